"""Payloads of three formats, documents in files, and what a document must have."""

import datetime as dt
import json
import os

import pytest

from tidebar.operators import strategy as st
from tidebar.sources import documents as docs
from tidebar.sources import payloads as pay
from tidebar.sources.store import BarStore

T0 = dt.datetime(2024, 1, 1)
S0 = 1704067200


def put(root, exchange, symbol, name, content):
    folder = os.path.join(root, exchange, symbol)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(content if isinstance(content, str) else json.dumps(content))


def candles(kind, minutes, base=10.0):
    rows = [(S0 + 60 * m, base + m, base + m + 2, base + m - 1, base + m + 1, 5.0 + m) for m in minutes]
    if kind == "binance":
        return [[t * 1000, str(o), str(h), str(lo), str(c), str(v), t * 1000 + 59_999, "1", 3, "1", "1", "0"] for t, o, h, lo, c, v in rows]
    if kind == "coinbase":
        return [[t, lo, h, o, c, v] for t, o, h, lo, c, v in reversed(rows)]
    return [{"t": t * 1000, "T": t * 1000 + 59_999, "s": "X", "o": str(o), "h": str(h), "l": str(lo), "c": str(c), "v": str(v), "n": 4} for t, o, h, lo, c, v in rows]


def test_three_formats_give_equal_bars(spark, tmp_path):
    root = str(tmp_path / "in")
    for exchange in pay.EXCHANGES:
        put(root, exchange, "0700", "a b+c.json", candles(exchange if exchange != "binanceus" else "binance", range(4)))
    put(root, "coinbase", "EMPTY", "1.json", [])
    put(root, "coinbase", "BAD", "1.json", '{"message": "not found"}')
    put(root, "coinbase", "CUT", "1.json", "[[17040")
    put(root, "elsewhere", "X", "1.json", candles("coinbase", range(2)))
    put(root, "coinbase", "GAPS", "1.json", [[S0, 1, 2, None, 4, 5], ["x", 1, 2, 3, 4, 5], [S0, 1, 2, 3, 4], [S0 + 60, 1, 2, 3, 4, 5]])
    got = pay.read_payloads(spark, root).orderBy("exchange", "ts").collect()
    bars = {}
    for r in got:
        if r.symbol == "0700":
            bars.setdefault(r.exchange, []).append((r.ts, r.open, r.high, r.low, r.close, r.volume))
    want = [(T0 + dt.timedelta(minutes=m), 10.0 + m, 12.0 + m, 9.0 + m, 11.0 + m, 5.0 + m) for m in range(4)]
    assert bars == dict.fromkeys(pay.EXCHANGES, want)
    assert [(r.symbol, r.ts.minute, r.open) for r in got if r.symbol != "0700"] == [("GAPS", 1, 3.0)]
    assert sorted((r.exchange, r.symbol) for r in pay.unreadable(spark, root).collect()) == [("coinbase", "BAD"), ("coinbase", "CUT"), ("elsewhere", "X")]


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    root, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    put(root, "binance", "BTC", "1.json", candles("binance", range(5)))
    put(root, "hyperliquid", "ETH", "1.json", candles("hyperliquid", range(3)))
    assert pay.ingest(spark, root, store, mark) == 1
    assert pay.ingest(spark, root, store, mark) == 1  # nothing new
    put(root, "binance", "BTC", "2.json", candles("binance", range(4, 8), 100.0))
    assert pay.ingest(spark, root, store, mark) == 2
    held = BarStore(spark, store)
    assert held.since(1).count() == 4 and [r.open for r in held.read(symbol="BTC").orderBy("ts").collect()] == [10, 11, 12, 13, 104, 105, 106, 107]
    wanted = spark.createDataFrame([("binance", "BTC", T0), ("coinbase", "NEW", T0)], "exchange string, symbol string, first timestamp")
    spans = sorted(map(tuple, pay.missing_windows(held, wanted, T0 + dt.timedelta(minutes=12), "1Min", 4).collect()))
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    assert spans == [("binance", "BTC", minute(8), minute(11)), ("binance", "BTC", minute(12), minute(12)), *(("coinbase", "NEW", minute(m), minute(min(m + 3, 12))) for m in (0, 4, 8, 12))]


def test_documents_in_files(spark, tmp_path):
    document = {"datapoints": [{"name": "m", "transformer": "sma", "args": [3]}], "enter": [["close", ">", "m"]], "exit": [["close", "<", "m", 2]], "any_enter": None, "start": "2024-01-01", "lot_size": 0.5}
    for name in ("b.yml", "a.json", "c.yaml"):
        docs.write_document(spark, f"{tmp_path}/{name}", document)
    (tmp_path / "notes.txt").write_text("no document")
    found = docs.read_documents(spark, str(tmp_path))
    assert list(found) == ["a.json", "b.yml", "c.yaml"] and all(d == document for d in found.values())
    assert st.Strategy.of(found["b.yml"], complete=True).lot_size == 0.5
    assert docs.read_documents(spark, f"{tmp_path}/a.json") == {"a.json": document}
    with pytest.raises(ValueError):
        docs.parse("- a\n- b")
    with pytest.raises(Exception, match="no documents|PATH_NOT_FOUND"):
        docs.read_documents(spark, str(tmp_path / "nothing*"))


def test_start_is_required_and_old_keys_are_named():
    document = {"datapoints": [], "enter": [["close", ">", 1]], "exit": [["close", "<", 1]], "start": ""}
    assert st.validate(document) == {}
    assert st.validate({k: v for k, v in document.items() if k != "start"}) == {"start": ["is missing"]}
    assert "deprecated" in st.validate(document | {"start_date": "2024"})["start_date"][0] and "deprecated" in st.validate(document | {"end_date": "2024"})["end_date"][0]


def test_finished_runs_are_validated(spark):
    bars = spark.createDataFrame([("a", T0, 1.0)], "symbol string, ts timestamp, m double")
    s = st.Strategy.of({"datapoints": [{"name": "m", "transformer": "sma"}, {"name": "k", "transformer": "macd"}]})
    assert st.validate_run(bars, s) == ["datapoint k has no column"]
    assert st.validate_run(bars.withColumn("k_macd_macd", bars.m).limit(0), s) == ["there are no bars"]
