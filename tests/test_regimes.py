import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidebar.operators import regimes as rg
from tidebar.operators import search
from tidebar.operators import strategy as st

T0 = dt.datetime(2024, 1, 1)


def frame(spark, close):
    return spark.createDataFrame([("a", T0 + dt.timedelta(days=k), float(c), float(c) + 1, float(c) - 1, float(c), 100.0 + k) for k, c in enumerate(close)], ["symbol", "ts", "open", "high", "low", "close", "volume"])


def test_states_and_transitions(spark):
    df = rg.with_states(frame(spark, [100, 103, 104.5, 105, 104.9, 104.2, 102.7, 90]))
    got = [r.state for r in df.orderBy("ts").collect()]
    assert got == ["Stable", "Strong Increase", "Moderate Increase", "Slight Increase", "Stable", "Slight Decrease", "Moderate Decrease", "Strong Decrease"]
    pairs = {(r.source, r.target): (r["count"], r.probability) for r in rg.transitions(df).collect()}
    assert pairs[("Stable", "Strong Increase")] == (1, 0.5)
    assert sum(n for n, _ in pairs.values()) == 7


def test_features_and_label(spark):
    df = rg.regime_features(frame(spark, [100 + 2 * k for k in range(30)])).orderBy("ts").collect()
    assert df[18].trend == 0 and df[19].trend == pytest.approx(2)
    assert df[0].ret == 0 and df[1].ret == pytest.approx(0.02)
    rows = spark.createDataFrame([(5.0, 1.0, 0.0, 0.0), (-5.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0)], ["trend", "vol", "range", "volume_z"])
    assert [r.label for r in rows.withColumn("label", rg.regime_label()).collect()] == ["Risk-on", "Risk-off", "Mean reverting"]


def test_screen(spark):
    close = [1000] + [100] * 60 + [50]
    found = rg.screen(frame(spark, close), {"min_candles": 10, "max_drawdown_60d": -0.4}).first()
    assert (found.candles, found.max_drawdown_60d, found.reason) == (62, -0.5, "drawdown")
    assert rg.screen(frame(spark, close), {"min_candles": 90}).first().reason == "candles"
    assert rg.screen(frame(spark, close).limit(0), {}).count() == 0


def test_sweep_equals_single_runs(spark):
    bars = frame(spark, [10, 11, 12, 11, 10, 12, 13, 9]).cache()
    documents = {str(n): {"datapoints": [{"name": "m", "transformer": "sma", "args": [n]}], "enter": [["close", ">", "m"]], "exit": [["close", "<", "m"]]} for n in (2, 3)}
    got = {r.variant: r.asDict() for r in st.sweep(bars, documents).collect()}
    for name, d in documents.items():
        want = st.summarize(st.backtest(bars, st.Strategy.of(d))).first().asDict()
        assert {k: v for k, v in got[name].items() if k != "variant"} == want


def test_fitness(spark):
    df = spark.createDataFrame([(2.0, -10.0, 3)], ["return_perc", "max_drawdown_pct", "num_trades"])
    assert df.select(st.fitness({"return_perc": 2, "max_drawdown_pct": -0.1}, 5)).first()[0] == pytest.approx(4 - 1 - 5)
    assert df.select(F.round(st.fitness({}, 0), 3)).first()[0] == 0


def test_genes_and_search(spark):
    document = {"datapoints": [{"name": "m", "transformer": "#kind", "args": ["#n", 2.6]}], "enter": [["close", ">", "#column_a"]], "exit": [["close", "<", "m"]], "lot_size": "#lot"}
    got = search.with_genes(document, {"kind": "sma", "n": lambda: 4.2, "column_a": 5, "lot": 0.5}, columns=True)
    assert got["datapoints"][0] == {"name": "m", "transformer": "sma", "args": [4, 3]} and got["enter"] == [["close", ">", "open"]] and got["lot_size"] == 0.5
    assert document["lot_size"] == "#lot" and search.with_genes(document, {})["lot_size"] == "#lot" and search.with_mods(got, {"lot_size": 1})["lot_size"] == 1
    assert search.with_genes(document, {"freq": 99})["freq"] == "12h" and search.with_genes(document, {"freq": "1h"})["freq"] == "1h"
    wave = frame(spark, [100 + 10 * ((k % 12) - 6 if k % 24 < 12 else 6 - k % 12) / 6 for k in range(120)]).cache()
    crossing = {"datapoints": [{"name": "m", "transformer": "sma", "args": ["#n"]}], "enter": [["close", ">", "m"]], "exit": [["close", "<", "m"]]}
    best = search.search(wave, crossing, {"n": lambda r: r.randrange(2, 20)}, {"return_perc": 1.0}, size=8, generations=2, keep=3, min_trades=0)
    assert len(best) <= 3 and [f for _, f in best] == sorted((f for _, f in best), reverse=True)
    alone = st.summarize(st.backtest(wave, st.Strategy.of(search.with_genes(crossing, best[0][0])))).first().return_perc
    assert alone == pytest.approx(best[0][1])


def test_ranks_and_horizons(spark):
    rows = [(s, T0 + dt.timedelta(days=k), float(100 + step * k)) for s, step in (("a", 1), ("b", 2), ("c", -0.5)) for k in range(80)] + [("d", T0, 5.0)]
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    got = {r.symbol: r for r in rg.ranked(rg.horizon_quantiles(bars)).collect()}
    assert [got[s]["rank"] for s in "bacd"] == [1, 2, 3, 4] and got["d"].score is None
    moves = sorted((100 + k + 30) / (100 + k) - 1 for k in range(50))
    assert got["a"].p50_30 == pytest.approx((moves[24] + moves[25]) / 2)


def test_datapoints_can_see_earlier_bars(spark):
    bars = frame(spark, range(1, 11))
    s = st.Strategy.of({"datapoints": [{"name": "m", "transformer": "sma", "args": [4]}], "start": "2024-01-05"})
    assert [r.m for r in st.with_datapoints(bars, s).orderBy("ts").collect()][:4] == [None, None, None, 6.5]
    assert [r.m for r in st.with_datapoints(bars, s, warm_up=True).orderBy("ts").collect()] == [3.5, 4.5, 5.5, 6.5, 7.5, 8.5]
