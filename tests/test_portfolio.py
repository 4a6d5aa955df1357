import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import strategy as st
from tidebar.sources import runs
from tidebar.streaming import portfolio as pf

T0 = dt.datetime(2024, 1, 1)
S = st.Strategy.of({"datapoints": [{"name": "m", "transformer": "sma", "args": [3]}], "enter": [["close", ">", "m"]], "exit": [["close", "<", "m"]], "lot_size": 0.5, "max_lot_size": 400.0})


def plain(rows):
    """Cash, quantity and equity after each (price, action)."""
    cash, held, out = 1000.0, 0.0, []
    for price, action in rows:
        if action == "e" and not held:
            spent = min(cash * 0.5, 400.0)
            cash, held = cash - spent, spent / price
        elif action == "x" and held:
            cash, held = cash + held * price, 0.0
        cash, held = round(cash, 8), round(held, 8)
        out.append((cash, held, round(cash + held * price, 8)))
    return out


def test_stream_equals_a_plain_loop(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(s, T0 + dt.timedelta(minutes=k), float(10 + rng.random()), str(rng.choice(["e", "x", "h"]))) for s in "ab" for k in range(60)]
    df = spark.createDataFrame(rows, pf.ACTIONS)
    path = str(tmp_path / "actions")
    for low, high in ((0, 25), (20, 60)):  # some bars come twice
        df.where((F.minute("ts") >= low) & (F.minute("ts") < high)).write.mode("append").parquet(path)
        stream = spark.readStream.schema(pf.ACTIONS).parquet(path)
        pf.act_on(stream, S).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "log")).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    for s in "ab":
        got = [(r.cash, r.position_qty, r.equity) for r in log.where(F.col("symbol") == s).orderBy("ts").collect()]
        np.testing.assert_allclose(got, plain([r[2:] for r in rows if r[0] == s]), rtol=1e-12)


def test_watch_takes_new_bars_of_a_store(spark, tmp_path):
    rng = np.random.default_rng(2)
    close = (20 + rng.normal(size=90).cumsum()).round(2)
    rows = [("x", "a", T0 + dt.timedelta(hours=k), *[float(c)] * 4, 1.0) for k, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "exchange string, symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    store, folder = str(tmp_path / "store"), str(tmp_path / "portfolio")
    for part in (bars.limit(50), bars.orderBy(F.desc("ts")).limit(40)):
        part.write.mode("append").partitionBy("exchange", "symbol").parquet(store)
        pf.watch(spark, store, S, folder)
    actions = {r.ts: r.action for r in spark.read.parquet(f"{folder}/actions").collect()}
    want = {r.ts: r.action for r in st.with_actions(st.with_datapoints(bars.drop("exchange"), S), S).collect()}
    assert actions == want
    log = spark.read.parquet(f"{folder}/log").orderBy("ts").collect()
    assert [r.equity for r in log] == pytest.approx([x[2] for x in plain([(c, want[r.ts]) for c, r in zip(close, log, strict=True)])])
    assert pf.traded(spark.read.parquet(f"{folder}/log")).where("side = 'BUY'").count() > 2 and pf.longest(S) == 200


def test_runs_are_saved_and_found(spark, tmp_path):
    path = str(tmp_path / "runs")
    summary = spark.createDataFrame([("a", 1.5, None)], "symbol string, return_perc double, note string")
    for k in range(3):
        runs.save_run(path, f"2024010{k}", summary.withColumn("return_perc", F.lit(float(k))), summary, summary)
    assert [r.return_perc for r in runs.saved_runs(spark, path, 2).collect()] == [2.0, 1.0]
    assert runs.saved_runs(spark, path, name="20240101").first().return_perc == 1.0 and runs.load_run(spark, path, "20240100", "trade_log").count() == 1
    assert runs.markdown(summary).splitlines()[2] == "| a | 1.5 |  |"
    bars = spark.createDataFrame([(s,) for s in "cab"], "symbol string")
    assert [r.symbol for r in runs.universe(bars, most=2).collect()] == ["a", "b"] and runs.universe(bars, ["c"]).count() == 1
