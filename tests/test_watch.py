"""A portfolio that watches a store of snapshots, its status and log."""

import datetime as dt

import numpy as np

from tidebar.operators import strategy as st
from tidebar.sources.store import SCHEMA, BarStore
from tidebar.streaming import portfolio as pf

T0 = dt.datetime(2024, 1, 1)
S = st.Strategy.of({"datapoints": [{"name": "m", "transformer": "sma", "args": [3]}], "enter": [["close", ">", "m"]], "exit": [["close", "<", "m"]]})


def test_status_log_and_late_bars(spark, tmp_path):
    rng = np.random.default_rng(9)
    close = {s: (20 + rng.normal(size=60).cumsum()).round(2).tolist() for s in "ab"}
    bars = spark.createDataFrame([("x", s, T0 + dt.timedelta(hours=k), *[c] * 4, 1.0) for s in "ab" for k, c in enumerate(close[s])], SCHEMA)
    store, folder = f"{tmp_path}/store", f"{tmp_path}/portfolio"
    held = BarStore(spark, store)
    held.commit(bars.where("ts < timestamp'2024-01-02 06:00:00'"))
    pf.watch(spark, store, S, folder)
    held.commit(bars.where("ts >= timestamp'2024-01-02 04:00:00'"))  # two hours come again as they were
    held.compact()
    pf.watch(spark, store, S, folder)
    want = {(r.symbol, r.ts): r.action for r in st.with_actions(st.with_datapoints(bars.drop("exchange"), S), S).collect()}
    log = spark.read.parquet(f"{folder}/log").collect()
    assert {(r.symbol, r.ts) for r in log} == set(want) and len(log) == 120
    assert all(r.action in (want[r.symbol, r.ts], "h") for r in log) and sum(r.side is not None for r in log) > 4
    now = {r.symbol: r for r in pf.status(spark, folder).collect()}
    assert {s: (r.ts, r.price) for s, r in now.items()} == {s: (T0 + dt.timedelta(hours=59), close[s][-1]) for s in "ab"}
    assert pf.passed_over(spark, folder).count() == 0
    held.commit(bars.where("symbol = 'a' and ts = timestamp'2024-01-02 00:00:00'").withColumn("close", bars.close + 5))
    pf.watch(spark, store, S, folder)
    late = pf.passed_over(spark, folder).collect()
    assert [(r.symbol, r.ts, r.close) for r in late] == [("a", dt.datetime(2024, 1, 2), close["a"][24] + 5)]
    assert {r.symbol: (r.ts, r.equity) for r in pf.status(spark, folder).collect()} == {s: (r.ts, r.equity) for s, r in now.items()}
    assert [r.ts for r in pf.tail(spark, folder, 2).collect()] == [T0 + dt.timedelta(hours=59)] * 2
    stream = pf.follow(spark, folder).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("followed").count() == 120
