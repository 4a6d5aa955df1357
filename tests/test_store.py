"""The store of snapshots, and runs whose names look like numbers."""

import datetime as dt
import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from tidebar.sources import bars as src
from tidebar.sources import runs
from tidebar.sources.store import SCHEMA, BarStore, Conflict

T0 = dt.datetime(2024, 1, 1)


def rows(spark, symbol, hours, value, exchange="x"):
    made = [(exchange, symbol, T0 + dt.timedelta(hours=h), *[float(value)] * 5) for h in hours]
    return spark.createDataFrame(made, SCHEMA)


def closes(df):
    return {(r.exchange, r.symbol, (r.ts - T0).total_seconds() // 3600): r.close for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return BarStore(spark, f"{tmp_path}/store")


def test_keys_are_text_and_new_bars_replace_old_ones(spark, store):
    assert store.read().count() == 0 and store.versions() == []
    assert store.commit(rows(spark, "0700", range(5), 1).unionByName(rows(spark, "1INCH", range(5), 2, "007"))) == 1
    assert store.commit(rows(spark, "0700", range(3, 8), 9)) == 2
    want = {("x", "0700", h): 1.0 for h in range(3)} | {("x", "0700", h): 9.0 for h in range(3, 8)} | {("007", "1INCH", h): 2.0 for h in range(5)}
    assert closes(store.read()) == want
    assert closes(store.read(symbol="0700", start=T0 + dt.timedelta(hours=6))) == {("x", "0700", 6): 9.0, ("x", "0700", 7): 9.0}
    assert store.read(exchange="7").count() == 0 and store.read(stop=T0).count() == 2
    assert sorted(map(tuple, store.assets().collect())) == [("007", "1INCH"), ("x", "0700")]


def test_a_snapshot_stays_what_it_is(spark, store):
    store.commit(rows(spark, "a", range(4), 1))
    old = store.read()
    store.commit(rows(spark, "a", range(4), 2))
    assert set(closes(old).values()) == {1.0} and set(closes(store.read(version=1)).values()) == {1.0} and set(closes(store.read()).values()) == {2.0}
    assert closes(store.since(1)) == closes(store.read()) and store.since(2).count() == 0
    with pytest.raises(ValueError):
        store.read(version=7)


def test_an_unfinished_commit_is_not_seen(spark, store):
    store.commit(rows(spark, "a", range(4), 1))
    store._written(rows(spark, "a", range(4), 5), "000000000002-lost")  # a writer that died before its manifest
    os.makedirs(f"{store.path}/snapshots", exist_ok=True)
    open(f"{store.path}/snapshots/000000000002", "w").close()  # and one that died while it published
    assert store.versions() == [1] and set(closes(store.read()).values()) == {1.0}
    with pytest.raises(Conflict):
        store.commit(rows(spark, "a", range(4), 6))
    assert set(closes(store.read()).values()) == {1.0}


def test_one_of_two_writers_wins(spark, store):
    store.commit(rows(spark, "a", range(2), 0))
    done = []

    def write(k):
        try:
            done.append(store.commit(rows(spark, "a", [k + 5], k)))
        except Conflict:
            done.append(None)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(store.read().collect()) == 2 + sum(d is not None for d in done) and any(done)


def test_broken_files_are_passed_over_and_listed(spark, store):
    store.commit(rows(spark, "a", range(4), 1))
    store.commit(rows(spark, "b", range(4), 2))
    broken = glob.glob(f"{store.path}/data/000000000002-*/*.parquet")
    for name in broken:
        with open(name, "w") as f:
            f.write("no Parquet")
    assert {k[1] for k in closes(store.read())} == {"a"}
    listed = store.corrupt().collect()
    assert [(r.bars, r.readable) for r in listed] == [(4, 0)] and {os.path.basename(r.file) for r in listed} == set(map(os.path.basename, broken))
    store.commit(rows(spark, "b", range(2, 6), 3))  # and don't stop a merge or compaction
    store.commit(rows(spark, "a", range(3, 5), 4))
    store.compact()
    assert closes(store.read()) == {("x", "a", h): 1.0 for h in range(3)} | {("x", "a", h): 4.0 for h in (3, 4)} | {("x", "b", h): 3.0 for h in range(2, 6)}
    assert store.corrupt().count() == 1


def test_compaction_and_vacuum(spark, store):
    for k in range(4):
        store.commit(rows(spark, "a", range(k, k + 6), k).unionByName(rows(spark, f"own{k}", [1], k)))
    before, files = closes(store.read()), store.manifest().select("file").distinct().count()
    assert store.compact() == 5 and store.compact() is None
    assert closes(store.read()) == before and store.manifest().select("file").distinct().count() < files
    assert store.since(4).count() == 0
    gone = store.vacuum()
    assert closes(store.read()) == before and store.versions() == [5] and len(gone) >= 8


def test_repeated_and_useless_rows(spark, store):
    bars = rows(spark, "a", [1, 1, 2], 1).unionByName(rows(spark, "a", [1], 3))
    nothing = spark.createDataFrame([(None, "a", T0, 1.0), ("x", None, T0, 1.0), ("x", "a", None, 1.0)], "exchange string, symbol string, ts timestamp, open double")
    store.commit(bars.withColumn("more", F.lit("column")).withColumn("age", F.lit(5)).unionByName(nothing, allowMissingColumns=True))
    assert closes(store.read()) == {("x", "a", 1): 3.0, ("x", "a", 2): 1.0}
    store.commit(bars.limit(0))
    assert store.read().count() == 2 and store.versions() == [1, 2]


def test_a_partitioned_folder_is_taken_over(spark, tmp_path):
    path = f"{tmp_path}/old"
    rows(spark, "0700", range(3), 1).write.partitionBy("exchange", "symbol").parquet(path)
    assert [r.symbol for r in src.assets(spark, path).collect()] == ["0700"]
    src.upsert(spark, rows(spark, "0700", [2, 3], 2), path)
    assert closes(src.read_store(spark, path)) == {("x", "0700", 0): 1.0, ("x", "0700", 1): 1.0, ("x", "0700", 2): 2.0, ("x", "0700", 3): 2.0}
    assert src.scan(spark, path, "0700", "x", start="2024-01-01 02:00:00").count() == 2 and src.scan(spark, path, "700").count() == 0


def test_names_of_runs_are_text(spark, tmp_path):
    path = f"{tmp_path}/runs"
    summary = spark.createDataFrame([("a", 1.5)], "symbol string, return_perc double")
    names = ["007", "010", "2024-01-01", "with space", "a+b", "1e3"]
    for name in names:
        runs.save_run(path, name, summary, summary)
    assert sorted(r.run for r in runs.saved_runs(spark, path).collect()) == sorted(names)
    for name in names:
        assert runs.saved_runs(spark, path, name=name).count() == 1 and runs.load_run(spark, path, name).count() == 1
    assert runs.saved_runs(spark, path, name="7").count() == 0
    with pytest.raises(ValueError):
        runs.save_run(path, "a/b", summary)


def test_csv_and_screens(spark, tmp_path):
    with open(tmp_path / "a.csv", "w") as f:
        f.write("date,close,open,high,low,volume,mood\n1704067200,2,1,3,0.5,10,7\n1704067200,9,9,9,9,9,9\n1704067260000,4,,x,1,0,8\n2024-01-01 00:02:00,5,5,5,5,5,5\n")
    got = src.read_csv(spark, str(tmp_path / "a.csv"), "s").orderBy("ts").collect()
    assert [(r.symbol, r.ts.minute, r.close, r.open, r.high, r.mood) for r in got] == [("s", 0, 2, 1, 3, 7), ("s", 1, 4, None, None, 8), ("s", 2, 5, 5, 5, 5)]
    open(tmp_path / "empty.csv", "w").close()
    with pytest.raises(ValueError):
        src.read_csv(spark, str(tmp_path / "empty.csv"), "s")
    screen = spark.createDataFrame([("a", None, 1)], "symbol string, score double, rank int")
    runs.save_screen(screen, f"{tmp_path}/screen")
    assert '"score":null' in "".join(open(n).read() for n in glob.glob(f"{tmp_path}/screen/*.json"))
