"""Scans and slices against plain loops and against the same work symbol by symbol."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions import scans, slices
from tidebar.functions.indicators import look_back, with_indicators
from tidebar.operators import strategy as st

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for symbol, n in (("long", 400), ("short", 7), ("gaps", 150)):
        close = 50 + rng.normal(size=n).cumsum()
        minutes = np.cumsum(rng.choice([10, 10, 10, 30], n)) if symbol == "gaps" else 10 * np.arange(n)
        rows += [(symbol, T0 + dt.timedelta(minutes=int(m)), c - 0.1, c + 1, c - 1, c, float(rng.integers(0, 9))) for m, c in zip(minutes, close.tolist(), strict=True)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double").repartition(3).cache()


@pytest.mark.parametrize("length", [2, 3, 512])
def test_affine_scan(spark, monkeypatch, length):
    """Blocks and packs of blocks of any length give the values of a plain loop; nothing before the first start, nothing after a missing step until the next start."""
    monkeypatch.setattr(scans, "LENGTH", length)
    rng = np.random.default_rng(length)
    rows, want = [], {}
    for key, n in (("a", 60), ("b", 1), ("c", 17)):
        y = math.nan
        for t in range(n):
            a = 0.0 if rng.random() < 0.15 else float(rng.normal())
            c = math.nan if rng.random() < 0.05 else float(rng.normal())
            y = c if a == 0 else a * y + c
            rows.append((key, t, t // length, a, c, 1 - a, f"row {t}"))
            want[key, t] = y
    df = spark.createDataFrame(rows, "k string, t int, block long, a double, c double, z double, note string").repartition(5)
    got = scans.affine(df, ["k"], "t", "block", [("a", "c"), ("z", "c")], ["y", "other"]).collect()
    assert len(got) == len(want) and all(r.note == f"row {r.t}" for r in got)
    np.testing.assert_allclose([r.y for r in got], [want[r.k, r.t] for r in got], rtol=1e-9)


def test_cut(spark, bars):
    """Each bar is in one slice, and again in the next one's halo if it is one of the last bars before it."""
    rows = slices.cut(bars, 40, 15).orderBy("symbol", "_slice", "ts").collect()
    own = [(r.symbol, r.ts, r._slice) for r in rows if r._own]
    assert len(own) == bars.count() == len({x[:2] for x in own})
    for symbol in ("long", "gaps", "short"):
        mine = sorted(x[1:] for x in own if x[0] == symbol)
        assert [s for _, s in mine] == sorted(s for _, s in mine)
        for number in {s for _, s in mine} - {0}:
            start = next(t for t, s in mine if s == number)
            halo = sorted(r.ts for r in rows if r.symbol == symbol and r._slice == number and not r._own)
            assert len(halo) >= 15 and halo == [t for t, _ in mine if t < start][-len(halo) :]
    assert max(x[2] for x in own) >= 9
    with pytest.raises(Exception, match="too many bars"):
        slices.cut(bars, 40, span=10**6).collect()


@pytest.mark.parametrize("name, args", [("sma", [7]), ("ema", [5]), ("macd", []), ("kama", []), ("ev_macd", [5, 9, 4]), ("vwap", []), ("obv", []), ("dymi", []), ("vortex", [])])
def test_indicators_by_slices(bars, name, args):
    """Windows, decaying means, running totals, scans, and one that takes all bars together."""
    assert (look_back(name, args) is None) == (name == "vortex")
    both = [with_indicators(bars, [("x", name, args)], slice_rows=n).orderBy("symbol", "ts").drop(*(bars.columns)).toPandas().astype(float) for n in (None, 60)]
    assert len(both[0]) == 557 and both[0].notna().any().all()
    np.testing.assert_allclose(both[1], both[0], rtol=1e-9, atol=1e-9)


DOCUMENT = {
    "datapoints": [{"name": "fast", "transformer": "sma", "args": [3]}, {"name": "slow", "transformer": "ema", "args": [9]}, {"name": "hour", "transformer": "sma", "args": [2], "freq": "1h"}],
    "enter": [["fast", ">", "slow", 2]],
    "exit": [["fast", "<", "slow", 3]],
    "any_exit": [["fast", "<", "hour", 2]],
    "comission": 0.1,
}


@pytest.mark.parametrize("more", [{}, {"freq": "10Min", "trailing_stop_loss": 0.1, "exit_on_end": True}])
def test_account_by_slices(bars, more):
    s = st.Strategy.of(DOCUMENT | more)
    whole, cut = (st.backtest(bars, s, slice_rows=n).orderBy("symbol", "ts").toPandas() for n in (None, 50))
    assert set(whole.columns) == set(cut.columns) and len(whole) == len(cut)
    assert whole.action.nunique() >= 3
    for c in whole.columns:
        if whole[c].dtype.kind == "f":
            np.testing.assert_allclose(cut[c].astype(float), whole[c].astype(float), rtol=1e-9, atol=1e-6)
        else:
            assert (cut[c] == whole[c]).all(), c


def test_stages_leave_one_table(spark, bars):
    stages = slices.Stages()
    first = stages(bars.limit(3))
    path = stages.path
    assert stages(first.withColumn("x", F.lit(1))).count() == 3
    assert not os.path.exists(path.removeprefix("file:"))
