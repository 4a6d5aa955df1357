"""Forecasts against the enumeration of all paths."""

import datetime as dt
import itertools

import numpy as np
import pytest

from tidebar.operators import forecast as fc

T0 = dt.datetime(2024, 1, 1)


def test_quantiles_are_within_their_error_of_all_paths(spark):
    """Every sequence of states and seen returns with its chance; a state that was never seen is not entered."""
    rng = np.random.default_rng(3)
    rows, matrices = [], {"a": [[0.7, 0.2, 0.1], [0.3, 0.5, 0.2], [0.3, 0.3, 0.4]], "b": [[0.5, 0.5, 0.0], [0.1, 0.9, 0.0], [0.2, 0.2, 0.6]]}
    for symbol in "ab":
        close = np.exp(rng.normal(0, 0.1, 9).cumsum())
        states = rng.integers(0, 3 if symbol == "a" else 2, 9)
        states[:3] = [0, 1, 2 if symbol == "a" else 0]
        rows += [(symbol, T0 + dt.timedelta(days=k), float(c), int(s)) for k, (c, s) in enumerate(zip(close, states, strict=True))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, state int")
    moves = spark.createDataFrame([(n, np.ravel(m).tolist()) for n, m in matrices.items()], "symbol string, moves array<double>")
    got = {(r.symbol, r.horizon): r for r in fc.forecast(df, moves, (1, 3)).collect()}
    assert len(got) == 4
    for symbol in "ab":
        mine = [r for r in rows if r[0] == symbol]
        returns = {s: [np.log(b[2] / a[2]) for a, b in itertools.pairwise(mine) if b[3] == s] for s in range(3)}
        m = np.array(matrices[symbol]) * [bool(returns[s]) for s in range(3)]
        m = m / m.sum(axis=1, keepdims=True)
        for horizon in (1, 3):
            sums, chances = [], []
            for path in itertools.product(range(3), repeat=horizon):
                chance = np.prod([m[a, b] for a, b in itertools.pairwise((mine[-1][3], *path))])
                for chosen in itertools.product(*(returns[s] for s in path)) if chance else ():
                    sums.append(sum(chosen))
                    chances.append(chance / np.prod([len(returns[s]) for s in path]))
            order = np.argsort(sums)
            line = np.cumsum(np.array(chances)[order])
            assert line[-1] == pytest.approx(1)
            r = got[symbol, horizon]
            for q in fc.QUANTILES:
                exact = np.array(sums)[order][np.searchsorted(line, q / 100 - 1e-9)]
                assert abs(np.log1p(r[f"p{q}"]) - exact) <= r.error + 1e-9
            assert 0 < r.error < 0.001


def test_screen_lists_what_it_skips(spark):
    rng, rows = np.random.default_rng(1), []
    for symbol, n, drift in (("up", 150, 0.01), ("down", 150, -0.01), ("few", 20, 0.0), ("thin", 150, 0.0)):
        close = 100 * np.exp((drift + rng.normal(0, 0.02, n)).cumsum())
        volume = 0.001 if symbol == "thin" else 1000.0
        rows += [(symbol, T0 + dt.timedelta(days=k), c, c * 1.01, c * 0.99, c, volume) for k, c in enumerate(close.tolist())]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    got = {r.symbol: r for r in fc.screen_by_forecast(df, {"min_candles": 90, "min_avg_quote_volume_30d": 10.0}, 2, 3).collect()}
    assert (got["up"]["rank"], got["down"]["rank"]) == (1, 2) and got["up"].score > 0 > got["down"].score
    assert (got["few"].reason, got["thin"].reason) == ("candles", "quote volume") and got["few"]["rank"] is None is got["thin"].score
    assert got["up"].p10_30 < got["up"].p50_30 < got["up"].p90_30 < got["up"].p90_60 and got["up"].current_state in (0, 1)
