"""Forecasts from market states, by carrying distributions forward instead of drawing paths.

From the present state a symbol moves by its transition matrix, and in each state
its log return is one of those seen there. Returns are put on a grid, so the sum of
some bars' returns has a distribution on the grid too; in Fourier space a step is a
product with each state's returns and the transition matrix, and quantiles are
read off the sums. A return lies at most half a grid step off its place, so every
log quantile over h bars is within ``error`` = h/2 grid steps of the exact one.

Spark makes the histograms; what reaches the task of a symbol is bounded by the
grid, however long its history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hmm
from .regimes import ranked, screen, screen_features

#: Points of the grid; fixed values: the quantiles of a forecast, its horizons in bars and the features of its states.
GRID = 1 << 16
QUANTILES = (10, 25, 50, 75, 90)
HORIZONS = (30, 60)
FEATURES = ["ret", "vol", "range", "trend", "drawdown"]


def _carried(keys: list[str], horizons: tuple[int, ...]):
    def quantiles(row) -> Iterator[tuple]:
        k = int(np.sqrt(len(row.moves)))
        moves = np.reshape(row.moves, (k, k))
        seen = np.zeros((k, GRID))
        for cell in row.cells:
            seen[cell["state"], int(cell["bin"]) % GRID] += cell["n"]
        visited = seen.sum(axis=1) > 0
        chances = seen / np.maximum(seen.sum(axis=1), 1)[:, None]
        moves = np.where(visited, moves, 0.0)
        moves = moves / np.maximum(moves.sum(axis=1), 1e-300)[:, None]
        moved = np.fft.rfft(chances, axis=1)
        now = np.zeros((k, moved.shape[1]), complex)
        now[row.state] = 1
        for h in range(1, max(horizons) + 1):
            now = (moves.T @ now) * moved
            if h in horizons:
                total = np.fft.irfft(now.sum(axis=0), GRID)
                line = np.cumsum(np.maximum(np.concatenate([total[GRID // 2 :], total[: GRID // 2]]), 0.0))
                at = np.searchsorted(line, [q / 100 * line[-1] * (1 - 1e-12) for q in QUANTILES]) - GRID // 2
                yield h, *(float(x) for x in np.expm1(at * row.width)), float(h * row.width / 2)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(*(getattr(r, n) for n in keys), *q) for r in frame.itertuples(index=False) for q in quantiles(r)]
            yield pd.DataFrame(out, columns=[*keys, "horizon", *(f"p{q}" for q in QUANTILES), "error"])

    return run


def forecast(df: DataFrame, moves: DataFrame, horizons: tuple[int, ...] = HORIZONS, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, horizon, p10, p25, p50, p75, p90, error): quantiles of the change of the close over each horizon, from the last bar's state.

    ``df`` has the bars with ``state``, ``moves`` (keys, moves) each key's transition
    matrix, row after row. Bars without a positive close before and at them have no
    return; keys without any return, or without a matrix, are left out. States that
    no bar was in are not entered.
    """
    w, names = Window.partitionBy(*keys).orderBy("ts"), list(keys)
    before = F.lag("close").over(w)
    steps = df.select(*keys, "ts", F.col("state").cast("int").alias("state"), F.when((F.col("close") > 0) & (before > 0), F.ln(F.col("close") / before)).alias("r"))
    # the grid is wide enough for the largest return at every step
    width = F.greatest(F.max(F.abs("r")) * 2 * (max(horizons) + 1) / GRID, F.lit(1e-12))
    last = steps.groupBy(*keys).agg(F.max_by("state", "ts").alias("state"), width.alias("width"), F.count("r").alias("n")).where("n > 0")
    counted = steps.where("r is not null").join(last.select(*keys, "width"), names).groupBy(*keys, "state", F.rint(F.col("r") / F.col("width")).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    cells = counted.groupBy(*keys).agg(F.collect_list(F.struct("state", "bin", "n")).alias("cells"))
    whole = last.drop("n").join(moves.select(*keys, "moves"), names).join(cells, names)
    kinds = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return whole.mapInPandas(_carried(names, tuple(horizons)), f"{kinds}, horizon int, {', '.join(f'p{q} double' for q in QUANTILES)}, error double")


def forecast_symbols(bars: DataFrame, states: int = 3, rounds: int = 20, least: int = 90, horizons: tuple[int, ...] = HORIZONS, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Forecasts of every key with at least ``least`` bars, from a hidden Markov model of its own, with the state of its last bar."""
    enough = F.count(F.lit(1)).over(Window.partitionBy(*keys)) >= least
    df = screen_features(bars.where("close is not null").withColumn("_enough", enough).where("_enough").drop("_enough"), keys)
    model = hmm.train(df, FEATURES, states, rounds, keys)
    seen = hmm.apply(df, model, FEATURES, keys)
    now = seen.groupBy(*keys).agg(F.max_by("state", "ts").alias("current_state"))
    return forecast(seen, model.select(*keys, "moves"), horizons, keys).join(now, list(keys))


def screen_by_forecast(bars: DataFrame, filters: dict, states: int = 3, rounds: int = 20, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every key with its forecasts over 30 and 60 bars, score and rank, the best first; skipped keys come last with a ``reason`` and without a rank."""
    checked = screen(bars, filters, keys)
    found = forecast_symbols(bars, states, rounds, max(int(filters.get("min_candles", 0)), 90), HORIZONS, keys)
    wide = found.groupBy(*keys).agg(
        F.first("current_state").alias("current_state"), *(F.max(F.when(F.col("horizon") == h, F.col(c))).alias(f"{c}_{h}") for h in HORIZONS for c in (*(f"p{q}" for q in QUANTILES), "error"))
    )
    every = checked.join(wide, list(keys), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("p50_30").isNull(), "no forecast")))
    numbers = [c for c in wide.columns if c not in keys]
    every = every.withColumns({c: F.when(F.col("reason").isNull(), F.col(c)) for c in numbers})
    return ranked(every).withColumn("rank", F.when(F.col("reason").isNull(), F.col("rank")))
