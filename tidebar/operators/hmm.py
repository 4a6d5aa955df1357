"""Hidden Markov models with Gaussian features, trained and applied over many tasks a sequence.

A step of the forward recursion multiplies by a K x K matrix, so a block of rows
is one matrix, and the blocks of a sequence are put together from their matrices
alone. What enters and leaves each block is known then, and each block is finished
on its own: expected counts while training, posteriors and, with maxima instead of
sums, the best path while applying. A round of training is two passes over the
packed blocks; expected counts are added up by Spark, and the models are rows of a
table, one for each key, of which none passes through the driver.

Features are centred and scaled by the model's own mean and deviation. Training
starts from states spaced evenly from one deviation below the mean to one above,
with equal chances and ``STAY`` to remain, and takes a fixed number of rounds, so
that it gives the same model every time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Stages

#: Rows of a block, the chance to remain in a state at first, and the least variance of a scaled feature.
LENGTH, STAY, FLOOR = 1024, 0.8, 1e-3
_MODEL = "center array<double>, scale array<double>, start array<double>, moves array<double>, means array<double>, variances array<double>, loglik double"
PARTS = [c.split()[0] for c in _MODEL.split(", ")]


def _typed(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def packed(df: DataFrame, columns: list[str], keys: list[str], length: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_row``, their number in the sequence, and the blocks of features (keys, block, x); what is null or not finite counts as zero."""
    values = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0) for c in columns]
    rows = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    blocks = rows.groupBy(*keys, *(c for c in by if c not in keys), F.floor(F.col("_row") / length).alias("block")).agg(F.array_sort(F.collect_list(F.struct("_row", F.array(*values).alias("x")))).alias("r"))
    return rows, blocks.withColumn("x", F.col("r.x")).drop("r")


class _Batch:
    """Blocks of a batch side by side: densities ``b`` (block, row, state) relative to the greatest, whose logarithms are ``top``."""

    def __init__(self, frame: pd.DataFrame):
        self.n = np.array([len(x) for x in frame["x"]])
        longest, dims = int(self.n.max()), len(frame["center"].iloc[0])
        self.k = k = len(frame["start"].iloc[0])
        self.x = np.zeros((len(frame), longest, dims))
        for i, (x, center, scale) in enumerate(zip(frame["x"], frame["center"], frame["scale"], strict=True)):
            self.x[i, : len(x)] = (np.stack(x) - center) / scale
        part = lambda c, *shape: np.stack(list(frame[c])).reshape(len(frame), *shape)
        self.start, self.moves, means, variances = part("start", k), part("moves", k, k), part("means", k, dims), part("variances", k, dims)
        far = (self.x[:, :, None, :] - means[:, None]) ** 2 / variances[:, None]
        logs = -0.5 * (far.sum(axis=3) + np.log(2 * np.pi * variances).sum(axis=2)[:, None])
        self.top = logs.max(axis=2)
        self.b = np.exp(logs - self.top[:, :, None])
        self.first = frame["block"].to_numpy() == 0
        self.live = np.arange(longest)[None, :] < self.n[:, None]

    def step(self, t: int) -> np.ndarray:
        """The matrices of row t: the way from each state before to each state, and the density there. A sequence's first row comes from anywhere."""
        moves = np.where(self.first[:, None, None], self.start[:, None, :], self.moves) if t == 0 else self.moves
        return moves * self.b[:, t, None, :]


def _multiplied(batch: _Batch, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' matrices, each row divided by its greatest value, and the logarithms of these; with ``best`` of the likeliest path instead of all."""
    m = np.broadcast_to(np.eye(batch.k), (len(batch.n), batch.k, batch.k)).copy()
    logs = np.zeros((len(batch.n), batch.k))
    for t in range(batch.x.shape[1]):
        step = batch.step(t)
        new = (m[:, :, :, None] * step[:, None]).max(axis=2) if best else m @ step
        most = np.maximum(new.max(axis=2), 1e-300)
        live = batch.live[:, t]
        m[live] = (new / most[:, :, None])[live]
        logs[live] += np.log(most)[live]
    return m, logs


def _matrices(keys: list[str], best: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                m, logs = _multiplied(_Batch(frame), best)
                yield frame[[*keys, "block"]].assign(m=[x.ravel().tolist() for x in m], logs=logs.tolist())

    return run


def _scaled(values: np.ndarray) -> np.ndarray:
    """Values given by logarithms, relative to their sum."""
    out = np.exp(values - values.max())
    return out / out.sum()


def _ends(keys: list[str]):
    """What enters each block of a sequence, and the weight of what follows it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        k = len(frame["logs"].iloc[0])
        with np.errstate(divide="ignore"):
            full = [np.log(np.reshape(m, (k, k))) + np.asarray(s)[:, None] for m, s in zip(frame["m"], frame["logs"], strict=True)]
            alpha, enters = np.full(k, 1 / k), []
            for m in full:
                enters.append(alpha)
                alpha = _scaled(np.logaddexp.reduce(np.log(alpha)[:, None] + m, axis=0))
            beta, leaves = np.full(k, 1.0), []
            for m in reversed(full):
                leaves.append(beta)
                beta = _scaled(np.logaddexp.reduce(m + np.log(beta)[None, :], axis=1))
        return frame[[*keys, "block"]].assign(enters=enters, leaves=leaves[::-1])

    return run


def _best_ends(keys: list[str]):
    """The states before and at the end of each block on the best path."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        k = len(frame["logs"].iloc[0])
        with np.errstate(divide="ignore"):
            full = [np.log(np.reshape(m, (k, k))) + np.asarray(s)[:, None] for m, s in zip(frame["m"], frame["logs"], strict=True)]
        delta, before = np.zeros(k), []
        for m in full:
            before.append(delta)
            delta = (delta[:, None] + m).max(axis=0)
            delta = delta - delta.max()
        state, path = int(delta.argmax()), []
        for m, delta in zip(reversed(full), reversed(before), strict=True):
            entry = int((delta + m[:, state]).argmax())
            path.append((entry, state))
            state = entry
        return frame[[*keys, "block"]].assign(entry=[p[0] for p in path[::-1]], final=[p[1] for p in path[::-1]])

    return run


def _posteriors(batch: _Batch, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chances of the states, expected moves, log likelihood) of each block; chances are zero beyond its rows."""
    enters, leaves = np.stack(list(frame["enters"])), np.stack(list(frame["leaves"]))
    rows = batch.x.shape[1]
    alphas, alpha, loglik = np.zeros((rows, *enters.shape)), enters, np.zeros(len(enters))
    for t in range(rows):
        new = np.einsum("bi,bij->bj", alpha, batch.step(t))
        total = np.maximum(new.sum(axis=1), 1e-300)
        live = batch.live[:, t]
        alpha = np.where(live[:, None], new / total[:, None], alpha)
        loglik += np.where(live, np.log(total) + batch.top[:, t], 0.0)
        alphas[t] = alpha
    beta, gamma, moved = leaves, np.zeros((rows, *enters.shape)), np.zeros((len(enters), batch.k, batch.k))
    for t in range(rows - 1, -1, -1):
        live = batch.live[:, t]
        both = alphas[t] * beta
        gamma[t] = np.where(live[:, None], both / np.maximum(both.sum(axis=1), 1e-300)[:, None], 0.0)
        step = batch.step(t) * beta[:, None, :]
        ways = (alphas[t - 1] if t else enters)[:, :, None] * step
        counted = live & ~batch.first if t == 0 else live
        moved += np.where(counted[:, None, None], ways / np.maximum(ways.sum(axis=(1, 2)), 1e-300)[:, None, None], 0.0)
        back = step.sum(axis=2)
        beta = np.where(live[:, None], back / np.maximum(back.max(axis=1), 1e-300)[:, None], beta)
    return gamma.transpose(1, 0, 2), moved, loglik


def _counts(by: list[str]):
    """Each block's expected counts: at the start, of moves, of states, their features and squares, and the log likelihood."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            batch = _Batch(frame)
            gamma, moved, loglik = _posteriors(batch, frame)
            started = np.where(batch.first[:, None], gamma[:, 0], 0.0)
            parts = [started, moved, gamma.sum(axis=1), np.einsum("btk,btd->bkd", gamma, batch.x), np.einsum("btk,btd->bkd", gamma, batch.x**2), loglik]
            yield frame[by].assign(counts=np.concatenate([p.reshape(len(frame), -1) for p in parts], axis=1).tolist())

    return run


def _improved(by: list[str]):
    """The model that fits the counts best."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for counts, old in zip(frame["counts"], frame[PARTS].itertuples(index=False), strict=True):
                k, d = len(old.start), len(old.center)
                cut = np.cumsum([k, k * k, k, k * d, k * d])
                start, moves, total, sums, squares, loglik = np.split(np.asarray(counts), cut)
                moves, sums, squares = moves.reshape(k, k), sums.reshape(k, d), squares.reshape(k, d)
                away = moves.sum(axis=1, keepdims=True)
                moves = np.where(away > 0, moves / np.maximum(away, 1e-300), 1 / k)
                seen = total[:, None] > 1e-12
                means = np.where(seen, sums / np.maximum(total, 1e-300)[:, None], np.reshape(old.means, (k, d)))
                variances = np.where(seen, np.maximum(squares / np.maximum(total, 1e-300)[:, None] - means**2, FLOOR), np.reshape(old.variances, (k, d)))
                rows.append((old.center, old.scale, start / start.sum(), moves.ravel(), means.ravel(), variances.ravel(), float(loglik[0])))
            yield pd.concat([frame[by].reset_index(drop=True), pd.DataFrame(rows, columns=PARTS)], axis=1)

    return run


def _first_model(blocks: DataFrame, by: list[str], states: int) -> DataFrame:
    """Means and deviations of the features of each model's rows, and evenly spaced states."""
    each = blocks.select(*by, F.explode("x").alias("x")).select(*by, F.posexplode("x").alias("d", "v"))
    moments = each.groupBy(*by, "d").agg(F.avg("v").alias("c"), F.stddev_pop("v").alias("s"))
    model = moments.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("d", "c", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("s")))).alias("m"))
    spread = [0.0 if states == 1 else 2 * k / (states - 1) - 1 for k in range(states)]
    away = (1 - STAY) / max(states - 1, 1)
    moves = [1.0 if states == 1 else STAY if i == j else away for i in range(states) for j in range(states)]
    lits = lambda values: F.array(*map(F.lit, values))
    return model.select(
        *by,
        F.col("m.c").alias("center"),
        F.col("m.s").alias("scale"),
        lits([1 / states] * states).alias("start"),
        lits(moves).alias("moves"),
        F.flatten(F.transform(lits(spread), lambda s: F.transform("m", lambda _: s))).alias("means"),
        F.flatten(F.transform(lits(spread), lambda s: F.transform("m", lambda _: F.lit(1.0)))).alias("variances"),
        F.lit(None).cast("double").alias("loglik"),
    )


def _entered(blocks: DataFrame, keys: list[str], best: bool) -> DataFrame:
    """(keys, block, ...) of what enters and leaves each block, or of the best path's states there."""
    made = blocks.mapInPandas(_matrices(keys, best), f"{_typed(blocks, keys)}, block long, m array<double>, logs array<double>")
    extra = "entry int, final int" if best else "enters array<double>, leaves array<double>"
    return made.groupBy(*keys).applyInPandas((_best_ends if best else _ends)(keys), f"{_typed(blocks, keys)}, block long, {extra}")


def train(df: DataFrame, columns: list[str], states: int = 6, rounds: int = 20, keys: tuple[str, ...] = ("symbol",), by: tuple[str, ...] | None = None, length: int = LENGTH, watch: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """Models of the rows' features, a row for each value of ``by`` (None: of the keys; (): one model of all sequences).

    Sequences are the rows of a key in order of ``ts``. The table holds the model
    and ``loglik``, the likelihood of the rows under the model of the round before.
    ``watch`` is called with each round's number and models. No rows give no models.
    """
    by = list(keys if by is None else by) or ["_all"]
    df = df.withColumn("_all", F.lit(0)) if by == ["_all"] else df
    blocks = Stages()(packed(df, columns, list(keys), length, by)[1])
    stages = Stages()
    model = stages(_first_model(blocks, by, states))
    for number in range(rounds):
        whole = blocks.join(model, by)
        found = whole.join(_entered(whole, list(keys), False), [*keys, "block"]).mapInPandas(_counts(by), f"{_typed(blocks, by)}, counts array<double>")
        added = found.select(*by, F.posexplode("counts").alias("p", "c")).groupBy(*by, "p").agg(F.sum("c").alias("c"))
        total = added.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda x: x["c"]).alias("counts"))
        model = stages(total.join(model, by).mapInPandas(_improved(by), f"{_typed(blocks, by)}, {_MODEL}"))
        if watch:
            watch(number, model)
    return model


def _paths(keys: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            batch = _Batch(frame)
            gamma = _posteriors(batch, frame)[0]
            rows, many = batch.x.shape[1], np.arange(len(frame))
            delta = np.where(np.arange(batch.k) == frame["entry"].to_numpy()[:, None], 0.0, -np.inf)
            came = np.zeros((rows, len(frame), batch.k), np.int8)
            with np.errstate(divide="ignore"):
                for t in range(rows):
                    ways = delta[:, :, None] + np.log(batch.step(t))
                    came[t] = ways.argmax(axis=1)
                    delta = np.where(batch.live[:, t, None], ways.max(axis=1), delta)
            state, path = frame["final"].to_numpy().copy(), np.zeros((len(frame), rows), int)
            for t in range(rows - 1, -1, -1):
                live = batch.live[:, t]
                path[:, t] = state
                state = np.where(live, came[t][many, state], state)
            yield frame[[*keys, "block"]].assign(path=[p[:n].tolist() for p, n in zip(path, batch.n, strict=True)], sure=[g[:n].max(axis=1).tolist() for g, n in zip(gamma, batch.n, strict=True)])

    return run


def apply(df: DataFrame, model: DataFrame, columns: list[str], keys: tuple[str, ...] = ("symbol",), length: int = LENGTH) -> DataFrame:
    """Adds ``state``, the state on the likeliest path, and ``confidence``, the greatest chance of a state at the row. Rows without a model are dropped."""
    by = [c for c in model.columns if c not in PARTS]
    df = df.withColumn("_all", F.lit(0)) if by == ["_all"] else df
    rows, blocks = packed(df, columns, list(keys), length, by)
    blocks = Stages()(blocks)
    whole = blocks.join(model, by)
    found = whole.join(_entered(whole, list(keys), False), [*keys, "block"]).join(_entered(whole, list(keys), True), [*keys, "block"])
    made = found.mapInPandas(_paths(list(keys)), f"{_typed(blocks, list(keys))}, block long, path array<int>, sure array<double>")
    each = made.select(*keys, "block", F.posexplode(F.arrays_zip("path", "sure")).alias("_i", "z"))
    each = each.select(*keys, (F.col("block") * length + F.col("_i")).alias("_row"), F.col("z.path").alias("state"), F.col("z.sure").alias("confidence"))
    return rows.drop("_all", "state", "confidence").join(each, [*keys, "_row"]).drop("_row")
