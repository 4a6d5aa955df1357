"""Hidden Markov models against plain loops over whole sequences."""

import datetime as dt

import numpy as np
import pytest

from tidebar.operators import hmm
from tidebar.operators import regimes as rg

T0 = dt.datetime(2024, 1, 1)
N = {"a": 57, "b": 23, "c": 1}


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = np.random.default_rng(4), []
    for symbol, n in N.items():
        state = 0
        for t in range(n):
            state = state if rng.random() < 0.85 else int(rng.integers(0, 3))
            x, y = rng.normal(2.0 * state, 0.7), rng.normal(-1.0 * state, 1.0 + state)
            out.append((symbol, T0 + dt.timedelta(hours=t), float(x), float(y)))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double, y double").repartition(4).cache()


def first_model(series, k):
    x = np.concatenate(series)
    center, scale = x.mean(axis=0), x.std(axis=0)
    spread = np.linspace(-1, 1, k)
    moves = np.full((k, k), (1 - hmm.STAY) / (k - 1))
    np.fill_diagonal(moves, hmm.STAY)
    return center, np.where(scale > 0, scale, 1), np.full(k, 1 / k), moves, np.repeat(spread[:, None], x.shape[1], axis=1), np.ones((k, x.shape[1]))


def logs(x, means, variances):
    return -0.5 * (((x[:, None] - means) ** 2 / variances) + np.log(2 * np.pi * variances)).sum(axis=2)


def plain_posteriors(x, start, moves, means, variances):
    """Forward and backward in logarithms, a sequence at a time."""
    b, n = logs(x, means, variances), len(x)
    with np.errstate(divide="ignore"):
        a, z = [np.log(start) + b[0]], [np.zeros(len(start))]
        for t in range(1, n):
            a.append(np.logaddexp.reduce(a[-1][:, None] + np.log(moves), axis=0) + b[t])
        for t in range(n - 2, -1, -1):
            z.append(np.logaddexp.reduce(np.log(moves) + b[t + 1] + z[-1], axis=1))
        z = z[::-1]
        whole = np.logaddexp.reduce(a[-1])
        gamma = np.exp(np.array(a) + np.array(z) - whole)
        xi = sum((np.exp(a[t][:, None] + np.log(moves) + b[t + 1] + z[t + 1] - whole) for t in range(n - 1)), np.zeros_like(moves))
    return gamma, xi, whole


def plain_training(series, k, rounds):
    center, scale, start, moves, means, variances = first_model(series, k)
    scaled, seen = [(x - center) / scale for x in series], []
    for _ in range(rounds):
        found = [plain_posteriors(x, start, moves, means, variances) for x in scaled]
        gamma, x = np.concatenate([g for g, _, _ in found]), np.concatenate(scaled)
        start = sum(g[0] for g, _, _ in found) / len(found)
        xi = sum(m for _, m, _ in found)
        moves = np.where(xi.sum(axis=1, keepdims=True) > 0, xi / np.maximum(xi.sum(axis=1, keepdims=True), 1e-300), 1 / k)
        means = gamma.T @ x / gamma.sum(axis=0)[:, None]
        variances = np.maximum(gamma.T @ x**2 / gamma.sum(axis=0)[:, None] - means**2, hmm.FLOOR)
        seen.append(sum(w for _, _, w in found))
    return (center, scale, start, moves, means, variances), seen


def plain_path(x, start, moves, means, variances):
    b = logs(x, means, variances)
    with np.errstate(divide="ignore"):
        best, back = np.log(start) + b[0], []
        for t in range(1, len(x)):
            ways = best[:, None] + np.log(moves)
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + b[t]
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(int(came[path[-1]]))
    return path[::-1]


def series(rows, names):
    return [np.array([r[2:] for r in rows if r[0] == s]) for s in names]


@pytest.mark.parametrize("by, length", [((), 8), (None, 1000)])
def test_training_equals_a_plain_loop(df, rows, by, length):
    """In blocks of 8 rows or whole; one model of all sequences or one each. The likelihood never falls."""
    seen = []
    model = hmm.train(df, ["x", "y"], 3, 6, by=by, length=length, watch=lambda k, m: seen.append({r["symbol"] if by is None else None: r["loglik"] for r in m.collect()}))
    got = {r["symbol"] if by is None else None: r for r in model.collect()}
    for name in N if by is None else [None]:
        if name == "c":
            continue  # one row: nothing to learn from
        want, likelihoods = plain_training(series(rows, [name] if name else N), 3, 6)
        for part, value in zip(hmm.PARTS, want, strict=False):
            np.testing.assert_allclose(got[name][part], np.ravel(value), rtol=1e-7, atol=1e-9, err_msg=part)
        np.testing.assert_allclose([s[name] for s in seen], likelihoods, rtol=1e-9)
        assert (np.diff(likelihoods) >= -1e-9).all()


@pytest.mark.parametrize("length", [1, 5, 1000])
def test_path_and_confidence_equal_plain_ones(df, rows, length):
    model = hmm.train(df, ["x", "y"], 3, 3, by=())
    center, scale, *parts = (np.array(model.first()[p]) for p in hmm.PARTS[:6])
    parts = [p.reshape(s) for p, s in zip(parts, ((3,), (3, 3), (3, 2), (3, 2)), strict=True)]
    got = hmm.apply(df, model, ["x", "y"], length=length).orderBy("symbol", "ts").collect()
    assert len(got) == len(rows)
    for name in N:
        x = (series(rows, [name])[0] - center) / scale
        mine = [r for r in got if r.symbol == name]
        assert [r.state for r in mine] == plain_path(x, *parts)
        np.testing.assert_allclose([r.confidence for r in mine], plain_posteriors(x, *parts)[0].max(axis=1), rtol=1e-9)


def test_regimes(spark, tmp_path):
    rng = np.random.default_rng(8)
    close = 100 + rng.normal(size=150).cumsum()
    bars = [("s", T0 + dt.timedelta(hours=k), c, c + 1, c - 1, c, float(rng.integers(1, 9))) for k, c in enumerate(close.tolist())] + [("s", T0 + dt.timedelta(hours=151), None, None, None, None, 0.0)]
    df = spark.createDataFrame(bars, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    model, labels = rg.train_regimes(df, 3, 4)
    rg.save_regimes(str(tmp_path), model, labels)
    got = rg.apply_regimes(df, *rg.load_regimes(spark, str(tmp_path))).collect()
    assert len(got) == 150 and {r.regime_label for r in got} == {r.label for r in labels.collect()}
    assert all(1 / 3 <= r.regime_conf <= 1 + 1e-12 for r in got)
    assert hmm.train(df.limit(0).withColumn("ret", df.close), ["ret"], 2, 2).count() == 0
