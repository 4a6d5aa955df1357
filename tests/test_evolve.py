"""Sweeps over frequencies and ranges against single runs, and the genetic search against a plain loop."""

import datetime as dt
import hashlib
import json
import math

import numpy as np
import pytest

from tidebar.operators import evolve as ev
from tidebar.operators import search
from tidebar.operators import strategy as st

T0 = dt.datetime(2024, 1, 1)
CROSSING = {"datapoints": [{"name": "m", "transformer": "sma", "args": ["#period"]}], "enter": [["close", ">", "m"]], "exit": [["close", "<", "m"]]}


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(6)
    rows = []
    for symbol in "ab":
        for k, c in enumerate((30 + rng.normal(size=200).cumsum()).tolist()):
            if k % 17:
                rows.append((symbol, T0 + dt.timedelta(hours=k), c, c + 1, c - 1, c, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double").cache()


def test_sweep_of_frequencies_and_ranges_equals_single_runs(bars):
    base = search.with_genes(CROSSING, {"period": 3}) | {"comission": 0.1}
    variants = {"none": base, "4h": base | {"freq": "4h"}, "7h": base | {"freq": "7h", "start": "2024-01-02", "stop": "2024-01-06", "exit_on_end": True}, "1h": base | {"freq": "1h", "any_exit": [["m", ">", 31, 2]]}}
    many = {(r.variant, r.symbol): r.asDict(True) for r in st.sweep(bars, variants).collect()}
    assert len(many) == 8
    for name, document in variants.items():
        for r in st.summarize(st.backtest(bars, st.Strategy.of(document)), freq=document.get("freq")).collect():
            assert str(many[name, r.symbol] | {"variant": 0}) == str({"variant": 0} | r.asDict(True) | {"variant": 0}) or many[name, r.symbol] == r.asDict(True) | {"variant": name}


def test_bad_variants_are_named(bars):
    good, bad = st.sound(
        {
            "good": search.with_genes(CROSSING, {"period": 3}),
            "odd": {"datapoints": [{"name": "f", "transformer": "frama", "args": [3]}]},
            "unknown": {"datapoints": [{"name": "f", "transformer": "sma", "args": [3]}], "enter": [["f", ">", "g"]]},
            "operator": {"enter": [["close", "~", 1]]},
            "arguments": {"datapoints": [{"name": "f", "transformer": "sma", "args": ["x"]}]},
        }
    )
    assert set(good) == {"good"} and set(bad) == {"odd", "unknown", "operator", "arguments"} and "even" in bad["odd"]
    with pytest.raises(ValueError):
        st.sweep(bars, {})


def draw(*what):
    return int(hashlib.sha256(":".join(map(str, what)).encode()).hexdigest()[:13], 16) / 16**13


def plain(genes, score, plan):
    """The search as a loop over lists."""

    def new(generation, child):
        out = []
        for k, g in enumerate(genes):
            u = draw(plan.seed, generation, "gene", k, child)
            out.append(float(math.floor(u * len(g.choices))) if g.choices else g.low + u * (g.high - g.low) if g.real else float(g.low + math.floor(u * (g.high - g.low + 1))))
        return out

    population, generations = [new(0, c) for c in range(plan.size)], []
    for generation in range(1, plan.generations + 2):
        scored = [(-score(p), c, p) for c, p in enumerate(population)]
        generations.append(sorted((p, -f) for f, _, p in scored))
        ranked = [p for _, _, p in sorted(scored)]
        population = ranked[: plan.keep]
        for c in range(plan.keep, plan.size):
            parents = []
            for side in (0, 1):
                if plan.selection == "steady":
                    rank = (c + side) % min(plan.parents, plan.size)
                else:
                    rank = min(math.floor(draw(plan.seed, generation, "rival", k, c, side) * plan.size) for k in range(plan.tournament))
                parents.append(ranked[rank])
            point, fresh = 1 + math.floor(draw(plan.seed, generation, "point", c) * max(len(genes) - 1, 1)), new(generation, c)
            first = lambda k: k < point if plan.crossover == "single_point" else draw(plan.seed, generation, "mix", k, c) < 0.5  # noqa: B023, E731
            mixed = [parents[0 if first(k) else 1][k] for k in range(len(genes))]
            population.append([fresh[k] if draw(plan.seed, generation, "mutate", k, c) < plan.mutation else mixed[k] for k in range(len(genes))])
    return generations


@pytest.mark.parametrize("more", [{}, {"selection": "tournament", "tournament": 3, "crossover": "uniform", "keep": 2, "mutation": 0.2}])
def test_search_equals_a_plain_loop(spark, more):
    genes = [ev.Gene(low=2, high=9), ev.Gene(choices=["a", "b", "c"]), ev.Gene(low=-1, high=1, real=True)]
    plan = ev.Plan(size=8, generations=3, parents=3, seed=5, **more)

    def score(g):
        return ev.ERROR if g[0] == 9 else -abs(g[0] - 5) + g[1] - g[2] ** 2

    judged, seen = [], []

    def judge(new):
        judged.extend(map(tuple, new))
        return spark.createDataFrame([(k, float("nan") if g[0] == 9 else score(g)) for k, g in enumerate(new) if g[0] != 9 or k % 2], "place long, fitness double")

    known = ev.evolve(spark, genes, judge, plan, lambda k, p: seen.append(sorted((list(r.genes), r.fitness) for r in p.collect())))
    want = plain(genes, score, plan)
    assert len(seen) == 4 and [[g for g, _ in s] for s in seen] == [[g for g, _ in w] for w in want]
    np.testing.assert_allclose([f for s in seen for _, f in s], [f for w in want for _, f in w])
    assert len(judged) == len(set(judged)) == known.count()  # nothing is judged twice
    best = [max(f for _, f in s) for s in seen]
    assert best == sorted(best)


def test_evolving_a_strategy(bars):
    """A gene of the freq, a gene that breaks the document, and the best one run alone."""
    document = CROSSING | {"datapoints": [{"name": "m", "transformer": "#kind", "args": ["#period"]}]}
    genes = {"period": ev.Gene(low=2, high=12), "freq": ev.Gene(choices=["1h", "4h"]), "kind": ev.Gene(choices=["sma", "frama", "nothing"])}
    found = ev.evolve_strategy(bars, document, genes, {"return_perc": 1.0}, ev.Plan(size=5, generations=1, seed=3), min_trades=0).collect()
    assert len(found) >= 6 and any(r.fitness == ev.ERROR for r in found) and any(r.fitness > ev.ERROR for r in found)
    best = max(found, key=lambda r: r.fitness)
    named = json.loads(best.named)
    chosen = {"period": int(named["period"]), "freq": ["1h", "4h"][int(named["freq"])], "kind": ["sma", "frama", "nothing"][int(named["kind"])]}
    alone = st.summarize(st.backtest(bars, st.Strategy.of(search.with_genes(document, chosen)))).collect()
    assert best.fitness == pytest.approx(sum(r.return_perc for r in alone) / len(alone))
    best = search.search(bars, CROSSING, {"period": lambda r: r.choice([2, 5]), "freq": lambda r: r.choice(["1h", "4h"])}, {"return_perc": 1.0}, size=4, min_trades=0)
    assert best and all(f > ev.ERROR for _, f in best)


def test_plans(spark):
    for wrong in ({"selection": "luck"}, {"crossover": "x"}, {"keep": 10}, {"parents": 0}):
        with pytest.raises(ValueError):
            ev.Plan(**wrong)
