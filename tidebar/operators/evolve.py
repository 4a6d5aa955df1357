"""Genetic search over the genes of a strategy document.

The population is a table of gene arrays. Selection, crossover and mutation are
expressions and joins on it; what would be random comes from hashes of the seed,
the generation and the child, so a search gives the same children every time.
Each generation's children whose genes are not known yet are run in one sweep; a
child that can't be run gets the fitness ``ERROR`` and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import Stages
from .search import with_genes
from .strategy import ERROR, fitness, sound, sweep


@dataclass(frozen=True)
class Gene:
    """What a gene can be: one of ``choices``, or a number from ``low`` to ``high``, whole unless ``real``."""

    choices: Sequence = ()
    low: float = 0.0
    high: float = 1.0
    real: bool = False

    def place(self, u: Column) -> Column:
        """The gene's number for a draw from [0, 1): of a choice its place."""
        if self.choices:
            return F.floor(u * len(self.choices)).cast("double")
        if self.real:
            return F.lit(float(self.low)) + u * (float(self.high) - float(self.low))
        return (F.lit(float(self.low)) + F.floor(u * (self.high - self.low + 1))).cast("double")

    def value(self, number: float):
        return self.choices[int(number)] if self.choices else float(number) if self.real else int(number)


#: Ranges of genes that a search has no range for, by what is in their names; fixed values.
RANGES = {"period": Gene(low=2, high=200), "rsi": Gene(low=1, high=100)}


KINDS = {"selection": ("steady", "tournament"), "crossover": ("single_point", "uniform")}


@dataclass(frozen=True)
class Plan:
    """How a search goes: children a generation, best ones that live on, parents, and how these are chosen and mixed."""

    size: int = 10
    generations: int = 10
    keep: int = 1
    parents: int = 10
    selection: str = "steady"
    tournament: int = 4
    crossover: str = "single_point"
    mutation: float = 0.5
    seed: int = 0

    def __post_init__(self):
        for name, allowed in KINDS.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}")
        if not 0 <= self.keep < self.size or self.parents < 1 or self.tournament < 1:
            raise ValueError("keep fewer than size, and at least one parent and rival")


def drawn(*what: Column | str | int) -> Column:
    """A number in [0, 1) that follows from ``what``: the first 52 bits of the SHA-256 of its parts joined by colons."""
    parts = [w if isinstance(w, Column) else F.lit(str(w)) for w in what]
    digest = F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def _new(genes: Sequence[Gene], seed: int, generation: int, child: Column) -> list[Column]:
    return [g.place(drawn(seed, generation, "gene", k, child)) for k, g in enumerate(genes)]


def first_population(spark: SparkSession, genes: Sequence[Gene], plan: Plan) -> DataFrame:
    """(id, genes) of the first generation, all drawn anew."""
    ids = spark.range(plan.size)
    return ids.select("id", F.array(*_new(genes, plan.seed, 0, F.col("id"))).alias("genes"))


def children(population: DataFrame, genes: Sequence[Gene], plan: Plan, generation: int) -> DataFrame:
    """(id, genes) of the next generation of (id, genes, fitness).

    The best ``keep`` live on as children 0, 1, ...; the others have two parents.
    ``steady``: of the best ``parents``, child c has those of rank c and c + 1 in a
    circle. ``tournament``: each parent is the best of ``tournament`` drawn ones. Of
    equal fitness the smaller id is better.
    """
    # a population is a setting of the search, of some tens or hundreds of rows
    order = Window.orderBy(F.desc("fitness"), "id")
    ranked = population.select("genes", (F.row_number().over(order) - 1).alias("rank"))
    spark, n = population.sparkSession, len(genes)
    born = spark.range(plan.keep, plan.size).withColumnRenamed("id", "child").withColumn("parent", F.explode(F.array(F.lit(0), F.lit(1))))
    if plan.selection == "steady":
        chosen = born.withColumn("rank", ((F.col("child") + F.col("parent")) % min(plan.parents, plan.size)).cast("int"))
    else:
        picks = [F.floor(drawn(plan.seed, generation, "rival", k, F.col("child"), F.col("parent")) * plan.size).cast("int") for k in range(plan.tournament)]
        chosen = born.withColumn("rank", F.array_min(F.array(*picks)))  # the best of some ranks is the smallest
    both = chosen.join(ranked, "rank").groupBy("child").agg(F.min_by("genes", "parent").alias("mother"), F.max_by("genes", "parent").alias("father"))
    child = F.col("child")
    point = 1 + F.floor(drawn(plan.seed, generation, "point", child) * max(n - 1, 1))
    fresh = _new(genes, plan.seed, generation, child)
    made = []
    for k in range(n):
        first = F.lit(k) < point if plan.crossover == "single_point" else drawn(plan.seed, generation, "mix", k, child) < 0.5
        inherited = F.when(first, F.col("mother")[k]).otherwise(F.col("father")[k])
        made.append(F.when(drawn(plan.seed, generation, "mutate", k, child) < plan.mutation, fresh[k]).otherwise(inherited))
    elite = ranked.where(F.col("rank") < plan.keep).select(F.col("rank").cast("long").alias("id"), "genes")
    return elite.unionByName(both.select(child.alias("id"), F.array(*made).alias("genes")))


Judge = Callable[[list[list[float]]], DataFrame]


def evolve(spark: SparkSession, genes: Sequence[Gene], judge: Judge, plan: Plan, watch: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """All genes that were judged, (genes, fitness), of the first population and ``generations`` more.

    ``judge`` takes the gene arrays that are not known yet, at most ``size``, and
    gives (place, fitness) for their places in the list; one that is missing or has
    no finite fitness counts as ``ERROR``. ``watch`` sees each generation's
    (id, genes, fitness).
    """
    stages, kept = Stages(), Stages()
    known = spark.createDataFrame([], "genes array<double>, fitness double")
    now = first_population(spark, genes, plan)
    for generation in range(plan.generations + 1):
        now = stages(now)
        new = [list(r["genes"]) for r in now.select("genes").distinct().join(known, "genes", "left_anti").orderBy("genes").collect()]
        if new:
            listed = spark.createDataFrame(list(enumerate(new)), "place long, genes array<double>")
            finite = F.when(F.abs("fitness") < float("inf"), F.col("fitness"))
            judged = listed.join(judge(new).select(F.col("place").cast("long").alias("place"), finite.alias("fitness")), "place", "left")
            known = kept(known.unionByName(judged.select("genes", F.coalesce("fitness", F.lit(ERROR)).alias("fitness"))))
        population = now.join(known, "genes").select("id", "genes", "fitness")
        if watch:
            watch(generation, population)
        now = children(population, genes, plan, generation + 1)
    return known


def evolve_strategy(bars: DataFrame, document: Mapping, genes: Mapping[str, Gene | None], weights: Mapping[str, float], plan: Plan, min_trades: int = 5, penalty: float = -5.0, keys: tuple[str, ...] = ("symbol",), watch: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """(genes, fitness, named) of every set of genes that was tried, ``named`` the numbers by name as JSON; fitness is the mean over all keys.

    A gene without a range gets one by its name, or is a number from 0 to 1.
    """
    names = list(genes)
    space = [g or next((r for part, r in RANGES.items() if part in name.lower()), Gene(real=True)) for name, g in genes.items()]

    def filled(values: Sequence[float]) -> dict:
        return with_genes(document, {n: g.value(v) for n, g, v in zip(names, space, values, strict=True)})

    def judge(new: list[list[float]]) -> DataFrame:
        good, _ = sound({str(k): filled(v) for k, v in enumerate(new)})
        if not good:
            return bars.sparkSession.createDataFrame([], "place long, fitness double")
        found = sweep(bars, {name: filled(new[int(name)]) for name in good}, keys)
        score = F.avg(fitness(dict(weights), min_trades, penalty)).alias("fitness")
        return found.groupBy("variant").agg(score).select(F.col("variant").cast("long").alias("place"), "fitness")

    known = evolve(bars.sparkSession, space, judge, plan, watch)
    named = F.to_json(F.struct(*(F.col("genes")[k].alias(n) for k, n in enumerate(names))))
    return known.withColumn("named", named)
