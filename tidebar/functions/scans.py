"""First-order recurrences y = a * y + c as associative scans, without Python.

Two steps of such a recurrence are one step again, (a2 a1, a2 c1 + c2), so a run
of rows is one map. Rows are cut into blocks and each block reduces to its map;
the maps of ``LENGTH`` blocks reduce to one more; the few that are left are put
together key by key, and what enters each block follows. Then each block's rows
are finished on their own. Blocks, not keys, are what is shuffled and worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and blocks whose maps are reduced together.
LENGTH = 512


def _then(a: Column, c: Column, y: Column) -> Column:
    """One step; a map whose ``a`` is zero forgets y, whatever that is."""
    return F.when(a == 0, c).otherwise(a * y + c)


def _map(rows: str, k: int) -> Column:
    """The map of an array of maps."""

    def after(s: Column, r: Column) -> Column:
        a, c = r[f"a{k}"], r[f"c{k}"]
        return F.struct(F.when(a == 0, 0.0).otherwise(a * s["a"]).alias("a"), _then(a, c, s["c"]).alias("c"))

    return F.aggregate(rows, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c")), after)


def _values(rows: str, k: int, start: Column) -> Column:
    """The values after each map of an array, from ``start`` on."""
    none = F.array().cast("array<double>")
    last = lambda s: F.when(F.size(s["out"]) == 0, s["y"]).otherwise(F.element_at(s["out"], -1))
    step = lambda s, r: F.struct(s["y"].alias("y"), F.array_append(s["out"], _then(r[f"a{k}"], r[f"c{k}"], last(s))).alias("out"))
    return F.aggregate(rows, F.struct(start.alias("y"), none.alias("out")), step, lambda s: s["out"])


def _reduced(df: DataFrame, by: list[str], order: str, kept: list[str], n: int) -> DataFrame:
    """Rows packed by ``by``, in order, with the maps of each pack as a0, c0, a1, ..."""
    packed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *kept))).alias("_rows"))
    made = packed.withColumns({f"_m{k}": _map("_rows", k) for k in range(n)})
    return made.withColumns({f"{x}{k}": F.col(f"_m{k}.{x}") for k in range(n) for x in "ac"}).drop(*(f"_m{k}" for k in range(n)))


def _entering(maps: DataFrame, keys: list[str], block: str, n: int, level: int = 1) -> DataFrame:
    """What enters each block: (keys, block, e0, e1, ...); nothing, NaN, enters the first."""
    names = [f"{x}{k}" for k in range(n) for x in "ac"]
    if level:
        over = f"{block}_{level}"
        packs = _reduced(maps.withColumn(over, F.floor(F.col(block) / LENGTH)), [*keys, over], block, names, n)
        packs = packs.join(_entering(packs.select(*keys, over, *names), keys, over, n, level - 1), [*keys, over])
    else:
        packs = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(block, *names))).alias("_rows")).withColumns({f"e{k}": F.lit(float("nan")) for k in range(n)})
    packs = packs.withColumns({f"_v{k}": _values("_rows", k, F.col(f"e{k}")) for k in range(n)})
    before = lambda k: lambda r, i: F.when(i == 0, F.col(f"e{k}")).otherwise(F.get(F.col(f"_v{k}"), i - 1))
    for k in range(n):
        packs = packs.withColumn(f"_b{k}", F.transform("_rows", before(k)))
    each = F.transform("_rows", lambda r, i: F.struct(r[block].alias(block), *(F.get(F.col(f"_b{k}"), i).alias(f"e{k}") for k in range(n))))
    return packs.select(*keys, F.inline(each))


def affine(df: DataFrame, keys: list[str], ts: str, block: str, maps: list[tuple[str, str]], outputs: list[str]) -> DataFrame:
    """Adds a column y of y = a y + c for each pair of columns (a, c), over the rows of a key in order of ``ts``; ``block`` numbers runs of rows.

    A row whose a is zero starts anew from its c, and before the first such row
    there is no value (NaN); neither a nor c may be null.
    """
    rest = [c for c in df.columns if c not in (*keys, ts, block)]
    n = len(maps)
    named = df.withColumns({f"{x}{k}": F.col(c) for k, pair in enumerate(maps) for x, c in zip("ac", pair, strict=True)})
    packed = _reduced(named, [*keys, block], ts, [*rest, *(f"{x}{k}" for k in range(n) for x in "ac")], n)
    entering = _entering(packed.select(*keys, block, *(f"{x}{k}" for k in range(n) for x in "ac")), keys, block, n)
    packed = packed.join(entering, [*keys, block]).withColumns({f"_v{k}": _values("_rows", k, F.col(f"e{k}")) for k in range(n)})
    row = F.transform("_rows", lambda r, i: F.struct(r[ts].alias(ts), *(r[c].alias(c) for c in rest), *(F.get(F.col(f"_v{k}"), i).alias(o) for k, o in enumerate(outputs))))
    return packed.select(*keys, block, F.inline(row))
