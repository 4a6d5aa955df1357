"""Long series cut into slices of time, so that one symbol's bars are worked on by many tasks.

``cut`` counts the bars of short spans of time, adds the counts up and gives each
span a slice of about ``rows`` bars; only the counts of spans meet in one place.
The last ``halo`` bars of a slice are sent to the next one as well, which serves
every window that looks back no further. What depends on all bars before is put
together from the slices: a total, or a last value, of each slice and of those
before it. Rows have ``_slice``, ``_own`` (false for a bar of the halo) and
``_next`` (the bar belongs to the next slice's halo too).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Stages

MARKS = ["_slice", "_own", "_next"]


def cut(df: DataFrame, rows: int, halo: int = 0, keys: tuple[str, ...] = ("symbol",), ts: str = "ts", span: int = 3600) -> DataFrame:
    """The rows with their slice, those of a halo twice. A span of ``span`` seconds stays in one slice; one of over half a slice's rows raises an error."""
    rows = max(rows, 2 * halo)
    df = df.drop(*MARKS).withColumn("_span", F.floor(F.unix_micros(ts) / (span * 1_000_000)))
    counts = df.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_span")
    seen = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    checked = F.when(F.col("_n") > rows / 2, F.raise_error(F.lit("a span holds too many bars for its slice: use a shorter span"))).otherwise(F.floor(seen / rows))
    spans = counts.withColumn("_seen", seen).withColumn("_turn", checked)
    changed = (F.col("_turn") != F.coalesce(F.lag("_turn").over(w), F.lit(0))).cast("long")
    spans = spans.withColumn("_slice", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    following = Window.partitionBy(*keys).orderBy("_slice").rangeBetween(1, 1)
    spans = spans.withColumn("_next", F.coalesce(F.min("_seen").over(following) - F.col("_seen") - F.col("_n") < halo, F.lit(False)))
    return with_halo(df.join(spans.select(*keys, "_span", "_slice", "_next"), [*keys, "_span"]).drop("_span"), keys)


def with_halo(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Bars of the slices themselves, and those that the next slice sees again, dealt out by slice."""
    copies = F.when(F.col("_next"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    df = df.drop("_own").withColumn("_copy", F.explode(copies))
    return df.withColumns({"_slice": F.col("_slice") + F.col("_copy"), "_own": F.col("_copy") == 0}).drop("_copy").repartition(*keys, "_slice")


def own(df: DataFrame) -> DataFrame:
    """The bars without halos."""
    return df.where("_own")


def before(df: DataFrame, made: dict[str, tuple[Column, Callable[[Column], Column]]], keys: tuple[str, ...], stages: Stages) -> DataFrame:
    """Adds columns of what lies before a bar's slice: an aggregate of each slice's rows, and how those of the slices before are put together."""
    df = stages(df)
    each = df.groupBy(*keys, "_slice").agg(*(c.alias(n) for n, (c, _) in made.items()))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return df.join(each.select(*keys, "_slice", *(f(F.col(n)).over(w).alias(n) for n, (_, f) in made.items())), [*keys, "_slice"])


def _last(x: Column) -> Column:
    return F.last(x, ignorenulls=True)


def carried(df: DataFrame, columns: list[str], keys: tuple[str, ...], stages: Stages, ts: str = "ts") -> DataFrame:
    """Bars without halos whose nulls in some columns become the last value before."""
    if not columns:
        return df
    held = {f"_held{k}": (F.max_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(ts))), _last) for k, c in enumerate(columns)}
    w = Window.partitionBy(*keys, "_slice").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    df = before(df, held, keys, stages)
    return df.withColumns({c: F.coalesce(_last(F.col(f"`{c}`")).over(w), F.col(f"_held{k}")) for k, c in enumerate(columns)}).drop(*held)


def regrid(df: DataFrame, step: int, keys: tuple[str, ...] = ("symbol",), ts: str = "ts") -> DataFrame:
    """Bars without halos with an empty row for every step of ``step`` seconds that is missing from the key's first bar on; rows off these steps go."""
    origin = df.groupBy(*keys).agg(F.min(ts).alias("_origin"))
    df = df.join(origin, list(keys)).where((F.unix_micros(ts) - F.unix_micros("_origin")) % (step * 1_000_000) == 0).drop("_origin")
    starts = df.groupBy(*keys, "_slice").agg(F.min(ts).alias("_start"))
    starts = starts.select(*keys, "_slice", F.lead("_start").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_after"))
    columns = [c for c in df.columns if c not in (*keys, ts, *MARKS)]
    then = F.coalesce(F.lead(ts).over(Window.partitionBy(*keys, "_slice").orderBy(ts)), F.col("_after"))
    last = F.coalesce(F.timestamp_micros(F.unix_micros(then) - step * 1_000_000), F.col(ts))
    rows = df.join(starts, [*keys, "_slice"]).withColumn("_until", last)
    rows = rows.select(*keys, "_slice", *columns, F.posexplode(F.sequence(ts, "_until", F.make_dt_interval(secs=F.lit(step)))).alias("_n", ts))
    return rows.select(*keys, "_slice", ts, *(F.when(F.col("_n") == 0, F.col(c)).alias(c) for c in columns))
