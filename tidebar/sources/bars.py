"""Bars: loading, standardising, resampling and putting on a regular grid."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .store import SCHEMA, BarStore

OHLCV = ["open", "high", "low", "close", "volume"]
_UNITS = {"T": 60, "Min": 60, "min": 60, "H": 3600, "h": 3600, "D": 86400, "S": 1, "s": 1}


def seconds(freq: str) -> int:
    """Seconds of a frequency such as 5Min, 4h or 1D."""
    found = re.fullmatch(r"(\d{1,4})?([A-Za-z]+)", freq.strip())
    if not found or found[2] not in _UNITS:
        raise ValueError(f"not a frequency: {freq}")
    return int(found[1] or 1) * _UNITS[found[2]]


def parse_time(value: Column) -> Column:
    """A timestamp from an epoch in seconds (10 digits) or milliseconds (13 digits), or from text."""
    text = value.cast("string")
    return F.when(F.length(text) == 13, F.timestamp_millis(F.try_to_number(text, F.lit("9" * 13)).cast("long"))).when(text.rlike(r"^\d{10}$"), F.timestamp_seconds(F.try_to_number(text, F.lit("9" * 10)).cast("long"))).otherwise(F.try_to_timestamp(text))


def read_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of one symbol from a CSV file with a header; of rows with equal dates the first stays, extra columns are kept as numbers."""
    raw = spark.read.csv(path, header=True).withColumn("_line", F.monotonically_increasing_id())
    if "date" not in raw.columns:
        raise ValueError(f"no bars in {path}")
    rest = [c for c in raw.columns if c not in ("date", "ignore", "_line")]
    rows = raw.select(F.lit(symbol).alias("symbol"), parse_time(F.col("date")).alias("ts"), *(F.col(c).try_cast("double").alias(c) for c in rest), "_line")
    return deduplicate(rows, "_line", keep="first").drop("_line")


def deduplicate(df: DataFrame, order: str, keep: str = "last", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One row for each key and time: the first or last by ``order``."""
    by = F.col(order).asc() if keep == "first" else F.col(order).desc()
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "ts").orderBy(by))).where("_rank = 1").drop("_rank")


def bucket(ts: Column, freq: str, origin: Column | None = None) -> Column:
    """The start of the tumbling bucket, counted from ``origin``; without one from 1970, which is midnight for steps that divide a day."""
    step = seconds(freq) * 1_000_000
    zero = F.unix_micros(origin) if origin is not None else F.lit(0)
    return F.timestamp_micros(F.floor((F.unix_micros(ts) - zero) / step) * step + zero)


def with_bucket(df: DataFrame, freq: str, keys: tuple[str, ...] = ("symbol",), name: str = "_b") -> DataFrame:
    """Adds the start of each row's bucket; buckets are counted from midnight UTC of the first day of its key."""
    if 86400 % seconds(freq) == 0:
        return df.withColumn(name, bucket(F.col("ts"), freq))
    first = df.groupBy(*keys).agg(F.date_trunc("day", F.min("ts")).alias("_day"))
    return df.join(first, list(keys)).withColumn(name, bucket(F.col("ts"), freq, F.col("_day"))).drop("_day")


def resample(df: DataFrame, freq: str, keys: tuple[str, ...] = ("symbol",), empty: bool = False) -> DataFrame:
    """Bars of a coarser frequency: first open, highest high, lowest low, last close, summed volume; ``empty``: buckets without bars too, with no prices and volume 0."""
    out = (
        with_bucket(df, freq, keys)
        .groupBy(*keys, "_b")
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("_b", "ts")
    )
    return regrid(out, freq, fill=False, keys=keys).withColumn("volume", F.coalesce("volume", F.lit(0.0))) if empty else out


def first_values(df: DataFrame, freq: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The first value that isn't null of every column in each bucket; no bars are made."""
    columns = [c for c in df.columns if c not in (*keys, "ts")]
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in columns]
    return with_bucket(df, freq, keys).groupBy(*keys, "_b").agg(*firsts).withColumnRenamed("_b", "ts").select(*keys, "ts", *columns)


def resample_calendar(df: DataFrame, unit: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars of calendar days, weeks, months, quarters or years, dated by the first day."""
    day = F.date_trunc(unit, "ts").alias("_b")
    bars = (F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return df.groupBy(*keys, day).agg(*bars).withColumnRenamed("_b", "ts")


def within(ts: Column, edge, last: bool) -> Column:
    """Whether a time lies at or after an edge, or for the ``last`` edge at or before it; one of a day alone covers that day then."""
    text = str(edge)
    at = parse_time(F.lit(text))
    if not last:
        return ts >= at
    return ts < at + F.expr("interval 1 day") if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else ts <= at


def between(df: DataFrame, start=None, stop=None) -> DataFrame:
    """Rows from start to stop, both included; times are text or epochs, a stop of a day alone covers that day, and nothing or "" leaves a side open."""
    for edge, last in ((start, False), (stop, True)):
        if edge is not None and edge != "":
            df = df.where(within(F.col("ts"), edge, last))
    return df


def trending(df: DataFrame, column: str, n: int = 1, up: bool = True, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """Whether the column is above (or below) where it was n bars before; false where that isn't known."""
    move = F.col(column) - F.lag(column, n).over(Window.partitionBy(*keys).orderBy("ts"))
    return F.coalesce(move > 0 if up else move < 0, F.lit(False))


def _in_order(df: DataFrame, ts: Column, tie: Column) -> Column:
    """A value that orders rows by time and then ``tie``; of whole numbers one decimal, which a hash aggregate can hold, where a struct needs all rows sorted."""
    kind = df.select(tie.alias("k")).schema["k"].dataType
    if not isinstance(kind, IntegralType):
        return F.struct(ts.alias("t"), tie.alias("k"))
    wide = F.lit(str(2 * 10**19)).cast("decimal(20,0)")
    return F.unix_micros(ts).cast("decimal(38,0)") * wide + tie.cast("decimal(38,0)")


def from_ticks(df: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, tie: Column, freq: str) -> DataFrame:
    """Bars from single trades; ``tie`` orders trades of one time."""
    rows = df.select(symbol.alias("symbol"), bucket(ts, freq).alias("ts"), _in_order(df, ts, tie).alias("o"), price.cast("double").alias("p"), volume.cast("double").alias("v")).where("p is not null")
    return rows.groupBy("symbol", "ts").agg(F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"), F.sum("v").alias("volume"))


def filled(x: str | Column, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """The column's last value that isn't null."""
    return F.last(x, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))


def regrid(df: DataFrame, freq: str, fill: bool = True, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """A row for every step from each key's first bar on; rows off these steps go, and ``fill`` carries the last values forward.

    Each row makes those that are missing up to the next one, so nothing is joined.
    """
    out = regrid_by(df, F.lit(seconds(freq)), keys)
    return out.withColumns({c: filled(c, keys) for c in df.columns if c not in (*keys, "ts")}) if fill else out


def regrid_by(df: DataFrame, step: Column, keys: tuple[str, ...]) -> DataFrame:
    """As ``regrid`` without filling, for a step in seconds that is the same for all rows of a key and may differ between keys; keys without a step stay as they are."""
    w = Window.partitionBy(*keys).orderBy("ts")
    columns = [c for c in df.columns if c not in (*keys, "ts")]
    first = F.min("ts").over(w)
    on = df.withColumns({"_step": step.cast("long"), "_off": (F.unix_micros("ts") - F.unix_micros(first)) % (step.cast("long") * 1_000_000)}).where("coalesce(_off, 0) = 0").drop("_off")
    last = F.timestamp_micros(F.unix_micros(F.lead("ts").over(w)) - F.col("_step") * 1_000_000)
    steps = F.sequence("ts", F.coalesce("_last", "ts"), F.make_dt_interval(secs=F.coalesce("_step", F.lit(1))))
    rows = on.withColumn("_last", last).select(*keys, *columns, F.posexplode(steps).alias("_n", "ts"))
    return rows.select(*keys, "ts", *(F.when(F.col("_n") == 0, F.col(c)).alias(c) for c in columns))


def infer_frequency(df: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The commonest step in seconds of every key, the smallest of equally common ones."""
    w = Window.partitionBy(*keys).orderBy("ts")
    steps = df.select(*keys, (F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(w))).alias("step")).where("step is not null").groupBy(*keys, "step").count()
    return steps.groupBy(*keys).agg(F.max_by("step", F.struct("count", -F.col("step"))).alias("step"))


def missing_bars(df: DataFrame, freq: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Bars that a regular grid would have besides those there are, and their share in percent."""
    expected = (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / seconds(freq) + 1
    found = df.groupBy(*keys).agg(expected.cast("long").alias("e"), F.count("*").alias("n"))
    return found.select(*keys, F.greatest(F.col("e") - F.col("n"), F.lit(0)).alias("total_missing"), F.round((F.col("e") - F.col("n")) / F.col("e") * 100, 2).alias("perc_missing"))


def _partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A folder of Parquet files by exchange=.../symbol=..., whose names stay text; unreadable files are skipped."""
    return spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(path)


def upsert(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Commits bars with columns exchange and symbol to a store of snapshots; new rows stand instead of old ones of the same time. A folder partitioned by both is taken over first."""
    store = BarStore(spark, path)
    if not store.versions() and any(n.startswith("exchange=") for n in store._listed("")):
        store.commit(_partitioned(spark, path))
    store.commit(df)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored bars of the newest snapshot, or of a folder partitioned by exchange and symbol; unreadable files are skipped and stay where they are."""
    store = BarStore(spark, path)
    return store.read() if store.versions() else _partitioned(spark, path)


def assets(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of exchange and symbol that are stored, but for names that begin with an underscore."""
    store = BarStore(spark, path)
    if store.versions():
        return store.assets()
    pairs = _partitioned(spark, path).select("exchange", "symbol").distinct()
    return pairs.where(~F.col("exchange").startswith("_") & ~F.col("symbol").startswith("_"))


def scan(spark: SparkSession, path: str, symbol: str | None = None, exchange: str | None = None, start=None, stop=None, freq: str | None = None) -> DataFrame:
    """Stored bars, resampled to ``freq``; exchange and symbol choose files, and the range reaches the Parquet scan."""
    store = BarStore(spark, path)
    if store.versions():
        df = store.read(exchange or None, symbol or None)
    else:
        df = _partitioned(spark, path)
        for column, value in (("symbol", symbol), ("exchange", exchange)):
            df = df.where(F.col(column) == value) if value else df
    df = between(df, start, stop)
    return resample(df, freq, ("exchange", "symbol")) if freq else df
