"""Candle payloads of exchanges: folders of JSON answers become bars, in batches or as a stream.

A payload lies at ``.../<exchange>/<symbol>/<name>.json``, whole as it came. The
formats are parsed by Spark's JSON functions, so they are read wherever Spark
reads. ``ingest`` commits the bars of files that it has not seen to a store; which
files those are is kept in the stream's checkpoint, so a second run reads new
files only. ``missing_windows`` says what to ask an exchange for next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import OHLCV, seconds
from .store import BarStore

# The places of (time, open, high, low, close, volume) in the rows of formats that are arrays, or their
# names where rows are objects, and how many of the time's units make a second.
FORMATS = {
    "klines": ((0, 1, 2, 3, 4, 5), 1000),
    "candles": ((0, 3, 2, 1, 4, 5), 1),
    "snapshot": (("t", "o", "h", "l", "c", "v"), 1000),
}
#: The format of each exchange; a fixed value.
EXCHANGES = {"binance": "klines", "binanceus": "klines", "coinbase": "candles", "hyperliquid": "snapshot"}


def _rows(text: Column, kind: str) -> Column:
    """The rows of a payload as (ts, open, high, low, close, volume); null if it isn't one."""
    fields, unit = FORMATS[kind]
    whole = all(isinstance(f, int) for f in fields)
    read = F.from_json(text, "array<array<string>>" if whole else f"array<struct<{', '.join(f'`{f}`: string' for f in fields)}>>")

    def row(x: Column) -> Column:
        t, *values = (F.get(x, f) if whole else x[f] for f in fields)
        micros = F.floor(t.try_cast("decimal(38,6)") * (1_000_000 // unit)).cast("long")
        return F.struct(F.timestamp_micros(micros).alias("ts"), *(v.try_cast("double").alias(n) for v, n in zip(values, OHLCV, strict=True)))

    return F.transform(read, row)


def parsed(files: DataFrame, exchanges: dict[str, str] | None = None) -> DataFrame:
    """(exchange, symbol, file, rows) of files with ``value``, the whole text, and ``path``; rows are null where the exchange isn't known or the text no payload of it."""
    known = EXCHANGES if exchanges is None else exchanges
    part = lambda n: F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", n)
    exchange = F.lower(part(1))
    rows = None
    for name, kind in known.items():
        rows = F.when(exchange == name, _rows(F.col("value"), kind)) if rows is None else rows.when(exchange == name, _rows(F.col("value"), kind))
    return files.select(exchange.alias("exchange"), part(2).alias("symbol"), F.col("path").alias("file"), rows.alias("rows"))


def bars_of(files: DataFrame, exchanges: dict[str, str] | None = None) -> DataFrame:
    """Bars of payload files. Rows without a time or with a value that is no number are passed over; of rows of one time any of the last file stays."""
    rows = parsed(files, exchanges).select("exchange", "symbol", "file", F.inline("rows")).dropna()
    return rows.groupBy("exchange", "symbol", "ts").agg(F.max_by(F.struct(*OHLCV), F.struct("file", *OHLCV)).alias("v")).select("exchange", "symbol", "ts", "v.*")


def _path() -> Column:
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """(value, path) of all payload files below a folder."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return read.select("value", _path().alias("path"))


def read_payloads(spark: SparkSession, path: str, exchanges: dict[str, str] | None = None) -> DataFrame:
    """The bars of all payload files below a folder."""
    return bars_of(payload_files(spark, path), exchanges)


def unreadable(spark: SparkSession, path: str, exchanges: dict[str, str] | None = None) -> DataFrame:
    """(exchange, symbol, file) of the files that are no payloads of their exchange, or of none that is known."""
    return parsed(payload_files(spark, path), exchanges).where("rows is null").drop("rows")


def ingest(spark: SparkSession, path: str, store: str, checkpoint: str, exchanges: dict[str, str] | None = None) -> int:
    """Commits the bars of the payload files that came since the last call with this checkpoint; returns the store's version then. A batch that is done again after a failure changes no bar."""
    held = BarStore(spark, store)
    files = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").option("wholetext", "true").text(path).select("value", _path().alias("path"))

    def commit(batch: DataFrame, _: int) -> None:
        bars = bars_of(batch, exchanges)
        if not bars.isEmpty():
            held.commit(bars)

    files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return (held.versions() or [0])[-1]


def missing_windows(store: BarStore, wanted: DataFrame, until, freq: str, most: int = 1000) -> DataFrame:
    """(exchange, symbol, start, stop): the spans to ask for, each of at most ``most`` bars, from the latest stored bar of every wanted (exchange, symbol, first) on, or from ``first`` where there is none."""
    latest = store.manifest().groupBy("exchange", "symbol").agg(F.max("last").alias("last"))
    step, end = seconds(freq), F.lit(until).cast("timestamp")
    begin = wanted.join(latest, ["exchange", "symbol"], "left").withColumn("begin", F.coalesce(F.col("last") + F.make_dt_interval(secs=F.lit(step)), F.col("first"))).where(F.col("begin") <= end)
    spans = begin.withColumn("start", F.explode(F.sequence("begin", end, F.make_dt_interval(secs=F.lit(step * most)))))
    stop = F.least(F.col("start") + F.make_dt_interval(secs=F.lit(step * (most - 1))), end)
    return spans.select("exchange", "symbol", "start", stop.alias("stop"))
