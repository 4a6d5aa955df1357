"""Shared-folder staging and connected components of edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor must see; where it is unset and all run in one process, as in tests, a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _local.get(spark.sparkContext.applicationId) or _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidebar-"))
    return folder


_local: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staged(df: DataFrame, *done: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: its lineage is cut, and a lost executor loses none of it.

    Staged tables in ``done``, which nothing but ``df`` reads, are deleted then.
    """
    path = f"{shared_folder(df.sparkSession)}/tidebar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    dropped(*done)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def dropped(*done: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in done:
        if path := _written.pop(df, None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


#: Edges that a task of a later round writes; there are about as many as in the round before.
ROWS = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node reachable.

    Alternating large and small stars: every node sends its larger, then its
    smaller neighbours to the smallest node it knows, until nothing changes. Each
    round is staged, and a count and checksum of it are observed as it is written;
    minima combine before the shuffle, so hubs do no harm.
    """

    def written(e: DataFrame, *done: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = staged(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), *done)
        return out, seen.get

    e, mark = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), F.col("m")))).alias("p"))
        e, now = written(small.select(F.col("p.b").alias("a"), F.col("p.m").alias("b")).where("a <> b").distinct().coalesce(8 + mark["n"] // ROWS), e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
