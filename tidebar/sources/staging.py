"""Tables written to the folder that the driver and all executors share, to cut lineage so that a lost executor loses none of them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all run in one process, as in tests, a temporary one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="tidebar-"))
    return folder


def new_folder(spark: SparkSession, kind: str = "tidebar") -> str:
    """A folder of its own there, which doesn't exist yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def put_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """A small text as a file; without ``replace`` it is an error if there is one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(place, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


class Stages:
    """A line of tables each of which is made of the one before: when the next one is written, the last one is deleted."""

    def __init__(self):
        self.path: str | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, new_folder(df.sparkSession)
        df.write.parquet(path)
        if self.path:
            delete(spark, self.path)
        self.path = path
        return spark.read.schema(df.schema).parquet(path)
