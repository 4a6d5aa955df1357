"""A store of bars as snapshots: every commit adds files and ends with a manifest of all files that are live.

Readers take the newest finished snapshot, so they see all of a commit or none of
it, and a snapshot that they have begun with stays readable until ``vacuum``. Keys
are columns of the files, so symbols stay the text that they are. A commit costs
its own bars only: a bar that is written again is the newer one when it is read,
and ``compact`` puts such files together.

``data/<version>-<id>/`` holds a commit's files, ``manifests/<version>-<id>/`` a row
for each file and key with the first and last time and the number of bars, and
``snapshots/<version>``, created last and only where there is none, the manifest's
name. Of two writers of one version the second one fails and may try again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import put_text

KEYS = ("exchange", "symbol")
SCHEMA = "exchange string, symbol string, ts timestamp, open double, high double, low double, close double, volume double"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
MANIFEST = "file string, exchange string, symbol string, first timestamp, last timestamp, bars long"


class Conflict(RuntimeError):
    """Another writer committed first; nothing was changed."""


class BarStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- snapshots -----------------------------------------------------------

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        place, fs = self._place(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def _text(self, name: str) -> str:
        place, fs = self._place(name)
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        """The finished snapshots, oldest first."""
        return [int(n) for n in self._listed("snapshots") if n.isdigit() and self._text(f"snapshots/{n}")]

    def manifest(self, version: int | None = None) -> DataFrame:
        """The files of a snapshot, the newest if none is named."""
        known = self.versions()
        if not known and version is None:
            return self.spark.createDataFrame([], MANIFEST)
        if version is not None and version not in known:
            raise ValueError(f"no snapshot {version}")
        number = known[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self._text(f'snapshots/{number:012d}')}")

    def _publish(self, version: int, name: str, manifest: DataFrame) -> int:
        manifest.write.parquet(f"{self.path}/manifests/{name}")
        try:
            put_text(self.spark, f"{self.path}/snapshots/{version:012d}", name, replace=False)
        except Exception as e:
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            raise Conflict(f"snapshot {version} was written by another writer") from e
        return version

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """Writes bars as files of a commit, each a range of keys and times; returns their manifest rows."""
        df.select(*COLUMNS).repartitionByRange(*KEYS, "ts").sortWithinPartitions(*KEYS, "ts").write.parquet(f"{self.path}/data/{name}")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{name}").select(_file().alias("file"), *KEYS, "ts")
        return rows.groupBy("file", *KEYS).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("bars"))

    def commit(self, df: DataFrame) -> int:
        """Adds bars, which stand instead of older ones of the same key and time; of two within ``df`` the one with the greatest values stays. Returns the new version.

        Rows without a key or time are passed over.
        """
        version = (self.versions() or [0])[-1] + 1
        name = f"{version:012d}-{uuid.uuid4().hex}"
        values = F.max(F.struct(*COLUMNS[3:])).alias("v")
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        typed = df.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS)).where("exchange is not null and symbol is not null and ts is not null")
        rows = typed.groupBy(*COLUMNS[:3]).agg(values).select(*COLUMNS[:3], "v.*")
        before = self.manifest()
        return self._publish(version, name, before.unionByName(self._written(rows, name)))

    # -- reading -------------------------------------------------------------

    def _rows(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], f"{SCHEMA}, age long")
        read = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(*(f"{self.path}/{f}" for f in files))
        return read.select(*COLUMNS, F.regexp_extract(_file(), r"data/(\d+)-", 1).cast("long").alias("age"))

    def read(self, exchange: str | None = None, symbol: str | None = None, start=None, stop=None, version: int | None = None) -> DataFrame:
        """The bars of a snapshot. The manifest tells which files hold the key and range; unreadable ones are passed over.

        Only where files overlap are bars compared, and the newest one of a time kept.
        """
        parts = self._in_range(self.manifest(version), exchange, symbol, start, stop)
        files, twice = self._files(parts)
        found = self._rows(files)
        for name, value in zip(KEYS, (exchange, symbol), strict=True):
            found = found.where(F.col(name) == value) if value is not None else found
        found = found.where(F.col("ts") >= start) if start is not None else found
        found = found.where(F.col("ts") <= stop) if stop is not None else found
        return newest(found) if twice else found.drop("age")

    def since(self, version: int, until: int | None = None) -> DataFrame:
        """The bars that commits after ``version`` brought, up to ``until``; compaction brings none, and takes none away as long as the commit's snapshot is kept."""
        files: list[str] = []
        for number in self.versions():
            if number > version and (until is None or number <= until):
                mine = F.col("file").startswith(f"data/{number:012d}-") & ~F.col("file").contains("-compact")
                files += [f for f, in self.manifest(number).where(mine).select("file").distinct().collect()]
        return newest(self._rows(files))

    @staticmethod
    def _in_range(parts: DataFrame, exchange, symbol, start, stop) -> DataFrame:
        for name, value in zip(KEYS, (exchange, symbol), strict=True):
            parts = parts.where(F.col(name) == value) if value is not None else parts
        parts = parts.where(F.col("last") >= start) if start is not None else parts
        return parts.where(F.col("first") <= stop) if stop is not None else parts

    @staticmethod
    def _overlaps(parts: DataFrame) -> DataFrame:
        """Adds whether a file's bars of a key reach into the times of another file's."""
        w = Window.partitionBy(*KEYS).orderBy("first", "last", "file")
        before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("first")
        after = F.min("first").over(w.rowsBetween(1, Window.unboundedFollowing)) <= F.col("last")
        return parts.withColumn("overlaps", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))

    def _files(self, parts: DataFrame) -> tuple[list[str], bool]:
        found = self._overlaps(parts).groupBy("file").agg(F.max("overlaps").alias("twice")).orderBy("file").collect()
        return [r["file"] for r in found], any(r["twice"] for r in found)

    def assets(self) -> DataFrame:
        """The pairs of exchange and symbol that are stored, from the manifest alone, but for names that begin with an underscore."""
        return self.manifest().select(*KEYS).distinct().where(~F.col("exchange").startswith("_") & ~F.col("symbol").startswith("_"))

    # -- upkeep --------------------------------------------------------------

    def corrupt(self, version: int | None = None) -> DataFrame:
        """(file, bars, readable): the files of a snapshot that don't give all bars that were written."""
        known = self.manifest(version).groupBy("file").agg(F.sum("bars").alias("bars"))
        files = [r["file"] for r in known.select("file").collect()]
        there = [f for f in files if (p := self._place(f)) and p[1].exists(p[0])]
        read = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(*(f"{self.path}/{f}" for f in there)) if there else None
        seen = read.select(_file().alias("file"), "ts").groupBy("file").agg(F.count("*").alias("readable")) if read else known.select("file", F.lit(0).alias("readable")).limit(0)
        return known.join(seen, "file", "left").select("file", "bars", F.coalesce("readable", F.lit(0)).cast("long").alias("readable")).where("readable < bars")

    def compact(self) -> int | None:
        """Puts files whose bars overlap together in a new snapshot; unreadable ones stay in the manifest as they are. None if there was nothing to do."""
        version = (self.versions() or [0])[-1]
        manifest = self.manifest()
        broken = self.corrupt().select("file")
        chosen = self._overlaps(manifest).where("overlaps").select("file").distinct().join(broken, "file", "left_anti")
        files = [r["file"] for r in chosen.collect()]
        if len(files) < 2:
            return None
        name = f"{version + 1:012d}-compact{uuid.uuid4().hex}"
        merged = self._written(newest(self._rows(files)), name)
        return self._publish(version + 1, name, manifest.where(~F.col("file").isin(files)).unionByName(merged))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes what none of the newest ``keep`` snapshots needs, left over commits that failed included; returns the folders that went. No writer may be at work."""
        known = self.versions()
        kept = known[-keep:]
        names = {self._text(f"snapshots/{v:012d}") for v in kept}
        live = {f.split("/")[1] for v in kept for f, in self.manifest(v).select("file").distinct().collect()}
        gone = [f"snapshots/{v:012d}" for v in known if v not in kept]
        gone += [f"manifests/{n}" for n in self._listed("manifests") if n not in names] + [f"data/{n}" for n in self._listed("data") if n not in live]
        for name in gone:
            place, fs = self._place(name)
            fs.delete(place, True)
        return gone


def _file():
    """A file's name within the store."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/[^/]+)$", 1)


def newest(rows: DataFrame) -> DataFrame:
    """Of the bars of a key and time that of the latest commit."""
    w = Window.partitionBy(*KEYS, "ts").orderBy(F.desc("age"))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "age")
