"""Where results go: runs of strategies with their frames and trades, screens and portfolios, and how runs are found again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_run(path: str, run: str, summary: DataFrame, frame: DataFrame | None = None, trades: DataFrame | None = None) -> None:
    """Writes a run's summary as JSON and, where given, its bars and trades as Parquet, each in the folder of its kind and run; a run of that name is replaced."""
    if not run or "/" in run:
        raise ValueError(f"not a name for a run: {run!r}")
    for kind, df in (("dataframe", frame), ("trade_log", trades)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{kind}/run={run}")
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/summary/run={run}")


def saved_runs(spark: SparkSession, path: str, limit: int = 10, name: str | None = None) -> DataFrame:
    """The summaries of the latest ``limit`` runs by name, latest first; or of the run ``name``."""
    # the run is read from the path, as text: Spark would take 007 for a number and 2024-01-01 for a date
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/run=([^/]+)/[^/]*$", 1)
    rows = spark.read.option("recursiveFileLookup", "true").json(f"{path}/summary")
    runs = rows.select(*rows.columns, F.url_decode(F.regexp_replace(folder, r"\+", "%2B")).alias("run"))
    if name is not None:
        return runs.where(F.col("run") == name)
    latest = runs.select("run").distinct().orderBy(F.desc("run")).limit(limit)
    return runs.join(F.broadcast(latest), "run").orderBy(F.desc("run"))


def load_run(spark: SparkSession, path: str, run: str, kind: str = "dataframe") -> DataFrame:
    """The bars or the trade log of a run."""
    return spark.read.parquet(f"{path}/{kind}/run={run}")


def save_screen(screen: DataFrame, path: str) -> None:
    """Writes a screen as JSON."""
    screen.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(report: DataFrame, limit: int = 20) -> str:
    """The first ``limit`` rows of a report as a Markdown table."""
    rows = report.limit(limit).collect()
    lines = [report.columns, ["---"] * len(report.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)


def universe(bars: DataFrame, symbols: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The symbols to look at: those given, or those there are, in order of name, at most ``most``."""
    found = bars.select("symbol").distinct()
    found = found.where(F.col("symbol").isin(symbols)) if symbols else found
    return found.orderBy("symbol").limit(most) if most else found
