"""Strategy documents as files: JSON always, YAML where a parser is installed."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .staging import put_text


def parse(text: str, name: str = "document.yml") -> dict:
    """A document from the text of a file; its ending says which language it is in."""
    if name.lower().endswith(".json"):
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("documents in YAML need a YAML parser") from e
        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{name} holds no document")
    return found


def read_documents(spark: SparkSession, path: str) -> dict[str, dict]:
    """The documents of a file or a folder by the names of their files. They are settings, so all come to the driver, in order of name."""
    read = spark.read.option("pathGlobFilter", "*.{json,yml,yaml}").text(path, wholetext=True)
    rows = read.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("name"), "value").orderBy("name").collect()
    if not rows:
        raise ValueError(f"no documents at {path}")
    return {r["name"]: parse(r["value"], r["name"]) for r in rows}


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """Writes a document, in YAML unless the path ends in .json."""
    if path.lower().endswith(".json"):
        text = json.dumps(document, indent=2)
    else:
        import yaml

        text = yaml.safe_dump(document, sort_keys=False)
    put_text(spark, path, text)
