"""A corpus pipeline over ``documents``: quality rules, near-duplicate removal, decontamination, masking of personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; stages are written as Parquet and read again. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import decontaminate, ngram_join, packing, pii, rules, tokencount
from tidebar.llm.graph import staged
from tidebar.llm.textio import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Those of null, empty or short texts go; repeated rows share a verdict; columns of any name stay as they are."""
    own = docs.select(F.col("doc_id"), F.col("text"), F.struct(*docs.columns).alias("_row"))
    judged = rules.apply_rules(own, rules.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates, one row of it; documents without words all stay."""
    return ngram_join.keep_one(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found, repeated rows and null texts included."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and ``n_chars`` of the new text; a null text stays null."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text is an empty one."""
    return packing.pack_documents(docs, tokencount.vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", pack),
]
#: SQL can't express the packing stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole of ``documents``; a stage's table is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), docs)
    return docs
