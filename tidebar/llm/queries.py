"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, hard_negatives, licenses, ngram_join, packing, piece_codec, pii, prefix_trie, quality, rules, tokencount, toxicity
from .textio import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row is a record of its own layout, as are the two turns of conversation -1, and its fingerprint says where the turn is."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"})
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), record.alias("record"))
    messages = [F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.to_json(F.struct(F.array(*messages).alias("messages"))).alias("record"))
    turns = chat.turns_from_json(rows.unionByName(extra), "conv_id", "record", "turn")
    return chat.conversation_digests(chat.format_turns(turns))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    names = F.transform("matches", lambda m: m["license"])
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licenses"), F.size("sentences").cast("long").alias("n_sentences"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokencount.vocabulary_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.scan_pii(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokencount.vocabulary_path())


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.apply_rules(docs, rules.trusted_ids(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("items", lambda i: i["item"])))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.array_join(items.cast("array<string>"), ",").alias("items"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_codec.model_path()
    coded = piece_codec.decode_ids(piece_codec.encode_texts(table(spark, sf_dir, "documents"), model), model)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), piece_codec.ids_digest().alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a seventh of the rows are moved by one before mining, as the contract has it."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", moved.cast("int").alias("label")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie.prefix_trie(prefix_trie.spliced(prefix_trie.turn_rows(table(spark, sf_dir, "conversations"))))
    found = nodes.join(prefix_trie.ends_digest(ends), "key", "left")
    digest = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return found.select(F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n_members").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), digest)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_chat_format": op2_chat_format,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op12_hard_negatives": hard_negatives.MINE_SQL, "op13_prefix_trie": prefix_trie.TRIE_SQL}
