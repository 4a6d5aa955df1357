"""Quality rules with DataFrame functions only: heuristics, and an n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed n-grams, one of trusted documents
and one of the whole corpus, for each order from one to three words; an order has
buckets of its own, so that the many rare n-grams of three words don't drown the
words. The trusted counts of an order are smoothed by ``PRIOR`` n-grams spread as
in the corpus, so that with few trusted documents all ratios near 0. A document's
verdict is the sum of the log ratios of all its n-grams, divided by its number of
words, against a fixed threshold, so it is the same on every run. All counts cover
all documents and all labels; only one number per bucket reaches the driver or
every task.

Expressions are laid out in steps, each a projection, so that splitting, sorting
and set operations run in generated code on primitive arrays; lambdas, which
Spark interprets, are kept few and small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the n-grams of one, two and three words; powers of two.
BUCKETS = (1 << 16, 1 << 15, 1 << 15)
PRIOR = 4096.0
THRESHOLD = -0.5
MIN_WORDS, MAX_REPEATED = 50, 50
_PLACE_BITS = 20
# White space and symbols.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def _bucket(h: Column, order: int) -> Column:
    """The bucket of a hashed n-gram of ``order`` + 1 words; those of lower orders come first."""
    return h.bitwiseAND(F.lit(BUCKETS[order] - 1)).cast("int") + sum(BUCKETS[:order])


def trusted_ids(labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """The ids of all documents labelled good."""
    return labels.where(F.col(label) == 1).select(id_col).distinct()


def _grams(h: Column) -> tuple[Column, Column]:
    """Hashes of the n-grams of two and of three words, from those of the words."""
    first = lambda n: F.slice(h, 1, F.greatest(F.size(h) - n, F.lit(0)))
    pairs = F.zip_with(first(1), F.slice(h, 2, F.size(h)), lambda x, y: F.xxhash64(x, y))
    return pairs, F.transform(first(2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))


def _counted(texts: DataFrame, good: Column, text_col: str) -> DataFrame:
    """(bucket, raw, target): how many n-grams of all texts and of the good ones are in each bucket."""
    hashed = texts.select(good.cast("long").alias("good"), F.transform(words_of(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.xxhash64(x)).alias("_h"))
    grams = hashed.select("good", "_h", *(g.alias(n) for g, n in zip(_grams(F.col("_h")), ("_b", "_g"), strict=True)))
    ends = F.size("_h").alias("n1"), (F.size("_h") + F.size("_b")).alias("n2")
    each = grams.select("good", *ends, F.posexplode(F.concat("_h", "_b", "_g")).alias("at", "g"))
    bucket = F.when(F.col("at") < F.col("n1"), _bucket(F.col("g"), 0)).when(F.col("at") < F.col("n2"), _bucket(F.col("g"), 1)).otherwise(_bucket(F.col("g"), 2))
    return each.select("good", bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))


def bucket_ratios(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row with one array: the log ratio of every bucket, trusted over corpus, from all documents."""
    marked = df.select(id_col, text_col).join(trusted.select(id_col).distinct().withColumn("good", F.lit(1)).hint("shuffle_hash"), id_col, "left")
    counts = _counted(marked, F.coalesce("good", F.lit(0)), text_col)
    every = df.sparkSession.range(sum(BUCKETS)).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0, ["raw", "target"])
    order = F.when(F.col("bucket") < BUCKETS[0], 0).when(F.col("bucket") < sum(BUCKETS[:2]), 1).otherwise(2)
    sums = [F.array(*(F.sum(F.when(order == k, F.col(c)).otherwise(0)) for k in range(3))).alias(n) for c, n in (("target", "t"), ("raw", "r"))]
    listed = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "target", "raw", order.alias("order")))).alias("b"), *sums)
    total = lambda n, x: F.get(F.col(n), x["order"])
    prior = lambda x: x["raw"] / total("r", x)
    known = lambda x: (x["raw"] > 0) & (total("t", x) > 0)
    return listed.select(F.transform("b", lambda x: F.when(known(x), F.log((x["target"] + PRIOR * prior(x)) / ((total("t", x) + PRIOR) * prior(x)))).otherwise(0.0)).alias("ratios"))


def _repeated(df: DataFrame) -> DataFrame:
    """Adds _repeat, the words in three-word windows found twice or more, from _g, the windows' 64-bit hashes, and their number _n.

    Most texts repeat no window, which the set of the windows' hashes shows. In
    the others, windows are sorted by hash with their places in the low bits, and
    those that share their high bits with a neighbour are repeats, unless these
    hold more hashes than high bits. Such texts, and those with more windows than
    the low bits can number, sort pairs of hash and place. A repeat covers three
    words. The work is n log n.
    """
    g, s, p, v = (F.col(c) for c in ("_g", "_s", "_p", "_v"))
    place = (1 << _PLACE_BITS) - 1
    high = lambda x: F.shiftright(x, _PLACE_BITS)
    placed = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long")))
    pairs = F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    df = df.withColumn("_some", F.size(F.array_distinct(g)) < F.col("_n")).withColumn("_long", F.col("_n") > place + 1)
    df = df.withColumn("_s", F.when(F.col("_some") & ~F.col("_long"), F.sort_array(placed)))
    df = df.withColumn("_s", F.filter(s, lambda x, i: (high(x.bitwiseXOR(F.get(s, i + 1))) == 0) | (high(x.bitwiseXOR(F.get(s, i - 1))) == 0)))
    df = df.withColumn("_p", F.transform(s, lambda x: x.bitwiseAND(F.lit(place)).cast("int")))
    alike = F.size(F.array_distinct(F.transform(s, high))) < F.size(F.array_distinct(F.transform(p, lambda i: F.get(g, i))))
    df = df.withColumn("_long", F.col("_some") & (F.col("_long") | alike)).withColumn("_v", F.when(F.col("_long"), F.sort_array(pairs)))
    paired = F.filter(v, lambda x, i: F.coalesce((x["h"] == F.get(v, i + 1)["h"]) | (x["h"] == F.get(v, i - 1)["h"]), x["h"] == F.get(v, i - 1)["h"], x["h"] == F.get(v, i + 1)["h"]))
    df = df.withColumn("_p", F.when(F.col("_long"), F.transform(paired, lambda x: x["i"])).otherwise(p))
    covered = F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))
    return df.withColumn("_repeat", F.when(F.col("_some"), covered).otherwise(0).cast("long"))


def _score(grams: str, order: int) -> Column:
    """The sum of the log ratios of all n-grams of an order, from the array of ratios in _r and the order."""
    at = lambda x: x.bitwiseAND(F.lit(BUCKETS[order] - 1)) + sum(BUCKETS[:order])
    return F.aggregate(grams, F.lit(0.0), lambda a, x: a + F.col(f"_r{order}")[at(x)])


def apply_rules(df: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept.

    A null text counts as empty: no words, llr 0, base_failed, not kept. Without
    trusted documents all ratios are 0 and the heuristics alone decide. Repeated
    rows get equal verdicts; columns of ``df`` with the names above are replaced.
    Texts of any length have exact counts.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    kept = [c for c in df.columns if c not in names]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    w = F.col("_w")
    ratios = bucket_ratios(df, trusted, id_col, text_col).scalar()
    found = df.select(
        *kept,
        words_of(text).alias("_w"),
        lines.alias("_lines"),
        (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
    )
    found = found.select(
        *kept,
        "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(w, lambda x: F.xxhash64(x)).alias("_h"),
    )
    both = (g.alias(n) for g, n in zip(_grams(F.col("_h")), ("_b", "_g"), strict=True))
    counts = ["n_symbols", "n_words", "word_chars", "n_dup_lines"]
    found = found.select(*kept, *counts, "_h", *both)
    # The array of ratios is named once for each use, and above columns that are used twice: so Spark looks it up where it
    # is used. As a column of its own, its megabyte would be copied for each row.
    found = found.select(*kept, *counts, "_h", "_b", "_g", F.size("_g").alias("_n"), *(ratios.alias(f"_r{k}") for k in range(3)))
    found = found.select(*kept, *counts, "_g", "_n", sum(map(_score, ("_h", "_b", "_g"), range(3))).alias("_llr"))
    n, repeated = F.col("n_words"), F.col("_repeat")
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
    # Always true, but of a kind that Spark doesn't push filters through: a filter on the verdict would else be
    # rewritten in terms of the text, with every step above evaluated anew for each word.
    barrier = F.spark_partition_id() >= 0
    llr = F.when(n > 0, F.col("_llr") / n).otherwise(0.0)
    return _repeated(found).select(
        *kept, n, "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), llr.alias("llr"), failed.alias("base_failed"), (barrier & ~failed & (llr >= threshold)).alias("kept")
    )
