"""The pipeline's stages against plain versions, on a small corpus with planted faults."""

import collections
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tidebar.llm import tokencount

from .test_edges import plain_items, plain_spans, plain_verdicts


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    random.seed(21)
    words = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ha", "jo", "ku") for b in ("lin", "mar", "nor", "pet", "ros", "sun", "tam", "vel")]
    text = lambda n: " ".join(random.choice(words) for _ in range(n))
    items = [(k, text(30)) for k in range(4)]
    rows = [(k, text(random.randrange(60, 160))) for k in range(40)]
    rows += [(40 + k, rows[k][1]) for k in range(6)]
    rows += [(50 + k, rows[k][1] + " " + text(3)) for k in range(6)]
    rows += [(60 + k, f"{text(40)} {items[k % 4][1]} {text(40)}") for k in range(6)]
    rows += [(70 + k, f"{text(60)} write to a{k}@b.example.org or +1 415 555 010{k}") for k in range(6)]
    rows += [(80, "short"), (81, ""), (82, None), (83, "again and again " * 60), (84, " ".join(f"#|{w}" for w in text(200).split()))]
    folder = tmp_path_factory.mktemp("corpus")
    shape = "doc_id long, text string, lang string, source string, n_chars long, kept string, llr int, _key string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own", 7, "k") for i, t in rows], shape).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows[:40]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, items


def jaccard_keep(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    return [min((rows[k] for k in range(len(rows)) if root[k] == r), key=lambda x: x[0]) for r in set(root)]


def plain_mask(text):
    out, done = [], 0
    for kind, a, b in plain_spans(text):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def test_stages_equal_plain_versions(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    verdicts = plain_verdicts(rows, {i for i, _ in rows[:40]})
    want = [r for r in rows if verdicts[r[0]][1]]
    assert 84 not in dict(want) and 83 not in dict(want) and set(range(40)) <= set(dict(want))
    steps = [lambda x: x, jaccard_keep, lambda x: [(i, t) for i, t in x if not plain_items(t, items)], lambda x: [(i, plain_mask(t)) for i, t in x]]
    for (name, stage), plain in zip(corpus_pipeline.STAGES, steps, strict=False):
        want = sorted(plain(want))
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "llr", "_key"], name
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == want, name
        assert all((r.kept, r.llr, r._key) == ("own", 7, "k") for r in got)
        docs = spark.createDataFrame(got, docs.schema)
    assert all(r.n_chars == len(r.text) for r in got)


def test_run_packs_all_that_is_kept(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    library = tokencount.transducer(tokencount.vocabulary_path()).library
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got, filled = collections.Counter(), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] += r.length
        filled[r.sequence_id].append((r.offset, r.length))
    assert got == want
    assert all(sum(n for _, n in x) <= 4096 and sorted(x)[0][0] == 0 for x in filled.values())


def test_empty_corpus(spark, corpus, tmp_path):
    folder, *_ = corpus
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_null_ids(spark, corpus, tmp_path):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    kept = more
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, kept, str(tmp_path))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None not in ids and np.isin(range(6, 40), ids).all()
