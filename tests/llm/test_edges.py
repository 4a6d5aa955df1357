"""Plain versions of the operators, and odd inputs: nulls, empty and long texts, repeats, clashing columns, empty tables."""

import collections
import hashlib
import json
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidebar.llm import chat, decontaminate, licenses, ngram_join, packing, pii, quality, queries, rules, tokencount, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"
ROWS = "doc_id long, text string, kept boolean, n_words string, llr double, items string, spans int, id string, role string, output string, prompt string"


def clashing(spark, rows):
    """Rows of (doc_id, text) with columns that operators use or make, and other values in them."""
    return spark.createDataFrame([(i, t, True, "seven", 9.5, "x", 4, "none", "r", "o", "p") for i, t in rows], ROWS)


LONG = "slow tide and harbour light again " * 40_000
EDGES = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "only null"), (None, None), (4, LONG), (5, " \t\n "), (6, "\x1c   x")]


@pytest.fixture(scope="module")
def edges(spark):
    return clashing(spark, EDGES).repartition(2).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_classifiers_at_the_edges(spark, edges, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train_quality(docs, labels)
    got = collections.defaultdict(set)
    for r in quality.score_quality(edges, model).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        got[r.doc_id].add(r.score)
    assert len(got[1]) == 1 and got[2] == got[3] and quality.score_quality(edges.limit(0), model).count() == 0
    toxic = toxicity.train_toxicity(docs, labels)
    scored = toxicity.score_toxicity(edges, toxic).collect()
    assert len(scored) == len(EDGES) and all(0 <= r.expected_severity <= 2 for r in scored) and toxicity.score_toxicity(edges.limit(0), toxic).count() == 0
    twice = docs.unionByName(docs)
    assert (quality.train_quality(twice, labels) == model).all()
    assert not quality.train_quality(docs.limit(0), labels).any()


def test_quality_scores_equal_a_plain_dot_product(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    weights = np.random.default_rng(1).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    for r in quality.score_quality(docs, weights).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = r.text.casefold().encode()
        words = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+", raw)
        at, _ = quality.buckets([raw])
        assert len(at) == max(0, 2 * len(words) - 1)
        x = collections.Counter(at.tolist())
        z = weights[0] + quality.SCALE * sum(n * weights[1 + b] for b, n in x.items()) / max(1, len(at))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-6)
        assert all((a == quality.REPEAT) or b != c for a, b, c in zip(at[len(words) :], words, words[1:], strict=False))


def test_severity_is_the_sum_of_the_thresholds(spark):
    model = toxicity.Model(toxicity.Words([b"vile", b"mean"], toxicity.PLAIN).hash, np.array([3.0, 1.0]), np.array([1.0, 4.0]))
    df = spark.createDataFrame([(0, "calm"), (1, "vile Vile!"), (2, "mean"), (3, "vile " * 9)], "doc_id long, text string")
    for r in toxicity.score_toxicity(df, model).collect():
        z = [0, 6, 1, 9][r.doc_id]  # counts are cut at three
        p = [1 / (1 + math.exp(t - z)) for t in (1, 4)]
        assert r.expected_severity == pytest.approx(sum(p)) and r.toxic == (p[0] >= 0.5) and r.grade == int(np.argmax([1 - p[0], p[0] - p[1], p[1]]))


def test_chat_at_the_edges(spark):
    rows = [(1, 0, "user", "q", "o", "p", "s"), (1, 1, "gpt", "a", None, None, None), (1, 1, "gpt", "a", None, None, None), (None, 0, None, None, None, None, None), (2, 5, "assistant", "", "", "", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, output string, prompt string, system string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(chat.canonical_turns(df))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"user\nq\ngpt\na\ngpt\na\n").hexdigest() and got[1].loss_chars == 0
    assert got[None].n_turns == 1 and got[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat.conversation_digests(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0
    with pytest.raises(ValueError):
        chat.canonical_turns(df.select("conv_id", "turn", "text"))
    record = {"prompt": "q", "response": "a", "score": 4, "tags": ["x"], "messages": 7}
    assert chat.turns_of(record) == [("user", "q"), ("assistant", "a")]
    assert chat.turns_of({"messages": ["no turn"]}) is None and chat.turns_of({"messages": [{"role": "bot", "content": "a", "id": 1}]}) == [("bot", "a")]
    raw = spark.createDataFrame([(1, json.dumps(record), 4), (1, json.dumps(record), 4), (None, None, None), (3, "[1]", 1)], "id long, j string, turn long")
    assert sorted((r.id or -1, r.turn, r.role) for r in chat.turns_from_json(raw, "id", "j", "turn").collect()) == [(-1, -1, ""), (1, 4, "user"), (1, 4, "user"), (1, 5, "assistant"), (1, 5, "assistant"), (3, -1, "")]


def test_chat_query_equals_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    turns = collections.defaultdict(list)
    for c, k, r, t in sorted(rows, key=lambda x: x[:2]):
        turns[c].append((r, t or ""))
    digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    want = {c: (len(x), digest(f"{r}\n{t}\n" for r, t in x), sum(len(t) for r, t in x if r == "assistant"), digest(t for r, t in x if r == "assistant")) for c, x in turns.items()}
    got = queries.op2_chat_format(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


def plain_licenses(text):
    """Known sentences by searching each one's words, and single-sentence rules."""
    words = re.findall(r"[^\W_]+", text.casefold())
    out = set()
    for name, sequence in licenses.RULES:
        if len(sequence) == 1:
            s = re.findall(r"[^\W_]+", licenses.SENTENCES[sequence[0]].casefold())
            if any(words[k : k + len(s)] == s for k in range(len(words) - len(s) + 1)):
                out.add(name)
    return out


def test_licenses_on_a_table(spark, edges):
    got = licenses.scan_licenses(edges).collect()
    assert len(got) == len(EDGES) and not any(r.matches for r in got) and licenses.scan_licenses(edges.limit(0)).count() == 0
    long = ("filler words here. " * 20_000) + "Released under the MIT License. " + ("more filler. " * 20_000)
    df = clashing(spark, [(1, long), (1, long), (2, "licensed under cc by-sa\n4.0!"), (None, "All rights reserved")])
    assert sorted(r.matches[0].license for r in licenses.scan_licenses(df).collect()) == ["CC-BY-SA-4.0", "MIT", "MIT", "all-rights-reserved"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    single = {n for n, q in licenses.RULES if len(q) == 1}
    for r in licenses.scan_licenses(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert {m.license for m in r.matches} & single == plain_licenses(r.text or "")


def test_every_short_sentence_has_its_license():
    s = licenses.Scanner()
    for name, sequence in licenses.RULES:
        text = "Foo. " + " Then.\n".join(licenses.SENTENCES[q] for q in sequence) + ". Bar."
        assert [m[0] for m in s.match(s.sentences([text.casefold().encode()])[0])] == [name], sequence


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(digits))) % 10 == 0 if len(digits) < 40 else False
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_personal_data_equals_the_plain_patterns(spark, edges):
    random.seed(7)
    pieces = ["1", "25", "4111 1111 1111 1111", "378282246310005", ".", ".", " ", "-", "+1", "(0)", "10.0.0.1", "300", "a", "é", "@x", "b.c", "+44 20 7946 0958", "\n", "0000", "٣"]
    texts = ["".join(random.choice(pieces) for _ in range(random.randrange(1, 25))) for _ in range(3000)]
    for t in texts:
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE] == plain_spans(t), t
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame(list(enumerate(texts[:200], 10**6)), "doc_id long, text string"))
    for r in pii.span_digest(pii.scan_pii(df)).join(df, "doc_id").collect():
        want = plain_spans(r.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(",")) | {""}
    assert pii.scan_pii(edges).count() == len(EDGES) and pii.scan_pii(edges.limit(0)).count() == 0
    assert pii.mask_pii(edges).columns == edges.columns


def test_long_runs_take_time_in_proportion():
    began = time.time()
    for run in ("1" * 400_000, "1." * 200_000, "a@" * 100_000, "+1(" * 100_000, "AB12 " * 80_000, "1-1-" * 100_000, "a." * 100_000 + "@"):
        pii.find_spans(run)
    assert time.time() - began < 20


def test_context_decides():
    masked = lambda t: pii.mask(t, pii.find_spans(t))
    assert masked("my SSN is 123-45-6789") == "my SSN is [SSN]" and masked("part 123-45-6789 of the order") == "part 123-45-6789 of the order"
    assert masked("host 10.1.2.3 is up") == "host [IP] is up" and masked("upgrade to version 10.1.2.3 now") == "upgrade to version 10.1.2.3 now"
    assert masked("SSN 000-45-6789, 666-45-6789, 123-00-6789") == "SSN 000-45-6789, 666-45-6789, 123-00-6789"
    assert [s[0] for s in pii.find_spans("version 10.1.2.3")] == ["ip"]


def plain_items(text, items):
    words = lambda t: re.findall(r"[^\W_]+", t.casefold())
    doc, found = words(text), set()
    for name, item in items:
        it = words(item)
        need = min(len(it), decontaminate.WINDOW)
        enough = math.ceil(decontaminate.SHARE * need)
        for shift in range(-len(it), len(doc)):
            same = [0 <= shift + k < len(doc) and doc[shift + k] == it[k] for k in range(len(it))]
            if len(it) >= decontaminate.MIN_TOKENS and any(sum(same[a : a + need]) >= enough and 0 <= shift + a and shift + a + need <= len(doc) for a in range(len(it) - need + 1)):
                found.add(name)
    return found


def test_decontamination_equals_a_plain_search(spark, edges):
    random.seed(11)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(random.choice(vocabulary) for _ in range(random.choice([3, 5, 8, 12, 16, 24])))) for k in range(12)] + [(12, None), (13, "")]
    texts = []
    for k in range(60):
        _, item = random.choice(items[:12])
        words = [w if random.random() > 0.2 else "other" for w in item.split()]
        texts.append(" ".join([*random.choices(vocabulary, k=5), *words, *random.choices(vocabulary, k=5)]))
    df = clashing(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {k: plain_items(t, [i for i in items if i[1]]) for k, t in enumerate(texts)}
    for limit in (decontaminate.MAX_INDEX, 600):
        got = {r.doc_id: {i["item"] for i in r["items"]} for r in decontaminate.find_contamination(df, bench, max_index=limit).collect()}
        assert got == want
        kept = decontaminate.drop_contaminated(df, bench, max_index=limit)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [k for k in range(60) if not want[k]]
    assert decontaminate.find_contamination(edges, bench).count() == len(EDGES) and decontaminate.find_contamination(edges, bench.limit(0)).count() == len(EDGES)
    assert decontaminate.drop_contaminated(edges, bench).count() == len(EDGES) and decontaminate.drop_contaminated(edges.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(edges, bench, max_index=600).count() == len(EDGES)


def chained(hashes):
    """Spark's hash of several longs: each one's hash is the seed of the next."""
    seed = 42
    for h in hashes:
        seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=seed)
    return seed


def grams(words):
    """The (order, bucket) of a text's n-grams of one to three words."""
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    longer = [(n - 1, chained(h[k : k + n])) for n in (2, 3) for k in range(len(h) - n + 1)]
    return [(o, x & (rules.BUCKETS[o] - 1)) for o, x in [(0, x) for x in h] + longer]


def plain_verdicts(rows, good):
    """{id: (llr, kept)} by counting n-grams in dictionaries."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    raw, target, r, t = (collections.Counter() for _ in range(4))
    for i, w in words:
        for g in grams(w):
            raw[g] += 1
            r[g[0]] += 1
            target[g] += i in good
            t[g[0]] += i in good
    out = {}
    for (i, text), (_, w) in zip(rows, words, strict=True):
        prior = {g: raw[g] / r[g[0]] for g in grams(w)}
        ratio = [math.log((target[g] + rules.PRIOR * prior[g]) / ((t[g[0]] + rules.PRIOR) * prior[g])) if t[g[0]] else 0.0 for g in grams(w)]
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        llr = sum(ratio) / len(w) if w else 0.0
        out[i] = llr, len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and llr >= rules.THRESHOLD
    return out


def test_verdicts_equal_plain_counts(spark, edges, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    want = plain_verdicts([tuple(r) for r in docs.collect()], good)
    got = {r.doc_id: (r.llr, r.kept) for r in rules.apply_rules(docs, rules.trusted_ids(labels)).collect()}
    assert all(got[i][0] == pytest.approx(want[i][0], abs=1e-9) and got[i][1] == want[i][1] for i in want) and len(got) == len(want)
    found = rules.apply_rules(edges, rules.trusted_ids(labels)).collect()
    assert len(found) == len(EDGES) and {r.n_words for r in found if r.doc_id == 4} == {240_000} and not any(r.kept for r in found)
    assert rules.apply_rules(edges.limit(0), rules.trusted_ids(labels)).count() == 0


def test_near_duplicates_at_the_edges(spark, edges):
    got = ngram_join.near_duplicates(edges).collect()
    assert len(got) == len(EDGES) and {r.component_id for r in got if r.doc_id == 1} == {1} and {r.n_shingles for r in got if r.doc_id in (2, 3, 5)} == {0}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_join.keep_one(edges).columns == edges.columns and ngram_join.keep_one(edges.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(3, 1 << 21), (256, 400)])
def test_cut_areas_lose_no_link(spark, monkeypatch, sizes):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sizes[0])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", sizes[1])
    random.seed(sizes[0])
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):  # a chain of slow changes, so that far ends of the chain don't link by themselves
        at = random.randrange(len(base))
        base[at : at + 2] = [f"n{k}a", f"n{k}b"]
        rows.append((k, " ".join(base[: 120 - k // 6])))
    rows += [(100 + k, " ".join(random.sample(base, 100))) for k in range(5)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()} == {rows[k][0]: least[root[k]] for k in range(len(rows))}


def test_packing_and_counts_at_the_edges(spark, edges):
    path = tokencount.vocabulary_path()
    rows = packing.pack_documents(edges, path).collect()
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2 and packing.pack_documents(edges.limit(0), path).count() == 0
    assert len(tokencount.count_tokens(edges, path).collect()) == len(EDGES) and tokencount.count_tokens(edges.limit(0), path).count() == 0
