"""SentencePiece against its library, hard negatives and the prefix trie against plain versions."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidebar.llm import hard_negatives, piece_codec, prefix_trie, queries

MODEL = piece_codec.model_path()
ALPHABET = "  ▁▁ abcdehilmnorstuxyzAB.,'\"()-_\n\t01éßñ中日本語の🙂﻿́\x00<s>/"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


def texts(n, seed):
    rng = random.Random(seed)
    codec = piece_codec.codec(MODEL)
    pieces = sorted(codec.ids)
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60)))
        else:
            yield "".join(rng.choice(pieces) for _ in range(rng.randrange(9))).replace("▁", " ")


def test_codec_is_the_librarys(library):
    codec = piece_codec.codec(MODEL)
    for text in [*texts(6000, 1), "", " ", "a" * 30_000, " " * 30_000, "-=" * 9000, "</s> <unk> <0x41>"]:
        ids = np.frombuffer(codec.encode(text), "<i4").tolist()
        assert ids == library.encode(text), text[:80]
        assert codec.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids(library):
    codec, rng = piece_codec.codec(MODEL), random.Random(2)
    for _ in range(6000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(259, 32000), rng.randrange(130, 259), 28705]) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_codec_backtracks(library):
    """Texts where the longest token at a place is not the one that the encoding has."""
    codec = piece_codec.codec(MODEL)
    greedy = 0
    for text in texts(2000, 3):
        tokens = codec.tokens(codec.prefix + text.replace(" ", piece_codec.SPACE)) if text else []
        assert [codec.ids.get(t) for t in tokens if t in codec.ids] == [i for i in (library.encode(text) if text else []) if i not in set(codec.byte_ids)]
        at, rest = 0, codec.prefix + text.replace(" ", piece_codec.SPACE)
        for t in tokens:
            greedy += any(rest[at : at + n] in codec.shorter for n in range(len(t) + 1, 17))
            at += len(t)
    assert greedy > 100


def test_codec_query(spark, tmp_path, library):
    docs = [(1, "Hello  world"), (2, None), (3, ""), (4, "x\ty\nz" * 20_000), (None, "null id"), (1, "Hello  world"), (5, "▁ 日本🙂")]
    wide = [(i, t, "keep", 1) for i, t in docs]
    spark.createDataFrame(wide, "doc_id long, text string, ids string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op11_sentencepiece(spark, str(tmp_path)).collect(), key=str)
    want = []
    for i, t in docs:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert piece_codec.encode_texts(empty, MODEL).count() == 0


def plain_negatives(rows, every, positives, negatives, low, high):
    good = [(i, la, [math.floor(256 * float(x)) for x in v]) for i, v, la in rows if None not in (i, la, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (i, la, v) in enumerate(good):
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, lb) for b, (j, lb, w) in enumerate(good) if b != a))
        for s, j, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [(-t, k) for t, k, lb in scored if lb != la and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, n, k, -s, t) for n, (t, k) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def vectors(seed, n, dims):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = [rng.choice([-0.5, 0.0, 0.25, 0.5]) if i % 3 else rng.gauss(0, 1) for _ in range(dims)]
        rows.append((i, [float(np.float32(x)) for x in base], rng.randrange(3)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives(spark, monkeypatch, seed):
    """Ties, repeated vectors, rows that take no part, shorter vectors and columns of other names."""
    rows = vectors(seed, 700, 5)
    rows += [(700 + k, [0.5] * 5, k % 2) for k in range(60)] + rows[:3] + rows[70:71]
    rows += [(None, [1.0] * 5, 1), (801, None, 1), (802, [1.0] * 5, None), (803, [1.0, None, 0.0, 0.0, 0.0], 1), (804, [float("nan")] + [0.0] * 4, 1), (805, [float("inf")] + [0.0] * 4, 1), (806, [0.5, 0.25], 1), (810, [], 0)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<float>, label int, score int, block int").repartition(7)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, every=10, positives=4, negatives=6).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows, 10, 4, 6, hard_negatives.LOW, hard_negatives.HIGH)
    assert len(got) > 500


def test_hard_negatives_of_huge_and_of_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    huge = [(i, [3e38 if i % 2 else 1.0, -1.0 * i], i % 2) for i in range(20)]
    assert hard_negatives.mine(spark.createDataFrame(huge, schema)).count() >= 0
    assert hard_negatives.mine(spark.createDataFrame([], schema)).collect() == []
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1)], schema)).collect() == []


def test_hilbert_curve_is_a_path():
    """All cells of a cube, in the order of their places, are neighbours."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = sorted(range(len(cells)), key=lambda k: hard_negatives.hilbert(cells, 3)[k].tobytes())
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert (steps == 1).all() and len(set(order)) == 512


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [x[2:] for x in sorted(own[c], key=lambda x: (x[0], x[1], x[2], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).hexdigest()))]
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        gain = (len(m) - 1) * len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += gain
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("size, slab", [(512, 256), (7, 2), (3, 1)])
def test_prefix_trie(spark, size, slab):
    """Shared openings over several shards, copies, nulls, ties, gaps in the ids, long and turnless conversations."""
    rng = random.Random(size)
    said = ["hi", "ho ho", "", None, "a b c", "tab\tand\nline  end"]
    rows = []
    for c in [*range(60), 83, 84, 119, 2000, -5]:
        n = rng.choice([1, 2, 3, 4, 9])
        rows += [(c, rng.choice([t, t, None]) if t < 2 else t, rng.choice(["user", "user", None]), rng.choice(said)) for t in range(n)]
    for c in range(40, 52):
        rows = [r for r in rows if r[0] != c] + [(c, t, "user", f"copy {t}") for t in range(12)]
    rows += rows[:20] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, b"x", 3) for r in rows], "conv_id long, turn long, role string, text string, key binary, at int").repartition(5)
    nodes, ends = prefix_trie.prefix_trie(prefix_trie.spliced(prefix_trie.turn_rows(df)), size, slab)
    found = nodes.join(prefix_trie.ends_digest(ends), "key", "left").collect()
    none = hashlib.sha256(b"").hexdigest()
    got = [(r["first"], r["depth"], r["parent"], r["n_members"], r["n_children"], r["n_leaves"], r["saved"], r["ends_sha256"] or none) for r in found]
    assert sorted(got, key=str) == sorted(plain_trie(rows), key=str)


def test_prefix_trie_query(spark, tmp_path):
    rows = [(c, t, "user", f"{c % 3 if t < 2 else c} turn {t}") for c in range(50) for t in range(c % 6 + 1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(rows), key=str)


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes, ends = prefix_trie.prefix_trie(prefix_trie.spliced(prefix_trie.turn_rows(empty)))
    assert nodes.count() == 0 and prefix_trie.ends_digest(ends).count() == 0
