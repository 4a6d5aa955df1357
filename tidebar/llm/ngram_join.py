"""N-gram Jaccard self-join with signature trees.

A document's set holds its distinct shingles of five words, by 64-bit hash. Two
documents link when the Jaccard similarity of their sets is 0.8 or more. The join
is exact:

1. Equal sets are one class, known by a 128-bit fingerprint.
2. A set of which more than a fifth is found in no other class links with nothing.
   Shingles are dealt out by hash and counted; a fixed share of all hashes does, as
   a class can be ruled out by these alone. The classes left are counted again, then
   with all shingles. Only counts by class travel back.
3. In one order of all shingles, two sets that link share a shingle among the
   first n - ceil(0.8 n) + 1 of each. Shingles seen often come last, which is only
   a matter of speed. Classes that share such a shingle are candidates if their
   sizes lie close and enough shingles follow the shared one in both. A shingle
   shared by more than ``PAIRED`` classes tests no pairs: classes of a run of close
   sizes are tied to the smallest, first within each task.
4. Connected components of the candidates, the areas, are the only places where
   links can be. Each area builds a signature tree: leaf and inner nodes hold the OR
   of their sets' bitmaps, the range of sizes and the most shingles that share bits.
   The tree is walked against itself, a pair of nodes whose largest possible
   overlap is too small is dropped, and the pairs of sets that remain are compared
   in full, unless already connected.
5. A large area is cut into blocks of bounded size by band of sizes. Each block
   meets itself and a few hubs of its area. What they leave outside the area's
   largest component then meets all blocks of close sizes, so that a group of
   copies costs its size and not its square.
6. Connected components of the links give each class its label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components, dropped, staged
from .textio import _GRAM, WORDS, Words, mix, sliced

SHINGLE = 5
FANOUT, FRONTIER = 8, 50_000
BLOCK_SETS, BLOCK_SHINGLES, HUBS = 256, 1 << 21, 4
LOCAL_OFTEN, OFTEN, MAX_OFTEN = 2, 4, 1 << 19
PAIRED, FLUSH_ROWS, FLUSH_SHINGLES = 64, 1 << 21, 4_000_000
#: Sizes on a log scale, so that sizes that can link lie REACH steps apart at most.
STEP, REACH = 1.01, 23
BAND = 1.26
_SIZES = STEP ** np.arange(4096.0)
_ROW = np.dtype([("key", "<u8"), ("node", "<i8"), ("low", "<u2"), ("high", "<u2"), ("rest", "<u2")])
_NODE = (1 << 48) - 1
MIN_FILTER, MAX_FILTER = 20, 28
#: Of the first counts, one hash in so many; sets of a flush, whose numbers take the place of the lowest bits of hashes.
SAMPLED, FLUSH_BITS = 3, 14
_U = np.uint64


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words is one shingle, one without words none."""
    words = Words(texts, WORDS)
    grams, first = words.grams(SHINGLE)
    out = []
    for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b > a:
            out.append(np.unique(grams[a:b]))
        else:
            h = words.hash[words.first[k] : words.first[k + 1]]
            out.append(mix(np.sum(h * _GRAM[: len(h)], keepdims=True) + _U(len(h))) if len(h) else h)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([np.sum(mix(s + _U(17))), np.sum(mix(s ^ _U(0x5DEECE66D)))], np.uint64).tobytes()


def prefix(s: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The shingles of which sets that link share one: the first of the common order, often seen ones last."""
    n = len(s)
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        last = often[at] == s
        if last.any():
            s = np.concatenate([s[~last], s[last]])
    return s[: n - (4 * n + 4) // 5 + 1]


def _each_set(texts: bool, column: pd.Series) -> Iterator[np.ndarray]:
    """The sets of a batch of texts, or of sets as bytes."""
    if texts:
        for _, some in sliced(column):
            yield from shingle_sets(some)
    else:
        yield from (np.frombuffer(raw, np.uint64) for raw in column)


def _dealt(values: np.ndarray) -> bytes:
    """Sorted hashes whose lowest bits are numbers of sets, as gaps by plane of bytes, which compress."""
    key, owner = values >> _U(FLUSH_BITS), (values & _U((1 << FLUSH_BITS) - 1)).astype("<u2")
    gap = np.diff(key, prepend=key[:1])
    narrow = int(gap.max()) < 1 << 32
    planes = gap.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if narrow else gap.astype("<u8").tobytes()
    return bytes([narrow]) + key[:1].tobytes() + owner.view(np.uint8).reshape(-1, 2).T.tobytes() + planes


def _undealt(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    narrow, first = raw[0], np.frombuffer(raw, "<u8", 1, 1)
    n = (len(raw) - 9) // (6 if narrow else 10)
    owner = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 2 * n, 9).reshape(2, n).T).view("<u2").ravel()
    if narrow:
        gap = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 9 + 2 * n).reshape(4, n).T).view("<u4").ravel().astype(np.uint64)
    else:
        gap = np.frombuffer(raw, "<u8", n, 9 + 2 * n)
    return first + np.cumsum(gap), owner


_SEEN = np.dtype([("id", "<i8"), ("n", "<i8"), ("named", "?"), ("fresh", "?"), ("class", "V16")])
_LONE = np.dtype([("set", "<u2"), ("n", "<u4")])


def _screened(rows: DataFrame, column: str, share: int, parts: int) -> DataFrame:
    """(id, n, class, node, alive) for every row of (id, text or shingles): alive, unless more than a fifth of the set is in no other class.

    Only one set of each class that a task's flush sees is counted; of its others
    ``alive`` is false. ``share``: one hash in so many is counted. A flush sends
    each hash twice at most, however many of its sets have it.
    """
    texts = column == "text"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held, seen, known, size = [], [], set(), 0

        def flush() -> pd.DataFrame:
            out = [(task % parts, task, True, np.array(seen, _SEEN).tobytes())]
            values = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            # two sets tell all others that a shingle is shared, so a very common one is sent twice and no more
            key = values >> _U(FLUSH_BITS)
            values = values[np.concatenate([np.ones(min(2, len(key)), bool), key[2:] != key[:-2]])]
            part = (values >> _U(40)) * _U(parts) >> _U(24)
            where, begin = np.unique(part, return_index=True)
            for p, a, b in zip(where.tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)], strict=False):
                out.append((p, task, False, _dealt(values[a:b])))
            return pd.DataFrame(out, columns=["part", "flush", "sets", "raw"])

        for batch in batches:
            named = batch["id"].notna().to_numpy()
            ids = batch["id"].fillna(0).to_numpy(np.int64).tolist()
            for k, s in enumerate(_each_set(texts, batch[column])):
                name = fingerprint(s)
                fresh = name not in known and len(s) > 0
                if fresh:
                    known.add(name)
                    some = s if share == 1 else s[(s >> _U(20)) % _U(share) == 0]
                    held.append(some >> _U(FLUSH_BITS) << _U(FLUSH_BITS) | _U(len(seen)))
                    size += len(some)
                seen.append((ids[k], len(s), named[k], fresh, name))
                if size > FLUSH_SHINGLES or len(seen) >= 1 << FLUSH_BITS:
                    yield flush()
                    held, seen, known, size, task = [], [], set(), 0, task + 1
        if seen:
            yield flush()

    def count(group: pd.DataFrame) -> pd.DataFrame:
        sets = group["sets"].to_numpy(bool)
        out = [(f, True, r) for f, r in zip(group["flush"][sets], group["raw"][sets], strict=True)]
        blobs = [_undealt(r) for r in group["raw"][~sets]]
        if blobs:
            keys = np.concatenate([k for k, _ in blobs])
            order = np.argsort(keys, kind="stable")
            new = np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]])
            lone = np.empty(len(keys), bool)
            lone[order] = new[1:] & new[:-1]
            at = 0
            for f, (_, owner) in zip(group["flush"][~sets], blobs, strict=True):
                who, n = np.unique(owner[lone[at : at + len(owner)]], return_counts=True)
                at += len(owner)
                found = np.empty(len(who), _LONE)
                found["set"], found["n"] = who, n
                out.append((f, False, found.tobytes()))
        return pd.DataFrame(out, columns=["flush", "sets", "raw"])

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        sets = group["sets"].to_numpy(bool)
        seen = np.frombuffer(group["raw"][sets].iloc[0], _SEEN)
        lone = np.zeros(len(seen), np.int64)
        for raw in group["raw"][~sets]:
            found = np.frombuffer(raw, _LONE)
            lone[found["set"]] += found["n"]
        names = [x.tobytes() for x in seen["class"]]
        nodes = [int.from_bytes(x[:8], "little") & _NODE for x in names]
        ids = pd.array(seen["id"], "Int64")
        ids[~seen["named"]] = pd.NA
        return pd.DataFrame({"id": ids, "n": seen["n"], "class": names, "node": nodes, "alive": seen["fresh"] & (5 * lone <= seen["n"])})

    dealt = rows.select("id", column).mapInPandas(deal, "part bigint, flush bigint, sets boolean, raw binary")
    counted = dealt.groupBy("part").applyInPandas(count, "flush bigint, sets boolean, raw binary")
    return counted.groupBy("flush").applyInPandas(judge, "id bigint, n bigint, class binary, node bigint, alive boolean")


def _often_seen(sets: DataFrame) -> np.ndarray:
    """Shingles that many classes have, as far as tasks see them often themselves; at most MAX_OFTEN, the most frequent counts first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            some = n >= LOCAL_OFTEN
            return pd.DataFrame({"shingle": keys[some].view(np.int64), "n": n[some]})

        for batch in batches:
            for s in _each_set(False, batch["shingles"]):
                held.append(s)
                size += len(s)
                if size > FLUSH_SHINGLES:
                    yield flush()
                    held, size = [], 0
        yield flush()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"raw": [batch["shingle"].to_numpy(np.int64).tobytes()]})

    seen = sets.select("shingles").mapInPandas(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    seen = staged(seen)
    counts = Window.orderBy(F.desc("n"))
    fits = seen.groupBy("n").agg(F.count("*").alias("c")).withColumn("total", F.sum("c").over(counts)).where(F.col("total") <= MAX_OFTEN)
    least = fits.agg(F.min("n")).first()[0]
    raws = [] if least is None else [r["raw"] for r in seen.where(F.col("n") >= least).select("shingle").mapInPandas(pack, "raw binary").collect()]
    dropped(seen)
    return np.sort(np.frombuffer(b"".join(raws), np.uint64))


def _sent(rows: np.ndarray) -> bytes:
    """Rows as 18 bytes each: what equals a key or node in its lower 48 bits may be taken for it, which adds candidates and loses none."""
    six = [np.ascontiguousarray(rows[f]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for f in ("key", "node")]
    return b"".join([*six, *(np.ascontiguousarray(rows[f]).tobytes() for f in ("low", "high", "rest"))])


def _received(raw: bytes) -> np.ndarray:
    n = len(raw) // 18
    rows = np.zeros(n, _ROW)
    for k, f in enumerate(("key", "node")):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, 6 * n * k).reshape(-1, 6)
        rows[f] = wide.view(rows[f].dtype).ravel()
    for k, f in enumerate(("low", "high", "rest")):
        rows[f] = np.frombuffer(raw, "<u2", n, 12 * n + 2 * n * k)
    return rows


def entries(s: np.ndarray, node: int, n: int) -> np.ndarray:
    """A row for each shingle of a prefix: the size of the set, and how many shingles are left from there on."""
    rows = np.empty(len(s), _ROW)
    rows["key"], rows["node"] = s & _U(_NODE), node
    rows["low"] = rows["high"] = int(math.log(n) / math.log(STEP))
    rows["rest"] = np.ceil(np.log(n - np.arange(len(s))) / math.log(STEP)) + 1
    return rows


def _runs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row for every key and run of sizes that lie close, edges of the nodes to the smallest of their run); rows are sorted by key and size."""
    number = np.cumsum(np.concatenate([[False], rows["key"][1:] != rows["key"][:-1]])) << 20
    reach = np.maximum.accumulate(number + rows["high"])
    begin = np.flatnonzero(np.concatenate([[True], number[1:] + rows["low"][1:] > reach[:-1] + REACH]))
    least = np.minimum.reduceat(rows["node"], begin)
    every = np.repeat(least, np.diff(np.append(begin, len(rows))))
    away = rows["node"] != every
    out = rows[begin].copy()
    out["node"] = least
    for f in ("high", "rest"):
        out[f] = np.maximum.reduceat(rows[f], begin)
    return out, np.stack([rows["node"][away], every[away]], axis=1)


def _pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Edges between rows of a key that can link: sizes lie close, and enough shingles are left in both from the shared one on."""
    begin = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    length = np.diff(np.append(begin, len(rows)))
    for n in np.unique(length[length > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        at = begin[length == n]
        for k in range(0, len(at), max(1, FRONTIER * 8 // len(i))):
            some = at[k : k + max(1, FRONTIER * 8 // len(i)), None]
            a, b = rows[(some + i).ravel()], rows[(some + j).ravel()]
            low, high = a["low"].astype(np.int64), b["low"].astype(np.int64)
            close = (low - b["high"] <= REACH) & (high - a["high"] <= REACH)
            enough = 9 * _SIZES[np.minimum(a["rest"], b["rest"])] >= 4 * (_SIZES[low] + _SIZES[high])
            ok = close & enough
            yield np.stack([a["node"][ok], b["node"][ok]], axis=1)


def _split(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows sorted by key and size and each node once, which lie in keys of more than PAIRED rows)."""
    rows = rows[np.lexsort((rows["node"], rows["low"], rows["key"]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows["key"][1:] == rows["key"][:-1]) & (rows["node"][1:] == rows["node"][:-1]) & (rows["high"][1:] == rows["high"][:-1])
    rows = rows[~again]
    begin = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
    length = np.diff(np.append(begin, len(rows)))
    return rows, np.repeat(length > PAIRED, length)


def stars(edges: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node connected with it) for every other node of the edges."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in edges.tolist():
        x, y = top(x), top(y)
        root[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(root) if top(x) != x]


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges that connect the same nodes, fewer than there are nodes."""
    if not len(edges):
        return edges
    return np.array(stars(np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0)), np.int64).reshape(-1, 2)


def _candidates(sets: DataFrame, often: np.ndarray, parts: int) -> DataFrame:
    """Edges (a, b) that connect all nodes that share a prefix shingle and can link."""
    seldom = sets.sparkSession.sparkContext.broadcast(often)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            rows, many = _split(np.concatenate(held))
            edges = np.empty((0, 2), np.int64)
            if many.any():
                runs, edges = _runs(rows[many])
                rows, edges = np.concatenate([rows[~many], runs]), forest(edges)
            part = (mix(rows["key"]) >> _U(20)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            part, rows = part[order], rows[order]
            where, begin = np.unique(part, return_index=True)
            end = np.append(begin[1:], len(part))
            out = [(int(p), True, _sent(rows[a:b])) for p, a, b in zip(where, begin, end, strict=True)]
            part = edges[:, 0] % parts
            out += [(int(p), False, edges[part == p].tobytes()) for p in np.unique(part)]
            return pd.DataFrame(out, columns=["part", "open", "rows"])

        for batch in batches:
            for s in _each_set(False, batch["shingles"]):
                node = int.from_bytes(fingerprint(s)[:8], "little") & _NODE
                held.append(entries(prefix(s, seldom.value), node, len(s)))
                size += len(held[-1])
                if size > FLUSH_ROWS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        is_open = group["open"].to_numpy(bool)
        edges = [np.frombuffer(r, np.int64).reshape(-1, 2) for r in group["rows"][~is_open]]
        if is_open.any():
            rows, many = _split(np.concatenate([_received(r) for r in group["rows"][is_open]]))
            if many.any():
                edges.append(_runs(rows[many])[1])
            for found in _pairs(rows[~many]):
                edges.append(found)
                if len(edges) > 64:
                    edges = [forest(np.concatenate(edges))]
        found = forest(np.concatenate(edges)) if edges else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    return sets.select("shingles").mapInPandas(spread, "part bigint, open boolean, rows binary").groupBy("part").applyInPandas(meet, "a bigint, b bigint")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sets' signatures, the bits that their shingles fall on: four times as many as the largest set has shingles, or more."""
    words = 1 << max(3, (4 * max(map(len, sets), default=1) // 64).bit_length())
    out = np.zeros((len(sets), words), np.uint64)
    bits = np.zeros(64 * words, bool)
    for k, s in enumerate(sets):
        at = (s >> _U(13)).astype(np.int64) & (64 * words - 1)
        bits[at] = True
        out[k] = np.packbits(bits).view(np.uint64)
        bits[at] = False
    return out


class Tree:
    """A signature tree over sets: level 0 has the sets, each further level the OR of up to FANOUT nodes below."""

    def __init__(self, maps: np.ndarray, size: np.ndarray):
        self.levels = [(maps, size, size, size - np.bitwise_count(maps).sum(axis=1).astype(np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(children of the nodes, place in ``nodes`` of each one's parent)."""
        total = len(self.levels[level - 1][0])
        begin = nodes * FANOUT
        n = np.minimum(begin + FANOUT, total) - begin
        which = np.repeat(np.arange(len(nodes)), n)
        return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum()), which


def _may_link(x: Tree, i: int, a: np.ndarray, y: Tree, j: int, b: np.ndarray) -> np.ndarray:
    """Whether sets under nodes a of x's level i and b of y's level j can overlap enough."""
    (xm, xl, xh, xs), (ym, yl, yh, ys) = x.levels[i], y.levels[j]
    ok = np.flatnonzero((4 * xl[a] <= 5 * yh[b]) & (4 * yl[b] <= 5 * xh[a]))
    out = np.zeros(len(a), bool)
    step = max(1, (1 << 20) // xm.shape[1])
    for k in range(0, len(ok), step):
        some = ok[k : k + step]
        c, d = a[some], b[some]
        most = np.bitwise_count(xm[c] & ym[d]).sum(axis=1).astype(np.int64) + np.minimum(xs[c], ys[d])
        out[some] = 9 * np.minimum(most, np.minimum(xh[c], yh[d])) >= 4 * (xl[c] + yl[d])
    return out


def candidate_pairs(x: Tree, y: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that the walk over both trees leaves, in parts; of a tree with itself each pair once."""
    own = x is y
    stack = [(len(x.levels) - 1, np.zeros(1, np.int64), len(y.levels) - 1, np.zeros(1, np.int64))]
    while stack:
        i, a, j, b = stack.pop()
        ok = _may_link(x, i, a, y, j, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if not i and not j:
            if own:
                a, b = a[a < b], b[a < b]
            yield a, b
            continue
        if i >= j:
            c, which = x.children(i, a)
            a, b, i = c, b[which], i - 1
        else:
            c, which = y.children(j, b)
            a, b, j = a[which], c, j - 1
        if own and i == j:
            keep = a <= b
            a, b = a[keep], b[keep]
        for k in range(0, len(a), FRONTIER):
            stack.append((i, a[k : k + FRONTIER], j, b[k : k + FRONTIER]))


def alike(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether the sets' Jaccard similarity is 0.8 or more."""
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    same = int((t[at] == s).sum())
    return 100 * same >= 80 * (len(s) + len(t) - same)


def connecting_pairs(sets: list[np.ndarray], split: int | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all that the links between the sets connect.

    Without ``split`` the sets are joined with themselves, otherwise those before
    it with those from it on. Sets with equal ``known`` are connected already;
    pairs of connected sets are passed over.
    """
    size = np.array([len(s) for s in sets], np.int64)
    maps = bitmaps(sets)
    x = Tree(maps[:split], size[:split])
    y = x if split is None else Tree(maps[split:], size[split:])
    root = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    links = []
    for a, b in candidate_pairs(x, y):
        b = b + (split or 0)
        while True:
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            _, now = np.unique(a, return_index=True)  # one pair of every left set, the rest again once these have been joined
            for p, q in zip(a[now].tolist(), b[now].tolist(), strict=True):
                if root[p] != root[q] and alike(sets[p], sets[q]):
                    links.append((p, q))
                    root[root == root[q]] = root[p]
            rest = np.ones(len(a), bool)
            rest[now] = False
            a, b = a[rest], b[rest]
    return links


def _links(rows: DataFrame, parts: int) -> DataFrame:
    """Edges (a, b, whole) by id from (group, side, whole, id, class, known, shingles): a group's side 0 meets side 1, or itself if there is no other.

    Each edge ties a class to the smallest id of those that the group connects;
    ``whole``: the group is a whole area, so these are its components.
    """

    def join(slot: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, group in slot.groupby("group", sort=False):
            group = group.drop_duplicates(["side", "id", "class"])
            sets = [np.frombuffer(r, np.uint64) for r in group["shingles"]]
            side, size = group["side"].to_numpy(), np.array([len(s) for s in sets])
            order = np.lexsort(([int(s[0]) for s in sets], size, side))  # copies lie together
            sets, names, known = [sets[k] for k in order], group["id"].to_numpy()[order], group["known"].to_numpy()[order]
            both, split = side.any(), int((side == 0).sum())
            if len(sets) > 1 and (split or not both):
                pairs = np.array([(names[p], names[q]) for p, q in connecting_pairs(sets, split if both else None, known)], np.int64).reshape(-1, 2)
                found += [(a, b, bool(group["whole"].iloc[0])) for a, b in stars(pairs)]
        return pd.DataFrame(found, columns=["a", "b", "whole"]).astype({"a": "int64", "b": "int64", "whole": "bool"})

    slot = F.pmod(F.xxhash64("group"), F.lit(parts)).alias("slot")
    return rows.select(slot, "group", "side", "whole", "id", "class", "known", "shingles").groupBy("slot").applyInPandas(join, "a bigint, b bigint, whole boolean")


def _marked(classes: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2 ** bits of the classes' hashed ids; a full one only lets more documents through."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = classes.select(bit.alias("bit")).groupBy(F.expr("bit div 32").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"at": [batch["word"].to_numpy(np.int32).tobytes()], "bits": [batch["bits"].to_numpy(np.int64).astype(np.uint32).tobytes()]})

    out = np.zeros(1 << bits - 5, np.uint32)
    for row in words.mapInPandas(pack, "at binary, bits binary").collect():
        out[np.frombuffer(row["at"], np.int32)] = np.frombuffer(row["bits"], np.uint32)
    return out


def _only(rows: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """(id, class, n, shingles) of the rows of (id, text or shingles) whose id is marked: those of the classes and, by chance, a few others."""
    bits = min(MAX_FILTER, max(MIN_FILTER, (32 * classes.count()).bit_length()))
    held = rows.sparkSession.sparkContext.broadcast(_marked(classes, bits))
    texts = column == "text"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, bytes]] = set()
        for batch in batches:
            bit = batch["bit"].to_numpy(np.int64)
            batch = batch[(held.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1) > 0]
            out, size = [], 0
            for name, s in zip(batch["id"].to_numpy(np.int64).tolist(), _each_set(texts, batch[column]), strict=True):
                what = name, fingerprint(s)
                if not len(s) or what in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(what)
                out.append((*what, len(s), s.tobytes()))
                size += len(s)
                if size > FLUSH_SHINGLES:
                    yield pd.DataFrame(out, columns=["id", "class", "n", "shingles"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=["id", "class", "n", "shingles"])

    marked = rows.where("id is not null").select("id", column, F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("bit"))
    return marked.mapInPandas(cut, "id bigint, class binary, n bigint, shingles binary")


def _banded(classes: DataFrame) -> DataFrame:
    return classes.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)))


def _blocks(classes: DataFrame) -> DataFrame:
    """(area, band, blocks): into how many blocks of bounded size the classes of an area and band go."""
    return classes.groupBy("area", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _in_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("class"), F.col(blocks)).cast("int").alias("i")


def _met(bands: DataFrame) -> DataFrame:
    """(area, band, other, j): the blocks j of band ``other`` that rows of ``band`` can link with."""
    near = F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band")
    return bands.select("area", near, F.col("band").alias("other"), "blocks").select("area", "band", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))


def _first_groups(classes: DataFrame, large: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows by group for a first round of links: each small area, and each block of a large one with its area's hubs of close sizes."""
    chance = F.struct(F.xxhash64("class"), "class")
    first = large.groupBy("area", "band", "i").agg(F.min_by(F.struct("id", "class"), chance).alias("x")).select("area", "band", "x.*")
    place = F.row_number().over(Window.partitionBy("area", "band").orderBy(chance))
    hubs = first.withColumn("place", place).where(F.col("place") <= HUBS).join(_met(bands), ["area", "band"])
    small = classes.join(bands.select("area").distinct(), "area", "left_anti").select(F.col("area").cast("string").alias("group"), F.lit(0).alias("side"), F.lit(True).alias("whole"), "id", "class", F.col("id").alias("known"))
    for part, names in ((large, ("area", "band", "i")), (hubs, ("area", "other", "j"))):
        small = small.unionByName(part.withColumn("group", F.concat_ws(":", *names)).select("group", F.lit(0).alias("side"), F.lit(False).alias("whole"), "id", "class", F.col("id").alias("known")))
    return small


def _second_groups(large: DataFrame, bands: DataFrame, found: DataFrame) -> DataFrame:
    """Rows by group in which the classes outside their area's largest component meet all blocks of close sizes."""
    parted = staged(large.join(found, large["id"] == found["node"], "left").withColumn("known", F.coalesce("component", "id")).drop("node", "component"))
    most = parted.groupBy("area", "known").agg(F.count("*").alias("c")).groupBy("area").agg(F.max_by("known", F.struct("c", "known")).alias("main"))
    rest = staged(parted.join(most, "area").where("known <> main").drop("main", "i", "blocks"))
    few = staged(_blocks(rest))
    left = rest.join(few, ["area", "band"]).withColumn("i", _in_block("blocks")).join(_met(bands), ["area", "band"]).withColumn("group", F.concat_ws(":", "area", "band", "i", "other", "j"))
    right = parted.join(_met(few), ["area", "band"]).withColumn("group", F.concat_ws(":", "area", "other", "j", "band", "i"))
    sides = (rows.select("group", F.lit(side).alias("side"), F.lit(False).alias("whole"), "id", "class", "known") for side, rows in enumerate((left, right)))
    return staged(reduce(DataFrame.unionByName, sides), parted, rest, few)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id that links reach.

    Ids are integers. Null and empty texts, and texts of white space only, have no
    shingles and link with nothing. Classes whose smallest ids are equal, as rows of
    one id can have different texts, count as linked; a row with a null id has a
    null component. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(_screened(narrow, "text", SAMPLED, parts))
    known = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    least = known.groupBy("class", "node").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.bool_or("alive").alias("alive"))
    sets = staged(_only(narrow, "text", least.where("alive")))
    alive = staged(_screened(sets, "shingles", 1, parts).where("alive").select("id", "class", "node", "n"))
    sets = staged(_only(sets, "shingles", alive).join(alive.select("id", "class"), ["id", "class"]).dropDuplicates(["id", "class"]), sets)
    areas = connected_components(_candidates(sets, _often_seen(sets), parts))
    classes = staged(alive.dropDuplicates(["id", "class"]).join(areas, "node").select("id", "class", "n", F.col("component").alias("area")), areas, alive)
    some = classes.groupBy("area").agg(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES).alias("x")).where("x > 1").select("area")
    bands = staged(_blocks(_banded(classes).join(some, "area", "left_semi")))
    large = _banded(classes).join(bands, ["area", "band"]).withColumn("i", _in_block("blocks"))
    keys = ["id", "class"]
    links = staged(_links(_first_groups(classes, large, bands).join(_only(sets, "shingles", classes).drop("n"), keys), parts))
    whole = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if not bands.isEmpty() or not classes.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        # areas that were cut, and classes that share an id, are put together
        every = links.select("a", "b")
        groups = _second_groups(large, bands, connected_components(links.where("not whole").select("a", "b")))
        more = staged(_links(groups.join(_only(sets, "shingles", groups).drop("n"), keys), parts), groups)
        whole = connected_components(every.unionByName(more.select("a", "b")))
        dropped(more, links)
    dropped(classes, sets)
    labels = least.join(whole, least["id"] == whole["node"], "left").select(least["class"], F.coalesce("component", "id").alias("component_id"))
    alone = rows.where((F.col("n") == 0) | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"))
    out = known.select("id", "n", "class").join(labels, "class").select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, of its smallest id, with all columns.

    A row without id counts as a document whose id is greater than all others.
    Texts without words link with nothing, so all their rows stay.
    """
    unnamed = F.xxhash64(text_col).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    rows = df.select(F.struct(*df.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), unnamed).alias("key"), F.col(text_col).alias("text"))
    worded = lambda text: F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = near_duplicates(rows, "key", "text")
    first = found.where(F.col("component_id") == F.col("key")).select("key").distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text")))
    kept = rows.where(worded("text")).join(first, "key", "left_semi").withColumn("place", place).where("place = 1")
    return kept.select("row.*").unionByName(df.where(~worded(text_col)))
