"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a few consecutive tokens that ignores some of them.
Masked windows of the benchmark items are hashed into an index; masked windows of
the documents look it up, so that a passage is hit even when some of its tokens
were substituted. The seeds for a window are lossless: every pattern of the
mismatches that it may have leaves one of them whole. Around every hit, document
and item are compared token by token along the hit's diagonal, and a window with
enough equal tokens confirms it. Scripts without spaces have a token by character.

The index goes to the tasks as a broadcast of at most ``MAX_INDEX`` entries. A
larger benchmark is cut into parts of that size; each is matched against all
documents in a pass of its own, whose hits are staged before its broadcast is
destroyed, so that driver and tasks never hold more than one part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import staged
from .textio import _GRAM, PLAIN, Words, mix, sliced

# For windows of so many tokens with so many mismatches, seeds of which one agrees whatever the places of
# the mismatches; 1 is a token that must agree. The heaviest come first.
LOSSLESS = {
    (16, 4): ["111011", "1100001011", "111000010001"],
    (12, 3): ["110111", "110001011", "11101001", "1110010001"],
    (8, 2): ["11011", "1111", "1100011"],
    (4, 1): ["111", "1101", "1011"],
}
WINDOW, SHARE = 16, 0.75
#: Items of fewer tokens are not looked for. By default all are: one of less than four tokens is found where all of them agree.
MIN_TOKENS = 1
MAX_INDEX = 1 << 21
_FILTER_BITS = 22
_CHECK_HITS = 1 << 14
_U = np.uint64
# Punctuation of scripts without spaces, and their characters (Thai to Lao, Myanmar, Khmer, kana, Han).
_STOPS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f\u3031-\u312f\u3190-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def spaced(text: str | None) -> str | None:
    """The text with the characters of scripts without spaces set apart as tokens."""
    if not isinstance(text, str) or text.isascii():
        return text
    return _UNSPACED.sub(r" \g<0> ", _STOPS.sub(" ", text))


def seeds_for(length: int, equal: int) -> list[str]:
    """Seeds that every window of ``length`` tokens with ``equal`` ones or more hits.

    A longer window whose added tokens mismatch, and the part of a window with the
    fewest mismatches, take over the seeds of another size; else some run between
    the mismatches is long enough.
    """
    for (m, k), seeds in LOSSLESS.items():
        if (length - equal) // (length // m) <= k if length >= m else length - equal + m - length <= k:
            return seeds
    return ["1" * -(-equal // (length - equal + 1))]


def _seeded(h: np.ndarray, seed: str, number: int) -> np.ndarray:
    """Masked-window hashes; windows may cross texts, which the comparison along the diagonal sorts out."""
    span = len(seed)
    total = len(h) - span + 1
    if total <= 0:
        return np.empty(0, np.uint64)
    places = [k for k, c in enumerate(seed) if c == "1"]
    return mix(sum(h[k : k + total] * _GRAM[k] for k in places) + _U(number + 1))


class Index:
    """Seed hashes of benchmark items with the places they come from."""

    def __init__(self, items: list[tuple], window: int = WINDOW, share: float = SHARE, min_tokens: int = MIN_TOKENS):
        self.ids = [i for i, _ in items]
        words = Words([(spaced(t) or "").casefold().encode("utf-8", "surrogatepass") for _, t in items], PLAIN)
        self.hash, self.first, self.count = words.hash, words.first, words.count
        self.need = np.minimum(words.count, window)
        self.equal = np.array([max(1, math.ceil(share * n)) for n in self.need.tolist()], np.int64)
        owner = words.text_of()
        wanted: dict[str, set[int]] = {}
        sizes = {(n, e) for n, e, c in zip(self.need.tolist(), self.equal.tolist(), words.count.tolist(), strict=True) if c >= max(min_tokens, 1) and n >= e}
        for n, e in sizes:
            for seed in seeds_for(n, e):
                wanted.setdefault(seed, set()).add(n)
        self.seeds = sorted(wanted)
        keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for number, seed in enumerate(self.seeds):
            h = _seeded(words.hash, seed, number)
            inside = owner[: len(h)] == owner[len(seed) - 1 :] if len(h) else np.zeros(0, bool)
            inside &= np.isin(self.need[owner[: len(h)]], list(wanted[seed])) & (words.count[owner[: len(h)]] >= min_tokens)
            keys.append(h[inside])
            places.append(np.flatnonzero(inside))
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.owner = key[order], place[order], owner
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.key >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def _close(self, words: Words, text: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which hits lie in a window with enough equal tokens, those outside of text or item being unequal."""
        good = np.zeros(len(at), bool)
        for begin in range(0, len(at), _CHECK_HITS):
            some = slice(begin, begin + _CHECK_HITS)
            t, a, i, p = text[some], at[some], item[some], place[some]
            need = self.need[i]
            reach = int(need.max())
            low = -np.minimum(a - words.first[t], p - self.first[i])
            high = np.minimum(words.first[t + 1] - a, self.first[i + 1] - p)
            sums = np.zeros((2 * reach, len(a)), np.int32)
            for row, k in enumerate(range(-reach + 1, reach), 1):
                inside = (k >= low) & (k < high)
                same = words.hash[np.where(inside, a + k, 0)] == self.hash[np.where(inside, p + k, 0)]
                sums[row] = sums[row - 1] + (same & inside)
            for n in np.unique(need).tolist():
                of = np.flatnonzero(need == n)
                lo, hi = reach - n, reach + n - 1
                most = (sums[lo + n : hi + 1, of] - sums[lo : hi + 1 - n, of]).max(axis=0)
                good[begin + of] = most >= self.equal[i[of]]
        return good

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, first matched token, equal tokens): the best window of every text and item that pass."""
        words = Words(texts, PLAIN)
        diagonals = []
        for number, seed in enumerate(self.seeds):
            h = _seeded(words.hash, seed, number)
            maybe = np.flatnonzero(self.filter[(h >> _U(64 - _FILTER_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            a, b = np.searchsorted(self.key, h[maybe]), np.searchsorted(self.key, h[maybe], side="right")
            n = b - a
            at = np.repeat(maybe, n)
            place = self.place[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            item = self.owner[place]
            text = np.searchsorted(words.first, at, side="right") - 1
            near = self._close(words, text, at, item, place)
            diagonals.append(np.stack([text[near], item[near], (at - (place - self.first[item]))[near]], axis=1))
        if not diagonals:
            return []
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, shift in np.unique(np.concatenate(diagonals), axis=0).tolist():
            lo, hi = int(words.first[text]), int(words.first[text + 1])
            begin, length = int(self.first[item]), int(self.count[item])
            a, b = max(lo, shift), min(hi, shift + length)
            need = int(self.need[item])
            if b - a < need:
                continue
            same = np.concatenate([[0], np.cumsum(words.hash[a:b] == self.hash[begin + a - shift : begin + b - shift])])
            sums = same[need:] - same[:-need]
            k = int(sums.argmax())
            if sums[k] >= self.equal[item] and (int(sums[k]), lo - a - k) > best.get((text, item), (0, 0)):
                best[text, item] = (int(sums[k]), lo - a - k)
        return [(t, i, -p, s) for (t, i), (s, p) in sorted(best.items())]


def _entries(text: str) -> int:
    return max(map(len, LOSSLESS.values())) * (len(text) + 1)


def _parts(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The items in parts of at most ``limit`` index entries."""
    part, size = [], 0
    for row in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).orderBy(item_col, text_col).toLocalIterator(prefetchPartitions=False):
        need = _entries(row[1])
        if part and size + need > limit:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += need
    if part:
        yield part


def _found(df: DataFrame, part: list[tuple], names: list[str], found_by: tuple[int, float, int], kinds: tuple[str, str]) -> tuple[DataFrame, Broadcast]:
    """(id, items) of every row of (id, text) for one part of the benchmark, and the part's broadcast."""
    held = df.sparkSession.sparkContext.broadcast(Index(part, *found_by))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            index = held.value
            for start, texts in sliced(map(spaced, batch["text"]), fold=True):
                for text, item, token, equal in index.search(texts):
                    found[start + text].append({"item": index.ids[item], "token": token, "equal": equal})
            yield pd.DataFrame({names[0]: batch[names[0]], "items": found})

    return df.mapInPandas(search, f"`{names[0]}` {kinds[0]}, items array<struct<item:{kinds[1]},token:bigint,equal:bigint>>"), held


def find_contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, max_index: int = MAX_INDEX, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(id, items array<struct<item, token, equal>>) for every row: the benchmark items found in its whole text.

    An item is found where some ``window`` consecutive tokens (all of a shorter
    item's) agree with the text in ``share`` of places or more, and none is missed.
    Items of less than ``min_tokens`` tokens, null items and null or empty texts
    match nothing; items that are equal are all found. Repeated rows and null ids
    are kept; other columns are ignored; an empty table gives no rows, and an empty
    benchmark no items.
    """
    kinds = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    parts = _parts(benchmark, item_col, item_text, max_index)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return _found(rows, first, ["id"], (window, share, min_tokens), kinds)[0].withColumnRenamed("id", id_col)
    # rows of equal id and text have equal items, so hits go by both
    keyed = rows.select(F.xxhash64("id", "text").alias("key"), "text")
    hits = []
    for part in chain((first, second), parts):
        hits.append(_hits(keyed, part, (window, share, min_tokens), kinds[1]))
    every = reduce(DataFrame.unionByName, hits).groupBy("key").agg(F.flatten(F.collect_list("items")).alias("items"))
    none = F.array().cast(every.schema["items"].dataType)
    return rows.withColumn("key", F.xxhash64("id", "text")).drop("text").join(every, "key", "left").select(F.col("id").alias(id_col), F.coalesce("items", none).alias("items"))


def _hits(keyed: DataFrame, part: list[tuple], found_by: tuple[int, float, int], kind: str) -> DataFrame:
    """(key, items) of the rows in which an item of the part is found, once a key; staged, with the part's broadcast gone."""
    found, held = _found(keyed, part, ["key"], found_by, ("bigint", kind))
    out = staged(found.where(F.size("items") > 0).dropDuplicates(["key"]))
    held.destroy()
    return out


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: float = SHARE, max_index: int = MAX_INDEX, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The rows in whose text no benchmark item is found, with all their columns.

    Rows with null or empty texts stay, as do repeated rows and null ids; an empty
    benchmark drops nothing. A benchmark of several parts takes a pass for each.
    """
    parts = _parts(benchmark, item_col, item_text, max_index)
    part = next(parts, None)
    while part is not None:
        held, after = df.sparkSession.sparkContext.broadcast(Index(part, window, share, min_tokens)), next(parts, None)
        df = df.where(~_hit(held)(F.col(text_col)))
        if after is not None:
            df = staged(df)
            held.destroy()
        part = after
    return df


def _hit(held: Broadcast):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        for start, some in sliced(map(spaced, texts), fold=True):
            out[[start + t for t, *_ in held.value.search(some)]] = True
        return pd.Series(out)

    return hit
