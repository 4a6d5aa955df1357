"""Order-preserving packing of token streams by dynamic programming.

Each task joins its documents' tokens into blocks of about a million and cuts a
block into sequences. Cuts may lie at document ends, sentence ends and, where
neither is near, at evenly spaced places. With P the tokens before a cut, the
least cost is

    f(j) = cut(j) + min over i with P(j) - P(i) <= limit of f(i) + padding(P(j) - P(i))

and as padding is linear in the length, the minimum slides over f(i) + P(i): a
monotone queue gives it in constant time. Lengths that are powers of two need no
padding and are looked up apart.

Documents keep the order of their rows; nothing is shuffled, and memory holds
one block (or one document, if that is longer).
"""

from __future__ import annotations

import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textio import sliced
from .tokencount import byte_symbols

LIMIT = 4096
BLOCK_TOKENS = 1 << 20
TEXT_BYTES = 8 << 20
SENTENCE_COST, FORCED_COST, SPACING = 4.0, 48.0, 256
END_ID = 2
MAX_CACHED_RUNS = 1_000_000


# Punctuation makes pre-tokens of its own wherever it stands, but for an apostrophe, which may begin a contraction.
_MARKS = "[!-&(-/:-@\\[-`{-~]*"
_SIMPLE = f"^(?P<before>{_MARKS})(?P<word>[A-Za-zªµºÀ-ÖØ-öø-ÿ]*)(?P<after>{_MARKS})$"
LONG_RUN = 256


class _Known(dict):
    """Values by key, made when first asked for; emptied when there are ``most``."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class RunEncoder:
    """Token ids of texts, from a bounded cache by white-space separated run; no token crosses white space.

    Arrow splits a slice of texts and numbers its different runs, each of which is
    looked up once; NumPy lays out their ids by number. A new run of Latin-1 letters
    with punctuation around it is at most three pre-tokens, each known or given to
    the library's model; any other run goes through the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.cache: dict[str, bytes] = {}
        self.pieces = _Known(self._piece, MAX_CACHED_RUNS // 2)
        words = self.library.get_vocab()
        self.ends_sentence = np.zeros(max(words.values()) + 1, bool)
        self.ends_sentence[[i for w, i in words.items() if w.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        self.symbols = str.maketrans({b: s for b, s in byte_symbols().items()})

    def _piece(self, piece: str) -> bytes:
        symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)  # printable ASCII stands for itself
        ids = [t.id for t in self.model.tokenize(symbols)] if piece else []
        return struct.pack(f"<{len(ids)}I", *ids)

    def _made(self, runs: list[str]) -> Iterator[bytes]:
        parts = pc.extract_regex(pa.array(runs, pa.large_string()), _SIMPLE)
        before, word, after = (parts.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(3))
        lower, get = [w.lower() if w else w for w in word], self.pieces.__getitem__
        for run, known, a, w, b in zip(runs, parts.is_valid().to_numpy(zero_copy_only=False).tolist(), before, lower, after, strict=True):
            if not known or len(run) > LONG_RUN or "<|" in run:
                yield np.array(self.library.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
            elif a or b:
                yield get(a) + get(w) + get(b)
            else:
                yield get(w)

    def _ids(self, runs: list[str]) -> list[bytes]:
        if len(self.cache) > MAX_CACHED_RUNS:
            self.cache.clear()
        found = [*map(self.cache.get, runs)]
        new = [k for k, ids in enumerate(found) if ids is None]
        for k, ids in zip(new, self._made([runs[k] for k in new]), strict=True):
            found[k] = self.cache[runs[k]] = ids
        return found

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, each with the end id, and the number of ids of each text."""
        offsets = np.cumsum([0, *map(len, texts)])
        whole = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(b"".join(texts)))
        split = pc.ascii_split_whitespace(whole)
        found = split.flatten().dictionary_encode()
        runs = [*self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist()), struct.pack("<I", END_ID)]
        pool = np.frombuffer(b"".join(runs), "<u4")
        many = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        bounds = split.offsets.to_numpy()[1:]
        at = np.insert(found.indices.to_numpy(), bounds, len(runs) - 1)
        count = many[at]
        ends = np.cumsum(count)
        place = np.repeat(((np.cumsum(many) - many)[at] - (ends - count)).astype(np.int32), count)
        place += np.arange(len(place), dtype=np.int32)
        return pool[place], np.diff(ends[bounds + np.arange(len(texts))], prepend=0)


def best_cuts(at: np.ndarray, cost: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The cheapest way to cut at some of the places ``at`` (ascending, first 0, gaps at most ``limit``): the chosen indices, ends included."""
    n = len(at)
    pairs = []
    k = 1
    while k < limit:
        want = at - k
        i = np.searchsorted(at, want)
        j = np.flatnonzero((want >= 0) & (at[np.minimum(i, n - 1)] == want))
        pairs.append(np.stack([j, i[j]], axis=1))
        k *= 2
    exact = np.concatenate(pairs)
    exact = exact[np.argsort(exact[:, 0], kind="stable")]
    ej, ei = [*exact[:, 0].tolist(), n], exact[:, 1].tolist()
    place, price = at.tolist(), cost.tolist()
    f, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f(i) + P(i), P(i), i: values ascend
    x = 0
    for j in range(1, n):
        p = place[j]
        while queue[0][1] < p - limit:
            queue.popleft()
        low, _, i = queue[0]
        best = low + limit - p
        while ej[x] == j:
            if f[ei[x]] < best:
                best, i = f[ei[x]], ei[x]
            x += 1
        f[j] = best = best + price[j]
        back[j] = i
        best += p
        while queue and queue[-1][0] >= best:
            queue.pop()
        queue.append((best, p, j))
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return np.array(chosen[::-1])


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Places where a block may be cut, and the cost of each."""
    total = len(ids)
    price = np.full(total + 1, np.inf, np.float32)  # by place: infinite where no cut may lie
    price[np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1] = SENTENCE_COST
    price[doc_ends] = 0.0
    price[[0, total]] = np.minimum(price[[0, total]], FORCED_COST)
    at = np.flatnonzero(price < np.inf)
    spacing = min(SPACING, limit)
    for g in np.flatnonzero(np.diff(at) > spacing).tolist():
        price[at[g] + spacing : at[g + 1] : spacing] = FORCED_COST
    rest = total
    for k in range(limit.bit_length() - 1, -1, -1):  # the end of a block may fall into powers of two
        if total >> k & 1 and 1 << k < limit:
            rest -= 1 << k
            if rest > 0:
                price[rest] = min(price[rest], FORCED_COST)
    at = np.flatnonzero(price < np.inf)
    return at, price[at]


def _pack(names: list, parts: list[np.ndarray], sizes: list[int], encoder: RunEncoder, limit: int, first: int, with_ids: bool) -> tuple[pd.DataFrame, int]:
    ids = np.concatenate(parts)
    size = np.array(sizes, np.int64)
    ends = np.cumsum(size)
    at, cost = candidates(ids, ends, encoder.ends_sentence, limit)
    cuts = at[best_cuts(at, cost, limit)]
    edges = np.union1d(cuts, np.concatenate([[0], ends]))
    begin, end = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, begin, side="right")
    seq = np.searchsorted(cuts, begin, side="right") - 1
    view = memoryview(ids.tobytes())
    out = {
        "doc": [names[d] for d in doc.tolist()],
        "start": begin - (ends - size)[doc],
        "length": end - begin,
        "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)],
        "doc_tokens": size[doc],
        "sequence_id": first + seq,
        "offset": begin - cuts[seq],
        "sequence_length": (cuts[1:] - cuts[:-1])[seq],
    }
    if with_ids:
        out["ids"] = [ids[a:b].astype(np.int32) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return pd.DataFrame(out), first + len(cuts) - 1


_encoders: dict[str, RunEncoder] = {}


def pack_documents(df: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document: where it lies in the document and in its sequence.

    Every row of the input is a document, repeated and null ids included; a null
    or empty text is one token, the end id. Texts are never truncated: a document
    longer than ``limit`` spans sequences. ``with_ids`` adds the piece's token
    ids. An empty table gives no rows; other columns are ignored.
    """
    if limit & (limit - 1) or limit < 2:
        raise ValueError("the limit must be a power of two")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = RunEncoder(vocabulary)
        encoder = _encoders[vocabulary]
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        names, parts, sizes, held = [], [], [], 0
        for batch in batches:
            for start, texts in sliced(batch["text"], TEXT_BYTES):
                ids, count = encoder.encode(texts)
                given = batch["id"].iloc[start : start + len(texts)].tolist()
                done = 0
                # blocks end with the document that fills them
                while done < len(texts):
                    until = np.cumsum(count[done:])
                    n = min(int(np.searchsorted(until, BLOCK_TOKENS - held)) + 1, len(until))
                    names += [None if pd.isna(x) else x for x in given[done : done + n]]
                    sizes += count[done : done + n].tolist()
                    part, ids = np.split(ids, [until[n - 1]])
                    parts.append(part)
                    held, done = held + len(part), done + n
                    if held >= BLOCK_TOKENS:
                        out, sequence = _pack(names, parts, sizes, encoder, limit, sequence, with_ids)
                        yield out.rename(columns={"doc": id_col})
                        names, parts, sizes, held = [], [], [], 0
        if names:
            out, sequence = _pack(names, parts, sizes, encoder, limit, sequence, with_ids)
            yield out.rename(columns={"doc": id_col})

    kind = df.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"
    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInPandas(pack, shape + ", ids array<int>" * with_ids)
