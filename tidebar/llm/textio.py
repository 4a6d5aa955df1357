"""Vectorised word hashing for batches of texts, shared by the text operators.

Texts are joined into slices of about a megabyte and hashed with NumPy: every
byte goes through a random 64-bit table and a polynomial prefix sum, so the hash
of a run is a difference of two prefix sums. Runs are found from a byte-class
table, which works on UTF-8 because every class border is an ASCII byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_U = np.uint64
_RNG = np.random.default_rng(7_041_776)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_GRAM = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def _classes(word: Iterable[int], mark: Iterable[int] = ()) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(word)] = 1
    out[list(mark)] = 2
    return out


_SPACE = {0x20, *range(0x09, 0x0E)}
_ALNUM = {b for b in range(256) if b >= 128 or chr(b).isalnum()}
#: White-space separated words: ``[^\x20\x09-\x0D]+``.
WORDS = _classes(set(range(256)) - _SPACE)
#: Runs of letters and digits only; ASCII punctuation separates.
PLAIN = _classes(_ALNUM)
#: Runs of letters and digits, and runs of punctuation, as separate tokens.
MARKED = _classes(_ALNUM, set(range(33, 127)) - _ALNUM)


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        got = np.full(size, _U(base), np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The hashed words of some texts: ``hash``, ``kind`` and byte places by word; text k has words first[k]:first[k+1]."""

    def __init__(self, texts: list[bytes], classes: np.ndarray = WORDS):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        kind = classes[low]
        step = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        begins = step[kind[step] != 0]
        ends = step[(kind[step - 1] != 0) & (step > 0)]
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[low] * _power(_BASE, len(data)), out=total[1:])
        self._total, self._unpower = total, _power(_UNBASE, len(data))
        self.hash = self._between(begins, ends)
        self.kind, self.begin, self.end = kind[begins], begins, ends
        self.at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(begins, self.at)
        self.count = np.diff(self.first)

    def _between(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._total[ends] - self._total[begins]) * self._unpower[begins])

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of the words that are longer, and the places of those words."""
        at = np.flatnonzero(self.end - self.begin > n)
        return self._between(self.begin[at], self.begin[at] + n) + _GRAM[n % 64], at

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of n words, and first window by text; windows don't cross texts."""
        if n == 1:
            return self.hash, self.first
        total = len(self.hash) - n + 1
        if total <= 0:
            return np.empty(0, np.uint64), np.zeros(len(self.first), np.int64)
        h = sum(self.hash[k : k + total] * _GRAM[k] for k in range(n))
        owner = self.text_of()
        h = mix(h)[owner[:total] == owner[n - 1 :]]
        return h, np.concatenate([[0], np.cumsum(np.maximum(self.count - n + 1, 0))])


def sliced(texts: Iterable[str | None], limit: int = SLICE_BYTES, fold: bool = False) -> Iterator[tuple[int, list[bytes]]]:
    """The texts (``fold``: without case) as UTF-8, null as empty, in slices of about ``limit`` bytes with the number of the first."""
    part: list[bytes] = []
    start = size = k = 0
    for k, text in enumerate(texts):
        raw = (text.casefold() if fold else text).encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if part and size + len(raw) > limit:
            yield start, part
            part, start, size = [], k, 0
        part.append(raw)
        size += len(raw)
    if part:
        yield start, part


def held_bytes(batch: pa.RecordBatch, column: int, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of one column, at least a row each, so that what is made of a part stays small."""
    size = batch.column(column).nbytes / max(batch.num_rows, 1)
    step = max(1, int(limit / max(size, 1)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
