"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A byte-pair tokenizer with word ends is turned into a deterministic transducer
over bytes. After a prefix of a pre-token, all that matters for later counts is
the longest suffix that still begins a vocabulary entry, the last token of the
tokenization at each place in that suffix, and the token counts there relative
to the whole prefix; that tuple is the state. A transition is annotated with
the change in the number of emitted tokens. States are compiled when a text
first reaches them and kept for the life of the worker.

Texts are counted in chunks that run side by side: a byte of white space puts
the transducer in its start state, so a chunk's state map is constant after the
first such byte. The scan composes those maps: the exit state of one chunk is
the entry state of the head of the next, and prefix sums over the annotations
give every text its count.

Bytes outside the transducer's alphabet (anything but printable ASCII and the
Latin-1 letters), special-token openings and runs longer than ``LONG_RUN`` go,
as whole white-space separated runs, through the library, which gives the same
counts as no token crosses white space.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .textio import sliced

LONG_RUN = 2048
LANE = 128
MAX_STATES = 1 << 19
MAX_CACHED_RUNS = 200_000
LIMIT = 2048

# Byte classes: 0 white space, 1 hard, 2 apostrophe, then digits, letters, marks.
_SPACE, _HARD, _APOS = 0, 1, 2
_DIGITS = b"0123456789"
_LETTERS = bytes(range(97, 123)) + b"\xc3" + bytes(range(0x9F, 0xC0))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)
_ALPHABET = b" \x01'" + _DIGITS + _LETTERS + _MARKS
_CLASS = np.full(256, _HARD, np.uint8)
for _i, _b in enumerate(_ALPHABET):
    _CLASS[_b] = _i
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_WIDTH = len(_ALPHABET)
#: Contractions that are pre-tokens of their own; a fixed value of the public pattern.
_ENDINGS = {b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"}


def byte_symbols() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """Counts tokens of byte strings as the tokenizer file at ``path`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model, to_byte = spec["model"], {s: b for b, s in byte_symbols().items()}
        self.end = model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.inner: dict[bytes, str] = {}
        self.final: dict[bytes, str] = {}
        for token in model["vocab"]:
            ends = token.endswith(self.end)
            raw = token[: -len(self.end)] if ends else token
            if raw and all(c in to_byte for c in raw):
                (self.final if ends else self.inner)[bytes(to_byte[c] for c in raw)] = token
        self.begins = {raw[:k] for raws in (self.inner, self.final) for raw in raws for k in range(1, len(raw) + 1)}
        self.symbol = byte_symbols()
        self.fits: dict[tuple[str, str], bool] = {}
        self.runs: dict[bytes, int] = {}
        self.reset()

    # -- the pair rule -------------------------------------------------------

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(((self.rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))))
            if best[0] == 1 << 30:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def _follows(self, left: str | None, right: str) -> bool:
        """Whether ``right`` may stand after ``left`` (None: at the beginning) in a tokenization."""
        got = self.fits.get((left, right))
        if got is None:
            want = [right] if left is None else [left, right]
            got = self.fits[left, right] = self._merge([s for t in want for s in self._symbols(t)]) == want
        return got

    # -- states --------------------------------------------------------------

    def reset(self) -> None:
        """Forget the compiled states."""
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, _WIDTH), -1, np.int32)
        self.emit = np.zeros((1024, _WIDTH), np.int16)
        self._state(("start",))

    def _state(self, key: tuple) -> int:
        got = self.ids.get(key)
        if got is None:
            got = self.ids[key] = len(self.states)
            self.states.append(key)
            if got == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return got

    def _extend(self, key: tuple, byte: int) -> tuple[tuple, int]:
        """The state after one more byte of a pre-token, and the change in the count."""
        kind, tail, chain = key
        word = tail + bytes([byte])
        for k in range(len(word)):  # longest candidate first
            part = word[k:]
            if part in self.inner:
                left, count = chain[k]
                if self._follows(left, self.inner[part]):
                    token, total = self.inner[part], count + 1
                    break
        keep = next((k for k in range(len(word)) if word[k:] in self.begins), len(word))
        rest = (*chain[keep:], (token, total))
        return (kind, word[keep:], tuple((t, c - total) for t, c in rest)), total

    def _closing(self, key: tuple) -> int:
        """The change in the count when the pre-token ends here."""
        _, tail, chain = key
        for k in range(len(tail)):
            part = tail[k:]
            if part in self.final and self._follows(chain[k][0], self.final[part]):
                return chain[k][1] + 1
        raise ValueError("a vocabulary without single bytes")

    def _run(self, kind: str, raw: bytes) -> tuple[tuple, int]:
        key, total = (kind, b"", ((None, 0),)), 0
        for b in raw:
            key, more = self._extend(key, b)
            total += more
        return key, total

    def _whole(self, raw: bytes) -> int:
        key, total = self._run("marks", raw)
        return total + self._closing(key)

    def _step(self, key: tuple, c: int) -> tuple[tuple, int]:
        byte = _ALPHABET[c]
        letter, digit = byte in _LETTERS, byte in _DIGITS
        kind = key[0]
        if kind == "ending":  # an apostrophe at the start of a pre-token, and letters that may make a contraction
            seen = key[1] + bytes([byte])
            if seen in _ENDINGS:
                return ("start",), self._whole(b"'" + seen)
            if any(e.startswith(seen) for e in _ENDINGS):
                return ("ending", seen), 0
            if not key[1] and not letter and not digit and c != _SPACE:
                return self._run("marks", bytes([39, byte]))
            base, total = (("start",), self._whole(b"'")) if not key[1] else (None, self._whole(b"'"))
            if base is None:
                base, more = self._run("letters", key[1])
                total += more
            after, more = self._step(base, c)
            return after, total + more
        if kind == "letters" and letter or kind == "marks" and not (letter or digit or c == _SPACE):
            return self._extend(key, byte)
        done = 0 if kind == "start" else self._closing(key)
        if c == _SPACE:
            return ("start",), done
        if digit:
            return ("start",), done + self._whole(bytes([byte]))
        if c == _APOS:
            return ("ending", b""), done
        after, more = self._run("letters" if letter else "marks", bytes([byte]))
        return after, done + more

    def _compile(self, pairs: np.ndarray) -> None:
        for code in pairs.tolist():
            state, c = divmod(code, _WIDTH)
            after, change = self._step(self.states[state], c)
            to = self._state(after)
            self.next[state, c], self.emit[state, c] = to, change

    def _advance(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state.astype(np.int64) * _WIDTH + c
        to = self.next.ravel()[at]
        if (missing := to < 0).any():
            self._compile(np.unique(at[missing]))
            to = self.next.ravel()[at]
        return to, self.emit.ravel()[at]

    # -- counting ------------------------------------------------------------

    def _library(self, runs: list[bytes]) -> list[int]:
        new = list({r for r in runs if r not in self.runs})
        found = dict(zip(new, (len(e) for e in self.library.encode_batch_fast([r.decode("utf-8", "replace") for r in new], add_special_tokens=False)), strict=True)) if new else {}
        out = [found[r] if r in found else self.runs[r] for r in runs]
        if len(self.runs) + len(found) > MAX_CACHED_RUNS:
            self.runs.clear()
        self.runs.update((r, n) for r, n in found.items() if len(r) <= 256)
        return out

    def count(self, texts: list[bytes]) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.states) > MAX_STATES:
            self.reset()
        joined = b" ".join(texts) + b" "
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        data = np.frombuffer(joined, np.uint8).copy()
        after_c3 = np.zeros(len(data), bool)
        after_c3[1:] = data[:-1] == 0xC3
        upper = (data >= 65) & (data <= 90) | after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        data[upper] += 32
        c = _CLASS[data]
        high = data >= 0x80
        c[high & (data != 0xC3) & ~after_c3 | after_c3 & ((data == 0x97) | (data == 0xB7))] = _HARD
        c[:-1][(data[:-1] == 60) & (data[1:] == 124)] = _HARD  # "<|" may open a special token
        space = c == _SPACE
        # Whole runs with a hard byte, or very long ones, are left to the library.
        bounds = np.flatnonzero(np.diff(space, prepend=True, append=True))
        begin, end = bounds[::2], bounds[1::2]
        extra = np.zeros(len(texts), np.int64)
        if len(begin):
            hard_before = np.concatenate([[0], np.cumsum(c == _HARD)])
            odd = (hard_before[end] > hard_before[begin]) | (end - begin > LONG_RUN)
            if odd.any():
                b, e = begin[odd], end[odd]
                counts = self._library([joined[i:j] for i, j in zip(b.tolist(), e.tolist(), strict=True)])
                np.add.at(extra, np.searchsorted(at, b, side="right") - 1, counts)
                for i, j in zip(b.tolist(), e.tolist(), strict=True):
                    c[i:j] = _SPACE
        # Lanes side by side, from the first white space of each on; then the heads, from the exit of the lane before.
        lanes = -(-len(c) // LANE)
        grid = np.zeros((lanes, LANE), np.uint8)
        grid.ravel()[: len(c)] = c
        emitted = np.zeros((lanes, LANE), np.int16)
        state = np.zeros(lanes, np.int32)
        is_space = grid == _SPACE
        head = np.where(is_space.any(axis=1), is_space.argmax(axis=1), LANE)
        columns = np.ascontiguousarray(grid.T)
        for k in range(LANE):
            live = np.flatnonzero(head <= k)
            if len(live):
                state[live], emitted[live, k] = self._advance(state[live], columns[k][live])
        # Exits of lanes without white space depend on the lane before; each round composes one more map.
        exits, known = state, head < LANE
        known[0] = True
        entry_known = np.zeros(lanes, bool)
        entry_known[0] = True
        entry_known[1:] = known[:-1]
        waiting = np.arange(lanes)
        while len(waiting):
            ready = waiting[entry_known[waiting]]
            waiting = waiting[~entry_known[waiting]]
            now = np.where(ready > 0, exits[ready - 1], 0).astype(np.int32)
            for k in range(LANE):
                live = np.flatnonzero(head[ready] >= k)  # the white space itself closes the head's last pre-token
                if not len(live):
                    break
                now[live], emitted[ready[live], k] = self._advance(now[live], columns[k][ready[live]])
            whole = ready[head[ready] == LANE]
            exits[whole] = now[head[ready] == LANE]
            known[whole] = True
            entry_known[1:] |= known[:-1]
        total = np.concatenate([[0], np.cumsum(emitted.ravel()[: len(c)], dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]] + extra


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer for a vocabulary file, compiled states and all."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, from its whole text.

    Null and empty texts count 0 bytes and 0 tokens. Repeated rows and null ids
    are kept as they are; other columns are ignored; an empty table gives none.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = transducer(vocabulary)
        for batch in batches:
            n = np.zeros(len(batch), np.int64)
            size = np.zeros(len(batch), np.int64)
            for start, texts in sliced(batch["text"]):
                n[start : start + len(texts)] = machine.count(texts)
                size[start : start + len(texts)] = [len(t) for t in texts]
            yield pd.DataFrame({id_col: batch["id"], "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInPandas(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
