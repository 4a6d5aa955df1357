"""SentencePiece encoding and decoding, exact for models of merge type with byte fallback.

Such a model merges, again and again, the adjacent pair whose concatenation has
the best score. A token sequence is its encoding of a text exactly if each token
is the encoding of its own text and each two neighbours stay as they are when
their joined text is merged anew. So a text is encoded from left to right: an
Aho-Corasick automaton gives the longest token at each place, a token is taken
if it goes with the one before, otherwise the next shorter one is tried, and
where none is left the token before is given up and its end marked in a bitfield
of places from which the rest can't be encoded. A prefix of a text has only one
encoding, so a marked place stays marked and the work is linear.

Texts are first cut where no token can cross: before white space that follows
something else, between letters and marks that never meet in a token, and around
characters of which no longer token is made. Runs between cuts recur, so each
worker keeps the encodings of those it has seen.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .textio import held_bytes

SPACE = "▁"
#: Runs, and pairs of tokens, that a worker remembers before it forgets the older half.
MAX_CACHED = 300_000
_NEVER = float("-inf")


def _single(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


#: Every byte that is no part of a character becomes one replacement character.
codecs.register_error("tidebar_each_byte", _single)


class _Halves(dict):
    """A cache of at most twice ``MAX_CACHED`` entries: when the newer half is full, the older one is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(self) >= MAX_CACHED:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class PieceCodec:
    """Encodes and decodes as the model file at ``path`` says."""

    def __init__(self, path: str):
        from ahocorasick import Automaton
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        plain = not spec.normalizer_spec.precompiled_charsmap and not spec.normalizer_spec.remove_extra_whitespaces and spec.normalizer_spec.escape_whitespaces
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix or not plain:
            raise ValueError("only models of merge type with byte fallback and without normalisation are supported")
        self.prefix = SPACE if spec.normalizer_spec.add_dummy_prefix else ""
        library = SentencePieceProcessor(model_file=path)
        ids = range(library.get_piece_size())
        kept = [i for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        if any(library.is_unused(i) for i in ids) or any(p.type == p.USER_DEFINED for p in spec.pieces):
            raise ValueError("models with unused or user-defined pieces are not supported")
        self.ids = {library.id_to_piece(i): i for i in kept}
        self.score = {library.id_to_piece(i): library.get_score(i) for i in kept}
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.decoded = [b"" if library.is_control(i) else spec.trainer_spec.unk_surface.encode() if library.is_unknown(i) else library.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        self.controls = {i for i in ids if library.is_control(i)}
        self.opens = {i for piece, i in self.ids.items() if self.prefix and piece.startswith(SPACE)}
        # Tokens: pieces that are the encoding of their own text. Each is followed by its next shorter beginning.
        tokens = [p for p in self.ids if len(p) == 1 or self._merged(p) == [p]]
        self.automaton, known = Automaton(), set(tokens)
        for p in tokens:
            if len(p) > 1:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in tokens}
        self.runs = re.compile(self._runs([p for p in tokens if len(p) > 1]), re.DOTALL)
        self.raw = {p: np.array([i], "<i4").tobytes() for p, i in self.ids.items()}
        self.follows = _Halves(lambda pair: self._merged(pair[0] + pair[1]) == list(pair))
        self.cache = _Halves(self._run_ids)

    def _merged(self, text: str) -> list[str]:
        """The text's characters, merged by best score, the leftmost of equal ones first."""
        parts, score = list(text), self.score
        scores = [score.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > _NEVER:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(scores):
                scores[i] = score.get(parts[i] + parts[i + 1], _NEVER)
        return parts

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text in which white space is already escaped; a character without a piece is a token of its own."""
        longest = list(text)
        for end, token in self.automaton.iter(text):
            longest[end + 1 - len(token)] = token  # of those with one beginning, longer ones come later
        failed = bytearray(len(text) // 8 + 1)
        taken: list[str] = []
        at, token, n = 0, longest[0] if text else None, len(text)
        follows, shorter = self.follows, self.shorter
        while at < n or token is not None:
            last = taken[-1] if taken else None
            while token is not None:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or follows[last, token]):
                    break
                token = shorter.get(token)
            if token is None:
                if last is None:
                    raise ValueError("the pieces can't encode this text")
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(taken.pop())
                token = shorter.get(last)
                continue
            taken.append(token)
            at = end
            token = longest[at] if at < n else None
        return taken

    @staticmethod
    def _runs(longer: list[str]) -> str:
        """A pattern of runs that no token crosses: characters that stand side by side in tokens belong together, the largest such set and all others; white space is the beginning of a run."""
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return ".+"
        head: dict[str, str] = {}

        def find(c: str) -> str:
            while head.setdefault(c, c) != c:
                head[c] = c = head[head[c]]
            return c

        for p in longer:
            for c in (p := p.lstrip(SPACE)):
                head[find(c)] = find(p[0])
        sets: dict[str, list[str]] = {}
        for c in head:
            sets.setdefault(find(c), []).append(c)
        most = max(sets.values(), key=len, default=[])
        classes = [f"[{''.join(map(re.escape, sorted(x)))}]" for x in (most, head.keys() - set(most)) if x]
        return "|".join([f"{SPACE}+(?:{'|'.join(f'{c}+' for c in classes)})?", *(f"{c}+" for c in classes), "."]) if classes else f"{SPACE}+|."

    def _run_ids(self, run: str) -> bytes:
        raw = self.raw
        return b"".join([raw.get(t) or self._bytes(t) for t in self.tokens(run)])

    def _bytes(self, character: str) -> bytes:
        return np.array([self.byte_ids[b] for b in character.encode()], "<i4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, as little-endian 32-bit numbers; null and empty texts have none."""
        if not text:
            return b""
        return b"".join(map(self.cache.__getitem__, self.runs.findall(self.prefix + text.replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: bytes are put together, white space restored and the one that encoding puts first taken away."""
        first = next((i for i in ids if self.decoded[i]), None)
        raw = [b"".join(map(self.decoded.__getitem__, part)) for part in self._between_controls(ids)]
        return "".join(x.decode("utf-8", "tidebar_each_byte") for x in raw)[first in self.opens :]

    def _between_controls(self, ids: list[int]) -> list[list[int]]:
        """Bytes on both sides of a control token are no character."""
        if self.controls.isdisjoint(ids):
            return [ids]
        places = [k for k, i in enumerate(ids) if i in self.controls]
        return [ids[a:b] for a, b in zip([0, *places], [*places, len(ids)], strict=True)]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The worker's codec for a model file, with what it has cached."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_texts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row: the whole text's token ids, as the library gives them without begin and end ids.

    Null and empty texts have an empty list. Repeated rows and null ids are kept
    as they are; other columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(model)
        for batch in batches:
            for part in held_bytes(batch, 1):
                found = [machine.encode(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in found])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids; null is decoded as an empty list, and bytes that make no character become replacement characters. A column named as ``into`` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = codec(model)
        for batch in batches:
            for part in held_bytes(batch, batch.schema.get_field_index(ids_col)):
                lists = part.column(ids_col)
                ends = np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)), dtype=np.int64).tolist()
                ids = lists.flatten().to_numpy()
                texts = pa.array([machine.decode(ids[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, into])

    kept = df.drop(into)
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, StringType())]))


def ids_digest(ids: str = "ids") -> Column:
    """Lowercase SHA-256 of the decimal ids, joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
