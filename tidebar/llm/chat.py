"""Chat formatting: records of many layouts become canonical turns, and turns become marked text.

A layout is known by its fingerprint, a hash of its nested field paths. Each
fingerprint selects a declarative mapping that says where the turns and roles
are. A template marks every turn; control strings inside texts are escaped, so
that the turns can be read back exactly from the formatted text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The template's marks, and other control strings that must not appear unescaped in a text.
OPEN, SAY, CLOSE = "<|turn|>", "<|say|>", "</s>"
CONTROLS = [OPEN, SAY, CLOSE, "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
_CONTROL = "|".join(map(re.escape, CONTROLS))
_TO_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_ESCAPED = re.compile(rf"\\(\\|{_CONTROL})")
_UNIT = re.compile(rf"\\(?:\\|{_CONTROL})|({_CONTROL})")


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns: ``turns`` names a list of structs with ``role`` and ``text``; or ``fields`` gives (role, path, ...) in order, the paths of one turn joined."""

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, ...], ...] = ()

    def paths(self) -> frozenset[str]:
        if self.fields:
            return frozenset(p for _, *paths in self.fields for p in paths)
        stem = f"{self.turns}[]." if self.turns else ""
        return frozenset({stem + self.role, stem + self.text})


# The known layouts, and other names of roles.
MAPPINGS = [
    Mapping("turn rows", None, "role", "text"),
    Mapping("messages", "messages", "role", "content"),
    Mapping("messages with text", "messages", "role", "text"),
    Mapping("from and value", "conversations", "from", "value"),
    Mapping("prompt and response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system, prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("instruction and output", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction, input and output", fields=(("user", "instruction", "input"), ("assistant", "output"))),
]
MAX_LAYOUTS = 100_000
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths) -> str:
    """A hash of the set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths()): m for m in MAPPINGS}


def mapping_of(paths: list[str]) -> Mapping | None:
    """The mapping of a layout: the one of its fingerprint, or else the one with the most of its paths (the first listed of several) whose paths it has all; others are ignored."""
    name = fingerprint(paths)
    if name not in BY_FINGERPRINT:
        here = set(paths)
        fits = [m for m in MAPPINGS if m.paths() <= here]
        if len(BY_FINGERPRINT) > MAX_LAYOUTS:
            return max(fits, key=lambda m: len(m.paths()), default=None)
        BY_FINGERPRINT[name] = max(fits, key=lambda m: len(m.paths()), default=None)
    return BY_FINGERPRINT[name]


def schema_paths(kind: T.DataType, stem: str = "") -> list[str]:
    """Paths of all leaves of a Spark type; lists are marked by []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{stem}.{f.name}" if stem else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{stem}[]")
    return [stem]


def value_paths(value, stem: str = "") -> list[str]:
    """Paths of all leaves of a parsed JSON value."""
    if isinstance(value, dict):
        return [p for k, v in value.items() for p in value_paths(v, f"{stem}.{k}" if stem else k)]
    if isinstance(value, list):
        return [p for v in value for p in value_paths(v, f"{stem}[]")]
    return [stem]


def turns_of(record: dict) -> list[tuple[str, str]] | None:
    """The canonical turns of a parsed record, or None when no mapping has its fingerprint."""
    mapping = mapping_of(value_paths(record))
    if mapping is None:
        return None
    as_text = lambda v: v if isinstance(v, str) else "" if v is None else json.dumps(v, ensure_ascii=False)
    if mapping.fields:
        return [(role, "\n\n".join(t for p in paths if (t := as_text(record.get(p))))) for role, *paths in mapping.fields]
    rows = record[mapping.turns] if mapping.turns else [record]
    if not all(isinstance(row, dict) for row in rows):
        return None
    names = ROLE_NAMES if mapping.role == "from" else {}
    return [(names.get(r := as_text(row.get(mapping.role)), r), as_text(row.get(mapping.text))) for row in rows]


def turns_from_json(df: DataFrame, id_col: str, json_col: str, turn_col: str | None = None) -> DataFrame:
    """(id, turn, role, text) of JSON records of any known layouts, each by its own fingerprint.

    Turns are numbered within the record, from ``turn_col`` on if there is one.
    Records that don't parse or whose layout is unknown give one row with turn -1
    and the record as its text, so that nothing is lost; a null record's text is
    empty. Repeated records and null ids are kept; other columns are ignored.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, begin, raw in zip(batch["id"], batch["begin"], batch["json"], strict=True):
                try:
                    record = json.loads(raw)
                    turns = turns_of(record) if isinstance(record, dict) else None
                except (TypeError, ValueError, RecursionError):
                    turns = None
                rows += [(name, -1, "", raw or "")] if turns is None else [(name, begin + k, r, t) for k, (r, t) in enumerate(turns)]
            yield pd.DataFrame(rows, columns=[id_col, "turn", "role", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    begin = F.coalesce(F.col(turn_col).cast("long"), F.lit(0)) if turn_col else F.lit(0)
    return df.select(F.col(id_col).alias("id"), begin.cast("long").alias("begin"), F.col(json_col).alias("json")).mapInPandas(explode, f"`{id_col}` {kind}, turn bigint, role string, text string")


def canonical_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, turn, role, text) of a table, whose layout is known by its schema's fingerprint.

    Columns beside those of the mapping are ignored, whatever their names. A table
    of turn rows keeps its turn column and its roles; otherwise a row is a
    conversation and its turns are numbered. Null roles and texts become empty;
    repeated rows are kept; an empty table gives no rows.
    """
    mapping = mapping_of([p for p in schema_paths(df.schema) if p not in (id_col, turn_col)])
    if mapping is None:
        raise ValueError(f"no mapping has the layout {sorted(schema_paths(df.schema))}")
    if mapping.fields:
        each = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when(F.col(p) != "", F.col(p)) for p in paths)).alias("text")) for role, *paths in mapping.fields]
        rows = df.select(F.col(id_col), F.posexplode(F.array(*each)).alias("turn", "t"))
        role, text = F.col("t.role"), F.col("t.text")
    elif mapping.turns:
        rows = df.select(F.col(id_col), F.posexplode(mapping.turns).alias("turn", "t"))
        role, text = F.col(f"t.{mapping.role}"), F.col(f"t.{mapping.text}")
        if mapping.role == "from":
            names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
            role = F.coalesce(F.try_element_at(names, role), role)
    else:
        rows, role, text = df.withColumn("turn", F.col(turn_col)), F.col(mapping.role), F.col(mapping.text)
    return rows.select(F.col(id_col), F.col("turn").cast("long"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def escape(text: str) -> str:
    """The text with a backslash before every backslash and control string."""
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{SAY}{escape(text)}{CLOSE}"


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, where the escaped text begins, where it ends) of every turn of a formatted text."""
    marks = [(m[1], m.start(), m.end()) for m in _UNIT.finditer(formatted) if m[1]]
    for (a, _, role_at), (b, role_end, text_at), (c, text_end, _) in zip(marks[::3], marks[1::3], marks[2::3], strict=True):
        if (a, b, c) != (OPEN, SAY, CLOSE):
            raise ValueError("not a formatted conversation")
        yield unescape(formatted[role_at:role_end]), unescape(formatted[text_at:text_end]), text_at, text_end


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, formatted, loss_start, loss_end): each turn's marked text and, in code points within it, the part under the loss mask.

    Only assistants' texts are under the mask; other turns have it empty. A
    conversation's text is its turns' texts in order of turn, without separators.
    Empty texts are turns too, repeated rows are turns of their own, and an empty
    table gives no rows; other columns are ignored.
    """

    @F.pandas_udf("formatted string, loss_start bigint, loss_end bigint")
    def formatted(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for role, text in zip(roles, texts, strict=True):
            begin = len(OPEN) + len(escape(role)) + len(SAY)
            whole = format_turn(role, text)
            rows.append((whole, begin, len(whole) - len(CLOSE) if role == "assistant" else begin))
        return pd.DataFrame(rows, columns=["formatted", "loss_start", "loss_end"])

    return turns.select(F.col(id_col), "turn", formatted("role", "text").alias("f")).select(id_col, "turn", "f.*")


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the formatted turns: counts, and hashes of all turns and of the text under the loss mask.

    The turns of a conversation stream through one task in order, as a hash must;
    only the running hashes are held, so a conversation of any length fits. Turns
    of one number follow in the order of their formatted text. A null id is a
    conversation of its own.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, state = None, None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                n, turns, chars, loss, length = state
                done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        for batch in batches:
            for name, text, begin, end in zip(batch[id_col].tolist(), batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True):
                name = None if pd.isna(name) else name
                if state is None or name != current:
                    close()
                    current, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                under = unescape(text[begin:end])
                state[2] += len(under)
                state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield pd.DataFrame(done, columns=columns)
            done.clear()
        close()
        yield pd.DataFrame(done, columns=columns)

    kind = formatted.schema[id_col].dataType.simpleString()
    ordered = formatted.repartition(id_col).sortWithinPartitions(id_col, "turn", "formatted")
    return ordered.mapInPandas(digest, f"`{id_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
