"""Personal data: patterns propose spans, checksums confirm them, context words move their scores.

The four base kinds are found by fixed patterns, leftmost and non-overlapping per
kind. Two are added: account numbers (IBAN), which have their country's length and
pass mod 97, and social security numbers, of which the pattern alone says too
little, so that only those with a context word nearby are spans. Every span has a
score: the kind's own prior, raised by a passed checksum and by words nearby that
speak for it, lowered by words that speak against it. Base spans are always
listed; what is masked depends on the score, so that a version number isn't.
All searches take time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Kinds in the order in which ties are listed, with prior score and replacement.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = KINDS[:4]
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.6, "phone": 0.5, "iban": 0.6, "ssn": 0.3}
CHECKED = {"card": 0.3, "iban": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security", "social-security", "taxpayer"),
}
AGAINST = {"ip": re.compile(r"\b(?:version|release|build|firmware|section|chapter)\b")}
CONTEXT_CHARS, CONTEXT_GAIN, CONTEXT_LOSS, LEAST = 40, 0.2, 0.3, 0.5
# The patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match takes runs of digits whole, so one that fails at the run's begin fails at every digit of it.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){1,30}")
# Characters of an IBAN by country.
IBAN_LENGTH = {
    code[:2]: int(code[2:])
    for code in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 "
        "KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the digits, every second one from the right doubled, sum to a multiple of ten."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The IBAN rule: country and check digits moved to the end, letters as 10 to 35, remainder 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """All matches of local part, @ and dotted domain: each begins where the run before an @ does, or where the last match ended."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        got = DOMAIN.match(text, at) if begin < at else None
        if got:
            out.append((begin, got.end()))
            done = got.end()
        at = text.find("@", max(at + 1, done))
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers of their country's length, or for other countries the longest of 15 to 34 characters, that pass mod 97.

    They end where a run of letters and digits does. Single spaces may stand between groups of two characters or more
    and a last one of any length. A place that fails hides no later one.
    """
    out, at = [], 0
    while head := IBAN_HEAD.search(text, at):
        at = head.end()
        run = text[head.start() : IBAN_REST.match(text, at).end()]
        ends = [k for k, c in enumerate(run, 1) if c != " "]
        size = IBAN_LENGTH.get(run[:2])
        for n in [size] if size else range(34, 14, -1):
            if n > len(ends):
                continue
            stop = head.start() + ends[n - 1]
            groups = run[: ends[n - 1]].split(" ")
            if not (text[stop : stop + 1].isascii() and text[stop : stop + 1].isalnum()) and all(len(g) > 1 for g in groups[:-1]) and mod97("".join(groups)):
                out.append((head.start(), stop))
                at = stop
                break
    return out


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by start and then kind as listed: all base spans, and others that score LEAST or more."""
    found = [("email", *m) for m in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
        found += [("iban", *m) for m in _ibans(text)]
        found += [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    out = []
    for kind, a, b in found:
        near = (text[max(0, a - CONTEXT_CHARS) : a] + " " + text[b : b + CONTEXT_CHARS]).lower()
        score = PRIOR[kind] + CHECKED.get(kind, 0.0)
        if any(w in near for w in CONTEXT[kind]):
            score += CONTEXT_GAIN
        elif kind in AGAINST and AGAINST[kind].search(near):
            score -= CONTEXT_LOSS
        score = round(min(score, 1.0), 3)
        if kind in BASE or score >= LEAST:
            out.append((kind, a, b, score))
    return out


def mask(text: str, spans: list[tuple[str, int, int, float]], least: float = LEAST) -> str:
    """The text with each span scored ``least`` or more, or joined overlapping ones, as the first one's [KIND]."""
    out, done = [], 0
    for kind, a, b, score in spans:
        if score < least:
            continue
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def _text(value) -> str:
    return value if isinstance(value, str) else ""


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, stop, score>>) for every row's whole text; null and empty texts have no spans.

    Repeated rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "stop": b, "score": s} for k, a, b, s in find_spans(_text(t))] for t in batch["text"]]
            yield pd.DataFrame({id_col: batch["id"], "spans": spans})

    kind = df.schema[id_col].dataType.simpleString()
    narrow = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return narrow.mapInPandas(scan, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,stop:bigint,score:double>>")


def mask_pii(df: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows with personal data replaced in the text; a null text stays null, other columns are kept."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: mask(t, find_spans(t), least) if isinstance(t, str) else None)

    return df.withColumn(text_col, masked(F.col(text_col)))


def span_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, a digest of the base spans and all spans as text."""

    @F.pandas_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, scores string")
    def digest(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for spans in lists:
            base = [s for s in spans if s["kind"] in BASE]
            counts = [sum(s["kind"] == k for s in base) for k in BASE]
            joined = [",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in some) for some in (base, spans)]
            rows.append([*counts, hashlib.sha256(joined[0].encode()).hexdigest(), joined[1], ",".join(f"{s['score']:.2f}" for s in spans)])
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    return found.select(id_col, digest("spans").alias("d")).select(id_col, "d.*")
