r"""Personal data: regular expressions propose spans, checksums confirm them,
nearby context words adjust the score.

Kinds, in listing order: ``email``, ``ip``, ``card``, ``phone`` (the base
kinds) and ``iban``, ``ssn`` (added by the method).  A span is (kind, start,
end, score, base) in code points, end exclusive.

* Base spans are leftmost, non-overlapping per kind; a match that fails its
  check (ip parts over 255, Luhn, digit counts) is dropped without a retry.
* ``iban`` proposals must pass mod-97.  ``ssn`` proposals have no checksum and
  stand only where a context word lifts their score to ``MIN_SCORE``.
* Base spans always stay; their score is informative.

Defined results: null or empty text has no spans; every input row gives one
output row, repeated rows and ids included; other columns are passed through
by ``redact`` and ignored by ``find_pii``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import give_back
from .registry import load, register

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn")
MIN_SCORE = 0.5
CONTEXT_CHARS = 48

# The patterns below match what the documented ones match.  An email is found
# from its ``@`` outwards, and digit runs are taken whole (possessive), so
# long runs cost linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Prior score of a confirmed span, and the words near it that lift it.
_PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
_LIFT = 0.3
_CONTEXT = {
    "email": re.compile(r"(?i)\b(?:e-?mail|contact|write|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|adresse)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|téléphone|teléfono)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security)\b"),
}

SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>"


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97_ok(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    done = 0
    for m in _EMAIL_TAIL.finditer(text):
        at = start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = m.end()
            yield start, done


def _ips(text: str):
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") or "0" for p in m.group().split("."))
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn_ok(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def _ibans(text: str):
    """The longest end at a space that mod-97 confirms, as words in capitals
    may follow a number."""
    m = _IBAN.search(text)
    while m:
        found, done = m.group(), m.end()
        while len(found.replace(" ", "")) >= 15:
            if len(found.replace(" ", "")) <= 34 and mod97_ok(found):
                done = m.start() + len(found)
                yield m.start(), done
                break
            found = found.rpartition(" ")[0]
        m = _IBAN.search(text, done)


_FINDERS = (
    ("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones),
    ("iban", _ibans), ("ssn", lambda t: (m.span() for m in _SSN.finditer(t))),
)


def spans_of(text: str | None) -> list[tuple[str, int, int, float, bool]]:
    """All spans of one text, by kind as listed, then start."""
    out = []
    for kind, finder in _FINDERS:
        base = kind in BASE_KINDS
        for start, end in finder(text or ""):
            near = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
            score = _PRIOR[kind] + (_LIFT if _CONTEXT[kind].search(near) else 0.0)
            if base or score >= MIN_SCORE:
                out.append((kind, start, end, min(1.0, score), base))
    return out


def redacted(text: str | None) -> str | None:
    """``text`` with each span, overlapping ones merged, put as ``[KIND]``."""
    spans = sorted((s, e, k) for k, s, e, _, _ in spans_of(text))
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


_ARROW_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
    ("score", pa.float64()), ("base", pa.bool_()),
]))
_NAMES = ("kind", "start", "end", "score", "base")


def spans_column(text: Column) -> Column:
    """Array of spans of a text column."""

    @F.arrow_udf(SPAN_TYPE)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[dict(zip(_NAMES, s)) for s in spans_of(t.as_py())] for t in texts], _ARROW_SPANS
        )

    return find(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``spans``."""
    return docs.select(F.col(id_col), spans_column(F.col(text_col)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its personal data replaced by ``[KIND]`` and its length
    column (if given) brought up to date; null texts stay null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out = pa.array([redacted(t.as_py()) for t in texts], pa.string())
        give_back()
        return out

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.coalesce(F.char_length(text_col), F.lit(0)).cast(kind))
    return out


@register("op9_pii")
def op9_pii(spark, sf_dir):
    spans = F.col("spans")

    def listed(array: Column) -> Column:
        return F.concat_ws(",", F.transform(
            array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return find_pii(load(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
    )
