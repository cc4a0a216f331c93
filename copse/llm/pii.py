"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Emails, IP addresses, payment cards (Luhn) and phone numbers are reported wherever their pattern and check hold.
Bank account numbers (mod 97), national phone numbers and social security numbers are weaker proposals: they are
reported if their check or the words around them lift the score to the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.common import small_batches, text_of

#: Kinds of spans in the order that breaks ties: those that report by themselves, then the weaker ones.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "local_phone", "ssn"]
#: Score from which a proposal is reported; code points around it in which words count.
THRESHOLD, REACH = 0.5, 48

# fixed values: the patterns that report by themselves
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match cannot start inside a run of digits that an earlier start could not match
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# weaker proposals
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score before context, and the words that raise it by CONTEXT when they stand nearby.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.6, "local_phone": 0.3, "ssn": 0.3}
WORDS = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "credit", "debit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social", "security"),
}
CONTEXT = 0.3

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """Whether an account number, its first four characters moved to the end and letters as 10 to 35, is 1 modulo 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each ``@``: the run before it, down to the last match's end, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at)  # what stands before this @ cannot reach past it
        at = text.find("@", max(at + 1, end))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers that pass the check; a word that only looks like a group after one is left out of it."""
    at = 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        ends = [end, *(start + i for i in range(end - start - 1, 14, -1) if m[0][i] == " ")]
        passed = next((e for e in ends if mod_97(text[start:e].replace(" ", ""))), None)
        if passed:
            yield start, passed
        at = passed or start + 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that report by themselves: leftmost, non-overlapping within their kind."""
    out = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def _scored(text: str, kind: str, start: int, end: int, reach: int) -> Span:
    around = set(re.findall(r"[^\W\d_]+", f"{text[max(0, start - reach) : start]} {text[end : end + reach]}".lower()))
    return kind, start, end, round(min(1.0, PRIOR[kind] + CONTEXT * any(w in around for w in WORDS[kind])), 2)


def find_spans(text: str, threshold: float = THRESHOLD, reach: int = REACH) -> list[Span]:
    """All reported spans with their scores."""
    out = [_scored(text, *s, reach) for s in base_spans(text)]
    weak = [("iban", *s) for s in _ibans(text)]
    weak += [(kind, *m.span()) for kind, p in (("local_phone", _LOCAL_PHONE), ("ssn", _SSN)) for m in p.finditer(text)]
    return out + [s for w in weak if (s := _scored(text, *w, reach))[3] >= threshold]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, reach: int = REACH) -> DataFrame:
    """``doc_id, found array<struct<kind, start, end, score>>`` for each row; code points, end exclusive.

    A null text counts as empty and has no spans. Repeated rows each get a row; other columns are left out; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in _SPAN]
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in find_spans(t, threshold, reach)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, found {_SPANS}")


def redacted(docs: DataFrame, threshold: float = THRESHOLD, reach: int = REACH) -> DataFrame:
    """``docs`` with each reported span of ``text`` replaced by its kind in brackets; a null text stays null."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, find_spans(t, threshold, reach)) for t in batch.column(at).to_pylist()]
            cols = batch.columns
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
