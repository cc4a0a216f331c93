"""Secrets in texts: patterns that report by themselves, and weak parts that report only together.

Access identifiers, secrets and endpoints are intervals in a text. Each interval is widened by the reach of a scope
and joined with the intervals of the other parts that it touches; the intervals of a part are sorted by place, so
the join is a binary search and no pairs are listed. A weak part is reported only if its complements are found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.common import small_batches, text_of

#: Kinds of spans in the order that breaks ties: those that report by themselves, then the weak ones.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "key_id", "secret", "endpoint"]
#: Code points around a part in which its complements must lie.
REACH = 300

# fixed values: the patterns that report by themselves
_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# weak parts
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:A[A-Z]IA[A-Z0-9]{12,}|(?:client|account|access[_-]?key|key)[_-]?id\"?\x20?[:=]\x20?[\"']?[A-Za-z0-9_.-]{6,})")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
_URL = re.compile(r"(?<![A-Za-z0-9])https?://[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?")
_DOMAIN = re.compile(r"\.amazonaws\.com(?::[0-9]{2,5})?")
_LABELS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789-.")
#: A shorter secret reports beside an identifier only, not beside an endpoint alone.
LONG = 32

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans that report by themselves: leftmost, non-overlapping within their kind."""
    out: list[Span] = []
    lower = text.lower()
    if any(key in lower for key in _KEYS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _near(span: tuple[int, int], starts: list[int], ends: list[int], reach: int) -> bool:
    """Whether any of the sorted, non-overlapping intervals comes within reach of the span, itself aside."""
    first, last = bisect_left(ends, span[0] - reach), bisect_right(starts, span[1] + reach)
    return any((starts[i], ends[i]) != span for i in range(first, min(last, first + 2)))


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and bare hosts of a cloud domain: found from the domain, each run before it is walked once."""
    out = [m.span() for m in _URL.finditer(text)]
    starts, ends = _merged(out)
    floor = 0
    for m in _DOMAIN.finditer(text):
        i = bisect_right(starts, m.start()) - 1
        floor = max(floor, ends[i] if i >= 0 else 0)
        start = m.start()
        while start > floor and text[start - 1] in _LABELS:
            start -= 1
        while start < m.start() and text[start] == ".":
            start += 1
        if start < m.start() and not (start and text[start - 1].isascii() and text[start - 1].isalnum()):
            out.append((start, m.end()))
        floor = m.end()
    return sorted(out)


def _mixed(text: str) -> bool:
    """Whether a run looks drawn at random: small and capital letters and digits, no long repeats."""
    return bool(re.search("[a-z]", text) and re.search("[A-Z]", text) and re.search("[0-9]", text)) and len(set(text)) * 3 >= min(len(text), 48)


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts whose complements co-occur within reach.

    An identifier needs a secret; a secret needs an identifier or, from ``LONG`` code points on, an endpoint; an
    endpoint needs an identifier and a secret. Spans inside base spans are not weak parts of their own.
    """
    taken_from, taken_to = _merged([s[1:] for s in base])
    inside = lambda a, b: (i := bisect_right(taken_from, a) - 1) >= 0 and taken_to[i] > a or (bisect_left(taken_from, b) - bisect_left(taken_from, a)) > 0
    has_id = "IA" in text or "_id" in text or "-id" in text
    has_url = "://" in text or "amazonaws" in text
    ids = [m.span() for m in _KEY_ID.finditer(text) if not inside(*m.span())] if has_id else []
    urls = [s for s in endpoints(text) if not inside(*s)] if has_url else []
    known_ids = [s[1:] for s in base if s[0] == "access"]
    if not ids and not urls and not known_ids:
        return []
    secrets = [m.span() for m in _SECRET.finditer(text) if not inside(*m.span()) and _mixed(m[0])]
    known_secrets = [s[1:] for s in base if s[0] != "access"]
    all_ids, all_secrets, all_urls = _merged(ids + known_ids), _merged(secrets + known_secrets), _merged(urls)
    out = [("key_id", *s) for s in ids if _near(s, *all_secrets, reach)]
    out += [("secret", *s) for s in secrets if _near(s, *all_ids, reach) or (s[1] - s[0] >= LONG and _near(s, *all_urls, reach))]
    return out + [("endpoint", *s) for s in urls if _near(s, *all_ids, reach) and _near(s, *all_secrets, reach)]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, found array<struct<kind, start, end>>`` for each row of ``docs``; code points, end exclusive.

    A null text counts as empty and has no spans. Repeated rows each get a row; other columns are left out; an
    empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in base + linked_spans(text, base, reach)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")
