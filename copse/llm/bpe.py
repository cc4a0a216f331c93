"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until its pieces are short; a short piece is encoded directly. Two neighbours are joined by
re-encoding a window around the cut that grows on either side until it ends where the tokens outside cannot
change: before white space that follows a character which is not white space. No match of the split pattern can
reach across such a place, none before it looks past it, and the merges never leave a match, so the tokens on
either side are those of the joined text. If a side has no such place the window takes all of that side, which
keeps long unbroken runs right too. Joining is associative: any tree over the same text gives the same ids.
Decoding concatenates the bytes of halves up the same kind of tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from copse.llm.common import small_batches, text_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Code points of a text, or ids of a sequence, up to which a leaf of the tree takes them.
LEAF = 2048
#: The first window on either side of a cut, in code points; it doubles.
WINDOW = 32

# Python's class of white space holds that of the split pattern, so \S here is never white space there
_STABLE = re.compile(r"(?<=\S)[ \n\r\t]")
# runs of the split pattern's white space that are one match, less the last character if text follows; the library's
# regular expression overflows its stack on runs of about a million
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{65536,}")


@functools.cache
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once in each worker."""
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def _stable_before(text: str, start: int, cut: int) -> int:
    """The last place in (start, cut] at which tokens cannot change, else start."""
    width = WINDOW
    while True:
        at = max(start + 1, cut - width)
        found = [m.start() for m in _STABLE.finditer(text, at, cut + 1)]
        if found:
            return found[-1]
        if at == start + 1:
            return start
        width *= 2


def _stable_after(text: str, cut: int, end: int) -> int:
    """The first place in [cut, end) at which tokens cannot change, else end."""
    width = WINDOW
    while True:
        to = min(end, cut + width)
        if found := _STABLE.search(text, cut, to):
            return found.start()
        if to == end:
            return end
        width *= 2


def join(text: str, start: int, cut: int, end: int, left: list[int], right: list[int], enc: tiktoken.Encoding) -> list[int]:
    """The ids of text[start:end] from those of text[start:cut] and text[cut:end]."""
    a = _stable_before(text, start, cut)
    if a == cut:
        return left + right
    b = _stable_after(text, cut, end)
    tail = len(left) if a == start else len(enc.encode_ordinary(text[a:cut]))
    head = len(right) if b == end else len(enc.encode_ordinary(text[cut:b]))
    return left[: len(left) - tail] + enc.encode_ordinary(text[a:b]) + right[head:]


def _halves(text: str, start: int, end: int, enc: tiktoken.Encoding, leaf: int) -> list[int]:
    if end - start <= leaf:
        return enc.encode_ordinary(text[start:end])
    cut = (start + end) // 2
    return join(text, start, cut, end, _halves(text, start, cut, enc, leaf), _halves(text, cut, end, enc, leaf), enc)


def encode(text: str, enc: tiktoken.Encoding, leaf: int = LEAF) -> list[int]:
    """The ids of a text, by halves; very long runs of white space, at which tokens cannot change, by themselves."""
    ids: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += _halves(text, at, run.start(), enc, leaf)
        ids += enc._encode_single_piece(text[run.start() : stop])
        at = stop
    return ids + _halves(text, at, len(text), enc, leaf)


def decode(ids: list[int], enc: tiktoken.Encoding, leaf: int = LEAF) -> bytes:
    """The bytes of ids, by halves."""
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    cut = len(ids) // 2
    return decode(ids[:cut], enc, leaf) + decode(ids[cut:], enc, leaf)


def id_bytes(ids: list[int]) -> bytes:
    """Ids as unsigned little-endian 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def encode_documents(docs: DataFrame, ranks: str = RANKS, leaf: int = LEAF) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` for each row of ``docs``: the ids of its text and their bytes.

    A null text counts as empty and has no ids. Repeated rows each get a row; other columns are left out; an empty
    table gives an empty result.
    """
    return _mapped(docs, ranks, leaf, _SCHEMA, "doc_id long, ids array<int>, decoded binary", lambda ids, back: (ids, back))


def digest_documents(docs: DataFrame, ranks: str = RANKS, leaf: int = LEAF) -> DataFrame:
    """As ``encode_documents``, with the number of ids and SHA-256 digests in place of ids and bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(ids: list[int], back: bytes) -> tuple:
        return len(ids), hashlib.sha256(id_bytes(ids)).hexdigest(), hashlib.sha256(back).hexdigest()

    return _mapped(docs, ranks, leaf, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def _mapped(docs: DataFrame, ranks: str, leaf: int, schema: pa.Schema, ddl: str, made) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text, enc, leaf)
                rows.append((doc_id, *made(ids, decode(ids, enc, leaf))))
            cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").select("doc_id", text_of().alias("text")).mapInArrow(run, ddl)
