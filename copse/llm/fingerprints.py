"""SimHash fingerprints and the search for all fingerprints within a Hamming radius.

A text's terms are its word shingles. Each term's hash votes +weight on its set bits and -weight on the others;
the weight is 1 + floor(log2(term frequency)), so that a term repeated a thousand times counts ten times, not a
thousand. The search cuts a fingerprint into ``radius + 2`` blocks: two fingerprints within the radius agree in
at least two whole blocks, so each two blocks lead one permuted table, and equal leading blocks are compared.
(Manku et al., "Detecting Near-Duplicates for Web Crawling", 2007.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.buckets import links
from copse.llm.common import cut, small_batches, text_of
from copse.llm.components import components

#: Words of a term, bits of a fingerprint, the Hamming radius of the search, and the blocks that lead a permuted table.
TERM_WORDS, BITS, RADIUS, LEADING = 3, 128, 5, 2
#: Bytes of text of a part when texts meet their neighbours; from so many parts on, parts grow up to eight times as large.
PART_BYTES, MANY_PARTS = 16 << 20, 4096

#: For each byte, its eight bits as eight one-byte lanes, so that one addition counts eight bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def bit_counts(digests: np.ndarray) -> np.ndarray:
    """Of each bit, in how many rows of bytes it is set; bits in big-endian order."""
    total = np.zeros(digests.shape[1] * 8, dtype=np.int64)
    for at in range(0, len(digests), 255):  # a lane holds up to 255
        total += _LANES[digests[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def shingles(text: str, words: int) -> list[bytes]:
    """Word shingles of a text, A-Z lower-cased, space-joined as UTF-8, repeats included.

    Words are runs without space, tab, line feed, vertical tab, form feed and carriage return. Fewer words than a
    shingle has give the whole sequence; no words give none.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    joined = b" ".join(found)
    return [joined[a:b] for a, b in zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority(counts: np.ndarray, of: int) -> bytes:
    """Bits that are set in over half."""
    return np.packbits(2 * counts > of).tobytes()


def weighted_simhash(text: str, words: int = TERM_WORDS) -> bytes:
    """The fingerprint of a text, ``BITS`` bits; of no words, zero."""
    terms = shingles(text, words)
    if not terms:
        return bytes(BITS // 8)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, terms)), dtype="V16")
    once, times = np.unique(hashes, return_counts=True)
    rows = once.view(np.uint8).reshape(-1, BITS // 8)
    counts, of, least = bit_counts(rows), len(rows), 2
    while (more := times >= least).any():  # one more vote for each doubling
        counts += bit_counts(rows[more])
        of += int(more.sum())
        least *= 2
    return majority(counts, of)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def block_keys(words: list[Column], blocks: int, leading: int = LEADING) -> list[Column]:
    """One key for each permuted table: the table's number and the ``leading`` blocks that lead it.

    Two fingerprints that differ in at most ``blocks - leading`` bits agree in the leading blocks of some table.
    """
    bits, parts = 64 * len(words), []
    for k in range(blocks):
        lo, hi = k * bits // blocks, (k + 1) * bits // blocks
        own = []
        for i, w in enumerate(words):
            a, b = max(lo, 64 * i), min(hi, 64 * i + 64)
            if a < b:
                mask = (1 << (b - a)) - 1
                own.append(F.shiftrightunsigned(w, 64 * i + 64 - b).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1).cast("long")))
        parts.append(own)
    return [F.xxhash64(F.lit(t), *[x for k in table for x in parts[k]]) for t, table in enumerate(combinations(range(blocks), leading))]


def ordered(docs: DataFrame) -> DataFrame:
    """``part, doc_id, text`` in descending order of ids, within parts that follow one another.

    Null ids come last; equal ids are ordered by the text's hash, and equal rows are spread like others. Parts are
    dealt by ranges of about ``PART_BYTES`` of text, so that no id, block of ids or sparse numbering makes a large one.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, min(-(-size // PART_BYTES), max(MANY_PARTS, -(-size // (8 * PART_BYTES)))))
    keyed = own.select("doc_id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"), "text")
    order = [F.desc_nulls_last("doc_id"), F.col("h"), F.col("row")]
    dealt = keyed.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    return dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")


def _row(doc_id: int | None, text: str, own: bytes, following: str, next_print: bytes) -> tuple:
    changed = edited(text, following)
    other = weighted_simhash(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    hi, lo = (int.from_bytes(own[i : i + 8], signed=True) for i in (0, 8))
    return doc_id, len(text), sha, own.hex(), other.hex(), likeness(own, other), likeness(own, next_print), hi, lo


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document but the last of a part; of each part its first (edge 0) and last (edge 1) text as well."""
    before, none = None, (None,) * len(_SCHEMA)
    for batch in batches:
        out = []
        for part, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (doc_id, text, weighted_simhash(text))
            if before is None:
                out.append((*none, part, 0, doc_id, text))
            else:
                out.append((*_row(*before, text, now[2]), None, None, None, None))
            before, place = now, part
        yield _batch(out, _EDGED)
    if before:
        yield _batch([(*none, place, 1, *before[:2])], _EDGED)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each last document of a part, beside the first of the next."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield _batch([_row(i, text, weighted_simhash(text), following, weighted_simhash(following)) for i, text, following in rows], _SCHEMA)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string())]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("hi", pa.int64()), ("lo", pa.int64())]
)
_EDGED = pa.schema([*_SCHEMA, ("part", pa.int32()), ("edge", pa.int32()), ("edge_id", pa.int64()), ("edge_text", pa.string())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, and those of its edited text and of the next document beside it.

    Texts are put in order in parts; what a part lacks, the first text of the next, is exchanged afterwards as one
    small row a part. A null text counts as empty; a text without words has fingerprint zero. Repeated rows each get
    a row; a single document is its own next. Other columns are left out, so their names cannot clash. An empty table
    gives an empty result.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, hi long, lo long"
    met = cut(ordered(docs).mapInArrow(_inside, f"{schema}, part int, edge int, edge_id long, edge_text string"))
    edges = met.where("edge IS NOT NULL")
    # two numbers for each part that holds rows, put in order by one task
    follows = edges.where("edge = 0").select("part", F.expr("coalesce(lead(part) OVER (ORDER BY part), min(part) OVER ()) AS next"))
    firsts = edges.where("edge = 0").select(F.col("part").alias("next"), F.col("edge_text").alias("following"))
    lasts = edges.where("edge = 1").join(follows, "part").join(firsts, "next").select("edge_id", "edge_text", "following")
    names = [f.name for f in _SCHEMA]
    return met.where("edge IS NULL").select(*names).unionByName(lasts.mapInArrow(_across, schema))


def within(prints: DataFrame, keys: list[Column], radius: int, words: list[str]) -> DataFrame:
    """``prints`` with ``component_id``: the smallest ``doc_id`` reachable over fingerprints within the radius.

    Equal fingerprints become one node before any key is made. Rows without an id belong to the component of
    equal fingerprints (null, if those have no id either) but link nothing.
    """
    # the small side of the last join: one row for each different fingerprint
    nodes = cut(prints.where("doc_id IS NOT NULL").groupBy(*words).agg(F.min("doc_id").alias("id")))
    roots = components(links(nodes, words, keys, radius)).withColumnRenamed("node", "id")
    named = nodes.join(roots, "id", "left").select(*words, F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, words, "left")


def search(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (``doc_id, hi, lo, ...``) with the component of all fingerprints within ``radius`` bits."""
    return within(prints, block_keys([F.col("hi"), F.col("lo")], radius + LEADING), radius, ["hi", "lo"])
