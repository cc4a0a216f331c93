"""Near-duplicate groups by SimHash and deletion-variant signatures.

A fingerprint is cut into few segments, so few that of two fingerprints within the radius one segment differs in
at most one bit. Each segment is indexed once for each of its bits with that bit as a wildcard; segments that
differ in at most one bit then share a key, which an equality join finds and the whole distance verifies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.buckets import links
from copse.llm.common import cut, small_batches, text_of
from copse.llm.fingerprints import bit_counts, majority, shingles, within
from copse.llm.set_join import similar_components

SEED, RADIUS, WORDS = 42, 4, 4
#: Bits within which fingerprints of shingle sets are paired before the pairs are verified; three segments cover them.
VERIFIED_RADIUS = 5


def simhash(text: str, words: int, seeds: tuple[int, ...] = (SEED,)) -> bytes:
    """Majority bits of the shingles' XXH64 under each seed, 64 bits a seed; of no words, zero."""
    grams = shingles(text, words)
    if not grams:
        return bytes(8 * len(seeds))
    out = b""
    for seed in seeds:
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(g, seed) for g in grams]), dtype=np.uint8).reshape(-1, 8)
        out += majority(bit_counts(hashes), len(grams))
    return out


def segments(radius: int) -> int:
    """The fewest segments of which one differs in at most one bit."""
    return radius // 2 + 1


def variant_keys(words: list[Column], count: int) -> list[Column]:
    """A key for each bit of the fingerprint: its segment with that bit as a wildcard.

    No segment crosses a word; each word is cut into ``count / len(words)`` segments, rounded up.
    """
    each, keys = math.ceil(count / len(words)), []
    for i, w in enumerate(words):
        for k in range(each):
            lo, hi = k * 64 // each, (k + 1) * 64 // each
            part = F.shiftrightunsigned(w, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1).cast("long"))
            for bit in range(hi - lo):
                number = 64 * i + lo + bit
                kept = part.bitwiseAND(F.lit(~(1 << bit) if bit < 63 else (1 << 63) - 1).cast("long"))
                keys.append(kept + F.lit(number << (hi - lo)) if hi - lo + number.bit_length() < 63 else F.xxhash64(F.lit(number), kept))
    return keys


def fingerprints(docs: DataFrame, words: int = WORDS, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``doc_id, w0, w1, ...``: one signed 64-bit word a seed. A null text counts as empty."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *(f"w{i}" for i in range(len(seeds)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = b"".join(simhash(t, words, seeds) for t in batch.column(1).to_pylist())
            cols = np.frombuffer(prints, dtype=">i8").astype(np.int64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in cols.T)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seeds: tuple[int, ...] = (SEED,), segment_count: int | None = None
) -> DataFrame:
    """``doc_id, w0, ..., component_id`` for every row of ``docs``: the smallest id reachable over near copies.

    Fingerprints that differ in at most ``radius`` bits are linked, those of texts without words (zero) like any
    other. With the default ``segment_count`` every such pair is found; with fewer segments pairs further apart
    than ``2 * segment_count - 1`` bits are found only where some segment differs in at most one bit. Repeated rows
    each get a row; rows without an id take the component of equal fingerprints (null if none has an id) and link
    nothing; an empty table gives an empty result; other columns are left out.
    """
    names = [f"w{i}" for i in range(len(seeds))]
    prints = cut(fingerprints(docs, words, seeds))
    keys = variant_keys([F.col(n) for n in names], segment_count or segments(radius))
    return within(prints, keys, radius, names)


def close_fingerprints(nodes: DataFrame, radius: int = VERIFIED_RADIUS) -> DataFrame:
    """``a, b``: pairs of ``nodes`` (``node, w0``) whose fingerprints are within the radius, by deletion-variant signatures.

    Nodes of one fingerprint are each paired with the least of them, and fingerprints are linked by way of these. Of the
    pairs that a node is the greater of, the one with the least other stays: one pair a node.
    """
    leasts = cut(nodes.groupBy("w0").agg(F.min("node").alias("id"), F.count("*").alias("n")))
    equal = nodes.join(leasts.where("n > 1"), "w0").where("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    found = equal.unionByName(links(leasts.select("id", "w0"), ["w0"], variant_keys([F.col("w0")], segments(radius)), radius))
    return found.groupBy(F.greatest("a", "b").alias("b")).agg(F.min(F.least("a", "b")).alias("a"))


def verified_duplicates(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``doc_id, component_id`` for rows of ``docs`` with words and an id: components of all pairs with similar shingles.

    Documents whose fingerprints lie within ``VERIFIED_RADIUS`` bits are paired by deletion-variant signatures and
    linked if their whole sets of shingles of ``words`` words have this Jaccard similarity. Pairs that are similar
    enough, but whose fingerprints differ more, are found among what is not linked yet by an exact way: see
    ``set_join``. Every similar pair is linked or connected by such links, and no other. Texts with equal sets are one
    node. Rows without an id or without words are left out. Of rows that repeat an id with other texts each is linked
    by its own text. An empty table gives an empty result; other columns are left out.
    """
    return similar_components(docs, similarity, words, close_fingerprints)


def radius_for(similarity: float, bits: int) -> int:
    """The bits by which SimHash fingerprints of shingle sets with this Jaccard similarity differ, on average.

    Sets of equal size with Jaccard similarity s have cosine 2s / (1 + s); a random hyperplane splits them with
    probability angle / pi.
    """
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` without all but the smallest id of each group of near copies, as ``verified_duplicates`` finds them.

    Of rows with one id all stay or go together; rows without an id stay, and so do texts without words.
    """
    gone = verified_duplicates(docs, similarity, words).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
