"""All pairs of shingle sets that are similar enough, by prefix filtering.

Every set is put in one order that all sets share, common shingles last. Two sets of Jaccard similarity t or more
share a shingle among the first ``n - ceil(t * n) + 1`` of both, so these shingles are equality-join keys that miss
no pair, wherever and however the texts differ. (Chaudhuri et al., "A Primitive Operator for Similarity Joins in
Data Cleaning", 2006; Xiao et al., "Efficient Similarity Joins for Near Duplicate Detection", 2008.)

Inside a key, pairs are tried by growing distance in the order of sizes, and only those not yet linked, so that a
group of copies is linked long before all its pairs are listed. A pair that fails leaves both open for others:
every pair that shares a key is verified on whole sets, ruled out by a bound, or is connected by links that were.
After the first round rows carry counts of their hashes and their first keys, so a pair that cannot be similar, or that
meets at an earlier key of these, is not made a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.llm.buckets import _dealt
from copse.llm.common import cut, gathered, small_batches, text_of
from copse.llm.components import components
from copse.llm.fingerprints import bit_counts, majority, shingles

SEED = 42
#: Documents whose shingles say which are common, and how many common ones are told to all tasks. They only order.
SAMPLE, COMMON = 10_000, 32_768
#: Members of a key above which it is dealt in parts that meet pairwise.
HOT_KEY = 4096
#: One in so many sets is counted to find such keys.
COUNTED = 16
#: Bytes of a hash that whole sets carry, and ids of documents that are broadcast at most.
KEPT, BROADCAST_IDS = 5, 4_000_000
#: Bytes of a profile, and shingles of a prefix that go with it.
BINS, FIRST = 256, 8
#: Each round tries so many times the distance of the one before; rows of keys of more members than NEAR all go on.
WIDER, NEAR = 32, 64


def hashed(text: str, words: int) -> np.ndarray:
    """The different 64-bit hashes of a text's shingles, ascending."""
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(g, SEED) for g in shingles(text, words)]), dtype=">i8").astype(np.int64))


def name_of(hashes: np.ndarray) -> int:
    """One number for equal sets."""
    return int.from_bytes(xxhash.xxh3_64_digest(hashes.tobytes()), signed=True)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one; ``common`` ascends, ``times`` says how common each is."""
    count = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        rank = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.argsort(rank, kind="stable")[:count]]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of different hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _common(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles on many documents of a sample, ascending, and on how many."""
    every = max(1, math.ceil(docs.count() / SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(hashed(text, words))], names=["shingle"])

    few = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    seen = few.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n >= 4")
    rows = sorted((r.shingle, r.n) for r in seen.orderBy(F.desc("n"), "shingle").limit(COMMON).collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def _array(column: pa.Array) -> np.ndarray:
    """A column of numbers, or of byte strings of one length as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1) if pa.types.is_binary(column.type) else column.to_numpy()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole keys, of rows sorted by the first column."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_array(c) for c in batch.columns]
        if held and cols[0][-1] == held[-1][0][-1]:
            held.append(cols)
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        held.append([c[:last] for c in cols])
        yield [np.concatenate(x) for x in zip(*held, strict=True)]
        held = [[c[last:] for c in cols]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _fits(i: np.ndarray, d: int, size: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Of the places ``i``, those whose row may be similar to that ``d`` rows on.

    At the first shingle that two sets share, what is left of both bounds what they share.
    """
    left = np.minimum(size[i] - place[i], size[i + d] - place[i + d])
    return i[left * (1 + similarity) >= similarity * (size[i] + size[i + d]) - 1e-6]


def _shared(similarity: float):
    """Rows that may be similar to another of their key, with the number of the key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _by_key(batches):
            key, _, size, place = cols
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.repeat(sizes := np.diff(np.r_[starts, len(key)]), sizes)
            useful = n > NEAR
            for d in range(1, NEAR):
                i = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else np.array([], int)
                if not len(i):
                    break
                i = _fits(i, d, size, place, similarity)
                useful[i] = useful[i + d] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[useful]) for c in (*cols, n)], names=["key", "node", "size", "place", "n"])

    return run


def _tried(similarity: float, near: int, far: int):
    """Pairs of rows of one key at these distances that are not linked yet and may be similar.

    Rows that come with profiles and first keys make only pairs that these leave: that may be similar by profiles, and
    share no earlier key that both know of, where they meet as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, size, place, root, *known in _by_key(batches):
            for d in range(near + 1, far + 1):
                i = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else np.array([], int)
                if not len(i):
                    break
                i = _fits(i[root[i] != root[i + d]], d, size, place, similarity)
                if known:
                    profiles, firsts = known[0], known[1].view(np.int64)
                    i = i[may_be_similar(profiles[i], profiles[i + d], size[i], size[i + d], similarity)]
                    i = i[~_met_before(firsts[i], firsts[i + d], place[i], place[i + d])]
                a, b = np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def profile(hashes: np.ndarray) -> bytes:
    """How many hashes have each last 9 bits, modulo 16; two counts a byte."""
    counts = np.bincount(hashes & (2 * BINS - 1), minlength=2 * BINS) & 15
    return (counts[:BINS] | counts[BINS:] << 4).astype(np.uint8).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """False only where sets of m and n hashes with these profiles cannot be that similar: they differ in as many at least.

    Counts that differ by x differ by min(x, 16 - x) or more before they are taken modulo 16.
    """
    low, high = (a - b) & 15, ((a >> 4) - (b >> 4)) & 15
    apart = (np.minimum(low, 16 - low) + np.minimum(high, 16 - high)).sum(axis=-1, dtype=np.int64)
    return (m + n - apart) * (1 + similarity) >= 2 * similarity * (m + n) - 1e-6


def first_keys(keys: np.ndarray) -> bytes:
    """The first ``FIRST`` shingles of a prefix; fewer are filled up with zeros."""
    return np.r_[keys[:FIRST], np.zeros(max(0, FIRST - len(keys)), np.int64)].astype(np.int64).tobytes()


def _met_before(a: np.ndarray, b: np.ndarray, place: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether rows with these first keys share one before these places."""
    at = np.arange(FIRST)
    both = (at < place[:, None])[:, :, None] & (at < other[:, None])[:, None, :]
    return (both & (a[:, :, None] == b[:, None, :])).any(axis=(1, 2))


def packed(hashes: np.ndarray) -> bytes:
    """The last ``KEPT`` bytes of each hash, which tell the shingles of any two texts apart."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The different hashes of a packed set, ascending."""
    out = np.zeros((len(data) // KEPT, 8), dtype=np.uint8)
    out[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return np.unique(out.view(np.int64).ravel())


def _whole(words: int):
    """The sets of texts, by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed(t, words) for t in batch.column(0).to_pylist()]
            cols = [pa.array([name_of(s) for s in sets], pa.int64()), pa.array([packed(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "hashes"])

    return run


def _kept_pairs(test: Callable[..., bool]):
    """The pairs ``a, b`` for which what stands beside them passes a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [test(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, own: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame | None:
    """The different ``pairs`` (``a < b``, names of sets) that are similar as whole sets, or None if there are none.

    ``own`` has ``node, doc_id, size, profile`` of each set. Profiles rule out what cannot be similar; whole sets are
    made of the texts of the few documents that are left, which alone leave their place.
    """
    sides = pairs.join(own.select(F.col("node").alias("a"), F.col("profile").alias("x"), F.col("size").alias("m")), "a")
    sides = sides.join(own.select(F.col("node").alias("b"), F.col("profile").alias("y"), F.col("size").alias("n")), "b").select("a", "b", "x", "y", "m", "n")
    hopeful, _ = gathered(sides.mapInArrow(_kept_pairs(lambda x, y, m, n: bool(may_be_similar(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), m, n, similarity))), "a long, b long"))
    needed, count = gathered(hopeful.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(own.select("node", "doc_id"), "node").select("doc_id").distinct())
    if not count:
        return None
    chosen = docs.join(F.broadcast(needed) if count <= BROADCAST_IDS else needed, "doc_id", "left_semi")
    sets = chosen.select("text").mapInArrow(_whole(words), "node long, hashes binary").dropDuplicates(["node"])
    both = hopeful.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    found, linked = gathered(both.mapInArrow(_kept_pairs(lambda x, y: jaccard(unpacked(x), unpacked(y)) >= similarity), "a long, b long"))
    return found if linked else None


def _described(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """``doc_id, node, size, w0, keys, profile, firsts``: the name of each text's set, its size, fingerprint, prefix, profile and first keys."""
    common, times = _common(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [hashed(t, words) for t in batch.column(1).to_pylist()]
            prints = b"".join(majority(bit_counts(s.astype(">i8").view(np.uint8).reshape(-1, 8)), len(s)) for s in sets)
            keys = [prefix(s, similarity, common, times) for s in sets]
            cols = [batch.column(0), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
            cols += [pa.array(np.frombuffer(prints, dtype=">i8").astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            cols += [pa.array([profile(s) for s in sets], pa.binary()), pa.array([first_keys(k) for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "size", "w0", "keys", "profile", "firsts"])

    return docs.mapInArrow(run, "doc_id long, node long, size int, w0 long, keys array<long>, profile binary, firsts binary").where("size > 0")


def similar_components(docs: DataFrame, similarity: float, words: int, first: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``doc_id, component_id`` for every row of ``docs`` (``doc_id, text``): components of all pairs that are similar.

    ``first`` makes pairs ``a, b`` (names of sets) of ``node, w0`` (fingerprints of the sets) that are verified
    with the first round's; pairs that these connect are not tried again. Equal sets are one node. Texts without words are
    no copies of one another; they have no component.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).where("doc_id IS NOT NULL")
    prints = cut(_described(docs, similarity, words))
    size, w0, keys, counts, firsts = (F.any_value(c).alias(c) for c in ("size", "w0", "keys", "profile", "firsts"))
    nodes = prints.groupBy("node").agg(size, w0, keys)
    own = prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), size, counts, firsts)
    roots = None

    def tried(pairs: DataFrame) -> None:
        nonlocal roots
        found = verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), own, docs, similarity, words)
        if found is not None:
            # what was linked before is a star around each root
            roots, _ = gathered(components(found if roots is None else found.unionByName(roots.toDF("a", "b"))))

    index = nodes.select(F.col("node").alias("id"), "size", F.posexplode("keys").alias("place", "key")).select("key", "id", "size", "place")
    dealt = _dealt(index, HOT_KEY, COUNTED).repartition("key").sortWithinPartitions("key", "size", "id")
    shared = cut(dealt.mapInArrow(_shared(similarity), "key long, node long, size int, place int, n long"))
    most = shared.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    near, far = 0, 1
    while near + 1 < most:
        rows = shared.where(F.col("n") > near + 1).drop("n")
        rows = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = rows.select("key", "node", "size", "place", "root")
        if near:
            # the first round makes a pair a row at most; later ones might make all pairs of a key, most of them hopeless
            open_keys = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
            rows = rows.join(open_keys, "key", "left_semi").join(own.select("node", "profile", "firsts"), "node").select(*rows.columns, "profile", "firsts")
        rows = rows.repartition("key").sortWithinPartitions("key", "size", "node")
        pairs = rows.mapInArrow(_tried(similarity, near, far), "a long, b long")
        # similar sets share a key, so where no key is shared those of ``first`` cannot be similar either
        tried(pairs if near or first is None else pairs.unionByName(first(nodes.select("node", "w0")).select("a", "b")))
        near, far = far, far * WIDER
    named = prints.select("doc_id", "node")
    rooted = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")
