"""Links between fingerprints that share a table key and differ in few bits.

Each table key is an equality-join key. Its rows are dealt and sorted by Spark, and a task reads them as a
stream, one key at a time. Inside a key, every member is compared with those that are not yet linked to it,
so that the links found span exactly the members' components but never list all pairs of a group. A key with
more members than a task should hold is dealt in parts, and every two parts meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import cut

#: Groups up to this size are compared by shifting the sorted rows against themselves, all keys at once.
SMALL_GROUP = 8
#: Groups up to this size are spanned by their shortest links.
NEAREST = 2048
#: Members of a key above which it is dealt in parts; a task then holds two parts.
HOT_KEY = 32_768


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1)


def _span(ids: np.ndarray, words: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of rows within the radius.

    Up to ``NEAREST`` rows, each is linked to the nearest row that is linked already; more rows are linked breadth
    first, which looks only at those not yet linked and so stays close to linear in dense groups.
    """
    edges: list[tuple[int, int]] = []
    if len(ids) <= NEAREST:
        left, at = np.arange(1, len(ids)), 0
        best, whom = _bits(words[left], words[0]), np.zeros(len(left), dtype=np.int64)
        while len(left):
            k = int(best.argmin())
            at = left[k]
            if best[k] <= radius:
                edges.append((ids[whom[k]], ids[at]))
            left, best, whom = np.delete(left, k), np.delete(best, k), np.delete(whom, k)
            apart = _bits(words[left], words[at])
            nearer = apart < best
            best, whom = np.where(nearer, apart, best), np.where(nearer, at, whom)
        return edges
    left = np.arange(len(ids))
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _bits(words[left], words[at]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                edges += [(ids[at], ids[k]) for k in found]
                frontier += list(found)
    return edges


def _edges(key: np.ndarray, ids: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    a, b = [], []
    for d in range(1, SMALL_GROUP):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:]) if len(key) > d else np.array([], int)
        if not len(i):
            break
        i = i[_bits(words[i], words[i + d]) <= radius]
        a.append(ids[i])
        b.append(ids[i + d])
    for at in np.flatnonzero(sizes > SMALL_GROUP):
        s = slice(starts[at], starts[at] + sizes[at])
        found = np.array(_span(ids[s], words[s], radius), dtype=np.int64).reshape(-1, 2)
        a.append(found[:, 0])
        b.append(found[:, 1])
    empty = np.array([], dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _linker(words: list[str], radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # of the last key, whose rows may go on in the next batch

        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            key, ids, *w = parts
            a, b = _edges(key, ids, np.stack(w, axis=-1).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
            if not len(cols[0]):
                continue
            if held and cols[0][-1] == held[-1][0][-1]:
                held.append(cols)
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            held.append([c[:last] for c in cols])
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])
            held = [[c[last:] for c in cols]]
        if held:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _dealt(rows: DataFrame, limit: int, share: int = 1) -> DataFrame:
    """``rows`` with each key of more than ``limit`` members in parts, of which every two share a key of their own.

    Two members of a part meet wherever that part does, so nothing that shared a key is kept apart. One in ``share``
    of the ids is counted to tell which keys these are.
    """
    counted = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0) if share > 1 else rows
    hot = cut(counted.groupBy("key").agg((F.count("*") * share).alias("n")).where(F.col("n") > limit))
    if hot.isEmpty():
        return rows
    parts = hot.select("key", F.greatest(F.lit(2), F.ceil(F.col("n") / limit)).cast("int").alias("parts"))
    met = rows.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("part"))
    pair = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    split = met.withColumn("other", F.explode_outer(F.when(F.col("parts").isNotNull(), others)))
    return split.withColumn("key", F.when(F.col("parts").isNull(), F.col("key")).otherwise(pair)).select(*rows.columns)


def links(nodes: DataFrame, words: list[str], keys: list[Column], radius: int, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges ``(a, b)`` between ids of ``nodes`` that share a key and differ in at most ``radius`` bits.

    ``nodes`` has one row for each different fingerprint: ``id`` (long) and its ``words`` (longs). Within every
    key the edges connect exactly what the radius connects. A task holds about twice ``hot_key`` rows of a key at
    most, 16 bytes and a fingerprint each.
    """
    rows = _dealt(nodes.select(F.explode(F.array(*keys)).alias("key"), "id", *words), hot_key)
    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_linker(words, radius), "a long, b long").distinct()
