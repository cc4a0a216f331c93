"""Blocks of queries against shards of vectors, and trees that merge what each shard found.

Both sides are dealt so that a task holds one block and one shard: every vector is copied once for each block of
queries, every query once for each shard. A shard's rows are drawn by row, not by id or content, so equal vectors and
repeated ids spread evenly. What a task finds for a query is a short list, and lists are merged ``FAN`` at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm.common import cut

#: Most rows of a shard and of a block of queries; least rows of a shard while there are fewer than two a core; lists
#: merged at a time; entries of a product that are held at once.
SHARD, BLOCK, LEAST, FAN, HELD = 32768, 4096, 1024, 8, 1 << 21
#: Stands for a null id in a task, where it sorts last.
NO_ID = np.iinfo(np.int64).max
_EXACT, _MOST = 2.0**53, np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def numbered(vectors: DataFrame) -> DataFrame:
    """Rows with a number that stays theirs when a task is run again, and the length of their vector."""
    return cut(vectors.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}))


def dealt(queries: DataFrame, rows: DataFrame, run: Callable, schema: str) -> tuple[DataFrame, int]:
    """``run(query table, row table)`` for each block of queries and each shard of ``numbered`` rows, and the number of shards.

    Vectors meet queries of their own length (``dim``) only. ``queries`` have one row for each ``query_id``. The result
    has the column ``shard`` besides those of ``schema``.
    """
    n, asked = rows.count(), queries.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-n // SHARD), min(2 * cores, -(-n // LEAST)))
    blocks = max(1, -(-asked // BLOCK))
    of = lambda column, parts: F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    right = rows.withColumn("shard", of("row", shards)).drop("row").withColumn("block", every(blocks))
    left = queries.withColumn("block", of("query_id", blocks)).withColumn("shard", every(shards))

    def tile(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        out = run(asked, held) if asked.num_rows and held.num_rows else []
        table = pa.concat_tables(out) if out else empty.drop_columns("shard")
        return table.append_column("shard", pa.array(np.full(table.num_rows, key[1].as_py(), dtype=np.int32))).cast(empty.schema)

    schema = f"{schema}, shard int"
    empty = _empty(schema)
    key = ["dim", "shard", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, schema), shards


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (field.split() for field in schema.split(", "))})


def merged(found: DataFrame, keys: list[str], row: Column, k: int, parts: int, part: str) -> DataFrame:
    """``keys`` and ``list``: the least ``k`` of each key's rows, in order.

    ``row`` is a struct that sorts as wanted; ``part`` (0 to ``parts - 1``) says which list a row belongs to. Lists are
    merged ``FAN`` at a time until one is left for each key, so no task gathers more than ``FAN * k`` rows of a key,
    if no part has more than ``k`` of them.
    """
    parts = -(-parts // FAN)
    now = found.groupBy(*keys, F.pmod(part, F.lit(parts)).alias("part")).agg(F.collect_list(row).alias("list"))
    while True:
        now = now.withColumn("list", F.slice(F.array_sort("list"), 1, k))
        if parts == 1:
            return now.drop("part")
        parts = -(-parts // FAN)
        now = now.groupBy(*keys, F.pmod("part", F.lit(parts)).alias("part")).agg(F.flatten(F.collect_list("list")).alias("list"))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of equally long vectors as rows of doubles."""
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in vectors.chunks]
    flat = np.concatenate(parts).astype(np.float64)
    return flat.reshape(len(vectors), len(flat) // len(vectors))


def whole(vectors: pa.ChunkedArray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of each component, as doubles that are whole numbers; what passes doubles is the largest one."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix(vectors) * scale), -most, most)


def _ints(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=object)
    out.flat = [int(v) for v in x.flat]
    return out


def size(x: np.ndarray) -> float:
    """The largest component's size, 1 at least."""
    return float(np.abs(x).max(initial=1.0))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of two matrices' rows, which are whole numbers: doubles where no sum can be rounded, else integers.

    Those beyond 64 bits count as the largest or smallest long.
    """
    if left.shape[1] * size(left) * size(right) < _EXACT:
        return left @ right.T
    return np.clip(np.dot(_ints(left), _ints(right).T), -_MOST, _MOST)


def ordered(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of scores from the highest, ties by the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i])), dtype=np.int64)
    return np.lexsort((ids, -scores))


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row of scores the places of its ``k`` highest, ties to the smaller id; ``-inf`` is no score.

    A partial selection gives the k-th highest score; only what reaches it is put in order.
    """
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    for row, bound in zip(scores, least, strict=True):
        able = np.flatnonzero((row >= bound) & (row > -np.inf))
        yield able[ordered(row[able], ids[able])][:k]
