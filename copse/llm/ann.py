"""Approximate nearest neighbours by inner product with collision-counting hashing.

Vectors get one more component so that all of a slice have its longest one's length; then the largest inner product is
the smallest distance. Directions drawn as random orthonormal bases give each vector one number each, and each
direction's numbers are one sorted array. Around a query's number a window grows on every array at once; by virtual
rehashing each wider window contains the one before, so only what its ends pass is counted anew. When enough vectors lie in the windows of a share of the
directions, those with most collisions are verified by the exact inner product. Slices hold vectors of similar
lengths, the longest first, and a slice that cannot hold a nearer one than those found is left out. (Gan et al., C2LSH,
2012; Huang et al., QALSH, 2015; Yan et al., "Norm-Ranging LSH for Maximum Inner Product Search", 2018.)

Stated queries run against all vectors in blocks: a task holds one block of either.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from copse.llm.common import cut
from copse.llm.exact_search import one_query

#: Orthonormal bases of directions; share of directions that must collide; verified candidates of a slice: a number and
#: a share; width of the first window in standard deviations, and growth of the windows; seed of the directions; shares of
#: a block's vectors at which slices end; vectors and queries of a block.
BASES, THRESHOLD, ENOUGH, SHARE, WIDTH, GROWTH, SEED = 2, 0.9, 100, 0.04, 2.6, 1.15, 7
SLICES = (0.005, 0.05, 0.2, 1.0)
BLOCK, QUERY_BLOCK = 32768, 8192


@functools.cache
def directions(dim: int, bases: int = BASES, seed: int = SEED) -> np.ndarray:
    """``dim`` x ``bases * dim``: random orthonormal bases, side by side."""
    rng = np.random.default_rng([seed, dim])
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(bases)], axis=1)


class Slice:
    """The sorted arrays of vectors of similar lengths: for each direction the numbers, and the vectors in their order."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray):
        lengths = np.sqrt((vectors**2).sum(axis=1))
        self.vectors, self.rows, self.longest, n = vectors, rows, float(lengths.max()), len(vectors)
        rest = np.sqrt(np.maximum(0, self.longest**2 - lengths**2))
        self.by = directions(vectors.shape[1] + 1)
        numbers = (np.c_[vectors, rest] @ self.by).T
        self.order = np.argsort(numbers, axis=1, kind="stable")
        self.sorted = np.take_along_axis(numbers, self.order, axis=1)
        self.first = self.sorted.std(axis=1).mean() * WIDTH or 1e-9
        self.enough = min(n, ENOUGH + int(SHARE * n))

    def ask(self, directed: np.ndarray) -> None:
        """Take in a block of queries of length 1; their windows of each level are found together, when a query needs them."""
        self.at, self.windows = (np.c_[directed * self.longest, np.zeros(len(directed))] @ self.by).T, {}

    def _window(self, q: int, level: int) -> tuple[list[int], list[int]]:
        """The first and last place of a query's window on each array."""
        if level not in self.windows:
            width = self.first * GROWTH**level
            low = np.stack([line.searchsorted(x - width) for line, x in zip(self.sorted, self.at, strict=True)], axis=1)
            high = np.stack([line.searchsorted(x + width, "right") for line, x in zip(self.sorted, self.at, strict=True)], axis=1)
            self.windows[level] = low, high
        low, high = self.windows[level]
        return low[q].tolist(), high[q].tolist()

    def _in(self, ranges: list[tuple[int, int, int]]) -> np.ndarray:
        """How many of the ranges (array, start, end) hold each vector."""
        return np.bincount(np.concatenate([self.order[j, a:b] for j, a, b in ranges]), minlength=len(self.vectors))

    def candidates(self, q: int) -> np.ndarray:
        """The places of the vectors that collide with a query most, at the first level where enough do in enough directions.

        A vector's misses are the arrays on whose window it does not stand. The first windows leave out few vectors, which
        are counted; from then on the two ends of a window only move outwards, and what they pass is taken off.
        """
        n, arrays = len(self.vectors), len(self.at)
        if self.enough == n:
            return np.arange(n)
        level, (low, high) = 0, self._window(q, 0)
        misses = self._in([(j, a, b) for j in range(arrays) for a, b in ((0, low[j]), (high[j], n))])
        while np.count_nonzero(misses <= (1 - THRESHOLD) * arrays) < self.enough:
            level += 1
            wider = self._window(q, level)
            misses -= self._in([(j, a, b) for j in range(arrays) for a, b in ((wider[0][j], low[j]), (high[j], wider[1][j]))])
            low, high = wider
        return np.flatnonzero(misses <= np.partition(misses, self.enough - 1)[self.enough - 1])


class Index:
    """A block of vectors in slices by length, the longest first."""

    def __init__(self, vectors: np.ndarray):
        order = np.argsort(-(vectors**2).sum(axis=1), kind="stable")
        ends = [0, *(int(share * len(order)) for share in SLICES)]
        self.slices = [Slice(vectors[order[a:b]], order[a:b]) for a, b in zip(ends, ends[1:]) if a < b]

    def ask(self, queries: np.ndarray) -> None:
        """Take in a block of queries."""
        self.queries, self.lengths = queries, np.linalg.norm(queries, axis=1)
        for part in self.slices:
            part.ask(queries / self.lengths[:, None])

    def nearest(self, ids: np.ndarray, query_id: int, q: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best ``k`` candidates but the query's own id; ties to the smaller id, null ids last."""
        best_rows, best = np.zeros(0, dtype=np.int64), np.zeros(0)
        for part in self.slices:
            if len(best) == k and best[-1] > part.longest * self.lengths[q] * (1 + 1e-9):
                break
            found = part.candidates(q)
            found = found[ids[part.rows[found]] != query_id]
            vectors = part.vectors.take(found, axis=0)
            if len(found) > k:  # a fast product, whose rounding may differ from row to row, leaves those that can be among the best
                rough = vectors @ self.queries[q]
                least = np.partition(rough, len(found) - k)[len(found) - k]
                able = rough >= least - 1e-9 * (1 + abs(least))
                found, vectors = found[able], vectors[able]
            rows = np.r_[best_rows, part.rows[found]]
            scores = np.r_[best, (vectors * self.queries[q]).sum(axis=1)]
            order = np.lexsort((ids[rows], -scores))[:k]
            best_rows, best = rows[order], scores[order]
        return best_rows, best


_NO_ID = np.iinfo(np.int64).max  # stands for a null id in a block, where it sorts last


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def _search(k: int):
    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(base):
            ids = base["vec_id"].to_numpy()
            index = Index(_matrix(base["vector"]))
            index.ask(_matrix(queries["vector"]))
            for q, query_id in enumerate(queries["query_id"]):
                rows, scores = index.nearest(ids, query_id, q, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[rows], "score": scores}))
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return found.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def _usable(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest ``k`` found for each query, nearest first.

    Vectors (``vec_id, embedding``) that are null, zero or hold null or non-finite components take no part, and
    vectors meet queries of their own length only. Repeated rows are candidates each. A row with the query's id is the
    query's own; of rows that share an id the least vector asks, and all are candidates of other queries. Ties go to the
    smaller id; a null id is no query and comes last. Fewer candidates than ``k``
    are all returned. An empty table gives an empty result; other columns are left out.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", vector.alias("vector"), is_query.alias("q")).where(_usable(F.col("vector")))
    # the blocks of rows stay what they are when rows are computed again
    rows = cut(rows.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}))
    n, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    blocks = max(1, -(-n // BLOCK))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(1, -(-asked // QUERY_BLOCK), min(-(-cores // blocks), asked // 256))
    base = rows.select("dim", F.coalesce("vec_id", F.lit(_NO_ID)).cast("long").alias("vec_id"), "vector", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"))
    base = base.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = one_query(rows.where("q"))
    queries = queries.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "block", "query_block"]
    found = queries.groupBy(*key).cogroup(base.groupBy(*key)).applyInPandas(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = cut(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")
