"""Exact search for the highest inner products of whole-number vectors.

Queries and vectors are dealt as tiles of a matrix product; each tile keeps a partial selection of every query's
highest scores, and the lists of a query's tiles are merged as a tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.llm import tiles

SCALE, K = 256, 5


def _tile(k: int, scale: int):
    def run(asked: pa.Table, held: pa.Table) -> list[pa.Table]:
        ids, asking = held["vec_id"].to_numpy(), asked["query_id"].to_numpy()
        rows, queries = tiles.whole(held["vector"], scale), tiles.whole(asked["vector"], scale)
        out, step = [], max(1, tiles.HELD // len(rows))
        for at in range(0, len(queries), step):
            scores = tiles.products(queries[at : at + step], rows)
            scores[asking[at : at + step, None] == ids[None, :]] = -np.inf
            for query, row, best in zip(asking[at : at + step], scores, tiles.leading(scores, ids, k), strict=True):
                out.append((np.full(len(best), query), ids[best], row[best].astype(np.int64)))
        names = ("query_id", "vec_id", "score")
        return [pa.table({name: np.concatenate(c).astype(np.int64) for name, c in zip(names, zip(*out, strict=True), strict=True)})]

    return run


def one_query(rows: DataFrame, *more: str) -> DataFrame:
    """One query for each id: of rows that share one, the least vector asks."""
    one = F.min(F.struct("vector", *more)).alias("one")
    return rows.where("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("query_id")).agg(one).select("query_id", "one.*", F.size("one.vector").alias("dim"))


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest exact scores of each query, ties to the smaller id.

    A score is the inner product of the vectors (``vec_id, embedding``) after each component becomes
    ``floor(scale * x)``; scores beyond 64 bits count as the largest or smallest long.
    Vectors that are null or hold null or non-finite components take no part, and vectors meet queries of their own
    length only. A row with the query's id is the query's own; of rows that share an id the least vector asks, and all
    are candidates of other queries, once each. A null id is no query, and as a candidate comes last among ties. Fewer
    candidates than ``k`` are all returned, an empty table gives an empty result, and other columns are left out.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), is_query.alias("asks")).where(tiles.finite(F.col("vector")))
    rows = tiles.numbered(rows)
    base = rows.select("dim", "row", F.coalesce("vec_id", F.lit(tiles.NO_ID)).cast("long").alias("vec_id"), "vector")
    found, shards = tiles.dealt(one_query(rows.where("asks")), base, _tile(k, scale), "query_id long, vec_id long, score long")
    row = F.struct((-F.col("score")).alias("s"), "vec_id")
    lists = tiles.merged(found, ["query_id"], row, k, shards, "shard")
    ranked = lists.select("query_id", F.posexplode("list").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(F.col("x.vec_id") != tiles.NO_ID, F.col("x.vec_id")).alias("vec_id"), (-F.col("x.s")).alias("score"))
