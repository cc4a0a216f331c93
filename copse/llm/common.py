"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.session import cut, gathered, shared_folder

__all__ = ["cut", "gathered", "shared_folder", "small_batches", "spans_digest", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small for operators over whole texts, which may be very long.

    The setting is read when the plan runs, so it stays on the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def spans_digest(spans: str, kinds: list[str]) -> Column:
    """``kind:start:end`` of an array of (kind, start, end), by start, then kind as listed, comma-joined."""
    rank = F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*[F.lit(i) for i in range(len(kinds))]))
    keyed = F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    )
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
