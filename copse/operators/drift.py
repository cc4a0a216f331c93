"""Comments that stayed as they were while the code after them changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.operators.scan import path_order

LOOKAHEAD, YEARS, SCAN = 10, 3, 50
YEAR_SECONDS = 365 * 86400


def candidates(files: DataFrame, limit: int = SCAN) -> DataFrame:
    """The paths with most comment lines, which are worth blaming."""
    return files.where(F.col("comment") > 0).orderBy(F.desc("comment"), path_order()).limit(limit).select("path")


def drift(lines: DataFrame, years: float = YEARS) -> DataFrame:
    """``path, blocks, drifted`` from ``lines`` (``path, line, kind, time``); a null time counts as 0.

    A block is a run of comment lines. It counts if code follows it; it has drifted if the newest of the next
    ``LOOKAHEAD`` code lines is newer than the newest of its own lines by more than ``years``.
    """
    own = Window.partitionBy("path").orderBy("line")
    rows = lines.withColumn("time", F.coalesce("time", F.lit(0)))
    # code lines numbered apart, so that the look-ahead skips all other lines
    code = rows.where(F.col("kind") == "code").withColumn("code_time", F.max("time").over(own.rowsBetween(0, LOOKAHEAD - 1)))
    both = rows.where(F.col("kind") == "comment").select("path", "line", "kind", "time", F.lit(None).cast("long").alias("code_time"))
    both = both.unionByName(code.select("path", "line", "kind", "time", "code_time"))
    run = F.col("line") - F.row_number().over(Window.partitionBy("path", "kind").orderBy("line"))
    after = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    next_code = F.last(F.when(F.col("kind") == "code", F.col("code_time")), ignorenulls=True).over(after)
    marked = both.withColumns({"run": run, "next_code": next_code}).where(F.col("kind") == "comment")
    blocks = marked.groupBy("path", "run").agg(F.max("time").alias("comment_time"), F.max_by("next_code", "line").alias("code_time"))
    late = F.col("code_time") - F.col("comment_time") > F.lit(years * YEAR_SECONDS)
    return blocks.groupBy("path").agg(F.count("code_time").alias("blocks"), F.count_if(late).alias("drifted"))


def rank(drifts: DataFrame) -> DataFrame:
    """Files with blocks; the largest drifted share first."""
    out = drifts.where(F.col("blocks") > 0)
    return out.orderBy(F.desc(F.col("drifted") / F.col("blocks")), F.desc("drifted"), path_order())


def summary(drifts: DataFrame) -> DataFrame:
    """One row: ``files_checked, blocks, drifted``."""
    found = drifts.where(F.col("blocks") > 0)
    return found.agg(F.count("*").alias("files_checked"), F.coalesce(F.sum("blocks"), F.lit(0)).alias("blocks"), F.coalesce(F.sum("drifted"), F.lit(0)).alias("drifted"))
