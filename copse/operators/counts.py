"""Lines of code by language, their distribution and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copse.operators.scan import one_value, path_order, quantiles

SUMS = ("code", "comment", "blank", "total", "complexity")
LARGEST, TOP_SHARE = 25, 0.05


def by_language(files: DataFrame) -> DataFrame:
    """``language, files, code, comment, blank, total, complexity``; most code first."""
    out = files.groupBy("language").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in SUMS])
    return out.orderBy(F.desc("code"), "language")


def totals(files: DataFrame) -> DataFrame:
    """The same sums over all files, one row; zeros for none."""
    return files.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS])


def distribution(files: DataFrame) -> DataFrame:
    """``language, median_code, p90_code, max_code`` of code lines a file."""
    median = quantiles(files, "code", 0.5, ["language"]).withColumnRenamed("value", "median_code")
    high = quantiles(files, "code", 0.9, ["language"]).withColumnRenamed("value", "p90_code")
    return files.groupBy("language").agg(F.max("code").alias("max_code")).join(median, "language").join(high, "language")


def concentration(files: DataFrame) -> DataFrame:
    """One row: ``largest_files, share, median_code, p90_code``: the largest twentieth's percentage of all code.

    Files of one size are counted together, and running sums over sizes say how much the largest hold.
    """
    sizes = files.groupBy("code").agg(F.count("*").alias("n"))
    whole = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("code"), F.lit(0)).alias("total"))
    k = F.when(F.col("files") == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("files") * F.lit(TOP_SHARE) + 0.5)))
    larger = Window.partitionBy(F.lit(0)).orderBy(F.desc("code")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumn("upto", F.sum("n").over(larger)).crossJoin(F.broadcast(whole.withColumn("k", k)))
    taken = F.greatest(F.lit(0), F.least("n", F.col("k") - (F.col("upto") - F.col("n"))))
    top = ranked.agg(F.coalesce(F.max("k"), F.lit(0)).alias("largest_files"), F.sum(F.col("code") * taken).alias("held"), F.max("total").alias("total"))
    share = F.when(F.coalesce("total", F.lit(0)) > 0, F.col("held") / F.col("total") * 100).otherwise(0.0)
    out = top.select("largest_files", share.alias("share"))
    return out.crossJoin(F.broadcast(one_value(files, "code", 0.5, "median_code"))).crossJoin(F.broadcast(one_value(files, "code", 0.9, "p90_code")))


def largest(files: DataFrame, limit: int = LARGEST) -> DataFrame:
    """``path, code, comment, complexity`` of the files with most code."""
    return files.select("path", "code", "comment", "complexity").orderBy(F.desc("code"), path_order()).limit(limit)


def test_ratio(roled: DataFrame) -> DataFrame:
    """One row: ``source_code, test_code, ratio`` of test code to source code."""
    role_sum = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("code"))), F.lit(0))
    out = roled.agg(role_sum("source").alias("source_code"), role_sum("test").alias("test_code"))
    return out.withColumn("ratio", F.when(F.col("source_code") > 0, F.col("test_code") / F.col("source_code")))
