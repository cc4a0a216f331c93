"""Decision points of files: how many, how dense, and how concentrated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copse.functions import text
from copse.operators.scan import path_order


def density() -> Column:
    """Decision points for a hundred lines of code."""
    return F.when(F.col("code") > 0, F.col("complexity") / F.col("code") * 100).otherwise(0.0)


def hits() -> Column:
    """The lines of ``with_lines`` that have decisions, with their number, as an array."""
    counted = F.transform("code_lines", lambda line, i: F.struct(i.alias("line"), text.decisions(line, F.col("ext")).alias("n")))
    return F.filter(counted, lambda h: h["n"] > 0)


def complexity(files: DataFrame, window: int = text.DENSEST_WINDOW) -> DataFrame:
    """``path, language, complexity, code, density, branch, loop, bool, densest, concentration`` of measured files; without buckets if they have none.

    ``densest`` is the most decisions in any run of ``window`` lines, and ``concentration`` its percentage of the
    file's. Only lines that have decisions are exploded; the window and the sums share one shuffle by path. A column
    ``hits`` is used if there is one.
    """
    buckets = [b for b in ("branch", "loop", "bool") if b in files.columns]
    names = ["path", "language", "complexity", "code", *buckets]
    rows = files.select(*names, F.explode_outer(F.col("hits") if "hits" in files.columns else hits()).alias("h")).select(*names, "h.line", "h.n")
    run = Window.partitionBy("path").orderBy("line").rangeBetween(-(window - 1), 0)
    out = rows.withColumn("run", F.sum("n").over(run)).groupBy(*names).agg(F.coalesce(F.max("run"), F.lit(0)).cast("long").alias("densest"))
    share = F.when(F.col("complexity") > 0, F.col("densest") / F.col("complexity") * 100).otherwise(0.0)
    return out.select("path", "language", "complexity", "code", density().alias("density"), *buckets, "densest", share.alias("concentration"))


def rank(scored: DataFrame, sort: str = "raw", min_lines: int = 1) -> DataFrame:
    """Files that have decisions and at least ``min_lines`` of code, by decisions (``raw``) or by ``density``."""
    key = {"raw": "complexity", "density": "density"}[sort]
    return scored.where((F.col("complexity") > 0) & (F.col("code") >= min_lines)).orderBy(F.desc(key), path_order())
