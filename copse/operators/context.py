"""What it costs in tokens to read the files, and how easy they are to find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.functions import text
from copse.operators.scan import one_value, path_order

TIERS = (0.5, 0.25, 0.1)


def costs() -> Column:
    """A struct (tokens, code_tokens, comment_tokens) of the lines of ``with_lines``. Each line costs its tokens and its end.

    Estimates add up over lines, so the lines of one sort are joined and estimated at once.
    """
    comments = F.filter(F.zip_with("lines", "kinds", lambda line, kind: F.when(kind == "comment", line)), lambda x: x.isNotNull())
    cost = lambda lines: F.when(F.size(lines) > 0, text.token_estimate(F.array_join(lines, "\n")) + 1).otherwise(0).cast("long")
    return F.transform(
        F.array(F.struct(cost(F.col("lines")).alias("a"), cost(comments).alias("c"))),
        lambda x: F.struct(x["a"].alias("tokens"), (x["a"] - x["c"]).alias("code_tokens"), x["c"].alias("comment_tokens")),
    )[0]


def context(lexed: DataFrame) -> DataFrame:
    """``path, tokens, code_tokens, comment_tokens``; the costliest first. A column ``costs`` is used if there is one."""
    out = lexed.select("path", F.col("costs") if "costs" in lexed.columns else costs().alias("costs")).select("path", "costs.*")
    return out.orderBy(F.desc("tokens"), path_order())


def directories(contexts: DataFrame) -> DataFrame:
    """``dir, tokens, files`` of each first directory; the costliest first."""
    out = contexts.groupBy(text.top_dir(F.col("path")).alias("dir")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("files"))
    return out.orderBy(F.desc("tokens"), F.expr("dir COLLATE UNICODE"))


def totals(contexts: DataFrame) -> DataFrame:
    """Sums over all files, one row."""
    return contexts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "code_tokens", "comment_tokens")])


def repeated_names(files: DataFrame) -> DataFrame:
    """``name, count`` of base names that more than one file has; the worst first."""
    out = files.groupBy(text.base_name(F.col("path")).alias("name")).agg(F.count("*").alias("count")).where(F.col("count") > 1)
    return out.orderBy(F.desc("count"), F.expr("name COLLATE UNICODE"))


def navigability(files: DataFrame) -> DataFrame:
    """One row: ``files, ambiguous_files, median_depth, max_depth``; depth counts the parts of a path."""
    depths = files.select(F.size(F.split("path", "/")).alias("depth"))
    ambiguous = repeated_names(files).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("ambiguous_files"))
    out = depths.agg(F.count("*").alias("files"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    return out.crossJoin(F.broadcast(ambiguous)).crossJoin(F.broadcast(one_value(depths, "depth", 0.5, "median_depth")))


def budget_tiers(contexts: DataFrame, budget: int = 50_000) -> DataFrame:
    """``share, threshold, files``: how many files cost more than a share of the budget."""
    limits = [(share, int(budget * share + 0.5)) for share in TIERS]
    counts = contexts.agg(*[F.count_if(F.col("tokens") > limit).alias(f"n{i}") for i, (_, limit) in enumerate(limits)])
    rows = F.array(*[F.struct(F.lit(s).alias("share"), F.lit(limit).cast("long").alias("threshold"), F.col(f"n{i}").alias("files")) for i, (s, limit) in enumerate(limits)])
    return counts.select(F.inline(rows))
