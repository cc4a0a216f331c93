"""Verdicts on files: which to refactor, and which are risky to edit unattended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.operators.complexity import density
from copse.operators.scan import path_order, wide_values

REFACTOR, AGENT = ("refactor", "split", "watch", "quiet", "inert"), ("safe", "review", "human")
# fixed values: changes from which a file is busy; floors and limits of risks
MIN_BUSY = 2
MIN_DENSE, MIN_LARGE, DUPLICATED, DIFFUSE = 10, 2000, 20, 15


def refactor_input(scored: DataFrame, contexts: DataFrame, changes: DataFrame) -> DataFrame:
    """Files with their complexity, tokens and history; files without history have zeros."""
    base = scored.select("path", "complexity", "code", density().alias("density")).join(contexts.select("path", "tokens"), "path")
    names = {"changes": 0, "churn": 0, "momentum": 0.0, "last_change": 0}
    return base.join(changes, "path", "left").fillna(names)


def refactor_limits(files: DataFrame) -> DataFrame:
    """One row: ``busy, dense, costly``: the median momentum of changed files, upper quartiles of density and tokens."""
    measured = files.where(F.col("complexity") > 0)
    changed = F.when(F.col("changes") > 0, F.col("momentum"))
    return wide_values(measured, {"busy": (changed, 0.5), "dense": (F.col("density"), 0.75), "costly": (F.col("tokens"), 0.75)})


def refactor(files: DataFrame) -> DataFrame:
    """``files`` that have decisions, with ``recurring_tokens, churn_ratio, verdict``; the costliest first."""
    judged = files.where(F.col("complexity") > 0).crossJoin(F.broadcast(refactor_limits(files)))
    verdict = (
        F.when(F.col("changes") == 0, "inert")
        .when(~((F.col("momentum") >= F.col("busy")) & (F.col("changes") >= MIN_BUSY)), "quiet")
        .when(F.col("density") >= F.col("dense"), "refactor")
        .when(F.col("tokens") >= F.col("costly"), "split")
        .otherwise("watch")
    )
    ratio = F.when(F.col("code") > 0, F.col("churn") / F.col("code") * 100).otherwise(0.0)
    out = judged.withColumns({"recurring_tokens": F.col("tokens") * F.col("changes"), "churn_ratio": ratio, "verdict": verdict})
    return out.drop("busy", "dense", "costly").orderBy(F.desc("recurring_tokens"), path_order())


def rank_refactor(judged: DataFrame, sort: str = "cost") -> DataFrame:
    """Changed files by recurring cost, churn ratio (``churn``) or momentum (``recent``)."""
    key = {"cost": "recurring_tokens", "churn": "churn_ratio", "recent": "momentum"}[sort]
    return judged.where(F.col("changes") > 0).orderBy(F.desc(key), path_order())


def histogram(judged: DataFrame, verdicts: tuple[str, ...]) -> DataFrame:
    """One row with a count for each verdict, zeros included."""
    return judged.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts])


def agent_input(scored: DataFrame, contexts: DataFrame, duplication: DataFrame) -> DataFrame:
    """Files with density, concentration, tokens and their duplicated percentage, 0 if none."""
    base = scored.select("path", "code", "density", "concentration").join(contexts.select("path", "tokens"), "path")
    return base.join(duplication.select("path", F.col("percentage").alias("duplication")), "path", "left").fillna(0.0, ["duplication"])


def agent_limits(files: DataFrame) -> DataFrame:
    """One row: ``dense, large``: upper quartiles, but no less than their floors."""
    code = files.where(F.col("code") > 0)
    both = wide_values(code, {"d": (F.col("density"), 0.75), "t": (F.col("tokens"), 0.75)})
    return both.select(F.greatest(F.lit(float(MIN_DENSE)), "d").alias("dense"), F.greatest(F.lit(MIN_LARGE), "t").alias("large"))


def _risks() -> Column:
    dense = (F.col("density") >= F.col("dense")) & (F.col("density") > 0)
    found = [
        F.when(dense, "dense"),
        F.when((F.col("tokens") >= F.col("large")) & (F.col("tokens") > 0), "large"),
        F.when(F.col("duplication") >= DUPLICATED, "duplicated"),
        F.when(dense & (F.col("concentration") > 0) & (F.col("concentration") < DIFFUSE), "diffuse"),
    ]
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def agent(files: DataFrame) -> DataFrame:
    """``files`` that have code, with ``risks`` and ``verdict``; the riskiest first."""
    judged = files.where(F.col("code") > 0).crossJoin(F.broadcast(agent_limits(files))).withColumn("risks", _risks())
    verdict = F.when(F.size("risks") == 0, "safe").when(F.size("risks") == 1, "review").otherwise("human")
    return judged.withColumn("verdict", verdict).drop("dense", "large").orderBy(F.desc(F.size("risks")), F.desc("density"), path_order())
