"""What a version history says about files: changes, churn, recency, and files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: accounts of machines
BOT_ACCOUNTS = [
    "dependabot", "renovate", "github-actions", "greenkeeper", "snyk-bot", "imgbot", "allcontributors", "mergify", "codecov", "semantic-release-bot",
    "bot",
]
#: Limits of coupling: changes of either file, joint changes, percentage, and files of a commit.
MIN_REVISIONS, MIN_SHARED, MIN_STRENGTH, MAX_COMMIT_SIZE = 10, 10, 50, 30


def is_bot(name: Column, email: Column) -> Column:
    """Whether an author is a machine: a name that ends in ``[bot]``, or an account that is known."""
    local = F.regexp_replace(F.substring_index(F.lower(email), "@", 1), r"\[bot\]$", "")
    return F.endswith(F.trim(F.lower(name)), F.lit("[bot]")) | local.isin(BOT_ACCOUNTS)


def commits_of(commits: DataFrame, include_bots: bool = False) -> DataFrame:
    """The commits of people, or all."""
    return commits if include_bots else commits.where(~is_bot(F.col("name"), F.col("email")))


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/", "")


def rename_pair(field: Column) -> Column:
    """A struct (from, to) of a path field: ``a => b``, ``dir/{a => b}`` or ``{a => b}/file``; else both the field.

    Found by plain searches; no pattern can backtrack over a crafted name.
    """
    arrow = F.instr(field, " => ")
    before, after = F.substring(field, F.lit(1), arrow - 1), F.substring(field, arrow + 4, F.length(field))
    back = F.instr(F.reverse(before), "{")
    close = F.instr(after, "}")
    prefix = F.substring(before, F.lit(1), F.length(before) - back)
    old = F.substring(before, F.length(before) - back + 2, F.length(before))
    new, suffix = F.substring(after, F.lit(1), close - 1), F.substring(after, close + 1, F.length(after))
    braced = F.struct(_clean(F.concat(prefix, old, suffix)).alias("from"), _clean(F.concat(prefix, new, suffix)).alias("to"))
    plain = F.struct(_clean(before).alias("from"), _clean(after).alias("to"))
    same = F.struct(field.alias("from"), field.alias("to"))
    return F.when(arrow == 0, same).when((back == 0) | (close == 0), plain).otherwise(braced)


def number(value: Column) -> Column:
    """A count of lines; anything that is no number counts as 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0))


def half_life(commits: DataFrame) -> DataFrame:
    """One row: ``now, half_life``: the newest time above 0, and a quarter of the span to the oldest."""
    return commits.where("time > 0").agg(F.coalesce(F.max("time"), F.lit(0)).alias("now"), F.coalesce((F.max("time") - F.min("time")) / 4, F.lit(0.0)).alias("half_life"))


def file_changes(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """``path, changes, churn, momentum, last_change`` from ``commits`` (``ord, time``) and ``changes`` (``ord, path, added, deleted``).

    A change weighs half as much for every half-life it is older than the newest.
    """
    rows = changes.join(commits.select("ord", "time"), "ord").crossJoin(F.broadcast(half_life(commits)))
    weight = F.when(F.col("half_life") == 0, 1.0).otherwise(F.pow(F.lit(0.5), (F.col("now") - F.col("time")) / F.when(F.col("half_life") != 0, F.col("half_life"))))
    # summed as decimals, so that the sum does not depend on the order in which tasks finish
    momentum = F.sum(weight.cast("decimal(28, 15)")).cast("double")
    return rows.groupBy("path").agg(
        F.count("*").alias("changes"), F.sum(F.col("added") + F.col("deleted")).alias("churn"), momentum.alias("momentum"), F.max("time").alias("last_change")
    )


def partials(commits: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a batch of commits adds to ``file_changes``: ``path, time, changes, churn``, and one row ``oldest, newest``.

    Both merge: see ``folded``. Weights are left out, since they depend on the newest time and the half-life of all
    commits, those of later batches included.
    """
    rows = changes.join(commits.select("ord", "time"), "ord").groupBy("path", "time")
    times = commits.where("time > 0").agg(F.min("time").alias("oldest"), F.max("time").alias("newest"))
    return rows.agg(F.count("*").alias("changes"), F.sum(F.col("added") + F.col("deleted")).alias("churn")), times


def folded(*parts: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Partials of several batches as one; in any order and grouping."""
    sums, times = parts[0]
    for more, other in parts[1:]:
        sums, times = sums.unionByName(more), times.unionByName(other)
    return sums.groupBy("path", "time").agg(F.sum("changes").alias("changes"), F.sum("churn").alias("churn")), times.agg(F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def changes_of(sums: DataFrame, times: DataFrame, now: int | None = None, half_life: float | None = None) -> DataFrame:
    """``file_changes`` from partials; ``now`` and ``half_life`` are those of all commits unless they are given."""
    newest = F.coalesce("newest", F.lit(0)) if now is None else F.lit(now)
    life = F.coalesce((F.col("newest") - F.col("oldest")) / 4, F.lit(0.0)) if half_life is None else F.lit(float(half_life))
    rows = sums.crossJoin(F.broadcast(times.select(newest.alias("now"), life.alias("half_life"))))
    weight = F.when(F.col("half_life") == 0, 1.0).otherwise(F.pow(F.lit(0.5), (F.col("now") - F.col("time")) / F.when(F.col("half_life") != 0, F.col("half_life"))))
    momentum = F.sum((weight * F.col("changes")).cast("decimal(28, 15)")).cast("double")
    return rows.groupBy("path").agg(F.sum("changes").alias("changes"), F.sum("churn").alias("churn"), momentum.alias("momentum"), F.max("time").alias("last_change"))


def _sized(changes: DataFrame) -> DataFrame:
    """The different paths of each commit, with their number."""
    paths = changes.select("ord", "path").distinct()
    return paths.join(paths.groupBy("ord").agg(F.count("*").alias("size")), "ord")


def commit_counts(changes: DataFrame, max_commit_size: int = MAX_COMMIT_SIZE) -> DataFrame:
    """One row: ``commits, skipped``: commits that count, and those with too many files."""
    sizes = changes.select("ord", "path").distinct().groupBy("ord").agg(F.count("*").alias("size"))
    return sizes.agg(F.count_if(F.col("size") <= max_commit_size).alias("commits"), F.count_if(F.col("size") > max_commit_size).alias("skipped"))


def revisions(changes: DataFrame, max_commit_size: int = MAX_COMMIT_SIZE) -> DataFrame:
    """``path, revisions``: commits of bounded size that hold the path."""
    return _sized(changes).where(F.col("size") <= max_commit_size).groupBy("path").agg(F.count("*").alias("revisions"))


def coupling(
    changes: DataFrame, min_revisions: int = MIN_REVISIONS, min_shared: int = MIN_SHARED, min_strength: float = MIN_STRENGTH, max_commit_size: int = MAX_COMMIT_SIZE
) -> DataFrame:
    """``a, b, shared, revisions_a, revisions_b, strength`` of files that change together; the strongest first.

    The bound on a commit's files also bounds its pairs. Files with too few revisions leave before pairs are made:
    no pair of theirs could count.
    """
    sized = _sized(changes).where(F.col("size") <= max_commit_size)
    revised = sized.groupBy("path").agg(F.count("*").alias("revisions")).where(F.col("revisions") >= min_revisions)
    members = sized.join(revised, "path").groupBy("ord").agg(F.sort_array(F.collect_set(F.struct("path", "revisions"))).alias("m"))
    inner = lambda x, i: F.transform(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("x"), y.alias("y")))
    pairs = members.where(F.size("m") > 1).select(F.explode(F.flatten(F.transform("m", inner))).alias("p"))
    counted = pairs.groupBy(F.col("p.x.path").alias("a"), F.col("p.y.path").alias("b"), F.col("p.x.revisions").alias("revisions_a"), F.col("p.y.revisions").alias("revisions_b")).agg(
        F.count("*").alias("shared")
    )
    strength = F.col("shared") / ((F.col("revisions_a") + F.col("revisions_b")) / 2) * 100
    kept = counted.where(F.col("shared") >= min_shared).withColumn("strength", strength).where(F.col("strength") >= min_strength)
    out = kept.select("a", "b", "shared", "revisions_a", "revisions_b", "strength")
    return out.orderBy(F.desc("strength"), F.desc("shared"), F.expr("a COLLATE UNICODE"), F.expr("b COLLATE UNICODE"))


def coupled_files(pairs: DataFrame) -> DataFrame:
    """``path, revisions, sum_of_coupling, partners`` of the files in pairs; the most coupled first."""
    ends = F.array(F.struct(F.col("a").alias("path"), F.col("revisions_a").alias("revisions")), F.struct(F.col("b").alias("path"), F.col("revisions_b").alias("revisions")))
    out = pairs.select(F.inline(ends), "shared").groupBy("path", "revisions").agg(F.sum("shared").alias("sum_of_coupling"), F.count("*").alias("partners"))
    return out.orderBy(F.desc("sum_of_coupling"), F.expr("path COLLATE UNICODE"))
