"""The eight analyses over files, history and blame given as DataFrames.

``files`` has ``path, content, role``; ``commits`` has ``ord, time, email, name``; ``changes`` has ``ord, path, added,
deleted``; ``blame`` has ``path, line, time``; ``changed`` has ``path``. Each analysis returns DataFrames by name. Where
several of them need the same few numbers of each file, those are computed once and cut from their lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.functions import text
from copse.operators import complexity, context, counts, drift, duplication, history, scan, verdicts
from copse.session import cut


def _sources(files: DataFrame, include_all: bool, changed: DataFrame | None) -> DataFrame:
    return scan.included(scan.scoped(files, changed), include_all)


def _excluded(files: DataFrame, include_all: bool, changed: DataFrame | None) -> DataFrame:
    """``role, files, code`` of what an analysis leaves out."""
    rest = scan.scoped(files, changed).where(F.lit(False) if include_all else F.col("role") != "source")
    return scan.role_summary(scan.measured(scan.with_lines(rest), buckets=False))


def facts(lexed: DataFrame, rows: bool = True) -> DataFrame:
    """What the analyses of a file need, without its text: ``measured``, ``hits``, ``costs`` and the hashed code ``rows``.

    Cut from its lineage, so that each file is lexed once for an analysis that needs several of them.
    """
    more = {"hits": complexity.hits(), "costs": context.costs()} | ({"rows": duplication.hashed_lines()} if rows else {})
    return cut(scan.measured(lexed, buckets=False).withColumns(more).drop("content", "lines", "code_text", "code_lines", "kinds"))


def count(files: DataFrame, include_all: bool = False, changed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lines of code. Roles are counted over all files in scope."""
    roled = cut(scan.measured(scan.with_lines(scan.scoped(files, changed)), buckets=False).select("path", "role", "language", *counts.SUMS))
    chosen = scan.included(roled, include_all)
    return {
        "languages": counts.by_language(chosen), "totals": counts.totals(chosen), "distribution": counts.distribution(chosen),
        "concentration": counts.concentration(chosen), "largest": counts.largest(chosen), "roles": scan.role_summary(roled), "test_ratio": counts.test_ratio(roled),
    }


def cx(files: DataFrame, include_all: bool = False, changed: DataFrame | None = None, sort: str = "raw", min_lines: int = 1) -> dict[str, DataFrame]:
    """Complexity."""
    scored = complexity.complexity(scan.measured(scan.with_lines(_sources(files, include_all, changed))))
    return {"files": complexity.rank(scored, sort, min_lines), "excluded": _excluded(files, include_all, changed)}


def ctx(files: DataFrame, include_all: bool = False, changed: DataFrame | None = None, budget: int = 50_000) -> dict[str, DataFrame]:
    """The cost of reading."""
    costs = cut(context.context(scan.with_lines(_sources(files, include_all, changed))))
    return {
        "files": costs, "dirs": context.directories(costs), "totals": context.totals(costs), "navigability": context.navigability(costs),
        "worst_names": context.repeated_names(costs).limit(3), "tiers": context.budget_tiers(costs, budget), "excluded": _excluded(files, include_all, changed),
    }


def dup(
    files: DataFrame, min_lines: int = 5, min_copies: int = 2, include_all: bool = False, changed: DataFrame | None = None, cross_file_only: bool = False, renamed: bool = False
) -> dict[str, DataFrame]:
    """Duplication. A changed set limits what is reported, not where copies are looked for."""
    lexed = scan.with_lines(scan.included(files, include_all))
    rows = cut(duplication.code_rows(lexed))
    groups = cut(duplication.fragments(rows, min_lines, min_copies, cross_file_only))
    per_file = duplication.per_file(groups)
    if changed is not None:
        groups, per_file, rows = duplication.touching(groups, changed), scan.scoped(per_file, changed), scan.scoped(rows, changed)
    listed = duplication.listed(groups)
    out = {
        "clones": duplication.order(listed), "coded": duplication.order(duplication.with_code(listed, files)), "ranked": duplication.ranked(listed), "per_file": per_file, "shape": duplication.shape(groups),
        "headline": duplication.headline(per_file, rows),
    }
    if renamed:
        out["renamed"] = duplication.renamed_groups(lexed, groups, min_lines, min_copies)
    return out


def comments(
    files: DataFrame, blame: DataFrame | Callable[[DataFrame], DataFrame], include_all: bool = False, changed: DataFrame | None = None, years: float = 3, limit: int = 50
) -> dict[str, DataFrame]:
    """Comment drift of the files with most comments; files that are not blamed are left out.

    ``blame`` may be a function that is given the chosen files (``path, kinds``), so that no others need be blamed. Each
    file is lexed once, for which files to choose and for their lines; what is kept of it is a byte for each line.
    """
    lexed = scan.measured(scan.with_lines(_sources(files, include_all, changed)), buckets=False)
    known = cut(lexed.select("path", "comment", text.packed_kinds(F.col("kinds")).alias("packed")))
    chosen = cut(known.join(drift.candidates(known, limit), "path", "left_semi").select("path", text.unpacked_kinds(F.col("packed")).alias("kinds")))
    blamed = blame(chosen) if callable(blame) else blame
    lines = chosen.join(blamed.select("path").distinct(), "path", "left_semi").select("path", F.posexplode("kinds").alias("line", "kind")).withColumn("line", F.col("line") + 1)
    found = drift.drift(lines.join(blamed.select("path", F.col("line").cast("int").alias("line"), "time"), ["path", "line"], "left"), years)
    return {"files": drift.rank(found), "summary": drift.summary(found)}


def refactor(
    files: DataFrame, commits: DataFrame, changes: DataFrame, include_all: bool = False, changed: DataFrame | None = None, include_bots: bool = False, sort: str = "cost"
) -> dict[str, DataFrame]:
    """Which files to refactor."""
    known = facts(scan.with_lines(_sources(files, include_all, changed)), rows=False)
    kept = history.commits_of(commits, include_bots)
    inputs = cut(verdicts.refactor_input(known, context.context(known), history.file_changes(kept, changes)))
    judged = verdicts.refactor(inputs)
    return {
        "candidates": judged, "ranked": verdicts.rank_refactor(judged, sort), "limits": verdicts.refactor_limits(inputs),
        "verdicts": verdicts.histogram(judged, verdicts.REFACTOR), "excluded": _excluded(files, include_all, changed),
    }


def coupling(commits: DataFrame, changes: DataFrame, include_bots: bool = False, **limits: float) -> dict[str, DataFrame]:
    """Files that change together."""
    kept = changes.join(history.commits_of(commits, include_bots).select("ord"), "ord", "left_semi")
    pairs = history.coupling(kept, **limits)
    size = {k: v for k, v in limits.items() if k == "max_commit_size"}
    return {"pairs": pairs, "files": history.coupled_files(pairs), "commits": history.commit_counts(kept, **size)}


def agent(files: DataFrame, include_all: bool = False, changed: DataFrame | None = None, min_lines: int = 5) -> dict[str, DataFrame]:
    """Which files are risky to edit unattended. Copies are looked for in the files in scope."""
    known = facts(scan.with_lines(_sources(files, include_all, changed)))
    copies = duplication.per_file(duplication.fragments(duplication.code_rows(known), min_lines))
    inputs = cut(verdicts.agent_input(complexity.complexity(known), context.context(known), copies))
    judged = verdicts.agent(inputs)
    return {"candidates": judged, "limits": verdicts.agent_limits(inputs), "verdicts": verdicts.histogram(judged, verdicts.AGENT), "excluded": _excluded(files, include_all, changed)}
