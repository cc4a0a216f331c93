"""Runs an analysis over a tree on disk: binds configuration, files, history, blame and the changed set."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.operators import drift, duplication, scan
from copse.plans import analyses
from copse.report import results
from copse.sources import config, git, tree

COMMANDS = ("count", "dup", "cx", "ctx", "comments", "refactor", "coupling", "agent")


@dataclass
class Options:
    """What the command line and the RPC server ask for."""

    include_all: bool = False
    diff: str | None = None
    config: str | None = None
    since: str = "2 years ago"
    include_bots: bool = False
    sort: str | None = None
    min_lines: int | None = None
    min_copies: int = 2
    cross_file: bool = False
    renamed: bool = False
    churn: bool = False
    snippets: int = 0
    years: float = 3
    scan: int = 50
    budget: int = 50_000
    limits: dict[str, float] = field(default_factory=dict)


@dataclass
class Outcome:
    """A result, or why there is none."""

    result: dict[str, Any] | None
    unavailable: str | None = None
    warning: str | None = None


def _changed(spark: SparkSession, root: str, ref: str | None) -> DataFrame | None:
    if ref is None:
        return None
    names = git.changed_files(root, ref)
    if names is None:
        raise ValueError(f"cannot compare with {ref}")
    return spark.createDataFrame([(n,) for n in names], "path string")


def run(spark: SparkSession, command: str, root: str, options: Options | None = None, limit: int | None = None, listed: results.Listed = results.rows) -> Outcome:
    """One analysis; ``limit`` bounds the rows of each listing, ``listed`` takes the listings (``report.sink``: written by tasks)."""
    o = options or Options()
    if command not in COMMANDS:
        raise ValueError(f"unknown analysis {command}")
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no such directory: {root}")
    warning = "history is shallow: older changes are missing" if command in ("refactor", "coupling", "comments") and git.repository_state(root) == "shallow" else None
    if command in ("refactor", "coupling"):
        log = git.read_log(spark, root, o.since)
        if log is None:
            return Outcome(None, "no-git")
        commits, changes = log
        if command == "coupling":
            return Outcome(results.coupling(analyses.coupling(commits, changes, o.include_bots, **o.limits), limit, listed), warning=warning)
    changed = _changed(spark, root, o.diff)
    files = tree.read_tree(spark, root, config.load(root, o.config)).persist()
    try:
        scope = {"include_all": o.include_all, "changed": changed}
        if command == "count":
            out = analyses.count(files, **scope)
        elif command == "dup":
            out = analyses.dup(files, o.min_lines or duplication.MIN_LINES, o.min_copies, cross_file_only=o.cross_file, renamed=o.renamed, **scope)
            result = results.dup(out, limit, listed)
            if o.snippets:
                result["code"] = results.snippets(out, o.snippets)
            if o.churn:
                paths = out["ranked"].limit(limit or 10).select(F.explode("files").alias("path")).distinct()
                result["churn"] = {r.path: r.newest for r in duplication.clone_churn(out["clones"], git.read_blame(paths, root), limit or 10).collect()}
            return Outcome(result)
        elif command == "cx":
            out = analyses.cx(files, sort=o.sort or "raw", min_lines=o.min_lines or 1, **scope)
        elif command == "ctx":
            out = analyses.ctx(files, budget=o.budget, **scope)
        elif command == "agent":
            out = analyses.agent(files, min_lines=o.min_lines or duplication.MIN_LINES, **scope)
        elif command == "refactor":
            out = analyses.refactor(files, commits, changes, include_bots=o.include_bots, sort=o.sort or "cost", **scope)
        else:
            lexed = scan.measured(scan.with_lines(scan.included(scan.scoped(files, changed), o.include_all)))
            chosen = drift.candidates(lexed, o.scan).persist()
            if chosen.isEmpty():
                return Outcome(None, "no-comments")
            blame = git.read_blame(chosen, root).persist()
            if blame.isEmpty():
                return Outcome(None, "no-git")
            out = analyses.comments(files, blame, years=o.years, limit=o.scan, **scope)
        return Outcome(results.RESULTS[command](out, limit, listed), warning=warning)
    finally:
        files.unpersist()
