"""Git history, blame, changed files and the state of a repository."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.operators.asof import latest
from copse.operators.history import is_bot, number, rename_pair
from copse.session import cut

_RECORD, _UNIT = "\x1e", "\x1f"
#: Commits that one task reads.
COMMITS = 500


def _git(root: str, *args: str) -> str | None:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def repository_state(root: str) -> str:
    """``ok``, ``shallow`` if history is cut off, or ``none``."""
    shallow = _git(root, "rev-parse", "--is-shallow-repository")
    return "none" if shallow is None else "shallow" if shallow.strip() == "true" else "ok"


def changed_files(root: str, ref: str) -> list[str] | None:
    """Files added, copied, changed or renamed since the merge base with a ref; None if there is no such ref."""
    out = _git(root, "diff", "--name-only", "-z", "--relative", "--diff-filter=ACMR", f"{ref}...HEAD")
    return None if out is None else [p for p in out.split("\0") if p]


def _selection(since: str) -> list[str]:
    return [f"--since={since}", "--no-merges"]


def log_text(root: str, since: str = "2 years ago", skip: int = 0, count: int = -1) -> str | None:
    """The log as text: records of header and line counts, newest first; None without a repository."""
    part = [f"--skip={skip}", f"--max-count={count}"]
    return _git(root, "log", *_selection(since), *part, "-M", "--numstat", "--relative", "--format=%x1e%H%x1f%ct%x1f%ae%x1f%an")


def read_log(spark: SparkSession, root: str, since: str = "2 years ago") -> tuple[DataFrame, DataFrame] | None:
    """Commits and changes of a repository's log, or None without one.

    Only the number of commits comes to the driver; tasks read ``COMMITS`` of them each, newest first, so the repository
    must be where all executors can read it.
    """
    number_of = _git(root, "rev-list", "--count", *_selection(since), "HEAD")
    if number_of is None:
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for skip in batch["id"]:
                records = (log_text(root, since, skip, COMMITS) or "").split(_RECORD)[1:]
                yield pd.DataFrame({"ord": range(skip, skip + len(records)), "record": records}).astype({"ord": "int64", "record": "str"})

    total = int(number_of)
    starts = spark.range(0, total, COMMITS, numPartitions=max(1, -(-total // COMMITS)))
    return parse_records(cut(starts.mapInPandas(run, "ord long, record string")))


def records(texts: DataFrame) -> DataFrame:
    """``ord, record`` of log texts that each fit a row; blank records do not count."""
    found = F.filter(F.split("text", _RECORD), lambda b: F.trim(F.translate(b, "\r\n\t", "   ")) != "")
    return texts.select(F.posexplode(found).alias("ord", "record"))


def parse_log(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parse_records`` of a whole log's text."""
    return parse_records(records(texts))


def parse_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``commits`` (``ord, hash, time, email, name, bot``) and ``changes`` (``ord, path, added, deleted``) of a log's records.

    ``ord`` counts from the newest. Paths are those that files have now: see ``resolve``.
    """
    commits, rows = parsed(records)
    return commits, resolve(rows)


def parsed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``parse_records``, with paths as the log has them: changes are ``ord, line, added, deleted, from, to``."""
    lines = records.select("ord", F.split("record", "\n").alias("lines"))
    head = F.split(F.element_at("lines", 1), _UNIT)
    part = lambda i: F.coalesce(F.try_element_at(head, F.lit(i)), F.lit(""))
    commits = lines.select("ord", part(1).alias("hash"), number(part(2)).alias("time"), part(3).alias("email"), part(4).alias("name"))
    commits = commits.withColumn("bot", is_bot(F.col("name"), F.col("email")))
    rows = lines.select("ord", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("line", "text"))
    fields = F.split("text", "\t", -1)
    rows = rows.where(F.size(fields) >= 3).select("ord", "line", number(fields[0]).alias("added"), number(fields[1]).alias("deleted"), rename_pair(fields[2]).alias("pair"))
    return commits, rows.select("ord", "line", "added", "deleted", "pair.from", "pair.to")


def _followed(rows: DataFrame, renames: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (``id, at, name``) as ``id, name, via``: the name that each has now, and the last rename that says so, or null.

    ``renames`` has ``id, at, name`` (the old one), ``names`` the name that each rename leads to (``id, now``). A name is
    looked up as of the row's place in the log, and so is what it leads to, until there is nothing newer or a name comes
    again.
    """
    old = renames.select("name").distinct()
    events = renames.select("name", "at", F.col("id").alias("hit"))
    state = rows.select("id", "at", "name", F.lit(None).cast("long").alias("via"), F.array().cast("array<string>").alias("seen"))
    done = None
    while True:
        # most names were never given up; only others are looked up
        able = state.join(old, "name", "left_semi").where(~F.array_contains("seen", F.col("name")))
        hit = latest(able, events, "name", "at", "hit").where("hit IS NOT NULL")
        met = cut(hit.join(names.select(F.col("id").alias("hit"), "now"), "hit").select("id", "at", F.col("now").alias("name"), F.col("hit").alias("via"), F.array_append("seen", F.col("name")).alias("seen")))
        left = state.join(met.select("id"), "id", "left_anti").select("id", "name", "via")
        done = left if done is None else done.unionByName(left)
        if met.isEmpty():
            return done
        state = met


def _doubled(pointers: DataFrame) -> DataFrame:
    """``id, end`` of ``id, via``: the end of each chain of pointers, found by joining pointers to themselves again and again."""
    now = cut(pointers.select("id", F.coalesce("via", "id").alias("end")))
    while True:
        further = now.select(F.col("id").alias("end"), F.col("end").alias("__end"))
        step = cut(now.join(further, "end").select("id", F.col("__end").alias("end"), (F.col("end") != F.col("__end")).alias("moved")))
        if step.where("moved").isEmpty():
            return step.select("id", "end")
        now = step.drop("moved")


def resolve(rows: DataFrame) -> DataFrame:
    """``ord, path, added, deleted`` of ``ord, line, added, deleted, from, to`` with every path as the file is named now.

    A rename says what older changes' paths became; the log is one stream, newest first. A name leads to another from one
    of its renames to the next older one, so a change finds the rename that holds for it by an as-of join, and renames
    find theirs in the same way. Chains of renames are followed to their ends by pointer doubling. A name at a chain's
    end may itself have been given up earlier in time than the chain began; such renames are pointed anew until none is
    left. No family of names is held together: all joins are by rename or dealt by name and place in the log.
    """
    numbered = rows.withColumn("id", F.monotonically_increasing_id())
    numbered = cut(numbered.withColumn("at", F.struct(F.col("ord").cast("long").alias("ord"), F.col("line").cast("long").alias("line"), "id")))
    renames = numbered.where(F.col("from") != F.col("to")).select("id", "at", F.col("from").alias("name"), F.col("to").alias("new"))
    if renames.isEmpty():
        return numbered.select("ord", F.col("to").alias("path"), "added", "deleted")
    asked = renames.select("id", "at", F.col("new").alias("name"))
    pointers = cut(latest(asked, renames.select("name", "at", F.col("id").alias("via")), "name", "at", "via").select("id", "via"))
    while True:
        ends = _doubled(pointers)
        names = cut(ends.join(renames.select(F.col("id").alias("end"), F.col("new").alias("now")), "end").select("id", "now"))
        again = cut(_followed(asked, renames, names).select("id", "via"))
        wrong = pointers.join(again.withColumnRenamed("via", "other"), "id").where("NOT via <=> other").select("id", "other")
        # another pointer to the same name changes nothing
        to = lambda side: names.select(F.col("id").alias(side), F.col("now").alias(f"{side}_now"))
        wrong = wrong.join(to("other"), "other", "left").join(names, "id").where("NOT other_now <=> now")
        if wrong.isEmpty():
            break
        pointers = again
    found = _followed(numbered.select("id", "at", F.col("to").alias("name")), renames, names)
    return numbered.join(found.select("id", F.col("name").alias("path")), "id").select("ord", "path", "added", "deleted")


def parse_blame(text: str) -> list[int]:
    """The author time of each line of a blame in porcelain form."""
    times, now = [], 0
    for line in text.split("\n"):
        if line.startswith("author-time "):
            now = int(line.split(" ", 1)[1])
        elif line.startswith("\t"):
            times.append(now)
    return times


def read_blame(paths: DataFrame, root: str) -> DataFrame:
    """``path, line, time`` of each line of the files in ``paths``; files that cannot be blamed are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                times = parse_blame(_git(root, "blame", "--line-porcelain", "--", path) or "")
                yield pd.DataFrame({"path": path, "line": range(1, len(times) + 1), "time": times}).astype({"path": "str", "line": "int64", "time": "int64"})

    return paths.select("path").repartition("path").mapInPandas(run, "path string, line long, time long")
