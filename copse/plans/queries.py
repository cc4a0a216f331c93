"""The registered queries: each analysis over the given tables.

Files are made of ``pages`` (markup) and ``documents`` (nine other languages): some words of a document become comment
marks, so that every syntax has something to find. Commits are ``orders``; their changes are ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copse.functions import paths, text
from copse.operators import chunks, complexity, context, counts, drift, duplication, history, scan, verdicts
from copse.plans import analyses
from copse.session import cut
from copse.sources.git import parsed, resolve

EXTENSIONS = (".ts", ".py", ".sql", ".rb", ".md", ".json", ".css", ".lua", ".go")
#: What stands in for words of a document, in this order.
MARKS = ((". ", ".\n/* "), (", ", " */ "), (" the ", "\n# the "), (" of ", "\n-- of "))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table of texts, over all cores."""
    return scan.spread(_table(spark, sf_dir, name).select(key, *columns), key)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, content`` of documents."""
    content = F.col("text")
    for old, new in MARKS:
        content = F.replace(content, F.lit(old), F.lit(new))
    folder = F.when(F.col("doc_id") % 10 == 0, "tests/").when(F.col("doc_id") % 17 == 0, "vendor/").when(F.col("doc_id") % 19 == 0, "docs/").otherwise("")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), folder, F.lit("d"), F.expr("cast(doc_id div 97 as string)"), F.lit("/doc_"), (F.col("doc_id") % 97).cast("string"), ext)
    return _texts(spark, sf_dir, "documents", "doc_id", "text", "source", "lang").select("doc_id", path.alias("path"), content.alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content, role``."""
    pages = _texts(spark, sf_dir, "pages", "page_id", "html").select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return scan.with_roles(pages.unionByName(document_files(spark, sf_dir).drop("doc_id")))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, time, email, name``."""
    who = _table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("c_name"))
    name = F.when(F.col("o_custkey") % 29 == 0, F.concat("c_name", F.lit(" [bot]"))).otherwise(F.col("c_name"))
    email = F.when(F.col("o_custkey") % 31 == 0, "renovate@example.com").otherwise(F.concat(F.translate("c_name", "#", "."), F.lit("@example.com")))
    joined = _table(spark, sf_dir, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("ord"), F.unix_timestamp("o_orderdate").alias("time"), email.alias("email"), name.alias("name"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, path, added, deleted`` of files named after suppliers."""
    path = F.concat(F.lit("mod"), (F.col("l_suppkey") % 20).cast("string"), F.lit("/s"), F.col("l_suppkey").cast("string"), F.lit(".ts"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), path.alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, path, added, deleted`` of documents: a part's number is a document's."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("doc_id"), "l_quantity", "l_linenumber")
    joined = lines.join(document_files(spark, sf_dir).select("doc_id", "path"), "doc_id")
    return joined.select(F.col("l_orderkey").alias("ord"), "path", F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))


def blame(lines: DataFrame) -> DataFrame:
    """``path, line, kind, time`` of the lines of files: times from the line's number and the path's length."""
    rows = lines.select("path", F.posexplode("kinds").alias("line", "kind")).withColumn("line", F.col("line") + 1)
    return rows.withColumn("time", ((F.col("line") * 7919 + F.length("path") * 104729) % 400).cast("long") * 1_000_000)


def _lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.with_lines(files(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.with_lines(scan.included(files(spark, sf_dir)))


def _measured(spark: SparkSession, sf_dir: str, buckets: bool = False) -> DataFrame:
    return scan.measured(_sources(spark, sf_dir), buckets)


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The few numbers of each file that several aggregates need, computed once."""
    return cut(_measured(spark, sf_dir).select("path", "role", "language", *counts.SUMS))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def line_kinds(spark, sf_dir):
    return scan.measured(_lexed(spark, sf_dir), buckets=False).select("path", "language", "code", "comment", "blank", "total")


def chunk_kinds(spark, sf_dir):
    """The same sums of files that are cut after every 1,000 characters."""
    cut_up = chunks.chunked(files(spark, sf_dir).select("path", "content"), 1000)
    return chunks.measured(cut_up).select("path", "language", "code", "comment", "blank", "total", "complexity")


def count_by_language(spark, sf_dir):
    return counts.by_language(_measured(spark, sf_dir))


def count_totals(spark, sf_dir):
    return counts.totals(_measured(spark, sf_dir))


def size_distribution(spark, sf_dir):
    return counts.distribution(_numbers(spark, sf_dir))


def concentration(spark, sf_dir):
    return _rounded(counts.concentration(_numbers(spark, sf_dir)), "share")


def largest_files(spark, sf_dir):
    return counts.largest(_measured(spark, sf_dir))


def role_classify(spark, sf_dir):
    return files(spark, sf_dir).select("path", "role")


def role_summary(spark, sf_dir):
    return scan.role_summary(scan.measured(_lexed(spark, sf_dir), buckets=False))


def test_ratio(spark, sf_dir):
    return _rounded(counts.test_ratio(scan.measured(_lexed(spark, sf_dir), buckets=False)), "ratio")


GLOBS = ("src1*/en/**", "doc_?.go", "**/d1/*.sql", "*7.html")


def ignore_filter(spark, sf_dir):
    kept = ~paths.ignored(F.col("path"), ["vendor", "tests"], ["doc_1.py"], [".md", ".css"], GLOBS)
    return files(spark, sf_dir).where(kept).select("path")


def glob_match(spark, sf_dir):
    return files(spark, sf_dir).select("path", paths.matches_any(F.col("path"), GLOBS).alias("matched"))


#: Thousands of globs by a rule: folders, names within folders at any depth, and ends of names.
MANY_GLOBS = [g for i in range(0, 3000, 3) for g in (f"**/d{i}/**", f"*{i}.html", f"src*/*/d{i + 1}/*.ts", f"site/{i + 2}7.*", f"**/doc_{i}.?s*")]


def glob_many(spark, sf_dir):
    """Which files fit any of 5,000 globs."""
    return files(spark, sf_dir).select("path", paths.matches_any(F.col("path"), MANY_GLOBS).alias("matched"))


def complexity_rank(spark, sf_dir):
    out = complexity.rank(complexity.complexity(_measured(spark, sf_dir)), "raw", 3)
    return _rounded(out.select("path", "language", "complexity", "code", "density", "densest", "concentration"), "density", "concentration")


def complexity_density(spark, sf_dir):
    return _rounded(_measured(spark, sf_dir).select("path", complexity.density().alias("density")), "density")


def complexity_breakdown(spark, sf_dir):
    return _measured(spark, sf_dir, buckets=True).select("path", "branch", "loop", "bool", "complexity")


def densest_window(spark, sf_dir):
    return complexity.complexity(_measured(spark, sf_dir)).where("densest > 0").select("path", "densest")


def token_estimate(spark, sf_dir):
    return _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def context_files(spark, sf_dir):
    return context.context(_sources(spark, sf_dir))


def context_dirs(spark, sf_dir):
    return context.directories(context.context(_sources(spark, sf_dir)))


def context_totals(spark, sf_dir):
    return context.totals(context.context(_sources(spark, sf_dir)))


def navigability(spark, sf_dir):
    return context.navigability(files(spark, sf_dir))


def repeated_names(spark, sf_dir):
    return context.repeated_names(files(spark, sf_dir))


def budget_tiers(spark, sf_dir):
    return context.budget_tiers(context.context(_sources(spark, sf_dir)), 8000)


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed set: the documents of every seventh number."""
    return document_files(spark, sf_dir).where("doc_id % 7 = 0").select("path")


def diff_scope(spark, sf_dir):
    return scan.scoped(files(spark, sf_dir), _changed(spark, sf_dir)).select("path", "role")


def bot_filter(spark, sf_dir):
    return history.commits_of(commits(spark, sf_dir)).select("ord", "name")


def rename_pair(spark, sf_dir):
    name = F.concat(F.lit("src/{"), F.col("p_brand"), F.lit(" => "), F.col("p_type"), F.lit("}/f"), F.col("p_partkey").cast("string"))
    field = F.when(F.col("p_partkey") % 3 == 0, name).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" => /"), "p_type")).otherwise(F.concat(F.lit("{ => "), "p_brand", F.lit("}//x")))
    pair = history.rename_pair(field)
    return _table(spark, sf_dir, "part").select("p_partkey", pair["from"].alias("old_path"), pair["to"].alias("new_path"))


def file_changes(spark, sf_dir):
    return _rounded(history.file_changes(history.commits_of(commits(spark, sf_dir)), changes(spark, sf_dir)), "momentum")


def folded_changes(spark, sf_dir):
    """``file_changes`` of four batches of commits, each summed by itself and folded afterwards."""
    people, all_changes = history.commits_of(commits(spark, sf_dir)), changes(spark, sf_dir)
    parts = [history.partials(people.where(F.col("ord") % 4 == k), all_changes.where(F.col("ord") % 4 == k)) for k in range(4)]
    return _rounded(history.changes_of(*history.folded(*parts)), "momentum")


LOOSE = {"min_revisions": 10, "min_shared": 2, "min_strength": 0.3, "max_commit_size": 30}


def coupling_pairs(spark, sf_dir):
    return _rounded(history.coupling(changes(spark, sf_dir), **LOOSE), "strength")


def coupling_files(spark, sf_dir):
    return history.coupled_files(history.coupling(changes(spark, sf_dir), **LOOSE))


def coupling_commits(spark, sf_dir):
    return history.commit_counts(changes(spark, sf_dir), 5)


def comment_drift(spark, sf_dir):
    return drift.rank(drift.drift(blame(_sources(spark, sf_dir))))


def drift_summary(spark, sf_dir):
    return drift.summary(drift.drift(blame(_sources(spark, sf_dir))))


def drift_candidates(spark, sf_dir):
    return drift.candidates(_measured(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(duplication.code_rows(_sources(spark, sf_dir)))


def _fragments(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return duplication.fragments(_rows(spark, sf_dir), **options)


def _clones(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return duplication.listed(_fragments(spark, sf_dir, **options))


def _clones_of(sources: DataFrame) -> DataFrame:
    return duplication.listed(duplication.fragments(duplication.code_rows(sources)))


def _listed(groups: DataFrame, *more: Column) -> DataFrame:
    at = F.transform("fragments", lambda f: F.concat_ws(":", f["path"], f["start_line"].cast("string"), f["end_line"].cast("string")))
    return duplication.order(groups).select("line_count", "copies", F.array_join(at, ",").alias("fragments"), *more)


def dup_windows(spark, sf_dir):
    found = duplication.windows(_rows(spark, sf_dir))
    return found.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").groupBy("copies").agg(F.count("*").alias("classes"))


def dup_clones(spark, sf_dir):
    return _listed(_clones(spark, sf_dir))


def clone_code(spark, sf_dir):
    """The code of each group: the lines of its first fragment."""
    sources = cut(_sources(spark, sf_dir).select("path", "content", duplication.hashed_lines().alias("rows")))
    groups = duplication.with_code(_clones_of(sources), sources)
    return _listed(groups, F.array_join("code", "\n").alias("code"))


def dup_cross_file(spark, sf_dir):
    return _listed(_clones(spark, sf_dir, min_copies=3, cross_file_only=True))


def dup_ranked(spark, sf_dir):
    return duplication.ranked(_clones(spark, sf_dir)).select(F.array_join("files", ",").alias("files"), "copies", "line_count", "removable")


def dup_shape(spark, sf_dir):
    return _rounded(duplication.shape(cut(_fragments(spark, sf_dir))), "under_ten", "top_ten_share")


def dup_per_file(spark, sf_dir):
    return _rounded(duplication.per_file(_fragments(spark, sf_dir)), "percentage")


def dup_focus(spark, sf_dir):
    return _listed(duplication.listed(duplication.touching(cut(_fragments(spark, sf_dir)), _changed(spark, sf_dir))))


def dup_renamed(spark, sf_dir):
    return duplication.renamed_groups(_sources(spark, sf_dir), _fragments(spark, sf_dir))


def known_blame(lines: DataFrame) -> DataFrame:
    """``path, line, time`` of blame that lacks every eleventh line, and files whose name ends in 7."""
    return blame(lines).where("line % 11 <> 0 AND NOT path LIKE '%7.%'").select("path", "line", "time")


def clone_newest(spark, sf_dir):
    groups = duplication.listed(_fragments(spark, sf_dir))
    return duplication.clone_churn(groups, known_blame(_sources(spark, sf_dir)), 1 << 30)


def comment_blame(spark, sf_dir):
    return analyses.comments(files(spark, sf_dir), known_blame)["files"]


def rename_resolution(spark, sf_dir):
    """A history of fifty files, each renamed at every seventh of its changes."""
    orders = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.min("l_suppkey") % 50).alias("file"), F.sum("l_linenumber").alias("added"))
    rows = orders.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("l_orderkey")) - 1)
    name = lambda version: F.concat(F.lit("dir/f"), F.col("file").cast("string"), F.lit("_v"), version.cast("string"))
    now = F.floor(F.col("k") / 7)
    before = F.when((F.col("k") % 7 == 0) & (F.col("k") > 0), now - 1).otherwise(now)
    log = rows.select((-F.col("l_orderkey")).cast("int").alias("ord"), F.lit(0).alias("line"), F.col("added").cast("long").alias("added"), F.lit(0).cast("long").alias("deleted"), name(before).alias("from"), name(now).alias("to"))
    return resolve(log).select("path", "ord", "added")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, record``: orders as a log prints commits; every fifth change has no counts, and every third renames a file."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), "l_linenumber", "l_quantity", F.col("l_suppkey").cast("string").alias("s"))
    n = F.col("l_linenumber").cast("string")
    binary = F.col("l_quantity") % 5 == 0
    field = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("mod/{s"), "s", F.lit(" => t"), n, F.lit("}/f.ts"))).otherwise(F.concat(F.lit("mod/s"), "s", F.lit("/f.ts")))
    text_of = F.concat_ws("\t", F.when(binary, "-").otherwise(F.col("l_quantity").cast("long").cast("string")), F.when(binary, "-").otherwise(n), field)
    bodies = lines.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", text_of.alias("text")))), lambda x: x["text"]), "\n").alias("body"))
    heads = commits(spark, sf_dir).withColumn("head", F.concat_ws("\x1f", F.concat(F.lit("h"), F.col("ord").cast("string")), F.col("time").cast("string"), "email", "name"))
    return heads.join(bodies, "ord", "left").select("ord", F.concat_ws("\n", "head", "body").alias("record"))


def log_parsing(spark, sf_dir):
    heads, lines = parsed(_records(spark, sf_dir))
    sums = lines.groupBy("ord").agg(
        F.count("*").alias("files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("line").cast("int").alias("last"), F.min("from").alias("old_path"), F.max("to").alias("new_path")
    )
    return heads.join(sums, "ord", "left").select("ord", "hash", "time", "email", "name", "bot", F.coalesce("files", F.lit(0)).alias("files"), "added", "deleted", "last", "old_path", "new_path")


def _refactor(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return analyses.refactor(files(spark, sf_dir), commits(spark, sf_dir), document_changes(spark, sf_dir))


def refactor_verdicts(spark, sf_dir):
    out = _refactor(spark, sf_dir)["candidates"]
    return _rounded(out.select("path", "changes", "churn", "momentum", "recurring_tokens", "churn_ratio", "verdict"), "momentum", "churn_ratio")


def refactor_limits(spark, sf_dir):
    return _rounded(_refactor(spark, sf_dir)["limits"], "busy", "dense")


def agent_risk(spark, sf_dir):
    out = analyses.agent(files(spark, sf_dir))["candidates"]
    return _rounded(out.select("path", "density", "concentration", "tokens", "duplication", F.array_join("risks", ",").alias("risks"), "verdict"), "density", "concentration", "duplication")


def agent_verdicts(spark, sf_dir):
    return analyses.agent(files(spark, sf_dir))["verdicts"]


def size_label(spark, sf_dir):
    total = counts.totals(_measured(spark, sf_dir))
    return total.select("code", text.size_label(F.col("code")).alias("label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        line_kinds, chunk_kinds, count_by_language, count_totals, size_distribution, concentration, largest_files, role_classify, role_summary, test_ratio, ignore_filter, glob_match, glob_many,
        complexity_rank, complexity_density, complexity_breakdown, densest_window, token_estimate, context_files, context_dirs, context_totals, navigability, repeated_names,
        budget_tiers, diff_scope, bot_filter, rename_pair, file_changes, folded_changes, coupling_pairs, coupling_files, coupling_commits, comment_drift, drift_summary, drift_candidates,
        dup_windows, dup_clones, dup_cross_file, dup_ranked, dup_shape, dup_per_file, dup_focus, dup_renamed, clone_newest, comment_blame, rename_resolution, log_parsing, clone_code, refactor_verdicts, refactor_limits, agent_risk, agent_verdicts, size_label,
    )
}
