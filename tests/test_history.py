"""History, coupling, drift and verdicts."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from copse.functions import text
from copse.operators import asof, drift, history, verdicts
from copse.plans import analyses
from copse.sources import git

NOW = 1_700_000_000


def log_of(*commits):
    """Text of a log, newest first: (hash, time, email, name, [(added, deleted, field)])."""
    return "".join(f"\x1e{h}\x1f{t}\x1f{e}\x1f{n}\n\n" + "".join(f"{a}\t{d}\t{f}\n" for a, d, f in files) for h, t, e, n, files in commits)


def parsed(spark, *commits):
    commits_, changes = git.parse_log(spark.createDataFrame([(log_of(*commits),)], "text string"))
    return commits_, changes


@pytest.mark.parametrize(
    ("name", "email", "want"),
    [("renovate[bot]", "x@y", True), (" Some [BOT] ", "x@y", True), ("Abbot Robertson", "abbot@y", False), ("x", "dependabot[bot]@users", True), ("x", "BOT@y", True), ("x", "robot@y", False), ("x", "", False)],
)
def test_bots(spark, name, email, want):
    assert spark.createDataFrame([(name, email)], "n string, e string").select(history.is_bot(F.col("n"), F.col("e"))).first()[0] is want


@pytest.mark.parametrize(
    ("field", "old", "new"),
    [
        ("a.ts", "a.ts", "a.ts"), ("a.ts => b.ts", "a.ts", "b.ts"), ("src/{a => b}/f.ts", "src/a/f.ts", "src/b/f.ts"), ("{ => sub}/f.ts", "f.ts", "sub/f.ts"), ("src/{lib => }/f.ts", "src/lib/f.ts", "src/f.ts"),
        ("dir/{a.ts => b.ts}", "dir/a.ts", "dir/b.ts"), ("{a => b", "{a", "b"), ("a => b}", "a", "b}"), ("x{y}z", "x{y}z", "x{y}z"), ("{" * 6000 + "a => b", "{" * 6000 + "a", "b"),
    ],
)
def test_rename_pair(spark, field, old, new):
    assert tuple(spark.createDataFrame([(field,)], "f string").select(history.rename_pair(F.col("f"))).first()[0]) == (old, new)


def test_log(spark):
    commits, changes = parsed(
        spark, ("h1", NOW, "dev@x", "Dev", [(3, 1, "a.ts"), ("-", "-", "img.png")]), ("h2", "soon", "r@x", "Re [bot]", []), ("h3", NOW - 5, "d@x", "D", [(1, 1, "b.ts")])
    )
    assert [(r.hash, r.time, r.email, r.name, r.bot) for r in commits.orderBy("ord").collect()] == [("h1", NOW, "dev@x", "Dev", False), ("h2", 0, "r@x", "Re [bot]", True), ("h3", NOW - 5, "d@x", "D", False)]
    assert sorted(tuple(r) for r in changes.collect()) == [(0, "a.ts", 3, 1), (0, "img.png", 0, 0), (2, "b.ts", 1, 1)]
    assert parsed(spark)[0].count() == 0


def test_renames_are_followed(spark):
    _, changes = parsed(
        spark, ("4", 4, "", "", [(1, 1, "c.ts"), (9, 9, "z.ts")]), ("3", 3, "", "", [(1, 1, "b.ts => c.ts")]), ("2", 2, "", "", [(1, 1, "a.ts => b.ts")]), ("1", 1, "", "", [(1, 1, "a.ts")])
    )
    assert sorted(r.path for r in changes.collect()) == ["c.ts"] * 4 + ["z.ts"]
    back = parsed(spark, ("3", 3, "", "", [(1, 1, "b => a")]), ("2", 2, "", "", [(1, 1, "a => b")]), ("1", 1, "", "", [(1, 1, "a")]))[1]
    assert back.count() == 3  # there and back ends


def follow_all(rows):
    """Renames followed one row at a time, newest first."""
    now, out = {}, []
    for _, old, new in rows:
        seen, path = set(), new
        while path in now and path not in seen:
            seen.add(path)
            path = now[path]
        if old != new:
            now[old] = path
        out.append(path)
    return out


def test_renames_equal_a_walk_over_the_log(spark):
    """Names that are given up, taken again, swapped and chained, in any order."""
    rng = random.Random(2)
    names = [f"n{i}" for i in range(9)]
    rows = [(i // 3, old, rng.choice(names) if rng.random() < 0.25 else old) for i, old in enumerate(rng.choice(names) for _ in range(60))]
    df = spark.createDataFrame([(o, i % 3, i, 0, a, b) for i, (o, a, b) in enumerate(rows)], "ord int, line int, added long, deleted long, from string, to string")
    got = {r.added: r.path for r in git.resolve(df.repartition(5)).collect()}
    assert [got[i] for i in range(len(rows))] == follow_all(rows)


def test_a_long_chain_of_renames_takes_few_rounds(spark):
    df = spark.range(400).selectExpr("cast(id as int) ord", "0 line", "id added", "0L deleted", "concat('v', 400 - id - 1) from", "concat('v', 400 - id) to")
    assert git.resolve(df).select("path").distinct().collect() == [("v400",)]


def test_as_of_join(spark):
    """One key holds nearly all rows and spreads over many ranges; the last event before a range reaches into it."""
    rng = random.Random(4)
    keys = ["hot"] * 9 + ["b", "c"]
    events = [(rng.choice(keys), t, f"e{t}") for t in rng.sample(range(1000), 12)]
    rows = [(rng.choice(keys), rng.randint(-5, 1005), i) for i in range(400)] + [(None, 5, 400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.latest(spark.createDataFrame(rows, "k string, t int, n int"), spark.createDataFrame(events, "k string, t int, e string"), "k", "t", "e")
        assert got.columns == ["k", "t", "n", "e"]
        want = {n: max(((u, e) for q, u, e in events if q == k and u < t), default=(0, None))[1] for k, t, n in rows}
        assert {r.n: r.e for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert asof.latest(spark.createDataFrame(rows, "k string, t int, n int").limit(0), spark.createDataFrame(events, "k string, t int, e string"), "k", "t", "e").count() == 0


def test_decay(spark):
    commits, changes = parsed(spark, *[(str(i), 1000 - 100 * i, "", "", [(1, 1, f"{i}.ts"), (2, 0, "all.ts")]) for i in range(5)])
    got = {r.path: r for r in history.file_changes(commits, changes).collect()}
    assert got["4.ts"].momentum == 0.0625 and got["0.ts"].momentum == 1.0
    assert (got["all.ts"].changes, got["all.ts"].churn, got["all.ts"].last_change) == (5, 10, 1000)
    one = history.file_changes(*parsed(spark, ("1", 7, "", "", [(1, 1, "a"), (1, 1, "a")]))).first()
    assert (one.changes, one.momentum) == (2, 2.0)


def test_batches_of_commits_are_folded(spark):
    rng = random.Random(9)
    commits = [(i, rng.choice([0, 50, 1000 + 37 * i])) for i in range(60)]
    changes = [(rng.randrange(60), rng.choice("abc"), rng.randint(0, 9), 1) for _ in range(200)]
    frames = lambda keep: (spark.createDataFrame([c for c in commits if keep(c[0])], "ord long, time long"), spark.createDataFrame([c for c in changes if keep(c[0])], "ord long, path string, added long, deleted long"))
    parts = [history.partials(*frames(lambda o, k=k: o % 3 == k)) for k in range(3)]
    row = lambda r: (r.path, r.changes, r.churn, pytest.approx(r.momentum, abs=1e-9), r.last_change)
    want = sorted(map(row, history.file_changes(*frames(lambda o: True)).collect()), key=lambda r: r[0])
    for order in ((0, 1, 2), (2, 0, 1)):
        stored = history.folded(history.folded(parts[order[0]], parts[order[1]]), parts[order[2]])
        assert sorted((tuple(r) for r in history.changes_of(*stored).select("path", "changes", "churn", "momentum", "last_change").collect())) == want
    later = {r.path: r.momentum for r in history.changes_of(*stored, now=10_000, half_life=100.0).collect()}
    assert later["a"] == pytest.approx(sum(0.5 ** ((10_000 - commits[o][1]) / 100) for o, p, *_ in changes if p == "a"), abs=1e-9)


def test_coupling(spark):
    both = [(f"j{i}", i, "", "", [(1, 1, "b.ts"), (1, 1, "a.ts"), (1, 1, "a.ts")]) for i in range(3)]
    solo = [(f"s{i}", i, "", "", [(1, 1, "a.ts")]) for i in range(3)]
    sweep = [("w", 9, "", "", [(1, 1, f"{i}.ts") for i in range(40)]), ("e", 9, "", "", [])]
    _, changes = parsed(spark, *both, *solo, *sweep)
    row = history.coupling(changes, 1, 1, 0).first()
    assert (row.a, row.b, row.shared, row.revisions_a, row.revisions_b, round(row.strength, 2)) == ("a.ts", "b.ts", 3, 6, 3, 66.67)
    assert history.commit_counts(changes).first().asDict() == {"commits": 6, "skipped": 1}
    assert [tuple(r) for r in history.coupled_files(history.coupling(changes, 1, 1, 0)).collect()] == [("a.ts", 6, 3, 1), ("b.ts", 3, 3, 1)]
    assert history.coupling(changes, 3, 3, 66.6).count() == 1 and history.coupling(changes, 4, 1, 0).count() == 0 and history.coupling(changes, 1, 4, 0).count() == 0
    assert history.coupling(changes, 1, 1, 66.7).count() == 0 and history.coupling(changes).count() == 0


YEAR = 365 * 86400


@pytest.mark.parametrize(
    ("kinds", "times", "want"),
    [
        ("cx", [0, 5 * YEAR], (1, 1)), ("xc", [0, 0], None), ("cx", [5 * YEAR, 0], (1, 0)), ("cx", [0, 3 * YEAR], (1, 0)), ("cx", [0, 3 * YEAR + 1], (1, 1)), ("ccx", [0, 3 * YEAR, 5 * YEAR], (1, 0)),
        ("cbx", [0, 0, 5 * YEAR], (1, 1)), ("c" + "x" * 11, [0] * 11 + [5 * YEAR], (1, 0)), ("c" + "x" * 10, [0] * 10 + [5 * YEAR], (1, 1)), ("cxcx", [0, 0, 5 * YEAR, 5 * YEAR], (2, 1)), ("cc", [0, 0], None),
        ("cx", [None, 5 * YEAR], (1, 1)), ("cx", [0, None], (1, 0)), ("cbcx", [0, 0, 5 * YEAR, 5 * YEAR], (2, 1)),
    ],
)
def test_drift(spark, kinds, times, want):
    names = {"c": "comment", "x": "code", "b": "blank"}
    rows = [("f", i + 1, names[k], t) for i, (k, t) in enumerate(zip(kinds, times, strict=True))]
    got = drift.rank(drift.drift(spark.createDataFrame(rows, "path string, line int, kind string, time long"))).first()
    assert (got and (got.blocks, got.drifted)) == want


def test_drift_order_and_summary(spark):
    rows = spark.createDataFrame([("a", 4, 1), ("b", 2, 2), ("c", 4, 4), ("d", 0, 0)], "path string, blocks long, drifted long")
    assert [r.path for r in drift.rank(rows).collect()] == ["c", "b", "a"]
    assert tuple(drift.summary(rows).first()) == (3, 10, 7)


def test_comments_lex_each_file_once_and_blame_the_chosen_alone(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(content):
        read.add(1)
        return content

    counted = F.udf(passed, "string").asNondeterministic()
    # d0 has no comment, d1 one, and so on; the two of d4 have one path, of which one is blank
    texts = [(f"d{n}.ts", "// a\nx\n\n" * n + "y\n", "source") for n in range(6)] + [("d4.ts", "\n\n", "source"), ("t.ts", "// a\nx\n" * 9, "test")]
    files = spark.createDataFrame(texts, "path string, content string, role string").withColumn("content", counted("content")).where(F.spark_partition_id() >= 0)
    asked = []

    def blamed(chosen):
        asked.extend(sorted(r.path for r in chosen.collect()))
        lines = chosen.select("path", F.posexplode("kinds").alias("line", "kind")).where("path <> 'd3.ts'")
        return lines.groupBy("path", (F.col("line") + 1).alias("line")).agg(F.max(F.when(F.col("kind") == "code", 5 * YEAR).otherwise(0)).alias("time"))

    out = analyses.comments(files, blamed, limit=3)
    assert [tuple(r) for r in out["files"].collect()] == [("d5.ts", 5, 5), ("d4.ts", 4, 4)]
    assert tuple(out["summary"].first()) == (2, 9, 9)
    assert asked == ["d3.ts", "d4.ts", "d4.ts", "d5.ts"] and read.value == len(texts)
    table = blamed(spark.createDataFrame([(f"d{n}.ts", ["comment", "code", "blank"] * n + ["code"]) for n in range(6)], "path string, kinds array<string>"))
    assert [tuple(r) for r in analyses.comments(files, table, limit=3)["files"].collect()] == [("d5.ts", 5, 5), ("d4.ts", 4, 4)]


def test_kinds_are_packed_and_unpacked(spark):
    rows = spark.createDataFrame([(["code", "blank", "comment", "code"],), ([],), (None,)], "kinds array<string>")
    packed = rows.select("kinds", text.packed_kinds(F.col("kinds")).alias("packed"))
    assert packed.schema["packed"].dataType.elementType.typeName() == "byte"
    assert all(r[0] == r[1] for r in packed.select("kinds", text.unpacked_kinds(F.col("packed"))).collect())


REFACTOR = "path string, complexity long, code long, density double, tokens long, changes long, churn long, momentum double, last_change long"


def test_refactor_verdicts(spark):
    rows = [("refactor", 50, 100, 50.0, 100, 9, 10, 9.0, 1), ("split", 5, 100, 5.0, 9000, 8, 10, 8.0, 1), ("watch", 5, 100, 5.0, 100, 7, 10, 8.0, 1), ("quiet", 5, 100, 5.0, 9999, 1, 10, 0.1, 1), ("inert", 5, 0, 60.0, 100, 0, 0, 0.0, 0), ("none", 0, 9, 0.0, 9, 9, 9, 9.0, 1)]
    files = spark.createDataFrame(rows, REFACTOR)
    got = verdicts.refactor(files).collect()
    assert {r.path: r.verdict for r in got} == {v: v for v in verdicts.REFACTOR}
    assert [r.path for r in got][:3] == ["split", "quiet", "refactor"] and got[0].recurring_tokens == 72000 and {r.path: r.churn_ratio for r in got}["inert"] == 0
    assert [r.path for r in verdicts.rank_refactor(verdicts.refactor(files), "recent").collect()] == ["refactor", "split", "watch", "quiet"]
    assert verdicts.histogram(verdicts.refactor(files), verdicts.REFACTOR).first().asDict() == dict.fromkeys(verdicts.REFACTOR, 1)
    assert verdicts.refactor(files.limit(0)).count() == 0


def test_agent_verdicts(spark):
    rows = [("safe", 10, 1.0, 50.0, 100, 0.0), ("dense", 10, 60.0, 50.0, 100, 0.0), ("both", 10, 60.0, 50.0, 9000, 0.0), ("diffuse", 10, 60.0, 14.9, 100, 0.0), ("copied", 10, 1.0, 50.0, 100, 20.0), ("empty", 0, 99.0, 1.0, 9999, 99.0)]
    files = spark.createDataFrame(rows, "path string, code long, density double, concentration double, tokens long, duplication double")
    got = {r.path: (r.risks, r.verdict) for r in verdicts.agent(files).collect()}
    assert got == {"safe": ([], "safe"), "dense": (["dense"], "review"), "both": (["dense", "large"], "human"), "diffuse": (["dense", "diffuse"], "human"), "copied": (["duplicated"], "review")}
    assert tuple(verdicts.agent_limits(files.where("path = 'safe'")).first()) == (10.0, 2000)


def run(root, *args, when=NOW):
    env = {"GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000", "HOME": str(root), "PATH": "/usr/bin:/bin:/usr/local/bin", "GIT_CONFIG_NOSYSTEM": "1"}
    subprocess.run(["git", "-C", str(root), "-c", "user.name=Dev", "-c", "user.email=dev@example.com", *args], check=True, capture_output=True, env=env)


def test_a_real_repository(spark, tmp_path):
    import time

    now = int(time.time())
    run(tmp_path, "init", "-q", "-b", "main")
    (tmp_path / "a.ts").write_text("// old\nx\n")
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-qm", "1", when=now - 4 * YEAR)
    (tmp_path / "a.ts").write_text("// old\nif (y) {}\n")
    (tmp_path / "b.ts").write_text("z\n")
    run(tmp_path, "add", ".")
    run(tmp_path, "commit", "-qm", "2", when=now - 100)
    run(tmp_path, "mv", "b.ts", "c.ts")
    run(tmp_path, "commit", "-qm", "3", when=now - 50)
    root = str(tmp_path)
    assert git.repository_state(root) == "ok" and git.changed_files(root, "HEAD~1") == ["c.ts"] and git.changed_files(root, "nope") is None
    commits, changes = git.read_log(spark, root)
    assert commits.count() == 2 and sorted((r.path, r.added) for r in changes.collect()) == [("a.ts", 1), ("c.ts", 0), ("c.ts", 1)]
    files = spark.createDataFrame([("a.ts", "// old\nif (y) {}\n", "source"), ("c.ts", "z\n", "source")], "path string, content string, role string")
    blame = git.read_blame(files, root)
    assert blame.where("path = 'a.ts'").count() == 2
    assert [tuple(r) for r in analyses.comments(files, blame)["files"].collect()] == [("a.ts", 1, 1)]
    assert [r.verdict for r in analyses.refactor(files, commits, changes)["candidates"].collect()] == ["quiet"]
    (tmp_path / "plain").mkdir()
    assert git.read_log(spark, "/proc") is None and git.repository_state("/proc") == "none"
