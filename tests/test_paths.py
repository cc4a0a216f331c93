"""Globs, ignore rules, roles and configuration."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from copse.functions import paths
from copse.operators import scan
from copse.sources import config, tree


def on(spark, path, column):
    return spark.createDataFrame([(path,)], "p string").select(column(F.col("p"))).first()[0]


@pytest.mark.parametrize(
    ("glob", "path", "want"),
    [("*.min.js", "app.min.js", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("src/**", "src/a/b.ts", True), ("**/x", "x", False), ("**/x", "a/x", True), ("a/**/b", "a/b", False), ("[ab].ts", "a.ts", False), ("{a,b}", "a", False), ("a.ts", "axts", False), ("*.ts", "src/deep/a.ts", True), ("src/*.ts", "src/deep/a.ts", False)],
)
def test_globs(spark, glob, path, want):
    assert on(spark, path, lambda p: paths.matches_any(p, [glob])) is want


@pytest.mark.parametrize(("path", "want"), [("LICENSE", True), ("logo.PNG", True), ("yarn.lock", True), ("bundle.js.map", True), ("src/a.ts", False), ("node_modules/a.ts", True), ("a/dist/b.ts", True), ("dist.ts", False), ("x/gen/a.ts", True)])
def test_ignored(spark, path, want):
    c = config.Config(ignore_globs=["x/gen/**"])
    assert on(spark, path, lambda p: paths.ignored(p, c.ignore_dirs, c.ignore_files, c.ignore_extensions, c.ignore_globs)) is want


@pytest.mark.parametrize(
    ("path", "head", "want"),
    [
        ("src/a.ts", "", "source"), ("src/a.test.ts", "", "test"), ("src/a_spec.rb", "", "test"), ("test/a.ts", "", "test"), ("latest/a.ts", "", "source"), ("__mocks__/a.ts", "", "test"),
        ("vendor/test/a.ts", "", "vendored"), ("a/node_modules/b.min.js", "", "vendored"), ("a.min.js", "", "generated"), ("x.pb.go", "", "generated"), ("pb.go", "", "generated"), ("spb.go", "", "source"),
        ("docs/a.ts", "", "docs"), ("README.MD", "", "docs"), ("test/README.md", "", "test"), ("src/a.ts", "// Code generated by x. DO NOT EDIT.", "generated"), ("test/a.ts", "@generated", "generated"),
        ("src/a.ts", " " * 2048 + "@generated", "source"), ("src/doc", "", "source"),
    ],
)
def test_roles(spark, path, head, want):
    assert on(spark, path, lambda p: paths.role_of(p, F.lit(head))) == want


def test_role_precedence(spark):
    patterns, attributes = {"source": ["test/keep.ts"], "docs": ["*.story.ts"]}, {"generated": ["gen/**"], "vendored": ["gen/v/**"]}
    role = lambda path, head="": on(spark, path, lambda p: paths.role_of(p, F.lit(head), patterns, attributes))
    assert role("test/keep.ts", "@generated") == "source" and role("gen/a.story.ts") == "docs" and role("gen/v/a.ts") == "generated" and role("src/a.ts") == "source"


def test_scope_and_summary(spark):
    files = scan.with_roles(spark.createDataFrame([("a.ts", "x"), ("test/b.ts", "x\ny"), ("docs/c.md", "z")], "path string, content string"))
    summary = scan.role_summary(scan.measured(scan.with_lines(files))).collect()
    assert [tuple(r) for r in summary] == [("source", 1, 1), ("test", 1, 2), ("docs", 1, 1)]
    changed = spark.createDataFrame([("a.ts",), ("gone.ts",)], "path string")
    assert scan.scoped(files, changed).count() == 1 and scan.scoped(files, changed.limit(0)).count() == 0 and scan.scoped(files, None).count() == 3
    assert scan.included(files).count() == 1 and scan.included(files, True).count() == 3


def test_many_globs_equal_each_alone(spark):
    """Any mix of heads, tails, inner pieces, long pieces and globs without any, against every glob tried by itself."""
    rng = random.Random(3)
    part = lambda: rng.choice(["a", "b", "ab", "src", "x.ts", "é", "'q", "\\\\d", "$", "(", "long" * 9])
    globs = ["".join(rng.choice([part(), "/", "*", "**", "?", "."]) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    names = ["/".join("".join(part() for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(300)] + ["", "/", "a", "long" * 9]
    usable = [g for g in globs if not re.fullmatch(r"[*?./]*", g)]
    frame = spark.createDataFrame([(n,) for n in [*names, None]], "p string").repartition(4)
    for chosen in (usable[:40], usable, [*usable, "?", "??/a*"]):
        want = {n: any(re.match(paths.glob_pattern(g), x) for g in chosen for x in (n, n.rsplit("/", 1)[-1])) for n in names} | {None: None}
        got = {r.p: r.m for r in frame.select("p", paths.matches_any(F.col("p"), chosen).alias("m")).collect()}
        assert got == want and len(set(got.values())) > 2
    assert on(spark, "any/thing", lambda p: paths.matches_any(p, [*usable, "**"])) is True


def test_cost_of_a_path_does_not_grow_with_the_globs(spark):
    globs = [g for i in range(2500) for g in (f"pkg{i}/**", f"*.gen{i}.ts", f"**/mod{i}/*.py", f"lib{i}.js")]
    frame = spark.range(40_000).selectExpr("concat('pkg', id, 'x/mod', id % 5000, '/f', id % 7, if(id % 2 = 0, '.py', '.js')) AS p").repartition(8).cache()
    frame.count()

    def took(chosen):
        start = time.time()
        n = frame.where(paths.matches_any(F.col("p"), chosen)).count()
        return n, time.time() - start

    took(globs[:100])
    few, many = min(took(globs[:100])[1] for _ in range(2)), took(globs)
    assert many[0] == 10_000 and many[1] < 10 * few + 5  # one alternation of all takes minutes
    frame.unpersist()


GOOD = [{}, {"ignore": {}}, {"ignore": {"dirs": ["x"], "globs": ["*.z"]}}, {"unignore": {"dirs": ["dist"]}}, {"roles": {"test": ["a/**"]}}, {"respectGitignore": False}]
BAD = [
    (None, "expected object, received null"), ([], "expected object, received array"), ({"ignore": []}, "ignore: expected object, received array"), ({"ignore": {"dirs": "x"}}, "ignore.dirs: expected array, received string"),
    ({"ignore": {"dirs": [1]}}, "ignore.dirs.0: expected string, received number"), ({"respectGitignore": "no"}, "respectGitignore: expected boolean, received string"), ({"ignored": {}}, 'Unknown key "ignored" — did you mean "ignore"?'),
    ({"zzz": 1}, 'Unknown key "zzz"'), ({"unignore": {"globs": []}}, 'Unknown key "unignore: globs"'), ({"roles": {"source": None}}, "roles.source: expected array, received null"),
]


@pytest.mark.parametrize("data", GOOD)
def test_good_configurations(data):
    config.parse(data)


@pytest.mark.parametrize(("data", "issue"), BAD)
def test_bad_configurations(data, issue):
    with pytest.raises(config.ConfigError) as error:
        config.parse(data)
    assert error.value.issues[0].startswith(issue)


def test_issues_add_up_and_lists_merge():
    with pytest.raises(config.ConfigError) as error:
        config.parse({"ignore": {"dirs": [1, 2]}, "x": 1})
    assert len(error.value.issues) == 3
    c = config.parse({"ignore": {"dirs": ["mine", "dist"]}, "unignore": {"dirs": ["build"]}})
    assert c.ignore_dirs == [*[d for d in config.IGNORE_DIRS if d != "build"], "mine"]


def test_ignore_and_attributes_files():
    assert config.parse_gitignore("# c\n/build/\n!keep\n\nx.ts\r\n/y") == ["build/**", "x.ts", "y"]
    text = "# c\n*.pb.go linguist-generated\nlib/ linguist-vendored=true -linguist-documentation\nx linguist-generated=false\n"
    assert config.parse_gitattributes(text) == {"generated": ["*.pb.go"], "vendored": ["lib/**"], "docs": []}


def test_tree(spark, tmp_path):
    for name, body in {"src/__init__.py": b"x = 1\n", "src/.eslintrc.js": b"a", "node_modules/a.js": b"a", "b/bad.ts": b"\xff\n", "LICENSE": b"l", "gen/a.ts": b"g", "README.md": b"d", "x.log": b""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    (tmp_path / "link.ts").symlink_to(tmp_path / "gen/a.ts")
    (tmp_path / ".gitignore").write_text("/gen/\n")
    (tmp_path / config.CONFIG_FILE).write_text(json.dumps({"roles": {"test": ["b/**"]}}))
    got = {r.path: (r.content, r.role) for r in tree.read_tree(spark, str(tmp_path), config.load(str(tmp_path))).collect()}
    assert got == {"src/__init__.py": ("x = 1\n", "source"), "src/.eslintrc.js": ("a", "source"), "b/bad.ts": ("�\n", "test"), "README.md": ("d", "docs")}
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path), str(tmp_path / "none.json"))


def test_tree_source(spark, tmp_path, monkeypatch):
    """Directories are partitions; what is ignored or cannot fit a filter is not entered."""
    for path in ("a.py", "src/b.ts", "src/deep/er/c.ts", "src/deep/d.py", "node_modules/x/e.js", ".hidden/_f.ts", "other/g.ts"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(f"{path}\n" * 3)
    (tmp_path / "link").symlink_to(tmp_path / "src")
    (tmp_path / "empty").mkdir()
    root = str(tmp_path)
    found = tree.tree(spark, root, ["node_modules"])
    assert sorted(r.path for r in found.collect()) == [".hidden/_f.ts", "a.py", "other/g.ts", "src/b.ts", "src/deep/d.py", "src/deep/er/c.ts"]
    assert {r.content for r in found.where("path = 'a.py'").collect()} == {"a.py\n" * 3}
    parts = tree.tree(spark, root, [], chunk=4).where("path = 'src/b.ts'").orderBy("part").collect()
    assert [len(r.content) for r in parts] == [4] * 6 + [3] and "".join(r.content for r in parts) == "src/b.ts\n" * 3
    by = lambda condition: sorted(r.path for r in found.where(condition).collect())
    assert by("path LIKE 'src/%' AND path LIKE '%.ts'") == ["src/b.ts", "src/deep/er/c.ts"]
    assert by("path IN ('a.py', 'other/g.ts', 'no')") == ["a.py", "other/g.ts"] and by("path > 'src/deep/e'") == ["src/deep/er/c.ts"]
    reader = tree.TreeReader({"path": root, "ignore_dirs": '["node_modules"]'})
    rest = list(reader.pushFilters([tree.StringStartsWith(("path",), "src/deep/"), tree.StringEndsWith(("path",), ".py"), tree.EqualTo(("part",), 0)]))
    assert [f.attribute for f in rest] == [("part",)]
    entered = []
    real = tree._listed
    monkeypatch.setattr(tree, "_listed", lambda root, folder, ignore: entered.append(folder) or real(root, folder, ignore))
    assert [(d.path, d.deep) for d in reader.partitions()] == [("src/deep", False)]
    assert sorted(set(entered)) == ["", "src", "src/deep", "src/deep/er"]
    monkeypatch.setattr(tree, "PARTITIONS", 3)
    few = tree.TreeReader({"path": root}).partitions()
    assert sum(d.deep for d in few) >= 2 and sorted(r[0] for d in few for r in tree.TreeReader({"path": root}).read(d)) == sorted([*by("true"), "node_modules/x/e.js"])
    monkeypatch.undo()
    assert tree.tree(spark, str(tmp_path / "empty"), []).count() == 0
