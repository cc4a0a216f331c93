"""Duplicated blocks: the scenarios of the contract, and random files against brute force."""

import random

import pytest

from copse.functions import text
from copse.operators import duplication, scan
from copse.plans import analyses


def lexed(spark, files):
    return scan.with_lines(spark.createDataFrame([(p, "\n".join(x)) for p, x in files.items()], "path string, content string"))


def found(spark, files, *args, normalizer=text.normalize_line, **options):
    rows = duplication.code_rows(lexed(spark, files), normalizer)
    groups = duplication.clones(rows, *args, **options)
    return [(r.line_count, [(f.path, f.start_line, f.end_line) for f in r.fragments]) for r in duplication.order(groups).collect()], groups, rows


def block(name, n):
    return [f"{name}{i}" for i in range(1, n + 1)]


SAME = ["same"] * 7
SCENARIOS = {
    "two files": ({"a.ts": block("l", 6), "b.ts": block("l", 6)}, (5,), [(6, [("a.ts", 1, 6), ("b.ts", 1, 6)])]),
    "short": ({"a.ts": block("x", 3), "b.ts": block("x", 3)}, (5,), []),
    "within a file": ({"a.ts": [*block("p", 5), "u1", "u2", *block("p", 5)]}, (5,), [(5, [("a.ts", 1, 5), ("a.ts", 8, 12)])]),
    "three copies": ({f: block("m", 5) for f in ("a.ts", "b.ts", "c.ts")}, (5,), [(5, [("a.ts", 1, 5), ("b.ts", 1, 5), ("c.ts", 1, 5)])]),
    "maximal": ({"a.ts": block("e", 8), "b.ts": block("e", 8)}, (5,), [(8, [("a.ts", 1, 8), ("b.ts", 1, 8)])]),
    "overlaps are one": ({"a.ts": SAME, "b.ts": SAME}, (5,), [(7, [("a.ts", 1, 7), ("b.ts", 1, 7)])]),
    "one region is no clone": ({"a.ts": ["same"] * 12}, (5,), []),
    "weights": ({"a.ts": [*block("g", 6), "xa", *block("s", 4)], "b.ts": [*block("g", 6), "xb", *block("s", 4)], "c.ts": block("s", 4)}, (4,), [(6, [("a.ts", 1, 6), ("b.ts", 1, 6)]), (4, [("a.ts", 8, 11), ("b.ts", 8, 11), ("c.ts", 1, 4)])]),
    "blanks and comments inside": ({"a.ts": ["a1", "", "a2", "// c", "a3", "a4", "a5"], "b.ts": ["  a1", "a2 ", "a3", "a4", "a5"]}, (5,), [(5, [("a.ts", 1, 7), ("b.ts", 1, 5)])]),
    "nested": ({"a.ts": block("n", 10), "b.ts": block("n", 10), "c.ts": block("n", 5)}, (5,), [(10, [("a.ts", 1, 10), ("b.ts", 1, 10)]), (5, [("a.ts", 1, 5), ("b.ts", 1, 5), ("c.ts", 1, 5)])]),
    "nested twice": ({"a.ts": block("n", 7), "b.ts": block("n", 7), "c.ts": block("n", 6), "d.ts": block("n", 5)}, (5,), [(5, [(f"{f}.ts", 1, 5) for f in "abcd"]), (6, [(f"{f}.ts", 1, 6) for f in "abc"]), (7, [(f"{f}.ts", 1, 7) for f in "ab"])]),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenarios(spark, name):
    files, args, want = SCENARIOS[name]
    got, _, _ = found(spark, files, *args)
    assert sorted(got) == sorted(want)


def test_order_and_copies(spark):
    files = {"t1.ts": block("t", 5), "t2.ts": block("t", 5), "t3.ts": block("t", 5), "p1.ts": block("q", 5), "p2.ts": block("q", 5)}
    got, groups, rows = found(spark, files, 5, 2)
    assert [len(f) for _, f in got] == [3, 2]
    per_file = duplication.per_file(groups)
    assert per_file.count() == 5 and duplication.headline(per_file, rows).first().duplicated_lines == 25
    got, groups, rows = found(spark, files, 5, 3)
    assert len(got) == 1 and duplication.headline(duplication.per_file(groups), rows).first().asDict() == {"total_lines": 25, "duplicated_lines": 15, "percentage": 60.0}


def test_nothing(spark):
    got, groups, rows = found(spark, {"a.ts": ["x"]}, 5)
    assert got == [] and duplication.per_file(groups).count() == 0
    assert duplication.shape(groups).first().asDict() == {"groups": 0, "removable": 0, "max_lines": 0, "under_ten": 0.0, "within_file": 0, "same_directory": 0, "same_package": 0, "cross_package": 0, "median_lines": 0, "top_ten_share": 0.0}
    empty = {"e.ts": []}
    assert found(spark, empty, 5)[0] == []


def test_options_and_shape(spark):
    b = block("a", 5)
    inside = {"a.ts": [*b, "b()", *b]}
    assert len(found(spark, inside, 5)[0]) == 1 and found(spark, inside, 5, cross_file_only=True)[0] == []
    one = {"a.ts": [f"const {n} = f({i});" for i, n in enumerate(("one", "two", "three"))], "b.ts": [f"const {n} = f({i});" for i, n in enumerate(("x", "y", "z"))]}
    assert found(spark, one, 3)[0] == [] and len(found(spark, one, 3, normalizer=text.normalize_renamed)[0]) == 1
    _, groups, _ = found(spark, one, 3)
    assert duplication.renamed_groups(lexed(spark, one), groups, 3).first()[0] == 1
    _, groups, _ = found(spark, {"p/q/a.ts": b, "p/q/x/b.ts": b, "p/q/c.ts": block("c", 12), "p/q/d.ts": block("c", 12), "e.ts": block("d", 5), "z/e.ts": block("d", 5)}, 5)
    shape = duplication.shape(groups).first()
    assert (shape.groups, shape.removable, shape.max_lines, shape.median_lines) == (3, 22, 12, 5) and (shape.same_package, shape.same_directory, shape.cross_package, shape.within_file) == (1, 1, 1, 0)
    assert round(shape.under_ten, 3) == 66.667 and shape.top_ten_share == 100
    assert [(r.removable, r.files) for r in duplication.ranked(groups).collect()][0] == (12, ["p/q/c.ts", "p/q/d.ts"])
    blame = spark.createDataFrame([("p/q/c.ts", 1, 5), ("p/q/c.ts", 2, 9), ("other", 1, 99)], "path string, line int, time long")
    assert [tuple(r) for r in duplication.clone_churn(groups, blame, 1).collect()] == [("p/q/c.ts", 9)]


def test_changed_files_report_what_they_share(spark):
    files = spark.createDataFrame([("a.ts", "\n".join(block("k", 5)), "source"), ("b.ts", "\n".join(block("k", 5)), "source"), ("c.ts", "\n".join(block("m", 5)), "source"), ("d.ts", "\n".join(block("m", 5)), "source")], "path string, content string, role string")
    out = analyses.dup(files, changed=spark.createDataFrame([("a.ts",)], "path string"))
    assert [len(r.fragments) for r in out["clones"].collect()] == [2] and [r.path for r in out["per_file"].collect()] == ["a.ts"]
    assert out["headline"].first().percentage == 100
    none = analyses.dup(files, changed=spark.createDataFrame([], "path string"))
    assert none["clones"].count() == 0 and none["headline"].first().percentage == 0


def brute(files, m):
    """Repeats of at least m lines whose occurrences cannot all be longer, and that hold m lines which occur nowhere else."""
    occurrences = {}
    for path, lines in files.items():
        for i in range(len(lines)):
            for j in range(i + m, len(lines) + 1):
                occurrences.setdefault(tuple(lines[i:j]), []).append((path, i))
    out = set()
    for key, at in occurrences.items():
        if len(at) < 2:
            continue
        n = len(key)
        if all(len(occurrences[key[i : i + m]]) > len(at) for i in range(n - m + 1)):
            continue
        before = {files[p][i - 1] if i else None for p, i in at}
        after = {files[p][i + n] if i + n < len(files[p]) else None for p, i in at}
        if (len(before) > 1 or None in before) and (len(after) > 1 or None in after):
            spans = []
            for p, i in sorted(at):
                if spans and spans[-1][0] == p and i <= spans[-1][2]:
                    spans[-1][2] = i + n - 1
                else:
                    spans.append([p, i, i + n - 1])
            if len(spans) > 1:
                out.add(tuple((p, a + 1, b + 1) for p, a, b in spans))
    return out


def test_blocks_are_the_maximal_repeats(spark):
    for seed in range(4):
        rng = random.Random(seed)
        parts = [[f"w{k}x{i}" for i in range(rng.randint(3, 9))] for k in range(6)]
        files = {}
        for f in range(8):
            lines = []
            for _ in range(rng.randint(1, 4)):
                part = rng.choice(parts)
                a = rng.randint(0, 2)
                lines += part[a : len(part) - rng.randint(0, 2)] + ([f"u{f}{len(lines)}"] if rng.random() < 0.6 else [])
            files[f"f{f}.ts"] = lines
        got, _, _ = found(spark, files, 3)
        assert {tuple(x) for _, x in got} == brute(files, 3)


def test_blocks_of_many_islands(spark):
    """Copies of which many parts also stand elsewhere: what a class's occurrences have in common spans many islands to either side."""
    for seed in range(3):
        rng = random.Random(100 + seed)
        base = [f"b{i}" for i in range(40)]
        files = {"a.ts": ["x1", *base, "x2"], "z/a.ts": ["y1", *base[:35], "y2"], "z/b.ts": [*base[3:], "v", *base[10:22]]}
        for f in range(7):
            at = rng.randint(0, 34)
            files[f"s{f}.ts"] = [f"u{f}", *base[at : at + rng.randint(3, 9)], f"w{f}"]
        files["loop.ts"] = ["p", "q"] * 6 + ["r"] + ["p", "q"] * 4
        got, _, _ = found(spark, files, 3)
        assert {tuple(x) for _, x in got} == brute(files, 3)
