"""Line kinds, decision points, token estimates, languages and counts."""

import pytest
from pyspark.sql import functions as F

from copse.functions import languages, text
from copse.operators import complexity, context, counts, scan


def lexed(spark, *files):
    return scan.with_lines(spark.createDataFrame(list(files), "path string, content string"))


def kinds_of(spark, path, content):
    return lexed(spark, (path, content)).first().kinds


C, K, B = "code", "comment", "blank"


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("a.ts", "const a = 1;\n\n// note\n", [C, B, K]),
        ("a.ts", "a\n", [C]),
        ("a.ts", "", []),
        ("a.ts", None, []),
        ("a.ts", "a\n\n", [C, B]),
        ("a.ts", "a\r\nb\r\n", [C, C]),
        ("a.ts", "x = 1; /* note\nstill comment\n*/ y = 2;", [C, K, C]),
        ("a.ts", "/* start\n   \nend */", [K, B, K]),
        ("a.ts", "const s = \"// no\"; // yes", [C]),
        ("a.ts", "const s = '/* no';\nx", [C, C]),
        ("a.ts", "const s = 'a\\'/*';\nx // y\n// z", [C, C, K]),
        ("a.ts", "'unterminated /*\n// note", [C, K]),
        ("a.ts", "'ends in escape\\\n/* note */", [C, K]),
        ("a.ts", "/*/ open */\nx", [K, C]),
        ("a.ts", "/* never closed\nx\ny", [K, K, K]),
        ("a.ts", " 　\n﻿\nx", [B, B, C]),
        ("a.py", '"""doc\nmore\n"""\nx = 1  # c\n# d', [K, K, K, C, K]),
        ("a.py", "x = '''a\nb'''\n", [C, K]),
        ("a.py", "'''it\"s'''\ny", [K, C]),
        ("a.lua", "--[[ a\nb ]]\n-- c\nx", [K, K, K, C]),
        ("a.sql", "-- c\n/* d */ select 1\nselect '--'", [K, C, C]),
        ("a.html", "<!-- a\nb -->\n<p>it's <!-- hidden --></p>", [K, K, C]),
        ("a.css", "/* a */\n// not one\n", [K, C]),
        ("a.json", '{"a": "// x"}\n', [C]),
        ("a.unknown", "// x\n# y", [C, C]),
        ("a.rb", "# c\nx = \"#{y}\"", [K, C]),
    ],
)
def test_line_kinds(spark, path, content, want):
    assert kinds_of(spark, path, content) == want


def test_long_texts_need_no_stack(spark):
    content = "x = '" + "a\\'" * 400_000 + "'\n/*" + "b\n" * 200_000 + "*/ y"
    row = scan.measured(lexed(spark, ("a.ts", content))).select("code", "comment").first()
    assert (row.code, row.comment) == (2, 200_000)


def test_code_keeps_quotes_but_not_strings(spark):
    assert lexed(spark, ("a.ts", "f('if', `x`) // if\n/* if\n*/ if")).first().code_text == "f('', ``) \n\n if"


@pytest.mark.parametrize(
    ("path", "content", "want"),
    [
        ("a.ts", "if (a && b) {\n for (x of y) {}\n}", (1, 1, 1)),
        ("a.ts", "switch (x) { case 1: case 2: } catch (e) {} while (a || b)", (3, 1, 1)),
        ("a.ts", "const notif = iffy; // if\n'if'", (0, 0, 0)),
        ("a.ts", "éif if é", (2, 0, 0)),
        ("a.ts", "a &&& b", (0, 0, 1)),
        ("a.py", "if a and b or c:", (1, 0, 2)),
        ("a.rb", "unless x or y && z", (1, 0, 2)),
        ("a.json", "if for while &&", (0, 0, 0)),
        ("a.md", "if", (0, 0, 0)),
        ("a.unknown", "if (x)", (1, 0, 0)),
    ],
)
def test_decisions(spark, path, content, want):
    row = scan.measured(lexed(spark, (path, content))).first()
    assert (row.branch, row.loop, row.bool) == want and row.complexity == sum(want)


def test_densest_window_and_concentration(spark):
    content = "if (a)\n" * 3 + "x\n" * 100 + "if (a)\n" * 2
    got = complexity.complexity(scan.measured(lexed(spark, ("a.ts", content), ("b.ts", "x")))).orderBy("path").collect()
    assert (got[0].complexity, got[0].densest, got[0].concentration) == (5, 3, 60.0)
    assert (got[1].complexity, got[1].densest, got[1].density, got[1].concentration) == (0, 0, 0.0, 0.0)
    assert [r.path for r in complexity.rank(spark.createDataFrame([("b", 2, 9, 1.0), ("a", 2, 1, 9.0), ("c", 0, 9, 0.0)], "path string, complexity int, code int, density double")).collect()] == ["a", "b"]


@pytest.mark.parametrize(
    ("content", "want"),
    [("getUserName", 3), ("sha256", 2), ("__", 1), ("abcdefghijk", 2), ("!@#$%^", 2), ("a\nb", 3), ("const userName = getUser(id);", 9), ("", 0), ("😀😀", 2), ("héllo", 3), ("ABCdef", 1), ("a_b", 2), ("x9Y", 3), (" ", 0), ("_a_", 1)],
)
def test_token_estimate(spark, content, want):
    assert spark.createDataFrame([(content,)], "t string").select(text.token_estimate(F.col("t"))).first()[0] == want


def test_context(spark):
    files = lexed(spark, ("src/a.ts", "const userName = getUser(id);\n// note\n\n"), ("b.ts", "x"), ("lib/a.ts", "x"))
    got = context.context(files)
    rows = got.collect()
    assert [(r.path, r.tokens, r.code_tokens, r.comment_tokens) for r in rows] == [("src/a.ts", 14, 11, 3), ("b.ts", 2, 2, 0), ("lib/a.ts", 2, 2, 0)]
    assert [tuple(r) for r in context.directories(got).collect()] == [("src", 14, 1), (".", 2, 1), ("lib", 2, 1)]
    assert context.navigability(got).first().asDict() == {"files": 3, "ambiguous_files": 2, "median_depth": 2, "max_depth": 2}
    assert [tuple(r) for r in context.budget_tiers(got, 24).collect()] == [(0.5, 12, 1), (0.25, 6, 1), (0.1, 2, 1)]


def test_extension_and_language(spark):
    paths = ["a/b.TS", ".bashrc", "a.", "Makefile", "x.tar.gz", "a/.eslintrc.js", "..", "d.md"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(text.extension(F.col("p")).alias("e")).withColumn("l", languages.language_name(F.col("e"))).collect()
    assert [(r.e, r.l) for r in rows] == [(".TS", "TypeScript"), ("no_ext", "Other"), (".", "Other"), ("no_ext", "Other"), (".gz", "Other"), (".js", "JavaScript"), ("no_ext", "Other"), (".md", "Markdown")]


def test_counts(spark):
    files = scan.measured(lexed(spark, ("a.ts", "a\nb\n// c\n\n"), ("b.ts", "x"), ("c.py", "# a\n# b")))
    got = {r.language: r for r in counts.by_language(files).collect()}
    assert got["TypeScript"].asDict() == {"language": "TypeScript", "files": 2, "code": 3, "comment": 1, "blank": 1, "total": 5, "complexity": 0}
    assert (got["Python"].code, got["Python"].comment) == (0, 2)
    assert counts.totals(files).first().total == 7
    assert {r.language: r.median_code for r in counts.distribution(files).collect()} == {"TypeScript": 2, "Python": 0}
    assert [r.path for r in counts.largest(files, 2).collect()] == ["a.ts", "b.ts"]


def test_bracketed_quantiles_are_exact(spark):
    import random

    rng = random.Random(1)
    for values in ([], [3.5], [rng.random() for _ in range(3000)], [round(rng.random(), 1) for _ in range(500)], [0.0] * 9 + [1.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for f in (0.0, 0.5, 0.75, 0.9, 1.0):
            want = sorted(values)[min(len(values) - 1, int(len(values) * f))] if values else 0
            assert scan.wide_values(df, {"q": (F.col("v"), f)}).first().q == want


def test_many_quantiles_at_once(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 a", "cast(id % 3 as double) b", "if(id % 2 = 0, id / 7, null) c", "id % 10 = 0 d")
    got = scan.wide_values(df, {"x": (F.col("a"), 0.5), "y": (F.col("b"), 0.9), "z": (F.col("c"), 0.25), "w": (F.when(F.col("d"), F.col("a")), 0.0), "v": (F.when(F.lit(False), F.col("a")), 0.5)}).first()
    assert got.asDict() == {"x": 2500, "y": 2.0, "z": 1250 / 7, "w": 0, "v": 0}


def test_quantile_and_concentration(spark):
    of = lambda values, f: scan.one_value(spark.createDataFrame([(v,) for v in values], "v long"), "v", f, "q").first().q
    assert of([1, 2, 3, 4], 0.5) == 3 and of([4, 3, 2, 1], 0.9) == 4 and of([], 0.5) == 0 and of([7], 0.99) == 7 and of([1, 1, 1, 9], 0.5) == 1
    sizes = spark.createDataFrame([(10,)] * 95 + [(190,)] * 5, "code long")
    row = counts.concentration(sizes).first()
    assert (row.largest_files, round(row.share, 6), row.median_code) == (5, 50.0, 10)
    assert counts.concentration(sizes.limit(0)).first().asDict() == {"largest_files": 0, "share": 0.0, "median_code": 0, "p90_code": 0}


@pytest.mark.parametrize(("code", "label"), [(0, "Meteoroid"), (999, "Meteoroid"), (1000, "Asteroid"), (49_999, "Moon"), (4_999_999, "Galaxy"), (5_000_000, "Universe")])
def test_size_label(spark, code, label):
    assert spark.range(1).select(text.size_label(F.lit(code))).first()[0].startswith(label)


def test_normalizers(spark):
    rows = spark.createDataFrame([("const alpha = beta(gamma);",), ("  if   (x)  ",)], "t string")
    assert [r[0] for r in rows.select(text.normalize_renamed(F.col("t"))).collect()] == ["const $ = $($);", "if ($)"]
    assert [r[0] for r in rows.select(text.normalize_line(F.col("t"))).collect()] == ["const alpha = beta(gamma);", "if (x)"]
