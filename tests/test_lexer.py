"""The lexer of the plans against one that reads a character at a time, on all files of the smallest tables and on odd ones."""

import random

import pytest
from copse.operators import chunks, scan
from copse.plans import queries

SF = "/root/testdata/sf0.001"
BLOCKS = {"c": [("/*", "*/")], "css": [("/*", "*/")], "py": [('"""', '"""'), ("'''", "'''")], "sql": [("/*", "*/")], "lua": [("--[[", "]]")], "xml": [("<!--", "-->")]}
LINE = {"c": "//", "py": "#", "hash": "#", "sql": "--", "lua": "--"}
OF = {".ts": "c", ".go": "c", ".css": "css", ".py": "py", ".rb": "hash", ".sql": "sql", ".lua": "lua", ".html": "xml"}


def slow_code(text, syntax):
    """The text with comments as their line ends alone and strings as their quotes."""
    out, at, text = [], 0, text.replace("\r\n", "\n")
    while at < len(text):
        block = next((b for b in BLOCKS.get(syntax, []) if text.startswith(b[0], at)), None)
        if block:
            end = text.find(block[1], at + len(block[0]))
            end = len(text) if end < 0 else end + len(block[1])
            out.append("\n" * text.count("\n", at, end))
            at = end
        elif syntax in LINE and text.startswith(LINE[syntax], at):
            while at < len(text) and text[at] != "\n":
                at += 1
        elif text[at] in "\"'`":
            quote = text[at]
            out.append(quote)
            at += 1
            while at < len(text) and text[at] not in (quote, "\n"):
                # a backslash takes the next character with it, but no line end
                at += 2 if text[at] == "\\" and at + 1 < len(text) and text[at + 1] != "\n" else 1
            if at < len(text) and text[at] == quote:
                out.append(quote)
                at += 1
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


SPACES = set("\t\n\x0b\f\r \xa0     　﻿") | {chr(c) for c in range(0x2000, 0x200B)}


def slow_kinds(text, syntax):
    code = slow_code(text, syntax).split("\n")
    lines = text.replace("\r\n", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    return ["blank" if not set(raw) - SPACES else "code" if set(left) - set(" \t\r\f\x0b") else "comment" for raw, left in zip(lines, code)]


def agree(files):
    for r in scan.with_lines(files).select("path", "content", "ext", "kinds").collect():
        assert r.kinds == slow_kinds(r.content, OF.get(r.ext, "text")), r.path


def test_all_files_of_the_tables(spark):
    agree(queries.files(spark, SF))


def odd(seed):
    rng = random.Random(seed)
    parts = ["/*", "*/", "//", "#", "--", "--[[", "]]", "<!--", "-->", '"""', "\'\'\'", '"', "'", "`", "\\", "\n", "\r\n", " ", "\t", "　", "x", "if", "a b", "\n\n"]
    return [(f"f{i}{ext}", "".join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(40) for ext in OF]


@pytest.mark.parametrize("seed", range(3))
def test_odd_files(spark, seed):
    agree(spark.createDataFrame(odd(seed), "path string, content string"))


@pytest.mark.parametrize("size", [1, 7])
def test_chunks_of_any_size_are_lexed_as_whole_files(spark, size):
    rows = odd(size) + [("long.ts", "a /* b\n" + "c\n" * 50 + "*/ d\n\n" + "x" * 40), ("none.py", None), ("empty.lua", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    lexed = chunks.with_lines(chunks.chunked(files, size)).select("path", "part", "kinds").collect()
    got = {}
    for r in sorted(lexed, key=lambda r: (r.path, r.part)):
        got.setdefault(r.path, []).extend(r.kinds)
    assert got == {path: slow_kinds(content or "", OF.get("." + path.rsplit(".")[-1], "text")) for path, content in rows}


def test_sums_of_chunks_are_those_of_files(spark):
    files = queries.files(spark, SF).select("path", "content").where("path LIKE '%7.%'")
    columns = ["path", "language", "code", "comment", "blank", "total", "branch", "loop", "bool", "complexity"]
    parts = chunks.measured(chunks.chunked(files, 100)).select(*columns)
    assert sorted(parts.collect()) == sorted(scan.measured(scan.with_lines(files)).select(*columns).collect())
