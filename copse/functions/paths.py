"""Glob patterns, ignore rules and roles of files, as predicates on their paths."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from copse.functions.text import base_name, extension

ROLES = ("source", "test", "generated", "vendored", "docs")
# fixed values: characters of a text in which a header that says it is generated is looked for, what it says in any
# case, and names that decide a file's role
HEAD = 2048
GENERATED_HEADER = ["@generated", "code generated by", "do not edit", "autogenerated", "auto-generated", "generated by"]
TEST_DIRS = ["__tests__", "__mocks__", "__fixtures__", "__snapshots__", "test", "tests", "spec", "specs", "e2e", "fixtures", "benchmarks"]
VENDOR_DIRS = ["vendor", "vendored", "third_party", "third-party", "flow-typed", "node_modules", "bower_components"]
DOC_DIRS = ["docs", "doc"]
DOC_EXTENSIONS = [".md", ".markdown", ".txt", ".rst", ".adoc"]
OWN_REPORT = r'(?i)<meta name="generator" content="copse|<title>copse[^<]*report</title>'
TEST_FILE = r"(?i)[.\-_](test|spec)\.[^.]+$"
GENERATED_FILE = r"(?i)\.(min|bundle|generated)\.[^.]+$|(^|[.\-_])pb\.[^.]+$"


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over the whole string: ``**`` any text, ``*`` any but slashes, ``?`` one but a slash."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    wild = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(wild.get(p) or re.escape(p) for p in parts) + "$"


#: Globs up to which one pattern holds them all; beyond, a path is only tried on those that share a piece with it.
FEW = 16
#: Longest piece, in characters, by which a glob is looked up.
PIECE = 24


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether any glob fits the path or its base name. A null path gives null."""
    globs = list(dict.fromkeys(globs))
    if not globs:
        return F.lit(False)
    if len(globs) <= FEW:
        return _fits(path, F.lit(_any_of(globs)))
    return _looked_up(path, globs)


def _any_of(globs: Sequence[str]) -> str:
    return "|".join(f"(?:{glob_pattern(g)})" for g in globs)


def _fits(path: Column, pattern: Column) -> Column:
    return F.rlike(path, pattern) | F.rlike(base_name(path), pattern)


def _pieces(glob: str) -> list[str]:
    """What a path must have to fit a glob, each with a mark: ``^`` begins the path or base name, ``$`` ends it, ``+`` stands somewhere."""
    literal = re.split(r"[*?]+", glob)
    out = ["^" + literal[0][:PIECE]] if literal[0] else []
    out += ["$" + literal[-1][-PIECE:]] if literal[-1] else []
    return out + ["+" + p[:PIECE] for p in literal[1:-1] if p]


def _looked_up(path: Column, globs: Sequence[str]) -> Column:
    """``matches_any`` of any number of globs.

    Each glob is filed under one piece that every path that fits must have: the one that fewest globs share. A table of twice
    as many slots as globs has, for a piece's hash, the pattern of all globs filed there. A path looks up its own beginnings,
    ends and inner parts of the lengths that pieces have, and is only tried on the slots that it hits; so what a path costs
    grows with its length, not with the number of globs. Two pieces in one slot only cost a try. Globs without a piece, as
    ``**``, are tried always.
    """
    pieces = {g: _pieces(g) for g in globs}
    shared = Counter(p for own in pieces.values() for p in set(own))
    slots = 2 * len(globs)
    filed: dict[int, list[str]] = {}
    lengths: dict[str, set[int]] = {"^": set(), "$": set(), "+": set()}
    always = []
    for glob, own in pieces.items():
        if not own:
            always.append(glob)
            continue
        piece = min(own, key=lambda p: (shared[p], p[0] == "+", -len(p)))
        lengths[piece[0]].add(len(piece) - 1)
        filed.setdefault(zlib.crc32(piece.encode()) % slots, []).append(glob)
    table = F.split(F.lit("\0".join(_any_of(filed.get(i, [])) for i in range(slots))), "\0")

    sizes = lambda mark: F.array(*map(F.lit, sorted(lengths[mark]))).cast("array<int>")
    base = base_name(path)
    places = lambda n: F.sequence(F.lit(1), F.length(path) - n + 1)
    inner = F.transform(F.filter(sizes("+"), lambda n: n <= F.length(path)), lambda n: F.transform(places(n), lambda i: F.concat(F.lit("+"), F.substring(path, i, n))))
    own = F.concat(
        F.transform(sizes("^"), lambda n: F.concat(F.lit("^"), F.substring(path, F.lit(1), n))),
        F.transform(sizes("^"), lambda n: F.concat(F.lit("^"), F.substring(base, F.lit(1), n))),
        F.transform(sizes("$"), lambda n: F.concat(F.lit("$"), F.substring(path, F.greatest(F.length(path) - n + 1, F.lit(1)), n))),
        *([F.flatten(inner)] if lengths["+"] else []),
    )
    slot = lambda piece: F.get(table, (F.crc32(F.encode(piece, "UTF-8")) % slots).cast("int"))
    hit = F.filter(F.array_distinct(F.transform(own, slot)), lambda pattern: pattern != "")
    found = F.exists(hit, lambda pattern: _fits(path, pattern))
    found = F.when(path.isNotNull(), found)
    return found | _fits(path, F.lit(_any_of(always))) if always else found


def ignored(path: Column, dirs: Sequence[str], files: Sequence[str], extensions: Sequence[str], globs: Sequence[str]) -> Column:
    """Whether a file is ignored: a directory or base name or lower-cased extension that is listed, or a glob that fits."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return (
        F.arrays_overlap(folders, F.array(*map(F.lit, dirs)).cast("array<string>"))
        | base_name(path).isin(list(files))
        | F.lower(extension(path)).isin(list(extensions))
        | matches_any(path, globs)
    )


def role_of(path: Column, head: Column, patterns: dict[str, Sequence[str]] | None = None, attributes: dict[str, Sequence[str]] | None = None) -> Column:
    """A file's role; the first that fits of configured globs, repository attributes, header, and path."""
    patterns, attributes = patterns or {}, attributes or {}
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    base = base_name(path)
    within = lambda names: F.arrays_overlap(folders, F.array(*map(F.lit, names)))
    start = F.lower(F.substring(head, 1, HEAD))
    generated = F.lit(False)
    for phrase in GENERATED_HEADER:
        generated = generated | start.contains(phrase)
    rules = [(matches_any(path, patterns[r]), r) for r in ROLES if patterns.get(r)]
    rules += [(matches_any(path, attributes[r]), r) for r in ("generated", "vendored", "docs") if attributes.get(r)]
    rules += [
        (generated | (start.contains("copse") & start.rlike(OWN_REPORT)), "generated"),
        (within(VENDOR_DIRS), "vendored"),
        (base.rlike(GENERATED_FILE), "generated"),
        (within(TEST_DIRS) | base.rlike(TEST_FILE), "test"),
        (within(DOC_DIRS) | F.lower(extension(path)).isin(DOC_EXTENSIONS), "docs"),
    ]
    out = F.when(*[rules[0][0], F.lit(rules[0][1])])
    for fits, role in rules[1:]:
        out = out.when(fits, role)
    return out.otherwise("source")


def role_order(role: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ROLES)), role)
