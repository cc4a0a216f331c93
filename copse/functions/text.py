"""Lines, line kinds, decision points and token estimates of a file's text, as column expressions.

No text is read a character at a time: one regular expression per comment syntax marks comments and empties strings
in a single pass, so a file of any length stays inside native expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from copse.functions.languages import BOOLEANS, DECISIONS, LOOPS, SYNTAX, dialect_name, syntax_name

#: White space as the language of the original tools defines it; Java's \s knows ASCII alone.
SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Marks around a comment while it is taken out; characters that no text may hold.
_OPEN, _CLOSE, _NEVER = "\uFDD0", "\uFDD1", "\uFDD2"
#: Lines of the window in which decisions are counted together.
DENSEST_WINDOW = 40


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the base name, ``no_ext`` if there is none but a leading one."""
    ext = F.regexp_extract(base_name(path), r"^.+?(\.[^.]*)$", 1)
    dots_only = base_name(path).rlike(r"^\.\.?$")
    return F.when(dots_only | (ext == ""), "no_ext").otherwise(ext)


def top_dir(path: Column) -> Column:
    """The first directory, ``.`` for files at the root."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def split_lines(text: Column) -> Column:
    """Lines without their ends; a last empty one does not count, and an empty text has none."""
    lines = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def _marking(blocks: list[tuple[str, str]], line: str | None) -> str:
    """Comments in the first group, then each kind of string as its opening and closing quotes."""
    comments = [rf"(?s:{re.escape(a)}.*?(?:{re.escape(b)}|\z))" for a, b in blocks]
    comments += [rf"{re.escape(line)}[^\n]*+"] if line else []
    strings = [rf"({q})[^{q}\\\n]*+(?:\\[^\n]?[^{q}\\\n]*+)*+({q}?)" for q in "\"'`"]
    return "|".join([f"({'|'.join(comments)})" if comments else f"({_NEVER})", *strings])


def _marked(text: Column, ext: Column, end: str = "") -> Column:
    """The text with each comment between marks and each string emptied; ``end`` is put behind it."""
    clean = F.translate(F.regexp_replace(text, "\r\n", "\n"), _OPEN + _CLOSE + _NEVER, "\uFFFD\uFFFD\uFFFD")
    clean = F.concat(clean, F.lit(end)) if end else clean
    marks = f"{_OPEN}$1{_CLOSE}$2$3$4$5$6$7"
    syntax = syntax_name(ext)
    marked = F.regexp_replace(clean, _marking([], None), marks)
    for name, (blocks, line, _) in SYNTAX.items():
        marked = F.when(syntax == name, F.regexp_replace(clean, _marking(blocks, line), marks)).otherwise(marked)
    return marked


def code_text(text: Column, ext: Column) -> Column:
    """The text without comments and without what stands inside strings; every line keeps its place."""
    parts = F.split(_marked(text, ext), _OPEN, -1)
    kept = F.transform(
        parts, lambda p: F.when(F.instr(p, _CLOSE) > 0, F.concat(F.regexp_replace(F.substring_index(p, _CLOSE, 1), "[^\n]", ""), F.substring_index(p, _CLOSE, -1))).otherwise(p)
    )
    return F.array_join(kept, "")


#: States of the lexer at a line's start: in code, or in one of its syntax's block comments, as they are listed.
STATES = 1 + max(len(blocks) for blocks, _, _ in SYNTAX.values())


def opener(ext: Column, state: Column) -> Column:
    """What opens the block comment of a state; a text that starts in a state is lexed as if this stood before it."""
    syntax, out = syntax_name(ext), F.lit("")
    for name, (blocks, _, _) in SYNTAX.items():
        for k, (a, _) in enumerate(blocks, 1):
            out = F.when((syntax == name) & (state == k), a).otherwise(out)
    return out


def end_state(text: Column, ext: Column) -> Column:
    """The state in which whole lines of text leave the lexer: strings and line comments end with their line, so only block comments go on."""
    last = F.element_at(F.split(_marked(text, ext, _NEVER), _OPEN, -1), -1)
    syntax, comment, out = syntax_name(ext), F.substring_index(last, _CLOSE, 1), F.lit(0)
    for name, (blocks, _, _) in SYNTAX.items():
        for k, (a, _) in reversed(list(enumerate(blocks, 1))):
            out = F.when((syntax == name) & comment.startswith(a), k).otherwise(out)
    return F.when((F.instr(last, _CLOSE) > 0) & F.endswith(comment, F.lit(_NEVER)), out).otherwise(0)


def code_lines(code: Column, lines: Column) -> Column:
    """The lines of ``code_text``, as many as there are lines."""
    return F.slice(F.split(code, "\n", -1), 1, F.size(lines))


def line_kinds(lines: Column, code: Column) -> Column:
    """``code``, ``comment`` or ``blank`` for each line, from its text and what is left of it as code."""
    return F.zip_with(
        lines,
        code,
        lambda raw, left: F.when(~raw.rlike(f"[^{SPACE}]"), "blank").when(left.rlike(r"[^ \t\r\f\x0B]"), "code").otherwise("comment"),
    )


#: What a line may be, by the numbers that ``packed_kinds`` gives from 1.
KINDS = ("code", "comment", "blank")


def packed_kinds(kinds: Column) -> Column:
    """Line kinds as a byte for each line."""
    return F.transform(kinds, lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k).cast("byte"))


def unpacked_kinds(packed: Column) -> Column:
    """The line kinds that ``packed_kinds`` made bytes of."""
    return F.transform(packed, lambda n: F.element_at(F.array(*map(F.lit, KINDS)), n.cast("int")))


def _word_pattern(words: list[str]) -> str:
    return rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def decision_pattern(dialect: str, bucket: str | None = None) -> str | None:
    """The regular expression of a bucket (branch, loop or bool; None: all) in a dialect, or None if it has none."""
    words, operators, _ = DECISIONS[dialect]
    own = [w for w in words.split() if bucket in (None, "loop" if w in LOOPS else "bool" if w in BOOLEANS else "branch")]
    found = [_word_pattern(own)] if own else []
    if bucket in (None, "bool"):
        found += [re.escape(o) for o in operators.split()]
    return "|".join(found) or None


def decisions(text: Column, ext: Column, bucket: str | None = None) -> Column:
    """How many decision points of a bucket, or of all, stand in code."""
    out, dialect = F.lit(0), dialect_name(ext)
    for name in DECISIONS:
        if pattern := decision_pattern(name, bucket):
            out = F.when(dialect == name, F.regexp_count(text, F.lit(pattern))).otherwise(out)
    return out


#: A token: a line end, symbols, up to ten characters of a word that no part ends among, or underscores alone.
_TOKEN = (
    rf"\n|[^{SPACE}A-Za-z0-9_]{{1,3}}|(?:[a-z](?![A-Z0-9])|[A-Z](?![0-9])|[0-9](?![A-Z])){{0,9}}[A-Za-z0-9]|(?<![A-Za-z0-9_])_++(?![A-Za-z0-9])"
)


def token_estimate(text: Column) -> Column:
    """Tokens that reading the text costs: line ends, a token for every three symbols of a run, and for every ten
    characters of each part of a word; parts end at underscores, before capitals and before digits. Characters beyond
    the basic plane count as two symbols. All of them are found in one pass.
    """
    wide = r"[\x{10000}-\x{10FFFF}]"
    pairs = F.when(text.rlike(wide), F.regexp_replace(text, wide, "§§")).otherwise(text)
    return F.regexp_count(pairs, F.lit(_TOKEN)).cast("long")


def normalize_line(lines: Column) -> Column:
    """Lines without white space at their ends, and with single spaces inside; line ends stay."""
    return F.regexp_replace(F.regexp_replace(lines, f"[{SPACE.replace(chr(92) + 'n', '')}]+", " "), "(?md)^ | $", "")


# fixed values: words that stay when identifiers are masked
KEYWORDS = [
    "abstract", "and", "as", "async", "await", "break", "case", "catch", "class", "const", "continue", "def", "default", "delete", "do", "elif", "else",
    "enum", "except", "export", "extends", "false", "final", "finally", "fn", "for", "from", "func", "function", "if", "implements", "import", "in",
    "interface", "is", "lambda", "let", "match", "namespace", "new", "nil", "none", "not", "null", "or", "package", "pass", "private", "protected",
    "public", "raise", "return", "self", "static", "struct", "super", "switch", "this", "throw", "true", "try", "type", "typeof", "undefined", "use",
    "var", "void", "when", "while", "with", "yield",
]


def normalize_renamed(line: Column) -> Column:
    """Normalised lines with every identifier but keywords as ``$``."""
    masked = F.regexp_replace(line, rf"(?<![A-Za-z0-9_$])(?!(?:{'|'.join(KEYWORDS)})(?![A-Za-z0-9_$]))[A-Za-z_$][A-Za-z0-9_$]*", r"\$")
    return normalize_line(masked)


# fixed values: sizes of projects in lines of code, each tier up to its bound exclusive
SIZE_TIERS = (
    (1_000, "Meteoroid 🪨"), (10_000, "Asteroid ☄️"), (50_000, "Moon 🌑"), (100_000, "Planet 🪐"), (500_000, "Star ⭐"), (1_000_000, "Solar System ☀️"), (5_000_000, "Galaxy 🌌"),
)
LARGEST_TIER = "Universe 🌠"


def size_label(code: Column) -> Column:
    """The size tier of a project."""
    out = F.lit(LARGEST_TIER)
    for bound, label in reversed(SIZE_TIERS):
        out = F.when(code < bound, label).otherwise(out)
    return out
