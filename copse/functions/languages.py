"""Languages by file extension: names, comment syntax and decision keywords."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions of each language
NAMES = {
    "JavaScript": ".js .mjs .cjs", "JSX": ".jsx", "TypeScript": ".ts .mts .cts", "TSX": ".tsx", "Java": ".java", "C": ".c .h", "C++": ".cpp .cc .hpp",
    "C#": ".cs", "Go": ".go", "Rust": ".rs", "Swift": ".swift", "Kotlin": ".kt .kts", "Scala": ".scala", "PHP": ".php", "CSS": ".css", "SCSS": ".scss",
    "Less": ".less", "Python": ".py .pyi", "Ruby": ".rb", "CoffeeScript": ".coffee", "Bash": ".sh .bash", "Zsh": ".zsh", "YAML": ".yml .yaml", "TOML": ".toml",
    "Perl": ".pl", "R": ".r", "SQL": ".sql", "Lua": ".lua", "HTML": ".html", "XML": ".xml", "Vue": ".vue", "JSON": ".json", "Markdown": ".md .markdown", "Plain Text": ".txt",
}

# fixed values: block comments in the order they are tried, the line comment, and the extensions that have them
SYNTAX = {
    "slashes": ([("/*", "*/")], "//", ".js .jsx .mjs .cjs .ts .tsx .mts .cts .java .c .h .cpp .cc .hpp .cs .go .rs .swift .kt .kts .scala .php .scss .less"),
    "blocks": ([("/*", "*/")], None, ".css"),
    "quotes": ([('"""', '"""'), ("'''", "'''")], "#", ".py .pyi"),
    "hash": ([], "#", ".rb .coffee .sh .bash .zsh .yml .yaml .toml .pl .r"),
    "sql": ([("/*", "*/")], "--", ".sql"),
    "lua": ([("--[[", "]]")], "--", ".lua"),
    "markup": ([("<!--", "-->")], None, ".html .xml .vue"),
}

# fixed values: keywords and operators that count as decisions; extensions not named have those of "braces"
DECISIONS = {
    "braces": ("if for while case catch", "&& ||", ""),
    "python": ("if elif for while except and or", "", ".py .pyi"),
    "ruby": ("if elsif unless while until for when rescue and or", "&& ||", ".rb"),
    "none": ("", "", ".json .yml .yaml .toml .md .markdown .txt .html .xml .vue .css .scss .less"),
}
LOOPS, BOOLEANS = {"for", "while", "until", "loop"}, {"and", "or"}


def _by_extension(groups: dict[str, str], default: str, ext: Column) -> Column:
    """A literal map from extension to the name of its group, looked up once."""
    pairs = chain.from_iterable((F.lit(e), F.lit(name)) for name, extensions in groups.items() for e in extensions.split())
    return F.coalesce(F.create_map(*pairs)[F.lower(ext)], F.lit(default))


def language_name(ext: Column) -> Column:
    """The language of an extension, ``Other`` if unknown."""
    return _by_extension(NAMES, "Other", ext)


def syntax_name(ext: Column) -> Column:
    """The key of ``SYNTAX``, or ``plain`` where only strings are known."""
    return _by_extension({k: v[2] for k, v in SYNTAX.items()}, "plain", ext)


def dialect_name(ext: Column) -> Column:
    """The key of ``DECISIONS``."""
    return _by_extension({k: v[2] for k, v in DECISIONS.items()}, "braces", ext)
