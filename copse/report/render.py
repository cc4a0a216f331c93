"""Sinks: the JSON envelope, text tables, HTML pages and README sections."""

from __future__ import annotations

import html
import json
import os
import textwrap
import time
from collections.abc import Sequence
from typing import Any

TOOL, VERSION, SCHEMA = "copse", "0.1.0", 1
START, END = "<!-- copse:start -->", "<!-- copse:end -->"
#: Rows of an HTML page.
HTML_ROWS = 1000


def envelope(command: str, root: str, result: Any, unavailable: str | None = None) -> str:
    """A result as JSON that depends on nothing but the result."""
    out = {"schema": SCHEMA, "tool": TOOL, "version": VERSION, "command": command, "root": root, "result": None if unavailable else result}
    return json.dumps(out | ({"unavailable": unavailable} if unavailable else {}), indent=2, ensure_ascii=False)


def number(value: float | int | None) -> str:
    """Thousands with commas; at most two decimals."""
    if value is None:
        return "-"
    return f"{value:,.2f}".rstrip("0").rstrip(".") if isinstance(value, float) else f"{value:,}"


def compact(value: float) -> str:
    """1.2k, 3.4M."""
    for bound, unit in ((1e9, "B"), (1e6, "M"), (1e3, "k")):
        if value >= bound:
            return f"{value / bound:.1f}".rstrip("0").rstrip(".") + unit
    return number(value)


def money(value: float) -> str:
    return f"${value:,.2f}" if value >= 0.01 or value == 0 else f"${value:.4f}"


def age(seconds: float) -> str:
    """The largest unit that a time fills."""
    for size, unit in ((365 * 86400, "y"), (30 * 86400, "mo"), (86400, "d"), (3600, "h")):
        if seconds >= size:
            return f"{int(seconds // size)}{unit}"
    return "now"


def shorten(text: str, width: int) -> str:
    """The end of a long path."""
    return text if len(text) <= width else "…" + text[len(text) - width + 1 :]


def table(header: Sequence[str], body: Sequence[Sequence[Any]]) -> str:
    """Aligned columns, numbers to the right."""
    cells = [[number(c) if isinstance(c, int | float) and not isinstance(c, bool) else ", ".join(map(str, c)) if isinstance(c, list) else str(c) for c in r] for r in body]
    right = [bool(body) and all(isinstance(r[i], int | float) for r in body) for i in range(len(header))]
    widths = [max(len(x[i]) for x in [list(header), *cells]) for i in range(len(header))]
    lines = [[*header], ["-" * w for w in widths], *cells]
    return "\n".join("  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(line, widths, right, strict=True)).rstrip() for line in lines)


# what the listings of each analysis show: where the rows are, and their columns
LISTINGS: dict[str, list[tuple[str, list[str]]]] = {
    "count": [("languages", ["language", "files", "code", "comment", "blank", "total", "complexity"]), ("roles", ["role", "files", "code"]), ("largestFiles", ["path", "code", "comment", "complexity"])],
    "dup": [("perFile", ["path", "totalLines", "duplicatedLines", "percentage"])],
    "cx": [("files", ["path", "language", "complexity", "code", "density", "densest", "concentration"])],
    "ctx": [("files", ["path", "tokens", "codeTokens", "commentTokens"]), ("dirs", ["dir", "tokens", "files"]), ("tiers", ["share", "threshold", "files"])],
    "comments": [("files", ["path", "blocks", "drifted"])],
    "refactor": [("candidates", ["path", "verdict", "recurringTokens", "changes", "churnRatio", "density"])],
    "coupling": [("pairs", ["a", "b", "shared", "strength"]), ("files", ["path", "revisions", "sumOfCoupling", "partners"])],
    "agent": [("candidates", ["path", "verdict", "risks", "density", "tokens", "duplication"])],
}
SUMMARIES = {
    "count": ["totalFiles", "totalLines", "totalCode", "totalComment", "totalBlank", "totalComplexity", "testRatio"], "dup": ["totalLines", "duplicatedLines", "percentage"], "cx": [],
    "ctx": ["totalTokens", "codeTokens", "commentTokens"], "comments": ["filesChecked", "blocks", "drifted"], "refactor": ["measured", "inert"], "coupling": ["commits", "skipped"], "agent": ["measured"],
}


#: What a verdict or risk means.
REASONS = {
    "refactor": "dense logic that changes often", "split": "costly to read and changed often, with simple logic", "watch": "changes often but is cheap to read", "quiet": "rarely changes",
    "inert": "did not change in this window", "safe": "no sign of risk", "review": "one sign of risk: read the diff", "human": "several signs of risk: decide the design first",
}


#: What each sign of risk means.
RISKS = {
    "dense": "many decisions a line of code", "large": "costs many tokens to read", "duplicated": "much of it stands elsewhere too: an edit may have to be made in every copy",
    "diffuse": "its decisions are spread over the whole file",
}
PLACES = {"withinFile": "within one file", "sameDirectory": "in one directory", "samePackage": "in one package", "crossPackage": "across packages"}
#: Clones of an HTML page, and lines of code that it shows of each.
CLONES, SNIPPET = 500, 60
#: Columns of text beyond which it goes on in the next line.
WIDTH = 100


def wrap(text: str, width: int = WIDTH, indent: str = "") -> str:
    """Text in lines of at most ``width``, broken at spaces; words longer than that stay whole."""
    return textwrap.fill(text, width, initial_indent=indent, subsequent_indent=indent, break_long_words=False, break_on_hyphens=False)


def multiple(value: float, of: float) -> str:
    """How many times one figure is another."""
    return f"{number(round(value / of, 1))}x" if of else "-"


def _shape(result: dict[str, Any]) -> list[str]:
    """What duplication looks like: sizes, places, and how much a few groups hold."""
    shape = result["shape"]
    groups = shape["groups"]
    if not groups:
        return ["no duplicated blocks"]
    places = sorted(((n, PLACES[k]) for k, n in shape["byLocation"].items() if n), reverse=True)
    out = [
        f"groups: {number(groups)}, {number(shape['removable'])} lines to save by keeping one copy of each",
        f"size: {shape['underTen']:.0f} % under 10 lines, median {number(shape['medianLines'])}, largest {number(shape['maxLines'])}",
        "where: " + ", ".join(f"{n / groups * 100:.0f} % {where}" for n, where in places),
        f"spread: the ten largest hold {shape['topTenShare']:.0f} % of what can be saved",
    ]
    return out + ([f"renamed: {number(result['renamedGroups'])} more groups if names do not matter"] if result.get("renamedGroups") else [])


def duplication(result: dict[str, Any], top: int | None, now: float | None = None) -> list[str]:
    """The parts of a duplication report: its shape, what is most worth removing, and the clones with their places."""
    churn, now = result.get("churn"), time.time() if now is None else now
    body = []
    for r in result["ranked"][:top]:
        more = len(r["files"]) - 1
        row = [shorten(r["files"][0], 60) + (f" +{more}" if more else ""), r["lineCount"], r["copies"], r["removable"]]
        if churn is not None:
            times = [churn[f] for f in r["files"] if f in churn]
            row.append(age(now - max(times)) if times else "-")
        body.append(row)
    clones = [[c["lineCount"], len(c["fragments"]), ", ".join(f"{f['path']}:{f['startLine']}-{f['endLine']}" for f in c["fragments"])] for c in result["clones"]]
    head = ["where", "lines", "copies", "removable", *(["last change"] if churn is not None else [])]
    return ["\n".join(_shape(result)), table(head, body) if body else "", table(["lines", "copies", "where"], clones[:top]) if clones else ""]


def text(command: str, result: dict[str, Any], top: int | None = None, more: Sequence[str] = ()) -> str:
    """A summary line and the listings of a result, ``top`` rows each; ``more`` names columns that the first listing adds."""
    parts = ["  ".join(f"{k}: {number(result[k])}" for k in SUMMARIES[command])]
    if command == "dup":
        parts += duplication(result, top)
    for i, (key, columns) in enumerate(LISTINGS[command]):
        columns = [*columns, *more] if i == 0 else columns
        parts.append(table(columns, [[r.get(c) for c in columns] for r in result[key][:top]]))
        if top is not None and len(result[key]) > top:
            parts.append(f"{number(len(result[key]) - top)} more")
    if "verdicts" in result:
        parts.append("\n".join(f"{k}: {v} ({REASONS[k]})" for k, v in result["verdicts"].items()))
    if command == "agent":
        found = {risk for r in result["candidates"][:top] for risk in r["risks"]}
        parts.append("\n".join(wrap(f"{k}: {meaning}") for k, meaning in RISKS.items() if k in found))
    if "window" in result:
        parts.append(f"{number(result['totalTokens'] / result['window'] * 100)} % of a window of {compact(result['window'])} tokens ({multiple(result['totalTokens'], result['window'])})")
    left = result.get("excluded", {}).get("files", 0)
    if left:
        parts.append(wrap(f"{number(left)} files left out: " + ", ".join(f"{r['role']} {r['files']}" for r in result["excluded"]["roles"])))
    return "\n\n".join(p for p in parts if p)


def _html_table(columns: Sequence[str], body: Sequence[Sequence[Any]]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(c))}</td>" for c in r) + "</tr>" for r in body) + "</tbody></table>"


def _clones(result: dict[str, Any], code: Sequence[str]) -> list[str]:
    """Clones with the places of their copies and the code of the first."""
    out = ["<h2>shape</h2><ul>" + "".join(f"<li>{html.escape(x)}</li>" for x in _shape(result)) + "</ul><h2>clones</h2>"]
    for clone, own in zip(result["clones"][:CLONES], [*code, *[""] * len(result["clones"])]):
        lines = own.split("\n")
        shown = "\n".join(lines[:SNIPPET]) + (f"\n({len(lines) - SNIPPET} more lines)" if len(lines) > SNIPPET else "")
        places = "".join(f"<li>{html.escape(f['path'])}:{f['startLine']}-{f['endLine']}</li>" for f in clone["fragments"])
        out.append(f"<section><h3>{clone['lineCount']} lines, {len(clone['fragments'])} copies</h3><ul>{places}</ul>" + (f"<pre><code>{html.escape(shown)}</code></pre>" if own else "") + "</section>")
    hidden = len(result["clones"]) - CLONES
    return out + ([f"<p>{number(hidden)} more clones</p>"] if hidden > 0 else [])


def page(command: str, result: dict[str, Any], code: Sequence[str] = ()) -> str:
    """A page of the listings, at most ``HTML_ROWS`` rows each; ``code`` has that of the clones in their order."""
    out = [f'<!doctype html><html><head><meta charset="utf-8"><meta name="generator" content="{TOOL} {VERSION}"><title>{TOOL} {command} report</title></head><body>']
    out.append("<p>" + html.escape("  ".join(f"{k}: {number(result[k])}" for k in SUMMARIES[command])) + "</p>")
    for key, columns in LISTINGS[command]:
        out.append(f"<h2>{html.escape(key)}</h2>" + _html_table(columns, [[r.get(c) for c in columns] for r in result[key][:HTML_ROWS]]))
    return "".join([*out, *(_clones(result, code) if command == "dup" else []), "</body></html>"])


def readme_section(result: dict[str, Any], label: str) -> str:
    """The language table as Markdown between marks."""
    columns = ["language", "files", "code", "comment", "blank"]
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(number(r[c]) if isinstance(r[c], int) else r[c] for c in columns) + " |" for r in result["languages"]]
    return "\n".join([START, f"**{number(result['totalCode'])}** lines of code: {label}", "", *lines, END])


def inject(path: str, section: str) -> None:
    """Put a section where the marks are, or at the end."""
    old = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
    a, b = old.find(START), old.find(END)
    new = old[:a] + section + old[b + len(END) :] if 0 <= a < b else old.rstrip("\n") + ("\n\n" if old.strip() else "") + section + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(new)
