"""Plain results of the analyses: what the JSON sink, the command line and the RPC server share."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators.verdicts import AGENT, DIFFUSE, DUPLICATED, REFACTOR

Result = dict[str, Any]
#: What becomes of a listing, the only part of a result that grows with the files: rows on the driver, or a sink's mark.
Listed = Callable[[DataFrame, int | None], Any]


def camel(name: str) -> str:
    return re.sub("_(.)", lambda m: m[1].upper(), name)


def plain(value: Any) -> Any:
    """A row, or a value of one, with the names of the JSON format."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {camel(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


def rows(df: DataFrame, limit: int | None = None) -> list[Result]:
    """Rows as dictionaries with the names of the JSON format; at most ``limit``."""
    return [plain(r) for r in (df if limit is None else df.limit(limit)).collect()]


def one(df: DataFrame) -> Result:
    return rows(df)[0]


def _excluded(df: DataFrame) -> Result:
    roles = rows(df)
    return {"files": sum(r["files"] for r in roles), "code": sum(r["code"] for r in roles), "roles": roles}


def count(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows) -> Result:
    totals, spread = one(out["totals"]), {r["language"]: r for r in rows(out["distribution"])}
    names = {"code": "totalCode", "comment": "totalComment", "blank": "totalBlank", "total": "totalLines", "files": "totalFiles", "complexity": "totalComplexity"}
    languages = [r | {k: v for k, v in spread[r["language"]].items() if k != "language"} for r in rows(out["languages"])]
    return {new: totals[old] for old, new in names.items()} | {
        "languages": languages, "concentration": one(out["concentration"]), "largestFiles": rows(out["largest"]), "roles": rows(out["roles"]), "testRatio": one(out["test_ratio"])["ratio"],
    }


def dup(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows) -> Result:
    fragments = F.transform("fragments", lambda f: F.struct(f["path"].alias("path"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line")))
    shape = one(out["shape"])
    places = ("withinFile", "sameDirectory", "samePackage", "crossPackage")
    shape["byLocation"] = {p: shape.pop(p) for p in places}
    extra = {"renamedGroups": one(out["renamed"])["renamedGroups"]} if "renamed" in out else {}
    listings = {
        "clones": out["clones"].select("line_count", fragments.alias("fragments")), "ranked": out["ranked"].select("files", "copies", "line_count", "removable"), "perFile": out["per_file"],
    }
    return one(out["headline"]) | {k: listed(df, limit) for k, df in listings.items()} | {"shape": shape} | extra


def snippets(out: dict[str, DataFrame], limit: int) -> list[str]:
    """The code of the first ``limit`` clones, in their order."""
    return ["\n".join(r["code"]) for r in rows(out["coded"].select("code"), limit)]


def cx(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows) -> Result:
    return {"files": listed(out["files"], limit), "excluded": _excluded(out["excluded"])}


def ctx(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows) -> Result:
    totals = one(out["totals"])
    return {
        "files": listed(out["files"], limit), "dirs": listed(out["dirs"], limit), "totalTokens": totals["tokens"], "codeTokens": totals["codeTokens"], "commentTokens": totals["commentTokens"],
        "navigability": one(out["navigability"]) | {"worstNames": rows(out["worst_names"])}, "tiers": rows(out["tiers"]), "excluded": _excluded(out["excluded"]),
    }


def comments(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows) -> Result:
    return one(out["summary"]) | {"files": listed(out["files"], limit)}


def refactor(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows, order: str = "candidates") -> Result:
    verdicts = one(out["verdicts"])
    measured = sum(verdicts[v] for v in REFACTOR)
    return {"candidates": listed(out[order], limit), "limits": one(out["limits"]), "verdicts": verdicts, "measured": measured, "inert": verdicts["inert"], "excluded": _excluded(out["excluded"])}


def coupling(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows) -> Result:
    return {"pairs": listed(out["pairs"], limit), "files": listed(out["files"], limit)} | one(out["commits"])


def agent(out: dict[str, DataFrame], limit: int | None = None, listed: Listed = rows) -> Result:
    verdicts = one(out["verdicts"])
    limits = one(out["limits"]) | {"duplicated": DUPLICATED, "diffuse": DIFFUSE}
    return {"candidates": listed(out["candidates"], limit), "limits": limits, "verdicts": verdicts, "measured": sum(verdicts[v] for v in AGENT), "excluded": _excluded(out["excluded"])}


RESULTS = {"count": count, "dup": dup, "cx": cx, "ctx": ctx, "comments": comments, "refactor": refactor, "coupling": coupling, "agent": agent}
