"""A JSON-RPC 2.0 server over lines: one tool for each analysis."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import SparkSession

from copse import runner
from copse.report.render import TOOL, VERSION

PROTOCOL, TOP = "2024-11-05", 20
_SCHEMA = {
    "type": "object",
    "properties": {"dir": {"type": "string"}, "all": {"type": "boolean"}, "top": {"type": "number"}, "diff": {"type": "string"}},
}


def tools() -> list[dict[str, Any]]:
    return [{"name": name, "description": f"The {name} analysis of a directory.", "inputSchema": _SCHEMA} for name in runner.COMMANDS]


def call(spark: SparkSession, name: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """A tool's result as text content; what goes wrong is a result too."""
    try:
        top = max(1, int(arguments.get("top", TOP)))
        options = runner.Options(include_all=bool(arguments.get("all")), diff=arguments.get("diff"))
        if name == "coupling":
            options.diff = None
        if name == "comments":
            options.scan = top
        outcome = runner.run(spark, name, arguments.get("dir", "."), options, None if name == "count" else top)
        result = outcome.result
        if name == "refactor" and result:
            result["candidates"] = [c for c in result["candidates"] if c["changes"] > 0]
        if name == "agent" and result:
            result["candidates"] = [c for c in result["candidates"] if c["risks"]]
        body = result if result is not None else {"unavailable": outcome.unavailable}
        return {"content": [{"type": "text", "text": json.dumps(body, ensure_ascii=False)}]}
    except Exception as error:  # a tool's failure is its answer; the server goes on
        return {"content": [{"type": "text", "text": str(error)}], "isError": True}


def respond(spark: SparkSession, line: str) -> dict[str, Any] | None:
    """The answer to a line, or None to a notification."""
    try:
        request = json.loads(line)
    except json.JSONDecodeError:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return {"jsonrpc": "2.0", "id": request.get("id") if isinstance(request, dict) else None, "error": {"code": -32600, "message": "Invalid request"}}
    if "id" not in request:
        return None
    answer: dict[str, Any] = {"jsonrpc": "2.0", "id": request["id"]}
    params = request.get("params") or {}
    match request["method"]:
        case "initialize":
            result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": TOOL, "version": VERSION}}
        case "ping":
            result = {}
        case "tools/list":
            result = {"tools": tools()}
        case "tools/call" if params.get("name") in runner.COMMANDS:
            result = call(spark, params["name"], params.get("arguments") or {})
        case "tools/call":
            return answer | {"error": {"code": -32602, "message": f"Unknown tool: {params.get('name')}"}}
        case method:
            return answer | {"error": {"code": -32601, "message": f"Unknown method: {method}"}}
    return answer | {"result": result}


def serve(lines: Iterable[str], write: Callable[[str], Any], spark: SparkSession) -> None:
    """Answer each line; blank lines are skipped."""
    for line in lines:
        if line.strip() and (answer := respond(spark, line)) is not None:
            write(json.dumps(answer, ensure_ascii=False))
