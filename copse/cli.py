"""The command line: ``python -m copse.cli COMMAND [DIR] [options]``. Exit status 1 is an error, 2 a gate that failed."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from copse import runner
from copse.report import render, results, sink
from copse.sources.config import ConfigError

#: Options that bound a figure: the command, its option, and where the figure is.
GATES = {
    "dup": ("max_duplication", lambda r: r["percentage"]),
    "cx": ("max_density", lambda r: max((f["density"] for f in r["files"]), default=0)),
    "ctx": ("max", lambda r: r["totalTokens"]),
    "comments": ("max_drift", lambda r: r["drifted"] / r["blocks"] * 100 if r["blocks"] else 0),
    "refactor": ("max_reread", lambda r: max((f["recurringTokens"] for f in r["candidates"]), default=0)),
}


def token_count(value: str) -> int:
    """A number of tokens: 5000, 200k, 1m."""
    unit = {"k": 1_000, "m": 1_000_000}.get(value[-1:].lower(), 1)
    n = float(value[:-1] if unit > 1 else value)
    if not n > 0 or n == float("inf"):
        raise argparse.ArgumentTypeError(f"not a positive number: {value}")
    return int(n * unit)


def percentage(value: str) -> float:
    n = float(value.removesuffix("%"))
    if not 0 <= n <= 100:
        raise argparse.ArgumentTypeError(f"not a percentage: {value}")
    return n


def positive(value: str) -> int:
    if not value.isdigit() or int(value) < 1:
        raise argparse.ArgumentTypeError(f"not a positive number: {value}")
    return int(value)


def row_count(value: str) -> int | None:
    """A number of rows; ``all`` and 0 are no bound."""
    return None if value in ("all", "0") else positive(value)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="copse", description="Code metrics over a file tree and its history.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in runner.COMMANDS:
        p = commands.add_parser(name)
        p.add_argument("dir", nargs="?", default=".")
        p.add_argument("--json", action="store_true")
        p.add_argument("--html", metavar="FILE")
        p.add_argument("--json-dir", metavar="DIR", help="write what --json prints as parts, by tasks, into a new folder that all executors share")
        p.add_argument("--config")
        p.add_argument("--top", type=row_count, default=10 if name == "dup" else 20)
        if name != "coupling":
            p.add_argument("--all", action="store_true", dest="include_all")
            p.add_argument("--diff", metavar="REF")
        if name in ("refactor", "coupling"):
            p.add_argument("--since", default="2 years ago")
            p.add_argument("--include-bots", action="store_true")
        if name in ("dup", "cx", "agent"):
            p.add_argument("--min-lines", type=positive)
        gate = GATES.get(name)
        if gate:
            p.add_argument("--" + gate[0].replace("_", "-"), dest="gate", type=token_count if name in ("ctx", "refactor") else percentage if name in ("dup", "comments") else float)
    at = commands.choices
    at["count"].add_argument("--readme", action="store_true")
    at["count"].add_argument("--distribution", dest="more", action="store_const", const=("medianCode", "p90Code", "maxCode"), default=())
    at["cx"].add_argument("--explain", dest="more", action="store_const", const=("branch", "loop", "bool"), default=())
    at["dup"].add_argument("--min-copies", type=positive, default=2)
    for flag in ("--cross-file", "--renamed", "--churn"):
        at["dup"].add_argument(flag, action="store_true")
    at["cx"].add_argument("--sort", choices=["raw", "density"])
    at["ctx"].add_argument("--window", type=token_count, default=200_000)
    at["ctx"].add_argument("--budget", type=token_count, default=50_000)
    at["comments"].add_argument("--years", type=float, default=3)
    at["comments"].add_argument("--scan", type=positive, default=50)
    at["refactor"].add_argument("--sort", choices=["cost", "churn", "recent"])
    at["refactor"].add_argument("--price", type=float)
    for option in ("min_revisions", "min_shared", "max_commit_size"):
        at["coupling"].add_argument("--" + option.replace("_", "-"), type=positive)
    at["coupling"].add_argument("--min-strength", type=percentage)
    commands.add_parser("serve")
    return parser


def _options(args: argparse.Namespace) -> runner.Options:
    own = {k: v for k, v in vars(args).items() if k in runner.Options.__dataclass_fields__ and v is not None}
    limits = {k: getattr(args, k) for k in ("min_revisions", "min_shared", "min_strength", "max_commit_size") if getattr(args, k, None) is not None}
    return runner.Options(**own, limits=limits, snippets=render.CLONES if args.command == "dup" and args.html else 0)


def session() -> SparkSession:
    """The active session, or a local one."""
    return SparkSession.getActiveSession() or (
        SparkSession.builder.appName("copse").config("spark.sql.shuffle.partitions", os.cpu_count() or 8).config("spark.ui.enabled", "false").getOrCreate()
    )


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.command == "serve":
        from copse import rpc

        rpc.serve(sys.stdin, print, spark or session())
        return 0
    if args.command == "count" and args.readme and args.diff:
        print("--readme needs the whole tree, not --diff", file=sys.stderr)
        return 1
    if args.json_dir and (args.json or args.html or getattr(args, "readme", False) or getattr(args, "gate", None) is not None):
        print("--json-dir goes with no other report or gate", file=sys.stderr)
        return 1
    try:
        report = sink.Report(args.json_dir) if args.json_dir else None
        outcome = runner.run(spark or session(), args.command, args.dir, _options(args), listed=report.listing if report else results.rows)
    except (ConfigError, OSError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    if outcome.warning:
        print(outcome.warning, file=sys.stderr)
    result = outcome.result
    if result is not None and args.command == "ctx":
        result |= {"window": args.window, "budget": args.budget}
    if result is not None and args.command == "comments":
        result["years"] = args.years
    if report:
        report.finish(args.command, args.dir, result, outcome.unavailable)
        return 0
    code = result.pop("code", []) if result is not None else []
    if args.json:
        print(render.envelope(args.command, args.dir, result, outcome.unavailable))
    elif result is None:
        print({"no-git": "no version history here", "no-comments": "no comments here"}[outcome.unavailable])
    else:
        print(render.text(args.command, result, args.top, getattr(args, "more", ())))
        if args.command == "refactor" and args.price is not None:
            cost = sum(c["recurringTokens"] for c in result["candidates"]) / 1e6 * args.price
            print(f"\nrereading at {render.money(args.price)} a million tokens: {render.money(cost)}")
    if result is not None and args.html:
        with open(args.html, "w", encoding="utf-8") as f:
            f.write(render.page(args.command, result, code))
    if args.command == "count" and args.readme:
        from copse.functions.text import LARGEST_TIER, SIZE_TIERS

        label = next((name for bound, name in SIZE_TIERS if result["totalCode"] < bound), LARGEST_TIER)
        render.inject(os.path.join(args.dir, "README.md"), render.readme_section(result, label))
    bound = getattr(args, "gate", None)
    if result is not None and bound is not None and GATES[args.command][1](result) > bound:
        print(f"{GATES[args.command][0].replace('_', ' ')} is over {render.number(bound)}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
