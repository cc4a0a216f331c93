"""Configuration of a scan: what is ignored, and which paths have which role."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

from copse.functions.paths import ROLES

CONFIG_FILE = "copse.json"

# fixed values: what is ignored unless the configuration says otherwise
IGNORE_DIRS = ["node_modules", "dist", "build", "coverage", "logs", ".git", ".idea", ".vscode", "tmp", "out", "public", "static"]
IGNORE_FILES = [CONFIG_FILE, "tsconfig.json", "package.json", "package-lock.json", "pnpm-lock.yaml", "LICENSE", ".gitignore", ".gitmodules"]
IGNORE_EXTENSIONS = [
    ".log", ".csv", ".ini", ".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mp4", ".avi", ".mpg", ".mov", ".svg", ".webp", ".ico", ".lock", ".lockb", ".map",
    ".snap", ".snapshot", ".tsbuildinfo", ".code-workspace",
]

_LISTS = {"ignore": ("dirs", "files", "extensions", "globs"), "unignore": ("dirs", "files", "extensions"), "roles": ROLES}
_KEYS = (*_LISTS, "respectGitignore")


class ConfigError(ValueError):
    """A configuration that does not hold; ``issues`` lists all that is wrong."""

    def __init__(self, issues: list[str]):
        super().__init__("Invalid config:\n" + "\n".join(f"  {i}" for i in issues))
        self.issues = issues


@dataclass
class Config:
    """A resolved configuration."""

    ignore_dirs: list[str] = field(default_factory=lambda: list(IGNORE_DIRS))
    ignore_files: list[str] = field(default_factory=lambda: list(IGNORE_FILES))
    ignore_extensions: list[str] = field(default_factory=lambda: list(IGNORE_EXTENSIONS))
    ignore_globs: list[str] = field(default_factory=list)
    roles: dict[str, list[str]] = field(default_factory=dict)
    attributes: dict[str, list[str]] = field(default_factory=dict)
    respect_gitignore: bool = True


def _kind(value: Any) -> str:
    names = {type(None): "null", bool: "boolean", str: "string", int: "number", float: "number", list: "array", dict: "object"}
    return names.get(type(value), "undefined")


def _suggestion(key: str) -> str:
    close = [k for k in _KEYS if k.startswith(key[:3]) or key.startswith(k[:3])]
    return f' — did you mean "{close[0]}"?' if close else ""


def parse(data: Any) -> Config:
    """A configuration from parsed JSON; every issue is found before any is raised."""
    if not isinstance(data, dict):
        raise ConfigError([f"expected object, received {_kind(data)}"])
    issues: list[str] = []
    lists: dict[str, dict[str, list[str]]] = {}
    for name, keys in _LISTS.items():
        part = data.get(name, {})
        if not isinstance(part, dict):
            issues.append(f"{name}: expected object, received {_kind(part)}")
            part = {}
        lists[name] = {}
        for key in keys:
            value = part.get(key, [])
            if not isinstance(value, list):
                issues.append(f"{name}.{key}: expected array, received {_kind(value)}")
                value = []
            issues += [f"{name}.{key}.{i}: expected string, received {_kind(v)}" for i, v in enumerate(value) if not isinstance(v, str)]
            lists[name][key] = [v for v in value if isinstance(v, str)]
        issues += [f'Unknown key "{name}: {k}"{_suggestion(k)}' for k in part if k not in keys]
    respect = data.get("respectGitignore", True)
    if not isinstance(respect, bool):
        issues.append(f"respectGitignore: expected boolean, received {_kind(respect)}")
    issues += [f'Unknown key "{k}"{_suggestion(k)}' for k in data if k not in _KEYS]
    if issues:
        raise ConfigError(issues)

    def merged(defaults: list[str], key: str) -> list[str]:
        return [x for x in dict.fromkeys([*defaults, *lists["ignore"][key]]) if x not in lists["unignore"][key]]

    return Config(
        merged(IGNORE_DIRS, "dirs"), merged(IGNORE_FILES, "files"), merged(IGNORE_EXTENSIONS, "extensions"), lists["ignore"]["globs"], lists["roles"], {}, respect
    )


def _as_glob(pattern: str) -> str:
    pattern = pattern.removeprefix("/")
    return f"{pattern[:-1]}/**" if pattern.endswith("/") else pattern


def parse_gitignore(text: str) -> list[str]:
    """Globs of an ignore file; comments and exceptions are left out."""
    lines = (line.strip() for line in re.split(r"\r?\n", text))
    return [_as_glob(line) for line in lines if line and line[0] not in "#!"]


def parse_gitattributes(text: str) -> dict[str, list[str]]:
    """Globs by role of an attributes file's markers, but those unset or false."""
    # fixed values: markers and their roles
    markers = {"linguist-generated": "generated", "linguist-vendored": "vendored", "linguist-documentation": "docs"}
    out: dict[str, list[str]] = {role: [] for role in markers.values()}
    for line in re.split(r"\r?\n", text):
        pattern, *marks = line.split() or [""]
        if not pattern or pattern.startswith("#"):
            continue
        for mark in marks:
            name, _, value = mark.partition("=")
            if name in markers and value != "false":
                out[markers[name]].append(_as_glob(pattern))
    return out


def _read(path: str) -> str | None:
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def load(root: str, explicit: str | None = None) -> Config:
    """The configuration of a tree: the file named, or the one at its root, or the defaults; with its ignore and attributes files."""
    text = _read(explicit or os.path.join(root, CONFIG_FILE))
    if text is None and explicit:
        raise FileNotFoundError(f"Config file not found: {explicit}")
    try:
        config = Config() if text is None else parse(json.loads(text))
    except json.JSONDecodeError as error:
        raise ConfigError([f"not JSON: {error}"]) from None
    if config.respect_gitignore:
        config.ignore_globs = [*config.ignore_globs, *parse_gitignore(_read(os.path.join(root, ".gitignore")) or "")]
    config.attributes = parse_gitattributes(_read(os.path.join(root, ".gitattributes")) or "")
    return config
