"""A file tree as a data source whose partitions are directories.

Spark's own file sources leave out names that start with a dot or an underscore. Here the driver lists only as many
directories as it takes to find enough partitions; tasks list the rest and read the files. Ignored directories are never
entered, and filters on paths that Spark hands down keep a task from entering, or opening, what cannot fit. The root must
be a folder that all executors share.

    spark.dataSource.register(TreeSource)
    spark.read.format("source_tree").option("ignore_dirs", '["node_modules"]').load(root).where("path LIKE 'src/%'")
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from copse.functions.paths import ignored
from copse.operators.scan import with_roles
from copse.sources.config import Config

#: Partitions that the driver looks for.
PARTITIONS = 64


@dataclass
class Directory(InputPartition):
    """A directory below the root, with all that lies in it or with its own files alone."""

    path: str
    deep: bool


def _listed(root: str, folder: str, ignore_dirs: list[str]) -> tuple[list[str], list[str]]:
    """Directories to enter and plain files of one directory, in order; links and specials are left out."""
    dirs, files = [], []
    with os.scandir(os.path.join(root, folder)) as entries:
        for entry in sorted(entries, key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_dir(follow_symlinks=False) and entry.name not in ignore_dirs:
                dirs.append(path)
            elif entry.is_file(follow_symlinks=False):
                files.append(path)
    return dirs, files


class TreeSource(DataSource):
    """``path, part, content`` of the files under a root; options:

    ``ignore_dirs`` (a JSON list of names), ``content`` (``false``: names alone, with a null content), ``chunk`` (characters
    of a part; 0, the default: whole files). Bytes that are no UTF-8 are replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, part int, content string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.ignore_dirs = json.loads(options.get("ignore_dirs", "[]"))
        self.content = options.get("content", "true").lower() == "true"
        self.chunk = int(options.get("chunk", "0"))
        self.starts: list[str] = []
        self.ends: list[str] = []
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("path",):
                yield f
            elif isinstance(f, StringStartsWith):
                self.starts.append(f.value)
            elif isinstance(f, StringEndsWith):
                self.ends.append(f.value)
            elif isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether a directory can hold a path that fits the filters."""
        inside = f"{folder}/"
        return all(inside.startswith(s) or s.startswith(inside) for s in self.starts) and (self.wanted is None or any(w.startswith(inside) for w in self.wanted))

    def _fits(self, path: str) -> bool:
        return all(path.startswith(s) for s in self.starts) and all(path.endswith(e) for e in self.ends) and (self.wanted is None or path in self.wanted)

    def _entered(self, folder: str) -> tuple[list[str], list[str]]:
        dirs, files = _listed(self.root, folder, self.ignore_dirs)
        return [d for d in dirs if self._may_hold(d)], [f for f in files if self._fits(f)]

    def partitions(self) -> list[Directory]:
        open_, shallow = [""], []
        while open_ and len(open_) + len(shallow) < PARTITIONS:
            folder = open_.pop(0)
            dirs, files = self._entered(folder)
            open_ += dirs
            if files:
                shallow.append(folder)
        return [Directory(f, False) for f in shallow] + [Directory(f, True) for f in open_] or [Directory("", False)]

    def read(self, partition: Directory) -> Iterator[tuple[str, int, str | None]]:
        open_ = [partition.path]
        while open_:
            dirs, files = self._entered(open_.pop())
            open_ += dirs if partition.deep else []
            for path in files:
                if self.content:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace", newline="") as f:
                        part, text = 0, f.read(self.chunk or None)
                        while text or not part:
                            yield path, part, text
                            part, text = part + 1, f.read(self.chunk) if self.chunk else ""
                else:
                    yield path, 0, None


def tree(spark: SparkSession, root: str, ignore_dirs: list[str], **options: object) -> DataFrame:
    """The data source over a root, with filters handed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(ignore_dirs=json.dumps(ignore_dirs), **options).load(os.path.abspath(root))


def read_tree(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """``path, content, role`` of every file under a root that is not ignored.

    Names are listed first and dealt out, so that no file that is ignored is opened and no task reads more files than
    others because its directory is large.
    """
    config = config or Config()
    names = tree(spark, root, config.ignore_dirs, content="false").select("path")
    names = names.where(~ignored(F.col("path"), config.ignore_dirs, config.ignore_files, config.ignore_extensions, config.ignore_globs))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(os.path.join(root, path), encoding="utf-8", errors="replace", newline="") as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read()]})

    dealt = names.repartition("path")
    return with_roles(dealt.mapInPandas(read, "path string, content string"), config.roles, config.attributes)
