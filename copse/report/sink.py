"""The JSON envelope of results of any size, written by tasks.

A listing is a DataFrame in its order. Each task renders its rows into a file of its own; the job commit puts the files of
the tasks that succeeded in order and removes what other attempts left. No row comes to the driver. The parts of a finished
folder, one after another in the order of their names, are the bytes that ``render.envelope`` gives for the collected
result. The folder must be one that all executors share.

    report = Report("/shared/out")
    outcome = runner.run(spark, "ctx", ".", listed=report.listing)
    report.finish("ctx", ".", outcome.result)
"""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from copse.report.render import envelope
from copse.report.results import plain

#: Spaces before a row: listings are members of the result, which is a member of the envelope.
MARGIN = "\n" + " " * 6
DONE = "_SUCCESS"
_PLACE = re.compile(r'"\\u0000listing:(\d+)"')


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote."""

    partition: int
    file: str
    rows: int


class ListingSink(DataSource):
    """Writes rows as members of a JSON list into a folder: ``format("json_listing")``."""

    @classmethod
    def name(cls) -> str:
        return "json_listing"

    def writer(self, schema, overwrite: bool) -> ListingWriter:
        return ListingWriter(self.options["path"])


class ListingWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator[Row]) -> Part:
        context = TaskContext.get()
        name, n = f"try-{context.partitionId():06d}-{context.taskAttemptId()}", 0
        with open(os.path.join(self.folder, name), "w", encoding="utf-8", newline="") as f:
            for row in rows:
                # line ends inside values are escaped, so those left are the layout's
                f.write("," + MARGIN + json.dumps(plain(row), indent=2, ensure_ascii=False).replace("\n", MARGIN))
                n += 1
        return Part(context.partitionId(), name, n)

    def commit(self, messages: list[Part | None]) -> None:
        kept = sorted((m for m in messages if m and m.rows), key=lambda m: m.partition)
        for i, m in enumerate(kept):
            path = os.path.join(self.folder, f"rows-{i:06d}")
            os.replace(os.path.join(self.folder, m.file), path)
            if i == 0:  # every task's rows begin with a comma; the list's begin with its bracket
                with open(path, "r+b") as f:
                    f.write(b"[")
        self._clear("try-")

    def abort(self, messages: list[Part | None]) -> None:
        self._clear("try-")

    def _clear(self, start: str) -> None:
        for name in os.listdir(self.folder):
            if name.startswith(start):
                os.remove(os.path.join(self.folder, name))


class Report:
    """A folder that becomes one envelope; it must not exist, or be empty."""

    def __init__(self, folder: str):
        self.folder = os.path.abspath(folder)
        os.makedirs(self.folder, exist_ok=True)
        if os.listdir(self.folder):
            raise FileExistsError(f"not empty: {folder}")
        self.listings: list[str] = []

    def listing(self, df: DataFrame, limit: int | None = None) -> str:
        """Write a listing at once; what is returned stands for it in the result."""
        staged = os.path.join(self.folder, f".listing-{len(self.listings)}")
        os.makedirs(staged)
        df.sparkSession.dataSource.register(ListingSink)
        (df if limit is None else df.limit(limit)).write.format("json_listing").mode("append").save(staged)
        self.listings.append(staged)
        return f"\0listing:{len(self.listings) - 1}"

    def finish(self, command: str, root: str, result: Any, unavailable: str | None = None) -> None:
        """Put the listings where the result has them, as ``part-000000`` and so on, then mark the folder as done."""
        pieces, n = _PLACE.split(envelope(command, root, result, unavailable)), 0
        for i, piece in enumerate(pieces):
            if i % 2:
                staged = self.listings[int(piece)]
                names = sorted(os.listdir(staged))
                for name in names:
                    os.replace(os.path.join(staged, name), self._part(n))
                    n += 1
                os.rmdir(staged)
                end = "\n    ]" if names else "[]"
            else:
                end = piece
            if end:
                with open(self._part(n), "w", encoding="utf-8", newline="") as f:
                    f.write(end)
                n += 1
        with open(os.path.join(self.folder, DONE), "w"):
            pass

    def _part(self, n: int) -> str:
        return os.path.join(self.folder, f"part-{n:09d}")


def copy_to(folder: str, out: TextIO) -> None:
    """A finished envelope's bytes, a part at a time."""
    if not os.path.exists(os.path.join(folder, DONE)):
        raise FileNotFoundError(f"no finished report: {folder}")
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(os.path.join(folder, name), encoding="utf-8", newline="") as f:
                shutil.copyfileobj(f, out)
