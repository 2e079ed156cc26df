"""Appending to a ledger that is one file, as hooks do: never rewritten, a torn last line closed first.

A Python data source. Tasks write their lines to files beside the ledger; the commit, on the driver's side, ends an open last
line, appends the tasks' files in the order of their partitions through a buffer of fixed size, and removes them. A job that
fails leaves the ledger's bytes as they were (a task that outlives it may leave a file, which the next job removes). An append that dies half-way leaves a torn line, which readers skip and the
next append closes; rows that are then appended again are duplicates, which event ids tell. For one writer at a time, and
batches of the size of hooks' and imports'; large loads are folders of their own (``sources.folders``).
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "ledger_file"


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str
    lines: int


def local(path: str) -> str:
    """A path that Python can open: on a cluster the ledger lies in a folder that all machines mount."""
    return path[len("file:") :].replace("//", "/", 1) if path.startswith("file:") else path


def open_line(path: str) -> bool:
    """Whether a file's last line has no end; looks at one byte."""
    try:
        with open(path, "rb") as f:
            if not f.seek(0, os.SEEK_END):
                return False
            f.seek(-1, os.SEEK_END)
            return f.read(1) != b"\n"
    except FileNotFoundError:
        return False


class LedgerWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = local(path), uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        name = f"{self.path}.{self.job}-{part}-{attempt}"
        count = 0
        first = next(iterator, None)
        if first is None:
            return Written(part, name, 0)
        try:
            with open(name, "w", encoding="utf-8", newline="\n") as out:
                for row in chain([first], iterator):
                    out.write(row[0] + "\n")
                    count += 1
                out.flush()
                os.fsync(out.fileno())
        except BaseException:
            os.remove(name)
            raise
        return Written(part, name, count)

    def leftovers(self) -> list[str]:
        """Tasks' files beside the ledger: this job's, and those of tasks that outlived a failed job."""
        folder, name = os.path.split(self.path)
        folder = folder or "."
        return [os.path.join(folder, x) for x in os.listdir(folder) if re.fullmatch(re.escape(name) + r"\.[0-9a-f]{32}-\d+-\d+", x)]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if isinstance(m, Written) and m.lines), key=lambda m: m.part)
        if parts:
            torn = open_line(self.path)
            with open(self.path, "ab") as ledger:
                if torn:
                    ledger.write(b"\n")
                for m in parts:
                    with open(m.path, "rb") as lines:
                        shutil.copyfileobj(lines, ledger, 1 << 20)
                ledger.flush()
                os.fsync(ledger.fileno())
        for x in self.leftovers():
            os.remove(x)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for x in self.leftovers():
            os.remove(x)


class LedgerFile(DataSource):
    """One column of text, a line for each row."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        if overwrite:
            raise ValueError("a ledger is appended to")
        return LedgerWriter(self.options["path"])


def append_events(events: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """Appends rows as JSON objects, nulls and all, to the ledger at ``path``; in the order of some columns, if given."""
    spark = events.sparkSession
    spark.dataSource.register(LedgerFile)
    rows = events.orderBy(*order) if order else events
    lines = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format(NAME).option("path", path).mode("append").save()
