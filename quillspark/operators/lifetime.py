"""Events of each session over its whole life, from partial results for each input file.

A file's partial has one row for each of its groups of equal events: the first one's place and session. It is kept under the
file's name with its size and time of change, and made again only when these differ. Groups are deduplicated across files by
the first file that has them, so counts are those of one pass over all files in their order.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import blank_to_null
from ..sources import ledger
from ..sources.folders import Folders
from .dedup import first_wins
from .productivity import eligible

PARTIAL = "file string, g binary, session_id string"


class Lifetime:
    """The partials at ``path`` of the ledgers in ``folder``: files ``<tag>.jsonl``, or folders of that name with part files."""

    def __init__(self, spark: SparkSession, folder: str, path: str) -> None:
        self.spark, self.folder, self.partials = spark, folder.rstrip("/"), Folders(spark, path)

    def files(self) -> dict[str, dict[str, tuple[str, int, int]]]:
        """For each ledger its files' (path, size, time) by name."""
        fs, found = self.partials.fs, {}
        for tag in ledger.FILES:
            place = f"{self.folder}/{tag}.jsonl"
            listed = fs.listing(place) if fs.exists(place) else []
            names = {p.rpartition("/")[2]: (p, size, time) for p, size, time in listed}
            found[tag] = {n: x for n, x in names.items() if not n.startswith(("_", "."))}
        return found

    def refresh(self) -> list[str]:
        """Reads the files that are new or changed, drops those that are gone; the keys that were read."""
        last, state = self.partials.state()
        put, read = {}, []
        present = set()
        for tag, files in self.files().items():
            changed = {}
            for name, (path, size, time) in files.items():
                present.add(key := f"{tag}/{name}")
                if (was := state.get(key)) is None or (was["size"], was["time"]) != (size, time):
                    changed[name] = (key, path, size, time)
            if not changed:
                continue
            events = eligible(ledger.read_events(self.spark, [path for _, path, _, _ in changed.values()], ledger.FILES[tag], tag))
            firsts = events.groupBy("file", F.unhex(F.md5(F.col("dedupe_group").cast("binary"))).alias("g")).agg(
                F.min_by(blank_to_null(F.col("session_id")), F.struct("block", "id")).alias("session_id"),
            )
            folder = self.partials.place("partial")
            firsts.withColumn("part", F.md5(F.col("file").cast("binary"))).repartition("part").write.partitionBy("part").parquet(f"{self.partials.at}/{folder}")
            for name, (key, _, size, time) in changed.items():
                part = f"{folder}/part={hashlib.md5(name.encode()).hexdigest()}"
                put[key] = {"folder": part if self.partials.fs.exists(f"{self.partials.at}/{part}") else None, "size": size, "time": time}
                read.append(key)
        gone = sorted(set(state) - present)
        if put or gone:
            self.partials.commit(put, gone, after=last)
        return read

    def counts(self) -> DataFrame:
        """session_id, events: of each group the first row, by ledger, file and line, if it has a session."""
        _, state = self.partials.state()
        rows = None
        for rank, tag in enumerate(ledger.FILES):
            folders = [v["folder"] for k, v in sorted(state.items()) if k.startswith(f"{tag}/") and v["folder"]]
            if folders or rows is None:
                part = self.partials.read(folders, PARTIAL).withColumn("rank", F.lit(rank))
                rows = part if rows is None else rows.unionByName(part)
        once = first_wins(rows, ["g"], ["rank", "file"])
        return once.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("events"))
