"""Daily aggregates of a ledger, kept up by day, and windows answered from them.

Sums over days would be wrong under dedup alone: which of a group's rows survives depends on the window. So a day keeps two
things. Groups that occur in one cell only, a day and a provider, add to sums by day, provider, model and origin. Groups
that occur in several keep the first row of each of their cells; a window takes those of its days and providers, dedups
them, and adds them to the sums. That is exact for every window of whole days, with or without providers.

``refresh`` reads the events of the days that changed, and of the days kept so far one column, to find groups that now
occur in several cells; the days of those are made anew from their cells, without their events. All changes are one commit.
Cells have a folder for each day. Sums and shared cells have one for each refresh, in the order of days, so that a window
opens few files; days that a later refresh made again are passed over, and when there are many such folders the next refresh
brings them together.
"""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import normalize as n
from ..session import cut
from ..sources.folders import Folders
from . import rollup
from .dedup import first_wins

DIMENSIONS = ("event_date", "provider", "model", "origin")
MEASURES = "calls long, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, cached_input_tokens long, reasoning_tokens long, total_tokens long, cost_estimate_usd double, unknown_pricing_events long"
NAMES = [x.split()[0] for x in MEASURES.split(", ")]
#: Folders of sums from which the next refresh makes one.
MANY = 6
SUMS = f"event_date date, provider string, model string, origin string, {MEASURES}"


def cells(events: DataFrame) -> DataFrame:
    """The first row of each group on a day and for a provider: the group's 128 bits, its place, the dimensions and what the
    row adds to the measures."""
    rows = events.where(~F.col("model").eqNullSafe(F.lit(n.SYNTHETIC))).withColumn("g", F.unhex(F.md5(F.col("dedupe_group").cast("binary"))))
    rows = rows.withColumns({"provider": F.col("provider_norm"), "model": n.model_name(F.col("model")), "origin": F.col("origin_norm")})
    first = F.min_by(F.struct("model", "origin", *rollup.INPUTS), "ord").alias("r")
    firsts = rows.groupBy("event_date", "provider", "g").agg(F.min("ord").alias("ord"), first)
    return firsts.select("event_date", "provider", "g", "ord", "r.*").select("event_date", "provider", "model", "origin", "g", "ord", *rollup.row_stats())


def sums(rows: DataFrame, by: list[str]) -> DataFrame:
    add = [F.coalesce(F.sum(c), F.lit(0).cast(rows.schema[c].dataType)).alias(c) for c in NAMES]
    return rows.groupBy(*by).agg(*add) if by else rows.agg(*add)


class Daily:
    """The aggregates at ``path``. Keys of its folders: ``cells``, ``sums`` and ``shared`` of each day."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folders = spark, Folders(spark, path)

    @staticmethod
    def keys(state: dict, kind: str, days: list[str]) -> list[str]:
        return [x["folder"] for d in days if (x := state.get(f"{kind}/{d}")) and x["folder"]]

    def write_days(self, rows: DataFrame, kind: str, days: list[str]) -> dict[str, dict]:
        """Writes rows, a folder for each day; entries for all of ``days``, also those without rows."""
        name = self.folders.place(kind)
        rows.withColumn("day", F.col("event_date").cast("string")).write.partitionBy("day").parquet(f"{self.folders.at}/{name}")
        fs = self.folders.fs
        there = {s.getPath().getName().partition("=")[2] for s in fs.fs.listStatus(fs.path(f"{self.folders.at}/{name}")) if s.isDirectory()}
        return {f"{kind}/{d}": {"folder": f"{name}/day={d}" if d in there else None} for d in days}

    def write(self, rows: DataFrame, kind: str, days: list[str]) -> dict[str, dict]:
        """Writes rows, days one after another, to one folder."""
        name = self.folders.place(kind)
        rows.repartitionByRange("event_date").sortWithinPartitions("event_date").write.parquet(f"{self.folders.at}/{name}")
        return {f"{kind}/{d}": {"folder": name} for d in days}

    def kept(self, state: dict, kind: str, days: list[str], schema: StructType | str) -> DataFrame:
        """The rows of some days from the folders that hold them now."""
        where: dict[str, list[str]] = {}
        for d in days:
            if x := state.get(f"{kind}/{d}"):
                where.setdefault(x["folder"], []).append(d)
        out = self.folders.read([], schema)
        for folder, own in where.items():
            out = out.unionByName(self.folders.read([folder], schema).where(F.col("event_date").isin([date.fromisoformat(d) for d in own])))
        return out

    def refresh(self, events: DataFrame, days: list[date | str]) -> list[str]:
        """Makes these days anew from the events that they have now; the days whose aggregates changed.

        Rows of other days in ``events`` are left alone: the filter reaches the scan."""
        last, state = self.folders.state()
        days = sorted(map(str, days))
        known = sorted(k.partition("/")[2] for k in state if k.startswith("cells/"))
        made = cells(events.where(F.col("event_date").isin([F.lit(d).cast("date") for d in days])))
        schema = made.schema
        put = self.write_days(made, "cells", days)
        at = state | put
        old = self.folders.read(self.keys(state, "cells", [d for d in known if d in days]), schema)
        new = self.folders.read(self.keys(put, "cells", days), schema)
        others = self.folders.read(self.keys(state, "cells", [d for d in known if d not in days]), schema)
        touched = new.select("g").unionByName(old.select("g")).distinct()
        # (days: at most those that are kept)
        near = [str(r[0]) for r in others.join(touched, "g", "left_semi").select("event_date").distinct().collect()]
        again = sorted({*days, *near})
        own = self.folders.read(self.keys(at, "cells", again), schema)
        every = self.folders.read(self.keys(at, "cells", sorted({*known, *days})), schema).select("g")
        several = cut(every.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"))
        whole = sums(own.join(several, "g", "left_anti"), list(DIMENSIONS))
        shared = own.join(several, "g", "left_semi")
        rest: list[str] = []
        if len({v["folder"] for k, v in state.items() if k.startswith("sums/")}) >= MANY:
            rest = [d for d in known if d not in again]
            whole = whole.unionByName(self.kept(state, "sums", rest, SUMS))
            shared = shared.unionByName(self.kept(state, "shared", rest, schema))
        put |= self.write(whole, "sums", [*again, *rest])
        put |= self.write(shared, "shared", [*again, *rest])
        # the schema of ``ord`` is the ledger's
        self.folders.commit(put | {"schema": {"folder": None, "json": schema.json()}}, after=last)
        return again

    def state(self, start: date | str, end: date | str) -> dict | None:
        """What is kept, if it has all days of a window."""
        state = self.folders.state()[1]
        first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
        return state if all(f"sums/{first + timedelta(k)}" in state for k in range((last - first).days + 1)) else None

    def window(self, state: dict, start: date | str, end: date | str, providers: list[str] | None = None) -> DataFrame:
        """Rows with the dimensions and measures whose sums are those of the deduplicated window."""
        days = [d for d in sorted(k.partition("/")[2] for k in state if k.startswith("sums/")) if str(start) <= d <= str(end)]
        whole = self.kept(state, "sums", days, SUMS)
        if "schema" not in state:
            return whole
        shared = self.kept(state, "shared", days, StructType.fromJson(json.loads(state["schema"]["json"])))
        if providers is not None:
            named = F.col("provider").isin(*[n.provider(F.lit(p)) for p in providers])
            whole, shared = whole.where(named), shared.where(named)
        columns = [*DIMENSIONS, *NAMES]
        return whole.select(columns).unionByName(first_wins(shared, ["g"], ["ord"]).select(columns))


def measures(
    daily: Daily | None, events: DataFrame, start: date | str, end: date | str, by: tuple[str, ...] = (), providers: list[str] | None = None,
    where: Column | None = None, grand_total: bool = False,
) -> DataFrame:
    """The measures of a window by some columns: from the daily aggregates if they have all its days and dimensions and no
    other condition is asked for, from the events otherwise. ``grand_total`` adds a row, with nulls, for all."""
    plain = daily is not None and where is None and set(by) <= set(DIMENSIONS)
    if plain and (state := daily.state(start, end)) is not None:
        rows = daily.window(state, start, end, providers)
    else:
        kept = events if where is None else events.where(where)
        rows = rollup.window(kept, start, end, providers)
        rows = rows.withColumns({"provider": F.col("provider_norm"), "model": n.model_name(F.col("model")), "origin": F.col("origin_norm")})
        rows = rows.select(*by, *rollup.row_stats())
    if not grand_total:
        return sums(rows, list(by))
    add = [F.coalesce(F.sum(c), F.lit(0).cast(rows.schema[c].dataType)).alias(c) for c in NAMES]
    return rows.groupingSets([[F.col(c) for c in by], []], *by).agg(*add)


def build(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Makes the aggregates of a folder's ledgers, and gives one row: the numbers of events, tasks and bus events, and the
    first and last time of an event."""
    from ..sources import ledger

    events = ledger.read_ledgers(spark, folder)
    daily = Daily(spark, path)
    daily.refresh(events, [r[0] for r in events.select("event_date").distinct().collect()])
    counts = events.agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    fs = daily.folders.fs
    tasks = ledger.read_tasks(spark, f"{folder}/tasks.json").count() if fs.exists(f"{folder}/tasks.json") else 0
    bus = ledger.read_bus_events(spark, f"{folder}/bus-events.jsonl").count() if fs.exists(f"{folder}/bus-events.jsonl") else 0
    return counts.select("events", F.lit(tasks).alias("tasks"), F.lit(bus).alias("bus_tasks"), "first_ts", "last_ts")
