"""Time metrics from gaps between events. All times are TIMESTAMP_NTZ; hours are doubles.

Nothing orders all rows, a whole day or a whole session in one task. For gaps, times are first reduced to seconds where the
rows are, then ordered within hours, of 3,600 seconds at most however many rows there are; the hours' first and last times are
joined up afterwards. Unions of intervals are made of ranges of equal depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import DEPTH, HOUR, SECOND, instant, running, span

MINUTE = 60_000_000


def with_session(events: DataFrame) -> DataFrame:
    return events.where((F.coalesce("session_id", F.lit("")) != "") & F.col("ts").isNotNull())


def gaps_by(times: DataFrame, keys: list[str], gap_minutes: float, width: int = HOUR) -> DataFrame:
    """keys, events, active_hours, start, end: the rows of each group, the sum of the gaps of at most ``gap_minutes`` between
    them, the first time and the last.

    Gaps within a second (or within the limit, if that is shorter) all count and add up to the span of its times."""
    limit, own = int(gap_minutes * MINUTE), [*keys, "_range"]
    unit = max(1, min(SECOND, limit))
    near = lambda c: F.coalesce(F.sum(F.when(F.col(c) <= limit, F.col(c))), F.lit(0))
    at = times.select(*keys, "ts", instant("ts").alias("at")).withColumn("_range", span("at", width)).withColumn("_unit", span("at", unit))
    units = at.groupBy(*own, "_unit").agg(
        F.count("*").alias("_rows"), F.min("at").alias("_first"), F.max("at").alias("_last"), F.min("ts").alias("_start"), F.max("ts").alias("_end"),
    )
    inner = units.withColumn("_gap", F.col("_first") - F.lag("_last").over(Window.partitionBy(*own).orderBy("_unit")))
    ranges = inner.groupBy(*own).agg(
        F.sum("_rows").alias("_rows"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        (near("_gap") + F.coalesce(F.sum(F.col("_last") - F.col("_first")), F.lit(0))).alias("_in"), F.min("_start").alias("_start"), F.max("_end").alias("_end"),
    )
    joined = ranges.withColumn("_over", F.col("_first") - F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range")))
    hours = (F.coalesce(F.sum("_in"), F.lit(0)) + near("_over")) / HOUR
    return joined.groupBy(*keys).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("events"), hours.alias("active_hours"), F.min("_start").alias("start"),
        F.max("_end").alias("end"),
    )


def active_by(events: DataFrame, keys: list[str], gap_minutes: int = 2) -> DataFrame:
    """keys, events, active_hours: the sum of the gaps of at most ``gap_minutes`` between a group's events."""
    return gaps_by(with_session(events), keys, gap_minutes).drop("start", "end")


def merged_hours(times: DataFrame, gap_minutes: int) -> DataFrame:
    """One row, hours: gaps of at most ``gap_minutes`` in the pooled times ``ts`` of all rows."""
    return gaps_by(times.where("ts is not null"), [], gap_minutes).select(F.col("active_hours").alias("hours"))


def active_merged(events: DataFrame, gap_minutes: int = 2) -> DataFrame:
    return merged_hours(with_session(events), gap_minutes).withColumnRenamed("hours", "active_hours")


def union_hours(spans: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row, hours: how long at least one of the spans (start, end) lasts; touching ones are one.

    A span is two points, which open and close it; time counts while more are open than closed."""
    ends = F.array(F.struct(instant("start").alias("at"), F.lit(1).alias("open")), F.struct(instant("end").alias("at"), F.lit(-1).alias("open")))
    points = spans.where("start < end").select(F.explode(ends).alias("p")).select("p.*")
    rows = running(points.groupBy("at").agg(F.sum("open").alias("open")), ["at"], ["open"], depth)
    return rows.agg((F.coalesce(F.sum(F.when(F.col("open") > 0, F.col("_next") - F.col("at"))), F.lit(0)) / HOUR).alias("hours"))


def spans(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, events."""
    return with_session(events).groupBy(*keys).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("events"))


def attention(units: DataFrame, prompts: DataFrame, cached: DataFrame, events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """One row, hours and fallbacks: the human's time in covered units.

    ``units``: (session_id, day or null for a whole session). ``prompts``, ``cached`` and ``events`` hold (session_id,
    ts): live prompts, else cached ones, restricted to the unit's day or to the session's active days; a unit that has
    none takes the session's events instead and counts as a fallback."""
    live = prompts.select("session_id", "ts").distinct()
    frozen = cached.select("session_id", "ts").distinct().join(live.select("session_id").distinct(), "session_id", "left_anti")
    human = live.unionByName(frozen).withColumn("day", F.to_date("ts"))
    ai = events.select("session_id", "ts").withColumn("day", F.to_date("ts"))
    # a whole session is written as its active days, with no day of its own to be told from them
    u = units.select("session_id", F.col("day").alias("unit_day")).distinct().withColumn("unit", F.coalesce(F.col("unit_day").cast("string"), F.lit("all")))
    whole = u.where("unit_day is null").select("session_id", "unit").join(ai.select("session_id", "day").distinct(), "session_id")
    dated = u.where("unit_day is not null").select("session_id", "unit", F.col("unit_day").alias("day"))
    days = whole.unionByName(dated)
    own = cut(days.join(human, ["session_id", "day"]).select("session_id", "unit", "ts"))
    missing = u.select("session_id", "unit").join(own.select("session_id", "unit").distinct(), ["session_id", "unit"], "left_anti")
    spare = days.join(missing, ["session_id", "unit"]).join(ai, ["session_id", "day"]).select("session_id", "unit", "ts")
    return merged_hours(own.unionByName(spare).select("ts"), gap_minutes).crossJoin(missing.agg(F.count("*").alias("fallbacks")))
