"""What is to be estimated next, and increments after a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..session import shuffled
from .timegap import with_session

#: Categories of closed days in the order in which they are taken.
CATEGORIES = ("missing", "codex_blind", "compaction_input", "partial_day")


def units(events: DataFrame) -> DataFrame:
    """session_id, day, provider: a unit with any of anthropic's events is claude's."""
    claude = F.max((F.col("provider_norm") == "anthropic").cast("int")) == 1
    return with_session(events).groupBy("session_id", F.col("event_date").alias("day")).agg(F.when(claude, "claude").otherwise("codex").alias("provider"))


def with_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    known = tasks.where("chunk_date is not null").select(
        "session_id", F.col("chunk_date").alias("day"),
        n.effective_hours(F.col("human_corrected_hours"), F.col("ai_baseline_hours")).alias("hours"), "day_input_version",
        "estimation_mode", "input_read_at",
    )
    return rows.join(shuffled(known), ["session_id", "day"], "left")


def closed_days(events: DataFrame, tasks: DataFrame, today: str, *, version: int, fixed_at: str, mode: str, compacted: DataFrame | None = None) -> DataFrame:
    """session_id, day, provider, category, hours: past days without an estimate, or with one from an outdated or an
    incomplete input. ``compacted``: (session_id, day) whose old input held a summary."""
    rows = with_tasks(units(events).where(F.col("day") < F.lit(today).cast("date")), tasks)
    if compacted is not None:
        rows = rows.join(compacted.select("session_id", "day").distinct().withColumn("summed", F.lit(True)), ["session_id", "day"], "left")
    else:
        rows = rows.withColumn("summed", F.lit(False))
    old = ~(F.coalesce("day_input_version", F.lit(0)) >= version) & (F.coalesce("estimation_mode", F.lit("")).eqNullSafe(mode) | F.coalesce(F.col("input_read_at") < F.lit(fixed_at).cast("timestamp_ntz"), F.lit(False)))
    category = (
        F.when(F.col("hours").isNull(), "missing")
        .when(old & (F.col("provider") == "codex"), "codex_blind")
        .when(old & (F.col("provider") == "claude") & F.coalesce("summed", F.lit(False)), "compaction_input")
        .when(F.coalesce(F.to_date("input_read_at") <= F.col("day"), F.lit(False)), "partial_day")
    )
    return rows.select("session_id", "day", "provider", category.alias("category"), "hours").where("category is not null")


def in_order(queue: DataFrame) -> DataFrame:
    """The newest day first, then by category, then by session."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    return queue.orderBy(F.desc("day"), rank, "session_id")


def open_day(events: DataFrame, tasks: DataFrame, today: str, now: str, hours: int) -> DataFrame:
    """session_id, provider, hours: today's units without an estimate, or with one older than so many hours."""
    rows = with_tasks(units(events).where(F.col("day") == F.lit(today).cast("date")), tasks)
    stale = F.col("input_read_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    return rows.where(F.col("hours").isNull() | stale).select("session_id", "provider", "hours")


def pending(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """session_id: sessions without an estimate."""
    known = tasks.where(F.col("chunk_date").isNull() & n.effective_hours(F.col("human_corrected_hours"), F.col("ai_baseline_hours")).isNotNull()).select("session_id")
    return with_session(events).select("session_id").distinct().join(known, "session_id", "left_anti")


def after_watermark(records: DataFrame, marks: DataFrame) -> DataFrame:
    """A stream's records (stream, ord, id) after its mark (stream, mark); all of them if there is no mark or it isn't found."""
    at = records.join(marks, "stream").where(F.col("id") == F.col("mark")).groupBy("stream").agg(F.max("ord").alias("_at"))
    return records.join(at, "stream", "left").where(F.col("_at").isNull() | (F.col("ord") > F.col("_at"))).drop("_at")


def stratified(sessions: DataFrame, k: int) -> DataFrame:
    """The first k sessions, by id, of each size."""
    rows = sessions.withColumn("bucket", n.session_size(F.col("events")))
    return rows.withColumn(
        "_n",
        F.row_number().over(Window.partitionBy("bucket").orderBy("session_id")),
    ).where(F.col("_n") <= k).select("session_id", "bucket", "events")


def saturated(events: DataFrame, tasks: DataFrame, most: int) -> DataFrame:
    """The sessions with the most events for an estimated hour."""
    known = tasks.where("chunk_date is null").select(
        "session_id",
        n.effective_hours(F.col("human_corrected_hours"), F.col("ai_baseline_hours")).alias("b"),
    ).where("b is not null")
    counts = with_session(events).groupBy("session_id").agg(F.count("*").alias("events"))
    rows = counts.join(known, "session_id").select("session_id", (F.col("events") / F.greatest(F.col("b"), F.lit(0.1))).alias("saturation"))
    return rows.orderBy(F.desc("saturation"), "session_id").limit(most)
