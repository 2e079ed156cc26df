"""Productivity: estimated hours without help against the time a human spent, with guards and explicit coverage."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..functions import privacy, text
from ..session import cut, shuffled
from . import rollup, timegap
from .ordered import at_rank, nearest_rank, upto

#: Minutes of attention that each covered session costs at least.
FLOOR_MINUTES = 5.0
#: A session's kinds of origin that count for task metrics, beside all of anthropic's.
HUMAN_ORIGINS = ("desktop", "tui")


def eligible(events: DataFrame) -> DataFrame:
    """Events that task metrics are made from."""
    p, o = F.col("provider_norm"), F.coalesce("origin_norm", F.lit(""))
    return events.where((p == "anthropic") | ((p == "openai") & o.isin(*HUMAN_ORIGINS)))


def units_by_session(events: DataFrame, tasks: DataFrame, gap_minutes: int = 2) -> DataFrame:
    """session_id, events, active_hours, baseline, effective, kind, start, end: sessions that have an estimate."""
    known = tasks.where("chunk_date is null").select(
        "session_id",
        n.effective_hours(F.col("human_corrected_hours"), F.col("ai_baseline_hours")).alias("baseline"),
    ).where("baseline is not null")
    units = timegap.gaps_by(timegap.with_session(events), ["session_id"], gap_minutes).join(known, "session_id")
    return units.withColumn(
        "_g",
        n.guarded_hours(F.col("baseline"), F.col("active_hours"), F.col("events")),
    ).select("*", "_g.hours", "_g.kind").withColumnRenamed("hours", "effective").drop("_g")


def units_by_day(events: DataFrame, tasks: DataFrame, gap_minutes: int = 2) -> DataFrame:
    """As by session, for each (session_id, day); days without an estimate have nulls."""
    known = tasks.where("chunk_date is not null").select(
        "session_id", F.col("chunk_date").alias("day"),
        n.effective_hours(F.col("human_corrected_hours"), F.col("ai_baseline_hours")).alias("baseline"),
    )
    daily = events.withColumn("day", F.col("event_date"))
    keys = ["session_id", "day"]
    units = timegap.gaps_by(timegap.with_session(daily), keys, gap_minutes).join(shuffled(known), keys, "left")
    guard = F.when(F.col("baseline").isNotNull(), n.guarded_hours(F.col("baseline"), F.col("active_hours"), F.col("events")))
    return units.withColumn("_g", guard).select("*", F.col("_g.hours").alias("effective"), F.col("_g.kind").alias("kind")).drop("_g")


def guard_sums() -> list[Column]:
    gap = F.col("effective") - F.col("baseline")
    ceiling = F.col("kind").startswith("ceiling")
    return [
        F.coalesce(F.sum("effective"), F.lit(0.0)).alias("hours_without_ai"),
        F.coalesce(F.sum("active_hours"), F.lit(0.0)).alias("active_hours_per_session_sum"),
        F.coalesce(F.sum((F.col("kind") == "floor").cast("long")), F.lit(0)).alias("baseline_floor_clamped"),
        F.coalesce(F.sum(F.when(F.col("kind") == "floor", gap)), F.lit(0.0)).alias("hours_floor_added"),
        F.coalesce(F.sum(ceiling.cast("long")), F.lit(0)).alias("baseline_ceiling_clamped"),
        F.coalesce(F.sum(F.when(ceiling, -gap)), F.lit(0.0)).alias("hours_ceiling_removed"),
        F.count("*").alias("sessions_covered"),
        F.count_distinct("session_id").alias("distinct_sessions_covered"),
    ]


def baseline_p95(units: DataFrame) -> DataFrame:
    """One row: the 95th percentile (nearest rank) of the estimated hours an event."""
    rates = upto(units.select((F.col("baseline") / F.col("events")).alias("rate")), [], "rate")
    return rates.agg(F.coalesce(at_rank("rate", nearest_rank(0.95)), F.lit(0.0)).alias("baseline_per_event_p95"))


def ratio(row: DataFrame) -> DataFrame:
    """Denominator, hours saved, multiplier and whether the floor decides, for rows of sums."""
    floor = F.col("distinct_sessions_covered") * (FLOOR_MINUTES / 60)
    covered = F.col("distinct_sessions_covered") > 0
    denominator = F.when(covered, F.greatest(F.col("human_attention_hours"), floor)).otherwise(F.col("active_hours"))
    return row.withColumn("denominator_hours", denominator).withColumn("hours_saved", F.col("hours_without_ai") - F.col("denominator_hours")).withColumn(
        "multiplier",
        F.coalesce(F.try_divide("hours_without_ai", F.nullif(F.col("denominator_hours"), F.lit(0.0))), F.lit(0.0)),
    ).withColumn("denominator_is_floor", covered & (floor > F.col("human_attention_hours")))


def together(rows: DataFrame, *more: DataFrame) -> DataFrame:
    """Frames of one row each side by side."""
    for other in more:
        rows = rows.crossJoin(other)
    return rows


def by_session(events: DataFrame, tasks: DataFrame, prompts: DataFrame, cached: DataFrame, gap_minutes: int = 2) -> DataFrame:
    """One row: the payload of session mode. Eligible events and units are made once, as all figures start from them."""
    own = cut(timegap.with_session(eligible(events)).select("session_id", "ts", "event_date"))
    units = cut(units_by_session(own, tasks, gap_minutes))
    covered = own.join(units.select("session_id"), "session_id", "left_semi")
    human = timegap.attention(units.select("session_id", F.lit(None).cast("date").alias("day")), prompts, cached, covered)
    return ratio(
        together(
            units.agg(*guard_sums()),
            baseline_p95(units),
            timegap.active_merged(covered, gap_minutes),
            timegap.union_hours(units.select("start", "end")).withColumnRenamed("hours", "calendar_hours"),
            human.select(F.col("hours").alias("human_attention_hours"), F.col("fallbacks").alias("human_attention_fallbacks")),
            own.agg(F.count_distinct("session_id").alias("sessions_total")),
        )
    )


def by_day(events: DataFrame, tasks: DataFrame, prompts: DataFrame, cached: DataFrame, today: str, gap_minutes: int = 2) -> DataFrame:
    """One row: the payload of day mode. Only past days count; the open day's figures are provisional and apart."""
    own = cut(timegap.with_session(eligible(events)).select("session_id", "ts", "event_date"))
    all_units = cut(units_by_day(own, tasks, gap_minutes))
    at = F.lit(today).cast("date")
    closed = all_units.where((F.col("day") < at) & F.col("baseline").isNotNull())
    opened = all_units.where((F.col("day") == at) & F.col("baseline").isNotNull())
    rows = own.withColumn("day", F.col("event_date"))
    covered = rows.join(closed.select("session_id", "day"), ["session_id", "day"], "left_semi")
    attention = lambda units: timegap.attention(units.select("session_id", "day"), prompts, cached, rows)
    number = lambda condition: F.coalesce(F.sum(condition.cast("long")), F.lit(0))
    counts = all_units.agg(
        number(F.col("day") < at).alias("units_eligible"),
        number((F.col("day") < at) & F.col("baseline").isNotNull()).alias("units_estimated"),
        number(F.col("day") == at).alias("units_open"),
    )
    provisional = opened.agg(
        F.count("*").alias("open_units_estimated"),
        F.coalesce(F.sum("effective"), F.lit(0.0)).alias("open_hours_without_ai"),
        F.count_distinct("session_id").alias("open_distinct_sessions"),
    )
    out = together(
        closed.agg(*guard_sums()),
        baseline_p95(closed),
        counts,
        timegap.active_merged(covered, gap_minutes),
        timegap.union_hours(closed.select("start", "end")).withColumnRenamed("hours", "calendar_hours"),
        timegap.union_hours(all_units.select("start", "end")).withColumnRenamed("hours", "window_calendar_hours"),
        attention(closed).select(F.col("hours").alias("human_attention_hours"), F.col("fallbacks").alias("human_attention_fallbacks")),
        attention(all_units).select(F.col("hours").alias("window_human_attention_hours")),
        provisional,
        attention(opened).select(F.col("hours").alias("open_human_attention_hours")),
    )
    unknown = F.col("units_eligible") - F.col("units_estimated")
    return ratio(out.withColumn("units_unknown", unknown).withColumn("window_complete", (F.col("units_eligible") > 0) & (unknown == 0)))


def by_periods(ledger: DataFrame, tasks: DataFrame, prompts: DataFrame, cached: DataFrame, today: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """days and the payload of day mode for each window of so many days that ends today; every window is deduplicated for
    itself."""
    rows = []
    for n_days in days:
        start = date.fromisoformat(today) - timedelta(days=n_days - 1)
        payload = by_day(rollup.window(ledger, start, today), tasks, prompts, cached, today)
        rows.append(payload.withColumn("days", F.lit(n_days)))
    return reduce(DataFrame.unionByName, rows)


def today_payload(ledger: DataFrame, tasks: DataFrame, prompts: DataFrame, cached: DataFrame, today: str, now: str) -> DataFrame:
    """One row: all that is shown of the open day, i.e. its totals, the budget of the last 5 and 24 hours, the sessions of the
    last 24 hours and their human hours with the ratio that may be shown."""
    day = rollup.window(ledger, today, today)
    at = F.lit(now).cast("timestamp_ntz")
    last = timegap.with_session(ledger).where(F.col("ts").between(at - F.expr("INTERVAL 24 HOURS"), at) & (F.col("model") != n.SYNTHETIC))
    return together(
        rollup.totals(day),
        rollup.budget(rollup.dedup_events(last), now),
        last.agg(F.count_distinct("session_id").alias("sessions_24h"), F.max("ts").alias("last_ts")),
        today_block(by_day(day, tasks, prompts, cached, today)).drop("active_hours"),
    )


def recent(ledger: DataFrame, now: str) -> DataFrame:
    """The deduplicated events of the last 24 hours, both ends included."""
    at = F.lit(now).cast("timestamp_ntz")
    rows = ledger.where(F.col("ts").between(at - F.expr("INTERVAL 24 HOURS"), at) & ~F.col("model").eqNullSafe(F.lit(n.SYNTHETIC)))
    return rollup.dedup_events(rows)


def today_sessions(ledger: DataFrame, tasks: DataFrame, now: str, limit: int = 50) -> DataFrame:
    """The sessions of the last 24 hours, the latest first, with what may be shown of their tasks."""
    rows = rollup.session_list(recent(ledger, now), tasks, limit)
    return rows.withColumn("brief_description", privacy.description(F.col("brief_description"))).orderBy(F.desc("last_ts"), "session_id")


def today_markers(ledger: DataFrame, tasks: DataFrame, messages: DataFrame, now: str, patterns: tuple[str, ...] = text.PROFANITY) -> DataFrame:
    """session_id, markers: marks in what users wrote in the last 24 hours, for the sessions of that time. A session whose
    transcript isn't there (``messages``: session_id, ts, role, text) has what was counted for it as a whole."""
    at = F.lit(now).cast("timestamp_ntz")
    known = recent(ledger, now).where(F.coalesce("session_id", F.lit("")) != "").select("session_id").distinct()
    late = (F.col("role") == "user") & (F.col("ts") >= at - F.expr("INTERVAL 24 HOURS"))
    counted = messages.groupBy("session_id").agg(F.coalesce(F.sum(F.when(late, text.count_markers(F.col("text"), patterns))), F.lit(0)).alias("_m"))
    whole = tasks.where("chunk_date is null").select("session_id", n.as_int(F.col("profanity_count")).alias("_t"))
    rows = known.join(counted, "session_id", "left").join(whole, "session_id", "left")
    return rows.select("session_id", F.coalesce("_m", "_t", F.lit(0)).cast("long").alias("markers"))


def public_block(rows: DataFrame) -> DataFrame:
    """The ratio as it may be shown: none (0) where the floor decides or where nothing is saved."""
    unsafe = F.col("denominator_is_floor") | (F.col("multiplier") < 1) | (F.col("hours_saved") < 0)
    shown = F.when(unsafe, 0.0).otherwise(F.col("multiplier"))
    saved = F.when(unsafe, 0.0).otherwise(F.col("hours_saved"))
    return rows.withColumn("shown_multiplier", shown).withColumn("shown_hours_saved", saved).withColumn("estimated_hours", F.col("denominator_hours") + saved)


def today_block(rows: DataFrame) -> DataFrame:
    """As ``public_block``, and none under half an hour of attention or above fifty; while the day is open the ratio
    comes from its provisional estimates, under the same guards."""
    block = public_block(rows)
    odd = (F.col("shown_multiplier") > 50) | (F.col("denominator_hours") < 0.5)
    is_open = (F.col("units_open") > 0) & (F.col("units_eligible") == 0)
    floor = F.col("open_distinct_sessions") * (FLOOR_MINUTES / 60)
    denominator = F.greatest(F.col("open_human_attention_hours"), floor)
    ratio = F.coalesce(F.try_divide("open_hours_without_ai", F.nullif(denominator, F.lit(0.0))), F.lit(0.0))
    fine = (F.col("open_human_attention_hours") >= floor) & (F.col("open_human_attention_hours") >= 0.5) & ratio.between(1, 50)
    shown = F.when(is_open, F.when(fine, ratio).otherwise(0.0)).when(odd, 0.0).otherwise(F.col("shown_multiplier"))
    saved = F.when(is_open, F.when(fine, F.col("open_hours_without_ai") - denominator)).when(odd, 0.0).otherwise(F.col("shown_hours_saved"))
    return block.withColumn("_m", shown).withColumn("shown_hours_saved", saved).withColumn("shown_multiplier", F.col("_m")).drop("_m")
