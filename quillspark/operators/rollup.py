"""Rollups of a deduplicated ledger (see ``sources.ledger`` for its columns)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from .dedup import dedup_events

# Monthly prices of subscriptions in US dollars, and days of a month.
SUBSCRIPTIONS = {"anthropic": 200.0, "openai": 200.0, "openrouter": 0.0, "opencode": 0.0}
MONTH_DAYS = 30.0


def window(events: DataFrame, start: date | str, end: date | str, providers: list[str] | None = None) -> DataFrame:
    """The deduplicated ledger of some days (both included) and providers, by any of their names: the filters come first and
    reach the scan."""
    rows = events.where(F.col("event_date").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
    rows = rows.where(~F.col("model").eqNullSafe(F.lit(n.SYNTHETIC)))
    if providers is not None:
        rows = rows.where(F.col("provider_norm").isin(*[n.provider(F.lit(p)) for p in providers]))
    return dedup_events(rows)


#: What the measures are made of.
INPUTS = (
    "is_correction", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cached_input_tokens",
    "reasoning_tokens", "total_tokens", "cost_estimate_usd",
)


def row_stats() -> list[Column]:
    """What a row adds to each measure. Corrections restate money; they are no calls."""
    c = {name: F.col(name) for name in INPUTS}
    tokens = [c[x] for x in ("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]
    return [
        (1 - c["is_correction"]).cast("long").alias("calls"),
        n.uncached_input(c["input_tokens"], c["cached_input_tokens"]).cast("long").alias("input_tokens"),
        c["output_tokens"].cast("long").alias("output_tokens"),
        (c["cache_read_tokens"] + c["cached_input_tokens"]).cast("long").alias("cache_read_tokens"),
        *[c[x].cast("long").alias(x) for x in ("cache_creation_tokens", "cached_input_tokens", "reasoning_tokens")],
        n.total_tokens(*tokens).cast("long").alias("total_tokens"),
        c["cost_estimate_usd"].alias("cost_estimate_usd"),
        c["cost_estimate_usd"].isNull().cast("long").alias("unknown_pricing_events"),
    ]


def stats() -> list[Column]:
    """The measures of every rollup. Corrections restate money; they are no calls."""
    return [
        F.coalesce(F.sum(1 - F.col("is_correction")), F.lit(0)).cast("long").alias("calls"),
        F.coalesce(F.sum(n.uncached_input(F.col("input_tokens"), F.col("cached_input_tokens"))), F.lit(0)).alias("input_tokens"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("output_tokens",)],
        F.coalesce(F.sum(F.col("cache_read_tokens") + F.col("cached_input_tokens")), F.lit(0)).alias("cache_read_tokens"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cache_creation_tokens", "cached_input_tokens", "reasoning_tokens")],
        F.coalesce(
            F.sum(n.total_tokens(*[F.col(c) for c in ("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])),
            F.lit(0),
        ).alias("total_tokens"),
        F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost_estimate_usd"),
        F.coalesce(F.sum(F.col("cost_estimate_usd").isNull().cast("long")), F.lit(0)).alias("unknown_pricing_events"),
    ]


def by_model(events: DataFrame) -> DataFrame:
    """provider, model, measures: one row for each pair and one, with nulls for both, for all."""
    rows = events.withColumn("provider", F.col("provider_norm")).withColumn("model", n.model_name(F.col("model")))
    return rows.groupingSets([[F.col("provider"), F.col("model")], []], F.col("provider"), F.col("model")).agg(*stats())


def totals(events: DataFrame) -> DataFrame:
    return events.agg(*stats())


def by_provider(events: DataFrame) -> DataFrame:
    """Measures, the number of models and the calls of each, for each provider."""
    rows = events.withColumn("provider", F.col("provider_norm")).withColumn("model", n.model_name(F.col("model")))
    calls = rows.groupBy("provider", "model").agg(F.sum(1 - F.col("is_correction")).alias("c")).where("c > 0")
    models = calls.groupBy("provider").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "c")))).alias("models"))
    return rows.groupBy("provider").agg(*stats()).join(models, "provider", "left")


def by_origin(events: DataFrame) -> DataFrame:
    return events.groupBy(
        F.col("provider_norm").alias("provider"), F.coalesce("origin_norm", F.lit("unknown")).alias("origin"),
    ).agg(*stats()).orderBy("provider", F.desc("cost_estimate_usd"), F.desc("calls"), "origin")


def by_day(events: DataFrame) -> DataFrame:
    return events.groupBy("event_date").agg(*stats())


def cache_hit_percent(read: Column, tokens: Column) -> Column:
    """The share of cached input in percent, 0 where there is none; unrounded."""
    return F.coalesce(F.try_divide(read * 100, F.nullif(read + tokens, F.lit(0))), F.lit(0.0))


def subscription_cost(events: DataFrame, days: int) -> DataFrame:
    """One row: what the providers' subscriptions cost in so many days."""
    present = events.select(F.col("provider_norm").alias("p")).distinct()
    price = F.lit(0.0)
    for name, monthly in SUBSCRIPTIONS.items():
        price = F.when(F.col("p") == name, monthly).otherwise(price)
    return present.agg(F.count("*").alias("providers"), (F.coalesce(F.sum(price), F.lit(0.0)) / MONTH_DAYS * days).alias("subscription_usd"))


def model_shares(events: DataFrame) -> DataFrame:
    """model, cost, percent of all cost; synthetic and unnamed models left out."""
    rows = events.where(~F.lower(F.coalesce("model", F.lit(""))).isin("<synthetic>", "synthetic", "unknown", ""))
    cost = rows.groupBy("provider_norm", "model").agg(F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"))
    total = F.sum("cost").over(Window.partitionBy())
    return cost.select(
        F.col("provider_norm").alias("provider"), "model", n.model_short(F.col("model")).alias("label"), "cost",
        F.coalesce(F.try_divide(F.col("cost") * 100, F.nullif(total, F.lit(0.0))), F.lit(0.0)).alias("percent"),
    )


def most_common(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value: each group's most frequent value, of equally frequent ones the least."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    best = F.min_by(F.col(value), F.struct((-F.col("_n")).alias("a"), F.col(value).alias("b")))
    return counts.groupBy(*keys).agg(best.alias(value))


def sessions(events: DataFrame) -> DataFrame:
    """session_id, first and last time, calls, cost, most common model."""
    rows = events.where(F.coalesce("session_id", F.lit("")) != "").withColumn("model", n.model_name(F.col("model")))
    spans = rows.groupBy("session_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(1 - F.col("is_correction")).alias("calls"),
        F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"),
    )
    return spans.join(most_common(rows, ["session_id"], "model"), "session_id")


def session_list(events: DataFrame, tasks: DataFrame, limit: int) -> DataFrame:
    """The latest sessions with what is known about their task; without a task its columns are null."""
    joined = sessions(events).join(
        tasks.where("chunk_date is null").select(
            "session_id", "brief_description",
            n.effective_hours(F.col("human_corrected_hours"), F.col("ai_baseline_hours")).alias("baseline_hours"),
        ),
        "session_id", "left",
    )
    return joined.orderBy(F.desc("last_ts"), "session_id").limit(limit)


def models_by_calls(events: DataFrame) -> DataFrame:
    """provider, model, calls: a provider's models, the most called first, of equally called ones the first by name."""
    rows = events.groupBy(F.col("provider_norm").alias("provider"), n.model_name(F.col("model")).alias("model"))
    return rows.agg(F.sum(1 - F.col("is_correction")).cast("long").alias("calls")).orderBy("provider", F.desc("calls"), "model")


def session_ids(events: DataFrame) -> DataFrame:
    """session_id, first: the sessions in the order in which they come up, told by their first event's place."""
    named = events.where(F.coalesce("session_id", F.lit("")) != "")
    return named.groupBy("session_id").agg(F.min("ord").alias("first")).orderBy("first")


def period(today: date, days: int = 1, start: str | None = None, end: str | None = None) -> tuple[date, date]:
    """The first and the last day of what is asked for: two days, one of them with the number of days, or the last days."""
    length = timedelta(max(days, 1) - 1)
    first, last = (x and date.fromisoformat(x) for x in (start, end))
    return first or (last or today) - length, last or today


def calendar(spark, start: date | str, end: date | str) -> DataFrame:
    """day: every day from start to end."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))).alias("day"))


def timeseries(events: DataFrame, metric: Column, start: date | str, end: date | str) -> DataFrame:
    """day, value: a measure for every day of the window, 0 on days without events."""
    daily = events.groupBy("event_date").agg(metric.alias("value"))
    days = calendar(events.sparkSession, start, end)
    return days.join(daily, F.col("day") == F.col("event_date"), "left").select("day", F.coalesce("value", F.lit(0)).alias("value"))


def metric(name: str) -> Column:
    if name == "cost":
        return F.sum("cost_estimate_usd")
    if name == "calls":
        return F.sum(1 - F.col("is_correction"))
    if name == "sessions":
        return F.count_distinct("session_id")
    return F.sum(n.total_tokens(*[F.col(c) for c in ("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]))


def periods(events: DataFrame, today: str, days: tuple[int, ...]) -> DataFrame:
    """days, calls, cost, sessions: totals of the windows of so many days that end today, from one scan of the longest.

    Dedup runs once, over the longest window: an event that was first seen before a shorter window isn't new in it."""
    at = F.lit(today).cast("date")
    rows = dedup_events(events.where(F.col("event_date").between(F.date_sub(at, max(days) - 1), at) & ~F.col("model").eqNullSafe(F.lit(n.SYNTHETIC))))
    age = F.date_diff(at, F.col("event_date"))
    each = rows.withColumn("days", F.explode(F.filter(F.array(*map(F.lit, days)), lambda k: k > age)))
    return each.groupBy("days").agg(
        F.sum(1 - F.col("is_correction")).cast("long").alias("calls"),
        F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"),
        F.count_distinct(n.blank_to_null(F.col("session_id"))).alias("sessions"),
    )


# Estimated limits of tokens in five hours.
LIMITS = {"max5x": 440_000, "max20x": 1_700_000}


def budget(events: DataFrame, now: str, limits: dict[str, int] | None = None) -> DataFrame:
    """One row: anthropic's tokens, cache tokens and cost of the last 5 and 24 hours (both ends included), and the tokens'
    share of the limits in percent."""
    at = F.lit(now).cast("timestamp_ntz")
    total = n.total_tokens(*[F.col(c) for c in ("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")])
    cache = F.col("cache_read_tokens") + F.col("cached_input_tokens") + F.col("cache_creation_tokens")
    day = events.where(F.col("ts").between(at - F.expr("INTERVAL 24 HOURS"), at) & (F.col("provider_norm") == "anthropic"))
    recent = F.col("ts") >= at - F.expr("INTERVAL 5 HOURS")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = day.agg(
        zero(F.when(recent, total)).alias("tokens_5h"), zero(F.when(recent, cache)).alias("cache_5h"),
        zero(total).alias("tokens_24h"), zero(cache).alias("cache_24h"), zero(1 - F.col("is_correction")).alias("calls_24h"),
        F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost_24h"),
    )
    for name, most in (limits or LIMITS).items():
        out = out.withColumn(f"percent_{name}", n.percent(F.col("tokens_5h"), F.lit(most)))
    return out
