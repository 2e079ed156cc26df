"""Prices restated: whole ledgers at today's tables, and corrections for calls whose cache lasted an hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing


def price_day(ts: Column) -> Column:
    """The day that decides a call's price: the UTC day of a time in the session's zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts))


def repriced(events: DataFrame) -> DataFrame:
    """The ledger with new_cost: by the producer's price table; other producers keep what they wrote."""
    claude = pricing.claude_cost(
        F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_creation_tokens"), F.col("cache_read_tokens"),
        F.lit(0),
    )
    openai = pricing.openai_cost(F.col("model"), F.col("input_tokens"), F.col("cached_input_tokens"), F.col("output_tokens"), price_day(F.col("ts")))
    return events.withColumn(
        "new_cost",
        F.when(F.col("provider_norm") == "anthropic", claude).when(F.col("provider_norm") == "openai", openai).otherwise(F.col("cost_estimate_usd")),
    )


def exact_sum(dollars: Column) -> Column:
    """A sum of dollars that doesn't depend on the order of rows, added up as decimals of 12 digits (prices of a token have
    fewer); as doubles where a value is no such decimal. 0 without values."""
    whole = dollars.try_cast("decimal(28,12)")
    odd = F.count_if(dollars.isNotNull() & whole.isNull())
    return F.coalesce(F.when(odd > 0, F.sum(dollars)).otherwise(F.sum(whole).cast("double")), F.lit(0.0))


def recost_report(events: DataFrame) -> DataFrame:
    """provider, events, changed, old and new cost."""
    rows = repriced(events)
    changed = ~F.col("new_cost").eqNullSafe(F.col("cost_estimate_usd"))
    sums = [exact_sum(F.col(c)).alias(a) for c, a in (("cost_estimate_usd", "old_cost"), ("new_cost", "new_cost"))]
    return rows.groupBy(F.col("provider_norm").alias("provider")).agg(F.count("*").alias("events"), F.sum(changed.cast("long")).alias("changed"), *sums)


def cache_corrections(events: DataFrame, usage: DataFrame) -> DataFrame:
    """event_id, delta: what calls of the long cache cost more than was written, for those not yet corrected.

    ``usage``: message_uuid, cache_creation_1h_tokens, ord (the last of several rows counts)."""
    last = usage.groupBy("message_uuid").agg(F.max_by("cache_creation_1h_tokens", "ord").alias("hour"))
    done = events.where("correction_of is not null").select(F.col("correction_of").alias("event_id")).distinct()
    args = [F.col(c) for c in ("model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")]
    rows = events.where("is_correction = 0").join(done, "event_id", "left_anti").join(last, "message_uuid").where("hour > 0")
    delta = pricing.claude_cost(*args, F.col("hour")) - pricing.claude_cost(*args, F.lit(0))
    return rows.select("event_id", delta.alias("delta")).where("delta > 0")
