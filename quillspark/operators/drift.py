"""Drift detectors: the last days against the days before them, which leave the last ones out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from .ordered import at_rank, median, nearest_rank, upto


def limits(today: str, short: int, long: int) -> tuple[Column, Column, Column]:
    at = F.lit(today).cast("date")
    return F.date_sub(at, max(short, 1) - 1), F.date_sub(at, max(long, 1) - 1), at


def pair_totals(events: DataFrame, today: str, short: int = 7, long: int = 30) -> DataFrame:
    """provider, model, cost and output tokens of the short window and of the baseline before it."""
    recent, start, end = limits(today, short, long)
    rows = events.where(F.col("event_date").between(start, end)).select(
        F.col("provider_norm").alias("provider"), n.model_name(F.col("model")).alias("model"),
        (F.col("event_date") >= recent).alias("_new"), F.coalesce("cost_estimate_usd", F.lit(0.0)).alias("_cost"),
        "output_tokens",
    )
    part = lambda c, new: F.coalesce(F.sum(F.when(F.col("_new") == new, F.col(c))), F.lit(0))
    return rows.groupBy("provider", "model").agg(
        part("_cost", True).alias("short_cost"), part("output_tokens", True).alias("short_output"),
        part("_cost", False).alias("base_cost"), part("output_tokens", False).alias("base_output"),
    )


def cost_regressions(events: DataFrame, today: str, threshold: float = 1.2, min_output: int = 10, short: int = 7, long: int = 30) -> DataFrame:
    """Pairs whose cost per output token rose beyond the threshold, with the longest run of raised days (of equally long
    ones the latest; the whole short window where no day is raised)."""
    recent, _, end = limits(today, short, long)
    totals = pair_totals(events, today, short, long).where((F.col("short_output") >= min_output) & (F.col("base_cost") != 0) & (F.col("base_output") > 0) & (F.col("short_output") > 0))
    rates = totals.select(
        "provider", "model",
        (F.col("short_cost") / F.col("short_output")).alias("rate_short"),
        (F.col("base_cost") / F.col("base_output")).alias("rate_base"),
    ).where("rate_base > 0")
    found = rates.withColumn("ratio", F.col("rate_short") / F.col("rate_base")).where(F.col("ratio") > threshold)
    runs = elevated_runs(events, found.select("provider", "model", "rate_base"), recent, end, threshold)
    return found.join(runs, ["provider", "model"], "left").select(
        "provider", "model", "rate_short", "rate_base", "ratio", ((F.col("ratio") - 1) * 100).alias("delta_pct"),
        F.coalesce("run_start", recent).alias("window_start"), F.coalesce("run_end", end).alias("window_end"),
    ).orderBy(F.desc("ratio"), "provider", "model")


def elevated_runs(events: DataFrame, baselines: DataFrame, start: Column, end: Column, threshold: float) -> DataFrame:
    """provider, model, run_start, run_end: the longest run of days whose rate is over threshold times rate_base."""
    keys = ["provider", "model"]
    rows = events.where(F.col("event_date").between(start, end)).select(
        F.col("provider_norm").alias("provider"), n.model_name(F.col("model")).alias("model"), F.col("event_date").alias("day"),
        F.coalesce("cost_estimate_usd", F.lit(0.0)).alias("c"), F.col("output_tokens").alias("o"),
    )
    daily = rows.groupBy(*keys, "day").agg(F.sum("c").alias("c"), F.sum("o").alias("o")).where("o > 0")
    high = daily.join(baselines, keys).where((F.col("c") / F.col("o")) / F.col("rate_base") > threshold)
    island = F.date_sub(F.col("day"), F.row_number().over(Window.partitionBy(*keys).orderBy("day")))
    runs = high.withColumn("_run", island).groupBy(*keys, "_run").agg(F.count("*").alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    best = runs.groupBy(*keys).agg(F.max(F.struct("n", "b", "a")).alias("r"))
    return best.select(*keys, F.col("r.a").alias("run_start"), F.col("r.b").alias("run_end"))


def fingerprints(events: DataFrame) -> DataFrame:
    """provider, model, bucket (by the size of the prompt), day, cost."""
    prompt = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    return events.select(
        F.col("provider_norm").alias("provider"), n.model_name(F.col("model")).alias("model"),
        n.prompt_size(prompt).alias("bucket"), F.col("event_date").alias("day"),
        F.coalesce("cost_estimate_usd", F.lit(0.0)).alias("cost"),
    )


def slippage_baselines(events: DataFrame, today: str, min_events: int = 5, short: int = 7, long: int = 30) -> DataFrame:
    """For each fingerprint with enough recent events: numbers, medians of the window, the short part and the baseline,
    and the 95th percentile (nearest rank). Ranks come from counts of equal costs, not from a group's sorted rows."""
    recent, start, end = limits(today, short, long)
    keys = ["provider", "model", "bucket"]
    part = F.explode(F.array(F.lit("all"), F.when(F.col("day") >= recent, "new").otherwise("old")))
    rows = fingerprints(events).where(F.col("day").between(start, end)).select(*keys, part.alias("part"), "cost")
    is_ = lambda p: F.col("part") == p
    rows_of = lambda p: F.coalesce(F.max(F.when(is_(p), F.col("_c"))), F.lit(0))
    medians = {"median_cost": "all", "median_cost_7d": "new", "median_cost_baseline": "old"}
    p95 = lambda p: at_rank("cost", nearest_rank(0.95), is_(p))
    out = upto(rows, [*keys, "part"], "cost").groupBy(*keys).agg(
        rows_of("all").alias("events"), rows_of("new").alias("events_7d"),
        *[F.coalesce(median("cost", is_(p)), F.lit(0.0)).alias(k) for k, p in medians.items()],
        p95("all").alias("p95_cost"), p95("new").alias("p95_cost_7d"),
    )
    return out.where(F.col("events_7d") >= min_events).orderBy(F.desc("median_cost"), *keys)


def slippages(baselines: DataFrame, threshold: float = 1.3) -> DataFrame:
    """Fingerprints whose recent median rose beyond the threshold."""
    ratio = F.col("median_cost_7d") / F.col("median_cost_baseline")
    return baselines.where("median_cost_baseline > 0").withColumn("ratio", ratio).where(F.col("ratio") > threshold).withColumn("delta_pct", (F.col("ratio") - 1) * 100).orderBy(
        F.desc("ratio"), "provider", "model", "bucket",
    )
