"""Sentiment of sessions: sums, averages, the trend over the window's halves, top days and moods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n
from . import timegap
from .productivity import eligible

KEYS = ("profanity_count", "frustration_score", "appreciation_score", "mood_arc", "sentiment_intensity")


def covered(events: DataFrame, tasks: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each session whose task has any sentiment key (a null value counts, an absent one doesn't)."""
    spans = timegap.spans(eligible(events), ["session_id"]).select("session_id", F.to_date("start").alias("day"))
    known = tasks.where(F.col("chunk_date").isNull() & F.col("has_sentiment"))
    days = F.date_diff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    half = F.when(F.date_diff("day", F.lit(start).cast("date")) < days / 2, 1).otherwise(2)
    return spans.join(known, "session_id").select(
        "session_id",
        "day",
        half.alias("half"),
        F.greatest(n.as_int(F.col("profanity_count")), F.lit(0)).alias("profanity"),
        F.greatest(n.as_int(F.col("appreciation_count")), F.lit(0)).alias("thanks"),
        n.clamp(F.col("frustration_score")).alias("frustration"),
        n.clamp(F.col("appreciation_score")).alias("appreciation"),
        F.substring(n.blank_to_null(F.trim("mood_arc")), 1, 30).alias("mood"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """One row from ``covered``; none if it is empty."""
    days = rows.groupBy("day").agg(F.sum("profanity").alias("p"), F.sum("thanks").alias("t"), F.count("*").alias("n"))
    top = days.agg(F.max(F.struct("p", "n", "day")).alias("top"), F.max(F.struct("t", "n", "day")).alias("thanks"))
    halves = [F.avg(F.when(F.col("half") == h, F.col("frustration"))) for h in (1, 2)]
    sums = rows.agg(
        F.sum("profanity").alias("profanity_total"),
        F.sum("thanks").alias("appreciation_total"),
        F.avg("frustration").alias("frustration_avg"),
        F.avg("appreciation").alias("appreciation_avg"),
        n.stress_trend(*halves).alias("stress_trend"),
        F.count("*").alias("sessions_covered"),
    ).where("sessions_covered > 0")
    return sums.crossJoin(top).select(
        "*", F.col("top.day").alias("top_day"), F.col("top.p").alias("top_day_profanity"),
        F.col("thanks.day").alias("top_appreciation_day"),
    ).drop("top", "thanks").withColumn("frustration_label", n.sentiment_label(F.col("frustration_avg")))


def moods(rows: DataFrame, most: int = 3) -> DataFrame:
    """The most common moods: by number, then by name."""
    return rows.where("mood is not null").groupBy("mood").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), "mood").limit(most)


def daily(rows: DataFrame, start: str, end: str) -> DataFrame:
    """day, profanity, frustration: for every day of the window."""
    from .rollup import calendar

    by_day = rows.groupBy("day").agg(F.sum("profanity").alias("profanity"), F.avg("frustration").alias("frustration"))
    return calendar(rows.sparkSession, start, end).join(by_day, "day", "left").select(
        "day", F.coalesce("profanity", F.lit(0)).alias("profanity"), F.coalesce("frustration", F.lit(0.0)).alias("frustration"),
    )
