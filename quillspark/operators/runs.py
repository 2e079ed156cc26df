"""Runs and their tasks: envelopes, claims in comments, order of dependent roles, sample evaluation, plans of work."""

from __future__ import annotations

from collections.abc import Iterable
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..session import shuffled
from .ordered import row_at
from .timegap import with_session

CLAIM = r"(?im)^claim:\s*(\S+)"
HEARTBEAT = r"(?im)^heartbeat:\s*(\S+)"
ENVELOPE = r"(?s)```json\s*(\{.*?\})\s*```\s*sha256:\s*([0-9a-f]{64})"


def dag_order(flow: list[str], dependencies: dict[str, Iterable[str]]) -> list[str]:
    """The roles of a flow with each after what it depends on, otherwise as given; ValueError for a cycle."""
    place = {role: i for i, role in enumerate(flow)}
    sorter = TopologicalSorter({role: [d for d in dependencies.get(role, ()) if d in place] for role in flow})
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"roles depend on each other: {e.args[1]}") from e
    out: list[str] = []
    ready: list[str] = []
    while sorter.is_active():
        ready = sorted([*ready, *sorter.get_ready()], key=place.__getitem__)
        out.append(ready.pop(0))
        sorter.done(out[-1])
    return out


def parse_comments(comments: DataFrame) -> DataFrame:
    """issue, id, at, kind, exec_id of comments (issue, id, at, body) that are claims or heartbeats."""
    claim, beat = (F.nullif(F.regexp_extract("body", p, 1), F.lit("")) for p in (CLAIM, HEARTBEAT))
    kind = F.when(claim.isNotNull(), "claim").when(beat.isNotNull(), "heartbeat")
    return comments.select("issue", "id", "at", kind.alias("kind"), F.coalesce(claim, beat).alias("exec_id")).where("kind is not null")


def envelopes(rows: DataFrame, text_col: str = "body", required: tuple[str, ...] = ("task_id", "kind")) -> DataFrame:
    """The rows with task (JSON text) and valid: the written digest is the task's, and the required keys are there."""
    task = F.regexp_extract(text_col, ENVELOPE, 1)
    keys = F.coalesce(F.json_object_keys(task), F.array().cast("array<string>"))
    valid = (F.sha2(task, 256) == F.regexp_extract(text_col, ENVELOPE, 2)) & F.forall(F.array(*map(F.lit, required)), lambda k: F.array_contains(keys, k))
    return rows.withColumn("task", F.nullif(task, F.lit(""))).withColumn("valid", F.coalesce(valid, F.lit(False)))


def lower_median(rows: DataFrame, keys: list[str], value: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Of each group the row in the middle by ``value`` and ``ties``, the lower one of two. Null values don't count."""
    return row_at(rows, keys, [value, *ties], F.expr("(_c - 1) div 2 + 1"))


# Sizes of sessions, from small to large.
SIZES = ("stub", "small", "medium", "large", "marathon")


def monotone_medians(samples: DataFrame) -> DataFrame:
    """bucket, median, falls: the median hours of each size of session (bucket, hours), and whether it is below the one
    before. A group of sizes, five rows at most, is in one order."""
    medians = samples.groupBy("bucket").agg(F.median("hours").alias("median"))
    rank = F.array_position(F.array(*map(F.lit, SIZES)), F.col("bucket"))
    before = F.lag("median").over(Window.orderBy(rank))
    return medians.select("bucket", "median", F.coalesce(F.col("median") < before, F.lit(False)).alias("falls"))


def rechunk_plan(units: DataFrame, tasks: DataFrame, multi_day_only: bool = True) -> DataFrame:
    """session_id, days, missing, baseline: sessions with an estimate of their own whose days lack one.

    ``units``: (session_id, day)."""
    whole = tasks.where("chunk_date is null").select(
        "session_id",
        n.effective_hours(F.col("human_corrected_hours"), F.col("ai_baseline_hours")).alias("baseline"),
    ).where("baseline is not null")
    daily = tasks.where("chunk_date is not null").select("session_id", F.col("chunk_date").alias("day"), F.lit(1).alias("known")).distinct()
    sums = units.distinct().join(shuffled(daily), ["session_id", "day"], "left").groupBy("session_id").agg(
        F.count("*").alias("days"),
        F.sum((F.col("known").isNull()).cast("long")).alias("missing"),
    )
    return sums.join(whole, "session_id").where((F.col("missing") > 0) & ((F.col("days") > 1) if multi_day_only else F.lit(True)))


def known_events(tasks_counts: DataFrame) -> DataFrame:
    """session_id, events: the least number of a session's events that its days' estimates (session_id, chunk_events) tell."""
    return tasks_counts.where("chunk_events is not null").groupBy("session_id").agg(F.sum("chunk_events").alias("events"))


def missing_hindsight(steps: DataFrame, notes: DataFrame) -> DataFrame:
    """run_id, ord, role: finished steps without a note (run_id, ord)."""
    return steps.where("status in ('done', 'ok')").join(notes.select("run_id", "ord"), ["run_id", "ord"], "left_anti").select("run_id", "ord", "role")


def recent_sessions(events: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """session_id, last_ts: sessions with an event in the last hours, the end included."""
    at = F.lit(now).cast("timestamp_ntz")
    return with_session(events).where(F.col("ts").between(at - F.expr(f"INTERVAL {hours} HOURS"), at)).groupBy("session_id").agg(F.max("ts").alias("last_ts"))


def imported_messages(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Calls of another application's tables: messages (id, session_id, data as JSON) with their session's folder, if it is
    known. Times are milliseconds: of completion, else of an update, else of creation."""
    number = lambda k: F.coalesce(F.get_json_object("data", f"$.{k}").try_cast("bigint"), F.lit(0))
    when = F.coalesce(*[n.epoch_ms(F.nullif(number(f"time.{k}"), F.lit(0))) for k in ("completed", "updated", "created")])
    joined = messages.alias("m").join(sessions.select(F.col("id").alias("_sid"), "directory"), F.col("m.session_id") == F.col("_sid"), "left")
    fields = {
        "input_tokens": "tokens.input", "output_tokens": "tokens.output", "reasoning_tokens": "tokens.reasoning",
        "cache_read_tokens": "tokens.cache.read", "cache_creation_tokens": "tokens.cache.write",
    }
    rows = joined.where(F.get_json_object("data", "$.role") == "assistant").select(
        F.col("m.id").alias("event_id"), "m.session_id",
        F.coalesce(F.get_json_object("data", "$.path.cwd"), "directory").alias("working_dir"),
        when.cast("timestamp_ntz").alias("ts"), F.get_json_object("data", "$.modelID").alias("model"),
        *[number(p).alias(c) for c, p in fields.items()],
        F.get_json_object("data", "$.cost").try_cast("double").alias("cost_estimate_usd"),
    )
    used = F.lit(False)
    for c in fields:
        used = used | (F.col(c) > 0)
    return rows.where(F.col("ts").isNotNull() & (used | (F.coalesce("cost_estimate_usd", F.lit(0.0)) > 0)))


def session_metrics(messages: DataFrame, gap_minutes: int = 2) -> DataFrame:
    """path, day, messages by role, span and active hours of transcripts (path, ts, role)."""
    from . import timegap

    rows = messages.where("ts is not null").withColumn("day", F.to_date("ts")).withColumn("session_id", F.col("path"))
    counts = rows.groupBy("path", "day").agg(
        F.sum((F.col("role") == "user").cast("long")).alias("user_messages"),
        F.sum((F.col("role") == "assistant").cast("long")).alias("assistant_messages"), F.min("ts").alias("start"),
        F.max("ts").alias("end"),
    )
    active = timegap.active_by(rows, ["path", "session_id", "day"], gap_minutes).select("path", "day", "active_hours")
    return counts.join(active, ["path", "day"])


def fingerprint(text: Column) -> Column:
    """A slug of a deliverable's first Markdown headings, or null without one."""
    heads = F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)), 1, 3)
    return F.when(F.size(heads) > 0, F.substring(F.trim(F.regexp_replace(F.lower(F.array_join(heads, " ")), "[^a-z0-9]+", "-"), F.lit("-")), 1, 60))
