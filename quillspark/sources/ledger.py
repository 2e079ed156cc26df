"""Scans of append-only JSON-lines ledgers, task maps, bus events and caches.

Lines are read as text, so a broken line costs only itself. Values go through VARIANT with lenient casts: numbers written
as text count, what can't be read is 0 (or null where null means something else than 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..operators.dedup import dedupe_group

#: file name without its ending: (tag, default provider)
FILES = {"claude": "anthropic", "codex": "openai", "openclaw": "openrouter", "opencode": "opencode", "dscall": "openrouter"}
INTEGERS = (
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cached_input_tokens", "reasoning_tokens",
    "total_tokens", "tool_uses", "cache_creation_1h_tokens", "cache_creation_5m_tokens",
)
STRINGS = (
    "session_id", "message_uuid", "model", "working_dir", "stop_reason", "provider", "codex_origin", "originator", "codex_source",
    "source", "openclaw_source", "opencode_agent", "opencode_provider_id", "correction_of", "kind", "reason", "agent_id",
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, v (a JSON object), file, block and id: lines that are objects; within a file, splits come by their start and
    lines within a split by the id."""
    return parsed(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")))


def parsed(raw: DataFrame) -> DataFrame:
    """Lines (value, ...) that are JSON objects, with them as v; a broken line costs only itself."""
    # a generator's column: as a plain one it would be parsed anew for each place in the filters that come after it
    rows = raw.where(F.trim("value") != "").select("*", F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    return rows.where(F.schema_of_variant("v").startswith("OBJECT"))


def get(key: str, kind: str, v: str = "v") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def text(key: str, v: str = "v") -> Column:
    return get(key, "string", v)


def integer(key: str, v: str = "v") -> Column:
    return F.coalesce(get(key, "bigint", v), F.lit(0).cast("bigint"))


def optional(key: str, kind: str) -> Column:
    """Null where it is absent or null, 0 where it can't be read."""
    return F.when(F.coalesce(get(key, "string"), F.lit(None)).isNull(), None).otherwise(F.coalesce(get(key, kind), F.lit(0).cast(kind)))


def local_time(raw: Column) -> Column:
    """A time as the session's zone has it; text without an offset is in that zone already."""
    return F.try_to_timestamp(raw).cast("timestamp_ntz")


def read_events(spark: SparkSession, path: str, default_provider: str, tag: str) -> DataFrame:
    """Normalized events of one ledger."""
    return events_of(lines(spark, path), default_provider, tag)


def events_of(rows: DataFrame, default_provider: str, tag: str) -> DataFrame:
    """Normalized events of a ledger's lines: those without a readable time and synthetic ones are left out."""
    columns = [text(c).alias(c) for c in STRINGS] + [integer(c).alias(c) for c in INTEGERS]
    rows = rows.select(
        "file", "block", "id", F.col("value").alias("raw_json"), local_time(text("ts")).alias("ts"), text("ts").alias("ts_raw"),
        *columns,
        optional("cost_estimate_usd", "double").alias("cost_estimate_usd"),
        optional("duration_ms", "bigint").alias("duration_ms"), get("exit_code", "bigint").alias("exit_code"),
        text("event_id").alias("event_id"), text("tracking_run_id").alias("tracking_run_id"),
    )
    rows = rows.where(F.col("ts").isNotNull() & ~F.col("model").eqNullSafe(F.lit(n.SYNTHETIC)))
    given = F.coalesce(n.blank_to_null(F.col("provider")), F.lit(default_provider))
    rows = rows.withColumn("json_provider", F.col("provider")).withColumn("provider_norm", n.provider(given))
    rows = rows.withColumn("provider", F.lit(tag)).withColumn("event_date", F.to_date("ts"))
    rows = rows.withColumn("is_correction", (F.coalesce("correction_of", F.lit("")) != "").cast("int"))
    origin = F.when(
        F.col("provider_norm") == "openai",
        n.codex_origin(
            *[F.col(c) for c in ("codex_origin", "originator")], F.coalesce("codex_source", "source"), F.col("model"),
            F.col("provider_norm"),
        ),
    ).when(F.col("provider_norm") == "openrouter", n.blank_to_null(F.col("openclaw_source"))).when(
        F.col("provider_norm") == "opencode",
        n.blank_to_null(F.coalesce("opencode_agent", "opencode_provider_id")),
    )
    rows = rows.withColumn("origin_norm", origin)
    parts = [
        n.dedupe_provider(F.col("json_provider"), F.lit(default_provider)),
        *[F.col(c) for c in ("session_id", "message_uuid", "ts_raw", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cached_input_tokens", "reasoning_tokens", "total_tokens")],
    ]
    return rows.withColumn("dedupe_group", dedupe_group(F.col("event_id"), F.col("tracking_run_id"), parts))


def read_ledgers(spark: SparkSession, folder: str, tags: list[str] | None = None) -> DataFrame:
    """All ledgers of a folder in one table; ``ord`` orders rows by file, then by line."""
    parts = [read_events(spark, f"{folder}/{tag}.jsonl", default, tag).withColumn("rank", F.lit(i)) for i, (tag, default) in enumerate(FILES.items()) if tags is None or tag in tags]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("ord", F.struct("rank", "file", "block", "id")).drop("rank", "file", "block", "id")


def in_time(events: DataFrame) -> DataFrame:
    """Events by time, those of one instant in the order of files and lines."""
    return events.orderBy("ts", "ord")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task_key, session_id, chunk_date and estimates from a map of objects; a broken file gives no rows."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = whole.select(F.explode("m").alias("task_key", "value")).withColumn("v", F.try_parse_json("value")).where(F.schema_of_variant("v").startswith("OBJECT"))
    day = F.regexp_extract("task_key", r"^(.*):(\d{4}-\d{2}-\d{2})$", 2)
    keys = ("profanity_count", "frustration_score", "appreciation_score", "mood_arc", "sentiment_intensity")
    present = F.lit(False)
    for k in keys:
        present = present | F.array_contains(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.lit(k))
    columns = (
        "human_corrected_hours", "ai_baseline_hours", "profanity_count", "appreciation_count", "frustration_score",
        "appreciation_score", "mood_arc", "sentiment_intensity", "brief_description", "estimation_mode", "transcript_path",
    )
    return rows.select(
        "task_key",
        F.when(day == "", F.col("task_key")).otherwise(F.regexp_extract("task_key", r"^(.*):\d{4}-\d{2}-\d{2}$", 1)).alias("session_id"),
        F.try_to_date(n.blank_to_null(day)).alias("chunk_date"), *[text(c).alias(c) for c in columns],
        get("day_input_version", "int").alias("day_input_version"),
        local_time(text("day_input_read_at")).alias("input_read_at"), present.alias("has_sentiment"),
    )


def read_bus_events(spark: SparkSession, path: str) -> DataFrame:
    """Transitions of routed tasks: rows with a time and a transition."""
    columns = ("provider", "task_id", "session_id", "kind", "transition", "exec_id", "target_host")
    rows = lines(spark, path).select(
        local_time(text("ts")).alias("ts"), *[text(c).alias(c) for c in columns],
        *[integer(c).alias(c) for c in ("issue_number", "lease_seconds", "input_tokens", "output_tokens")],
        optional("cost_estimate_usd", "double").alias("cost_estimate_usd"),
        optional("duration_ms", "bigint").alias("duration_ms"),
    )
    return rows.where(F.col("ts").isNotNull() & (F.coalesce("transition", F.lit("")) != ""))


def read_attention_cache(spark: SparkSession, path: str) -> DataFrame:
    """session_id, ts from a map of objects with arrays of epoch seconds; what is no number is left out."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = whole.select(F.explode("m").alias("session_id", "value")).select(
        "session_id",
        F.explode(F.from_json(F.get_json_object("value", "$.ts"), "array<string>")).alias("t"),
    )
    return rows.select("session_id", F.timestamp_seconds(F.col("t").try_cast("double")).cast("timestamp_ntz").alias("ts")).where("ts is not null")


def read_run_states(spark: SparkSession, path: str) -> DataFrame:
    """run_id, and each step's role, status, ok, duration and time (epoch seconds or ISO text)."""
    rows = spark.read.text(path, wholetext=True).withColumn("v", F.try_parse_json("value")).where("v is not null")
    steps = rows.select(
        text("run_id").alias("run_id"),
        F.posexplode(F.from_json(F.get_json_object("value", "$.steps"), "array<string>")).alias("ord", "s"),
    ).withColumn("v", F.try_parse_json("s"))
    at = F.coalesce(F.timestamp_seconds(get("started_at", "double")), F.try_to_timestamp(text("started_at"))).cast("timestamp_ntz")
    return steps.select(
        "run_id", "ord", text("role").alias("role"), text("status").alias("status"),
        F.coalesce(get("result.ok", "boolean"), F.lit(False)).alias("ok"),
        get("result.duration_ms", "double").alias("duration_ms"), at.alias("at"),
    )


def schema_coverage(spark: SparkSession, path: str) -> DataFrame:
    """file, records, how many bear a schema version, and how many are broken."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return raw.groupBy("file").agg(
        F.count("*").alias("records"),
        F.sum((good & get("schema_version", "int").isNotNull()).cast("long")).alias("versioned"),
        F.sum((~good).cast("long")).alias("broken"),
    )
