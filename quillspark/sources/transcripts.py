"""Conversations as their clients wrote them: two dialects of JSON lines, brought to messages, prompts and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.ordered import carried
from .ledger import get, integer, lines, local_time, text

USER_BLOCKS = ("text", "input_text")


def block_text(content: str) -> Column:
    """The text of a message: written as text, or the text blocks of an array, one on a line."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(
        F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: F.coalesce(b["text"], F.lit(""))),
        "\n",
    )
    return F.when(F.startswith(F.col(content), F.lit("[")), joined).otherwise(F.col(content))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of transcripts in files."""
    return messages_of(lines(spark, path))


def messages_of(rows: DataFrame) -> DataFrame:
    """path, block, id, ts, role, text, uuid, sidechain, summary, model, v: messages of lines of both dialects."""
    rows = rows.withColumn("path", F.col("file"))
    kind = text("type")
    rollout = kind.isin("session_meta", "turn_context", "response_item", "event_msg", "compacted")
    payload = F.coalesce(text("payload.type") == "message", F.lit(False))
    role = F.when(rollout, F.when(payload, text("payload.role"))).otherwise(F.coalesce(text("message.role"), kind))
    out = rows.select(
        "path",
        "block",
        "id",
        local_time(F.coalesce(text("timestamp"), text("ts"))).alias("ts"),
        role.alias("role"),
        F.when(rollout, text("payload.content")).otherwise(text("message.content")).alias("content"),
        text("uuid").alias("uuid"),
        text("sessionId").alias("session_id"),
        text("cwd").alias("cwd"),
        F.coalesce(get("isSidechain", "boolean"), F.lit(False)).alias("sidechain"),
        F.coalesce(get("isCompactSummary", "boolean"), F.lit(False)).alias("summary"),
        text("message.model").alias("model"),
        F.col("v"),
    )
    return out.where("role is not null").withColumn("text", block_text("content"))


def prompts(rows: DataFrame) -> DataFrame:
    """What a human wrote: no summaries, no sidechains, no injected messages; a tool's result counts only beside text."""
    own = (F.col("role") == "user") & ~F.col("summary") & ~F.col("sidechain") & (F.trim(F.coalesce("text", F.lit(""))) != "") & ~t.is_injected(F.col("text"))
    return rows.where(own)


def billable(rows: DataFrame) -> DataFrame:
    """Assistant messages with usage, model and id: one row for each id, the first."""
    usage = "message.usage"
    fields = {
        "input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens",
        "cache_creation_tokens": "cache_creation_input_tokens",
        "cache_creation_1h_tokens": "cache_creation.ephemeral_1h_input_tokens",
        "cache_creation_5m_tokens": "cache_creation.ephemeral_5m_input_tokens",
    }
    own = rows.where((F.col("role") == "assistant") & F.col("uuid").isNotNull() & F.col("model").isNotNull() & text(usage).isNotNull())
    out = own.select(
        "path", "block", "id", "session_id", F.col("uuid").alias("message_uuid"), "ts", "model",
        F.col("cwd").alias("working_dir"),
        *[integer(f"{usage}.{k}").alias(c) for c, k in fields.items()],
    )
    w = Window.partitionBy("session_id", "message_uuid").orderBy("path", "block", "id")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rollout_meta(rows: DataFrame) -> DataFrame:
    """file, session_id, originator, source, working_dir: what the first head of each rollout (v, file, block, id) says."""
    fields = {"session_id": "id", "originator": "originator", "source": "source", "working_dir": "cwd"}
    heads = rows.where(text("type") == "session_meta").select("file", "block", "id", *[text(f"payload.{k}").alias(c) for c, k in fields.items()])
    return heads.groupBy("file").agg(F.min_by(F.struct(*fields), F.struct("block", "id")).alias("m")).select("file", "m.*")


def rollout_calls(spark: SparkSession, path: str) -> DataFrame:
    """Token counts of rollouts in files."""
    return rollout_calls_of(lines(spark, path))


def rollout_calls_of(rows: DataFrame) -> DataFrame:
    """Token counts of rollouts with what was said before them carried forward: session, folder, originator, model.

    State goes from line to line within a file, as the last value that isn't null (see ``ordered.carried``)."""
    kind = text("type")
    meta = lambda key: F.when(kind == "session_meta", text(f"payload.{key}"))
    state = carried(rows, {
        "session_id": meta("id"), "originator": meta("originator"), "source": meta("source"),
        "working_dir": F.when(kind.isin("session_meta", "turn_context"), text("payload.cwd")), "model": F.when(kind == "turn_context", text("payload.model")),
    })
    usage = "payload.info.last_token_usage"
    fields = {
        "input_tokens": "input_tokens", "cached_input_tokens": "cached_input_tokens", "output_tokens": "output_tokens",
        "reasoning_tokens": "reasoning_output_tokens", "total_tokens": "total_tokens",
    }
    calls = state.where((kind == "event_msg") & (text("payload.type") == "token_count"))
    out = calls.select(
        "file", "block", "id", local_time(text("timestamp")).alias("ts"), "session_id", "originator", "source", "working_dir",
        "model",
        *[integer(f"{usage}.{k}").alias(c) for c, k in fields.items()],
    )
    return out.where("ts is not null and session_id is not null and (input_tokens > 0 or output_tokens > 0 or total_tokens > 0)")


# Records of a rollout that are calls of a tool; their results are records of their own.
TOOL_RECORDS = ("function_call", "custom_tool_call", "web_search_call")


def signals(rows: DataFrame) -> DataFrame:
    """The lines (value, v, file, block, id) with what they add to the size of a conversation, whatever the dialect: role
    (user, assistant or null), calls (of tools), ts and summary (whether the line is a compaction's).

    Of rollouts only genuine messages count, and records that call a tool; else every line with a role, the tool blocks of
    an assistant's message or, without any, a line with a tool's id. A compaction's lines count for nothing."""
    kind, payload = text("type"), text("payload.type")
    rollout = F.coalesce(kind == "response_item", F.lit(False))
    summary = F.coalesce(get("isCompactSummary", "boolean"), F.lit(False)) | F.coalesce(kind == "compacted", F.lit(False))
    rows = rows.withColumn("_content", F.when(rollout, text("payload.content")).otherwise(text("message.content")))
    said = F.trim(F.regexp_replace(F.coalesce(block_text("_content"), F.lit("")), r"(?U)^\s+|\s+$", ""))
    genuine = F.when((payload == "message") & (said != ""), text("payload.role"))
    genuine = F.when((genuine == "assistant") | ((genuine == "user") & ~t.is_injected(said)), genuine)
    written = F.coalesce(F.when(text("message.role").isin("user", "assistant"), text("message.role")), F.when(kind.isin("user", "assistant"), kind))
    role = F.when(rollout, genuine).otherwise(written)
    used = F.size(F.filter(F.from_json("_content", "array<struct<type:string>>"), lambda b: b["type"] == "tool_use"))
    blocks = F.when((written == "assistant") & F.startswith("_content", F.lit("[")), F.greatest(used, F.lit(0))).otherwise(0)
    calls = F.when(rollout, payload.isin(*TOOL_RECORDS).cast("int")).when(F.coalesce(blocks, F.lit(0)) > 0, blocks).otherwise(text("toolUseID").isNotNull().cast("int"))
    return rows.select(
        "file", "block", "id", local_time(F.coalesce(text("timestamp"), text("ts"))).alias("ts"), summary.alias("summary"),
        F.when(~summary, role).alias("role"), F.when(~summary, F.coalesce(calls, F.lit(0))).otherwise(0).cast("long").alias("calls"),
        F.when(rollout, F.when(payload == "message", text("payload.role"))).otherwise(written).alias("written_role"), (said != "").alias("has_text"),
    )


def sizes(lines_: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """keys (``day`` is a line's), user_messages, assistant_messages, tool_calls, and the first and last time."""
    rows = signals(lines_).withColumn("day", F.to_date("ts"))
    if "day" in keys:
        rows = rows.where("day is not null")
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.sum("calls").alias("tool_calls"), F.min("ts").alias("start"), F.max("ts").alias("end"),
    )


def compaction_days(lines_: DataFrame, first: int = 3) -> DataFrame:
    """file, day: days with a compaction's summary among their first so many user lines that have text, as they were once
    read: summaries count like prompts."""
    rows = signals(lines_).where("written_role = 'user' AND has_text AND ts IS NOT NULL").withColumn("day", F.to_date("ts"))
    nth = F.row_number().over(Window.partitionBy("file", "day").orderBy("block", "id"))
    return rows.withColumn("_n", nth).where(F.col("_n") <= first).groupBy("file", "day").agg(F.max("summary").alias("_s")).where("_s").select("file", "day")


def tool_calls(rows: DataFrame) -> DataFrame:
    """path, calls: tool uses in assistant messages."""
    used = F.size(F.filter(F.from_json("content", "array<struct<type:string>>"), lambda b: b["type"] == "tool_use"))
    return rows.where("role = 'assistant'").groupBy("path").agg(F.sum(F.coalesce(F.greatest(used, F.lit(0)), F.lit(0))).alias("calls"))


def is_rollout(spark: SparkSession, path: str) -> DataFrame:
    """file, rollout: by the type of a file's first record."""
    kinds = ("session_meta", "turn_context", "response_item", "event_msg", "compacted")
    first = lines(spark, path).groupBy("file").agg(F.min_by(text("type"), F.struct("block", "id")).alias("kind"))
    return first.select("file", F.coalesce(F.col("kind").isin(*kinds), F.lit(False)).alias("rollout"))


def daily_input(rows: DataFrame, first: int = 3, last: int = 5, limit: int = 2000) -> DataFrame:
    """path, day, messages, tools, context: the first user and the last assistant messages of each day, each cut in its middle.

    Only the few messages that are kept are gathered."""
    dated = rows.where("ts is not null").withColumn("day", F.to_date("ts")).where("role in ('user', 'assistant')")
    order = ["block", "id"]
    up = F.row_number().over(Window.partitionBy("path", "day", "role").orderBy(*order))
    down = F.row_number().over(Window.partitionBy("path", "day", "role").orderBy(*[F.desc(c) for c in order]))
    kept = dated.withColumn("_u", up).withColumn("_d", down).where(((F.col("role") == "user") & (F.col("_u") <= first)) | ((F.col("role") == "assistant") & (F.col("_d") <= last)))
    few = kept.groupBy("path", "day").agg(F.array_sort(F.collect_list(F.struct("block", "id", "role", t.clip_middle(F.col("text"), limit).alias("text")))).alias("m"))
    context = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")))), "\n")
    counts = dated.groupBy("path", "day").agg(F.count("*").alias("messages"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return counts.join(few, ["path", "day"]).withColumn("context", context).drop("m")


# Limits of a message, the second where the first gives too much, and of the whole context.
MESSAGE_LIMITS, CONTEXT_LIMIT = (2_500, 1_200), 15_000


def clipped(text: Column, limit: int) -> Column:
    """A message's beginning, with a mark where the rest was."""
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?U)\s+\z", ""), F.lit("\n...[truncated]")),
    )


def without_middle(text: Column, limit: int) -> Column:
    """A third of the limit from the beginning, the rest of it, less the mark, from the end."""
    mark = "\n...[middle truncated]...\n"
    head = limit // 3
    tail = limit - head - len(mark)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(
            F.regexp_replace(F.substring(text, 1, head), r"(?U)\s+\z", ""), F.lit(mark),
            F.regexp_replace(F.substring(text, -tail, tail), r"(?U)\A\s+", ""),
        ),
    )


def context(
    rows: DataFrame, keys: tuple[str, ...] = ("path",), first: int = 3, last: int = 5, limits: tuple[int, int] = MESSAGE_LIMITS, most: int = CONTEXT_LIMIT,
) -> DataFrame:
    """keys, context: a conversation's first user messages and its last assistant ones, each cut to the first limit, or to
    the second if the whole is longer than ``most``, which then loses its middle. Only messages that are kept are gathered,
    each as its beginning: of ``rows`` (keys, block, id, role, text) no more than ``first`` + ``last`` for each key."""
    said = rows.where(F.col("role").isin("user", "assistant")).select(*keys, "block", "id", "role", F.coalesce("text", F.lit("")).alias("text"))
    place = F.struct("block", "id")
    # (Spark keeps the few of each task before it shuffles them)
    up = F.row_number().over(Window.partitionBy(*keys, "role").orderBy("block", "id"))
    down = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(F.desc("block"), F.desc("id")))
    users = said.where("role = 'user'").withColumn("_n", up).where(F.col("_n") <= first)
    assistants = said.where("role = 'assistant'").withColumn("_n", down).where(F.col("_n") <= last)
    longest = max(limits)
    begun = F.struct(place.alias("at"), F.substring("text", 1, longest + 1).alias("text"))
    few = users.unionByName(assistants).groupBy(*keys).agg(
        *[F.array_sort(F.collect_list(F.when(F.col("role") == r, begun))).alias(r) for r in ("user", "assistant")],
    )

    def section(role: str, title: str, limit: int) -> Column:
        lines = F.transform(role, lambda m, i: F.concat(F.lit(f"[{role} "), (i + 1).cast("string"), F.lit("]\n"), clipped(m["text"], limit)))
        return F.when(F.size(role) > 0, F.concat_ws("\n\n", F.lit(title), F.array_join(lines, "\n\n")))

    def rendered(limit: int) -> Column:
        whole = F.concat_ws("\n\n", section("user", "### First user messages", limit), section("assistant", "### Last assistant messages", limit))
        return F.when(whole == "", "No readable transcript text found.").otherwise(whole)

    long = rendered(limits[0])
    return few.select(*keys, without_middle(F.when(F.length(long) > most, rendered(limits[1])).otherwise(long), most).alias("context"))


def log_events(spark: SparkSession, path: str) -> DataFrame:
    """Calls of a plain log: the session is the day, the id the beginning of the line's SHA-1."""
    rows = lines(spark, path)
    at = local_time(F.coalesce(text("ts"), text("time")))
    return rows.select(
        F.substring(F.sha1(F.trim("value").cast("binary")), 1, 16).alias("event_id"), at.alias("ts"),
        F.concat(F.lit("dscall:"), F.to_date(at).cast("string")).alias("session_id"), text("model").alias("model"),
        integer("input_tokens").alias("input_tokens"), integer("output_tokens").alias("output_tokens"),
        get("cost", "double").alias("cost_estimate_usd"),
    ).where("ts is not null")
