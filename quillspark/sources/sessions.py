"""Session files beyond the two dialects of ``transcripts``: whole folders with their subagents, a dialect that switches
models on the way, captures of single runs, another application's database, and the map of roles.

Readers take lines as ``ledger.lines`` gives them (file, block, id, v), so they run on files and on tables alike.
"""

from __future__ import annotations

import sqlite3
import tomllib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import normalize as n
from ..operators.ordered import carried
from .folders import FileSystem
from .ledger import get, local_time, parsed, text

AGENTS = "subagents"


def files(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all session files below a folder, those of subagents included, with each file's ``stream_identity``."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root)
    raw = raw.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    known = stream_identity(F.col("file"))
    return parsed(raw).withColumn("_i", known).where("_i.session_id is not null").select("*", "_i.*").drop("_i")


def stream_identity(path: Column) -> Column:
    """struct(session_id, working_dir, agent_id) from where a file lies: ``project/session.jsonl``, or below
    ``project/session/subagents/`` a file ``agent-*.jsonl`` (the agent is the rest of the path); null ids elsewhere."""
    bare = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    agent = rf"/([^/]+)/([^/]+)/{AGENTS}/((?:.*/)?agent-[^/]*)\.jsonl$"
    main = r"/([^/]+)/([^/]+)\.jsonl$"
    inside = F.contains(bare, F.lit(f"/{AGENTS}/"))
    of = lambda k, j: F.when(
        inside, n.blank_to_null(F.regexp_extract(bare, agent, k)),
    ).otherwise(n.blank_to_null(F.regexp_extract(bare, main, j)))
    who = F.when(inside, n.blank_to_null(F.regexp_extract(bare, agent, 3)))
    return F.struct(of(2, 2).alias("session_id"), n.project_dir(of(1, 1)).alias("working_dir"), who.alias("agent_id"))


def switched_calls(rows: DataFrame, since: str | None = None) -> DataFrame:
    """Calls of sessions that name their provider and model in lines before: file, line, event_id, ts, session_id, provider,
    model, tokens, cost, exit_code, partial, working_dir, channel, response_id.

    State goes from line to line within a file, as the last value that isn't null (see ``ordered.carried``): ``session`` lines set id and folder,
    ``model_change`` lines provider and model, the runtime context the channel, and a call its own provider and model for
    those after it. Calls without any usage are left out, but what they set stays."""
    kind = text("type")
    at = local_time(F.coalesce(text("timestamp"), text("message.timestamp")))
    usage = get("message.usage", "variant")
    call = (kind == "message") & (text("message.role") == "assistant") & F.coalesce(
        F.schema_of_variant(usage).startswith("OBJECT"), F.lit(False),
    ) & at.isNotNull()
    if since is not None:
        call = call & (at >= F.lit(since).cast("timestamp_ntz"))
    call = F.coalesce(call, F.lit(False))
    change, started = F.coalesce(kind == "model_change", F.lit(False)), F.coalesce(kind == "session", F.lit(False))
    first = lambda *keys: F.coalesce(*[n.blank_to_null(text(k)) for k in keys])
    named = F.lower(F.trim(F.when(change, text("provider")).when(call, text("message.provider"))))
    provider = F.when(named.isin("openrouter_openclaw", "openclaw"), "openrouter").otherwise(n.blank_to_null(named))
    model = F.when(change, first("modelId", "model")).when(call, first("message.model", "message.responseModel"))
    context = F.when((kind == "custom_message") & (text("customType") == "openclaw.runtime-context"), n.channel(text("content")))
    number = lambda key: F.coalesce(get(f"message.usage.{key}", "bigint"), F.lit(0).cast("bigint"))
    known = carried(rows, {
        "_id": F.when(started, first("id")), "_cwd": F.when(started, first("cwd")), "_provider": provider, "_model": model, "_channel": context,
    }, line="_line")
    state = known.select(
        "file",
        F.col("_line").alias("line"),
        F.coalesce("_id", F.regexp_replace("file", r"\.jsonl$", "")).alias("session_id"),
        F.coalesce("_cwd", F.lit("")).alias("working_dir"),
        F.coalesce("_provider", F.lit("openrouter")).alias("provider"),
        F.coalesce("_model", F.lit("unknown")).alias("model"),
        F.coalesce("_channel", F.lit("workspace")).alias("channel"),
        at.alias("ts"),
        *[number(k).alias(c) for c, k in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_read_tokens", "cacheRead"), ("cache_creation_tokens", "cacheWrite"), ("written", "totalTokens"))],
        F.coalesce(F.round(get("message.usage.cost.total", "double"), 10), F.lit(0.0)).alias("cost_estimate_usd"),
        n.exit_status(text("message.stopReason")).alias("exit_code"),
        first("id", "message.responseId").alias("own"),
        F.coalesce(text("message.responseId"), F.lit("")).alias("response_id"),
        call.alias("call"),
    )
    parts = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
    out = state.where("call").withColumn("total_tokens", F.when(F.col("written") > 0, F.col("written")).otherwise(parts))
    out = out.where((F.col("total_tokens") > 0) | (F.col("cost_estimate_usd") > 0))
    name = F.concat_ws("-", F.lit("openclaw-session"), "session_id", F.coalesce("own", F.col("line").cast("string")))
    return out.withColumn("event_id", name).withColumn("partial", F.col("exit_code") != 0).drop("written", "own", "call")


def captured_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """One event for each captured run (file): session_id, model, tokens, usage_captured, partial, json_events.

    ``runs``: file, exit_code, interrupted, model (what was asked for, or null). Of the captured lines the first session or
    thread id counts, the first model and the last usage; a run without a usage, with another exit code than 0 or an
    interruption is partial. Only one value for each run leaves a task; lines are never gathered."""
    order = F.struct("block", "id")
    named = F.coalesce(n.blank_to_null(text("session_id")), n.blank_to_null(text("thread_id")))
    model = F.coalesce(n.blank_to_null(text("model")), n.blank_to_null(text("item.model")))
    usage = get("usage", "variant")
    used = F.coalesce(F.schema_of_variant(usage).startswith("OBJECT"), F.lit(False))

    def number(*keys: str) -> Column:
        there = F.coalesce(*[F.when(F.array_contains(F.json_object_keys("u"), k), F.coalesce(F.get_json_object("u", f"$.{k}").try_cast("bigint"), F.lit(0).cast("bigint"))) for k in keys])
        return F.coalesce(there, F.lit(0).cast("bigint"))

    sums = rows.groupBy("file").agg(
        F.min_by(named, F.when(named.isNotNull(), order)).alias("session_id"),
        F.min_by(model, F.when(model.isNotNull(), order)).alias("said"),
        F.max_by(F.to_json(usage), F.when(used, order)).alias("u"),
        F.count("*").alias("json_events"),
    )
    out = runs.join(sums, "file", "left").withColumn("usage_captured", F.col("u").isNotNull())
    parts = {
        "input_tokens": ("input_tokens", "prompt_tokens"),
        "cached_input_tokens": ("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"),
        "output_tokens": ("output_tokens", "completion_tokens"),
        "reasoning_tokens": ("reasoning_tokens", "reasoning_output_tokens", "output_reasoning_tokens"),
        "written": ("total_tokens",),
    }
    out = out.select("*", *[number(*keys).alias(c) for c, keys in parts.items()])
    total = F.col("input_tokens") + F.col("cached_input_tokens") + F.col("output_tokens") + F.col("reasoning_tokens")
    partial = F.coalesce("interrupted", F.lit(False)) | (F.coalesce("exit_code", F.lit(0)) != 0) | ~F.col("usage_captured")
    out = out.withColumn("total_tokens", F.when(F.col("written") > 0, F.col("written")).otherwise(total)).withColumn("partial", partial)
    out = out.withColumn("session_id", F.coalesce("session_id", F.concat(F.lit("codex-missing-thread-"), "file")))
    out = out.withColumn("model", F.coalesce("said", n.blank_to_null(F.col("model")), F.lit("unknown")))
    columns = ("file", "session_id", "model", *list(parts)[:-1], "total_tokens", "usage_captured", "partial")
    return out.select(*columns, F.coalesce("json_events", F.lit(0)).alias("json_events"))


class Rows(InputPartition):
    """Row ids from low to high, both included."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.path, self.table, self.names = options["path"], options["table"], names
        self.parts = int(options.get("partitions", "8"))

    def connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[Rows]:
        with self.connect() as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Rows(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join(f'"{c}"' for c in self.names)
        with self.connect() as db:
            yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))


class SqliteTable(DataSource):
    """Tables of a SQLite file in a folder that executors can read: options path, table, partitions (ranges of row ids)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}
        with SqliteReader(self.options, []).connect() as db:
            found = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in found)

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema.names)


def sqlite_table(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file, e.g. the messages and sessions that ``runs.imported_messages`` joins."""
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).option("partitions", partitions).load()


def read_roles(spark: SparkSession, path: str) -> DataFrame:
    """role, provider, invocation, model, agent: the map of roles, a small TOML file wherever Spark can read. A missing or
    broken one gives no rows."""
    fs = FileSystem(spark, path)
    try:
        table = tomllib.loads(fs.read(path)).get("role") if fs.exists(path) else None
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        table = None
    of = lambda c, k: c.get(k) if isinstance(c.get(k), str) and c.get(k) else None
    found = [(str(r), of(c, "provider"), of(c, "invocation"), of(c, "model")) for r, c in (table or {}).items() if isinstance(c, dict)] if isinstance(table, dict) else []
    rows = spark.createDataFrame(found, "role string, provider string, invocation string, model string")
    return with_agent(rows)


def with_agent(roles: DataFrame) -> DataFrame:
    """Roles (role, provider, invocation, model) with the agent that their text names."""
    return roles.withColumn("agent", n.agent(F.col("invocation"), F.col("model"), F.col("provider")))


def with_agents(steps: DataFrame, roles: DataFrame) -> DataFrame:
    """Steps (role, ...) with the agent of their role (role, agent; one row each), ``unknown`` for roles that have none."""
    joined = steps.join(roles.select(F.col("role").alias("_role"), "agent").dropDuplicates(["_role"]), F.col("role") == F.col("_role"), "left")
    return joined.drop("_role").withColumn("agent", F.coalesce("agent", F.lit("unknown")))
