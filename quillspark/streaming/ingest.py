"""Incremental ingest with Structured Streaming: reading at least once, committing exactly once.

A ledger's new lines come as a stream of files. Late rows are no special case in the batch queries, which recompute their
windows; the stream only needs to keep each event once, within a horizon of event time that bounds its state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_wins
from ..sources.folders import FileSystem, Folders
from ..sources.sinks import write_payload

SCHEMA = "event_id string, session_id string, ts timestamp, provider string, model string, input_tokens bigint, output_tokens bigint, cost_estimate_usd double"


def stream(spark: SparkSession, folder: str, schema: str = SCHEMA, files: int = 100) -> DataFrame:
    """New JSON-lines files of a folder; lines that aren't objects or have no time are left out."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("mode", "PERMISSIVE").json(folder).where("ts is not null")


def deduplicated(events: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Each event id once, as long as its copies come within the horizon."""
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["event_id"])


def daily(events: DataFrame, late: str | None = "2 days") -> DataFrame:
    """day, provider, calls, tokens, cost: tumbling days that close when their lateness has passed. None keeps the
    watermark that the events have, e.g. from ``deduplicated``."""
    rows = events.withWatermark("ts", late) if late else events
    sums = rows.groupBy(F.window("ts", "1 day"), "provider").agg(
        F.count("*").alias("calls"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_estimate_usd").alias("cost"),
    )
    return sums.select(F.to_date("window.start").alias("day"), "provider", "calls", "tokens", "cost")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 days") -> DataFrame:
    """session_id, start, end, events: stretches without a longer gap."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count("*").alias("events")).select(
        "session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events",
    )


def append_new(table: str, key: str = "event_id", order: str = "ts", horizon: str = "7 days") -> Callable[[DataFrame, int], None]:
    """For foreachBatch without state: appends the rows whose key the table (a Parquet folder) doesn't have yet. A batch that
    is run again appends nothing, so the sink may be at-least-once.

    Keys are compared with rows of the table whose time is within the horizon around the batch's, as in ``deduplicated``;
    the condition reaches the scan, so old files are left alone."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = first_wins(batch, [key], [order])
        if FileSystem(spark, table).exists(f"{table}/_SUCCESS"):
            known = spark.read.parquet(table).select(key, order)
            low, high = batch.agg(F.min(order) - F.expr(f"INTERVAL {horizon}"), F.max(order) + F.expr(f"INTERVAL {horizon}")).first()
            rows = rows.join(known.where(F.col(order).between(F.lit(low), F.lit(high))).select(key), key, "left_anti")
        rows.write.mode("append").parquet(table)

    return run


def commit_batches(table: str, stream_id: str = "batch") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch is one folder under the table's log (``sources.folders``), committed under its number. A
    batch that fails before its commit leaves nothing to see; one that is run again finds its number and does nothing. Rows
    of earlier batches aren't looked at."""

    def run(batch: DataFrame, number: int) -> None:
        Folders(batch.sparkSession, table).append(f"{stream_id}-{number:012d}", batch)

    return run


def committed(spark: SparkSession, table: str, schema: str = SCHEMA) -> DataFrame:
    """The rows of all committed batches."""
    return Folders(spark, table).rows(schema)


def snapshots(events: DataFrame, make: Callable[[], DataFrame], path: str, checkpoint: str, every: str = "30 seconds"):
    """Writes the payload that ``make`` gives to ``path`` whenever new events came, at most once in ``every``; the query."""
    write = lambda _, __: write_payload(make(), path)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Takes in what is new and returns; for schedulers that run it again and again. The table is a Parquet folder, and keys
    are compared with its rows."""
    query = stream(spark, folder).writeStream.foreachBatch(append_new(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_once(spark: SparkSession, folder: str, table: str, checkpoint: str, horizon: str = "7 days", schema: str = SCHEMA) -> None:
    """The same into a table of committed batches: repeats are told by the stream's state, batches by their numbers, so no
    run reads what the table has. Read it with ``committed``."""
    rows = deduplicated(stream(spark, folder, schema), horizon)
    query = rows.writeStream.foreachBatch(commit_batches(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
