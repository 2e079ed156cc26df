"""Queries over what the library keeps between runs: daily aggregates, partials of files, committed batches, appended
ledgers and leases. Each makes its state from the given tables, in several steps, in new folders of the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.daily import Daily, measures
from ..operators.lifetime import Lifetime
from ..session import shared_dir
from ..sources import append, ledger
from ..sources.folders import Folders
from ..streaming import ingest, leases
from . import views as v
from .queries import SQL, claims, query
from .views import END, LEDGER, NOW, START


def new_folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_days(s: SparkSession, d: str) -> tuple[Daily, DataFrame]:
    """Aggregates of all days, made in three steps: the later half, the earlier one, and a day in the middle again."""
    events = v.ledger(s, d)
    days = sorted(str(r[0]) for r in events.where(F.col("event_date").between(F.lit(START).cast("date"), F.lit(END).cast("date"))).select("event_date").distinct().collect())
    daily = Daily(s, new_folder(s, "daily"))
    half = len(days) // 2
    for some in (days[half:], days[:half], days[half : half + 1]):
        daily.refresh(events, some)
    return daily, events


@query(SQL["summary_by_model"])
def daily_by_model(s, d):
    daily, events = kept_days(s, d)
    return measures(daily, events, START, END, by=("provider", "model"), grand_total=True)


@query(SQL["totals"])
def daily_totals(s, d):
    daily, events = kept_days(s, d)
    return measures(daily, events, START, END)


@query(SQL["by_day"])
def daily_by_day(s, d):
    daily, events = kept_days(s, d)
    return measures(daily, events, START, END, by=("event_date",))


@query(SQL["by_origin"].replace("model <> '<synthetic>'),", "model <> '<synthetic>' AND provider_norm IN ('openai', 'anthropic')),"))
def daily_by_origin(s, d):
    daily, events = kept_days(s, d)
    rows = measures(daily, events, START, END, by=("provider", "origin"), providers=["claude", "codex"])
    return rows.withColumn("origin", F.coalesce("origin", F.lit("unknown")))


def ledger_files(s: SparkSession, d: str, folder: str, where: str = "true") -> None:
    """The events as part files of one ledger, in order, as many as the rows need; more files come beside those that are there."""
    raw = v.raw_ledger(s, d).where(where).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    columns = ["event_id", "ts", "session_id", "provider", "model", "originator", "source", *[c for c in raw.columns if c.endswith("_tokens")], "cost_estimate_usd"]
    lines = raw.select("ord", F.to_json(F.struct(*columns, F.when(F.col("is_correction") == 1, "x").alias("correction_of"))).alias("value"))
    lines.repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.mode("append").text(f"{folder}/claude.jsonl")


@query(f"""WITH {LEDGER}, life AS (SELECT * FROM led2 WHERE model <> '<synthetic>' AND (provider_norm = 'anthropic' OR (provider_norm = 'openai'
  AND coalesce(origin, '') IN ('desktop', 'tui'))) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) = 1)
SELECT session_id, count(*) AS events FROM life GROUP BY 1""")
def lifetime_counts(s, d):
    folder = new_folder(s, "ledgers")
    life = Lifetime(s, folder, f"{folder}-partials")
    for half in ("ord % 4 < 2", "ord % 4 >= 2"):  # events of one id are in one half
        ledger_files(s, d, folder, half)
        life.refresh()
    return life.counts()


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS events, round(sum(value), 6) AS cost FROM events GROUP BY 1")
def committed_batches(s, d):
    folder = new_folder(s, "stream")
    rows = v.table(s, d, "events").selectExpr(
        "concat('e', event_id) AS event_id", "CAST(user_id AS STRING) AS session_id", "ts", "'anthropic' AS provider", "event_type AS model",
        "1L AS input_tokens", "0L AS output_tokens", "value AS cost_estimate_usd",
    )
    for _ in range(2):  # every event comes twice
        rows.write.mode("append").json(f"{folder}/in")
        ingest.ingest_once(s, f"{folder}/in", f"{folder}/table", f"{folder}/checkpoint", horizon="400 days")
    found = ingest.committed(s, f"{folder}/table")
    return found.groupBy("session_id").agg(F.count("*").alias("events"), F.sum("cost_estimate_usd").alias("cost"))


@query("""SELECT CASE event_type WHEN 'click' THEN 'openai' ELSE 'anthropic' END AS provider, count(*) AS events, CAST(sum(event_id % 7) AS BIGINT) AS input_tokens,
CAST(count(*) FILTER (event_id % 5 = 0) AS BIGINT) AS unpriced FROM events WHERE event_id <> 0 GROUP BY 1""")
def appended_ledger(s, d):
    folder = new_folder(s, "ledger")
    path = f"{folder}/claude.jsonl"
    s.range(0).write.parquet(folder)  # makes the folder
    rows = v.table(s, d, "events").selectExpr(
        "concat('e', event_id) AS event_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS ts", "IF(event_type = 'click', 'codex', NULL) AS provider",
        "event_type AS model", "event_id % 7 AS input_tokens", "IF(event_id % 5 = 0, NULL, value) AS cost_estimate_usd", "event_id AS ord",
    )
    append.append_events(rows.where("ord % 2 = 1"), path, ("ord",))
    with open(append.local(path), "a", encoding="utf-8") as f:  # a writer that died within a line
        f.write('{"event_id": "e0", "ts": "2024-01-0')
    append.append_events(rows.where("ord % 2 = 0 AND ord <> 0"), path, ("ord",))
    events = ledger.read_events(s, path, "anthropic", "claude")
    return events.groupBy(F.col("provider_norm").alias("provider")).agg(
        F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"), F.count_if(F.col("cost_estimate_usd").isNull()).alias("unpriced"),
    )


LEASES = """cm AS (SELECT user_id AS issue, event_id AS id, ts AS tm, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' ELSE 'note' END AS kind,
  'x' || event_id AS exec_id, 86400 + event_id % 7 * 86400 AS lease FROM events WHERE ts <= TIMESTAMP '2024-01-30 23:59:59'),
st AS (SELECT issue, tm, id, last_value(CASE WHEN kind = 'claim' THEN exec_id END IGNORE NULLS) OVER w AS exec_id, last_value(CASE WHEN kind = 'claim' THEN tm END IGNORE NULLS) OVER w AS c,
  last_value(CASE WHEN kind = 'claim' THEN lease END IGNORE NULLS) OVER w AS lease, max(CASE WHEN kind = 'heartbeat' THEN tm END) OVER w AS b,
  lead(tm, 1, TIMESTAMP '2024-01-30 23:59:59') OVER (PARTITION BY issue ORDER BY tm, id) AS nx FROM cm WHERE kind <> 'note'
  WINDOW w AS (PARTITION BY issue ORDER BY tm, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ex AS (SELECT issue, tm, id, exec_id, coalesce(b, c) AS renewed_at, coalesce(b, c) + to_microseconds(CAST(lease * 1500000 AS BIGINT)) AS expired_at, nx FROM st WHERE c IS NOT NULL)
SELECT issue, exec_id, renewed_at, expired_at FROM ex WHERE expired_at < nx QUALIFY row_number() OVER (PARTITION BY issue ORDER BY tm, id) = 1"""


def lease_comments(s: SparkSession, d: str) -> DataFrame:
    return v.table(s, d, "events").selectExpr(
        "user_id AS issue", "event_id AS id", "ts AS at", "CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'heartbeat' ELSE 'note' END AS kind",
        "concat('x', event_id) AS exec_id", "86400 + event_id % 7 * 86400 AS lease_seconds",
    )


@query(f"WITH {LEASES}")
def expired_leases(s, d):
    return leases.expired_by(lease_comments(s, d), NOW)


@query(f"WITH {LEASES}")
def expired_leases_stream(s, d):
    """The same from a replay: the comments come in three batches by time, and a clock's tick after them."""
    folder = new_folder(s, "leases")
    rows = lease_comments(s, d).withColumn("at", F.col("at").cast("timestamp")).where(F.col("at") <= F.lit(NOW).cast("timestamp"))
    cuts = ["1970-01-01", "2024-01-10", "2024-01-20", "2100-01-01"]
    for low, high in zip(cuts, cuts[1:]):
        rows.where(F.col("at").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    tick = s.range(1).select(
        F.lit(-1).cast("long").alias("issue"), F.lit(0).cast("long").alias("id"), F.lit(NOW).cast("timestamp").alias("at"), F.lit("tick").alias("kind"),
        F.lit("").alias("exec_id"), F.lit(0).cast("long").alias("lease_seconds"),
    )
    tick.write.mode("append").parquet(f"{folder}/in")
    comments = s.readStream.schema(tick.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with leases.timers(s):
        stream = leases.expiries(comments).writeStream.foreachBatch(ingest.commit_batches(f"{folder}/out"))
        stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = Folders(s, f"{folder}/out").rows("issue long, exec_id string, renewed_at timestamp, expired_at timestamp")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("renewed_at", "expired_at")})
