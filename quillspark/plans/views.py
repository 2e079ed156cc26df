"""Logical tables of the ledger's model over a star schema of test tables: the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..operators.dedup import dedupe_group

START, END, TODAY, NOW = "2024-01-01", "2024-01-30", "2024-01-30", "2024-01-30 23:59:59"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields as producers wrote them."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.selectExpr(
        "event_id AS ord",
        "CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('e', event_id - CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END) END AS event_id",
        "ts",
        "to_date(ts) AS event_date",
        "CAST(user_id AS STRING) AS session_id",
        "CASE user_id % 6 WHEN 0 THEN 'claude' WHEN 1 THEN 'Codex' WHEN 2 THEN 'openclaw' WHEN 3 THEN 'opencode' WHEN 4 THEN 'OpenAI' ELSE NULL END AS provider",
        "CASE WHEN k = 13 THEN '<synthetic>' WHEN event_type = 'purchase' THEN 'gpt-5.6-sol' WHEN event_type = 'view' THEN 'claude-sonnet-4-20250514' WHEN event_type = 'signup' THEN 'openrouter/free' WHEN event_type = 'click' THEN 'claude-opus-4-1' WHEN k % 2 = 0 THEN '' ELSE 'codex-auto-review' END AS model",
        "CASE user_id % 5 WHEN 0 THEN 'codex_exec' WHEN 1 THEN 'codex-tui' WHEN 2 THEN 'Codex Desktop' ELSE NULL END AS originator",
        "CASE user_id % 7 WHEN 0 THEN 'vscode' WHEN 1 THEN 'subagent:review' ELSE NULL END AS source",
        "CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END AS is_correction",
        "CASE WHEN event_id % 50 = 7 THEN 0 ELSE 100 * k END AS input_tokens",
        "CASE WHEN event_id % 50 = 7 THEN 0 ELSE 10 * k END AS output_tokens",
        "CASE WHEN event_id % 50 = 7 THEN 0 ELSE 7 * (k % 5) END AS cached_input_tokens",
        "CASE WHEN event_id % 50 = 7 THEN 0 ELSE 3 * (k % 4) END AS cache_read_tokens",
        "CASE WHEN event_id % 50 = 7 THEN 0 ELSE 2 * (k % 3) END AS cache_creation_tokens",
        "CASE WHEN event_id % 50 = 7 THEN 0 ELSE k % 2 END AS reasoning_tokens",
        "CASE WHEN event_id % 50 = 7 OR k % 3 = 0 THEN 0 ELSE 111 * k END AS total_tokens",
        "CASE WHEN k % 11 = 0 THEN NULL ELSE value / 100 END AS cost_estimate_usd",
        "CASE WHEN user_id % 3 = 0 THEN '/work/repo0/src' WHEN user_id % 3 = 1 THEN 'C:\\\\Work\\\\Repo1' ELSE NULL END AS working_dir",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalized ledger, not yet deduplicated."""
    rows = raw_ledger(spark, sf_dir).withColumn("provider_norm", n.provider(F.col("provider")))
    origin = n.codex_origin(F.lit(None).cast("string"), F.col("originator"), F.col("source"), F.col("model"), F.col("provider_norm"))
    parts = [F.col(c) for c in ("provider_norm", "session_id", "ts", "model", "input_tokens", "output_tokens")]
    rows = rows.withColumn("origin_norm", F.when(F.col("provider_norm") == "openai", origin))
    return rows.withColumn(
        "dedupe_group",
        dedupe_group(
            F.col("event_id"), F.lit(None).cast("string"),
            [p if i != 2 else F.date_format(p, "yyyy-MM-dd HH:mm:ss.SSSSSS") for i, p in enumerate(parts)],
        ),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates for sessions, and for days of sessions."""
    c = table(spark, sf_dir, "customer")
    common = (
        "CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 14 = 0 THEN 'n/a' ELSE '2.5' END END AS human_corrected_hours",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(greatest(c_acctbal, 0) / 1000 AS STRING) END AS ai_baseline_hours",
        "c_custkey % 11 <> 0 AS has_sentiment",
        "CAST(c_custkey % 4 AS STRING) AS profanity_count",
        "CAST(c_custkey % 3 AS STRING) AS appreciation_count",
        "CAST((c_custkey % 13) / 10 AS STRING) AS frustration_score",
        "CAST((c_custkey % 9) / 8 AS STRING) AS appreciation_score",
        "CASE WHEN c_custkey % 6 = 0 THEN '  ' ELSE concat('mood ', c_custkey % 6) END AS mood_arc",
        "c_name AS brief_description",
        "CASE WHEN c_custkey % 3 = 0 THEN 2 END AS day_input_version",
        "CASE WHEN c_custkey % 2 = 0 THEN 'rechunk' END AS estimation_mode",
    )
    whole = c.selectExpr("CAST(c_custkey AS STRING) AS session_id", "CAST(NULL AS DATE) AS chunk_date", *common, "CAST(NULL AS TIMESTAMP_NTZ) AS input_read_at")
    days = c.selectExpr("CAST(c_custkey AS STRING) AS session_id", "explode(sequence(0, 29)) AS d", "*").where("(c_custkey + d) % 3 > 0")
    days = days.selectExpr(
        "session_id", "date_add(DATE'2024-01-01', d) AS chunk_date", *common,
        "CASE WHEN d % 4 = 0 THEN CAST(date_add(DATE'2024-01-01', d) AS TIMESTAMP_NTZ) + INTERVAL 8 HOURS WHEN d % 4 = 1 THEN CAST(date_add(DATE'2024-01-01', d) AS TIMESTAMP_NTZ) + INTERVAL 30 HOURS END AS input_read_at",
    )
    return whole.unionByName(days)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live human prompts: what a third of the users viewed."""
    return table(spark, sf_dir, "events").where("event_type = 'view' AND user_id % 3 = 0").selectExpr("CAST(user_id AS STRING) AS session_id", "ts")


def cached_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts kept from before: what most users clicked."""
    return table(spark, sf_dir, "events").where("event_type = 'click' AND user_id % 3 < 2").selectExpr("CAST(user_id AS STRING) AS session_id", "ts")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('/work/repo', o_orderkey % 2) AS repo", "CAST(o_orderkey AS STRING) AS hash",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(o_orderkey * 37 % 43200 AS INT)) AS committed_at",
        "CAST(o_totalprice AS BIGINT) % 400 AS lines",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of runs: a role, an agent, how it ended and how long it took."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr(
        "p_brand AS role", "concat('agent', l_suppkey % 8) AS agent",
        "CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'error' ELSE 'timeout' END AS status", "l_returnflag = 'A' AS ok",
        "l_quantity * 1000 AS duration_ms", "l_shipdate AS at", "l_orderkey * 10 + l_linenumber AS ord",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END AS fingerprint",
    )


LEDGER = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
led0 AS (SELECT event_id AS ord,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE 'e' || (event_id - CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END) END AS eid,
  ts, CAST(ts AS DATE) AS event_date, CAST(user_id AS VARCHAR) AS session_id,
  CASE user_id % 6 WHEN 1 THEN 'openai' WHEN 2 THEN 'openrouter' WHEN 3 THEN 'opencode' WHEN 4 THEN 'openai' ELSE 'anthropic' END AS provider_norm,
  CASE WHEN k = 13 THEN '<synthetic>' WHEN event_type = 'purchase' THEN 'gpt-5.6-sol' WHEN event_type = 'view' THEN 'claude-sonnet-4-20250514'
    WHEN event_type = 'signup' THEN 'openrouter/free' WHEN event_type = 'click' THEN 'claude-opus-4-1' WHEN k % 2 = 0 THEN ''
  ELSE 'codex-auto-review' END AS model,
  user_id, CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END AS is_correction,
  CASE WHEN event_id % 50 = 7 THEN 0 ELSE k END AS t, k, value FROM raw),
led1 AS (SELECT *, 100 * t AS input_tokens, 10 * t AS output_tokens, 7 * (t % 5) AS cached, 3 * (t % 4) AS cread, 2 * (t % 3) AS ccreate, t % 2 AS reasoning,
  CASE WHEN k % 3 = 0 THEN 0 ELSE 111 * t END AS written_total, CASE WHEN k % 11 = 0 THEN NULL ELSE value / 100 END AS cost FROM led0),
led2 AS (SELECT *, CASE WHEN model = '' THEN 'unknown' ELSE model END AS model_name, greatest(input_tokens - cached, 0) AS net_input,
  CASE WHEN written_total <> 0 THEN written_total ELSE greatest(input_tokens - cached, 0) + cached + output_tokens + cread + ccreate END AS total,
  CASE WHEN provider_norm <> 'openai' THEN NULL WHEN model = 'codex-auto-review' OR user_id % 7 = 1 THEN 'auto_review' WHEN user_id % 5 = 0 THEN 'headless'
    WHEN user_id % 5 = 1 THEN 'tui' WHEN user_id % 5 = 2 OR user_id % 7 = 0 THEN 'desktop' ELSE 'headless' END AS origin,
  coalesce(eid, concat_ws('|', 'legacy', provider_norm, session_id, ts, model, input_tokens, output_tokens)) AS grp FROM led1),
win AS (SELECT * FROM led2 WHERE event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' AND model <> '<synthetic>'),
led AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) = 1),
elig AS (SELECT * FROM led WHERE provider_norm = 'anthropic' OR (provider_norm = 'openai' AND coalesce(origin, '') IN ('desktop', 'tui')))
"""

TASKS = """
tcommon AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 2.5 END
  WHEN c_custkey % 5 = 0 THEN NULL ELSE greatest(c_acctbal, 0) / 1000 END AS baseline FROM customer),
tsess AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id, * FROM tcommon),
tday AS (SELECT CAST(c_custkey AS VARCHAR) AS session_id, CAST(DATE '2024-01-01' + CAST(d AS INT) AS DATE) AS day, d, c_custkey, baseline
  FROM tcommon, (SELECT unnest(range(0, 30)) AS d) WHERE (c_custkey + d) % 3 > 0)
"""

STATS = """CAST(coalesce(sum(1 - is_correction), 0) AS BIGINT) AS calls, CAST(coalesce(sum(net_input), 0) AS BIGINT) AS input_tokens,
CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(cread + cached), 0) AS BIGINT) AS cache_read_tokens,
CAST(coalesce(sum(ccreate), 0) AS BIGINT) AS cache_creation_tokens, CAST(coalesce(sum(cached), 0) AS BIGINT) AS cached_input_tokens,
CAST(coalesce(sum(reasoning), 0) AS BIGINT) AS reasoning_tokens, CAST(coalesce(sum(total), 0) AS BIGINT) AS total_tokens,
round(coalesce(sum(cost), 0), 6) AS cost_estimate_usd, CAST(coalesce(sum(CASE WHEN cost IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS unknown_pricing_events"""
