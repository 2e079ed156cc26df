"""The library's queries over the test tables, each with its SQL. Doubles are rounded at this edge only."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..functions import pricing, privacy
from ..functions import text as t
from ..operators import attribution, drift, mining, productivity, queue, repricing, reputation, rollup, runs, sentiment, timegap
from ..operators.dedup import dedup_events, semantic_dedup
from ..session import cut
from . import views as v
from .views import END, LEDGER, NOW, START, STATS, TASKS, TODAY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(sql: str | None = None, *, rounding: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = (lambda s, d: rounded(f(s, d))) if rounding else f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def window(s: SparkSession, d: str) -> DataFrame:
    return rollup.window(v.ledger(s, d), START, END)


# -- Rollups ---------------------------------------------------------------------------------------------------------


@query(f"WITH {LEDGER} SELECT provider_norm AS provider, model_name AS model, {STATS} FROM led GROUP BY GROUPING SETS ((provider_norm, model_name), ())")
def summary_by_model(s, d):
    return rollup.by_model(window(s, d))


@query(f"WITH {LEDGER} SELECT {STATS} FROM led")
def totals(s, d):
    return rollup.totals(window(s, d))


@query(f"""WITH {LEDGER} SELECT a.*, b.models FROM (SELECT provider_norm AS provider, {STATS} FROM led GROUP BY 1) a JOIN
(SELECT provider_norm AS provider, string_agg(model_name || '=' || c, ',' ORDER BY model_name) AS models FROM
 (SELECT provider_norm, model_name, CAST(sum(1 - is_correction) AS BIGINT) AS c FROM led GROUP BY 1, 2 HAVING sum(1 - is_correction) > 0)
  GROUP BY 1) b USING (provider)""")
def by_provider(s, d):
    text = F.array_join(F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rollup.by_provider(window(s, d)).withColumn("models", text)


@query(f"WITH {LEDGER} SELECT provider_norm AS provider, coalesce(origin, 'unknown') AS origin, {STATS} FROM led GROUP BY 1, 2")
def by_origin(s, d):
    return rollup.by_origin(window(s, d))


@query(f"WITH {LEDGER} SELECT event_date, {STATS} FROM led GROUP BY 1")
def by_day(s, d):
    return rollup.by_day(window(s, d))


@query(f"""WITH {LEDGER} SELECT provider_norm AS provider, model_name AS model,
round(CASE WHEN sum(net_input) + sum(cread + cached) > 0 THEN sum(cread + cached) * 100.0 / (sum(net_input) + sum(cread + cached))
  ELSE 0 END, 6) AS cache_hit_percent FROM led GROUP BY 1, 2""")
def cache_hits(s, d):
    rows = rollup.by_model(window(s, d)).where("provider is not null")
    return rows.select("provider", "model", rollup.cache_hit_percent(F.col("cache_read_tokens"), F.col("input_tokens")).alias("cache_hit_percent"))


@query(f"""WITH {LEDGER} SELECT count(DISTINCT provider_norm) AS providers,
round((SELECT sum(CASE WHEN p IN ('anthropic', 'openai') THEN 200.0 ELSE 0 END) FROM (SELECT DISTINCT provider_norm AS p
  FROM led)) / 30.0 * 30, 6) AS subscription_usd FROM led""")
def subscription(s, d):
    return rollup.subscription_cost(window(s, d), 30)


@query(f"""WITH {LEDGER}, m AS (SELECT provider_norm AS provider, model, coalesce(sum(cost), 0) AS cost FROM led WHERE model <> '' GROUP BY 1, 2)
SELECT provider, model, CASE model WHEN 'claude-sonnet-4-20250514' THEN 'sonnet 4.20250514' WHEN 'claude-opus-4-1' THEN 'opus 4.1' ELSE model END AS label,
round(cost, 6) AS cost, round(cost * 100 / sum(cost) OVER (), 6) AS percent FROM m""")
def model_shares(s, d):
    return rollup.model_shares(window(s, d))


@query(f"WITH {LEDGER} SELECT ord, provider_norm, round(cost, 6) AS cost_estimate_usd FROM led")
def dedup_first_wins(s, d):
    return window(s, d).select("ord", "provider_norm", "cost_estimate_usd")


@query(f"""WITH {LEDGER}, k AS (SELECT provider_norm, cost, row_number() OVER (PARTITION BY session_id, event_date, model, total
  ORDER BY ord) > 1 AS dropped FROM win)
SELECT provider_norm AS provider, dropped, count(*) AS events, round(coalesce(sum(cost), 0), 6) AS cost FROM k GROUP BY 1, 2""")
def semantic_duplicates(s, d):
    rows = v.ledger(s, d).where(F.col("event_date").between(F.lit(START).cast("date"), F.lit(END).cast("date")) & (F.col("model") != n.SYNTHETIC))
    rows = rows.withColumn(
        "total",
        n.total_tokens(*[F.col(c) for c in ("total_tokens", "input_tokens", "cached_input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]),
    )
    return semantic_dedup(rows, ["session_id", "event_date", "model", "total"]).groupBy(F.col("provider_norm").alias("provider"), "dropped").agg(
        F.count("*").alias("events"),
        F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"),
    )


@query(f"""WITH {LEDGER}, {TASKS}, s AS (SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(1 - is_correction) AS BIGINT) AS calls,
  coalesce(sum(cost), 0) AS cost FROM led GROUP BY 1),
m AS (SELECT session_id, model_name FROM (SELECT session_id, model_name, count(*) AS c FROM led GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c DESC, model_name) = 1)
SELECT s.session_id, first_ts, last_ts, calls, round(cost, 6) AS cost, model_name AS model, c_name AS brief_description, round(baseline, 6) AS baseline_hours
FROM s JOIN m USING (session_id) LEFT JOIN tsess USING (session_id) ORDER BY last_ts DESC, session_id LIMIT 50""")
def session_rollup_topk(s, d):
    return rollup.session_list(window(s, d), v.tasks(s, d), 50)


@query(f"""WITH {LEDGER} SELECT CAST(day AS DATE) AS day, round(coalesce(value, 0), 6) AS value FROM (SELECT unnest(generate_series(DATE '2023-12-28',
  DATE '2024-02-02', INTERVAL 1 DAY)) AS day) LEFT JOIN (SELECT event_date, sum(cost) AS value FROM led GROUP BY 1) ON day = event_date""")
def timeseries_cost(s, d):
    return rollup.timeseries(window(s, d), rollup.metric("cost"), "2023-12-28", "2024-02-02").withColumn("value", F.col("value").cast("double"))


@query(f"""WITH {LEDGER} SELECT CAST(day AS DATE) AS day, CAST(coalesce(calls, 0) AS BIGINT) AS calls, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens,
  coalesce(sessions, 0) AS sessions FROM (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-02', INTERVAL 1 DAY)) AS day) LEFT
  JOIN (SELECT event_date, sum(1 - is_correction) AS calls, sum(total) AS tokens, count(DISTINCT session_id) AS sessions FROM led
  GROUP BY 1) ON day = event_date""")
def timeseries_counts(s, d):
    w = window(s, d)
    daily = w.groupBy("event_date").agg(*[rollup.metric(m).alias(m) for m in ("calls", "tokens", "sessions")])
    days = rollup.calendar(s, "2023-12-28", "2024-02-02")
    return days.join(daily, F.col("day") == F.col("event_date"), "left").select(
        "day",
        *[F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in ("calls", "tokens", "sessions")],
    )


@query(f"""WITH {LEDGER}, g AS (SELECT event_date, session_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_date, session_id ORDER BY ts),
  ts) AS gap FROM led),
a AS (SELECT event_date, sum(CASE WHEN gap <= 120000000 THEN gap ELSE 0 END) / 3600000000.0 AS h FROM g GROUP BY 1)
SELECT event_date AS day, CAST(sum(1 - is_correction) AS BIGINT) AS calls, round(coalesce(sum(cost), 0), 6) AS cost,
round(coalesce(sum(CASE WHEN provider_norm = 'anthropic' THEN cost END), 0), 6) AS anthropic, round(coalesce(sum(CASE
  WHEN provider_norm = 'openai' THEN cost END), 0), 6) AS openai,
round(any_value(h), 6) AS active_hours FROM led JOIN a USING (event_date) GROUP BY 1""")
def timeline_days(s, d):
    w = window(s, d)
    cost = lambda p: F.coalesce(F.sum(F.when(F.col("provider_norm") == p, F.col("cost_estimate_usd"))), F.lit(0.0)).alias(p)
    daily = w.groupBy(F.col("event_date").alias("day")).agg(
        F.sum(1 - F.col("is_correction")).cast("long").alias("calls"),
        F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"), cost("anthropic"), cost("openai"),
    )
    active = timegap.active_by(w.withColumn("day", F.col("event_date")), ["day", "session_id"]).groupBy("day").agg(F.sum("active_hours").alias("active_hours"))
    return daily.join(active, "day")


@query(f"""WITH {LEDGER}, b AS (SELECT *, ts >= TIMESTAMP '2024-01-30 18:59:59' AS recent FROM led2 WHERE ts BETWEEN TIMESTAMP '2024-01-29 23:59:59'
  AND TIMESTAMP '2024-01-30 23:59:59' AND model <> '<synthetic>'
 QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) = 1)
SELECT CAST(coalesce(sum(CASE WHEN recent THEN total ELSE 0 END), 0) AS BIGINT) AS tokens_5h, CAST(coalesce(sum(CASE
  WHEN recent THEN cread + cached + ccreate ELSE 0 END), 0) AS BIGINT) AS cache_5h,
CAST(coalesce(sum(total), 0) AS BIGINT) AS tokens_24h, CAST(coalesce(sum(cread + cached + ccreate), 0) AS BIGINT) AS cache_24h,
  CAST(coalesce(sum(1 - is_correction), 0) AS BIGINT) AS calls_24h,
round(coalesce(sum(cost), 0), 6) AS cost_24h, round(coalesce(sum(CASE WHEN recent THEN total ELSE 0 END), 0) * 100.0 / 440000, 6) AS percent_max5x,
round(coalesce(sum(CASE WHEN recent THEN total ELSE 0 END), 0) * 100.0 / 1700000, 6) AS percent_max20x FROM b WHERE provider_norm = 'anthropic'""")
def budget_windows(s, d):
    at = F.lit(NOW).cast("timestamp_ntz")
    rows = v.ledger(s, d).where(F.col("ts").between(at - F.expr("INTERVAL 24 HOURS"), at) & (F.col("model") != n.SYNTHETIC))
    return rollup.budget(dedup_events(rows), NOW)


@query("""SELECT CASE user_id % 6 WHEN 1 THEN 'openai' WHEN 2 THEN 'openrouter' WHEN 3 THEN 'opencode' WHEN 4 THEN 'openai'
  ELSE 'anthropic' END AS provider, count(*) AS events, count(DISTINCT user_id) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts
  FROM events GROUP BY 1""")
def health(s, d):
    return v.ledger(s, d).groupBy(F.col("provider_norm").alias("provider")).agg(
        F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@query(f"""WITH {LEDGER} SELECT CASE WHEN input_tokens < 1000 THEN 'xs' WHEN input_tokens < 10000 THEN 's' WHEN input_tokens < 100000 THEN 'm'
  ELSE 'l' END AS prompt,
CASE provider_norm WHEN 'anthropic' THEN 'anthropic_claude' WHEN 'openai' THEN 'openai_codex' WHEN 'openrouter' THEN 'openrouter_openclaw'
  ELSE 'opencode_openrouter' END AS output_key,
CASE WHEN starts_with(lower(model_name), provider_norm || '/') THEN model_name ELSE provider_norm || '/' || model_name END AS model_key,
  count(*) AS events FROM led GROUP BY 1, 2, 3""")
def keys_and_buckets(s, d):
    m = n.model_name(F.col("model"))
    return window(s, d).groupBy(
        n.prompt_size(F.col("input_tokens")).alias("prompt"), n.output_key(F.col("provider_norm")).alias("output_key"),
        n.provider_model(F.col("provider_norm"), m).alias("model_key"),
    ).agg(F.count("*").alias("events"))


# -- Time ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {LEDGER}, g AS (SELECT session_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY session_id ORDER BY ts), ts) AS gap FROM led)
SELECT session_id, count(*) AS events, round(sum(CASE WHEN gap <= 1800000000 THEN gap ELSE 0 END) / 3600000000.0, 6) AS active_hours FROM g GROUP BY 1""")
def active_hours_by_session(s, d):
    return timegap.active_by(window(s, d), ["session_id"], 30)


@query(f"""WITH {LEDGER}, g AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM led)
SELECT round(sum(CASE WHEN gap <= 120000000 THEN gap ELSE 0 END) / 3600000000.0, 6) AS active_hours FROM g""")
def active_hours_merged(s, d):
    return timegap.active_merged(window(s, d), 2)


UNION = """SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {0}"""


@query(f"""WITH {LEDGER}, r AS (SELECT min(ts) AS s, max(ts) AS e FROM led GROUP BY session_id, event_date), u AS ({UNION.format("r")})
SELECT round(sum(greatest(0, date_diff('microsecond', greatest(s, coalesce(p, s)), e))) / 3600000000.0, 6) AS hours FROM u""")
def interval_union(s, d):
    return timegap.union_hours(timegap.spans(window(s, d), ["session_id", "event_date"]))


ATTENTION = """
live AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, ts FROM events WHERE event_type = 'view' AND user_id % 3 = 0),
froz AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, ts FROM events WHERE event_type = 'click' AND user_id % 3 < 2
  AND CAST(user_id AS VARCHAR) NOT IN (SELECT session_id FROM live)),
hum AS (SELECT session_id, ts, CAST(ts AS DATE) AS day FROM live UNION ALL SELECT session_id, ts, CAST(ts AS DATE) FROM froz)"""


def attention_sql(name: str, units: str, source: str) -> str:
    """CTEs for the hours and fallbacks of units (session_id, ud); ``source``: the events they fall back to."""
    return f"""
{name}_own AS (SELECT u.session_id, u.ud, h.ts FROM {units} u JOIN hum h ON h.session_id = u.session_id AND
  (h.day = u.ud OR (u.ud IS NULL AND EXISTS (SELECT 1 FROM {source} x WHERE x.session_id = u.session_id AND x.event_date = h.day)))),
{name}_miss AS (SELECT u.* FROM {units} u WHERE NOT EXISTS (SELECT 1 FROM {name}_own o WHERE o.session_id = u.session_id AND o.ud IS NOT DISTINCT FROM u.ud)),
{name}_pool AS (SELECT ts FROM {name}_own UNION ALL SELECT x.ts FROM {name}_miss m JOIN {source} x ON x.session_id = m.session_id
  AND (m.ud IS NULL OR x.event_date = m.ud)),
{name}_gap AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM {name}_pool),
{name} AS (SELECT coalesce(sum(CASE WHEN gap <= 1800000000 THEN gap ELSE 0 END), 0) / 3600000000.0 AS hours, (SELECT count(*)
  FROM {name}_miss) AS fallbacks FROM {name}_gap)"""


@query(f"""WITH {LEDGER}, {ATTENTION}, units AS (SELECT DISTINCT session_id, CAST(NULL AS DATE) AS ud FROM elig), {attention_sql("att", "units", "elig")}
SELECT round(hours, 6) AS hours, fallbacks FROM att""")
def human_attention(s, d):
    own = productivity.eligible(window(s, d))
    return timegap.attention(own.select("session_id", F.lit(None).cast("date").alias("day")).distinct(), v.prompts(s, d), v.cached_prompts(s, d), own)


# -- Productivity and sentiment --------------------------------------------------------------------------------------

GUARD = """CASE WHEN events <= 5 AND active <= 0.05 AND baseline > 1 THEN active WHEN greatest(baseline, active) > greatest(6.0,
  events) THEN greatest(6.0, events) ELSE greatest(baseline, active) END AS effective,
CASE WHEN events <= 5 AND active <= 0.05 AND baseline > 1 THEN 'ceiling_trivial' WHEN greatest(baseline, active) > greatest(6.0,
  events) THEN 'ceiling_band' WHEN baseline < active THEN 'floor' ELSE 'normal' END AS kind"""


@query(f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity / 5 AS baseline, l_discount * 40 AS active, l_suppkey % 12 AS events FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(effective, 6) AS hours, kind FROM (SELECT *, {GUARD} FROM g)""")
def effective_hours_guard(s, d):
    rows = v.table(s, d, "lineitem").withColumn("g", n.guarded_hours(F.col("l_quantity") / 5, F.col("l_discount") * 40, F.col("l_suppkey") % 12))
    return rows.select("l_orderkey", "l_linenumber", F.col("g.hours").alias("hours"), F.col("g.kind").alias("kind"))


def units_sql(name: str, keys: str, source: str, tasks: str, on: str) -> str:
    return f"""
{name}_g AS (SELECT {keys}, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY {keys} ORDER BY ts), ts) AS gap FROM {source}),
{name}_a AS (SELECT {keys}, count(*) AS events, sum(CASE WHEN gap <= 120000000 THEN gap ELSE 0 END) / 3600000000.0 AS active, min(ts) AS s,
  max(ts) AS e FROM {name}_g GROUP BY {keys}),
{name} AS (SELECT *, {GUARD} FROM (SELECT a.*, t.baseline FROM {name}_a a JOIN {tasks} t ON {on} WHERE t.baseline IS NOT NULL))"""


SUMS = """round(coalesce(sum(effective), 0), 6) AS hours_without_ai, round(coalesce(sum(active), 0), 6) AS active_hours_per_session_sum,
CAST(coalesce(sum(CASE WHEN kind = 'floor' THEN 1 ELSE 0 END), 0) AS BIGINT) AS baseline_floor_clamped, round(coalesce(sum(CASE
  WHEN kind = 'floor' THEN effective - baseline END), 0), 6) AS hours_floor_added,
CAST(coalesce(sum(CASE WHEN kind LIKE 'ceiling%' THEN 1 ELSE 0 END), 0) AS BIGINT) AS baseline_ceiling_clamped, round(coalesce(sum(CASE
  WHEN kind LIKE 'ceiling%' THEN baseline - effective END), 0), 6) AS hours_ceiling_removed,
round(coalesce(quantile_disc(baseline / events, 0.95), 0), 6) AS baseline_per_event_p95, count(*) AS sessions_covered,
  count(DISTINCT session_id) AS distinct_sessions_covered"""


@query(f"""WITH {LEDGER}, {TASKS}, {ATTENTION}, {units_sql("un", "session_id", "elig", "tsess", "t.session_id = a.session_id")},
cov AS (SELECT * FROM elig WHERE session_id IN (SELECT session_id FROM un)), uu AS (SELECT session_id, CAST(NULL AS DATE) AS ud FROM un),
  {attention_sql("att", "uu", "cov")},
ag AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM cov), am AS (SELECT coalesce(sum(CASE
  WHEN gap <= 120000000 THEN gap ELSE 0 END), 0) / 3600000000.0 AS h FROM ag),
iu AS ({UNION.format("un")}), cal AS (SELECT coalesce(sum(greatest(0, date_diff('microsecond', greatest(s, coalesce(p, s)), e))),
  0) / 3600000000.0 AS h FROM iu),
sums AS (SELECT {SUMS}, sum(effective) AS eff FROM un), x AS (SELECT *, am.h AS amh, cal.h AS calh, greatest(att.hours,
  distinct_sessions_covered * 5.0 / 60) AS den FROM sums, am, cal, att)
SELECT * EXCLUDE (eff, h, hours, fallbacks, amh, calh, den, h_1), round(amh, 6) AS active_hours, round(calh, 6) AS calendar_hours,
  round(hours, 6) AS human_attention_hours, fallbacks AS human_attention_fallbacks,
(SELECT count(DISTINCT session_id) FROM elig) AS sessions_total, round(den, 6) AS denominator_hours, round(eff - den, 6) AS hours_saved,
  round(eff / den, 6) AS multiplier, distinct_sessions_covered * 5.0 / 60 > hours AS denominator_is_floor,
round(CASE WHEN distinct_sessions_covered * 5.0 / 60 > hours OR eff / den < 1 THEN 0 ELSE eff / den END, 6) AS shown_multiplier, round(CASE
  WHEN distinct_sessions_covered * 5.0 / 60 > hours OR eff / den < 1 THEN 0 ELSE eff - den END, 6) AS shown_hours_saved,
round(den + CASE WHEN distinct_sessions_covered * 5.0 / 60 > hours OR eff / den < 1 THEN 0 ELSE eff - den END, 6) AS estimated_hours FROM x""")
def productivity_session(s, d):
    return productivity.public_block(productivity.by_session(window(s, d), v.tasks(s, d), v.prompts(s, d), v.cached_prompts(s, d)))


def chunk_sql(ledger: str = LEDGER) -> str:
    return f"""WITH {ledger}, {TASKS}, {ATTENTION}, el AS (SELECT *, event_date AS day FROM elig),
  {units_sql("un", "session_id, day", "el", "tday", "t.session_id = a.session_id AND t.day = a.day")},
cl AS (SELECT * FROM un WHERE day < DATE '2024-01-30'), op AS (SELECT * FROM un WHERE day = DATE '2024-01-30'), cov AS (SELECT el.*
  FROM el SEMI JOIN cl ON el.session_id = cl.session_id AND el.day = cl.day),
uc AS (SELECT session_id, day AS ud FROM cl), uo AS (SELECT session_id, day AS ud FROM op), ua AS (SELECT session_id, day AS ud FROM un_a),
{attention_sql("att", "uc", "el")}, {attention_sql("ato", "uo", "el")}, {attention_sql("ata", "ua", "el")},
ag AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS gap FROM cov), iu AS ({UNION.format("cl")}), iw AS ({UNION.format("un_a")}),
sums AS (SELECT {SUMS}, sum(effective) AS eff FROM cl),
x AS (SELECT *, (SELECT coalesce(sum(CASE WHEN gap <= 120000000 THEN gap ELSE 0 END), 0) / 3600000000.0 FROM ag) AS amh,
 (SELECT coalesce(sum(greatest(0, date_diff('microsecond', greatest(s, coalesce(p, s)), e))), 0) / 3600000000.0 FROM iu) AS calh,
 (SELECT coalesce(sum(greatest(0, date_diff('microsecond', greatest(s, coalesce(p, s)), e))), 0) / 3600000000.0 FROM iw) AS wcal,
 (SELECT hours FROM ato) AS oh, (SELECT hours FROM ata) AS wh, (SELECT count(*) FROM un_a WHERE day < DATE '2024-01-30') AS ue,
  (SELECT count(*) FROM un_a WHERE day = DATE '2024-01-30') AS uop,
 greatest(att.hours, distinct_sessions_covered * 5.0 / 60) AS den FROM sums, att)
SELECT * EXCLUDE (eff, hours, fallbacks, amh, calh, wcal, oh, wh, ue, uop, den), round(amh, 6) AS active_hours, round(calh,
  6) AS calendar_hours, round(wcal, 6) AS window_calendar_hours, round(hours, 6) AS human_attention_hours,
fallbacks AS human_attention_fallbacks, round(wh, 6) AS window_human_attention_hours, ue AS units_eligible,
  sessions_covered AS units_estimated, uop AS units_open, ue - sessions_covered AS units_unknown, ue > 0 AND ue = sessions_covered AS window_complete,
(SELECT count(*) FROM op) AS open_units_estimated, round((SELECT coalesce(sum(effective), 0) FROM op), 6) AS open_hours_without_ai,
  (SELECT count(DISTINCT session_id) FROM op) AS open_distinct_sessions, round(oh, 6) AS open_human_attention_hours,
round(den, 6) AS denominator_hours, round(eff - den, 6) AS hours_saved, round(eff / den, 6) AS multiplier,
  distinct_sessions_covered * 5.0 / 60 > hours AS denominator_is_floor FROM x"""


@query(chunk_sql())
def productivity_chunk(s, d):
    return productivity.by_day(window(s, d), v.tasks(s, d), v.prompts(s, d), v.cached_prompts(s, d), TODAY)


def period_sql(days: int) -> str:
    start = (date.fromisoformat(TODAY) - timedelta(days=days - 1)).isoformat()
    return f"SELECT CAST({days} AS INT) AS days, * FROM ({chunk_sql(LEDGER.replace(f"DATE '{START}'", f"DATE '{start}'"))})"


@query(f"{period_sql(7)} UNION ALL {period_sql(30)}")
def productivity_periods(s, d):
    return productivity.by_periods(v.ledger(s, d), v.tasks(s, d), v.prompts(s, d), v.cached_prompts(s, d), TODAY, (7, 30))


ZERO, NONE = "CAST(0 AS DOUBLE)", "CAST(0 AS BIGINT)"
#: The ledger of the open day alone, which has no closed units: all closed figures are zero.
TODAY_LEDGER = LEDGER.replace(f"BETWEEN DATE '{START}' AND DATE '{END}'", f"BETWEEN DATE '{TODAY}' AND DATE '{TODAY}'")


@query(f"""WITH {TODAY_LEDGER}, {TASKS}, {ATTENTION}, el AS (SELECT *, event_date AS day FROM elig),
{units_sql("un", "session_id, day", "el", "tday", "t.session_id = a.session_id AND t.day = a.day")},
uo AS (SELECT session_id, day AS ud FROM un), ua AS (SELECT session_id, day AS ud FROM un_a),
{attention_sql("ato", "uo", "el")}, {attention_sql("ata", "ua", "el")}, iw AS ({UNION.format("un_a")}),
x AS (SELECT (SELECT count(*) FROM un_a) AS uop, (SELECT count(*) FROM un) AS n, (SELECT coalesce(sum(effective), 0) FROM un) AS own,
 (SELECT count(DISTINCT session_id) FROM un) AS ds, (SELECT hours FROM ato) AS oh, (SELECT hours FROM ata) AS wh,
 (SELECT coalesce(sum(greatest(0, date_diff('microsecond', greatest(s, coalesce(p, s)), e))), 0) / 3600000000.0 FROM iw) AS wcal),
y AS (SELECT *, greatest(oh, ds * 5.0 / 60) AS den FROM x),
z AS (SELECT *, CASE WHEN den > 0 THEN own / den ELSE 0 END AS ratio FROM y),
f AS (SELECT *, oh >= ds * 5.0 / 60 AND oh >= 0.5 AND ratio BETWEEN 1 AND 50 AS fine FROM z)
SELECT {", ".join(f"{ZERO} AS {c}" for c in (
    "hours_without_ai", "active_hours_per_session_sum", "hours_floor_added", "hours_ceiling_removed", "baseline_per_event_p95", "active_hours",
    "calendar_hours", "human_attention_hours", "denominator_hours", "hours_saved", "multiplier", "estimated_hours"))},
{", ".join(f"{NONE} AS {c}" for c in (
    "baseline_floor_clamped", "baseline_ceiling_clamped", "sessions_covered", "distinct_sessions_covered", "human_attention_fallbacks",
    "units_eligible", "units_estimated", "units_unknown"))},
FALSE AS denominator_is_floor, FALSE AS window_complete, uop AS units_open, n AS open_units_estimated, round(own, 6) AS open_hours_without_ai,
ds AS open_distinct_sessions, round(oh, 6) AS open_human_attention_hours, round(wh, 6) AS window_human_attention_hours,
round(wcal, 6) AS window_calendar_hours, round(CASE WHEN uop > 0 AND fine THEN ratio ELSE 0 END, 6) AS shown_multiplier,
round(CASE WHEN uop = 0 THEN 0 WHEN fine THEN own - den END, 6) AS shown_hours_saved FROM f""")
def productivity_today(s, d):
    day = rollup.window(v.ledger(s, d), TODAY, TODAY)
    return productivity.today_block(productivity.by_day(day, v.tasks(s, d), v.prompts(s, d), v.cached_prompts(s, d), TODAY))


@query(f"""SELECT * EXCLUDE (active_hours) FROM (WITH {TODAY_LEDGER} SELECT {STATS} FROM led), ({SQL["budget_windows"]}), ({SQL["productivity_today"]}),
(WITH {LEDGER} SELECT count(DISTINCT session_id) AS sessions_24h, max(ts) AS last_ts FROM led2
 WHERE ts BETWEEN TIMESTAMP '2024-01-29 23:59:59' AND TIMESTAMP '{NOW}' AND model <> '<synthetic>')""")
def today_payload(s, d):
    return productivity.today_payload(v.ledger(s, d), v.tasks(s, d), v.prompts(s, d), v.cached_prompts(s, d), TODAY, NOW)


SENT = f"""{LEDGER}, {TASKS}, sp AS (SELECT session_id, CAST(min(ts) AS DATE) AS day FROM elig GROUP BY 1),
cv AS (SELECT sp.session_id, day, CASE WHEN day - DATE '2024-01-01' < 15 THEN 1 ELSE 2 END AS half, c_custkey % 4 AS profanity, c_custkey % 3 AS thanks,
 least(1.0, (c_custkey % 13) / 10) AS fr, least(1.0, (c_custkey % 9) / 8) AS ap, CASE WHEN c_custkey % 6 = 0 THEN NULL
  ELSE 'mood ' || (c_custkey % 6) END AS mood
 FROM sp JOIN tsess USING (session_id) WHERE c_custkey % 11 <> 0), dy AS (SELECT day, sum(profanity) AS p, sum(thanks) AS t, count(*) AS n
  FROM cv GROUP BY 1)"""


@query(f"""WITH {SENT}, h AS (SELECT avg(CASE WHEN half = 1 THEN fr END) AS a, avg(CASE WHEN half = 2 THEN fr END) AS b FROM cv)
SELECT CAST(sum(profanity) AS BIGINT) AS profanity_total, CAST(sum(thanks) AS BIGINT) AS appreciation_total, round(avg(fr),
  6) AS frustration_avg, round(avg(ap), 6) AS appreciation_avg,
(SELECT CASE WHEN a IS NULL OR b IS NULL THEN 'n/a (need both halves)' WHEN b - a <= -0.05 THEN '↘ improving'
  WHEN b - a >= 0.05 THEN '↗ worsening' ELSE '→ stable' END FROM h) AS stress_trend, count(*) AS sessions_covered,
(SELECT day FROM dy ORDER BY p DESC, n DESC, day DESC LIMIT 1) AS top_day, (SELECT CAST(max(p) AS BIGINT) FROM dy) AS top_day_profanity,
  (SELECT day FROM dy ORDER BY t DESC, n DESC, day DESC LIMIT 1) AS top_appreciation_day,
CASE WHEN avg(fr) < 0.2 THEN 'low' WHEN avg(fr) < 0.4 THEN 'medium-low' WHEN avg(fr) < 0.6 THEN 'medium'
  WHEN avg(fr) < 0.8 THEN 'medium-high' ELSE 'high' END AS frustration_label FROM cv""")
def sentiment_rollup(s, d):
    return sentiment.summary(sentiment.covered(window(s, d), v.tasks(s, d), START, END))


@query(f"WITH {SENT} SELECT mood, count(*) AS sessions FROM cv WHERE mood IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def sentiment_moods(s, d):
    return sentiment.moods(sentiment.covered(window(s, d), v.tasks(s, d), START, END))


@query(f"""WITH {SENT} SELECT CAST(g.day AS DATE) AS day, CAST(coalesce(sum(profanity), 0) AS BIGINT) AS profanity, round(coalesce(avg(fr), 0),
  6) AS frustration FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day) g LEFT
  JOIN cv ON g.day = cv.day GROUP BY 1""")
def sentiment_timeseries(s, d):
    return sentiment.daily(sentiment.covered(window(s, d), v.tasks(s, d), START, END), START, END)


# -- Drift -----------------------------------------------------------------------------------------------------------

DRIFT = f"""{LEDGER}, pr AS (SELECT provider_norm AS provider, model_name AS model, event_date AS day, sum(coalesce(cost, 0)) AS c,
  sum(output_tokens) AS o FROM led GROUP BY 1, 2, 3),
pt AS (SELECT provider, model, coalesce(sum(CASE WHEN day >= DATE '2024-01-24' THEN c END), 0) AS sc, coalesce(sum(CASE
  WHEN day >= DATE '2024-01-24' THEN o END), 0) AS so,
 coalesce(sum(CASE WHEN day < DATE '2024-01-24' THEN c END), 0) AS bc, coalesce(sum(CASE WHEN day < DATE '2024-01-24' THEN o END), 0) AS bo
  FROM pr WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 1, 2),
rt AS (SELECT provider, model, sc / so AS rs, bc / bo AS rb FROM pt WHERE so >= 10 AND bc <> 0 AND bo > 0 AND so > 0)"""
RUNS = """hi AS (SELECT pr.provider, pr.model, day, day - CAST(row_number() OVER (PARTITION BY pr.provider, pr.model ORDER BY day) AS INT) AS isl
  FROM pr JOIN rt USING (provider, model) WHERE day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' AND o > 0 AND c / o / rb > {0}),
rn AS (SELECT provider, model, min(day) AS a, max(day) AS b, count(*) AS n FROM hi GROUP BY provider, model, isl
  QUALIFY row_number() OVER (PARTITION BY provider, model ORDER BY n DESC, b DESC) = 1)"""


@query(f"""WITH {DRIFT}, {RUNS.format("1.02")} SELECT rt.provider, rt.model, round(rs, 6) AS rate_short, round(rb, 6) AS rate_base, round(rs / rb,
  6) AS ratio, round((rs / rb - 1) * 100, 6) AS delta_pct,
coalesce(a, DATE '2024-01-24') AS window_start, coalesce(b, DATE '2024-01-30') AS window_end FROM rt LEFT JOIN rn USING (provider, model)
  WHERE rs / rb > 1.02""")
def cost_regression(s, d):
    return drift.cost_regressions(window(s, d), TODAY, threshold=1.02)


@query(f"WITH {DRIFT}, {RUNS.format('1.1')} SELECT provider, model, a AS run_start, b AS run_end FROM rn")
def elevated_runs(s, d):
    w = window(s, d)
    base = drift.pair_totals(w, TODAY).where("short_output >= 10 and base_cost <> 0 and base_output > 0").select(
        "provider", "model",
        (F.col("base_cost") / F.col("base_output")).alias("rate_base"),
    )
    recent, _, end = drift.limits(TODAY, 7, 30)
    return drift.elevated_runs(w, base, recent, end, 1.1)


SLIP = f"""{LEDGER}, fp AS (SELECT provider_norm AS provider, model_name AS model, CASE WHEN input_tokens + cread + ccreate < 1000 THEN 'xs'
  WHEN input_tokens + cread + ccreate < 10000 THEN 's' ELSE 'm' END AS bucket, event_date >= DATE '2024-01-24' AS new, coalesce(cost,
  0) AS cost FROM led),
bl AS (SELECT provider, model, bucket, count(*) AS events, CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) AS BIGINT) AS events_7d,
  median(cost) AS m, coalesce(median(CASE WHEN new THEN cost END), 0) AS m7, coalesce(median(CASE WHEN NOT new THEN cost END), 0) AS mb,
 quantile_disc(cost, 0.95) AS p, quantile_disc(CASE WHEN new THEN cost END, 0.95) AS p7 FROM fp GROUP BY 1, 2, 3 HAVING sum(CASE
  WHEN new THEN 1 ELSE 0 END) >= 5)"""
SLIP_OUT = "provider, model, bucket, events, events_7d, round(m, 6) AS median_cost, round(m7, 6) AS median_cost_7d, round(mb, 6) AS median_cost_baseline, round(p, 6) AS p95_cost, round(p7, 6) AS p95_cost_7d"


@query(f"WITH {SLIP} SELECT {SLIP_OUT} FROM bl")
def slippage_baselines(s, d):
    return drift.slippage_baselines(window(s, d), TODAY)


@query(f"WITH {SLIP} SELECT {SLIP_OUT}, round(m7 / mb, 6) AS ratio, round((m7 / mb - 1) * 100, 6) AS delta_pct FROM bl WHERE mb > 0 AND m7 / mb > 1.05")
def model_slippage(s, d):
    return drift.slippages(drift.slippage_baselines(window(s, d), TODAY), 1.05)


# -- Attribution, reputation, prices ---------------------------------------------------------------------------------

COMMITS = """cm AS (SELECT '/work/repo' || (o_orderkey % 2) AS repo, CAST(o_orderkey AS VARCHAR) AS hash,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(o_orderkey * 37 % 43200 AS INT)) AS tm, CAST(trunc(o_totalprice) AS BIGINT) % 400 AS lines FROM orders),
se AS (SELECT session_id || ':' || event_date AS session_id, min(ts) AS s, max(ts) AS e, coalesce(sum(cost), 0) AS cost, min(CASE
  WHEN user_id % 3 = 0 THEN '/work/repo0/src' WHEN user_id % 3 = 1 THEN 'C:\\Work\\Repo1' END) AS wd FROM led GROUP BY session_id, event_date),
pair AS (SELECT se.session_id, se.s, cm.repo, cm.hash, cm.tm, cm.lines, coalesce(wd = '/work/repo0/src' AND repo = '/work/repo0',
  FALSE) AS near FROM se JOIN cm ON tm BETWEEN s AND e)"""
COSTS = f"""{LEDGER}, {COMMITS}, co AS (SELECT se.session_id, se.cost, count(hash) AS commits, CAST(coalesce(sum(lines), 0) AS BIGINT) AS lines FROM se
  LEFT JOIN pair USING (session_id) GROUP BY 1, 2)"""
OWNERS = f"""{LEDGER}, {COMMITS}, gp AS (SELECT pair.*, (SELECT min(abs(date_diff('microsecond', l.ts, pair.tm))) FROM led l
  WHERE l.session_id || ':' || l.event_date = pair.session_id) AS gap FROM pair),
ow AS (SELECT * FROM gp QUALIFY row_number() OVER (PARTITION BY repo, hash ORDER BY CASE WHEN near THEN 0 ELSE 1 END, gap, s, session_id) = 1)"""


def work_events(s, d) -> DataFrame:
    """Events of work sessions, each of which is a user's day."""
    session = F.concat_ws(":", "session_id", F.col("event_date").cast("string")).alias("session_id")
    return window(s, d).select(session, "ts", "cost_estimate_usd", "working_dir")


def work_sessions(events: DataFrame) -> DataFrame:
    """Work sessions with their costs."""
    return events.groupBy("session_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"),
        F.min("working_dir").alias("working_dir"),
    ).where("session_id <> '' and start is not null")


def work(s, d) -> tuple[DataFrame, DataFrame]:
    """Work sessions and their events, each made once."""
    events = cut(work_events(s, d))
    return cut(work_sessions(events)), events


@query(f"WITH {COSTS} SELECT session_id, round(cost, 6) AS cost, commits, lines, round(CASE WHEN lines > 0 THEN cost / lines END, 6) AS cost_per_line FROM co")
def diff_cost_sessions(s, d):
    return attribution.session_costs(work_sessions(work_events(s, d)), v.commits(s, d))


@query(f"""WITH {COSTS}, cl AS (SELECT session_id, cost, commits, lines, cost / lines AS cpl FROM co WHERE lines > 0), th AS (SELECT cpl AS threshold
  FROM (SELECT cpl, row_number() OVER (ORDER BY cpl) - 1 AS r, count(*) OVER () AS n FROM cl) WHERE r = CAST(ceil(round((n - 1) * 0.9, 6)) AS BIGINT))
SELECT session_id, round(cost, 6) AS cost, commits, lines, round(cpl, 6) AS cost_per_line, round(threshold, 6) AS threshold FROM cl, th
  WHERE cpl >= threshold ORDER BY cpl DESC, session_id LIMIT 5""")
def diff_cost_expensive(s, d):
    return attribution.expensive(attribution.session_costs(work_sessions(work_events(s, d)), v.commits(s, d)))


@query(f"WITH {OWNERS} SELECT repo, hash, session_id, gap FROM ow")
def commit_attribution(s, d):
    sessions, events = work(s, d)
    return attribution.owners(sessions, events, v.commits(s, d))


@query(f"""WITH {OWNERS}, ps AS (SELECT repo, session_id, sum(ow.lines) AS lines FROM ow GROUP BY 1, 2 HAVING sum(ow.lines) > 0)
SELECT repo, count(*) AS sessions, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(CASE WHEN cost / lines >= 0.01 THEN 1
  ELSE 0 END) AS BIGINT) AS expensive_sessions FROM ps JOIN se USING (session_id) GROUP BY 1""")
def diff_cost_repos(s, d):
    sessions, events = work(s, d)
    return attribution.by_repo(sessions, events, v.commits(s, d), 0.01)


REPUTATION = """st AS (SELECT p_brand AS role, 'agent' || (l_suppkey % 8) AS agent, CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'N' THEN 'error'
  ELSE 'timeout' END AS status, l_returnflag = 'A' AS ok, l_quantity * 1000 AS dur, l_shipdate AS tm, l_orderkey * 10 + l_linenumber AS ord,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linestatus END AS fp FROM lineitem JOIN part ON l_partkey = p_partkey),
rp AS (SELECT role, agent, count(*) AS runs, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS successes, avg(dur) AS dur,
  max(tm) AS last_at, struct_extract(min(struct_pack(o := ord, f := fp)) FILTER (fp IS NOT NULL), 'f') AS fingerprint,
  count(*) FILTER (status = 'timeout') AS tmo FROM st GROUP BY 1, 2),
rw AS (SELECT *, successes / runs AS rate, greatest(0,
  (successes / runs + 3.8416 / (2 * runs) - 1.96 * sqrt((successes / runs * (1 - successes / runs) + 3.8416 / (4 * runs)) / runs)) / (1 + 3.8416 / runs)) AS w FROM rp)"""
REPUTATION_OUT = "role, agent, runs, successes, round(dur, 6) AS mean_duration_ms, last_at, fingerprint, round(rate, 6) AS success_rate, round(w, 6) AS wilson, CASE WHEN runs <= 1 THEN 'low (single-run sample)' WHEN runs < 5 THEN 'low (small sample)' WHEN runs < 10 THEN 'medium' ELSE 'high' END AS confidence, tmo AS timeouts"


def reputations(s, d):
    return reputation.ledger(v.steps(s, d)).withColumn("timeouts", F.coalesce(F.try_element_at("statuses", F.lit("timeout")), F.lit(0)).cast("long"))


@query(f"WITH {REPUTATION} SELECT {REPUTATION_OUT} FROM rw")
def reputation_ledger(s, d):
    return reputations(s, d).drop("statuses")


@query(f"WITH {REPUTATION} SELECT {REPUTATION_OUT} FROM rw QUALIFY row_number() OVER (PARTITION BY role ORDER BY w DESC, runs DESC, dur, agent) = 1")
def best_agent_by_role(s, d):
    return reputation.best_by_role(reputations(s, d)).drop("statuses")


@query(f"""WITH {REPUTATION}, f AS (SELECT agent, status, count(*) AS failures FROM st WHERE NOT ok GROUP BY 1, 2) SELECT agent, status, failures,
  CAST(row_number() OVER (PARTITION BY agent ORDER BY failures DESC, status) AS INT) AS nth FROM f QUALIFY nth <= 3""")
def failure_modes(s, d):
    return reputation.failure_modes(v.steps(s, d))


@query(f"""WITH {LEDGER} SELECT provider_norm AS provider, count(DISTINCT session_id) AS sessions, CAST(sum(1 - is_correction) AS BIGINT) AS calls,
  round(coalesce(sum(cost), 0), 6) AS cost, max(ts) AS last_ts, round(coalesce(sum(cost), 0) / count(DISTINCT session_id), 6) AS cost_per_session
FROM led WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-30 23:59:59' GROUP BY 1""")
def direct_activity(s, d):
    return reputation.direct_activity(window(s, d), "2024-01-10", NOW)


@query(f"""WITH {REPUTATION}, fl AS (SELECT CAST(ord // 10 AS BIGINT) AS flow_id, CAST(ord AS BIGINT) AS ord, CASE WHEN ord % 4 = 3 THEN 'reviewer'
  ELSE role END AS role, agent FROM st),
r AS (SELECT fl.*, CASE WHEN coalesce(runs, 0) < 5 THEN 'MED' WHEN rate < 0.7 THEN 'HIGH' WHEN tmo >= 1 AND tmo / runs >= 0.2 THEN 'MED' ELSE 'LOW' END AS risk,
  lead(fl.role) OVER (PARTITION BY flow_id ORDER BY ord, fl.role, fl.agent) IS NOT DISTINCT FROM 'reviewer' AS nxt FROM fl LEFT
  JOIN rw ON rw.role = fl.role AND rw.agent = fl.agent),
c AS (SELECT *, role <> 'reviewer' AND risk <> 'LOW' AND NOT nxt AS ask FROM r),
g AS (SELECT *, sum(CASE WHEN ask THEN 0 ELSE 1 END) OVER (PARTITION BY flow_id ORDER BY ord, role, agent ROWS UNBOUNDED PRECEDING) AS grp FROM c)
SELECT flow_id, ord, role, agent, risk, CASE WHEN ask AND row_number() OVER (PARTITION BY flow_id, grp, ask ORDER BY ord, role,
  agent) % 2 = 1 THEN 'inject_reviewer'
  WHEN role <> 'reviewer' AND risk = 'LOW' AND nxt THEN 'trim_reviewer' ELSE 'keep' END AS action FROM g""")
def disagreement_routing(s, d):
    steps = v.steps(s, d)
    flow = steps.select(
        (F.col("ord") / 10).cast("long").alias("flow_id"), "ord",
        F.when(F.col("ord") % 4 == 3, "reviewer").otherwise(F.col("role")).alias("role"), "agent",
    )
    return reputation.route(flow, reputations(s, d))


@query(f"""WITH {REPUTATION}, cur AS (SELECT DISTINCT p_brand AS role, 'agent1' AS now FROM part WHERE p_size > 2), b AS (SELECT role, agent, CASE
  WHEN runs <= 1 THEN 'low (single-run sample)' WHEN runs < 5 THEN 'low (small sample)' WHEN runs < 10 THEN 'medium'
  ELSE 'high' END AS confidence FROM rw QUALIFY row_number() OVER (PARTITION BY role ORDER BY w DESC, runs DESC, dur, agent) = 1)
SELECT role, CASE WHEN agent IS NULL THEN 'keep' WHEN now IS NULL THEN 'add' WHEN now = agent THEN 'keep' ELSE 'change' END AS action,
  coalesce(agent, now) AS agent, confidence FROM cur FULL JOIN b USING (role)""")
def role_changes(s, d):
    current = v.table(s, d, "part").where("p_size > 2").select(F.col("p_brand").alias("role"), F.lit("agent1").alias("agent")).distinct()
    return reputation.role_changes(reputation.best_by_role(reputations(s, d)), current)


CLAIMS = "cl AS (SELECT user_id AS issue, event_id AS id, ts AS tm, CASE WHEN event_type = 'click' THEN 'claim' ELSE 'heartbeat' END AS kind, 'x' || event_id AS exec_id, event_id % 7 * 600 AS lease FROM events)"


def claims(s, d):
    return v.table(s, d, "events").selectExpr(
        "user_id AS issue", "event_id AS id", "ts AS at",
        "CASE WHEN event_type = 'click' THEN 'claim' ELSE 'heartbeat' END AS kind", "concat('x', event_id) AS exec_id",
        "event_id % 7 * 600 AS lease_seconds",
    )


@query(f"""WITH {CLAIMS} SELECT issue, exec_id, date_diff('microsecond', tm, TIMESTAMP '2024-01-30 23:59:59') // 1000000 > lease AS expired FROM cl
  QUALIFY row_number() OVER (PARTITION BY issue ORDER BY tm DESC, id DESC) = 1""")
def lease_states(s, d):
    return reputation.latest_claims(claims(s, d), NOW)


@query(f"WITH {CLAIMS} SELECT issue, arg_min(exec_id, id) AS exec_id FROM cl WHERE kind = 'claim' GROUP BY 1")
def winning_claims(s, d):
    return reputation.winning_claim(claims(s, d))


PRICES = """pc AS (SELECT l_orderkey, l_linenumber, ['gpt-6-astra', 'gpt-5.6-sol-ultra', 'gpt-5.6-terra', 'GPT-5.6-Luna', 'gpt-5.5', 'codex-auto-review',
  'claude-opus-5', 'claude-sonnet-4', 'claude-haiku-3', 'claude-x'][l_suppkey % 10 + 1] AS m,
CAST(floor(l_extendedprice * 10) AS BIGINT) AS i, CAST(l_quantity AS BIGINT) * 100 AS c, CAST(l_partkey AS BIGINT) AS o,
  CAST(l_shipdate + INTERVAL 30 YEAR AS DATE) AS day FROM lineitem)"""


@query(f"""WITH {PRICES}, q AS (SELECT *, CASE WHEN m = 'gpt-6-astra' THEN CASE WHEN i > 272000 THEN [20, 2, 75] ELSE [10, 1, 50] END
  WHEN m LIKE 'gpt-5.6-sol%' THEN CASE WHEN day >= DATE '2026-08-21' THEN [4, 0.4, 20] ELSE [5, 0.5, 30] END
WHEN m = 'gpt-5.6-terra' THEN CASE WHEN day >= DATE '2026-07-30' THEN [2, 0.2, 12] ELSE [2.5, 0.25, 15] END
  WHEN lower(m) = 'gpt-5.6-luna' THEN CASE WHEN day >= DATE '2026-07-30' THEN [0.2, 0.02, 1.2] ELSE [1, 0.1, 6] END ELSE [5, 0.5,
  30] END::DOUBLE[] AS r,
CASE m WHEN 'claude-opus-5' THEN [5, 25, 0.5, 6.25, 10] WHEN 'claude-sonnet-4' THEN [3, 15, 0.3, 3.75, 6] WHEN 'claude-haiku-3' THEN [1, 5,
  0.1, 1.25, 2] END::DOUBLE[] AS k FROM pc)
SELECT l_orderkey, l_linenumber, CASE WHEN m LIKE 'claude%' THEN round((i * k[1] + o * k[2] + c * k[3] + greatest(c - least(o, c),
  0) * k[4] + least(o, c) * k[5]), 2)
 ELSE round((greatest(i - c, 0) * r[1] + c * r[2] + o * r[3]), 2) END AS cost_micro FROM q""")
def pricing_effective_dated(s, d):
    models = (
        "gpt-6-astra", "gpt-5.6-sol-ultra", "gpt-5.6-terra", "GPT-5.6-Luna", "gpt-5.5", "codex-auto-review", "claude-opus-5",
        "claude-sonnet-4", "claude-haiku-3", "claude-x",
    )
    rows = v.table(s, d, "lineitem").withColumn("m", F.element_at(F.array(*map(F.lit, models)), (F.col("l_suppkey") % 10 + 1).cast("int")))
    i, c, o = F.floor(F.col("l_extendedprice") * 10), F.col("l_quantity").cast("bigint") * 100, F.col("l_partkey").cast("bigint")
    openai = pricing.openai_cost(F.col("m"), i, c, o, F.to_date(F.col("l_shipdate") + F.expr("INTERVAL 30 YEAR")))
    claude = pricing.claude_cost(F.col("m"), i, o, c, c, o)
    return rows.select(
        "l_orderkey", "l_linenumber",
        F.round(F.when(F.startswith("m", F.lit("claude")), claude).otherwise(openai) * 1_000_000, 2).alias("cost_micro"),
    )


@query(f"""WITH {LEDGER}, nc AS (SELECT *, CASE WHEN provider_norm = 'anthropic' THEN CASE
  WHEN model = 'claude-opus-4-1' THEN (input_tokens * 5.0 + output_tokens * 25.0 + cread * 0.5 + ccreate * 6.25) / 1000000
 WHEN model LIKE 'claude-sonnet-%' THEN (input_tokens * 3.0 + output_tokens * 15.0 + cread * 0.3 + ccreate * 3.75) / 1000000 END
  WHEN provider_norm = 'openai' THEN (net_input * 5.0 + cached * 0.5 + output_tokens * 30.0) / 1000000 ELSE cost END AS new_cost FROM led)
SELECT provider_norm AS provider, count(*) AS events, CAST(sum(CASE WHEN new_cost IS DISTINCT FROM cost THEN 1
  ELSE 0 END) AS BIGINT) AS changed, round(coalesce(sum(cost), 0), 4) AS old_cost, round(coalesce(sum(new_cost), 0), 4) AS new_cost FROM nc GROUP BY 1""")
def recost(s, d):
    return rounded(repricing.recost_report(window(s, d)), 4)


# -- Texts -----------------------------------------------------------------------------------------------------------

LETTER = "A-Za-zА-Яа-яЁё"
WORDS = f"regexp_extract_all(lower(text), '[{LETTER}][{LETTER}'']*')"
HEDGE_1 = ", ".join(f"'{h}'" for h in t.HEDGES if " " not in h)
IMPER = ", ".join(f"'{h}'" for h in t.IMPERATIVES)


def hits(phrases) -> str:
    return " + ".join("((length(lo) - length(replace(lo, '{0}', ''))) // {1})".format(p.replace("'", "''"), len(p)) for p in phrases)


SLOP = f"""sl0 AS (SELECT doc_id, source, lower(text) AS lo, {WORDS} AS w FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
sl1 AS (SELECT *, len(w) AS n, CASE WHEN len(w) < 3 THEN 0 ELSE 1 - len(list_distinct(list_transform(range(1, len(w) - 1),
  lambda i: array_to_string(w[i:i + 2], ' ')))) / (len(w) - 2) END AS tri, {hits(t.STOCK)} AS st,
 len(list_filter(w, lambda x: x IN ({HEDGE_1}))) + {hits([h for h in t.HEDGES if " " in h])} AS h, len(list_filter(w,
  lambda x: x IN ({IMPER}))) AS im FROM sl0),
sl2 AS (SELECT doc_id, source, n AS word_count, tri AS trigram, CASE WHEN n > 0 THEN least(st * 100 / greatest(n, 1) / 5.0, 1)
  ELSE 0 END AS stock, CASE WHEN h = 0 THEN 0 WHEN im = 0 THEN 1 ELSE least(h / im, 1) END AS hedge FROM sl1),
sl AS (SELECT *, (0.4 * trigram + 0.3 * stock + 0.3 * hedge) * 100 AS score FROM sl2)"""


@query(f"""WITH {SLOP} SELECT doc_id, round(score, 6) AS score, round(trigram, 6) AS trigram, round(stock, 6) AS stock, round(hedge, 6) AS hedge,
  CAST(word_count AS INT) AS word_count FROM sl""")
def slop_components(s, d):
    return t.slop(v.table(s, d, "documents")).select("doc_id", F.col("score").cast("double").alias("score"), "trigram", "stock", "hedge", "word_count")


@query(f"""WITH {SLOP}, x AS (SELECT *, source AS agent, doc_id % 3 AS role FROM sl) SELECT agent, role, CAST(grouping(agent, role) AS BIGINT) AS level,
  count(*) AS texts, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, round(avg(trigram), 6) AS mean_trigram,
  round(avg(stock), 6) AS mean_stock, round(avg(hedge), 6) AS mean_hedge FROM x GROUP BY GROUPING SETS ((agent), (role), (agent, role), ())""")
def slop_by_source(s, d):
    rows = v.table(s, d, "documents").select(F.col("source").alias("agent"), (F.col("doc_id") % 3).alias("role"), "text")
    return mining.slop_rollup(rows, ["agent", "role"])


NOISY = " OR ".join("starts_with(ltrim(lower(left(text, 80))), '{0}')".format(p.replace("'", "''")) for p in t.NOISE)
KIND = "CASE WHEN split_part(prefix, ' ', 1) IN ({0}) THEN 'script' WHEN split_part(prefix, ' ', 1) IN ({1}) THEN 'prompt-template' WHEN len(string_split(prefix, ' ')) < 3 THEN 'noise' ELSE 'prompt-template' END".format(
    *[", ".join(f"'{w}'" for w in dict.fromkeys(words)) for words in (t.VERBS, t.QUESTIONS)]
)


@query(f"""WITH p AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[{LETTER}0-9_]+') AS w FROM conversations WHERE role = 'user' AND NOT ({NOISY})),
k AS (SELECT CAST(conv_id AS VARCHAR) AS s, conv_id * 1000 + turn AS ord, array_to_string(w[1:2], ' ') AS prefix FROM p WHERE len(w) >= 2),
g AS (SELECT prefix, count(*) AS occurrences, count(DISTINCT s) AS sessions, min(ord) AS first_at, max(ord) AS last_at, CAST(least(count(*),
  3) AS INT) AS shown FROM k GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT *, coalesce(nullif(trim(regexp_replace(trim(prefix), '[^{LETTER}0-9]+', '-', 'g'), '-'), ''), 'pattern') AS name FROM g)
SELECT prefix, occurrences, sessions, first_at, last_at, shown, {KIND} AS kind, left(lower(CASE WHEN regexp_full_match(name,
  '[A-Za-z0-9._-]+') THEN name ELSE 'pattern-' || left(sha256(name), 8) END), 60) AS slug FROM n""")
def pattern_mining(s, d):
    rows = v.table(s, d, "conversations").where("role = 'user'")
    found = mining.patterns(rows.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text"), 2)
    return found.select("prefix", "occurrences", "sessions", "first_at", "last_at", F.size("examples").alias("shown"), "kind", "slug")


def marker_sql(text: str, patterns) -> str:
    """How often patterns occur. Borders are signs that are part of no word of any script; all such signs are doubled before,
    so that two words may share one."""
    start, end = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    spelled = [re.sub(r"\\b(?=$|[|)])", lambda _: end, p).replace(r"\b", start).replace("'", "''") for p in patterns]
    doubled = f"regexp_replace(coalesce({text}, ''), '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    return " + ".join(f"len(regexp_extract_all({doubled}, '(?i){p}'))" for p in spelled)


@query(f"SELECT conv_id, turn, CAST({marker_sql('text', t.PROFANITY)} AS INT) AS profanity, CAST({marker_sql('text', t.THANKS)} AS INT) AS thanks FROM conversations")
def profanity_count(s, d):
    rows = v.table(s, d, "conversations")
    return rows.select(
        "conv_id", "turn",
        t.count_markers(F.col("text"), t.PROFANITY).alias("profanity"), t.count_markers(F.col("text"), t.THANKS).alias("thanks"),
    )


def outputs(s, d):
    """Markdown of roles: whole texts of documents, each sentence a bullet; lines that are Markdown stay. Dealt by run, so
    that texts travel once instead of their findings twice."""
    lines = F.regexp_replace("text", r"(?<=[^0-9\s][.!?])[ \t]+", "\n")
    text = F.regexp_replace(lines, r"(?m)^(?!\s*(?:##|```|~~~)|[-*+]\s|[0-9]+\.\s)(?=.*\S)", "- ")
    return v.table(s, d, "documents").select(
        (F.col("doc_id") / 8).cast("long").alias("run_id"),
        F.concat(F.lit("role"), (F.col("doc_id") % 8).cast("string")).alias("role"), text.alias("text"),
    ).repartition("run_id")


@query(None)
def consensus_findings(s, d):
    return mining.findings(outputs(s, d)).select("run_id", "role", "fid", "ord", "title")


STOP = ", ".join(f"'{w}'" for w in sorted(set(t.STOP_WORDS)))


@query(f"""WITH tk AS (SELECT doc_id, source AS run_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(text, '^[^\\n]*')),
  '[{LETTER}0-9_]+'), lambda x: len(x) > 1 AND x NOT IN ({STOP})))) AS w FROM documents WHERE text IS NOT NULL)
SELECT a.run_id, a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS similarity
FROM tk a JOIN tk b ON a.run_id = b.run_id AND a.doc_id < b.doc_id WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w,
  b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.4""")
def consensus_pairs(s, d):
    """Documents by their titles: the operator compares titles of findings, and a document's is its first line."""
    title = t.tokens(F.substring_index("text", "\n", 1))
    rows = v.table(s, d, "documents").where("text IS NOT NULL").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("fid"), F.array_sort(F.array_distinct(title)).alias("tokens"),
    )
    return mining.similar_pairs(rows)


@query(f"""WITH tk AS (SELECT doc_id, source AS run_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[{LETTER}0-9_]+'),
  lambda x: len(x) > 1 AND x NOT IN ({STOP})))) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT run_id, w, min(doc_id) AS class, count(*) AS size FROM tk GROUP BY 1, 2)
SELECT tk.run_id, tk.doc_id AS fid, g.class, g.size FROM tk JOIN g ON tk.run_id IS NOT DISTINCT FROM g.run_id AND tk.w = g.w""")
def consensus_classes(s, d):
    """Whole documents with the same tokens."""
    return mining.similar_classes(document_tokens(s, d))[0]


@query(f"""WITH tk AS (SELECT doc_id, source AS run_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[{LETTER}0-9_]+'),
  lambda x: len(x) > 1 AND x NOT IN ({STOP})))) AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT run_id, w, min(doc_id) AS fid FROM tk GROUP BY 1, 2)
SELECT a.run_id, a.fid AS a, b.fid AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS similarity
FROM g a JOIN g b ON a.run_id = b.run_id AND a.fid < b.fid AND least(len(a.w), len(b.w)) >= 0.4 * greatest(len(a.w), len(b.w))
WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.4""")
def consensus_class_pairs(s, d):
    """Pairs of classes of whole documents."""
    return mining.similar_classes(document_tokens(s, d))[1]


def document_tokens(s, d):
    rows = v.table(s, d, "documents").where("text IS NOT NULL")
    return rows.select(F.col("source").alias("run_id"), F.col("doc_id").alias("fid"), F.array_sort(F.array_distinct(t.tokens(F.col("text")))).alias("tokens"))


@query(f"""WITH tk AS (SELECT doc_id AS fid, source AS run_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[{LETTER}0-9_]+'),
  lambda x: len(x) > 1 AND x NOT IN ({STOP})))) AS w FROM documents WHERE text IS NOT NULL)
SELECT a.run_id, a.fid AS a, b.fid AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS similarity
FROM tk a JOIN tk b ON a.run_id = b.run_id AND a.fid < b.fid AND least(len(a.w), len(b.w)) >= 0.4 * greatest(len(a.w), len(b.w))
WHERE len(list_intersect(a.w, b.w)) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.4""")
def consensus_pairs_all(s, d):
    """Whole documents of all languages, with the operator's own tokens."""
    return mining.similar_pairs(document_tokens(s, d))


@query(None)
def consensus_matrix(s, d):
    # (a token has two signs, and there is one more between two)
    texts = v.table(s, d, "documents").groupBy((F.col("doc_id") / 8).cast("long").alias("run_id")).agg(F.sum((F.length("text") + 1) / 3).alias("n"))
    return mining.consensus(mining.findings(outputs(s, d), titles=False), sizes=texts)


def spelled_signs(pattern: str) -> str:
    """A pattern whose word signs are those of every script, for DuckDB."""
    signs = r"\p{L}\p{N}_"
    return pattern.replace("'", "''").replace(r"[\w", f"[{signs}").replace(r"[^\w", f"[^{signs}").replace(r"\w", f"[{signs}]")


def scan_sql() -> str:
    """Word signs of every script, spelled out as DuckDB needs them."""
    parts = []
    for kind, pattern in privacy.SCAN.items():
        parts.append(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{spelled_signs(pattern)}')) AS value FROM documents")
    return " UNION ALL ".join(parts)


@query(scan_sql())
def privacy_findings(s, d):
    return privacy.scan(v.table(s, d, "documents"), "doc_id", "text")


def scrub_sql() -> str:
    out = "coalesce(text, '')"
    for pattern, name in ((privacy.PATH_WIN, "[path]"), (privacy.PATH_UNIX, "[path]"), (privacy.EMAIL, "[email]"), (privacy.TOKEN, "[token]")):
        # what stands before a path is kept
        p = re.sub(r"\(\?<!\[(.*?)\]\)", r"(^|[^\1])", pattern)
        out = f"regexp_replace({out}, '{spelled_signs(p)}', '{chr(92) + '1' if p != pattern else ''}{name}', 'g')"
    return f"SELECT doc_id, {out} AS text FROM documents"


def gate_sql() -> str:
    parts = []
    for kind, severity, pattern in privacy.GATE:
        flags, rest = re.match(r"(\(\?i\))?(.*)$", pattern, re.S).groups()
        before, rest = re.match(r"(?:\(\?<!\[(.*?)\]\))?(.*)$", rest, re.S).groups()
        rest, after = re.match(r"(.*?)(?:\(\?=(.*)\))?$", rest, re.S).groups()
        p = (flags or "") + (f"(?:^|[^{before}])" if before else "") + f"({rest})" + (f"(?:{after})" if after else "")
        parts.append(f"SELECT doc_id, line, '{kind}' AS kind, '{severity}' AS severity, unnest(regexp_extract_all(t, '{spelled_signs(p)}', 1)) AS value FROM l")
    return f"""WITH x AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS ls FROM documents),
l AS (SELECT * FROM (SELECT doc_id, unnest(range(1, len(ls) + 1))::INTEGER AS line, unnest(ls) AS t FROM x) WHERE NOT regexp_matches(t, '{privacy.ALLOW_MARKER}')),
f AS ({" UNION ALL ".join(parts)})
SELECT * FROM f WHERE kind <> 'email' OR NOT ends_with(lower(value), '@example.com')"""


@query(scrub_sql())
def public_scrub(s, d):
    return v.table(s, d, "documents").select("doc_id", privacy.scrub(F.col("text")).alias("text"))


@query(gate_sql())
def release_gate(s, d):
    return privacy.gate(v.table(s, d, "documents"), "doc_id", "text", ("@example.com",))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND trim(text) <> '' AND NOT (ltrim(text) LIKE '<environment_context>%')")
def human_prompts(s, d):
    rows = v.table(s, d, "conversations").where((F.col("role") == "user") & (F.trim("text") != "") & ~t.is_injected(F.col("text")))
    return rows.select("conv_id", "turn", "text")


# -- Queues and increments -------------------------------------------------------------------------------------------

QUEUE = f"""{LEDGER}, {TASKS}, un AS (SELECT session_id, event_date AS day, CASE WHEN max(CASE WHEN provider_norm = 'anthropic' THEN 1
  ELSE 0 END) = 1 THEN 'claude' ELSE 'codex' END AS provider FROM elig GROUP BY 1, 2),
td AS (SELECT *, CASE d % 4 WHEN 0 THEN day::TIMESTAMP + INTERVAL 8 HOURS WHEN 1 THEN day::TIMESTAMP + INTERVAL 30 HOURS END AS read_at,
  NOT (c_custkey % 3 = 0) AND (c_custkey % 2 = 0 OR coalesce(CASE d % 4 WHEN 0 THEN day::TIMESTAMP + INTERVAL 8 HOURS
  WHEN 1 THEN day::TIMESTAMP + INTERVAL 30 HOURS END < TIMESTAMP '2024-01-15', FALSE)) AS old FROM tday)"""


@query(f"""WITH {QUEUE} SELECT * FROM (SELECT un.session_id, un.day, un.provider, CASE WHEN baseline IS NULL THEN 'missing' WHEN old
  AND un.provider = 'codex' THEN 'codex_blind' WHEN coalesce(CAST(read_at AS DATE) <= un.day, FALSE) THEN 'partial_day' END AS category,
  round(baseline, 6) AS hours
FROM un LEFT JOIN td ON td.session_id = un.session_id AND td.day = un.day WHERE un.day < DATE '2024-01-30') WHERE category IS NOT NULL""")
def closed_day_queue(s, d):
    return queue.closed_days(productivity.eligible(window(s, d)), v.tasks(s, d), TODAY, version=2, fixed_at="2024-01-15 00:00:00", mode="rechunk")


@query(f"""WITH {QUEUE} SELECT un.session_id, un.provider, round(baseline, 6) AS hours FROM un LEFT JOIN td ON td.session_id = un.session_id AND td.day = un.day
WHERE un.day = DATE '2024-01-30' AND (baseline IS NULL OR read_at < TIMESTAMP '2024-01-30 21:59:59')""")
def open_day_queue(s, d):
    return queue.open_day(productivity.eligible(window(s, d)), v.tasks(s, d), TODAY, NOW, 2)


@query(f"WITH {LEDGER}, {TASKS} SELECT DISTINCT session_id FROM led WHERE session_id NOT IN (SELECT session_id FROM tsess WHERE baseline IS NOT NULL)")
def pending_sessions(s, d):
    return queue.pending(window(s, d), v.tasks(s, d))


@query("""WITH m AS (SELECT user_id, max(event_id) AS w FROM events WHERE event_id % 5 = 0 GROUP BY 1) SELECT e.user_id AS stream, e.event_id AS ord
  FROM events e LEFT JOIN m ON m.user_id = e.user_id WHERE m.w IS NULL OR e.event_id > m.w""")
def watermark_tail(s, d):
    events = v.table(s, d, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("ord"), F.col("event_id").alias("id"))
    marks = events.where("ord % 5 = 0").groupBy("stream").agg(F.max("id").alias("mark"))
    return queue.after_watermark(events, marks).select("stream", "ord")


@query(f"""WITH {LEDGER}, {TASKS}, c AS (SELECT session_id, count(*) AS n FROM led GROUP BY 1) SELECT session_id, CASE WHEN n <= 3 THEN 'stub'
  WHEN n <= 50 THEN 'small' WHEN n <= 500 THEN 'medium' WHEN n <= 1500 THEN 'large' ELSE 'marathon' END AS bucket, n AS events FROM c
QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY session_id) <= 5""")
def eval_samples(s, d):
    return queue.stratified(window(s, d).groupBy("session_id").agg(F.count("*").alias("events")), 5)


@query(f"""WITH {LEDGER}, {TASKS}, c AS (SELECT session_id, count(*) AS n FROM elig GROUP BY 1) SELECT session_id, round(n / greatest(baseline, 0.1),
  6) AS saturation FROM c JOIN tsess USING (session_id) WHERE baseline IS NOT NULL ORDER BY n / greatest(baseline, 0.1) DESC, session_id LIMIT 10""")
def saturated_sessions(s, d):
    return queue.saturated(productivity.eligible(window(s, d)), v.tasks(s, d), 10)


@query(f"""WITH {LEDGER} SELECT event_date, CAST(ord AS BIGINT) AS ord, CAST(row_number() OVER (PARTITION BY event_date ORDER BY ts, ord) AS INT) AS nth
  FROM led QUALIFY nth <= 3""")
def first_events_of_day(s, d):
    w = Window.partitionBy("event_date").orderBy("ts", "ord")
    return window(s, d).withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("event_date", "ord", "nth")


@query(f"""WITH {LEDGER} SELECT session_id, max(ts) AS last_ts FROM led WHERE ts BETWEEN TIMESTAMP '2024-01-29 23:59:59'
  AND TIMESTAMP '2024-01-30 23:59:59' GROUP BY 1""")
def recent_sessions(s, d):
    return runs.recent_sessions(window(s, d), NOW)


@query(f"""WITH {LEDGER}, {TASKS}, u AS (SELECT DISTINCT session_id, event_date AS day FROM elig),
x AS (SELECT u.session_id, count(*) AS days, CAST(sum(CASE WHEN t.session_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM u LEFT
  JOIN tday t ON t.session_id = u.session_id AND t.day = u.day GROUP BY 1)
SELECT x.session_id, days, missing, round(baseline, 6) AS baseline FROM x JOIN tsess ON tsess.session_id = x.session_id
  WHERE baseline IS NOT NULL AND missing > 0 AND days > 1""")
def rechunk_plan(s, d):
    units = productivity.eligible(window(s, d)).select("session_id", F.col("event_date").alias("day"))
    return runs.rechunk_plan(units, v.tasks(s, d))


@query(f"""WITH {LEDGER} SELECT provider_norm AS provider, CAST(ord AS BIGINT) AS ord, round(cost, 6) AS cost FROM (SELECT *,
  row_number() OVER (PARTITION BY provider_norm ORDER BY cost, ord) AS r, count(*) OVER (PARTITION BY provider_norm) AS n FROM led
  WHERE cost IS NOT NULL) WHERE r = (n - 1) // 2 + 1""")
def lower_median_call(s, d):
    rows = window(s, d).where("cost_estimate_usd is not null").select(F.col("provider_norm").alias("provider"), "ord", F.col("cost_estimate_usd").alias("cost"))
    return runs.lower_median(rows, ["provider"], "cost", ("ord",))


@query(f"""WITH {REPUTATION}, a AS (SELECT agent, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(successes) AS BIGINT) AS successes, count(*) AS roles,
  max(last_at) AS last_at FROM rw GROUP BY 1),
f AS (SELECT agent, status, count(*) AS c FROM st WHERE NOT ok GROUP BY 1, 2), t AS (SELECT agent, string_agg(status || ':' || c, ','
  ORDER BY c DESC, status) AS failures FROM f GROUP BY 1)
SELECT agent, runs, successes, roles, last_at, round(successes / runs, 6) AS success_rate, failures FROM a LEFT JOIN t USING (agent)""")
def agent_cards(s, d):
    return reputation.cards(reputations(s, d), v.steps(s, d))


@query(f"""WITH {LEDGER}, w AS (SELECT unnest([1, 7, 30]) AS days) SELECT CAST(days AS INT) AS days, CAST(sum(1 - is_correction) AS BIGINT) AS calls,
  round(coalesce(sum(cost), 0), 6) AS cost, count(DISTINCT session_id) AS sessions
FROM w JOIN led ON event_date > DATE '2024-01-30' - CAST(days AS INT) AND event_date <= DATE '2024-01-30' GROUP BY 1""")
def period_totals(s, d):
    return rollup.periods(v.ledger(s, d), TODAY, (1, 7, 30))


from . import session_queries, state_queries, text_queries  # noqa: E402,F401 register their queries here
