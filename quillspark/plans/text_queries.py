"""Queries over texts: envelopes of tasks, contexts within a budget, and findings with what stands around them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n
from ..functions import privacy, terms
from ..functions import text as t
from ..operators import attribution, bus, dedup, productivity, report, repricing, rollup
from ..sources import ledger, transcripts
from . import views as v
from .queries import query, window
from .views import END, LEDGER, NOW, START, STATS, TASKS

ORDERS = """c AS (SELECT *, floor(o_totalprice)::BIGINT - 200000 AS lease, CASE o_orderpriority WHEN '5-LOW' THEN 2 ELSE 1 END AS ver FROM orders),
k AS (SELECT *, '{"created_at":"' || strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z","idempotency_key":"é' || o_orderstatus || '","kind":"' || o_orderpriority
  || '","lease_seconds":' || lease || ',"payload_ref":"p","payload_sha256":"' || sha256(CAST(o_orderkey AS VARCHAR)) || '","schema_version":' || ver
  || ',"target_host":"h' || o_custkey || '","task_id":"t' || o_orderkey || '"}' AS canon FROM c)"""


@query(f"""WITH {ORDERS} SELECT o_orderkey, o_orderstatus <> 'P' AS verified,
CASE WHEN o_orderstatus <> 'P' AND lease > 0 AND ver = 1 THEN canon END AS task FROM k""")
def task_envelopes(s, d):
    """Orders as tasks: keys in another order, spaces and escapes in the JSON, and wrong digests for those of one status."""
    rows = v.table(s, d, "orders").selectExpr(
        "*", "CAST(floor(o_totalprice) AS BIGINT) - 200000 AS lease", "IF(o_orderpriority = '5-LOW', 2, 1) AS ver",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "sha2(CAST(o_orderkey AS STRING), 256) AS payload",
    )
    canon = F.format_string(
        '{"created_at":"%sT00:00:00Z","idempotency_key":"é%s","kind":"%s","lease_seconds":%s,"payload_ref":"p","payload_sha256":"%s","schema_version":%s,"target_host":"h%s","task_id":"t%s"}',
        "day", "o_orderstatus", "o_orderpriority", "lease", "payload", "ver", "o_custkey", "o_orderkey",
    )
    body = F.format_string(
        '{ "task_id" : "t%s",\n  "schema_version": %s, "kind": "%s",\t"target_host": "h%s", "payload_ref": "p",\n "payload_sha256":"%s", "lease_seconds":  %s, "idempotency_key": "\\u00e9%s", "created_at": "%sT00:00:00Z" }',
        "o_orderkey", "ver", "o_orderpriority", "o_custkey", "payload", "lease", "o_orderstatus", "day",
    )
    digest = F.sha2(F.when(F.col("o_orderstatus") == "P", F.reverse(canon)).otherwise(canon), 256)
    text = F.concat(F.lit("Please:\n<!-- x-task:v1 sha256="), F.upper(digest), F.lit(" -->\n"), body, F.lit("\n<!-- /x-task:v1 -->\nThanks"))
    return bus.envelopes(rows.select("o_orderkey", text.alias("body"))).drop("body")


def context_sql(limits: tuple[int, int], most: int) -> str:
    cut = lambda n: f"CASE WHEN length(text) <= {n} THEN text ELSE regexp_replace(substr(text, 1, {n}), '\\s+$', '') || chr(10) || '...[truncated]' END"
    part = lambda role, title, n: f"'### {title}' || E'\\n\\n' || string_agg('[{role} ' || n || ']' || chr(10) || {cut(n)}, E'\\n\\n' ORDER BY n) FILTER (role = '{role}')"
    whole = lambda n: f"concat_ws(E'\\n\\n', {part('user', 'First user messages', n)}, {part('assistant', 'Last assistant messages', n)})"
    head, mark = most // 3, "\n...[middle truncated]...\n"
    return f"""WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS up,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS down FROM conversations WHERE role IN ('user', 'assistant')),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM m
  WHERE (role = 'user' AND up <= 3) OR (role = 'assistant' AND down <= 5)),
c AS (SELECT conv_id, {whole(limits[0])} AS a, {whole(limits[1])} AS b FROM f GROUP BY conv_id),
w AS (SELECT conv_id, CASE WHEN length(a) > {most} THEN b ELSE a END AS t FROM c)
SELECT conv_id, CASE WHEN length(t) <= {most} THEN t ELSE regexp_replace(substr(t, 1, {head}), '\\s+$', '') || chr(10) || '...[middle truncated]...' || chr(10)
  || regexp_replace(right(t, {most - head - len(mark)}), '^\\s+', '') END AS context FROM w"""


def conversations(s, d) -> DataFrame:
    return v.table(s, d, "conversations").selectExpr("conv_id", "0L AS block", "turn AS id", "role", "text")


@query(context_sql(transcripts.MESSAGE_LIMITS, transcripts.CONTEXT_LIMIT))
def transcript_context(s, d):
    return transcripts.context(conversations(s, d), ("conv_id",))


@query(context_sql((700, 250), 1500))
def transcript_context_tight(s, d):
    """The same where all limits bind."""
    return transcripts.context(conversations(s, d), ("conv_id",), limits=(700, 250), most=1500)


SIGN = r"[\p{L}\p{N}_]"


@query(rf"""WITH tm AS (SELECT term, row_number() OVER (ORDER BY term) AS k FROM (SELECT DISTINCT lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS term FROM benchmark)),
o AS (SELECT doc_id, text, term, k, string_split(lower(text), term) AS parts FROM documents JOIN tm ON contains(lower(text), term)),
x AS (SELECT *, unnest(range(1, len(parts))) AS j FROM o),
y AS (SELECT *, CAST(list_sum(list_transform(parts[1:j], lambda p: length(p))) AS BIGINT) + (j - 1) * length(term) AS pos FROM x)
SELECT doc_id, 'private_term_' || k AS kind, substr(text, pos + 1, length(term)) AS value,
  replace(substr(text, greatest(pos - 80, 0) + 1, least(pos, 80) + length(term) + 120), chr(10), '\n') AS context FROM y
WHERE NOT (pos > 0 AND regexp_matches(substr(text, pos, 1), '{SIGN}')) AND NOT regexp_matches(substr(text, pos + length(term) + 1, 1), '{SIGN}')""")
def term_findings(s, d):
    """Where the documents have the first two words of a benchmark's item, in any case."""
    first = v.table(s, d, "benchmark").select(F.lower(F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2))).alias("t")).distinct().orderBy("t")
    names = [r[0] for r in first.collect()]  # a list of terms, as a deployment keeps one
    return terms.find_terms(v.table(s, d, "documents"), "doc_id", "text", list(enumerate(names, 1)))


def contexts_sql() -> str:
    signs = r"\p{L}\p{N}_"
    parts = []
    for kind, pattern in privacy.SCAN.items():
        p = pattern.replace("'", "''").replace(r"[\w", f"[{signs}").replace(r"\w", f"[{signs}]")
        parts.append(f"SELECT doc_id, text, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS v, regexp_split_to_array(text, '{p}') AS s FROM documents")
    return f"""WITH o AS ({' UNION ALL '.join(parts)}), x AS (SELECT *, unnest(range(1, len(v) + 1)) AS j FROM o),
y AS (SELECT *, CAST(list_sum(list_transform(s[1:j], lambda p: length(p))) + coalesce(list_sum(list_transform(v[1:j - 1], lambda p: length(p))), 0) AS BIGINT) AS pos FROM x)
SELECT doc_id, kind, v[j] AS value, replace(substr(text, greatest(pos - 80, 0) + 1, least(pos, 80) + length(v[j]) + 120), chr(10), '\\n') AS context FROM y"""


@query(contexts_sql())
def privacy_contexts(s, d):
    return terms.find_patterns(v.table(s, d, "documents"), "doc_id", "text")


def dialect_lines(s, d) -> DataFrame:
    """Conversations as transcripts: those whose system speaks first as rollouts, the others in the other dialect. A question
    as long as 350 signs comes from a compaction; an answer's lines are its calls of tools, as blocks or as records of their own."""
    c = v.table(s, d, "conversations").withColumn("rollout", F.expr("max(role = 'system') OVER (PARTITION BY conv_id)"))
    c = c.withColumn("uses", F.expr("IF(role = 'assistant', size(split(text, '\n')) - 1, 0)")).withColumn("at", F.expr("concat('2026-05-1', turn div 3, 'T10:00:0', turn, 'Z')"))
    blocks = "concat(array(named_struct('type', 'text', 'text', text)), transform(IF(uses > 0, sequence(1, uses), array()), x -> named_struct('type', 'tool_use', 'text', CAST(NULL AS STRING))))"
    plain = f"to_json(named_struct('type', role, 'timestamp', at, 'isCompactSummary', role = 'user' AND length(text) >= 350, 'message', named_struct('role', role, 'content', {blocks})))"
    said = """to_json(named_struct('type', 'response_item', 'timestamp', at, 'payload', named_struct('type', 'message', 'role', IF(role = 'system', 'developer', role),
      'content', array(named_struct('type', IF(role = 'user', 'input_text', 'output_text'), 'text', text)))))"""
    record = "to_json(named_struct('type', 'response_item', 'timestamp', at, 'payload', named_struct('type', 'custom_tool_call')))"
    lines = c.selectExpr(
        "concat('c', conv_id) AS file", "0L AS block", "turn AS id",
        f"IF(rollout, concat(array({said}), array_repeat({record}, CAST(uses AS INT))), array({plain})) AS all",
    )
    each = lines.selectExpr("file", "block", "id AS turn", "posexplode(all) AS (k, value)")
    return ledger.parsed(each.selectExpr("file", "block", "turn * 1000 + k AS id", "value"))


DIALECTS = """cv AS (SELECT *, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS rollout, DATE '2026-05-10' + CAST(turn // 3 AS INT) AS day,
  len(string_split(text, chr(10))) - 1 AS breaks FROM conversations)"""


@query(f"""WITH {DIALECTS} SELECT 'c' || conv_id AS file, day, count(*) FILTER (role = 'user' AND (rollout OR length(text) < 350)) AS user_messages,
  count(*) FILTER (role = 'assistant') AS assistant_messages, CAST(sum(CASE WHEN role = 'assistant' THEN breaks ELSE 0 END) AS BIGINT) AS tool_calls
FROM cv GROUP BY 1, 2""")
def conversation_sizes(s, d):
    return transcripts.sizes(dialect_lines(s, d), ("file", "day")).drop("start", "end")


@query(f"""WITH {DIALECTS}, u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, day ORDER BY turn) AS n FROM cv WHERE role = 'user')
SELECT DISTINCT 'c' || conv_id AS file, day FROM u WHERE n <= 3 AND NOT rollout AND length(text) >= 350""")
def compaction_days(s, d):
    return transcripts.compaction_days(dialect_lines(s, d))


@query(f"""WITH {LEDGER}, ev AS (SELECT *, 'c' || ord AS id FROM led2), done AS (SELECT 'c' || (ord - 5) AS id FROM led2 WHERE is_correction = 1),
c AS (SELECT id, least(greatest(k % 4, 0), ccreate) * CASE WHEN model LIKE 'claude-opus-%' THEN 3.75 WHEN model LIKE 'claude-sonnet-%' THEN 2.25 END / 1000000 AS delta
  FROM ev WHERE is_correction = 0 AND id NOT IN (SELECT id FROM done))
SELECT id AS event_id, round(delta * 1000000, 6) AS delta_micro FROM c WHERE delta > 0""")
def cache_corrections(s, d):
    """What calls of the long cache cost more; what their transcripts say of the cache comes twice, and the last one counts."""
    events = v.ledger(s, d).withColumn("k", F.col("output_tokens") / 10).select(
        F.concat(F.lit("c"), "ord").alias("event_id"), F.concat(F.lit("m"), "ord").alias("message_uuid"), "model", "is_correction", "input_tokens", "output_tokens",
        "cache_creation_tokens", "cache_read_tokens", F.when(F.col("is_correction") == 1, F.concat(F.lit("c"), F.col("ord") - 5)).alias("correction_of"), "ord", "k",
    )
    hour = events.select("message_uuid", (F.col("k") % 4).cast("long").alias("cache_creation_1h_tokens"), F.col("ord").alias("ord"))
    first = hour.withColumn("cache_creation_1h_tokens", F.lit(9).cast("long")).withColumn("ord", F.col("ord") - 1_000_000)
    rows = repricing.cache_corrections(events.drop("ord", "k"), first.unionByName(hour))
    return rows.select("event_id", (F.col("delta") * 1_000_000).alias("delta_micro"))


@query("""SELECT o_orderkey, CAST(o_custkey % 50 + 1 AS INT) AS files, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS INT) END AS insertions,
CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(length(o_orderpriority) AS INT) END AS deletions FROM orders""")
def commit_stats(s, d):
    line = """concat(' ', o_custkey % 50 + 1, IF(o_custkey % 50 = 0, ' file', ' files'), ' changed', IF(o_orderstatus = 'F', '', concat(', ', CAST(floor(o_totalprice / 1000) AS INT), ' insertions(+)')),
      IF(o_orderstatus = 'O', '', concat(', ', length(o_orderpriority), ' deletions(-)')))"""
    rows = v.table(s, d, "orders").selectExpr("o_orderkey", f"{line} AS line")
    return rows.select("o_orderkey", attribution.shortstat(F.col("line")).alias("x")).select("o_orderkey", "x.*")


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 299) || '…' END AS shown FROM documents""")
def terminal_texts(s, d):
    """Texts that came coloured from a terminal, without the colours and cut to a length."""
    coloured = F.concat(F.lit("\u001b[1;32m"), F.regexp_replace("text", " ", " \u001b[0m"), F.lit("\u001b[K"))
    return v.table(s, d, "documents").select("doc_id", t.clip_end(t.strip_ansi(F.when(F.col("text").isNotNull(), coloured)), 300).alias("shown"))


RECENT = """rec AS (SELECT * FROM led2 WHERE ts BETWEEN TIMESTAMP '2024-01-29 23:59:59' AND TIMESTAMP '2024-01-30 23:59:59' AND model <> '<synthetic>'
  QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) = 1)"""


@query(f"""WITH {LEDGER}, {TASKS}, {RECENT}, s AS (SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(sum(1 - is_correction) AS BIGINT) AS calls,
  coalesce(sum(cost), 0) AS cost FROM rec GROUP BY 1),
m AS (SELECT session_id, model_name FROM (SELECT session_id, model_name, count(*) AS c FROM rec GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY c DESC, model_name) = 1)
SELECT s.session_id, first_ts, last_ts, calls, round(cost, 6) AS cost, model_name AS model, coalesce(c_name, '') AS brief_description, round(baseline, 6) AS baseline_hours
FROM s JOIN m USING (session_id) LEFT JOIN tsess USING (session_id) ORDER BY last_ts DESC, session_id LIMIT 50""")
def today_sessions(s, d):
    rows = productivity.today_sessions(v.ledger(s, d), v.tasks(s, d), NOW)
    return rows.withColumn("brief_description", F.coalesce("brief_description", F.lit("")))


@query(f"""WITH {LEDGER}, {RECENT}, k AS (SELECT DISTINCT session_id FROM rec),
m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(sum(CASE WHEN role = 'user' AND turn <= 4 THEN len(regexp_extract_all(lower(text), ' the ')) ELSE 0 END) AS BIGINT) AS m
  FROM conversations GROUP BY 1)
SELECT k.session_id, coalesce(m.m, c_custkey % 4, 0) AS markers FROM k LEFT JOIN m USING (session_id) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = k.session_id""")
def today_markers(s, d):
    messages = v.table(s, d, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS session_id", f"TIMESTAMP_NTZ'{NOW}' - make_dt_interval(0, CAST(6 * turn AS INT)) AS ts", "role", "text",
    )
    return productivity.today_markers(v.ledger(s, d), v.tasks(s, d), messages, NOW, (" the ",))


@query(f"WITH {LEDGER} SELECT provider_norm AS provider, model_name AS model, CAST(sum(1 - is_correction) AS BIGINT) AS calls FROM led GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2")
def models_by_calls(s, d):
    return rollup.models_by_calls(window(s, d))


@query(f"WITH {LEDGER}, {RECENT} SELECT session_id, min(ord) AS first FROM rec GROUP BY 1 ORDER BY 2")
def today_session_ids(s, d):
    return rollup.session_ids(productivity.recent(v.ledger(s, d), NOW))


def joined(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns) + ")"


@query(f"""WITH {LEDGER}, v AS (SELECT ord, provider_norm, cost, CASE provider_norm
  WHEN 'openai' THEN {joined("session_id", "model", "input_tokens", "cached", "output_tokens", "reasoning", "written_total")}
  WHEN 'openrouter' THEN {joined("session_id", "model", "input_tokens", "cread", "ccreate", "output_tokens", "written_total")}
  ELSE {joined("session_id", "model", "input_tokens", "cread", "ccreate", "output_tokens", "reasoning", "written_total")} END AS k FROM led2 WHERE provider_norm <> 'anthropic'),
f AS (SELECT *, row_number() OVER (PARTITION BY provider_norm, k ORDER BY ord) > 1 AS dropped FROM v)
SELECT provider_norm AS provider, dropped, count(*) AS events, round(coalesce(sum(cost), 0), 6) AS cost FROM f GROUP BY 1, 2""")
def vendor_duplicates(s, d):
    """Repeated calls by what each vendor's importer takes for the same."""
    none = F.lit(None).cast("string")
    rows = v.ledger(s, d).withColumns({"response_id": none, "message_id": none, "provider": none})
    parts = [rows.where(F.col("provider_norm") == p).withColumn("k", dedup.semantic_key(vendor)) for p, vendor in (("openai", "codex"), ("openrouter", "openclaw"), ("opencode", "opencode"))]
    all_ = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return dedup.semantic_dedup(all_, ["provider_norm", "k"]).groupBy(F.col("provider_norm").alias("provider"), "dropped").agg(
        F.count("*").alias("events"), F.coalesce(F.sum("cost_estimate_usd"), F.lit(0.0)).alias("cost"),
    )


@query(f"""WITH {LEDGER}, m AS (SELECT DISTINCT 'anthropic/' || model AS model FROM led UNION SELECT DISTINCT model FROM led)
SELECT model, CASE model WHEN 'claude-sonnet-4-20250514' THEN 'sonnet 4.20250514' WHEN 'claude-opus-4-1' THEN 'opus 4.1'
  ELSE CASE WHEN starts_with(model, 'anthropic/') THEN substr(model, 11) ELSE model END END AS label FROM m""")
def model_labels(s, d):
    names = window(s, d).select("model").distinct()
    both = names.select(F.concat(F.lit("anthropic/"), "model").alias("model")).unionByName(names).distinct()
    return both.select("model", n.model_label(F.col("model")).alias("label"))


@query("""SELECT 'f' || conv_id AS file, 's' || conv_id AS session_id, CASE WHEN any_value(rollout) THEN 'codex-tui' END AS originator, min_by(role, turn) AS source,
  '/w/' || min(turn) AS working_dir FROM (SELECT *, bool_or(role = 'system') OVER (PARTITION BY conv_id) AS rollout FROM conversations) GROUP BY conv_id""")
def rollout_heads(s, d):
    """Conversations whose every turn is a head; the first one counts."""
    c = v.table(s, d, "conversations").withColumn("rollout", F.expr("max(role = 'system') OVER (PARTITION BY conv_id)"))
    line = "named_struct('id', concat('s', conv_id), 'originator', IF(rollout, 'codex-tui', NULL), 'source', role, 'cwd', concat('/w/', turn))"
    lines = c.selectExpr("concat('f', conv_id) AS file", "0L AS block", "turn AS id", f"to_json(named_struct('type', 'session_meta', 'payload', {line})) AS value")
    return transcripts.rollout_meta(ledger.parsed(lines))


ROW_LINE = """'| ' || label || ' | ' || format('{:,}', calls) || ' | ' || format('{:,}', input_tokens) || ' | ' || format('{:,}', output_tokens) || ' | '
  || CAST(CASE WHEN cache_read_tokens + input_tokens > 0 THEN round_even(cache_read_tokens * 100.0 / (cache_read_tokens + input_tokens), 0) ELSE 0 END AS BIGINT)
  || '% | ' || printf('%.2f', cost_estimate_usd) || ' |'"""


@query(f"""WITH {LEDGER}, m AS (SELECT provider_norm, model_name, CASE WHEN starts_with(lower(model_name), provider_norm || '/') THEN model_name
  ELSE provider_norm || '/' || model_name END AS name, {STATS} FROM led GROUP BY GROUPING SETS ((provider_norm, model_name), ())),
d AS (SELECT event_date, {STATS} FROM led GROUP BY 1),
c AS (SELECT cost_estimate_usd AS cost, (SELECT sum(CASE WHEN p IN ('anthropic', 'openai') THEN 200.0 ELSE 0 END) FROM (SELECT DISTINCT provider_norm AS p FROM led)) AS paid
  FROM m WHERE provider_norm IS NULL)
SELECT 0 AS part, '0' AS key, '{report.TITLE.format(f"{START}..{END} (30 days)")}' AS line UNION ALL SELECT 0, '1', ''
UNION ALL SELECT 1, '0', '{report.HEADS[0].format("Model")}' UNION ALL SELECT 1, '1', '{report.HEADS[1]}'
UNION ALL SELECT CASE WHEN provider_norm IS NULL THEN 3 ELSE 2 END, coalesce(name, ''), {ROW_LINE} FROM (SELECT *, coalesce(name, '**Total**') AS label FROM m)
UNION ALL SELECT 4, '0', '' UNION ALL SELECT 4, '1', 'Unknown pricing note: ' || sum(unknown_pricing_events) || ' events have unknown pricing and are counted as $0 in totals ('
  || string_agg(name || ': ' || unknown_pricing_events, ', ' ORDER BY name || ': ' || unknown_pricing_events) || ').' FROM m WHERE provider_norm IS NOT NULL AND unknown_pricing_events > 0
UNION ALL SELECT 5, '0', '' UNION ALL SELECT 5, '1', '**Period API cost**: $' || printf('%.2f', cost) FROM c UNION ALL SELECT 5, '2', '**Subscriptions prorated**: $' || printf('%.2f', paid) FROM c
UNION ALL SELECT 5, '3', CASE WHEN cost >= paid THEN '**Savings vs API rates**: $' || printf('%.2f', cost - paid) || ' ✅' ELSE '**Subscription not fully used**: $' || printf('%.2f', paid - cost) END FROM c
UNION ALL SELECT 5, '4', 'If paid by API rates would owe $' || printf('%.2f', cost) || '; subscription costs $' || printf('%.2f', paid) || ' for this period; '
  || CASE WHEN cost >= paid THEN 'saved $' ELSE 'unused subscription value $' END || printf('%.2f', abs(cost - paid)) || '.' FROM c
UNION ALL SELECT 6, '0', '' UNION ALL SELECT 6, '1', '### Daily aggregates' UNION ALL SELECT 6, '2', '' UNION ALL SELECT 6, '3', '{report.HEADS[0].format("Date")}' UNION ALL SELECT 6, '4', '{report.HEADS[1]}'
UNION ALL SELECT 7, CAST(event_date AS VARCHAR), {ROW_LINE} FROM (SELECT *, CAST(event_date AS VARCHAR) AS label FROM d)""")
def summary_report(s, d):
    return report.summary(window(s, d), START, END)
