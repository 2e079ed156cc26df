"""Queries over session files: JSON lines and paths that are made of the test tables, read as the sources read files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import review, rollup
from ..operators.dedup import dedup_events
from ..sources import ledger, sessions, transcripts
from . import views as v
from .queries import COSTS, marker_sql, query
from .views import LEDGER, STATS, TODAY


def session_lines(s, d) -> DataFrame:
    """Each conversation as a file: a session line, changes of model by users, contexts, and calls."""
    c = v.table(s, d, "conversations")
    user, made = "role = 'user'", "((conv_id * 7 + turn) % 11)"
    parts = {
        "turn = 0": "named_struct('type', 'session', 'id', concat('c', conv_id), 'cwd', concat('/w/', conv_id % 3))",
        user: "named_struct('type', 'model_change', 'provider', element_at(array('OpenClaw', 'mistral', ' '), CAST(conv_id % 3 AS INT) + 1), 'modelId', concat('m', turn % 3))",
        "turn % 3 = 1": "named_struct('type', 'custom_message', 'customType', 'openclaw.runtime-context', 'content', IF(conv_id % 2 = 0, 'at telegram:1', 'x'))",
        "role = 'assistant'": f"""named_struct('type', 'message', 'id', concat('t', turn), 'timestamp', concat('2026-05-10T10:0', turn, ':00Z'), 'message',
          named_struct('role', 'assistant', 'model', IF(turn % 4 = 3, concat('x', conv_id), NULL), 'stopReason', IF(turn % 3 = 0, 'aborted', 'stop'),
          'usage', named_struct('input', {made}, 'output', turn * {made} % 5, 'totalTokens', IF(turn % 3 = 2, 50, 0), 'cost',
  named_struct('total', conv_id % 2 * 0.25))))""",
    }
    rows = None
    for k, (where, line) in enumerate(parts.items()):
        some = c.where(where).selectExpr(f"to_json({line}) AS value", "concat('f', conv_id, '.jsonl') AS file", "0L AS block", f"turn * 4 + {k} AS id")
        rows = some if rows is None else rows.unionByName(some)
    return ledger.parsed(rows)


@query("""WITH a AS (SELECT conv_id, turn, role, (conv_id * 7 + turn) % 11 AS i, CASE WHEN role = 'user' THEN ['openrouter', 'mistral',
  NULL][conv_id % 3 + 1] END AS p,
  CASE WHEN role = 'user' THEN 'm' || (turn % 3) WHEN turn % 4 = 3 THEN 'x' || conv_id END AS m, CASE WHEN turn % 3 = 1 THEN CASE
  WHEN conv_id % 2 = 0 THEN 'telegram' ELSE 'workspace' END END AS ch FROM conversations),
b AS (SELECT *, coalesce(last_value(p IGNORE NULLS) OVER w, 'openrouter') AS pp, coalesce(last_value(m IGNORE NULLS) OVER w,
  'unknown') AS mm, coalesce(last_value(ch IGNORE NULLS) OVER w, 'workspace') AS cc,
  turn * i % 5 AS o FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
e AS (SELECT *, CASE WHEN turn % 3 = 2 THEN 50 ELSE i + o END AS total FROM b WHERE role = 'assistant')
SELECT 'openclaw-session-c' || conv_id || '-t' || turn AS event_id, 'c' || conv_id AS session_id, '/w/' || (conv_id % 3) AS working_dir,
  TIMESTAMP '2026-05-10 10:00:00' + to_minutes(CAST(turn AS INT)) AS ts,
  pp AS provider, mm AS model, cc AS channel, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens,
  CAST(total AS BIGINT) AS total_tokens, CAST(conv_id % 2 * 0.25 AS DOUBLE) AS cost_estimate_usd, turn % 3 = 0 AS partial
FROM e WHERE total > 0 OR conv_id % 2 = 1""")
def switched_calls(s, d):
    rows = sessions.switched_calls(session_lines(s, d))
    return rows.select(
        "event_id", "session_id", "working_dir", "ts", "provider", "model", "channel", "input_tokens", "output_tokens",
        "total_tokens", "cost_estimate_usd", "partial",
    )


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn > 0 AND conv_id % 5 > 0 THEN 'th' || (conv_id + turn) END AS th, CASE WHEN turn % 2 = 1
  AND conv_id % 7 > 0 THEN turn * 10 + conv_id % 9 END AS i FROM conversations),
r AS (SELECT conv_id, count(*) AS n, arg_min(th, turn) FILTER (th IS NOT NULL) AS th, arg_max(i, turn) FILTER (i IS NOT NULL) AS i FROM l GROUP BY 1)
SELECT 'run' || conv_id AS file, coalesce(th, 'codex-missing-thread-run' || conv_id) AS session_id, CASE WHEN conv_id % 4 = 0 THEN 'asked'
  ELSE 'unknown' END AS model, CAST(coalesce(i, 0) AS BIGINT) AS input_tokens,
  CAST(CASE WHEN i IS NULL THEN 0 ELSE 3 END AS BIGINT) AS output_tokens, CAST(coalesce(i + 3, 0) AS BIGINT) AS total_tokens,
  i IS NOT NULL AS usage_captured, conv_id % 3 = 1 OR i IS NULL AS partial, n AS json_events FROM r""")
def captured_runs(s, d):
    c = v.table(s, d, "conversations")
    line = """to_json(named_struct('thread_id', IF(turn > 0 AND conv_id % 5 > 0, concat('th', conv_id + turn), NULL),
      'usage', IF(turn % 2 = 1 AND conv_id % 7 > 0, named_struct('prompt_tokens', turn * 10 + conv_id % 9, 'output_tokens', '3'), NULL)))"""
    lines = ledger.parsed(c.selectExpr(f"{line} AS value", "concat('run', conv_id) AS file", "0L AS block", "turn AS id"))
    runs = c.selectExpr(
        "concat('run', conv_id) AS file", "CAST(conv_id % 3 = 1 AS INT) AS exit_code", "false AS interrupted",
        "IF(conv_id % 4 = 0, 'asked', NULL) AS model",
    ).distinct()
    found = sessions.captured_runs(lines, runs)
    return found.select("file", "session_id", "model", "input_tokens", "output_tokens", "total_tokens", "usage_captured", "partial", "json_events")


@query("""SELECT CAST(event_id AS BIGINT) AS id, CASE WHEN event_id % 4 < 3 THEN 's' || user_id END AS session_id, CASE event_id % 4 WHEN 3 THEN NULL
  ELSE 'C:/work/p' || (user_id % 3) END AS working_dir,
CASE event_id % 4 WHEN 1 THEN 'agent-' || event_id WHEN 2 THEN 'workflows/wf/agent-' || event_id END AS agent_id FROM events""")
def stream_identities(s, d):
    place = "concat('/h/projects/C--work-p', user_id % 3, '/s', user_id)"
    path = f"CASE event_id % 4 WHEN 0 THEN concat({place}, '.jsonl') WHEN 1 THEN concat({place}, '/subagents/agent-', event_id, '.jsonl') WHEN 2 THEN concat({place}, '/subagents/workflows/wf/agent-', event_id, '.jsonl') ELSE '/h/notes.txt' END"
    rows = v.table(s, d, "events").selectExpr("event_id AS id", f"{path} AS path")
    return rows.select("id", sessions.stream_identity(F.col("path")).alias("i")).select("id", "i.*")


@query("""WITH r AS (SELECT DISTINCT p_brand AS role FROM part), a AS (SELECT role, CASE ascii(right(role, 1)) % 5 WHEN 0 THEN 'claude'
  WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' WHEN 3 THEN 'mine' ELSE 'unknown' END AS agent FROM r),
st AS (SELECT p_brand AS role, l_returnflag AS f FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT role, coalesce(CASE WHEN role LIKE '%1' THEN NULL ELSE agent END, 'unknown') AS agent, count(*) AS steps, CAST(sum(CASE
  WHEN f = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS successes FROM st JOIN a USING (role) GROUP BY 1, 2""")
def agents_of_roles(s, d):
    kind = "ascii(right(p_brand, 1)) % 5"
    roles = v.table(s, d, "part").select("p_brand").distinct().where("p_brand NOT LIKE '%1'").selectExpr(
        "p_brand AS role", f"IF({kind} = 3, 'mine', NULL) AS provider",
        f"element_at(array('run Claude --openai', 'codex exec', 'DeepSeek', 'x', NULL), {kind} + 1) AS invocation", "CAST(NULL AS STRING) AS model",
    )
    steps = sessions.with_agents(v.steps(s, d).drop("agent"), sessions.with_agent(roles))
    return steps.groupBy("role", "agent").agg(F.count("*").alias("steps"), F.sum(F.col("ok").cast("long")).alias("successes"))


@query("""SELECT c_custkey AS id, c_custkey % 6 <> 4 AND c_custkey % 7 <> 0 AS valid, CASE WHEN c_custkey % 6 <> 4
  AND c_custkey % 7 <> 0 THEN 'made ' || c_name END AS description,
CASE WHEN c_custkey % 6 <> 4 AND c_custkey % 7 <> 0 THEN c_custkey % 7 / 2 END AS hours, CASE WHEN c_custkey % 6 <> 4
  AND c_custkey % 7 <> 0 THEN least(1.0, c_custkey % 13 / 10) END AS frustration,
CASE WHEN c_custkey % 6 <> 4 AND c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'low' END END AS confidence FROM customer""")
def estimate_answers(s, d):
    plain = """to_json(named_struct('brief_description', concat(' made \n ', c_name), 'ai_baseline_hours', IF(c_custkey % 7 = 0, 'none',
  CAST(c_custkey % 7 / 2 AS STRING)),
      'frustration_score', c_custkey % 13 / 10, 'estimation_confidence', IF(c_custkey % 2 = 0, 'high', 'sure')))"""
    wraps = (
        "p", "concat('```json\n', p, '\n```')", "to_json(named_struct('result', p))", "concat('Here: ', p, ' That is all')",
        "'no estimate'",
        "to_json(named_struct('result', to_json(named_struct('result', concat('```\n', p, '\n```')))))",
    )
    rows = v.table(s, d, "customer").selectExpr("c_custkey AS id", f"{plain} AS p").selectExpr(
        "id",
        f"element_at(array({', '.join(wraps)}), CAST(id % 6 AS INT) + 1) AS text",
    )
    e = "estimate."
    return review.estimates(rows).select(
        "id", "valid", F.col(e + "brief_description").alias("description"), F.col(e + "ai_baseline_hours").alias("hours"),
        F.col(e + "frustration_score").alias("frustration"), F.col(e + "estimation_confidence").alias("confidence"),
    )


@query("""WITH p AS (SELECT user_id, max(ts) AS last_ts, count(*) AS prompts FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS session_id, last_ts, prompts FROM p LEFT JOIN customer ON c_custkey = user_id
WHERE c_custkey IS NULL OR NOT (c_custkey % 9 = 0 OR c_custkey % 4 = 1 OR c_custkey % 3 = 0) ORDER BY last_ts DESC, session_id""")
def estimate_candidates(s, d):
    entries = v.table(s, d, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS session_id", "c_custkey % 9 = 0 AS review",
        "IF(c_custkey % 4 = 1, '2026-05-10', NULL) AS estimated_at", "IF(c_custkey % 3 = 0, 1.5, NULL) AS baseline",
    )
    return review.candidates(v.table(s, d, "events").where("event_type = 'view'").selectExpr("CAST(user_id AS STRING) AS session_id", "ts"), entries)


@query("""SELECT event_type, user_id % 5 AS client, count(*) AS sessions FROM events WHERE user_id % 4 <> 1 AND user_id % 5 IN (0, 1, 2)
  AND user_id % 6 <> 3 GROUP BY 1, 2""")
def human_sessions(s, d):
    rows = v.table(s, d, "events").selectExpr("event_type", "user_id % 5 AS client", "IF(user_id % 4 = 1, 'codex_exec', 'codex-tui') AS originator",
      "element_at(array('vscode', 'Desktop', 'cli', 'exec', 'other'), CAST(user_id % 5 AS INT) + 1) AS source", "true AS is_text", "IF(user_id % 6 = 3, 'SubAgent', NULL) AS thread_source")
    own = rows.where(review.human_driven(F.col("originator"), F.col("source"), F.col("is_text"), F.col("thread_source")))
    return own.groupBy("event_type", "client").agg(F.count("*").alias("sessions"))


@query("""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '{"schema_version":2,"n":' || user_id || '}'
  WHEN 1 THEN '{"schema_version": 1, "n":' || user_id || '}' ELSE '{"schema_version": 1}' END AS value FROM events""")
def schema_stamps(s, d):
    kinds = "concat('{\"schema_version\":2,\"n\":', user_id, '}')", "concat('{\"n\":', user_id, '}')", "'{}'"
    rows = v.table(s, d, "events").selectExpr("event_id AS id", f"element_at(array({', '.join(kinds)}), CAST(event_id % 3 AS INT) + 1) AS value")
    return rows.select("id", review.with_schema_version(F.col("value")).alias("value"))


@query(f"""WITH {COSTS}, cl AS (SELECT session_id, cost, commits, lines, cost / lines AS cpl FROM co WHERE lines > 0), th AS (SELECT cpl AS threshold
  FROM (SELECT cpl, row_number() OVER (ORDER BY cpl) - 1 AS r, count(*) OVER () AS n FROM cl) WHERE r = CAST(ceil(round((n - 1) * 0.9,
  6)) AS BIGINT)),
ex AS (SELECT session_id, cl.cost, lines, cpl FROM cl, th WHERE cpl >= threshold ORDER BY cpl DESC, session_id LIMIT 5)
SELECT left(ex.session_id, 8) AS session_short, se.s AS "start", se.e AS "end", round(ex.cost, 6) AS cost, lines, round(cpl,
  6) AS cost_per_line FROM ex JOIN se ON se.session_id = ex.session_id""")
def public_sessions(s, d):
    from ..operators import attribution
    from .queries import work

    own = work(s, d)[0]
    found = attribution.expensive(attribution.session_costs(own, v.commits(s, d)))
    return review.public_sessions(found.join(own.select("session_id", "start", "end"), "session_id"))


@query(None)
def sanitized_documents(s, d):
    return review.sanitize(v.table(s, d, "documents"))


@query(f"""SELECT 'c' || conv_id AS path, CAST(sum({marker_sql("text", (*t.PROFANITY, *t.THANKS))}) AS BIGINT) AS markers FROM conversations
WHERE role = 'user' AND turn >= 2 GROUP BY 1""")
def markers_since(s, d):
    rows = v.table(s, d, "conversations").selectExpr(
        "concat('c', conv_id) AS path",
        f"TIMESTAMP_NTZ'{TODAY} 10:00:00' + make_dt_interval(0, 0, CAST(turn AS INT)) AS ts", "role", "text",
    )
    return review.markers_since(rows, f"{TODAY} 10:02:00", (*t.PROFANITY, *t.THANKS))


@query(f"""WITH {LEDGER}, own AS (SELECT * FROM led2 WHERE model <> '<synthetic>' QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ord) = 1)
SELECT provider_norm AS provider, {STATS} FROM own GROUP BY 1""")
def ledger_lines(s, d):
    """Events written as lines, some numbers as text, with broken lines among them, and read back."""
    raw = v.raw_ledger(s, d)
    numbers = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")
    fields = [
        *[f"'{c}', {c}" for c in ("event_id", "session_id", "provider", "model", "originator", "source", "working_dir", "cost_estimate_usd")],
        *[f"'{c}', CAST({c} AS STRING)" for c in numbers], "'total_tokens', total_tokens", "'correction_of', IF(is_correction = 1, 'x', '')",
        "'ts', concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z')",
    ]
    good = raw.selectExpr(f"to_json(named_struct({', '.join(fields)})) AS value", "ord AS id")
    bad = raw.where("ord % 97 = 0").selectExpr("concat('{\"ts\": ', ord) AS value", "ord AS id")
    lines = ledger.parsed(good.unionByName(bad).selectExpr("value", "'claude.jsonl' AS file", "0L AS block", "id"))
    events = ledger.events_of(lines, "anthropic", "claude").withColumn("ord", F.col("id"))
    return dedup_events(events).groupBy(F.col("provider_norm").alias("provider")).agg(*rollup.stats())


def transcript_lines(s, d) -> DataFrame:
    """Conversations as transcripts: tool results beside some texts, side chains, summaries, and calls that are written twice."""
    c = v.table(s, d, "conversations")
    content = "IF(turn % 4 = 0, to_json(array(named_struct('type', 'tool_result', 'text', 'no'), named_struct('type', 'text', 'text', text))), text)"
    usage = "named_struct('input_tokens', turn + conv_id % 10, 'output_tokens', 2, 'cache_creation', named_struct('ephemeral_1h_input_tokens', turn))"
    line = f"""to_json(named_struct('type', role, 'timestamp', concat('2026-05-10T10:0', turn, ':00Z'), 'uuid', concat('u', CAST(turn / 4 AS INT)),
      'sessionId', concat('c', conv_id), 'isSidechain', conv_id % 5 = 4, 'isCompactSummary', turn = 6,
      'message', named_struct('role', role, 'content', 'TEXT', 'model', IF(role = 'assistant', concat('m', turn % 3), NULL),
      'usage', IF(role = 'assistant' AND conv_id % 7 > 0, {usage}, NULL))))"""
    text = f"IF(turn % 4 = 0, {content}, to_json(named_struct('t', text)))"
    rows = c.selectExpr(f"{line} AS line", f"{text} AS t", "turn % 4 = 0 AS blocks", "concat('f', conv_id, '.jsonl') AS file", "0L AS block", "turn AS id")
    # the text as JSON: an array of blocks, or what stands between the braces and the key of an object
    inner = F.when(F.col("blocks"), F.col("t")).otherwise(F.expr("substring(t, 6, length(t) - 6)"))
    return ledger.parsed(rows.select(F.replace("line", F.lit('"TEXT"'), inner).alias("value"), "file", "block", "id"))


@query("""SELECT 'f' || conv_id || '.jsonl' AS path, turn AS id, text FROM conversations
WHERE role = 'user' AND conv_id % 5 <> 4 AND turn <> 6 AND trim(text) <> '' AND NOT (ltrim(text) LIKE '<environment_context>%')""")
def transcript_prompts(s, d):
    return transcripts.prompts(transcripts.messages_of(transcript_lines(s, d))).select("path", "id", "text")


@query("""SELECT 'c' || conv_id AS session_id, 'u' || (turn // 4) AS message_uuid, 'm' || (turn % 3) AS model,
  TIMESTAMP '2026-05-10 10:00:00' + to_minutes(CAST(turn AS INT)) AS ts,
CAST(turn + conv_id % 10 AS BIGINT) AS input_tokens, CAST(2 AS BIGINT) AS output_tokens, CAST(turn AS BIGINT) AS cache_creation_1h_tokens FROM conversations
WHERE role = 'assistant' AND conv_id % 7 > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) = 1""")
def transcript_calls(s, d):
    calls = transcripts.billable(transcripts.messages_of(transcript_lines(s, d)))
    return calls.select("session_id", "message_uuid", "model", "ts", "input_tokens", "output_tokens", "cache_creation_1h_tokens")


@query("""WITH a AS (SELECT *, CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'm' || (turn + conv_id) END AS m, CASE WHEN role = 'user'
  AND turn % 3 = 0 THEN '/w/' || turn WHEN turn = 0 THEN '/w' END AS w FROM conversations),
b AS (SELECT *, last_value(m IGNORE NULLS) OVER o AS model, last_value(w IGNORE NULLS) OVER o AS wd FROM a WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'f' || conv_id AS file, 's' || conv_id AS session_id, model, wd AS working_dir, CAST(turn * (conv_id % 3) AS BIGINT) AS input_tokens,
  CAST(conv_id % 2 AS BIGINT) AS total_tokens
FROM b WHERE role = 'assistant' AND (turn * (conv_id % 3) > 0 OR conv_id % 2 > 0)""")
def rollout_calls(s, d):
    """Rollouts of conversations: a head, contexts that change model and folder, and token counts."""
    c = v.table(s, d, "conversations")
    parts = (
        ("turn = 0", "named_struct('type', 'session_meta', 'payload', named_struct('id', concat('s', conv_id), 'cwd', '/w', 'originator', 'codex-tui'))"),
        (
            "role = 'user' AND (turn % 4 = 0 OR turn % 3 = 0)",
            """named_struct('type', 'turn_context', 'payload',
              named_struct('model', IF(turn % 4 = 0, concat('m', turn + conv_id), NULL), 'cwd', IF(turn % 3 = 0, concat('/w/', turn), NULL)))""",
        ),
        (
            "role = 'assistant'",
            """named_struct('type', 'event_msg', 'timestamp', concat('2026-05-10T10:0', turn, ':00Z'), 'payload', named_struct('type', 'token_count',
              'info', named_struct('last_token_usage', named_struct('input_tokens', turn * (conv_id % 3), 'total_tokens', conv_id % 2))))""",
        ),
    )
    rows = None
    for k, (where, line) in enumerate(parts):
        some = c.where(where).selectExpr(f"to_json({line}) AS value", "concat('f', conv_id) AS file", "0L AS block", f"turn * 3 + {k} AS id")
        rows = some if rows is None else rows.unionByName(some)
    return transcripts.rollout_calls_of(ledger.parsed(rows)).select("file", "session_id", "model", "working_dir", "input_tokens", "total_tokens")
