"""Runs, envelopes, claims and plans of work."""

import hashlib
import re
from datetime import date, datetime

import pytest

from quillspark.operators import productivity, queue, runs


def test_order_of_roles():
    assert runs.dag_order(["a", "b", "c", "d"], {"a": ["c"], "b": ["x"]}) == ["b", "c", "a", "d"]
    with pytest.raises(ValueError):
        runs.dag_order(["a", "b"], {"a": ["b"], "b": ["a"]})


def test_comments_and_envelopes(spark):
    rows = spark.createDataFrame(
        [(1, 1, "claim: x1"), (1, 2, "so what"), (1, 3, "Heartbeat: x1 ok")], "issue int, id int, body string",
    ).selectExpr("*", "id as at")
    assert sorted((r["id"], r["kind"], r["exec_id"]) for r in runs.parse_comments(rows).collect()) == [(1, "claim", "x1"), (3, "heartbeat", "x1")]
    task = '{"task_id": 1, "kind": "k"}'
    good = f"```json\n{task}\n```\nsha256: {hashlib.sha256(task.encode()).hexdigest()}"
    rows = spark.createDataFrame([(good,), (good.replace("1,", "2,"),), ("nothing",), (None,)], "body string")
    assert [r["valid"] for r in runs.envelopes(rows).collect()] == [True, False, False, False]
    assert runs.envelopes(rows, required=("other",)).where("valid").count() == 0


def test_medians(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in (3, 1, 2, 4)] + [("b", 7.0)], "k string, x double")
    assert sorted(map(tuple, runs.lower_median(rows, ["k"], "x").collect())) == [("a", 2.0), ("b", 7.0)]
    rows = spark.createDataFrame([("stub", 1.0), ("small", 3.0), ("large", 2.0), ("large", 2.5)], "bucket string, hours double")
    assert {r["bucket"]: r["falls"] for r in runs.monotone_medians(rows).collect()} == {"stub": False, "small": False, "large": True}


def test_rechunk_plan(spark):
    units = spark.createDataFrame(
        [("a", date(2026, 5, 1)), ("a", date(2026, 5, 2)), ("b", date(2026, 5, 1)), ("c", date(2026, 5, 1)), ("c", date(2026, 5, 2))],
        "session_id string, day date",
    )
    tasks = spark.createDataFrame(
        [("a", None, "2", None), ("b", None, "2", None), ("c", None, "bad", None), ("a", date(2026, 5, 1), "1", None)],
        "session_id string, chunk_date date, ai_baseline_hours string, human_corrected_hours string",
    )
    assert [(r["session_id"], r["days"], r["missing"]) for r in runs.rechunk_plan(units, tasks).collect()] == [("a", 2, 1)]
    assert {r["session_id"] for r in runs.rechunk_plan(units, tasks, False).collect()} == {"a", "b"}


def test_imported_messages(spark):
    data = '{"role": "assistant", "modelID": "m", "tokens": {"input": 5, "cache": {"read": 2}}, "time": {"created": 1767225600000, "completed": 0}, "cost": 0.5}'
    rows = spark.createDataFrame(
        [("1", "s", data), ("2", "gone", data), ("3", "s", data.replace("assistant", "user")), ("4", "s", data.replace("1767225600000", "5"))],
        "id string, session_id string, data string",
    )
    got = runs.imported_messages(rows, spark.createDataFrame([("s", "/w")], "id string, directory string")).orderBy("event_id").collect()
    assert [(r["event_id"], r["working_dir"], r["ts"], r["input_tokens"], r["cache_read_tokens"]) for r in got] == [
        ("1", "/w", datetime(2026, 1, 1), 5, 2), ("2", None, datetime(2026, 1, 1), 5, 2),
    ]


def test_small_reports(spark):
    at = datetime(2026, 5, 10, 10)
    ev = spark.createDataFrame([("a", at), ("b", datetime(2026, 5, 1))], "session_id string, ts timestamp_ntz")
    assert [r["session_id"] for r in runs.recent_sessions(ev, "2026-05-11 10:00:00").collect()] == ["a"]
    steps = spark.createDataFrame(
        [("r", 1, "dev", "done"), ("r", 2, "qa", "done"), ("r", 3, "x", "failed")],
        "run_id string, ord int, role string, status string",
    )
    assert [r["role"] for r in runs.missing_hindsight(steps, steps.where("ord = 1")).collect()] == ["qa"]
    text = spark.createDataFrame([("# One Two\n## Three!",), ("none",)], "t string")
    assert [r[0] for r in text.select(runs.fingerprint(text["t"])).collect()] == ["one-two-three", None]
    told = spark.createDataFrame([("s", 3), ("s", 4), ("t", None)], "session_id string, chunk_events int")
    assert [tuple(r) for r in runs.known_events(told).collect()] == [("s", 7)]
    m = spark.createDataFrame([("p", at, "user"), ("p", datetime(2026, 5, 10, 10, 1), "assistant")], "path string, ts timestamp_ntz, role string")
    r = runs.session_metrics(m).first()
    assert (r["user_messages"], r["assistant_messages"], r["active_hours"]) == (1, 1, pytest.approx(1 / 60))


def test_days_of_tasks_are_never_broadcast(spark):
    """Spark takes the rows that an explode makes for one, so the days of many tasks look small to it."""
    events = spark.createDataFrame([("1", datetime(2026, 5, 1, 10), date(2026, 5, 1), "anthropic")], "session_id string, ts timestamp_ntz, event_date date, provider_norm string")
    tasks = spark.range(3).selectExpr(
        "CAST(id AS STRING) AS session_id", "explode(sequence(DATE'2026-05-01', DATE'2026-05-20')) AS chunk_date", "'1' AS ai_baseline_hours", "CAST(NULL AS STRING) AS human_corrected_hours",
        "1 AS day_input_version", "'' AS estimation_mode", "CAST(NULL AS TIMESTAMP_NTZ) AS input_read_at",
    )
    units = events.selectExpr("session_id", "event_date AS day", "'claude' AS provider")
    for made in (productivity.units_by_day(events, tasks), queue.with_tasks(units, tasks), runs.rechunk_plan(units.select("session_id", "day"), tasks)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and re.search(r"\bday#|chunk_date#|event_date#", x)], plan
