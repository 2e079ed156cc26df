"""Scans of files, sinks and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.operators import repricing, rollup
from quillspark.operators.dedup import dedup_events
from quillspark.sources import ledger, sinks, transcripts
from quillspark.streaming import ingest


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_ledger(spark, tmp_path):
    good = {
        "ts": "2026-05-10T10:00:00Z", "session_id": "s", "model": "claude-opus-4-1", "input_tokens": "5", "output_tokens": 3.7,
        "cost_estimate_usd": None, "event_id": "a",
    }
    write(
        tmp_path / "claude.jsonl",
        [
            "", "broken {", "[1]", {**good, "model": "<synthetic>"}, {**good, "ts": "never"}, good, {**good, "input_tokens": 99},
            {**good, "event_id": None, "cost_estimate_usd": 0}, {**good, "event_id": None, "cost_estimate_usd": 0},
            {**good, "event_id": "c", "correction_of": "a", "cost_estimate_usd": 0.5},
        ],
    )
    write(
        tmp_path / "codex.jsonl",
        [{"ts": "2026-05-10T13:00:00+03:00", "session_id": "x", "provider": "openai", "originator": "codex-tui", "cached_input_tokens": True, "duration_ms": "bad"}],
    )
    rows = dedup_events(ledger.read_ledgers(spark, str(tmp_path), ["claude", "codex"])).orderBy("ord").collect()
    assert [(r["provider_norm"], r["input_tokens"], r["output_tokens"], r["cost_estimate_usd"], r["is_correction"]) for r in rows] == [
        ("anthropic", 5, 3, None, 0), ("anthropic", 5, 3, 0.0, 0), ("anthropic", 5, 3, 0.5, 1), ("openai", 0, 0, None, 0),
    ]
    assert (rows[3]["origin_norm"], rows[3]["cached_input_tokens"], rows[3]["duration_ms"]) == ("tui", 1, 0)
    assert {r["ts"] for r in rows} == {datetime(2026, 5, 10, 10)}
    every = ledger.read_ledgers(spark, str(tmp_path), ["claude", "codex"])
    assert [r["provider_norm"] for r in ledger.in_time(every).collect()] == ["anthropic"] * 5 + ["openai"]
    assert rollup.window(every, "2026-05-10", "2026-05-10", ["Codex"]).count() == 1
    cover = ledger.schema_coverage(spark, str(tmp_path / "claude.jsonl")).first()
    assert (cover["records"], cover["versioned"], cover["broken"]) == (9, 0, 2)


def test_tasks(spark, tmp_path):
    path = write(
        tmp_path / "tasks.json",
        [{"s": {"ai_baseline_hours": 2, "mood_arc": None}, "s:2026-05-10": {"human_corrected_hours": "x", "day_input_version": 2}, "bad": 3}],
    )
    rows = {r["task_key"]: r for r in ledger.read_tasks(spark, path).collect()}
    assert set(rows) == {"s", "s:2026-05-10"}
    assert rows["s"]["has_sentiment"] and not rows["s:2026-05-10"]["has_sentiment"]
    assert str(rows["s:2026-05-10"]["chunk_date"]) == "2026-05-10" and rows["s"]["chunk_date"] is None
    assert ledger.read_tasks(spark, write(tmp_path / "t.json", ["{broken"])).count() == 0


def test_bus_cache_and_runs(spark, tmp_path):
    bus = write(
        tmp_path / "bus.jsonl",
        [
            {"ts": "2026-05-10T10:00:00Z", "transition": "claimed", "task_id": "t"},
            {"ts": "2026-05-10T10:00:00Z", "transition": ""}, {"transition": "x"},
        ],
    )
    assert [r["task_id"] for r in ledger.read_bus_events(spark, bus).collect()] == ["t"]
    cache = write(tmp_path / "c.json", [{"s": {"ts": [0, "x", 60.5], "prompts": 2}}])
    assert [r["ts"].second for r in ledger.read_attention_cache(spark, cache).orderBy("ts").collect()] == [0, 0]
    run = write(
        tmp_path / "state.json",
        [{"run_id": "r", "steps": [{"role": "dev", "status": "ok", "started_at": 60, "result": {"ok": True, "duration_ms": 5}}, {"role": "qa", "started_at": "2026-05-10T10:00:00Z"}]}],
    )
    assert [(r["role"], r["ok"], r["at"].year) for r in ledger.read_run_states(spark, run).orderBy("ord").collect()] == [
        ("dev", True, 1970), ("qa", False, 2026),
    ]


def test_transcripts(spark, tmp_path):
    at = "2026-05-10T10:00:0{}Z"
    rows = [
        {"type": "user", "timestamp": at.format(0), "message": {"role": "user", "content": "hello"}},
        {"type": "user", "timestamp": at.format(1), "message": {"role": "user", "content": [{"type": "tool_result", "content": "x"}]}},
        {"type": "user", "timestamp": at.format(2), "message": {"role": "user", "content": [{"type": "tool_result"}, {"type": "text", "text": "and more"}]}},
        {"type": "user", "timestamp": at.format(3), "isSidechain": True, "message": {"role": "user", "content": "side"}},
        {"type": "user", "timestamp": at.format(4), "isCompactSummary": True, "message": {"role": "user", "content": "summary"}},
        {"type": "user", "timestamp": at.format(5), "message": {"role": "user", "content": "<environment_context> x"}},
        {
            "type": "assistant", "timestamp": at.format(6), "uuid": "u", "sessionId": "s",
            "message": {
                "role": "assistant", "model": "claude-opus-5",
                "usage": {"input_tokens": 3, "cache_creation_input_tokens": 9, "cache_creation": {"ephemeral_1h_input_tokens": 4}},
                "content": [{"type": "tool_use"}, {"type": "text", "text": "ok"}],
            },
        },
        {
            "type": "assistant", "timestamp": at.format(7), "uuid": "u", "sessionId": "s",
            "message": {"role": "assistant", "model": "claude-opus-5", "usage": {"input_tokens": 99}, "content": "again"},
        },
        "not json",
    ]
    found = transcripts.messages(spark, write(tmp_path / "a.jsonl", rows))
    assert [r["text"] for r in transcripts.prompts(found).orderBy("id").collect()] == ["hello", "and more"]
    calls = transcripts.billable(found).collect()
    assert [(r["input_tokens"], r["cache_creation_tokens"], r["cache_creation_1h_tokens"], r["cache_read_tokens"]) for r in calls] == [(3, 9, 4, 0)]
    assert transcripts.tool_calls(found).first()["calls"] == 1
    assert "user: hello" in transcripts.daily_input(found).first()["context"]


def test_rollouts_carry_state_forward(spark, tmp_path):
    count = lambda n: {
        "type": "event_msg", "timestamp": f"2026-05-10T10:00:0{n}Z",
        "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "total_tokens": n}}},
    }
    rows = [
        {"type": "session_meta", "timestamp": "x", "payload": {"id": "s", "cwd": "/w", "originator": "codex-tui"}},
        {"type": "turn_context", "payload": {"model": "m1"}}, count(1), count(0),
        {"type": "turn_context", "payload": {"model": "m2", "cwd": "/v"}}, count(2),
    ]
    path = write(tmp_path / "r.jsonl", rows)
    got = [(r["session_id"], r["originator"], r["model"], r["working_dir"], r["input_tokens"]) for r in transcripts.rollout_calls(spark, path).orderBy("id").collect()]
    assert got == [("s", "codex-tui", "m1", "/w", 1), ("s", "codex-tui", "m2", "/v", 2)]
    assert transcripts.is_rollout(spark, path).first()["rollout"]


def test_upserts(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, hours int, note string")
    changes = spark.createDataFrame([("a", None, None), ("c", 3, "z")], "k string, hours int, note string")
    got = sorted(map(tuple, sinks.upsert(table, changes, "k", ("hours",)).collect()))
    assert got == [("a", 1, None), ("b", 2, "y"), ("c", 3, "z")]
    assert [r["k"] for r in sinks.replaced(table, changes, "k").collect()] == ["a"]


def test_caches_are_merged(spark):
    rows = lambda *r: spark.createDataFrame(r, "session_id string, ts array<double>")
    got = dict(map(tuple, sinks.merge_cache(rows(("a", [1.0]), ("b", [1.0]), ("d", [4.0])), rows(("a", [2.0]), ("b", [1.0, 2.0]), ("c", [3.0]))).collect()))
    assert got == {"a": [1.0], "b": [1.0, 2.0], "c": [3.0], "d": [4.0]}


def test_documents(spark):
    doc = json.loads(sinks.snapshot({"a": spark.range(2), "b": spark.range(0)}).first()[0])
    assert doc == {"a": [{"id": 0}, {"id": 1}], "b": []}
    once = sinks.replace_block("# t\n", "| x |")
    assert sinks.replace_block(once, "| x |") == once
    assert sinks.markdown(spark.range(1)).splitlines()[-1] == "| 0 |"


def test_streams(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    row = lambda i, minute=0: {
        "event_id": f"e{i}", "session_id": "s", "ts": f"2026-05-10T10:{minute:02}:00Z", "provider": "openai", "input_tokens": 1,
        "output_tokens": 1, "cost_estimate_usd": 0.5,
    }
    write(source / "1.json", [row(1), row(2, 29), row(1), "broken"])
    ingest.ingest(spark, str(source), table, str(tmp_path / "c1"))
    write(source / "2.json", [row(2, 29), row(3, 59)])
    ingest.ingest(spark, str(source), table, str(tmp_path / "c1"))
    ingest.ingest(spark, str(source), table, str(tmp_path / "c2"))  # from the beginning: nothing is added
    assert sorted(r["event_id"] for r in spark.read.parquet(table).collect()) == ["e1", "e2", "e3"]
    clean = lambda: ingest.deduplicated(ingest.stream(spark, str(source)))
    # windows stay open for late rows until a later event closes them
    write(source / "3.json", [{**row(9), "ts": "2026-06-30T00:00:00Z"}])
    found = {}
    for name, made in (("days", ingest.daily(clean(), None)), ("gaps", ingest.sessions(clean(), late=None))):
        query = made.writeStream.format("memory").queryName(name).outputMode("append").option(
            "checkpointLocation", str(tmp_path / name),
        ).trigger(availableNow=True).start()
        query.awaitTermination()
        found[name] = sorted(map(tuple, spark.table(name).collect()))
    assert [r[1:] for r in found["days"]] == [("openai", 3, 6, pytest.approx(1.5))]
    # a gap that equals the limit doesn't part
    assert [(r[0], r[1].minute, r[3]) for r in found["gaps"]] == [("s", 0, 3)]


def test_payloads_replace_the_old_one_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "payload")
    sinks.write_payload(spark.range(5), path)
    sinks.write_payload(spark.range(2), path)
    assert spark.read.json(path).count() == 2
    failing = spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.write_payload(failing, path)
    assert spark.read.json(path).count() == 2
    assert [p.name for p in tmp_path.iterdir() if ".old" in p.name] == []


def test_prices_go_by_the_utc_day(spark):
    """Late in the evening west of Greenwich the next day's prices hold already."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = spark.createDataFrame([(datetime(2026, 8, 20, 21, 0),), (datetime(2026, 8, 20, 19, 0),)], "ts timestamp_ntz")
        assert [str(r[0]) for r in rows.select(repricing.price_day(F.col("ts"))).collect()] == ["2026-08-21", "2026-08-20"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.json", [{"event_id": "e", "ts": "2026-05-10T10:00:00Z"}])
    query = ingest.snapshots(ingest.stream(spark, str(tmp_path / "in")), lambda: spark.range(1), str(tmp_path / "out"), str(tmp_path / "cp"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_lines_are_parsed_once(spark, tmp_path):
    """Before, filters on what a line says parsed it anew for each place they name it."""
    from quillspark.operators.productivity import eligible

    (tmp_path / "claude.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "event_id": "a"}\nnull\n[1]\n{"ts": 1\n', encoding="utf-8")
    rows = eligible(ledger.read_events(spark, str(tmp_path / "claude.jsonl"), "anthropic", "claude"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert [r["event_id"] for r in rows.select("event_id").collect()] == ["a"]
