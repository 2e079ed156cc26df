"""Session files, the database source and what needs a review, on small files."""

import json
import re
import sqlite3
from datetime import datetime

from pyspark.sql import functions as F

from quillspark.operators import review, runs
from quillspark.sources import ledger, sessions


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows), encoding="utf-8")
    return str(path)


def test_folder_with_subagents(spark, tmp_path):
    line = {"type": "user", "sessionId": "x"}
    write(tmp_path / "C--work-p" / "s1.jsonl", [line, "broken"])
    write(tmp_path / "C--work-p" / "s1" / "subagents" / "agent-a.jsonl", [line, line])
    write(tmp_path / "C--work-p" / "s1" / "subagents" / "workflows" / "wf" / "agent-a.jsonl", [line])
    write(tmp_path / "C--work-p" / "s1" / "subagents" / "notes.jsonl", [line])
    rows = sessions.files(spark, str(tmp_path)).groupBy("session_id", "working_dir", "agent_id").count().collect()
    assert sorted((r["session_id"], r["working_dir"], r["agent_id"] or "", r["count"]) for r in rows) == [
        ("s1", "C:/work/p", "", 1), ("s1", "C:/work/p", "agent-a", 2), ("s1", "C:/work/p", "workflows/wf/agent-a", 1),
    ]


def test_switched_calls(spark, tmp_path):
    call = lambda at, usage, **more: {
        "type": "message", "timestamp": f"2026-05-10T10:0{at}:00Z", "message": {"role": "assistant", "usage": usage, **more},
    }
    rows = [
        call(0, {"input": 5}),
        {"type": "session", "id": "s", "cwd": "/w"},
        {"type": "model_change", "provider": "OpenClaw", "modelId": "m1"},
        {"type": "custom_message", "customType": "openclaw.runtime-context", "content": "telegram:7"},
        call(1, {"input": 0}, model="m0", provider="Mistral"),
        call(2, {"output": 3, "totalTokens": 9, "cost": {"total": 0.5}}, stopReason="Error"),
        call(3, "none"),
        {"type": "message", "timestamp": "bad", "message": {"role": "assistant", "usage": {"input": 1}, "model": "never"}},
        call(4, {"cacheRead": 2}),
    ]
    found = sessions.switched_calls(ledger.lines(spark, write(tmp_path / "base.jsonl", rows))).orderBy("line").collect()
    assert [(r["session_id"], r["provider"], r["model"], r["channel"], r["total_tokens"], r["partial"]) for r in found] == [
        ("base", "openrouter", "unknown", "workspace", 5, False), ("s", "mistral", "m0", "telegram", 9, True), ("s", "mistral", "m0", "telegram", 2, False),
    ]
    later = sessions.switched_calls(ledger.lines(spark, str(tmp_path / "base.jsonl")), since="2026-05-10 10:02:00").collect()
    assert {(r["provider"], r["model"]) for r in later} == {("openrouter", "m1")} and len(later) == 2


def test_captured_runs(spark, tmp_path):
    a = write(
        tmp_path / "a.jsonl",
        [
            {"thread_id": ""}, {"thread_id": "t1", "session_id": "s1"}, {"usage": {"input_tokens": 9}},
            {"item": {"model": "m"}, "usage": {"prompt_tokens": 2, "input_tokens": "x", "total_tokens": 0, "output_reasoning_tokens": 4}},
            {"usage": 3},
        ],
    )
    b = write(tmp_path / "b.jsonl", [{"type": "x"}])
    lines = ledger.lines(spark, a).unionByName(ledger.lines(spark, b))
    given = spark.createDataFrame(
        [("a.jsonl", 0, False, None), ("b.jsonl", 0, False, "asked"), ("c.jsonl", 1, True, None)],
        "file string, exit_code int, interrupted boolean, model string",
    )
    rows = {r["file"]: r for r in sessions.captured_runs(lines, given).collect()}
    assert (
        rows["a.jsonl"]["session_id"], rows["a.jsonl"]["model"], rows["a.jsonl"]["input_tokens"], rows["a.jsonl"]["total_tokens"],
        rows["a.jsonl"]["partial"],
    ) == ("s1", "m", 0, 4, False)
    assert (
        rows["b.jsonl"]["session_id"], rows["b.jsonl"]["model"], rows["b.jsonl"]["partial"], rows["b.jsonl"]["json_events"],
    ) == ("codex-missing-thread-b.jsonl", "asked", True, 1)
    assert (rows["c.jsonl"]["json_events"], rows["c.jsonl"]["partial"]) == (0, True)


def test_database_tables(spark, tmp_path):
    path = str(tmp_path / "store.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT, n INTEGER)")
        db.execute("CREATE TABLE session (id TEXT, directory TEXT)")
        data = json.dumps({"role": "assistant", "time": {"completed": 1_778_400_000_000}, "tokens": {"input": 4}, "modelID": "m"})
        db.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [(f"m{i}", f"s{i % 3}", data if i % 2 else None, i) for i in range(100)])
        db.execute("INSERT INTO session VALUES ('s1', '/w')")
        db.execute("CREATE TABLE empty (x REAL)")
    rows = sessions.sqlite_table(spark, path, "message", 7)
    assert rows.count() == 100 and rows.agg(F.sum("n")).first()[0] == 4950 and dict(rows.dtypes)["n"] == "bigint"
    assert sessions.sqlite_table(spark, path, "empty").count() == 0
    calls = runs.imported_messages(rows, sessions.sqlite_table(spark, path, "session")).collect()
    assert len(calls) == 50 and {r["working_dir"] for r in calls} == {"/w", None}


def test_roles(spark, tmp_path):
    (tmp_path / "roles.toml").write_text(
        "[role.dev]\nprovider = 'p'\ninvocation = 'claude -p'\n[role.qa]\nprovider = \"mine\"\n[role.odd]\nprovider = 3\n",
        encoding="utf-8",
    )
    roles = sessions.read_roles(spark, str(tmp_path / "roles.toml"))
    assert {r["role"]: r["agent"] for r in roles.collect()} == {"dev": "claude", "qa": "mine", "odd": "unknown"}
    assert sessions.read_roles(spark, str(tmp_path / "none.toml")).count() == 0
    steps = spark.createDataFrame([("dev",), ("other",), (None,)], "role string")
    assert sorted((str(r["role"]), r["agent"]) for r in sessions.with_agents(steps, roles).collect()) == [
        ("None", "unknown"), ("dev", "claude"), ("other", "unknown"),
    ]


def test_sanitizer_keeps_marked_passages(spark):
    ip, home = "see 10.0.5.7 ", "cat /home/me/x "
    texts = [
        ip + home, f"{ip}\n{review.KEEP_OPEN}\n{ip}\n{review.KEEP_CLOSE} {ip}\n{ip}",
        f"{review.KEEP_OPEN} {ip}\n```sh\n{ip}\n~~~\n{ip}\n``` end {ip}\n{home}", f"a\n{review.KEEP_OPEN}\n{ip}", None, "", "plain",
    ]

    def clean(part):
        out, hits = part, {}
        for pattern, new, what in review.RULES:
            out, k = re.subn(pattern, new, out)
            hits[what] = k
        return out, hits

    def brute(text):
        """Line by line, as the marks say."""
        done, kept, fence, hits, free = [], False, None, {}, []
        for line in (text or "").splitlines(keepends=True) + [None]:
            opens = line is not None and not kept and review.KEEP_OPEN in line
            if line is None or opens:
                part, found = clean("".join(free))
                done.append(part)
                hits = {k: hits.get(k, 0) + v for k, v in found.items()}
                free = []
            if line is None:
                break
            if opens:
                kept, fence = True, None
                done.append(line)
            elif kept:
                done.append(line)
                if review.KEEP_CLOSE in line or (fence and line.lstrip().startswith(fence)):
                    kept = False
                elif fence is None and line.lstrip().startswith(("```", "~~~")):
                    fence = line.lstrip()[:3]
            else:
                free.append(line)
        return None if text is None else "".join(done), {k: v for k, v in hits.items() if v}

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in review.sanitize(df).collect():
        assert (r["text"], {h["rule"]: h["n"] for h in r["hits"]}) == brute(texts[r["doc_id"]])


def test_small_reviews(spark):
    at = lambda m: datetime(2026, 5, 10, 10, m)
    rows = spark.createDataFrame(
        [("a", at(1), "user", "Damn it, damn"), ("a", at(0), "user", "damn"), ("a", at(5), "assistant", "damn"), ("b", at(9), "user", "fine")],
        "path string, ts timestamp_ntz, role string, text string",
    )
    found = {r["path"]: r["markers"] for r in review.markers_since(rows, "2026-05-10 10:01:00", (r"\bdamn\b",)).collect()}
    assert found == {"a": 2, "b": 0}
    both = review.united(rows.select("role", "text"), rows.select("path", "text"))
    assert both.where("source = 'runs' and path is null").count() == 4 and both.count() == 8
    commits = spark.createDataFrame(
        [("s1234567890", None, 3, None), ("s1234567890", "b", None, 1)],
        "session_id string, subject string, insertions int, deletions int",
    )
    ex = spark.createDataFrame(
        [("s1234567890", at(0), at(1), 2.0, 4, 0.5)],
        "session_id string, start timestamp_ntz, end timestamp_ntz, cost double, lines long, cost_per_line double",
    )
    r = review.public_sessions(ex, commits).first()
    assert r["session_short"] == "s1234567" and [tuple(c) for c in r["commits"]] == [("", 3, 0), ("b", 0, 1)] and "session_id" not in r
    changes = spark.createDataFrame(
        [("dev", "keep", "claude", "high"), ("qa", "change", "codex", None)],
        "role string, action string, agent string, confidence string",
    )
    assert {r["role"]: r["line"] for r in review.role_lines(changes).collect()} == {
        "dev": "# Suggestion: keep current (claude). Confidence: high.", "qa": "# Suggestion: switch to codex. Confidence: none.",
    }
    matrix = spark.createDataFrame([(1, "f", "qa", "silent"), (1, "f", "dev", "raised")], "run_id int, canonical string, role string, state string")
    assert review.report_lines(matrix).first()["line"] == "| f | dev: raised | qa: silent |"
