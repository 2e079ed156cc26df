"""What is kept between runs: tables of folders, daily aggregates, partials of files, appended ledgers, leases."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators.daily import NAMES, Daily, build, measures
from quillspark.operators.lifetime import Lifetime
from quillspark.sources import append, ledger, sinks
from quillspark.sources.folders import Conflict, Folders
from quillspark.streaming import ingest, leases

SF = "/root/testdata/sf0.001"


# -- Tables of folders -----------------------------------------------------------------------------------------------


def test_log_of_commits(spark, tmp_path):
    table = Folders(spark, str(tmp_path / "t"), full=3)
    assert table.state() == (-1, {}) and table.rows("id long").count() == 0
    for i in range(8):
        assert table.append(f"k{i}", spark.range(i, i + 1))
        assert not table.append(f"k{i}", spark.range(100))
    assert table.state()[0] == 7 and sorted(r[0] for r in table.rows("id long").collect()) == list(range(8))
    table.commit({}, ["k3"])
    assert sorted(r[0] for r in Folders(spark, str(tmp_path / "t"), full=3).rows("id long").collect()) == [0, 1, 2, 4, 5, 6, 7]
    gone = table.vacuum()
    assert len(gone) == 1 and table.rows("id long").count() == 7 and table.numbers() == [6, 7, 8]


def test_one_of_two_writers_gets_a_commit(spark, tmp_path):
    one, two = Folders(spark, str(tmp_path / "t")), Folders(spark, str(tmp_path / "t"))
    last = one.state()[0]
    one.commit({"a": {"folder": None}}, after=last)
    with pytest.raises(Conflict):
        two.commit({"b": {"folder": None}}, after=last)
    # a rename onto a number that is taken is refused by the file system, whoever asked first
    two.fs.write(f"{two.at}/_new-x", json.dumps({"put": {"c": {"folder": None}}, "drop": []}))
    assert not two.fs.move(f"{two.at}/_new-x", f"{two.log}/{0:012d}.json")
    assert set(two.state()[1]) == {"a"}


def test_a_batch_that_dies_before_its_commit_is_written_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    run = ingest.commit_batches(path)
    run(spark.range(3), 0)
    commit = Folders.commit

    def dies(self, *a, **k):
        raise OSError("killed")

    monkeypatch.setattr(Folders, "commit", dies)
    with pytest.raises(OSError, match="killed"):
        run(spark.range(3, 5), 1)
    monkeypatch.setattr(Folders, "commit", commit)
    assert sorted(r[0] for r in ingest.committed(spark, path, "id long").collect()) == [0, 1, 2]
    assert sum(x.startswith("part-") for x in os.listdir(path)) == 2  # the rows are there, but nobody sees them
    run(spark.range(3, 5), 1)
    run(spark.range(3, 5), 1)
    assert sorted(r[0] for r in ingest.committed(spark, path, "id long").collect()) == [0, 1, 2, 3, 4]


def test_stream_repeats_a_failed_batch(spark, tmp_path, monkeypatch):
    source, table, at = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "at")
    source.mkdir()
    line = lambda i: json.dumps({"event_id": f"e{i}", "session_id": "s", "ts": f"2026-05-10T10:00:{i:02}Z", "provider": "openai"})
    (source / "1.json").write_text("\n".join(map(line, [1, 2, 2])))
    ingest.ingest_once(spark, str(source), table, at)
    (source / "2.json").write_text("\n".join(map(line, [2, 3])))
    commit = Folders.commit
    monkeypatch.setattr(Folders, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception, match="killed"):
        ingest.ingest_once(spark, str(source), table, at)
    monkeypatch.setattr(Folders, "commit", commit)
    assert ingest.committed(spark, table).count() == 2
    for _ in range(2):
        ingest.ingest_once(spark, str(source), table, at)
    assert sorted(r["event_id"] for r in ingest.committed(spark, table).collect()) == ["e1", "e2", "e3"]


# -- Daily aggregates ------------------------------------------------------------------------------------------------

EVENTS = (
    "ord long, ts timestamp_ntz, event_date date, provider_norm string, model string, origin_norm string, dedupe_group string, is_correction int, "
    "input_tokens long, output_tokens long, cached_input_tokens long, cache_read_tokens long, cache_creation_tokens long, reasoning_tokens long, "
    "total_tokens long, cost_estimate_usd double"
)


def event(i, day, provider="anthropic", model="m", group=None, cost=1.0, **more):
    at = datetime(2026, 5, day, 12)
    row = dict.fromkeys([c.split()[0] for c in EVENTS.split(", ")], 1)
    row |= {"ord": i, "ts": at, "event_date": at.date(), "provider_norm": provider, "model": model, "origin_norm": None}
    return tuple((row | {"dedupe_group": group or f"g{i}", "is_correction": 0, "input_tokens": i, "cost_estimate_usd": cost} | more).values())


def both(daily, events, start, end, by, providers=None):
    fast = measures(daily, events, f"2026-05-{start:02}", f"2026-05-{end:02}", by, providers, grand_total=bool(by))
    slow = measures(None, events, f"2026-05-{start:02}", f"2026-05-{end:02}", by, providers, grand_total=bool(by))
    assert fast.columns == slow.columns
    key = lambda r: repr(r[: len(by)])
    assert sorted(map(tuple, fast.collect()), key=key) == sorted(map(tuple, slow.collect()), key=key)
    return fast


def test_windows_from_aggregates_are_those_from_events(spark, tmp_path):
    rows = [event(i, 1 + i % 6, ["anthropic", "openai"][i % 2], f"m{i % 3}", f"g{i % 17}" if i % 3 else None, None if i % 7 == 0 else i / 8) for i in range(90)]
    rows += [event(90, 3, model="<synthetic>"), event(91, 2, model=None), event(92, 5, is_correction=1)]
    events = spark.createDataFrame(rows, EVENTS)
    daily = Daily(spark, str(tmp_path / "d"))
    assert daily.state("2026-05-01", "2026-05-01") is None
    daily.refresh(events, [f"2026-05-{x:02}" for x in (4, 5, 6, 7)])
    daily.refresh(events, [f"2026-05-{x:02}" for x in (1, 2, 3)])
    assert daily.state("2026-05-01", "2026-05-07") and daily.state("2026-05-01", "2026-05-08") is None
    for start, end in ((1, 7), (2, 4), (3, 3), (7, 7)):
        for by in ((), ("provider", "model"), ("event_date",), ("provider", "origin")):
            for providers in (None, ["codex"], ["claude", "openai"]):
                both(daily, events, start, end, by, providers)


def test_new_rows_of_a_day_change_other_days(spark, tmp_path):
    first = [event(1, 1, group="a"), event(2, 1, group="b"), event(3, 2, group="c")]
    daily = Daily(spark, str(tmp_path / "d"))
    old = spark.createDataFrame(first, EVENTS)
    daily.refresh(old, ["2026-05-01", "2026-05-02"])
    both(daily, old, 1, 2, ())
    now = spark.createDataFrame([*first, event(4, 2, group="a"), event(5, 3, group="b")], EVENTS)
    assert daily.refresh(now, ["2026-05-02", "2026-05-03"]) == ["2026-05-01", "2026-05-02", "2026-05-03"]
    for window in ((1, 3), (2, 3), (3, 3), (1, 1)):
        both(daily, now, *window, ("event_date",))
    # and back: the group is in one cell again
    back = spark.createDataFrame([*first, event(5, 3, group="b")], EVENTS)
    assert "2026-05-01" in daily.refresh(back, ["2026-05-02"])
    both(daily, back, 1, 3, ("event_date",))


def test_a_refresh_reads_the_events_of_its_days_only(spark, tmp_path):
    rows = spark.createDataFrame([event(i, 1 + i % 5) for i in range(50)], EVENTS)
    rows.write.partitionBy("event_date").parquet(str(tmp_path / "events"))
    kept = spark.read.parquet(str(tmp_path / "events"))
    daily = Daily(spark, str(tmp_path / "d"))
    daily.refresh(kept, [f"2026-05-0{x}" for x in range(1, 6)])
    # days are partitions, so a day that is gone can't be read
    for name in os.listdir(tmp_path / "events"):
        if name.endswith(("05-01", "05-02")):
            for x in os.listdir(tmp_path / "events" / name):
                os.remove(tmp_path / "events" / name / x)
    assert daily.refresh(kept, ["2026-05-04"]) == ["2026-05-04"]
    fast = measures(daily, kept, "2026-05-01", "2026-05-05", ("provider",))
    assert fast.collect()[0]["calls"] == 50
    assert all("/d/" in x for x in fast.inputFiles()) and fast.inputFiles()


def test_folders_are_brought_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quillspark.operators.daily.MANY", 3)
    events = spark.createDataFrame([event(i, 1 + i % 5, group=f"g{i % 20}" if i % 2 else None) for i in range(60)], EVENTS)
    daily = Daily(spark, str(tmp_path / "d"))
    for day in (1, 2, 3, 4, 5, 3, 1):
        daily.refresh(events, [f"2026-05-{day:02}"])
    assert len({v["folder"] for k, v in daily.folders.state()[1].items() if k.startswith("sums/")}) <= 3
    both(daily, events, 1, 5, ("event_date", "provider"))
    both(daily, events, 2, 4, ("model",))


def test_other_questions_go_to_the_events(spark, tmp_path):
    events = spark.createDataFrame([event(i, 1 + i % 2) for i in range(10)], EVENTS)
    daily = Daily(spark, str(tmp_path / "d"))
    daily.refresh(events, ["2026-05-01", "2026-05-02"])
    days = ("2026-05-01", "2026-05-02")
    assert measures(daily, events, *days, where=F.col("ord") < 5).first()["calls"] == 5
    assert measures(daily, events, "2026-04-30", "2026-05-02").first()["calls"] == 10  # a day that isn't kept
    assert measures(daily, events, *days).first().asDict().keys() == set(NAMES)
    assert measures(daily, events, "2026-05-02", "2026-05-01").first()["calls"] == 0


def test_build_counts_what_is_there(spark, tmp_path):
    folder = tmp_path / "l"
    folder.mkdir()
    for tag in ledger.FILES:
        (folder / f"{tag}.jsonl").write_text(json.dumps({"ts": "2026-05-01T10:00:00Z", "event_id": f"{tag}1", "model": "m", "input_tokens": 3}) + "\nbroken\n")
    (folder / "tasks.json").write_text(json.dumps({"s1": {"ai_baseline_hours": 1}, "s2:2026-05-01": {}}))
    (folder / "bus-events.jsonl").write_text(json.dumps({"ts": "2026-05-01T10:00:00Z", "transition": "done"}) + "\n{}\n")
    row = build(spark, str(folder), str(tmp_path / "d")).first()
    assert (row["events"], row["tasks"], row["bus_tasks"]) == (5, 2, 1)
    daily = Daily(spark, str(tmp_path / "d"))
    got = {r["provider"]: r["calls"] for r in measures(daily, None, "2026-05-01", "2026-05-01", ("provider",)).collect()}
    assert got == {"anthropic": 1, "openai": 1, "openrouter": 2, "opencode": 1}


# -- Partials of files -----------------------------------------------------------------------------------------------


def write_events(path, rows):
    path.write_text("".join(json.dumps({"ts": "2026-05-01T10:00:00Z", "model": "m", **r}) + "\n" for r in rows))


def test_only_changed_files_are_read(spark, tmp_path):
    folder = tmp_path / "l"
    (folder / "claude.jsonl").mkdir(parents=True)
    life = Lifetime(spark, str(folder), str(tmp_path / "p"))
    assert life.refresh() == [] and life.counts().count() == 0
    write_events(folder / "claude.jsonl" / "a", [{"event_id": "1", "session_id": "s"}, {"event_id": "1", "session_id": "t"}, {"event_id": "2", "session_id": "s"}])
    write_events(folder / "claude.jsonl" / "b", [{"event_id": "2", "session_id": "u"}, {"event_id": "3", "session_id": "u"}, {"event_id": "4"}])
    write_events(folder / "codex.jsonl", [{"event_id": "3", "session_id": "x", "originator": "codex-tui"}, {"event_id": "9", "session_id": "x", "originator": "codex_exec"}])
    assert sorted(life.refresh()) == ["claude/a", "claude/b", "codex/codex.jsonl"]
    assert dict(map(tuple, life.counts().collect())) == {"s": 2, "u": 1}
    assert life.refresh() == []
    # unchanged files are not opened: they can't be read any more, and nobody notices
    os.truncate(folder / "claude.jsonl" / "b", os.path.getsize(folder / "claude.jsonl" / "b"))
    write_events(folder / "claude.jsonl" / "0", [{"event_id": "4", "session_id": "z"}, {"event_id": "1", "session_id": "z"}])
    again = life.refresh()
    assert "claude/0" in again and "claude/a" not in again
    # the new file comes first, so its rows win
    assert dict(map(tuple, life.counts().collect())) == {"s": 1, "u": 1, "z": 2}
    os.remove(folder / "claude.jsonl" / "0")
    life.refresh()
    assert dict(map(tuple, life.counts().collect())) == {"s": 2, "u": 1}


def test_a_refresh_reads_the_bytes_of_new_files_only(spark, tmp_path):
    folder = tmp_path / "l"
    (folder / "claude.jsonl").mkdir(parents=True)
    write_events(folder / "claude.jsonl" / "a", [{"event_id": str(i), "session_id": f"s{i % 3}"} for i in range(2000)])
    life = Lifetime(spark, str(folder), str(tmp_path / "p"))
    life.refresh()
    os.chmod(folder / "claude.jsonl" / "a", 0)
    write_events(folder / "claude.jsonl" / "b", [{"event_id": "new", "session_id": "s0"}])
    state = life.partials.state()[1]["claude/a"]
    assert life.refresh() == ["claude/b"] and life.partials.state()[1]["claude/a"] == state
    assert sum(r["events"] for r in life.counts().collect()) == 2001
    assert not any("/l/" in x for x in life.counts().inputFiles())


# -- Appending to one file -------------------------------------------------------------------------------------------


def lines(path):
    return [json.loads(x) for x in path.read_text().splitlines() if x.strip()]


def test_appends_and_never_rewrites(spark, tmp_path):
    path = tmp_path / "claude.jsonl"
    path.write_text(json.dumps({"id": -1}) + "\n")
    before = path.read_bytes()
    append.append_events(spark.range(5).repartition(3), str(path), ("id",))
    assert path.read_bytes()[: len(before)] == before
    assert [x["id"] for x in lines(path)] == [-1, 0, 1, 2, 3, 4]
    assert os.listdir(tmp_path) == ["claude.jsonl"]


def test_an_open_last_line_is_closed_first(spark, tmp_path):
    path = tmp_path / "claude.jsonl"
    whole = json.dumps({"event_id": "old", "ts": "2026-08-18T10:00:00Z", "model": "m"})
    path.write_text(whole)  # no end
    rows = spark.createDataFrame([("new", "2026-08-18T10:00:01Z", "m", None)], "event_id string, ts string, model string, cost_estimate_usd double")
    append.append_events(rows, str(path))
    assert [x["event_id"] for x in lines(path)] == ["old", "new"] and "cost_estimate_usd" in lines(path)[1]
    with open(path, "a") as f:
        f.write('{"event_id": "torn", "ts": "2026')
    append.append_events(rows.withColumn("event_id", F.lit("third")), str(path))
    assert sorted(r["event_id"] for r in ledger.read_events(spark, str(path), "anthropic", "claude").collect()) == ["new", "old", "third"]


def test_empty_batches_and_failures_leave_the_ledger_alone(spark, tmp_path):
    path = tmp_path / "claude.jsonl"
    append.append_events(spark.range(0), str(path))
    assert not path.exists() and os.listdir(tmp_path) == []
    path.write_text('{"id": 1}')
    with pytest.raises(Exception, match="no"):
        append.append_events(spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id")), str(path))
    assert path.read_text() == '{"id": 1}'
    append.append_events(spark.range(1), str(path))
    assert path.read_text() == '{"id": 1}\n{"id":0}\n' and os.listdir(tmp_path) == ["claude.jsonl"]


# -- Leases ----------------------------------------------------------------------------------------------------------

COMMENTS = "issue long, id long, at timestamp, kind string, exec_id string, lease_seconds long"
T0 = datetime(2026, 5, 13, 10)


def comment(issue, i, minutes, kind, lease=600):
    return (issue, i, T0 + timedelta(minutes=minutes), kind, f"x{i}", lease)


CASES = [
    comment(1, 1, 0, "claim"), *[comment(1, 10 + k, 10 * k, "heartbeat") for k in range(1, 12)],  # renewed until 11:50
    comment(2, 2, 0, "claim"), comment(2, 20, 100, "note"), comment(2, 21, 110, "heartbeat"),  # nobody came for 15 minutes
    comment(3, 3, 110, "claim"),  # fresh
    comment(4, 4, 60, "heartbeat"),  # never claimed
    comment(5, 5, 0, "claim"), comment(5, 50, 15, "heartbeat"),  # at the very end of its lease
    comment(6, 6, 100, "claim", 60), comment(6, 60, 101, "claim", 6000),  # claimed again
]


def test_leases_by_table(spark):
    rows = spark.createDataFrame(CASES, COMMENTS)
    got = {r["issue"]: (r["exec_id"], r["renewed_at"], r["expired_at"]) for r in leases.expired_by(rows, "2026-05-13 12:00:00").collect()}
    at = lambda m: T0 + timedelta(minutes=m)
    assert got == {2: ("x2", at(0), at(15)), 5: ("x5", at(15), at(30))}


@pytest.mark.parametrize("order", [0, 1])
def test_leases_end_without_an_event(spark, tmp_path, order):
    source = tmp_path / "in"
    schema = spark.createDataFrame([], COMMENTS).schema
    half = T0 + timedelta(minutes=50)
    parts = [[c for c in CASES if c[2] < half], [c for c in CASES if c[2] >= half], [(-1, 0, datetime(2026, 5, 13, 12), "tick", "", 0)]]
    if order:  # disorder within the watermark's delay
        parts = [CASES[::2], CASES[1::2], [(-1, 0, datetime(2026, 5, 13, 16), "tick", "", 0)]]
    for p in parts:
        spark.createDataFrame(p, COMMENTS).coalesce(1).write.mode("append").parquet(str(source))
    comments = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    with leases.timers(spark):
        stream = leases.expiries(comments, delay="4 hours" if order else "0 seconds").writeStream.foreachBatch(ingest.commit_batches(str(tmp_path / "out")))
        stream.option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    out = Folders(spark, str(tmp_path / "out")).rows("issue long, exec_id string, renewed_at timestamp, expired_at timestamp")
    want = leases.expired_by(spark.createDataFrame(CASES, COMMENTS), "2026-05-13 12:00:00")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


# -- Published payloads ----------------------------------------------------------------------------------------------


def test_published_versions_replace_one_another(spark, tmp_path):
    path = str(tmp_path / "payload")
    assert sinks.published(spark, path) is None
    sinks.publish(spark.range(5), path)
    old = sinks.published(spark, path)
    assert old.count() == 5
    failing = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish(failing, path)
    assert sinks.published(spark, path).count() == 5
    sinks.publish(spark.range(2), path)
    assert sinks.published(spark, path).count() == 2 and old.count() == 5  # those who still read the old one may
    for k in range(3):
        sinks.publish(spark.range(k), path)
    assert sinks.published(spark, path).count() == 2
    assert sum(x.startswith("version-") for x in os.listdir(path)) == 3  # two kept, and the one that failed


def test_leases_take_no_rows_that_only_move_time_on(spark, tmp_path, capsys):
    """Such rows move the watermark on, and go no further; before, issues' states were handed them."""
    comments = spark.readStream.schema(COMMENTS).parquet(str(tmp_path))
    leases.expiries(comments).explain(extended=True)
    plan = capsys.readouterr().out.split("Optimized Logical Plan")[1]
    assert -1 < plan.find("heartbeat") < plan.find("EventTimeWatermark")
