"""Work in ranges of time and of magnitude against brute force over whole lists."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import attribution, ordered, runs, timegap

T0 = datetime(2026, 5, 10)
MINUTE = 60_000_000


@pytest.mark.parametrize("depth", [3, 40, 10**6])
def test_owners(spark, depth):
    """Sessions of one to nine events on a grid of minutes, so that ties are common; folders inside one, two or no repositories."""
    r = random.Random(depth)
    sessions, events = [], []
    for k in range(60):
        start = r.randrange(600)
        times = [start, *(start + r.randrange(r.choice([1, 30, 400])) for _ in range(r.randrange(9)))]
        folder = r.choice([None, "/x", "/r/a", "/r/a/deep/", "C:\\R\\A\\b", "/r/ab"])
        sessions.append((f"s{k:02}", T0 + timedelta(minutes=min(times)), T0 + timedelta(minutes=max(times)), float(k % 7), folder))
        events += [(f"s{k:02}", T0 + timedelta(minutes=t)) for t in times]
    commits = [(r.choice(["/r", "/r/a/", "c:/r/a", "/none"]), f"h{k}", T0 + timedelta(minutes=r.randrange(1100)), k % 5) for k in range(250)]
    norm = lambda p: p.replace("\\", "/").lower().rstrip("/")
    want, sums = {}, {s[0]: [0, 0] for s in sessions}
    for repo, h, at, lines in commits:
        found = []
        for sid, start, end, _, folder in sessions:
            if start <= at <= end:
                sums[sid][0] += 1
                sums[sid][1] += lines
                near = folder is not None and (norm(folder) == norm(repo) or norm(folder).startswith(norm(repo) + "/"))
                found.append((not near, min(abs(at - t) for s, t in events if s == sid), start, sid))
        if found:
            _, gap, _, sid = min(found)
            want[repo, h] = (sid, gap // timedelta(microseconds=1))
    s = spark.createDataFrame(sessions, "session_id string, start timestamp_ntz, end timestamp_ntz, cost double, working_dir string")
    e = spark.createDataFrame(events, "session_id string, ts timestamp_ntz")
    c = spark.createDataFrame(commits, "repo string, hash string, committed_at timestamp_ntz, lines long")
    got = {(x["repo"], x["hash"]): (x["session_id"], x["gap"]) for x in attribution.owners(s, e, c, depth).collect()}
    assert got == want
    costs = {x["session_id"]: [x["commits"], x["lines"]] for x in attribution.session_costs(s, c, depth).collect()}
    assert costs == sums
    assert attribution.owners(s, e, c.where("false"), depth).count() == 0
    assert attribution.owners(s.where("false"), e, c, depth).count() == 0


def test_owners_are_sought_once_for_an_instant(spark, monkeypatch):
    """commits at one instant, and stretches of no length, make no rows of their own in the pass; batches may be small."""
    events = [(f"s{k}", T0 + timedelta(minutes=t)) for k in range(20) for t in (k, k + 5, k + 5, k + 400)]
    e = spark.createDataFrame(events, "session_id string, ts timestamp_ntz")
    s = e.groupBy("session_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end")).withColumn("cost", F.lit(1.0)).withColumn("working_dir", F.lit("/r/a"))
    c = spark.range(2000).select(
        F.lit("/r").alias("repo"), F.col("id").cast("string").alias("hash"), F.lit(1).cast("long").alias("lines"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") % 5 * 100).cast("int"))).alias("committed_at"),
    )
    # a commit that is listed twice is one commit
    c = c.unionByName(c.where("hash = '7'"))
    rows, of = spark.sparkContext.accumulator(0), attribution.nearest

    def counted(batches):
        def each():
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        yield from of(each())

    monkeypatch.setattr(attribution, "nearest", counted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        own = {int(r["hash"]): (r["session_id"], r["gap"] // MINUTE) for r in attribution.owners(s, e, c, 10**6).collect()}
        seen = rows.value
        repos = [tuple(r) for r in attribution.by_repo(s, e, c, 0.01).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in range(5):
        at = T0 + timedelta(minutes=100 * k)
        within = [(min(abs(at - t) for n, t in events if n == f"s{i}"), i) for i in range(20) if i <= 100 * k <= i + 400]
        if within:
            gap, i = min(within)
            want |= {h: (f"s{i}", gap // timedelta(minutes=1)) for h in range(k, 2000, 5)}
    assert own == want
    # two scopes: five instants and two stretches of each session
    assert seen == 2 * (5 + 20 * 2)
    assert [(r[0], r[2]) for r in repos] == [("/r", len(want))]


@pytest.mark.parametrize("width", [3 * MINUTE, ordered.HOUR, 10**13])
def test_gaps_and_unions(spark, width):
    r = random.Random(3)
    rows = [(r.choice("ab"), T0 + timedelta(minutes=r.randrange(2000))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    want = {}
    for k in "ab":
        times = sorted(t for x, t in rows if x == k)
        want[k] = (len(times), sum((b - a).total_seconds() for a, b in zip(times, times[1:]) if (b - a).total_seconds() <= 600) / 3600)
    got = {x["k"]: (x["events"], pytest.approx(x["active_hours"])) for x in timegap.gaps_by(df, ["k"], 10, width).collect()}
    assert got == want
    spans = [(T0 + timedelta(minutes=(a := r.randrange(3000))), T0 + timedelta(minutes=a + r.choice([0, 1, 50, 500]))) for _ in range(40)]
    minutes = {m for a, b in spans for m in range(int((a - T0).total_seconds()) // 60, int((b - T0).total_seconds()) // 60)}
    df = spark.createDataFrame(spans, "start timestamp_ntz, end timestamp_ntz")
    for depth in (2, 17, 10**6):
        assert timegap.union_hours(df, depth).first()["hours"] == pytest.approx(len(minutes) / 60)


@pytest.mark.parametrize("limit", [0, 0.001, 0.01, 1])
def test_gaps_below_a_second(spark, limit):
    r = random.Random(4)
    times = sorted(T0 + timedelta(microseconds=r.randrange(r.choice([2_000_000, 90_000_000]))) for _ in range(500))
    df = spark.createDataFrame([(t,) for t in times + times[:50]], "ts timestamp_ntz")
    want = sum(d for a, b in zip(times, times[1:]) if (d := (b - a).total_seconds()) <= limit * 60) / 3600
    row = timegap.gaps_by(df, [], limit).first()
    assert row["active_hours"] == pytest.approx(want) and row["events"] == 550 and (row["start"], row["end"]) == (times[0], times[-1])


def test_an_hour_that_holds_everything_is_many_ranges(spark):
    rows = spark.range(200_000).select((F.lit(1_700_000_000_000_000) + F.pmod(F.xxhash64("id"), F.lit(3_000_000))).alias("at"), F.lit(1).alias("open"))
    cuts = ordered.borders(rows, depth=1000)
    assert 150 < len(cuts) < 300
    sizes = [r["count"] for r in ordered.ranged(rows, cuts).groupBy("_range").count().collect()]
    assert max(sizes) < 2 * 200_000 / len(sizes)
    # seconds, whatever the number of rows
    last = ordered.running(rows, ["at"], ["open"], 1000).agg(F.max("open"), F.count("*")).first()
    assert tuple(last) == (200_000, 200_000)


def test_a_row_in_the_middle_among_many_equal_ones(spark):
    r = random.Random(6)
    rows = [(r.choice(["x", None]), r.choice([0.0, 0.0, 0.0, 1.5, -2.0]), r.choice([None, *range(40)]), f"t{i}") for i in range(300)] + [("x", None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, v double, tie long, name string")
    got = {x["k"]: (x["v"], x["tie"], x["name"]) for x in runs.lower_median(df, ["k"], "v", ("tie", "name")).collect()}
    for key in ("x", None):
        order = sorted((v, -1 if t is None else t, n) for k, v, t, n in rows if k == key and v is not None)
        v, t, n = order[(len(order) - 1) // 2]
        assert got[key] == (v, None if t == -1 else t, n)


def test_ranks(spark):
    r = random.Random(8)
    rows = [(r.choice(["x", "y", None]), r.choice([0.0, -1.5, 2.25, r.random(), -r.random() * 1e6, 1e300, 1e-300])) for _ in range(400)] + [("x", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for key in ("x", "y", None):
        values = sorted(v for k, v in rows if k == key and v is not None)
        found = ordered.upto(df.where(F.col("k").eqNullSafe(key)), ["k"], "v")
        row = found.groupBy("k").agg(ordered.median("v").alias("m"), ordered.at_rank("v", ordered.nearest_rank(0.95)).alias("p")).first()
        n = len(values)
        assert row["m"] == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2) and row["p"] == values[-(-n * 95 // 100) - 1]
    assert {x["k"] for x in runs.lower_median(df, ["k"], "v").collect()} == {None, "x", "y"}
