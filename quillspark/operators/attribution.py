"""What commits cost: sessions and commits joined by time.

``sessions``: session_id, start, end, cost, working_dir. ``commits``: repo, hash, committed_at, lines. ``events``:
session_id, ts. Sessions and the commits made while they last never meet as pairs: sums over a session are differences of
running sums, and a commit's owner is found by one pass over ranges of time (see ``around``). A range of time, which holds
about ``depth`` rows, is the unit of work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import DEPTH, at_rank, borders, instant, ranged, running, upto

#: Later than any instant.
NEVER = 2**62


def session_costs(sessions: DataFrame, commits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """session_id, cost, commits, lines, cost_per_line: a commit counts for every session around it, both ends included.

    Commits are added up over time once; a session takes the sums up to its end less those before its start."""
    sessions = cut(sessions.select("session_id", "start", "end", "cost"))
    # at one instant: sessions' starts, commits, sessions' ends
    ends = F.array(F.struct(instant("start").alias("at"), F.lit(-1).alias("side")), F.struct(instant("end").alias("at"), F.lit(1).alias("side")))
    own = sessions.where("start <= end").select("session_id", F.explode(ends).alias("p")).select(
        "session_id", "p.*", F.lit(0).cast("long").alias("commits"), F.lit(0).cast("long").alias("lines"),
    )
    made = commits.where("committed_at is not null").select(
        F.lit(None).cast(sessions.schema["session_id"].dataType).alias("session_id"), instant("committed_at").alias("at"),
        F.lit(0).alias("side"), F.lit(1).cast("long").alias("commits"), F.coalesce("lines", F.lit(0)).cast("long").alias("lines"),
    )
    sums = running(own.unionByName(made), ["at", "side"], ["commits", "lines"], depth).where("side <> 0")
    sums = sums.groupBy("session_id").agg(*[F.sum(F.col(c) * F.col("side")).alias(c) for c in ("commits", "lines")])
    joined = sessions.select("session_id", "cost").join(sums, "session_id", "left")
    joined = joined.select("session_id", "cost", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("commits", "lines")])
    return joined.withColumn("cost_per_line", F.when(F.col("lines") > 0, F.col("cost") / F.col("lines")))


def rank_percentile(df: DataFrame, value: str, p: float) -> DataFrame:
    """One row, threshold: the value at rank ceil((n - 1) * p), counted from 0, in ascending order."""
    return upto(df, [], value).agg(at_rank(value, F.ceil((F.col("_c") - 1) * p - 1e-6) + 1).alias("threshold"))


def expensive(costs: DataFrame, p: float = 0.9, most: int = 5) -> DataFrame:
    """The sessions with lines whose cost per line is at the percentile or above it: the highest ones."""
    rows = costs.where("cost_per_line is not null")
    return rows.crossJoin(F.broadcast(rank_percentile(rows, "cost_per_line", p))).where("cost_per_line >= threshold").orderBy(F.desc("cost_per_line"), "session_id").limit(most)  # the threshold is one row


def normal_dir(path: Column) -> Column:
    return F.rtrim(F.lower(F.translate(path, "\\", "/")), F.lit("/"))


def inside(folder: Column, repo: Column) -> Column:
    d, r = normal_dir(folder), normal_dir(repo)
    return F.coalesce((d == r) | F.startswith(d, F.concat(r, F.lit("/"))), F.lit(False))


def folders(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """working_dir, repos: the repositories (as ``normal_dir`` writes them) that a folder is inside, at most one for each of
    its parts."""
    part = F.split(normal_dir(F.col("working_dir")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(part)), lambda k: F.array_join(F.slice(part, F.lit(1), k), "/"))
    each = sessions.where("working_dir is not null").select("working_dir").distinct().select("working_dir", F.explode(above).alias("repo"))
    return each.join(
        commits.select(normal_dir(F.col("repo")).alias("repo")).distinct(), "repo",
    ).groupBy("working_dir").agg(F.collect_set("repo").alias("repos"))


def stretches(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """session_id, start, working_dir, lo, hi, a, b: each session cut at its events; from lo to hi the last event is at a (or
    there was none) and the next one at b (or there is none). Events outside of their session are left out, and so are
    stretches of no length but a session's first: the event they are at ends the stretch before."""
    own = sessions.select("session_id", "working_dir", instant("start").alias("start"), instant("end").alias("end"))
    marks = events.select("session_id", instant("ts").alias("a")).join(own, "session_id").where("a between start and end")
    w = Window.partitionBy("session_id").orderBy("a")
    marks = marks.withColumn("b", F.lead("a").over(w)).withColumn("_nth", F.row_number().over(w)).where("_nth = 1 or a < coalesce(b, end)")
    none = F.lit(None).cast("long")
    after = F.struct(F.col("a").alias("lo"), F.coalesce("b", "end").alias("hi"), F.col("a").alias("a"), F.col("b").alias("b"))
    before = F.struct(F.col("start").alias("lo"), F.col("a").alias("hi"), none.alias("a"), F.col("a").alias("b"))
    pieces = F.when((F.col("_nth") == 1) & (F.col("start") < F.col("a")), F.array(before, after)).otherwise(F.array(after))
    return marks.select("session_id", "start", "working_dir", F.explode(pieces).alias("p")).select("session_id", "start", "working_dir", "p.*")


class Best:
    """For each of a group's instants the stretch around it that comes first, of those seen so far: least v, then start, then
    session_id."""

    def __init__(self, at: np.ndarray) -> None:
        self.at = at
        self.v, self.start = np.full(len(at), NEVER), np.full(len(at), NEVER)
        self.session = np.full(len(at), None, object)

    def see(self, rows: pa.Table, i: np.ndarray, j: np.ndarray) -> None:
        """rows: v, start, session_id of stretches around the instants number i to j."""
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("v", "start", "session_id")]).to_numpy()
        n = len(order)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        # two blocks of a power of two cover each stretch's instants; blocks hand what they have down to their halves
        level = np.frexp(j - i + 1)[1] - 1
        least = np.full((int(level.max()) + 1, len(self.at)), n)
        np.minimum.at(least, (level, i), rank)
        np.minimum.at(least, (level, j + 1 - (1 << level)), rank)
        for k in range(len(least) - 1, 0, -1):
            half = 1 << (k - 1)
            np.minimum(least[k - 1], least[k], out=least[k - 1])
            np.minimum(least[k - 1][half:], least[k][:-half], out=least[k - 1][half:])
        at = np.flatnonzero(least[0] < n)
        row = order[least[0][at]]
        which, back = np.unique(row, return_inverse=True)
        session = np.empty(len(which), object)
        session[:] = rows["session_id"].take(pa.array(which)).to_pylist()
        v, start, session = rows["v"].to_numpy()[row], rows["start"].to_numpy()[row], session[back]
        first = (v < self.v[at]) | (v == self.v[at]) & (start < self.start[at])
        for k in np.flatnonzero((v == self.v[at]) & (start == self.start[at])):
            first[k] = session[k] < self.session[at[k]]
        at = at[first]
        self.v[at], self.start[at], self.session[at] = v[first], start[first], session[first]


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each instant asked for the stretch around it that began last and the one that ends first, with the gap to that event.

    Rows: range, near, repo (a group), piece (whether it is a stretch), lo, hi, a, b, start, session_id; a group's instants
    (in lo) come before its stretches, in order. A task holds the instants of a group, and a batch of stretches."""
    names = ["near", "repo", "at", "gap", "start", "session_id"]
    group: tuple | None = None
    asked: list[np.ndarray] = []
    late: Best | None = None
    soon: Best | None = None
    kind: pa.DataType | None = None

    def found() -> Iterator[pa.RecordBatch]:
        for best, sign in ((late, 1), (soon, -1)):
            if best is not None:
                k = np.flatnonzero(best.v < NEVER)
                gap = best.v[k] + sign * best.at[k]
                columns = [pa.array([group[1]] * len(k), pa.bool_()), pa.array([group[2]] * len(k), pa.string())]
                columns += [pa.array(x) for x in (best.at[k], gap, best.start[k])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best.session[k].tolist(), kind)], names)

    for batch in batches:
        kind = batch.column(9).type
        own = [batch.column(k) for k in range(4)]
        cuts = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in own:
            cuts |= pc.not_equal(c.slice(1), c.slice(0, max(batch.num_rows - 1, 0))).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(cuts) + 1).tolist(), batch.num_rows]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            *key, piece = (c[x].as_py() for c in own)
            if tuple(key) != group:
                yield from found()
                group, asked, late, soon = tuple(key), [], None, None
            rows = batch.slice(x, y - x)
            if not piece:
                asked.append(rows.column(4).to_numpy())
                continue
            if not asked:
                continue
            if late is None:
                at = np.concatenate(asked)
                late, soon = Best(at), Best(at)
            i = np.searchsorted(late.at, rows.column(4).to_numpy(), "left")
            j = np.searchsorted(late.at, rows.column(5).to_numpy(), "right") - 1
            for best, column, sign in ((late, rows.column(6), -1), (soon, rows.column(7), 1)):
                k = np.flatnonzero((i <= j) & column.is_valid().to_numpy(zero_copy_only=False))
                if len(k):
                    v = column.take(pa.array(k)).to_numpy() * sign
                    best.see(pa.table({"v": v, "start": rows.column(8).take(pa.array(k)), "session_id": rows.column(9).take(pa.array(k))}), i[k], j[k])
    yield from found()


def around(sessions: DataFrame, events: DataFrame, asked: DataFrame, depth: int = DEPTH) -> DataFrame:
    """near, repo, at, gap, start, session_id: for each instant asked for (near, repo, at; distinct) the session with the
    nearest event, among those inside the repository if ``near``; then the one that started first.

    A session's nearest event begins or ends the stretch between its events that the instant lies in, so only the stretch
    that began last and the one that ends first can win. Stretches go to the ranges of time that they begin and end in. Of
    those that last throughout a range the two are kept for each block of ranges (a power of two), by an aggregate."""
    asked = cut(asked)
    pieces = stretches(sessions, events).join(folders(sessions, asked.where("near")), "working_dir", "left")
    pieces = cut(pieces.select("lo", "hi", "a", "b", "start", "session_id", F.coalesce("repos", F.array().cast("array<string>")).alias("repos")))
    cuts = borders(asked.select("at").unionByName(pieces.select(F.explode(F.array("lo", "hi")).alias("at"))), depth=depth)
    pieces = ranged(ranged(pieces, cuts, "lo", "first"), cuts, "hi", "last")
    edge = pieces.withColumn("range", F.explode(F.array_distinct(F.array("first", "last")))).drop("first", "last")
    # what lasts throughout ranges: one row for equal ones, then for each block
    late = F.min(F.when(F.col("a").isNotNull(), F.struct((-F.col("a")).alias("v"), "start", "session_id"))).alias("late")
    soon = F.min(F.when(F.col("b").isNotNull(), F.struct(F.col("b").alias("v"), "start", "session_id"))).alias("soon")
    through = pieces.where(F.col("last") - F.col("first") > 1).groupBy("repos", "first", "last").agg(late, soon)
    through = through.withColumn("level", F.floor(F.log2(F.col("last") - F.col("first") - 1)).cast("int"))
    through = through.withColumn("wide", F.expr("shiftleft(1L, level)"))
    blocks = through.withColumn("block", F.explode(F.array_distinct(F.array(F.col("first") + 1, F.col("last") - F.col("wide")))))
    blocks = blocks.groupBy("repos", "wide", "block").agg(F.min("late").alias("late"), F.min("soon").alias("soon"))
    none = F.lit(None).cast("long")
    two = F.array(
        F.struct((-F.col("late.v")).alias("a"), none.alias("b"), "late.start", "late.session_id"),
        F.struct(none.alias("a"), F.col("soon.v").alias("b"), "soon.start", "soon.session_id"),
    )
    blocks = blocks.withColumn("range", F.explode(F.sequence("block", F.col("block") + F.col("wide") - 1)))
    blocks = blocks.select("repos", "range", F.explode(two).alias("x")).where("x.session_id is not null").select(
        F.lit(-NEVER).alias("lo"), F.lit(NEVER).alias("hi"), "x.*", "repos", "range",
    )
    scopes = F.concat(
        F.array(F.struct(F.lit(False).alias("near"), F.lit("").alias("repo"))),
        F.transform("repos", lambda r: F.struct(F.lit(True).alias("near"), r.alias("repo"))),
    )
    columns = ["range", "near", "repo", "piece", "lo", "hi", "a", "b", "start", "session_id"]
    dealt = edge.unionByName(blocks).withColumn("s", F.explode(scopes)).select("*", "s.*", F.lit(True).alias("piece")).select(columns)
    session = sessions.schema["session_id"].dataType
    points = ranged(asked, cuts, "at", "range").select(
        "range", "near", "repo", F.lit(False).alias("piece"), F.col("at").alias("lo"), F.col("at").alias("hi"), none.alias("a"),
        none.alias("b"), F.lit(0).cast("long").alias("start"), F.lit(None).cast(session).alias("session_id"),
    )
    dealt = points.unionByName(dealt).repartition(*columns[:3]).sortWithinPartitions(*columns[:5])
    close = dealt.mapInArrow(nearest, f"near boolean, repo string, at long, gap long, start long, session_id {session.simpleString()}")
    best = F.min(F.struct("gap", "start", "session_id")).alias("o")
    return close.groupBy("near", "repo", "at").agg(best).select("near", "repo", "at", "o.*")


def owned(sessions: DataFrame, events: DataFrame, commits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """repo, hash, session_id, gap, lines (if ``commits`` has them): each commit's one session: of those around it, sessions
    working inside the repository before others, then the one with the nearest event (gap in microseconds), then the one
    that started first. A repository's commits at one instant have one owner, which is looked for once."""
    commits = commits.where("committed_at is not null").withColumn("at", instant("committed_at"))
    instants = cut(commits.select("repo", "at").distinct())
    both = F.array(F.struct(F.lit(False).alias("near"), F.lit("").alias("folder")), F.struct(F.lit(True).alias("near"), normal_dir(F.col("repo")).alias("folder")))
    wanted = instants.select("repo", "at", F.explode(both).alias("s")).where("s.folder is not null").select("repo", "at", "s.*")
    asked = wanted.select("near", F.col("folder").alias("repo"), "at").distinct()
    found = around(sessions, events, asked, depth).withColumnRenamed("repo", "folder")
    order = F.struct((~F.col("near")).alias("far"), "gap", "start", "session_id")
    found = wanted.join(found, ["near", "folder", "at"]).groupBy("repo", "at").agg(F.min(order).alias("o"))
    # (rows of one commit at several instants are one commit)
    more = [c for c in ("lines",) if c in commits.columns]
    named = F.struct("o.*", *more)
    of = commits.alias("c").join(found.alias("f"), F.col("c.repo").eqNullSafe(F.col("f.repo")) & (F.col("c.at") == F.col("f.at")))
    of = of.select("c.*", "o").groupBy("repo", "hash").agg(F.min(named).alias("o"))
    return of.select("repo", "hash", *[f"o.{c}" for c in ("session_id", "gap", *more)])


def owners(sessions: DataFrame, events: DataFrame, commits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """repo, hash, session_id, gap: the owner of each commit (see ``owned``)."""
    return owned(sessions, events, commits.select("repo", "hash", "committed_at"), depth)


def by_repo(sessions: DataFrame, events: DataFrame, commits: DataFrame, threshold: float) -> DataFrame:
    """repo, sessions with lines, lines, and sessions that are expensive (cost per line at the threshold or above)."""
    per = owned(sessions, events, commits).groupBy("repo", "session_id").agg(F.sum("lines").alias("lines")).where("lines > 0")
    per = per.join(sessions.select("session_id", "cost"), "session_id")
    dear = (F.col("cost") / F.col("lines") >= threshold).cast("long")
    return per.groupBy("repo").agg(F.count("*").alias("sessions"), F.sum("lines").alias("lines"), F.sum(dear).alias("expensive_sessions"))


def shortstat(text: Column) -> Column:
    """struct(files, insertions, deletions) of git's --shortstat line."""
    number = lambda p: F.coalesce(n_or_null(F.regexp_extract(text, p, 1)), F.lit(0))
    n_or_null = lambda c: F.nullif(c, F.lit("")).cast("int")
    return F.struct(
        number(r"(\d+) files? changed").alias("files"), number(r"(\d+) insertions?").alias("insertions"),
        number(r"(\d+) deletions?").alias("deletions"),
    )
