"""Orders and running sums of large tables, without a task that sorts a whole table or a whole group.

Rows are dealt into ranges that follow one another (of time, or of a number's magnitude). Work is done within ranges; one
row for each range is put in order afterwards and brings the ranges together. Ranges of time are cut where a sketch of the
rows' quantiles says that about equally many lie between the cuts, so an hour into which everything falls is many ranges.
Ranges of magnitude hold distinct values, counted where the rows are, so a value that most rows have is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import cut

#: Rows of a range of equal depth, and the number of ranges at most.
DEPTH, MOST = 100_000, 1024
#: Lines of a file that are carried forward in one go.
CHUNK = 1 << 16
SECOND = 1_000_000
HOUR = 3600 * SECOND


def micros(a: Column, b: Column) -> Column:
    """Microseconds from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b)


def instant(at: Column | str) -> Column:
    """A TIMESTAMP_NTZ as microseconds, so that ranges are integers."""
    return micros(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at) if isinstance(at, str) else at)


def span(at: Column | str, width: int) -> Column:
    """The number of the range of ``width`` microseconds that an instant lies in."""
    at = F.col(at) if isinstance(at, str) else at
    return ((at - F.pmod(at, F.lit(width))) / width).cast("long")


def magnitude(value: Column) -> Column:
    """A number that never falls as ``value`` grows: 64 ranges for each doubling."""
    size = F.floor(F.log2(F.abs(value)) * 64) + 100_000
    return F.when(value > 0, size).when(value < 0, -size).otherwise(0).cast("long")


def back(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their range; keys may be null."""
    named = ranges.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in ranges.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return rows.join(named, on).drop(*[f"_r_{k}" for k in keys])


def upto(rows: DataFrame, keys: list[str], value: str, size: Column | None = None) -> DataFrame:
    """keys, value, _n, _c: for each distinct value of a group how many of its rows have it or a lower one, and the group's
    rows. Equal values are counted where the rows are. ``size``: a number that orders values by magnitude; without it, the
    value itself (the distinct values of a column that holds no numbers are one range)."""
    own = [*keys, "_range"]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_one"))
    if size is None and isinstance(rows.schema[value].dataType, NumericType):
        size = F.col(value)
    counts = counts.withColumn("_range", F.lit(0).cast("long") if size is None else magnitude(size.cast("double")))
    placed = counts.withColumn("_in", F.sum("_one").over(Window.partitionBy(*own).orderBy(value)))
    w = Window.partitionBy(*keys)
    before = F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = placed.groupBy(*own).agg(F.sum("_one").alias("_rows"))
    ranges = ranges.select(*own, F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("_c"))
    return back(placed, ranges, own).select(*keys, value, (F.col("_before") + F.col("_in")).alias("_n"), "_c")


def at_rank(value: str, rank: Column, where: Column | None = None) -> Column:
    """An aggregate over rows of ``upto``: the value at a rank, counted from 1."""
    reached = F.col("_n") >= rank
    return F.min(F.when(reached if where is None else where & reached, F.col(value)))


def median(value: str, where: Column | None = None) -> Column:
    """An aggregate over rows of ``upto``: the value in the middle, or the mean of the two."""
    return (at_rank(value, F.expr("(_c + 1) div 2"), where) + at_rank(value, F.expr("_c div 2 + 1"), where)) / 2


def nearest_rank(p: float) -> Column:
    """The rank of a percentile: the first value that at least a share p of the rows don't exceed."""
    return F.ceil(F.col("_c") * p - 1e-9)


def row_at(rows: DataFrame, keys: list[str], columns: list[str], rank: Column) -> DataFrame:
    """Of each group the row at a rank (counted from 1, made of _c, the group's rows whose first column isn't null) in the
    order of ``columns``. The rank's value is found among the distinct ones; rows that have it go on to the next column."""
    left = rows.where(F.col(columns[0]).isNotNull())
    asked: DataFrame | None = None
    for k, column in enumerate(columns):
        # (a null tie counts as the least)
        named = left.withColumn("_v", F.struct(F.col(column).isNotNull().alias("has"), F.col(column).alias("is")))
        number = isinstance(rows.schema[column].dataType, NumericType)
        counts = upto(named, keys, "_v", F.coalesce(F.col("_v.is").cast("double"), F.lit(-1.7e308)) if number else None)
        if asked is None:
            counts = counts.withColumn("_rank", rank)
        else:
            counts = back(counts, asked, keys)
        reached = counts.where("_n >= _rank").groupBy(*keys).agg(F.min("_v").alias("_at"), F.min("_rank").alias("_rank"))
        below = back(counts, reached.withColumnRenamed("_rank", "_r"), keys).where("_v < _at").groupBy(*keys).agg(F.max("_n").alias("_below"))
        asked = cut(named_back(reached, below, keys))
        left = cut(back(named, asked.select(*keys, "_at"), keys).where("_v = _at").drop("_v", "_at"))
        asked = asked.select(*keys, "_rank")
    return left.groupBy(*keys).agg(F.first(F.struct(*rows.columns)).alias("_row")).select("_row.*")


def named_back(reached: DataFrame, below: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _at, _rank: the value at the rank, and the rank among the rows that have it."""
    on = reduce(lambda a, k: a & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")), keys, F.lit(True))
    joined = reached.alias("r").join(below.alias("b"), on, "left")
    return joined.select(*[F.col(f"r.{k}") for k in keys], "_at", (F.col("_rank") - F.coalesce("_below", F.lit(0))).alias("_rank"))


def borders(rows: DataFrame, at: str = "at", depth: int = DEPTH) -> list[int]:
    """Instants that cut the rows into ranges of about ``depth`` rows, fewer than MOST: one row of a sketch's quantiles."""
    shares = [k / MOST for k in range(1, MOST)]
    found = rows.agg(F.count(at).alias("n"), F.percentile_approx(at, shares, 10_000).alias("q")).first()
    if not found["n"]:
        return []
    each = max(1, int(MOST * depth / found["n"]))
    return sorted(set(found["q"][each - 1 :: each]))


def ranged(rows: DataFrame, cuts: list[int], at: str = "at", name: str = "_range") -> DataFrame:
    """The rows with the number of their range: how many cuts aren't after them."""
    if not cuts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    splits = [float("-inf"), *map(float, cuts), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_at", outputCol="_to").transform(rows.withColumn("_at", F.col(at).cast("double")))
    return dealt.withColumn(name, F.col("_to").cast("long")).drop("_at", "_to")


def running(points: DataFrame, order: list[str], sums: list[str], depth: int = DEPTH) -> DataFrame:
    """points (at in microseconds, ...) with each column of ``sums`` added up over all points up to each one, and _next, the
    instant of the point after it. Points with equal ``order``, which begins with ``at``, count together."""
    points = cut(points)
    w = Window.partitionBy("_range").orderBy(*order)
    placed = ranged(points, borders(points, depth=depth))
    placed = placed.select(
        "*",
        F.lead("at").over(Window.partitionBy("_range").orderBy(*order)).alias("_next"),
        *[F.sum(c).over(w).alias(f"_in_{c}") for c in sums],
    )
    every = Window.orderBy("_range")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(F.min("at").alias("_first"), *[F.sum(c).alias(f"_all_{c}") for c in sums])
    ranges = ranges.select(
        "_range", F.lead("_first").over(every).alias("_after"),
        *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_before_{c}") for c in sums],
    )
    total = {c: (F.col(f"_before_{c}") + F.col(f"_in_{c}")).alias(c) for c in sums}
    return placed.join(ranges, "_range").select(*[total.get(c, F.col(c)) for c in points.columns], F.coalesce("_next", "_after").alias("_next"))


def carried(
    rows: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = ("file",), order: tuple[str, str] = ("block", "id"), line: str | None = None,
) -> DataFrame:
    """The rows with columns that hold, of each value, the last one that isn't null up to the row, in its file; ``line``: the
    row's number, from 1.

    In two levels, so that no task has a whole file: within chunks, i.e. splits (``order[0]``) cut by the line's number, and
    then from chunk to chunk, of which there is one row each."""
    block, place = order
    own = [*keys, block, "_chunk"]
    named = [f"_v_{k}" for k in values]
    dealt = rows.select("*", *[c.alias(n) for n, c in zip(named, values.values(), strict=True)], F.expr(f"`{place}` div {CHUNK}").alias("_chunk"))
    w = Window.partitionBy(*own).orderBy(place)
    upto_row = w.rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.select(*rows.columns, "_chunk", *[F.last(c, ignorenulls=True).over(upto_row).alias(c) for c in named], F.row_number().over(w).alias("_line"))
    chunks = inner.groupBy(*own).agg(F.max("_line").alias("_lines"), *[F.max_by(c, "_line").alias(f"_c{c}") for c in named])
    before = Window.partitionBy(*keys).orderBy(block, "_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        *own, F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_lines"), *[F.last(f"_c{c}", ignorenulls=True).over(before).alias(f"_c{c}") for c in named],
    )
    joined = back(inner, chunks, own)
    number = [] if line is None else [(F.col("_lines") + F.col("_line")).alias(line)]
    return joined.select(*rows.columns, *number, *[F.coalesce(c, f"_c{c}").alias(k) for k, c in zip(values, named, strict=True)])
