"""Mixing sources to target weights.

Sizes are summed for each source (the only shuffle, pre-aggregated where the rows are), each source's repetition rate is
its target over its size, and every document is taken floor(rate) times plus once more if a draw seeded by a hash of its
id falls below the rate's fraction. The draw depends on the id and the seed only: reruns, retries and other partitionings
agree. Nothing but one row for each source meets in one task, and it comes back to the documents by a join on the source.

Targets share the total size by the sources' weights. No source may exceed ``cap`` times its size; what it leaves is
shared again by weight. The end of that is the level L with sum(min(cap * size, L * weight)) = total, found in one pass
over the sources in the order of cap * size / weight.

Null texts have size 0; null sources are a source of their own, after all others; a source of size 0 has target 0 and
rate 0; rows with equal ids share their draw, and a null id draws as the text 'null'. Texts of any length are counted
whole, in Spark. Repeated rows count each for itself. Empty input gives empty output. Rows keep all their columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source; weights repeat over the sources' order."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    w = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("limit", cap * F.col("source_size"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    w = w.withColumn("shared", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # cutting off the sources before it raises the level as long as they are above their limits, and lowers it after that
    w = w.withColumn("level", F.max(F.col("rest") / F.col("shared")).over(every))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    return w.select("source", "source_size", target.alias("target"))


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def planned(
    docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(row, size, source_size, target, times): each row of ``docs`` as a struct, its size, its source's size and target, and
    how often the mix takes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sized = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("key"), F.col(f"`{source_col}`").alias("of"), words(F.col(f"`{text_col}`")).alias("size"))
    targets = source_targets(sized.groupBy(F.col("of").alias("source")).agg(F.sum("size").alias("source_size")), weights, cap)
    joined = sized.join(targets, F.col("of").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw("key", seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row", "size", "source_size", "target", (F.floor(rate) + extra).cast("long").alias("times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    rows = planned(docs, **options).where("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select("row.*")
