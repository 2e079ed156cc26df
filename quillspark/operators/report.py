"""Reports as Markdown, made as rows of lines: whatever the number of models and days, Spark writes and sorts them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as n
from . import rollup

# The report's words.
TITLE = "## Claude + Codex + OpenClaw + OpenCode stats: {0}"
HEADS = ("| {0} | Calls | In tok | Out tok | Cache hit % | API cost ($) |", "|---|---|---|---|---|---|")


def money(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def row_line(label: Column) -> Column:
    """A table's row for measures."""
    hit = F.rint(rollup.cache_hit_percent(F.col("cache_read_tokens"), F.col("input_tokens"))).cast("long").cast("string")
    numbers = [F.format_number(c, 0) for c in ("calls", "input_tokens", "output_tokens")]
    cells = [label, *numbers, F.concat(hit, F.lit("%")), money(F.col("cost_estimate_usd"))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def summary(events: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """part, key, line: the report of a deduplicated window, in the order of part and key. No events give one line."""
    first, last = date.fromisoformat(str(start)), date.fromisoformat(str(end))
    days = (last - first).days + 1
    spark = events.sparkSession
    of = f"{first} (1 day)" if days == 1 else f"{first}..{last} ({days} days)"
    fixed = [(0, "0", TITLE.format(of)), (0, "1", ""), (1, "0", HEADS[0].format("Model")), (1, "1", HEADS[1])]
    if days > 1:
        fixed += [(6, "0", ""), (6, "1", "### Daily aggregates"), (6, "2", ""), (6, "3", HEADS[0].format("Date")), (6, "4", HEADS[1])]
    lines = spark.createDataFrame(fixed, "part int, key string, line string")
    models = rollup.by_model(events)
    total = F.col("provider").isNull()
    name = n.provider_model(F.col("provider"), F.col("model"))
    rows = models.select(F.when(total, 3).otherwise(2).alias("part"), F.when(total, "").otherwise(name).alias("key"), row_line(F.when(total, "**Total**").otherwise(name)).alias("line"))
    unknown = F.col("unknown_pricing_events")
    each = F.array_sort(F.collect_list(F.when(~total & (unknown > 0), F.concat(name, F.lit(": "), unknown.cast("string")))))
    note = models.agg(each.alias("each"), F.sum(F.when(~total, unknown)).alias("all")).where("all > 0").select(
        F.explode(F.array(
            F.struct(F.lit("0").alias("key"), F.lit("").alias("line")),
            F.struct(F.lit("1").alias("key"), F.concat(
                F.lit("Unknown pricing note: "), F.col("all").cast("string"), F.lit(" events have unknown pricing and are counted as $0 in totals ("),
                F.array_join("each", ", "), F.lit(")."),
            ).alias("line")),
        )).alias("x"),
    ).select(F.lit(4).alias("part"), "x.*")
    cost = models.where(total).select(F.col("cost_estimate_usd").alias("cost"))
    both = cost.crossJoin(rollup.subscription_cost(events, days).select(F.col("subscription_usd").alias("paid")))  # one row each
    saved = F.col("cost") >= F.col("paid")
    gap = money(F.abs(F.col("cost") - F.col("paid")))
    owed = F.concat(F.lit("If paid by API rates would owe $"), money(F.col("cost")), F.lit("; subscription costs $"), money(F.col("paid")), F.lit(" for this period; "))
    texts = [
        F.lit(""), F.concat(F.lit("**Period API cost**: $"), money(F.col("cost"))), F.concat(F.lit("**Subscriptions prorated**: $"), money(F.col("paid"))),
        F.when(saved, F.concat(F.lit("**Savings vs API rates**: $"), gap, F.lit(" ✅"))).otherwise(F.concat(F.lit("**Subscription not fully used**: $"), gap)),
        F.concat(owed, F.when(saved, "saved $").otherwise("unused subscription value $"), gap, F.lit(".")),
    ]
    costs = both.select(F.posexplode(F.array(*texts)).alias("k", "line")).select(F.lit(5).alias("part"), F.col("k").cast("string").alias("key"), "line")
    out = lines.unionByName(rows).unionByName(note).unionByName(costs)
    if days > 1:
        daily = rollup.by_day(events).select(F.lit(7).alias("part"), F.col("event_date").cast("string").alias("key"), row_line(F.col("event_date").cast("string")).alias("line"))
        out = out.unionByName(daily)
    nothing = events.limit(1).count() == 0
    return spark.createDataFrame([(0, "0", "No events in period")], "part int, key string, line string") if nothing else out.orderBy("part", "key")
