"""Deduplication: the first row of a group, by the order of the ledger, survives.

Filters by day or provider come before it: which row survives depends on the window that is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

from ..functions.normalize import blank_to_null

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "cached_input_tokens", "reasoning_tokens", "total_tokens")


# What makes two calls of a vendor the same, and the provider of calls that name none.
SEMANTIC_KEYS = {
    "codex": ("openai", ("session_id", "model", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens", "total_tokens")),
    "openclaw": (
        "openrouter",
        ("session_id", "response_id", "model", "input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens", "total_tokens"),
    ),
    "opencode": (
        "opencode",
        ("session_id", "message_id", "model", "input_tokens", "cache_read_tokens", "cache_creation_tokens", "output_tokens", "reasoning_tokens", "total_tokens"),
    ),
}


def semantic_key(vendor: str, provider: str = "provider") -> Column:
    """A text that two calls of a vendor share if they are the same; absent parts are parts of their own."""
    default, parts = SEMANTIC_KEYS[vendor]
    named = F.coalesce(blank_to_null(F.col(provider)), F.lit(default))
    return F.to_json(F.array(named, *[F.col(p).cast("string") for p in parts]))


def dedupe_group(event_id: Column, tracking_id: Column, parts: list[Column]) -> Column:
    """``event_id:…`` for a row that has an id of its own, else a legacy key of the given parts."""
    own = F.coalesce(blank_to_null(event_id), blank_to_null(tracking_id))
    return F.when(
        own.isNotNull(), F.concat(F.lit("event_id:"), own),
    ).otherwise(F.concat(F.lit("legacy:"), F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each group of ``keys``; nulls are one value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def dedup_events(events: DataFrame) -> DataFrame:
    return first_wins(events, ["dedupe_group"], ["ord"])


def semantic_dedup(events: DataFrame, keys: list[str]) -> DataFrame:
    """All rows with ``dropped``: whether an earlier row has the same semantic key."""
    w = Window.partitionBy(*keys).orderBy("ord")
    return events.withColumn("dropped", F.row_number().over(w) > 1)


def new_only(batch: DataFrame, known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch whose key isn't known, the first of each."""
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    return first_wins(batch.alias("b").join(known.select(*keys).distinct().alias("k"), same, "left_anti"), keys, order)


def import_dedup(batch: DataFrame, known: DataFrame, id_col: str, key_col: str, order: str) -> DataFrame:
    """Rows of a batch that repeat neither an id nor a semantic key, of the table or of a row accepted before them.

    In order, an accepted row registers both and a dropped one neither. Each round accepts the rows that are first in
    both their groups and drops what shares an id or a key with them; chains of rows are short, so rounds are few."""
    left = batch.join(known.select(id_col).distinct(), id_col, "left_anti").join(known.select(key_col).distinct(), key_col, "left_anti").select(batch.columns)
    accepted = left.where("false")
    while True:
        by_id, by_key = Window.partitionBy(id_col), Window.partitionBy(key_col)
        marked = left.withColumn("_i", F.min(order).over(by_id)).withColumn("_k", F.min(order).over(by_key))
        new = cut(marked.where((F.col("_i") == F.col(order)) & (F.col("_k") == F.col(order))).drop("_i", "_k"))
        if new.isEmpty():
            return accepted
        accepted = accepted.unionByName(new)
        rest = left.join(new.select(id_col), id_col, "left_anti").join(new.select(key_col), key_col, "left_anti")
        left = cut(rest.select(batch.columns))
