"""Tasks and leases as they are written in issues: envelopes with a digest, claims and heartbeats in comments.

An envelope is a JSON object between two HTML comments, the first of which has its digest. The digest is that of the object's
canonical form: keys in order, no spaces, signs as they are. Marks begin with a deployment's own prefix, which may be any.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# The marks and fields of tasks.
OPEN = r"<!--\s*[\w.]+-task:v1\s+sha256=([0-9a-fA-F]{64})\s*-->"
CLOSE = r"<!-- /[\w.]+-task:v1 -->"
CLAIM = r"<!--\s*[\w.]+-claim:v1\s+host=(\S+)\s+exec=(\S+)\s+claimed_at=(\S+)\s+lease_seconds=(\d+)\s*-->"
HEARTBEAT = r"<!--\s*[\w.]+-hb:v1\s+exec=(\S+)\s+ts=(\S+)\s*-->"
TEXT_FIELDS = ("task_id", "kind", "target_host", "payload_ref", "idempotency_key", "created_at")
VERSION = 1


def canonical(body: str | None) -> str | None:
    """The canonical form of a JSON object; None for what isn't one."""
    try:
        task = json.loads(body or "")
    except (json.JSONDecodeError, RecursionError):
        return None
    return json.dumps(task, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if isinstance(task, dict) else None


@F.pandas_udf(ArrayType(StructType([StructField("task", StringType()), StructField("digest", StringType())])))
def canonicals(bodies: pd.Series) -> pd.Series:
    """Each body's canonical form and its digest, nulls for what is no object."""

    def one(body: str | None) -> tuple[str | None, str | None]:
        task = canonical(body)
        return task, task and hashlib.sha256(task.encode("utf-8", "surrogatepass")).hexdigest()

    return bodies.map(lambda x: [] if x is None else [dict(zip(("task", "digest"), one(b), strict=True)) for b in x])


def valid(task: Column) -> Column:
    """Whether a JSON object has a task's fields: texts that aren't blank, a digest of the payload, a lease of whole seconds
    above 0, and a time."""
    # (parsed once, as the one element of an array)
    return F.get(F.transform(F.array(F.try_parse_json(task)), lambda v: has_fields(v, task)), F.lit(0))


def has_fields(v: Column, task: Column) -> Column:
    kind = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    text = lambda key: F.when(kind(key) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    good = F.lit(True)
    for field in TEXT_FIELDS:
        good = good & F.coalesce(text(field).rlike(r"(?U)\S"), F.lit(False))
    good = good & F.coalesce(text("payload_sha256").rlike(r"^[0-9a-fA-F]{64}\z"), F.lit(False))
    # (a whole number of any size is BIGINT or a decimal without a fraction; 600.0 is written with one)
    written = F.regexp_extract(task, r'"lease_seconds":(-?\d+)(?=[,}])', 1)
    good = good & (written != "") & F.coalesce(F.try_variant_get(v, "$.lease_seconds", "decimal(38,0)") > 0, F.lit(False))
    return good & F.try_to_timestamp(F.regexp_replace(text("created_at"), "Z$", "+00:00")).isNotNull()


def envelopes(rows: DataFrame, text_col: str = "body") -> DataFrame:
    """The rows with ``verified`` (whether the first envelope's digest is its object's) and ``task`` (the first object, in
    canonical form, with the right digest and a task's fields; null if none is, or if a newer version comes before it)."""
    # what stands after each opening mark, up to the first closing one; marks may stand in one another
    opened = F.regexp_extract_all(text_col, F.lit(OPEN), F.lit(1))
    ends = F.slice(F.split(F.coalesce(text_col, F.lit("")), OPEN), 2, F.size(opened) + 1)
    marks = F.regexp_extract_all(text_col, F.lit(OPEN), F.lit(0))
    rest = F.transform(
        ends, lambda _, i: F.aggregate(
            F.sequence(i, F.size(ends) - 1), F.lit(""),
            lambda a, k: F.concat(a, F.when(k > i, F.get(marks, k)).otherwise(F.lit("")), F.get(ends, k)),
        ),
    )
    # (an envelope without an end is none)
    closed = F.filter(F.arrays_zip(opened.alias("expected"), rest.alias("rest")), lambda x: x["rest"].rlike(CLOSE))
    found = rows.withColumn("_e", F.coalesce(closed, F.array().cast("array<struct<expected:string,rest:string>>")))
    found = found.withColumn("_c", canonicals(F.transform("_e", lambda x: F.get(F.split(x["rest"], CLOSE, 2), 0))))
    true = F.transform(F.arrays_zip("_e", "_c"), lambda x: F.coalesce(F.lower(x["_e"]["expected"]) == x["_c"]["digest"], F.lit(False)))
    tasks = F.filter(F.arrays_zip(true.alias("ok"), F.col("_c.task").alias("task")), lambda x: x["ok"])
    version = lambda t: F.coalesce(F.try_variant_get(F.try_parse_json(t), "$.schema_version", "double"), F.lit(-1.0)) == VERSION
    found = found.withColumn("_first", F.coalesce(F.get(true, F.lit(0)), F.lit(False))).withColumn("_tasks", F.transform(tasks, lambda x: x["task"]))
    told = F.get(F.filter("_tasks", lambda t: ~version(t) | valid(t)), F.lit(0))
    return found.withColumn("verified", F.col("_first")).withColumn("task", F.when(version(told), told)).drop("_e", "_c", "_first", "_tasks")


def serialized(task: Column, prefix: str) -> Column:
    """An envelope around a JSON object; null for what isn't one or hasn't a task's fields."""
    one = F.get(canonicals(F.array(task)), F.lit(0))
    body = F.when(has_fields(F.try_parse_json(one["task"]), one["task"]), one["task"])
    return F.concat(F.lit(f"<!-- {prefix}-task:v1 sha256="), one["digest"], F.lit(" -->\n"), body, F.lit(f"\n<!-- /{prefix}-task:v1 -->"))


def comments(rows: DataFrame, body: str = "body") -> DataFrame:
    """issue, id, at, kind, exec_id, lease_seconds of comments (issue, id, body) that are claims or heartbeats, as ``leases``
    takes them."""
    part = lambda pattern, k: F.nullif(F.regexp_extract(body, pattern, k), F.lit(""))
    claimed = part(CLAIM, 2).isNotNull()
    at = F.try_to_timestamp(F.coalesce(part(CLAIM, 3), part(HEARTBEAT, 2)))
    kind = F.when(claimed, "claim").when(part(HEARTBEAT, 1).isNotNull(), "heartbeat")
    return rows.select(
        "issue", "id", at.alias("at"), kind.alias("kind"), F.coalesce(part(CLAIM, 2), part(HEARTBEAT, 1)).alias("exec_id"),
        F.coalesce(part(CLAIM, 4).try_cast("bigint"), F.lit(0).cast("bigint")).alias("lease_seconds"),
    ).where("kind is not null and at is not null")
