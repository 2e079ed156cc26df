"""Sinks: appended lines, keyed upserts, payload documents and Markdown tables of small results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Conflict, Folders


def append_lines(events: DataFrame, path: str) -> None:
    """Rows as JSON lines beside those that are there; a broken last line of an old file stays a line of its own."""
    events.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_payload(rows: DataFrame, path: str) -> None:
    """A result as JSON lines in a folder that replaces the old one as a whole: it is written beside it and renamed, so a
    failure leaves the old one. Between the two renames there is no folder for a moment; see ``publish`` for readers that
    may not meet that."""
    spark = rows.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    rows.write.json(new)
    to = place(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(to)
    if there and not fs.rename(to, place(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(place(new), to):
        if there:
            fs.rename(place(old), to)
        raise OSError(f"can't move {new}")
    if there:
        fs.delete(place(old), True)


def publish(rows: DataFrame, path: str, keep: int = 2) -> int:
    """A result as a version of the table of folders at ``path``; the version's number. Readers have the old one or the new one
    and never none: what they follow is moved by one rename. Of older versions the last ``keep`` - 1 stay, for those who still
    read them."""
    table = Folders(rows.sparkSession, path)
    folder = table.place("version")
    rows.write.parquet(f"{table.at}/{folder}")
    while True:
        last, state = table.state()
        old = [v["folder"] for _, v in sorted(state.items())]
        put = {f"{k:03d}": {"folder": f} for k, f in enumerate([folder, *old[: keep - 1]])}
        try:
            number = table.commit(put, [k for k in state if k not in put], after=last)
        except Conflict:
            continue
        for gone in old[keep - 1 :]:
            table.fs.delete(f"{table.at}/{gone}")
        return number


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version at ``path``; None before the first."""
    table = Folders(spark, path)
    newest = table.state()[1].get("000")
    return newest and spark.read.parquet(f"{table.at}/{newest['folder']}")


def upsert(table: DataFrame, changes: DataFrame, key: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """The table with changed rows replaced and new ones added. A null never replaces a value of a protected column."""
    old, new = table.alias("o"), changes.alias("c")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"c.{key}"), "full")
    touched = F.col(f"c.{key}").isNotNull()
    pick = lambda c: F.coalesce(f"c.{c}", f"o.{c}") if c in protected or c == key else F.when(touched, F.col(f"c.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select([pick(c).alias(c) for c in table.columns])


def replaced(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """What an upsert replaced, for the audit: the old rows whose key changed."""
    return table.join(changes.select(key), key, "left_semi")


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def merge_cache(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """session_id, ts (array): live times replace frozen ones only if their number changed."""
    f, c = frozen.alias("f"), live.alias("l")
    joined = f.join(c, F.col("f.session_id") == F.col("l.session_id"), "full")
    take = F.col("l.ts").isNotNull() & ~F.size("l.ts").eqNullSafe(F.size("f.ts"))
    return joined.select(
        F.coalesce("f.session_id", "l.session_id").alias("session_id"),
        F.when(take, F.col("l.ts")).otherwise(F.coalesce("f.ts", "l.ts")).alias("ts"),
    )


def snapshot(parts: dict[str, DataFrame]) -> DataFrame:
    """One row, document: small results (a few rows each) as one nested JSON object."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.collect_list(F.struct("*")).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct("*")).alias("document"))


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A table of a result's first rows, for reports."""
    cells = lambda xs: "| " + " | ".join("" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([cells(rows.columns), cells(["---"] * len(rows.columns)), *map(cells, rows.limit(most).collect())])


def replace_block(text: str, block: str, name: str = "stats") -> str:
    """A text with what stands between two markers replaced; running it again changes nothing."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    body = f"{start}\n{block.strip()}\n{end}"
    if start in text and end in text:
        return text[: text.index(start)] + body + text[text.index(end) + len(end) :]
    return f"{text.rstrip()}\n\n{body}\n"
