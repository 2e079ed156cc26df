"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_trie, mixing, recompression, simhash, toxicity
from quillspark.llm._common import cut, new_path

#: Texts with this score or more are rejected.
TOXIC = 0.3


def free(name: str, columns: list[str]) -> str:
    """A name that none of the columns has."""
    while name.lower() in map(str.lower, columns):
        name = "_" + name
    return name


def whole(docs: DataFrame) -> Column:
    """A row as one struct, so that none of its columns' names meets another."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC. Rows keep all their columns; null and empty texts score as texts
    without any sign of toxicity; repeated rows score alike; texts are scored whole; no documents give none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.learnable("doc_id"))
    name = free("score", docs.columns)
    scored = toxicity.assess(docs, labels, keep=tuple(docs.columns), name=name)
    return scored.where(F.col(f"`{name}`") < TOXIC).select([F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the least id; of equal rows of it one.

    Texts without words (null, empty, blank) are copies of each other. Texts of any length are looked at whole. A class whose
    ids are all null keeps one row for each fingerprint. Rows keep all their columns; no documents give none."""
    found = cut(simhash.near_duplicates(docs))
    tops = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("top"), F.col("fingerprint").alias("of"))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = docs.select(F.col("doc_id").alias("key"), whole(docs).alias("row"))
        return rows.join(tops, F.col("key").eqNullSafe(F.col("top")), "left_semi").select("row.*")
    marked = simhash.fingerprints(docs.select(whole(docs).alias("row"), "text"), "row", "text")
    marked = marked.select("row", F.col("row.doc_id").alias("key"), simhash.digits("fp").alias("own"))
    kept = marked.join(tops.distinct(), F.col("key").eqNullSafe(F.col("top")) & (F.col("own") == F.col("of")), "left_semi")
    return kept.dropDuplicates(["key", "own"]).select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; other texts stay as they are, emptied ones go.

    Null and empty texts stay. Rows with equal ids are one document's; rows with a null id stay whole. Other columns stay
    as they are, but for n_chars, which follows the text; no documents give none."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    out = recompression.remove_repeats(docs.select("doc_id", "text", row.alias("rest")), keep=("rest",), whole=True)
    columns = {c: F.col(f"rest.`{c}`") for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.where("n_removed = 0 or n_removed < n_words").select([columns[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Rows keep all their columns; a null source is a source; texts
    without words count nothing and are taken at their source's rate; very long texts count whole, and are taken or not as
    a whole; rows with equal ids are drawn alike, and sources that tie in size or limit are in the order of their names; no
    documents give none."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids, their number and a digest of the text that they decode to. Null and empty texts have
    no ids; every row is encoded, repeated ones too, and texts of any length whole; other columns are left out; no documents
    give none."""
    rows = bpe_trie.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "source"))
    return rows.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("source mixing", mix_sources),
    ("bpe encoding", encode),
]

#: The first stages learn models and follow links of hashes that SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result goes through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
