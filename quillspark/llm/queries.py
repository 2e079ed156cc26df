"""The queries opN_<name>: each operator over its whole table, with digests of what it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, itq, langid, media, mixing, negatives, packing, periodic, range_coder, recompression, simhash, token_counts, toxicity
from ._common import WORD, new_path


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token_ids")
    range_coder.write(table(spark, sf_dir, "documents"), path, tokenizer())
    return range_coder.read(spark, path).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"),
    )


def op2_media_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media.text_payload("text").alias("payload"),
    )
    path = new_path(spark, "media")
    media.store(docs.withColumn("k", F.struct("doc_id", "n_bytes")), "payload", "k").write.option("compression", "zstd").parquet(path)
    read = media.load(spark.read.parquet(path), "media", "k", keep=("media",))
    code = F.array_join("fingerprint", ",")
    return read.select(
        "k.doc_id",
        "k.n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint"), F.md5(code.cast("binary"))).alias("feature"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.planned(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op4_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_trie.round_trip(table(spark, sf_dir, "documents"), tokenizer())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs.where(langid.fold("doc_id", 5) != 0))
    return langid.identify(docs, model).select("doc_id", (langid.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer())
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompression.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(toxicity.learnable("doc_id"))
    scores = toxicity.assess(docs, labels)
    return scores.select("doc_id", (~toxicity.learnable("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "pieces")
    packing.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    pieces = packing.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf_dir, "documents"), change=periodic.planted)
    greater = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda a, r: F.when(greater(a, r), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", "runs", best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_ids, op2_media_fingerprint, op3_source_mix, op4_itq_near_duplicates, op5_bpe_trie, op6_language_id,
        op7_simhash_near_duplicates, op8_token_counts, op9_recompression, op10_toxicity, op11_best_fit_packing, op12_hard_negatives,
        op13_periodic_runs,
    )
}

ORACLE_SQL = {
    "op3_source_mix": rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS lim FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(lim) OVER o, 0) AS BIGINT))::DOUBLE
  / (CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER o, 0) AS BIGINT)) AS level
  FROM w WINDOW o AS (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(lim::DOUBLE, (SELECT max(level) FROM l) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0
    < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r""",
    "op9_recompression": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(w, i, i + 12), chr(31)) AS s FROM p WHERE i + 12 <= len(w)),
hit AS (SELECT r, i FROM (SELECT r, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, i + k AS i FROM hit, (SELECT unnest(range(0, 13)) AS k)),
kept AS (SELECT p.r, list(w[p.i] ORDER BY p.i) AS ws FROM p ANTI JOIN gone g ON p.r = g.r AND p.i = g.i GROUP BY p.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(len(k.ws), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(k.ws, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.r = k.r""",
    "op12_hard_negatives": r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.r <> b.r AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, br) <= 5),
n AS (SELECT p.ar, p.br, p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id, s.br) AS INTEGER) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_periodic_runs": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
h AS (SELECT *, len(w) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: list_reduce(
    list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) AS h FROM d),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g),
x AS (SELECT r, doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) AS w FROM f),
t AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM x),
-- lags up to 64, and the distances between equal stretches of 64 words, of which one starts at a multiple of 64
grams AS (SELECT r, n, i, array_to_string(list_slice(x.w, i + 1, i + 64), chr(31)) AS s FROM x, LATERAL (SELECT unnest(range(greatest(n - 63, 0))) AS i)),
lags AS (SELECT DISTINCT a.r, b.i - a.i AS q FROM (SELECT * FROM grams WHERE i % 64 = 0) a JOIN grams b ON a.r = b.r AND a.s = b.s AND b.i - a.i > 64
    WHERE b.i - a.i <= a.n // 3
  UNION ALL SELECT r, q FROM x, (SELECT unnest(range(1, 65)) AS q) WHERE q <= n // 3),
m AS (SELECT a.r, q, a.i, a.i - row_number() OVER (PARTITION BY a.r, q ORDER BY a.i) AS island
  FROM lags l JOIN t a ON l.r = a.r JOIN t b ON b.r = a.r AND b.i = a.i + q AND b.word = a.word),
s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DECIMAL(38, 0) * 1000000000000 // period DESC, start, period) = 1),
lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.r, string_agg(t.word, ' ' ORDER BY t.i) AS s FROM t ANTI JOIN gone g ON t.r = g.r AND t.i = g.i GROUP BY t.r)
SELECT x.doc_id, coalesce(lines.n_runs, 0) AS n_runs, b.start, b.length, b.period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM x LEFT JOIN best b ON x.r = b.r LEFT JOIN lines ON x.r = lines.r LEFT JOIN kept ON x.r = kept.r""",
}
