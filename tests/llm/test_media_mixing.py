"""op2 and op3."""

import hashlib
import io
import wave
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import media, mixing
from quillspark.llm import queries as q


def test_wav_is_lossless():
    for payload in (b"", b"\0" * 64, bytes(range(256)) * 5):
        stored = media.to_wav(payload)
        with wave.open(io.BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert media.from_wav(stored) == payload


def test_fingerprint_finds_tones_and_ignores_what_comes_before():
    t = np.arange(20_000) / media.RATE
    tone = (128 + 60 * np.sin(2 * np.pi * 500 * t) + 40 * np.sin(2 * np.pi * 1500 * t)).astype(np.uint8)
    code = media.fingerprint(tone)
    bins = {int(x >> 20 & 0xFFF) for x in code}
    assert round(500 / media.RATE * media.FRAME) in bins and round(1500 / media.RATE * media.FRAME) in bins
    later = media.fingerprint(np.concatenate([np.full(media.HOP * 10, 128, np.uint8), tone]))
    moved = {(int(x >> 32) - 10, int(x & 0xFFFFFFFF)) for x in later}
    same = {(int(x >> 32), int(x & 0xFFFFFFFF)) for x in code}
    assert len(same & moved) > 0.9 * len(same)


def test_media_columns(spark, odd_docs, odd_texts, no_docs):
    df = odd_docs.select("doc_id", media.text_payload("text").alias("payload")).unionByName(spark.createDataFrame([(99, None)], "doc_id long, payload binary"))
    rows = media.load(media.store(df), keep=("media",)).collect()
    assert len(rows) == len(odd_texts) + 2
    for r in rows:
        if r["doc_id"] == 99:
            assert r["media"] is r["samples"] is r["fingerprint"] is None
        elif r["doc_id"] not in (None, 11):
            raw = (odd_texts[r["doc_id"]] or "").encode()
            assert bytes(r["samples"]) == raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert r["fingerprint"] == sorted(r["fingerprint"])
    assert media.load(media.store(no_docs.select("doc_id", media.text_payload("text").alias("payload")))).count() == 0


def test_op2(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by_text = {}
    for r in q.op2_media_fingerprint(spark, sf).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        stored = media.to_wav(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert by_text.setdefault(raw, r["feature"]) == r["feature"]
    assert len(set(by_text.values())) > 0.9 * len(by_text)


def water(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight, the excess over the caps shared again, until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    while True:
        rest = sum(sizes) - sum(cap * sizes[i] for i in full)
        left = [i for i in range(len(sizes)) if i not in full]
        share = sum(w[i] for i in left)
        over = [i for i in left if rest * w[i] / share > cap * sizes[i]]
        if not over:
            for i in left:
                target[i] = rest * w[i] / share
            for i in full:
                target[i] = float(cap * sizes[i])
            return target
        full.update(over)


def test_targets(spark):
    for sizes in ([100, 5, 5, 300], [7, 7, 7], [1000, 1, 1, 1, 1, 1, 1], [0, 10, 0], [5]):
        df = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        rows = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        assert np.allclose([rows[f"s{i:02}"] for i in range(len(sizes))], water(sizes))


def test_mix(spark, odd_docs, no_docs):
    rows = mixing.planned(odd_docs).collect()
    for r in rows:
        assert r["size"] == len((r["row"]["text"] or "").encode().split())
        assert 0 <= r["times"] <= 3
    again = mixing.planned(odd_docs.repartition(7)).collect()
    key = lambda r: (str(r["row"]["doc_id"]), r["row"]["text"] or "", r["times"], r["target"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(odd_docs).count() == sum(r["times"] for r in rows)
    assert mixing.mix(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0


def test_taken_words_come_near_the_targets(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("s"), F.least(F.col("id") % 9, F.lit(6)).cast("string")).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
    )
    sums = mixing.planned(docs).groupBy("row.source").agg(F.sum(F.col("size") * F.col("times")).alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 for r in sums)


def test_op3_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(q.ORACLE_SQL["op3_source_mix"]).fetchall())
    assert sorted(map(tuple, q.op3_source_mix(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect())) == want


def test_fingerprint_against_the_definition():
    """Every bin of every frame by the sum that defines it, and pairs by hand."""
    r = np.random.default_rng(7)
    for n in (64, 256, 700, 1500):
        samples = r.integers(0, 256, n).astype(np.uint8)
        size = max(media.FRAME, -(-n // media.HOP) * media.HOP)
        x = np.zeros(size)
        x[:n] = samples.astype(float) - 128
        k = np.arange(media.FRAME)
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * k / (media.FRAME - 1))
        frames = []
        for at in range(0, size - media.FRAME + 1, media.HOP):
            part = x[at : at + media.FRAME] * hann
            power = [abs(np.sum(part * np.exp(-2j * np.pi * b * k / media.FRAME))) for b in range(media.FRAME // 2 + 1)]
            mean = np.mean(power[media.BANDS[0] :])
            frames.append([(max(range(lo, hi), key=lambda b, p=power: p[b]), max(power[lo:hi]) > mean) for lo, hi in zip(media.BANDS, media.BANDS[1:])])
        want = []
        for f, own in enumerate(frames):
            for reach in range(1, media.REACH + 1):
                if f + reach < len(frames):
                    want += [f << 32 | a << 20 | b << 8 | reach for (a, s), (b, t) in zip(own, frames[f + reach]) if s and t]
        assert media.fingerprint(samples).tolist() == sorted(want)


def test_mix_of_clashing_names(spark):
    names = ("_size", "_times", "_copy", "_source", "_target", "size", "times", "row", "target", "source_size", "key", "of", "copy", "rate")
    docs = spark.createDataFrame(
        [(i, "a b c", "s", *[i * 100 + k for k in range(len(names))]) for i in range(20)],
        "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names),
    )
    own = {tuple(r) for r in docs.collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} == own
    assert mixing.planned(docs.where("false")).count() == 0
