"""The corpus pipeline, stage by stage."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from quillspark.llm import simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = p.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    single = p.drop_near_copies(spark, clean, SF).cache()
    ids = [r["component_id"] for r in simhash.near_duplicates(clean).select("component_id").distinct().collect()]
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(ids)
    cut = p.drop_repeats(spark, single, SF).cache()
    assert cut.columns == docs.columns
    before = {r["doc_id"]: r for r in single.collect()}
    for r in cut.collect():
        old = before[r["doc_id"]]
        assert r["text"] == old["text"] and r["n_chars"] == old["n_chars"] or len(r["text"].split()) < len(old["text"].split()) and r["n_chars"] == len(r["text"])
        assert (r["lang"], r["source"]) == (old["lang"], old["source"])
    mixed = p.mix_sources(spark, cut, SF)
    assert mixed.columns == docs.columns
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in cut.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in p.encode(spark, mixed, SF).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, text), (1, text), (2, text),
        (3, "quite another text about other things, long enough to be its own"),
        (3, "and one more with the same id but nothing else in common at all"), (None, "no id"), (None, "no id"),
    ]
    docs = spark.createDataFrame(
        [(d, t, "en", "s", len(t), "x") for d, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, _fp string",
    )
    kept = p.drop_near_copies(spark, docs.drop("_fp"), SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(d), t) for d, t in {rows[0], rows[3], rows[4], rows[5]})
    for _, stage in p.STAGES:
        stage(spark, docs.where("false"), SF).collect()


def test_run_of_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_run(spark):
    rows = p.run(spark, SF)
    assert rows.columns == ["doc_id", "source", "ids", "n_tokens", "decoded_sha256"] and rows.count() > 0
    assert len(p.STAGES) == 5 and rows.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_planted_near_copies(spark):
    """Of copies with one word in 40 changed, those stay that no chain of fingerprints within 4 bits reaches."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        words = r.choices(vocabulary, k=400)
        texts.append(" ".join(words))
        for edits in (1, 4, 10):
            new = list(words)
            for k in r.sample(range(400), edits):
                new[k] = r.choice(vocabulary)
            texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [simhash.simhash(t) for t in texts]
    top = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((top[a], top[b]))
                top = [x if c == y else c for c in top]
    got = {r["doc_id"] for r in p.drop_near_copies(spark, docs, SF).collect()}
    assert got == set(top) and 40 < len(got) < 160


CLASHING = (
    "_id", "_fp", "_k", "_own", "_score", "score", "_size", "_times", "_copy", "_source", "_target", "row", "key", "top", "of",
    "size", "times", "copy", "rest", "doc", "z", "starts", "spans", "n_words", "n_removed", "y", "fp", "node", "own",
    "component_id", "fingerprint", "ids", "decoded",
)


@pytest.mark.parametrize(("stage", "repeated"), [(0, False), (1, False), (1, True), (2, True), (3, True), (4, True)])
def test_clashing_names_and_odd_rows(spark, odd_texts, stage, repeated):
    """Every stage keeps every column as it is, with null, empty, long and repeated texts."""
    texts = [*odd_texts, "long " + "word " * 60_000]
    rows = [(0 if repeated and i == 1 else i, t, ["b", None, "a"][i % 3], len(t or ""), *[i * 100 + k for k in range(len(CLASHING))]) for i, t in enumerate(texts)]
    rows += [(None, *rows[-2][1:]), (None, *rows[-2][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, " + ", ".join(f"`{c}` int" for c in CLASHING))
    name, run = p.STAGES[stage]
    out = run(spark, docs, SF)
    got = out.collect()
    if stage == 4:
        assert len(got) == len(rows) and out.columns == ["doc_id", "source", "ids", "n_tokens", "decoded_sha256"]
        return
    assert out.columns == docs.columns and got
    own = {(r[0], r[4:]) for r in rows}
    assert {(r[0], tuple(r[4:])) for r in got} <= own
    if name != "substring dedup":
        assert {tuple(r) for r in got} <= set(rows)
