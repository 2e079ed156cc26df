"""op11: ids against the library, places against packing piece by piece."""

import random
import zlib
from math import isqrt

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import packing, queries
from quillspark.llm._common import new_path
from quillspark.llm.packing import Limits, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = packing.WordEncoder(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(text):
    return np.frombuffer(ENCODER([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("’— \n\t'sdtm日😀<|endoftext|>Σİ́ "))))
def test_ids_agree_with_the_library(text):
    assert encoded(text) == ids(text)


def test_classes_of_code_points_are_those_of_the_library():
    for a in range(0x250):
        text = f"A{chr(a)}{chr(a)}1{chr(a)} B'{chr(a)}s"
        assert encoded(text) == ids(text), hex(a)


def one_by_one(lengths, limits):
    """Vector best-fit decreasing as it is defined: for each piece, longest first, the sequence and the offset."""
    left, out = [], []
    for length in sorted(lengths, reverse=True):
        need = np.array([length, 1, length**2])
        fits = [(float(limits.score(x, need)), i) for i, x in enumerate(left) if (x >= need).all()]
        if fits:
            at = min(fits)[1]
        else:
            at = len(left)
            left.append(limits.capacity)
        out.append((length, at, limits.tokens - int(left[at][0])))
        left[at] = left[at] - need
    return out, len(left)


LIMITS = st.builds(
    Limits, tokens=st.integers(8, 60), docs=st.one_of(st.none(), st.integers(1, 6)), attention=st.one_of(st.none(), st.integers(9, 2000)),
    weights=st.sampled_from([(1.0, 0.01, 0.01), (1.0, 1.0, 1.0), (1.0, 0.0, 0.0), (0.5, 0.0, 2.0)]), measure=st.sampled_from(["norm", "dot"]),
)


@settings(max_examples=300, deadline=None)
@given(LIMITS, st.lists(st.integers(1, 60), max_size=60))
def test_plan_is_best_fit_piece_by_piece(limits, lengths):
    lengths = [1 + (x - 1) % limits.longest for x in lengths]
    want, opened = one_by_one(lengths, limits)
    values, counts = np.unique(np.array(lengths, np.int64), return_counts=True)
    made = plan(values, counts, limits)
    assert made.sequences == opened
    length = np.repeat(values, counts)
    rank = np.concatenate([np.arange(c) for c in counts]) if len(counts) else np.zeros(0, np.int64)
    if len(length):
        assert sorted(zip(length.tolist(), *(x.tolist() for x in made.find(length, rank)), strict=True)) == sorted(want)


def test_few_sequences_and_every_capacity():
    r = np.random.default_rng(1)
    lengths = np.minimum(2048, r.lognormal(5, 1, 20_000).astype(np.int64) + 1)
    values, counts = np.unique(lengths, return_counts=True)
    assert plan(values, counts).sequences <= -(-lengths.sum() // 2048) + 1
    limits = Limits(docs=8, attention=2048**2 // 4)
    lengths = np.minimum(lengths, limits.longest)
    values, counts = np.unique(lengths, return_counts=True)
    made = plan(values, counts, limits)
    sequence = made.find(np.repeat(values, counts), np.concatenate([np.arange(c) for c in counts]))[0]
    length = np.repeat(values, counts)
    used = np.stack([np.bincount(sequence, x) for x in (length, np.ones(len(length)), length**2)], axis=1)
    assert (used <= limits.capacity).all()
    need = max(-(-length.sum() // 2048), -(-len(length) // 8), -(-(length**2).sum() // (2048**2 // 4)))
    assert made.sequences <= need * 1.5  # with three capacities that bind


def test_limits_must_make_sense():
    assert Limits(attention=100).longest == 10 == isqrt(100)
    for bad in ({"tokens": 0}, {"docs": 0}, {"attention": 0}, {"weights": (0.0, 1.0, 1.0)}, {"measure": "first"}):
        with pytest.raises(ValueError):
            Limits(**bad)


def check(rows, texts, limits, end=0):
    """Pieces as they must be: every document whole, sequences gapless and within the capacities."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    want = sorted(((k, tuple([*ids(t), end])) for k, t in texts), key=repr)
    got = []
    for k, parts in docs.items():
        parts.sort(key=lambda r: (r["piece"], r["start"]))
        if len({r["piece"] for r in parts}) < len(parts):
            return check_repeated(want)
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == [i * limits.longest for i in range(len(parts))]
        assert all(r["length"] == limits.longest for r in parts[:-1])
        got.append((k, tuple(np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist())))
    assert sorted(got, key=repr) == want
    for parts in seqs.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= limits.tokens
        if limits.docs:
            assert len(parts) <= limits.docs


def check_repeated(want):
    raise AssertionError(f"repeated pieces among {len(want)} documents")


@pytest.mark.parametrize("limits", [Limits(), Limits(tokens=64, docs=3, attention=2000)])
def test_packs_documents(spark, odd_docs, odd_texts, limits):
    path = new_path(spark, "pieces")
    docs = odd_docs.where("doc_id is null or doc_id <> 11")  # the repeated id: below
    packing.write(docs, path, PATH, limits)
    placed = packing.place(packing.read(spark, path), limits)
    texts = [(i, t) for i, t in enumerate(odd_texts) if i not in (11, 12)] + [(None, "no id here")]
    rows = placed.collect()
    check(rows, texts, limits)
    lengths = [r["length"] for r in rows]
    assert len({r["sequence_id"] for r in rows}) == one_by_one(lengths, limits)[1]
    # whole sequences
    for s in packing.sequences(placed).collect():
        parts = sorted((r["offset"], r["ids"]) for r in rows if r["sequence_id"] == s["sequence_id"])
        assert bytes(s["ids"]) == b"".join(bytes(i) for _, i in parts)
        assert s["lengths"] == [len(i) // 4 for _, i in parts]


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "same text")] * 5 + [(None, "same text")] * 3, "doc_id long, text string").repartition(4)
    path = new_path(spark, "pieces")
    packing.write(docs, path, PATH, Limits(tokens=2 * len(ids("same text")) + 2))
    rows = packing.place(packing.read(spark, path), Limits(tokens=2 * len(ids("same text")) + 2)).collect()
    assert len(rows) == 8 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 8
    assert len({r["sequence_id"] for r in rows}) == 4


def test_empty_table_and_other_columns(spark, no_docs):
    path = new_path(spark, "pieces")
    packing.write(no_docs, path, PATH)
    made = packing.place(packing.read(spark, path))
    assert made.count() == 0 and packing.sequences(made).count() == 0
    rows = spark.createDataFrame([(0, 5, 0, "k", 1, 2)], "part long, length long, nth long, key string, rank int, before int")
    assert packing.place(rows, Limits(tokens=8)).first().asDict() == {
        "part": 0, "length": 5, "nth": 0, "key": "k", "rank": 1, "before": 2, "sequence_id": 0, "offset": 0,
    }


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = queries.op11_best_fit_packing(spark, sf).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append(r)
    total = 0
    for doc_id, text in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall():
        want = np.array([*ids(text), 0], "<u4")
        total += len(want)
        parts = sorted(found.pop(doc_id), key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in parts] == [
            (a, len(want[a : a + 2048]), zlib.crc32(want[a : a + 2048].tobytes())) for a in range(0, len(want), 2048)
        ]
    assert not found
    used = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and len(used) <= -(-total // 2048) + 1


def test_pieces_of_one_length_in_many_partitions(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "a " * r.choice([3, 3, 3, 9])) for i in range(400)], "doc_id long, text string").repartition(13)
    path = new_path(spark, "pieces")
    packing.write(docs, path, PATH, Limits(tokens=12))
    rows = packing.place(packing.read(spark, path), Limits(tokens=12)).collect()
    assert len({(x["sequence_id"], x["offset"]) for x in rows}) == 400
    used = {}
    for x in rows:
        used[x["sequence_id"]] = used.get(x["sequence_id"], 0) + x["length"]
    assert max(used.values()) <= 12 and len(used) == one_by_one([x["length"] for x in rows], Limits(tokens=12))[1]
