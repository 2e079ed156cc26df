"""op13: against trying every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import queries
from quillspark.llm.periodic import collapsed, find_runs, islands, lag_counts, planted, runs


def brute(words, least=24, times=3):
    """Every run, by its definition."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            part = words[a : a + length]
            if length >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((a, length, q))
    return sorted((a, length, q) for a, length, q in out)


def numbers(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], np.int64)


@st.composite
def texts(draw):
    alphabet = draw(st.sampled_from(["ab", "abc", "abcdefghijklmnop"]))
    out = []
    for _ in range(draw(st.integers(0, 5))):
        block = draw(st.lists(st.sampled_from(alphabet), min_size=1, max_size=20))
        out += (block * draw(st.integers(1, 9)))[: draw(st.integers(1, 200))]
    return out


@settings(max_examples=400, deadline=None)
@given(texts(), st.sampled_from([None, 1, 4, 10**9]))
def test_runs_are_those_of_the_definition(words, heavy):
    assert runs(numbers(words), heavy=heavy) == brute(words)


@settings(max_examples=200, deadline=None)
@given(texts(), st.sampled_from([(4, 2), (6, 3), (2, 2), (30, 4)]))
def test_other_thresholds(words, form):
    assert runs(numbers(words), *form) == brute(words, *form)


@pytest.mark.parametrize("heavy", [None, 1, 20, 10**9])
def test_lag_counts_are_exact(heavy):
    r = np.random.default_rng(7)
    words = np.minimum(r.geometric(0.2, 3001), 40).astype(np.int64)
    want = [0] + [int((words[:-k] == words[k:]).sum()) for k in range(1, 1001)]
    assert lag_counts(words, 1000, heavy).tolist() == want


def test_islands_at_the_borders():
    words = numbers("x a b a b a b a b".split())
    assert islands(words, 2, 4) == [(1, 8)]
    assert islands(words, 2, 6) == [(1, 8)] and islands(words, 2, 7) == []


def test_equal_stretches_have_their_least_period():
    assert runs(numbers(["a"] * 100)) == [(0, 100, 1)]
    assert runs(numbers(["a", "b"] * 40)) == [(0, 80, 2)]
    assert runs(numbers(["a"] * 23)) == [] and runs(numbers(["a"] * 24)) == [(0, 24, 1)]
    block = [f"w{i}" for i in range(9)]
    assert runs(numbers(block * 3)) == [(0, 27, 9)] and runs(numbers((block * 3)[:-1])) == []


def test_long_texts():
    r = np.random.default_rng(3)
    words = r.zipf(1.3, 300_000) % 50_000
    words[100_000:250_000] = np.resize(words[100_000:140_000], 150_000)
    words[260_000:290_000] = np.resize(words[260_000:260_007], 30_000)
    found = runs(words.astype(np.int64))
    inside = [x for x in found if x[2] in (40_000, 7)]
    assert any(a <= 100_000 and a + n >= 250_000 for a, n, q in inside if q == 40_000)
    assert any(a <= 260_000 and a + n >= 290_000 for a, n, q in inside if q == 7)


def test_collapsed():
    assert collapsed(10, [(2, 6, 2)]).tolist() == [True] * 4 + [False] * 4 + [True] * 2
    assert collapsed(3, []).all()


def test_planted_follows_the_contract():
    for doc_id in range(200):
        words = [b"w%d" % i for i in range(doc_id % 37)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        want = list(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert planted(doc_id, words) == want
    assert planted(None, [b"a"]) == [b"a"]


def test_documents(spark, odd_docs, odd_texts, no_docs):
    assert find_runs(no_docs).count() == 0
    rows = find_runs(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 1 and rows[0].asDict().keys() == {"doc_id", "runs", "text"}
    want = []
    for text in [*odd_texts, "no id here"]:
        words = (text or "").encode().split()
        found = brute(words)
        stays = collapsed(len(words), found)
        want.append((found, b" ".join(w for w, s in zip(words, stays, strict=True) if s).decode()))
    assert sorted(([tuple(x) for x in r["runs"]], r["text"]) for r in rows) == sorted(want)
    assert any(found for found, _ in want)


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' WHERE len(text) < 9000").fetchall()
    hits = 0
    for doc_id, text in random.Random(1).sample(docs, 60) + [d for d in docs if zlib.crc32(str(d[0]).encode()) % 10 == 0][:20]:
        words = planted(doc_id, (text or "").encode().split())
        found = brute(words)
        best = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        row = got[doc_id]
        assert row["n_runs"] == len(found)
        hits += bool(found)
        assert (row["start"], row["length"], row["period"]) == (best or (None, None, None))
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
        stays = collapsed(len(words), found)
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for w, s in zip(words, stays, strict=True) if s)).hexdigest()
    assert hits > 3
