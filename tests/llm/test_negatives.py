"""op12: against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import negatives, queries
from quillspark.llm.negatives import Block, hard_negatives


def brute(rows, every=10, positives=5, wanted=10, low=30, high=90):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, vector, label)."""
    used = []
    for k, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 2**56:
            used.append((k, q, label))
    key = lambda s: (-s[0], math.inf if s[1] is None else s[1])
    out = []
    for n, (k, q, label) in enumerate(used):
        if k is None or k % every:
            continue
        scores = [(sum(a * b for a, b in zip(q, p, strict=True)), i, of) for m, (i, p, of) in enumerate(used) if m != n and len(p) == len(q)]
        for ps, pid, _ in sorted((s for s in scores if s[2] == label), key=key)[:positives]:
            near = sorted((s for s in scores if s[2] != label and low * ps <= 100 * s[0] <= high * ps), key=key)[:wanted]
            out += [(k, pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(near, 1)]
    return sorted(out, key=repr)


def made(spark, rows, schema="vec_id long, embedding array<double>, label int", **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    found = hard_negatives(df, F.col("id") % 10 == 0, **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def clustered(n, d, seed, labels=4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((labels, d))
    return [(i, (centres[i % labels] * r.uniform(0, 1.2) + r.standard_normal(d)).tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("n", "d"), [(300, 16), (120, 1), (200, 3)])
def test_all_pairs(spark, n, d):
    rows = clustered(n, d, n)
    assert made(spark, rows) == brute(rows)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 16)
    monkeypatch.setattr(negatives, "PARTS", 1000)
    monkeypatch.setattr(negatives, "ENTRIES", 64)
    rows = clustered(400, 8, 5)
    rows += [(400 + i, rows[3][1], 0) for i in range(80)]  # equal vectors: ties by id, over many blocks
    assert made(spark, rows) == brute(rows)


def test_other_numbers(spark):
    rows = clustered(200, 6, 9)
    assert made(spark, rows, positives=2, negatives=3, low=10, high=70) == brute(rows, positives=2, wanted=3, low=10, high=70)


def test_odd_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(60)]
    rows += [(60, None, 1), (61, [None, 1.0, 1.0, 1.0], 1), (70, [math.nan, 1.0, 1.0, 1.0], 1), (80, [math.inf, 0.0, 0.0, 0.0], 1), (90, [1.0] * 4, None)]
    rows += [(100, [0.0] * 4, 0), (110, [1.0, 2.0], 0), (111, [1.0, 2.1], 0), (112, [1.0, 1.0], 1), (120, [], 0), (130, [2.0] * 4, 9)]
    rows += [(10, rows[10][1], 1), (20, rows[20][1], 2), (20, rows[20][1], 2), (None, rows[5][1], 2), (None, rows[5][1], 1), (-140, [0.5] * 4, 1)]
    rows += [(150, [1e7, 0.0, 0.0, 0.0], 1), (151, [1e300, 0.0, 0.0, 0.0], 1), (160, [5e5, -3e5, 0.1, 0.0], 2), (161, [5e5, -2e5, 0.1, 0.0], 2), (162, [3e5, -2e5, 0.1, 0.0], 1)]
    assert made(spark, rows) == brute(rows)


def test_empty_and_clashing_names(spark):
    schema = "vec_id long, embedding array<float>, label int, node string, part int, key long, anchor string"
    assert made(spark, [], schema) == []
    rows = [(i, [float(i % 7), 1.0], i % 2, "x", 1, 2, "y") for i in range(40)]
    assert made(spark, rows, schema) == brute([x[:3] for x in rows])


def test_one_label_only_gives_nothing(spark):
    assert made(spark, [(i, [1.0, float(i)], 1) for i in range(30)]) == []


def test_discards_before_products():
    r = np.random.default_rng(0)
    d, n = 64, 4000
    x = (r.standard_normal((n, d)) * (0.9 ** np.arange(d)) @ np.linalg.qr(r.standard_normal((d, d)))[0] * 200).astype(np.int32)
    block = Block(np.arange(n), np.arange(n), np.zeros(n, np.int64), x)
    a, every = x[:50], np.full(50, np.iinfo(np.int64).max)
    i, j, score = block.survivors(a, np.ones((50, n), bool), -every, every, 5)
    assert len(i) < 0.1 * 50 * n  # verified pairs that are returned
    exact = a.astype(np.int64) @ x.T.astype(np.int64)
    assert (score == exact[i, j]).all()
    some = block.best(i, j, score, 5)
    for k in range(50):
        assert sorted(score[some][i[some] == k].tolist(), reverse=True) == np.sort(exact[k])[::-1][:5].tolist()


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.ORACLE_SQL["op12_hard_negatives"].replace("FROM embeddings", f"FROM '{sf}/embeddings.parquet'")).fetchall()
    assert sorted(tuple(r) for r in queries.op12_hard_negatives(spark, sf).collect()) == sorted(want)
