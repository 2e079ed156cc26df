"""op9: against brute force and SQL."""

import random
from collections import defaultdict

import duckdb
import numpy as np

from quillspark.llm import queries as q
from quillspark.llm import recompression


def brute(rows, width=13):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        out.append((str(d), len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out)


def corpus(seed, words, docs=60):
    r = random.Random(seed)
    passages = [[f"w{r.randrange(words)}" for _ in range(r.choice([5, 12, 13, 14, 40]))] for _ in range(12)]
    passages.append(["same"] * 30)
    passages.append(["ab", "cd"] * 20)
    rows = []
    for d in range(docs):
        w = []
        for _ in range(r.randrange(5)):
            w += r.choice(passages) + [f"w{r.randrange(words)}" for _ in range(r.randrange(6))]
        rows.append((d, " ".join(w)))
    rows += [(5, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, rows[3][1]), (docs, None), (docs + 1, " \n "), (-4, rows[9][1])]
    return rows


def test_equal_windows_have_equal_symbols():
    r = random.Random(2)
    for _ in range(20):
        size = r.choice([2, 5, 50])
        seq, doc = [], []
        for d in range(15):
            w = [r.randrange(size) for _ in range(r.choice([0, 5, 40]))] + [1] * r.randrange(20)
            seq += w
            doc += [d] * len(w)
        names = recompression.named([str(x).encode() for x in seq])
        inside, stands = recompression.symbols(names, np.array(doc, np.int64), 13)
        by_window = defaultdict(set)
        for i in np.flatnonzero(inside):
            by_window[tuple(seq[i : i + 13])].add(int(stands[i]))
        assert all(len(s) == 1 for s in by_window.values())


def test_against_brute_force(spark):
    for seed, words, unique in ((1, 3, True), (2, 40, False), (3, 4000, False), (4, 40, True), (5, 4000, True)):
        rows = corpus(seed, words)
        if unique:  # copies of all words, and ids that are unique
            rows = [(i if d is not None else None, t) for i, (d, t) in enumerate(rows)] + [(1000 + i, rows[i][1]) for i in range(9)] + [(-1000, rows[5][1])]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in recompression.remove_repeats(df).collect())
        assert got == brute(rows)


def test_odd_texts(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = recompression.remove_repeats(odd_docs, keep=("key", "size", "lang")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in got) == brute(rows)
    kept = recompression.remove_repeats(odd_docs, whole=True).where("n_removed = 0").collect()
    texts = {t for _, t in rows}
    assert all(r["text"] in texts for r in kept)
    assert recompression.remove_repeats(no_docs).count() == 0


def test_op9_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(q.ORACLE_SQL["op9_recompression"]).fetchall())
    assert sorted(map(tuple, q.op9_recompression(spark, sf).collect())) == want


def test_many_texts_of_one_id(spark):
    """Many texts with one id, all with a passage that an earlier document has."""
    passage = " ".join(f"w{i}" for i in range(13))
    n = 300
    df = spark.range(n).selectExpr(
        "1L AS doc_id", f"concat('n', id, ' {passage} m') AS text",
    ).unionByName(spark.createDataFrame([(0, passage)], "doc_id long, text string"))
    got = recompression.remove_repeats(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(0, 13, 0, 1), (1, 15, 13, n)]


def test_common_passage_is_combined_where_it_arises():
    """Of the rows of a hot symbol in one part of a batch only the first document's keeps it."""
    doc = np.repeat(np.arange(1000), 2)
    key = np.tile(np.array([7, 0], np.uint64), 1000) + np.tile(np.array([0, 1], np.uint64), 1000) * (doc + 100).astype(np.uint64)
    shared, later = recompression.met(doc, key)
    assert shared[::2].all() and not shared[1::2].any() and later.sum() == 999 and not later[0]
    out = recompression.scattered(key, doc, later)
    assert (out == 7).sum() == 1 and len(set(out.tolist())) == 2000
