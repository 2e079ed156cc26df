"""op4 and op7: against brute force."""

import random

import numpy as np
import pytest
import xxhash

from quillspark.llm import itq, simhash
from quillspark.llm import queries as q
from quillspark.llm._common import components


def classes(n, pairs):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    for n, m in ((50, 30), (200, 190), (40, 0)):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(0, n // 4)]
        got = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
        want = classes(n, pairs)
        assert all(got.get(i, i) == want[i] for i in range(n))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_simhash(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = lower.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd_texts):
    for t in odd_texts:
        assert simhash.simhash(t) == slow_simhash(t)


def test_thresholds_add_up():
    r = np.random.default_rng(1)
    fps = r.integers(0, 2**63, 500).astype(np.uint64) & np.uint64(0xFFFFFFFF0000FFFF)
    for n in (10, 10_000, 10_000_000):
        design = simhash.plan(fps, n)
        assert sum(t + 1 for _, t in design) == 5
        bits = [b for own, _ in design for b in own]
        assert len(bits) == len(set(bits))
    assert simhash.thresholds([[0, 5, 6, 50], [0, 1, 9, 99]], 2)[0] == 7


def test_links_lose_nothing(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for b in base[:60]:
        for _ in range(3):
            x = b
            for k in r.sample(range(64), r.choice([1, 3, 4, 5])):
                x ^= 1 << k
            fps.add(x)
    dense = base[0]
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(0, 24) for j in range(i)}
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 4
    want = classes(len(fps), zip(*np.nonzero(near), strict=True))
    df = spark.createDataFrame([(int(x), int(x)) for x in arr.view(np.int64)], "fp long, node long")
    place = {int(x): i for i, x in enumerate(arr.view(np.int64))}
    for n, members in ((len(fps), 10**6), (10**9, 10**6), (len(fps), 40)):
        pairs = [(place[a], place[b]) for a, b in simhash.links(df, simhash.plan(arr, n), members=members).collect()]
        assert classes(len(fps), pairs) == want


def test_near_duplicate_documents(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    data = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    fps = [simhash.simhash(t) for _, t in data]
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (d, _), c in zip(data, want, strict=True):
        least[c] = min((x for x in (least.get(c), d) if x is not None), default=None)
    expect = sorted((str(d), f"{f:016x}", str(least[c])) for (d, _), f, c in zip(data, fps, want, strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in rows) == expect
    assert simhash.near_duplicates(no_docs).count() == 0


def brute(vectors, least=0.9):
    ok = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([vectors[i] for i in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    pairs = [(ok[a], ok[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    links = [0] * len(vectors)
    for a, _ in pairs:
        links[a] += 1
    return links, classes(len(vectors), pairs)


def test_embeddings(spark):
    r = np.random.default_rng(2)
    centres = r.standard_normal((60, 32))
    vectors = [(c + s * r.standard_normal(32)).tolist() for c in centres for s in (0.1, 0.2, 0.3)]
    vectors += [vectors[0]] * 4 + [(centres[1] + 0.05 * r.standard_normal(32)).tolist() for _ in range(60)]
    vectors += [None, [0.0] * 32, [float("nan")] * 32, [None, *[1.0] * 31], [float("inf")] * 32]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    links, top = brute(vectors)
    for members in (10**6, 20):
        rows = {x["vec_id"]: x for x in itq.near_duplicates(df, members=members).collect()}
        found = [rows[i]["n_links"] for i in range(len(vectors))]
        assert all(a <= b for a, b in zip(found, links, strict=True)) and sum(found) >= 0.95 * sum(links)
        assert sum(rows[i]["component_id"] == top[i] for i in rows) >= 0.97 * len(rows)
        assert all(rows[i]["kept"] == (rows[i]["component_id"] == i) for i in rows)
        assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] for i in range(len(vectors) - 5, len(vectors)))
    assert itq.near_duplicates(df.where("false")).count() == 0
    assert itq.near_duplicates(df.where("vec_id >= 244")).count() == len(vectors) - 244


def test_vectors_of_several_lengths(spark):
    """Each length has an index of its own; the longest ones being the most common costs the others nothing."""
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(30)]
    a = r.standard_normal(8)
    rows += [
        (40, a.tolist()), (41, (a + 0.01 * r.standard_normal(8)).tolist()), (42, (a * 1e-200).tolist()), (43, [*a.tolist(), 0.0]),
        (44, [1.0]), (45, [2.0]), (46, [-1.0]),
    ]
    rows += [(47, []), (None, (a * 3).tolist()), (41, r.standard_normal(16).tolist()), (48, [0.0, 1e-300]), (49, [-0.0, 1e300])]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "vec_id long, embedding array<double>, key string, links int")
    got = {(str(x["vec_id"]), x["n_links"], str(x["component_id"])) for x in itq.near_duplicates(df).collect() if x["n_links"]}
    assert got == {("40", 3, "40"), ("41", 3, "40"), ("42", 3, "40"), ("None", 3, "40"), ("44", 1, "44"), ("45", 1, "44"), ("48", 1, "48"), ("49", 1, "48")}
    assert itq.near_duplicates(df).count() == len(rows)


def test_deeper_designs_find_the_same(spark, monkeypatch):
    """Longer substrings with a wider radius, as many vectors get them, and no bound on differing bits."""
    r = np.random.default_rng(4)
    centres = r.standard_normal((80, 64))
    vectors = [(c + s * r.standard_normal(64)).tolist() for c in centres for s in (0.1, 0.25, 0.3)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    links, _ = brute([np.float32(v).astype(float).tolist() for v in vectors])
    for tables, radius, far in ((5, 1, None), (4, 2, 64), (3, 3, None)):
        monkeypatch.setattr(itq, "design", lambda *_, t=tables, k=radius: (t, k))
        found = {x["vec_id"]: x["n_links"] for x in itq.near_duplicates(df, far=far).collect()}
        assert all(found[i] <= n for i, n in enumerate(links)) and sum(found.values()) >= 0.9 * sum(links)
    monkeypatch.undo()
    assert itq.design(10**3, 64, 0.9)[1] < itq.design(10**9, 64, 0.9)[1]


def test_recall_at_the_threshold(spark):
    """Independent pairs of unit vectors with a cosine of 0.90 to 0.93: the index must find 0.9 of them."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(1100):  # too many for one exact group
        a = r.standard_normal(64)
        a /= np.linalg.norm(a)
        b = r.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = r.uniform(0.901, 0.93)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert itq.design(len(rows), 64, 0.9)[0] > 1
    assert itq.near_duplicates(df).where("n_links > 0").count() >= 0.9 * len(rows)


def test_op4_recall(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    links, _ = brute([r["embedding"] for r in data])
    found = {r["vec_id"]: r["n_links"] for r in q.op4_itq_near_duplicates(spark, sf).collect()}
    got = [found[r["vec_id"]] for r in data]
    assert all(a <= b for a, b in zip(got, links, strict=True)) and sum(got) >= 0.9 * sum(links)
