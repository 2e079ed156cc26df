"""op6 and op10: held-out accuracy, and what they must not depend on."""

import itertools
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid, toxicity
from quillspark.llm import queries as q

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = q.op6_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held if any(map(str.isalpha, docs[r["doc_id"]]["text"]))]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_rules(spark, odd_docs, no_docs):
    model = langid.learn(odd_docs)
    assert set(model.languages) <= {"en", "fr"}
    rows = langid.identify(odd_docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    for r in rows:
        if r["doc_id"] not in (None, 11):
            t = texts[r["doc_id"]]
            letters = bool(t) and any(map(str.isalpha, t))
            assert (r["lang_pred"] == "und") == (not letters) and (r["score"] == 0) == (not letters)
    nothing = langid.learn(no_docs)
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0


def test_scores_by_batch_are_those_by_text():
    r = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], r.integers(0, 50, (langid.BUCKETS, 3)).astype(float))
    texts = ["x", "héllo wörld", "ab", "日本語", "z" * 1000]
    best, share = model.score(texts)
    for t, b, s in zip(texts, best, share, strict=True):
        one = model.score([t])
        assert one[0][0] == b and abs(one[1][0] - s) < 1e-4


@pytest.fixture(scope="module")
def characters(spark):
    rows = [("a stupid clown and an idiot, what a loser with pathetic trash ideas",)] * 40 + [("the other house stands near the old river and nobody knows why",)] * 60
    return toxicity.character_model(spark.createDataFrame(rows, "text string"))


def test_restoring(characters):
    want = {
        "1d10t": "idiot", "stup1d": "stupid", "cl0wn!!": "clown", "IDIOT***": "idiot", "l.o.s.e.r": "loser", "looooser": "loser",
        "p@thetic": "pathetic", "tr4$h": "trash", "the&&&": "the", "house": "house", "108.51.216.133": "", "###": "",
    }
    assert {w: toxicity.restore(w, characters) for w in want} == want
    spaced = toxicity.features("he is an i d i o t today", characters, {}, None)
    assert zlib.crc32(b"idiot") % toxicity.HASH in spaced
    assert toxicity.features(None, characters, {}, None) == toxicity.features("", characters, {}, None) == set()


def test_restoring_spacing_separators_and_doubles(characters):
    known = {}
    words = lambda text: toxicity.found(text, characters, known, lambda w: w or None)
    for text in ("id.iot", "id-iot", "i-d-i-o-t", "idiiot", "iidiot", "1d.i0t", "an id io t", "an i d i o t", "i_d_i_o_t!!"):
        assert "idiot" in words(text), text
    assert {"stupid", "idiot"} <= words("he is s t u p i d i d i o t now")
    assert words("house river near nobody") == {"house", "river", "near", "nobody"}
    assert toxicity.restore("2024", characters) == toxicity.restore("10", characters) == ""
    assert toxicity.restore("@$", characters) in ("", "as", "a", "s") and toxicity.restore("###", characters) == ""


def test_doubled_letters_are_decided_as_by_the_lattice(characters):
    r = random.Random(5)
    some = 0
    for _ in range(3000):
        word = "".join(r.choice("aeiotdsnrßé") * r.choice([1, 1, 1, 2]) for _ in range(r.randrange(1, 9)))
        plain = toxicity.undoubled(word, characters)
        some += plain is not None
        assert plain is None or plain == toxicity.decode(word, characters), word
    assert some > 1000


def test_wide_lattices(characters, monkeypatch):
    """Arrays of states give what dictionaries give, whatever the segment, and thousands of wildcards are no matter."""
    r = random.Random(11)
    for _ in range(12):
        word = "".join(r.choice(["idi", "o", "t", "*", "#", "%%", "a", "1", "s--t"]) for _ in range(r.randrange(4, 9)))
        columns = toxicity.lattice(word)
        monkeypatch.setattr(toxicity, "WIDE", 10**9)
        want = toxicity.viterbi(columns, characters)
        for wide, few, segment in ((10, 5, 2), (50, 40, 3), (3000, 40, 2048)):
            monkeypatch.setattr(toxicity, "WIDE", wide)
            monkeypatch.setattr(toxicity, "FEW", few)
            monkeypatch.setattr(toxicity, "SEGMENT", segment)
            got = toxicity.viterbi(columns, characters)
            assert got[1] == pytest.approx(want[1], abs=1e-3), word
    began = time.process_time()
    assert toxicity.restore("a" + "*#" * 500 + "b", characters)
    assert time.process_time() - began < 30


def test_toxic_words_are_learnt_and_found_in_disguise(spark):
    r = random.Random(1)
    some = "green red house river stone old new tall road field cloud rain".split()
    names = [["uncle", "artist", "expert"], ["idiot", "clown", "moron"]]
    rows = [(i, f"he was such an {names[i % 2][i % 3]} about the " + " ".join(r.choice(some) for _ in range(6))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    more = spark.createDataFrame(
        [(1000, "a m0r0n lives here"), (1001, "an artist lives here"), (1002, None), (1003, "what an i d i o t")],
        "doc_id long, text string",
    )
    rows = {r["doc_id"]: r["score"] for r in toxicity.assess(docs.unionByName(more), labels).collect()}
    assert rows[1000] > 0.5 and rows[1003] > 0.5 and rows[1001] < 0.5 and rows[1002] == rows[1002]
    assert all(0 <= s <= 1 for s in rows.values())


def test_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.assess(odd_docs, none).collect()} == {toxicity.assess(odd_docs, none).first()["score"]}
    assert toxicity.assess(no_docs, none).count() == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in q.op10_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    hit = sum(r["predicted"] for r in rows if labels[r["doc_id"]])
    assert hit / sum(labels[r["doc_id"]] for r in rows) > 0.75
    assert hit / sum(r["predicted"] for r in rows) > 0.9


def test_words_that_share_a_hash_are_told_apart(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    at = zlib.crc32(b"idiot") % 2**20
    twin = next(w for x in itertools.permutations(letters, 6) if zlib.crc32((w := "".join(x)).encode()) % 2**20 == at)
    rows = [(i, f"he was such an {['uncle', 'idiot'][i % 2]} about the {a} {b}") for i, (a, b) in enumerate(itertools.permutations("green red house river stone old new tall road field".split(), 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    more = spark.createDataFrame([(1000, f"a {twin} lives here"), (1001, "a cloud lives here"), (1002, "an idiot lives here")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.assess(docs.unionByName(more), labels).collect()}
    assert got[1000] == got[1001] < 0.5 < got[1002]


def test_long_words_are_decoded(characters):
    assert toxicity.restore("idi" + "o" * 300 + "t", characters) == "idiot"
    assert toxicity.restore("1d10t" * 60, characters) == "idiot" * 60


def test_naive_bayes_of_single_n_grams(spark):
    """The same model and scores from dictionaries, one n-gram of one text after another."""
    r = random.Random(6)
    rows = [(i, "".join(r.choice(s) for _ in range(r.randrange(1, 60))), lang) for i, (lang, s) in enumerate([("a", "abcd eÄ"), ("b", "bcxyz é"), ("c", "日本語 a"), ("a", "abcd eÄ")] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B1 % 2**32
            h ^= h >> 15
        return h % langid.BUCKETS

    grams = lambda t: [bucket(t[i : i + n]) for n in langid.GRAMS for i in range(len(t) - n + 1)]
    counts = {x: {} for x in "abc"}
    for _, t, lang in rows:
        for b in grams(t.lower()):
            counts[lang][b] = counts[lang].get(b, 0) + 1
    total = {x: sum(c.values()) + 0.1 * langid.BUCKETS for x, c in counts.items()}
    for got in langid.identify(docs.withColumn("letter", F.lit(1)), model).collect():
        t = rows[got["doc_id"]][1].lower()
        if not any(map(str.isalpha, t)):
            continue
        logs = {x: (np.log(sum(r[2] == x for r in rows) / len(rows)) + sum(np.log((counts[x].get(b, 0) + 0.1) / total[x]) for b in grams(t))) / np.sqrt(len(langid.GRAMS) * len(t)) for x in "abc"}
        best = max(logs, key=logs.get)
        assert got["lang_pred"] == best
        assert got["score"] == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), abs=1e-4)


def test_very_long_texts_and_many_languages(spark, monkeypatch):
    model = langid.learn(spark.createDataFrame([(1, "abc abd", "x"), (2, "zyx zyw", "y")], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(1, "abc " * 300_000), (2, "zyx"), (2, "zyx")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(rows, model).collect()) == [(1, "x"), (2, "y"), (2, "y")]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    many = [(i, "abc", f"l{i % 3 + (i % 5 == 0)}") for i in range(30)]
    model = langid.learn(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    counts = {x: sum(r[2] == x for r in many) for x in {r[2] for r in many}}
    assert model.languages == sorted(sorted(counts, key=lambda x: (-counts[x], x))[:2])


def test_rare_languages_are_learnt(spark):
    rows = [(i, "the house and the river", "en") for i in range(5000)] + [(9000 + i, "żółć źdźbło ćma", "pl") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, max_rows=100)
    assert model.languages == ["en", "pl"]
    assert np.allclose(np.exp(model.prior), [5000 / 5003, 3 / 5003])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got[0] == "en" and got[9000] == "pl"


def test_viterbi_against_all_paths(characters):
    r = random.Random(9)
    for _ in range(150):
        word = "".join(r.choice("aeidotslcw0135@$!|*") for _ in range(r.randrange(1, 7)))
        if r.random() < 0.4:
            word += word[-1] * r.randrange(1, 4)
        columns = toxicity.lattice(word)
        if np.prod([len(c) for c in columns]) > 30_000:
            continue
        scored = []
        for path in itertools.product(*columns):
            text, cost = "".join(p for p, _ in path), sum(c for _, c in path)
            a = b = c = 0
            s = -cost
            for ch in text:
                k = toxicity.letter(ch)
                s += float(characters.logs[(a * toxicity.LETTERS + b) * toxicity.LETTERS + c, k])
                a, b, c = b, c, k
            scored.append((s + float(characters.logs[(a * toxicity.LETTERS + b) * toxicity.LETTERS + c, 0]), text))
        best = max(s for s, _ in scored)
        assert toxicity.decode(word, characters) in {t for s, t in scored if s > best - 1e-6}


def test_fit_against_descent():
    """Newton's solution against plain gradient descent on the same loss."""
    r = np.random.default_rng(2)
    x = (r.random((300, 6)) < 0.4).astype(float)
    y = (r.random(300) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0.5, -2] - 0.5)))).astype(float)
    w, b = np.zeros(6), 0.0
    for _ in range(30_000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 0.01 * (x.T @ (p - y) + w)
        b -= 0.01 * ((p - y).sum() + 1e-6 * b)
    weights, bias = toxicity.fit(x, y)
    assert np.allclose(weights, w, atol=1e-4) and abs(bias - b) < 1e-4
