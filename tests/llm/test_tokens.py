"""op1, op5, op8: against the tokenizers library."""

import hashlib
import tempfile
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe_trie, range_coder, token_counts
from quillspark.llm._common import new_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TRIE, COUNTER = bpe_trie.TrieEncoder(PATH), token_counts.Counter(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from("’— \n\t'sdtm日😀<|endoftext|>"))))
def test_trie_and_counter_agree_with_the_library(text):
    want = ids(text)
    assert np.frombuffer(TRIE.encode([text])[0], "<i4").tolist() == want
    assert COUNTER([text]) == [len(want)]


def test_classes_of_code_points_are_those_of_the_library():
    for a in range(0x250):
        text = f"a{chr(a)}{chr(a)}1{chr(a)} "
        assert TRIE.pretokens(text) == [text[i:j] for _, (i, j) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)], hex(a)


def test_long_words_and_small_caches(monkeypatch):
    monkeypatch.setattr(bpe_trie, "MAX_NODES", 50)
    monkeypatch.setattr(bpe_trie, "MAX_WORDS", 5)
    text = "z" * 5000 + " " + "ab" * 2000 + " the other thing, " * 9
    assert np.frombuffer(bpe_trie.TrieEncoder(PATH).encode([text, text])[1], "<i4").tolist() == ids(text)
    assert COUNTER.merge([b"aaa", b"aaaa", b"-" * 77]).tolist() == [len(ids("aaa")), len(ids("aaaa")), len(ids("-" * 77))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aabetxé-0"), min_size=1, max_size=400).map(str.encode), min_size=1, max_size=4))
def test_long_pre_tokens_by_buckets(words):
    assert COUNTER.merge_long(words).tolist() == COUNTER.merge(words).tolist()


def test_very_long_pre_tokens():
    r = np.random.default_rng(3)
    words = ["".join(map(chr, r.integers(97, 123, 100_000))), "ab" * 50_000, "-" * 99_999]
    began = time.process_time()
    assert COUNTER(words) == [len(ids(w)) for w in words]
    assert time.process_time() - began < 20


def test_encode_and_decode(spark, odd_docs, odd_texts):
    encoded = bpe_trie.encode(odd_docs, PATH)
    rows = bpe_trie.decode(encoded, PATH, keep=("ids",)).collect()
    assert len(rows) == len(odd_texts) + 1
    assert sorted((r["text"], r["ids"]) for r in rows) == sorted((t or "", ids(t)) for t in [*odd_texts, "no id here"])
    some = spark.createDataFrame([(1, [50256, 447, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe_trie.decode(some, PATH).collect()} == {
        1: LIBRARY.decode([50256, 447, 50256], skip_special_tokens=False), 2: None, 3: "",
    }


def test_counts(odd_docs, odd_texts):
    rows = token_counts.count_tokens(odd_docs, PATH).collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in rows) == sorted((len((t or "").encode()), len(ids(t))) for t in [*odd_texts, "no id here"])


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, 300_000])
@pytest.mark.parametrize("symbols", [1, 2, 50_257])
def test_blocks_round_trip(n, symbols):
    r = np.random.default_rng(n)
    x = np.minimum((r.pareto(1.0, n) * 5).astype(np.int64), symbols - 1)
    x[n // 2 :] = x[: n - n // 2]
    keys = [None, -3, 2**40]
    sizes = np.array([0, n - n // 3, n // 3])
    data = range_coder.pack_block(keys, sizes, x)
    k, s, y = range_coder.unpack_block(data)
    assert k == keys and (s == sizes).all() and (x == y).all()
    if n == 300_000 and symbols > 2:
        assert len(data) < n * 2 * 0.6  # repeated text is predicted
    for at in (0, 7, len(data) - 1):
        with pytest.raises(ValueError):
            range_coder.unpack_block(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_file(spark, odd_docs, odd_texts):
    path = new_path(spark, "ids")
    range_coder.write(odd_docs, path, PATH, block_ids=200)
    assert spark.read.parquet(path).count() > 3
    rows = sorted(range_coder.read(spark, path).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:]) and len(rows) == len(odd_texts) + 1
    at = 0
    by_id = {i: [*ids(t), 2] for i, t in enumerate(odd_texts) if i not in (11, 12)} | {None: [*ids("no id here"), 2]}
    for r in rows:
        found = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at
        at += len(found)
        assert r["doc_id"] == 11 or found == by_id[r["doc_id"]]


def test_empty_tables(spark, no_docs):
    path = new_path(spark, "ids")
    range_coder.write(no_docs, path, PATH)
    assert range_coder.read(spark, path).count() == 0
    assert bpe_trie.encode(no_docs, PATH).count() == token_counts.count_tokens(no_docs, PATH).count() == 0


def test_queries(spark):
    from quillspark.llm import queries as q

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    start = 0
    one = {r["doc_id"]: r for r in q.op1_token_ids(spark, sf).collect()}
    five = {r["doc_id"]: r for r in q.op5_bpe_trie(spark, sf).collect()}
    eight = {r["doc_id"]: r for r in q.op8_token_counts(spark, sf).collect()}
    for d in sorted(docs):
        want = ids(docs[d])
        assert (one[d]["start"], one[d]["n_tokens"]) == (start, len(want) + 1)
        assert one[d]["ids_crc32"] == zlib.crc32(np.array([*want, 2], "<u4").tobytes())
        start += len(want) + 1
        assert five[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert five[d]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
        assert (five[d]["n_tokens"], eight[d]["n_tokens"], eight[d]["over_limit"]) == (len(want), len(want), len(want) > 1024)


def test_equal_ids_are_in_the_order_of_their_texts(spark):
    rows = [(7, t) for t in ("bb cc", None, "aa", "dd", "aa", "")] + [(None, "x"), (3, "y")]
    read = []
    for k in (1, 4):
        path = tempfile.mkdtemp(prefix="spark-") + "/ids"
        range_coder.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(k), path, PATH)
        read.append([(r["doc_id"], r["start"], bytes(r["ids"])) for r in range_coder.read(spark, path).orderBy("start").collect()])
    assert read[0] == read[1] and [r[0] for r in read[0]] == [None, 3, 7, 7, 7, 7, 7, 7]


def test_bits_an_id(spark):
    """The mixed orders need fewer bits than zlib on the same 32-bit ids, and than the ids' own frequencies allow."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    ids = np.frombuffer(b"".join(range_coder.library(PATH)(texts)), "<i4").astype(np.int64)
    sizes, words = range_coder.encode_lanes(ids, int(ids.max()) + 1)
    bits = 8 * (4 * len(words) + 4 * len(sizes)) / len(ids)
    counts = np.bincount(ids)
    order0 = -(counts[counts > 0] * np.log2(counts[counts > 0] / len(ids))).sum() / len(ids)
    zipped = 8 * len(zlib.compress(ids.astype("<i4").tobytes(), 6)) / len(ids)
    print(f"bits an id: mixed {bits:.2f}, order 0 {order0:.2f}, zlib {zipped:.2f}")
    assert bits < zipped


def test_words_outlive_a_full_table():
    """A worker's table lets go of words not asked for lately, and asks the library's model once for those that come back."""
    encoder = range_coder.LibraryEncoder(PATH)
    encoder.MAX_WORDS = 4
    made, tokenize = [], encoder.model.tokenize

    class Counted:
        def tokenize(self, word):
            made.append(word)
            return tokenize(word)

    encoder.model = Counted()
    library = encoder.pretokens.library
    for text in ("a one two three four", "six", "x two one", None, "", "\tñ \x7f\x00 <|endoftext|> two", "ñ ni\u0303 日本 one"):
        got = np.frombuffer(encoder([text])[0], "<i4").tolist()
        assert got == library.encode(text or "", add_special_tokens=False).ids
        if text == "x two one":
            assert made.count("Ġtwo") == made.count("Ġone") == 1
    assert len(encoder.words) + len(encoder.words.before) <= 4 + 2 * 7
