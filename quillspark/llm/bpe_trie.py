"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a byte string is fixed by one state for each of its prefixes: the last token of the prefix's encoding.
That token is the only suffix of the prefix that is a token, encodes as itself, and may follow the last token of what
stands before it, i.e. no merge across their border comes before the merges that make the two. Distinct words go into a
trie in sorted order, so nodes are made depth first; each node's state is computed once, from its ancestors' states, and
serves every word with that prefix. A word's tokens are read off from its end.

Null and empty texts have no ids. Rows are kept as they come, repeated ones too; an empty table gives no rows; columns that
aren't asked for are left out, whatever their names. Texts may be of any length: a word costs one trie node a byte. The trie is dropped and the
table of finished words cut to the current ones when they reach a fixed size, so a Python worker's memory is bounded.
"""

from __future__ import annotations

import struct
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._common import Pretokenizer, Vocabulary, calm_gc, fields, map_columns

NEVER = 1 << 60


def pack(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


#: Trie nodes and finished words that one Python worker holds.
MAX_NODES, MAX_WORDS, MAX_FITS = 200_000, 250_000, 100_000


class TrieEncoder:
    """Encodes distinct words by states that their shared prefixes have in common."""

    def __init__(self, path: str) -> None:
        calm_gc()
        self.vocabulary = v = Vocabulary(path)
        self.pretokens = Pretokenizer(path)
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges)}
        self.parts = {c: (r, a, b) for r, (a, b, c) in enumerate(v.merges)}
        self.fits_cache: dict[int, bool] = {}
        self.whole_cache: dict[int, bool] = {}
        # tokens by their bytes from the last to the first
        self.back: dict[int, int] = {}
        self.ends = [-1]
        added = set(v.added.values())
        for token, raw in enumerate(v.bytes):
            if raw and token not in added and self.whole(token):
                at = 0
                for b in reversed(raw):
                    key = at << 8 | b
                    if key not in self.back:
                        self.back[key] = len(self.ends)
                        self.ends.append(-1)
                    at = self.back[key]
                self.ends[at] = token
        #: finished words' ids as little-endian 32-bit integers
        self.words: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last = [-1]

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens at a token's right or left border while it is built, each with the rank of the merge that uses it up."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until, a, b = self.parts[token]
            token = b if right else a

    def crosses(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        """Whether some merge across the border comes first. Of equal pairs in a row the left one is merged first."""
        get = self.rank.get
        return any((m := get((x, y))) is not None and m < p and m <= q for x, p in left for y, q in right)

    def fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits_cache.get(key)
        if known is None:
            if len(self.fits_cache) > MAX_FITS:
                self.fits_cache.clear()
            known = self.fits_cache[key] = not self.crosses(self.edge(a, True), self.edge(b, False))
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's bytes encode as that token."""
        known = self.whole_cache.get(token)
        if known is None:
            known = True
            if token in self.parts:
                r, a, b = self.parts[token]
                left, right = [(a, r), *self.edge(a, True)[1:]], [(b, r), *self.edge(b, False)[1:]]
                get = self.rank.get
                known = self.whole(a) and self.whole(b) and not any((x, y) != (a, b) and (m := get((x, y))) is not None and m < p and m <= q for x, p in left for y, q in right)
            self.whole_cache[token] = known
        return known

    def state(self, word: bytes, end: int, path: list[int]) -> int:
        """The last token of ``word[:end]``; ``path`` has the nodes of its shorter prefixes."""
        back, ends, last = self.back, self.ends, self.last
        found, at, k = [], 0, end
        while k:
            at = back.get(at << 8 | word[k - 1], -1)
            if at < 0:
                break
            k -= 1
            if ends[at] >= 0:
                found.append((k, ends[at]))
        for k, token in reversed(found):
            if k == 0 or self.fits(last[path[k]], token):
                return token
        raise AssertionError("a byte has no token")

    def encode_word(self, word: bytes) -> list[int]:
        child, last, path, node = self.child, self.last, [0], 0
        for end, b in enumerate(word, 1):
            key = node << 8 | b
            node = child.get(key, -1)
            if node < 0:
                token = self.state(word, end, path)
                node = child[key] = len(last)
                last.append(token)
            path.append(node)
        out, end, sizes = [], len(word), self.vocabulary.bytes
        while end:
            token = last[path[end]]
            out.append(token)
            end -= len(sizes[token])
        return out[::-1]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        words, added = self.words, self.vocabulary.added
        cut = list(map(self.pretokens, texts))
        seen = set(chain.from_iterable(cut))
        if len(words) > MAX_WORDS:
            self.words = words = {w: words[w] for w in seen if w in words}
        for word in sorted(seen.difference(words)):
            if word in added:
                words[word] = pack(added[word])
                continue
            if len(self.last) > MAX_NODES:
                self.clear()
            words[word] = pack(*self.encode_word(word.encode()))
        get = words.__getitem__
        return [b"".join(map(get, x)) for x in cut]


@cache
def encoder(path: str) -> TrieEncoder:
    """One for each Python worker and file."""
    return TrieEncoder(path)


@cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes, one after another, and their sizes."""
    found = Vocabulary(path).bytes
    return np.frombuffer(b"".join(found), np.uint8), np.array(list(map(len, found)), np.int64)


def id_lists(path: str, texts: pa.Array) -> pa.ListArray:
    rows = encoder(path).encode(texts.to_pylist())
    ends = np.cumsum([0, *map(len, rows)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def id_texts(path: str, ids: pa.ListArray) -> list[str | None]:
    raw, sizes = pieces(path)
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(x or 0 for x in pc.list_value_length(ids).to_pylist())])
    token_ends = np.r_[0, np.cumsum(sizes[flat])]
    starts = np.cumsum(sizes) - sizes
    # each token's bytes lie in a row in ``raw``: where they start, and one more for each byte after the first
    at = np.repeat(starts[flat] - token_ends[:-1], sizes[flat]) + np.arange(token_ends[-1])
    text, cuts = raw[at].tobytes(), token_ends[ends].tolist()
    return [text[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(cuts, cuts[1:], ids.is_valid().to_pylist(), strict=False)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): each text's token ids. Rows are kept as they come, repeated ids and null ids too."""

    def run(keys: pa.Array, texts: pa.Array) -> list:
        return [keys, id_lists(path, texts)]

    return map_columns(docs, [id_col, text_col], fields(docs, (id_col,), "ids array<int>"), run, 500)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, text): the text that ids stand for; bytes that aren't UTF-8 become U+FFFD, null ids give null."""

    def run(keys: pa.Array, ids: pa.Array, *more: pa.Array) -> list:
        return [keys, *more, id_texts(path, ids)]

    return map_columns(encoded, [id_col, ids_col, *keep], fields(encoded, (id_col, *keep), "text string"), run, 500)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, ids, decoded): encoding and decoding in one pass, for a check of what is stored. One Python worker a
    task does both, so the vocabulary is held once and ids travel once."""

    def run(texts: pa.Array, *more: pa.Array) -> list:
        ids = id_lists(path, texts)
        return [*more, ids, id_texts(path, ids)]

    return map_columns(docs, [text_col, *keep], fields(docs, keep, "ids array<int>, decoded string"), run, 500)
