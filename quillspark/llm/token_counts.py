"""Token counts by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie one after another in one numpy array. In every round each sequence looks up the
ranks of its adjacent pairs, takes its lowest, and merges all places of that pair at once (of overlapping places every
second one, from the left); a sequence without a ranked pair is done, and its surviving symbols are its tokens. A merge
only makes pairs of higher rank, so a round's merges never get in each other's way.

Long pre-tokens would take as many such rounds as they have ranks, each over all their symbols. They are kept as linked
arrays instead, with the places of every rank in a bucket: a round takes the lowest bucket and touches only its places and
their neighbours, whose new pairs go to later buckets. That is near-linear in a pre-token's length.

Null and empty texts have no tokens. Texts of any length are counted whole. Rows are kept as they come, repeated ones and
null ids too; an empty table gives no rows; other columns are left out, whatever their names. The table of counted words is
cut to the current ones at a fixed size; memory grows with a batch's distinct words only.
"""

from __future__ import annotations

import heapq
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import Pretokenizer, Vocabulary, calm_gc, map_columns

NONE = np.int64(1) << 40
MAX_WORDS = 200_000
#: Bytes of pre-tokens merged together.
MAX_BYTES = 4_000_000
#: Bytes from which a pre-token is a long one.
LONG = 200


class Counter:
    """Counts the tokens of pre-tokens."""

    def __init__(self, path: str) -> None:
        calm_gc()
        v = Vocabulary(path)
        self.pretokens, self.added = Pretokenizer(path), v.added
        keys = np.array([a << 32 | b for a, b, _ in v.merges], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.merged = np.array([c for _, _, c in v.merges], np.int64)
        self.pairs = [(a, b) for a, b, _ in v.merges]
        self.byte_ids = np.array(v.byte_ids, np.int64)
        self.words: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word; none is empty."""
        counts = np.zeros(len(words), np.int64)
        sizes = np.array(list(map(len, words)), np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        which = np.arange(len(words))
        while len(which):
            starts = np.cumsum(sizes) - sizes
            ends = starts + sizes - 1
            ranks = np.full(len(symbols), NONE)
            ranks[:-1] = self.ranks(symbols[:-1], symbols[1:])
            ranks[ends] = NONE
            least = np.minimum.reduceat(ranks, starts)
            done = least == NONE
            counts[which[done]] = sizes[done]
            low = np.repeat(least, sizes)
            places = np.flatnonzero((ranks == low) & (low != NONE))
            first = np.ones(len(places), bool)
            first[1:] = places[1:] != places[:-1] + 1
            nth = np.arange(len(places)) - np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[nth % 2 == 0]
            symbols[places] = self.merged[ranks[places]]
            kept = np.repeat(~done, sizes)
            kept[places + 1] = False
            lost = np.zeros(len(symbols), np.int64)
            lost[places + 1] = 1
            sizes = (sizes - np.add.reduceat(lost, starts))[~done]
            symbols, which = symbols[kept], which[~done]
        return counts

    def merge_long(self, words: list[bytes]) -> np.ndarray:
        """The same for long pre-tokens."""
        sizes = np.array(list(map(len, words)), np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1])
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        # after the last symbol comes one that pairs with nothing, and it is its own neighbour
        symbols = np.append(symbols, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n], before[0] = n, n
        after[ends - 1], before[ends[:-1]] = n, n
        buckets: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(places: np.ndarray) -> None:
            other = symbols[after[places]]
            places, other = places[other >= 0], other[other >= 0]
            ranks = self.ranks(symbols[places], other)
            order = np.flatnonzero(ranks != NONE)
            if not len(order):
                return
            order = order[np.argsort(ranks[order], kind="stable")]
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for rank, some in zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts), strict=True):
                if rank not in buckets:
                    buckets[rank] = []
                    heapq.heappush(queue, rank)
                buckets[rank].append(some)

        put(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            places = np.unique(np.concatenate(buckets.pop(rank)))
            left, right = self.pairs[rank]
            places = places[(symbols[places] == left) & (symbols[after[places]] == right)]
            if left == right and len(places) > 1:
                first = np.ones(len(places), bool)
                first[1:] = after[places[:-1]] != places[1:]
                nth = np.arange(len(places)) - np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
                places = places[nth % 2 == 0]
            gone = after[places]
            symbols[places], symbols[gone] = self.merged[rank], -2
            after[places] = after[gone]
            before[after[places]] = places
            around = before[places]
            put(np.unique(np.concatenate([places, around[around < n]])))
        return np.add.reduceat((symbols[:n] >= 0).astype(np.int64), ends - sizes)

    def __call__(self, texts: list[str | None]) -> list[int]:
        words = self.words
        cut = list(map(self.pretokens, texts))
        seen = set(chain.from_iterable(cut))
        if len(words) > MAX_WORDS:
            self.words = words = {w: words[w] for w in seen if w in words}
        new = list(seen.difference(words))
        words.update((w, 1) for w in new if w in self.added)
        new = [w for w in new if w not in self.added]
        raw = [w.encode() for w in new]
        long = [i for i, w in enumerate(raw) if len(w) > LONG]
        if long:
            words.update(zip([new[i] for i in long], self.merge_long([raw[i] for i in long]).tolist(), strict=True))
            new, raw = [w for w in new if w not in words], [w for w in raw if len(w) <= LONG]
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(raw[end]) <= MAX_BYTES):
                size += len(raw[end])
                end += 1
            words.update(zip(new[at:end], self.merge(raw[at:end]).tolist(), strict=True))
            at = end
        get = words.__getitem__
        return [sum(map(get, x)) for x in cut]


@cache
def counter(path: str) -> Counter:
    """One for each Python worker and file."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each row; the file's added tokens inside texts count as one token each."""

    def run(keys: pa.Array, texts: pa.Array) -> list:
        rows = texts.to_pylist()
        return [keys, [len(t.encode()) if t else 0 for t in rows], counter(path)(rows)]

    key = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, [id_col, text_col], f"`{id_col}` {key}, n_bytes long, n_tokens long", run)
