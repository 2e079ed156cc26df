"""Token ids in a compact binary format: an adaptive context-mixing range coder over independent, checksummed blocks.

A block holds some documents' ids and starts from an empty model, so blocks can be read alone and in any order. Its ids
are cut into lanes that are coded side by side: in each step every lane codes its next id under one shared model, then
the model learns all of them. The model mixes three predictions linearly: the id last seen after the two ids before
(order 2), after the one before (order 1), and the ids' adaptive frequencies (order 0). The weights follow how often each
was right where the two guesses had the same confidence. All arithmetic is on integers, so that writer and reader agree
everywhere. Each lane has a carry-less 64-bit range coder that gives out 32-bit words.

``write`` sorts the documents by id over range partitions, encodes them where they are and writes one row for each block:
its partition, its number, the ids before it in the partition, and its bytes (the header below, then the lanes' words).
``read`` checks every block's CRC-32 and raises ValueError on damage. Only one total for each partition is gathered.

Null and empty texts give the end id alone; null document ids come first; rows with equal ids are kept, next to each
other in the order of their texts, so reruns agree. A document is never cut; a very long one makes a longer block. An empty
table gives a folder without blocks, which reads as no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import Pretokenizer, byte_level, calm_gc

MAGIC = b"QIDS1\0"
#: Ids at which a block is closed, lanes at most, and ids that a lane has at least.
BLOCK_IDS, LANES, LEAST = 1 << 20, 8192, 64
#: Frequencies add up to 2 ** SCALE, weights to 2 ** WEIGHT.
SCALE, WEIGHT = 20, 8
#: What an occurrence adds to an id's count, and learnt ids after which frequencies are made anew (earlier at the start).
GAIN, RENEW = 24, 32_768
HASH_BITS = 18
WORD32 = np.uint64(32)
LOW32 = np.uint64(0xFFFFFFFF)
ONE32 = np.uint64(1 << 32)


class Mixer:
    """What reader and writer know before each step. Lanes' numbers are 32-bit."""

    def __init__(self, symbols: int, inverse: bool = False) -> None:
        self.n, self.inverse = symbols, inverse
        self.counts = np.ones(symbols, np.int64)
        # an id that was seen after a context, times 4, and how sure that is (0: not at all, up to 3)
        self.slots1, self.slots2 = np.zeros(symbols + 1, np.int32), np.zeros(1 << HASH_BITS, np.int32)
        self.right = np.tile(np.array([[2, 1, 4]], np.int64), (16, 1))
        self.learnt, self.waiting = 0, []
        self.renew()

    def renew(self) -> None:
        if self.waiting:
            self.counts += GAIN * np.bincount(np.concatenate(self.waiting), minlength=self.n)
            self.waiting = []
        upto = np.cumsum(self.counts)
        while upto[-1] >= 1 << SCALE:
            self.counts = (self.counts + 1) >> 1
            upto = np.cumsum(self.counts)
        # as the counts' sum is less than 2 ** SCALE, every id keeps a frequency of 1 at least
        self.below = np.zeros(self.n + 1, np.int32)
        self.below[1:] = upto * ((1 << SCALE) / int(upto[-1]))
        self.below[-1] = 1 << SCALE
        # an id's bounds lie side by side, as they are looked up together
        self.bounds = np.stack([self.below[:-1], self.below[1:]], axis=1).view(np.int64).ravel()
        if self.inverse:
            self.id_at = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.below))
        self.since = 0

    def predict(self, before1: np.ndarray, before2: np.ndarray) -> None:
        """Guesses and weights for lanes whose last ids, plus one, are given (0: none)."""
        self.at1 = before1
        self.at2 = (before2.view(np.uint32) * np.uint32(0x9E3779B1) + before1.view(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS)
        slot1, slot2 = self.slots1.take(self.at1), self.slots2.take(self.at2)
        self.g1, self.c1, self.g2, self.c2 = slot1 >> 2, slot1 & 3, slot2 >> 2, slot2 & 3
        self.context = (self.c2 * 4 + self.c1).astype(np.intp)
        share = (self.right * ((1 << WEIGHT) - 4) // self.right.sum(axis=1, keepdims=True)).astype(np.int32)
        share[:4, 0] = 0
        share[::4, 1] = 0
        w2, w1 = share[:, 0].take(self.context), share[:, 1].take(self.context)
        self.w0 = (1 << WEIGHT) - w1 - w2
        same = self.g1 == self.g2
        self.m2 = (w2 + w1 * same) << SCALE
        self.m1 = (w1 * ~same) << SCALE

    def between(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.bounds.take(ids).view(np.int32)
        return both[::2], both[1::2]

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.between(ids)
        start = self.w0 * low + self.m1 * (self.g1 < ids) + self.m2 * (self.g2 < ids)
        return start, self.w0 * (high - low) + self.m1 * (self.g1 == ids) + self.m2 * (self.g2 == ids)

    def find(self, value: np.ndarray) -> np.ndarray:
        first = self.g1 <= self.g2
        a, b = np.minimum(self.g1, self.g2), np.maximum(self.g1, self.g2)
        ma, mb = np.where(first, self.m1, self.m2), np.where(first, self.m2, self.m1)
        both = a == b
        ma, mb = ma + mb * both, mb * ~both
        (a_low, a_high), (b_low, b_high) = self.between(a), self.between(b)
        a_low, b_low = self.w0 * a_low, self.w0 * b_low + ma
        a_high, b_high = self.w0 * a_high + ma, self.w0 * b_high + ma + mb
        rest = value - ma * (value >= a_high) - mb * (value >= b_high)
        # exact: both are below 2 ** 28, and quotients that are no integers lie 1 / 256 or more apart from one
        at = np.minimum(rest / self.w0, (1 << SCALE) - 1).astype(np.int32)
        ids = np.where((value >= b_low) & (value < b_high), b, self.id_at.take(at))
        return np.where((value >= a_low) & (value < a_high), a, ids)

    def learn(self, ids: np.ndarray) -> None:
        hit1, hit2 = (self.g1 == ids) & (self.c1 > 0), (self.g2 == ids) & (self.c2 > 0)
        kind = (2 - hit1.view(np.int8)) * ~hit2
        self.right += np.bincount(self.context * 3 + kind, minlength=48).reshape(16, 3)
        self.right[self.right.sum(axis=1) > 1 << 16] >>= 1
        np.maximum(self.right, 1, out=self.right)
        for slots, at, g, c, hit in ((self.slots1, self.at1, self.g1, self.c1, hit1), (self.slots2, self.at2, self.g2, self.c2, hit2)):
            slots[at] = np.where(hit | (c > 1), g, ids) << 2 | np.where(hit, np.minimum(c + 1, 3), np.maximum(c - 1, 1))
        self.waiting.append(ids)
        self.learnt += len(ids)
        self.since += len(ids)
        if self.since >= min(RENEW, self.learnt // 2):
            self.renew()


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and the steps of all but the last."""
    steps = max(LEAST, -(-n // LANES))
    return -(-n // steps), steps


def encode_lanes(ids: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(each lane's number of words, all words)."""
    lanes, steps = lanes_of(len(ids))
    last = len(ids) - (lanes - 1) * steps
    padded = np.zeros(lanes * steps, np.int32)
    padded[: len(ids)] = ids
    table = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    words, sizes = np.zeros((lanes, steps + 1), np.uint32), np.zeros(lanes, np.int64)
    before1, before2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    mixer = Mixer(symbols)
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        if not k:
            break
        now = table[t, :k]
        mixer.predict(before1[:k], before2[:k])
        start, size = mixer.interval(now)
        unit = span[:k] >> np.uint64(SCALE + WEIGHT)
        low[:k] += start.astype(np.uint64) * unit
        span[:k] = size.astype(np.uint64) * unit
        out = np.flatnonzero(span[:k] < ONE32)
        if len(out):
            shift(low, span, out)
            words[out, sizes[out]] = (low[out] >> WORD32).astype(np.uint32)
            sizes[out] += 1
            low[out] <<= WORD32
            span[out] <<= WORD32
        before2[:k] = before1[:k]
        before1[:k] = now + 1
        mixer.learn(now)
    words[np.arange(lanes), sizes] = ((low + LOW32) >> WORD32).astype(np.uint32)
    sizes += 1
    return sizes, words[np.arange(steps + 1) < sizes[:, None]]


def shift(low: np.ndarray, span: np.ndarray, out: np.ndarray) -> None:
    """Narrows the spans of lanes whose next word isn't certain yet, so that it is."""
    l, s = low[out], span[out]
    open_ = (l >> WORD32) != ((l + (s - np.uint64(1))) >> WORD32)
    span[out] = np.where(open_, ONE32 - (l & LOW32), s)


def decode_lanes(n: int, symbols: int, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    lanes, steps = lanes_of(n)
    last = n - (lanes - 1) * steps
    table = np.zeros((steps, lanes), np.int32)
    queue = np.concatenate([words.astype(np.uint64), np.zeros(2, np.uint64)])
    at = np.cumsum(sizes) - sizes
    ends = at + sizes
    take = lambda which: np.where(at[which] < ends[which], queue[at[which]], np.uint64(0))
    every = np.arange(lanes)
    code = take(every) << WORD32
    at = np.minimum(at + 1, ends)
    code |= take(every)
    at = np.minimum(at + 1, ends)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    before1, before2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    mixer = Mixer(symbols, inverse=True)
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        if not k:
            break
        mixer.predict(before1[:k], before2[:k])
        unit = span[:k] >> np.uint64(SCALE + WEIGHT)
        value = np.minimum((code[:k] - low[:k]) // unit, np.uint64((1 << (SCALE + WEIGHT)) - 1)).astype(np.int32)
        now = mixer.find(value)
        start, size = mixer.interval(now)
        low[:k] += start.astype(np.uint64) * unit
        span[:k] = size.astype(np.uint64) * unit
        out = np.flatnonzero(span[:k] < ONE32)
        if len(out):
            shift(low, span, out)
            low[out] <<= WORD32
            span[out] <<= WORD32
            code[out] = code[out] << WORD32 | take(out)
            at[out] = np.minimum(at[out] + 1, ends[out])
        table[t, :k] = now
        before2[:k] = before1[:k]
        before1[:k] = now + 1
        mixer.learn(now)
    return np.ascontiguousarray(table.T).reshape(-1)[:n]


def pack_block(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """magic, crc32 of the rest; documents, ids, symbols, lanes, bytes of the index; the index (deflated: null flags, keys,
    sizes); the lanes' numbers of words; their words. Little-endian."""
    symbols = int(ids.max()) + 1
    counts, words = encode_lanes(ids, symbols)
    index = zlib.compress(
        np.array([k is None for k in keys], np.uint8).tobytes() + np.array([k or 0 for k in keys], "<i8").tobytes() + sizes.astype("<u4").tobytes(),
        1,
    )
    body = struct.pack("<IQIII", len(keys), len(ids), symbols, len(counts), len(index)) + index + counts.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def unpack_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, sizes, ids)."""
    head = len(MAGIC) + 4
    if data[: len(MAGIC)] != MAGIC or len(data) < head + 24 or zlib.crc32(memoryview(data)[head:]) != struct.unpack_from("<I", data, len(MAGIC))[0]:
        raise ValueError("damaged block of ids")
    docs, n, symbols, lanes, size = struct.unpack_from("<IQIII", data, head)
    at = head + 24
    index = zlib.decompress(data[at : at + size])
    at += size
    null = np.frombuffer(index, np.uint8, docs)
    keys = np.frombuffer(index, "<i8", docs, docs).tolist()
    sizes = np.frombuffer(index, "<u4", docs, docs * 9).astype(np.int64)
    counts = np.frombuffer(data, "<u4", lanes, at).astype(np.int64)
    words = np.frombuffer(data, "<u4", int(counts.sum()), at + 4 * lanes)
    return [None if z else k for k, z in zip(keys, null, strict=True)], sizes, decode_lanes(n, symbols, counts, words)


class LibraryEncoder:
    """The tokenizers library's ids: its BPE model is asked once for each distinct pre-token that a worker holds. Texts are
    cut and looked up one by one, while their pre-tokens are fresh."""

    #: Of the pre-tokens held, at which those not asked for since half as many were new are left.
    MAX_WORDS = 1_000_000

    def __init__(self, path: str) -> None:
        calm_gc()
        self.pretokens = Pretokenizer(path)
        self.model = self.pretokens.library.model
        self.signs = {b: c for c, b in byte_level().items()}
        self.space = self.signs[ord(" ")]
        self.words = Words(self.ids)

    def ids(self, word: str) -> bytes:
        added = self.pretokens.added.get(word)
        if added is not None:
            return struct.pack("<i", added)
        # (a space is the only printable ASCII sign that stands for another)
        plain = word.isascii() and word.isprintable()
        signs = word.replace(" ", self.space) if plain else word.encode().decode("latin-1").translate(self.signs)
        found = [t.id for t in self.model.tokenize(signs)]
        return struct.pack(f"<{len(found)}i", *found)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if len(self.words) > self.MAX_WORDS // 2:
            self.words.before = {}
            self.words = Words(self.ids, self.words)
        get, cut = self.words.__getitem__, self.pretokens
        return [b"".join(map(get, cut(x))) for x in texts]


class Words(dict):
    """Ids of pre-tokens, made when they are first asked for, or taken from the words held before."""

    def __init__(self, ids: Callable[[str], bytes], before: dict[str, bytes] | None = None) -> None:
        self.ids, self.before = ids, before or {}

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.ids(word)
        self[word] = found
        return found


@cache
def library(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


def write(docs: DataFrame, to: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes each text's ids and the end id, in ascending order of the documents' ids, to the folder ``to``."""
    end = struct.pack("<i", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        rows: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, start, keys, rows, size
            data = pack_block(keys, np.array([len(x) // 4 for x in rows]), np.frombuffer(b"".join(rows), "<i4").astype(np.int64))
            made = pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, block, start, len(keys), size, data)],
                ["part", "block", "start", "n_docs", "n_ids", "data"],
            )
            block, start, keys, rows, size = block + 1, start + size, [], [], 0
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for key, ids in zip(piece.column(0).to_pylist(), library(tokenizer)(piece.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    rows.append(ids + end)
                    size += len(rows[-1]) // 4
                    if size >= block_ids:
                        yield close()
        if rows:
            yield close()

    sorted_ = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("t"),
    ).repartitionByRange("k").sortWithinPartitions("k", "t")
    sorted_.mapInArrow(run, "part long, block long, start long, n_docs long, n_ids long, data binary").write.option("compression", "none").parquet(to)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids): each document's ids as little-endian unsigned 32-bit integers, and the number of ids before them."""
    files = spark.read.parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = files.join(parts.select("part", before.alias("offset")), "part").select((F.col("offset") + F.col("start")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, sizes, ids = unpack_block(data.as_py())
                ends = np.cumsum(sizes)
                raw = pa.py_buffer(ids.astype("<u4").tobytes())
                cut = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(start + ends - sizes), pa.Array.from_buffers(pa.binary(), len(keys), [None, cut, raw])],
                    [id_col, "start", "ids"],
                )

    return blocks.mapInArrow(run, StructType([StructField(id_col, LongType()), *StructType.fromDDL("start long, ids binary")]))
