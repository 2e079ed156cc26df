"""Vector best-fit packing of token sequences.

A piece needs ids, one document and attention cost (its length squared); a sequence has a capacity for each. Pieces are
taken by falling length, and each goes to the sequence that it fits best: of all that can take it under every capacity,
the one with the smallest weighted norm of what would be left (``measure="norm"``), or the smallest weighted dot product of
the piece and what is left (``"dot"``: the sequence that is tightest where the piece is large); of equal ones the first
opened. Both only fall as a sequence fills, so pieces of one length fill a sequence before they start on the next.

That makes the result a function of the lengths' counts: ``plan`` works on runs of sequences with equal contents, of which
there are at most a few for each length, whatever the number of documents. What is collected is one count for each length
(the capacity at most), what is broadcast is the plan. Each piece finds its place by its rank among those of its length:
the pieces of earlier partitions, from sums over (partition, length), and its number in its own partition, which the task
that cuts the texts gives it. Nothing else meets: no task sees a whole length, and ids aren't shuffled.

Null and empty texts have the end id alone. Texts of any length are encoded whole and cut into pieces of the largest length
that an empty sequence takes. Null and repeated document ids are kept, each row for itself; equal rows are packed as often
as they come. An empty table gives no rows. ``write`` leaves other columns out, whatever their names; ``place`` keeps all
columns of the pieces and adds its two.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ._common import LETTERS, NUMBERS, SPACES, UNKNOWN, byte_level, calm_gc, cut


@dataclass(frozen=True)
class Limits:
    """What a sequence takes at most. ``docs`` and ``attention`` may be left open: then no sequence of ``tokens`` ids reaches
    them. ``weights`` are those of ids, documents and attention cost, each a share of its capacity."""

    tokens: int = 2048
    docs: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    measure: str = "norm"

    @property
    def capacity(self) -> np.ndarray:
        docs = self.tokens if self.docs is None else self.docs
        return np.array([self.tokens, docs, self.tokens**2 if self.attention is None else self.attention], np.int64)

    @property
    def longest(self) -> int:
        return min(int(self.capacity[0]), isqrt(int(self.capacity[2])))

    def __post_init__(self) -> None:
        if self.weights[0] <= 0 or min(self.weights) < 0 or self.measure not in ("norm", "dot") or self.longest < 1 or self.capacity[1] < 1:
            raise ValueError("limits must take one id, weights must not be negative, and ids must weigh something")

    def score(self, left: np.ndarray, need: np.ndarray) -> np.ndarray:
        """How well something that needs ``need`` fits where ``left`` is left; the smaller the better."""
        a, b, w = left / self.capacity, need / self.capacity, np.array(self.weights)
        return ((a - b) ** 2 * w).sum(axis=-1) if self.measure == "norm" else (a * b * w).sum(axis=-1)


@dataclass(frozen=True)
class Plan:
    """Where pieces go: those of ``length`` from rank ``first`` on go to the sequences from ``sequence`` on, ``each`` of
    them in one, the first at ``offset``. Rows are sorted by length and rank."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = np.searchsorted(self.length << 44 | self.first, length << 44 | rank, "right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def plan(lengths: np.ndarray, counts: np.ndarray, limits: Limits = Limits()) -> Plan:
    """Vector best-fit decreasing over the counts of lengths. Runs of sequences are rows (first sequence, number, what is
    left of each capacity)."""
    runs = np.zeros((0, 5), np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0
    order = np.argsort(-np.asarray(lengths), kind="stable")
    shortest = int(min(lengths, default=1))
    least = np.array([shortest, 1, shortest**2])
    for length, count in zip(np.asarray(lengths)[order].tolist(), np.asarray(counts)[order].tolist(), strict=True):
        need, rank = np.array([length, 1, length**2]), 0
        runs = runs[(runs[:, 2:] >= least).all(axis=1)]
        while rank < count:
            fits = np.flatnonzero((runs[:, 2:] >= need).all(axis=1))
            if len(fits):
                score = limits.score(runs[fits, 2:], need)
                best = fits[score == score.min()]
                at = best[np.argmin(runs[best, 0])]
                first, number, left = int(runs[at, 0]), int(runs[at, 1]), runs[at, 2:].copy()
                runs = np.delete(runs, at, axis=0)
            else:
                first, left = opened, limits.capacity
                number = -(-(count - rank) // int((left // need).min()))
                opened += number
            each = int((left // need).min())
            rows.append((length, rank, first, each, limits.tokens - int(left[0])))
            full = min(number, (count - rank) // each)
            rank += full * each
            made = [(first, full, *(left - each * need))] if full else []
            used = full
            if full < number and rank < count:
                made.append((first + full, 1, *(left - (count - rank) * need)))
                rank, used = count, full + 1
            if used < number:
                made.append((first + used, number - used, *left))
            runs = np.vstack([runs, np.array(made, np.int64)])
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return Plan(*(np.ascontiguousarray(c) for c in table.T), sequences=opened)


# The published pattern of word-end BPE, over lower-cased text, for the classes of code points below U+0250
#   's|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+
# (letters first here: they can't begin with an apostrophe)
_WORDS = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


class WordEncoder:
    """The ids that the library gives for a file of this kind: NFC, lower case, pre-tokens by the pattern above, byte-level
    BPE with word ends. The library's BPE model is asked once for each distinct pre-token that a worker holds. Texts beyond
    Latin script are encoded by the library itself, by chunks: white space ends every pre-token and leaves none, so a text's
    ids are those of its chunks between the six ASCII white-space signs."""

    MAX_WORDS = 500_000

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        calm_gc()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.signs = {b: c for c, b in byte_level().items()}
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: ids by pre-token, and by chunk (as bytes)
        self.words: dict[str | bytes, bytes] = {}

    def cut(self, text: str | None) -> list[str] | list[bytes]:
        """Pre-tokens, or chunks where the pattern doesn't know a sign or added tokens are in the text."""
        if not text:
            return []
        low = text.lower()
        known = text.isascii() or not (UNKNOWN.search(text) or UNKNOWN.search(low))
        if known and not any(t in text for t in self.added):
            return _WORDS.findall(low)
        return text.encode().split()

    def ids(self, word: str | bytes) -> bytes:
        if isinstance(word, bytes):
            return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        found = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.signs))]
        return struct.pack(f"<{len(found)}I", *found)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        words = self.words
        cut_ = list(map(self.cut, texts))
        seen = set(chain.from_iterable(cut_))
        if len(words) > self.MAX_WORDS:
            self.words = words = {w: words[w] for w in seen if w in words}
        for word in seen.difference(words):
            words[word] = self.ids(word)
        get = words.__getitem__
        return [b"".join(map(get, x)) for x in cut_]


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(
    docs: DataFrame, to: str, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Writes the pieces of each text's ids and the end id to the folder ``to``: (id, piece, start, length, ids as
    little-endian unsigned 32-bit integers, part, nth). ``part`` is the task's partition and ``nth`` the piece's number
    among those of its length there."""
    longest, end = limits.longest, np.array([end_id], "<u4").tobytes()
    names = [id_col, "piece", "start", "length", "ids", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, met = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                coded = [ids + end for ids in encoder(tokenizer)(some.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in coded], np.int64)
                pieces = -(-sizes // longest)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * longest
                length = np.minimum(longest, sizes[doc] - start)
                order = np.argsort(length, kind="stable")
                of = length[order]
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)])) + met[of]
                met += np.bincount(length, minlength=longest + 1)
                # pieces of a document lie one after another, so all ids of the slice are one buffer
                ends = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int64)
                ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(coded))])
                rows = [some.column(0).take(pa.array(doc)), piece.astype(np.int32), start, length, ids.cast(pa.binary()), np.full(len(doc), part), nth]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in rows], names)

    schema = StructType(
        [StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("piece int, start long, length long, ids binary, part long, nth long")],
    )
    docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema).write.option("compression", "zstd").parquet(to)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def place(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The pieces with sequence_id and offset. Only the columns length, part and nth are looked at."""
    counts = cut(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # a row for each length: limits.longest at most
    shared = pieces.sparkSession.sparkContext.broadcast(plan(histogram.column(0).to_numpy(), histogram.column(1).to_numpy(), limits))

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = shared.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    row = pieces.select(F.struct("*").alias("row"), "part", "length", "nth")
    found = row.join(bases, ["part", "length"]).select("row", find("length", F.col("nth") + F.col("before")).alias("at"))
    return found.select("row.*", "at.sequence_id", "at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): each sequence's ids, and its pieces' lengths in their order. A sequence's pieces meet in
    one row, which its capacities bound."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return placed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("p.length").alias("lengths"),
    )
