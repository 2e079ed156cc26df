"""Hard negatives by inner products, with an orthogonal PCA rotation that lets most rows be discarded early.

Vectors are whole numbers, and scores their inner products. Anchors' positives are the rows of their label with the highest
scores; a positive's negatives are the best rows of other labels whose score is between two shares of the positive's.

Rows are dealt into blocks (positives: of one label; negatives: of all labels), and every anchor visits the blocks that it
is compared with: in a task a block's rows come first, then its anchors, a bounded number at a time. A block turns its rows
by the eigenvectors of their second moments, so that leading components hold most of every product. Partial products over
them, accumulated in steps, are off by at most the product of the norms of what is left plus slack for rounding. A row goes
as soon as its highest possible score is below what is asked for, or below as many rows' lowest possible scores as are
wanted, or its lowest is above the range. What survives is verified by products of the whole numbers. A block gives an anchor's
best rows; windows over these few, by anchor and positive, give the result, which is exact.

Blocks have ``n / PARTS`` rows, 1,024 at least and 2^17 at most, so there are enough of them for all cores, and at 10^9 rows
an anchor visits 7,630. All anchors against all rows are the task itself; no pair of rows is written but the best of a block.
A label with a third of all rows is in many blocks.

Rows take no part if the label or the vector is null or a component is null or not finite, or if the squares of the whole
numbers add up to 2^56 or more (so that 100 times a score fits a long). Rows of different lengths aren't compared. Rows with
equal ids are rows of their own: an anchor twice in the table has its negatives twice. A null id is no anchor, and comes
last of equal scores. A label with one row has no positives, and gives nothing; neither does an empty table. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import apart, cut

LEAST_ROWS, MOST_ROWS, PARTS = 1 << 10, 1 << 17, 64
#: Entries of a matrix of partial products.
ENTRIES = 1 << 22
#: Shares of the components after which rows are discarded.
STEPS = (0.25, 0.5)
#: Slack, as a share of both norms: far above what the rotation and sums of 64-bit floats lose.
SLACK = 1e-11


class Block:
    """A block's rows, turned."""

    def __init__(self, ids: np.ndarray, nodes: np.ndarray, labels: np.ndarray, whole: np.ndarray) -> None:
        self.ids, self.nodes, self.labels, self.whole = ids, nodes, labels, whole
        x = whole.astype(np.float64)
        _, vectors = np.linalg.eigh(x.T @ x)
        self.turn = np.ascontiguousarray(vectors[:, ::-1])
        self.x = x @ self.turn
        d = x.shape[1]
        self.cuts = sorted({max(1, round(d * s)) for s in STEPS if d > 1} - {d})
        self.rest = [np.linalg.norm(self.x[:, k:], axis=1) for k in self.cuts]
        self.norm = np.linalg.norm(self.x, axis=1)

    def survivors(
        self, anchors: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, wanted: int,
        inner: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all allowed pairs (anchors by rows) with least <= score <= most, but for some with a score
        below that of ``wanted`` rows in the range (``inner``: in that range); scores are exact."""
        first, last = inner or (least, most)
        a = anchors.astype(np.float64) @ self.turn
        norm = np.linalg.norm(a, axis=1)
        slack = SLACK * norm[:, None] * self.norm[None, :]
        product, done = np.zeros((len(a), len(self.x))), 0
        low = least.astype(np.float64)
        for k, rest in zip(self.cuts, self.rest, strict=True):
            product += a[:, done:k] @ self.x[:, done:k].T
            done = k
            off = np.linalg.norm(a[:, k:], axis=1)[:, None] * rest[None, :] + slack
            below = product - off
            if wanted < below.shape[1]:
                sure = np.where(allowed & (product + off <= last[:, None]) & (below >= first[:, None]), below, -np.inf)
                low = np.maximum(low, np.partition(sure, -wanted, axis=1)[:, -wanted])
            allowed = allowed & (product + off >= low[:, None]) & (below <= most[:, None])
            if np.count_nonzero(allowed) * 4 < allowed.size:
                break
        i, j = np.nonzero(allowed)
        score = np.empty(len(i), np.int64)
        for s in range(0, len(i), 50_000):
            some = slice(s, s + 50_000)
            score[some] = np.einsum("ij,ij->i", anchors[i[some]].astype(np.int64), self.whole[j[some]].astype(np.int64))
        inside = (score >= np.ceil(low)[i]) & (score >= least[i]) & (score <= most[i])
        return i[inside], j[inside], score[inside]

    def best(self, i: np.ndarray, j: np.ndarray, score: np.ndarray, wanted: int) -> np.ndarray:
        """Which of the found pairs are the first ``wanted`` of their anchor, by score, then id."""
        order = np.lexsort((self.nodes[j], self.ids[j], -score, i))
        of = i[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        nth = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        return order[nth < wanted]


#: What a null id counts as in a task.
NO_ID = np.iinfo(np.int64).max


def visits(batches: Iterator[pa.RecordBatch], names: list[str], fn) -> Iterator[pa.RecordBatch]:
    """``fn(block, anchors' ids, nodes, labels, vectors, positives)`` for each block and slices of its anchors. Rows come as
    ``compared`` makes them: key, of, size, part, anchor, id, node, label, whole, positives."""
    key: tuple | None = None
    held: list[list[np.ndarray]] = []
    block: Block | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of, size, part, anchor = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 5))
        change = np.r_[True, (of[1:] != of[:-1]) | (size[1:] != size[:-1]) | (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1])]
        starts = np.flatnonzero(change)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
            if (now := (of[a], size[a], part[a])) != key:
                key, held, block = now, [], None
            some = batch.slice(a, b - a)
            whole = some.column(8).flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(b - a, -1)
            rows = [some.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (5, 6, 7)] + [whole]
            if not anchor[a]:
                held.append(rows)
                continue
            if block is None:
                block = Block(*(np.concatenate(c) for c in zip(*held, strict=True))) if held else None
                if block is None:
                    continue
            each = max(1, ENTRIES // len(block.ids))
            for at in range(0, b - a, each):
                positives = some.column(9).slice(at, each).to_pylist()
                found = fn(block, *(r[at : at + each] for r in rows), positives)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)


def positives_of(block: Block, ids: np.ndarray, nodes: np.ndarray, labels: np.ndarray, whole: np.ndarray, _: list, wanted: int) -> list[np.ndarray]:
    """(anchor, id, node, score): an anchor's best rows of a block of its label."""
    every = np.full(len(ids), np.iinfo(np.int64).max)
    i, j, score = block.survivors(whole, nodes[:, None] != block.nodes[None, :], -every, every, wanted)
    some = block.best(i, j, score, wanted)
    i, j = i[some], j[some]
    return [nodes[i], block.ids[j], block.nodes[j], score[some]]


def negatives_of(
    block: Block, ids: np.ndarray, nodes: np.ndarray, labels: np.ndarray, whole: np.ndarray, positives: list, wanted: int, low: int, high: int,
) -> list[np.ndarray]:
    """(anchor, nth positive, id, node, score): the best rows of a block for each positive of an anchor. Positives come from
    the best to the worst, so the last one's range begins and ends lowest: a row below ``wanted`` rows in it is below as many
    rows of any other range that holds it."""
    scores = np.array([p + p[-1:] * (max(map(len, positives)) - len(p)) for p in positives], np.int64)
    number = np.array(list(map(len, positives)))
    # 100 * score >= low * positive, and 100 * score <= high * positive, in whole numbers
    least, most = -(-low * scores // 100), high * scores // 100
    other = labels[:, None] != block.labels[None, :]
    # (the ranges of negative positives are empty)
    i, j, score = block.survivors(whole, other, least.min(axis=1), most.max(axis=1), wanted, (least[:, -1], most[:, -1]))
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for k in range(scores.shape[1]):
        some = np.flatnonzero((score >= least[i, k]) & (score <= most[i, k]) & (number[i] > k))
        some = some[block.best(i[some], j[some], score[some], wanted)]
        for to, x in zip(out, (nodes[i[some]], np.full(len(some), k + 1), block.ids[j[some]], block.nodes[j[some]], score[some]), strict=True):
            to.append(x)
    return [np.concatenate(x) for x in out]


def wholes(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(node, id, label, size, whole) of the rows that take part; ``node`` tells rows apart."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**20)))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    rows = rows.select("id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("int")).alias("whole"))
    squares = F.aggregate("whole", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.where(squares < float(2**56)).where(F.size("whole") > 0)
    return cut(rows.select(F.monotonically_increasing_id().alias("node"), "id", "label", F.size("whole").alias("size"), "whole"))


def compared(rows: DataFrame, anchors: DataFrame, by_label: bool) -> DataFrame:
    """Rows and the anchors that visit them (see ``visits``), dealt out by block, the block's rows first. ``anchors`` has
    positives."""
    of = F.col("label") if by_label else F.lit(0).cast("long")
    total = rows.groupBy("size").agg(F.count("*").alias("n"))
    rows_each = F.least(F.lit(MOST_ROWS), F.greatest(F.lit(LEAST_ROWS), F.floor(F.col("n") / PARTS)))
    blocks = rows.groupBy("size", of.alias("of")).agg(F.count("*").alias("c")).join(total, "size")
    blocks = apart(cut(blocks.select("size", "of", F.ceil(F.col("c") / rows_each).cast("int").alias("parts"))), "of")
    columns = ["of", "size", "part", "anchor", "id", "node", "label", "whole", "positives"]
    no_id = F.coalesce("id", F.lit(int(NO_ID)))
    left = rows.withColumn("of", of).join(blocks, ["size", "of"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left = left.withColumn("anchor", F.lit(False)).withColumn("positives", F.lit(None).cast("array<long>")).withColumn("id", no_id).select(columns)
    right = anchors.withColumn("of", of).join(blocks, ["size", "of"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.withColumn("anchor", F.lit(True)).withColumn("id", no_id).select(columns)
    both = left.unionByName(right).select(F.xxhash64("of", "size", "part").alias("key"), *columns)
    return both.repartition("key").sortWithinPartitions("of", "size", "part", "anchor")


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), as the module says. ``anchor`` is a
    condition on the column ``id``; ``low`` and ``high`` are hundredths of a positive's score."""
    rows = wholes(vectors, id_col, vector_col, F.col("label") if label is None else label)
    anchors = rows.where(F.coalesce(anchor, F.lit(False)))
    names = ["anchor", "id", "node", "score"]
    found = compared(rows, anchors.withColumn("positives", F.lit(None).cast("array<long>")), by_label=True).mapInArrow(
        lambda b: visits(b, names, lambda *x: positives_of(*x, wanted=positives)), "anchor long, id long, node long, score long",
    )
    order = [F.desc("score"), "id", "node"]
    nth = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    best = cut(found.withColumn("nth", nth).where(F.col("nth") <= positives))
    lists = best.groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("positives"))
    asked = anchors.join(lists.withColumnRenamed("anchor", "node"), "node")
    names2 = ["anchor", "nth", "id", "node", "score"]
    near = compared(rows, asked, by_label=False).mapInArrow(
        lambda b: visits(b, names2, lambda *x: negatives_of(*x, wanted=negatives, low=low, high=high)),
        "anchor long, nth long, id long, node long, score long",
    )
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(*order))
    near = near.withColumn("rank", rank).where(F.col("rank") <= negatives)
    real = F.when(F.col("id") != int(NO_ID), F.col("id"))
    chosen = best.select("anchor", F.col("nth").cast("long").alias("nth"), real.alias("positive_id"), F.col("score").alias("positive_score"))
    of = anchors.select(F.col("node").alias("anchor"), F.col("id").alias("anchor_id"))
    out = near.select("anchor", "nth", "rank", real.alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(chosen, ["anchor", "nth"]).join(of, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    )
