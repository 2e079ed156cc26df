"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

A rotation learnt on a bounded sample (``SAMPLE`` vectors, by a hash of the vector) turns centred unit vectors into balanced
binary codes of up to 64 bits. Every vector is indexed: a code is cut into substrings, one for each table, and each distinct
vector goes to the shuffle under its own value of each substring and under the values at most ``radius`` bits away (of two
values that differ, the one with a 0 at the lowest differing bit does the probing, so a pair meets once in a table). Tables
and radius follow from the number of vectors: more vectors get longer substrings and a wider radius, so groups stay small,
and the pairs at the least cosine that the tables are expected to find stay at ``RECALL`` or more. Tests measure recall
against brute force.

Codes travel first (key, node and code); only rows that have a candidate, i.e. another code within ``far`` bits in their
group, fetch their vectors and meet again, where the cosine in double precision decides. A pair that meets in several tables
counts in the first. Equal vectors travel once, with their number. A task gives, for each value, how many links each vector
has there and a forest that connects them, never the pairs. A value that more than ``MEMBERS`` vectors share is dealt out
as pairs of chunks.

``far`` = 64 lets no candidate go unlooked at; the default is 2.5 standard deviations beyond the bits that are expected to
differ at the least cosine, which costs less than 1 % of the pairs there and none of the closer ones.

Vectors that are null or zero, or that hold null or non-finite components, link with nothing; they are kept, as classes of
their own. Vectors of different lengths link with nothing of another length; each length that several vectors have gets an
index of its own. Rows with equal ids are kept; they share a class through their vectors only. Null ids are kept, and are
no class's id unless all of its ids are null. An empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._common import apart, components, cut
from .simhash import flips, values

SAMPLE, MEMBERS = 8192, 2048
#: The expected share of pairs at the least cosine that meet in some table.
RECALL = 0.93
#: Codes compared that cost as much as one row more in the shuffle.
CHEAP = 500


def design(n: int, bits: int, least: float) -> tuple[int, int]:
    """(tables, radius): the cheapest with the expected recall, for n vectors with codes of so many bits. Vectors that fit
    in one group need no tables."""
    if n <= MEMBERS:
        return 0, 0
    p = acos(min(1.0, max(-1.0, least))) / pi
    best = None
    for tables in range(1, bits + 1):
        w = bits / tables
        for radius in range(min(4, int(w) + 1)):
            inside = [comb(ceil(w), j) for j in range(radius + 1)]
            found = sum(c * p**j * (1 - p) ** (w - j) for j, c in enumerate(inside))
            if 1 - (1 - min(1.0, found)) ** tables < RECALL:
                continue
            cost = tables * (1 + sum(inside[1:]) / 2 + n * sum(inside) / 2**w / CHEAP)
            if best is None or cost < best[0]:
                best = (cost, tables, radius)
    return best[1:] if best else (bits, 1)


def far_bits(bits: int, least: float) -> int:
    p = acos(min(1.0, max(-1.0, least))) / pi
    return min(64, int(bits * p + 2.5 * sqrt(bits * p * (1 - p))) + (bits < 32))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, also those whose squares leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Quantizer:
    """Centre, projection and rotation; ``bits`` cut into substrings."""

    def __init__(self, sample: np.ndarray, n: int, least: float, rounds: int = 40, seed: int = 3) -> None:
        x = units(sample)
        bits = min(64, x.shape[1])
        self.mean = x.mean(axis=0)
        c = x - self.mean
        _, vectors = np.linalg.eigh(c.T @ c)
        project = vectors[:, ::-1][:, :bits]
        v = c @ project
        rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        self.turn = project @ rotation
        tables, self.radius = design(n, bits, least)
        self.parts = [p.tolist() for p in np.array_split(np.arange(bits), tables)] if tables else [[]]
        self.far = far_bits(bits, least) if tables else 64

    def codes(self, x: np.ndarray) -> np.ndarray:
        ones = (units(x) - self.mean) @ self.turn >= 0
        wide = np.zeros((len(x), 64), np.uint8)
        wide[:, : ones.shape[1]] = ones
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64).ravel()

    def probes(self, key: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Whether each row stands under a value that isn't its own; all rows of one table."""
        return values(code, self.parts[int(key[0] >> 56)]).astype(np.int64) != key & ((1 << 56) - 1)


def usable(v: Column) -> Column:
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def listed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector or null, a, b): usable vectors as arrays of floats, if they are that, else of doubles, and 128 bits that
    stand for a vector (for one that isn't usable, for its id)."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    v = F.transform(v, lambda x: x + F.lit(0).cast("float" if single else "double"))  # -0.0 becomes 0.0
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    rows = rows.select("id", F.when(usable(F.col("v")), F.col("v")).alias("vector"))
    stands = [F.coalesce(F.when(F.col("vector").isNotNull(), F.xxhash64("vector", F.lit(k))), F.xxhash64("id", F.lit(k))) for k in ("a", "b")]
    return rows.select("id", "vector", stands[0].alias("a"), stands[1].alias("b"))


def keyed(reps: DataFrame, quantizer: Quantizer) -> DataFrame:
    """(key, node, code): each vector under its own substrings and under those it probes."""
    shared = reps.sparkSession.sparkContext.broadcast(quantizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Quantizer = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node = part.column(0).to_numpy(zero_copy_only=False)
                code = q.codes(np.array(part.column(1).to_pylist(), np.float64))
                every = np.arange(len(code))
                for i, bits in enumerate(q.parts):
                    own = values(code, bits)
                    keys, rows = [own], [every]
                    for places in flips(len(bits), q.radius):
                        zero = (own >> np.uint64(places[0])) & np.uint64(1) == 0
                        keys.append(own[zero] ^ np.uint64(sum(1 << k for k in places)))
                        rows.append(every[zero])
                    row = np.concatenate(rows)
                    key = np.concatenate(keys).astype(np.int64) | i << 56
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(code[row].view(np.int64))], ["key", "node", "code"])

    return reps.select("node", "vector").mapInArrow(run, "key long, node long, code long")


def candidates(
    q: Quantizer, far: int, key: np.ndarray, low: np.ndarray, high: np.ndarray, chunk: np.ndarray, code: np.ndarray,
) -> Iterator[tuple[slice, np.ndarray]]:
    """For blocks of a group's rows which of all its rows may be linked with each, where the pair meets for the first time."""
    n, table = len(code), int(key[0] >> 56)
    code = code.view(np.uint64)
    probe = q.probes(key, code)
    for a in range(0, n, 512):
        part = slice(a, a + 512)
        apart_ = code[part, None] ^ code[None, :]
        ok = np.bitwise_count(apart_) <= far
        ok &= ~(probe[part, None] & probe[None, :])
        ok &= np.arange(n)[part, None] != np.arange(n)[None, :]
        if low[0] != high[0]:
            ok &= chunk[part, None] != chunk[None, :]
        for bits in q.parts[:table]:
            if not ok.any():
                break
            ok &= np.bitwise_count(apart_ & np.uint64(sum(1 << b for b in bits))) > q.radius
        yield part, ok


def promising(q: Quantizer, far: int, group: list[np.ndarray]) -> list[np.ndarray]:
    """The rows of a group (key, low, high, chunk, node, code) that have a candidate."""
    key, low, high, chunk, node, code = group
    some = np.concatenate([ok.any(axis=1) for _, ok in candidates(q, far, key, low, high, chunk, code)])
    return [x[some] for x in (key, low, high, chunk, node)]


def linked(q: Quantizer, far: int, least: float, group: list[np.ndarray]) -> list[np.ndarray]:
    """(u, v, links) of a group (key, low, high, chunk, node, n, vector): links of u in it, and a node that it is connected
    with."""
    key, low, high, chunk, node, count, x = group
    n, unit, code = len(key), units(x), q.codes(x).view(np.int64)
    near = np.zeros((n, n), bool)
    for part, ok in candidates(q, far, key, low, high, chunk, code):
        i, j = np.nonzero(ok)
        if len(i) * 8 > ok.size:
            ok &= unit[part] @ unit.T >= least
        else:
            hit = np.zeros(len(i), bool)
            for s in range(0, len(i), 100_000):
                some = slice(s, s + 100_000)
                hit[some] = np.einsum("ij,ij->i", unit[part.start + i[some]], unit[j[some]]) >= least
            ok[i, j] = hit
        near[part] = ok
    links, label = near @ count, np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            some = near.any(axis=1)
            return [node[some], node[label[some]], links[some]]
        label = new


def by_group(batches: Iterator[pa.RecordBatch], columns: int, names: list[str], fn) -> Iterator[pa.RecordBatch]:
    """``fn`` on each group of rows sorted by (key, low, high), the first columns; groups of one row are left out. A last
    column beyond ``columns`` has lists of numbers."""
    held: list[np.ndarray] | None = None

    def groups(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, low, high = rows[:3]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        out = [[np.zeros(0, np.int64)] for _ in names]
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)], strict=True):
            if b - a > 1:
                for to, found in zip(out, fn([x[a:b] for x in rows]), strict=True):
                    to.append(found)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(columns)]
        if batch.num_columns > columns:
            lists = batch.column(columns)
            rows.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1))
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
        ended = int(np.searchsorted(last, True))
        if ended:
            yield groups([c[:ended] for c in rows])
        held = [c[ended:] for c in rows]
    if held is not None:
        yield groups(held)


def links_of(reps: DataFrame, size: int, n: int, least: float, far: int | None, members: int) -> DataFrame:
    """(u, v, links) for the vectors of one length, of which there are n (node, n, vector)."""
    own = reps.where(F.size("vector") == size)
    sample = own.orderBy(F.xxhash64("vector", F.lit("itq")), "node").limit(SAMPLE).select("vector").toArrow().column(0).to_pylist()
    q = Quantizer(np.array(sample, np.float64), n, least)
    far = q.far if far is None else far
    rows = keyed(own, q)
    large = cut(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > members))
    where = ["key", "low", "high"]
    if large.isEmpty():
        rows = rows.select("key", *[F.lit(0).alias(c) for c in ("low", "high", "chunk")], "node", "code")
    else:
        chunks = large.select("key", F.ceil(F.col("c") / members).cast("int").alias("c"))
        rows = rows.join(chunks, "key", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn(
            "chunk", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"),
        )
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        rows = rows.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "code")
    shared = reps.sparkSession.sparkContext.broadcast(q)
    dealt = rows.repartition(*where).sortWithinPartitions(*where)
    names = [*where, "chunk", "node"]
    some = dealt.mapInArrow(lambda b: by_group(b, 6, names, lambda g: promising(shared.value, far, g)), ", ".join(f"{c} long" for c in names))
    fetched = some.join(own.select("node", "n", "vector"), "node").select(*names, "n", "vector")
    dealt = fetched.repartition(*where).sortWithinPartitions(*where)
    return dealt.mapInArrow(lambda b: by_group(b, 6, ["u", "v", "links"], lambda g: linked(shared.value, far, least, g)), "u long, v long, links long")


def near_duplicates(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", members: int = MEMBERS,
    far: int | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    every = listed(vectors, id_col, vector_col)
    reps = every.where("vector is not null").groupBy("a", "b", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = cut(reps)
    sums = reps.agg(F.count("*").alias("n"), F.count_distinct("rep").alias("ids")).first()
    # least ids are nodes, so a component's least node is its least id; null and repeated ids make vectors the nodes
    own = sums["n"] == sums["ids"] and dict(reps.dtypes)["rep"] in ("bigint", "int", "smallint", "tinyint")
    reps = reps.withColumn("node", F.col("rep" if own else "a").cast("long"))
    sizes = reps.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).where("n > 1").orderBy("size").collect()
    none = vectors.sparkSession.createDataFrame([], "u long, v long, links long")
    links = cut(reduce(DataFrame.unionByName, [links_of(reps, x["size"], x["n"], least, far, members) for x in sizes], none))
    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    found = reps.drop("vector").join(counts, "node", "left").join(components(links.select("u", "v")), "node", "left")
    found = found.select("a", "b", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    if not own:
        tops = found.groupBy("component").agg(F.min("rep").alias("least"))
        found = found.join(apart(tops, "component"), "component").withColumn("component", F.col("least"))
    out = every.select("id", "a", "b").join(found.select("a", "b", "links", "component", F.lit(True).alias("known")), ["a", "b"], "left")
    component = F.when(F.col("known"), F.col("component")).otherwise(F.col("id")).cast("long")
    kept = F.coalesce(F.col("id") == component, F.lit(False))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        kept.alias("kept"),
    )
