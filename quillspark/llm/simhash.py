"""SimHash near-dedup with the generalised pigeonhole principle.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Two
fingerprints are linked if at most ``radius`` bits differ. The bits are cut into partitions with thresholds t_i such that
sum(t_i + 1) = radius + 1: linked fingerprints then differ by at most t_i bits in some partition i. Bits that go
together in a sample are put into the same partition, which leaves the partitions themselves less dependent; the
thresholds, unequal where that pays, come from a dynamic program over the candidates that the sample lets expect and the
variants to be probed. Each distinct fingerprint is indexed under its own value of every partition and probes the values
within t_i bits; what meets under a value is verified on all 64 bits.

Copies share a fingerprint, so they never meet as rows. A task works through the sorted values of its shuffle partition
and gives, for each value, a forest that connects what is linked there, never all pairs. A value that more than
``MEMBERS`` fingerprints share is dealt out as pairs of chunks, so no task holds an unbounded group. The sample is
bounded by ``SAMPLE``; it sets the plan's speed only, never its result.

Texts without words (null, empty, blank) have fingerprint zero and are linked like any other. Texts of any length are
hashed whole, in the task that reads them. Rows with equal ids are kept as they come. Null ids are kept, and are no class's
id unless all of its ids are null. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import apart, components, cut, fields, map_columns

SAMPLE = 2048
MEMBERS = 16_384
#: Verified candidates that cost as much as a probed value.
CHEAP = 20.0


def simhash(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint as an unsigned integer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(joined[a:b], seed) for a, b in zip(starts[:k].tolist(), last.tolist(), strict=True)), np.uint64, k)
    byte = hashes.view(np.uint8).reshape(k, 8)
    if k < 64:
        ones = np.unpackbits(byte, axis=1, bitorder="little").sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(byte[:, j], minlength=256) @ BITS for j in range(8)])
    return int(np.packbits(ones * 2 > k, bitorder="little").view(np.uint64)[0])


#: The bits of each byte, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a long."""

    def run(keys: pa.Array, texts: pa.Array) -> list:
        found = np.array([simhash(t, width, seed) for t in texts.to_pylist()], np.uint64)
        return [keys, pa.array(found.view(np.int64))]

    return map_columns(docs, [id_col, text_col], fields(docs, (id_col,), "fp long"), run)


# -- The plan: partitions and thresholds -----------------------------------------------------------------------------


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size; each takes the bits most correlated with those it has."""
    spread = bits - bits.mean(axis=0)
    scale = np.sqrt((spread**2).sum(axis=0))
    like = np.abs(spread.T @ spread) / np.maximum(np.outer(scale, scale), 1e-9)
    left, out = list(range(bits.shape[1])), []
    for i in range(parts):
        size = len(left) // (parts - i)
        first = max(left, key=lambda b: (like[b, left].sum(), -b))
        own = [first]
        left.remove(first)
        while len(own) < size:
            near = max(left, key=lambda b: (like[b, own].sum(), -b))
            own.append(near)
            left.remove(near)
        out.append(sorted(own))
    return out


def thresholds(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """The cheapest t_i >= -1 with sum(t_i + 1) = radius + 1; costs[i][t + 1] is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t1, more in enumerate(own):
                n = used + t1
                if n <= radius + 1 and (n not in step or cost + more < step[n][0]):
                    step[n] = (cost + more, [*chosen, t1 - 1])
        best = step
    return best[radius + 1]


def plan(sample: np.ndarray, n: int, radius: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) for each partition, from a sample of distinct fingerprints and the number of all."""
    if len(sample) < 2:
        sample = np.array([0, 2**64 - 1], np.uint64)
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    pairs = max(1, len(sample) * (len(sample) - 1))
    found = None
    for parts in range(2, radius + 2):
        groups, costs = group_bits(bits, parts), []
        for own in groups:
            b = bits[:, own]
            apart = b @ (1 - b).T
            apart = (apart + apart.T).astype(np.int64)
            near = np.cumsum(np.bincount(np.minimum(apart, radius + 1).ravel(), minlength=radius + 2))
            costs.append([0.0] + [n * (1 + sum(comb(len(own), j) for j in range(1, t + 1)) / 2) + n * n / 2 * max(0.0, float(near[t] - len(sample)) / pairs) / CHEAP for t in range(radius)])
        cost, chosen = thresholds(costs, radius)
        if found is None or cost < found[0]:
            found = (cost, [(own, t) for own, t in zip(groups, chosen, strict=True) if t >= 0])
    return found[1]


# -- Probing and verifying -------------------------------------------------------------------------------------------


def values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def flips(width: int, most: int) -> list[list[int]]:
    """The sets of one to ``most`` positions."""
    sets: list[list[int]] = [[]]
    out: list[list[int]] = []
    for _ in range(most):
        sets = [[*s, k] for s in sets for k in range(s[-1] + 1 if s else 0, width)]
        out += sets
    return out


def keyed(fps: DataFrame, design: list[tuple[list[int], int]]) -> DataFrame:
    """(key, probe, fp, node): each fingerprint under its own values (probe 0) and under the values it probes (probe 1). Of
    two values that differ, the one with 0 at the lowest differing bit does the probing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = batch.column(0)[at : at + 20_000].to_numpy(zero_copy_only=False).view(np.uint64)
                node = batch.column(1)[at : at + 20_000].to_numpy(zero_copy_only=False)
                every = np.arange(len(fp))
                for i, (bits, most) in enumerate(design):
                    own = values(fp, bits)
                    keys, probes, rows = [own], [np.zeros(len(fp), np.int8)], [every]
                    for places in flips(len(bits), most):
                        zero = (own >> np.uint64(places[0])) & np.uint64(1) == 0
                        keys.append(own[zero] ^ np.uint64(sum(1 << k for k in places)))
                        rows.append(every[zero])
                        probes.append(np.ones(int(zero.sum()), np.int8))
                    key = np.concatenate(keys).astype(np.int64) | i << 56
                    row = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(np.concatenate(probes)), pa.array(fp[row].view(np.int64)), pa.array(node[row])],
                        ["key", "probe", "fp", "node"],
                    )

    return fps.select("fp", "node").mapInArrow(run, "key long, probe tinyint, fp long, node long")


def forest(fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (of places) that connect what is linked in one large group: least labels spread over the links, in blocks."""
    n = len(fp)
    label = np.arange(n)
    while True:
        new = label.copy()
        for a in range(0, n, 512):
            near = np.bitwise_count(fp[a : a + 512, None] ^ fp[None, :]) <= radius
            near &= (probe[a : a + 512, None] + probe[None, :]) < 2
            least = np.where(near, label[None, :], n).min(axis=1)
            np.minimum(new[a : a + 512], least, out=new[a : a + 512])
            np.minimum.at(new, label[a : a + 512], least.clip(max=label[a : a + 512]))
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def linked(batches: Iterator[pa.RecordBatch], radius: int, small: int = 48) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: pairs (u, v) of nodes that connect what is linked in each group."""

    def pairs(keys: np.ndarray, probe: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero(sizes > small):
            part = slice(first[k], first[k] + sizes[k])
            u, v = forest(fp[part], probe[part], radius)
            us.append(node[part][u])
            vs.append(node[part][v])
        low = np.repeat(sizes <= small, sizes)
        left = np.repeat(first + sizes, sizes) - np.arange(len(keys))  # rows to the end of the group
        at = np.flatnonzero(low & (left > 1))
        step = 1
        while len(at):
            u, v = fp[at], fp[at + step]
            ok = (np.bitwise_count(u ^ v) <= radius) & (probe[at] + probe[at + step] < 2) & (u != v)
            us.append(node[at[ok]])
            vs.append(node[at[ok] + step])
            step += 1
            at = at[left[at] > step]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        key, probe, fp, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        rows = [key, probe.astype(np.int64), fp.view(np.uint64), node]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        ended = int(np.searchsorted(rows[0] == rows[0][-1], True)) if len(rows[0]) else 0
        if ended:
            yield pairs(*(x[:ended] for x in rows))
        held = [x[ended:] for x in rows]
    if held is not None and len(held[0]):
        yield pairs(*held)


def links(fps: DataFrame, design: list[tuple[list[int], int]], radius: int = 4, members: int = MEMBERS) -> DataFrame:
    """(u, v): pairs of nodes of ``fps`` (fp, node; each fingerprint once) at most ``radius`` bits apart that connect all that
    are linked."""
    rows = keyed(fps, design)
    large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > members))
    if not large.isEmpty():
        chunks = large.select("key", F.ceil(F.col("n") / members).cast("int").alias("c"))
        rows = rows.join(chunks, "key", "left").withColumn("own", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("c"))))
        other = F.explode(F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1)))
        rows = rows.withColumn("other", other)
        # the upper byte has the partition, which leaves room for a hash of the pair of chunks
        rows = rows.select(
            F.when(F.col("c").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"),
            "probe", "fp", "node",
        )
    dealt = rows.repartition("key").sortWithinPartitions("key", "fp", "probe")
    return dealt.mapInArrow(lambda batches: linked(batches, radius), "u long, v long").distinct()


def classes(fps: DataFrame, radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id): for each distinct fingerprint of ``fps`` (id, fp) the least id that its links reach.

    Where every fingerprint has a least id of its own, that id is its node, and the least node of a component is the
    answer; null or repeated ids make the fingerprints themselves the nodes."""
    firsts = cut(fps.groupBy("fp").agg(F.min(id_col).alias("first")))
    sums = firsts.agg(F.count("*").alias("n"), F.count_distinct("first").alias("ids")).first()
    own = sums["n"] == sums["ids"] and dict(firsts.dtypes)["first"] in ("bigint", "int", "smallint", "tinyint")
    sample = firsts.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = firsts.select("fp", "first", F.col("first" if own else "fp").cast("long").alias("node"))
    found = components(links(nodes, plan(sample, sums["n"], radius), radius))
    joined = nodes.join(found, "node", "left").withColumn("top", F.coalesce("component", "node"))
    if own:
        return joined.select("fp", F.col("top").cast(firsts.schema["first"].dataType).alias("component_id"))
    least = joined.groupBy("top").agg(F.min("first").alias("component_id"))
    return joined.join(apart(least, "top"), "top").select("fp", "component_id")


def digits(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) for each row."""
    fps = cut(fingerprints(docs, id_col, text_col, width, seed))
    joined = fps.join(classes(fps, radius, id_col), "fp")
    return joined.select(id_col, digits("fp").alias("fingerprint"), "component_id")
