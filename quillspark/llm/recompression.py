"""Removal of repeated passages by recompression.

Words are named by 64-bit hashes. The first round names runs of a word, and every round then names pairs: a hash of a
symbol's name and the round's number puts it into a left or a right class, and each left symbol followed by a right one
becomes one symbol, named by a hash of the two names. Equal pairs so get equal names everywhere, and equal passages are
cut alike but for what touches their borders. For each window of ``width`` words the core is what remains certain when a
round's border symbols that might join their outer neighbours are left off; it depends on the window's words alone. The
longest core symbol of the higher rounds stands for the window (of equally long ones the one with the highest hash, which
neighbouring windows then share).

1. Each document sends the symbols that stand for its windows, once for each stretch of windows, and one that stands for
   all its words, to the shuffle that names them globally: a symbol that only one document has reveals no repeat, and
   its windows are done.
2. Stretches of shared symbols go back to their documents, which send those windows, as 80-bit hashes, to the second
   shuffle; it verifies them and finds each window's first document. A copy of an earlier document sends its whole
   instead of its windows.
3. What is covered by a window with an earlier document goes.

Names are 64-bit hashes of what they stand for, so a name is global without a lookup and rounds need no shuffle of all
words; the shuffles are those of 1 and 2. Two different windows count as equal if their 80 bits agree: with n shared
windows the chance that this happens at all is about n^2 / 2^81. Wrong names in 1 only send more windows to 2.

Windows of runs, whose cores are empty, stand for themselves. Hot symbols and windows are combined where they arise: of
the documents that one part of a batch (about two megabytes) holds, the first sends its row under the symbol or window,
and the others' rows, which are known to repeat it, travel under keys of their own. So a passage that a third of all
documents share has a row for each part, not for each document, in the task that finds its first document. Texts travel
deflated by Zstandard, in one exchange that steps 2 and 3 share.

Null and empty texts have no words. Rows with equal ids are one document's rows: none repeats another. Rows with a null id
neither lose words nor take any from others. Texts with fewer words than a window lose none. Texts of any length are
taken whole: a text's words and stretches are in one task, as the text itself is. Every row is kept; an empty table gives
no rows; columns that aren't asked for are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fields, map_columns

ROUNDS = 3
MAX_WORDS = 150_000
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: A worker's names of words.
NAMES: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * B
    return x ^ (x >> np.uint64(29))


def named(words: list[bytes]) -> np.ndarray:
    """The words' names."""
    seen = set(words)
    if len(NAMES) > MAX_WORDS:
        kept = {w: NAMES[w] for w in seen if w in NAMES}
        NAMES.clear()
        NAMES.update(kept)
    for w in seen.difference(NAMES):
        NAMES[w] = xxhash.xxh64_intdigest(w, 9)
    return np.fromiter(map(NAMES.__getitem__, words), np.uint64, len(words))


def highest(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the highest rank is in each range [low, high), the first of equal ones: from tables for powers of two."""
    log = np.frompyfunc(int.bit_length, 1, 1)(np.arange(int((high - low).max(initial=1)) + 1)).astype(np.int64) - 1
    tables = [np.arange(len(rank))]
    for j in range(int(log[-1])):
        t = tables[-1]
        other = t[np.minimum(np.arange(len(rank)) + (1 << j), len(rank) - 1)]
        tables.append(np.where(rank[other] > rank[t], other, t))
    table, k = np.stack(tables), log[high - low]
    a, b = table[k, low], table[k, high - (1 << k)]
    return np.where(rank[b] > rank[a], b, a)


def symbols(names: np.ndarray, doc: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each window (at the word where it starts) whether it is in one document, and the symbol that stands for it.

    ``names``: the words of several documents one after another; ``doc``: the document of each."""
    n = len(names)
    if n < width:
        return np.zeros(0, bool), np.zeros(0, np.uint64)
    w = n - width + 1
    inside = doc[:w] == doc[width - 1 :]
    stands = window_hash(names, width, B)  # of windows without a core
    longest = np.zeros(w, np.int64)
    # runs of words
    first = np.r_[True, (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])]
    at = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    size = np.diff(np.r_[at, n])
    name = np.where(size > 1, mixed(names[at] + size.astype(np.uint64) * C), names[at])
    doc = doc[at]
    low, high = run[:w] + 1, run[width - 1 :]  # the core: complete runs, from the second to the last but one
    live = np.flatnonzero(inside & (low < high))
    low, high = low[live], high[live]
    for k in range(rounds):
        right = (mixed(name + np.uint64((k + 1) * int(A) % 2**64)) >> np.uint64(17)) & np.uint64(1) == 1
        joined = np.r_[False, ~right[:-1] & right[1:] & (doc[1:] == doc[:-1])]
        at = np.flatnonzero(~joined)
        to = np.cumsum(~joined) - 1
        low = low + right[low]
        high = high - ~right[high - 1]
        ok = low < high
        live, low, high = live[ok], to[low[ok]], to[high[ok] - 1] + 1
        after = np.minimum(at + 1, len(size) - 1)
        pair = joined[after] & (at + 1 < len(size))
        size = size[at] + np.where(pair, size[after], 0)
        name = np.where(pair, mixed(name[at] * A ^ mixed(name[after] + C)), name[at])
        doc = doc[at]
        if k and len(live):
            pick = highest((size << 24) + (mixed(name) >> np.uint64(41)).astype(np.int64), low, high)
            better = size[pick] >= longest[live]
            pick, at = pick[better], live[better]
            stands[at], longest[at] = name[pick], size[pick]
    return inside, stands


def window_hash(names: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of each ``width`` names in a row."""
    w = len(names) - width + 1
    out = np.zeros(max(0, w), np.uint64)
    for j in range(width if w > 0 else 0):
        out = out * base + names[j : j + w]
    return mixed(out)


def batch_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The names of all texts' words, and the text of each."""
    rows = [t.split() if t else [] for t in texts]
    sizes = list(map(len, rows))
    return named([w for r in rows for w in r]), np.repeat(np.arange(len(rows), dtype=np.int64), sizes)


def slices(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes in a column, one row at least."""
    size = np.array([0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()])
    at = 0
    ends = np.cumsum(size)
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def packed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """(doc, row, z) and the kept columns: the id, what tells different texts with equal ids apart (a hash; 0 where ids are
    unique), and the text deflated."""

    def run(keys: pa.Array, texts: pa.Array, *more: pa.Array) -> list:
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        raw = [None if t is None else t.encode() for t in texts.to_pylist()]
        row = [0] * len(raw) if unique else [xxhash.xxh64_intdigest(t or b"") - 2**63 for t in raw]
        return [*more, keys, row, [None if t is None else press(t) for t in raw]]

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *[F.col(c) for c in keep])
    return map_columns(rows, ["doc", "text", *keep], fields(rows, keep, "doc long, row long, z binary"), run)


def places(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each of n documents' words start, and their numbers."""
    first = np.searchsorted(doc, np.arange(n))
    return first, np.diff(np.r_[first, len(doc)])


def wholes(names: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A hash of each document's words."""
    first, sizes = places(doc, n)
    at = np.arange(len(names)) - np.repeat(first, sizes)
    out = np.zeros(n, np.uint64)
    has = sizes > 0
    if has.any():
        out[has] = np.add.reduceat(mixed(mixed(names) + at.astype(np.uint64) * A), first[has])
    return mixed(out + sizes.astype(np.uint64) * C)


#: Spans of a whole document: of a copy of an earlier one, and of the first.
COPY, FIRST = 1 << 41, (1 << 41) + 1
#: Marks of a span: its symbol is shared, and an earlier document has it.
SHARED, LATER = 1 << 62, 1 << 61
#: In the lower 32 bits of ``at``: all words, and a mark of windows that the document has again. Above them: a mark of
#: windows that an earlier document is known to have.
EVERYTHING, AGAIN, KNOWN = 2**32 - 1, 2**31, 1 << 47


def met(doc: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a key that several documents have here, and which of these are of another than the first one."""
    shared, later = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    order = np.argsort(key[0])
    same = key[0][order][1:] == key[0][order][:-1]
    at = order[np.r_[False, same] | np.r_[same, False]]  # the rest has no other row with its key
    if len(at):
        at = at[np.lexsort((doc[at], *(k[at] for k in reversed(key))))]
        new = np.ones(len(at), bool)
        new[1:] = np.any([k[at][1:] != k[at][:-1] for k in key], axis=0)
        first = np.flatnonzero(new)
        sizes = np.diff(np.r_[first, len(at)])
        least, most = doc[at][first], doc[at][np.r_[first[1:], len(at)] - 1]
        shared[at] = np.repeat(least < most, sizes)
        later[at] = doc[at] != np.repeat(least, sizes)
    return shared, later


def scattered(key: np.ndarray, doc: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The keys, of their own for rows of ``later``."""
    out = key.copy()
    out[later] = mixed(mixed(key[later] + C) ^ doc[later].astype(np.uint64) * A)
    return out


def standing(docs: DataFrame, id_col: str, text_col: str, width: int, unique: bool = False) -> DataFrame:
    """(key, doc, span): the symbols that stand for a document's windows, once for each stretch of windows; a span is the
    stretch's first window times 256, and its length, with marks. Where ids are unique, the symbol of all words has the span
    COPY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                keys = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                names, doc = batch_words([None if t is None else t.encode() for t in part.column(1).to_pylist()])
                inside, stands = symbols(names, doc, width)
                at = np.flatnonzero(inside)
                starts, sizes = places(doc, part.num_rows)
                pos = at - starts[doc[at]]
                new = np.ones(len(at), bool)
                new[1:] = (stands[at][1:] != stands[at][:-1]) | (doc[at][1:] != doc[at][:-1]) | (pos[1:] % 128 == 0)
                first = np.flatnonzero(new)
                size = np.diff(np.r_[first, len(at)])
                at = at[first]
                long = np.flatnonzero(unique & (sizes >= width))
                key = np.r_[stands[at], wholes(names, doc, part.num_rows)[long]]
                owner = np.r_[keys[doc[at]], keys[long]]
                shared, later = met(owner, key)
                span = np.r_[pos[first] << 8 | size, np.full(len(long), COPY)] | shared * SHARED | later * LATER
                yield pa.RecordBatch.from_arrays(
                    [pa.array(scattered(key, owner, later).view(np.int64)), pa.array(owner), pa.array(span)],
                    ["key", "doc", "span"],
                )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "key long, doc long, span long")


def windows(with_spans: DataFrame, width: int, unique: bool = False) -> DataFrame:
    """(h, doc, at; without ``unique`` row too): hashes of a document's windows in its shared stretches (doc, row, z, ...,
    spans), and of all words of copies and of what they are copies of; ``at`` has 16 more bits of the hash, marks, and
    where the window starts (of wholes EVERYTHING). A window that a document has several times is sent once, marked
    AGAIN, so a common line makes no more rows than there are documents with it."""
    names_ = ["h", "doc", "at"] if unique else ["h", "doc", "at", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            batch = batch.filter(batch.column("spans").is_valid()).select(["doc", "row", "z", "spans"])
            for part in slices(batch, 2, 500_000):
                docs, rows = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                names, doc = batch_words([None if z is None else zstandard.decompress(z) for z in part.column(2).to_pylist()])
                first, sizes = places(doc, part.num_rows)
                spans = part.column("spans")
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(spans).to_numpy(zero_copy_only=False))
                span = spans.flatten().to_numpy(zero_copy_only=False)
                whole = np.zeros(part.num_rows, bool)
                copy = np.zeros(part.num_rows, bool)
                whole[owner[span >= COPY]] = True
                copy[owner[span == COPY]] = True
                own = (span < COPY) & ~copy[owner]
                owner, span = owner[own], span[own]
                size = span & 255
                pos = np.repeat((span >> 8) - (np.cumsum(size) - size), size) + np.arange(size.sum())
                owner = np.repeat(owner, size)
                ok = pos <= sizes[owner] - width  # rows with equal ids share their spans
                owner, pos = owner[ok], pos[ok]
                at = first[owner] + pos
                none = np.zeros(0, np.uint64)
                h, g = (window_hash(names, width, base)[at] if len(at) else none for base in (A, C))
                order = np.lexsort((pos, h, owner))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                start = np.flatnonzero(new)
                often = np.diff(np.r_[start, len(order)]) > 1
                one = order[start]
                h, g, owner, pos = h[one], g[one], owner[one], pos[one] | often.astype(np.int64) * AGAIN
                all_ = np.flatnonzero(whole & (sizes >= width))
                w = wholes(names, doc, part.num_rows)[all_]
                h, g = np.r_[h, w], np.r_[g, mixed(w * B)]
                owner, pos = np.r_[owner, all_], np.r_[pos, np.full(len(all_), EVERYTHING)]
                _, later = met(docs[owner], h, g >> np.uint64(48))
                packed_at = (g >> np.uint64(48)).astype(np.uint16).view(np.int16).astype(np.int64) << 48 | later * KNOWN | pos
                columns = [scattered(h, docs[owner], later).view(np.int64), docs[owner], packed_at, rows[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[: len(names_)]], names_)

    # all columns come along, so that the exchange of texts is the same as that of step 3
    return with_spans.mapInArrow(run, ", ".join(f"{c} long" for c in names_))


def repeats(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, unique: bool = False) -> DataFrame:
    """(doc, starts): where windows start that an earlier document has too, as ``at`` of ``windows`` (without ``unique`` with
    the row). ``rows``: what ``packed`` makes of ``docs``."""
    by_key = Window.partitionBy("key")
    marked = lambda mark: F.col("span").bitwiseAND(F.lit(mark)) != 0
    shared = standing(docs, id_col, text_col, width, unique)
    shared = shared.withColumn("a", F.min("doc").over(by_key)).withColumn("b", F.max("doc").over(by_key)).where((F.col("a") < F.col("b")) | marked(SHARED))
    plain = F.col("span").bitwiseAND(F.lit(LATER - 1))
    span = F.when((plain == COPY) & (F.col("doc") == F.col("a")) & ~marked(LATER), FIRST).otherwise(plain)
    spans = shared.select("doc", span.cast("long").alias("span")).groupBy("doc").agg(F.collect_set("span").alias("spans"))
    found = windows(rows.join(spans, "doc", "left"), width, unique).repartition("h")
    by_window = Window.partitionBy("h", F.shiftrightunsigned("at", 48))
    found = found.withColumn("a", F.min("doc").over(by_window)).where((F.col("a") < F.col("doc")) | (F.col("at").bitwiseAND(F.lit(KNOWN)) != 0))
    return found.groupBy("doc").agg(F.collect_set("at" if unique else F.struct("row", "at")).alias("starts"))


def everywhere(words: list[bytes], starts: np.ndarray, width: int) -> np.ndarray:
    """Where windows start, with all places of those that are marked AGAIN."""
    again = starts >= AGAIN
    places_ = starts & (AGAIN - 1)
    if again.any():
        h = window_hash(named(words), width, A)
        places_ = np.union1d(places_, np.flatnonzero(np.isin(h, h[places_[again]])))
    return places_


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n words a window that starts at one of ``starts`` covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, keep: tuple[str, ...] = (),
    whole: bool = False,
) -> DataFrame:
    """The id, the kept columns, n_words, n_removed, text: each row's words that are kept, joined by single spaces. With
    ``whole`` a text that loses no word stays as it is (null: null)."""
    extra = tuple(f"_k{i}" for i in range(len(keep)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, extra, strict=True)])
    known, nameless = own.where("doc_id is not null"), own.where("doc_id is null")
    unique = known.groupBy("doc_id").count().where("count > 1").isEmpty()
    rows = packed(known, "doc_id", "text", extra, unique)
    found = repeats(known, rows, "doc_id", "text", width, unique)

    def lasting(text: str | None, words: list[bytes], n: int) -> str | None:
        return text if whole and len(words) == n else b" ".join(words).decode()

    def run(keys: pa.Array, row: pa.Array, z: pa.Array, starts: pa.Array, *more: pa.Array) -> list:
        import zstandard

        counts, gone, texts = [], [], []
        for own, raw, at in zip(row.to_pylist(), z.to_pylist(), starts, strict=True):
            text = zstandard.decompress(raw) if raw is not None else None
            words = text.split() if text else []
            counts.append(len(words))
            if at.is_valid:
                if unique:
                    found = at.values.to_numpy(zero_copy_only=False)
                else:
                    of, found = (at.values.field(k).to_numpy(zero_copy_only=False) for k in ("row", "at"))
                    found = found[of == own]
                found = found & 0xFFFFFFFF
                drop = np.ones(len(words), bool) if (found == EVERYTHING).any() else covered(len(words), everywhere(words, found, width), width)
                words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
            gone.append(counts[-1] - len(words))
            texts.append(lasting(None if text is None else text.decode(), words, counts[-1]))
        return [*more, keys, counts, gone, texts]

    def keep_all(texts: pa.Array, *more: pa.Array) -> list:
        cut = [(t, t.encode().split() if t else []) for t in texts.to_pylist()]
        sizes = [len(w) for _, w in cut]
        return [*more, [None] * len(cut), sizes, [0] * len(cut), [lasting(t, w, len(w)) for t, w in cut]]

    joined = rows.join(found, "doc", "left")
    shape = fields(own, extra, "doc_id long, n_words long, n_removed long, text string")
    out = map_columns(joined, ["doc", "row", "z", "starts", *extra], shape, run, 500)
    out = out.unionByName(map_columns(nameless, ["text", *extra], shape, keep_all, 500))
    return out.select(F.col("doc_id").alias(id_col), *[F.col(k).alias(c) for c, k in zip(keep, extra, strict=True)], "n_words", "n_removed", "text")
