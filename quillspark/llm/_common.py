"""Small helpers that several operators of this package share."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..session import cut, shared_dir

__all__ = ["WORD", "Pretokenizer", "Vocabulary", "apart", "byte_level", "calm_gc", "components", "cut", "fields", "map_columns", "new_path", "shared_dir"]

#: A word, for Spark's and DuckDB's regular expressions. ``bytes.split()`` cuts at exactly the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def apart(df: DataFrame, key: str) -> DataFrame:
    """The same rows, which Spark no longer knows to be dealt by ``key``: a join on it then shuffles both sides for
    itself, and adaptive execution may split a key with very many rows (it can't where a side was dealt before)."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def map_columns(df: DataFrame, inputs: list[str], schema: StructType | str, fn: Callable[..., list], rows: int = 2000) -> DataFrame:
    """``fn(*columns)`` on slices of at most ``rows`` rows; each column comes as an Arrow array and ``fn`` returns one
    sequence or Arrow array for each field of ``schema``. Only the named inputs reach Python."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names, types = struct.names, [to_arrow_type(f.dataType) for f in struct]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*part.columns)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    return df.select([F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(inputs)]).mapInArrow(run, struct)


def calm_gc() -> None:
    """Lets a Python worker look for cycles less often: large tables and lists of strings have none, and walking them
    for every few thousand new lists took a sixth of the time."""
    gc.freeze()
    gc.set_threshold(200_000, 50, 1000)


def fields(df: DataFrame, columns: tuple[str, ...] | list[str], more: str) -> StructType:
    """The columns as ``df`` has them, and the fields that ``more`` (DDL) adds."""
    return StructType([StructField(c, df.schema[c].dataType) for c in columns] + StructType.fromDDL(more).fields)


def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round (Kiveris et al., 2014) over edges (u, v) with u > v. A hub's edges meet its
    least neighbour in joins that may be split."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.where("v > u").join(apart(least, "u"), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    near = large.join(apart(least, "u"), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (u, v, longs) the smallest node it is connected with.

    Each round is a few shuffles of the edges; no node's neighbours are gathered in a row. Edges from a node to itself
    and repeated edges are allowed; no edges give no rows."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state:
            break
        state = tuple(new)
        edges = cut(star_round(edges))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


# -- Pre-tokens of byte-level BPE ------------------------------------------------------------------------------------

# Classes of the code points below U+0250, for the published byte-level pattern
#   's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\\t-\\r \x85\xa0"
# (letters first here: they can't begin with an apostrophe, and most pre-tokens are letters)
_LATIN = re.compile(
    f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+",
)
#: A code point whose class isn't among those above.
UNKNOWN = re.compile("[^\x00-ɏ‐-‧‰-⁞₠-₿]")


class Pretokenizer:
    """Cuts texts into pre-tokens as the tokenizer file at ``path`` does (byte-level pattern, no added prefix space).
    Added tokens come as pieces of their own. Texts beyond Latin script go through the library's own pre-tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not UNKNOWN.search(text):
            return _LATIN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out += [part] if k % 2 else self.plain(part)
        return out


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes for themselves, the others in order from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Token bytes, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        of = byte_level()
        vocab: dict[str, int] = model["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for piece, i in vocab.items():
            self.bytes[i] = piece.encode() if piece in self.added else bytes(of[c] for c in piece)
        for piece, i in self.added.items():
            self.bytes[i] = piece.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        #: (left id, right id, merged id) by rank
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.byte_ids = [0] * 256
        for c, b in of.items():
            self.byte_ids[b] = vocab[c]
