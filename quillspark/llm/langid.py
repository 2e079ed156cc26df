"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every n-gram of one to three characters falls into one of ``BUCKETS`` buckets by a hash. Learning
counts buckets for each language over a bounded sample of labelled rows (``max_rows``, about as many of each language,
chosen by a hash of the id), as sparse rows that Spark sums; the languages' prior probabilities are those of all labelled
rows. The matrix of log probabilities, buckets by languages, is broadcast. Its size is bounded by the buckets and by
``MAX_LANGUAGES``: of more values of the language column the most frequent ones are learnt. Scoring treats a batch as one sparse matrix: the bucket numbers of all its
characters one after another, cut at the texts' ends, with rows of the matrix added up for each text in numpy.

A null text and a text without a letter give ``und`` with score 0. The score is the share of the predicted language when
log probabilities are divided by the square root of the number of n-grams. Without any labelled row every text gives
``und``. Texts of any length are scored whole, one text at least at a time. Rows are kept as they come, repeated ones and
null ids too; equal texts give equal results, and of equally likely languages the first by name counts. An empty table
gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fields, map_columns

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)
UNKNOWN = "und"
#: The matrix has at most BUCKETS * MAX_LANGUAGES numbers.
MAX_LANGUAGES = 1000
#: Characters scored together.
MOST = 500_000


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram orders x characters) bucket numbers, BUCKETS where an n-gram would leave its text, and each text's end."""
    lower = [t.lower() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)))
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(n)
    out = np.full((len(GRAMS), n), BUCKETS, np.int32)
    for k, size in enumerate(GRAMS):
        if n < size:
            continue
        h = np.full(n - size + 1, size, np.uint32)
        for j in range(size):
            h = (h ^ codes[j : n - size + 1 + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out[k, : n - size + 1] = np.where(left[: n - size + 1] >= size, (h & np.uint32(BUCKETS - 1)).astype(np.int32), BUCKETS)
    return out, ends


def grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about MOST characters, one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= MOST):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


class Model:
    """Languages, their log probabilities (``texts``: how many of each there are) and those of buckets; the row after the
    last bucket is zero."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray | None = None, smooth: float = 0.1) -> None:
        self.languages = languages
        n = np.ones(len(languages)) if texts is None else np.asarray(texts, np.float64)
        self.prior = np.log(n / n.sum()) if len(languages) else n
        share = np.log((counts + smooth) / (counts + smooth).sum(axis=0, keepdims=True)) if len(languages) else counts
        self.logs = np.vstack([share, np.zeros((1, len(languages)))]).astype(np.float32)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, its share) for each text, all with at least one character."""
        best, share = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for a, b in grouped(texts):
            rows, ends = buckets(texts[a:b])
            starts = np.r_[0, ends[:-1]]
            each = self.logs[rows[0]]
            for row in rows[1:]:
                each += self.logs[row]
            total = np.add.reduceat(each, starts, axis=0, dtype=np.float64)
            scaled = (total + self.prior) / np.sqrt(len(GRAMS) * (ends - starts))[:, None]
            best[a:b] = scaled.argmax(axis=1)
            share[a:b] = 1 / np.exp(scaled - scaled.max(axis=1, keepdims=True)).sum(axis=1)
        return best, share


def bounded_sample(rows: DataFrame, id_col: str, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows at most, chosen by a hash of the id."""
    n = rows.count()
    if n <= max_rows:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 16_000) -> Model:
    """A model of the rows that have a text and a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in grouped(texts):
                numbers, ends = buckets(texts[a:b])
                for lang, lo, hi in zip(langs[a:b], np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                    sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    np.add.at(sums[lang], numbers[:, lo:hi].ravel(), 1)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "n"])

    known = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(id_col, text_col, lang_col)
    kept = known.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(MAX_LANGUAGES).collect()
    # a row for each language, MAX_LANGUAGES at most; of each about as many texts, so that rare ones are learnt too
    share = [(r["_lang"], min(1 << 30, max_rows * (1 << 30) // (len(kept) * r["_n"]))) for r in kept]
    rates = F.broadcast(rows.sparkSession.createDataFrame(share, "_lang string, _rate long"))
    chosen = known.join(rates, F.col(lang_col) == F.col("_lang")).where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < F.col("_rate"))
    sample = chosen.select(text_col, lang_col)
    sums = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sums.column("lang").to_pylist()
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    counts = np.zeros((BUCKETS, len(names)))
    counts[sums.column("bucket").to_numpy(), [place[x] for x in langs]] = sums.column("n").to_numpy()
    texts = {r["_lang"]: r["_n"] for r in kept}
    return Model(names, counts, np.array([texts[x] for x in names]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(keys: pa.Array, texts: pa.Array, letters: pa.Array) -> list:
        m: Model = shared.value
        rows, ok = texts.to_pylist(), letters.to_pylist()
        at = [i for i, x in enumerate(ok) if x and m.languages]
        names, scores = [UNKNOWN] * len(rows), [0.0] * len(rows)
        best, share = m.score([rows[i] for i in at])
        for i, k, s in zip(at, best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = m.languages[k], s
        return [keys, names, scores]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), has_letter(F.col(text_col)).alias("letter"))
    return map_columns(rows, ["id", "text", "letter"], fields(docs, (id_col,), "lang_pred string, score double"), run)


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp(text, F.lit(r"\p{L}")), F.lit(False))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0))
