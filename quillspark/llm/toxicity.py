"""Toxicity of texts, scored after noisy-channel deobfuscation.

Restoring: a word with look-alike signs, doubled or stretched letters or separators between its letters, and a row of short
pieces set apart by spaces of which some are single letters, becomes a lattice of what each sign may stand for; a separator
may be nothing or the border of a word, and so may a space within such a row. Viterbi decoding picks the path with the
highest probability under a character language model (four letters deep, counted over all texts) and the channel (what each
change costs). A word of look-alike signs alone is a number, or nothing, unless its letters are likely enough. Everything
else is lower-cased and loses the signs around it.

Scoring: the restored words that tell the classes apart best (by chi-square, at most ``FEATURES``) are the features of a
logistic regression with an L2 penalty, fitted on a bounded sample of labelled rows (``max_rows``, by a hash of the id;
equal feature sets count once). The score is the probability of label 1; labels, languages, sources and ids are no
inputs. The model's size is bounded by FEATURES and the alphabet, so it is broadcast.

Null and empty texts score as texts without any feature. Without labels of both classes every score is the share of
label 1, or 0. Texts and words of any length are restored whole: a lattice is decoded from end to end with at most
LETTERS ** 3 states, as an array where they are many (about a millisecond a sign, and memory for SEGMENT signs). Rows are kept as they come, repeated ones and null ids too; a document with several labels counts as
toxic if any of them says so; of equally telling words the first by name is a feature. An empty table gives no rows; other
columns than those asked for are left out, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Hashable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, fields, map_columns
from .langid import bounded_sample, fold

LETTERS = 28  # 0: any sign, 1-26: a-z, 27: other letters
HASH = 1 << 20
FEATURES = 256
#: Letters that signs stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "µ": "u",
}
ANY = "*#%&?"
CHANGE, DROP, WILD = 1.0, 3.0, 3.2
#: What it costs to read a doubled letter as one, and to join pieces of more than a letter.
SINGLE, JOIN = 2.5, 1.0
#: What a sign costs that is no letter at all, in a word of look-alike signs: a digit, another one.
DIGIT, SIGN = 2.2, 3.6
SEPARATORS = ".-_*·/~"

CLASS = np.full(256, 27, np.uint8)
CLASS[:128] = 0
for _i in range(26):
    CLASS[97 + _i] = CLASS[65 + _i] = 1 + _i

EDGE = ".,;:?\"'()[]{}<>&%#*-_/\\~`^=…“”‘’«»"
LEFT = EDGE.replace("(", "")
ODD = re.compile(r"[0-9@$!|+€£¡(*#%&?]|(.)\1|[^\W_][.\-_·/~]+[^\W_]")
TAIL = re.compile(r"(?:([!$%&*#@+])\1+|!)$")


class CharacterModel:
    """log P(letter | three before) from counts of four letters in a row."""

    def __init__(self, counts: np.ndarray) -> None:
        c = counts.reshape([LETTERS] * 4).astype(np.float64)
        three, two = c.sum(axis=0), c.sum(axis=(0, 1))
        one = two.sum(axis=0) + 1
        p = np.broadcast_to(one / one.sum(), two.shape)
        p = (two + 20 * p) / (two.sum(axis=1, keepdims=True) + 20)
        p = (three + 10 * p) / (three.sum(axis=2, keepdims=True) + 10)
        p = (c + 5 * p) / (c.sum(axis=3, keepdims=True) + 5)
        self.cube = np.log(p).astype(np.float32)
        self.logs = self.cube.reshape(-1, LETTERS)

    @cached_property
    def table(self) -> list[float]:
        """The same as a list, which is faster to look single values up in."""
        return self.logs.ravel().tolist()

    @cached_property
    def back(self) -> np.ndarray:
        """The same as (b, c, k, a), so that the letter furthest back is innermost."""
        return np.ascontiguousarray(np.transpose(self.cube, (1, 2, 3, 0)))


def letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each run of a sign the strings that it may stand for, with their costs. A space is the border of a word, or none."""
    out = []
    size = len(word)
    for m in re.finditer(r"(.)\1*", word, re.S):
        c, n, (a, b) = m[1], len(m[0]), m.span()
        if c.isalpha() and c not in LOOKS:
            out.append([(c, 0.0)] if n == 1 else [(c * 2, 0.0), (c, SINGLE)] if n == 2 else [(c, 0.0), (c * 2, 0.0)])
            continue
        border: list[tuple[str, float]] = []
        if c == " " or c in SEPARATORS and 0 < a and b < size and word[a - 1].isalnum() and word[b].isalnum():
            lone = (a < 2 or not word[a - 2].isalnum()) or (b + 1 >= size or not word[b + 1].isalnum())
            border = [("", 0.0 if lone else JOIN), (" ", 0.0)]
        if c == " " or border and c not in ANY:
            out.append(border)
            continue
        some = [(x, CHANGE) for x in LOOKS.get(c, "")] or ([(chr(97 + i), WILD) for i in range(26)] if c in ANY else [])
        out.append([(x * k, cost * k) for x, cost in some for k in ((1, 2) if n > 1 else (1,))] + (border or [("", DROP * min(n, 3))]))
    return out


#: Steps of states and options from which states are an array, states at which they are none any more, and columns whose
#: ways back are held at once.
WIDE, FEW, SEGMENT = 3000, 40, 2048
#: By the last three letters, as one number: log probability less costs, and the text as its last piece and those before.
States = dict[int, tuple[float, tuple]]


def viterbi(columns: list[list[tuple[str, float]]], model: CharacterModel) -> tuple[str, float]:
    """The most probable text of a lattice between two borders of a word, and its log probability less what it costs."""
    states: States = {0: (0.0, ())}
    table, wrap, at = model.table, LETTERS**3, 0
    while at < len(columns):
        if len(states) * len(columns[at]) > WIDE:
            states, at = wide(columns, at, states, model)
            continue
        new: States = {}
        for more, cost in columns[at]:
            letters = tuple(map(letter, more))
            for place, (score, text) in states.items():
                s = score - cost
                for k in letters:
                    place = place * LETTERS + k  # noqa: PLW2901
                    s += table[place]
                    place %= wrap  # noqa: PLW2901
                if place not in new or s > new[place][0]:
                    new[place] = (s, (more, text))
        states, at = new, at + 1
    ends = [(s + table[place * LETTERS], t) for place, (s, t) in states.items()]
    best = max(s for s, _ in ends)
    return max(spelled(t) for s, t in ends if s == best), best


def step(s: np.ndarray, options: list[tuple[str, float]], model: CharacterModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores after a column of states (b, c, a), a being the letter furthest back; for each state, as (y, z, x), the option
    that led there, the letter that it pushed out and, of a doubled letter, the one before it."""
    one = {letter(t): (cost, k) for k, (t, cost) in enumerate(options) if len(t) == 1}
    two = {letter(t[0]): (cost, k) for k, (t, cost) in enumerate(options) if len(t) == 2}
    letters = sorted({*one, *two})
    every = s[:, :, None, :] + model.back[:, :, letters, :]  # b, c, k, a
    out = every.argmax(axis=3)
    reached = np.take_along_axis(every, out[..., None], 3)[..., 0]  # b, c, k
    new = np.full_like(s, -np.inf)
    option, pushed, second = (np.zeros(s.shape, np.uint8) for _ in range(3))
    for i, k in enumerate(letters):
        if k in one:
            cost, number = one[k]
            # the state (b, c, k) is at [c, k, b]
            new[:, k, :] = reached[:, :, i].T - cost
            option[:, k, :] = number
            pushed[:, k, :] = out[:, :, i].T
    for i, k in enumerate(letters):
        if k in two:
            cost, number = two[k]
            twice = reached[:, :, i] + model.cube[:, :, k, k]  # b, c
            b = twice.argmax(axis=0)
            c = np.arange(LETTERS)
            score = twice[b, c] - cost
            better = score > new[k, k, :]  # the state (c, k, k) is at [k, k, c]
            new[k, k, better] = score[better]
            option[k, k, better], pushed[k, k, better], second[k, k, better] = number, out[b, c, i][better], b[better]
    for number, (t, cost) in enumerate(options):
        if not t:
            better = s - cost > new
            new[better] = s[better] - cost
            option[better] = number
    return new, option, pushed, second


def wide(columns: list[list[tuple[str, float]]], at: int, states: States, model: CharacterModel) -> tuple[States, int]:
    """Goes on from a column with an array of all states until few are left or the word ends; the states there, and where.

    Forward, only scores are kept, one array for each segment; ways back are made again, a segment at a time."""
    s = np.full((LETTERS,) * 3, -np.inf, np.float32)
    for place, (score, _) in states.items():
        s[place // LETTERS % LETTERS, place % LETTERS, place // LETTERS**2] = score
    starts, begin, ways = [s], at, []
    while at < len(columns):
        if (at - begin) % SEGMENT == 0 and at > begin:
            starts.append(s)
            ways = []
        s, *way = step(s, columns[at], model)
        ways.append(way)
        at += 1
        if np.count_nonzero(np.isfinite(s)) <= FEW:
            break
    if at == len(columns):  # only the best can win
        total = s + np.transpose(model.cube[:, :, :, 0], (1, 2, 0))
        kept = np.argwhere(total == total.max())
    else:
        kept = np.argwhere(np.isfinite(s))
    paths = [(tuple(x), []) for x in kept.tolist()]
    for k in range(len(starts) - 1, -1, -1):
        first = begin + k * SEGMENT
        if k < len(starts) - 1:
            ways, now = [], starts[k]
            for options in columns[first : first + SEGMENT]:
                now, *way = step(now, options, model)
                ways.append(way)
        back = []
        for (y, z, x), pieces in paths:
            for j in range(len(ways) - 1, -1, -1):
                option, pushed, second = ways[j]
                text = columns[first + j][option[y, z, x]][0]
                pieces.append(text)
                if len(text) == 1:
                    y, z, x = x, y, int(pushed[y, z, x])
                elif text:
                    y, z, x = int(second[y, z, x]), x, int(pushed[y, z, x])
            back.append(((y, z, x), pieces))
        paths = back
    out: States = {}
    for (b, c, a), ((y, z, x), pieces) in zip(kept.tolist(), paths, strict=True):
        text = states[(x * LETTERS + y) * LETTERS + z][1]
        for piece in reversed(pieces):
            text = (piece, text)
        out[(a * LETTERS + b) * LETTERS + c] = (float(s[b, c, a]), text)
    return out, at


def spelled(text: tuple) -> str:
    out = []
    while text:
        more, text = text
        out.append(more)
    return "".join(reversed(out))


def decode(word: str, model: CharacterModel) -> str:
    return viterbi(lattice(word), model)[0]


DOUBLED = re.compile(r"(.)\1+")


def undoubled(word: str, model: CharacterModel) -> str | None:
    """What ``decode`` gives for a word of letters alone whose doubled ones are at least two letters apart: whether one of
    them is read as single changes a few terms of the sum only, so each is decided by these. None for other words."""
    places, upto = [], -4
    for m in DOUBLED.finditer(word):
        at, end = m.span()
        if end - at > 2 or at < upto + 4:
            return None
        places.append(at)
        upto = at
    p, base = model.table, LETTERS
    k = [0, 0, 0, *map(letter, word), 0, 0]
    gone = []
    for at in places:
        i = at + 3
        x, y, c, d, e = k[i - 2], k[i - 1], k[i], k[i + 2], k[i + 3]
        last = at + 2 >= len(word)
        two = p[((x * base + y) * base + c) * base + c] + p[((y * base + c) * base + c) * base + d]
        one = p[((x * base + y) * base + c) * base + d] - SINGLE
        if not last:
            two += p[((c * base + c) * base + d) * base + e]
            one += p[((y * base + c) * base + d) * base + e]
        if one > two:
            gone.append(at)
    for at in reversed(gone):
        word = word[:at] + word[at + 1 :]
    return word


def restore(word: str, model: CharacterModel, known: dict[str, str] | None = None) -> str:
    """A word as it was meant, without the signs around it; empty if it has no letter. Separators may have made it several.
    ``known`` keeps what is decoded."""
    bare = word.lower().rstrip(EDGE).lstrip(LEFT)
    if not bare.isalpha():
        if not any(map(str.isalpha, bare)):
            if not bare or any(c not in LOOKS for c in bare):
                return ""
            text, score = viterbi(lattice(bare), model)
            return text if score > -sum(DIGIT if c.isdigit() else SIGN for c in bare) else ""
        while (m := TAIL.search(bare)) and m.start():
            bare = bare[: m.start()].rstrip(EDGE)
        if not any(map(str.isalpha, bare)):
            return ""
    if not ODD.search(bare):
        return bare
    if bare.isalpha() and (plain := undoubled(bare, model)) is not None:
        return plain
    if known is None:
        return decode(bare, model)
    if bare not in known:
        known[bare] = decode(bare, model)
    return known[bare]


#: A row of pieces: at least so many, of at most so many signs.
ROW, PIECE = 3, 2
_SHORT = re.compile(rb"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D]{1,8}[\x20\x09-\x0D]+){2,}[^\x20\x09-\x0D]{1,8}(?![^\x20\x09-\x0D])")


def rows_of(words: list[bytes]) -> Iterator[bytes]:
    """The rows of short pieces in a text's words, of which one is a single letter at least."""
    at, n = 0, len(words)
    while at < n:
        end, lone = at, False
        while end < n and len(words[end]) <= PIECE * 4 and len(words[end].decode("utf-8", "replace")) <= PIECE:
            lone = lone or ONE(words[end])
            end += 1
        if lone and end - at >= ROW:
            yield b" ".join(words[at:end])
        at = end + 1


def found(text: str | None, model: CharacterModel, known: dict[bytes, tuple], of: Callable[[str], Hashable], spelled_: dict[str, str] | None = None) -> set:
    """What ``of`` gives for a text's restored words, without None. ``known`` keeps it by word and row, ``spelled_`` what
    was decoded."""
    raw = text.encode() if text else b""
    words = set(raw.split())
    for w in words.difference(known):
        known[w] = tuple(of(x) for x in restore(w.decode("utf-8", "replace"), model, spelled_).split(" "))
    out = set(chain.from_iterable(map(known.__getitem__, words)))
    if any(map(ONE, words)):
        for m in _SHORT.finditer(raw):
            for row in rows_of(m[0].split()):
                if (key := row + b" ") not in known:
                    known[key] = tuple(of(x) for x in decode(row.decode("utf-8", "replace").lower(), model).split(" "))
                out.update(known[key])
    out.discard(None)
    return out


def features(
    text: str | None, model: CharacterModel, known: dict[bytes, tuple], place: dict[str, int] | None, spelled_: dict[str, str] | None = None,
) -> set[int]:
    """The numbers of a text's restored words that are features (without ``place``: hashes of all, which may collide)."""
    return found(text, model, known, number if place is None else place.get, spelled_)


def ONE(word: bytes) -> bool:
    return len(word) == 1 or len(word) == 2 and word[0] >= 0xC0


def number(word: str) -> int | None:
    return zlib.crc32(word.encode()) % HASH if word else None


def character_model(docs: DataFrame, text_col: str = "text") -> CharacterModel:
    """Counts of four letters in a row over all texts; each task sends its counts, at most LETTERS ** 4."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(LETTERS**4, np.int64)
        for batch in batches:
            texts = batch.column(0).drop_null()
            for at in range(0, len(texts), 200):
                raw = (" " + "   ".join(texts[at : at + 200].to_pylist()) + " ").encode()
                for k in range(0, len(raw), 1 << 20):
                    c = CLASS[np.frombuffer(raw, np.uint8, min(len(raw) - k, (1 << 20) + 3), k)].astype(np.int32)
                    if len(c) > 3:
                        counts += np.bincount(((c[:-3] * LETTERS + c[1:-2]) * LETTERS + c[2:-1]) * LETTERS + c[3:], minlength=LETTERS**4)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])

    sums = docs.select(text_col).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(LETTERS**4, np.int64)
    counts[sums.column("gram").to_numpy()] = sums.column("n").to_numpy()
    return CharacterModel(counts)


class Classifier:
    """A logistic regression over the presence of features."""

    def __init__(self, place: dict[str, int], weights: np.ndarray, bias: float) -> None:
        self.place, self.weights, self.bias = place, weights, bias

    def score(self, found: set[int]) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.bias + float(sum(self.weights[k] for k in sorted(found)))))))


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(ridge), x1.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn(
    docs: DataFrame, labels: DataFrame, model: CharacterModel, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", max_rows: int = 12_000,
) -> Classifier:
    """A classifier from the rows of ``labels`` (id, label 0/1); those used are bounded, so that they may be broadcast."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = bounded_sample(known, id_col, max_rows)
    texts = docs.select(id_col, text_col).join(F.broadcast(known.select(F.col(id_col).alias("_id"), "y")), F.col(id_col) == F.col("_id")).select(text_col, "y")

    def run(texts: pa.Array, y: pa.Array) -> list:
        cache: dict[bytes, tuple] = {}
        decoded: dict[str, str] = {}
        return [y, [sorted(found(t, shared.value, cache, lambda w: w or None, decoded)) for t in texts.to_pylist()]]

    rows = cut(map_columns(texts, [text_col, "y"], "y int, found array<string>", run).distinct())
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        share = n1 / max(1, n1 + n0)
        return Classifier({}, np.zeros(0), math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    counts = rows.select("y", F.explode("found").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b"))
    gain = F.when(F.col("a") * n0 > F.col("b") * n1, F.pow(F.col("a") * n0 - F.col("b") * n1, F.lit(2)) / (F.col("a") + F.col("b")))
    best = counts.where("a >= 3").withColumn("gain", gain).where("gain is not null").orderBy(F.desc("gain"), "f").limit(FEATURES).collect()
    place = {r["f"]: k for k, r in enumerate(best)}
    wanted = F.array_intersect("found", F.array(*[F.lit(f) for f in place])) if place else F.array().cast("array<string>")
    data = rows.select("y", wanted.alias("found")).collect()
    x = np.zeros((len(data), len(place)))
    for i, r in enumerate(data):
        x[i, [place[f] for f in r["found"]]] = 1
    weights, bias = fit(x, np.array([r["y"] for r in data], float))
    return Classifier(place, weights, bias)


def score(
    docs: DataFrame, model: CharacterModel, classifier: Classifier, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    name: str = "score",
) -> DataFrame:
    """The kept columns and the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((model, classifier))
    most = 150_000

    inputs = list(dict.fromkeys([*keep, text_col]))  # a kept text travels once
    at = inputs.index(text_col)

    def run(*columns: pa.Array) -> list:
        characters, c = shared.value
        known, decoded = shared.__dict__.setdefault("known", ({}, {}))
        for table in (known, decoded):
            if len(table) > most:
                table.clear()
        return [*columns[: len(keep)], [c.score(features(t, characters, known, c.place, decoded)) for t in columns[at].to_pylist()]]

    return map_columns(docs, inputs, fields(docs, keep, f"`{name}` double"), run)


def learnable(id_col: str) -> Column:
    """Whether a label may be learnt from: the rest, by crc32 of the id as text modulo 4, is held out."""
    return fold(id_col, 4) != 2


def assess(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    name: str = "score",
) -> DataFrame:
    """Counts the character model over ``docs``, learns from ``labels`` (id, toxic) and scores every row of ``docs``."""
    model = character_model(docs, text_col)
    return score(docs, model, learn(docs, labels, model, id_col, text_col), text_col, keep, name)
