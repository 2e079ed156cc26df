"""Runs: stretches of words that repeat with a period.

A run of period q is a maximal stretch in which words q apart are equal; it counts if it has ``least`` words and ``times``
periods at least, and no smaller period. So its lag q must match in max(least - q, (times - 1) q) places, all in a row.
How often each lag of a text matches is counted exactly, by heavy and light words: frequent words (those whose pairs would
cost more than a transform) by the autocorrelation of their indicators, whose power spectra are added before one inverse
transform and rounded to integers; the others by the differences of their pairs of places. Only lags with enough matches
are scanned for islands of matches, and only where every max(...)-th place, one of which any such island covers, has a match.
A stretch found at several lags has the least of them as its period: of two periods that a stretch of two lengths has, their
greatest common divisor is one too.

Texts are looked at whole, each by itself, where they are: nothing is shuffled. Null, empty and blank texts have no words and
no runs. Null and repeated ids and equal rows are kept. An empty table gives no rows; other columns are left out, whatever
their names. A text of n words takes memory in proportion to n, and no pair of places is stored beyond one distance at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import fields, map_columns

#: What a butterfly of a transform costs, in pairs of places.
BUTTERFLY = 1.5


def spread(n: int) -> int:
    """A length for transforms of n values: the least 2^a or 3 * 2^a that holds them."""
    p = 1 << max(1, n - 1).bit_length()
    return p * 3 // 4 if p * 3 // 4 >= n and p >= 8 else p


def lag_counts(words: np.ndarray, most: int, heavy: float | None = None) -> np.ndarray:
    """For each lag up to ``most`` the number of places i with words[i] = words[i + lag]; words are small integers. A word
    is heavy from ``heavy`` occurrences on, if that is given."""
    n = len(words)
    counts = np.zeros(most + 1, np.int64)
    if most < 1:
        return counts
    size = spread(n + most)
    if heavy is None:
        heavy = (2 * BUTTERFLY * size * log2(size)) ** 0.5
    times = np.bincount(words)
    order = np.argsort(words, kind="stable")
    frequent = np.flatnonzero(times >= heavy)
    if len(frequent):
        ends = np.cumsum(times)
        power = np.zeros(size // 2 + 1)
        for w in frequent.tolist():
            ones = np.zeros(size)
            ones[order[ends[w] - times[w] : ends[w]]] = 1
            f = np.fft.rfft(ones)
            power += f.real**2 + f.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        order = order[times[words[order]] < heavy]
    left = order
    of = words[order]
    far = 1
    # places of one word stand in order, so those ``far`` apart in this list are its far-th neighbours
    at = np.arange(len(left))
    while True:
        at = at[at + far < len(left)]
        at = at[of[at] == of[at + far]]
        if not len(at):
            break
        lag = left[at + far] - left[at]
        near = lag <= most
        at = at[near]
        counts += np.bincount(lag[near], minlength=most + 1)
        far += 1
    counts[0] = 0
    return counts


def islands(words: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches of period ``lag`` that have ``least`` matches in a row or more."""
    n = len(words) - lag
    probes = np.arange(least - 1, n, least)
    probes = probes[words[probes] == words[probes + lag]]
    if not len(probes):
        return []
    out: list[tuple[int, int]] = []
    upto = -1
    for p in probes.tolist():
        if p < upto:
            continue
        # an island with the probe lies in a stretch that grows until it ends on both sides
        low, high, reach = p, p + 1, least
        while high < n:
            some = words[high : min(n, high + reach)] == words[high + lag : min(n, high + reach) + lag]
            miss = int(np.argmin(some)) if not some.all() else len(some)
            high += miss
            if miss < len(some):
                break
            reach *= 2
        reach = least
        while low > 0:
            a = max(0, low - reach)
            some = (words[a:low] == words[a + lag : low + lag])[::-1]
            miss = int(np.argmin(some)) if not some.all() else len(some)
            low -= miss
            if miss < len(some):
                break
            reach *= 2
        upto = high
        if high - low >= least:
            out.append((low, high - low + lag))
    return out


def runs(words: np.ndarray, least: int = 24, times: int = 3, heavy: float | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period; ``times`` is 2 or more."""
    n = len(words)
    if n < least:
        return []
    most = n // times
    lags = np.arange(most + 1)
    enough = np.maximum(least - lags, (times - 1) * lags)
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero((lag_counts(words, most, heavy) >= enough) & (lags > 0)).tolist():
        for stretch in islands(words, lag, int(enough[lag])):
            found.setdefault(stretch, lag)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapsed(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of n words stays: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones that with the smallest start, then period."""
    best = None
    for run in found:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the repeats of the query's contract: for a tenth of the ids, chosen by the CRC-32 of the decimal id,
    the words from one place on repeat with a period. A null id has none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * -(-(n - a) // len(block)))[: n - a]


def find_runs(
    docs: DataFrame, least: int = 24, times: int = 3, id_col: str = "doc_id", text_col: str = "text",
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(id, runs, text): each text's runs as structs (start, length, period), and its words outside their repeats, joined by
    one space. ``change`` gets the id and the words and returns those to look at."""

    def run(keys: pa.Array, texts: pa.Array) -> list:
        every, kept = [], []
        for key, text in zip(keys.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
            words = text.split() if text else []
            if change is not None:
                words = change(key, words)
            names: dict[bytes, int] = {}
            found = runs(np.array([names.setdefault(w, len(names)) for w in words], np.int64), least, times)
            every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
            stays = collapsed(len(words), found) if found else None
            kept.append(b" ".join(words if stays is None else [w for w, s in zip(words, stays.tolist(), strict=True) if s]).decode())
        return [keys, every, kept]

    schema = fields(docs, [id_col], "runs array<struct<start: long, length: long, period: long>>, text string")
    return map_columns(docs, [id_col, text_col], schema, run, rows=500)
