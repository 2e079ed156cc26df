"""Long lists of literal terms, found by one automaton, and passages of patterns, with what stands around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .privacy import SCAN, any_script

#: Bytes of terms that one automaton takes; more terms take more automata, one after another.
MOST = 16 << 20
LEFT, RIGHT = 80, 120


def listed(lines: list[str]) -> list[tuple[int, str]]:
    """(line number, term) of a list with one term on a line; blank lines and those that begin with # are none."""
    return [(i, t) for i, line in enumerate(lines, 1) if (t := line.strip()) and not t.startswith("#")]


def low(text: str) -> str:
    """Lower case without a change of length."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Automaton:
    """Whole words or phrases, whatever their case. Equal terms are told apart by their numbers."""

    def __init__(self, terms: list[tuple[int, str]]) -> None:
        self.of: dict[str, list[int]] = {}
        for number, term in terms:
            self.of.setdefault(low(term), []).append(number)
        self.machine = ahocorasick.Automaton()
        for term in self.of:
            self.machine.add_word(term, term)
        if self.of:
            self.machine.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(term's number, start, end), each term's passages from the left, without overlaps of its own."""
        if not self.of:
            return []
        plain, ended, out = low(text), {}, []
        # ends rise, and of one term so do starts
        for last, term in self.machine.iter(plain):
            start, end = last + 1 - len(term), last + 1
            if start < ended.get(term, 0) or is_word(plain, start - 1) or is_word(plain, end):
                continue
            ended[term] = end
            out += [(number, start, end) for number in self.of[term]]
        return sorted(out)


def is_word(text: str, at: int) -> bool:
    """Whether there is a word's sign; Cyrillic ones all are."""
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_" or "Ѐ" <= text[at] <= "ӿ")


def around(text: str, start: int, end: int) -> str:
    return text[max(0, start - LEFT) : end + RIGHT].replace("\n", "\\n")


@lru_cache(maxsize=4)
def automaton(terms: tuple[tuple[int, str], ...]) -> Automaton:
    return Automaton(list(terms))


def chunks(terms: list[tuple[int, str]], most: int) -> list[tuple[tuple[int, str], ...]]:
    """The terms in lists of at most ``most`` bytes, or one term."""
    out: list[list[tuple[int, str]]] = [[]]
    size = 0
    for number, term in terms:
        need = len(term.encode()) + 16
        if out[-1] and size + need > most:
            out.append([])
            size = 0
        out[-1].append((number, term))
        size += need
    return [tuple(x) for x in out if x]


def find_terms(df: DataFrame, id_col: str, text_col: str, terms: list[tuple[int, str]], most: int = MOST) -> DataFrame:
    """id, kind (``private_term_`` and the term's number), value, context: every passage that is a term, as a whole word. A
    list that is too long for one broadcast takes as many passes as it fills."""
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *StructType.fromDDL("kind string, value string, context string").fields])
    rows = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    out: DataFrame | None = None
    for some in chunks(terms, most):
        shared = df.sparkSession.sparkContext.broadcast(some)  # of ``most`` bytes at most

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                at, kinds, values, contexts = [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for number, start, end in machine.find(text):
                        at.append(i)
                        kinds.append(f"private_term_{number}")
                        values.append(text[start:end])
                        contexts.append(around(text, start, end))
                keys = batch.column(0).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.string()) for x in (kinds, values, contexts))], schema.names)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def find_patterns(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """id, kind, value, context: every passage of a pattern. Only texts that have one, as the JVM finds, go to Python, which
    tells the places."""
    rules = patterns or SCAN
    hits = F.lit(False)
    for p in rules.values():
        hits = hits | F.col(text_col).rlike(any_script(p))
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *StructType.fromDDL("kind string, value string, context string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: re.compile(p) for k, p in rules.items()}
        for batch in batches:
            at, kinds, values, contexts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for kind, pattern in compiled.items():
                    for m in pattern.finditer(text):
                        at.append(i)
                        kinds.append(kind)
                        values.append(m.group(0))
                        contexts.append(around(text, m.start(), m.end()))
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.string()) for x in (kinds, values, contexts))], schema.names)

    return df.select(F.col(id_col), F.col(text_col)).where(F.coalesce(hits, F.lit(False))).mapInArrow(run, schema)


def snapshot_findings(df: DataFrame, id_col: str, text_col: str, terms: list[str] | None = None, patterns: dict[str, str] | None = None) -> DataFrame:
    """id, kind, value, context of all patterns, and of the terms of a list's lines."""
    found = find_patterns(df, id_col, text_col, patterns)
    extra = listed(terms or [])
    return found.unionByName(find_terms(df, id_col, text_col, extra)) if extra else found
