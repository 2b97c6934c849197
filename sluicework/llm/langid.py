"""Language identification by cross-parsing entropy.

A bounded, seeded sample of labelled text per language is turned into a suffix automaton.  A text is parsed
greedily into the longest phrases that occur in a language's sample; c phrases over n symbols against a
sample of N symbols estimate the cross entropy c * log2(N) / n, and the language with the least wins.

The automaton is only stepped forward (a missing transition ends the phrase and starts anew at the root),
so it is kept as a dense table over its own symbols, or, where all tables together would be too large, as sorted
edges, and all segments of a batch of texts are parsed in step by array lookups.
Segments only let long texts be parsed in parallel: each is parsed from the root at first, and then once more
from the state in which the segment before it ends, up to the symbol at which both parses are in one state.
So the phrases are those of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key60, mapped
from .shingles import slices

#: The sample: at most so many documents of each language, and characters in all.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 40_000
#: Symbols that are parsed in one lane.
SEGMENT = 1024
#: A text is foreign if it costs more than so many times the bits a symbol that this share of known texts stays under ...
MARGIN, QUANTILE = 1.5, 0.99
#: ... and so many phrases on top.
SLACK = 4
#: Steps of a bit in which costs of known texts are counted.
STEPS = 4096
#: Lanes that are parsed at once.
LANES = 4096
#: Bytes of all dense tables; an automaton beyond them is a sorted list of at most three edges a character.
DENSE_BYTES = 96 << 20
UNDETERMINED = "und"


def labelled_sample(docs: DataFrame, id_col: str = "doc_id", seed: int = 42) -> list[tuple[str, str]]:
    """(language, text) of the labelled rows with the smallest seeded hashes, at most ``SAMPLE_DOCS`` of each language.

    Texts are whole; of those longer than ``SAMPLE_CHARS``, which come after all others of their language, a window
    of that length is taken at a seeded place.  The rows are bounded per language before they are shuffled (a limit on
    row_number), and so is what reaches the driver.  Null languages and null or empty texts are no labelled rows;
    ties go by the text.
    """
    from pyspark.sql import Window as W

    known = docs.where("lang is not null and length(text) > 0").select("lang", "text", key60(F.lit(seed), F.col(id_col)).alias("h"), (F.length("text") > SAMPLE_CHARS).alias("long"))
    window = F.expr(f"substring(text, int(coalesce(h, 0) % (length(text) - {SAMPLE_CHARS} + 1)) + 1, {SAMPLE_CHARS})")
    row = known.select("lang", "h", "long", F.when(F.col("long"), window).otherwise(F.col("text")).alias("text"))
    best = row.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("long", "h", "text"))).where(F.col("r") <= SAMPLE_DOCS)
    return [(x["lang"], x["text"]) for x in best.orderBy("lang", "r").collect()]


def joined(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """One text per language that has a letter: whole texts in their order, as many as ``SAMPLE_CHARS`` holds."""
    texts: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for lang, t in rows:
        if size.get(lang, 0) + len(t) <= SAMPLE_CHARS:
            texts.setdefault(lang, []).append(t)
            size[lang] = size.get(lang, 0) + len(t)
    return [(lang, " ".join(t)) for lang, t in sorted(texts.items()) if any(map(str.isalpha, "".join(t)))]


def training_sample(docs: DataFrame, id_col: str = "doc_id", seed: int = 42) -> list[tuple[str, str]]:
    """(language, sample) of the languages that are learned."""
    return joined(labelled_sample(docs, id_col, seed))


def foreign_limit(docs: DataFrame, rows: list[tuple[str, str]]) -> tuple[float, float]:
    """(bits a symbol, bits on top) beyond which a text is in none of the languages of ``rows``, a sample of ``docs``.

    Every other text of the sample teaches; all other labelled documents are held out and parsed: ``MARGIN`` times the
    ``QUANTILE`` of their costs, and ``SLACK`` phrases, so that a few odd words make no text foreign.  Costs are counted
    in steps of 1 / ``STEPS``, of which the quantile's upper end is taken, so their number doesn't grow with the input.
    Infinite if there is nothing to hold out.
    """
    taught = rows[::2]
    known = Automata(joined(taught))
    if not known.langs:
        return float("inf"), 0.0
    extra = SLACK * float(known.cost.max())
    held = docs.where("lang is not null and length(text) > 0").select("text")
    used = docs.sparkSession.createDataFrame([(t,) for _, t in taught], "text string").distinct()
    cost = identify(held.join(F.broadcast(used), "text", "left_anti"), joined(taught)).where("lang_symbols > 0")
    rate = F.greatest(F.col("lang_bits") - F.lit(extra) / F.col("lang_symbols"), F.lit(0.0))
    counted = sorted((r["step"], r["n"]) for r in cost.groupBy(F.ceil(rate * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not counted:
        return float("inf"), 0.0
    upto = np.cumsum([n for _, n in counted])
    return MARGIN * counted[int(np.searchsorted(upto, QUANTILE * upto[-1]))][0] / STEPS, extra


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-cased text; every run of other characters than letters is one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    kept = letter | np.concatenate(([False], letter[:-1]))
    return np.where(letter, codes, 32)[kept]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Table:
    """Steps of one automaton: for a state and a column, 2 * next state, plus 1 if the phrase ends before the symbol.

    ``column``: of each symbol of the whole sample its column here, 0 for symbols that this language lacks.
    """

    def __init__(self, text: np.ndarray, symbols: int):
        own = np.unique(text)
        self.column = np.zeros(symbols + 1, np.int32)
        self.column[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        self.edges = suffix_automaton(self.column[text].tolist())
        self.lone = len(self.edges)  # after a symbol that the sample lacks, which is a phrase of its own
        self.dense_bytes = 4 * (self.lone + 1) * self.width
        self.flat = None

    def dense(self) -> None:
        table = np.full((self.lone + 1, self.width), 2 * self.lone + 1, np.int32)
        for c, s in self.edges[0].items():
            table[:, c] = 2 * s + 1
        for s, edges in enumerate(self.edges):
            for c, t in edges.items():
                table[s, c] = 2 * t
        table[0, table[0] == 2 * self.lone + 1] = 2 * self.lone  # nothing ends at a text's start
        self.flat, self.edges = table.reshape(-1), []

    def sparse(self) -> None:
        found = sorted((s * self.width + c, 2 * t) for s, edges in enumerate(self.edges) for c, t in edges.items())
        self.keys, self.to = np.array([k for k, _ in found], np.int64), np.array([t for _, t in found], np.int32)
        self.anew = np.full(self.width, 2 * self.lone + 1, np.int32)
        for c, s in self.edges[0].items():
            self.anew[c] = 2 * s + 1
        self.edges = []

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        c = self.column[symbol]
        if self.flat is not None:
            return self.flat[state * self.width + c]
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        missing = self.anew[c] - ((state == 0) & (self.anew[c] == 2 * self.lone + 1))
        return np.where(self.keys[at] == key, self.to[at], missing).astype(np.int32)


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The edges of each state of the text's suffix automaton; state 0 is the root."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go


class Automata:
    """Suffix automata of a sample, one per language; the smallest are dense as long as ``DENSE_BYTES`` holds them."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in sample]
        texts = [normalised(t) for _, t in sample]
        symbols = np.unique(np.concatenate([np.array([32], np.uint32), *texts])) if texts else np.array([32], np.uint32)
        self.symbol = np.zeros(0x110000, np.int32)  # 0: in no sample
        self.symbol[symbols] = np.arange(1, len(symbols) + 1)
        self.tables = [Table(self.symbol[t], len(symbols)) for t in texts]
        left = DENSE_BYTES
        for t in sorted(self.tables, key=lambda t: t.dense_bytes):
            left -= t.dense_bytes
            if left >= 0:
                t.dense()
            else:
                t.sparse()
        self.cost = np.array([np.log2(max(2, len(t))) for t in texts])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): how many phrases each text needs."""
        size = np.array([len(t) for t in texts], np.int64)
        segments = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        flat = self.symbol[np.concatenate(texts)] if len(texts) else np.zeros(0, np.int32)
        first = np.concatenate(([0], np.cumsum(size)))[:-1]
        rank = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(segments)))[:-1], segments)
        start = first[owner] + rank * SEGMENT
        length = np.minimum(SEGMENT, first[owner] + size[owner] - start)
        # the phrase that the text's end cuts off counts too
        out = np.repeat((size > 0).astype(np.int64)[:, None], len(self.langs), 1)
        for k, (table, (ends, last)) in enumerate(zip(self.tables, self._parse(flat, start, length), strict=True)):
            came = np.zeros(len(owner), np.int32)
            todo = np.flatnonzero(rank > 0)
            while len(todo):
                new = last[todo - 1]
                todo, new = todo[new != came[todo]], new[new != came[todo]]
                before = last[todo]
                self._correct(table, flat, start, length, todo, came[todo], new, ends, last)
                came[todo] = new
                # a segment that ends in another state than before leaves the next one to be put right
                todo = todo[last[todo] != before] + 1
                todo = todo[todo < len(owner)]
                todo = todo[rank[todo] > 0]
            np.add.at(out[:, k], owner, ends)
        return out

    def _parse(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each language (phrases that end in each segment, state at its end), from the root."""
        out = [(np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)) for _ in self.tables]
        order = np.argsort(-length, kind="stable")
        for lo in range(0, len(order), LANES):
            lane = order[lo : lo + LANES]
            n, at = length[lane], start[lane]
            alive = len(lane) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
            state = [np.zeros(len(lane), np.int32) for _ in self.tables]
            count = [np.zeros(len(lane), np.int32) for _ in self.tables]
            for step, a in enumerate(alive.tolist()):
                c = flat[at[:a] + step]
                for table, s, e in zip(self.tables, state, count, strict=True):
                    v = table.step(s[:a], c)
                    e[:a] += v & 1
                    s[:a] = v >> 1
            for (ends, last), s, e in zip(out, state, count, strict=True):
                ends[lane], last[lane] = e, s
        return out

    def _correct(self, table: Table, flat: np.ndarray, start: np.ndarray, length: np.ndarray, lane: np.ndarray, old: np.ndarray, new: np.ndarray, ends: np.ndarray, last: np.ndarray) -> None:
        """Puts right ``ends`` and ``last`` of the segments ``lane``, which were parsed from ``old`` and begin in ``new``."""
        step = 0
        while len(lane):
            c = flat[start[lane] + step]
            v, w = table.step(old, c), table.step(new, c)
            ends[lane] += (w & 1) - (v & 1)
            old, new, step = v >> 1, w >> 1, step + 1
            over = (length[lane] == step) & (old != new)
            last[lane[over]] = new[over]
            more = (old != new) & ~over
            lane, old, new = lane[more], old[more], new[more]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        """Language, score (0 to 1: how far the next language is behind), bits a symbol of the winner, and symbols."""
        codes = [normalised(t) if t else np.zeros(0, np.uint32) for t in texts]
        size = np.array([len(c) for c in codes])
        if not self.langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts), size.tolist()
        bits = self.phrases(codes) * self.cost / np.maximum(size, 1)[:, None]
        best = np.argmin(bits, axis=1)
        least = bits[np.arange(len(texts)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.where(second > 0, 1 - least / np.maximum(second, 1e-12), 0.0).clip(0, 1)
        lang = [self.langs[b] if n else UNDETERMINED for b, n in zip(best.tolist(), size.tolist(), strict=True)]
        return lang, np.where(size > 0, score, 0.0).tolist(), np.where(size > 0, least, 0.0).tolist(), size.tolist()


_built: dict[tuple, Automata] = {}


def automata(sample: list[tuple[str, str]]) -> Automata:
    """The automata of a sample, built once in each Python worker."""
    key = tuple(sample)
    if key not in _built:
        _built.clear()
        _built[key] = Automata(sample)
    return _built[key]


def identify(docs: DataFrame, sample: list[tuple[str, str]], text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score``, ``lang_bits`` and ``lang_symbols`` (replaced if there already).

    Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was learned.
    Ties go to the language that comes first by code point.  Whole texts are parsed; equal texts get equal values.
    """
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    added = {"lang_pred": StringType(), "lang_score": DoubleType(), "lang_bits": DoubleType(), "lang_symbols": LongType()}
    base = docs.drop(*added)
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automata(sample)
        for b in batches:
            for part in slices(b, at):
                new = known.predict(part.column(at).to_pylist())
                types = (pa.string(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, t) for v, t in zip(new, types, strict=True))], [*part.schema.names, *added])

    return mapped(base, run, StructType([*base.schema.fields, *(StructField(n, t) for n, t in added.items())]))
