"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to e = floor(rate * m) edits.  Cut into e + 1 pieces, at least one
piece then occurs unchanged.  Pieces are found by an Aho-Corasick automaton.  From a piece hit the item is
verified upwards: of two neighbouring groups of j pieces in all, matched with at most j - 1 edits, one is
matched within its own budget, so a hit goes on only while the group above it matches within budget.  Each
step, up to the whole item, is Myers' bit-parallel distance, ending anywhere in the text around the hit.

The benchmark is the query set: it is cut into blocks of bounded size, and all documents are held against one
block in a pass without a shuffle.  A worker holds the automaton of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .shingles import slices

#: Edits that an item may have, as a share of its characters.
RATE = 0.1
#: Characters of items that go to the tasks at once.
BLOCK_CHARS = 4_000_000


def normalised(text: str) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join(text.lower().split())


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_CHARS) -> list[list[tuple[object, str]]]:
    """(id, normalised text) in blocks of about ``most`` characters; null and blank items are left out, equal items are kept by id.

    Items are dealt to blocks by a hash of their text, so that a block is collected by itself.
    """
    some = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null")
    count = max(1, -(-(some.agg(F.sum(F.length("t"))).first()[0] or 0) // most))
    dealt = some.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(count)))
    blocks = []
    for k in range(count):
        rows = dealt.where(F.col("block") == k).orderBy("id", "t").toLocalIterator()
        blocks.append([(r[0], t) for r in rows if (t := normalised(r[1]))])
    return [b for b in blocks if b] or [[]]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """(least distance of the pattern to a substring of the text, end of the first such substring); (most + 1, -1) beyond ``most``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    if m <= most:
        best, end = m, 0
    get = masks.get
    for k, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


class Pieces:
    """The pieces of a block of items in an automaton; for each piece the groups above it, smallest first."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, self.automaton = items, ahocorasick.Automaton()
        uses: dict[str, list] = {}
        for n, (_, t) in enumerate(items):
            k = int(rate * len(t)) + 1
            cut = [j * len(t) // k for j in range(k + 1)]
            for j in range(k):
                above, lo, hi = [], 0, k
                while hi - lo > 1:  # from the whole item down to the piece
                    above.append((cut[lo], cut[hi], hi - lo - 1))
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if j < mid else (mid, hi)
                uses.setdefault(t[cut[j] : cut[j + 1]], []).append((n, cut[j], above[::-1]))
        for p, u in uses.items():
            self.automaton.add_word(p, (len(p), u))
        if uses:
            self.automaton.make_automaton()
        self.empty = not uses

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, least distance, end of the match) of each item that occurs in the normalised text."""
        found: dict[int, tuple[int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for last, (size, uses) in () if self.empty else self.automaton.iter(text):
            for n, at, above in uses:
                if found.get(n, (1,))[0] == 0:
                    continue
                start = last + 1 - size - at  # where the item would begin without edits
                t = self.items[n][1]
                best, end = 0, last + 1
                for lo, hi, most in above:
                    key = (n, start, lo << 24 | hi)
                    if key in tried:
                        best = -1  # a piece at the same place has been through here
                        break
                    tried.add(key)
                    a = max(0, start + lo - most)
                    best, end = myers(t[lo:hi], text[a : start + hi + most], most)
                    end += a
                    if best > most:
                        best = -1
                        break
                if best >= 0 and (n not in found or best < found[n][0]):
                    found[n] = (best, end)
        return [(self.items[n][0], d, e) for n, (d, e) in sorted(found.items())]


_built: dict[tuple, Pieces] = {}


def _pieces(block: list[tuple[object, str]], rate: float) -> Pieces:
    """The automaton of the block that this worker serves; an earlier block's is dropped."""
    key = (rate, tuple(block))
    if key not in _built:
        _built.clear()
        _built[key] = Pieces(block, rate)
    return _built[key]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", most: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and item in it: doc_id, item_id, distance, end (a character of the normalised text).

    Whole texts are searched.  Null and blank texts and items match nothing; an item shorter than 1 / rate
    characters must occur unchanged; equal documents give equal rows, equal items a row each.  Ids may be of
    any type and null.
    """
    from functools import reduce

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    who, item = docs.schema[id_col].dataType, benchmark.schema["item_id"].dataType
    schema = StructType([StructField("doc_id", who), StructField("item_id", item), StructField("distance", IntegerType()), StructField("end", LongType())])

    def search(block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = _pieces(block, rate)
            for whole in batches:
                for b in slices(whole, 1):
                    found = [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) if t for m in pieces.find(normalised(t))]
                    cols = list(zip(*found, strict=True)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], to_arrow_type(item)), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["doc_id", "item_id", "distance", "end"])

        return mapped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), run, schema)

    return reduce(DataFrame.unionAll, (search(b) for b in item_blocks(benchmark, most=most)))


def without_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", most: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item occurs, with all their columns; null texts stay."""
    at = docs.columns.index(text_col)

    def kept(docs: DataFrame, block: list[tuple[object, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces = _pieces(block, rate)
            for whole in batches:
                for b in slices(whole, at):
                    yield b.filter(pa.array([not t or not pieces.find(normalised(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        return mapped(docs, run, docs.schema)

    for block in item_blocks(benchmark, most=most):
        docs = kept(docs, block)
    return docs
