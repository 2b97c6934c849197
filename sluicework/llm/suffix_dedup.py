"""Removal of repeated byte strings by suffix sorting.

A byte goes if it is covered by a string of ``width`` bytes that also starts elsewhere in the table.

1. Anchors.  Of the ``GRAM``-byte grams in a window of ``width`` bytes the one with the least hash is the
   window's anchor, so equal windows have equal anchors at equal distances: all that can match meets under
   its anchor's hash.  Neighbouring windows mostly share an anchor; such a run of windows is one row.
2. Rows whose anchor is unique in the table end here.  Each task passes on one row per anchor to be met by
   others' and marks the rest as known to repeat, so a frequent anchor is a row per task.
3. Runs with equal bytes are one content.  Contents of an anchor are sorted: suffixes at the anchor by
   deep-shallow sorting, and reversed prefixes likewise; neighbours in both orders give the windows that
   two contents share (see ``suffix_sort``).  An anchor with more than ``LARGE`` contents is split into its
   windows, which are then counted under their own hashes.
4. The ranges go back to the documents, and the rest of each document is hashed.

Texts travel compressed and only twice: to cut out the contents that must be sorted, and to be trimmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, tabled
from .shingles import U, chunks, flat_bytes
from .suffix_sort import merge, repeated_windows

WIDTH = 200
GRAM = 32
#: Windows of a text that are hashed at once; positions take so many bits.
_BITS = 20
_SEGMENT = (1 << _BITS) - 2048
#: Distinct contents of one anchor that are sorted together.
LARGE = 50_000
#: Rows that a task holds before it passes them on.
HELD = 400_000

_SLIDE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def runs(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, anchor's hash) of each run of windows; windows lie within a text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = np.ndarray((n - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)) * U(_SLIDE[0])
        h ^= h >> U(31)
        h = h[:-8] * U(_SLIDE[1]) + h[8:]
        h ^= h >> U(29)
        h = h[:-16] * U(_SLIDE[2]) + h[16:]
        h ^= h >> U(32)
        h *= U(_SLIDE[3])
        key = (h & ~U((1 << _BITS) - 1)) | np.arange(len(h), dtype=U)
    span, at, m = width - GRAM + 1, 1, key
    while at * 2 <= span:
        m = np.minimum(m[:-at], m[at:])
        at *= 2
    if at < span:
        m = np.minimum(m[: len(m) - (span - at)], m[span - at :])
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(off) >= width)
    inside[off[long]] += 1
    inside[off[long + 1] - width + 1] -= 1
    p = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(p):
        return none, none, none, np.zeros(0, U)
    a = (m[p] & U((1 << _BITS) - 1)).astype(np.int64)
    new = np.concatenate(([True], a[1:] != a[:-1]))
    lo = p[new]
    hi = p[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(p) - 1]))]
    return lo, hi, a[new], h[a[new]]


def text_segments(data: np.ndarray, off: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes skipped of it, bytes, offsets): texts in groups; long texts in segments that overlap
    by width - 1 bytes, so that every window is in one segment."""
    for lo, hi in chunks(off, _SEGMENT):
        d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        if len(d) <= _SEGMENT:
            yield lo, 0, d, o
        else:
            for s in range(0, len(d) - width + 1, _SEGMENT - width + 1):
                part = d[s : s + _SEGMENT]
                yield lo, s, part, np.array([0, len(part)], np.int64)


OCCURRENCE = "doc long, th long, lo int, span int, run int, n int, anchor long, c1 long, c2 long"


def _flush(held: list[list[np.ndarray]]) -> pa.RecordBatch | None:
    if not held:
        return None
    cols = [np.concatenate(c) for c in zip(*held, strict=True)]
    anchor, n = cols[6], cols[5]
    order = np.argsort(anchor, kind="stable")
    cols = [c[order] for c in cols]
    anchor, n = cols[6], cols[5]
    first = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    group = np.cumsum(first) - 1
    known = np.bincount(group, weights=n)[group] > 1
    # the first row of an anchor is met by other tasks' rows under the anchor's hash; the others needn't be
    meet = np.where(first, anchor, anchor * 0x5851F42D4C957F2D + np.arange(len(anchor)))
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(known), pa.array(first), pa.array(meet)], [*(c.split()[0] for c in OCCURRENCE.split(", ")), "known", "asks", "meet"])


def occurrences(docs: DataFrame, width: int) -> DataFrame:
    """Runs of windows whose anchor occurs more than once.  ``docs``: (doc, th, t); th is a hash of the text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, off = flat_bytes(batch.column(2))
            for row, skip, d, o in text_segments(data, off, width):
                with np.errstate(over="ignore"):
                    lo, hi, _, h = runs(d, o, width)
                if not len(lo):
                    continue
                view = memoryview(np.ascontiguousarray(d))
                digest = xxhash.xxh3_128_digest
                c = np.frombuffer(b"".join([digest(view[a:z]) for a, z in zip(lo.tolist(), (hi + width).tolist(), strict=True)]), "<i8").reshape(-1, 2)
                owner = np.searchsorted(o, lo, side="right") - 1
                # a text that repeats itself at once (such as a run of one letter): equal neighbours are one row
                same = np.concatenate(([False], (c[1:] == c[:-1]).all(axis=1) & (owner[1:] == owner[:-1]) & (lo[1:] == hi[:-1] + 1)))
                head = np.flatnonzero(~same)
                last = np.concatenate((head[1:], [len(lo)])) - 1
                who = owner[head]
                held.append([doc[row + who], th[row + who], (lo[head] - o[who] + skip).astype(np.int32), (hi[last] - lo[head]).astype(np.int32), (hi[head] - lo[head]).astype(np.int32), (last - head + 1).astype(np.int32), h[head].view(np.int64), c[head, 0], c[head, 1]])
                count += len(head)
                if count >= HELD:
                    with np.errstate(over="ignore"):
                        yield _flush(held)
                    held, count = [], 0
        if held:
            with np.errstate(over="ignore"):
                yield _flush(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of ``meet``, those that ask by their anchor; the last row waits for its successor."""
        before, wait = None, None
        for batch in batches:
            if wait is not None:
                batch = pa.concat_batches([wait, batch])
            known, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (9, 10))
            k = np.where(asks, batch.column(11).to_numpy(zero_copy_only=False), 0)
            same = (k[1:] == k[:-1]) & asks[1:] & asks[:-1]
            first = bool(before is not None and asks[0] and k[0] == before)
            out = known | np.concatenate(([first], same)) | np.concatenate((same, [False]))
            n = batch.num_rows - 1
            if n:
                yield batch.slice(0, n).select(list(range(9))).filter(pa.array(out[:n]))
                before = k[n - 1] if asks[n - 1] else None
            wait = batch.slice(n)
            if out[n]:  # what is known of the last row mustn't be lost
                wait = pa.RecordBatch.from_arrays([*wait.columns[:9], pa.array([True]), wait.column(10), wait.column(11)], wait.schema.names)
        if wait is not None:
            yield wait.select(list(range(9))).filter(wait.column(9))

    rows = mapped(docs, find, OCCURRENCE + ", known boolean, asks boolean, meet long")
    dealt = rows.repartition("meet").sortWithinPartitions("meet", "asks")
    return mapped(dealt, meet, OCCURRENCE)


def compressed(docs: DataFrame) -> DataFrame:
    """(doc, th, z): texts as zstandard frames, to be shuffled; null is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [pack.compress(t.as_buffer()) if t.is_valid else pack.compress(b"") for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(z, pa.binary())], ["doc", "th", "z"])

    return mapped(docs, run, "doc long, th long, z binary")


def repeated_ranges(docs: DataFrame, width: int, large: int) -> DataFrame:
    """(doc, th, ranges): for each document with a repeated window, first and last starts, flattened."""
    found = tabled(occurrences(docs, width))
    content = ["anchor", "c1", "c2"]
    contents = tabled(found.groupBy(*content).agg(F.sum("n").alias("n"), F.min(F.struct("doc", "th", "lo", "run")).alias("at")))
    many = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    reps = contents.join(many, "anchor").select("at.*", *content, "n", "k")
    asked = reps.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "run", *content, "n", (F.col("k") > large).alias("split"))).alias("cut"))
    texts = asked.join(compressed(docs), ["doc", "th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of the contents; contents of a split anchor give a row per window, under the window's hash."""
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for z, cuts in zip(b.column(1), b.column(0).to_pylist(), strict=True):
                t = unpack.decompress(z.as_buffer())
                for x in cuts:
                    body = t[x["lo"] : x["lo"] + x["run"] + width]
                    if x["split"]:
                        for w in range(x["run"] + 1):
                            rows.append((xxhash.xxh3_64_intdigest(body[w : w + width]) - (1 << 63), x["anchor"], x["c1"], x["c2"], x["n"], w, body[w : w + width]))
                    else:
                        rows.append((x["anchor"], x["anchor"], x["c1"], x["c2"], x["n"], -1, body))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["unit", "anchor", "c1", "c2", "n", "w", "body"])

    pieces = mapped(texts.select("cut", "z"), cut, "unit long, anchor long, c1 long, c2 long, n long, w int, body binary")

    def solve(rows: list[tuple]) -> list[tuple]:
        """Ranges of repeated windows of the contents of one unit that occur once (the others repeat as they are)."""
        if rows[0][5] >= 0:
            alike: dict[bytes, int] = {}
            for r in rows:
                alike[r[6]] = alike.get(r[6], 0) + 1
            return [(r[1], r[2], r[3], [r[5], r[5]]) for r in rows if r[4] == 1 and alike[r[6]] > 1]
        bodies = [r[6] for r in rows]
        place = [_anchor_of(b, width) for b in bodies]
        return [(r[1], r[2], r[3], [x for f in got for x in f]) for r, got in zip(rows, repeated_windows(bodies, place, width), strict=True) if got and r[4] == 1]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, out = None, [], []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != now:
                    if len(group) > 1:
                        out += solve(group)
                    now, group = r[0], []
                group.append(r)
            if out:
                yield _decided(out)
                out = []
        if len(group) > 1:
            yield _decided(solve(group))

    decided = mapped(pieces.repartition("unit").sortWithinPartitions("unit"), sort, "anchor long, c1 long, c2 long, ranges array<int>")
    decided = decided.groupBy(*content).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    # collect_list above: a content has a row, or a row per window (fewer than width) if its anchor was split
    several = contents.where("n > 1").select(*content, F.array(F.lit(-1)).alias("ranges"))
    back = found.join(decided.unionByName(several), content)
    whole = "array(named_struct('a', lo, 'z', lo + span))"
    some = "transform(sequence(0, cast(size(ranges) / 2 as int) - 1), i -> named_struct('a', lo + ranges[2 * i], 'z', lo + ranges[2 * i + 1]))"
    back = back.select("doc", "th", F.expr(f"if(ranges[0] = -1, {whole}, {some})").alias("r"))
    return back.groupBy("doc", "th").agg(F.flatten(F.collect_list("r")).alias("ranges"))


def _decided(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["anchor", "c1", "c2", "ranges"])


def _anchor_of(body: bytes, width: int) -> int:
    """The anchor's place in a run's bytes."""
    with np.errstate(over="ignore"):
        return int(runs(np.frombuffer(body, np.uint8), np.array([0, len(body)], np.int64), width)[2][0])


def trim(text: bytes, ranges: list[tuple[int, int]], width: int = WIDTH) -> tuple[list[tuple[int, int]], list[bytes]]:
    """(removed spans as start and end, the pieces that stay)."""
    spans = merge([(a, z + width - 1) for a, z in ranges])
    kept, at = [], 0
    for a, z in spans:
        kept.append(text[at:a])
        at = z + 1
    kept.append(text[at:])
    return [(a, z + 1) for a, z in spans], kept


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE, with_bytes: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, ``kept``.

    Texts are UTF-8 bytes (null: empty); matches stay within a text; what repeats is judged on the input.
    Texts shorter than ``width`` lose nothing.  Rows that are equal in id and text repeat each other.  A
    null id is an id like others.  ``width`` is at least 64.
    """
    if width < 2 * GRAM:
        raise ValueError(f"width must be at least {2 * GRAM}")
    base = docs.select(F.coalesce(F.col(id_col), F.lit(-(1 << 62))).cast("long").alias("doc"), F.xxhash64(text_col, F.col(id_col).isNull()).alias("th"), F.col(text_col).alias("t"))
    ranges = repeated_ranges(base, width, large)
    all_ = compressed(base).join(ranges, ["doc", "th"], "left").select("doc", "th", "z", "ranges")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for b in batches:
            rows = []
            for doc, z, r in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                t = unpack.decompress(z.as_buffer())
                got = []
                if r.is_valid:
                    v = r.values
                    got = list(zip(v.field("a").to_pylist(), v.field("z").to_pylist(), strict=True))
                spans, kept = trim(t, got, width)
                left = b"".join(kept)
                rows.append((None if doc == -(1 << 62) else doc, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left)[: len(names)])
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    return mapped(all_, apply, schema)
