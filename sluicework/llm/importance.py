"""Importance resampling towards a target distribution, over hashed word features.

Words are found in the bytes of an Arrow UTF-8 buffer: a lookup table classifies every byte, differences of
the classes are the words' borders, and a table-driven CRC-32 is advanced by one byte for all words at once,
those that have ended aside.  No text becomes a Python string.

Documents and target are counted into a fixed number of buckets; each task counts its own first.  A document
is read twice, for the counts and for its weight; what is ranked is a narrow table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ordered import numbered
from .common import mapped, settled

BUCKETS = 10_000
#: Words are classified in pieces of so many bytes, and hashed so many at a time.
PIECE, AT_ONCE = 4 << 20, 1 << 18
#: Bytes after which the words that are still open are finished one by one.
LONG = 64
ADDED = ("n_features", "weight", "score", "rank")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words (digits, letters, all beyond ASCII), and bytes with A-Z lower-cased."""
    b = np.arange(256)
    upper = (b >= 0x41) & (b <= 0x5A)
    word = ((b >= 0x30) & (b <= 0x39)) | upper | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)
    return word, np.where(upper, b + 32, b).astype(np.uint8)


def _crc_table() -> np.ndarray:
    """Remainders of all bytes by the polynomial of CRC-32, reflected."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


IS_WORD, LOWER = _classes()
CRC = _crc_table()
ONES = np.uint32(0xFFFFFFFF)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """(bytes, offsets of the texts in them and their end) of an Arrow string column; null texts are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes between the first and the last offset; no word goes beyond a text."""
    first, last = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    starts, ends = [], []
    for a in range(first, last, PIECE):
        z = min(last, a + PIECE)
        inside = IS_WORD[data[a:z]]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        begun, ended = np.flatnonzero(edge == 1) + a, np.flatnonzero(edge == -1) + a
        # words that two texts, or two pieces, share are cut at the texts' borders and joined at the pieces'
        cuts = at[(at > a) & (at < z)]
        cuts = np.unique(cuts[(inside[cuts - a]) & (inside[cuts - a - 1])]) if len(cuts) else cuts
        begun, ended = np.sort(np.concatenate([begun, cuts])), np.sort(np.concatenate([ended, cuts]))
        if ends and len(begun) and len(ends[-1]) and ends[-1][-1] == begun[0] == a and not (at == a).any():
            begun, ends[-1] = begun[1:], ends[-1][:-1]
        starts.append(begun)
        ends.append(ended)
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def advanced(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC registers after the lower-cased bytes from each start to its end: one byte of every word at a time."""
    crc = crc.copy()
    live = np.arange(len(starts))
    for k in range(LONG):
        live = live[starts[live] + k < ends[live]]
        if not len(live):
            return crc
        now = crc[live]
        crc[live] = CRC[(now ^ LOWER[data[starts[live] + k]]) & 0xFF] ^ (now >> np.uint32(8))
    for i in live[starts[live] + LONG < ends[live]].tolist():
        crc[i] = zlib.crc32(LOWER[data[starts[i] + LONG : ends[i]]].tobytes(), int(crc[i] ^ ONES)) ^ int(ONES)
    return crc


def hashed(data: np.ndarray, at: np.ndarray, runs: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all features: runs of 1 to ``runs`` consecutive words of a text, joined by a blank."""
    starts, ends = words(data, at)
    text = np.searchsorted(at, starts, side="right") - 1
    for a in range(0, len(starts), AT_ONCE):
        z = min(len(starts), a + AT_ONCE)
        own = np.arange(a, z)
        crc = np.full(z - a, ONES)
        for k in range(runs):
            if k:
                more = own + k < len(starts)
                more[more] = text[own[more] + k] == text[own[more]]
                own, crc = own[more], crc[more]
                crc = CRC[(crc ^ np.uint32(0x20)) & 0xFF] ^ (crc >> np.uint32(8))
            crc = advanced(crc, data, starts[own + k], ends[own + k])
            yield text[own], ((crc ^ ONES) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: at most ``buckets`` rows come from a task and to the driver."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, found in hashed(*buffers(b.column(0)), runs, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in mapped(docs.select(docs[f"`{text_col}`"].cast("string").alias("t")), run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of smoothed frequencies in each bucket, rounded down."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text_col: str = "text", runs: int = 1) -> DataFrame:
    """``docs`` without ``text_col`` and with ``n_features``, ``weight`` (the gains of all features added) and ``_words``."""
    kept = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() not in ADDED]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gain = shared.value
        for b in batches:
            m = b.num_rows
            n, w, count = np.zeros(m, np.int64), np.zeros(m, np.int64), None
            data, at = buffers(b.column(len(names)))
            for text, found in hashed(data, at, runs, len(gain)):
                n += np.bincount(text, minlength=m)
                # texts ascend, so their sums are differences of one running sum, exact in integers
                upto = np.concatenate([[0], np.cumsum(gain[found])])
                edges = np.searchsorted(text, np.arange(m + 1))
                w += np.diff(upto[edges])
            count = n if runs == 1 else np.bincount(np.searchsorted(at, words(data, at)[0], side="right") - 1, minlength=m)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(n, pa.int64()), pa.array(w, pa.int64()), pa.array(count, pa.int64())], names=[*names, "n_features", "weight", "_words"])

    schema = StructType([*kept, *(StructField(c, LongType()) for c in ("n_features", "weight", "_words"))])
    return mapped(docs.select(*(docs[f"`{c}`"] for c in names), docs[f"`{text_col}`"].cast("string").alias("_text")), run, schema)


def noise(ids: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw that the seed and the id fix, rounded down; a null id draws as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, runs: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``docs`` without ``text_col`` and with ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    ``percent`` of the texts with ``min_words`` words are drawn, rounded down: those of the greatest weight plus
    Gumbel noise, which is a draw without replacement in proportion to the weights' exponentials.  Ties go to the
    smaller id; null ids come last, and rows of one id draw the same noise.  Null texts have no features and
    weight 0; an empty target gives gains by the source alone; an empty table no rows.  Input columns named
    like those added are replaced.
    """
    gain = gains(bucket_counts(docs, text_col, runs, buckets), bucket_counts(target, target_col, runs, buckets))
    scored = settled(weighted(docs, gain, text_col, runs).withColumn("score", F.col("weight") + noise(F.col(f"`{id_col}`"), seed)))
    apt = F.col("_words") >= min_words
    # texts that can't be drawn come last, so that all are ranked by one deal of narrow rows
    placed = numbered(scored.withColumn("_apt", apt), [], [F.desc("_apt"), F.desc("score"), F.col(f"`{id_col}`").asc_nulls_last(), F.col("n_features"), F.col("weight")], "_place")
    n = scored.where(apt).count()
    rank = F.when(F.col("_apt") & (F.col("_place") < percent * n // 100), F.col("_place") + 1)
    return placed.withColumn("rank", rank).drop("_apt", "_place", "_words")
