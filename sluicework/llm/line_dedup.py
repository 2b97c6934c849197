"""Fuzzy line deduplication: MinHash signatures, banding, exact Jaccard, union-find.

A line's shingles are the ``K``-character strings of its normalised form (a line of fewer is one shingle).  A
line is named by a 64-bit hash of its normalised form; equal lines are one row from the signatures on, first
within a batch and a task, so a line repeated in a third of all documents is a row per task.

Lines that agree in a band are candidates.  What a pair can share at most is read off two bitmaps of shingles:
a bit that only one line has set is a shingle that the other lacks.  This bound is worked out inside the join
that pairs the lines of a bucket, so pairs that can't reach the threshold are never rows, and none that can
is lost.  What is left is verified by exact Jaccard similarity of the shingle sets; verified pairs are links
of a distributed union-find.

A bucket of more than ``LARGE`` lines is first linked to ``LEADS`` of its lines.  Then its lines are compared
block by block, but only those of different classes: a large group of near copies is one class by then, and
pairs of lines that merely share a template are counted where their blocks meet and never become rows.

Hashing shingles and comparing their sets is vectorised Python on Arrow batches; the rest is DataFrame
operations.  The form without Python took three times the CPU time it may take (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, settled, tabled
from .graph import components
from .shingles import mix

K = 8
THRESHOLD = 0.8
#: Three minima to a band: a pair of similarity 0.8 shares one of nine bands with probability 0.998, one of 0.9 with 0.99999.
BANDS, ROWS = 9, 3
#: 64-bit words of a bitmap; a power of two.
WORDS = 16
#: Buckets of more lines are linked to leads first, and what is left is compared in blocks of about so many bytes of lines.
LARGE, LEADS, BLOCK = 64, 8, 1 << 20
#: So many names of lines (8 bytes each) are sent to all tasks to pick texts by; more are joined by a shuffle.
BROADCAST_NAMES = 1_000_000
#: Characters whose shingles are hashed at once.
CHUNK = 1 << 19

U = np.uint64
#: Odd multipliers of a shingle's characters, of its length if it is short, and of a band's minima and number.
_ODD = mix(np.arange(1, K + ROWS + 3, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
# the order of hashes XOR a constant is another permutation
_MASKS = np.array([0x9E3779B1 * (2 * i + 1) & (1 << 32) - 1 for i in range(BANDS * ROWS)], np.uint32)
_KEYS = [f"k{i}" for i in range(BANDS)]
_BITS = [f"b{i}" for i in range(WORDS)]


def normal_text(text: Column) -> Column:
    """Lower case; other white space than line ends is one blank.  Plain searches spare most texts the pattern."""
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r") | text.contains("\f") | text.contains("\v")
    return F.lower(F.when(odd, F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, line, h): the lines that aren't blank, normalised; h names a line's normalised form."""
    one = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(normal_text(F.col(text_col)), "\n")).alias("at", "raw"))
    norm = one.select("doc_id", "at", F.trim("raw").alias("line")).where("line <> ''")
    return norm.select("doc_id", "at", "line", F.xxhash64("line").alias("h"))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of each line one after another, len + 1 offsets); no line is empty or has a line end."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # lines have no line ends, so these fill up short ones without making them like others
    wide = "".join(t if len(t) >= K else t.ljust(K, "\n") for t in texts)
    c = np.frombuffer(wide.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    start = np.concatenate(([0], np.cumsum(np.maximum(size, K))))[:-1]
    count = np.maximum(size - K + 1, 1)
    with np.errstate(over="ignore"):
        h = c[: len(c) - K + 1] * _ODD[0]
        for k in range(1, K):
            h += c[k : len(c) - K + 1 + k] * _ODD[k]
        h = mix(h)
    off = np.concatenate(([0], np.cumsum(count)))
    return h[np.arange(off[-1]) + np.repeat(start - off[:-1], count)], off


def in_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of lines with about ``CHUNK`` characters each; a longer line is a range of its own."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > CHUNK:
            yield lo, i
            lo, held = i, 0
        held += max(len(t), K)
    if lo < len(texts):
        yield lo, len(texts)


def bitmaps(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The words of each line's bitmap, a row a line."""
    out = np.zeros((len(off) - 1, WORDS), U)
    most = 4096  # lines whose bits are spread out at once
    for lo in range(0, len(out), most):
        cut = off[lo : lo + most + 1]
        bits = np.zeros((len(cut) - 1, 64 * WORDS), bool)
        bits[np.repeat(np.arange(len(cut) - 1), np.diff(cut)), (h[cut[0] : cut[-1]] & U(64 * WORDS - 1)).astype(np.int64)] = True
        out[lo : lo + most] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return out


def signature_columns(texts: list[str]) -> list[np.ndarray]:
    """n, the keys of the bands and the words of the bitmap of each line."""
    h, off = shingle_hashes(texts)
    top = (h >> U(32)).astype(np.uint32)
    least = np.stack([np.minimum.reduceat(top ^ m, off[:-1]) for m in _MASKS]).astype(U)
    with np.errstate(over="ignore"):
        keys = [mix(sum(least[i * ROWS + r] * _ODD[K + r] for r in range(ROWS)) + U(i + 1) * _ODD[K + ROWS]) for i in range(BANDS)]
    return [np.diff(off), *(k.view(np.int64) for k in keys), *bitmaps(h, off).view(np.int64).T]


def signatures(rows: DataFrame) -> DataFrame:
    """(h, n, k0, k1, ..., b0, b1, ...) of each distinct line: its number of shingles, repeats included, the keys of its bands, and the bits that its shingles set."""
    names = ["h", "n", *_KEYS, *_BITS]

    def run(batches):
        for batch in batches:
            h, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            for lo, hi in in_chunks(texts):
                cols = signature_columns(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[lo:hi], *map(np.ascontiguousarray, cols))], names)

    one = mapped(rows.select("h", "line"), run, ", ".join(f"{c} long" for c in names))
    # equal lines have equal columns
    return one.groupBy("h").agg(*(F.min(c).alias(c) for c in names[1:]))


def shared_keys(sig: DataFrame) -> DataFrame:
    """(key, h, size) of the buckets of two lines and more, ``size`` being the lines of the key."""
    # dealt out once: counted and joined where they are; a count that left h unread would deal out anew
    member = sig.select("h", F.explode(F.array(*_KEYS)).alias("key")).repartition("key")
    size = member.groupBy("key").agg(F.count("h").alias("size")).where("size > 1")
    return tabled(member.join(size, "key"))


def renamed(df: DataFrame, mark: str, *keep: str) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{c}_{mark}") for c in df.columns))


def can_be_similar() -> Column:
    """Whether the bitmaps of (n_x, b*_x) and (n_y, b*_y) leave room for the threshold; never false for a similar pair."""
    only = lambda p, q: sum(F.bit_count(F.col(f"{b}_{p}").bitwiseAND(F.bitwise_not(f"{b}_{q}"))) for b in _BITS)
    x, y = only("x", "y"), only("y", "x")
    return (x + y) * THRESHOLD <= F.least(F.col("n_x") - x, F.col("n_y") - y) * (1 - THRESHOLD) + 1e-6


def as_pairs(both: DataFrame) -> DataFrame:
    return both.select(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).distinct()


def small_pairs(few: DataFrame) -> DataFrame:
    """Distinct (a, b) of the buckets of (key, h, n, bits) that may be similar."""
    return as_pairs(renamed(few, "x", "key").join(renamed(few, "y", "key"), "key").where((F.col("h_x") < F.col("h_y")) & can_be_similar()))


def lead_pairs(many: DataFrame) -> DataFrame:
    """Distinct (a, b): each line of a large bucket with the bucket's leads, the first line by name of each slice of names."""
    first = many.groupBy("key", F.pmod("h", F.lit(LEADS))).agg(F.min("h").alias("h")).select("key", "h")
    lead = first.join(many, ["key", "h"])
    return as_pairs(renamed(many, "x", "key").join(renamed(lead, "y", "key"), "key").where((F.col("h_x") != F.col("h_y")) & can_be_similar()))


def line_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each line."""
    sets = []
    for lo, hi in in_chunks(texts):
        h, off = shingle_hashes(texts[lo:hi])
        sets += [np.unique(h[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return sets


def verified(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b, la, lb = (c.to_pylist() for c in batch.columns)
            known = dict(zip(a, la, strict=True)) | dict(zip(b, lb, strict=True))
            sets = dict(zip(known, line_sets(list(known.values())), strict=True))
            found = []
            for x, y in zip(a, b, strict=True):
                p, q = sets[x], sets[y]
                if min(len(p), len(q)) < THRESHOLD * max(len(p), len(q)):
                    continue
                both = np.concatenate((p, q))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                j = common / (len(both) - common)
                if j >= THRESHOLD:
                    found.append((x, y, j))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["a", "b", "jaccard"])

    both = pairs.join(text.toDF("a", "la"), "a").join(text.toDF("b", "lb"), "b").select("a", "b", "la", "lb")
    return settled(mapped(both, run, "a long, b long, jaccard double"))


def class_links(h: np.ndarray, c: np.ndarray, side: np.ndarray, texts: list[str]) -> list[tuple[int, int, float]]:
    """(a, b, jaccard): links between lines of two blocks (``side`` 0 and 1; 2 is a block with itself), enough to join all classes ``c`` that links join.

    Shingles are ordered by the number of lines that have them, rarest first.  Similar lines share one of
    the first ``n - ceil(THRESHOLD * n) + 1`` shingles of both, so a line is compared, by whole sets, with
    those lines of other classes that such a list names and whose bitmaps leave room for the threshold;
    shingles of a common template come last.
    """
    sets = line_sets(texts)
    size = np.array([len(s) for s in sets])
    at = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(sets)
    _, col, lines_with = np.unique(flat, return_inverse=True, return_counts=True)
    bits = bitmaps(flat, at)
    rank = np.empty(len(lines_with), np.int64)
    rank[np.argsort(lines_with, kind="stable")] = np.arange(len(lines_with))
    ids = rank[col]
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        ids[lo:hi].sort()
    prefix = size - np.ceil(THRESHOLD * size - 1e-9).astype(np.int64) + 1
    ys = np.flatnonzero(side != 0)
    first = ids[np.repeat(at[ys], prefix[ys]) + _within(prefix[ys])]
    owner = np.repeat(ys, prefix[ys])[np.argsort(first, kind="stable")]
    start = np.concatenate(([0], np.cumsum(np.bincount(first, minlength=len(rank)))))
    kind, has, out = c.copy(), np.zeros(len(rank), bool), []
    for x in np.flatnonzero(side != 1).tolist():
        own = ids[at[x] : at[x + 1]]
        lead = own[: prefix[x]]
        n = start[lead + 1] - start[lead]
        near = np.unique(owner[np.repeat(start[lead], n) + _within(n)])
        near = near[(kind[near] != kind[x]) & ((side[near] != 2) | (near > x))]
        p, q = (np.bitwise_count(b).sum(1, dtype=np.int64) for b in (bits[x] & ~bits[near], bits[near] & ~bits[x]))
        near = near[(p + q) * THRESHOLD <= np.minimum(size[x] - p, size[near] - q) * (1 - THRESHOLD) + 1e-6]
        if not len(near):
            continue
        has[own] = True
        common = np.add.reduceat(has[ids[np.repeat(at[near], size[near]) + _within(size[near])]], np.concatenate(([0], np.cumsum(size[near])[:-1])), dtype=np.int64)
        has[own] = False
        j = common / (size[x] + size[near] - common)
        for y, value in zip(near[j >= THRESHOLD].tolist(), j[j >= THRESHOLD].tolist(), strict=True):
            if kind[y] != kind[x]:
                kind[kind == kind[y]] = kind[x]
                u, v = int(h[x]), int(h[y])
                out.append((min(u, v), max(u, v), value))
    return out


def _within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... n[0] - 1, 0, 1, ... n[1] - 1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def block_links(many: DataFrame, comp: DataFrame, text: DataFrame) -> DataFrame:
    """(a, b, jaccard) between lines of one large bucket that aren't in one class of ``comp`` yet; not all links, but all classes that links join.

    Lines of small classes are dealt to blocks together, a large class has blocks of its own, and no two
    blocks of one large class are compared.  Blocks hold about ``BLOCK`` bytes of lines at any size.
    """
    part = many.join(comp.withColumnsRenamed({"node": "h", "component": "c"}), "h", "left").withColumn("c", F.coalesce("c", "h"))
    mixed = part.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    part = settled(part.join(mixed, "key", "left_semi"))
    if part.isEmpty():
        return many.select(F.col("h").alias("a"), F.col("h").alias("b"), F.lit(1.0).alias("jaccard")).limit(0)
    # what a line weighs here: its characters, and what its arrays take even if it is short
    weight = F.col("n") + 64
    kind = part.groupBy("key", "c").agg(F.sum(weight).alias("members"))
    # a large class is a group of its own; all others are group null
    part = part.join(kind, ["key", "c"]).withColumn("own", F.when(F.col("members") > BLOCK, F.col("c")))
    total = part.groupBy("key", "own").agg(F.sum(weight).alias("total")).withColumnsRenamed({"key": "_key", "own": "_own"})
    part = part.join(total, (F.col("key") == F.col("_key")) & F.col("own").eqNullSafe(F.col("_own")))
    dealt = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("c")).otherwise(F.col("h"))), F.ceil(F.col("total") / BLOCK))
    part = settled(part.select("key", "h", "c", "own", F.xxhash64(F.coalesce("own", F.lit(0)), F.col("own").isNull(), dealt).alias("block")))
    block = part.select("key", "block", "own").distinct()
    i, j = renamed(block, "x", "key"), renamed(block, "y", "key")
    two = settled(i.join(j, "key").where("block_x <= block_y and not (own_x <=> own_y and own_x is not null)").select("key", "block_x", "block_y"))
    row = part.select("key", "block", "h", "c").join(text, "h")
    side = lambda mark, value, where: two.where(where).withColumn("block", F.col(f"block_{mark}")).withColumn("side", F.lit(value))
    sides = side("x", 0, "block_x < block_y").union(side("y", 1, "block_x < block_y")).union(side("x", 2, "block_x = block_y"))

    def run(group: pa.Table) -> pa.Table:
        found = class_links(*(group.column(c).to_numpy() for c in ("h", "c", "side")), group.column("line").to_pylist())
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64()), "jaccard": pa.array([f[2] for f in found], pa.float64())})

    both = row.join(sides, ["key", "block"]).select("key", "block_x", "block_y", "side", "h", "c", "line")
    return settled(both.groupBy("key", "block_x", "block_y").applyInArrow(run, "a long, b long, jaccard double"))


def similar_lines(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, at, h) of all lines; links (a, b, jaccard); (node, component) of the linked lines)."""
    rows = tabled(lines(docs, id_col, text_col))  # split once
    sig = tabled(signatures(rows))
    shared = shared_keys(sig)
    asked = settled(shared.select("h").distinct())
    pick = F.broadcast(asked) if asked.count() <= BROADCAST_NAMES else asked
    text = tabled(rows.select("h", "line").join(pick, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")))
    narrow = rows.drop("line")
    member = shared.join(sig.drop(*_KEYS), "h")
    pairs = small_pairs(member.where(F.col("size") <= LARGE).drop("size"))
    if shared.where(F.col("size") > LARGE).isEmpty():
        links = verified(settled(pairs), text)
        return narrow, links, components(links, "a", "b")
    many = settled(member.where(F.col("size") > LARGE).drop("size"))
    links = verified(settled(pairs.union(lead_pairs(many)).distinct()), text)
    comp = settled(components(links, "a", "b"))
    links = links.union(block_links(many.select("key", "h", "n"), comp, text))
    return narrow, links, components(links, "a", "b")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines without their text, with ``kept``; links (a, b, jaccard) between distinct lines)."""
    narrow, links, comp = similar_lines(docs, id_col, text_col)
    comp = comp.where("node <> component").withColumnRenamed("node", "h")
    classed = tabled(narrow.join(comp, "h", "left").select("doc_id", "at", F.coalesce("component", "h").alias("class")))
    # written first, so that the join below deals out both its sides anew and can split a hot class
    keeper = settled(classed.groupBy("class").agg(F.min(F.struct("doc_id", "at")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    kept = F.col("keep").isNull() | (F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.at") == F.col("at")))
    return classed.join(keeper, "class", "left").select("doc_id", "at", "class", kept.alias("kept")), links


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document id: doc_id, n_lines, n_kept, dropped (places of its dropped lines, in order).

    Of each class of similar lines the one that comes first by (doc_id, place) stays.  Blank lines are
    neither counted nor dropped; null and blank texts have no lines.  Rows of one id are one document.
    """
    narrow, _ = line_classes(docs, id_col, text_col)
    per = narrow.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("kept").alias("n_kept"), F.array_sort(F.collect_list(F.when(~F.col("kept"), F.col("at")))).alias("dropped"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    out = ids.join(per.withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return out.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def without_dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines cut out of their text."""
    gone = dedup_lines(docs, id_col, text_col).select(F.col("doc_id").alias("_d"), F.split("dropped", ",").alias("_gone"))
    both = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_d")), "left")
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_gone", i.cast("string")))
    return both.withColumn(text_col, F.array_join(kept, "\n")).select(*docs.columns)
