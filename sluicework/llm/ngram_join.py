"""N-gram Jaccard join: groups of documents whose shingle sets are similar.

1. Equal texts.  Ids of one text are linked to the smallest of them, which alone goes on: a corpus in which
   everything is there a dozen times has the candidates of one of its copies.
2. Candidates by prefixes.  If two sets overlap in the t / (1 + t) of their sizes that similarity t asks for,
   then under any common order of shingles their first shingles hold a common one: of n, the first
   n - ceil(t n) + 1.  So every pair that is similar meets under a shingle of its prefixes, whatever the
   order; none is lost.  The order only decides how many others meet: shingles that are frequent (counted in
   a first pass over the beginnings of all sets) come last, so documents that merely share a passage
   hardly meet.  Tasks know them by marks, a bit at a hash of each: their number isn't bounded, and what is
   marked by chance comes late in all sets alike.  Size and place bound what a pair can still share after
   the first common shingle; pairs below the bound are discarded where they meet.
3. Documents of a shingle that more than ``FEW`` have in their prefixes aren't paired.  Size and place leave
   each an interval of sizes, and the pairs within the bound are those of intervals that hold each other:
   runs of them are linked to their smallest id.  Those of one size and place that can meet count once,
   within each task first.  Candidate groups are the components.
4. Blocks.  A group (or, if it is large, each pair of its blocks) goes to one task, which multiplies rows of
   the document by n-gram incidence with the transposed matrix: overlap counts accumulate over posting
   lists; pairs whose sizes rule the bound out are discarded before, pairs below it after.  Documents that
   are linked already aren't compared again; of equal texts one is compared.  Links are exact; the task
   returns them as a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, released
from .graph import components
from .shingles import U, chunks, flat_bytes, mix, shingle_sets

#: Bytes of text of a block.
BLOCK = 4 << 20
#: So many ids are sent to all tasks to pick rows by; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: A shingle in the prefixes of more documents is frequent.
FEW = 8
#: Bits of the marks of frequent shingles for each of them, and binary logarithms of the least and the most bits in all (32 MB).
MARKS = (32, 12, 28)
#: Frequent shingles are counted in so many times the length of a prefix.
LOOK = 1.5
#: Rows that a task holds before it passes them on.
HELD = 1_000_000

ROW = "key long, a long, n int, place int, b long"


def prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The length of the prefix of sets of n shingles."""
    return n - -(-n * num // den) + 1


def prefixes(h: np.ndarray, at: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, number of its set, place in the set's order) of the prefixes of sorted sets; ``frequent`` is sorted."""
    n = np.diff(at)
    who = np.repeat(np.arange(len(n)), n)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    else:
        late = np.zeros(len(h), bool)
    before = np.concatenate(([0], np.cumsum(late)))
    own = before[:-1] - before[at[who]]  # frequent ones before it in its set
    rest = n - (before[at[1:]] - before[at[:-1]])
    place = np.where(late, rest[who] + own, np.arange(len(h)) - at[who] - own)
    keep = place < prefix(n, num, den)[who]
    return h[keep], who[keep], place[keep]


def marked(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of ``h`` that are marked."""
    bit = h >> U(58 - (len(marks).bit_length() - 1))
    return np.unique(h[(marks[bit >> U(6)] >> (bit & U(63))) & U(1) == 1])


def _batch(key: np.ndarray, a: np.ndarray, n: np.ndarray | None, place: np.ndarray | None, b: np.ndarray | None) -> pa.RecordBatch:
    m = len(key)
    cols = [pa.array(key.view(np.int64)), pa.array(a)]
    cols += [pa.nulls(m, pa.int32()) if x is None else pa.array(x.astype(np.int32)) for x in (n, place)]
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(m, pa.int64()) if b is None else pa.array(b)], ["key", "a", "n", "place", "b"])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links as rows that are dealt out by a hash of their ends."""
    pair = np.unique(np.stack((a, b), 1), axis=0)
    return _batch(mix(pair[:, 0].astype(U) * U(3) + pair[:, 1].astype(U)), pair[:, 0], None, None, pair[:, 1])


def _limit(n: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """The size of the largest set with which one of n shingles can be similar if the first common one has this place."""
    return (n - place) * (num + den) // num - n


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before; the first does."""
    new = np.zeros(len(cols[0]), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _merged(key: np.ndarray, a: np.ndarray, n: np.ndarray, place: np.ndarray, num: int, den: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(rows by key and id, p, q): in keys of more than ``FEW`` rows the smallest id stands for all of one size and place that can meet; p are linked to q."""
    order = np.lexsort((a, place, n, key))
    key, a, n, place = key[order], a[order], n[order], place[order]
    first = _starts(key)
    many = np.repeat(np.diff(np.append(first, len(key))) > FEW, np.diff(np.append(first, len(key))))
    same = _starts(key, n, place)
    lead = np.repeat(same, np.diff(np.append(same, len(key))))
    gone = many & (lead != np.arange(len(key))) & (_limit(n, place, num, den) >= n)
    far = gone & (a[lead] != a)
    keep = np.flatnonzero(~gone)
    keep = keep[np.lexsort((a[keep], key[keep]))]
    return [c[keep] for c in (key, a, n, place)], a[far], a[lead][far]


def _pass_on(rows: list[np.ndarray], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task, merged, and links of those that others stand for."""
    (key, a, n, place), p, q = _merged(*rows, num, den)
    if len(p):
        yield _edges(p, q)
    by_id = np.argsort(a, kind="stable")  # ids in order compress well in the shuffle
    yield _batch(key[by_id], a[by_id], n[by_id], place[by_id], None)


def _runs(a: np.ndarray, n: np.ndarray, place: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id of its component) of the graph of all pairs of one key that are within the bound.

    x and y, x the smaller set, are such a pair if y's size is within x's limit and x's size within y's.
    Those whose limit isn't below their size hence pair if the intervals from size to limit overlap; others
    pair only with smaller ones, and with one at all if the largest limit among sets within theirs allows it.
    """
    order = np.argsort(n, kind="stable")
    a, n, most = a[order], n[order], _limit(n, place, num, den)[order]
    up = most >= n
    if not up.any():
        return a[:0], a[:0]
    far = np.maximum.accumulate(most[up])
    run = np.cumsum(np.append(True, n[up][1:] > far[:-1])) - 1
    at = np.searchsorted(n[up], most[~up], side="right") - 1
    fits = (at >= 0) & (far[at] >= n[~up])
    ids, runs = np.concatenate((a[up], a[~up][fits])), np.concatenate((run, run[at[fits]]))
    lead = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(lead, runs, ids)
    other = lead[runs] != ids
    return ids[other], lead[runs][other]


def _meet(key: np.ndarray, a: np.ndarray, n: np.ndarray, place: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of whole keys, rows sorted by key and id."""
    first = _starts(key)
    size = np.diff(np.append(first, len(key)))
    p, q = [a[:0]], [a[:0]]
    for lo, m in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        x, y = _runs(a[lo : lo + m], n[lo : lo + m], place[lo : lo + m], num, den)
        p.append(x)
        q.append(y)
    for m in range(2, FEW + 1):
        at = first[size == m]
        for i in range(m):
            for j in range(i + 1, m):
                x, y = at + i, at + j
                both, small, large = n[x] + n[y], np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                left = np.minimum(n[x] - place[x], n[y] - place[y])  # the common shingle and all after it
                ok = (small * den >= large * num) & (left * (num + den) >= both * num) & (a[x] != a[y])
                p.append(a[y[ok]])
                q.append(a[x[ok]])
    return np.concatenate(p), np.concatenate(q)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sets, offsets) of the documents (id, text) in pieces of bounded size."""
    for batch in batches:
        data, off = flat_bytes(batch.column(1))
        doc = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in chunks(off):
            yield doc[lo:hi], *shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)


def frequent_shingles(some: DataFrame, n: int, num: int, den: int) -> np.ndarray:
    """Marks, in words of 64 bits, of the shingles that more than ``FEW`` documents of (id, t) have among their first ones."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def counted() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(times.astype(np.int32))], ["key", "c"])

        for _, h, at in _sets(batches, n):
            size = np.diff(at)
            most = np.minimum(size, (prefix(size, num, den) * LOOK).astype(np.int64) + 1)
            held.append(h[np.arange(len(h)) - np.repeat(at[:-1], size) < np.repeat(most, size)])
            count += len(held[-1])
            if count >= HELD:
                yield counted()
                held, count = [], 0
        if held:
            yield counted()

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The keys of more than ``FEW``.  Rows come by key; the last key of a batch waits for the next one."""
        key, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _then_none(batches):
            if batch is not None:
                key, total = np.concatenate((key, batch.column(0).to_numpy())), np.concatenate((total, batch.column(1).to_numpy()))
                if not len(key):
                    continue
            elif not len(key):
                return
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sums, names = np.add.reduceat(total, first), key[first]
            key, total = (names[-1:], sums[-1:]) if batch is not None else (names[:0], sums[:0])
            if batch is not None:
                names, sums = names[:-1], sums[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(names[sums > FEW])], ["key"])

    dealt = mapped(some, begin, "key long, c int").repartition("key").sortWithinPartitions("key")
    found = released(mapped(dealt, often, "key long"))
    each, least, most = MARKS
    bits = min(most, max(least, (found.count() * each).bit_length()))
    bit = F.shiftrightunsigned("key", 64 - bits)
    words = found.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int)))").alias("word")).toArrow()
    marks = np.zeros(1 << (bits - 6), U)
    marks[words.column(0).to_numpy()] = words.column(1).to_numpy().view(U)
    return marks


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def candidate_links(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (a, b): ids that meet under a shingle of their prefixes.  Ids are 64-bit integers; rows with a null id are left out."""
    some = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    late = some.sparkSession.sparkContext.broadcast(frequent_shingles(some, n, num, den))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        with np.errstate(over="ignore"):
            for doc, h, at in _sets(batches, n):
                key, who, place = prefixes(h, at, marked(h, late.value), num, den)
                held.append((key, doc[who], np.diff(at)[who], place))
                count += len(key)
                if count >= HELD:
                    yield from _pass_on([np.concatenate(c) for c in zip(*held, strict=True)], num, den)
                    held, count = [], 0
            if count:
                yield from _pass_on([np.concatenate(c) for c in zip(*held, strict=True)], num, den)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key and id.  The last key of a batch waits for the next one, merged if it has many rows."""
        wait = [np.zeros(0, np.int64)] * 4
        for batch in _then_none(batches):
            p, q = [], []
            if batch is None:
                now, wait = wait, None
            else:
                edge = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
                a, b = batch.column(1).to_numpy(), batch.column(4).fill_null(0).to_numpy()
                p.append(a[edge])
                q.append(b[edge])
                cols = [batch.column(c).fill_null(0).to_numpy().astype(np.int64)[~edge] for c in range(4)]
                now = [np.concatenate(c) for c in zip(wait, cols, strict=True)]
                last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
                wait, now = [c[last:] for c in now], [c[:last] for c in now]
                wait, x, y = _merged(*wait, num, den)
                p.append(x)
                q.append(y)
            if len(now[0]):
                x, y = _meet(*now, num, den)
                p.append(x)
                q.append(y)
            if sum(map(len, p)):
                pair = np.unique(np.stack((np.concatenate(p), np.concatenate(q)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    dealt = mapped(some, rows, ROW).repartition("key").sortWithinPartitions("key", "a")
    return mapped(dealt, meet, "a long, b long").distinct()


def _picking(ids: DataFrame) -> DataFrame:
    """``ids``, which is stored, to be broadcast if its counted rows are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _one_of_equal(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (node, t): its rows without ids that stand nowhere for their text; (a, b) of ids and the smallest id of the same text; (node, bytes)."""
    named = texts.select("node", F.unhex(F.md5("t")).alias("name"), F.octet_length("t").alias("bytes"))
    first = released(named.join(named.groupBy("name").agg(F.min("node").alias("first")), "name").select("node", "first", "bytes"))
    each = released(first.groupBy("node").agg(F.max("bytes").alias("bytes"), F.max(F.col("node") == F.col("first")).alias("stands")))
    gone, stays = each.where("not stands").select("node"), each.where("stands").select("node")
    if stays.count() < gone.count():
        some = texts.join(_picking(stays), "node", "left_semi")
    else:
        some = texts.join(_picking(gone), "node", "left_anti")
    return some, first.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")), each.select("node", "bytes")


def link_sets(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """For each of the distinct sets the first set that it is joined with by links, itself included."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    root = list(range(m))
    todo = np.arange(m)  # not reached yet
    flat = np.concatenate(sets)
    _, col = np.unique(flat, return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(m), size)
    posts = None
    while len(todo):
        front, lead = [int(todo[0])], int(todo[0])
        todo = todo[1:]
        while front and len(todo):
            i = front.pop()
            if posts is None or len(todo) * 2 < posts[2]:
                open_ = np.zeros(m, bool)
                open_[todo] = True
                keep = open_[owner]
                order = np.argsort(col[keep], kind="stable")
                start = np.concatenate(([0], np.cumsum(np.bincount(col[keep], minlength=int(col.max()) + 1))))
                posts = (start, owner[keep][order], len(todo))
            start, rows, _ = posts
            fit = todo[(size[todo] * num <= size[i] * den) & (size[i] * num <= size[todo] * den)]
            if not len(fit):
                continue
            c = col[at[i] : at[i + 1]]
            n = start[c + 1] - start[c]
            hit = rows[np.repeat(start[c] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))]
            both = np.bincount(hit, minlength=m)[fit]
            got = fit[both * den >= num * (size[i] + size[fit] - both)]
            if len(got):
                for g in got.tolist():
                    root[g] = lead
                front.extend(got.tolist())
                todo = np.setdiff1d(todo, got, assume_unique=True)
    return root


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(a, b): exact links as a forest; its components are those of the graph of all links."""
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("t"))
    texts, equal, bytes_ = _one_of_equal(texts)
    near = released(candidate_links(texts, n, num, den, "node", "t"))
    apart = bytes_.join(_picking(released(components(near, "a", "b"))), "node")
    size = apart.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("bytes") / block).cast("int").alias("blocks"))
    placed = apart.join(size.where("n > 1"), "component").withColumn("x", F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), "blocks")).cast("int"))
    placed = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("blocks") - 1))))
    placed = placed.select("node", "component", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    unit = texts.join(_picking(released(placed)), "node").select("component", "x", "y", "node", "t").repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "node")

    def solve(ids: list[np.ndarray], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        doc = np.concatenate(ids)
        kinds: dict[bytes, int] = {}
        kind = [kinds.setdefault(s.tobytes(), len(kinds)) for s in sets]
        first = np.array([kind.index(k) for k in range(len(kinds))]) if len(kinds) < 64 else np.unique(kind, return_index=True)[1]
        root = np.array(link_sets([sets[f] for f in first], num, den))
        lead = doc[first[root[kind]]]
        return doc[doc != lead], lead[doc != lead]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        a, b = [], []
        for batch in batches:
            data, off = flat_bytes(batch.column(4))
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
            doc = batch.column(3).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(off):
                h, at = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                for x in range(hi - lo):
                    if (k := tuple(key[lo + x])) != now:
                        if len(sets) > 1:
                            p, q = solve(ids, sets)
                            a.append(p)
                            b.append(q)
                        now, ids, sets = k, [], []
                    if at[x + 1] > at[x]:
                        ids.append(doc[lo + x : lo + x + 1])
                        sets.append(h[at[x] : at[x + 1]].copy())
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if len(sets) > 1:
            p, q = solve(ids, sets)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], ["a", "b"])

    return mapped(unit, links, "a long, b long").unionByName(equal)


def shingle_counts(docs: DataFrame, n: int, text_col: str = "text", out: str = "n_shingles") -> DataFrame:
    """``docs`` without its text, with the number of distinct shingles of the text."""
    rest = [c for c in docs.columns if c not in (text_col, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat_bytes(batch.column(len(rest)))
            size = [np.diff(shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)[1]) for lo, hi in chunks(off)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(size) if size else np.zeros(0, np.int64), pa.int64())], [*rest, out])

    from pyspark.sql.types import LongType, StructField, StructType

    df = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text_col))
    return mapped(df, run, StructType([*df.schema.fields[:-1], StructField(out, LongType())]))


def similar_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles and component_id, the smallest id reachable by links.

    Two documents link when den * intersection >= num * union of their sets of n-word shingles.  Null and
    wordless texts have no shingles and no links; rows of one id are one document as far as links go; a
    null id has a null component.  Equal sets are one class, of which one member is compared.
    """
    comp = components(released(jaccard_links(docs, n, num, den, id_col, text_col, block)), "a", "b").withColumnsRenamed({"node": "_node", "component": "_component"})
    counts = shingle_counts(docs.select(F.col(id_col), F.col(text_col)), n, text_col)
    return counts.join(comp, F.col(id_col) == F.col("_node"), "left").select(F.col(id_col), "n_shingles", F.coalesce("_component", F.col(id_col)).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are in another's group: the smallest id of each group stays.

    Of several rows with one id one stays; rows with a null id all stay.
    """
    from pyspark.sql import Window as W

    from .common import row_tie

    comp = components(released(jaccard_links(docs, n, num, den, id_col, text_col)), "a", "b")
    gone = released(comp.where("node <> component").select(F.col("node").alias("_node")))
    kept = docs.join(_picking(gone), F.col(id_col) == F.col("_node"), "left_anti")
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_node")).agg(F.count(F.lit(1)).alias("n"))
    twice = released(ids.where("n > 1").select("_node"))
    if twice.isEmpty():
        return kept
    same = F.col(id_col) == F.col("_node")
    copy = F.row_number().over(W.partitionBy(id_col).orderBy("_tie"))
    several = kept.join(twice, same, "left_semi").withColumn("_tie", row_tie(docs)).withColumn("_copy", copy).where("_copy = 1").drop("_tie", "_copy")
    return kept.join(twice, same, "left_anti").unionByName(several)
