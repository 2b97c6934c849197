"""Which rows of a key repeat an id that the key still remembers: the newest ids, by when they came first.

A stream's state is held by key and id, so a row reads and writes what belongs to its id alone, however many ids
a key remembers.  An id is forgotten when as many new ones have come after it; one that repeats isn't renewed, and
one that comes after it was forgotten is new again.

A table is dealt out by ranges of (key, order), as in ``ordered``.  All buckets are folded at once from nothing;
those whose key began in an earlier bucket are folded again from what that one ends with, until every one has begun
with what the one before it ended with.  What two beginnings leave behind is mostly the same, so one or two such
rounds do; after ``GUESSES`` of them only buckets whose beginning is certain are folded again, one at a time for a
key, so that no table costs more than a bounded number of folds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators import ordered

#: Rounds in which all buckets are folded again whose beginning has changed.
GUESSES = 3


class Recent(StatefulProcessor):
    """Adds ``duplicate`` to every row; ``ids`` names the id's column, ``order`` the one that rows of a key come in."""

    def __init__(self, ids: str, order: str, remember: int):
        self.ids, self.order, self.remember = ids, order, max(1, remember)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "id string", "place long")
        self.places = handle.getMapState("places", "place long", "id string")
        self.ends = handle.getValueState("ends", "oldest long, next long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        import pandas as pd

        oldest, following = self.ends.get() if self.ends.exists() else (0, 0)
        # a micro-batch's rows of a key come in no order
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        again = []
        for x in pdf[self.ids]:
            again.append(bool(self.known.containsKey((x,))))
            if not again[-1]:
                self.known.updateValue((x,), (following,))
                self.places.updateValue((following,), (x,))
                following += 1
                if following - oldest > self.remember:
                    gone = self.places.getValue((oldest,))
                    self.known.removeKey(gone)
                    self.places.removeKey((oldest,))
                    oldest += 1
        yield pdf.assign(duplicate=again)
        self.ends.update((oldest, following))

    def close(self) -> None:
        pass


def _fold(batches: Iterator[pa.RecordBatch], part: str, ids: str, remember: int, begin: dict[int, list[str]]) -> Iterator[tuple[pa.RecordBatch | None, list[bool], dict[int, list[str]]]]:
    """Each batch, sorted by bucket, key and order, with whether its rows repeat and what the last key of each bucket that ends leaves behind.

    ``begin``: what the first key of a bucket begins with; nothing where it is missing.
    """
    bucket, key, held, known = None, None, deque(), set()
    for batch in batches:
        again, over = [], {}
        for b, k, x in zip(*(batch.column(c).to_pylist() for c in (ordered.BUCKET, part, ids)), strict=True):
            if b != bucket:
                if bucket is not None:
                    over[bucket] = list(held)
                bucket, key, held = b, k, deque(begin.get(b, ()))
                known = set(held)
            elif k != key:
                key, held, known = k, deque(), set()
            again.append(x in known)
            if not again[-1]:
                held.append(x)
                known.add(x)
                if len(held) > remember:
                    known.remove(held.popleft())
        yield batch, again, over
    if bucket is not None:
        yield None, [], {bucket: list(held)}


def _ends(rows: DataFrame, part: str, ids: str, remember: int, begin: dict[int, list[str]]) -> dict[int, list[str]]:
    """What the last key of each bucket leaves behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, over in _fold(batches, part, ids, remember, begin):
            if over:
                yield pa.RecordBatch.from_arrays([pa.array(list(over), pa.int32()), pa.array(list(over.values()), pa.list_(pa.string()))], ["bucket", "held"])

    found = rows.select(ordered.BUCKET, part, ids).mapInArrow(run, "bucket int, held array<string>").collect()
    return {r["bucket"]: r["held"] for r in found}


def _table(rows: DataFrame, part: str, ids: str, order: str, remember: int, schema: StructType, buckets: int | None) -> DataFrame:
    """``remembered`` of a table.  What reaches the driver is ``remember`` ids of each bucket whose last key goes on."""
    d = ordered.dealt(rows, [part], [order], buckets)
    per = d.select(part, ordered.BUCKET).distinct().groupBy(part).agg(F.sort_array(F.collect_list(ordered.BUCKET)).alias("_in")).where("size(_in) > 1").collect()
    d = d.sortWithinPartitions(ordered.BUCKET, part, order)
    # of a bucket whose first key began earlier: the bucket before it, of which that key is the last
    before = {now: last for r in per for last, now in zip(r["_in"], r["_in"][1:], strict=False)}
    begin: dict[int, list[str]] = {}
    ends: dict[int, list[str]] = {}
    todo, rounds = {*before, *before.values()}, 0
    while todo:
        ends |= _ends(d.where(F.col(ordered.BUCKET).isin(sorted(todo))), part, ids, remember, begin)
        todo = {b for b, last in before.items() if begin.get(b, []) != ends[last]}
        rounds += 1
        if rounds > GUESSES:
            todo = {b for b in todo if not todo & set(_earlier(before, b))}
        begin |= {b: ends[before[b]] for b in todo}
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, again, _ in _fold(batches, part, ids, remember, begin):
            if batch is not None:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(again, pa.bool_())], [*names, "duplicate"])

    return d.mapInArrow(run, schema)


def _earlier(before: dict[int, int], bucket: int) -> Iterator[int]:
    """The buckets that lead to this one."""
    while (bucket := before.get(bucket)) is not None:
        yield bucket


def remembered(rows: DataFrame, part: str, ids: str, order: str, remember: int, buckets: int | None = None) -> DataFrame:
    """``rows``, a table or a stream, with ``duplicate``; ``ids`` are strings and not null.

    A stream needs the RocksDB state store and hands in a key's rows by ``order`` within each micro-batch.
    """
    schema = StructType([*rows.schema.fields, StructField("duplicate", BooleanType())])
    if not rows.isStreaming:
        return _table(rows, part, ids, order, max(1, remember), schema, buckets)
    return rows.groupBy(part).transformWithStateInPandas(Recent(ids, order, remember), schema, "Append", "None")
