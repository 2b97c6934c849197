"""Ranks, running sums, neighbours and runs in the order of a group, where a group may hold most of the rows.

A window over a group sorts it in one task.  Here rows are dealt out by ranges of (group, order), so that a
large group lies in several buckets, each no larger than another, and only a bucket is sorted.  What a bucket
has to know of those before or after it is a small summary (a count, a sum, a first or last value), merged
along the buckets of its group.  At each border between two buckets at most one group goes on, so no more
summaries than buckets matter, and they are broadcast: that bound doesn't depend on the data.

The dealt rows are settled in the checkpoint folder: ranges come from samples, so a plan that was run twice
could deal rows out in two ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled

#: The columns that number buckets and rows; both ascend in the order of (group, order).
BUCKET, PLACE = "_bucket", "_place_in_all"
Order = list[str | Column]


def dealt(rows: DataFrame, part: list[str], order: Order, buckets: int | None = None, place: str | None = None) -> DataFrame:
    """``rows`` with their bucket; ``buckets``: as many as the session has shuffle partitions.

    ``place``: a column that ascends in the order of (group, order) through all buckets.
    """
    n = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(max(1, n), *part, *order)
    if place:
        out = out.sortWithinPartitions(*part, *order).withColumn(place, F.monotonically_increasing_id())
    return settled(out.withColumn(BUCKET, F.spark_partition_id()))


def _across(rows: DataFrame, part: list[str], **summaries: Column) -> DataFrame:
    """Summaries of the buckets of those groups that lie in more than one; null groups are groups.

    Groups are combined before their shuffle.  At most two buckets' worth of rows for each bucket are left.
    """
    per = rows.groupBy(*part, BUCKET).agg(*(c.alias(n) for n, c in summaries.items()))
    return per.withColumn("_in", F.count(F.lit(1)).over(W.partitionBy(*part))).where("_in > 1").drop("_in")


def _joined(rows: DataFrame, part: list[str], starts: DataFrame) -> DataFrame:
    """``rows`` with the columns that their bucket starts with; null where its group begins in it."""
    names = {c: f"_{c}_of_start" for c in [*part, BUCKET]}
    s = starts.withColumnsRenamed(names)
    same = [rows[c].eqNullSafe(s[names[c]]) for c in part] + [rows[BUCKET] == s[names[BUCKET]]]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(F.broadcast(s), on, "left").drop(*names.values())


def matched(rows: DataFrame, table: DataFrame, part: list[str]) -> DataFrame:
    """Inner join on ``part`` (at least one column), in which null groups are groups; the planner chooses its kind."""
    names = {c: f"_{c}_of_table" for c in part}
    t = table.withColumnsRenamed(names)
    t = t.select(*names.values(), *(c for c in t.columns if c not in rows.columns and c not in names.values()))
    on = rows[part[0]].eqNullSafe(t[names[part[0]]])
    for c in part[1:]:
        on = on & rows[c].eqNullSafe(t[names[c]])
    return rows.join(t, on).drop(*names.values())


def running(rows: DataFrame, part: list[str], order: Order, buckets: int | None = None, **sums: Column | str) -> DataFrame:
    """``rows`` with, for each of ``sums`` (name=value), the sum of the value over the earlier rows of the group: 0 for the first.

    A null value adds nothing.  Rows that tie in ``order`` may stand in any order; an empty ``part`` is one group.
    """
    values = {n: F.expr(v) if isinstance(v, str) else v for n, v in sums.items()}
    d = dealt(rows.withColumns({f"_v_{n}": v for n, v in values.items()}), part, order, buckets)
    per = _across(d, part, **{n: F.sum(f"_v_{n}") for n in sums})
    before = W.partitionBy(*part).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(*part, BUCKET, *(F.sum(n).over(before).alias(f"_s_{n}") for n in sums))
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = W.partitionBy(*part, BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = _joined(d, part, starts)
    out = out.withColumns({n: zero(F.col(f"_s_{n}")) + zero(F.sum(f"_v_{n}").over(inside)) for n in sums})
    return out.drop(BUCKET, *(f"_{k}_{n}" for n in sums for k in "vs"))


def numbered(rows: DataFrame, part: list[str], order: Order, name: str, buckets: int | None = None) -> DataFrame:
    """``rows`` with their place in the group, from 0, as ``name``."""
    return running(rows, part, order, buckets, **{name: F.lit(1).cast("long")})


def neighbour(rows: DataFrame, part: list[str], order: Order, buckets: int | None = None, after: bool = False, **values: Column) -> DataFrame:
    """``rows`` with, for each of ``values`` (name=value), the nearest earlier (``after``: later) row's value that isn't null; null without one.

    A bucket that has none passes on what it got, so a value may come from far.
    """
    d = dealt(rows.withColumns({f"_v_{n}": v for n, v in values.items()}), part, order, buckets, place=PLACE)
    take = F.min_by if after else F.max_by
    per = _across(d, part, **{n: take(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(PLACE))) for n in values})
    w = W.partitionBy(*part).orderBy(F.col(BUCKET).desc() if after else F.col(BUCKET)).rowsBetween(W.unboundedPreceding, -1)
    starts = per.select(*part, BUCKET, *(F.last(n, ignorenulls=True).over(w).alias(f"_s_{n}") for n in values))
    inside = W.partitionBy(*part, BUCKET).orderBy(F.col(PLACE).desc() if after else F.col(PLACE)).rowsBetween(W.unboundedPreceding, -1)
    out = _joined(d, part, starts)
    out = out.withColumns({n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_s_{n}")) for n in values})
    return out.drop(BUCKET, PLACE, *(f"_{k}_{n}" for n in values for k in "vs"))


def runs(rows: DataFrame, part: list[str], order: Order, key: str, buckets: int | None = None) -> DataFrame:
    """(part, key, length): the maximal runs of rows with one key in the order of their group; null is a key.

    Buckets are summed up by their runs, of which only the first and the last can go on in another bucket: they
    are merged where they meet with one key, a bucket of a single run with both its neighbours.
    """
    d = dealt(rows.select(*part, key, *order), part, order, buckets, place=PLACE)
    inside = W.partitionBy(*part, BUCKET).orderBy(PLACE)
    # within a bucket, places less the places among rows of the same key are constant in a run
    island = F.row_number().over(inside) - F.row_number().over(W.partitionBy(*part, BUCKET, key).orderBy(PLACE))
    found = d.withColumn("_island", island).groupBy(*part, BUCKET, key, "_island").agg(F.count(F.lit(1)).alias("length"), F.min(PLACE).alias("_from"))
    ends = W.partitionBy(*part, BUCKET)
    found = found.withColumns({"_first": F.col("_from") == F.min("_from").over(ends), "_last": F.col("_from") == F.max("_from").over(ends)}).drop("_island")
    found = settled(found)
    outer = found.where("_first or _last")
    several = found.groupBy(*part).agg(F.min(BUCKET).alias("_lo"), F.max(BUCKET).alias("_hi")).where("_lo < _hi")
    # at most two runs of each bucket are joined here
    border = _semi(outer, several)
    along = W.partitionBy(*part).orderBy(BUCKET, "_from")
    before = lambda c: F.lag(c).over(along)
    joins = (before(BUCKET) < F.col(BUCKET)) & F.col("_first") & before("_last") & before(key).eqNullSafe(F.col(key))
    merged = border.withColumn("_new", (~F.coalesce(joins, F.lit(False))).cast("long")).withColumn("_run", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy(*part, key, "_run").agg(F.sum("length").alias("length")).drop("_run")
    rest = found.where("not (_first or _last)").select(*part, key, "length").unionByName(_semi(outer, several, "left_anti").select(*part, key, "length"))
    return rest.unionByName(merged)


def _semi(rows: DataFrame, groups: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose group is (or isn't) among ``groups``, null groups included; ``groups`` has no more rows than there are buckets."""
    names = {c: f"_{c}_of_group" for c in groups.columns if not c.startswith("_")}
    g = groups.select(*(F.col(c).alias(n) for c, n in names.items()), F.lit(1).alias("_some"))
    on = g["_some"] == 1
    for c, n in names.items():
        on = on & rows[c].eqNullSafe(g[n])
    return rows.join(F.broadcast(g), on, how)
