"""Operational analytics: bounded metrics, latencies, percentiles and fairness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import settled
from . import exact, ordered

# Attributes that metrics may carry.
ALLOWED_ATTRIBUTES = ("mutation", "operation", "outcome", "phase", "provider", "quota_class", "status", "work_class")
MAX_ATTRIBUTE_BYTES = 64
# Fixed value: the refusal of a weight.
BAD_WEIGHT = "fairness weights must be greater than zero"


def bounded_attributes(attributes: Column) -> Column:
    """Only allowed keys with a value; values of more than 64 UTF-8 bytes become ``other``."""
    kept = F.map_filter(attributes, lambda k, v: k.isin(*ALLOWED_ATTRIBUTES) & v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.when(F.octet_length(v) > MAX_ATTRIBUTE_BYTES, F.lit("other")).otherwise(v))


def metric_rollup(points: DataFrame, by: list[str]) -> DataFrame:
    """Counters add, gauges keep the latest, histograms count and sum; negative counts and records are ignored."""
    ok = F.col("value") >= 0
    return points.groupBy(*by).agg(
        F.sum(F.when((F.col("kind") == "counter") & ok, F.col("value"))).alias("counter"),
        F.max_by(F.when(F.col("kind") == "gauge", F.col("value")), F.when(F.col("kind") == "gauge", F.struct("at", "ordinal"))).alias("gauge"),
        F.count_if((F.col("kind") == "histogram") & ok).alias("records"),
        F.sum(F.when((F.col("kind") == "histogram") & ok, F.col("value"))).alias("recorded"),
    )


#: Cells of the histogram of a bracket, and the rows strictly inside a bracket that are ranked at last.
CELLS, INSIDE = 200, 4096


def nearest_rank(rows: DataFrame, part: list[str], value: str, *ps: float, inside: int = INSIDE) -> DataFrame:
    """Percentile p is the sorted value number round((n - 1) * p), halves to even, from 0; with ``n``, the values that aren't null.

    No partition is sorted.  A value is found by brackets: a histogram of equally filled cells of the rows inside
    one tells the two edges around the rank, exact counts of the rows below, between and equal to them tell where
    it is, and so on until ``inside`` rows are left, which are ranked.  Each pass combines before its shuffle and
    leaves about a hundredth of the rows; a poor histogram costs passes, never exactness.
    """
    v = settled(rows.where(F.col(value).isNotNull()).select(*part, F.col(value).alias("_v")))
    kind = v.schema["_v"].dataType
    sizes = v.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    targets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.bround((F.col("n") - 1) * p).cast("long").alias("k")) for i, p in enumerate(ps))))
    none = F.lit(None).cast(kind)
    b = sizes.withColumn("_t", targets).select(*part, "n", "_t.i", "_t.k", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("upto"), F.col("n").alias("m"), none.alias("found"))
    held = settled(b)

    def within(brackets: DataFrame) -> DataFrame:
        """Rows strictly inside the brackets of their group, once for each."""
        j = ordered.matched(v, brackets, part)
        return j.where((F.col("lo").isNull() | (F.col("_v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_v") < F.col("hi"))))

    key = [*part, "i"]
    while not (wide := held.where(F.col("found").isNull() & (F.col("m") > inside))).isEmpty():
        cells = [c / CELLS for c in range(CELLS + 1)]
        edges = within(wide).groupBy(*key).agg(F.percentile_approx("_v", cells, 10 * CELLS).alias("_e"))
        at = (F.col("k") - F.col("upto")) / F.col("m") * CELLS
        pick = lambda c: F.element_at("_e", c.cast("int") + 1)
        cut = ordered.matched(wide, edges, key).withColumns({"a": pick(F.greatest(F.lit(0), F.floor(at) - 1)), "b": pick(F.least(F.lit(CELLS), F.ceil(at) + 1))}).drop("_e")
        x, a, z = F.col("_v"), F.col("a"), F.col("b")
        counts = within(cut).groupBy(*key).agg(F.count_if(x < a).alias("c0"), F.count_if(x == a).alias("c1"), F.count_if((x > a) & (x < z)).alias("c2"), F.count_if((x == z) & (a < z)).alias("c3"))
        j = ordered.matched(cut, counts, key)
        r, c0, c1, c2, c3 = F.col("k") - F.col("upto"), *map(F.col, ("c0", "c1", "c2", "c3"))
        left, at_a, mid, at_b = r < c0, r < c0 + c1, r < c0 + c1 + c2, r < c0 + c1 + c2 + c3
        five = lambda *v: F.when(left, v[0]).when(at_a, v[1]).when(mid, v[2]).when(at_b, v[3]).otherwise(v[4])
        lo, hi, upto, m = map(F.col, ("lo", "hi", "upto", "m"))
        new = j.select(*part, "n", "i", "k", five(lo, lo, a, lo, z).alias("lo"), five(a, hi, z, hi, hi).alias("hi"), five(upto, upto, upto + c0 + c1, upto, upto + c0 + c1 + c2 + c3).alias("upto"), five(c0, m, c2, m, m - c0 - c1 - c2 - c3).alias("m"), five(none, a, none, z, none).alias("found"))
        held = settled(held.where(F.col("found").isNotNull() | (F.col("m") <= inside)).unionByName(new))
    counts = within(held.where("found is null")).groupBy(*key, "k", "upto", "_v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("upto") + F.sum("c").over(W.partitionBy(*key).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    last = counts.withColumn("_z", upto).where(F.col("_z") > F.col("k")).groupBy(*key).agg(F.min("_v").alias("found"))
    found = held.where("found is not null").select(*key, "found").unionByName(last)
    out = ordered.matched(sizes, found, part)
    return out.groupBy(*part).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col("found"))).alias(f"p{round(p * 100)}") for i, p in enumerate(ps)))


def resume_latency(history: DataFrame) -> DataFrame:
    """Signals with the microseconds until the next task start of the same history, by event position."""
    start = F.when(F.col("event_type") == "task_started", F.col("event_us"))
    return ordered.neighbour(history, ["workflow_id"], ["event_id"], after=True, start_us=start).where("event_type = 'signaled' and start_us is not null").select("workflow_id", "event_id", (F.col("start_us") - F.col("event_us")).alias("latency_us"))


def schedule_to_start(history: DataFrame) -> DataFrame:
    """Started events joined with the events that scheduled them; unmatched ones are dropped."""
    s = history.where("event_type = 'scheduled'").select("workflow_id", F.col("event_id").alias("scheduled_event_id"), F.col("event_us").alias("scheduled_us"))
    t = history.where("event_type = 'started'").select("workflow_id", "event_id", "scheduled_event_id", "event_us")
    return t.join(s, ["workflow_id", "scheduled_event_id"]).select("workflow_id", "event_id", (F.col("event_us") - F.col("scheduled_us")).alias("latency_us"))


def jain_index(counts: DataFrame, part: list[str]) -> DataFrame:
    """Weighted Jain index of (part, key, count, weight) as ``jain``; 1 where nothing was counted.

    The sums are exact before they are rounded, so the index has the same bits however rows are spread.  A group
    with a weight of 0 or less, or none, has no index but an ``error``.
    """
    fine = F.coalesce(F.col("weight") > 0, F.lit(False))
    x = F.when(fine, F.col("count") / F.col("weight"))
    added = exact.sums(counts, part, s=x, q=x * x)
    told = counts.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.bool_or(~fine).alias("_bad"))
    out = ordered.matched(told, added, part)
    jain = F.when(F.col("q") == 0, 1.0).otherwise(F.col("s") * F.col("s") / (F.col("n") * F.col("q")))
    return out.select(*part, F.when(~F.col("_bad"), jain).alias("jain"), F.when(F.col("_bad"), F.lit(BAD_WEIGHT)).alias("error"))


def completion_rank(dispatches: DataFrame, part: list[str]) -> DataFrame:
    """Place of each key's last dispatch in the order of (started_at, ordinal), from 1."""
    placed = ordered.numbered(dispatches, part, ["started_at", "ordinal"], "n")
    return placed.groupBy(*part, "fairness_key").agg((F.max("n") + 1).alias("completion_rank"))


def longest_runs(dispatches: DataFrame, part: list[str]) -> DataFrame:
    """Longest run of dispatches of one key in a row."""
    runs = ordered.runs(dispatches, part, ["started_at", "ordinal"], "fairness_key")
    return runs.groupBy(*part, "fairness_key").agg(F.max("length").alias("max_run"))


def concurrency(intervals: DataFrame, part: list[str], start: str, end: str) -> DataFrame:
    """Per group: ``intervals``, the most that are open at once (``peak``), the first time at which that many are (``peak_at``) and the time that all together are open (``busy``).

    Intervals are half open, [start, end): one that ends when another begins is not open with it.  Those without
    length, and those with an unknown end or start, are never open.  A sweep line: starts add one, ends take one
    away, changes at one time are summed up before anything is ordered, and their running sum needs no task per group.
    """
    known = intervals.where(F.col(start) < F.col(end))
    change = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).cast("long").alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).cast("long").alias("d"))))
    steps = known.select(*part, change.alias("_c")).groupBy(*part, F.col("_c.at").alias("at")).agg(F.sum("_c.d").alias("d"))
    open_ = ordered.running(steps.where("d <> 0"), part, ["at"], _before="d").withColumn("open", F.col("_before") + F.col("d"))
    peak = open_.groupBy(*part).agg(F.max(F.struct("open", (-F.col("at")).alias("_at"))).alias("p"))
    sizes = known.groupBy(*part).agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col(end) - F.col(start)).alias("busy"))
    return ordered.matched(sizes, peak, part).select(*part, "intervals", F.col("p.open").alias("peak"), (-F.col("p._at")).alias("peak_at"), "busy")


def history_totals(log: DataFrame) -> DataFrame:
    """Per history of ``log`` (workflow_id, event_type, byte_size, malformed): events, bytes, signals and damaged records.

    Damaged records belong to no history: they are the row whose ``workflow_id`` is null.
    """
    good = F.col("malformed").isNull()
    return log.groupBy("workflow_id").agg(F.count_if(good).alias("events"), F.coalesce(F.sum(F.when(good, F.col("byte_size"))), F.lit(0)).alias("bytes"), F.count_if(good & (F.col("event_type") == "signaled")).alias("signals"), F.count_if(~good).alias("damaged"))
