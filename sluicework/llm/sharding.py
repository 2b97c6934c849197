"""Sharding by proportional stratified interleaving.

Rows of each stratum (source) are put in a seeded random order; row r of n gets the fractional rank
(r + u) / n, where u in [0, 1) is a seeded offset of the stratum.  Sorted by fractional rank the strata
interleave in proportion to their sizes, so cutting the sequence into equal runs gives shards that all
match the mixture.  Shard row counts differ by one at most.

Neither order is made in one task.  Positions within a stratum come from bucketed running sums, and the
rows in each slice of the fractional ranks are counted from the strata's sizes alone by integer
arithmetic, so the rows are shuffled twice and read once more, only for their ids and sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_count, group_key, key60, packed, row_tie, running_totals

#: Steps of the strata's offsets u.
STEPS = 256


def interleave(docs: DataFrame, n: int, seed: int = 42, id_col: str = "doc_id", stratum: str = "source") -> DataFrame:
    """Row struct ``row`` and global position ``pos`` from 0; ``n`` is the number of rows."""
    b = bucket_count(n)
    bucket = (F.col("h") % b).alias("bucket")
    keys = docs.select(key60(F.lit(seed), F.col(id_col)).alias("h"), group_key(F.col(stratum)).alias("g"))
    rows = docs.select(packed(docs, "shard", "slot").alias("row"), key60(F.lit(seed), F.col(id_col)).alias("h"), group_key(F.col(stratum)).alias("g"), row_tie(docs).alias("tie"))
    totals = keys.groupBy("g", bucket).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_totals(rows.withColumn("bucket", F.col("h") % b), totals, "g", "bucket", [F.col("h"), F.col("tie")], F.lit(1))

    sizes = totals.groupBy("g").agg(F.sum("n").alias("size")).withColumn("u", key60(F.lit(seed), F.col("g")) % STEPS)
    # the slice of row r of a stratum is floor(b * (STEPS * r + u) / (STEPS * size)); rows below slice k:
    below = lambda k: F.least(F.col("size"), F.greatest(F.lit(0), F.expr(f"({k} * size * {STEPS} - {b} * u + {STEPS * b - 1}) div {STEPS * b}")))
    large = sizes.where(F.col("size") >= b).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"))))
    large = large.select("slice", (below("(slice + 1)") - below("slice")).alias("c"))
    small = sizes.where(F.col("size") < b).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    small = small.select(F.expr(f"({b} * ({STEPS} * r + u)) div ({STEPS} * size)").alias("slice"), F.lit(1).cast("long").alias("c"))
    slices = large.unionByName(small).groupBy("slice").agg(F.sum("c").alias("n")).withColumn("all", F.lit("all"))

    sized = totals.join(sizes, "g").select("g", "bucket", "size", "u")
    ranked = ranked.join(sized, ["g", "bucket"])
    ranked = ranked.withColumn("slice", F.expr(f"({b} * ({STEPS} * before + u)) div ({STEPS} * size)"))
    ranked = ranked.withColumn("f", (F.lit(STEPS) * F.col("before") + F.col("u")) / F.col("size")).withColumnRenamed("before", "rank").withColumn("all", F.lit("all"))
    placed = running_totals(ranked, slices, "all", "slice", [F.col("f"), F.col("g"), F.col("rank")], F.lit(1))
    return placed.select("row", F.col("before").alias("pos"))


def assign_shards(docs: DataFrame, num_shards: int = 16, seed: int = 42, id_col: str = "doc_id", stratum: str = "source") -> DataFrame:
    """``docs`` with ``shard`` (0 to num_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Null sources are a stratum of their own; null ids and null texts are rows like others.  Rows that are
    equal in id are ordered by a hash of all columns; rows equal in all columns may swap places, which
    leaves the result the same.  Fewer rows than shards leave shards empty; an empty table gives no rows.
    Columns named ``shard`` or ``slot`` in the input are replaced.
    """
    n = docs.count()
    placed = interleave(docs, n, seed, id_col, stratum)
    first = F.expr(f"(shard * {n} + {num_shards - 1}) div {num_shards}")
    out = placed.withColumn("shard", F.expr(f"(pos * {num_shards}) div {max(n, 1)}")).withColumn("slot", F.col("pos") - first)
    return out.select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
