"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with an edge; the component is named by its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until nothing changes: O(log^2 n)
    rounds, each of them min-aggregations (combined before their shuffle) and equi-joins whose skewed keys
    the engine can split.  Rows with a null end and loops are ignored.  Each round's edges are written to
    the shared checkpoint folder, so neither the driver nor a single task ever holds a component.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).toDF("u", "v", "ok").where("ok").drop("ok").distinct()
    e = released(e)
    seen = _digest(e)
    while seen[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        to = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(to, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(to.select("u", F.col("m").alias("v"))).distinct()
        e = released(small)
        now = _digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
