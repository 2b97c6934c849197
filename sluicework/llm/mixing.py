"""Mixing sources to target weights by Sainte-Laguë apportionment, filled from equal-token blocks.

1. Targets: sources share all tokens by weight; no target passes ``limit`` times what its source has, and
   the excess is shared again by weight (water filling, solved in closed form over the sorted ratios).
2. Seats: every word of the mix is a seat.  The seats go to the highest quotients target / (2k + 1).  Seat
   number r belongs to the shard of its place among all seats, which gives every shard integer quotas.  The
   seats before a shard's end are an apportionment of their own (the method is house-monotone), so only
   the few seats that rounding leaves open are ranked: fewer than 16 rows for each source and shard.  No
   source is off its target by more than rounding moves, whatever the other sources hold.
3. Blocks: each source's documents, in seeded order, are one stream of tokens, cut into blocks of equally
   many.  The blocks in another seeded order, turn after turn, are a line off which every shard cuts its
   quota: whole blocks, but for the two that it shares with its neighbours.

A document is taken as often as the blocks that it lies in; that is read off the running sum of copies at
its two ends, so no row is made per block and document.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import numbered, running
from .common import WORD, bucket_count, group_key, key60, packed, row_tie, running_totals, settled

#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: No source and no document is taken more often than this.
LIMIT = 3
SHARDS = 16
#: Blocks of the corpus per shard.
SEATS = 2048


def word_count(text: Column) -> Column:
    """Words of the text, 0 for null.  Only ends of words are matched, which makes an array of short strings."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """From (g, source, size), one row per source: adds ``place``, ``weight``, ``target`` and ``all``, the size of all.

    Places and sums along the sources come from range buckets, so that a table of very many sources is no task's;
    only sums over all of them reach the driver.
    """
    ranked = numbered(sizes, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("size") * float(limit))
    ranked = settled(running(ranked, [], [F.col("cap") / F.col("weight"), "place"], caps="cap", weights="weight"))
    whole, heavy = ranked.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = (F.lit(whole) - F.col("caps")) / (F.lit(heavy) - F.col("weights"))
    ranked = ranked.withColumn("full", F.col("cap") / F.col("weight") <= level)
    open_cap, open_weight = ranked.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0))).first()
    share = F.lit((whole - open_cap) / open_weight if open_weight else None).cast("double")
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * share)
    return ranked.withColumn("target", F.least(target, F.col("cap"))).withColumn("all", F.lit(whole).cast("long")).select("g", "source", "size", "place", "weight", "target", "all")


def seat_quotas(targets: DataFrame, shards: int = SHARDS, limit: int = LIMIT) -> DataFrame:
    """One row per source and shard that it has words in: (g, shard, quota)."""
    t = targets.where("target > 0").withColumn("most", F.expr(f"{limit} * size"))
    # sources at their limit take no more, so the others share what rounding moves
    sources, free, whole = t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("target") < F.col("most"), F.col("target"))), F.lit(0.0)), F.coalesce(F.max("all"), F.lit(0))).first()
    t = t.withColumn("end", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("house", F.expr(f"least(all, end * ((all + {shards - 1}) div {shards}))"))
    low = F.least(F.col("most"), F.greatest(F.lit(0), F.floor(F.col("target") * (F.col("house") - F.lit(sources)) / F.lit(whole or 1)) - 1)).cast("long")
    high = F.least(F.col("most"), F.floor(F.col("target") * (F.col("house") / F.lit(whole or 1) + F.lit(sources / (free or whole or 1)))) + 2).cast("long")
    t = t.withColumn("low", low).withColumn("high", high)
    sure = t.select("g", "end", F.col("low").alias("n"))
    left = {r["end"]: r["n"] for r in t.groupBy("end").agg((F.first("house") - F.sum("low")).alias("n")).collect()}  # a row for each shard
    seat = t.where("high > low").withColumn("k", F.explode(F.sequence("low", F.col("high") - 1)))
    seat = numbered(seat.select("g", "end", "place", (F.col("target") / (2 * F.col("k") + 1)).alias("quotient")), ["end"], [F.col("quotient").desc(), "place"], "r")
    open_seats = F.lit(0).cast("long")
    for end, n in sorted(left.items()):
        open_seats = F.when(F.col("end") == end, F.lit(n)).otherwise(open_seats)
    ends = sure.union(seat.where(F.col("r") < open_seats).select("g", "end", F.lit(1).cast("long"))).groupBy("g", "end").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.lag("n").over(W.partitionBy("g").orderBy("end")), F.lit(0))
    return ends.select("g", (F.col("end") - 1).alias("shard"), (F.col("n") - before).alias("quota")).where("quota > 0")


def shard_blocks(quotas: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(g, shard, j, tokens, turn, lo, hi): the tokens lo to hi of block j of a source that a shard takes in a turn.

    A source's blocks in seeded order (the short last block at the end), turn after turn, are one line of tokens;
    the shards cut their quotas off it one after the other.
    """
    cut = W.partitionBy("g").orderBy("shard")
    end = F.sum("quota").over(cut.rowsBetween(W.unboundedPreceding, 0))
    s = quotas.withColumn("z", end).withColumn("a", F.col("z") - F.col("quota")).join(targets.select("g", "size", "block"), "g")
    s = s.withColumn("turn", F.explode(F.expr("sequence(a div size, (z - 1) div size)")))
    s = s.select("g", "shard", "turn", F.greatest(F.lit(0), F.expr("a - turn * size")).alias("a"), F.expr("least(size, z - turn * size)").alias("z"))
    b = targets.withColumn("j", F.explode(F.expr("sequence(0L, greatest(0L, (size - 1) div block))")))
    b = b.withColumn("tokens", F.least(F.col("block"), F.col("size") - F.col("j") * F.col("block"))).where("tokens > 0")
    seeded = W.partitionBy("g").orderBy(F.col("tokens") < F.col("block"), key60(F.lit(seed), F.col("g"), F.col("j")), "j")
    b = b.withColumn("r", F.row_number().over(seeded).cast("long") - 1).select("g", "j", "tokens", "block", "r")
    # block number r of the line begins at r * block, so a shard's blocks are a range of numbers
    s = s.join(targets.select("g", "block"), "g").withColumn("r", F.explode(F.expr("sequence(a div block, (z - 1) div block)")))
    got = s.drop("block").join(b, ["g", "r"])
    lo, hi = F.greatest(F.lit(0), F.col("a") - F.col("r") * F.col("block")), F.least(F.col("tokens"), F.col("z") - F.col("r") * F.col("block"))
    return got.select("g", "shard", "j", "tokens", "turn", lo.alias("lo"), hi.alias("hi"))


def block_copies(quotas: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(g, j, copies, part, cum): how often block j of a source is taken whole by all shards together, how many tokens of its
    beginning are taken once more, and the tokens taken from the blocks before it.  A last row stands for the end."""
    taken = shard_blocks(quotas, targets, seed).groupBy("g", "j").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.first("tokens").alias("tokens"))
    every = targets.select("g", F.explode(F.expr("sequence(0L, (size + block - 1) div block)")).alias("j"))
    b = every.join(taken, ["g", "j"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    before = W.partitionBy("g").orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    whole = F.coalesce(F.expr("taken div tokens"), F.lit(0))
    return b.select("g", "j", whole.alias("copies"), (F.col("taken") - whole * F.coalesce("tokens", F.lit(0))).alias("part"), F.coalesce(F.sum("taken").over(before), F.lit(0)).alias("cum"))


def mix(docs: DataFrame, seed: int = 42, id_col: str = "doc_id", source: str = "source", size_col: str | None = None, shards: int = SHARDS, seats: int = SEATS) -> DataFrame:
    """``row`` (all columns), ``size``, ``source_size``, ``target`` and ``taken`` of every document.

    ``size_col`` names a column of sizes; without it the words of ``text`` count.  Null texts and texts
    without words have size 0 and are never taken; null sources are one source that comes last; an empty
    table gives no rows.  Equal rows are separate documents: which of them a half-taken block falls on
    doesn't show.  Reruns agree, as every order is by a seeded hash and then by the row's content.
    """
    n = docs.count()
    b = bucket_count(n)
    size = F.col(size_col).cast("long") if size_col else word_count(F.col("text"))
    h = key60(F.lit(seed), F.col(id_col)).alias("h")
    rows = docs.select(packed(docs).alias("row"), F.col(source).cast("string").alias("source"), group_key(F.col(source)).alias("g"), h, row_tie(docs).alias("tie"), size.alias("size")).withColumn("bucket", F.col("h") % b)
    totals = docs.select(F.col(source).cast("string").alias("source"), group_key(F.col(source)).alias("g"), h, size.alias("size")).groupBy("g", (F.col("h") % b).alias("bucket")).agg(F.sum("size").alias("n"), F.first("source").alias("source"))
    sizes = totals.groupBy("g").agg(F.first("source").alias("source"), F.sum("n").alias("size"))
    targets = source_targets(settled(sizes))
    targets = targets.withColumn("block", F.greatest(F.lit(1), F.expr(f"(all + {shards * seats - 1}) div {shards * seats}")))
    copies = block_copies(seat_quotas(targets, shards), targets, seed)
    block = targets.select("g", F.col("size").alias("source_size"), "target", "block")

    placed = running_totals(rows, totals.select("g", "bucket", "n"), "g", "bucket", [F.col("h"), F.col("tie"), F.col("size")], F.col("size"))
    known = totals.select("g", "bucket").join(block, "g")  # the hot source's rows meet by bucket, not by source
    placed = placed.join(known, ["g", "bucket"]).withColumn("end", F.col("before") + F.col("size"))
    placed = placed.withColumn("j0", F.expr("before div block")).withColumn("j1", F.expr("end div block"))
    at = copies.select(F.col("g"), F.col("j").alias("j0"), F.col("copies").alias("c0"), F.col("part").alias("p0"), F.col("cum").alias("s0"))
    to = copies.select(F.col("g"), F.col("j").alias("j1"), F.col("copies").alias("c1"), F.col("part").alias("p1"), F.col("cum").alias("s1"))
    got = placed.join(at, ["g", "j0"], "left").join(to, ["g", "j1"], "left")
    upto = lambda s, c, p, x: F.col(s) + F.col(c) * x + F.least(F.col(p), x)
    taken = upto("s1", "c1", "p1", F.col("end") % F.col("block")) - upto("s0", "c0", "p0", F.col("before") % F.col("block"))
    return got.select("row", "h", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.coalesce(taken, F.lit(0))).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42, **names: str) -> DataFrame:
    """The mix as whole documents with the columns of ``docs``: each repeated taken / size times, rounded
    up or down by a seeded draw, so that the expected tokens of every source are those of the mix."""
    m = mix(docs, seed, **names)
    draw = (F.col("h") % 1000003) / F.lit(1000003.0)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.col("taken") / F.col("size") + draw)).cast("int")
    kept = m.withColumn("copies", copies).where("copies > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
