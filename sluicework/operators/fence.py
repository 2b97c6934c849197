"""Generation-fenced mutation of keyed tables, and the lifecycle of stores.

Statuses are ordered ``case`` expressions; writes are recomputed tables (joins and last-write windows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WRITABLE = ("active", "syncing")


def fence_status(known: Column, generation: Column, state: Column, expected: Column, allowed: tuple[str, ...] = WRITABLE) -> Column:
    """An unknown store fails; then the generation is compared, then the state."""
    return F.when(~known, "failed").when(generation != expected, "stale_generation").when(~state.isin(*allowed), "rejected").otherwise("succeeded")


def ingest_status(mutations: DataFrame, stores: DataFrame) -> DataFrame:
    """``mutations`` with ``status``: deletions are only fenced; an upsert first needs its body and its hash.

    ``mutations``: store_no, mutation, content_hash, body, expected_generation.  A wrong hash is reported
    before a stale generation.  The body is read here and goes no further.
    """
    s = stores.select("store_no", F.col("lifecycle_generation").alias("_g"), F.col("lifecycle_state").alias("_s"))
    j = mutations.join(s, "store_no", "left")
    fence = fence_status(F.col("_g").isNotNull(), F.col("_g"), F.col("_s"), F.col("expected_generation"))
    status = (
        F.when(F.col("mutation") == "delete", fence)
        .when(F.col("body").isNull(), "failed")
        .when(F.sha2("body", 256) != F.col("content_hash"), "rejected")
        .otherwise(fence)
    )
    return j.withColumn("status", status).drop("_g", "_s", "body")


def last_writes(ingested: DataFrame) -> DataFrame:
    """The document table after the mutations that succeeded: the last by ordinal of each key, unless a deletion.

    Deletions come after upserts of the same ordinal.  The last write is an aggregate, which combines before
    the shuffle, so a hot key is a row per task.
    """
    done = ingested.where("status = 'succeeded'")
    order = F.struct("ordinal", (F.col("mutation") == "delete").alias("d"))
    last = done.groupBy("store_no", "document_key").agg(F.max_by(F.struct("source_version", "mutation", "ordinal"), order).alias("w"))
    return last.where("w.mutation = 'upsert'").select("store_no", "document_key", "w.source_version", "w.ordinal")


def validate_fence(fences: DataFrame, stores: DataFrame) -> DataFrame:
    """``fences`` (store_no, expected_generation, allowed_states) with ``status``."""
    s = stores.select("store_no", "lifecycle_generation", "lifecycle_state")
    j = fences.join(s, "store_no", "left")
    status = F.when(F.col("lifecycle_generation").isNull(), "failed").when(F.col("lifecycle_generation") != F.col("expected_generation"), "stale_generation").when(~F.array_contains("allowed_states", F.col("lifecycle_state")), "rejected").otherwise("succeeded")
    return j.withColumn("status", status)


def transitions(stores: DataFrame, kind: Column, expected: Column) -> DataFrame:
    """``stores`` with ``new_state``, ``new_generation`` and ``outcome`` of one command each.

    begin: once more for a store that has begun from ``expected``, else from a writable state to the next
    generation.  resume: a failed store goes back to deactivating, a deactivating one stays.  mark_inactive
    and mark_failed: from deactivating, and again from their own result.
    """
    g, s = F.col("lifecycle_generation"), F.col("lifecycle_state")
    begun = (g == expected + 1) & s.isin("deactivating", "inactive", "deactivation_failed")
    begin = F.when(begun, "unchanged").when(g != expected, "stale_generation").when(~s.isin(*WRITABLE), "rejected").otherwise("applied")
    resume = F.when((g != expected), "stale_generation").when(g <= 0, "rejected").when(s == "deactivation_failed", "applied").when(s == "deactivating", "unchanged").otherwise("rejected")
    end = lambda to: F.when(g != expected, "stale_generation").when(s == to, "unchanged").when(s == "deactivating", "applied").otherwise("rejected")
    outcome = F.when(kind == "begin", begin).when(kind == "resume", resume).when(kind == "mark_inactive", end("inactive")).when(kind == "mark_failed", end("deactivation_failed")).otherwise("rejected")
    to = F.when(kind.isin("begin", "resume"), "deactivating").when(kind == "mark_inactive", "inactive").otherwise("deactivation_failed")
    out = stores.withColumn("kind", kind).withColumn("expected", expected).withColumn("outcome", outcome)
    applied = F.col("outcome") == "applied"
    return out.withColumn("new_state", F.when(applied, to).otherwise(s)).withColumn("new_generation", F.when(applied & (F.col("kind") == "begin"), g + 1).otherwise(g))


def ensure_stores(stores: DataFrame, wanted: DataFrame) -> DataFrame:
    """Insert if absent."""
    return stores.unionByName(wanted.join(stores, "store_no", "left_anti").select(*stores.columns))


def activate_users(active: DataFrame, requests: DataFrame, stores: DataFrame) -> DataFrame:
    """Active users (store_no, user_key) after the requests (store_no, user_key, expected_generation) that pass the fence."""
    s = stores.where(F.col("lifecycle_state").isin(*WRITABLE)).select("store_no", F.col("lifecycle_generation").alias("expected_generation"))
    passed = requests.join(s, ["store_no", "expected_generation"], "left_semi").select("store_no", "user_key")
    return active.select("store_no", "user_key").unionByName(passed).distinct()


def cleanup_fence(commands: DataFrame, stores: DataFrame) -> DataFrame:
    """``commands`` (store_no, expected_generation, ...) with ``status``: only the generation that is being deactivated may be cleaned."""
    s = stores.select("store_no", F.col("lifecycle_generation").alias("_g"), F.col("lifecycle_state").alias("_s"))
    status = fence_status(F.col("_g").isNotNull(), F.col("_g"), F.col("_s"), F.col("expected_generation"), ("deactivating",))
    return commands.join(s, "store_no", "left").withColumn("status", status).drop("_g", "_s")


def deactivate_users(active: DataFrame, targets: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, affected count per store) of ``targets`` (store_no, user_key or null for all, expected_generation) that pass the cleanup fence."""
    live = cleanup_fence(targets, stores).where("status = 'succeeded'")
    every = live.where("user_key is null").select("store_no").distinct()
    some = live.where("user_key is not null").select("store_no", "user_key").distinct()
    hit = active.join(every, "store_no", "left_semi").unionByName(active.join(some, ["store_no", "user_key"], "left_semi")).distinct()
    return active.join(hit, ["store_no", "user_key"], "left_anti"), hit.groupBy("store_no").agg(F.count(F.lit(1)).alias("affected"))


def remove_objects(documents: DataFrame, commands: DataFrame, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surviving documents, removed count per store) of ``commands`` (store_no, expected_generation) that pass the cleanup fence.

    The same commands clear a store's key-value state: see ``cleared_state``.
    """
    s = cleanup_fence(commands, stores).where("status = 'succeeded'").select("store_no").distinct()
    return documents.join(s, "store_no", "left_anti"), documents.join(s, "store_no", "left_semi").groupBy("store_no").agg(F.count(F.lit(1)).alias("affected"))


def cleared_state(state: DataFrame, commands: DataFrame, stores: DataFrame) -> DataFrame:
    """``state`` (store_no, key, value) after the objects of stores were removed: nothing of theirs is left."""
    s = cleanup_fence(commands, stores).where("status = 'succeeded'").select("store_no").distinct()
    return state.join(s, "store_no", "left_anti")


def put_state(puts: DataFrame, stores: DataFrame) -> DataFrame:
    """The store's key-value state after fenced puts (store_no, key, value, expected_generation, ordinal): the last that passes wins."""
    s = stores.where(F.col("lifecycle_state").isin(*WRITABLE)).select("store_no", F.col("lifecycle_generation").alias("expected_generation"))
    ok = puts.join(s, ["store_no", "expected_generation"], "left_semi")
    return ok.groupBy("store_no", "key").agg(F.max_by("value", "ordinal").alias("value"))


def mutation_results(ingested: DataFrame) -> DataFrame:
    """One result row per mutation: it echoes the hash that was declared and the generation of the command, whatever the outcome."""
    return ingested.select("store_no", "ordinal", "document_key", "source_version", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.col("expected_generation").alias("lifecycle_generation"), "mutation", "status")


def result_counters(results: DataFrame) -> DataFrame:
    """One count per mutation and status, and of stale generations."""
    return results.groupBy("mutation", "status").agg(F.count(F.lit(1)).alias("results"), F.count_if(F.col("status") == "stale_generation").alias("stale"))


def failure_of(kind: Column, outcome: Column) -> Column:
    """How a refused lifecycle command ends: begin and resume fail for good; marking reports a stale generation as its status and lets a state rejection through."""
    marks = kind.isin("mark_inactive", "mark_failed")
    return F.when(outcome.isin("applied", "unchanged"), F.when(kind == "mark_failed", "failed").otherwise("succeeded")).when(marks & (outcome == "stale_generation"), "stale_generation").otherwise(F.concat(F.lit("error:"), outcome))


def first_outcomes(commands: DataFrame, key: str = "command_id", ordinal: str = "ordinal", part: str = "store_no") -> DataFrame:
    """``commands`` with ``duplicate``: whether an earlier row of the partition has the same key."""
    n = F.row_number().over(W.partitionBy(part, key).orderBy(ordinal))
    return commands.withColumn("duplicate", n > 1)
