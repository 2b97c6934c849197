"""Paging, fan-out and roll-ups: documents to pages, pages to resources, resources to users, users to stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordered


def paged(rows: DataFrame, part: list[str], order: list[str], page_size: int) -> DataFrame:
    """``rows`` with ``page_no`` (from 0) and ``page_ordinal`` within each partition."""
    return ordered.numbered(rows, part, order, "_n").withColumn("page_no", F.expr(f"_n div {page_size}")).withColumn("page_ordinal", F.expr(f"_n % {page_size}")).drop("_n")


def deletion_refs(pages: DataFrame) -> DataFrame:
    """Deleted keys as document references: version ``deleted:{page_key}``, no place and no hash."""
    return pages.select("page_key", F.explode("deleted_document_keys").alias("document_key")).select("page_key", "document_key", F.concat(F.lit("deleted:"), "page_key").alias("source_version"), F.lit("").alias("staging_uri"), F.lit("").alias("content_hash"))


def page_rollup(statuses: DataFrame) -> DataFrame:
    """Per page: status, changed and deleted documents (as sent, not as done), errors and the first error.

    Stale generations are no errors.
    """
    bad = ~F.col("status").isin("succeeded", "stale_generation")
    first = F.min(F.when(bad, F.struct((F.col("mutation") == "delete").alias("d"), "ordinal", "status")))
    out = statuses.groupBy("store_no", "user_key", "resource_key", "page_no").agg(
        F.count_if(F.col("mutation") == "upsert").alias("changed_documents"),
        F.count_if(F.col("mutation") == "delete").alias("deleted_documents"),
        F.count_if(bad).alias("error_count"),
        first.alias("f"),
    )
    return out.withColumn("status", F.when(F.col("error_count") > 0, "partial").otherwise("succeeded")).withColumn("first_error", F.concat(F.lit("document-"), F.col("f.ordinal").cast("string"), F.lit(":"), F.col("f.status"))).drop("f")


def resource_rollup(pages: DataFrame) -> DataFrame:
    """Per (store, user, resource): pages done, status, errors and the checkpoint: the cursor of the earliest
    failed page (null for the first page), else of nothing more to do."""
    out = pages.groupBy("store_no", "user_key", "resource_key").agg(
        F.count_if(~F.col("failed")).alias("pages_completed"),
        F.count_if("failed").alias("error_count"),
        F.min(F.when(F.col("failed"), F.struct("seq", "cursor"))).alias("f"),
    )
    return out.select("store_no", "user_key", "resource_key", "pages_completed", "error_count", F.col("f.cursor").alias("next_cursor"), (F.col("error_count") == 0).alias("finished"), F.when(F.col("error_count") > 0, "partial").otherwise("succeeded").alias("status"))


def user_rollup(resources: DataFrame, requested: int) -> DataFrame:
    """Per user: all pages and errors, resources finished, the first non-null cursor by resource name, status."""
    cursor = F.min(F.when(F.col("next_cursor").isNotNull(), F.struct("resource_key", "next_cursor")))
    out = resources.groupBy("store_no", "user_key").agg(
        F.sum("pages_completed").alias("pages_completed"),
        F.sum("error_count").alias("error_count"),
        F.count_if("finished").alias("resources_completed"),
        cursor.alias("c"),
        F.every("finished").alias("all_finished"),
    )
    return out.select("store_no", "user_key", "pages_completed", "error_count", "resources_completed", F.col("c.next_cursor").alias("next_cursor"), (F.col("all_finished") & (F.col("resources_completed") == requested)).alias("finished"), F.when(F.col("error_count") > 0, "partial").otherwise("succeeded").alias("status"))


def incomplete(ordinary: bool = True) -> Column:
    """Whether a user counts as failed: by status or errors, and in ordinary mode also if not finished."""
    bad = (F.col("status") != "succeeded") | (F.col("error_count") > 0)
    return bad | ~F.col("finished") if ordinary else bad


def store_rollup(users: DataFrame, ordinary: bool = True) -> DataFrame:
    """Per store: users completed and failed, errors (one at least for each failed user), pages, status."""
    failed = incomplete(ordinary)
    return users.groupBy("store_no").agg(
        F.count_if(~failed).alias("users_completed"),
        F.count_if(failed).alias("users_failed"),
        F.sum(F.when(failed, F.greatest(F.col("error_count"), F.lit(1))).otherwise(0)).alias("error_count"),
        F.sum("pages_completed").alias("pages_completed"),
    ).withColumn("status", F.when(F.col("error_count") > 0, "partial").otherwise("succeeded"))


def uniform_rounds(users: DataFrame, window: int, pages: int, page_slice: int) -> DataFrame:
    """Round mode for users of ``pages`` pages each: their first and last round in windows of active users.

    ``pages_reported`` adds a whole slice per round, as the roll-up of round mode does.
    """
    rounds = max(1, -(-pages // page_slice))
    first = F.floor(F.col("_n") / window).cast("long") * rounds
    return ordered.numbered(users, ["store_no"], ["ordinal"], "_n").withColumn("first_round", first).drop("_n").withColumn("last_round", F.col("first_round") + rounds - 1).withColumn("pages_reported", F.lit(rounds * page_slice).cast("long"))


def bounded_sample(rows: DataFrame, part: list[str], value: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` values of each partition without repeats, joined by ``|`` in their order.

    Capping comes before removing repeats.  The cap is part of the result; ranks are cut before the shuffle.
    """
    n = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    capped = rows.withColumn("_n", n).where(F.col("_n") <= limit)
    return capped.groupBy(*part).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"])), "|").alias("sample"))


def remaining_resources(users: DataFrame, requested: str = "requested", completed: str = "completed") -> DataFrame:
    """Requested and not completed, in their order, repeats kept."""
    return users.withColumn("remaining", F.filter(F.col(requested), lambda x: ~F.array_contains(F.col(completed), x)))


def cursor_for(cursors: str, resource: Column, fallback: Column) -> Column:
    """A resource's own cursor where it has one, null included; else the fallback."""
    return F.when(F.map_contains_key(F.col(cursors), resource), F.element_at(F.col(cursors), resource)).otherwise(fallback)


def remediation_batches(users: DataFrame, resource_concurrency: int, ordinary: bool = True) -> DataFrame:
    """Failed users in batches of min(8, resource_concurrency) by user key."""
    return paged(users.where(incomplete(ordinary)), ["store_no"], ["user_key"], min(8, max(1, resource_concurrency))).withColumnsRenamed({"page_no": "batch", "page_ordinal": "batch_ordinal"})


def remediation_rollup(attempts: DataFrame) -> DataFrame:
    """Per store: users done and errors; ``users_failed`` repeats the count of errors."""
    e = F.sum("error_count")
    return attempts.groupBy("store_no").agg(F.count_if((F.col("status") == "succeeded") & (F.col("error_count") == 0)).alias("users_completed"), e.alias("error_count"), e.alias("users_failed"))


def activation_stage(recent_clean: Column, fence: Column, backfill_clean: Column) -> Column:
    """Where an activation ends: a stage that isn't clean stops it; the fence lies between the two waves."""
    return F.when(~recent_clean, "recent_failed").when(fence != "succeeded", fence).when(~backfill_clean, "backfill_failed").otherwise("activated")


def cleanup_rollup(batches: DataFrame) -> DataFrame:
    """Per store: affected rows up to and with the first failing batch, its status and message."""
    failed = F.col("status") != "succeeded"
    ran = ordered.running(batches, ["store_no"], ["batch"], _before=failed.cast("long")).where("_before = 0")
    bad = F.min(F.when(failed, F.struct("batch", "status", "message")))
    return ran.groupBy("store_no").agg(F.sum("affected").alias("affected"), F.count(F.lit(1)).alias("batches_run"), bad.alias("b")).select("store_no", "affected", "batches_run", F.coalesce("b.status", F.lit("succeeded")).alias("status"), F.col("b.message").alias("message"))


def outstanding(expected: DataFrame, drained: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(drained, key, "left_anti")


def order_violations(actions: DataFrame) -> DataFrame:
    """Actions whose place in the plan isn't the one after their predecessor's (the first: 0)."""
    told = ordered.neighbour(actions, ["store_no"], ["ordinal"], _before=F.col("action_index"))
    return told.withColumn("_due", F.coalesce(F.col("_before") + 1, F.lit(0))).drop("_before").where("action_index <> _due").drop("_due")


def warning_text(warnings: Column) -> Column:
    """The first ten warnings joined by ``; ``, at most 1,000 characters."""
    return F.substring(F.array_join(F.slice(warnings, 1, 10), "; "), 1, 1000)
