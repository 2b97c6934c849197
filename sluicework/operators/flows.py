"""Orchestrated flows as set operations: pages, resources, users, rounds, remediations and deactivations.

What a flow decides one by one is a rule over numbered rows: a pipeline that stops at its first failure is a
filter below that failure plus the window in flight; a round schedule is a fold over a store's users that
holds no more than the window.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from . import authority, ordered
from .rollup import activation_stage, cleanup_rollup, incomplete, warning_text

RESOURCE = ["store_no", "user_key", "resource_key"]
#: Users, errors and remediation ids that a result names.
SAMPLE, ID_SAMPLE = 100, 20
#: Remediations that run at once; another begins when one less is left.
REMEDIATIONS = 4
# The actions of a deactivation in their order, and its messages.
ACTIONS = ("fence_committed", "controller_fenced", "owned_work_cancel_requested", "old_quota_invalidated", "drain_wait_finished", "users_cleaned", "objects_removed", "inactive_committed", "controller_terminal")
NO_FENCE_ACK, NO_TERMINAL_ACK = "controller did not acknowledge the generation fence", "controller did not acknowledge terminal operation status"


# ---- pages of a resource


def page_pipeline(pages: DataFrame, window: int, max_pages: int | None = None) -> DataFrame:
    """The pages that are started, of (store, user, resource, seq from 0, failed, ...).

    Pages are fetched one after the other while fewer than ``window`` are in flight and end in their order.
    The first that fails stops the fetching; what is in flight by then is drained.
    """
    some = pages if max_pages is None else pages.where(F.col("seq") < max_pages)
    stop = some.where("failed").groupBy(*RESOURCE).agg(F.min("seq").alias("_stop"))
    return some.join(stop, RESOURCE, "left").where(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop") + max(1, window))).drop("_stop")


def in_flight(pages: DataFrame, window: int) -> DataFrame:
    """Started pages with ``pending``: the pages in flight when each is admitted, itself included."""
    return pages.withColumn("pending", F.least(F.col("seq") + 1, F.lit(max(1, window))).cast("long"))


def resource_result(started: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Per resource: pages done and errors (with those of earlier runs), the cursor to go on from, whether it is finished, status.

    ``started``: seq, cursor, next_cursor, failed, errors.  A failed page has one error at least.  The cursor is
    the earliest failed page's, else what the last page names next.  ``prior``: store, user, resource, prior_pages, prior_errors.
    """
    out = started.groupBy(*RESOURCE).agg(
        F.count_if(~F.col("failed")).alias("pages"),
        F.sum(F.when(F.col("failed"), F.greatest(F.col("errors"), F.lit(1))).otherwise(0)).alias("new_errors"),
        F.min(F.when(F.col("failed"), F.struct("seq", "cursor"))).alias("f"),
        F.max(F.struct("seq", "next_cursor")).alias("l"),
    )
    if prior is not None:
        out = out.join(prior, RESOURCE, "left")
    before = lambda c: F.coalesce(F.col(c), F.lit(0)) if prior is not None else F.lit(0)
    errors = F.col("new_errors") + before("prior_errors")
    cursor = F.when(F.col("f").isNotNull(), F.col("f.cursor")).otherwise(F.col("l.next_cursor"))
    return out.select(*RESOURCE, (F.col("pages") + before("prior_pages")).alias("pages_completed"), errors.alias("error_count"), cursor.alias("next_cursor"), (F.col("f").isNull() & F.col("l.next_cursor").isNull()).alias("finished"), F.when(errors > 0, "partial").otherwise("succeeded").alias("status"))


# ---- users


def fan_out(users: DataFrame, concurrency: int) -> DataFrame:
    """A row per user and resource that is requested and not completed, in order: ``resource_key``, ``resource_no``, ``wave``, ``cursor``.

    At most ``concurrency`` resources of a user run at once.  A resource's own cursor counts where it has one,
    null included, else the user's.
    """
    left = F.filter("requested", lambda x: ~F.array_contains("completed", x))
    out = users.select("*", F.posexplode(left).alias("resource_no", "resource_key"))
    own = F.when(F.map_contains_key("resource_cursors", F.col("resource_key")), F.try_element_at("resource_cursors", F.col("resource_key"))).otherwise(F.col("cursor"))
    return out.withColumn("cursor", own).withColumn("wave", F.floor(F.col("resource_no") / max(1, concurrency)).cast("long"))


def descend(parent: DataFrame, level: str, **renamed: str) -> DataFrame:
    """The columns that a level takes from the one above, ``renamed`` as new=old; a resource's page limit is the pages' most."""
    carried = {
        "users": ("store_no", "lifecycle_generation", "sync_sequence", "user_key", "work_class", "resource_concurrency", "page_limit"),
        "resources": ("store_no", "lifecycle_generation", "sync_sequence", "user_key", "resource_key", "work_class", "cursor", "page_limit"),
        "pages": ("store_no", "lifecycle_generation", "sync_sequence", "user_key", "resource_key", "work_class", "cursor"),
    }[level]
    names = {c: c for c in carried if c in parent.columns} | ({"max_pages": "page_limit"} if level == "pages" and "page_limit" in parent.columns else {}) | renamed
    return parent.select(*(F.col(old).alias(new) for new, old in names.items()))


def comments_resync(resources: DataFrame) -> DataFrame:
    """The pages' inputs of comments alone."""
    return descend(resources.where("resource_key = 'comments'"), "pages")


def user_result(results: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: errors in the order of its resources, cursors by resource, completed resources, next cursor, finished, status.

    ``results``: store, user, resource_no, resource_key, exception (null: none), errors, next_cursor, finished.
    ``users``: requested, completed, resource_cursors (an array of resource and cursor, in order).  A resource
    that ends in an exception counts as an error ``resource:exception`` and keeps its cursor.  Cursors known
    before keep their places, new ones follow in the order of resources; the next cursor is the first that isn't null.
    """
    one = F.struct("resource_no", "resource_key", "exception", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"), "next_cursor", F.coalesce("finished", F.lit(True)).alias("finished"))
    # a user's resources are few: as many as were requested
    per = results.groupBy("store_no", "user_key").agg(F.array_sort(F.collect_list(one)).alias("r"))
    j = users.join(per, ["store_no", "user_key"], "left").withColumn("r", F.coalesce("r", F.expr("cast(array() as " + dict(per.dtypes)["r"] + ")")))
    ok = F.filter("r", lambda x: x["exception"].isNull())
    errors = F.flatten(F.transform("r", lambda x: F.when(x["exception"].isNotNull(), F.array(F.concat(x["resource_key"], F.lit(":"), x["exception"]))).otherwise(x["errors"])))
    j = j.withColumn("ok", ok).withColumn("errors", errors)
    old = F.transform("resource_cursors", lambda c: F.struct(c["resource"].alias("resource"), F.when(F.exists("ok", lambda x: x["resource_key"] == c["resource"]), F.get(F.filter("ok", lambda x: x["resource_key"] == c["resource"]), F.lit(0))["next_cursor"]).otherwise(c["cursor"]).alias("cursor")))
    new = F.transform(F.filter("ok", lambda x: ~F.exists("resource_cursors", lambda c: c["resource"] == x["resource_key"])), lambda x: F.struct(x["resource_key"].alias("resource"), x["next_cursor"].alias("cursor")))
    j = j.withColumn("cursors", F.concat(old, new))
    done = F.transform(F.filter("ok", lambda x: x["finished"] & ~F.array_contains("completed", x["resource_key"])), lambda x: x["resource_key"])
    j = j.withColumn("completed", F.concat("completed", F.array_distinct(done)))
    finished = F.forall("r", lambda x: x["exception"].isNull() & x["finished"]) & (F.size("completed") == F.size("requested"))
    following = F.get(F.filter("cursors", lambda c: c["cursor"].isNotNull()), F.lit(0))["cursor"]
    return j.select("store_no", "user_key", "errors", "cursors", "completed", F.size("ok").cast("long").alias("resources_completed"), following.alias("next_cursor"), finished.alias("finished"), F.when(F.size("errors") > 0, "partial").otherwise("succeeded").alias("status"))


def batch_join(inputs: DataFrame, results: DataFrame, key: list[str], missing: str = "MissingResult") -> DataFrame:
    """Every input with its own result or failure, whatever the order in which they end; an input without a result has failed with ``missing``.

    ``results``: key, status, error_count, finished, exception.
    """
    j = inputs.join(results, key, "left")
    lost = F.col("status").isNull() & F.col("exception").isNull()
    out = j.withColumn("exception", F.when(lost, F.lit(missing)).otherwise(F.col("exception")))
    bad = F.col("exception").isNotNull()
    return out.withColumns({"status": F.when(bad, "failed").otherwise(F.col("status")), "error_count": F.when(bad, F.lit(1)).otherwise(F.col("error_count")).cast("long"), "finished": F.when(bad, F.lit(False)).otherwise(F.coalesce("finished", F.lit(True)))})


# ---- ordinary mode


def ordinary_pages(users: DataFrame, page_size: int) -> DataFrame:
    """``users`` (store_no, ordinal, ...) with ``user_page``: the listing's page that each is on, valid or not."""
    return ordered.numbered(users, ["store_no"], ["ordinal"], "_n").withColumn("user_page", F.expr(f"_n div {max(1, page_size)}")).drop("_n")


def remediation_starts(users: DataFrame, mode: str, partition: str, generation: Column, sequence: Column) -> DataFrame:
    """One detached remediation for each partition (page or round) with failed users: its users in order, its id.

    The id names store, generation, sequence and partition, so a start that is repeated finds the one that runs.
    """
    failed = users.where(incomplete(mode == "ordinary"))
    # a partition's users are bounded by a page or a window
    out = failed.withColumns({"_g": generation, "_s": sequence}).groupBy("store_no", "store_key", F.col(partition).alias("partition")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "user_key"))), lambda x: x["user_key"]).alias("failed_user_keys"), F.first("_g").alias("_g"), F.first("_s").alias("_s")
    )
    identity = keys.json_array(keys.json_string(F.col("_s")), keys.json_array(keys.json_string(F.lit(mode)), keys.json_number(F.col("partition"))))
    return out.withColumn("remediation_id", keys.operation_id("failed-user-remediation", keys.json_string(F.col("store_key")), F.col("_g"), identity)).drop("_g", "_s")


def sync_result(users: DataFrame, mode: str, partition: str) -> DataFrame:
    """Per store: users completed and failed, errors, pages or rounds done, remediations started, a sample of failed users, status."""
    failed = incomplete(mode == "ordinary")
    per = users.withColumn("_bad", failed).groupBy("store_no", partition).agg(
        F.count_if(~F.col("_bad")).alias("ok"),
        F.count_if("_bad").alias("bad"),
        F.sum(F.when(F.col("_bad"), F.greatest(F.col("error_count"), F.lit(1))).otherwise(0)).alias("errors"),
    )
    done = "user_pages_completed" if mode == "ordinary" else "rounds_completed"
    out = per.groupBy("store_no").agg(F.sum("ok").alias("users_completed"), F.sum("bad").alias("users_failed"), F.sum("errors").alias("error_count"), (F.max(partition) + 1).cast("long").alias(done), F.count_if(F.col("bad") > 0).alias("remediation_count"))
    return out.withColumn("status", F.when(F.col("error_count") > 0, "partial").otherwise("succeeded"))


# ---- round mode


def rounds_needed(pages: DataFrame, page_slice: int) -> DataFrame:
    """Per user, from all pages of its resources: ``rounds`` that it takes part in, and whether it ``failed``.

    A round takes at most ``page_slice`` pages of every resource.  A user leaves with the round in which a page
    fails, or with the one that ends its longest resource.
    """
    k = max(1, page_slice)
    per = pages.groupBy("store_no", "user_key", "resource_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("failed"), F.col("seq"))).alias("stop"))
    out = per.groupBy("store_no", "user_key").agg(F.max(F.expr(f"(n + {k - 1}) div {k}")).alias("whole"), (F.min(F.expr(f"stop div {k}")) + 1).alias("until"))
    return out.select("store_no", "user_key", F.greatest(F.lit(1), F.least("whole", "until")).cast("long").alias("rounds"), (F.col("until").isNotNull() & (F.col("until") <= F.col("whole"))).alias("failed"))


def schedule(rows: DataFrame, window: int, part: str = "store_no", order: str = "ordinal", length: str = "rounds") -> DataFrame:
    """``rows`` with ``first_round`` and ``last_round``: each takes, in order, the first place that is free among ``window``.

    A fold by nature, as the lengths differ: a partition's rows go through one task in order, which holds a heap
    of ``window`` numbers.
    """
    import heapq

    import pandas as pd
    from pyspark.sql.types import LongType, StructField, StructType

    size, cols = max(1, window), rows.columns
    p, n = cols.index(part), cols.index(length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, []
        for pdf in batches:
            first, last = [], []
            for key, rounds in zip(pdf.iloc[:, p], pdf.iloc[:, n], strict=True):
                if key != now:
                    now, free = key, [0] * size
                at = heapq.heappop(free)
                heapq.heappush(free, at + int(rounds))
                first.append(at)
                last.append(at + int(rounds) - 1)
            yield pdf.assign(first_round=first, last_round=last)

    schema = StructType([*rows.schema.fields, StructField("first_round", LongType()), StructField("last_round", LongType())])
    return rows.repartition(part).sortWithinPartitions(part, order).mapInPandas(run, schema)


def throttled(starts: DataFrame, part: str = "store_no", order: str = "ordinal", length: str = "rounds") -> DataFrame:
    """Remediations with the step in which each begins: no more than ``REMEDIATIONS`` at once."""
    return schedule(starts, REMEDIATIONS, part, order, length)


def wait_order(handles: DataFrame, part: str, key: str) -> DataFrame:
    """``handles`` with ``place``: handles that end together are taken by id."""
    return ordered.numbered(handles, [part], [key], "place")


# ---- ends


def root_terminal(runs: DataFrame) -> DataFrame:
    """The status event of each run that a controller started: (operation_id, status, result_status, message).

    ``runs``: operation_id, controller, canceled, error (type name or null), result_status.
    """
    kind = F.when(F.col("canceled"), "canceled").when(F.col("error").isNotNull(), "failed").otherwise("completed")
    out = runs.where("controller is not null").withColumn("_k", kind)
    result = F.when(F.col("_k") == "completed", F.col("result_status")).otherwise(F.col("_k"))
    message = F.when(F.col("_k") == "canceled", "sync canceled").when(F.col("_k") == "failed", F.col("error"))
    return out.select("operation_id", F.col("_k").alias("status"), result.alias("result_status"), message.alias("message"))


def request_failures(requests: DataFrame, part: str = "store_no", key: str = "target_id") -> DataFrame:
    """Per partition: distinct targets that were asked, and how many of them couldn't be reached.

    A target is asked once, at its first mention.
    """
    first = requests.groupBy(part, key).agg(F.min_by("failed", "ordinal").alias("failed"))
    return first.groupBy(part).agg(F.count(F.lit(1)).alias("asked"), F.count_if("failed").alias("failures"))


def progress(rows: DataFrame, level: list[str]) -> DataFrame:
    """Snapshot of a level: phase, children completed, failed and pending, the furthest cursor."""
    out = rows.groupBy(*level).agg(F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "pending").alias("pending"), F.max_by("cursor", "ordinal").alias("cursor"))
    return out.withColumn("phase", F.when(F.col("pending") > 0, "running").otherwise("completed"))


def deactivation(stores: DataFrame) -> DataFrame:
    """How each store's deactivation ends: status, phase, generation, message, the last action done, whether the failure was marked.

    ``stores``: expected_generation, resume, fence_error, fence_ack, cancel_failures, quota_failures, outstanding,
    cleanup_status, cleanup_message, remove_status, remove_message, inactive_status, terminal_ack.  Without a
    fence nothing else happens; after it, what goes wrong on the way to a clean store is a failure, the rest
    are warnings, which make the result partial.
    """
    fenced = F.col("fence_error").isNull()
    count = lambda c, text: F.when(F.col(c) > 0, F.format_string(text, F.col(c).cast("long")))
    warnings = F.filter(
        F.array(
            F.when(~F.col("fence_ack"), F.lit(NO_FENCE_ACK)),
            count("cancel_failures", "%d owned cancellation request(s) failed"),
            count("quota_failures", "%d quota invalidation signal(s) failed"),
            count("outstanding", "drain timeout elapsed with %d operation(s) outstanding"),
        ),
        lambda x: x.isNotNull(),
    )
    stage = (
        F.when(F.col("cleanup_status") != "succeeded", F.struct(F.lit(4).alias("done"), F.coalesce(F.nullif("cleanup_message", F.lit("")), F.lit("user cleanup did not succeed")).alias("why")))
        .when(F.col("remove_status") != "succeeded", F.struct(F.lit(5).alias("done"), F.coalesce(F.nullif("remove_message", F.lit("")), F.lit("object removal did not succeed")).alias("why")))
        .when(F.col("inactive_status") != "succeeded", F.struct(F.lit(6).alias("done"), F.lit("marking the store inactive failed").alias("why")))
    )
    j = stores.withColumn("_w", warnings).withColumn("_x", stage)
    late = F.when(~F.col("terminal_ack"), F.array(F.lit(NO_TERMINAL_ACK))).otherwise(F.array().cast("array<string>"))
    every = F.concat("_w", late)
    unfenced = F.coalesce(F.nullif(F.substring("fence_error", 1, 500), F.lit("")), F.lit("deactivation fence did not commit"))
    unfenced = F.when(F.col("terminal_ack"), unfenced).otherwise(F.substring(F.concat(unfenced, F.lit("; " + NO_TERMINAL_ACK)), 1, 1000))
    failed = F.col("_x").isNotNull()
    message = F.when(~fenced, unfenced).when(failed, F.substring("_x.why", 1, 500)).when(F.size(every) > 0, warning_text(every))
    status = F.when(~fenced | failed, "failed").when(F.size(every) > 0, "partial").otherwise("succeeded")
    actions = F.array(*map(F.lit, ACTIONS))
    last = F.when(~fenced, F.lit(None)).when(failed, F.get(actions, F.col("_x.done"))).otherwise(F.lit(ACTIONS[-1]))
    generation = F.col("expected_generation") + F.when(fenced & ~F.col("resume"), 1).otherwise(0)
    return j.select("store_no", status.alias("status"), F.when(~fenced | failed, "failed").otherwise("completed").alias("phase"), generation.cast("long").alias("lifecycle_generation"), message.alias("message"), last.alias("last_action"), (fenced & failed).alias("marked_failed"))


def cleanup_batches(keys_: DataFrame, concurrency: int) -> DataFrame:
    """Users to clean, each once at its first mention, in batches that wait for each other; a store without any takes all its users in one."""
    first = keys_.groupBy("store_no", "user_key").agg(F.min("ordinal").alias("ordinal"))
    return ordered.numbered(first, ["store_no"], ["ordinal", "user_key"], "_n").withColumn("batch", F.expr(f"_n div {max(1, concurrency)}")).drop("_n")


def cleanup_tree(active: DataFrame, targets: DataFrame, commands: DataFrame, stores: DataFrame, concurrency: int) -> DataFrame:
    """Per store: users whose cleanup took something, batches run, status and message of the first failure in order.

    ``targets`` (store_no, ordinal, user_key, expected_generation) are taken each once, at the first mention, in
    batches that wait for each other; every one is fenced as of its own place among the lifecycle ``commands``.
    The first batch with a failure is finished and is the last.
    """
    first = targets.groupBy("store_no", "user_key").agg(F.min(F.struct("ordinal", "expected_generation")).alias("_f")).select("store_no", "user_key", "_f.*")
    told = authority.fenced_as_of(cleanup_batches(first, concurrency).drop("ordinal").join(first, ["store_no", "user_key"]), commands, stores, ("deactivating",))
    had = active.select("store_no", "user_key").distinct().withColumn("_had", F.lit(1))
    j = told.join(had, ["store_no", "user_key"], "left")
    fine = F.col("status") == "succeeded"
    per = j.groupBy("store_no", "batch").agg(F.count_if(fine & F.col("_had").isNotNull()).alias("affected"), F.min(F.when(~fine, F.struct("ordinal", "user_key", "status", "message"))).alias("_bad"))
    return cleanup_rollup(per.select("store_no", "batch", "affected", F.coalesce("_bad.status", F.lit("succeeded")).alias("status"), F.col("_bad.message").alias("message")))


# ---- activation in two waves


def activation(pages: DataFrame, fences: DataFrame, recent_cap: int, window: int) -> DataFrame:
    """Per user: stage, pages and errors of both waves, and the cursors that the recent one leaves, ``resource=cursor`` by ``|``.

    ``pages``: store, user, resource, seq, cursor, next_cursor, failed, errors; ``fences``: store_no, status.  The
    recent wave takes ``max(1, recent_cap)`` pages of each resource.  If it is clean and the fence holds, the
    backfill goes on with each unfinished resource at the page of its own cursor, to the end.
    """
    recent = resource_result(page_pipeline(pages, window, max(1, recent_cap)))
    user = ["store_no", "user_key"]
    left = F.when(~F.col("finished"), F.struct("resource_key", "next_cursor"))
    # a user's resources are few
    waves = recent.groupBy(*user).agg(F.sum("pages_completed").alias("recent_pages"), F.sum("error_count").alias("recent_errors"), F.array_sort(F.collect_list(left)).alias("_left"))
    waves = waves.join(fences.select("store_no", F.col("status").alias("_fence")), "store_no", "left").withColumn("_fence", F.coalesce("_fence", F.lit("failed")))
    on = waves.where("recent_errors = 0 and _fence = 'succeeded'").select(*user)
    go = recent.where("not finished").join(on, user, "left_semi").select(*RESOURCE, F.col("next_cursor").alias("cursor"))
    begin = pages.join(go, [*RESOURCE, "cursor"]).select(*RESOURCE, F.col("seq").alias("_begin"))
    rest = pages.join(begin, RESOURCE).where(F.col("seq") >= F.col("_begin")).withColumn("seq", F.col("seq") - F.col("_begin")).drop("_begin")
    later = resource_result(page_pipeline(rest, window)).groupBy(*user).agg(F.sum("pages_completed").alias("backfill_pages"), F.sum("error_count").alias("backfill_errors"))
    out = waves.join(later, user, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("backfill_pages", "backfill_errors")})
    stage = activation_stage(F.col("recent_errors") == 0, F.col("_fence"), F.col("backfill_errors") == 0)
    cursors = F.array_join(F.transform("_left", lambda x: F.concat(x["resource_key"], F.lit("="), x["next_cursor"])), "|")
    return out.select(*user, stage.alias("stage"), F.col("recent_pages").cast("long").alias("recent_pages"), "backfill_pages", (F.col("recent_errors") + F.col("backfill_errors")).cast("long").alias("error_count"), cursors.alias("cursors"))


def remediation_result(attempts: DataFrame) -> DataFrame:
    """Per store: users completed, errors, a sample of the first ``SAMPLE`` errors in the users' order, status; ``users_failed`` repeats the count of errors.

    ``attempts``: store_no, ordinal, status, errors (array), exception.  An attempt that ends in an exception has
    that one error, one that didn't succeed without saying why has its status.  Only errors within the sample are gathered.
    """
    empty = F.array().cast("array<string>")
    told = F.coalesce("errors", empty)
    errors = F.when(F.col("exception").isNotNull(), F.array("exception")).when((F.col("status") != "succeeded") & (F.size(told) == 0), F.array("status")).otherwise(told)
    j = attempts.select("store_no", "ordinal", errors.alias("e"))
    j = ordered.running(j, ["store_no"], ["ordinal"], before=F.size("e").cast("long"))
    named = F.when((F.col("before") < SAMPLE) & (F.size("e") > 0), F.struct("ordinal", F.slice("e", F.lit(1), F.greatest(F.lit(1), SAMPLE - F.col("before")).cast("int")).alias("e")))
    out = j.groupBy("store_no").agg(F.count_if(F.size("e") == 0).alias("users_completed"), F.sum(F.size("e").cast("long")).alias("error_count"), F.array_sort(F.collect_list(named)).alias("_s"))
    sample = F.flatten(F.transform("_s", lambda x: x["e"]))
    return out.select("store_no", "users_completed", "error_count", F.col("error_count").alias("users_failed"), sample.alias("errors"), F.when(F.col("error_count") > 0, "partial").otherwise("succeeded").alias("status"))


# ---- pages and documents


def page_tasks(pages: DataFrame) -> DataFrame:
    """The document mutations of each page in the order in which they are started: its upserts, then its deletions.

    ``pages``: page columns, documents (array of document_key, source_version, staging_uri, content_hash) and
    deleted_document_keys.  A deletion's version is ``deleted:{page_key}``; it has no place and no hash.
    """
    rest = [c for c in pages.columns if c not in ("documents", "deleted_document_keys")]
    ref = lambda x, mutation: F.struct(x["document_key"].alias("document_key"), x["source_version"].alias("source_version"), x["staging_uri"].alias("staging_uri"), x["content_hash"].alias("content_hash"), F.lit(mutation).alias("mutation"))
    gone = F.transform(F.coalesce("deleted_document_keys", F.array().cast("array<string>")), lambda k: F.struct(k.alias("document_key"), F.concat(F.lit("deleted:"), F.col("page_key")).alias("source_version"), F.lit("").alias("staging_uri"), F.lit("").alias("content_hash")))
    both = F.concat(F.transform("documents", lambda x: ref(x, "upsert")), F.transform(gone, lambda x: ref(x, "delete")))
    return pages.select(*rest, F.posexplode(both).alias("task_no", "_t")).select(*rest, F.col("task_no").cast("long").alias("task_no"), "_t.*")


def page_result(results: DataFrame, page: list[str]) -> DataFrame:
    """Per page: changed and deleted documents (as sent), all errors in the order of its tasks, status.

    ``results``: page columns, task_no, mutation, status, message.  A stale generation is no error; an error
    without a message is ``document rejected``.  A page has as many tasks as its provider's page size allows.
    """
    bad = ~F.col("status").isin("succeeded", "stale_generation")
    said = F.when(bad, F.struct("task_no", F.coalesce("message", F.lit("document rejected")).alias("m")))
    out = results.groupBy(*page).agg(F.count_if(F.col("mutation") == "upsert").alias("changed_documents"), F.count_if(F.col("mutation") == "delete").alias("deleted_documents"), F.transform(F.array_sort(F.collect_list(said)), lambda x: x["m"]).alias("errors"))
    return out.withColumn("status", F.when(F.size("errors") > 0, "partial").otherwise("succeeded"))


def expected_drains(syncs: DataFrame, remediations: DataFrame, drained: DataFrame) -> DataFrame:
    """Per store: operations that a drain waits for, the running sync and all remediations, each once, and how many haven't ended.

    All three: store_no, operation_id.
    """
    key = ["store_no", "operation_id"]
    every = syncs.select(*key).unionByName(remediations.select(*key)).where("operation_id is not null").distinct()
    left = every.join(drained.select(*key).distinct().withColumn("_gone", F.lit(1)), key, "left")
    return left.groupBy("store_no").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("_gone").isNull()).alias("outstanding"))


# ---- reports


def level_progress(documents: DataFrame, levels: list[str]) -> DataFrame:
    """Snapshots of all levels at once: (level, one column for each level's key, completed, failed, pending, phase).

    ``documents``: the columns ``levels``, from the outermost, and state.  A level's children are those of the next
    one, the last one's are documents; a child is pending while one of its own is, then failed if one is.
    """
    state = F.when(F.count_if(F.col("state") == "pending") > 0, "pending").when(F.count_if(F.col("state") == "failed") > 0, "failed").otherwise("completed")
    rows, out = documents.select(*levels, "state"), None
    for k in range(len(levels), 0, -1):
        one = progress_counts(rows, levels[:k]).withColumn("level", F.lit(levels[k - 1]))
        one = one.select("level", *levels[:k], *(F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in levels[k:]), "completed", "failed", "pending", "phase")
        out = one if out is None else out.unionByName(one)
        rows = rows.groupBy(*levels[:k]).agg(state.alias("state"))
    return out


def progress_counts(rows: DataFrame, level: list[str]) -> DataFrame:
    """Children completed, failed and pending, and the phase, of each of ``level``."""
    out = rows.groupBy(*level).agg(F.count_if(F.col("state") == "completed").alias("completed"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "pending").alias("pending"))
    return out.withColumn("phase", F.when(F.col("pending") > 0, "running").otherwise("completed"))


def provider_calls(calls: DataFrame) -> DataFrame:
    """One count per call by provider, quota class, operation and outcome."""
    return calls.groupBy("provider", "quota_class", "operation", "outcome").agg(F.count(F.lit(1)).alias("calls"))


def observations_of(calls: DataFrame) -> DataFrame:
    """What provider calls tell of their quota: exhausted calls with a scope are empty pages that report limit, balance (0 unless told), reset and retry; without a scope, and with bad credentials, they fail for good."""
    kind = F.col("kind")
    status = F.when(kind == "success", "page").when((kind == "quota_exhausted") & F.col("scope").isNotNull(), "exhausted").otherwise("failed")
    out = calls.withColumn("status", status)
    told = F.col("status") == "exhausted"
    return out.select("request_id", "scope", "status", told.alias("quota_exhausted"), F.when(told, F.col("limit")).alias("limit"), F.when(told, F.coalesce("remaining", F.lit(0))).alias("remaining"), F.when(told, F.col("reset_us")).alias("reset_us"), F.when(told, F.col("retry_after_seconds")).alias("retry_after_seconds"), told.alias("exhausted"))


def report(rows: DataFrame, part: list[str]) -> DataFrame:
    """Each row's other columns as one JSON document, in the order of their names."""
    rest = sorted(c for c in rows.columns if c not in part)
    return rows.select(*part, F.to_json(F.struct(*rest)).alias("report"))
