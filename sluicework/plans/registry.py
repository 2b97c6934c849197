"""All queries of the engine and the SQL that each must equal.

Each entry is a function over the carriers and its SQL; counts are bigint on both sides, doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys, policy
from ..operators import analytics, controller, fence, quota, rollup
from ..session import ship
from . import carriers as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(ship(spark), sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- fenced mutation


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    s = C.stores(spark, d)
    m = C.mutations(spark, d).join(s.select("store_no", "lifecycle_generation"), "store_no").withColumn("expected_generation", F.col("lifecycle_generation") - F.col("behind")).drop("lifecycle_generation")
    return fence.ingest_status(m, s)


INGESTED = f"""{C.STORES}, {C.MUTATIONS},
ingested AS (SELECT m.*, s.lifecycle_generation, s.lifecycle_state, CASE
  WHEN mutation = 'upsert' AND body IS NULL THEN 'failed'
  WHEN mutation = 'upsert' AND sha256(body) <> content_hash THEN 'rejected'
  WHEN behind <> 0 THEN 'stale_generation'
  WHEN lifecycle_state NOT IN ('active', 'syncing') THEN 'rejected' ELSE 'succeeded' END AS status
  FROM mutations m JOIN stores s USING (store_no))"""


@query(f"WITH {INGESTED} SELECT store_no, mutation, status, count(*) AS n FROM ingested GROUP BY ALL")
def ingest_status(spark: SparkSession, d: str) -> DataFrame:
    """Which staged document mutations commit, and why the others are refused."""
    return _ingested(spark, d).groupBy("store_no", "mutation", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {INGESTED}, w AS (SELECT *, row_number() OVER (PARTITION BY store_no, document_key
  ORDER BY ordinal DESC, mutation = 'delete' DESC) AS r FROM ingested WHERE status = 'succeeded')
  SELECT store_no, document_key, source_version, ordinal FROM w WHERE r = 1 AND mutation = 'upsert'""")
def document_state(spark: SparkSession, d: str) -> DataFrame:
    """The document table after all mutations."""
    return fence.last_writes(_ingested(spark, d))


@query(f"WITH {INGESTED} SELECT mutation, status, count(*) AS results, count(*) FILTER (status = 'stale_generation') AS stale FROM ingested GROUP BY ALL")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters per mutation and status."""
    return fence.result_counters(fence.mutation_results(_ingested(spark, d)))


@query(f"""WITH {C.STORES}, f AS (SELECT c_custkey AS fence_id, c_nationkey + (CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END) AS store_no,
  c_custkey % 4 AS expected_generation, c_custkey % 2 = 0 AS wide FROM customer)
  SELECT fence_id, CASE WHEN s.store_no IS NULL THEN 'failed' WHEN lifecycle_generation <> expected_generation THEN 'stale_generation'
  WHEN lifecycle_state NOT IN ('active', 'syncing') AND NOT (wide AND lifecycle_state = 'deactivating') THEN 'rejected' ELSE 'succeeded' END AS status
  FROM f LEFT JOIN stores s ON s.store_no = f.store_no""")
def fence_validate(spark: SparkSession, d: str) -> DataFrame:
    """Fences with their own allowed states: generation first, then state."""
    c = C.table(spark, d, "customer")
    k = F.col("c_custkey")
    wide = F.array(F.lit("active"), F.lit("syncing"), F.lit("deactivating"))
    fences = c.select(k.alias("fence_id"), (F.col("c_nationkey") + F.when(k % 50 == 0, 100).otherwise(0)).cast("long").alias("store_no"), (k % 4).alias("expected_generation"), F.when(k % 2 == 0, wide).otherwise(F.slice(wide, 1, 2)).alias("allowed_states"))
    return fence.validate_fence(fences, C.stores(spark, d)).select("fence_id", "status")


@query(f"""WITH {C.STORES}, c AS (SELECT s.*, k.kind, lifecycle_generation - k.behind AS expected FROM stores s,
  (VALUES ('begin', 0), ('begin', 1), ('resume', 0), ('mark_inactive', 0), ('mark_failed', 1), ('mark_failed', 0)) k(kind, behind)),
  o AS (SELECT *, CASE kind
  WHEN 'begin' THEN CASE WHEN lifecycle_generation = expected + 1 AND lifecycle_state IN ('deactivating', 'inactive', 'deactivation_failed') THEN 'unchanged'
    WHEN lifecycle_generation <> expected THEN 'stale_generation' WHEN lifecycle_state NOT IN ('active', 'syncing') THEN 'rejected' ELSE 'applied' END
  WHEN 'resume' THEN CASE WHEN lifecycle_generation <> expected THEN 'stale_generation' WHEN lifecycle_generation <= 0 THEN 'rejected'
    WHEN lifecycle_state = 'deactivation_failed' THEN 'applied' WHEN lifecycle_state = 'deactivating' THEN 'unchanged' ELSE 'rejected' END
  ELSE CASE WHEN lifecycle_generation <> expected THEN 'stale_generation'
    WHEN lifecycle_state = CASE kind WHEN 'mark_inactive' THEN 'inactive' ELSE 'deactivation_failed' END THEN 'unchanged'
    WHEN lifecycle_state = 'deactivating' THEN 'applied' ELSE 'rejected' END END AS outcome FROM c)
  SELECT store_no, kind, expected, outcome, CASE WHEN outcome <> 'applied' THEN lifecycle_state WHEN kind IN ('begin', 'resume') THEN 'deactivating'
  WHEN kind = 'mark_inactive' THEN 'inactive' ELSE 'deactivation_failed' END AS new_state,
  CASE WHEN outcome = 'applied' AND kind = 'begin' THEN lifecycle_generation + 1 ELSE lifecycle_generation END AS new_generation FROM o""")
def lifecycle_transition(spark: SparkSession, d: str) -> DataFrame:
    """Begin, resume, mark inactive and mark failed, for every store."""
    trial = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(b).cast("long").alias("behind")) for k, b in (("begin", 0), ("begin", 1), ("resume", 0), ("mark_inactive", 0), ("mark_failed", 1), ("mark_failed", 0)))))
    s = C.stores(spark, d).withColumn("t", trial)
    out = fence.transitions(s, F.col("t.kind"), F.col("lifecycle_generation") - F.col("t.behind"))
    return out.select("store_no", "kind", "expected", "outcome", "new_state", "new_generation")


@query(f"""WITH {INGESTED}, {C.USERS}, w AS (SELECT *, row_number() OVER (PARTITION BY store_no, document_key ORDER BY ordinal DESC) AS r
  FROM ingested WHERE mutation = 'upsert'), docs AS (SELECT * FROM w WHERE r = 1)
  SELECT s.store_no, (SELECT count(*) FROM docs x WHERE x.store_no = s.store_no AND s.store_no % 10 <> 7) AS documents_removed,
  (SELECT count(*) FROM users u WHERE u.store_no = s.store_no AND s.store_no % 10 <> 7 AND valid AND (s.store_no % 2 = 0 OR ordinal % 3 = 0)) AS users_removed
  FROM stores s WHERE lifecycle_state = 'deactivating'""")
def deactivate_purge(spark: SparkSession, d: str) -> DataFrame:
    """Purge of the stores' deactivating generation: even stores lose all users, odd ones every third."""
    s = C.stores(spark, d)
    docs = C.mutations(spark, d).where("mutation = 'upsert'").select("store_no", "document_key").distinct()
    active = C.users(spark, d).where("valid").select("store_no", "user_key", "ordinal")
    # the commands of every tenth store name the generation before
    expected = s.select("store_no", (F.col("lifecycle_generation") - F.when(F.col("store_no") % 10 == 7, 1).otherwise(0)).alias("expected_generation"))
    targets = s.where("store_no % 2 = 0").select("store_no", F.lit(None).cast("string").alias("user_key")).unionByName(active.where("store_no % 2 = 1 and ordinal % 3 = 0").select("store_no", "user_key")).join(expected, "store_no")
    gone = fence.remove_objects(docs, expected, s)[1].withColumnRenamed("affected", "documents_removed")
    users = fence.deactivate_users(active.select("store_no", "user_key"), targets, s)[1].withColumnRenamed("affected", "users_removed")
    out = s.where("lifecycle_state = 'deactivating'").select("store_no").join(gone, "store_no", "left").join(users, "store_no", "left")
    return out.select("store_no", F.coalesce("documents_removed", F.lit(0)).cast("long").alias("documents_removed"), F.coalesce("users_removed", F.lit(0)).cast("long").alias("users_removed"))


@query(f"WITH {C.STORES}, {C.USERS} SELECT u.store_no, count(*) AS active_users FROM users u JOIN stores s USING (store_no) WHERE ordinal % 5 = 0 OR (lifecycle_state IN ('active', 'syncing') AND ordinal % 4 = lifecycle_generation) GROUP BY u.store_no")
def user_activation(spark: SparkSession, d: str) -> DataFrame:
    """Active users after fenced activations."""
    u = C.users(spark, d)
    active = u.where("ordinal % 5 = 0")
    asked = u.select("store_no", "user_key", (F.col("ordinal") % 4).alias("expected_generation"))
    return fence.activate_users(active, asked, C.stores(spark, d)).groupBy("store_no").agg(F.count(F.lit(1)).alias("active_users"))


# ---- paging and roll-ups


@query(f"WITH {C.USERS}, p AS (SELECT *, row_number() OVER (PARTITION BY store_no ORDER BY ordinal) - 1 AS n FROM users WHERE valid) SELECT store_no, user_key, n // 10 AS page_no, n % 10 AS page_ordinal FROM p")
def user_pages(spark: SparkSession, d: str) -> DataFrame:
    """Valid users in pages of ten."""
    return rollup.paged(C.users(spark, d).where("valid"), ["store_no"], ["ordinal"], C.PAGE_SIZE).select("store_no", "user_key", "page_no", "page_ordinal")


@query(f"WITH {C.PAGES} SELECT store_no, user_key, resource_key, count(*) AS pages, sum(n_upserts)::BIGINT AS upserts, sum(n_deletes)::BIGINT AS deletes FROM pages WHERE seq < 5 GROUP BY ALL")
def resource_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first five pages of each user, by resource."""
    p = C.pages(spark, d).where("seq < 5")
    return p.groupBy("store_no", "user_key", "resource_key").agg(F.count(F.lit(1)).alias("pages"), F.sum("n_upserts").alias("upserts"), F.sum("n_deletes").alias("deletes"))


@query(f"WITH {C.PAGES} SELECT store_no, user_key, (seq // 3) AS round, count(*) AS pages FROM pages GROUP BY ALL")
def round_slices(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each user in rounds of three."""
    return C.pages(spark, d).groupBy("store_no", "user_key", F.expr("seq div 3").alias("round")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT 'page-' || (doc_id // 250) AS page_key, 'doc-' || doc_id AS document_key, 'deleted:page-' || (doc_id // 250) AS source_version, '' AS staging_uri, '' AS content_hash FROM documents")
def deletion_rows(spark: SparkSession, d: str) -> DataFrame:
    """Deleted keys of each page as document references; a page without any has no rows."""
    m = C.table(spark, d, "documents")
    pages = m.groupBy(F.expr("concat('page-', doc_id div 250)").alias("page_key")).agg(F.collect_list(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("deleted_document_keys"))
    none = C.table(spark, d, "region").select(F.concat(F.lit("empty-"), "r_name").alias("page_key"), F.array().cast("array<string>").alias("deleted_document_keys"))
    return rollup.deletion_refs(pages.unionByName(none))


@query(f"""WITH {INGESTED}, e AS (SELECT *, status NOT IN ('succeeded', 'stale_generation') AS bad FROM ingested)
  SELECT store_no, user_key, resource_key, page_no, count(*) FILTER (mutation = 'upsert') AS changed_documents,
  count(*) FILTER (mutation = 'delete') AS deleted_documents, count(*) FILTER (bad) AS error_count,
  CASE WHEN count(*) FILTER (bad) > 0 THEN 'partial' ELSE 'succeeded' END AS status,
  'document-' || arg_min(ordinal || ':' || status, (CASE WHEN mutation = 'delete' THEN 1 ELSE 0 END)::HUGEINT * 1000000000000 + ordinal) FILTER (bad) AS first_error
  FROM e GROUP BY store_no, user_key, resource_key, page_no""")
def page_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Documents to pages."""
    return rollup.page_rollup(_ingested(spark, d))


RESOURCES = f"""{C.PAGES}, resources AS (SELECT store_no, user_key, resource_key, count(*) FILTER (NOT failed) AS pages_completed,
  count(*) FILTER (failed) AS error_count, arg_min_null(cursor, seq) FILTER (failed) AS next_cursor,
  count(*) FILTER (failed) = 0 AS finished, CASE WHEN count(*) FILTER (failed) > 0 THEN 'partial' ELSE 'succeeded' END AS status
  FROM pages GROUP BY ALL)"""
USERS_UP = f"""{RESOURCES}, ups AS (SELECT store_no, user_key, sum(pages_completed)::BIGINT AS pages_completed, sum(error_count)::BIGINT AS error_count,
  count(*) FILTER (finished) AS resources_completed, arg_min(next_cursor, resource_key) FILTER (next_cursor IS NOT NULL) AS next_cursor,
  bool_and(finished) AND count(*) FILTER (finished) = 2 AS finished,
  CASE WHEN sum(error_count) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM resources GROUP BY ALL)"""


@query(f"WITH {RESOURCES} SELECT * FROM resources")
def resource_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """Pages to resources, with the cursor of the earliest failure."""
    return rollup.resource_rollup(C.pages(spark, d))


def _users_up(spark: SparkSession, d: str) -> DataFrame:
    return rollup.user_rollup(rollup.resource_rollup(C.pages(spark, d)), 2)


@query(f"WITH {USERS_UP} SELECT * FROM ups")
def user_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Resources to users."""
    return _users_up(spark, d)


_STORE_SQL = """SELECT store_no, count(*) FILTER (NOT bad) AS users_completed, count(*) FILTER (bad) AS users_failed,
  sum(CASE WHEN bad THEN greatest(error_count, 1) ELSE 0 END)::BIGINT AS error_count, sum(pages_completed)::BIGINT AS pages_completed,
  CASE WHEN sum(CASE WHEN bad THEN 1 ELSE 0 END) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM b GROUP BY store_no"""


@query(f"WITH {USERS_UP}, b AS (SELECT *, status <> 'succeeded' OR error_count > 0 OR NOT finished AS bad FROM ups) {_STORE_SQL}")
def store_rollup_ordinary(spark: SparkSession, d: str) -> DataFrame:
    """Users to stores; unfinished users count as failed."""
    return rollup.store_rollup(_users_up(spark, d))


@query(f"WITH {USERS_UP}, b AS (SELECT *, status <> 'succeeded' OR error_count > 0 AS bad FROM ups) {_STORE_SQL}")
def store_rollup_round(spark: SparkSession, d: str) -> DataFrame:
    """Users to stores in round mode; unfinished users carry on."""
    return rollup.store_rollup(_users_up(spark, d), ordinary=False)


@query(f"WITH {C.USERS}, p AS (SELECT *, row_number() OVER (PARTITION BY store_no ORDER BY ordinal) - 1 AS n FROM users WHERE valid) SELECT store_no, user_key, (n // 8) * 3 AS first_round, (n // 8) * 3 + 2 AS last_round, 12::BIGINT AS pages_reported FROM p")
def store_rollup_round_uniform(spark: SparkSession, d: str) -> DataFrame:
    """Round schedule of users of ten pages each: eight at a time, slices of four."""
    return rollup.uniform_rounds(C.users(spark, d).where("valid"), 8, 10, 4).select("store_no", "user_key", "first_round", "last_round", "pages_reported")


@query("""WITH c AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  f AS (SELECT user_id, event_type, min(r) AS r FROM c WHERE r <= 8 GROUP BY ALL)
  SELECT user_id, string_agg(event_type, '|' ORDER BY r) AS sample FROM f GROUP BY user_id""")
def bounded_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first eight event types of each user without repeats."""
    return rollup.bounded_sample(C.table(spark, d, "events"), ["user_id"], "event_type", ["event_id"], 8)


@query(f"""WITH {USERS_UP}, b AS (SELECT *, row_number() OVER (PARTITION BY store_no ORDER BY user_key) - 1 AS n FROM ups
  WHERE status <> 'succeeded' OR error_count > 0 OR NOT finished) SELECT store_no, user_key, n // 3 AS batch, n % 3 AS batch_ordinal FROM b""")
def remediation_batches(spark: SparkSession, d: str) -> DataFrame:
    """Failed users in batches of three."""
    return rollup.remediation_batches(_users_up(spark, d), 3).select("store_no", "user_key", "batch", "batch_ordinal")


@query(f"WITH {USERS_UP} SELECT store_no, count(*) FILTER (status = 'succeeded' AND error_count = 0) AS users_completed, sum(error_count)::BIGINT AS error_count, sum(error_count)::BIGINT AS users_failed FROM ups GROUP BY store_no")
def remediation_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of remediations per store."""
    return rollup.remediation_rollup(_users_up(spark, d))


@query(f"""WITH {C.PAGES}, {C.STORES}, w AS (SELECT store_no, user_key, bool_or(failed AND seq < 4) AS recent_bad, bool_or(failed AND seq >= 4) AS back_bad FROM pages GROUP BY ALL)
  SELECT store_no, user_key, CASE WHEN recent_bad THEN 'recent_failed' WHEN lifecycle_state NOT IN ('active', 'syncing') THEN 'rejected'
  WHEN back_bad THEN 'backfill_failed' ELSE 'activated' END AS stage FROM w JOIN stores USING (store_no)""")
def activation_stages(spark: SparkSession, d: str) -> DataFrame:
    """Recent wave of four pages, fence, backfill, activation."""
    w = C.pages(spark, d).groupBy("store_no", "user_key").agg(F.bool_or(F.col("failed") & (F.col("seq") < 4)).alias("r"), F.bool_or(F.col("failed") & (F.col("seq") >= 4)).alias("b"))
    s = C.stores(spark, d)
    j = w.join(s.select("store_no", "lifecycle_state"), "store_no")
    status = F.when(F.col("lifecycle_state").isin(*fence.WRITABLE), "succeeded").otherwise("rejected")
    return j.select("store_no", "user_key", rollup.activation_stage(~F.col("r"), status, ~F.col("b")).alias("stage"))


@query("""SELECT c_custkey AS user_no, CASE c_custkey % 3 WHEN 0 THEN 'files,files' WHEN 1 THEN 'comments' ELSE 'files,files,comments' END AS remaining FROM customer""")
def remaining_resources(spark: SparkSession, d: str) -> DataFrame:
    """Requested resources that aren't completed, repeats kept."""
    c = C.table(spark, d, "customer")
    requested = F.array(*map(F.lit, ("files", "files", "comments")))
    done = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("comments"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("files"))).otherwise(F.array().cast("array<string>"))
    out = rollup.remaining_resources(c.select(F.col("c_custkey").alias("user_no"), requested.alias("requested"), done.alias("completed")))
    return out.select("user_no", F.array_join("remaining", ",").alias("remaining"))


@query("SELECT c_custkey AS user_no, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'own' ELSE 'user' END AS cursor FROM customer")
def resource_cursors(spark: SparkSession, d: str) -> DataFrame:
    """A resource's own cursor, null included, before the user's."""
    c = C.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.expr("map('files', cast(null as string))")).when(F.col("c_custkey") % 3 == 1, F.expr("map('files', 'own')")).otherwise(F.expr("map('comments', 'x')")).alias("m"))
    return c.select(F.col("c_custkey").alias("user_no"), rollup.cursor_for("m", F.lit("files"), F.lit("user")).alias("cursor"))


_BATCHES = """b AS (SELECT l_suppkey % 25 AS store_no, l_orderkey % 40 AS batch, count(*) AS affected,
  CASE WHEN (l_suppkey % 25 + l_orderkey % 40) % 17 = 16 THEN 'failed' ELSE 'succeeded' END AS status FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {_BATCHES}, r AS (SELECT *, coalesce(sum((status <> 'succeeded')::INT) OVER (PARTITION BY store_no ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
  SELECT store_no, sum(affected)::BIGINT AS affected, count(*) AS batches_run, CASE WHEN count(*) FILTER (status <> 'succeeded') > 0 THEN 'failed' ELSE 'succeeded' END AS status,
  min('batch ' || batch) FILTER (status <> 'succeeded') AS message FROM r WHERE before = 0 GROUP BY store_no""")
def cleanup_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Batches of a cleanup up to the first that fails."""
    li = C.table(spark, d, "lineitem")
    b = li.groupBy((F.col("l_suppkey") % 25).alias("store_no"), (F.col("l_orderkey") % 40).alias("batch")).agg(F.count(F.lit(1)).alias("affected"))
    bad = (F.col("store_no") + F.col("batch")) % 17 == 16
    b = b.withColumn("status", F.when(bad, "failed").otherwise("succeeded")).withColumn("message", F.when(bad, F.concat(F.lit("batch "), F.col("batch").cast("string"))))
    return rollup.cleanup_rollup(b)


@query("SELECT o_custkey % 25 AS store_no, count(*) AS outstanding FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def drain_outstanding(spark: SparkSession, d: str) -> DataFrame:
    """Operations that haven't drained."""
    o = C.table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("store_no"), "o_orderkey", "o_orderstatus")
    left = rollup.outstanding(o.select("store_no", "o_orderkey"), o.where("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"])
    return left.groupBy("store_no").agg(F.count(F.lit(1)).alias("outstanding"))


@query("""WITH a AS (SELECT c_nationkey::BIGINT AS store_no, c_custkey AS ordinal, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) + (CASE WHEN c_custkey % 31 = 0 THEN 1 ELSE 0 END) AS action_index FROM customer),
  p AS (SELECT *, lag(action_index) OVER (PARTITION BY store_no ORDER BY ordinal) AS b FROM a) SELECT store_no, ordinal, action_index FROM p WHERE action_index <> coalesce(b + 1, 0)""")
def order_guard(spark: SparkSession, d: str) -> DataFrame:
    """Actions that are out of the plan's order."""
    c = C.table(spark, d, "customer")
    n = F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long") - 1
    a = c.select(F.col("c_nationkey").cast("long").alias("store_no"), F.col("c_custkey").alias("ordinal"), (n + F.when(F.col("c_custkey") % 31 == 0, 1).otherwise(0)).alias("action_index"))
    return rollup.order_violations(a)


# ---- quota


_DENIED = """e AS (SELECT *, CASE WHEN request_id = '' THEN 'request_id must not be empty' WHEN cost <= 0 THEN 'permit cost must be positive'
  WHEN other_scope THEN 'quota scope does not match coordinator' WHEN requester = '' THEN 'requester workflow ID is required'
  WHEN disabled THEN 'quota scope is disabled' END AS early FROM requests),
 a AS (SELECT *, coalesce(sum((early IS NULL)::INT) OVER (PARTITION BY scope ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM e),
 denied AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN ahead >= 30 THEN 'quota pending queue is at capacity' END AS denial FROM a)"""


@query(f"WITH {C.QUOTA}, {_DENIED} SELECT scope, denial, count(*) AS n, bool_or(denial = 'quota pending queue is at capacity') AS retryable FROM denied WHERE denial IS NOT NULL GROUP BY ALL")
def quota_denials(spark: SparkSession, d: str) -> DataFrame:
    """Requests of one instant that can't be queued, by reason; only a full queue is worth a retry."""
    r = quota.denial(C.quota_requests(spark, d), 30).where("denial is not null")
    return r.groupBy("scope", "denial").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("denial") == quota.FULL).alias("retryable"))


@query(f"""WITH {C.QUOTA}, {_DENIED}, q AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ordinal) AS queue_rank, sum(cost) OVER (PARTITION BY scope ORDER BY ordinal) AS running_cost FROM denied WHERE denial IS NULL)
  SELECT scope, request_id, ordinal, cost, queue_rank, running_cost::BIGINT AS running_cost FROM q WHERE queue_rank <= free_slots AND (remaining IS NULL OR running_cost <= remaining)""")
def quota_grants(spark: SparkSession, d: str) -> DataFrame:
    """The prefix of each queue that slots and balance allow."""
    r = quota.denial(C.quota_requests(spark, d), 30).where("denial is null")
    return quota.grants(r).select("scope", "request_id", "ordinal", "cost", "queue_rank", "running_cost")


@query(f"""WITH {C.QUOTA}, {_DENIED}, q AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ordinal) AS queue_rank, sum(cost) OVER (PARTITION BY scope ORDER BY ordinal) AS running_cost FROM denied WHERE denial IS NULL),
  g AS (SELECT *, queue_rank <= free_slots AND (remaining IS NULL OR running_cost <= remaining) AS granted FROM q)
  SELECT scope, count(*) FILTER (NOT granted) AS pending, count(*) FILTER (granted) AS in_flight,
  (max(remaining) - coalesce(sum(cost) FILTER (granted), 0))::BIGINT AS remaining FROM g GROUP BY scope""")
def quota_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Queue, permits and balance of each scope after the grants."""
    r = quota.denial(C.quota_requests(spark, d), 30).where("denial is null")
    g = quota.grants(r).select("scope", "ordinal", F.lit(True).alias("granted"))
    j = r.join(g, ["scope", "ordinal"], "left")
    spent = F.coalesce(F.sum(F.when(F.col("granted"), F.col("cost"))), F.lit(0))
    return j.groupBy("scope").agg(F.count_if(F.col("granted").isNull()).alias("pending"), F.count_if("granted").alias("in_flight"), (F.max("remaining") - spent).alias("remaining"))


@query(f"WITH {C.STORES}, {C.QUOTA} SELECT scope, r.store_no, r.lifecycle_generation, count(DISTINCT request_id) AS canceled FROM requests r JOIN stores s ON s.store_no = r.store_no AND s.lifecycle_generation = r.lifecycle_generation WHERE request_id <> '' GROUP BY ALL")
def quota_cancel_generation(spark: SparkSession, d: str) -> DataFrame:
    """Requests that cancellations of every store's generation take."""
    return quota.canceled_by_generation(C.quota_requests(spark, d), C.stores(spark, d))


_SEEN = """o AS (SELECT 'scope-' || user_id AS scope, event_id, event_id % 7 <> 0 AS own, CASE WHEN event_id % 5 = 0 THEN event_id % 50 - 5 END AS lim, CASE WHEN event_id % 3 = 0 THEN floor(value)::BIGINT - 5 END AS remaining,
  CASE WHEN event_id % 4 = 0 THEN event_id * 1000000 END AS reset_us, CASE WHEN event_id % 6 = 0 THEN (event_id % 90 - 10)::DOUBLE END AS wait, event_id % 10 = 2 AS exhausted FROM events)"""


@query(f"""WITH {_SEEN} SELECT scope, arg_max(greatest(0, lim), event_id) FILTER (own AND lim IS NOT NULL) AS "limit", min(CASE WHEN exhausted THEN 0 ELSE greatest(0, remaining) END) FILTER (own AND (exhausted OR remaining IS NOT NULL)) AS remaining, max(reset_us) FILTER (own) AS reset_us,
  max(greatest(reset_us, CASE WHEN wait IS NOT NULL THEN event_id * 500000 + (greatest(0, wait) * 1000000)::BIGINT WHEN reset_us IS NULL THEN event_id * 500000 + 60000000 END)) FILTER (own AND exhausted) AS blocked_us FROM o WHERE own GROUP BY scope""")
def quota_observation_fold(spark: SparkSession, d: str) -> DataFrame:
    """Observations without a window's end: the balance never rises, boundaries never come earlier."""
    i = F.col("event_id")
    scope = F.concat(F.lit("scope-"), F.col("user_id").cast("string"))
    e = C.table(spark, d, "events").select(
        scope.alias("scope"), F.when(i % 7 != 0, scope).otherwise("other").alias("own_scope"), i.alias("ordinal"), (i * 500_000).alias("at_us"), F.when(i % 5 == 0, i % 50 - 5).alias("limit"), F.when(i % 3 == 0, F.floor("value").cast("long") - 5).alias("remaining"),
        F.when(i % 4 == 0, i * 1_000_000).alias("reset_us"), F.when(i % 6 == 0, (i % 90 - 10).cast("double")).alias("retry_after_seconds"), (i % 10 == 2).alias("exhausted"),
    )
    return quota.observed(e)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN greatest(0, least(CASE WHEN event_id % 3 = 0 THEN event_id * 10 END, CASE WHEN event_id % 4 = 0 THEN event_id * 7 END) - 20000) END AS delay_us FROM events")
def quota_next_timer(spark: SparkSession, d: str) -> DataFrame:
    """Time to the earlier of block and reset; none without a boundary."""
    i = F.col("event_id")
    return C.table(spark, d, "events").select("event_id", quota.timer_micros(F.when(i % 3 == 0, i * 10), F.when(i % 4 == 0, i * 7), F.lit(20000)).alias("delay_us"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS recency FROM events) SELECT user_id, event_id, recency FROM r WHERE recency <= 20")
def quota_dedup_recent(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest ids of each scope."""
    return longs(quota.recent_ids(C.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 20), "recency")


def quota_messages(spark: SparkSession, d: str) -> DataFrame:
    """A log of messages of every kind: requests, cancellations, observations, completions and failed deliveries of granted permits, an end of the scope."""
    e = C.table(spark, d, "events")
    i = F.col("event_id")
    kinds = ("request", "request", "request", "request", "complete", "undelivered", "cancel", "observe", "cancel_generation", "tick")
    kind = F.when((i % 970 == 969) & (F.col("user_id") % 3 == 0), "disable").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (i % 10 + 1).cast("int")))
    return e.select(
        F.concat(F.lit("scope-"), (F.col("user_id") % 12).cast("string")).alias("scope_key"), i.alias("ordinal"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + i * 2_000_000).alias("at"), kind.alias("kind"),
        F.concat(F.lit("r"), (i - F.when(i % 10 == 6, 6).otherwise(0)).cast("string")).alias("request_id"), F.lit("worker").alias("requester"), (i % 3).cast("string").alias("store_key"), (i % 2).alias("lifecycle_generation"),
        (1 + F.floor("value") % 3).cast("long").alias("cost"), F.when(i % 50 == 27, F.lit(9)).cast("long").alias("limit"), F.when(i % 20 == 7, F.lit(5)).cast("long").alias("remaining"), (i % 30 == 17).alias("exhausted"), F.when(i % 90 == 47, F.timestamp_micros(F.lit(1_704_067_200_000_000) + (i + 40) * 2_000_000)).alias("reset_at"), F.when(i % 60 == 17, F.lit(30.0)).alias("retry_after_seconds"), F.when(i % 10 == 4, quota.OLDEST).when((i % 10 == 5) & (i % 4 == 1), quota.OLDEST).alias("permit_id"),
    )


@query()
def quota_replay(spark: SparkSession, d: str) -> DataFrame:
    """The whole log of each scope, folded; held against the fold's own tests."""
    return quota.replay(quota_messages(spark, d), limit=8, max_in_flight=4)


# ---- commands


@query("SELECT user_id % 25 AS store_no, 'cmd-' || (event_id % 2000) AS command_id, event_id AS ordinal, row_number() OVER (PARTITION BY user_id % 25, event_id % 2000 ORDER BY event_id) > 1 AS duplicate FROM events")
def command_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First outcome per command id."""
    e = C.table(spark, d, "events").select((F.col("user_id") % 25).alias("store_no"), F.concat(F.lit("cmd-"), (F.col("event_id") % 2000).cast("string")).alias("command_id"), F.col("event_id").alias("ordinal"))
    return fence.first_outcomes(e)


def commands(spark: SparkSession, d: str) -> DataFrame:
    """A log of commands and events of every kind; ``latest`` stands for the operation that the store accepted last."""
    e = C.table(spark, d, "events")
    i = F.col("event_id")
    kinds = ("request_sync", "operation_status", "remediation_started", "request_sync", "cancel_sync", "remediation_finished", "operation_status", "request_sync", "deactivation_fenced", "operation_status")
    kind = F.when(i % 110 == 44, "start_deactivation").otherwise(F.element_at(F.array(*map(F.lit, kinds)), (i % 10 + 1).cast("int")))
    return e.select(
        F.concat(F.lit("store-"), (F.col("user_id") % 25).cast("string")).alias("store_key"), i.alias("ordinal"), kind.alias("kind"), F.concat(F.lit("cmd-"), (i % 3000).cast("string")).alias("command_id"), (i % 7 % 2).cast("long").alias("expected_generation"),
        F.concat(F.lit("seq-"), i.cast("string")).alias("sync_sequence"), F.when(i % 10 == 2, F.concat(F.lit("rem-"), (i % 4).cast("string"))).when(i % 10 == 5, F.concat(F.lit("rem-"), (i % 4).cast("string"))).otherwise(controller.LATEST).alias("operation_id"), (i % 3).cast("long").alias("lifecycle_generation"),
        F.when(i % 4 == 0, "running").otherwise("completed").alias("status"), F.when(i % 11 == 0, "failed").otherwise("succeeded").alias("result_status"), F.when(i % 6 == 0, "q").alias("quota_id"), F.lit("active").alias("state"), F.lit(0).cast("long").alias("generation"),
    )


@query()
def controller_replay(spark: SparkSession, d: str) -> DataFrame:
    """Commands of each store, folded."""
    return controller.replay(commands(spark, d))


# ---- settings and keys


@query("""WITH r AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '12' WHEN 2 THEN '-3' WHEN 3 THEN 'x' ELSE '0' END AS raw,
  CASE c_custkey % 7 WHEN 0 THEN '5m' WHEN 1 THEN '250ms' WHEN 2 THEN '1.5 H' WHEN 3 THEN '30' WHEN 4 THEN 'soon' WHEN 5 THEN '2S' ELSE NULL END AS dur,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'YES' WHEN 2 THEN ' off ' WHEN 3 THEN '' WHEN 4 THEN 'maybe' ELSE '1' END AS flag,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' files, ,comments ' WHEN 2 THEN ' , ' ELSE 'a,b' END AS res,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '0.5' WHEN 2 THEN 'NaN' ELSE '1001' END AS weight FROM customer)
  SELECT id, coalesce(try_cast(raw AS BIGINT), CASE WHEN raw IS NULL THEN 20 END) AS page_size, coalesce(coalesce(try_cast(raw AS BIGINT), CASE WHEN raw IS NULL THEN 20 END) > 0, false) AS page_size_ok,
  CASE dur WHEN '5m' THEN 300000 WHEN '250ms' THEN 250 WHEN '1.5 H' THEN 5400000 WHEN '30' THEN 30000 WHEN '2S' THEN 2000 END::BIGINT AS millis,
  CASE WHEN flag IS NULL OR flag = '' THEN true WHEN flag IN ('YES', '1') THEN true WHEN flag = ' off ' THEN false END AS flag_value,
  CASE WHEN res IS NULL OR res = ' , ' THEN 'files' WHEN res = 'a,b' THEN 'a|b' ELSE 'files|comments' END AS resources,
  weight IS NULL OR weight = '0.5' AS weight_ok FROM r""")
def policy_parse(spark: SparkSession, d: str) -> DataFrame:
    """Raw settings as typed values with their validity."""
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x).cast("string") for x in v)), (k % n + 1).cast("int"))
    r = C.table(spark, d, "customer").select(
        k.alias("id"), pick(5, None, "12", "-3", "x", "0").alias("raw"), pick(7, "5m", "250ms", "1.5 H", "30", "soon", "2S", None).alias("dur"), pick(6, None, "YES", " off ", "", "maybe", "1").alias("flag"), pick(4, None, " files, ,comments ", " , ", "a,b").alias("res"), pick(4, None, "0.5", "NaN", "1001").alias("weight"),
    )
    size, ok = policy.positive_int(F.col("raw"), 20)
    return r.select("id", size.alias("page_size"), ok.alias("page_size_ok"), policy.duration_millis(F.col("dur")).alias("millis"), policy.parsed_bool(F.col("flag"), True)[0].alias("flag_value"), F.array_join(policy.resource_list(F.col("res")), "|").alias("resources"), policy.fairness_weight(F.col("weight"))[1].alias("weight_ok"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 4 END ELSE 5 END AS priority,
  (o_orderkey % 400 BETWEEN 1 AND 350) AND 2000 >= o_orderkey % 9 AND o_orderkey % 9 > 0 AND o_orderkey % 400 >= o_orderkey % 9 AS limits_ok,
  greatest(1, least(o_orderkey % 12, 10))::BIGINT AS fanout FROM orders""")
def work_class_priority(spark: SparkSession, d: str) -> DataFrame:
    """Priority of work classes, cross-checked limits, the smaller of two ceilings."""
    k = F.col("o_orderkey")
    name = F.element_at(F.array(*map(F.lit, ("interactive", "recent_activation", "incremental", "cleanup", "backfill"))), (k % 5 + 1).cast("int"))
    o = C.table(spark, d, "orders")
    return o.select("o_orderkey", policy.work_class_priority(name, k % 2 == 0).alias("priority"), policy.quota_limits_valid(k % 400, k % 9, F.lit(2000)).alias("limits_ok"), policy.min_of_ceilings(k % 12, F.lit(10)).cast("long").alias("fanout"))


def _b32(h: str) -> str:
    digit = lambda i: f"substr('{keys.ALPHABET}', ((('0x' || substr(h, {5 * (i // 4) + 1}, 5))::BIGINT >> {15 - 5 * (i % 4)}) & 31)::INT + 1, 1)"
    return " || ".join(digit(i) for i in range(26))


@query(f"""WITH t AS (SELECT c_custkey, sha256('{{"namespace":"user","parts":["' || c_name || '",' || c_nationkey || ']}}') || '0' AS h FROM customer)
  SELECT c_custkey, {_b32('h')} AS user_key, 'user/' || {_b32('h')} || '/' || (c_custkey % 4) AS composite FROM t""")
def opaque_keys(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic keys of typed parts, and composite ids."""
    c = C.table(spark, d, "customer")
    key = keys.opaque_key("user", keys.json_string(F.col("c_name")), keys.json_number(F.col("c_nationkey")))
    out = c.select("c_custkey", key.alias("user_key"))
    return out.withColumn("composite", keys.composite_id("user", F.col("user_key"), keys.generation_component(F.col("c_custkey") % 4)))


# ---- analytics


@query("""SELECT event_type, sum(floor(value)::BIGINT - 20) FILTER (event_id % 3 = 0 AND floor(value) >= 20)::BIGINT AS counter,
  arg_max(floor(value)::BIGINT - 20, (ts, event_id)) FILTER (event_id % 3 = 1) AS gauge,
  count(*) FILTER (event_id % 3 = 2 AND floor(value) >= 20) AS records,
  sum(floor(value)::BIGINT - 20) FILTER (event_id % 3 = 2 AND floor(value) >= 20)::BIGINT AS recorded FROM events GROUP BY event_type""")
def metric_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters, gauges and histograms per event type."""
    e = C.table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("counter", "gauge", "histogram"))), (F.col("event_id") % 3 + 1).cast("int"))
    points = e.select("event_type", kind.alias("kind"), (F.floor("value").cast("long") - 20).alias("value"), F.col("ts").alias("at"), F.col("event_id").alias("ordinal"))
    return analytics.metric_rollup(points, ["event_type"])


@query("""SELECT p_partkey, 'provider=' || CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_brand END || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ';status=' || p_type END AS attributes FROM part""")
def metric_bounding(spark: SparkSession, d: str) -> DataFrame:
    """Metric attributes within their allow-list and length."""
    p = C.table(spark, d, "part")
    k = F.col("p_partkey")
    m = F.create_map(F.lit("provider"), F.when(k % 3 == 0, F.repeat(F.lit("é"), 33)).otherwise(F.col("p_brand")), F.lit("status"), F.when(k % 2 == 1, F.col("p_type")), F.lit("store_key"), F.lit("raw"))
    entries = F.array_sort(F.map_entries(analytics.bounded_attributes(m)))
    return p.select(k, F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("attributes"))


@query("""WITH s AS (SELECT event_type, list_sort(list(floor(value)::BIGINT)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
  SELECT event_type, len(v) AS n, v[round_even((len(v) - 1) * 0.5, 0)::INT + 1] AS p50, v[round_even((len(v) - 1) * 0.95, 0)::INT + 1] AS p95 FROM s""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles."""
    e = C.table(spark, d, "events").select("event_type", F.floor("value").cast("long").alias("v"))
    return analytics.nearest_rank(e, ["event_type"], "v", 0.5, 0.95)


def _history(spark: SparkSession, d: str) -> DataFrame:
    e = C.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "signaled").when(F.col("event_type") == "purchase", "task_started").when(F.col("event_type") == "view", "scheduled").otherwise("started")
    return e.select(F.col("user_id").alias("workflow_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"), kind.alias("event_type"), F.lag("event_id").over(W.partitionBy("user_id").orderBy("event_id")).alias("scheduled_event_id"), F.octet_length("props").cast("long").alias("byte_size"))


_HISTORY = """h AS (SELECT user_id AS workflow_id, event_id, epoch_us(ts) AS event_us, CASE event_type WHEN 'click' THEN 'signaled' WHEN 'purchase' THEN 'task_started'
  WHEN 'view' THEN 'scheduled' ELSE 'started' END AS event_type, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS scheduled_event_id, strlen(props) AS byte_size FROM events)"""


@query(f"""WITH {_HISTORY}, n AS (SELECT *, first_value(CASE WHEN event_type = 'task_started' THEN event_us END IGNORE NULLS) OVER (PARTITION BY workflow_id ORDER BY event_id
  ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM h) SELECT workflow_id, event_id, s - event_us AS latency_us FROM n WHERE event_type = 'signaled' AND s IS NOT NULL""")
def signal_resume_latency(spark: SparkSession, d: str) -> DataFrame:
    """From a signal to the next task start."""
    return analytics.resume_latency(_history(spark, d))


@query(f"WITH {_HISTORY} SELECT b.workflow_id, b.event_id, b.event_us - a.event_us AS latency_us FROM h b JOIN h a ON a.workflow_id = b.workflow_id AND a.event_id = b.scheduled_event_id WHERE a.event_type = 'scheduled' AND b.event_type = 'started'")
def schedule_to_start(spark: SparkSession, d: str) -> DataFrame:
    """From scheduling to start."""
    return analytics.schedule_to_start(_history(spark, d))


@query(f"WITH {_HISTORY} SELECT event_type, count(*) AS n, sum(byte_size)::BIGINT AS bytes, count(*) FILTER (event_type = 'signaled') AS signals FROM h GROUP BY event_type")
def event_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events and bytes by type."""
    return _history(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("byte_size").alias("bytes"), F.count_if(F.col("event_type") == "signaled").alias("signals"))


def _dispatches(spark: SparkSession, d: str) -> DataFrame:
    e = C.table(spark, d, "events")
    return e.select((F.col("user_id") % 16).alias("queue"), F.col("event_type").alias("fairness_key"), F.col("ts").alias("started_at"), F.col("event_id").alias("ordinal"))


@query("""WITH g AS (SELECT user_id % 16 AS queue, event_type, count(*) AS n FROM events GROUP BY ALL),
  c AS (SELECT queue, n::DOUBLE / CASE WHEN event_type = 'view' THEN 2.0 ELSE 1.0 END AS x FROM g)
  SELECT queue, round(sum(x) * sum(x) / (count(*) * sum(x * x)), 6) AS jain FROM c GROUP BY queue""")
def fairness_jain(spark: SparkSession, d: str) -> DataFrame:
    """Weighted Jain index of each queue."""
    c = _dispatches(spark, d).groupBy("queue", "fairness_key").agg(F.count(F.lit(1)).alias("count")).withColumn("weight", F.when(F.col("fairness_key") == "view", 2.0).otherwise(1.0))
    return analytics.jain_index(c, ["queue"]).select("queue", F.round("jain", 6).alias("jain"))


_ORDERED = "o AS (SELECT user_id % 16 AS queue, event_type AS fairness_key, ts, event_id, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id % 16, event_type ORDER BY ts, event_id) AS k FROM events)"


@query(f"WITH {_ORDERED} SELECT queue, fairness_key, max(n) AS completion_rank FROM o GROUP BY ALL")
def completion_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of each key's last dispatch."""
    return analytics.completion_rank(_dispatches(spark, d), ["queue"])


@query(f"WITH {_ORDERED}, r AS (SELECT queue, fairness_key, n - k AS island, count(*) AS c FROM o GROUP BY ALL) SELECT queue, fairness_key, max(c) AS max_run FROM r GROUP BY ALL")
def max_run(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of dispatches of one key."""
    return analytics.longest_runs(_dispatches(spark, d), ["queue"])


from . import decision_queries, flow_queries, store_queries, wave_queries  # noqa: E402, F401  add their queries
