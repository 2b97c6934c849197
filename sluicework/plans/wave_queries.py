"""Queries of activations in waves, cleanup trees, page results, remediations and progress by level; added to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import fence, flows, quota
from ..streaming.dedup import remembered
from . import carriers as C
from .registry import query
from .store_queries import AUTHORITY, MANIFEST, known_stores, lifecycle_log, manifest, manifest_ingest


def resource_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each customer's resources from ``orders``; a page's cursor names its order."""
    o = C.table(spark, d, "orders").withColumn("resource_key", F.when(F.col("o_orderpriority").rlike("^[12]"), "files").otherwise("comments"))
    w, cursor = W.partitionBy("o_custkey", "resource_key").orderBy("o_orderkey"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    failed = F.col("o_totalprice") < 20000
    return o.select((F.col("o_custkey") % 25).alias("store_no"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_key"), "resource_key", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.when(F.lag("o_orderkey").over(w).isNotNull(), cursor).alias("cursor"), F.lead(cursor).over(w).alias("next_cursor"), failed.alias("failed"), F.when(failed, F.col("o_orderkey") % 3).otherwise(0).alias("errors"))


@query(f"""WITH {C.STORES}, o AS (SELECT *, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'files' ELSE 'comments' END AS resource FROM orders),
 p AS (SELECT o_custkey, resource, row_number() OVER w - 1 AS seq, CASE WHEN lag(o_orderkey) OVER w IS NOT NULL THEN 'c' || o_orderkey END AS cursor, lead('c' || o_orderkey) OVER w AS next_cursor, o_totalprice < 20000 AS failed,
  CASE WHEN o_totalprice < 20000 THEN greatest(1, o_orderkey % 3) ELSE 0 END AS errors FROM o WINDOW w AS (PARTITION BY o_custkey, resource ORDER BY o_orderkey)),
 s AS (SELECT *, min(seq) FILTER (failed AND seq < 2) OVER (PARTITION BY o_custkey, resource) AS stop, min(seq) FILTER (failed AND seq >= 2) OVER (PARTITION BY o_custkey, resource) AS stop2 FROM p),
 r AS (SELECT o_custkey, resource, count(*) FILTER (NOT failed) AS pages, sum(errors) AS errors, CASE WHEN bool_or(failed) THEN arg_min(coalesce(cursor, '-'), seq) FILTER (failed) ELSE arg_max(coalesce(next_cursor, '-'), seq) END AS c, bool_or(failed) AS bad FROM s WHERE seq < 2 AND (stop IS NULL OR seq < stop + 3) GROUP BY ALL),
 u AS (SELECT o_custkey, sum(pages)::BIGINT AS recent_pages, sum(errors) AS e, coalesce(string_agg(resource || '=' || c, '|' ORDER BY resource) FILTER (c <> '-'), '') AS cursors FROM r GROUP BY o_custkey),
 b AS (SELECT o_custkey, count(*) FILTER (NOT failed) AS pages, sum(errors) AS e FROM s WHERE seq >= 2 AND (stop2 IS NULL OR seq < stop2 + 3) GROUP BY o_custkey),
 j AS (SELECT u.*, o_custkey % 25 AS store_no, lifecycle_state IN ('active', 'syncing') AS open, coalesce(b.pages, 0) AS bp, coalesce(b.e, 0) AS be FROM u JOIN stores ON store_no = o_custkey % 25 LEFT JOIN b USING (o_custkey))
 SELECT store_no, 'user-' || o_custkey AS user_key, CASE WHEN e > 0 THEN 'recent_failed' WHEN NOT open THEN 'rejected' WHEN be > 0 THEN 'backfill_failed' ELSE 'activated' END AS stage, recent_pages,
  CASE WHEN e = 0 AND open THEN bp ELSE 0 END AS backfill_pages, (e + CASE WHEN e = 0 AND open THEN be ELSE 0 END)::BIGINT AS error_count, cursors FROM j""")
def activation_waves(spark: SparkSession, d: str) -> DataFrame:
    """A recent wave of two pages a resource, the fence, and a backfill from the cursors that it left."""
    s = C.stores(spark, d).withColumns({"expected_generation": F.col("lifecycle_generation"), "allowed_states": F.array(*map(F.lit, fence.WRITABLE))})
    fences = fence.validate_fence(s.select("store_no", "expected_generation", "allowed_states"), C.stores(spark, d)).select("store_no", "status")
    return flows.activation(resource_pages(spark, d), fences, 2, 3)


@query(f"""WITH RECURSIVE {AUTHORITY}, t AS (SELECT o_custkey % 25 AS store_no, 500 + o_orderkey // 20 AS ordinal, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
 f AS (SELECT t.*, lifecycle_generation + (lifecycle_state IN ('active', 'syncing'))::INT AS e, (row_number() OVER (PARTITION BY t.store_no ORDER BY ordinal, 'user-' || o_custkey) - 1) // 20 AS batch FROM t JOIN stores USING (store_no) WHERE k = 1),
 g AS (SELECT f.*, state, gen, coalesce(gen = e AND state = 'deactivating', false) AS ok, c_acctbal >= 0 AS had FROM f ASOF JOIN run ON run.store_no = f.store_no AND f.ordinal >= run.ordinal JOIN customer ON c_custkey = o_custkey),
 m AS (SELECT *, CASE WHEN NOT ok THEN CASE WHEN gen IS NULL THEN 'failed' WHEN gen <> e THEN 'stale_generation' ELSE 'rejected' END END AS why,
  CASE WHEN gen IS NULL THEN 'KeyError' WHEN gen <> e THEN 'expected generation ' || e || ', found ' || gen ELSE 'cleanup requires DEACTIVATING state' END AS said, min(batch) FILTER (NOT ok) OVER (PARTITION BY store_no) AS last FROM g)
 SELECT store_no, count(*) FILTER (ok AND had) AS affected, count(DISTINCT batch) AS batches_run, coalesce(arg_min(why, (ordinal, 'user-' || o_custkey)) FILTER (why IS NOT NULL), 'succeeded') AS status, arg_min(said, (ordinal, 'user-' || o_custkey)) FILTER (why IS NOT NULL) AS message
 FROM m WHERE last IS NULL OR batch <= last GROUP BY store_no""")
def cleanup_trees(spark: SparkSession, d: str) -> DataFrame:
    """Users that ordered, cleaned in batches of twenty, some while their store is being deactivated."""
    s = C.stores(spark, d)
    t = C.table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("store_no"), (500 + F.expr("o_orderkey div 20")).alias("ordinal"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_key"))
    t = t.join(s.select("store_no", (F.col("lifecycle_generation") + F.col("lifecycle_state").isin(*fence.WRITABLE).cast("int")).alias("expected_generation")), "store_no")
    active = C.table(spark, d, "customer").where("c_acctbal >= 0").select((F.col("c_custkey") % 25).alias("store_no"), F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_key"))
    return flows.cleanup_tree(active, t, lifecycle_log(spark, d), known_stores(spark, d), 20)


@query("""WITH m AS (SELECT doc_id % 25 AS store_no, doc_id // 250 AS page_no, doc_id, source || '/' || (n_chars // 100) AS document_key, n_chars % 2 AS v, n_chars > 4000 AS gone FROM documents)
 SELECT 'p' || page_no AS page_key, store_no, row_number() OVER (PARTITION BY store_no, page_no ORDER BY gone, doc_id) - 1 AS task_no, document_key, CASE WHEN gone THEN 'deleted:p' || page_no ELSE 'v' || v END AS source_version,
 CASE WHEN gone THEN '' ELSE 'staged/' || doc_id END AS staging_uri, CASE WHEN gone THEN 'delete' ELSE 'upsert' END AS mutation FROM m""")
def page_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """The mutations of each page: its documents, then its deleted keys."""
    m = manifest(spark, d).withColumn("gone", F.col("mutation") == "delete")
    one = F.struct("ordinal", "document_key", "source_version", "staging_uri", "content_hash")
    sorted_of = lambda c: F.array_sort(F.collect_list(F.when(c, one)))
    pages = m.groupBy("store_no", F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("page_key")).agg(sorted_of(~F.col("gone")).alias("documents"), F.transform(sorted_of(F.col("gone")), lambda x: x["document_key"]).alias("deleted_document_keys"))
    return flows.page_tasks(pages).select("page_key", "store_no", "task_no", "document_key", "source_version", "staging_uri", "mutation")


@query(f"""WITH RECURSIVE {MANIFEST}, e AS (SELECT *, CASE WHEN status = 'duplicate' THEN 'document rejected' WHEN mutation = 'upsert' AND body IS NULL THEN 'KeyError' WHEN mutation = 'upsert' AND sha256(body) <> content_hash THEN 'staged content hash does not match DocumentRef'
  WHEN state IS NULL THEN 'KeyError' ELSE 'store state ' || state || ' rejects retrieval writes' END AS said FROM m3)
 SELECT store_no, page_no, count(*) FILTER (mutation = 'upsert') AS changed_documents, count(*) FILTER (mutation = 'delete') AS deleted_documents,
 coalesce(string_agg(said, '|' ORDER BY mutation = 'delete', ordinal) FILTER (status NOT IN ('succeeded', 'stale_generation')), '') AS errors, CASE WHEN count(*) FILTER (status NOT IN ('succeeded', 'stale_generation')) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM e GROUP BY ALL""")
def page_errors(spark: SparkSession, d: str) -> DataFrame:
    """All errors of each page in the order of its tasks."""
    r = manifest_ingest(spark, d).withColumn("task_no", F.struct((F.col("mutation") == "delete").alias("d"), "ordinal"))
    return flows.page_result(r, ["store_no", "page_no"]).withColumn("errors", F.array_join("errors", "|"))


@query("""WITH a AS (SELECT o_custkey % 25 AS store_no, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'partial' ELSE 'failed' END AS status, CASE WHEN o_totalprice > 300000 THEN ['Timeout'] WHEN o_orderstatus <> 'F' AND o_orderpriority < '3' THEN [o_orderpriority, o_orderkey::VARCHAR]
  WHEN o_orderstatus <> 'F' THEN [CASE o_orderstatus WHEN 'O' THEN 'partial' ELSE 'failed' END] ELSE [] END AS e FROM orders),
 x AS (SELECT store_no, o_orderkey, unnest(e) AS m, generate_subscripts(e, 1) AS k FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY store_no ORDER BY o_orderkey, k) AS r FROM x),
 z AS (SELECT store_no, count(*) AS n, string_agg(m, '|' ORDER BY r) FILTER (r <= 100) AS errors FROM y GROUP BY store_no)
 SELECT a.store_no, count(*) FILTER (len(e) = 0) AS users_completed, coalesce(any_value(n), 0) AS error_count, coalesce(any_value(n), 0) AS users_failed, coalesce(any_value(errors), '') AS errors, CASE WHEN any_value(n) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM a LEFT JOIN z USING (store_no) GROUP BY a.store_no""")
def remediation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of each store with the first hundred of their errors."""
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "partial").otherwise("failed")
    errors = F.when((F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") < "3"), F.array("o_orderpriority", F.col("o_orderkey").cast("string")))
    a = C.table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("store_no"), F.col("o_orderkey").alias("ordinal"), status.alias("status"), errors.alias("errors"), F.when(F.col("o_totalprice") > 300000, "Timeout").alias("exception"))
    return flows.remediation_result(a).withColumn("errors", F.array_join("errors", "|"))


@query("""WITH x AS (SELECT DISTINCT * FROM (SELECT o_custkey % 25 AS store_no, o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT l_suppkey % 25, l_orderkey FROM lineitem WHERE l_returnflag = 'R')),
 g AS (SELECT DISTINCT l_suppkey % 25 AS store_no, l_orderkey AS id FROM lineitem WHERE l_linestatus = 'F') SELECT store_no, count(*) AS expected, count(*) FILTER (g.id IS NULL) AS outstanding FROM x LEFT JOIN g USING (store_no, id) GROUP BY store_no""")
def drain_expected(spark: SparkSession, d: str) -> DataFrame:
    """Syncs and remediations that a store's drain waits for."""
    op = lambda c: F.concat(F.lit("op-"), F.col(c).cast("string")).alias("operation_id")
    li = C.table(spark, d, "lineitem").withColumn("store_no", F.col("l_suppkey") % 25)
    syncs = C.table(spark, d, "orders").where("o_orderstatus = 'O'").select((F.col("o_custkey") % 25).alias("store_no"), op("o_orderkey"))
    return flows.expected_drains(syncs, li.where("l_returnflag = 'R'").select("store_no", op("l_orderkey")), li.where("l_linestatus = 'F'").select("store_no", op("l_orderkey")))


_LEVELS = ("store", "user_key", "resource_key", "page")


def _levels_sql() -> str:
    out, below = [], "x"
    for k in range(len(_LEVELS), 0, -1):
        key, name = ", ".join(_LEVELS[:k]), _LEVELS[k - 1]
        out.append(f"{name}_n AS (SELECT {key}, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS pending, CASE WHEN count(*) FILTER (state = 'pending') > 0 THEN 'pending' WHEN count(*) FILTER (state = 'failed') > 0 THEN 'failed' ELSE 'completed' END AS state FROM {below} GROUP BY ALL)")
        below = f"{name}_n"
    rows = [f"SELECT '{_LEVELS[k - 1]}' AS level, {', '.join(c if i < k else f'NULL AS {c}' for i, c in enumerate(_LEVELS))}, completed, failed, pending, CASE WHEN pending > 0 THEN 'running' ELSE 'completed' END AS phase FROM {_LEVELS[k - 1]}_n" for k in range(len(_LEVELS), 0, -1)]
    return ", ".join(out) + " " + " UNION ALL ".join(rows)


@query(f"WITH x AS (SELECT doc_id % 25 AS store, coalesce(source, '-') AS user_key, coalesce(lang, '-') AS resource_key, doc_id // 250 AS page, CASE WHEN n_chars < 200 THEN 'failed' WHEN n_chars > 6000 THEN 'pending' ELSE 'completed' END AS state FROM documents), {_levels_sql()}")
def progress_levels(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of pages, resources, users and stores, each from the level below."""
    n = F.col("n_chars")
    x = C.table(spark, d, "documents").select((F.col("doc_id") % 25).alias("store"), F.coalesce("source", F.lit("-")).alias("user_key"), F.coalesce("lang", F.lit("-")).alias("resource_key"), F.expr("doc_id div 250").alias("page"), F.when(n < 200, "failed").when(n > 6000, "pending").otherwise("completed").alias("state"))
    return flows.level_progress(x, list(_LEVELS))


@query("""WITH e AS (SELECT event_type || '/' || user_id % 8 || '/default' AS quota_scope, event_id, value, epoch_us(ts) AS t FROM events),
 o AS (SELECT quota_scope, arg_max(floor(value)::BIGINT, event_id) AS configured_limit, min(CASE WHEN value < 1 OR value > 99 THEN 0 ELSE floor(value)::BIGINT END) AS remaining, max(t) FILTER (value > 50) AS reset_us, max(CASE WHEN value > 50 THEN t ELSE event_id + 60000000 END) FILTER (value < 1 OR value > 99) AS blocked_us FROM e GROUP BY ALL)
 SELECT o.*, 4::BIGINT AS max_in_flight, 350::BIGINT AS max_pending_requests, (SELECT count(*) FROM e WHERE e.quota_scope = o.quota_scope AND value BETWEEN 10 AND 11) AS in_flight, remaining = 0 AS disabled,
 (SELECT count(*) FROM e WHERE e.quota_scope = o.quota_scope AND value < 5) AS pending_count, (SELECT count(*) FROM e WHERE e.quota_scope = o.quota_scope AND value BETWEEN 10 AND 11) AS reservation_count, 'initial' AS quota_window_id FROM o""")
def quota_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """All twelve fields of every scope, from its observations and requests."""
    v = F.col("value")
    e = C.table(spark, d, "events").select(F.col("event_type").alias("provider"), (F.col("user_id") % 8).cast("string").alias("credential_key"), F.lit("default").alias("quota_class"), "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    scope = F.concat_ws("/", "provider", "credential_key", "quota_class")
    seen = quota.observed(e.select(scope.alias("scope"), scope.alias("own_scope"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("at_us"), F.floor(v).cast("long").alias("limit"), F.when(v < 1, F.lit(0)).otherwise(F.floor(v)).cast("long").alias("remaining"), F.when(v > 50, F.col("t")).alias("reset_us"), F.lit(None).cast("double").alias("retry_after_seconds"), ((v < 1) | (v > 99)).alias("exhausted")))
    parts = F.split("scope", "/")
    scopes = seen.select(parts[0].alias("provider"), parts[1].alias("credential_key"), parts[2].alias("quota_class"), "limit", "remaining", "reset_us", "blocked_us", (F.col("remaining") == 0).alias("disabled"), F.lit(None).cast("string").alias("window_id"))
    return quota.snapshots(scopes, e.where("value < 5"), e.where("value between 10 and 11"), 4)


@query("""WITH RECURSIVE q AS (SELECT user_id % 25 AS store_no, event_type || '-' || (floor(value)::BIGINT) AS command_id, event_id AS ordinal, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS n FROM events),
 r AS (SELECT DISTINCT store_no, 0::BIGINT AS n, NULL::BIGINT AS ordinal, NULL::VARCHAR AS command_id, []::VARCHAR[] AS held, false AS duplicate FROM q
  UNION ALL SELECT q.store_no, q.n, q.ordinal, q.command_id, CASE WHEN list_contains(held, q.command_id) THEN held ELSE list_append(held, q.command_id)[-12:] END, list_contains(held, q.command_id) FROM r JOIN q ON q.store_no = r.store_no AND q.n = r.n + 1)
 SELECT store_no, ordinal, command_id, duplicate FROM r WHERE n > 0""")
def command_dedup_bounded(spark: SparkSession, d: str) -> DataFrame:
    """Whether a command is among the twelve that its store remembers."""
    c = C.table(spark, d, "events").select((F.col("user_id") % 25).alias("store_no"), F.concat("event_type", F.lit("-"), F.floor("value").cast("string")).alias("command_id"), F.col("event_id").alias("ordinal"))
    return remembered(c, "store_no", "command_id", "ordinal", 12)
