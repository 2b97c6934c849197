"""Queries of the orchestrated flows, the requester's side of the quota, ids and settings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, policy
from ..operators import controller, fence, flows, quota, requester
from . import carriers as C
from .registry import INGESTED, _ingested, longs, query

WINDOW, SLICE, LIMIT = 3, 2, 6


def digits(json: str) -> str:
    """SQL of the 26 base32 digits of a text's SHA-256."""
    return f"array_to_string(list_transform(range(26), lambda i: substr('{keys.ALPHABET}', ((('0x' || substr(sha256({json}) || '0', (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '')"


def key_sql(namespace: str, *parts: str) -> str:
    """SQL of an opaque key of SQL texts that are JSON."""
    body = " || ',' || ".join(parts)
    return digits(f"('{{\"namespace\":\"{namespace}\",\"parts\":[' || {body} || ']}}')")


def text_sql(column: str) -> str:
    return f"('\"' || {column} || '\"')"


# ---- pages, resources, users


def _flow_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages numbered within each resource; a page names the next one's cursor."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*flows.RESOURCE).orderBy("page_id")
    p = C.pages(spark, d).select(*flows.RESOURCE, "page_id", "failed", (F.col("page_id") % 3).alias("errors"), (F.row_number().over(w).cast("long") - 1).alias("seq"), F.lead("page_id").over(w).isNotNull().alias("more"))
    text = lambda n: F.concat(F.lit("c"), n.cast("string"))
    return p.select(*flows.RESOURCE, "seq", "failed", "errors", F.when(F.col("seq") > 0, text(F.col("seq"))).alias("cursor"), F.when(F.col("more"), text(F.col("seq") + 1)).alias("next_cursor"))


FLOW_PAGES = f"""{C.PAGES}, fp0 AS (SELECT store_no, user_key, resource_key, failed, page_id % 3 AS errors,
  row_number() OVER w - 1 AS seq, lead(page_id) OVER w IS NOT NULL AS more FROM pages WINDOW w AS (PARTITION BY store_no, user_key, resource_key ORDER BY page_id)),
 fp AS (SELECT store_no, user_key, resource_key, seq, failed, errors, CASE WHEN seq > 0 THEN 'c' || seq END AS cursor, CASE WHEN more THEN 'c' || (seq + 1) END AS next_cursor FROM fp0)"""
STARTED = f"""{FLOW_PAGES}, st AS (SELECT *, min(seq) FILTER (failed) OVER (PARTITION BY store_no, user_key, resource_key) AS stop FROM fp WHERE seq < {LIMIT}),
 started AS (SELECT * FROM st WHERE stop IS NULL OR seq < stop + {WINDOW})"""
RESULTS = f"""{STARTED}, res AS (SELECT store_no, user_key, resource_key,
  count(*) FILTER (NOT failed) + max(CASE WHEN resource_key = 'files' THEN 2 ELSE 0 END) AS pages_completed,
  (sum(CASE WHEN failed THEN greatest(errors, 1) ELSE 0 END) + max(CASE WHEN resource_key = 'files' AND store_no % 2 = 0 THEN 1 ELSE 0 END))::BIGINT AS error_count,
  CASE WHEN min(stop) IS NOT NULL THEN arg_min_null(cursor, seq) FILTER (failed) ELSE arg_max_null(next_cursor, seq) END AS next_cursor,
  min(stop) IS NULL AND arg_max_null(next_cursor, seq) IS NULL AS finished FROM started GROUP BY ALL)"""


def _started(spark: SparkSession, d: str) -> DataFrame:
    return flows.page_pipeline(_flow_pages(spark, d), WINDOW, LIMIT)


def _results(spark: SparkSession, d: str) -> DataFrame:
    s = _started(spark, d)
    files = F.col("resource_key") == "files"
    prior = s.select(*flows.RESOURCE).distinct().select(*flows.RESOURCE, F.when(files, 2).otherwise(0).alias("prior_pages"), F.when(files & (F.col("store_no") % 2 == 0), 1).otherwise(0).alias("prior_errors"))
    return flows.resource_result(s, prior)


@query(f"WITH {STARTED} SELECT store_no, user_key, resource_key, seq, failed, least(seq + 1, {WINDOW}) AS pending FROM started")
def page_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a resource starts: the first failure stops the fetching, what is in flight is drained."""
    return flows.in_flight(_started(spark, d), WINDOW).select(*flows.RESOURCE, "seq", "failed", "pending")


@query(f"WITH {RESULTS} SELECT *, CASE WHEN error_count > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM res")
def resource_result(spark: SparkSession, d: str) -> DataFrame:
    """Resources with pages and errors of earlier runs, and their checkpoint."""
    return longs(_results(spark, d), "pages_completed", "error_count")


@query(f"""WITH {RESULTS}, r AS (SELECT *, resource_key = 'comments' AND store_no % 5 = 0 AS lost FROM res),
 o AS (SELECT store_no, user_key, list(CASE WHEN lost THEN [resource_key || ':Timeout'] WHEN error_count > 0 THEN ['e' || error_count] ELSE []::VARCHAR[] END ORDER BY resource_key DESC) AS e,
  list(resource_key || '=' || coalesce(next_cursor, '-') ORDER BY resource_key DESC) FILTER (NOT lost AND resource_key = 'files') AS f,
  list(resource_key || '=' || coalesce(next_cursor, '-') ORDER BY resource_key DESC) FILTER (NOT lost AND resource_key <> 'files') AS n,
  count(*) FILTER (NOT lost) AS ok, bool_and(NOT lost AND finished) AS fin,
  list(resource_key ORDER BY resource_key DESC) FILTER (NOT lost AND finished) AS done,
  arg_min(next_cursor, CASE resource_key WHEN 'files' THEN 0 ELSE 1 END) FILTER (NOT lost AND next_cursor IS NOT NULL) AS nc, bool_or(resource_key = 'files') AS hasf FROM r GROUP BY ALL)
 SELECT store_no, user_key, array_to_string(flatten(e), '|') AS errors, array_to_string(list_concat(coalesce(f, ['files=old']), coalesce(n, [])), '|') AS cursors,
  array_to_string(coalesce(done, []), '|') AS completed, ok AS resources_completed, CASE WHEN f IS NULL THEN 'old' ELSE nc END AS next_cursor,
  fin AND len(coalesce(done, [])) = 2 AS finished, CASE WHEN len(flatten(e)) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM o""")
def user_result(spark: SparkSession, d: str) -> DataFrame:
    """Users from their resources: errors in order, cursors merged, completed resources."""
    r = _results(spark, d)
    lost = (F.col("resource_key") == "comments") & (F.col("store_no") % 5 == 0)
    r = r.select(*flows.RESOURCE, F.when(F.col("resource_key") == "files", 0).otherwise(1).alias("resource_no"), F.when(lost, "Timeout").alias("exception"), F.when(F.col("error_count") > 0, F.array(F.concat(F.lit("e"), F.col("error_count").cast("string")))).otherwise(F.array().cast("array<string>")).alias("errors"), "next_cursor", "finished")
    u = r.select("store_no", "user_key").distinct()
    u = u.select("*", F.array(F.lit("files"), F.lit("comments")).alias("requested"), F.array().cast("array<string>").alias("completed"), F.array(F.struct(F.lit("files").alias("resource"), F.lit("old").alias("cursor"))).alias("resource_cursors"))
    out = flows.user_result(r, u)
    cursors = F.transform("cursors", lambda c: F.concat(c["resource"], F.lit("="), F.coalesce(c["cursor"], F.lit("-"))))
    return out.select("store_no", "user_key", F.array_join("errors", "|").alias("errors"), F.array_join(cursors, "|").alias("cursors"), F.array_join("completed", "|").alias("completed"), "resources_completed", "next_cursor", "finished", "status")


def _wide_users(spark: SparkSession, d: str) -> DataFrame:
    u = C.users(spark, d).where("valid")
    k = F.col("ordinal")
    return u.select(
        "store_no", "user_key", (k % 4).alias("lifecycle_generation"), F.lit("seq-1").alias("sync_sequence"), F.lit("backfill").alias("work_class"), F.lit(2).alias("resource_concurrency"), F.when(k % 2 == 0, 5).alias("page_limit"), F.lit("user").alias("cursor"),
        F.array(*map(F.lit, ("files", "comments", "mail", "files"))).alias("requested"), F.when(k % 3 == 0, F.array(F.lit("comments"))).otherwise(F.array().cast("array<string>")).alias("completed"), F.when(k % 2 == 1, F.expr("map('files', cast(null as string), 'mail', 'm7')")).otherwise(F.expr("cast(map() as map<string, string>)")).alias("resource_cursors"),
    )


_FAN = f"""WITH {C.USERS}, v AS (SELECT *, CASE WHEN ordinal % 3 = 0 THEN ['files','mail','files'] ELSE ['files','comments','mail','files'] END AS r FROM users WHERE valid),
 x AS (SELECT store_no, user_key, ordinal, unnest(range(len(r))) AS resource_no, r FROM v),
 fan AS (SELECT store_no, user_key, ordinal, resource_no, r[resource_no + 1] AS resource_key, resource_no // 2 AS wave,
  CASE WHEN ordinal % 2 = 1 AND r[resource_no + 1] = 'files' THEN NULL WHEN ordinal % 2 = 1 AND r[resource_no + 1] = 'mail' THEN 'm7' ELSE 'user' END AS cursor FROM x)"""


@query(f"{_FAN} SELECT store_no, user_key, resource_no::INT AS resource_no, resource_key, wave, cursor FROM fan")
def user_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A row per user and resource left, in waves of two, with the cursor that counts."""
    u = _wide_users(spark, d)
    return flows.fan_out(u.select("store_no", "user_key", "cursor", "requested", "completed", "resource_cursors"), 2).select("store_no", "user_key", "resource_no", "resource_key", "wave", "cursor")


@query(f"{_FAN} SELECT store_no, ordinal % 4 AS lifecycle_generation, 'seq-1' AS sync_sequence, user_key, resource_key, 'backfill' AS work_class, cursor, CASE WHEN ordinal % 2 = 0 THEN 5 END::INT AS max_pages FROM fan WHERE resource_key = 'comments'")
def comments_resync(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of the pages of comments, carried down from users through resources."""
    fan = flows.fan_out(_wide_users(spark, d), 2)
    return flows.comments_resync(flows.descend(fan, "resources"))


# ---- ordinary and round mode


NEED = f"""{FLOW_PAGES}, per AS (SELECT store_no, user_key, resource_key, count(*) AS n, min(seq) FILTER (failed) AS stop FROM fp GROUP BY ALL),
 nd AS (SELECT store_no, user_key, max((n + {SLICE - 1}) // {SLICE}) AS whole, min(stop // {SLICE}) + 1 AS until FROM per GROUP BY ALL),
 need AS (SELECT store_no, user_key, greatest(1, least(whole, until)) AS rounds, until IS NOT NULL AND until <= whole AS failed, substr(user_key, 6)::BIGINT AS ordinal FROM nd),
 q AS (SELECT *, row_number() OVER (PARTITION BY store_no ORDER BY ordinal) AS n FROM need)"""
ROUNDS = f"""WITH RECURSIVE {NEED}, s AS (SELECT DISTINCT store_no, 0::BIGINT AS n, [0, 0, 0, 0]::BIGINT[] AS ends, NULL::VARCHAR AS user_key, NULL::BIGINT AS ordinal, false AS failed, 0::BIGINT AS first_round, 0::BIGINT AS last_round FROM q
  UNION ALL SELECT q.store_no, q.n, list_sort(list_append(s.ends[2:], s.ends[1] + q.rounds)), q.user_key, q.ordinal, q.failed, s.ends[1], s.ends[1] + q.rounds - 1 FROM s JOIN q ON q.store_no = s.store_no AND q.n = s.n + 1)"""


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    need = flows.rounds_needed(_flow_pages(spark, d), SLICE)
    need = need.withColumn("ordinal", F.substring("user_key", 6, 20).cast("long"))
    return flows.schedule(need, 4)


@query(f"{ROUNDS} SELECT store_no, user_key, first_round, last_round, failed FROM s WHERE n > 0")
def round_schedule(spark: SparkSession, d: str) -> DataFrame:
    """First and last round of users of unequal lengths, four at a time."""
    return _rounds(spark, d).select("store_no", "user_key", "first_round", "last_round", "failed")


_SYNC_SQL = """SELECT store_no, sum(ok)::BIGINT AS users_completed, sum(bad)::BIGINT AS users_failed, sum(errors)::BIGINT AS error_count, max(part) + 1 AS {done},
  count(*) FILTER (bad > 0) AS remediation_count, CASE WHEN sum(errors) > 0 THEN 'partial' ELSE 'succeeded' END AS status FROM p GROUP BY store_no"""


def _round_users(spark: SparkSession, d: str) -> DataFrame:
    return _rounds(spark, d).withColumns({"status": F.when(F.col("failed"), "partial").otherwise("succeeded"), "error_count": F.when(F.col("failed"), F.col("ordinal") % 3).otherwise(0).cast("long"), "finished": ~F.col("failed")})


@query(f"{ROUNDS}, p AS (SELECT store_no, last_round AS part, count(*) FILTER (NOT failed) AS ok, count(*) FILTER (failed) AS bad, sum(CASE WHEN failed THEN greatest(ordinal % 3, 1) ELSE 0 END) AS errors FROM s WHERE n > 0 GROUP BY ALL) {_SYNC_SQL.format(done='rounds_completed')}")
def round_sync(spark: SparkSession, d: str) -> DataFrame:
    """Result of a sync in round mode: a failed user leaves with its round, which starts a remediation."""
    return longs(flows.sync_result(_round_users(spark, d), "round", "last_round"), "users_completed", "users_failed", "error_count")


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """Valid users on their listing's pages, with results where there are any."""
    u = flows.ordinary_pages(C.users(spark, d), 7).where("valid")
    k = F.col("ordinal")
    r = u.where(k % 11 != 0).select("store_no", "user_key", F.when(k % 5 == 0, "partial").otherwise("succeeded").alias("status"), F.when(k % 5 == 0, k % 4).otherwise(0).alias("error_count"), F.when(k % 6 == 0, F.lit(False)).when(k % 2 == 0, F.lit(True)).alias("finished"), F.when(k % 13 == 0, "Timeout").alias("exception"))
    return flows.batch_join(u, r, ["store_no", "user_key"])


JOINED = f"""{C.USERS}, up AS (SELECT *, (row_number() OVER (PARTITION BY store_no ORDER BY ordinal) - 1) // 7 AS user_page FROM users),
 jn AS (SELECT store_no, ordinal, user_key, user_page, CASE WHEN ordinal % 11 = 0 THEN 'MissingResult' WHEN ordinal % 13 = 0 THEN 'Timeout' END AS exception FROM up WHERE valid),
 joined AS (SELECT *, CASE WHEN exception IS NOT NULL THEN 'failed' WHEN ordinal % 5 = 0 THEN 'partial' ELSE 'succeeded' END AS status,
  CASE WHEN exception IS NOT NULL THEN 1 WHEN ordinal % 5 = 0 THEN ordinal % 4 ELSE 0 END AS error_count, exception IS NULL AND ordinal % 6 <> 0 AS finished FROM jn),
 judged AS (SELECT *, status <> 'succeeded' OR error_count > 0 OR NOT finished AS bad FROM joined)"""


@query(f"WITH {JOINED} SELECT store_no, user_key, user_page, exception, status, error_count, finished FROM joined")
def user_batch_join(spark: SparkSession, d: str) -> DataFrame:
    """Every user with its own result or failure."""
    return _joined(spark, d).select("store_no", "user_key", "user_page", "exception", "status", "error_count", "finished")


@query(f"WITH {JOINED}, p AS (SELECT store_no, user_page AS part, count(*) FILTER (NOT bad) AS ok, count(*) FILTER (bad) AS bad, sum(CASE WHEN bad THEN greatest(error_count, 1) ELSE 0 END) AS errors FROM judged GROUP BY ALL) {_SYNC_SQL.format(done='user_pages_completed')}")
def ordinary_sync(spark: SparkSession, d: str) -> DataFrame:
    """Result of a sync in ordinary mode: page by page of users, each page's failures in a remediation."""
    return longs(flows.sync_result(_joined(spark, d), "ordinary", "user_page"), "users_completed", "users_failed", "error_count")


@query(f"""WITH {JOINED}, {C.STORES}, f AS (SELECT store_no, user_page, array_to_string(list(user_key ORDER BY ordinal), '|') AS failed_user_keys FROM judged WHERE bad GROUP BY ALL)
 SELECT f.store_no, user_page AS partition, failed_user_keys, 'failed-user-remediation/' || {key_sql('store', text_sql('store_key'))} || '/' || lifecycle_generation || '/' || {key_sql('sync-sequence', "('[\"seq-1\",[\"ordinary\",' || user_page || ']]')")} AS remediation_id
 FROM f JOIN stores USING (store_no)""")
def remediation_starts(spark: SparkSession, d: str) -> DataFrame:
    """Detached remediations of an ordinary sync, one per page of users with failures."""
    s = C.stores(spark, d).select("store_no", "store_key", "lifecycle_generation")
    out = flows.remediation_starts(_joined(spark, d).join(s, "store_no"), "ordinary", "user_page", F.col("lifecycle_generation"), F.lit("seq-1"))
    return out.select("store_no", "partition", F.array_join("failed_user_keys", "|").alias("failed_user_keys"), "remediation_id")


@query(f"""WITH RECURSIVE {JOINED}, m AS (SELECT store_no, user_page AS ordinal, count(*) AS rounds FROM judged WHERE bad GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY store_no ORDER BY ordinal) AS n FROM m),
 s AS (SELECT DISTINCT store_no, 0::BIGINT AS n, [0, 0, 0, 0]::BIGINT[] AS ends, NULL::BIGINT AS partition, 0::BIGINT AS first_round, 0::BIGINT AS last_round FROM q
  UNION ALL SELECT q.store_no, q.n, list_sort(list_append(s.ends[2:], s.ends[1] + q.rounds)), q.ordinal, s.ends[1], s.ends[1] + q.rounds - 1 FROM s JOIN q ON q.store_no = s.store_no AND q.n = s.n + 1)
 SELECT store_no, partition, first_round, last_round FROM s WHERE n > 0""")
def remediation_throttle(spark: SparkSession, d: str) -> DataFrame:
    """Steps in which remediations begin and end, four at a time, a step for each user."""
    s = C.stores(spark, d).select("store_no", "store_key", "lifecycle_generation")
    m = flows.remediation_starts(_joined(spark, d).join(s, "store_no"), "ordinary", "user_page", F.col("lifecycle_generation"), F.lit("seq-1"))
    m = m.select("store_no", F.col("partition").alias("ordinal"), F.size("failed_user_keys").cast("long").alias("rounds"))
    return flows.throttled(m).select("store_no", F.col("ordinal").alias("partition"), "first_round", "last_round")


@query(f"WITH {C.USERS}, v AS (SELECT * FROM users WHERE valid) SELECT store_no, user_key, row_number() OVER (PARTITION BY store_no ORDER BY user_key) - 1 AS place FROM v")
def handle_order(spark: SparkSession, d: str) -> DataFrame:
    """Children that end together, by id."""
    return flows.wait_order(C.users(spark, d).where("valid").select("store_no", "user_key"), "store_no", "user_key")


@query("""SELECT 'op-' || o_orderkey AS operation_id, CASE WHEN o_orderkey % 7 = 0 THEN 'canceled' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
 CASE WHEN o_orderkey % 7 = 0 THEN 'canceled' WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'succeeded' END AS result_status,
 CASE WHEN o_orderkey % 7 = 0 THEN 'sync canceled' WHEN o_orderkey % 5 = 0 THEN 'StageError' END AS message FROM orders WHERE o_orderkey % 4 <> 1""")
def root_terminal(spark: SparkSession, d: str) -> DataFrame:
    """The status event that each run sends to its controller."""
    k = F.col("o_orderkey")
    runs = C.table(spark, d, "orders").select(F.concat(F.lit("op-"), k.cast("string")).alias("operation_id"), F.when(k % 4 != 1, "c").alias("controller"), (k % 7 == 0).alias("canceled"), F.when(k % 5 == 0, "StageError").alias("error"), F.when(k % 3 == 0, "partial").otherwise("succeeded").alias("result_status"))
    return flows.root_terminal(runs)


_PROGRESS = "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END"


@query(f"""WITH p AS (SELECT o_custkey % 25 AS store_no, o_orderkey, {_PROGRESS} AS state FROM orders)
 SELECT store_no, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'pending') AS pending, 'c' || max(o_orderkey) AS cursor,
 CASE WHEN count(*) FILTER (state = 'pending') > 0 THEN 'running' ELSE 'completed' END AS phase FROM p GROUP BY store_no""")
def progress_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Children completed, failed and pending of each store."""
    o = C.table(spark, d, "orders")
    rows = o.select((F.col("o_custkey") % 25).alias("store_no"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed").alias("state"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("cursor"), F.col("o_orderkey").alias("ordinal"))
    return flows.progress(rows, ["store_no"])


# ---- deactivation


_TRIALS = """t AS (SELECT c_custkey AS store_no, c_custkey % 4 AS expected_generation, c_custkey % 3 = 0 AS resume, CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_custkey % 19 = 0 THEN repeat('x', 600) END AS fence_error,
  c_custkey % 5 <> 0 AS fence_ack, c_custkey % 4 AS cancel_failures, c_custkey % 2 AS quota_failures, CASE WHEN c_custkey % 23 < 3 THEN 2 ELSE 0 END AS outstanding,
  CASE WHEN c_custkey % 29 = 0 THEN 'failed' ELSE 'succeeded' END AS cleanup_status, 'batch' AS cleanup_message, CASE WHEN c_custkey % 31 = 0 THEN 'rejected' ELSE 'succeeded' END AS remove_status, '' AS remove_message,
  CASE WHEN c_custkey % 37 = 0 THEN 'stale_generation' ELSE 'succeeded' END AS inactive_status, c_custkey % 7 <> 0 AS terminal_ack FROM customer)"""


@query(f"""WITH {_TRIALS}, w AS (SELECT *, list_filter([CASE WHEN NOT fence_ack THEN '{flows.NO_FENCE_ACK}' END, CASE WHEN cancel_failures > 0 THEN cancel_failures || ' owned cancellation request(s) failed' END,
  CASE WHEN quota_failures > 0 THEN quota_failures || ' quota invalidation signal(s) failed' END, CASE WHEN outstanding > 0 THEN 'drain timeout elapsed with ' || outstanding || ' operation(s) outstanding' END,
  CASE WHEN NOT terminal_ack THEN '{flows.NO_TERMINAL_ACK}' END], lambda x: x IS NOT NULL) AS warnings,
  CASE WHEN cleanup_status <> 'succeeded' THEN 'batch' WHEN remove_status <> 'succeeded' THEN 'object removal did not succeed' WHEN inactive_status <> 'succeeded' THEN 'marking the store inactive failed' END AS why FROM t)
 SELECT store_no, CASE WHEN fence_error IS NOT NULL OR why IS NOT NULL THEN 'failed' WHEN len(warnings) > 0 THEN 'partial' ELSE 'succeeded' END AS status,
  CASE WHEN fence_error IS NOT NULL OR why IS NOT NULL THEN 'failed' ELSE 'completed' END AS phase, expected_generation + CASE WHEN fence_error IS NULL AND NOT resume THEN 1 ELSE 0 END AS lifecycle_generation,
  CASE WHEN fence_error IS NOT NULL THEN CASE WHEN fence_error = '' THEN 'deactivation fence did not commit' ELSE left(fence_error, 500) END || CASE WHEN terminal_ack THEN '' ELSE '; {flows.NO_TERMINAL_ACK}' END
   WHEN why IS NOT NULL THEN why WHEN len(warnings) > 0 THEN left(array_to_string(warnings, '; '), 1000) END AS message,
  CASE WHEN fence_error IS NOT NULL THEN NULL WHEN cleanup_status <> 'succeeded' THEN 'drain_wait_finished' WHEN remove_status <> 'succeeded' THEN 'users_cleaned' WHEN inactive_status <> 'succeeded' THEN 'objects_removed' ELSE 'controller_terminal' END AS last_action,
  fence_error IS NULL AND why IS NOT NULL AS marked_failed FROM w""")
def deactivation_result(spark: SparkSession, d: str) -> DataFrame:
    """How deactivations end: clean, with warnings, failed before or after the fence."""
    k = F.col("c_custkey")
    ok = lambda n, bad: F.when(k % n == 0, bad).otherwise("succeeded")
    t = C.table(spark, d, "customer").select(
        k.alias("store_no"), (k % 4).alias("expected_generation"), (k % 3 == 0).alias("resume"), F.when(k % 17 == 0, "").when(k % 19 == 0, F.repeat(F.lit("x"), 600)).alias("fence_error"), (k % 5 != 0).alias("fence_ack"), (k % 4).alias("cancel_failures"), (k % 2).alias("quota_failures"), F.when(k % 23 < 3, 2).otherwise(0).alias("outstanding"),
        ok(29, "failed").alias("cleanup_status"), F.lit("batch").alias("cleanup_message"), ok(31, "rejected").alias("remove_status"), F.lit("").alias("remove_message"), ok(37, "stale_generation").alias("inactive_status"), (k % 7 != 0).alias("terminal_ack"),
    )
    return flows.deactivation(t)


@query("WITH f AS (SELECT l_suppkey % 25 AS store_no, l_partkey % 50 AS target, arg_min(l_linenumber % 3 = 0, l_orderkey * 10 + l_linenumber) AS failed FROM lineitem GROUP BY ALL) SELECT store_no, count(*) AS asked, count(*) FILTER (failed) AS failures FROM f GROUP BY store_no")
def cancel_requests(spark: SparkSession, d: str) -> DataFrame:
    """Distinct operations asked to stop, and those that couldn't be reached."""
    li = C.table(spark, d, "lineitem")
    return flows.request_failures(li.select((F.col("l_suppkey") % 25).alias("store_no"), (F.col("l_partkey") % 50).alias("target_id"), (F.col("l_linenumber") % 3 == 0).alias("failed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal")))


@query("WITH f AS (SELECT user_id % 25 AS store_no, 'user-' || user_id AS user_key, min(event_id) AS ordinal FROM events GROUP BY ALL) SELECT store_no, user_key, (row_number() OVER (PARTITION BY store_no ORDER BY ordinal, user_key) - 1) // 4 AS batch FROM f")
def cleanup_batches(spark: SparkSession, d: str) -> DataFrame:
    """Users to clean, each once, in batches of four."""
    e = C.table(spark, d, "events").select((F.col("user_id") % 25).alias("store_no"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_key"), F.col("event_id").alias("ordinal"))
    return flows.cleanup_batches(e, 4).select("store_no", "user_key", "batch")


# ---- fenced tables


@query(f"""WITH {INGESTED} SELECT store_no, ordinal, document_key, source_version, coalesce(content_hash, '') AS content_hash, lifecycle_generation - behind AS lifecycle_generation, mutation, status FROM ingested""")
def ingest_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of all mutations, echoing the declared hash and the command's generation."""
    return fence.mutation_results(_ingested(spark, d))


@query(f"WITH {C.STORES}, p AS (SELECT user_id % 25 AS store_no, 'k' || (event_id % 9) AS key, event_type || event_id AS value, event_id, (event_id % 4) AS g FROM events) SELECT p.store_no, key, arg_max(value, event_id) AS value FROM p JOIN stores s ON s.store_no = p.store_no AND lifecycle_generation = g WHERE lifecycle_state IN ('active', 'syncing') GROUP BY ALL")
def state_puts(spark: SparkSession, d: str) -> DataFrame:
    """Key-value state of stores after fenced puts."""
    i = F.col("event_id")
    puts = C.table(spark, d, "events").select((F.col("user_id") % 25).alias("store_no"), F.concat(F.lit("k"), (i % 9).cast("string")).alias("key"), F.concat("event_type", i.cast("string")).alias("value"), (i % 4).alias("expected_generation"), i.alias("ordinal"))
    return fence.put_state(puts, C.stores(spark, d))


@query(f"""WITH {C.STORES}, c AS (SELECT s.*, k.behind FROM stores s, (VALUES (0), (1)) k(behind))
 SELECT store_no, lifecycle_generation - behind AS expected_generation, CASE WHEN behind <> 0 THEN 'stale_generation' WHEN lifecycle_state <> 'deactivating' THEN 'rejected' ELSE 'succeeded' END AS status FROM c""")
def cleanup_fence(spark: SparkSession, d: str) -> DataFrame:
    """Cleanup is fenced by generation first, then by state."""
    s = C.stores(spark, d)
    c = s.select("store_no", F.explode(F.array(F.col("lifecycle_generation"), F.col("lifecycle_generation") - 1)).alias("expected_generation"))
    return fence.cleanup_fence(c, s)


@query("""WITH k AS (SELECT * FROM (VALUES ('begin'), ('resume'), ('mark_inactive'), ('mark_failed')) k(kind), (VALUES ('applied'), ('unchanged'), ('stale_generation'), ('rejected')) o(outcome))
 SELECT n_nationkey AS nation, kind, outcome, CASE WHEN outcome IN ('applied', 'unchanged') THEN CASE WHEN kind = 'mark_failed' THEN 'failed' ELSE 'succeeded' END
  WHEN kind LIKE 'mark%' AND outcome = 'stale_generation' THEN 'stale_generation' ELSE 'error:' || outcome END AS result FROM nation, k""")
def lifecycle_failures(spark: SparkSession, d: str) -> DataFrame:
    """What a lifecycle command reports for each outcome."""
    cases = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(o).alias("outcome")) for k in ("begin", "resume", "mark_inactive", "mark_failed") for o in ("applied", "unchanged", "stale_generation", "rejected")))
    n = C.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.explode(cases).alias("x")).select("nation", "x.*")
    return n.withColumn("result", fence.failure_of(F.col("kind"), F.col("outcome")))


# ---- requester


_WAITS = """rq AS (SELECT 'w' || (user_id % 20) AS requester, 'r' || (event_id // 6) AS request_id, event_id AS ordinal, 'scope-' || (event_id // 6 % 3) AS scope, 1 + event_id // 6 % 2 AS cost FROM events WHERE event_id % 6 IN (0, 3)),
 an AS (SELECT 'w' || (user_id % 20) AS requester, 'r' || (event_id // 6) AS request_id, event_id AS ordinal, CASE WHEN event_id % 6 = 5 THEN 'denied' ELSE 'granted' END AS kind, 'scope-' || ((event_id // 6 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) % 3) AS scope, 1 + event_id // 6 % 2 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS cost FROM events WHERE event_id % 6 IN (1, 4, 5)),
 ab AS (SELECT 'w' || (user_id % 20) AS requester, 'r' || (event_id // 6) AS request_id, event_id AS ordinal, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'canceled' END AS reason FROM events WHERE event_id % 6 = 2)"""


def _waits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = C.table(spark, d, "events")
    i = F.col("event_id")
    n = F.expr("event_id div 6")
    base = [F.concat(F.lit("w"), (F.col("user_id") % 20).cast("string")).alias("requester"), F.concat(F.lit("r"), n.cast("string")).alias("request_id"), i.alias("ordinal")]
    scope = lambda x: F.concat(F.lit("scope-"), (x % 3).cast("string")).alias("scope")
    rq = e.where((i % 6).isin(0, 3)).select(*base, scope(n), (1 + n % 2).alias("cost"))
    an = e.where((i % 6).isin(1, 4, 5)).select(*base, F.when(i % 6 == 5, "denied").otherwise("granted").alias("kind"), scope(n + F.when(i % 7 == 0, 1).otherwise(0)), (1 + n % 2 + F.when(i % 11 == 0, 1).otherwise(0)).alias("cost"), F.col("ts").alias("at"))
    ab = e.where(i % 6 == 2).select(*base, F.when(i % 4 == 0, "failed").otherwise("canceled").alias("reason"))
    return rq, an, ab


@query(f"""WITH {_WAITS}, f AS (SELECT *, row_number() OVER (PARTITION BY requester, request_id ORDER BY ordinal) = 1 AS expected FROM rq),
 a AS (SELECT f.requester, f.request_id, min(an.ordinal) AS ordinal, arg_min(an.kind, an.ordinal) AS kind FROM f JOIN an ON an.requester = f.requester AND an.request_id = f.request_id AND an.scope = f.scope AND an.ordinal > f.ordinal AND (an.kind = 'denied' OR an.cost = f.cost) WHERE expected GROUP BY ALL),
 x AS (SELECT requester, request_id, min(ordinal) AS ordinal, arg_min(reason, ordinal) AS reason FROM ab GROUP BY ALL),
 w AS (SELECT f.*, CASE WHEN x.ordinal > f.ordinal AND (a.ordinal IS NULL OR x.ordinal < a.ordinal) THEN x.reason ELSE coalesce(a.kind, 'waiting') END AS outcome, CASE WHEN x.ordinal > f.ordinal AND (a.ordinal IS NULL OR x.ordinal < a.ordinal) THEN x.ordinal ELSE a.ordinal END AS over
  FROM f LEFT JOIN a USING (requester, request_id) LEFT JOIN x USING (requester, request_id) WHERE expected)
 SELECT requester, request_id, ordinal, outcome FROM w UNION ALL SELECT f.requester, f.request_id, f.ordinal, CASE WHEN w.over < f.ordinal THEN 'already consumed' ELSE 'already waiting' END FROM f JOIN w USING (requester, request_id) WHERE NOT f.expected""")
def requester_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How waits for permits end: by the first exact answer, or early."""
    return requester.outcomes(*_waits(spark, d)).select("requester", "request_id", "ordinal", "outcome")


@query(f"""WITH d AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'granted' WHEN 1 THEN 'denied' WHEN 2 THEN 'canceled' ELSE 'failed' END AS outcome, event_id % 5 AS c, event_type FROM events)
 SELECT 'user-quota/' || {key_sql('quota-scope', "('\"p\"')", "('\"c' || c || '\"')", text_sql('event_type'))} AS coordinator, 'r' || event_id AS request_id, CASE outcome WHEN 'granted' THEN 'complete' ELSE 'cancel' END AS kind,
 CASE outcome WHEN 'canceled' THEN '{requester.REQUESTER}' WHEN 'failed' THEN '{requester.FAILED}' END AS reason FROM d WHERE outcome <> 'denied'""")
def requester_releases(spark: SparkSession, d: str) -> DataFrame:
    """Completions and cancellations, sent to the coordinator that the scope names."""
    i = F.col("event_id")
    done = C.table(spark, d, "events").select(F.concat(F.lit("r"), i.cast("string")).alias("request_id"), F.lit("p").alias("provider"), F.concat(F.lit("c"), (i % 5).cast("string")).alias("credential"), F.col("event_type").alias("quota_class"), F.element_at(F.array(*map(F.lit, ("granted", "denied", "canceled", "failed"))), (i % 4 + 1).cast("int")).alias("outcome"))
    return requester.releases(done)


@query("""WITH p AS (SELECT user_id, event_id // 2 AS r, min(epoch_us(ts)) FILTER (event_id % 2 = 0) AS a, min(epoch_us(ts)) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY ALL)
 SELECT 'scope-' || user_id AS scope, 'r' || r AS request_id, greatest(0, floor((b - a) / 1000)::BIGINT) AS wait_ms FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def quota_wait(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds from a request to its grant."""
    e = C.table(spark, d, "events").select(F.concat(F.lit("scope-"), F.col("user_id").cast("string")).alias("scope"), F.concat(F.lit("r"), F.expr("event_id div 2").cast("string")).alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") % 2).alias("g"))
    return requester.grant_waits(e.where("g = 0").withColumnRenamed("us", "requested_us"), e.where("g = 1").withColumnRenamed("us", "granted_us"))


_ORDER = """m AS (SELECT DISTINCT 'scope-' || user_id AS scope, 'r' || (event_id % 97) AS request_id FROM events WHERE event_type <> 'click'),
 o AS (SELECT 'scope-' || user_id AS scope, 'r' || (event_id % 97) AS request_id, min(event_id) AS first_at FROM events WHERE event_type <> 'view' GROUP BY ALL)"""


@query(f"WITH {_ORDER} SELECT scope, request_id, row_number() OVER (PARTITION BY scope ORDER BY first_at IS NULL, first_at, request_id) - 1 AS place FROM m LEFT JOIN o USING (scope, request_id)")
def quota_repaired_order(spark: SparkSession, d: str) -> DataFrame:
    """The queue's order after a repair: known places first, the rest by id.  Clicks are entries of no member, views members without one, the others both."""
    e = C.table(spark, d, "events").select(F.concat(F.lit("scope-"), F.col("user_id").cast("string")).alias("scope"), F.concat(F.lit("r"), (F.col("event_id") % 97).cast("string")).alias("request_id"), F.col("event_id").alias("ordinal"), "event_type")
    return quota.repaired_order(e.where("event_type <> 'view'"), e.where("event_type <> 'click'"))


@query("WITH f AS (SELECT 'scope-' || user_id AS scope, 'r' || (event_id % 97) AS request_id, min(event_id) AS ordinal FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ordinal DESC) - 1 AS place FROM f) SELECT * FROM n WHERE place < 10")
def quota_compaction(spark: SparkSession, d: str) -> DataFrame:
    """Ended requests that a scope still remembers after it is carried over."""
    e = C.table(spark, d, "events").select(F.concat(F.lit("scope-"), F.col("user_id").cast("string")).alias("scope"), F.concat(F.lit("r"), (F.col("event_id") % 97).cast("string")).alias("request_id"), F.col("event_id").alias("ordinal"))
    return quota.compacted_terminals(e, 10)


@query(f"WITH {C.QUOTA} SELECT scope, min(ordinal) AS started_by, 8::BIGINT AS configured_limit, 8::BIGINT AS remaining FROM requests GROUP BY scope")
def quota_started_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that requests start or find; the balance begins at the limit."""
    return quota.started_scopes(C.quota_requests(spark, d), F.lit(8))


# ---- ids and settings


_T = "CAST(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * c_custkey AS TIMESTAMP)"


@query(f"""WITH c AS (SELECT *, {key_sql('store', text_sql('c_name'))} AS s, {key_sql('sync-sequence', text_sql('c_mktsegment'))} AS q, {key_sql('user', "('\"u' || c_custkey || '\"')")} AS u, {key_sql('resource', "('\"files\"')")} AS r, c_custkey % 4 AS g FROM customer)
 SELECT c_custkey, 'store-controller/' || s AS store_controller, 'store-sync/' || s || '/' || g || '/' || q AS store_sync, 'user-sync/' || s || '/' || g || '/' || q || '/' || u AS user_sync, 'resource-sync/' || s || '/' || g || '/' || q || '/' || u || '/' || r AS resource_sync,
 'files-page/' || {key_sql('resource-workflow', "('\"resource-sync/' || s || '/' || g || '/' || q || '/' || u || '/' || r || '\"')")} || '/' || {key_sql('page', "c_custkey")} AS files_page,
 'document-ingest/' || s || '/' || g || '/' || {key_sql('document', text_sql("'d' || c_custkey"))} || '/' || {key_sql('source-version', "('\"v1\"')")} AS document_ingest,
 CASE WHEN c_custkey % 5 > 0 THEN 'store-deactivation/' || s || '/' || (c_custkey % 5 - 1) END AS store_deactivation,
 'user-quota/' || {key_sql('quota-scope', "('\"p\"')", text_sql('c_name'), "('\"reads\"')")} AS user_quota, 'permit/' || {key_sql('permit-reservation', "('\"r' || c_custkey || '\"')", "('\"initial\"')")} AS permit FROM c""")
def operation_ids(spark: SparkSession, d: str) -> DataFrame:
    """All kinds of composite ids."""
    j, k = keys.json_string, F.col("c_custkey")
    text = lambda prefix: j(F.concat(F.lit(prefix), k.cast("string")))
    store, seq, gen, user, files = j(F.col("c_name")), j(F.col("c_mktsegment")), k % 4, text("u"), j(F.lit("files"))
    c = C.spread(C.table(spark, d, "customer").select(k, "c_name", "c_mktsegment")).withColumn("resource_sync", keys.operation_id("resource-sync", store, gen, seq, user, files))
    return c.select(
        k, keys.operation_id("store-controller", store).alias("store_controller"), keys.operation_id("store-sync", store, gen, seq).alias("store_sync"), keys.operation_id("user-sync", store, gen, seq, user).alias("user_sync"), "resource_sync",
        keys.operation_id("files-page", j(F.col("resource_sync")), keys.json_number(k)).alias("files_page"), keys.operation_id("document-ingest", store, gen, text("d"), j(F.lit("v1"))).alias("document_ingest"), keys.operation_id("store-deactivation", store, k % 5 - 1).alias("store_deactivation"),
        keys.quota_coordinator_id(F.lit("p"), F.col("c_name"), F.lit("reads")).alias("user_quota"), keys.permit_id(F.concat(F.lit("r"), k.cast("string")), F.lit("initial")).alias("permit"),
    )


@query(f"""WITH c AS (SELECT *, {_T} AS t FROM customer) SELECT c_custkey, {key_sql('typed', "('{\"__bytes__\":\"' || replace(replace(to_base64(c_name::BLOB), '+', '-'), '/', '_') || '\"}')", "('{\"__enum__\":\"' || c_mktsegment || '\"}')",
 "('{\"__datetime__\":\"' || strftime(t, '%Y-%m-%dT%H:%M:%S') || '+00:00\"}')", "('{\"__datetime__\":\"' || strftime(t, '%Y-%m-%d') || '\"}')", "('{\"__dataclass__\":{\"a\":' || c_custkey || ',\"b\":\"x\"}}')")} AS typed FROM c""")
def typed_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of bytes, enumerations, times, dates and records, which are told from texts."""
    c = C.spread(C.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")).withColumn("t", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("c_custkey")))
    parts = [keys.json_bytes(F.col("c_name").cast("binary")), keys.json_enum(F.col("c_mktsegment")), keys.json_datetime(F.col("t")), keys.json_date(F.col("t")), keys.json_record({"b": keys.json_string(F.lit("x")), "a": keys.json_number(F.col("c_custkey"))})]
    return c.select("c_custkey", keys.opaque_key("typed", *parts).alias("typed"))


@query(f"""WITH {C.STORES}, c AS (SELECT c_custkey, s.*, c_custkey % 2 = 0 AS seq, c_custkey % 3 = 0 AS scoped FROM customer JOIN stores s ON s.store_no = c_nationkey)
 SELECT c_custkey, {key_sql('store', text_sql('store_key'))} AS store_key_hash, lifecycle_generation, 'sync' AS operation_type, 'accepted' AS current_phase, CASE WHEN seq THEN {key_sql('search-sync-sequence', "('\"q\"')")} END AS sync_sequence_hash,
 CASE WHEN scoped THEN 'p' END AS provider, CASE WHEN scoped THEN {key_sql('search-quota-scope', "('\"p\"')", "('\"cred\"')", "('\"reads\"')")} END AS quota_scope_hash, 'backfill' AS work_class FROM c""")
def search_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes by which operations are found."""
    c = C.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("store_no")).join(C.stores(spark, d), "store_no")
    k = F.col("c_custkey")
    a = keys.search_attributes(F.col("store_key"), F.col("lifecycle_generation"), F.lit("sync"), F.lit("accepted"), F.when(k % 2 == 0, "q"), F.when(k % 3 == 0, "p"), F.lit("cred"), F.lit("reads"), F.lit("backfill"))
    return c.select("c_custkey", *(v.alias(n) for n, v in a.items()))


_META = """CASE c_custkey % 8 WHEN 0 THEN MAP {'provider': 'p', 'credential_key': 'c', 'fairness_weight': '2.5'} WHEN 1 THEN MAP {'provider': 'p', 'credential_key': 'c', 'fairness_weight': 'x'} WHEN 2 THEN MAP {'provider': 'p', 'fairness_weight': 'x'} WHEN 3 THEN MAP {'mode': 'round', 'round_page_slice_size': '9'}
 WHEN 4 THEN MAP {'mode': 'never', 'user_page_size': '0'} WHEN 5 THEN MAP {'resource_types': ' a,,b ', 'user_page_size': '-1'} WHEN 6 THEN MAP {'priority_fairness_enabled': 'YES', 'provider_task_queue': 'mine', 'quota_class': 'w'} ELSE MAP {'provider': 'p', 'credential_key': 'c', 'fairness_weight': 'NaN', 'mode': 'x'} END"""


@query(f"""WITH m AS (SELECT c_custkey, {_META} AS m, c_custkey % 8 AS v FROM customer)
 SELECT c_custkey, CASE WHEN v = 0 THEN 'p/c/default/2.5' END AS scope, coalesce(m['mode'], 'ordinary') AS mode, CASE WHEN v = 5 THEN 'a|b' ELSE 'files' END AS resources, coalesce(try_cast(m['user_page_size'] AS BIGINT), 100) AS user_page_size, coalesce(try_cast(m['round_page_slice_size'] AS BIGINT), 5) AS round_page_slice_size, 20::BIGINT AS max_active_users,
 coalesce(m['provider_task_queue'], 'queue') AS queue, v = 6 AS priority, CASE v WHEN 1 THEN 'fairness_weight' WHEN 4 THEN 'mode' WHEN 5 THEN 'user_page_size' WHEN 7 THEN 'fairness_weight' END AS error FROM m""")
def sync_policy(spark: SparkSession, d: str) -> DataFrame:
    """A sync's settings from its string map, and the first that isn't valid."""
    cases = ({"provider": "p", "credential_key": "c", "fairness_weight": "2.5"}, {"provider": "p", "credential_key": "c", "fairness_weight": "x"}, {"provider": "p", "fairness_weight": "x"}, {"mode": "round", "round_page_slice_size": "9"}, {"mode": "never", "user_page_size": "0"}, {"resource_types": " a,,b ", "user_page_size": "-1"}, {"priority_fairness_enabled": "YES", "provider_task_queue": "mine", "quota_class": "w"}, {"provider": "p", "credential_key": "c", "fairness_weight": "NaN", "mode": "x"})
    maps = F.array(*(F.create_map(*(F.lit(x) for kv in c.items() for x in kv)) for c in cases))
    c = C.table(spark, d, "customer").select("c_custkey", F.element_at(maps, (F.col("c_custkey") % 8 + 1).cast("int")).alias("m"))
    p = policy.sync_policy(F.col("m"), "queue")
    scope = F.when((p["quota_scope"].isNotNull()) & (F.coalesce(p["error"], F.lit("")) != "fairness_weight"), F.concat_ws("/", p["quota_scope"]["provider"], p["quota_scope"]["credential_key"], p["quota_scope"]["quota_class"], p["quota_scope"]["fairness_weight"].cast("string")))
    return c.select("c_custkey", scope.alias("scope"), p["mode"].alias("mode"), F.array_join(p["resource_types"], "|").alias("resources"), p["user_page_size"].alias("user_page_size"), p["round_page_slice_size"].alias("round_page_slice_size"), p["max_active_users"].alias("max_active_users"), p["provider_task_queue"].alias("queue"), p["priority_fairness_enabled"].alias("priority"), p["error"].alias("error"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 7 END::BIGINT AS max_users, CASE c_custkey % 4 WHEN 0 THEN 300000 WHEN 1 THEN 1500 WHEN 2 THEN 120000 END::BIGINT AS drain_ms,
 CASE c_custkey % 5 WHEN 0 THEN 2.5 END::DOUBLE AS rps, CASE c_custkey % 5 WHEN 4 THEN NULL ELSE c_custkey % 5 = 1 END AS priority, CASE WHEN c_custkey % 2 = 0 THEN 'key' END AS api_key, CASE c_custkey % 7 WHEN 0 THEN false WHEN 1 THEN NULL ELSE c_custkey % 2 = 0 END AS tls, 'localhost:7233' AS address,
 array_to_string(list_filter([CASE WHEN c_custkey % 3 = 2 THEN 'store_sync_max_active_users' END, CASE WHEN c_custkey % 4 = 3 THEN 'deactivation_drain_timeout' END, CASE WHEN c_custkey % 5 = 4 THEN 'enable_priority_fairness' END, CASE WHEN c_custkey % 5 = 3 THEN 'provider_queue_rps' END, CASE WHEN c_custkey % 7 = 1 THEN 'tls' END], lambda x: x IS NOT NULL), '|') AS invalid FROM customer""")
def environment_settings(spark: SparkSession, d: str) -> DataFrame:
    """Typed settings from environment variables, and those that don't parse."""
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*(F.lit(x).cast("string") for x in v)), (k % n + 1).cast("int"))
    raw = {"APP_STORE_SYNC_MAX_ACTIVE_USERS": pick(3, " ", "7", "many"), "APP_DEACTIVATION_DRAIN_TIMEOUT": pick(4, None, " 1.5s ", "2M", "soon"), "APP_PROVIDER_QUEUE_RPS": pick(5, "2.5", None, "", "fast", " "), "APP_ENABLE_PRIORITY_FAIRNESS": pick(5, "", "On", None, "no", "maybe"), "APP_API_KEY": pick(2, "key", ""), "APP_TLS": pick(7, "off", "", None, None, None, None, None)}
    c = C.table(spark, d, "customer").select(k, F.map_filter(F.create_map(*(x for n, v in raw.items() for x in (F.lit(n), v))), lambda n, v: v.isNotNull()).alias("m"))
    e, n = policy.environment(F.col("m"), policy.ENVIRONMENT, "app_"), policy.environment(F.col("m"), policy.CONNECTION, "app_")
    return c.select(k, e["store_sync_max_active_users"].alias("max_users"), e["deactivation_drain_timeout"].alias("drain_ms"), e["provider_queue_rps"].alias("rps"), e["enable_priority_fairness"].alias("priority"), n["api_key"].alias("api_key"), n["tls"].alias("tls"), n["address"].alias("address"), F.array_join(F.concat(e["invalid"], n["invalid"]), "|").alias("invalid"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 2 = 0 AS enabled, c_custkey % 3 <> 0 AS sdk, c_custkey % 5 <> 0 AS server, CASE c_custkey % 4 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 1000 ELSE 1001 END AS w FROM customer), x AS (SELECT *, enabled AND sdk AND server AS active, w BETWEEN 0.001 AND 1000 AS ok FROM c)
 SELECT c_custkey, CASE WHEN NOT enabled THEN 'disabled_by_configuration' WHEN NOT sdk THEN 'disabled_unsupported_sdk' ELSE 'priority_and_fairness' END AS mode, CASE WHEN active AND ok THEN CASE WHEN c_custkey % 8 < 4 THEN 1 ELSE 4 END END::INT AS priority, CASE WHEN active AND ok THEN w END AS weight, NOT active OR ok AS weight_ok FROM x""")
def priority_capability(spark: SparkSession, d: str) -> DataFrame:
    """Priority metadata only where it is configured and supported."""
    k = F.col("c_custkey")
    w = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, 0.5).when(k % 4 == 2, 1000.0).otherwise(1001.0)
    m = policy.priority_metadata(k % 2 == 0, k % 3 != 0, k % 5 != 0, F.lit("cleanup"), k % 8 < 4, w)
    return C.table(spark, d, "customer").select(k, *(v.alias(n) for n, v in m.items()))


@query("SELECT c_custkey, c_name AS store_key, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 4 END AS lifecycle_generation, 500::BIGINT AS command_dedup_window_size, 300.0::DOUBLE AS deactivation_drain_timeout_seconds FROM customer")
def controller_start(spark: SparkSession, d: str) -> DataFrame:
    """The row that a command proposes for a controller that doesn't run yet."""
    k = F.col("c_custkey")
    row = controller.initial_row(F.col("c_name"), F.when(k % 3 != 0, k % 4), 500)
    return C.table(spark, d, "customer").select(k, *(v.alias(n) for n, v in row.items()))


# ---- provider and reports


_CALLS = "cl AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN 'quota_exhausted' WHEN 1 THEN 'auth_failure' ELSE 'success' END AS kind, CASE WHEN event_id % 3 <> 0 THEN 'scope-' || user_id END AS scope, CASE WHEN event_id % 8 = 0 THEN 10 END AS lim, CASE WHEN event_id % 16 = 0 THEN 3 END AS remaining FROM events)"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return C.table(spark, d, "events").select(
        F.concat(F.lit("r"), i.cast("string")).alias("request_id"), F.when(i % 4 == 0, "quota_exhausted").when(i % 4 == 1, "auth_failure").otherwise("success").alias("kind"), F.when(i % 3 != 0, F.concat(F.lit("scope-"), F.col("user_id").cast("string"))).alias("scope"), F.when(i % 8 == 0, 10).cast("long").alias("limit"), F.when(i % 16 == 0, 3).cast("long").alias("remaining"),
        F.when(i % 5 == 0, i * 10).alias("reset_us"), F.when(i % 7 == 0, 1.5).alias("retry_after_seconds"), F.lit("p").alias("provider"), (i % 2).cast("string").alias("quota_class"), F.col("event_type").alias("operation"),
    )


@query(f"""WITH {_CALLS}, x AS (SELECT *, CASE WHEN kind = 'success' THEN 'page' WHEN kind = 'quota_exhausted' AND scope IS NOT NULL THEN 'exhausted' ELSE 'failed' END AS status FROM cl)
 SELECT 'r' || event_id AS request_id, scope, status, status = 'exhausted' AS quota_exhausted, CASE WHEN status = 'exhausted' THEN lim END::BIGINT AS "limit", CASE WHEN status = 'exhausted' THEN coalesce(remaining, 0) END::BIGINT AS remaining, CASE WHEN status = 'exhausted' AND event_id % 5 = 0 THEN event_id * 10 END AS reset_us, CASE WHEN status = 'exhausted' AND event_id % 7 = 0 THEN 1.5 END::DOUBLE AS retry_after_seconds, status = 'exhausted' AS exhausted FROM x""")
def provider_observations(spark: SparkSession, d: str) -> DataFrame:
    """What provider calls tell of their quota."""
    return flows.observations_of(_calls(spark, d))


@query(f"WITH {_CALLS} SELECT 'p' AS provider, (event_id % 2)::VARCHAR AS quota_class, event_type AS operation, kind AS outcome, count(*) AS calls FROM cl GROUP BY ALL")
def provider_calls(spark: SparkSession, d: str) -> DataFrame:
    """Counts of provider calls."""
    return flows.provider_calls(_calls(spark, d).withColumnRenamed("kind", "outcome"))


@query("SELECT event_type, '{\"events\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}' AS report FROM events GROUP BY event_type")
def load_report(spark: SparkSession, d: str) -> DataFrame:
    """A JSON report of each kind of event."""
    e = C.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"))
    return flows.report(e, ["event_type"])
