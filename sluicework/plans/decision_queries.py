"""Queries of quota messages of one instant and of controller commands, each judged by the state that it finds; added to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import admission, commands, fence, quota
from . import carriers as C
from .flow_queries import key_sql, text_sql
from .registry import query

# ---- quota: scopes are customers, what they hold are their orders, messages are line items


def scopes(spark: SparkSession, d: str) -> DataFrame:
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    limit = F.when(b > 8000, F.lit(None)).otherwise(F.floor(F.abs(b) / 1000)).cast("long")
    at = F.floor(b * 1000).cast("long")
    return C.table(spark, d, "customer").select(k.alias("scope"), limit.alias("limit"), (limit - 1).alias("remaining"), F.when(b > 2000, at).alias("reset_us"), F.when(b < 5000, at + 1_500_000).alias("blocked_us"), (F.col("c_mktsegment") == "FURNITURE").alias("disabled"), F.concat(F.lit("w"), F.col("c_nationkey").cast("string")).alias("window_id"))


_SCOPES = """s0 AS (SELECT c_custkey AS scope, CASE WHEN c_acctbal > 8000 THEN NULL ELSE floor(abs(c_acctbal) / 1000)::BIGINT END AS lim, CASE WHEN c_acctbal > 2000 THEN floor(c_acctbal * 1000)::BIGINT END AS reset_us,
  CASE WHEN c_acctbal < 5000 THEN floor(c_acctbal * 1000)::BIGINT + 1500000 END AS blocked_us, c_mktsegment = 'FURNITURE' AS disabled, 'w' || c_nationkey AS window_id FROM customer)"""


def held(spark: SparkSession, d: str) -> DataFrame:
    o = C.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "reserved").otherwise("ended")
    return o.select(F.col("o_custkey").alias("scope"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("request_id"), status.alias("status"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("p-"), "o_orderpriority")).alias("permit_id"))


_HELD = "h AS (SELECT o_custkey AS scope, 'r' || o_orderkey AS request_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'reserved' ELSE 'ended' END AS status, CASE WHEN o_orderstatus = 'P' THEN 'p-' || o_orderpriority END AS permit_id FROM orders)"


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Line items of an order go to its customer's scope; many name the order itself, or their part, several times.

    An ordinal belongs to one order, so items of one ordinal are settled where their order's are, before they meet it.
    """
    k = F.col("l_orderkey")
    place = (k * 1000 + F.col("l_linenumber") * 100 + F.col("l_partkey") % 100).alias("ordinal")
    items = C.table(spark, d, "lineitem").select(k, place, "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag").repartition("l_orderkey")
    least = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")).alias("m")
    li = items.groupBy("l_orderkey", "ordinal").agg(least).select("l_orderkey", "ordinal", "m.*")
    o = C.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").repartition("o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.min("o_orderpriority").alias("o_orderpriority"))
    name = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("r"), k.cast("string"))).when(F.col("l_quantity") == 1, "").otherwise(F.concat(F.lit("part"), (F.col("l_partkey") % 5).cast("string")))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    return j.select(F.col("o_custkey").alias("scope"), "ordinal", name.alias("request_id"), "l_quantity", "l_linestatus", "l_returnflag", "o_orderpriority", "l_suppkey")


_MESSAGES = """m AS (SELECT o_custkey AS scope, l_orderkey * 1000 + l_linenumber * 100 + l_partkey % 100 AS ordinal, arg_min({'request_id': CASE WHEN l_returnflag = 'R' THEN 'r' || l_orderkey WHEN l_quantity = 1 THEN '' ELSE 'part' || (l_partkey % 5) END,
  'l_quantity': l_quantity, 'l_linestatus': l_linestatus, 'l_returnflag': l_returnflag, 'o_orderpriority': o_orderpriority, 'l_suppkey': l_suppkey}, (l_partkey, l_suppkey, l_quantity)) AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
 ms AS (SELECT scope, ordinal, x.request_id AS request_id, x.l_quantity AS q, x.l_linestatus AS ls, x.l_returnflag AS rf, x.o_orderpriority AS op, x.l_suppkey AS sk FROM m)"""


@query(f"""WITH {_SCOPES}, {_HELD}, {_MESSAGES}, j AS (SELECT ms.*, s0.disabled, EXISTS (SELECT 1 FROM h WHERE h.scope = ms.scope AND h.request_id = ms.request_id) AS known, (SELECT count(*) FROM h WHERE h.scope = ms.scope AND h.status = 'pending') AS waiting FROM ms LEFT JOIN s0 USING (scope)),
 k AS (SELECT *, CASE WHEN known THEN 'duplicate' WHEN request_id = '' THEN '{quota.EMPTY_ID}' WHEN q = 2 THEN '{quota.BAD_COST}' WHEN sk % 11 = 0 THEN '{quota.OTHER_SCOPE}' WHEN sk % 13 = 0 THEN '{quota.NO_REQUESTER}' WHEN disabled THEN '{quota.DISABLED}' END AS why FROM j),
 f AS (SELECT *, min(ordinal) FILTER (why IS NULL) OVER (PARTITION BY scope, request_id) AS first FROM k), o AS (SELECT *, sum((why IS NULL AND ordinal = first)::INT) OVER (PARTITION BY scope ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM f),
 p AS (SELECT scope, request_id, waiting + coalesce(ahead, 0) < 6 AS inside FROM o WHERE why IS NULL AND ordinal = first)
 SELECT scope, ordinal, o.request_id, CASE WHEN inside AND ordinal > first THEN 'duplicate' WHEN why IS NOT NULL THEN why WHEN inside THEN 'queued' ELSE '{quota.FULL}' END AS outcome FROM o LEFT JOIN p USING (scope, request_id)""")
def quota_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Requests of one instant against what each scope holds: duplicates, denials, places."""
    s = F.col("l_suppkey")
    asks = messages(spark, d).select("scope", "ordinal", "request_id", F.when(F.col("l_quantity") == 2, 0).otherwise(1).alias("cost"), (s % 11 == 0).alias("other_scope"), F.when(s % 13 == 0, "").otherwise("w").alias("requester"))
    return admission.enqueue(asks, held(spark, d), scopes(spark, d), 6).select("scope", "ordinal", "request_id", "outcome")


@query(f"""WITH {_HELD}, {_MESSAGES}, j AS (SELECT ms.*, h.status, row_number() OVER (PARTITION BY scope, request_id ORDER BY ordinal) > 1 AS again FROM ms LEFT JOIN h USING (scope, request_id)), k AS (SELECT *, request_id = '' OR coalesce(status = 'ended', false) OR again AS over_ FROM j)
 SELECT scope, ordinal, request_id, CASE WHEN over_ THEN 'ignored' WHEN ls = 'F' THEN 'undelivered' ELSE 'canceled' END AS outcome, CASE WHEN NOT over_ THEN status END AS freed FROM k""")
def quota_cancels(spark: SparkSession, d: str) -> DataFrame:
    """Cancellations and failed deliveries of one instant."""
    stops = messages(spark, d).select("scope", "ordinal", "request_id", F.when(F.col("l_linestatus") == "F", "undelivered").otherwise("cancel").alias("kind"))
    return admission.cancel(stops, held(spark, d)).select("scope", "ordinal", "request_id", "outcome", "freed")


@query(f"""WITH {_HELD}, {_MESSAGES}, j AS (SELECT ms.*, coalesce(h.permit_id = CASE WHEN ls = 'F' THEN 'p-' || op ELSE 'p-none' END AND h.status = 'reserved', false) AS fits FROM ms LEFT JOIN h USING (scope, request_id))
 SELECT scope, ordinal, request_id, CASE WHEN fits AND ordinal = min(ordinal) FILTER (fits) OVER (PARTITION BY scope, request_id) THEN 'completed' ELSE 'ignored' END AS outcome FROM j""")
def quota_completions(spark: SparkSession, d: str) -> DataFrame:
    """Completions of one instant: of their own permit, once."""
    ends = messages(spark, d).select("scope", "ordinal", "request_id", F.when(F.col("l_linestatus") == "F", F.concat(F.lit("p-"), "o_orderpriority")).otherwise("p-none").alias("permit_id"))
    return admission.complete(ends, held(spark, d)).select("scope", "ordinal", "request_id", "outcome")


@query(f"""WITH {_HELD}, {_SCOPES}, off AS (SELECT DISTINCT c_custkey AS scope FROM customer WHERE c_mktsegment = 'BUILDING')
 SELECT s0.scope, disabled OR off.scope IS NOT NULL AS disabled, count(h.scope) FILTER (status = 'pending' AND off.scope IS NOT NULL) AS refused, count(h.scope) FILTER (status = 'pending' AND off.scope IS NULL) AS waiting, count(h.scope) FILTER (status = 'reserved') AS permits
 FROM s0 LEFT JOIN off USING (scope) LEFT JOIN h ON h.scope = s0.scope GROUP BY ALL""")
def quota_disables(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that are disabled: what waits is refused, permits stay."""
    off = C.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("scope"))
    s, h = admission.disable(scopes(spark, d), held(spark, d), off)
    per = h.groupBy("scope").agg(F.count("answer").alias("refused"), F.count_if(F.col("status") == "pending").alias("waiting"), F.count_if(F.col("status") == "reserved").alias("permits"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return s.join(per, "scope", "left").select("scope", "disabled", n("refused"), n("waiting"), n("permits"))


_NOW = 5_000_000


@query(f"""WITH {_SCOPES}, b AS (SELECT *, CASE WHEN blocked_us <= {_NOW} AND reset_us > {_NOW} THEN reset_us ELSE blocked_us END AS b FROM s0),
 p AS (SELECT *, greatest(CASE WHEN b <= {_NOW} THEN b END, CASE WHEN reset_us <= {_NOW} THEN reset_us END) AS last FROM b),
 t AS (SELECT *, strftime(make_timestamp(last), '%Y-%m-%dT%H:%M:%S') || CASE WHEN (last % 1000000 + 1000000) % 1000000 = 0 THEN '' ELSE '.' || lpad(((last % 1000000 + 1000000) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS iso FROM p)
 SELECT scope, last IS NOT NULL AS advanced, CASE WHEN last IS NULL THEN window_id ELSE {key_sql('permit-reservation', text_sql('window_id'), text_sql('iso'))} END AS window_id, CASE WHEN last IS NULL THEN lim - 1 ELSE lim END AS remaining,
 CASE WHEN b > {_NOW} THEN b END AS blocked_us, CASE WHEN reset_us > {_NOW} THEN reset_us END AS reset_us, disabled OR coalesce(b > {_NOW}, false) AS stopped FROM t""")
def quota_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that have passed by five seconds, the next ones' ids, and which scopes grant nothing."""
    now = F.lit(_NOW).cast("long")
    return admission.advance(scopes(spark, d), now).select("scope", "advanced", "window_id", "remaining", "blocked_us", "reset_us", admission.blocked(F.col("disabled"), F.col("blocked_us"), now).alias("stopped"))


_KINDS = ("request", "cancel", "complete", "observe", "tick", "odd")


def quota_log(spark: SparkSession, d: str) -> DataFrame:
    """A scope's messages by the digits of ``events``; the first purchase of a user starts its scope."""
    e = C.table(spark, d, "events")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor("value").cast("int") % 6 + 1))
    start = e.where("event_type = 'purchase' and value > 20").groupBy(F.col("user_id").alias("_u")).agg(F.min("event_id").alias("_s"))
    j = e.join(start, F.col("user_id") == F.col("_u"), "left")
    return j.select(F.col("user_id").alias("scope"), F.col("event_id").alias("ordinal"), F.when(F.col("event_id") == F.col("_s"), "start").otherwise(kind).alias("kind"))


_LOG = f"""st AS (SELECT user_id, min(event_id) AS s FROM events WHERE event_type = 'purchase' AND value > 20 GROUP BY user_id),
 l AS (SELECT e.user_id AS scope, event_id AS ordinal, s, CASE WHEN event_id = s THEN 'start' ELSE {list(_KINDS)}[(floor(value)::INT % 6) + 1] END AS kind FROM events e LEFT JOIN st USING (user_id))"""


@query(f"""WITH {_LOG} SELECT scope, ordinal, kind, coalesce(ordinal < s, true) AS early, CASE WHEN s IS NOT NULL THEN greatest(ordinal, s) END AS handled_at,
 CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY scope ORDER BY greatest(ordinal, s), ordinal <> s, ordinal) - 1 END AS place FROM l""")
def quota_deferred(spark: SparkSession, d: str) -> DataFrame:
    """Messages before their scope's start wait for it."""
    return admission.deferred(quota_log(spark, d)).select("scope", "ordinal", "kind", "early", "handled_at", "place")


@query(f"""WITH {_LOG}, c AS (SELECT *, kind NOT IN ('start', 'tick', 'odd') AS counted FROM l)
 SELECT scope, ordinal, CASE kind WHEN 'request' THEN 'enqueue' WHEN 'tick' THEN 'advance' WHEN 'odd' THEN NULL ELSE kind END AS handler, coalesce(sum(counted::INT) OVER (PARTITION BY scope ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 10 AS run FROM c""")
def quota_runs(spark: SparkSession, d: str) -> DataFrame:
    """What handles each message, and the run of its scope that it falls into, ten counted messages long."""
    return admission.surface(admission.rollovers(quota_log(spark, d), 10)).select("scope", "ordinal", "handler", "run")


@query("""SELECT event_id, epoch_us(ts) + CASE WHEN event_type = 'view' THEN 0 ELSE -7200000000 * (event_type = 'click')::INT END AS utc_us, strftime(ts + to_microseconds(CASE WHEN event_type = 'click' THEN -7200000000 ELSE 0 END), '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS iso FROM events""")
def message_times(spark: SparkSession, d: str) -> DataFrame:
    """Times with and without a zone, compared in UTC."""
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "+02:00").otherwise("Z"))
    u = C.table(spark, d, "events").select("event_id", admission.utc_micros(text).alias("utc_us"))
    return u.withColumn("iso", admission.utc_iso(F.col("utc_us")))


# ---- controllers


def controllers(spark: SparkSession, d: str) -> DataFrame:
    """One controller per customer: its open orders are syncs, those in progress remediations."""
    o = C.table(spark, d, "orders")
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.concat(F.lit("op-"), F.col("o_orderkey").cast("string")))))
    work = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(ids((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 480000)).alias("syncs"), ids((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 485000)).alias("remediations"))
    b, empty = F.col("c_acctbal"), F.array().cast("array<string>")
    state = F.when(b < 1000, "deactivation_failed").when(b < 2500, "inactive").when(b < 4000, "deactivating").otherwise("active")
    c = C.table(spark, d, "customer").join(work, "c_custkey", "left").withColumns({"syncs": F.coalesce("syncs", empty), "remediations": F.coalesce("remediations", empty), "state": state})
    c = c.withColumn("state", F.when((F.col("state") == "active") & (F.size("syncs") + F.size("remediations") > 0), "syncing").otherwise(F.col("state")))
    return c.select(F.col("c_custkey"), F.col("c_name").alias("store_key"), (F.col("c_nationkey") % 4).cast("long").alias("lifecycle_generation"), "state", "syncs", "remediations", F.when((b >= 2500) & (b < 3500), F.lit("stop")).alias("deactivation"), (b < 3000).alias("fenced"), F.lit(None).cast("string").alias("seen_reply"), F.lit(None).cast("string").alias("seen_operation"))


def controller_messages(spark: SparkSession, d: str) -> DataFrame:
    """What orders say to their customer's controller, by priority, price and status."""
    p, x = F.col("o_totalprice"), F.substring("o_orderpriority", 1, 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("request_sync", "cancel_sync", "start_deactivation", "operation_status", "remediation_started"))), x)
    kind = F.when((x == 5) & (p > 250000), "deactivation_fenced").when((x == 4) & (p < 100000), "remediation_finished").otherwise(kind)
    c = controllers(spark, d)
    j = c.join(C.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    g, cents = F.col("lifecycle_generation"), F.floor(p).cast("long")
    return j.select(
        *c.columns, F.col("o_orderkey").alias("ordinal"), kind.alias("kind"), F.when(cents % 17 == 0, "elsewhere").otherwise(F.col("store_key")).alias("store"), F.when(cents % 19 == 0, " ").otherwise("cmd").alias("command_id"), (g - F.when(cents % 3 == 0, 1).otherwise(0)).alias("expected_generation"),
        F.when(cents % 23 == 0, "").otherwise(F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("sync_sequence"), F.when(cents % 5 == 0, "stop").when(cents % 29 == 0, "").otherwise(F.concat(F.lit("op-"), F.col("o_orderkey").cast("string"))).alias("operation"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.when(cents % 2 == 0, "succeeded").otherwise("failed").alias("result_status"), (g + cents % 3 - 1).alias("event_generation"), (cents % 31 != 0).alias("settings_ok"),
    )


_CONTROLLERS = f"""w AS (SELECT o_custkey, list('op-' || o_orderkey) FILTER (o_orderstatus = 'O' AND o_totalprice > 480000) AS syncs, list('op-' || o_orderkey) FILTER (o_orderstatus = 'P' AND o_totalprice > 485000) AS rems FROM orders GROUP BY o_custkey),
 c AS (SELECT c_custkey, c_name AS store_key, c_nationkey % 4 AS g, coalesce(syncs, []) AS syncs, coalesce(rems, []) AS rems, CASE WHEN c_acctbal >= 2500 AND c_acctbal < 3500 THEN 'stop' END AS stopping, c_acctbal < 3000 AS fenced,
  CASE WHEN c_acctbal < 1000 THEN 'deactivation_failed' WHEN c_acctbal < 2500 THEN 'inactive' WHEN c_acctbal < 4000 THEN 'deactivating' WHEN syncs IS NULL AND rems IS NULL THEN 'active' ELSE 'syncing' END AS state FROM customer LEFT JOIN w ON o_custkey = c_custkey),
 x AS (SELECT c.*, o_orderkey, floor(o_totalprice)::BIGINT AS cents, o_totalprice AS p, o_orderstatus, left(o_orderpriority, 1)::INT AS pr FROM c JOIN orders ON o_custkey = c_custkey),
 y AS (SELECT *, CASE WHEN pr = 5 AND p > 250000 THEN 'deactivation_fenced' WHEN pr = 4 AND p < 100000 THEN 'remediation_finished' ELSE ['request_sync', 'cancel_sync', 'start_deactivation', 'operation_status', 'remediation_started'][pr] END AS kind, g - (cents % 3 = 0)::INT AS e,
  CASE WHEN cents % 5 = 0 THEN 'stop' WHEN cents % 29 = 0 THEN '' ELSE 'op-' || o_orderkey END AS op, g + cents % 3 - 1 AS eg, o_orderstatus <> 'O' AS over_ FROM x),
 v AS (SELECT *, CASE WHEN kind NOT IN ('request_sync', 'cancel_sync', 'start_deactivation') THEN NULL WHEN cents % 17 = 0 THEN 'WrongStore' WHEN cents % 19 = 0 THEN 'InvalidCommand' WHEN kind <> 'cancel_sync' AND e < 0 THEN 'InvalidCommand' WHEN kind = 'request_sync' AND cents % 23 = 0 THEN 'InvalidSyncCommand'
  WHEN kind = 'cancel_sync' AND op = '' THEN 'InvalidCancelCommand' END AS bad, list_contains(syncs, op) AS in_s, list_contains(rems, op) AS in_r, kind IN ('operation_status', 'remediation_finished') AND over_ AS fin, stopping IS NOT NULL AND op = 'stop' AND eg >= g AS fences,
  state IN ('deactivating', 'inactive', 'deactivation_failed') AS stopped FROM y),
 r AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad
  WHEN kind = 'request_sync' THEN CASE WHEN e <> g THEN 'StaleLifecycleGeneration' WHEN stopping IS NOT NULL OR stopped THEN 'StoreNotSyncable' WHEN len(syncs) > 0 THEN 'SyncAlreadyRunning' WHEN len(rems) > 0 THEN 'RemediationAlreadyRunning' WHEN cents % 31 = 0 THEN 'InvalidSyncCommand' ELSE 'accepted' END
  WHEN kind = 'cancel_sync' THEN CASE WHEN in_s THEN 'accepted' ELSE 'sync is not active' END
  WHEN kind = 'start_deactivation' THEN CASE WHEN stopping IS NOT NULL THEN 'accepted' WHEN state = 'inactive' AND e IN (g, g - 1) THEN 'completed' WHEN state = 'deactivation_failed' AND e = g - 1 THEN 'failed' WHEN e <> g THEN 'StaleLifecycleGeneration' ELSE 'accepted' END
  WHEN kind = 'remediation_started' THEN CASE WHEN NOT in_r AND stopped THEN 'canceled' ELSE 'noted' END WHEN kind = 'deactivation_fenced' THEN CASE WHEN fences THEN 'noted' ELSE 'ignored' END
  WHEN kind = 'remediation_finished' AND NOT over_ THEN 'ignored' WHEN fin AND (in_s OR in_r) AND stopping IS NOT NULL THEN 'drained' ELSE 'noted' END AS reply,
  len(syncs) + len(rems) - CASE WHEN fin THEN in_s::INT + in_r::INT ELSE 0 END > 0 AS left_ FROM v)"""


@query(f"""WITH {_CONTROLLERS} SELECT store_key, o_orderkey AS ordinal, kind, reply, bad IS NULL AND kind = 'start_deactivation' AND (stopping IS NOT NULL OR reply IN ('completed', 'failed')) AS duplicate,
 CASE WHEN bad IS NOT NULL THEN NULL WHEN kind = 'request_sync' THEN CASE WHEN reply = 'accepted' THEN 'store-sync/' || {key_sql('store', text_sql('store_key'))} || '/' || g || '/' || {key_sql('sync-sequence', text_sql("('s' || o_orderkey)"))} END
  WHEN kind = 'start_deactivation' THEN CASE WHEN stopping IS NOT NULL THEN stopping WHEN reply IN ('accepted', 'completed', 'failed') THEN 'store-deactivation/' || {key_sql('store', text_sql('store_key'))} || '/' || CASE WHEN reply = 'accepted' AND state NOT IN ('deactivating', 'deactivation_failed') THEN e + 1 ELSE g END END ELSE op END AS operation_id,
 CASE WHEN bad IS NOT NULL THEN state WHEN kind = 'request_sync' THEN CASE WHEN reply = 'accepted' THEN 'syncing' ELSE state END WHEN kind = 'start_deactivation' THEN CASE WHEN stopping IS NULL AND reply = 'accepted' THEN 'deactivating' ELSE state END
  WHEN kind = 'remediation_started' THEN CASE WHEN state = 'active' AND NOT in_r THEN 'syncing' ELSE state END WHEN kind = 'deactivation_fenced' THEN CASE WHEN fences THEN 'deactivating' ELSE state END
  WHEN kind = 'operation_status' OR fin THEN CASE WHEN fin AND stopping IS NOT NULL AND op = 'stop' THEN CASE WHEN fenced OR eg > g THEN CASE WHEN cents % 2 = 0 THEN 'inactive' ELSE 'deactivation_failed' END WHEN left_ THEN 'syncing' ELSE 'active' END WHEN state = 'syncing' AND NOT left_ THEN 'active' ELSE state END ELSE state END AS new_state,
 CASE WHEN kind = 'deactivation_fenced' AND fences THEN eg WHEN fin AND stopping IS NOT NULL AND op = 'stop' AND (fenced OR eg > g) THEN greatest(g, eg) ELSE g END AS new_generation FROM r""")
def controller_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What each command and event does to the controller that it finds."""
    return commands.decided(controller_messages(spark, d)).select("store_key", "ordinal", "kind", "reply", "duplicate", "operation_id", "new_state", "new_generation")


@query(f"""WITH {_CONTROLLERS} SELECT store_key, len(syncs) AS syncs, len(rems) AS remediations, n_nationkey % 5 AS lifecycle_generation, CASE WHEN c_acctbal >= 5000 THEN CASE WHEN len(syncs) + len(rems) > 0 THEN 'syncing' ELSE 'active' END ELSE 'inactive' END AS state
 FROM c JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey""")
def controller_bootstraps(spark: SparkSession, d: str) -> DataFrame:
    """Controllers that start anew with the authority."""
    c = controllers(spark, d).join(C.table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("long").alias("authority_generation"), F.when(F.col("c_acctbal") >= 5000, "active").otherwise("inactive").alias("authority_state")), "c_custkey")
    return commands.bootstrapped(c).select("store_key", F.size("syncs").cast("long").alias("syncs"), F.size("remediations").cast("long").alias("remediations"), "lifecycle_generation", "state")


# ---- stores, state, defaults


@query("""SELECT n_nationkey::BIGINT AS store_no, CASE WHEN n_regionkey = 4 THEN 'active' ELSE ['active','syncing','deactivating','inactive','deactivation_failed'][n_nationkey % 5 + 1] END AS lifecycle_state, CASE WHEN n_regionkey = 4 THEN 0 ELSE n_nationkey % 4 END::BIGINT AS lifecycle_generation FROM nation
 UNION ALL SELECT DISTINCT 100 + c_custkey % 25, 'active', 0::BIGINT FROM customer WHERE c_acctbal > 9000""")
def ensured_stores(spark: SparkSession, d: str) -> DataFrame:
    """Stores that are asked for: those that are known stay as they are, new ones begin."""
    known = C.stores(spark, d).join(C.table(spark, d, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").cast("long").alias("store_no")), "store_no", "left_semi").select("store_no", "lifecycle_state", "lifecycle_generation")
    asked = C.stores(spark, d).select("store_no").unionByName(C.table(spark, d, "customer").where("c_acctbal > 9000").select((100 + F.col("c_custkey") % 25).alias("store_no"))).distinct()
    return fence.ensure_stores(known, asked.select("store_no", F.lit("active").alias("lifecycle_state"), F.lit(0).cast("long").alias("lifecycle_generation")))


@query(f"""WITH {C.STORES}, t AS (SELECT o_custkey % 25 AS store_no, o_orderpriority AS key, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS value FROM orders GROUP BY ALL)
 SELECT t.store_no, key, value::VARCHAR AS value FROM t JOIN stores USING (store_no) WHERE lifecycle_state <> 'deactivating' OR (SELECT s_acctbal < 0 FROM supplier WHERE s_suppkey = t.store_no) IS TRUE""")
def cleared_states(spark: SparkSession, d: str) -> DataFrame:
    """State that is left after removals; some removals name the generation before."""
    s = C.stores(spark, d)
    state = C.table(spark, d, "orders").groupBy((F.col("o_custkey") % 25).alias("store_no"), F.col("o_orderpriority").alias("key")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).cast("string").alias("value"))
    late = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_no"), (F.col("s_acctbal") < 0).alias("_late"))
    removals = s.join(late, "store_no", "left").select("store_no", (F.col("lifecycle_generation") - F.coalesce(F.col("_late"), F.lit(False)).cast("int")).alias("expected_generation"))
    return fence.cleared_state(state, removals, s)


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'mode=ordinary|user_page_size=100' WHEN c_acctbal < 0 THEN 'mode=round|user_page_size=100' ELSE 'extra=' || c_nationkey || '|mode=ordinary|user_page_size=' || c_nationkey END AS settings FROM customer""")
def settings_over_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A client's defaults under what each caller gives."""
    n = F.col("c_nationkey").cast("string")
    given = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).when(F.col("c_acctbal") < 0, F.create_map(F.lit("mode"), F.lit("round"))).otherwise(F.create_map(F.lit("user_page_size"), n, F.lit("extra"), n))
    entries = F.array_sort(F.map_entries(policy.defaults_under({"user_page_size": "100", "mode": "ordinary"}, given)))
    return C.table(spark, d, "customer").select("c_custkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("settings"))
