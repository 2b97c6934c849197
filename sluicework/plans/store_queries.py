"""Queries of authorities in time, staged bodies, exact percentiles and sums, and concurrency; added to the registry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, authority, staging
from ..session import checkpoint_dir
from ..sources import histories
from ..streaming.repository import Repository
from . import carriers as C
from .registry import query

# ---- authorities in time


def known_stores(spark: SparkSession, d: str) -> DataFrame:
    """The stores that are there before the log: those of region 4 are ensured by it."""
    n = C.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("store_no"), "n_regionkey")
    return C.stores(spark, d).join(n.where("n_regionkey <> 4").select("store_no"), "store_no", "left_semi")


def lifecycle_log(spark: SparkSession, d: str) -> DataFrame:
    """Lifecycle commands from ``customer``: the kind by segment and balance; a third names another generation than the one to be ended."""
    c, s = C.table(spark, d, "customer"), C.stores(spark, d)
    b = F.col("c_acctbal")
    kind = F.when(F.col("c_mktsegment") == "FURNITURE", "ensure").when(F.col("c_mktsegment") == "AUTOMOBILE", "resume").when(F.col("c_mktsegment") == "MACHINERY", "mark_failed").when(b > 6000, F.when(F.col("c_mktsegment") == "HOUSEHOLD", "mark_inactive").otherwise("begin")).otherwise("resume")
    log = c.select(F.col("c_nationkey").cast("long").alias("store_no"), F.col("c_custkey").alias("ordinal"), kind.alias("kind"), b.alias("_b")).join(s.withColumnRenamed("lifecycle_generation", "_g"), "store_no")
    after = F.when((F.col("kind") != "begin") & F.col("lifecycle_state").isin("active", "syncing"), 1).otherwise(0)
    return log.select("store_no", "ordinal", "kind", (F.col("_g") + after - F.when(F.col("_b") < 2500, 1).otherwise(0)).alias("expected_generation"), F.when(F.col("kind") == "ensure", F.lit("active")).alias("ensured_state"), F.when(F.col("kind") == "ensure", F.col("_g")).alias("ensured_generation"))


_OUT = """CASE WHEN state IS NULL THEN 'failed'
  WHEN q.kind = 'begin' AND gen = e + 1 AND state IN ('deactivating', 'inactive', 'deactivation_failed') THEN 'unchanged' WHEN gen <> e THEN 'stale_generation'
  WHEN q.kind = 'begin' THEN CASE WHEN state IN ('active', 'syncing') THEN 'applied' ELSE 'rejected' END
  WHEN q.kind = 'resume' THEN CASE WHEN e <= 0 THEN 'rejected' WHEN state = 'deactivation_failed' THEN 'applied' WHEN state = 'deactivating' THEN 'unchanged' ELSE 'rejected' END
  WHEN state = to_ THEN 'unchanged' WHEN state = 'deactivating' THEN 'applied' ELSE 'rejected' END"""

#: Each store's log, one command after the other.
AUTHORITY = f"""{C.STORES}, known AS (SELECT store_no, CASE WHEN n_regionkey <> 4 THEN lifecycle_state END AS state, CASE WHEN n_regionkey <> 4 THEN lifecycle_generation END AS gen FROM stores JOIN nation ON n_nationkey = store_no),
 c0 AS (SELECT c_nationkey::BIGINT AS store_no, c_custkey AS ordinal, c_acctbal AS b, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'ensure' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'resume' WHEN c_mktsegment = 'MACHINERY' THEN 'mark_failed'
  WHEN c_acctbal <= 6000 THEN 'resume' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'mark_inactive' ELSE 'begin' END AS kind FROM customer),
 c1 AS (SELECT c0.*, lifecycle_generation AS g0, lifecycle_generation + CASE WHEN kind <> 'begin' AND lifecycle_state IN ('active', 'syncing') THEN 1 ELSE 0 END - CASE WHEN b < 2500 THEN 1 ELSE 0 END AS e,
  CASE kind WHEN 'begin' THEN 'deactivating' WHEN 'resume' THEN 'deactivating' WHEN 'mark_inactive' THEN 'inactive' WHEN 'mark_failed' THEN 'deactivation_failed' END AS to_,
  row_number() OVER (PARTITION BY store_no ORDER BY ordinal) AS n FROM c0 JOIN stores USING (store_no)),
 run AS (SELECT store_no, 0::BIGINT AS n, -1::BIGINT AS ordinal, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, state, gen FROM known
  UNION ALL SELECT q.store_no, q.n, q.ordinal, q.kind, {_OUT}, CASE WHEN q.kind = 'ensure' THEN coalesce(state, 'active') WHEN {_OUT} = 'applied' THEN to_ ELSE state END,
   CASE WHEN q.kind = 'ensure' THEN coalesce(gen, g0) WHEN q.kind = 'begin' AND {_OUT} = 'applied' THEN gen + 1 ELSE gen END
  FROM run r JOIN c1 q ON q.store_no = r.store_no AND q.n = r.n + 1)"""


@query(f"WITH RECURSIVE {AUTHORITY} SELECT store_no, ordinal, kind, outcome, state AS new_state, gen AS new_generation FROM run WHERE n > 0 AND kind <> 'ensure'")
def lifecycle_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What each lifecycle command of the log does, judged by the authority that it finds."""
    out = authority.command_outcomes(lifecycle_log(spark, d), known_stores(spark, d))
    return out.select("store_no", "ordinal", "kind", "outcome", "new_state", "new_generation")


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 250 documents: key by hundreds of characters, so that some pages name one key and version twice; short
    texts aren't staged, some long ones have changed since they were listed; deletions where no language is known or the text is long."""
    n, i = F.col("n_chars"), F.col("doc_id")
    return C.table(spark, d, "documents").select(
        (i % 25).alias("store_no"), i.alias("ordinal"), F.expr("doc_id div 250").alias("page_no"), F.concat(F.col("source"), F.lit("/"), F.expr("cast(n_chars div 100 as string)")).alias("document_key"), F.concat(F.lit("v"), (n % 2).cast("string")).alias("source_version"),
        F.when(n > 4000, "delete").otherwise("upsert").alias("mutation"), F.concat(F.lit("staged/"), i.cast("string")).alias("staging_uri"), F.sha2(F.when(n % 10 == 3, F.upper("text")).otherwise(F.col("text")), 256).alias("content_hash"), (n % 3).alias("_late"),
    )


def staged_bodies(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "documents").where("n_chars >= 120").select(F.concat(F.lit("staged/"), F.col("doc_id").cast("string")).alias("staging_uri"), F.col("text").alias("body"))


def manifest_ingest(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d).join(C.stores(spark, d).select("store_no", "lifecycle_generation"), "store_no")
    m = m.withColumn("expected_generation", F.col("lifecycle_generation") + F.when(F.col("_late") == 0, 1).otherwise(0)).drop("lifecycle_generation", "_late")
    return staging.ingest_manifest(m, staged_bodies(spark, d), lifecycle_log(spark, d), known_stores(spark, d), ["store_no", "page_no"])


#: Entries with the state of their store at their place.
MANIFEST = f"""{AUTHORITY}, m0 AS (SELECT doc_id % 25 AS store_no, doc_id AS ordinal, doc_id // 250 AS page_no, source || '/' || (n_chars // 100) AS document_key, 'v' || (n_chars % 2) AS source_version,
  CASE WHEN n_chars > 4000 THEN 'delete' ELSE 'upsert' END AS mutation, sha256(CASE WHEN n_chars % 10 = 3 THEN upper(text) ELSE text END) AS content_hash, n_chars % 3 = 0 AS late, CASE WHEN n_chars >= 120 THEN text END AS body FROM documents),
 m1 AS (SELECT m0.*, lifecycle_generation + late::INT AS e, row_number() OVER (PARTITION BY store_no, page_no, document_key, source_version, mutation ORDER BY ordinal) > 1 AS again FROM m0 JOIN stores USING (store_no)),
 m2 AS (SELECT m1.*, run.state, run.gen FROM m1 ASOF JOIN run ON run.store_no = m1.store_no AND m1.ordinal >= run.ordinal),
 m3 AS (SELECT *, CASE WHEN again THEN 'duplicate' WHEN mutation = 'upsert' AND body IS NULL THEN 'failed' WHEN mutation = 'upsert' AND sha256(body) <> content_hash THEN 'rejected'
  WHEN state IS NULL THEN 'failed' WHEN gen <> e THEN 'stale_generation' WHEN state NOT IN ('active', 'syncing') THEN 'rejected' ELSE 'succeeded' END AS status FROM m2)"""


@query(f"""WITH RECURSIVE {MANIFEST} SELECT store_no, ordinal, document_key, mutation, status, strlen(body) AS body_bytes,
 CASE WHEN again THEN NULL WHEN mutation = 'upsert' AND body IS NULL THEN '{staging.NO_BODY}' WHEN mutation = 'upsert' AND sha256(body) <> content_hash THEN '{staging.BAD_HASH}'
  WHEN state IS NULL THEN 'KeyError' WHEN gen <> e THEN 'expected generation ' || e || ', found ' || gen WHEN state NOT IN ('active', 'syncing') THEN 'store state ' || state || ' rejects retrieval writes' END AS message FROM m3""")
def staged_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Every manifest entry: duplicates of a page, missing and changed bodies, and the fence as of the entry."""
    return manifest_ingest(spark, d).select("store_no", "ordinal", "document_key", "mutation", "status", "body_bytes", "message")


# ---- the repository


def repository_log(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's entries and the lifecycle commands, activations and settings from ``orders``, removals from ``supplier``."""
    s = C.stores(spark, d).select("store_no", F.col("lifecycle_generation").alias("_g"), F.col("lifecycle_state").isin("active", "syncing").cast("int").alias("_open"))
    m = staging.checked(manifest(spark, d), staged_bodies(spark, d)).join(s, "store_no").withColumn("expected_generation", F.col("_g") + F.when(F.col("_late") == 0, 1).otherwise(0))
    o = C.table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("store_no"), F.expr("o_orderkey div 10").alias("ordinal"), "o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus").join(s, "store_no")
    late = F.col("_g") + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    acts = o.select("store_no", "ordinal", F.lit("activate_user").alias("kind"), late.alias("expected_generation"), F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_key"))
    # the last of an instant's settings is the one of the greatest order
    puts = o.groupBy("store_no", "ordinal", F.col("o_orderpriority").alias("key"), late.alias("expected_generation")).agg(F.max("o_orderkey").cast("string").alias("value")).withColumn("kind", F.lit("put_state"))
    removals = C.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("store_no"), (F.col("s_suppkey") * 9).alias("ordinal"), F.lit("remove_objects").alias("kind")).join(s, "store_no").withColumn("expected_generation", F.col("_g") + F.col("_open"))
    out = lifecycle_log(spark, d)
    for x in (m.withColumn("kind", F.col("mutation")), acts, puts, removals):
        out = out.unionByName(x, allowMissingColumns=True)
    return out


@query(f"""WITH RECURSIVE {MANIFEST}, ends AS (SELECT store_no, arg_max(state, n) AS lifecycle_state, arg_max(gen, n) AS lifecycle_generation FROM (SELECT * FROM run WHERE state IS NOT NULL) GROUP BY store_no),
 w AS (SELECT o_custkey % 25 AS store_no, o_orderkey // 10 AS ordinal, o_custkey, o_orderpriority, o_orderkey, lifecycle_generation + (o_orderstatus = 'F')::INT AS e FROM orders JOIN stores ON stores.store_no = o_custkey % 25),
 ok AS (SELECT w.* FROM w ASOF JOIN run ON run.store_no = w.store_no AND w.ordinal >= run.ordinal WHERE gen = e AND state IN ('active', 'syncing')),
 rem AS (SELECT s_nationkey::BIGINT AS store_no, s_suppkey * 9 AS ordinal, lifecycle_generation + (lifecycle_state IN ('active', 'syncing'))::INT AS e FROM supplier JOIN stores ON store_no = s_nationkey),
 purge AS (SELECT rem.store_no, max(rem.ordinal) AS p FROM rem ASOF JOIN run ON run.store_no = rem.store_no AND rem.ordinal >= run.ordinal WHERE gen = e AND state = 'deactivating' GROUP BY rem.store_no),
 own AS (SELECT *, CASE WHEN again AND status = 'duplicate' THEN CASE WHEN mutation = 'upsert' AND (body IS NULL OR sha256(body) <> content_hash) THEN 'bad' WHEN state IS NULL OR gen <> e OR state NOT IN ('active', 'syncing') THEN 'bad' ELSE 'succeeded' END ELSE status END AS judged FROM m3),
 docs AS (SELECT store_no, document_key, max(ordinal) AS last, arg_max(mutation, ordinal) AS mutation FROM own WHERE judged = 'succeeded' GROUP BY ALL),
 kept AS (SELECT docs.store_no, count(*) AS documents FROM docs LEFT JOIN purge USING (store_no) WHERE mutation = 'upsert' AND (p IS NULL OR last > p) GROUP BY docs.store_no),
 puts AS (SELECT store_no, o_orderpriority AS key, max(ordinal) AS last FROM ok GROUP BY ALL), held AS (SELECT puts.store_no, count(*) AS settings FROM puts LEFT JOIN purge USING (store_no) WHERE p IS NULL OR last > p GROUP BY puts.store_no)
 SELECT ends.*, coalesce(documents, 0) AS documents, coalesce(settings, 0) AS settings, (SELECT count(DISTINCT o_custkey) FROM ok WHERE ok.store_no = ends.store_no) AS users
 FROM ends LEFT JOIN kept USING (store_no) LEFT JOIN held USING (store_no)""")
def repository_tables(spark: SparkSession, d: str) -> DataFrame:
    """Documents, settings and users of each store after two batches and a compaction between them."""
    log = repository_log(spark, d)
    half = C.table(spark, d, "documents").agg(F.max("doc_id") / 2).first()[0]
    repo = Repository(spark, f"{checkpoint_dir(spark).rstrip('/')}/repository-{uuid.uuid4().hex}")
    known = known_stores(spark, d).select("store_no", F.lit(-1).cast("long").alias("ordinal"), F.lit("ensure").alias("kind"), F.col("lifecycle_state").alias("ensured_state"), F.col("lifecycle_generation").alias("ensured_generation"))
    repo.apply(known.unionByName(log.where(F.col("ordinal") < half), allowMissingColumns=True), 0)
    repo.compact()
    repo.apply(log.where(F.col("ordinal") >= half), 1)
    held = repo.commits()
    count = lambda rows, name: rows.groupBy("store_no").agg(F.count(F.lit(1)).alias(name))
    out = repo.stores(held).drop("version")
    for rows, name in ((repo.documents(held), "documents"), (repo.state(held), "settings"), (repo.users(held), "users")):
        out = out.join(count(rows, name), "store_no", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("documents", "settings", "users")})


# ---- measures


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
 SELECT event_type, len(v) AS n, v[round_even((len(v) - 1) * 0.5, 0)::INT + 1] AS p50, v[round_even((len(v) - 1) * 0.95, 0)::INT + 1] AS p95 FROM s""")
def value_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of values that hardly repeat."""
    return analytics.nearest_rank(C.table(spark, d, "events").select("event_type", "value"), ["event_type"], "value", 0.5, 0.95)


@query("""WITH i AS (SELECT event_type, epoch_us(ts) AS a, epoch_us(ts) + (value * 60000000)::BIGINT AS z FROM events), k AS (SELECT * FROM i WHERE a < z),
 s AS (SELECT event_type, t, sum(d) AS d FROM (SELECT event_type, a AS t, 1 AS d FROM k UNION ALL SELECT event_type, z, -1 FROM k) GROUP BY ALL),
 o AS (SELECT event_type, t, sum(d) OVER (PARTITION BY event_type ORDER BY t) AS open FROM s WHERE d <> 0),
 p AS (SELECT event_type, max(open)::BIGINT AS peak, min(t) FILTER (open = m) AS peak_at FROM (SELECT *, max(open) OVER (PARTITION BY event_type) AS m FROM o) GROUP BY event_type)
 SELECT event_type, count(*) AS intervals, any_value(peak) AS peak, any_value(peak_at) AS peak_at, sum(z - a)::BIGINT AS busy FROM k JOIN p USING (event_type) GROUP BY event_type""")
def in_flight_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The most events that are in flight at once, each for its value in minutes."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    e = C.table(spark, d, "events").select("event_type", at.alias("a"), (at + F.round(F.col("value") * 60_000_000).cast("long")).alias("z"))
    return analytics.concurrency(e, ["event_type"], "a", "z")


@query("""WITH g AS (SELECT user_id % 16 AS queue, event_type, count(*) AS n, (count(*) % 7)::DOUBLE AS w FROM events GROUP BY ALL),
 c AS (SELECT queue, n / nullif(w, 0) AS x, w FROM g)
 SELECT queue, CASE WHEN min(w) > 0 THEN round(sum(x) * sum(x) / (count(*) * sum(x * x)), 9) END AS jain, CASE WHEN min(w) <= 0 THEN 'fairness weights must be greater than zero' END AS error FROM c GROUP BY queue""")
def fairness_refused(spark: SparkSession, d: str) -> DataFrame:
    """Weights by what their counts leave over by seven: queues that hold a key of weight 0 have no index."""
    c = C.table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("queue"), "event_type").agg(F.count(F.lit(1)).alias("count")).withColumn("weight", (F.col("count") % 7).cast("double"))
    return analytics.jain_index(c, ["queue"]).select("queue", F.round("jain", 9).alias("jain"), "error")


_KIND = "CASE event_type WHEN 'click' THEN 'signaled' WHEN 'purchase' THEN 'task_started' WHEN 'view' THEN 'scheduled' ELSE 'started' END"
_LINE = f"""'{{"workflowId":"' || user_id || '","eventId":' || event_id || ',"eventType":"' || {_KIND} || '","eventMicros":' || epoch_us(ts) || '}}'"""


@query(f"""WITH l AS (SELECT user_id, event_id, {_KIND} AS kind, value < 2 AS damaged, {_LINE} AS line FROM events)
 SELECT user_id::VARCHAR AS workflow_id, count(*) AS events, sum(strlen(line))::BIGINT AS bytes, count(*) FILTER (kind = 'signaled') AS signals, 0::BIGINT AS damaged FROM l WHERE NOT damaged GROUP BY user_id
 UNION ALL SELECT NULL, 0, 0, 0, count(*) FROM l WHERE damaged HAVING count(*) > 0""")
def history_totals(spark: SparkSession, d: str) -> DataFrame:
    """``events`` written as a JSON log, those of small value cut off, read back and summed up by history."""
    kind = F.when(F.col("event_type") == "click", "signaled").when(F.col("event_type") == "purchase", "task_started").when(F.col("event_type") == "view", "scheduled").otherwise("started")
    e = C.table(spark, d, "events").select(F.col("user_id").cast("string").alias("workflow_id"), "event_id", kind.alias("event_type"), F.unix_micros(F.col("ts").cast("timestamp")).alias("event_us"), F.lit(None).cast("long").alias("scheduled_event_id"), "value")
    path = f"{checkpoint_dir(spark).rstrip('/')}/histories-{uuid.uuid4().hex}"
    histories.write_log(e.where("value is null or value >= 2"), f"{path}/whole")
    histories.write_log(e.where("value < 2"), f"{path}/cut")
    cut = spark.read.text(f"{path}/cut").select(F.expr("substring(value, 1, length(value) - 9)").alias("value"))
    cut.write.text(f"{path}/damaged")
    return analytics.history_totals(histories.read_log(spark, [f"{path}/whole", f"{path}/damaged"]))
