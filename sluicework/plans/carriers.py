"""Inputs of the lifecycle operators, derived from the driver's tables; and the same derivations as SQL.

Carriers are projections, so filters and column pruning reach the scans.  Dimension-sized carriers (stores
come from ``nation``, 25 rows) are left to the planner's size check for broadcasting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("active", "syncing", "deactivating", "inactive", "deactivation_failed")
PAGE_SIZE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Narrow ``rows`` dealt out to all tasks, for work on each that far outweighs its reading: a small file is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    state = F.element_at(F.array(*map(F.lit, STATES)), F.col("n_nationkey") % 5 + 1)
    return n.select(F.col("n_nationkey").cast("long").alias("store_no"), F.col("n_name").alias("store_key"), state.alias("lifecycle_state"), (F.col("n_nationkey") % 4).cast("long").alias("lifecycle_generation"))


STORES = """stores AS (SELECT n_nationkey::BIGINT AS store_no, n_name AS store_key,
  ['active','syncing','deactivating','inactive','deactivation_failed'][n_nationkey % 5 + 1] AS lifecycle_state,
  (n_nationkey % 4)::BIGINT AS lifecycle_generation FROM nation)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("long").alias("store_no"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_key"), (F.col("c_acctbal") >= 0).alias("valid"))


USERS = """users AS (SELECT c_nationkey::BIGINT AS store_no, c_custkey AS ordinal, 'user-' || c_custkey AS user_key,
  c_acctbal >= 0 AS valid FROM customer)"""


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed over ``documents``: some hashes are wrong, some bodies are missing, some rows are stale or deletions."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        (i % 25).alias("store_no"),
        i.alias("ordinal"),
        F.concat(F.lit("doc-"), F.expr("cast(doc_id div 75 as string)")).alias("document_key"),
        F.concat(F.lit("v"), i.cast("string")).alias("source_version"),
        F.when(i % 11 == 0, F.lit("delete")).otherwise(F.lit("upsert")).alias("mutation"),
        F.when(i % 7 == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("behind"),
        F.when(i % 17 == 0, F.lit("bad")).otherwise(F.sha2("text", 256)).alias("content_hash"),
        F.when(i % 29 == 0, F.lit(None)).otherwise(F.col("text")).alias("body"),
        F.col("source").alias("user_key"),
        F.col("lang").alias("resource_key"),
        F.expr("doc_id div 250").alias("page_no"),
    )


MUTATIONS = """mutations AS (SELECT doc_id % 25 AS store_no, doc_id AS ordinal, 'doc-' || (doc_id // 75) AS document_key,
  'v' || doc_id AS source_version, CASE WHEN doc_id % 11 = 0 THEN 'delete' ELSE 'upsert' END AS mutation,
  CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS behind,
  CASE WHEN doc_id % 17 = 0 THEN 'bad' ELSE sha256(text) END AS content_hash,
  CASE WHEN doc_id % 29 = 0 THEN NULL ELSE text END AS body,
  source AS user_key, lang AS resource_key, doc_id // 250 AS page_no FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fetched page of a (user, resource), with its outcome; from ``orders``."""
    o = table(spark, sf_dir, "orders")
    seq = F.row_number().over(_w("o_custkey", "o_orderkey")).cast("long") - 1
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 25).alias("store_no"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_key"),
        F.when(F.col("o_orderpriority").rlike("^[12]"), F.lit("files")).otherwise(F.lit("comments")).alias("resource_key"),
        seq.alias("seq"),
        F.when(seq == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("c"), seq.cast("string"))).alias("cursor"),
        (k % 13 == 0).alias("failed"),
        (k % 9).alias("n_upserts"),
        (k % 4).alias("n_deletes"),
        k.alias("page_id"),
    )


def _w(part: str, order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


PAGES = """pages0 AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq FROM orders),
pages AS (SELECT o_custkey % 25 AS store_no, 'user-' || o_custkey AS user_key,
  CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'files' ELSE 'comments' END AS resource_key, seq,
  CASE WHEN seq = 0 THEN NULL ELSE 'c' || seq END AS cursor, o_orderkey % 13 = 0 AS failed, o_orderkey % 9 AS n_upserts,
  o_orderkey % 4 AS n_deletes, o_orderkey AS page_id FROM pages0)"""


def quota_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permit requests at one instant; from ``events``."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("scope-"), F.col("user_id").cast("string")).alias("scope"),
        F.row_number().over(_w("user_id", "event_id")).cast("long").alias("ordinal"),
        F.when(i % 41 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), i.cast("string"))).alias("request_id"),
        F.when(i % 37 == 0, F.lit("")).otherwise(F.lit("worker")).alias("requester"),
        (i % 25).alias("store_no"),
        (i % 3).alias("lifecycle_generation"),
        (F.floor("value") % 4).cast("long").alias("cost"),
        (i % 53 == 0).alias("other_scope"),
        (F.col("user_id") % 19 == 0).alias("disabled"),
        (F.col("user_id") % 4 + 1).alias("free_slots"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None)).otherwise(F.col("user_id") % 11).cast("long").alias("remaining"),
    )


QUOTA = """requests AS (SELECT 'scope-' || user_id AS scope, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal,
  CASE WHEN event_id % 41 = 0 THEN '' ELSE 'r' || event_id END AS request_id,
  CASE WHEN event_id % 37 = 0 THEN '' ELSE 'worker' END AS requester, event_id % 25 AS store_no,
  event_id % 3 AS lifecycle_generation, (floor(value)::BIGINT % 4) AS cost, event_id % 53 = 0 AS other_scope,
  user_id % 19 = 0 AS disabled, user_id % 4 + 1 AS free_slots,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 11 END AS remaining FROM events)"""
