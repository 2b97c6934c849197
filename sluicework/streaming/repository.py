"""Stores, documents, users and retrieval state as tables that batches of commands change, each in one commit.

A batch is judged by the authority that each of its rows finds (``operators.authority``), after all batches
before it, and written as one data set; it exists once a small file that names it is renamed into place, which
only one writer can do for a version.  What a task wrote for a batch that was never committed is read by
nobody, and a batch that comes again changes nothing.  Batches are added, not merged: a batch costs what its
own rows cost, and tables are folds over the batches since the last ``compact``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import authority
from ..operators.fence import WRITABLE, fence_status, transitions
from ..session import settled

#: Kinds of rows by the table that they change; lifecycle commands change stores.
TOPICS = {"upsert": "documents", "delete": "documents", "activate_user": "users", "deactivate_users": "users", "put_state": "state", "remove_objects": "purges"} | dict.fromkeys(authority.COMMANDS, "lifecycle")
CLEANUPS = ("remove_objects", "deactivate_users")
#: Columns of a batch; those that it lacks are null.  ``body_status`` is how an upsert with a bad body ends.
BATCH = "store_no long, ordinal long, kind string, expected_generation long, document_key string, source_version string, user_key string, key string, value string, body_status string, ensured_state string, ensured_generation long"
LOG = BATCH + ", status string, lifecycle_state string, lifecycle_generation long, version long, topic string"


class Conflict(RuntimeError):
    """Another writer has committed the version; nothing of this batch is visible.  Apply it again."""


def judged(batch: DataFrame, stores: DataFrame) -> DataFrame:
    """``batch`` with ``status`` and topic, and a row ``end`` for each store that it touches, with the authority after the batch."""
    ends = batch.groupBy("store_no").agg((F.max("ordinal") + 1).alias("ordinal")).withColumn("kind", F.lit("end"))
    held = authority.authority(batch.unionByName(ends, allowMissingColumns=True), stores)
    g, s, e, kind = F.col("lifecycle_generation"), F.col("lifecycle_state"), F.col("expected_generation"), F.col("kind")
    fence = lambda allowed: fence_status(g.isNotNull(), g, s, e, allowed)
    moved = transitions(held, kind, e).withColumn("_o", F.when(g.isNull(), "failed").otherwise(F.col("outcome"))).drop("expected", "outcome", "new_state", "new_generation")
    status = F.when(kind == "end", "succeeded").when(kind == "ensure", F.when(g.isNull(), "applied").otherwise("unchanged")).when(kind.isin(*authority.COMMANDS), F.col("_o")).when(kind.isin(*CLEANUPS), fence(("deactivating",)))
    status = status.when((kind == "upsert") & F.col("body_status").isNotNull(), F.col("body_status")).otherwise(fence(WRITABLE))
    topic = F.lit("unknown")
    for k, t in (TOPICS | {"end": "stores"}).items():
        topic = F.when(kind == k, t).otherwise(topic)
    return moved.withColumns({"status": F.when(topic == "unknown", "failed").otherwise(status), "topic": topic}).drop("_o")


class Repository:
    """The tables under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- commits

    def _at(self, path: str):  # noqa: ANN202
        """(file system, path) of Hadoop's."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def commits(self) -> list[dict]:
        """What is committed, in order, from the last compaction on."""
        fs, p = self._at(f"{self.path}/commits")
        if not fs.exists(p):
            return []
        found = sorted((json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/commits", wholetext=True).collect()), key=lambda c: c["version"])
        last = max((k for k, c in enumerate(found) if c["base"]), default=0)
        return found[last:]

    def version(self) -> int:
        held = self.commits()
        return held[-1]["version"] if held else 0

    def _publish(self, commit: dict) -> None:
        """Makes ``commit`` its version, unless that version is there."""
        spark, name = self.spark, f"{self.path}/commits/{commit['version']:020d}.json"
        fs, part = self._at(f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(commit), "utf-8"))
        out.close()
        hadoop = spark._jvm.org.apache.hadoop.fs
        target = hadoop.Path(name)
        options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:  # a rename that doesn't overwrite
            hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark._jsc.hadoopConfiguration()).rename(part, target, options)
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(name) from e
            raise

    def _written(self, rows: DataFrame, held: list[dict], batches: dict, base: bool) -> int:
        version = (held[-1]["version"] if held else 0) + 1
        data = f"{self.path}/data/{version:020d}-{uuid.uuid4().hex}"
        rows = rows if base else rows.withColumn("version", F.lit(version).cast("long"))
        rows.select(*StructType.fromDDL(LOG).names).write.partitionBy("topic").parquet(data)
        self._publish({"version": version, "data": data, "batches": batches, "base": base})
        return version

    # ---- writes

    def apply(self, batch: DataFrame, batch_id: int, source: str = "batch") -> int:
        """Judges and commits ``batch``, and returns the version; a batch of the source that was committed before, or an earlier one, changes nothing."""
        held = self.commits()
        batches = held[-1]["batches"] if held else {}
        if batches.get(source, -1) >= batch_id:
            return held[-1]["version"]
        fields = StructType.fromDDL(BATCH).fields
        rows = batch.select(*((F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        return self._written(judged(settled(rows), self.stores(held)), held, batches | {source: batch_id}, base=False)

    def sink(self, source: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a stream that is restarted hands in its last batch again, which then changes nothing."""

        def each(batch: DataFrame, batch_id: int) -> None:
            self.apply(batch, batch_id, source)

        return each

    def compact(self) -> int:
        """The tables as one batch, which later reads begin with; as with ``apply``, another writer's commit wins."""
        held = self.commits()
        if not held:
            return 0
        put = lambda df, kind, topic: df.withColumns({"kind": F.lit(kind), "topic": F.lit(topic), "status": F.lit("succeeded")})
        rows = put(self.documents(held), "upsert", "documents").unionByName(put(self.users(held), "activate_user", "users"), allowMissingColumns=True)
        rows = rows.unionByName(put(self.state(held), "put_state", "state"), allowMissingColumns=True).unionByName(put(self.stores(held).withColumn("ordinal", F.lit(0).cast("long")), "end", "stores"), allowMissingColumns=True)
        some = [F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(LOG).fields if f.name not in rows.columns]
        return self._written(rows.select("*", *some), held, held[-1]["batches"], base=True)

    # ---- reads

    def log(self, held: list[dict] | None = None) -> DataFrame:
        """All rows since the last compaction as they were judged."""
        held = self.commits() if held is None else held
        if not held:
            return self.spark.createDataFrame([], LOG)
        logs = [self.spark.read.schema(LOG).parquet(c["data"]) for c in held]
        out = logs[0]
        for x in logs[1:]:
            out = out.unionByName(x)
        return out

    def _done(self, topic: str, held: list[dict] | None) -> DataFrame:
        return self.log(held).where((F.col("topic") == topic) & (F.col("status") == "succeeded"))

    @staticmethod
    def _last(rows: DataFrame, key: list[str], *values: str | Column) -> DataFrame:
        """The last row of each key, with its place: an aggregate, so that a hot key is a row per task."""
        place = F.struct("version", "ordinal", (F.col("kind") == "delete").alias("d"))
        return rows.groupBy(*key).agg(F.max_by(F.struct("version", "ordinal", "kind", *values), place).alias("_w")).select(*key, "_w.*")

    def _kept(self, rows: DataFrame, purges: DataFrame) -> DataFrame:
        """Rows that no later purge of their store has taken; a purge comes after the writes of its own ordinal."""
        last = purges.groupBy("store_no").agg(F.max(F.struct("version", "ordinal")).alias("_p"))
        j = rows.join(last, "store_no", "left")
        return j.where(F.col("_p").isNull() | (F.struct("version", "ordinal") > F.col("_p"))).drop("_p")

    def documents(self, held: list[dict] | None = None) -> DataFrame:
        """(store_no, document_key, source_version, version, ordinal)."""
        last = self._last(self._done("documents", held), ["store_no", "document_key"], "source_version").where("kind = 'upsert'").drop("kind")
        return self._kept(last, self._done("purges", held))

    def users(self, held: list[dict] | None = None) -> DataFrame:
        """(store_no, user_key, version, ordinal) of active users; a deactivation without a user is of all."""
        rows = self._done("users", held)
        last = self._last(rows.where("user_key is not null"), ["store_no", "user_key"]).where("kind = 'activate_user'").drop("kind")
        return self._kept(last, rows.where("user_key is null and kind = 'deactivate_users'"))

    def state(self, held: list[dict] | None = None) -> DataFrame:
        """(store_no, key, value, version, ordinal); removing a store's objects clears its state as well."""
        return self._kept(self._last(self._done("state", held), ["store_no", "key"], "value").drop("kind"), self._done("purges", held))

    def stores(self, held: list[dict] | None = None) -> DataFrame:
        """(store_no, lifecycle_state, lifecycle_generation, version)."""
        last = self._last(self._done("stores", held), ["store_no"], "lifecycle_state", "lifecycle_generation")
        return last.where("lifecycle_generation is not null").select("store_no", "lifecycle_state", "lifecycle_generation", "version")
