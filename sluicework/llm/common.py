"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs of bytes other than blank and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.  Only a local session, whose tasks all run here, may do without one."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="sluicework-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def mapped(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` with batches of about ``BATCH_BYTES``: both the JVM and the Python worker hold whole batches.

    The session's setting is lowered, never raised; it changes no result.
    """
    conf, setting = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(setting).rstrip("bB")) > BATCH_BYTES:
        conf.set(setting, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: later reads neither recompute it nor lose it with an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """As ``settled``; the shuffles that led to it leave the disks at once, not when the driver happens to collect garbage."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return settled(df.select("*"))  # a plan takes the setting over when it is made


def tabled(df: DataFrame) -> DataFrame:
    """As ``settled``, but as a compressed Parquet table: for wide or long results of which columns are read apart.

    The table stays in the shared folder until whoever owns that folder clears it.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting while one result is computed and written."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def key60(*parts: Column) -> Column:
    """A 60-bit number from the MD5 of the parts: the same in Spark and in ANSI engines that offer md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 15), 16, 10).cast("long")


def row_tie(df: DataFrame, *skip: str) -> Column:
    """A hash of whole rows (maps left out): breaks ties between rows that share their id."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name not in skip and "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def group_key(col: Column) -> Column:
    """A non-null grouping key in which null differs from every string, the empty one included."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("-"))


def packed(df: DataFrame, *new: str) -> Column:
    """All columns as one struct; columns named like those an operator adds are left out, as it replaces them."""
    names = [c for c in df.columns if c not in new]
    return F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(None).cast("int").alias("_"))


def running_totals(rows: DataFrame, totals: DataFrame, group: str, bucket: str, order: list[Column], value: Column) -> DataFrame:
    """``before``: sum of ``value`` over the rows of the same group that come earlier in (bucket, order).

    A group may hold most of the table, so no task orders a whole group: ``totals`` (the sums ``n`` of
    each (group, bucket), pre-aggregated before their shuffle) gives every bucket its starting sum, and
    only the rows of one bucket of one group are ordered together.
    """
    from pyspark.sql import Window as W

    starts = totals.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = rows.join(starts.select(group, bucket, "start"), [group, bucket])
    return joined.withColumn("before", F.col("start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("start")


def bucket_count(n: int, per_bucket: int = 256, most: int = 65536) -> int:
    """How finely ordering is split: about ``per_bucket`` rows each until there are ``most`` buckets."""
    return max(16, min(most, -(-n // per_bucket)))
