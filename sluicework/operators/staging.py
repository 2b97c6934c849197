"""Manifests of staged documents: bodies are hashed where they are read, and only their fingerprints travel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import authority

# What a refused upsert says.
NO_BODY, BAD_HASH = "KeyError", "staged content hash does not match DocumentRef"


def fingerprints(staged: DataFrame) -> DataFrame:
    """(staging_uri, body_hash, body_bytes) of ``staged`` (staging_uri, body): taken at the scan, so that no body is shuffled.

    A body that is staged twice under one name is one body if its bytes are the same; else the one with the
    greatest hash counts, whatever the order in which they are read.  A null body isn't staged.
    """
    read = staged.where("body is not null").select("staging_uri", F.sha2(F.col("body").cast("binary"), 256).alias("h"), F.octet_length("body").cast("long").alias("n"))
    return read.groupBy("staging_uri").agg(F.max("h").alias("body_hash"), F.max_by("n", "h").alias("body_bytes"))


def checked(manifest: DataFrame, staged: DataFrame) -> DataFrame:
    """``manifest`` (mutation, staging_uri, content_hash, ...) with ``body_bytes``, ``body_status`` and ``body_message``.

    ``body_status`` is null where the body is there and has the declared hash, and for deletions, which have none;
    a missing body has ``failed``, a wrong hash is ``rejected``.
    """
    j = manifest.join(fingerprints(staged), "staging_uri", "left")
    upsert = F.col("mutation") == "upsert"
    missing, wrong = upsert & F.col("body_hash").isNull(), upsert & ~F.col("body_hash").eqNullSafe(F.col("content_hash"))
    status = F.when(missing, "failed").when(wrong, "rejected")
    return j.withColumns({"body_status": status, "body_message": F.when(missing, NO_BODY).when(wrong, BAD_HASH)}).drop("body_hash")


def duplicates(manifest: DataFrame, page: list[str]) -> DataFrame:
    """``manifest`` with ``duplicate``: whether an earlier entry of the page has the same key and version.

    The two would share a child, so only the first is ingested.  The first is an aggregate, which combines before
    its shuffle; an entry of any page may be repeated often.
    """
    key = [*page, "document_key", "source_version", "mutation"]
    first = manifest.groupBy(*key).agg(F.min("ordinal").alias("_first"))
    return manifest.join(first, key).withColumn("duplicate", F.col("ordinal") > F.col("_first")).drop("_first")


def ingest_manifest(manifest: DataFrame, staged: DataFrame, commands: DataFrame, stores: DataFrame, page: list[str]) -> DataFrame:
    """Every entry of ``manifest`` with ``status`` and ``message``: duplicates are left out of the ingest, a bad body
    ends an upsert before its fence, and the fence is that of the entry's own place among ``commands``."""
    told = checked(duplicates(manifest, page), staged)
    out = authority.ingest_as_of(told, commands, stores)
    return out.withColumn("status", F.when(F.col("duplicate"), "duplicate").otherwise(F.col("status"))).withColumn("message", F.when(~F.col("duplicate"), F.col("message"))).drop("duplicate")
