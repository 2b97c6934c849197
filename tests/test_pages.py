"""The partitioned source of pages against a batch query, and how adapters are loaded."""

import ast
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sluicework.operators import rollup
from sluicework.sources import pages as P


@pytest.fixture(scope="module")
def source(spark, sf, tmp_path_factory):
    """Entries from ``orders``: a user per tenth customer, its resource by priority."""
    spark.sparkContext.addPyFile(str(Path(__file__).with_name("page_provider.py")))
    spark.dataSource.register(P.ResourcePages)
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("user"), (F.col("o_custkey") % 15).cast("string")).alias("user_key"), F.when(F.col("o_orderpriority") < "3", "files").otherwise("comments").alias("resource_key"), F.col("o_orderkey").alias("at"), (F.col("o_orderstatus") == "F").alias("deleted"))
    root = tmp_path_factory.mktemp("provider")
    for r in o.groupBy("user_key", "resource_key").agg(F.array_sort(F.collect_list(F.struct("at", "deleted"))).alias("e")).collect():
        (root / f"{r['user_key']}+{r['resource_key']}.json").write_text(json.dumps([[f"o{x['at']}", x["deleted"]] for x in r["e"]]))
    return o, str(root)


def test_stream_equals_batch_and_goes_on_where_it_was_stopped(spark, source, tmp_path):
    orders, root = source
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def start():
        s = spark.readStream.format("resource_pages").options(provider="page_provider:folder", path=root, page_size="7", window="5").load()
        return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()

    q = start()
    while q.lastProgress is None or q.lastProgress["batchId"] < 3:
        assert q.exception() is None
        time.sleep(0.1)
    q.stop()
    before = spark.read.parquet(out).count()
    q = start()
    q.processAllAvailable()
    offset = q.lastProgress["sources"][0]["endOffset"]
    q.stop()
    assert (offset if isinstance(offset, dict) else ast.literal_eval(offset))["open"] == {} and 0 < before < orders.count()
    got = spark.read.parquet(out)
    key = ["user_key", "resource_key"]
    want = rollup.paged(orders, key, ["at"], 7)
    want = want.select(*key, "page_no", F.when(F.col("page_no") > 0, (F.col("page_no") * 7).cast("string")).alias("cursor"), F.when(F.col("page_no") % 3 == 2, 2).otherwise(1).cast("long").alias("attempt"), F.col("page_ordinal").alias("ordinal"), F.concat(F.lit("o"), F.col("at").cast("string")).alias("document_key"), F.when(F.col("deleted"), "delete").otherwise("upsert").alias("mutation"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(got.where("not quota_exhausted").select(*want.columns)) == rows(want)
    away = got.where("quota_exhausted")
    assert rows(away.select(*key, "page_no")) == rows(want.where("attempt = 2").select(*key, "page_no").distinct()) and away.where("attempt <> 1 or ordinal is not null").count() == 0
    deleted = got.where("mutation = 'delete'").select("source_version", "cursor", "body").first()
    assert deleted["source_version"] == f"deleted:{deleted['cursor'] or 'initial'}" and deleted["body"] is None


def test_a_stream_without_a_provider_is_empty(spark, source, tmp_path):
    s = spark.readStream.format("resource_pages").load()
    q = s.writeStream.format("memory").queryName("no_pages").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("no_pages").count() == 0


def test_offsets_are_bounded_by_the_window(source):
    reader = P.PageReader({"provider": "page_provider:folder", "path": source[1], "page_size": "7", "window": "3"})
    at, pages = reader.initialOffset(), 0
    while True:
        end = reader.latestOffset()
        if end == at:
            break
        assert len(end["open"]) <= 3
        assert len(found := reader.partitions(at, end)) == len(at["open"]) and len({(p.user, p.resource) for p in found}) == len(found)
        pages += sum(not p.exhausted for p in found)
        at = json.loads(json.dumps(end))
    entries = [json.loads(p.read_text()) for p in Path(source[1]).glob("*.json")]
    assert pages == sum(-(-len(e) // 7) for e in entries) and at["begun"] == len(entries)


def test_adapters_are_all_or_nothing(source):
    one = "page_provider:folder"
    assert P.adapters({"allow_unsafe": "true"}) is None
    found = P.adapters({"repository": one, "staging": "page_provider:waited", "provider": one, "path": source[1]})
    assert set(found) == set(P.ADAPTERS) and all(f.targets() for f in found.values())
    for options in ({}, {"provider": one, "allow_unsafe": "true"}, {"repository": one, "staging": one}, dict.fromkeys(P.ADAPTERS, "page_provider"), dict.fromkeys(P.ADAPTERS, ":x")):
        with pytest.raises(ValueError):
            P.adapters(options | {"path": source[1]})
