"""Event logs with damaged records, bounded dedup of streams, and users behind a cursor."""

import json
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from sluicework.operators import analytics
from sluicework.sources import histories, provider
from sluicework.streaming import dedup
from sluicework.streaming.dedup import remembered


def test_damaged_lines_are_told_apart(spark, tmp_path):
    events = [("a", 1, "signaled", 5, None), ("a", 2, "started", 9, 1), ("b", 1, "signaled", 7, None), ("é", 4, "x", 1, None)]
    d = spark.createDataFrame(events, "workflow_id string, event_id long, event_type string, event_us long, scheduled_event_id long")
    histories.write_log(d, str(tmp_path / "log"))
    bad = ['{"workflowId":"a","eventId":3,"eventTy', "not json", '{"eventId":5}', '{"workflowId":"a","eventId":"x"}', "[1]"]
    (tmp_path / "log" / "more.txt").write_text("\n".join(["", *bad, "   ", '{"workflowId":"a","eventId":8,"eventType":"signaled","other":1}']) + "\n")
    got = histories.read_log(spark, str(tmp_path / "log"))
    rows = {(r["workflow_id"], r["event_id"], r["event_type"], r["event_us"], r["scheduled_event_id"]) for r in got.where("malformed is null").collect()}
    assert rows == {*events, ("a", 8, "signaled", None, None)}
    assert sorted(r["malformed"] for r in got.where("malformed is not null").collect()) == sorted(bad)
    totals = {r["workflow_id"]: (r["events"], r["signals"], r["damaged"]) for r in analytics.history_totals(got).collect()}
    assert totals == {"a": (3, 2, 0), "b": (1, 1, 0), "é": (1, 0, 0), None: (0, 0, 5)}


def test_exported_histories(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "one.json").write_text(json.dumps({"events": [{"eventId": "1", "eventTime": "2025-01-01T00:00:00Z", "eventType": "A"}, {"eventId": "2", "eventTime": "2025-01-01T00:00:01Z", "eventType": "B"}]}, indent=1))
    (tmp_path / "h" / "two.json").write_text("{ broken")
    got = histories.read_histories(spark, str(tmp_path / "h"))
    assert [(r["place"], r["event_id"], r["event_type"]) for r in got.where("malformed is null").orderBy("place").collect()] == [(0, 1, "A"), (1, 2, "B")]
    assert [r["malformed"] for r in got.where("malformed is not null").collect()] == ["{ broken"]


def plain(rows, remember):
    held, out = {}, {}
    for k, x, at in sorted(rows, key=lambda r: r[2]):
        ids = held.setdefault(k, OrderedDict())
        out[at] = x in ids
        ids.setdefault(x, None)
        while len(ids) > remember:
            ids.popitem(last=False)
    return out


def test_dedup_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    """Nine rows in ten are of one key; ids are forgotten and come again."""
    r = random.Random(5)
    rows = [("hot" if r.random() < 0.9 else "cold", f"id{int(r.expovariate(0.08))}", at) for at in range(300)]
    schema, want = "store_no string, command_id string, ordinal long", plain(rows, 6)
    assert 0 < sum(want.values()) < 250
    table = remembered(spark.createDataFrame(rows, schema).repartition(3), "store_no", "command_id", "ordinal", 6)
    assert {x["ordinal"]: x["duplicate"] for x in table.collect()} == want

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = remembered(s, "store_no", "command_id", "ordinal", 6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for a in (0, 170):  # the second time from the checkpoint
        part = rows[a : a + 170]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert {x["ordinal"]: x["duplicate"] for x in spark.read.parquet(str(tmp_path / "out")).collect()} == want


@pytest.mark.parametrize("remember", [1, 4, 8])
@pytest.mark.parametrize("names", [9, 40])
def test_dedup_of_a_table_goes_on_across_buckets(spark, monkeypatch, remember, names):
    """One key lies in most buckets; with few names what buckets leave behind depends on what they begin with."""
    monkeypatch.setattr(dedup, "GUESSES", 1)
    r = random.Random(names)
    rows = [(None if r.random() < 0.9 else r.choice("ab"), f"id{r.randrange(names)}", at) for at in range(400)]
    table = spark.createDataFrame(rows, "store_no string, command_id string, ordinal long").repartition(3)
    got = remembered(table, "store_no", "command_id", "ordinal", remember, buckets=9)
    assert {x["ordinal"]: x["duplicate"] for x in got.collect()} == plain(rows, remember)
    assert "transformWithState" not in got._jdf.queryExecution().toString() and got.rdd.getNumPartitions() == 9


def test_users_behind_a_cursor(spark, tmp_path):
    """A page for each batch; an exhausted one is asked for again."""
    spark.dataSource.register(provider.UserPages)
    s = spark.readStream.format("user_pages").options(provider="user_provider:users", page_size="4").load()
    q = s.writeStream.format("memory").queryName("listed_users").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["user_key"] for r in spark.table("listed_users").where("valid").collect()) == sorted(f"user{i}" for i in range(10) if i % 3)
    assert spark.table("listed_users").agg(F.count(F.lit(1))).first()[0] == 10
