"""The repository's tables after batches of commands, against plain dictionaries; what is lost, repeated or in conflict."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sluicework.operators import fence
from sluicework.streaming import repository as R
from test_ordered import Store

COLUMNS = "store_no long, ordinal long, kind string, expected_generation long, document_key string, source_version string, user_key string, key string, value string, ensured_state string, ensured_generation long"


def commands(seed, n=500):
    """Nine rows in ten are of one store."""
    r = random.Random(seed)
    out = [(s, s - 10, "ensure", None, None, None, None, None, None, "active", 1) for s in range(3)]
    for i in range(n):
        s = 0 if r.random() < 0.9 else r.choice((1, 2, 9))
        kind = r.choices(("upsert", "delete", "activate_user", "put_state", "begin", "mark_failed", "resume", "deactivate_users", "remove_objects", "mark_inactive"), (40, 8, 20, 20, 1 if i > 200 else 0, 3, 3, 3, 2, 1 if i > 400 else 0))[0]
        cleans = kind in ("deactivate_users", "remove_objects", "mark_failed", "resume", "mark_inactive")
        g = r.choice((1, 1, 1, 0)) + (1 if cleans else 0)
        user = None if kind == "deactivate_users" and r.random() < 0.2 else f"u{r.randint(0, 9)}"
        out.append((s, i, kind, g, f"d{r.randint(0, 25)}", f"v{i}", user, f"k{r.randint(0, 5)}", str(i), None, None))
    return out


def plain(rows):
    """The tables by one command after the other."""
    stores, docs, users, state = {}, {}, set(), {}
    for s, _, kind, g, doc, version, user, key, value, st, eg in rows:
        at = stores.get(s)
        if kind == "ensure":
            stores.setdefault(s, Store(st, eg))
        elif at is None:
            continue
        elif kind in ("begin", "resume", "mark_inactive", "mark_failed"):
            at.take(kind, g)
        elif at.generation == g and at.state == "deactivating" and kind in R.CLEANUPS:
            if kind == "remove_objects":
                docs, state = ({k: v for k, v in t.items() if k[0] != s} for t in (docs, state))
            else:
                users = {u for u in users if u[0] != s or (user is not None and u[1] != user)}
        elif at.generation == g and at.state in fence.WRITABLE and kind not in R.CLEANUPS:
            if kind == "upsert":
                docs[s, doc] = version
            elif kind == "delete":
                docs.pop((s, doc), None)
            elif kind == "activate_user":
                users.add((s, user))
            else:
                state[s, key] = value
    return {s: (x.state, x.generation) for s, x in stores.items()}, docs, users, state


def tables(repo):
    rows = lambda df: [tuple(x) for x in df.collect()]
    return (
        {s: (a, g) for s, a, g, _ in rows(repo.stores())},
        {(s, d): v for s, d, v in rows(repo.documents().select("store_no", "document_key", "source_version"))},
        set(rows(repo.users().select("store_no", "user_key"))),
        {(s, k): v for s, k, v in rows(repo.state().select("store_no", "key", "value"))},
    )


def test_batches_equal_one_command_after_the_other(spark, tmp_path):
    rows, repo = commands(1), R.Repository(spark, str(tmp_path / "r"))
    assert repo.version() == 0 and repo.documents().count() == 0
    cuts = [0, 150, 330, len(rows)]
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        part = rows[a:z]
        random.Random(k).shuffle(part)
        repo.apply(spark.createDataFrame(part, COLUMNS), k)
        if k == 1:
            assert tables(repo) == plain(rows[:z])
            assert repo.compact() == 3 and tables(repo) == plain(rows[:z]) and len(repo.commits()) == 1
    repo.apply(spark.createDataFrame(rows[:50], COLUMNS), 1)
    assert repo.version() == 4 and tables(repo) == plain(rows)


def test_what_was_not_committed_is_not_there(spark, tmp_path, monkeypatch):
    """A process that ends between write and commit, and a task that dies while it writes."""
    rows, repo = commands(2, 200), R.Repository(spark, str(tmp_path / "r"))
    repo.apply(spark.createDataFrame(rows[:100], COLUMNS), 0)
    before = tables(repo)
    rest = spark.createDataFrame(rows[100:], COLUMNS)

    def lost(self, commit):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(R.Repository, "_publish", lost)
        with pytest.raises(OSError):
            repo.apply(rest, 1)
    assert len(os.listdir(tmp_path / "r" / "data")) == 2 and tables(repo) == before

    real = R.judged

    def dies(batch, stores):
        die = F.udf(lambda x: os._exit(1) if x > 150 else "succeeded")
        return real(batch, stores).withColumn("status", die("ordinal"))

    with monkeypatch.context() as m:
        m.setattr(R, "judged", dies)
        with pytest.raises(Exception):  # noqa: B017
            repo.apply(rest, 1)
    assert tables(repo) == before and repo.version() == 1
    assert repo.apply(rest, 1) == 2 and tables(repo) == plain(rows)


def test_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    rows = commands(3, 60)
    a, b = (R.Repository(spark, str(tmp_path / "r")) for _ in range(2))
    stale = b.commits()
    a.apply(spark.createDataFrame(rows, COLUMNS), 0)
    with monkeypatch.context() as m:
        m.setattr(b, "commits", lambda: stale)
        with pytest.raises(R.Conflict):
            b.apply(spark.createDataFrame(rows[:9], COLUMNS), 7, "other")
    assert tables(a) == plain(rows) and not [f for f in os.listdir(tmp_path / "r" / "commits") if f.startswith(".") and not f.endswith(".crc")]


def test_a_stream_that_is_restarted(spark, tmp_path):
    rows, repo = commands(4, 300), R.Repository(spark, str(tmp_path / "r"))

    def run():
        s = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = s.writeStream.foreachBatch(repo.sink("stream")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    for a in (0, 200):
        spark.createDataFrame(rows[a : a + 200], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    os.remove(tmp_path / "c" / "commits" / "1")  # the stream ended after its batch's commit and before its own
    (tmp_path / "c" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert repo.version() == 2 and tables(repo) == plain(rows)
