"""Order over range buckets against loops: most rows in one group, null groups, ties in the group, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from sluicework.operators import analytics, authority, fence, ordered, quota, rollup

SCHEMA = "g string, at long, v long, s string"


def table(seed, n=1500):
    """Nine rows in ten are of one group; some are of the null group."""
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.9 else None if r.random() < 0.3 else r.choice("abc"), i, r.randint(0, 4) if r.random() < 0.9 else None, r.choice("xxxyz")) for i in range(n)]
    r.shuffle(rows)
    return rows


def groups(rows):
    out = {}
    for row in sorted(rows, key=lambda x: x[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("buckets", [1, 7])
def test_running_sums_and_places(spark, buckets):
    rows = table(1)
    got = {r["at"]: (r["n"], r["total"]) for r in ordered.running(spark.createDataFrame(rows, SCHEMA), ["g"], ["at"], buckets, n=F.lit(1).cast("long"), total="v").collect()}
    want = {}
    for members in groups(rows).values():
        total = 0
        for n, (_, at, v, _) in enumerate(members):
            want[at] = (n, total)
            total += v or 0
    assert got == want


@pytest.mark.parametrize("after", [False, True])
def test_nearest_value_that_is_not_null(spark, after):
    rows = table(2)
    seldom = F.when(F.col("at") % 211 == 0, F.col("at"))
    got = {r["at"]: r["near"] for r in ordered.neighbour(spark.createDataFrame(rows, SCHEMA), ["g"], ["at"], 6, after=after, near=seldom).collect()}
    want = {}
    for members in groups(rows).values():
        near = None
        for _, at, _, _ in reversed(members) if after else members:
            want[at] = near
            near = at if at % 211 == 0 else near
    assert got == want and len(set(want.values())) > 4


def plain_runs(rows):
    out = []
    for g, members in groups(rows).items():
        for k, row in enumerate(members):
            if k and members[k - 1][3] == row[3]:
                out[-1][2] += 1
            else:
                out.append([g, row[3], 1])
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("seed,one", [(3, False), (4, True)])
def test_runs_go_on_over_buckets(spark, seed, one):
    """With ``one``, most of the hot group is a single run that fills whole buckets."""
    rows = [(g, at, v, "x" if one and at % 400 else s) for g, at, v, s in table(seed)]
    got = sorted(map(tuple, ordered.runs(spark.createDataFrame(rows, SCHEMA), ["g"], ["at"], "s", 8).select("g", "s", "length").collect()), key=repr)
    assert got == plain_runs(rows)


def test_one_group_and_no_rows(spark):
    rows = table(5, 300)
    d = spark.createDataFrame(rows, SCHEMA)
    order = [F.col("v").desc_nulls_last(), "at"]
    got = [r["at"] for r in sorted(ordered.numbered(d, [], order, "place", 5).collect(), key=lambda r: r["place"])]
    assert got == [x[1] for x in sorted(rows, key=lambda x: (x[2] is None, -(x[2] or 0), x[1]))]
    none = d.where("false")
    assert ordered.numbered(none, ["g"], ["at"], "n").count() == ordered.runs(none, ["g"], ["at"], "s").count() == ordered.neighbour(none, ["g"], ["at"], x=F.col("v")).count() == 0


def test_operators_split_a_hot_key(spark):
    """Pages, queues, cleanups and order guards with nine rows in ten in one key, against loops."""
    rows = [r for r in table(6) if r[0] is not None]
    d = spark.createDataFrame(rows, SCHEMA)
    pages = {r["at"]: (r["page_no"], r["page_ordinal"]) for r in rollup.paged(d, ["g"], ["at"], 7).collect()}
    assert pages == {m[1]: divmod(n, 7) for members in groups(rows).values() for n, m in enumerate(members)}
    batches = d.select(F.col("g").alias("store_no"), F.col("at").alias("batch"), F.lit(2).alias("affected"), F.when(F.col("at") > 700, "failed").otherwise("succeeded").alias("status"), F.lit("m").alias("message"))
    got = {r["store_no"]: (r["affected"], r["status"]) for r in rollup.cleanup_rollup(batches).collect()}
    want = {}
    for g, members in groups(rows).items():
        good = sum(m[1] <= 700 for m in members)
        want[g] = (2 * (good + (good < len(members))), "failed" if good < len(members) else "succeeded")
    assert got == want
    asks = d.select(F.col("g").alias("scope"), F.col("at").alias("ordinal"), F.when(F.col("s") == "z", "").otherwise("r").alias("request_id"), F.lit(1).alias("cost"), F.lit(False).alias("other_scope"), F.lit("w").alias("requester"), F.lit(False).alias("disabled"))
    full = {r["ordinal"] for r in quota.denial(asks, 20).where(F.col("denial") == quota.FULL).collect()}
    assert full == {m[1] for members in groups(rows).values() for m in [m for m in members if m[3] != "z"][20:]} | set() and full


@pytest.mark.parametrize("kind", ["spread", "few", "outliers"])
def test_percentiles_by_brackets(spark, kind):
    r = random.Random(7)
    draw = {"spread": r.random, "few": lambda: r.choice([1.5, 1.5, 1.5, 2.0, 7.25]), "outliers": lambda: r.lognormvariate(0, 9)}[kind]
    rows = [(g, draw()) for g in ["hot"] * 3000 + ["a"] * 41 + [None] * 50] + [("hot", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: (x["n"], x["p50"], x["p95"]) for x in analytics.nearest_rank(d, ["g"], "v", 0.5, 0.95, inside=25).collect()}
    for g in ("hot", "a", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert got[g] == (len(v), v[round((len(v) - 1) * 0.5)], v[round((len(v) - 1) * 0.95)])


class Store:
    """The authority's rules, one command after the other."""

    def __init__(self, state, generation):
        self.state, self.generation = state, generation

    def take(self, kind, expected):
        if kind == "begin":
            if self.generation == expected + 1 and self.state not in fence.WRITABLE:
                return "unchanged"
            if self.generation != expected:
                return "stale_generation"
            if self.state not in fence.WRITABLE:
                return "rejected"
            self.state, self.generation = "deactivating", expected + 1
            return "applied"
        if self.generation != expected:
            return "stale_generation"
        if kind == "resume":
            if expected <= 0 or self.state not in ("deactivating", "deactivation_failed"):
                return "rejected"
            changed, self.state = self.state == "deactivation_failed", "deactivating"
            return "applied" if changed else "unchanged"
        to = "inactive" if kind == "mark_inactive" else "deactivation_failed"
        if self.state == to:
            return "unchanged"
        if self.state != "deactivating":
            return "rejected"
        self.state = to
        return "applied"


@pytest.mark.parametrize("seed", range(3))
def test_authority_as_of_each_row(spark, seed):
    """Mutations before, between and after a fence, retried beginnings, late ingests, stores that are ensured midway; most rows in one store."""
    r = random.Random(seed)
    starts = {0: ("active", 2), 1: ("syncing", 0), 2: ("deactivating", 1), 3: ("deactivation_failed", 0), 4: ("inactive", 3)}
    log = []
    for i in range(900):
        s = 0 if r.random() < 0.7 else r.randrange(8)
        g = starts.get(s, ("active", 5))[1]
        kind = r.choices(("write", "begin", "resume", "mark_inactive", "mark_failed", "ensure"), (60, 4 if i > 100 else 0, 9, 1, 9, 2))[0]
        log.append((s, i, kind, g + r.choice((-1, 0, 0, 1, 1)), r.choice(("active", "deactivating")) if kind == "ensure" else None, 5 if kind == "ensure" else None))
    stores, want, outcomes = {s: Store(*x) for s, x in starts.items()}, {}, {}
    for s, i, kind, expected, state, generation in log:
        at = stores.get(s)
        if kind == "write":
            want[i] = "failed" if at is None else "stale_generation" if at.generation != expected else "rejected" if at.state not in fence.WRITABLE else "succeeded"
        elif kind == "ensure":
            stores.setdefault(s, Store(state, generation))
        else:
            outcomes[i] = "failed" if at is None else at.take(kind, expected)
    df = spark.createDataFrame(log, "store_no long, ordinal long, kind string, expected_generation long, ensured_state string, ensured_generation long").repartition(3)
    base = spark.createDataFrame([(s, *x) for s, x in starts.items()], "store_no long, lifecycle_state string, lifecycle_generation long")
    got = authority.fenced_as_of(df.where("kind = 'write'").select("store_no", "ordinal", "expected_generation"), df.where("kind <> 'write'"), base)
    assert {x["ordinal"]: x["status"] for x in got.collect()} == want
    assert {x["ordinal"]: x["outcome"] for x in authority.command_outcomes(df, base).collect()} == outcomes
    assert len(set(want.values())) == 4 and len(set(outcomes.values())) == 5


def test_sums_are_exact_in_any_order(spark):
    from fractions import Fraction

    from sluicework.operators import exact

    r = random.Random(9)
    values = [r.choice((-1, 1)) * r.random() * 10.0 ** r.choice((-300, -20, -3, 0, 0, 5, 40, 300)) for _ in range(400)] + [2.0**k * s for k in range(-1074, 1023, 37) for s in (1, -1, 1)] + [0.0, -0.0]
    rows = [("a", v) for v in values] + [("b", 0.1)] * 10 + [(None, 1e16), (None, 1.0), (None, -1e16), ("nan", float("nan")), ("nan", 1.0), ("inf", float("inf")), ("inf", 1.0), ("none", None)]
    want = {"a": float(sum(map(Fraction, values))), "b": float(10 * Fraction(0.1)), None: 1.0, "inf": float("inf"), "none": 0.0}
    for k in (1, 5):
        r.shuffle(rows)
        got = {x["g"]: x["s"] for x in exact.sums(spark.createDataFrame(rows, "g string, v double").repartition(k), ["g"], s=F.col("v")).collect()}
        assert str(got.pop("nan")) == "nan" and got == want


def test_weights_that_are_refused(spark):
    d = spark.createDataFrame([("a", "x", 3, 1.0), ("a", "y", 1, 2.0), ("b", "x", 1, 0.0), ("b", "y", 4, 1.0), ("c", "x", 0, 1.0), ("d", "x", 1, None)], "queue string, fairness_key string, count long, weight double")
    got = {x["queue"]: (x["jain"], x["error"]) for x in analytics.jain_index(d, ["queue"]).collect()}
    assert got == {"a": (3.5**2 / (2 * 9.25), None), "b": (None, analytics.BAD_WEIGHT), "c": (1.0, None), "d": (None, analytics.BAD_WEIGHT)}


def test_most_intervals_at_once(spark):
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.9 else "cold", a := r.randint(0, 300), a + r.randint(0, 9)) for _ in range(800)] + [("hot", None, 4), ("cold", 9, 3)]
    got = {x["g"]: tuple(x)[1:] for x in analytics.concurrency(spark.createDataFrame(rows, "g string, a long, z long"), ["g"], "a", "z").collect()}
    for g in got:
        open_ = [(a, z) for k, a, z in rows if k == g and a is not None and a < z]
        at = {t: sum(a <= t < z for a, z in open_) for t in {a for a, _ in open_}}
        peak = max(at.values())
        assert got[g] == (len(open_), peak, min(t for t in at if at[t] == peak), sum(z - a for a, z in open_))
