"""Set-based effects of quota messages and controller commands against the ledger and the controller, one message at a time."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicework.operators import admission, commands, controller, quota
from sluicework.plans import registry

NOON = datetime(2025, 3, 1, 9, 30, tzinfo=UTC)


def micros(t):
    return None if t is None else round(t.timestamp() * 1_000_000)


def ledgers(seed, n=40):
    """Scopes in various states: some full, disabled, blocked, with permits and ended requests."""
    r = random.Random(seed)
    for k in range(n):
        x = quota.Ledger((f"scope{k}", "", ""), limit=r.choice((None, 3, 9)), max_in_flight=3, max_pending=6)
        for i in range(r.randint(0, 14)):
            x.apply({"kind": "request", "at": NOON, "request_id": f"r{i}", "requester": "w", "cost": r.randint(1, 2), "store_key": "s", "lifecycle_generation": 0})
            if r.random() < 0.3 and x.held:
                one = r.choice(list(x.held))
                x.apply({"kind": "complete", "at": NOON, "request_id": one, "permit_id": x.held[one]["permit"]})
        if r.random() < 0.2:
            x.apply({"kind": "disable", "at": NOON})
        x.blocked, x.reset = (r.choice((None, NOON + timedelta(seconds=r.choice((-90, -3, 0, 5, 70)), microseconds=r.choice((0, 1500))))) for _ in range(2))
        yield x


def tables(spark, found):
    scopes = [(x.scope[0], x.limit, x.remaining, micros(x.reset), micros(x.blocked), x.disabled, x.window) for x in found]
    held = [(x.scope[0], i, status, permit) for x in found for status, ids in (("pending", x.queue), ("reserved", x.held), ("ended", x.ended)) for i in ids for permit in [x.held[i]["permit"] if status == "reserved" else None]]
    return spark.createDataFrame(scopes, "scope string, limit long, remaining long, reset_us long, blocked_us long, disabled boolean, window_id string"), spark.createDataFrame(held, "scope string, request_id string, status string, permit_id string")


def still(x):
    """A ledger that grants nothing while messages of one instant are handled."""
    x = quota.Ledger.load(x.dump())
    x.grant = lambda now: []
    return x


def test_messages_of_one_kind_equal_the_ledger(spark):
    found, r = list(ledgers(1)), random.Random(2)
    scopes, held = tables(spark, found)
    asks, stops, ends = [], [], []
    for x in found:
        for at in range(12):
            i = r.choice([*x.queue, *x.held, *x.ended, "", f"new{r.randint(0, 9)}", f"new{r.randint(0, 9)}"])
            asks.append((x.scope[0], at, i, r.choice((0, 1, 1, 2)), r.choice(("w", "w", "w", "")), r.random() < 0.1))
            stops.append((x.scope[0], at, i, r.choice(("cancel", "undelivered"))))
            ends.append((x.scope[0], at, i, x.held[i]["permit"] if i in x.held and r.random() < 0.7 else r.choice(("wrong", None))))
    m = lambda rows, ddl: spark.createDataFrame(rows, "scope string, ordinal long, request_id string, " + ddl)
    got = lambda df: {(x["scope"], x["ordinal"]): x["outcome"] for x in df.collect()}
    got_asks = got(admission.enqueue(m(asks, "cost long, requester string, other_scope boolean"), held, scopes, 6))
    got_stops, got_ends = got(admission.cancel(m(stops, "kind string"), held)), got(admission.complete(m(ends, "permit_id string"), held))
    for x in found:
        a, b, c = still(x), still(x), still(x)
        for s, at, i, cost, who, other in (y for y in asks if y[0] == x.scope[0]):
            want = a.apply({"kind": "request", "at": NOON, "request_id": i, "cost": cost, "requester": who, "scope": ("else", "", "") if other else None})
            assert got_asks[s, at] == want[0][1], (s, at, want)
        for s, at, i, kind in (y for y in stops if y[0] == x.scope[0]):
            assert got_stops[s, at] == b.apply({"kind": kind, "at": NOON, "request_id": i})[0][1]
        for s, at, i, permit in (y for y in ends if y[0] == x.scope[0]):
            assert got_ends[s, at] == c.apply({"kind": "complete", "at": NOON, "request_id": i, "permit_id": permit})[0][1]
    assert len(set(got_asks.values())) == 8 and len(set(got_stops.values())) == 3 and set(got_ends.values()) == {"completed", "ignored"}


def test_windows_and_blocks_equal_the_ledger(spark):
    found = list(ledgers(3, 80))
    scopes, held = tables(spark, found)
    now = F.lit(micros(NOON)).cast("long")
    got = {x["scope"]: x for x in admission.advance(scopes, now).withColumn("stopped", admission.blocked(F.col("disabled"), F.col("blocked_us"), now)).collect()}
    for x in found:
        g, advanced = got[x.scope[0]], x.advance(NOON)
        assert (g["advanced"], g["window_id"], g["remaining"], g["blocked_us"], g["reset_us"]) == (advanced, x.window, x.remaining, micros(x.blocked), micros(x.reset))
        assert g["stopped"] == (x.disabled or (x.blocked is not None and x.blocked > NOON))
    assert 10 < sum(x["advanced"] for x in got.values()) < 80
    some = spark.createDataFrame([(x.scope[0],) for x in found[::2]], "scope string")
    s, h = admission.disable(scopes, held, some)
    ended = {x["scope"]: x["n"] for x in h.where("answer is not null").groupBy("scope").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k, x in enumerate(found):
        assert ended.get(x.scope[0], 0) == (0 if k % 2 else len(x.queue))
    assert s.where("disabled").count() == sum(x.disabled or not k % 2 for k, x in enumerate(found))


def test_early_messages_and_rollovers(spark):
    r = random.Random(4)
    rows = [("hot" if r.random() < 0.9 else r.choice("ab"), i, r.choice(("request", "tick", "observe", "odd"))) for i in range(400)]
    rows[130], rows[200] = ("hot", 130, "start"), ("a", 200, "start")
    d = spark.createDataFrame(rows, "scope string, ordinal long, kind string")
    got = {x["ordinal"]: (x["early"], x["handled_at"], x["place"]) for x in admission.deferred(d).collect()}
    for s, start in (("hot", 130), ("a", 200), ("b", None)):
        mine = [i for k, i, _ in rows if k == s]
        order = sorted(mine, key=lambda i: (max(i, start), i != start, i)) if start is not None else mine
        for n, i in enumerate(order):
            assert got[i] == ((True, None, None) if start is None else (i < start, max(i, start), n))
    runs = {x["ordinal"]: x["run"] for x in admission.rollovers(d, 7).collect()}
    seen = {}
    for s, i, kind in rows:
        assert runs[i] == seen.get(s, 0) // 7
        seen[s] = seen.get(s, 0) + (kind in admission.SURFACE and kind not in admission.UNCOUNTED)


def test_times_without_a_zone_are_utc(spark):
    texts = {"2025-03-01T09:30:00": 0, "2025-03-01T09:30:00Z": 0, "2025-03-01T11:30:00+02:00": 0, "2025-03-01T09:30:00.000250": 250, "soon": None}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", admission.utc_micros(F.col("t")).alias("u"), admission.utc_iso(admission.utc_micros(F.col("t"))).alias("i")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for x in got:
        want = None if texts[x["t"]] is None else micros(NOON) + texts[x["t"]]
        assert x["u"] == want and x["i"] == (None if want is None else (NOON + timedelta(microseconds=texts[x["t"]])).isoformat())


def test_commands_equal_the_controller(spark):
    """Every kind of command and event against controllers in many states; each is judged on its own copy."""
    r, rows, want = random.Random(6), [], {}
    for n in range(1200):
        c = controller.Controller("shop", r.randint(0, 3), r.choice(("active", "syncing", "deactivating", "inactive", "deactivation_failed")))
        c.syncs, c.remediations = ({o: 0 for o in ("op1", "op2") if r.random() < p} for p in (0.25, 0.25))
        c.deactivation, c.fenced = (r.choice((None, None, "op3")), r.random() < 0.5)
        if r.random() < 0.1:
            c.known["cmd"] = ("accepted", "before")
        kind = r.choice((*commands.COMMANDS, *commands.EVENTS))
        m = {"kind": kind, "store_key": r.choice(("shop",) * 9 + ("other",)), "command_id": r.choice(("cmd",) * 9 + (" ", None)), "expected_generation": c.generation + r.choice((-4, -1, -1, 0, 0, 0, 1)), "sync_sequence": r.choice(("s1", "s1", "s1", "")), "operation_id": r.choice(("op1", "op2", "op3", "")), "status": r.choice(("running", "completed", "failed")), "result_status": r.choice(("succeeded", "partial", "failed")), "lifecycle_generation": c.generation + r.choice((-1, 0, 1)), "settings": {} if r.random() < 0.9 else {"mode": "odd"}}
        rows.append((n, "shop", c.generation, c.state, list(c.syncs), list(c.remediations), c.deactivation, c.fenced, "accepted" if c.known and m["command_id"] == "cmd" else None, "before" if c.known else None, kind, m["store_key"], m["command_id"], m["expected_generation"], m["sync_sequence"], m["operation_id"], m["status"], m["result_status"], m["lifecycle_generation"], not m["settings"]))
        reply, duplicate, op = c.handle(m)
        want[n] = (kind, reply, duplicate, op, c.state, c.generation)
    d = spark.createDataFrame(rows, "n long, store_key string, lifecycle_generation long, state string, syncs array<string>, remediations array<string>, deactivation string, fenced boolean, seen_reply string, seen_operation string, kind string, store string, command_id string, expected_generation long, sync_sequence string, operation string, status string, result_status string, event_generation long, settings_ok boolean")
    got = {x["n"]: (x["kind"], x["reply"], x["duplicate"], x["operation_id"], x["new_state"], x["new_generation"]) for x in commands.decided(d).collect()}
    assert got == want and len({x[1] for x in want.values()}) > 12


def test_controllers_that_start_anew(spark):
    rows = [(n, ["op"] if busy else [], [], 3, state) for n, (busy, state) in enumerate((b, s) for b in (True, False) for s in ("active", "syncing", "inactive"))]
    d = spark.createDataFrame(rows, "n long, syncs array<string>, remediations array<string>, authority_generation long, authority_state string").withColumns({"lifecycle_generation": F.lit(0), "state": F.lit("x")})
    got = {x["n"]: (x["state"], x["lifecycle_generation"]) for x in commands.bootstrapped(d).collect()}
    assert got == {n: (lambda c: (c.state, c.generation))(controller.Controller.bootstrap("s", (3, state), dict.fromkeys(syncs, 3))) for n, syncs, _, _, state in rows}


@pytest.mark.parametrize("name", ["quota_cancels", "quota_completions"])
def test_messages_are_read_once(spark, sf, name):
    """The first of a request is found where its rows are, without a second reading of all messages."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_places_are_looked_for_among_the_first_requests(spark):
    """Nothing is settled; a scope's rows beyond its places go to no task together, and rows without a key are kept."""
    asks = spark.createDataFrame([("s", n, f"r{n % 4}", 1, False, "w") for n in range(9)] + [("off", 1, "a", 1, False, "w"), ("s", 9, None, 1, False, "w")], "scope string, ordinal long, request_id string, cost int, other_scope boolean, requester string")
    held = spark.createDataFrame([("s", "r1", "pending"), ("s", "x", "ended")], "scope string, request_id string, status string")
    scopes = spark.createDataFrame([("s", False), ("off", True)], "scope string, disabled boolean")
    got = admission.enqueue(asks, held, scopes, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "_bucket" not in plan
    want = {("s", n): {0: "queued", 1: "duplicate"}.get(n % 4, quota.FULL) for n in range(9)} | {("s", 4): "duplicate", ("s", 8): "duplicate", ("off", 1): quota.DISABLED, ("s", 9): quota.FULL}
    assert {(r["scope"], r["ordinal"]): r["outcome"] for r in got.collect()} == want
    stops = spark.createDataFrame([("s", 1, None, "cancel"), ("s", 2, "x", "cancel")], "scope string, ordinal long, request_id string, kind string")
    assert admission.cancel(stops, held).count() == 2
