"""Quota admission per scope.

For one instant the decisions are windows and ordered cases.  A log of messages is order-dependent (grants
depend on completions, window ids are a hash chain), so it is a keyed fold: ``Ledger`` holds one scope's
state, ``replay`` folds a batch log, and ``streaming.quota`` keeps the same ledger as stream state.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import opaque_key_py
from . import ordered

# The ceiling of a scope's queue; seconds of block for an exhaustion that tells neither when nor how long.
MAX_PENDING = 350
DEFAULT_RETRY_SECONDS = 60
EMPTY_ID, BAD_COST, OTHER_SCOPE, NO_REQUESTER, DISABLED, FULL = ("request_id must not be empty", "permit cost must be positive", "quota scope does not match coordinator", "requester workflow ID is required", "quota scope is disabled", "quota pending queue is at capacity")


def denial(requests: DataFrame, max_pending: int = MAX_PENDING) -> DataFrame:
    """``requests`` with ``denial`` (null: queued), all arriving at one instant in the order of ``ordinal``.

    Only requests that pass all other tests take a place in the queue.
    """
    early = (
        F.when(F.col("request_id") == "", EMPTY_ID)
        .when(F.col("cost") <= 0, BAD_COST)
        .when(F.col("other_scope"), OTHER_SCOPE)
        .when(F.col("requester") == "", NO_REQUESTER)
        .when(F.col("disabled"), DISABLED)
    )
    cap = min(max(1, max_pending), MAX_PENDING)
    out = ordered.running(requests.withColumn("_early", early), ["scope"], ["ordinal"], _ahead=F.col("_early").isNull().cast("long"))
    return out.withColumn("denial", F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("_ahead") >= cap, FULL)).drop("_early", "_ahead")


def grants(queue: DataFrame) -> DataFrame:
    """The longest prefix of each scope's queue within its free slots and balance (null: unlimited).

    Costs are positive, so rank and running cost only grow and a filter is the prefix.
    """
    placed = ordered.running(queue, ["scope"], ["ordinal"], queue_rank=F.lit(1).cast("long"), running_cost="cost")
    placed = placed.withColumns({"queue_rank": F.col("queue_rank") + 1, "running_cost": F.col("running_cost") + F.col("cost")})
    return placed.where((F.col("queue_rank") <= F.col("free_slots")) & (F.col("remaining").isNull() | (F.col("running_cost") <= F.col("remaining"))))


def timer_micros(blocked_until: Column, reset_at: Column, now: Column) -> Column:
    """Microseconds to the earlier boundary, 0 if it is past, null without one."""
    return F.when(blocked_until.isNotNull() | reset_at.isNotNull(), F.greatest(F.lit(0), F.least(blocked_until, reset_at) - now))


def recent_ids(rows: DataFrame, part: str, order: str, size: int) -> DataFrame:
    """The ``size`` newest ids of each partition: a ranked cut, made before the shuffle."""
    n = F.row_number().over(W.partitionBy(part).orderBy(F.col(order).desc()))
    return rows.withColumn("recency", n).where(F.col("recency") <= size)


def repaired_order(order: DataFrame, members: DataFrame, part: str = "scope", key: str = "request_id") -> DataFrame:
    """(part, key, place): members in the order of their first entry in ``order`` (part, key, ordinal); those without an entry follow by key.

    Entries that are no members are dropped, repeats count once.
    """
    first = order.groupBy(part, key).agg(F.min("ordinal").alias("_at"))
    j = members.select(part, key).distinct().join(first, [part, key], "left")
    return ordered.numbered(j, [part], [F.col("_at").asc_nulls_last(), key], "place").drop("_at")


def compacted_terminals(ended: DataFrame, size: int, part: str = "scope", key: str = "request_id") -> DataFrame:
    """The ``size`` latest ended requests of each scope by their first end, with ``place`` from 0 for the latest."""
    first = ended.groupBy(part, key).agg(F.min("ordinal").alias("ordinal"))
    n = F.row_number().over(W.partitionBy(part).orderBy(F.col("ordinal").desc())).cast("long") - 1
    return first.withColumn("place", n).where(F.col("place") < max(0, size))


def observed(observations: DataFrame) -> DataFrame:
    """Balance and boundaries of each scope after observations that don't close a window: (scope, limit, remaining, reset_us, blocked_us).

    ``observations``: scope, own_scope, ordinal, at_us, limit, remaining, reset_us, retry_after_seconds, exhausted.
    Only those of the own scope count.  The limit is the latest told; the balance never rises and is 0 once
    exhausted; a reset never comes earlier; a block ends at the latest of each exhaustion's own reset and retry,
    which is a minute later if it tells neither.
    """
    o = observations.where("scope <=> own_scope")
    retry = F.when(F.col("retry_after_seconds").isNotNull(), F.col("at_us") + F.greatest(F.lit(0.0), F.col("retry_after_seconds")) * 1_000_000).when(F.col("reset_us").isNull(), F.col("at_us") + DEFAULT_RETRY_SECONDS * 1_000_000)
    return o.groupBy("scope").agg(
        F.max_by(F.greatest(F.lit(0), "limit"), F.when(F.col("limit").isNotNull(), F.col("ordinal"))).alias("limit"),
        F.min(F.when(F.col("exhausted"), F.lit(0)).when(F.col("remaining").isNotNull(), F.greatest(F.lit(0), "remaining"))).cast("long").alias("remaining"),
        F.max("reset_us").alias("reset_us"),
        F.max(F.when(F.col("exhausted"), F.greatest(F.col("reset_us"), retry.cast("long")))).alias("blocked_us"),
    )


def canceled_by_generation(requests: DataFrame, cancellations: DataFrame) -> DataFrame:
    """(scope, store_no, lifecycle_generation, canceled): requests, pending or granted, that each cancellation of a generation takes; empty ids are no requests."""
    r = requests.where("request_id <> ''").select("scope", "request_id", "store_no", "lifecycle_generation").distinct()
    return r.join(cancellations.select("store_no", "lifecycle_generation").distinct(), ["store_no", "lifecycle_generation"], "left_semi").groupBy("scope", "store_no", "lifecycle_generation").agg(F.count(F.lit(1)).alias("canceled"))


def started_scopes(requests: DataFrame, limit: Column) -> DataFrame:
    """One row for each scope that a request starts or finds: its first request, limit and balance, which begins at the limit."""
    return requests.groupBy("scope").agg(F.min("ordinal").alias("started_by")).withColumn("configured_limit", limit.cast("long")).withColumn("remaining", limit.cast("long"))


def snapshots(scopes: DataFrame, queue: DataFrame, held: DataFrame, max_in_flight: int, max_pending: int = MAX_PENDING) -> DataFrame:
    """Every scope in twelve fields.

    ``scopes``: provider, credential_key, quota_class, limit, remaining, reset_us, blocked_us, disabled, window_id (null: the
    first one); ``queue`` and ``held`` (its three names, request_id): requests that wait, and those with a permit.
    """
    scope = ["provider", "credential_key", "quota_class"]
    count = lambda rows, name: rows.groupBy(*scope).agg(F.count(F.lit(1)).alias(name))
    j = scopes.join(count(queue, "pending_count"), scope, "left").join(count(held, "reservation_count"), scope, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return j.select(
        F.concat_ws("/", *scope).alias("quota_scope"), F.col("limit").alias("configured_limit"), "remaining", "reset_us", "blocked_us", F.lit(max_in_flight).cast("long").alias("max_in_flight"), F.lit(min(max(1, max_pending), MAX_PENDING)).cast("long").alias("max_pending_requests"),
        n("reservation_count").alias("in_flight"), "disabled", n("pending_count").alias("pending_count"), n("reservation_count").alias("reservation_count"), F.coalesce("window_id", F.lit("initial")).alias("quota_window_id"),
    )


def utc(t: datetime | None) -> datetime | None:
    """Times without a zone are UTC."""
    return t.replace(tzinfo=UTC) if t is not None and t.tzinfo is None else t


class Ledger:
    """One scope's queue, balance, permits and recently ended requests."""

    def __init__(self, scope: tuple[str, str, str], limit: int | None = None, max_in_flight: int = 4, max_pending: int = MAX_PENDING, remember: int = 2000, remaining: int | None = None, roll_after: int = 10_000, started: bool = True):
        self.roll_after, self.started = roll_after, started
        self.deferred: list[dict] = []
        self.rollovers = 0
        self.scope, self.limit, self.max_in_flight, self.max_pending, self.remember = scope, limit, max_in_flight, max_pending, remember
        self.remaining = limit if remaining is None else remaining
        self.window = "initial"
        self.blocked: datetime | None = None
        self.reset: datetime | None = None
        self.disabled = False
        self.messages = 0
        self.queue: OrderedDict[str, dict] = OrderedDict()
        self.held: OrderedDict[str, dict] = OrderedDict()
        self.ended: OrderedDict[str, None] = OrderedDict()

    # -- messages: each returns (request id, outcome, permit id) rows

    def apply(self, m: dict) -> list[tuple[str | None, str, str | None]]:
        """One message, then the grants that it makes possible at its time.

        Before the scope is started (message ``start``), messages wait; the start handles them in the order of
        their arrival, each at its own time, and grants at the start's.
        """
        if not self.started:
            if m["kind"] != "start":
                self.deferred.append(m)
                return [(m.get("request_id"), "deferred", None)]
            self.started, waiting, self.deferred = True, self.deferred, []
            self.compact()
            out = [row for early in waiting for row in self._one(early)]
            return out + self._settle(utc(m["at"]))
        return self._one(m) + self._settle(utc(m["at"]))

    def _one(self, m: dict) -> list:
        self.messages += m["kind"] not in ("start", "tick", "undelivered")
        return getattr(self, f"_{m['kind']}")(m, utc(m["at"]))

    def _settle(self, now: datetime) -> list:
        before = self.window
        out = self.grant(now)
        if self.window != before or self.messages >= self.roll_after:  # the state is carried over, compact
            self.compact()
            self.messages = 0
            self.rollovers += 1
        return out

    def _start(self, m: dict, at: datetime) -> list:
        return []

    def _undelivered(self, m: dict, at: datetime) -> list:
        """A grant that couldn't be delivered is canceled: its slot is free, its cost is spent."""
        return [(r, "undelivered" if outcome == "canceled" else outcome, p) for r, outcome, p in self._cancel(m, at)]

    def compact(self) -> None:
        """Normal form of a state that was carried over: no more ended requests than are remembered, the earliest go."""
        for r in [r for r in self.queue if r in self.held]:
            del self.queue[r]
        while len(self.ended) > max(0, self.remember):
            self.ended.popitem(last=False)

    def snapshot(self) -> dict:
        """The scope in twelve fields."""
        return {
            "scope": self.scope, "configured_limit": self.limit, "remaining": self.remaining, "reset_at": self.reset, "blocked_until": self.blocked, "max_in_flight": self.max_in_flight,
            "max_pending_requests": min(max(1, self.max_pending), MAX_PENDING), "in_flight": len(self.held), "disabled": self.disabled, "pending_count": len(self.queue), "reservation_count": len(self.held), "quota_window_id": self.window,
        }

    def _end(self, request: str) -> None:
        if self.remember <= 0:
            self.ended.clear()
        elif request not in self.ended:
            self.ended[request] = None
            while len(self.ended) > self.remember:
                self.ended.popitem(last=False)

    def why_denied(self, m: dict) -> str | None:
        tests = (
            (not m["request_id"], EMPTY_ID),
            ((m["cost"] or 0) <= 0, BAD_COST),
            (tuple(m.get("scope") or self.scope) != self.scope, OTHER_SCOPE),
            (not m["requester"], NO_REQUESTER),
            (self.disabled, DISABLED),
            (len(self.queue) >= min(max(1, self.max_pending), MAX_PENDING), FULL),
        )
        return next((text for failed, text in tests if failed), None)

    def _request(self, m: dict, at: datetime) -> list:
        r = m["request_id"]
        if r in self.queue or r in self.held or r in self.ended:
            return [(r, "duplicate", None)]
        if (why := self.why_denied(m)) is not None:
            return [(r, why, None)]
        self.queue[r] = {"cost": m["cost"], "store": m.get("store_key"), "generation": m.get("lifecycle_generation")}
        return [(r, "queued", None)]

    def _cancel(self, m: dict, at: datetime) -> list:
        r = m["request_id"]
        if not r or r in self.ended:
            return [(r, "ignored", None)]
        self.queue.pop(r, None)
        self.held.pop(r, None)  # the slot is free again, the cost is not given back
        self._end(r)
        return [(r, "canceled", None)]

    def _cancel_generation(self, m: dict, at: datetime) -> list:
        owner = (m.get("store_key"), m.get("lifecycle_generation"))
        gone = sorted(r for part in (self.queue, self.held) for r, x in part.items() if (x["store"], x["generation"]) == owner)
        for r in gone:
            self.queue.pop(r, None)
            self.held.pop(r, None)
            self._end(r)
        return [(r, "canceled", None) for r in gone]

    def _complete(self, m: dict, at: datetime) -> list:
        r = m["request_id"]
        if r in self.held and self.held[r]["permit"] == m.get("permit_id"):
            del self.held[r]
            self._end(r)
            return [(r, "completed", m.get("permit_id"))]
        return [(r, "ignored", None)]

    def _observe(self, m: dict, at: datetime) -> list:
        if tuple(m.get("scope") or self.scope) != self.scope:
            return [(m.get("request_id"), "ignored", None)]
        if m.get("limit") is not None:
            self.limit = max(0, m["limit"])
        if m.get("remaining") is not None:  # a late report can't raise the balance
            seen = max(0, m["remaining"])
            self.remaining = seen if self.remaining is None else min(self.remaining, seen)
        later = lambda a, b: max((t for t in (a, b) if t is not None), default=None)
        reset = utc(m.get("reset_at"))
        self.reset = later(self.reset, reset)
        if m.get("exhausted"):
            self.remaining = 0
            wait = m.get("retry_after_seconds")
            retry = at + timedelta(seconds=max(0, wait)) if wait is not None else None if reset is not None else at + timedelta(seconds=DEFAULT_RETRY_SECONDS)
            self.blocked = later(self.blocked, later(reset, retry))
        return [(m.get("request_id"), "observed", None)]

    def _disable(self, m: dict, at: datetime) -> list:
        self.disabled = True
        gone = list(self.queue)
        self.queue.clear()
        for r in gone:
            self._end(r)
        return [(r, DISABLED, None) for r in gone]

    def _tick(self, m: dict, at: datetime) -> list:
        return []

    # -- time and grants

    def advance(self, now: datetime) -> bool:
        """Opens the next window if a boundary has passed; the balance is the limit again."""
        due = lambda t: t is not None and t <= now
        if due(self.blocked) and self.reset is not None and not due(self.reset):
            self.blocked = self.reset
        passed = [t for t in (self.blocked, self.reset) if due(t)]
        if not passed:
            return False
        self.window = opaque_key_py("permit-reservation", self.window, max(passed).isoformat())
        self.blocked = None if due(self.blocked) else self.blocked
        self.reset = None if due(self.reset) else self.reset
        self.remaining = self.limit
        return True

    def grant(self, now: datetime) -> list[tuple[str, str, str]]:
        self.advance(now)
        out = []
        if self.disabled or (self.blocked is not None and self.blocked > now):
            return out
        while self.queue and len(self.held) < self.max_in_flight:
            r, x = next(iter(self.queue.items()))
            if self.remaining is not None and x["cost"] > self.remaining:
                break  # the head is never passed by
            del self.queue[r]
            permit = "permit/" + opaque_key_py("permit-reservation", r, self.window)
            self.held[r] = x | {"permit": permit}
            if self.remaining is not None:
                self.remaining -= x["cost"]
            out.append((r, "granted", permit))
        return out

    def timer(self, now: datetime) -> timedelta | None:
        times = [t for t in (self.blocked, self.reset) if t is not None]
        return max(min(times) - now, timedelta(0)) if times else None

    # -- state as text, for stream state

    def dump(self) -> str:
        iso = lambda t: t.isoformat() if t else None
        return json.dumps([self.scope, self.limit, self.max_in_flight, self.max_pending, self.remember, self.remaining, self.window, iso(self.blocked), iso(self.reset), self.disabled, self.messages, list(self.queue.items()), list(self.held.items()), list(self.ended), self.roll_after, self.started, [{k: iso(utc(v)) if k in ("at", "reset_at") else v for k, v in m.items()} for m in self.deferred], self.rollovers])

    @classmethod
    def load(cls, text: str) -> Ledger:
        x = json.loads(text)
        new = cls(tuple(x[0]), x[1], x[2], x[3], x[4])
        back = lambda t: datetime.fromisoformat(t) if t else None
        new.remaining, new.window, new.blocked, new.reset, new.disabled, new.messages = x[5], x[6], back(x[7]), back(x[8]), x[9], x[10]
        new.queue, new.held, new.ended = OrderedDict(map(tuple, x[11])), OrderedDict(map(tuple, x[12])), OrderedDict.fromkeys(x[13])
        new.roll_after, new.started, new.deferred, new.rollovers = x[14], x[15], [{k: back(v) if k in ("at", "reset_at") else v for k, v in m.items()} for m in x[16]], x[17]
        return new


#: In a log, the permit that has been held longest.
OLDEST = "oldest"
OUTCOME = "scope string, ordinal long, kind string, request_id string, outcome string, permit_id string, window_id string, remaining long, in_flight long"


def outcome_rows(ledger: Ledger, name: str, messages: Iterator[dict]) -> Iterator[tuple]:
    for m in messages:
        if m.get("permit_id") == OLDEST and ledger.held:
            r, x = next(iter(ledger.held.items()))
            m = m | {"request_id": r, "permit_id": x["permit"]}
        for r, outcome, permit in ledger.apply(m):
            yield name, int(m["ordinal"]), m["kind"], r, outcome, permit, ledger.window, ledger.remaining, len(ledger.held)


def clean(row: dict) -> dict:
    """pandas values as Python ones: NaN and NaT are None."""
    import pandas as pd

    out = {}
    for k, v in row.items():
        v = None if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)) else v
        out[k] = v.to_pydatetime() if isinstance(v, pd.Timestamp) else int(v) if k in ("cost", "limit", "remaining", "lifecycle_generation") and v is not None else v
    return out


def replay(messages: DataFrame, **settings: int | None) -> DataFrame:
    """Folds each scope's messages in the order of ``ordinal`` into outcome rows.

    A ``permit_id`` of ``OLDEST`` in a log stands for the request that holds the oldest permit.
    A scope is a serial log by nature: its messages go to one task, in batches of the sorted partition, and
    only its ledger is held.  Scopes run in parallel.
    """
    import pandas as pd

    cols = messages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, ledger = None, None
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False, name=None):
                m = clean(dict(zip(cols, values, strict=True)))
                if m["scope_key"] != name:
                    name, ledger = m["scope_key"], Ledger((m["scope_key"], "", ""), **settings)
                rows.extend(outcome_rows(ledger, name, iter([m])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"remaining": "Int64"})

    return messages.repartition("scope_key").sortWithinPartitions("scope_key", "ordinal").mapInPandas(run, OUTCOME)
