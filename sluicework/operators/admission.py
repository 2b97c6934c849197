"""What one kind of message does to quota scopes that arrive at one instant, for all scopes at once.

State is three tables: ``scopes`` (scope, limit, remaining, reset_us, blocked_us, disabled, window_id), ``held``
(scope, request_id, status: pending, reserved or ended, and for those with a permit permit_id) and the messages.
Each effect is a join of messages with the state, or an expression over a scope's row; no scope's messages are
handled one after the other.  Logs in which kinds depend on each other are the folds of ``quota``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys
from . import ordered
from .quota import BAD_COST, DISABLED, EMPTY_ID, FULL, MAX_PENDING, NO_REQUESTER, OTHER_SCOPE

ID = ["scope", "request_id"]
#: Kinds of messages by what handles them; the last group doesn't count towards a roll-over.
SURFACE = {"request": "enqueue", "cancel": "cancel", "cancel_generation": "cancel", "complete": "complete", "observe": "observe", "disable": "disable", "undelivered": "cancel", "start": "start", "tick": "advance"}
UNCOUNTED = ("start", "tick", "undelivered")


def blocked(disabled: Column, blocked_us: Column, now_us: Column) -> Column:
    """Whether a scope grants nothing now: for good, or until its block ends (the end itself is free)."""
    return F.coalesce(disabled, F.lit(False)) | F.coalesce(blocked_us > now_us, F.lit(False))


def utc_micros(text: Column) -> Column:
    """Microseconds of an ISO 8601 time; one without a zone is UTC, whatever the session's zone; null if it is none."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.unix_micros(F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(text, F.lit("Z")))))


def utc_iso(micros: Column) -> Column:
    """ISO 8601 of microseconds, in UTC, with a fraction only where there is one."""
    rest = F.pmod(micros, F.lit(1_000_000))
    days = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ((micros - rest) / 1_000_000).cast("decimal(18,6)"))
    whole = F.date_format(days, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))), F.lit("+00:00"))


def surface(messages: DataFrame) -> DataFrame:
    """``messages`` with ``handler`` (null: unknown, which nothing handles) and ``counted``: whether they count towards a roll-over."""
    handler = F.lit(None).cast("string")
    for kind, name in SURFACE.items():
        handler = F.when(F.col("kind") == kind, name).otherwise(handler)
    return messages.withColumn("handler", handler).withColumn("counted", handler.isNotNull() & ~F.col("kind").isin(*UNCOUNTED))


def deferred(messages: DataFrame) -> DataFrame:
    """``messages`` with ``handled_at``, ``place`` and ``early``: what comes before its scope's start waits for it and is then handled in the order of arrival.

    Without a start, ``handled_at`` and ``place`` are null.  The start itself is handled first of all.
    """
    start = messages.where("kind = 'start'").groupBy("scope").agg(F.min("ordinal").alias("_start"))
    j = ordered.matched(messages, messages.select("scope").distinct().join(start, "scope", "left"), ["scope"])
    j = j.withColumn("early", F.coalesce(F.col("ordinal") < F.col("_start"), F.lit(True))).withColumn("handled_at", F.greatest("ordinal", "_start")).withColumn("handled_at", F.when(F.col("_start").isNotNull(), F.col("handled_at")))
    known = j.where("_start is not null").withColumn("_first", F.col("ordinal") != F.col("_start"))
    placed = ordered.numbered(known, ["scope"], ["handled_at", "_first", "ordinal"], "place").drop("_first")
    return placed.unionByName(j.where("_start is null").withColumn("place", F.lit(None).cast("long"))).drop("_start")


def rollovers(messages: DataFrame, roll_after: int) -> DataFrame:
    """``messages`` with ``run``: how many times their scope has been carried over before them, by the number of counted messages."""
    told = surface(messages)
    placed = ordered.running(told, ["scope"], ["ordinal"], _n=F.col("counted").cast("long"))
    return placed.withColumn("run", F.expr(f"_n div {max(1, roll_after)}")).drop("_n", "handler", "counted")


def enqueue(requests: DataFrame, held: DataFrame, scopes: DataFrame, max_pending: int = MAX_PENDING) -> DataFrame:
    """``requests`` (scope, ordinal, request_id, cost, requester, other_scope) with ``outcome``: duplicate, why they are denied, or queued.

    Ids that wait, are reserved or have ended are duplicates.  Of an id's requests, the first that passes the tests
    takes a place, as long as there is one besides those that wait already; whatever names it later is a duplicate.
    """
    cap = min(max(1, max_pending), MAX_PENDING)
    waiting = held.where("status = 'pending'").groupBy("scope").agg(F.count(F.lit(1)).alias("_waiting"))
    off = scopes.where("disabled").select("scope").distinct().withColumn("_off", F.lit(True))
    why = F.when(F.col("request_id") == "", EMPTY_ID).when(F.col("cost") <= 0, BAD_COST).when(F.col("other_scope"), OTHER_SCOPE).when(F.col("requester") == "", NO_REQUESTER)
    j = requests.withColumn("_why", why).join(off, "scope", "left").withColumn("_why", F.coalesce("_why", F.when(F.col("_off"), DISABLED))).drop("_off")
    j = j.join(held.select(*ID).distinct().withColumn("_known", F.lit(True)), ID, "left").withColumn("_why", F.when(F.col("_known"), "duplicate").otherwise(F.col("_why"))).drop("_known")
    # the rows of an id are together since the join; of a scope's first requests no more than have places are looked at
    j = j.withColumn("_first", F.min(F.when(F.col("_why").isNull(), F.col("ordinal"))).over(W.partitionBy(*ID)))
    own = j.where("_why is null and ordinal = _first").select(*ID, "ordinal").withColumn("_nth", F.row_number().over(W.partitionBy("scope").orderBy("ordinal"))).where(F.col("_nth") <= cap)
    placed = own.join(waiting, "scope", "left").where(F.coalesce("_waiting", F.lit(0)) + F.col("_nth") <= cap).select(*ID, F.lit(True).alias("_in"))
    j = j.join(placed, ID, "left")
    again = F.coalesce(F.col("_in") & (F.col("ordinal") > F.col("_first")), F.lit(False))
    out = F.when(again, "duplicate").when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("_in"), "queued").otherwise(FULL)
    return j.withColumn("outcome", out).drop("_why", "_first", "_in")


def cancel(cancellations: DataFrame, held: DataFrame) -> DataFrame:
    """``cancellations`` (scope, ordinal, request_id, kind: cancel or undelivered) with ``outcome`` and ``freed`` (pending, reserved, or null).

    The first of a request ends it, known or not, so that it can't come later; the others, and those of ended
    requests, are ignored.  A freed permit makes room, but its cost stays spent.
    """
    # the rows of a request are together since the join
    j = cancellations.join(held.select(*ID, "status"), ID, "left").withColumn("_first", F.min("ordinal").over(W.partitionBy(*ID)))
    over = (F.col("request_id") == "") | F.coalesce(F.col("status") == "ended", F.lit(False)) | (F.col("ordinal") > F.col("_first"))
    name = F.when(F.col("kind") == "undelivered", "undelivered").otherwise("canceled")
    return j.withColumn("outcome", F.when(over, "ignored").otherwise(name)).withColumn("freed", F.when(~over, F.col("status"))).drop("_first", "status")


def complete(completions: DataFrame, held: DataFrame) -> DataFrame:
    """``completions`` (scope, ordinal, request_id, permit_id) with ``outcome``: the first that names a reserved request and its own permit completes it."""
    reserved = held.where("status = 'reserved'").select(*ID, F.col("permit_id").alias("_own"))
    j = completions.join(reserved, ID, "left").withColumn("_fits", F.coalesce(F.col("permit_id") == F.col("_own"), F.lit(False)))
    j = j.withColumn("_first", F.min(F.when(F.col("_fits"), F.col("ordinal"))).over(W.partitionBy(*ID)))
    return j.withColumn("outcome", F.when(F.col("_fits") & (F.col("ordinal") == F.col("_first")), "completed").otherwise("ignored")).drop("_own", "_fits", "_first")


def disable(scopes: DataFrame, held: DataFrame, disables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``scopes``, ``held``) after scopes were disabled: what waits has ended, refused; permits stay until they are completed."""
    off = disables.select("scope").distinct().withColumn("_off", F.lit(True))
    s = scopes.join(off, "scope", "left").withColumn("disabled", F.col("disabled") | F.coalesce("_off", F.lit(False))).drop("_off")
    gone = F.coalesce("_off", F.lit(False)) & (F.col("status") == "pending")
    h = held.join(off, "scope", "left").withColumn("answer", F.when(gone, DISABLED)).withColumn("status", F.when(gone, "ended").otherwise(F.col("status"))).drop("_off")
    return s, h


def advance(scopes: DataFrame, now_us: Column) -> DataFrame:
    """``scopes`` at ``now_us``, with ``advanced``: a passed boundary opens the next window, in which the balance is the limit again.

    A block that has passed before a reset that hasn't is held until that reset.  The window's id follows from the
    one before and the later of the boundaries that have passed.
    """
    b, r = F.col("blocked_us"), F.col("reset_us")
    due = lambda t: F.coalesce(t <= now_us, F.lit(False))
    s = scopes.withColumn("blocked_us", F.when(due(b) & r.isNotNull() & ~due(r), r).otherwise(b)).withColumn("_now", now_us)
    passed = lambda c: F.coalesce(F.col(c) <= F.col("_now"), F.lit(False))
    last = F.greatest(F.when(passed("blocked_us"), F.col("blocked_us")), F.when(passed("reset_us"), F.col("reset_us")))
    s = s.withColumn("_last", last).withColumn("advanced", F.col("_last").isNotNull())
    window = keys.opaque_key("permit-reservation", keys.json_string(F.col("window_id")), keys.json_string(utc_iso(F.col("_last"))))
    new = {"window_id": F.when(F.col("advanced"), window).otherwise(F.col("window_id")), "remaining": F.when(F.col("advanced"), F.col("limit")).otherwise(F.col("remaining"))}
    new |= {c: F.when(~passed(c), F.col(c)) for c in ("blocked_us", "reset_us")}
    return s.withColumns(new).drop("_now", "_last")
