"""The requester's side of quota admission: waiting for exact answers, releases and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys

REQUESTER, FAILED = "requester canceled while waiting for quota", "requester stopped waiting after request failure"  # fixed values


def expectations(requests: DataFrame, part: str = "requester") -> DataFrame:
    """``requests`` with ``expected``: the first of each id is waited for, a later one is an error."""
    n = F.row_number().over(W.partitionBy(part, "request_id").orderBy("ordinal"))
    return requests.withColumn("expected", n == 1)


def exact_answers(expected: DataFrame, answers: DataFrame, part: str = "requester") -> DataFrame:
    """The first answer that fits each expected request: (part, request_id, answer_ordinal, kind, answered_at).

    Grants fit by scope and cost, denials by scope; answers from before the request, and to a request that has
    been answered, are ignored.
    """
    e = expected.where("expected").select(part, "request_id", F.col("scope").alias("_scope"), F.col("cost").alias("_cost"), F.col("ordinal").alias("_from"))
    fit = answers.join(e, [part, "request_id"]).where("scope = _scope and ordinal > _from and (kind = 'denied' or (kind = 'granted' and cost = _cost))")
    return fit.groupBy(part, "request_id").agg(F.min(F.struct("ordinal", "kind", "at")).alias("a")).select(part, "request_id", F.col("a.ordinal").alias("answer_ordinal"), "a.kind", F.col("a.at").alias("answered_at"))


def outcomes(requests: DataFrame, answers: DataFrame, aborts: DataFrame, part: str = "requester") -> DataFrame:
    """``requests`` with ``outcome``: granted, denied, canceled, failed or waiting; second requests are ``already waiting`` or ``already consumed``.

    ``aborts`` (part, request_id, ordinal, reason: canceled or failed) end a wait that has no answer yet;
    they release the request at its coordinator, and what is answered later is ignored.
    """
    e = expectations(requests, part)
    a = exact_answers(e, answers, part)
    x = aborts.groupBy(part, "request_id").agg(F.min(F.struct("ordinal", "reason")).alias("x"))
    first = e.where("expected").join(a, [part, "request_id"], "left").join(x, [part, "request_id"], "left")
    live = F.col("x.ordinal") > F.col("ordinal")
    early = live & (F.col("answer_ordinal").isNull() | (F.col("x.ordinal") < F.col("answer_ordinal")))
    over = F.when(early, F.col("x.ordinal")).otherwise(F.col("answer_ordinal"))
    first = first.withColumn("outcome", F.when(early, F.col("x.reason")).otherwise(F.coalesce("kind", F.lit("waiting")))).withColumn("over", over)
    again = e.where("not expected").join(first.select(part, "request_id", F.col("over").alias("_over")), [part, "request_id"], "left")
    again = again.withColumn("outcome", F.when(F.col("_over") < F.col("ordinal"), "already consumed").otherwise("already waiting"))
    cols = [*requests.columns, "outcome"]
    return first.select(*cols).unionByName(again.select(*cols))


def releases(done: DataFrame) -> DataFrame:
    """What requesters send back to the coordinator that their scope names: completions of grants, cancellations of waits that ended early."""
    kind = F.when(F.col("outcome") == "granted", "complete").when(F.col("outcome").isin("canceled", "failed"), "cancel")
    reason = F.when(F.col("outcome") == "canceled", REQUESTER).when(F.col("outcome") == "failed", FAILED)
    coordinator = keys.quota_coordinator_id(F.col("provider"), F.col("credential"), F.col("quota_class"))
    return done.withColumn("kind", kind).where("kind is not null").select(coordinator.alias("coordinator"), "request_id", "kind", reason.alias("reason"))


def wait_millis(requested_at: Column, granted_at: Column) -> Column:
    """Whole milliseconds (both in microseconds), 0 at least; null if the request has no time."""
    return F.greatest(F.lit(0), F.expr("1") * F.floor((granted_at - requested_at) / 1000)).cast("long")


def grant_waits(pending: DataFrame, grants: DataFrame, part: str = "scope") -> DataFrame:
    """(part, request_id, wait_ms): grants joined with what was pending when they were made."""
    p = pending.where("requested_us is not null").select(part, "request_id", "requested_us")
    return grants.select(part, "request_id", "granted_us").join(p, [part, "request_id"]).select(part, "request_id", wait_millis(F.col("requested_us"), F.col("granted_us")).alias("wait_ms"))
