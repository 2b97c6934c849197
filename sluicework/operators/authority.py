"""A store's authority (state and generation) as of each row of its log, and mutations judged by it.

A store leaves its writable states once, with the first deactivation that names its generation; the state
machine that is left has three states, and each command is either nothing or puts the store in one state
whatever it was (a resumption: deactivating, a failure: failed), until the first inactivation that finds it
deactivating.  Composed commands of that kind are their last one, so a prefix of a log is summed up by one
value, summaries of pieces merge in any grouping, and a store's log needs no single task: see ``ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered
from .fence import WRITABLE, fence_status, transitions

# Fixed value: the refusal of a cleanup.
NO_CLEANUP = "cleanup requires DEACTIVATING state"
COMMANDS = ("ensure", "begin", "resume", "mark_inactive", "mark_failed")


def authority(log: DataFrame, stores: DataFrame) -> DataFrame:
    """``log`` with ``lifecycle_state`` and ``lifecycle_generation`` of its store just before each row; null for stores unknown by then.

    ``log``: store_no, ordinal, kind, expected_generation, and for ``ensure`` the state and generation that a new
    store gets (``ensured_state``, ``ensured_generation``).  Rows of other kinds (writes, cleanups) read the
    authority and leave it; one with the ordinal of a command comes after it.  ``stores``: the authority before
    the log.  A store that is known isn't ensured again.
    """
    command = F.col("kind").isin(*COMMANDS)
    log = log.withColumn("_at", F.col("ordinal") * 2 + F.when(command, 0).otherwise(1))
    ensure = F.when(F.col("kind") == "ensure", F.col("_at"))
    # the first ensure of each store; combined before the shuffle, as the other aggregates of stores are
    born = log.groupBy("store_no").agg(F.min(ensure).alias("_born"), F.min_by(F.struct("ensured_state", "ensured_generation"), ensure).alias("_e"))
    first = born.join(stores.select("store_no", F.col("lifecycle_state").alias("_s"), F.col("lifecycle_generation").alias("_g")), "store_no", "left")
    known = F.col("_g").isNotNull()
    first = first.select(
        "store_no",
        F.when(known, F.lit(-1).cast("long")).otherwise(F.col("_born")).alias("_born"),
        F.when(known, F.col("_s")).otherwise(F.col("_e.ensured_state")).alias("_s0"),
        F.when(known, F.col("_g")).otherwise(F.col("_e.ensured_generation")).alias("_g0"),
    ).withColumn("_open", F.col("_s0").isin(*WRITABLE))
    j = log.join(first, "store_no", "left")

    alive = F.col("_at") > F.col("_born")
    begins = (F.col("kind") == "begin") & F.col("_open") & alive & (F.col("expected_generation") == F.col("_g0"))
    fence = j.where(begins).groupBy("store_no").agg(F.min("_at").alias("_fence"))
    j = j.join(fence, "store_no", "left")
    # the generation that is, or will be, deactivated, and whether a row finds the store in it
    j = j.withColumn("_g1", F.col("_g0") + F.when(F.col("_open"), 1).otherwise(0))
    closed = alive & F.when(F.col("_open"), F.coalesce(F.col("_at") > F.col("_fence"), F.lit(False))).otherwise(True)
    j = j.withColumn("_closed", closed)
    own = F.col("_closed") & (F.col("expected_generation") == F.col("_g1"))
    puts = F.when(own & (F.col("kind") == "mark_failed"), "deactivation_failed").when(own & (F.col("kind") == "resume") & (F.col("_g1") > 0), "deactivating")
    j = ordered.neighbour(j, ["store_no"], ["_at"], _put=puts)
    now = F.coalesce("_put", F.when(F.col("_open"), F.lit("deactivating")).otherwise(F.col("_s0")))
    j = j.withColumn("_now", F.when(F.col("_s0") == "inactive", "inactive").otherwise(now))
    ends = F.col("_closed") & (F.col("kind") == "mark_inactive") & (F.col("expected_generation") == F.col("_g1")) & (F.col("_now") == "deactivating")
    end = j.where(ends).groupBy("store_no").agg(F.min("_at").alias("_end"))
    j = j.join(end, "store_no", "left")
    state = F.when(~alive, F.lit(None)).when(~F.col("_closed"), F.col("_s0")).when(F.col("_at") > F.col("_end"), "inactive").otherwise(F.col("_now"))
    generation = F.when(alive, F.when(F.col("_closed"), F.col("_g1")).otherwise(F.col("_g0")))
    return j.withColumns({"lifecycle_state": state, "lifecycle_generation": generation}).drop("_at", "_born", "_s0", "_g0", "_open", "_fence", "_g1", "_closed", "_put", "_now", "_end")


def command_outcomes(log: DataFrame, stores: DataFrame) -> DataFrame:
    """The lifecycle commands of ``log`` with ``outcome``, ``new_state`` and ``new_generation``, each judged by the authority that it finds; a command to an unknown store has ``failed``."""
    held = authority(log, stores).where(F.col("kind").isin(*COMMANDS[1:]))
    out = transitions(held, F.col("kind"), F.col("expected_generation"))
    known = F.col("lifecycle_generation").isNotNull()
    return out.withColumns({"outcome": F.when(known, F.col("outcome")).otherwise("failed"), "new_state": F.when(known, F.col("new_state")), "new_generation": F.when(known, F.col("new_generation"))})


def fence_message(status: Column, state: Column, generation: Column, expected: Column, cleanup: bool = False) -> Column:
    """What a refusal of a write, or of a cleanup, says; null where nothing was refused."""
    said = F.when(status == "stale_generation", F.format_string("expected generation %d, found %d", expected, generation))
    rejected = F.lit(NO_CLEANUP) if cleanup else F.format_string("store state %s rejects retrieval writes", state)
    return said.when(status == "rejected", rejected).when(status == "failed", "KeyError")


def fenced_as_of(rows: DataFrame, commands: DataFrame, stores: DataFrame, allowed: tuple[str, ...] = WRITABLE) -> DataFrame:
    """``rows`` (store_no, ordinal, expected_generation, ...) with ``status`` and ``message``: their fence at their own place in the log of ``commands``."""
    empty = lambda t: F.lit(None).cast(t)
    names = [c for c in rows.columns if c not in ("store_no", "ordinal", "expected_generation")]
    carried = F.struct(*names) if names else F.struct(F.lit(0).alias("_"))
    asks = rows.select("store_no", "ordinal", F.lit("write").alias("kind"), "expected_generation", carried.alias("_row"))
    given = {"ensured_state": "string", "ensured_generation": "long"}
    log = commands.select("store_no", "ordinal", "kind", "expected_generation", *((F.col(c) if c in commands.columns else empty(t)).alias(c) for c, t in given.items()))
    held = authority(log.unionByName(asks, allowMissingColumns=True), stores).where("kind = 'write'")
    status = fence_status(F.col("lifecycle_generation").isNotNull(), F.col("lifecycle_generation"), F.col("lifecycle_state"), F.col("expected_generation"), allowed)
    out = held.withColumn("status", status)
    return out.select("store_no", "ordinal", "expected_generation", *(["_row.*"] if names else []), "status", fence_message(F.col("status"), F.col("lifecycle_state"), F.col("lifecycle_generation"), F.col("expected_generation"), "deactivating" in allowed).alias("message"))


def ingest_as_of(mutations: DataFrame, commands: DataFrame, stores: DataFrame) -> DataFrame:
    """``mutations`` with ``status``: deletions are only fenced; an upsert first needs its body and its hash.

    ``mutations``: store_no, ordinal, mutation, expected_generation, body_status and body_message (null where body
    and hash are right, else how the upsert ends); see ``staging.checked``.  No body takes part in the order.
    """
    fenced = fenced_as_of(mutations, commands, stores)
    bad = (F.col("mutation") == "upsert") & F.col("body_status").isNotNull()
    out = fenced.withColumn("message", F.when(bad, F.col("body_message")).otherwise(F.col("message")))
    return out.withColumn("status", F.when(bad, F.col("body_status")).otherwise(F.col("status"))).drop("body_status", "body_message")
