"""What each command or event does to the controller that it finds: one row of state, one decision, for all at once.

``found``: store_key, lifecycle_generation, state, syncs and remediations (arrays of operation ids), deactivation
(id or null), fenced, and for a command the answer that its store remembers (seen_reply, seen_operation).  A log
in which commands follow each other is the fold of ``controller``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

# Statuses that end an operation; states without syncs.
TERMINAL = ("completed", "failed", "canceled", "rejected")
STOPPED = ("deactivating", "inactive", "deactivation_failed")
COMMANDS, EVENTS = ("request_sync", "cancel_sync", "start_deactivation"), ("operation_status", "remediation_started", "remediation_finished", "deactivation_fenced")


def invalid(kind: Column, own_store: Column, store: Column, command_id: Column, expected: Column, sequence: Column, operation: Column) -> Column:
    """Why a command is refused before it is looked up, the first reason in order; null for events and for what may be judged."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    why = F.when(~store.eqNullSafe(own_store), "WrongStore").when(blank(command_id), "InvalidCommand").when((kind != "cancel_sync") & (F.coalesce(expected, F.lit(0)) < 0), "InvalidCommand")
    why = why.when((kind == "request_sync") & blank(sequence), "InvalidSyncCommand").when((kind == "cancel_sync") & blank(operation), "InvalidCancelCommand")
    return F.when(kind.isin(*COMMANDS), why)


def bootstrapped(controllers: DataFrame) -> DataFrame:
    """``controllers`` as they start anew, with the authority's generation and state (authority_generation, authority_state): active with work left is syncing."""
    busy = (F.size("syncs") > 0) | (F.size("remediations") > 0)
    state = F.when((F.col("authority_state") == "active") & busy, "syncing").otherwise(F.col("authority_state"))
    return controllers.withColumns({"lifecycle_generation": F.col("authority_generation"), "state": state}).drop("authority_generation", "authority_state")


def decided(found: DataFrame) -> DataFrame:
    """``found`` with ``reply``, ``duplicate``, ``operation_id`` (the one that the reply names), ``new_state`` and ``new_generation``.

    Besides the controller's columns: kind, store (the one that a command names), command_id, expected_generation,
    sync_sequence, operation (the one that it names), status, result_status, event_generation, settings_ok.
    An answer that is remembered is repeated.  What is refused isn't remembered and changes nothing.
    """
    c = F.col
    g, state, kind, e, op = c("lifecycle_generation"), c("state"), c("kind"), c("expected_generation"), c("operation")
    ends = lambda name: F.array_contains(c(name), op)
    refused = invalid(kind, c("store_key"), c("store"), c("command_id"), e, c("sync_sequence"), op)
    seen = kind.isin(*COMMANDS) & c("seen_reply").isNotNull()

    sync = F.when(e != g, "StaleLifecycleGeneration").when(c("deactivation").isNotNull() | state.isin(*STOPPED), "StoreNotSyncable").when(F.size("syncs") > 0, "SyncAlreadyRunning")
    sync = sync.when(F.size("remediations") > 0, "RemediationAlreadyRunning").when(~c("settings_ok"), "InvalidSyncCommand").otherwise("accepted")
    again = state.isin("deactivating", "deactivation_failed")
    known = c("deactivation").isNotNull()
    done = (state == "inactive") & e.isin(g, g - 1)
    failed = (state == "deactivation_failed") & (e == g - 1)
    stop = F.when(known, "accepted").when(done, "completed").when(failed, "failed").when(e != g, "StaleLifecycleGeneration").otherwise("accepted")
    over = c("status").isin(*TERMINAL)
    mine = ends("syncs") | ends("remediations")
    finishes = kind.isin("operation_status", "remediation_finished") & over
    own = finishes & op.eqNullSafe(c("deactivation")) & op.isNotNull()
    noted = F.when((kind == "remediation_finished") & ~over, "ignored").when(finishes & mine & known, "drained").otherwise("noted")
    fences = c("operation").eqNullSafe(c("deactivation")) & op.isNotNull() & (c("event_generation") >= g)
    reply = F.when(seen, c("seen_reply")).when(kind == "request_sync", sync).when(kind == "cancel_sync", F.when(ends("syncs"), "accepted").otherwise("sync is not active")).when(kind == "start_deactivation", stop)
    reply = reply.when(kind == "remediation_started", F.when(~ends("remediations") & state.isin(*STOPPED), "canceled").otherwise("noted")).when(kind == "deactivation_fenced", F.when(fences, "noted").otherwise("ignored")).otherwise(noted)
    reply = F.when(refused.isNotNull(), refused).otherwise(reply)
    out = found.withColumn("reply", reply)

    fresh = refused.isNull() & ~F.coalesce(seen, F.lit(False))
    # the generation in a deactivation's id; each id is one expression, as keys are long ones
    number = F.when(c("reply").isin("completed", "failed") | again, g).otherwise(e + 1)
    stop_id = keys.operation_id("store-deactivation", keys.json_string(c("store_key")), number)
    sync_id = keys.operation_id("store-sync", keys.json_string(c("store_key")), g, keys.json_string(c("sync_sequence")))
    answered = c("reply").isin("accepted", "completed", "failed")
    named = F.when(kind == "request_sync", F.when(answered, sync_id)).when(kind == "start_deactivation", F.when(known, c("deactivation")).when(answered, stop_id)).otherwise(op)
    told = (kind == "start_deactivation") & (known | c("reply").isin("completed", "failed"))
    out = out.withColumn("operation_id", F.when(fresh, named).when(refused.isNull(), c("seen_operation"))).withColumn("duplicate", F.coalesce(refused.isNull() & (seen | told), F.lit(False)))

    left = (F.size(F.array_remove("syncs", op)) > 0) | (F.size(F.array_remove("remediations", op)) > 0)
    left = F.when(op.isNull() | ~finishes, (F.size("syncs") > 0) | (F.size("remediations") > 0)).otherwise(left)
    fenced = c("fenced") | (c("event_generation") > g)
    ended = F.when(fenced, F.when(c("result_status").isin("succeeded", "partial"), "inactive").otherwise("deactivation_failed")).when(left, "syncing").otherwise("active")
    noted_state = F.when(own, ended).when((state == "syncing") & ~left, "active").otherwise(state)
    new = F.when(~fresh, state).when(kind == "request_sync", F.when(c("reply") == "accepted", "syncing").otherwise(state))
    new = new.when(kind == "start_deactivation", F.when(~known & (c("reply") == "accepted"), "deactivating").otherwise(state))
    new = new.when(kind == "remediation_started", F.when((state == "active") & ~ends("remediations"), "syncing").otherwise(state))
    new = new.when(kind == "deactivation_fenced", F.when(fences, "deactivating").otherwise(state)).when((kind == "operation_status") | finishes, noted_state).otherwise(state)
    generation = F.when((kind == "deactivation_fenced") & fences, c("event_generation")).when(own & fenced, F.greatest(g, c("event_generation"))).otherwise(g)
    return out.withColumns({"new_state": new, "new_generation": generation})
