"""Commands of stores: one serial log per store, folded by a small state machine."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..functions.keys import operation_id_py
from ..functions.policy import MODES, SYNC_SETTINGS, WEIGHT_BOUNDS
from .quota import clean

TERMINAL = ("completed", "failed", "canceled", "rejected")  # fixed values
#: In a log, the operation that the store accepted last.
LATEST = "latest"
STOPPED = ("deactivating", "inactive", "deactivation_failed")
REPLY = "store_key string, ordinal long, kind string, command_id string, reply string, duplicate boolean, operation_id string, state string, generation long, active_syncs long, active_remediations long"


def initial_row(store_key, generation, remember: int = 2000, drain_seconds: float = 300.0) -> dict:  # noqa: ANN001
    """Columns of a controller that a command starts: its proposal counts only until the authority is read; a cancellation proposes generation 0."""
    from pyspark.sql import functions as F

    return {"store_key": store_key, "lifecycle_generation": F.coalesce(generation, F.lit(0)).cast("long"), "command_dedup_window_size": F.lit(remember).cast("long"), "deactivation_drain_timeout_seconds": F.lit(drain_seconds)}


class Controller:
    """State of one store's controller.  ``handle`` takes a command or event and returns (reply, duplicate, operation)."""

    def __init__(self, store: str, generation: int = 0, state: str = "active", remember: int = 2000):
        self.store, self.generation, self.state, self.remember = store, generation, state, remember
        self.syncs: dict[str, int] = {}
        self.remediations: dict[str, int] = {}
        self.deactivation: str | None = None
        self.fenced = False
        self.quotas: list[str] = []
        self.latest: str | None = None
        self.known: OrderedDict[str, tuple[str, str | None]] = OrderedDict()

    def handle(self, m: dict) -> tuple[str, bool, str | None]:
        if (why := self.invalid(m)) is not None:
            return why, False, None
        return getattr(self, f"_{m['kind']}")(m)

    def invalid(self, m: dict) -> str | None:
        """Why a command is refused before it is looked up; events are never refused here."""
        kind, blank = m["kind"], lambda k: not (m.get(k) or "").strip()
        if kind not in ("request_sync", "cancel_sync", "start_deactivation"):
            return None
        tests = (
            (m.get("store_key") != self.store, "WrongStore"),
            (blank("command_id"), "InvalidCommand"),
            (kind != "cancel_sync" and (m.get("expected_generation") or 0) < 0, "InvalidCommand"),
            (kind == "request_sync" and blank("sync_sequence"), "InvalidSyncCommand"),
            (kind == "cancel_sync" and blank("operation_id"), "InvalidCancelCommand"),
        )
        return next((why for failed, why in tests if failed), None)

    @classmethod
    def bootstrap(cls, store: str, authority: tuple[int, str], syncs: dict[str, int] | None = None, remediations: dict[str, int] | None = None, remember: int = 2000) -> Controller:
        """A controller that starts anew: the authority's generation and state count, but active with work left is syncing."""
        new = cls(store, *authority, remember)
        new.syncs, new.remediations = dict(syncs or {}), dict(remediations or {})
        if new.state == "active" and (new.syncs or new.remediations):
            new.state = "syncing"
        return new

    def _keep(self, m: dict, reply: str, op: str | None, duplicate: bool = False) -> tuple[str, bool, str | None]:
        self.known[m["command_id"]] = (reply, op)
        while len(self.known) > max(1, self.remember):
            self.known.popitem(last=False)
        return reply, duplicate, op

    def _seen(self, m: dict) -> tuple[str, bool, str | None] | None:
        got = self.known.get(m["command_id"])
        return got and (got[0], True, got[1])

    def _deactivation_id(self, generation: int) -> str:
        return operation_id_py("store-deactivation", self.store, generation)

    def _request_sync(self, m: dict) -> tuple:
        if (seen := self._seen(m)) is not None:
            return seen
        refusals = (
            (m["expected_generation"] != self.generation, "StaleLifecycleGeneration"),
            (self.deactivation is not None or self.state in STOPPED, "StoreNotSyncable"),
            (bool(self.syncs), "SyncAlreadyRunning"),
            (bool(self.remediations), "RemediationAlreadyRunning"),
            (not valid_settings(m.get("settings") or {}), "InvalidSyncCommand"),
        )
        for refused, why in refusals:  # refusals aren't remembered
            if refused:
                return why, False, None
        op = operation_id_py("store-sync", self.store, self.generation, m["sync_sequence"])
        self.syncs[op] = self.generation
        self.state = "syncing"
        if m.get("quota_id") and m["quota_id"] not in self.quotas:
            self.quotas.append(m["quota_id"])
        return self._keep(m, "accepted", op)

    def _cancel_sync(self, m: dict) -> tuple:
        if (seen := self._seen(m)) is not None:
            return seen
        return self._keep(m, "accepted" if m["operation_id"] in self.syncs else "sync is not active", m["operation_id"])

    def _start_deactivation(self, m: dict) -> tuple:
        if (seen := self._seen(m)) is not None:
            return seen
        expected, own = m["expected_generation"], self._deactivation_id(self.generation)
        if self.deactivation is not None:
            return self._keep(m, "accepted", self.deactivation, True)
        if self.state == "inactive" and expected in (self.generation, self.generation - 1):
            return self._keep(m, "completed", own, True)
        if self.state == "deactivation_failed" and expected == self.generation - 1:
            return self._keep(m, "failed", own, True)  # what failed is reported, not tried again
        if expected != self.generation:
            return "StaleLifecycleGeneration", False, None
        again = self.state in ("deactivating", "deactivation_failed")
        self.deactivation = own if again else self._deactivation_id(expected + 1)
        self.fenced, self.state = again, "deactivating"
        return self._keep(m, "accepted", self.deactivation)

    def _operation_status(self, m: dict) -> tuple:
        op, over, reply = m["operation_id"], m["status"] in TERMINAL, "noted"
        if over:
            mine = [self.syncs.pop(op, None), self.remediations.pop(op, None)]
            if mine != [None, None] and self.deactivation is not None:
                reply = "drained"  # told to the deactivation that waits for it
        if over and op is not None and op == self.deactivation:
            fenced = self.fenced or m["lifecycle_generation"] > self.generation
            self.deactivation, self.fenced = None, False
            if fenced:
                self.generation = max(self.generation, m["lifecycle_generation"])
                self.state = "inactive" if m["result_status"] in ("succeeded", "partial") else "deactivation_failed"
            else:
                self.state = "syncing" if self.syncs or self.remediations else "active"
        elif self.state == "syncing" and not self.syncs and not self.remediations:
            self.state = "active"
        if not (self.syncs or self.remediations or self.deactivation):
            self.quotas.clear()
        return reply, False, op

    def _remediation_started(self, m: dict) -> tuple:
        op = m["operation_id"]
        if op in self.remediations:
            return "noted", False, op
        self.remediations[op] = m["lifecycle_generation"]
        if self.state == "active":
            self.state = "syncing"
        # a remediation that comes late is registered, so that its end is seen, and canceled
        return "canceled" if self.state in STOPPED else "noted", False, op

    def _remediation_finished(self, m: dict) -> tuple:
        return self._operation_status(m) if m["status"] in TERMINAL else ("ignored", False, m["operation_id"])

    def _deactivation_fenced(self, m: dict) -> tuple:
        if m["operation_id"] != self.deactivation or m["lifecycle_generation"] < self.generation:
            return "ignored", False, m["operation_id"]
        self.fenced, self.generation, self.state = True, m["lifecycle_generation"], "deactivating"
        return "noted", False, m["operation_id"]

    def snapshot(self) -> dict:
        return {"state": self.state, "generation": self.generation, "syncs": sorted(self.syncs), "remediations": sorted(self.remediations), "deactivation": self.deactivation, "commands": len(self.known), "quotas": sorted(self.quotas)}

    def dump(self) -> str:
        return json.dumps([self.store, self.generation, self.state, self.remember, self.syncs, self.remediations, self.deactivation, self.fenced, self.quotas, list(self.known.items()), self.latest])

    @classmethod
    def load(cls, text: str) -> Controller:
        x = json.loads(text)
        new = cls(*x[:4])
        new.syncs, new.remediations, new.deactivation, new.fenced, new.quotas = x[4:9]
        new.known, new.latest = OrderedDict((k, tuple(v)) for k, v in x[9]), x[10]
        return new


def valid_settings(settings: dict[str, str]) -> bool:
    """Whether ``functions.policy.sync_policy`` finds no error."""

    def count(text: str) -> bool:
        try:
            return int(text) > 0
        except ValueError:
            return False

    def weight(text: str) -> bool:
        try:
            return WEIGHT_BOUNDS[0] <= float(text) <= WEIGHT_BOUNDS[1]
        except ValueError:
            return False

    scoped = settings.get("provider") and settings.get("credential_key")
    return (not scoped or weight(settings.get("fairness_weight", "1"))) and settings.get("mode", "ordinary") in MODES and all(count(settings.get(n, str(d))) for n, _, d in SYNC_SETTINGS)


def reply_row(c: Controller, m: dict) -> tuple:
    if m.get("operation_id") == LATEST:
        m = m | {"operation_id": c.latest or "none"}
    reply, duplicate, op = c.handle(m)
    if reply == "accepted":
        c.latest = op
    return c.store, int(m["ordinal"]), m["kind"], m.get("command_id"), reply, duplicate, op, c.state, c.generation, len(c.syncs), len(c.remediations)


def replay(commands: DataFrame, remember: int = 2000) -> DataFrame:
    """Folds each store's log in the order of ``ordinal``; ``generation`` and ``state`` are the authority's at its start.

    An ``operation_id`` of ``LATEST`` stands for the operation that the store accepted last.
    """
    import pandas as pd

    cols = commands.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = None
        for pdf in batches:
            rows = []
            for values in pdf.itertuples(index=False, name=None):
                m = clean(dict(zip(cols, values, strict=True)))
                for k in ("expected_generation", "generation"):
                    m[k] = None if m[k] is None else int(m[k])
                if c is None or c.store != m["store_key"]:
                    c = Controller(m["store_key"], m["generation"], m["state"], remember)
                rows.append(reply_row(c, m))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in REPLY.split(", ")])

    return commands.repartition("store_key").sortWithinPartitions("store_key", "ordinal").mapInPandas(run, REPLY)
