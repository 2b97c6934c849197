"""The keyed folds as Structured Streaming operators: state is one ledger or controller per key.

Rows of a key within a micro-batch are handled in the order of ``ordinal``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import controller, quota


class _Fold(StatefulProcessor):
    """``load``, ``new``, ``step`` and ``dump`` of a fold; ``columns`` of its output."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        import pandas as pd

        ms = [quota.clean(r) for pdf in rows for r in pdf.to_dict("records")]
        ms.sort(key=lambda m: m["ordinal"])
        at = self.load(self.state.get()[0]) if self.state.exists() else self.new(key[0], ms[0])
        out = [row for m in ms for row in self.step(at, m)]
        self.state.update((at.dump(),))
        yield pd.DataFrame(out, columns=self.columns).astype(self.types)

    types: dict[str, str] = {}

    def close(self) -> None:
        pass


class QuotaFold(_Fold):
    columns = [c.split()[0] for c in quota.OUTCOME.split(", ")]
    types = {"remaining": "Int64"}
    settings: dict = {}

    def __init__(self, **settings: int | None):
        self.settings = settings

    def new(self, key: str, first: dict) -> quota.Ledger:
        return quota.Ledger((key, "", ""), **self.settings)

    def load(self, text: str) -> quota.Ledger:
        return quota.Ledger.load(text)

    def step(self, at: quota.Ledger, m: dict) -> Iterator[tuple]:
        return quota.outcome_rows(at, at.scope[0], iter([m]))


class ControllerFold(_Fold):
    columns = [c.split()[0] for c in controller.REPLY.split(", ")]

    def new(self, key: str, first: dict) -> controller.Controller:
        return controller.Controller(key, int(first["generation"]), first["state"])

    def load(self, text: str) -> controller.Controller:
        return controller.Controller.load(text)

    def step(self, at: controller.Controller, m: dict) -> list[tuple]:
        return [controller.reply_row(at, m)]


def quota_stream(messages: DataFrame, **settings: int | None) -> DataFrame:
    """Outcome rows of a stream of quota messages keyed by ``scope_key``; needs the RocksDB state store."""
    return messages.groupBy("scope_key").transformWithStateInPandas(QuotaFold(**settings), quota.OUTCOME, "Append", "None")


def controller_stream(commands: DataFrame) -> DataFrame:
    """Replies to a stream of commands keyed by ``store_key``."""
    return commands.groupBy("store_key").transformWithStateInPandas(ControllerFold(), controller.REPLY, "Append", "None")
