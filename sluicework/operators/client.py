"""A caller's side of the controllers: commands as rows, their replies and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMAND = "store_key string, kind string, command_id string, expected_generation long, sync_sequence string, operation_id string, lifecycle_generation long, status string, result_status string, quota_id string, state string, generation long, settings map<string, string>"


class Client:
    """Builds commands; a sync's own settings come before ``defaults``.

    A command also proposes the generation of a controller that doesn't run yet; a cancellation proposes 0.
    """

    def __init__(self, spark: SparkSession, defaults: dict[str, str] | None = None):
        self.spark, self.defaults = spark, defaults or {}

    def _row(self, store: str, kind: str, command: str, generation: int | None, sequence: str | None = None, operation: str | None = None, settings: dict[str, str] | None = None) -> DataFrame:
        return self.spark.createDataFrame([(store, kind, command, generation, sequence, operation, None, None, None, None, "active", generation or 0, settings)], COMMAND)

    def request_sync(self, store: str, command: str, generation: int, sequence: str, settings: dict[str, str] | None = None) -> DataFrame:
        return self._row(store, "request_sync", command, generation, sequence, settings=self.defaults | (settings or {}))

    def cancel_sync(self, store: str, command: str, operation: str) -> DataFrame:
        return self._row(store, "cancel_sync", command, None, operation=operation)

    def start_deactivation(self, store: str, command: str, generation: int) -> DataFrame:
        return self._row(store, "start_deactivation", command, generation)

    @staticmethod
    def status(replies: DataFrame, store: str) -> DataFrame:
        """The store's state after its last reply; a store without any has no row."""
        mine = replies.where(F.col("store_key") == store)
        return mine.groupBy("store_key").agg(F.max_by(F.struct("state", "generation", "active_syncs", "active_remediations"), "ordinal").alias("s")).select("store_key", "s.*")

    @staticmethod
    def waited(replies: DataFrame, store: str) -> str | None:
        """The operation that a caller who deactivates and waits follows: the one of the last deactivation that was taken."""
        taken = replies.where((F.col("store_key") == store) & (F.col("kind") == "start_deactivation") & F.col("reply").isin("accepted", "completed", "failed"))
        return taken.agg(F.max_by("operation_id", "ordinal")).first()[0]
