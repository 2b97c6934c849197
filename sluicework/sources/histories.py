"""Event logs of histories: one JSON record a line, or exported objects that hold all events of a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "workflowId string, eventId long, eventType string, eventMicros long, scheduledEventId long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line: workflow_id, event_id, event_type, event_us, scheduled_event_id, byte_size, malformed.

    Records are parsed by a fixed schema, so nothing is read ahead to find one.  Lines are read as text, so a file
    is split among tasks, and a record's bytes are those of its line.  ``malformed`` is the line itself where it
    isn't a whole record or names no history or position; its other columns but ``byte_size`` are null then.
    Blank lines are no records.
    """
    lines = spark.read.text(path).where("length(trim(value)) > 0")
    parsed = lines.select("value", F.from_json("value", EVENT + ", _damaged string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}).alias("e"))
    good = F.col("e._damaged").isNull() & F.col("e.workflowId").isNotNull() & F.col("e.eventId").isNotNull()
    names = {"workflow_id": "workflowId", "event_id": "eventId", "event_type": "eventType", "event_us": "eventMicros", "scheduled_event_id": "scheduledEventId"}
    return parsed.select(*(F.when(good, F.col(f"e.{old}")).alias(new) for new, old in names.items()), F.octet_length("value").cast("long").alias("byte_size"), F.when(~good, F.col("value")).alias("malformed"))


def write_log(events: DataFrame, path: str) -> None:
    """``events`` (workflow_id, event_id, event_type, event_us, scheduled_event_id) as JSON lines."""
    names = {"workflow_id": "workflowId", "event_id": "eventId", "event_type": "eventType", "event_us": "eventMicros", "scheduled_event_id": "scheduledEventId"}
    events.select(F.to_json(F.struct(*(F.col(old).alias(new) for old, new in names.items()))).alias("value")).write.text(path)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """Exported histories (an object with ``events`` in each file) as one row per event, with its place from 0 and size.

    A file that isn't such an object is one row whose ``malformed`` is its text.  Such an export is one record, so
    it is one task's; logs that grow belong into lines.
    """
    schema = "events array<struct<eventId: string, eventTime: timestamp, eventType: string>>, _damaged string"
    raw = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(path)
    raw = raw.select(F.col("_metadata.file_path").alias("workflow_id"), F.posexplode_outer("events").alias("place", "e"), F.col("_damaged").alias("malformed"))
    return raw.select("workflow_id", "place", F.col("e.eventId").cast("long").alias("event_id"), F.col("e.eventTime").alias("event_time"), F.col("e.eventType").alias("event_type"), F.octet_length(F.to_json("e")).cast("long").alias("byte_size"), "malformed").where("place is not null or malformed is not null")
