"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds this package to the session's Python files, once per application, so that executors can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="sluicework-")) / "sluicework-code.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark


def local_session(cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume: UTC, adaptive execution, checkpoints that go with their results."""
    n = str(cpus or os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": n if n.isdigit() else "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="sluicework-"),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    return SparkSession.builder.master(f"local[{n}]").appName("sluicework").config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; a local session, whose tasks all run here, gets one of its own where it is unset."""
    context = spark.sparkContext
    if not (held := context._jsc.sc().getCheckpointDir()).isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="sluicework-")
        context.setCheckpointDir(named)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: later reads neither recompute it nor lose it with an executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
