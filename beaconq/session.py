"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
#: Bytes of rows that a Python worker is given at a time.
BATCH_BYTES = 4 << 20
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    A local session (tests, the bench) where it is unset gets one of its own; any other fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="beaconq-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/beaconq/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Send long texts to Python some megabytes at a time, not 10,000 rows or 64 MB, unless
    the session says how much itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, BATCH_BYTES)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not have it on their path."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _shipped:
        return
    fd, name = tempfile.mkstemp(prefix="beaconq-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(ROOT.glob("beaconq/**/*.py")):
            z.write(p, p.relative_to(ROOT))
        if (ROOT / "corpus_pipeline.py").exists():
            z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    spark.sparkContext.addPyFile(name)
    _shipped.add(spark.sparkContext.applicationId)
