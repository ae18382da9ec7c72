"""Where jobs keep intermediate tables, and the session defaults that they rely on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Spark deletes the shuffle files of a write when it ends; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables written inside the ``scratch`` blocks that are open, innermost last.
_open_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, our own in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = LOCAL_CHECKPOINT_DIR
    return path.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "zstd", keep: int = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a local checkpoint, the table outlives any executor, and what follows starts from files:
    lineage is cut, and columns such as ``monotonically_increasing_id`` keep their values. Inside a
    ``scratch`` block it goes with the block; a kept one goes with the block around that, if there is one
    (a number keeps it for as many blocks). What was shuffled for the write is deleted with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom-{label}-{uuid.uuid4().hex}"
    owners = _open_scratch[: max(0, len(_open_scratch) - keep)]
    if owners:
        owners[-1].append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that were materialised inside. What is still to be read must be written or kept first."""
    _open_scratch.append([])
    try:
        yield
    finally:
        for path in _open_scratch.pop():
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint while it has at most ``max_rows`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the session's workers, once, so that they need no PYTHONPATH of their own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / "textloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
