"""Session settings the operators rely on."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC, adaptive plans, and splitting of skewed join partitions."""
    for key, value in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.forceOptimizeSkewedJoin", "true"),
        # keyed stream state on disk, not on the heap
        ("spark.sql.streaming.stateStore.providerClass",
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
        # a repeated key keeps its last value, as JSON readers commonly do
        ("spark.sql.variant.allowDuplicateKeys", "true"),
    ):
        spark.conf.set(key, value)
    return spark


def reused(rows: DataFrame) -> DataFrame:
    """Rows that several branches of a plan read: kept on the executors' disks from the first
    job that needs them. No job runs before, and parts lost with an executor are made again.
    ``release`` frees them."""
    _reused.append(rows.persist(StorageLevel.DISK_ONLY))
    return _reused[-1]


_reused: list[DataFrame] = []


def release() -> int:
    """Frees what operators kept for results that are done by now; a result that is used again
    afterwards is made anew. Returns how many tables that were."""
    n = len(_reused)
    while _reused:
        _reused.pop().unpersist()
    return n


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a fresh local one only if none is named."""
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="proofmill-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


_shipped: set[str] = set()


def python_workers(spark: SparkSession) -> None:
    """Sends this package along to Python workers, once per application, so they can import it
    wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = pathlib.Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), f"{package.name}.zip")  # the driver serves it to all
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
