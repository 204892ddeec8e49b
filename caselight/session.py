"""Session settings this library relies on, and the shared folder for written tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Given, Made = TypeVar("Given"), TypeVar("Made")

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

#: How tables are written: smaller than by Parquet's usual codec.
WRITTEN = {"compression": "zstd"}

#: Folders chosen where ``spark.checkpoint.dir`` is unset, by application.
_folders: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("caselight")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage.

    ``spark.checkpoint.dir`` names it. Where that is unset, a cluster falls back on its SQL
    warehouse if that is in a shared store, and only a local master on a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    application = spark.sparkContext.applicationId
    if application not in _folders:  # the setting itself cannot be changed once a session runs
        if spark.sparkContext.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="caselight-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if folder.startswith(("file:", "/")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _folders[application] = folder
    return _folders[application]


def side_by_side(spark: SparkSession, work: Callable[[Given], Made], items: Iterable[Given]) -> list[Made]:
    """``work`` on each of a few items, as jobs that run at the same time; results in the order of the items."""
    items = list(items)
    if not items:
        return []
    with ThreadPoolExecutor(len(items)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
