"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and everything runs in
    one process (as in tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own_folders.get(sc.applicationId) or _own_folders.setdefault(sc.applicationId, f"file://{tempfile.mkdtemp(prefix='lacuna-')}")
    return found.rstrip("/")


def _place(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application or the innermost `temporary` ends."""
    path = f"{shared_dir(spark)}/lacuna/{name}-{uuid.uuid4().hex}"
    hadoop, store = _place(spark, path)
    store.deleteOnExit(hadoop)
    if _open:
        _open[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop, store = _place(spark, path)
    store.delete(hadoop, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables staged within it are removed at its end."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again: cuts the lineage, survives lost
    executors, and gives the planner the real size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What `build` returns, staged; the tables that it staged on the way are removed."""
    path = new_path(spark, name)
    with temporary(spark):
        df = build()
        df.write.parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)
