"""Paths and small files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary one of a session whose executors run in
    the driver's process; on a cluster that is an error, as executors would
    write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_remove)
    _made.append((spark, path))
    return path


def _opened(spark: SparkSession, path: str):
    """(path, its file system)"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file: a marker that is there or not, never in part."""
    p, fs = _opened(spark, path)
    fs.mkdirs(p.getParent())
    fs.create(p, False).close()


def marks(spark: SparkSession, folder: str) -> list[str]:
    """The names of the files in a folder; none if it does not exist."""
    p, fs = _opened(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _remove() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jvm is not None:
                p, fs = _opened(spark, path)
                fs.delete(p, True)
        except Exception:  # the session may be gone already
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage is cut, lost executors cost nothing, row ids are fixed."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged = path
    return found


def release(*tables: DataFrame) -> None:
    """Removes the files of tables from staged() that nothing lazy reads any more."""
    for df in tables:
        p, fs = _opened(df.sparkSession, df._staged)
        fs.delete(p, True)
