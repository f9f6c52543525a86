"""Cutting lineage: checkpoints and tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine (tests), a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(folder, "own"):
        folder.own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder.own, True)
    return f"file://{folder.own}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder for one table, removed when this process ends."""
    if not _tables:
        atexit.register(_clear)
    _tables.append((spark, path := f"{folder(spark)}/lodestone-tables/{tag}-{uuid.uuid4().hex}"))
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _clear() -> None:
    for spark, path in _tables:
        with contextlib.suppress(Exception):  # the session may have ended
            fs, at = file_system(spark, path)
            fs.delete(at, True)
    _tables.clear()
