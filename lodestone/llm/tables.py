"""Tables written by an operator into the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one where it is unset and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(shared_dir, "own", None)
        if not base:
            base = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
            atexit.register(shutil.rmtree, base.removeprefix("file://"), True)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path for one table, removed when this process ends."""
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table: what follows reads the table and not the lineage."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """``df`` as a table bucketed by ``key``: a join on it moves the other side only."""
    spark = df.sparkSession
    path, name = new_path(spark, tag), f"lodestone_{tag}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.option("compression", "none").option("path", path)
       .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return spark.table(name)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended
            remove(spark, path)
    _written.clear()
