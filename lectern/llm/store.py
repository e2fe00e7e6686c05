"""Shared folders for written intermediate tables and files.

Every written table lives below ``spark.checkpoint.dir``, the folder that all executors and the driver share. Where
that setting is absent (tests on one machine) a folder is made and set once per session.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, as a URI or path that Spark's own writers take."""
    base = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if base:
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        _local[app] = path = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir("file://" + path)
        atexit.register(shutil.rmtree, path, True)
    return "file://" + _local[app]


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; nothing is made there yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write the table into the shared folder and read it back, so that later plans start there."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _path(spark, path)
    return system.exists(where)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's that no plan reads any more."""
    system, where = _path(spark, path)
    system.delete(where, True)


def done_with(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote; no plan that is still to run may read them."""
    for t in tables:
        discard(t.sparkSession, t._written)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
