"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}  # folders by application


def shared_dir(spark: SparkSession) -> str:
    """URI of a new folder below ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset (tests in local mode) a
    temporary folder is made and set, since there driver and executors are one process.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spritelake-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"
    _made.setdefault(context.applicationId, []).append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, statistics are known."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes folders through the Hadoop file system they belong to."""
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> int:
    """Removes all that operators of this application have left in the shared folder, and tells how many folders that was.

    Results are lazy plans over such tables: save them first.
    """
    jvm, gone = spark._jvm, 0
    for path in _made.pop(spark.sparkContext.applicationId, []):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{path}*")
        system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in system.globStatus(pattern) or []:
            gone += bool(system.delete(found.getPath(), True))
    return gone


def drop(*tables: DataFrame) -> None:
    """Removes tables made by written() that no lazy plan reads any more."""
    for df in tables:
        delete(df.sparkSession, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})
