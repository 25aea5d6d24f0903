"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``).

A table that several steps read is written once, so none of them is worked out again, and a lost executor loses nothing.
Only where that setting is missing and Spark runs in one process is a folder made here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="skyloom-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and returns the table, read back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what this session stored; call it once results that read it are kept elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _written.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
