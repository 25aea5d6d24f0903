"""Stages on a stream, each done once for each batch whatever dies in between.

A stage's rows of a batch are one folder, ``{path}/{stage}/query={query}/batch={batch}``, and the committer's mark in it is written with its last rows: together
they are a ledger of (query, batch, stage). A batch that comes again, as after a lost driver, goes through the stages it
lacks and reads those it has; a folder without its mark is written anew. So a run that was killed and started again leaves the tables of an unbroken one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "_SUCCESS"


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def staged(path: str, query: str, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that takes a batch through ``stages`` (name, function); each function gets what the one before it wrote."""

    def each(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        for name, stage in stages:
            where = f"{path}/{name}/query={query}/batch={number}"
            if not _exists(spark, f"{where}/{MARK}"):
                stage(rows).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(where)
            rows = spark.read.parquet(where)

    return each


def result(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """All rows of a stage, with ``query`` and ``batch``."""
    return spark.read.parquet(f"{path}/{stage}")


def ledger(spark: SparkSession, path: str, stages: Sequence[str]) -> DataFrame:
    """What is done: ``stage, query, batch, n`` for each batch that left rows."""
    counted = [result(spark, path, name).groupBy("query", "batch").agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "query", "batch", "n") for name in stages]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out
