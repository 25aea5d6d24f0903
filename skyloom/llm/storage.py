"""Written tables in the folder that all executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it again, so a lost executor never
loses an intermediate result. Only where that setting is missing and Spark runs in one process is a folder made here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that the rows of one join key are spread over.
SPREAD = 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session that names none, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="skyloom-")
    return _own[app]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the read-back table.

    Shuffle files of the writing job go once it has ended; the written copy takes their place.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, by: Column, others: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``others``, which has each ``key`` once; a key that many of the rows have isn't one task's.

    The rows of a key are dealt into SPREAD parts by a hash of ``by``, and its row of ``others`` goes to those parts that occur.
    """
    dealt = rows.withColumn("_spread", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    parts = dealt.where(F.col(key).isNotNull()).select(key, "_spread").distinct()
    return dealt.join(parts.join(others, key), [key, "_spread"], how).drop("_spread")


def release(spark: SparkSession) -> None:
    """Deletes every table written so far; call it once results that read them are stored elsewhere."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
