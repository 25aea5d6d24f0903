"""Places of rows in an order, without sorting a group in one task.

Rows are dealt to tasks by ranges of the order; a row's place is what the ranges before hold, plus its place within its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantile import with_group
from .stored import stored


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, first: int = 1) -> DataFrame:
    """Adds ``name``, each row's place from ``first`` among the rows of its ``keys`` (of all, without) by ``order``, which should leave no ties."""
    table = stored(rows.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = table.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return with_group(table, ahead, [*keys, "_part"]).withColumn(name, F.col("_ahead") + within + F.lit(first - 1)).drop("_ahead", "_part")
