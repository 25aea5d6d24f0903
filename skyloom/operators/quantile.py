"""Exact order statistics without sorting a group or holding its distinct values.

The span from a group's least to its greatest value is cut into ``CELLS`` equal cells, rows are counted by cell, and the cell that holds
the wanted place is kept, with the least and greatest value in it as the next span. After ``PASSES`` of this, what is left is counted by value. All counts
are partial before they are shuffled, so a group of any size is no task's burden; what a task holds of a group is its cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS, PASSES = 1 << 16, 2


def with_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of ``groups``, which has each group of ``keys`` once; a null key is a group. Without keys ``groups`` is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(groups))
    named = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return rows.join(named, same).drop(*[f"_g_{k}" for k in keys])


def nth(rows: DataFrame, keys: Sequence[str], value: Column, place: Callable[[Column], Column], name: str, weight: Column | None = None) -> DataFrame:
    """Of each group the value at ``place`` (from 0, made from the number of values) in ascending order: ``keys, name``.

    Null and NaN values take no part; a group without others has no row. With a ``weight`` each value counts so many times.
    """
    own = rows.select(*keys, value.cast("double").alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    own = own.where("_v is not null and not isnan(_v) and _w > 0")
    total = [F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    spans = (own.groupBy(*keys).agg(*total) if keys else own.agg(*total).where("_n > 0")).withColumn("_k", place(F.col("_n")).cast("long")).drop("_n")
    upto = F.sum("_c").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
    for at in range(PASSES + 1):
        inside = with_group(own, spans, keys).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        width = (F.col("_hi") - F.col("_lo")) / CELLS
        cell = F.col("_v") if at == PASSES else F.when((width > 0) & (width < float("inf")), F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(CELLS - 1))).otherwise(0)
        cells = inside.groupBy(*keys, cell.alias("_cell")).agg(F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.any_value("_k").alias("_k"))
        found = cells.withColumn("_upto", upto).where((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_c") <= F.col("_k")))
        spans = found.select(*keys, "_lo", "_hi", (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"))
    return spans.select(*keys, F.col("_lo").alias(name))


def upper_median(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """The value at floor(n/2) of each group."""
    return nth(rows, keys, value, lambda n: F.floor(n / 2), name)
