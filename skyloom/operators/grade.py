"""Similarity of candidates to weighted query rows: grade, best match, and the assay matrix.

A row takes part if it has a vector and a weight above zero. The grade, a weighted mean of cosines of unit vectors, is the inner
product with the weighted mean of the rows, so it needs one vector however many rows there are. Cosines of all rows are one
matrix product for each Arrow batch; the rows are held by every task while they are few, else sent in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors

#: Query rows that every task may hold; more go through a block join.
MOST_ROWS = 4096


def taking_part(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vector").isNotNull() & (F.col("weight") > 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != width * (len(column) - column.null_count):
        raise ValueError("vectors of unequal length")
    return flat.reshape(-1, width)


def mean_row(rows: DataFrame) -> DataFrame:
    """One row: the weighted mean vector of the rows that take part, or null."""
    each = taking_part(rows).select("weight", F.posexplode(vectors.doubles(F.col("vector"))).alias("pos", "x"))
    by_place = each.groupBy("pos").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))  # as many as a vector has places
    return by_place.agg(F.transform(ordered, lambda p: p.m).alias("mean"))


def grade(candidates: DataFrame, rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Adds ``grade``: the weighted mean cosine; 0 if no row takes part. Vectors must be unit vectors."""
    mean = mean_row(rows)
    own = vectors.doubles(F.col(vector))
    value = F.when(F.size("mean") == 0, F.lit(0.0)).otherwise(vectors.dot(own, F.col("mean")))
    return candidates.crossJoin(F.broadcast(mean)).withColumn("grade", F.when(F.col(vector).isNotNull(), value)).drop("mean")


def cosines(candidates: DataFrame, rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """The assay in long form: ``key, row_idx, label, weight, cosine`` of each candidate with each row that takes part."""
    used = taking_part(rows).select("row_idx", "label", "weight", vectors.doubles(F.col("vector")).alias("_row"))
    few = used.limit(MOST_ROWS + 1).collect()
    own = candidates.where(F.col(vector).isNotNull()).select(key, vectors.doubles(F.col(vector)).alias("_own"))
    if len(few) > MOST_ROWS:
        return own.crossJoin(used).withColumn("cosine", vectors.dot(F.col("_own"), F.col("_row"))).drop("_own", "_row")
    if not few:
        return own.select(key, F.lit(None).cast("int").alias("row_idx"), F.lit("").alias("label"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("cosine")).limit(0)
    few.sort(key=lambda r: r.row_idx)
    held = candidates.sparkSession.sparkContext.broadcast((np.array([r._row for r in few]), [r.row_idx for r in few], [r.label for r in few], [float(r.weight) for r in few]))

    @F.arrow_udf("array<double>")
    def products(own: pa.Array) -> pa.Array:
        matrix = held.value[0]
        found = _matrix(own, matrix.shape[1]) @ matrix.T
        ends = np.arange(0, found.size + 1, matrix.shape[0], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    index = F.array(*[F.struct(F.lit(r.row_idx).alias("row_idx"), F.lit(r.label).alias("label"), F.lit(float(r.weight)).alias("weight")) for r in few])
    each = own.select(key, products("_own").alias("_all")).select(key, F.posexplode("_all").alias("_at", "cosine"))
    return each.withColumn("_row", F.get(index, F.col("_at"))).select(key, "_row.row_idx", "_row.label", "_row.weight", "cosine")


def best_row(assay: DataFrame, key: str) -> DataFrame:
    """The row with the highest cosine, the first one on ties, whatever its weight: ``key, label, cosine``; null for an empty label."""
    best = F.max(F.struct(F.col("cosine"), (-F.col("row_idx")).alias("first"), F.col("label"))).alias("best")
    return assay.groupBy(key).agg(best).select(key, F.nullif(F.col("best.label"), F.lit("")).alias("label"), F.col("best.cosine").alias("cosine"))


def assay_matrix(assay: DataFrame, graded: DataFrame, key: str, row_ids: list[int], digits: int = 6) -> DataFrame:
    """The wide form: one column ``row_<i>`` for each row, and the grade."""
    named = assay.groupBy(key).pivot("row_idx", row_ids).agg(F.round(F.first("cosine"), digits))
    renamed = named.select(key, *[F.col(str(i)).alias(f"row_{i}") for i in row_ids])
    return renamed.join(graded.select(key, F.round("grade", digits).alias("grade")), key)


def feature_label(kind: str = "kind") -> F.Column:
    """What a row is called in reports: a text row its text, an exemplar its title, else its DOI."""
    return F.when(F.col(kind) == "touchstone", text.clip_label(F.col("text"))).otherwise(text.clip_label(F.coalesce(F.nullif("title", F.lit("")), F.col("doi"))))


def ranked(graded: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` from 1: grade descending, input order on ties."""
    return graded.withColumn("rank", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("grade"), order)))
