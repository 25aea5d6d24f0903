"""Exact order statistics against sorted lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators import gate, quantile


def expected(values, place):
    own = sorted(v for v in values if v is not None and not math.isnan(v))
    return own[place(len(own))] if own else None


@pytest.mark.parametrize("cells", [2, 16, quantile.CELLS])
def test_medians_of_nights(spark, monkeypatch, cells):
    """Few cells, so that a narrowed span still holds many different values, and the usual number."""
    monkeypatch.setattr(quantile, "CELLS", cells)
    rng = random.Random(cells)
    nights = {
        "a": [rng.gauss(0, 1) for _ in range(400)], "b": [1e300, -1e300, *(rng.random() * 1e-300 for _ in range(60))], None: [rng.choice([0.5, 0.25]) for _ in range(41)], "one": [7.0], "two": [2.0, 1.0],
        "far": [1e9, *(0.5 + k * 2**-50 for k in range(101))], "odd": [None, math.nan, 3.0, math.inf, -math.inf, 3.0, 1.0], "none": [None, math.nan],
    }
    df = spark.createDataFrame([(n, v) for n, vs in nights.items() for v in vs], "night string, v double").repartition(5)
    places = {"half": (lambda n: n // 2, lambda n: F.floor(n / 2)), "first": (lambda n: 0, lambda n: F.lit(0)), "last": (lambda n: n - 1, lambda n: n - 1), "third": (lambda n: n // 3, lambda n: F.floor(n / 3))}
    for plain, place in places.values():
        got = {r.night: r.m for r in quantile.nth(df, ["night"], F.col("v"), place, "m").collect()}
        assert got == {n: expected(vs, plain) for n, vs in nights.items() if n != "none"}


def test_weights_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 0), (3.0, 2), (None, 9)], "v double, n int")
    got = [quantile.nth(df, [], F.col("v"), lambda n, k=k: F.lit(k), "m", F.col("n")).first().m for k in range(6)]
    assert got == [1.0, 1.0, 1.0, 2.0, 3.0, 3.0]
    assert quantile.nth(df.limit(0), [], F.col("v"), lambda n: F.floor(n / 2), "m").collect() == []


def test_no_buffer_and_no_single_task_of_grades(spark):
    df = spark.range(1000).select((F.col("id") % 97 / 97.0).alias("v"))
    plan = quantile.upper_median(df, [], F.col("v"), "m")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "SortAggregate" not in plan
    assert "partial_count" in plan or "partial_sum" in plan


def test_a_night_of_one_grade_and_a_null_night(spark):
    df = spark.createDataFrame([(None, i, 0.5) for i in range(6)] + [("x", 10 + i, g) for i, g in enumerate((0.1, 0.2, 0.3, 0.9))], "night string, id long, grade double")
    out = {(r.night, r.id): r.z for r in gate.z_scores(df, ["night"]).collect()}
    assert len(out) == 10 and all(z is None for (n, _), z in out.items() if n is None)
    assert out["x", 13] == pytest.approx((0.9 - 0.3) / (gate.MAD_SCALE * 0.2))
