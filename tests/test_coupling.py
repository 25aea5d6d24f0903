"""Coupling in blocks against all pairs in one matrix."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import vectors
from skyloom.operators import cluster


@pytest.mark.parametrize(("n", "block", "most"), [(0, 16, 16), (1, 16, 16), (90, 30, 30), (200, 8, 20), (130, 1024, 1024)])
def test_blocks_equal_the_matrix(spark, monkeypatch, n, block, most):
    for name, value in (("BLOCK", block), ("MOST_BLOCK", most), ("STRIP", 5), ("BLOCKS", 4)):
        monkeypatch.setattr(cluster, name, value)
    v = np.random.default_rng(n).normal(size=(n, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    members = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "k long, vector array<double>")
    sims = v @ v.T
    pairs = np.round(sims[np.triu_indices(n, 1)], 6) + 0.0
    values, counts = np.unique(pairs, return_counts=True)
    assert sorted((r.sim, r.n) for r in cluster.similarity_histogram(members, "k").collect()) == list(zip(values.tolist(), counts.tolist(), strict=True))
    scale = cluster.map_scale(cluster.similarity_extremes(members, "k")).first()
    assert (scale.lo, scale.hi) == ((pairs.min(), max(0.0, pairs.max())) if n > 1 else (0.0, 0.0))
    np.fill_diagonal(sims, -1)
    hit = sims >= 0.25
    wanted = {i * 3: (int(hit[i].sum()), round(float(sims[i].max()), 9)) for i in range(n) if hit[i].any()}
    assert {r.k: (r.degree, round(r.strongest, 9)) for r in cluster.degrees(members, "k", 0.25).collect()} == wanted


def test_cosines_that_are_no_numbers(spark):
    members = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0])], "k long, vector array<double>")
    found = {str(r.sim): r.n for r in cluster.similarity_histogram(members, "k").collect()}
    assert found == {"0.995037": 1, "nan": 3, "0.0": 2}
    assert [(r.k, r.degree) for r in cluster.degrees(members, "k", 0.25).orderBy("k").collect()] == [(0, 1), (2, 1)]
    assert cluster.map_scale(cluster.similarity_extremes(members, "k")).first().lo == 0.0


def test_meetings_ship_no_more_than_their_number(spark, monkeypatch):
    """Copies of a vector that are shuffled don't grow with the number of vectors, and no block meets by a nested loop."""
    monkeypatch.setattr(cluster, "BLOCK", 2)
    rng = np.random.default_rng(1)
    for n in (200, 400):
        members = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(n, 3)))], "k long, vector array<double>")
        met = cluster._meetings(members, "k", "vector")
        copies = met.agg(F.sum(F.octet_length("ids") / 8)).first()[0]
        assert copies / n < 22 and "Cartesian" not in met._jdf.queryExecution().toString() and "NestedLoop" not in met._jdf.queryExecution().toString()


def test_a_length_is_worked_out_once(spark):
    """A vector of 2,000 places, whose length was worked out for each place, and for each place of that again."""
    rng = np.random.default_rng(2)
    v, c = rng.normal(size=(3, 2000)), rng.normal(size=2000)
    df = spark.createDataFrame([(x.tolist(), c.tolist()) for x in v], "v array<double>, c array<double>")
    found = np.array([r.x for r in df.select(vectors.center(F.col("v"), F.col("c")).alias("x")).collect()])
    off = v / np.linalg.norm(v, axis=1, keepdims=True) - c
    assert np.allclose(found, off / np.linalg.norm(off, axis=1, keepdims=True), rtol=0, atol=1e-12)
