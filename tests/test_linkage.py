"""Average linkage in rounds over tasks against the matrix method in one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import cluster, linkage

SCHEMA = "haul string, id long, vector array<double>"


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rows_of(hauls):
    return [(h, i, x.tolist()) for h, v in hauls.items() for i, x in enumerate(v)]


def groups(merges, n, t):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b, sim in merges:
        if sim >= t:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in range(n)}


def same(found, expected):
    """The same pairs, at the same likenesses but for rounding."""
    found, expected = sorted(found), sorted(expected)
    assert [m[:2] for m in found] == [m[:2] for m in expected]
    assert [m[2] for m in found] == pytest.approx([m[2] for m in expected], abs=1e-9)


@pytest.fixture(scope="module")
def hauls():
    rng = np.random.default_rng(11)
    mixed = unit(rng.normal(size=(60, 6)) + 2 * rng.normal(size=(5, 6))[rng.integers(0, 5, 60)])
    copies = np.concatenate([mixed[:25], np.repeat(mixed[:2], 20, axis=0)])
    return {"mixed": mixed, None: unit(rng.normal(size=(31, 6))), "copies": copies, "two": mixed[:2], "one": mixed[:1], "same": np.repeat(mixed[3:4], 9, axis=0)}


def test_rounds_equal_the_matrix(spark, monkeypatch, hauls):
    """Small blocks, so that groups of a haul meet in many tasks."""
    monkeypatch.setattr(linkage, "BLOCK", 16)
    members = spark.createDataFrame(rows_of(hauls), SCHEMA)
    found = cluster.merges(members, "haul", "id", most=0)
    got = {}
    for r in found.collect():
        got.setdefault(r.haul, []).append((r.a, r.b, r.sim))
    for name in ("mixed", None, "two"):
        v = hauls[name]
        same(got[name], cluster.agglomerate(v @ v.T))
    assert "one" not in got and sorted(got["same"]) == [(0, b, 1.0) for b in range(1, 9)]
    assert len(got["copies"]) == 64
    for t in (0.3, 0.9999):
        cut = {}
        for r in cluster.cut(members, found, "haul", "id", t).collect():
            cut.setdefault(r.haul, {})[r.id] = r.root
        for name, v in hauls.items():
            assert cut[name] == groups(cluster.agglomerate(v @ v.T), len(v), t), (name, t)
    swept = {(r.haul, r.cut): (r.clusters, r.placed, r.largest) for r in cluster.sweep(None, found, "haul").collect()}
    assert len(swept) == 5 * len(cluster.CUTS)
    for (name, t), counts in swept.items():
        sizes = np.unique(list(groups(cluster.agglomerate(hauls[name] @ hauls[name].T), len(hauls[name]), t).values()), return_counts=True)[1]
        big = sizes[sizes >= 3]
        assert counts == (len(big), big.sum(), big.max(initial=0)), (name, t)


def test_both_ways_give_one_table(spark, hauls):
    """Small hauls in one task, large ones in rounds."""
    few = {name: hauls[name] for name in (None, "two", "mixed")}
    members = spark.createDataFrame(rows_of(few), SCHEMA)
    tables = [sorted((tuple(r) for r in cluster.merges(members, "haul", "id", most=m).collect()), key=lambda r: (r[0] or "", r[1], r[2])) for m in (40, 10_000)]
    assert len(tables[0]) == len(tables[1])
    for x, y in zip(*tables, strict=True):
        assert (x[:3], x[4:6]) == (y[:3], y[4:6]) and x[3] == pytest.approx(y[3], abs=1e-9)
        assert all(p == q if p is None or q is None else p == pytest.approx(q, abs=1e-9) for p, q in zip(x[6:], y[6:], strict=True))


def test_nothing_and_vectors_that_are_not_finite(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = cluster.merges(empty, "haul", "id", most=0)
    assert found.collect() == [] == cluster.cut(empty, found, "haul", "id", 0.3).collect() == cluster.sweep(None, found, "haul").collect()
    odd = spark.createDataFrame([("h", 0, [1.0, 0.0]), ("h", 1, [float("nan"), 0.0]), ("h", 2, [1.0, 0.1]), ("h", 3, None)], SCHEMA)
    found = cluster.merges(odd, "haul", "id", most=0)
    assert sorted((r.a, r.b, round(r.sim, 3)) for r in found.collect()) == [(0, 1, -2.0), (0, 2, 0.995)]
    cut = {r.id: r.root for r in cluster.cut(odd.where(F.col("vector").isNotNull()), found, "haul", "id", 0.5).collect()}
    assert cut == {0: 0, 1: 1, 2: 0}


def test_rounds_over_all_tasks_and_in_one_give_one_table(spark, monkeypatch, hauls):
    """Hauls are finished in one task after a few rounds, or from the start."""
    monkeypatch.setattr(linkage, "BLOCK", 16)
    monkeypatch.setattr(linkage, "STRIP", 7)
    members = spark.createDataFrame(rows_of(hauls), SCHEMA)
    tables = [sorted((tuple(r) for r in cluster.merges(members, "haul", "id", most=0, few=f).collect()), key=lambda r: (r[0] or "", r[1], r[2])) for f in (8, 1000)]
    for table in tables[1:]:
        assert len(table) == len(tables[0]) == 59 + 30 + 64 + 1 + 8
        for x, y in zip(tables[0], table, strict=True):
            assert (x[:3], x[4:6]) == (y[:3], y[4:6]) and x[3] == pytest.approx(y[3], abs=1e-9)
            assert all(p == q if p is None or q is None else p == pytest.approx(q, abs=1e-9) for p, q in zip(x[6:], y[6:], strict=True))


def test_a_large_haul_takes_few_jobs(spark):
    """Jobs are counted: 3,000 members took some for each of dozens of rounds."""
    v = unit(np.random.default_rng(5).normal(size=(3000, 16)))
    members = spark.createDataFrame(rows_of({"h": v}), SCHEMA).repartition(2)
    spark.sparkContext.setJobGroup("large haul", "")
    found = cluster.merges(members, "haul", "id", most=0).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("large haul"))
    spark.sparkContext.setJobGroup("", "")
    same([(r.a, r.b, r.sim) for r in found], cluster.agglomerate(v @ v.T))
    assert jobs < 40
