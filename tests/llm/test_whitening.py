"""Whitening against numpy's eigen-solver over exact integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from skyloom.llm import op13_whitening
from skyloom.llm.op13_whitening import symmetric_qr, whiten

SCHEMA = "vec_id long, embedding array<double>, component string, n string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


def brute(rows, scale=1024, shift=100_000):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(scale * c) + shift for c in v] for _, v in good]
    n, dim = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(dim)]
    centred = np.array([[(n * r[k] - s[k]) / n for k in range(dim)] for r in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    far = [sum((n * r[k] - s[k]) ** 2 for k in range(dim)) for r in x]
    return [i for i, _ in good], n, far, centred @ axes / np.sqrt(values), values / values.sum()


def check(df, rows, many=8):
    ids, n, far, white, explained = brute(rows)
    found = df.collect()
    many = min(many, white.shape[1])
    assert len(found) == len(ids) * many and {r.n for r in found} == {n}
    of = {}
    for r in found:
        of.setdefault((r.vec_id, r.component), []).append(r)
    order = {i: k for k, i in enumerate(ids)}
    for c in range(many):
        own = np.array([of[i, c + 1][0].whitened for i in ids])
        sign = np.sign(own @ white[:, c])
        assert np.allclose(own, sign * white[:, c], rtol=0, atol=1e-7)
    for r in found:
        assert r.deviation == far[order[r.vec_id]]
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in found}) == 1


def some(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * 0.2 + rng.normal(size=dim)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_against_numpy(spark):
    rows = some(1, 300, 12)
    check(whiten(vectors(spark, rows)), rows)
    few = some(2, 60, 3)
    check(whiten(vectors(spark, few, 7)), few)


def test_dropped_rows_repeats_and_null_ids(spark):
    rows = some(3, 80, 4)
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 1.0]), (903, [math.nan, 0.0, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [1e300, 0.0, 0.0, 0.0]), (906, [1.0, 2.0])]
    found = whiten(vectors(spark, rows + rows[:9] + odd))
    ids = [r.vec_id for r in found.where("component = 1").collect()]
    assert sorted(ids) == sorted([i for i, _ in rows] + list(range(9)))
    check(whiten(vectors(spark, [*rows, (None, rows[5][1])])), [*rows, (None, rows[5][1])])


def test_nothing_one_row_equal_rows(spark):
    assert whiten(vectors(spark, [])).collect() == []
    assert whiten(vectors(spark, [(1, None), (2, [math.nan])])).collect() == []
    for rows in ([(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)]):
        found = whiten(vectors(spark, rows)).collect()
        assert len(found) == 2 * len(rows)
        assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(len(rows), 0, None, None, None)}


def test_a_component_without_variance(spark):
    rows = [(i, [i / 7, 2 * (i // 1) / 7 * 0 + 1.0, -i * i / 50]) for i in range(20)]
    found = whiten(vectors(spark, rows)).collect()
    assert {r.component for r in found if r.whitened is None} == {3}
    assert all(r.identity_error < 1e-9 for r in found)


def test_exact_beyond_a_long(spark):
    """Entries so far apart that a square doesn't fit: no wrong number."""
    rows = [(0, [0.0, 0.0]), (1, [1e9, 1.0]), (2, [2.0, 3.0]), (3, [2.0, 5.0])]
    _, _, far, _, _ = brute(rows)
    found = {r.vec_id: r.deviation for r in whiten(vectors(spark, rows)).collect()}
    assert found == {i: v if v < 1 << 63 else None for i, v in enumerate(far)}
    assert None in found.values()


def test_states_merge_in_any_order():
    x = np.array([v for _, v in some(5, 200, 6)])
    whole = op13_whitening.Moments(6)
    whole.add(x)
    parts = []
    for lo in range(0, 200, 37):
        m = op13_whitening.Moments(6)
        m.add(x[lo : lo + 37])
        parts.append(m)
    random.Random(1).shuffle(parts)
    merged = op13_whitening.Moments(6)
    for m in parts:
        merged.merge(m.n, m.sums, m.mean, m.scatter)
    assert merged.n == 200 and np.allclose(merged.mean, x.mean(axis=0)) and np.allclose(merged.scatter, whole.scatter)
    assert np.allclose(merged.scatter / 200, np.cov(x.T, bias=True))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 64])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.diag(rng.integers(0, 3, n)).astype(float), np.zeros((n, n)), np.ones((n, n)), 1e9 * rng.normal(size=(n, n))):
        a = a + a.T
        values, axes = symmetric_qr(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.all(np.diff(values) <= 1e-12 * size * n)
        assert np.allclose(axes.T @ axes, np.eye(n), atol=1e-12)
        assert np.allclose(a @ axes, axes * values, atol=1e-12 * size * n)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * size * n)
