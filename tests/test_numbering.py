"""Places in an order against sorted lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skyloom.operators.numbering import numbered


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_places(spark, hot):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < hot else rng.choice(["a", "b", None]), rng.choice([None, *range(9)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, size int, id int").repartition(6)
    out = numbered(df, ["k"], [F.desc_nulls_last("size"), F.asc("id")], "place")
    got = {r.id: r.place for r in out.collect()}
    for key in {k for k, *_ in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    every = {r.id: r.n for r in numbered(df, [], [F.asc("id")], "n", 0).collect()}
    assert every == {i: i for i in range(300)}


def test_no_rows(spark):
    assert numbered(spark.range(0), [], [F.asc("id")], "n").collect() == []
