"""Rolling window features against a loop over all pairs of rows."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from skyloom.llm import catalog, op11_windows

WINDOWS, PERCENTS = [120, 600], {"median_chars": 50, "high_chars": 75}
SCHEMA = "doc_id long, t long, source string, text string, lang string, pane string, window_s int"


def features(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = op11_windows.window_features(df, F.col("t"), F.col("source"), F.char_length("text"), F.col("lang"), WINDOWS, PERCENTS)
    assert out.columns == ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def brute(rows):
    out = []
    pane = lambda t: None if t is None else t // 60 * 60
    for i, t, source, *_ in rows:
        for w in WINDOWS:
            inside = [r for r in rows if t is not None and r[1] is not None and r[2] == source and pane(t) - w <= pane(r[1]) < pane(t)]
            lengths = sorted(len(r[3]) for r in inside if r[3] is not None)
            rank = lambda p: lengths[-(-p * len(lengths) // 100) - 1] if lengths else None
            out.append((i, w, pane(t), len(inside), sum(lengths), len({r[4] for r in inside} - {None}), rank(50), rank(75)))
    return sorted(out, key=repr)


def some(rng, n, hot=0.3):
    def row(i):
        source = "hot" if rng.random() < hot else rng.choice([None, "", "a", "b"])
        return i, rng.choice([None, rng.randint(-400, 3000)]) if rng.random() < 0.1 else rng.randint(-400, 3000), source, rng.choice([None, "", "x" * rng.randint(1, 30)]), rng.choice([None, "en", "fr", "de"])

    out = [row(i) for i in range(n)]
    return out + out[: n // 5]


def test_against_all_pairs(spark):
    rows = some(random.Random(3), 400)
    assert features(spark, rows) == brute(rows)


def test_lengths_beyond_a_block_of_sums(spark, monkeypatch):
    """Lengths are gone through in several blocks, as they are in a group of many different ones."""
    rows = some(random.Random(4), 150)
    monkeypatch.setattr(op11_windows, "CELLS", 40)
    lo, hi = [0, 1, 0], [3, 3, 0]
    import numpy as np

    at, lengths, counts = np.array([0, 0, 1, 2, 2]), np.array([5, 9, 5, 1, 900_000]), np.array([1, 2, 3, 1, 1])
    ranks = np.array([[4, 8, 0], [3, 5, 0], [0, 0, 0]])
    found = op11_windows._ranked(at, lengths, counts, np.array(lo), np.array(hi), ranks)
    assert found.tolist() == [[5, 900_000, -1], [5, 900_000, -1], [-1, -1, -1]]
    assert features(spark, rows) == brute(rows)


def test_empty_one_row_and_very_long(spark):
    assert features(spark, []) == []
    rows = [(1, 60, None, "é" * 3_000_000, "en"), (2, 119, None, "a", None), (None, 120, None, None, "fr"), (4, None, "a", "b", "en"), (4, None, "a", "b", "en")]
    assert features(spark, rows) == brute(rows)


def test_one_minute_of_one_source_with_most_rows(spark):
    """A pane is one row, however many rows it has."""
    rows = [(i, 60, "s", "x" * (i % 7), "en") for i in range(3000)] + [(9000 + i, 120 + 60 * i, "s", "y", "de") for i in range(12)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    keyed = df.select("source", F.floor(F.col("t") / 60).alias("pane"), F.length("text").cast("long").alias("length"), "lang")
    first = op11_windows.panes(keyed).orderBy("pane").first()
    assert (first.n, list(first.lengths)) == (3000, list(range(7)))
    asked = [r for r in features(spark, rows) if r[0] == 9000]
    assert asked == [(9000, 120, 120, 3000, sum(i % 7 for i in range(3000)), 1, 3, 5), (9000, 600, 120, 3000, sum(i % 7 for i in range(3000)), 1, 3, 5)]


def test_windows_must_be_whole_panes(spark):
    import pytest

    with pytest.raises(ValueError, match="whole number of panes"):
        op11_windows.window_features(spark.range(1), F.col("id"), F.lit("s"), F.lit(1), F.lit("en"), [90], PERCENTS)


def test_times_of_the_query(spark, tmp_path):
    ids = [0, 7, 51_000, None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, "t", "s", "en") for i in ids], "doc_id long, text string, source string, lang string").write.parquet(path)
    found = {r.doc_id: r.event_s for r in catalog.queries()["op11_window_features"](spark, str(tmp_path)).collect()}
    assert found == {i: None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 4000) // 6) for i in ids}
