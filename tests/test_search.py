"""The paged search: pruned pages, first old entry, unknown dates, caps."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In

from skyloom.sources import search

DAY = dt.date(2026, 8, 14)
SCHEMA = "category string, page int, pos long, id string, title string, summary string, published date, author string"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    days = [0, 0, 1, 1, 2, 2, 3, 12, 12, 13]
    rows = [("a", i // 2, i, f"http://arxiv.org/abs/2401.{i:05}v2", "T <&>\n x", f"sum {i} \\'e", DAY - dt.timedelta(d), "A  One") for i, d in enumerate(days)]
    rows[3] = (*rows[3][:6], None, "A")
    rows += [("b", 0, 0, "x/1", "t", "s", DAY, "B"), ("b", 1, 1, "x/2", "t", " ", DAY, "B"), ("c", 0, 0, "y", "t", "s", dt.date(2020, 1, 1), "C")]
    out = str(tmp_path_factory.mktemp("pages") / "p")
    search.write_pages(spark.createDataFrame(rows, SCHEMA), out)
    return out


def reader(path, filters=(), **options):
    found = search.PagedReader({"path": path, "page_size": "2", **options})
    return found, list(found.pushFilters(list(filters)))


def pages(r):
    return [(p.category, p.number) for p in r.partitions()]


def test_partitions_are_pruned(path):
    every, _ = reader(path)
    assert pages(every) == [("a", k) for k in range(5)] + [("b", 0), ("b", 1), ("c", 0)]
    assert pages(reader(path, since="2026-08-11")[0]) == [("a", k) for k in range(4)] + [("b", 0), ("b", 1)]
    r, rest = reader(path, [EqualTo(("category",), "b"), In(("pos",), (1,))])
    assert pages(r) == [("b", 0), ("b", 1)] and len(rest) == 1
    r, rest = reader(path, [In(("category",), ("a", "c")), GreaterThanOrEqual(("published",), dt.date(2026, 8, 13))])
    assert pages(r) == [("a", 0), ("a", 1)] and len(rest) == 1
    assert pages(reader(path, max_results="3", categories="a, c")[0]) == [("a", 0), ("a", 1), ("c", 0)]


def test_rows(spark, path):
    found = search.search(spark, path, since="2026-08-11", page_size=2)
    got = sorted((r.category, r.pos, r.arxiv_id, r.title, r.abstract, tuple(r.authors)) for r in found.collect())
    assert got[0] == ("a", 0, "2401.00000", "T <&> x", "sum 0 é", ("A One",))
    assert [g[:2] for g in got] == [("a", k) for k in range(7)] + [("b", 0)]
    assert found.where("pos = 3").first().published is None
    assert search.search(spark, path, max_results=3, page_size=2, categories="a").count() == 3
    late = search.search(spark, path, page_size=2).where((F.col("category") == "a") & (F.col("published") >= F.lit("2026-08-13").cast("date")))
    assert sorted(r.pos for r in late.collect()) == [0, 1, 2]
