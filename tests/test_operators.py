from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from skyloom.functions import vectors
from skyloom.operators import archive, cluster, gate, grade, match, rank, store

NIGHT = [0.50, 0.55, 0.58, 0.60, 0.61, 0.62, 0.63, 0.65, 0.70, 0.90]


def night(spark, grades):
    return spark.createDataFrame([(i, float(g)) for i, g in enumerate(grades)], "id long, grade double")


def test_gate_night(spark):
    z = {r.id: r.z for r in gate.z_scores(night(spark, NIGHT)).collect()}
    assert [round(z[i], 2) for i in (9, 8, 7)] == [4.72, 1.35, 0.51]
    shipped = gate.select(night(spark, NIGHT), gate.Gate(min_items=0), "id").collect()
    assert [(r.id, r.band) for r in shipped] == [(9, "paydirt")]
    shipped = gate.select(night(spark, NIGHT), gate.Gate(soft_z=1.0, min_items=0), "id").orderBy("rank").collect()
    assert [(r.id, r.band) for r in shipped] == [(9, "paydirt"), (8, "look")]


def test_gate_floor_ceiling_and_no_spread(spark):
    assert gate.select(night(spark, NIGHT), gate.Gate(), "id").count() == 3
    assert gate.select(night(spark, NIGHT), gate.Gate(max_items=1), "id").count() == 1
    flat = gate.select(night(spark, [0.5, 0.5, 0.5]), gate.Gate(max_items=2), "id").collect()
    assert [(r.z, r.band) for r in flat] == [(None, "longshot")] * 2
    assert gate.select(night(spark, []), gate.Gate(), "id").count() == 0


def brute_gate(grades, g):
    order = sorted(range(len(grades)), key=lambda i: (-grades[i], i))
    if not order:
        return []
    med = sorted(grades)[len(grades) // 2]
    mad = sorted(abs(x - med) for x in grades)[len(grades) // 2]
    if not mad > 0:
        return order[: g.max_items]
    z = [(x - med) / (1.4826 * mad) for x in grades]
    out = [i for i in order if z[i] >= g.ship]
    if len(out) < g.floor:
        out = [i for i in order if z[i] >= min(g.long_z, g.ship)][: g.floor]
    return out[: g.max_items]


@pytest.mark.parametrize("seed", range(4))
def test_gate_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    grades = np.round(np.concatenate([rng.normal(0.62, 0.03, 60), rng.uniform(0.8, 0.95, seed)]), 3).tolist()
    for g in (gate.Gate(), gate.Gate(min_z=1, soft_z=0.5, max_items=20), gate.Gate(min_z=4, soft_z=4, long_z=0, min_items=6)):
        got = [r.id for r in gate.select(night(spark, grades), g, "id").orderBy("rank").collect()]
        assert got == brute_gate(grades, g)


def test_bands_tallies_options(spark):
    df = spark.createDataFrame([(3.1,), (2.0,), (1.4,), (0.6,), (None,)], "z double")
    g = gate.Gate(min_z=2, soft_z=1)
    assert [r.b for r in df.select(gate.band(F.col("z"), g).alias("b")).collect()] == ["paydirt", "paydirt", "look", "longshot", "longshot"]
    df = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 0, 1), (2, 0, 0), (1, 3, 1)], "p long, l long, s long")
    said = [r.t for r in df.select(gate.tally(F.col("p"), F.col("l"), F.col("s")).alias("t")).collect()]
    assert said == ["", "worth a look: 1; long shot: 2", "long shot: 1", "pay dirt: 2", "pay dirt: 1; worth a look: 3; long shot: 1"]
    assert gate.parse_gate({"min_z": 99, "min_items": "", "max_items": 0.2}) == gate.Gate(min_z=4.0, max_items=1)
    assert gate.parse_gate(None) == gate.Gate() and gate.preset_of(gate.Gate()) == "carry"


def test_grade_and_best_row(spark):
    rows_ = spark.createDataFrame([(0, "a", 1.0, [1.0, 0.0]), (1, "b", 3.0, [0.0, 1.0]), (2, "c", 0.0, [1.0, 0.0]), (3, "d", 1.0, None)], "row_idx int, label string, weight double, vector array<double>")
    stones = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "id long, vector array<double>")
    assert rows(grade.grade(stones, rows_).select("id", "grade")) == [(1, 0.25), (2, None)]
    assert rows(grade.best_row(grade.cosines(stones, rows_, "id"), "id")) == [(1, "a", 1.0)]
    none = rows_.where("weight < 0")
    assert grade.grade(stones, none).where("id = 1").first().grade == 0.0
    assert grade.cosines(stones, none, "id").count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.unit(F.col("a")).alias("u"), vectors.unit(F.col("b")).alias("z"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.unpack_vector(vectors.pack_vector(F.col("a"))).alias("p")).first()
    assert r.u == [0.6, 0.8] and r.z == [0.0, 0.0] and r.c == 0.0 and r.p == [3.0, 4.0]
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(vectors.dot(F.col("a"), F.col("b"))).collect()


def test_blend(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (0.8, None, None), (0.8, 0.0, 0.0), (None, None, None)], "l double, c double, s double")
    b = rank.blend({"l": F.col("l"), "c": F.col("c"), "s": F.col("s")}, {"l": 0.6, "c": 0.3, "s": 0.1})
    got = [r.b for r in df.select(b.alias("b")).collect()]
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0.8) and got[2] < 0.8 and got[3] == 0.0
    assert df.select(rank.saturated(F.col("c"), 20).alias("x")).collect()[1].x is None


PAPERS = "cite_key string, status string, published date, importance double, briefed_on date, relevant boolean"


def test_ranked_lists(spark):
    papers = spark.createDataFrame([("lo", "ranked", None, 0.1, None, True), ("hi", "ranked", None, 0.9, None, True), ("none", "ranked", None, None, None, None), ("done", "briefed", None, 1.0, date(2026, 1, 1), True)], PAPERS)
    assert [r.cite_key for r in rank.top_ranked(papers, 10).collect()] == ["hi", "lo", "none"]
    assert [r.cite_key for r in rank.also_evaluated(papers, papers.where("cite_key = 'hi'")).collect()] == ["lo", "none"]


def test_a_key_twice_is_an_error_whatever_is_patched(spark):
    current = spark.createDataFrame([("a", 1)], "k string, v int")
    for patch in (
        spark.createDataFrame([("b",), ("b",)], "k string"), spark.createDataFrame([("a", 5), ("a", 6)], "k string, fresh int"), spark.createDataFrame([("a", 5), ("a", 5)], "k string, v int"),
        spark.createDataFrame([(None,), (None,)], "k string"),
    ):
        with pytest.raises(Exception, match="a key comes twice"):
            store.upsert(current, patch, ["k"], ["k", "v", "fresh"]).count()
    new = spark.createDataFrame([("b", 2), ("b", 1), ("a", 7), (None, 3)], "k string, v int")
    with pytest.raises(Exception, match="a key comes twice"):
        store.insert_absent(current, new, ["k"]).count()
    out = store.insert_absent(current, new, ["k"], [F.asc("v")])
    assert rows(out) == [("a", 1), ("b", 1), (None, 3)]
    assert rows(store.insert_absent(out, new, ["k"], [F.asc("v")])) == [("a", 1), ("b", 1), (None, 3)]


def test_upsert(spark):
    current = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "k string, title string, scites int")
    patch = spark.createDataFrame([("a", None), ("c", 5)], "k string, scites int")
    assert rows(store.upsert(current, patch, ["k"])) == [("a", "old", None), ("b", "keep", 2), ("c", None, 5)]
    with pytest.raises(ValueError, match="unknown"):
        store.upsert(current, patch.withColumnRenamed("scites", "typo"), ["k"])
    assert rows(store.upsert(current, patch.select("k"), ["k"])) == [("a", "old", 1), ("b", "keep", 2), ("c", None, None)]
    with pytest.raises(ValueError, match="status"):
        store.set_status(current.withColumn("cite_key", F.col("k")), current, "nonsense")


def test_store_writes(spark):
    have = spark.createDataFrame([("a", "briefed")], "k string, status string")
    new = spark.createDataFrame([("a", "new"), ("b", "new")], "k string, status string")
    assert rows(store.insert_absent(have, new, ["k"])) == [("a", "briefed"), ("b", "new")]
    children = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, pos int")
    assert rows(store.replace_children(children, spark.createDataFrame([("a", 9)], "k string, pos int"), "k")) == [("a", 9), ("b", 1)]
    papers = spark.createDataFrame([("old", date(2020, 1, 1)), ("new", date(2026, 7, 25)), ("unknown", None)], "k string, published date")
    doomed = store.old_papers(papers, F.lit("2099-01-01").cast("date"))
    assert rows(store.prune({"p": papers}, doomed, "k")["p"]) == [("unknown", None)]
    assert rows(store.prune_counts({"p": papers}, store.old_papers(papers, F.lit("2026-07-20").cast("date")), "k")) == [("p", 1)]


def test_vector_cache(spark):
    schema = "text_sha string, model string, dim int, vector array<double>, seen_at date"
    cache = spark.createDataFrame([("s", "m", 2, [1.0, 2.0], date(2026, 1, 1))], schema)
    out = store.cache_write(cache, spark.createDataFrame([("s", "m", 2, [9.0, 9.0], date(2026, 2, 1)), ("t", "m", 2, [3.0, 4.0], date(2026, 2, 1))], schema))
    assert rows(out.select("text_sha", "vector", "seen_at")) == [("s", [1.0, 2.0], date(2026, 2, 1)), ("t", [3.0, 4.0], date(2026, 2, 1))]
    found = store.cache_lookup(spark.createDataFrame([("s",), ("x",), ("s",)], "text_sha string"), out, "m", 2)
    assert rows(found) == [("s", [1.0, 2.0]), ("x", None)]
    assert store.cache_prune(out, F.lit("2026-03-01").cast("date")).count() == 0
    with pytest.raises(Exception, match="length"):
        store.cache_write(cache, spark.createDataFrame([("u", "m", 3, [1.0], date(2026, 2, 1))], schema)).collect()


def test_runs(spark):
    runs = spark.createDataFrame([], "run_id long, started string, topics string, n_scraped int, n_relevant int, n_briefed int")
    runs, one = store.start_run(runs, "now", "t")
    assert rows(store.finish_run(runs, one, n_scraped=10, n_relevant=3, n_briefed=2)) == [(1, "now", "t", 10, 3, 2)]


CORPUS = "corpus_pos long, cite_key string, openalex_id string, doi string, title string"


def corpus(spark):
    return spark.createDataFrame([(0, "K1", "W1", "https://doi.org/10.1/A", "First Title"), (1, "K2", "W2", "10.48550/arXiv.2401.00001", "Second"), (2, "K3", "W3", "10.1/a", "first title!")], CORPUS)


def test_cascade(spark):
    refs = spark.createDataFrame([("p", 0, "doi:10.1/a", None, None), ("p", 1, None, "2401.00001v2", None), ("p", 2, "10.9/none", None, "FIRST title"), ("p", 3, None, None, None)], "cite_key string, ref_pos int, ref_doi string, ref_arxiv string, ref_title string")
    got = match.match_refs(refs, corpus(spark))
    assert rows(got.select("ref_pos", "matched_key")) == [(0, "K1"), (1, "K2"), (2, "K1"), (3, None)]
    assert match.bibliography_matches(got).first().matched == ["K1", "K2"]


def test_connect_decisions(spark):
    papers = spark.createDataFrame([(k,) for k in "abcde"], "cite_key string")
    refs = spark.createDataFrame([("a", 0, "K1")], "cite_key string, ref_pos int, matched_key string")
    resolved = spark.createDataFrame([("a", "X", "d", ["W2"]), ("c", "Xc", "dc", []), ("d", "Xd", "dd", ["W9"]), ("e", "Xe", "de", ["W2", "W1", "W2"])], "cite_key string, openalex_id string, doi string, referenced_works array<string>")
    got = {r.cite_key: (r.openalex_id, r.centrality, r.cited_in_corpus, r.connected) for r in match.connect(papers, refs, resolved, corpus(spark)).collect()}
    assert got == {
        "a": (None, 0.1, ["First Title"], True), "b": (None, None, None, False), "c": ("Xc", None, None, False), "d": ("Xd", 0.0, [], True), "e": ("Xe", 0.2, ["Second", "First Title"], True),
    }


def brute_linkage(s):
    groups, out = {i: [i] for i in range(len(s))}, []
    while len(groups) > 1:
        best = None
        for a in sorted(groups):
            for b in sorted(groups):
                if a < b:
                    v = np.mean([s[i, j] for i in groups[a] for j in groups[b]])
                    if best is None or v > best[2] + 1e-12:
                        best = (a, b, v)
        a, b, v = best
        out.append((a, b, round(v, 9)))
        groups[a] += groups.pop(b)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_agglomeration_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(24, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    assert [(a, b, round(x, 9)) for a, b, x in cluster.agglomerate(s)] == brute_linkage(s)
    assert cluster.agglomerate(np.ones((1, 1))) == [] == cluster.agglomerate(np.zeros((0, 0)))


def test_clusters(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal([8, 0, 0], 0.3, (5, 3)), rng.normal([0, 8, 0], 0.3, (4, 3)), [[0, 0, 9.0]]])
    members = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(v)], "haul int, id long, vector array<double>")
    found = cluster.merges(members, "haul", "id")
    ids = cluster.cluster_ids(cluster.cut(members, found, "haul", "id", 0.8), "haul")
    assert {r.id: r.cluster for r in ids.collect()} == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(5, 9), 1), 9: -1}
    best = cluster.best_cut(cluster.sweep(members, found, "haul"), members.groupBy("haul").agg(F.count("*").alias("n")), "haul").first()
    assert (best.clusters, best.placed, best.largest) == (2, 9, 5)


def test_top_category_tie(spark):
    df = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (0, 2, "a"), (0, 3, "b"), (0, 4, "")], "g int, pos int, c string")
    assert cluster.top_category(df, "g", "c", "pos").first().category == "a"


def test_archive(spark):
    day = spark.createDataFrame([("2026-08-01", "s", "1", "paydirt"), ("2026-08-01", "s", "2", "look"), ("2026-08-02", "s", "3", "look")], "date string, slug string, id string, band string").withColumn("date", F.to_date("date"))
    again = day.where("id = '2'")
    assert rows(archive.merge_days(day, again).select("id")) == [("2",), ("3",)]
    assert [(r.month, str(r.date), r.items, r.paydirt) for r in archive.index(day).collect()] == [("2026-08", "2026-08-02", 1, 0), ("2026-08", "2026-08-01", 2, 1)]
    presets = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "slug string, name string")
    entry = "slug string, items long, paydirt long, updated string"
    out = archive.manifest(presets, spark.createDataFrame([("a", 1, 1, "today")], entry), spark.createDataFrame([("a", 9, 9, "then"), ("b", 2, 0, "then"), ("gone", 1, 1, "then")], entry))
    assert rows(out) == [("a", "A", 1, 1, "today"), ("b", "B", 2, 0, "then"), ("c", "C", None, None, None)]


def test_write_days_replaces_only_those_days(spark, tmp_path):
    path = str(tmp_path / "archive")
    df = spark.createDataFrame([("2026-08-01", "1"), ("2026-08-02", "2")], "date string, id string").withColumn("date", F.to_date("date"))
    archive.write_days(df, path)
    archive.write_days(df.where("id = '1'").withColumn("id", F.lit("9")), path)
    assert rows(spark.read.parquet(path).select("id")) == [("2",), ("9",)]


def test_budget(spark):
    asks = spark.createDataFrame([("d", i, "x", w) for i, w in enumerate([5, 8, 1, -2, 1])], "day string, seq long, client string, want long")
    assert [r.granted for r in archive.spend(asks, 10, 100).orderBy("seq").collect()] == [5, 5, 0, -2, 1]
    hours = spark.createDataFrame([("x", 0, 0, 60), ("x", 1, 10, 60), ("x", 2, 3600, 60)], "client string, seq long, at long, want long")
    assert [r.allowed for r in archive.hourly(hours, 100).orderBy("seq").collect()] == [True, False, True]
