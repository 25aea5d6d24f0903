from __future__ import annotations

import json
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from skyloom.plans import claims, providers, render
from skyloom.sources import feeds
from skyloom.streaming import incremental

RSS = """<?xml version="1.0"?><rss xmlns:dc="d" xmlns:arxiv="a"><channel><lastBuildDate>Mon, 17 Aug 2026 00:00:00 -0400</lastBuildDate>
<item><title>A  title</title><link>https://arxiv.org/abs/2608.00001v1</link><description>arXiv:2608.00001v1 Announce Type: new Abstract: We &#8722; show L\\"uders</description><dc:creator>A One, B Two</dc:creator><category>quant-ph</category><arxiv:announce_type>new</arxiv:announce_type></item>
<item><title>Old</title><link>https://arxiv.org/abs/2608.00002</link><description>Abstract: Gone</description><arxiv:announce_type>replace</arxiv:announce_type></item>
<item><title>No abstract</title><link>https://arxiv.org/abs/2608.00003</link><description></description></item>
</channel></rss>"""
ATOM = """<feed xmlns:arxiv="a"><entry><id>http://arxiv.org/abs/2608.00009v2</id><published>2026-08-13T01:00:00Z</published><title>T</title><summary> some
 text </summary><author><name>A One</name></author></entry><entry><id>http://arxiv.org/abs/2608.00010v1</id><published>2026-08-13T01:00:00Z</published><title>U</title><summary> </summary></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RSS)
    (tmp_path / "b.xml").write_text(ATOM)
    got = feeds.announcement(spark, str(tmp_path / "a.xml")).collect()
    assert [(r.arxiv_id, r.title, r.abstract, r.authors, r.announce) for r in got] == [("2608.00001", "A title", "We − show Lüders", ["A One", "B Two"], "new")]
    found = feeds.search_results(spark, str(tmp_path / "b.xml")).collect()
    assert [(r.arxiv_id, r.abstract, str(r.published), r.authors) for r in found] == [("2608.00009", "some text", "2026-08-13", ["A One"])]
    built = feeds.built_on(spark, str(tmp_path / "a.xml"))
    assert str(built.first().built_on) == "2026-08-17"
    feeds.assert_fresh(built, "2026-08-17")
    with pytest.raises(RuntimeError, match="stale"):
        feeds.assert_fresh(built, "2026-08-18")


def test_take_while_stops_at_the_first_old_row(spark):
    df = spark.createDataFrame([(0, date(2026, 8, 14)), (1, date(2026, 8, 13)), (2, date(2026, 8, 2)), (3, date(2026, 8, 13))], "pos long, published date")
    assert rows(feeds.take_while(df, F.lit("2026-08-13").cast("date")).select("pos")) == [(0,), (1,)]
    assert feeds.take_while(df.where("pos < 2"), F.lit("2026-08-13").cast("date")).count() == 2


def test_sources_merge(spark):
    a = spark.createDataFrame([("1", 0), ("2", 1)], "arxiv_id string, pos long")
    b = spark.createDataFrame([("2", 0), ("3", 1)], "arxiv_id string, pos long")
    assert rows(feeds.merge_sources([a, b]).select("arxiv_id", "_source")) == [("1", 0), ("2", 0), ("3", 1)]

    def broken():
        raise OSError("down")

    assert feeds.fetch_all({"a": lambda: a, "x": broken}).count() == 2
    with pytest.raises(RuntimeError, match="no category"):
        feeds.fetch_all({"x": broken})


def test_corpus(spark, tmp_path):
    good = tmp_path / "works.json"
    good.write_text(json.dumps({"b": {"openalex_id": "W2", "doi": "10.1/x", "title": "T", "year": 2020, "referenced_works": ["W1"]}, "a": {"openalex_id": "W1"}}))
    assert rows(feeds.corpus(spark, str(good)).select("corpus_pos", "cite_key", "openalex_id")) == [(0, "b", "W2"), (1, "a", "W1")]
    facts = feeds.sync_corpus(spark, str(good)).first()
    assert (facts.n_records, facts.n_with_references, len(facts.sha256)) == (2, 1, 64)
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "list.json").write_text("[1]")
    assert feeds.corpus(spark, str(tmp_path / "none.json")).count() == 0 == feeds.corpus(spark, str(tmp_path / "bad.json")).count()
    for name, error in (("none.json", FileNotFoundError), ("bad.json", ValueError), ("list.json", TypeError)):
        with pytest.raises(error):
            feeds.sync_corpus(spark, str(tmp_path / name))


def test_presets_and_claims(spark, tmp_path):
    raw = {"claim_version": 1, "name": " Spin ", "touchstones": [{"text": " valley ", "weight": "2"}, {"text": " "}], "cores": [{"doi": "https://doi.org/10.1/X"}, {"doi": ""}], "select": {"min_z": 99}}
    (tmp_path / "spin.json").write_text(json.dumps(raw))
    got = feeds.units(feeds.presets(spark, str(tmp_path))).orderBy("row_idx").collect()
    assert [(r.slug, r.kind, r.text, r.doi, r.weight) for r in got] == [("spin", "touchstone", "valley", None, 2.0), ("spin", "core", None, "doi:10.1/x", 1.0)]
    df = spark.createDataFrame([(json.dumps(raw),), ("junk",), (None,)], "j string")
    found = [r.c for r in df.select(claims.sanitize(F.col("j")).alias("c")).collect()]
    assert (found[0].name, found[0]["select"].min_z, found[0]["select"].max_items, len(found[0].touchstones), found[0].cores[0].doi) == ("Spin", 4.0, 8, 1, "10.1/x")
    assert found[1] is None and found[2] is None


def test_claim_table(spark):
    table = spark.createDataFrame([("working", "Working", None), ("a", "Zed", "p"), ("b", "Abe", "p")], "slug string, name string, preset string")
    assert [r.slug for r in claims.listed(table).collect()] == ["working", "b", "a"]
    assert rows(claims.delete(claims.delete(table, "a"), "working").select("slug")) == [("b",), ("working",)]
    assert ("b-2",) in rows(claims.fork(table, "a", "B").select("slug"))
    assert tuple(claims.active_preset(table.where("preset is not null")).first()) == ("p", False)


PAPER = "cite_key string, arxiv_id string, title string, abstract string, summary string, research_question string, contribution string, topics array<string>, relevance_score double, relevant boolean, filter_reason string, scites int, centrality double, cited_in_corpus array<string>, importance double, claim string, stakes string, connection string, verdict string, briefed_on date, status string"


def test_stages_end_to_end(spark):
    papers = spark.createDataFrame([("a", "1", "Alpha"), ("b", "2", "Beta"), ("c", "3", "Broken")], "cite_key string, arxiv_id string, title string")
    papers = spark.createDataFrame([], PAPER).unionByName(papers.withColumn("abstract", F.concat("title", F.lit(" text"))).withColumn("status", F.lit("new")), allowMissingColumns=True)
    say = lambda **x: json.dumps(x)
    first = providers.Scripted({"Broken": "not json"}, say(summary="s", research_question="q", contribution="c"))
    papers = providers.summarize(papers, first, "sys").cache()
    assert rows(papers.select("cite_key", "status")) == [("a", "summarized"), ("b", "summarized"), ("c", "new")]
    second = providers.Scripted({"Alpha": say(relevant=True, score=0.9, matched=["spin", "invented"], reason="yes")}, say(relevant=False, score=0.1, matched=[], reason="off topic"))
    papers = providers.judge(papers, second, "sys", ["spin"]).cache()
    assert rows(papers.select("cite_key", "status", "relevant", "topics")) == [("a", "filtered", True, ["spin"]), ("b", "summarized", False, []), ("c", "new", None, None)]
    papers = providers.rank_stage(papers, {"llm": 1.0}).cache()
    third = providers.Scripted({}, say(claim="claim", stakes="st", connection="co", verdict="SKIP!"))
    papers = providers.pitch(papers, third, "sys", 2, F.lit("2026-08-17").cast("date")).cache()
    done = papers.where("cite_key = 'a'").first()
    assert (done.status, done.verdict, done.importance, str(done.briefed_on)) == ("briefed", "skim", 0.9, "2026-08-17")
    page = render.brief_text(papers, "2026-08-17").first().document
    assert page.startswith("# Papers of 2026-08-17") and "\n- claim: claim\n" in page and "* Beta: off topic https://arxiv.org/abs/2" in page
    assert page == render.brief_text(papers, "2026-08-17").first().document


def test_vectorize_embeds_only_what_is_missing(spark):
    embedder = providers.HashEmbedder(8)
    texts = spark.createDataFrame([("1", "a b"), ("2", "a  b"), ("3", "c")], "id string, text string")
    empty = spark.createDataFrame([], "text_sha string, model string, dim int, vector array<double>, seen_at date")
    every, made = providers.vectorize(texts, empty, embedder, F.current_date())
    assert every.count() == 3 and made.count() == 2
    again, made = providers.vectorize(texts, made, embedder, F.current_date())
    assert again.count() == 3 and made.count() == 0


def test_enrichment_replies(spark):
    df = spark.createDataFrame([('{"headline": "h", "verdict": "READ", "kind": "odd"}',), ('{"verdict": "read"}',), ("{broken",)], "r string")
    got = [r.e for r in df.select(providers.enrichment(F.col("r")).alias("e")).collect()]
    assert (got[0].headline, got[0].verdict, got[0].kind) == ("h", "read", "") and got[1] is None and got[2] is None


def test_rss_document(spark):
    items = spark.createDataFrame([("s", "2026-08-17", "1", "A & B", "https://x/1", 0.9, 4.7, "paydirt", "row", "A One", "text <b>")], "slug string, day string, id string, title string, link string, grade double, z double, band string, label string, authors string, abstract string")
    page = render.rss(items, "https://x/").first().document
    assert "A &amp; B" in page and "s:2026-08-17:1" in page and "pay dirt: 1" in page and "&amp;lt;b&amp;gt;" in page


def events(spark, path):
    df = spark.createDataFrame([(1, "a", "2026-08-17 10:00:00", 1.0), (2, "b", "2026-08-17 10:01:00", 2.0), (1, "a", "2026-08-17 10:02:00", 1.0), (3, "a", "2026-08-17 11:30:00", 4.0)], "id long, client string, t string, value double")
    df.select("id", "client", F.to_timestamp_ntz("t").alias("ts"), "value").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def test_stream_dedup_and_meter(spark, tmp_path):
    schema = events(spark, str(tmp_path / "in"))
    stream = incremental.read(spark, str(tmp_path / "in"), schema)
    incremental.append_available(incremental.first_within(stream, ["id"], "ts", "3 hours"), str(tmp_path / "c1"), str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id")) == [(1,), (2,), (3,)]
    seen = []
    meter = incremental.client_meter(stream.withColumn("want", F.lit(2).cast("long")), 3)
    incremental.run_available(meter, str(tmp_path / "c2"), lambda batch, _: seen.extend(tuple(r) for r in batch.collect()), "update")
    assert sorted(seen) == [("a", 6, 3, 3), ("b", 2, 2, 2)]


def test_windows(spark, tmp_path):
    events(spark, str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in incremental.tumbling(df, "ts", "1 hour", ["client"]).collect()) == [1, 1, 2]
    assert sorted(r.n for r in incremental.sessions(df, "ts", "5 minutes", ["client"]).collect()) == [1, 1, 2]


def test_each_category_looks_back_by_itself(spark):
    days = [date(2026, 8, 14), date(2026, 8, 10)]
    rows = [("a", 0, "x", days[0]), ("b", 1, "x", days[1]), ("c", 2, "y", days[0]), ("d", 3, "y", days[0]), ("e", 4, "x", days[0])]
    earlier = spark.createDataFrame(rows, "arxiv_id string, pos long, category string, published date")
    announced = earlier.limit(0)
    cut = F.lit("2026-08-13").cast("date")
    assert {r.arxiv_id for r in feeds.haul(announced, earlier, cut, 9).collect()} == {"a"}
    assert {r.arxiv_id for r in feeds.haul(announced, earlier, cut, 9, "category").collect()} == {"a", "c", "d"}
