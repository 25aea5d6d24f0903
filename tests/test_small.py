"""Small operators: archive entries, menus, labels, exports, codecs, write requests, report lines."""

from __future__ import annotations

import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from skyloom.functions import vectors
from skyloom.operators import archive, grade, store
from skyloom.plans import claims, render


def test_menu_of_feeds(spark):
    presets = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "D")], "slug string, name string")
    manifest = spark.createDataFrame([("a", 5, 2), ("b", 0, 0), ("c", 3, 0), ("x", 1, 1)], "slug string, items long, paydirt long")
    got = {r.slug: r.note for r in archive.menu(presets, manifest).collect()}
    assert got == {"a": "5 today, 2 pay dirt", "b": "nothing today", "c": "3 today", "d": "builds tonight"}


def test_archive_entry(spark):
    schema = "arxiv_id string, title string, link string, authors string, grade double, z double, band string, matched struct<label: string>, enrichment struct<verdict: string, kind: string, headline: string, so_what: string, caveat: string>, abstract string"
    rows = [("1", "", "l", None, 0.61237, 4.7249, None, None, None, "long"), ("2", "T", "l", "A", 0.5, None, "look", ("row",), ("read", "theory", "h", "s", "c"), "long")]
    a, b = archive.entry(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    assert (a.id, a.title, a.authors, a.grade, a.z, a.band, a.matched, a.verdict) == ("1", "1", "", 0.612, 4.7, "longshot", "", "")
    assert (b.title, b.z, b.matched, b.headline, b.caveat) == ("T", None, "row", "h", "c") and "abstract" not in a.asDict()


def test_labels_of_rows(spark):
    rows = [(0, "touchstone", "x" * 200, None, None), (1, "core", "abstract", "Title", "doi:10.1/a"), (2, "core", None, "", "doi:10.1/a")]
    df = spark.createDataFrame(rows, "i int, kind string, text string, title string, doi string").select("i", grade.feature_label().alias("l"))
    got = [r.l for r in df.orderBy("i").collect()]
    assert (len(got[0]), got[0][-1], got[1:]) == (80, "…", ["Title", "doi:10.1/a"])


def test_codecs(spark):
    data = struct.pack("<3f", 1.0, -2.5, 0.25)
    text = base64.b64encode(data).decode()
    assert vectors.decode_centroid(text) == [1.0, -2.5, 0.25]
    assert spark.range(1).select(vectors.base64_to_hex(F.lit(text)).alias("h")).first().h == "\\x" + data.hex()


def test_exported_claim_names_its_empty_fields(spark):
    claim = spark.createDataFrame([(("n", None),)], "c struct<name: string, blurb: string>")
    assert json.loads(claim.select(claims.to_json(F.col("c")).alias("j")).first().j) == {"name": "n", "blurb": None}


def test_vector_write_requests(spark):
    sha = "0" * 64
    rows = [(0, sha, 2, [1.0, 2.0]), (1, "short", 2, [1.0, 2.0]), (2, sha, 2, [1.0]), (3, sha, 2, [1.0, float("nan")]), (4, None, 2, [1.0, 2.0]), (5, sha, 2, None)]
    df = spark.createDataFrame(rows, "i int, text_sha string, dim int, vector array<double>")
    got = {r.i: r.error for r in store.valid_vector_writes(df).collect()}
    assert got == {0: None, 1: "bad key", 2: "wrong length", 3: "not a number", 4: "bad key", 5: "wrong length"}
    with pytest.raises(ValueError, match="more than 3"):
        store.valid_vector_writes(df, 3)


def test_report_lines_in_order(spark):
    items = spark.createDataFrame([("b", "B", 0.5, None, "look"), ("a", "A", 0.5, 2.0, "paydirt"), ("c", "C", 0.9, 4.5, "paydirt")], "id string, title string, grade double, z double, band string")
    got = [r.line for r in render.report_lines(items).orderBy("pos").collect()]
    assert [g.split("**")[1] for g in got] == ["C", "A", "B"] and got[0].startswith("1. ") and "z 4.5" in got[0] and ", z" not in got[2]
