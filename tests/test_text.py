from __future__ import annotations

import gzip
import io
import tarfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from skyloom.functions import dates, tex, text


def one(spark, column, *values, schema=None):
    """The value of a column over one row of values ``a``, ``b``, ..."""
    names = [chr(97 + i) for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], schema or ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "bare"), [("https://arxiv.org/abs/2401.12345v2", "2401.12345"), ("arXiv:2401.12345", "2401.12345"), ("cond-mat/0512345v1", "cond-mat/0512345"), (None, "")])
def test_bare_id(spark, raw, bare):
    assert one(spark, text.bare_arxiv_id(F.col("a")), raw, schema="a string") == bare


@pytest.mark.parametrize(("raw", "doi"), [("https://doi.org/10.1/X", "10.1/x"), ("http://dx.doi.org/10.1/x", "10.1/x"), ("DOI:10.1/x", "10.1/x"), ("arXiv:1234", ""), ("", ""), (None, ""), ("junk", "")])
def test_doi(spark, raw, doi):
    assert one(spark, text.normalize_doi(F.col("a")), raw, schema="a string") == doi


def test_key_forms(spark):
    assert one(spark, text.doi_key(F.col("a")), "https://doi.org/10.1/X") == "doi:10.1/x"
    assert one(spark, text.arxiv_doi(F.col("a")), "2401.1v3") == "10.48550/arxiv.2401.1"
    assert one(spark, text.clean_doi(F.col("a")), "10.1/Ab.).") == "10.1/ab"
    assert one(spark, text.norm_title(F.col("a")), "A Title: of-Things 2") == "atitleofthings2"


def test_collapse_and_sha(spark):
    assert one(spark, text.collapse(F.col("a")), "  a \n b\t") == "a b"
    assert one(spark, text.text_sha(F.col("a")), " a  b ") == one(spark, text.text_sha(F.col("a")), "a b")
    assert one(spark, text.text_sha(F.col("a")), None, schema="a string") == one(spark, text.text_sha(F.col("a")), "")


def test_labels(spark):
    label = one(spark, text.clip_label(F.col("a")), "x" * 200)
    assert len(label) == 80 and label.endswith("…")
    assert one(spark, text.row_label(F.col("a"), F.col("b")), "", "body") == "body"
    assert one(spark, text.slugify(F.col("a")), " Spin  Qubits! ") == "spin-qubits"
    assert one(spark, text.slugify(F.col("a")), "!!") == "untitled"
    assert one(spark, text.xml_escape(F.col("a")), "<a & 'b'>\"") == "&lt;a &amp; &apos;b&apos;&gt;&quot;"
    assert one(spark, text.title_case(F.col("a")), "read") == "Read"
    assert one(spark, text.embed_text(F.col("a"), F.col("b")), "T", "") == "T T"


def test_abstract_header(spark):
    assert one(spark, text.abstract_of(F.col("a")), "arXiv:1 Announce Type: new\nAbstract: We\n show") == "We show"
    assert one(spark, text.abstract_of(F.col("a")), "plain  text") == "plain text"


@pytest.mark.parametrize(("raw", "items"), [(None, []), ("", []), ('["a", "b"]', ["a", "b"]), ("not json", ["not json"]), ('"x"', ["x"]), ("[broken", ["[broken"])])
def test_json_list(spark, raw, items):
    assert one(spark, text.json_list(F.col("a")), raw, schema="a string") == items


def test_rebuild_abstract(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},), ({"a": [0], "c": [2]},), (None,)], "m map<string, array<int>>")
    assert [r.x for r in df.select(text.rebuild_abstract(F.col("m")).alias("x")).collect()] == ["a b a", "a", ""]


def test_bibliography(spark):
    bbl = r"\begin{x}\bibitem{a} Someone, plain. \bibitem{b} Other, cond-mat/0512345, doi 10.1103/PhysRevB.1. \bibitem{c} arXiv:2401.01234"
    df = spark.createDataFrame([(bbl,)], "s string")
    found = df.select(F.explode(text.entries(F.col("s"))).alias("c")).select(text.parsed_entry(F.col("c")).alias("r")).select("r.*").collect()
    assert [(r.ref_doi, r.ref_arxiv) for r in found] == [(None, None), ("10.1103/physrevb.1", "cond-mat/0512345"), (None, "2401.01234")]
    bib = '@article{a, title = {A\n Title}, doi = {10.1000/abc},}\n@article{b, title="Second", eprint={arXiv:2301.00001},}'
    df = spark.createDataFrame([(bib,)], "s string")
    found = df.select(F.explode(text.entries(F.col("s"))).alias("c")).select(text.parsed_entry(F.col("c")).alias("r")).select("r.*").collect()
    assert [(r.ref_title, r.ref_doi, r.ref_arxiv) for r in found] == [("A Title", "10.1000/abc", None), ("Second", None, "2301.00001")]
    assert one(spark, text.bib_dois(F.col("a")), "doi = {10.1/abc}, DOI={x}") == ["10.1/abc"]
    assert one(spark, F.size(text.entries(F.col("a"))), "") == 0
    assert tex.field("@a{x, booktitle = {No}, title = {A {nested} one}}", "title") == "A {nested} one" and tex.field("title = {open", "title") is None
    assert tex.work("see 2401.01234 and 1999.12345")["ref_arxiv"] is None and tex.work("https://arxiv.org/abs/2401.01234v2")["ref_arxiv"] == "2401.01234"


@pytest.mark.parametrize(
    ("markup", "plain"),
    [
        (r"K\"onig", "König"), (r"a \beta-decay", "a β-decay"), (r"90{\deg} turn", "90° turn"), (r"M\"{u}ller", "Müller"), (r"{\`a} la", "à la"), (r"\v{s}", "š"), (r"\omega oscillation", "ωoscillation"), (r"\command x", r"\command x"),
        ("no markup", "no markup"), (r"Wei{\ss}", "Weiß"), (r"gar\c{c}on", "garçon"), (r"na\"{\i}ve", "naïve"), (r"\'\i", "í"), (r"\O re", "Øre"), (r"\c", r"\c"), ("\\", "\\"), (r"{\unclosed", r"{\unclosed"), (r"\"{ou}", r"\"{ou}"),
    ],
)
def test_markup(spark, markup, plain):
    assert tex.to_unicode(markup) == plain == tex.to_unicode(plain)
    assert one(spark, text.de_latex(F.col("a")), markup) == plain


@pytest.mark.parametrize(
    ("name", "short"),
    [("Inés Quiroga", "I. Quiroga"), ("Okafor, B. T.", "B. T. Okafor"), ("Marie-Luise von der Heide", "M.-L. von der Heide"), ("Piet Van Loon", "P. Van Loon"), (r"J\"org Ma{\ss}en", "J. Massen"), ("Cher", "Cher"), ("", ""), (None, "")],
)
def test_authors(spark, name, short):
    assert one(spark, text.short_author(F.col("a")), name, schema="a string") == short


def test_author_lists(spark):
    df = spark.createDataFrame([(["Inés Quiroga", None, "", "Okafor, B."],), (None,)], "a array<string>")
    assert [r[0] for r in df.select(text.short_authors("a")).collect()] == ["I. Quiroga, B. Okafor", ""]


def test_cite_keys(spark):
    df = spark.createDataFrame([(["Ana Muñoz", "B"], "2024-01-02", "2401.1v2"), (None, "bad", "x/1")], "au array<string>, p string, i string")
    assert [r.k for r in df.select(text.cite_key(F.col("au"), F.col("p"), F.col("i")).alias("k")).collect()] == ["Munoz2024_2401.1", "Anon_x/1"]


def test_archives():
    def tar(**files):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, body in files.items():
                info = tarfile.TarInfo(name.replace("_", "."))
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        return out.getvalue()

    assert tex.source_of(b"%PDF-1.5 ...") == ""
    assert tex.source_of(gzip.compress(tar(a_bbl=b"BBL", a_tex=b"TEX"))) == "BBL"
    assert tex.source_of(tar(a_tex=b"TEX")) == "TEX"
    assert tex.source_of(gzip.compress(b"plain")) == "plain"
    assert tex.source_of(None) == ""


def test_cluster_key_ignores_order(spark):
    a = spark.createDataFrame([("1", " A  b"), ("2", "c")], "i string, t string")
    b = spark.createDataFrame([("2", "c"), ("1", "A b")], "i string, t string")
    key = text.cluster_key(F.col("i"), F.col("t"))
    assert a.agg(key).first()[0] == b.agg(key).first()[0] != a.where("i = '1'").agg(key).first()[0]


@pytest.mark.parametrize(("day", "back", "cut"), [("2026-08-17", 2, "2026-08-13"), ("2026-08-14", 2, "2026-08-12"), ("2026-08-17", 0, "2026-08-14"), ("2026-08-17", 1, "2026-08-14"), ("2026-08-16", 1, "2026-08-14")])
def test_weekday_cutoff(spark, day, back, cut):
    df = spark.createDataFrame([(date.fromisoformat(day),)], "d date")
    assert str(df.select(dates.weekday_cutoff(F.col("d"), back)).first()[0]) == cut


def test_build_date(spark):
    df = spark.createDataFrame([("", "Mon, 17 Aug 2026 00:00:00 -0400"), (None, "garbage"), ("Tue, 18 Aug 2026 04:00:21 +0000", "x")], "l string, p string")
    assert [str(r.d) for r in df.select(dates.build_date(F.col("l"), F.col("p")).alias("d")).collect()] == ["2026-08-17", "None", "2026-08-18"]


@pytest.mark.parametrize("chunk, doi, arxiv", [
    (r"\href{https://doi.org/10.1103/PhysRevA.1.1}{Phys. Rev.}", "10.1103/physreva.1.1", None), ("https://dx.doi.org/10.1000/ABC.", "10.1000/abc", None), ("http://arxiv.org/abs/quant-ph/9705052", None, "quant-ph/9705052"),
    ("abs/cond-mat/0512345v2 abs/cond-mat/0512345", None, "cond-mat/0512345"), ("arXiv:cond-mat/9701055, doi:10.1103/PhysRevA.57.120.", "10.1103/physreva.57.120", "cond-mat/9701055"), ("(doi 10.1016/S0(99)1-2)", "10.1016/s0(99)1-2", None),
    ("math.GT/0309136 and arXiv: 2401.12345v3", None, "2401.12345"), ("ArXiv 0704.0001", None, "0704.0001"), ("https://arxiv.org/pdf/2401.01234.pdf", None, "2401.01234"), ("pp. 2401.01234, 110.1000/x, 10.99/x, x10.1000/y", None, None),
    ("Acond-mat/0512345 hep-th/01234567 a/0512345", None, None), ("doi={10.1000/a,b}", "10.1000/a", None), ("10.1000/ 10.1000/).", None, None), ("", None, None),
])
def test_identifiers_of_a_reference(chunk, doi, arxiv):
    found = tex.work(chunk)
    assert (found["ref_doi"], found["ref_arxiv"]) == (doi, arxiv)


def test_cited_dois():
    assert tex.cited_dois("@a{x, doi = {10.1000/a}, title={T}}\n@b{y, DOI=\"https://doi.org/10.1/B\"}\n@c{z, doi={10.}, doi={none}}") == ["10.1000/a", "https://doi.org/10.1/B"]
    assert tex.cited_dois("doi = {10.1/abc}, DOI={ 10.2/x }") == ["10.1/abc", "10.2/x"] and tex.cited_dois(None) == []
