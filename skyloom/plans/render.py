"""Documents out: lines of a Markdown brief, an RSS feed, a report. Numbers are formatted here and nowhere else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gate, rank
from ..operators.numbering import numbered

#: What the bands are called.
BAND_NAMES = {"paydirt": "Pay dirt", "look": "Worth a look", "longshot": "Long shot", "picked": "Picked"}


def fixed(c: Column, digits: int) -> Column:
    """A number with a fixed number of decimals, without grouping."""
    return F.format_string(f"%.{digits}f", c)


def band_name(c: Column) -> Column:
    out = F.lit(BAND_NAMES["longshot"])
    for slug, name in BAND_NAMES.items():
        out = F.when(c == slug, name).otherwise(out)
    return out


def joined(lines: DataFrame, line: str, pos: str) -> DataFrame:
    """All lines as one text, in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(line).alias("t"))))
    return lines.agg(F.array_join(F.transform(listed, lambda x: x.t), "\n").alias("document"))


def brief(papers: DataFrame, day: str) -> DataFrame:
    """Lines of the day's page: ``section, pos, line``: chosen papers by importance, then all others that were judged."""
    shown = papers.where(F.col("briefed_on") == F.lit(day).cast("date"))
    rest = papers.where(F.col("briefed_on").isNull())
    text_of = lambda c: F.col(c).cast("string")
    line = lambda section, pos, c: [F.lit(section).alias("section"), pos.cast("long").alias("pos"), c.alias("line")]
    counts = shown.agg(F.count("*").alias("n")).crossJoin(rest.agg(F.count("*").alias("m"), F.count_if("relevant").alias("r")))
    head = F.concat(F.lit(f"# Papers of {day}\n\nchosen: "), text_of("n"), F.lit(", judged: "), (F.col("n") + F.col("m")).cast("string"), F.lit(", relevant: "), (F.col("n") + F.col("r")).cast("string"))
    listed = F.concat(F.lit("# Set aside: "), text_of("m"))
    both = counts.select(*line(0, F.lit(0), head)).unionByName(counts.select(*line(2, F.lit(0), listed)))
    said = lambda label, c: F.concat(F.lit(f"\n- {label}: "), F.coalesce(F.nullif(c, F.lit("")), F.lit("not said")))
    link = F.concat(F.lit("\n- https://arxiv.org/abs/"), "arxiv_id")
    slide = F.concat(F.lit("## "), text_of("_n"), F.lit(" "), "title", said("claim", "claim"), said("stakes", "stakes"), said("connection", "connection"), F.lit("\n- verdict: "), rank.verdict(F.coalesce("verdict", F.lit("skim"))), link)
    best = [F.desc_nulls_last("importance"), F.asc("cite_key")]
    slides = numbered(shown, [], best, "_n").select(*line(1, F.col("_n"), slide))
    judged = F.when(F.col("relevant"), " (relevant)").otherwise("")
    other = F.concat(F.lit("* "), F.coalesce(F.nullif("title", F.lit("")), F.col("cite_key")), judged, F.lit(": "), F.coalesce(F.nullif("filter_reason", F.lit("")), F.lit("not said")), F.lit(" https://arxiv.org/abs/"), "arxiv_id")
    others = numbered(rest, [], [F.desc_nulls_last("relevant"), *best], "_k").select(*line(3, F.col("_k"), other))
    return both.unionByName(slides).unionByName(others)


def brief_text(papers: DataFrame, day: str) -> DataFrame:
    return joined(brief(papers, day).withColumn("_at", F.struct("section", "pos")), "line", "_at")


def guid(slug: Column, day: Column, key: Column) -> Column:
    return F.concat_ws(":", slug, day, key)


def rss_item(items: DataFrame) -> DataFrame:
    """One RSS item for each row: ``slug, pos, item``. Needs slug, day, id, title, link, grade, z, band, label, authors, abstract."""
    pos = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("grade"), "id"))
    why = F.concat_ws(
        " · ", F.concat(F.lit("Grade "), fixed(F.col("grade"), 3)), F.when(F.col("z").isNotNull(), F.concat(fixed(F.col("z"), 1), F.lit(" sigma above the baseline"))),
        F.when(F.col("label").isNotNull(), F.concat(F.lit("matched "), "label")), F.nullif("authors", F.lit("")),
    )
    body = F.concat(F.lit("<p><strong>"), text.xml_escape(band_name(F.col("band"))), F.lit("</strong></p><p>"), text.xml_escape(why), F.lit("</p><p>"), text.xml_escape(F.col("abstract")), F.lit("</p>"))
    item = F.concat(
        F.lit("<item><title>"), text.xml_escape(F.coalesce(F.nullif("title", F.lit("")), F.col("id"))), F.lit("</title><link>"), text.xml_escape(F.col("link")),
        F.lit('</link><guid isPermaLink="false">'), text.xml_escape(guid(F.col("slug"), F.col("day"), F.col("id"))), F.lit("</guid><description>"), text.xml_escape(body),
        F.lit("</description><x:band>"), F.col("band"), F.lit("</x:band><x:grade>"), fixed(F.col("grade"), 3), F.lit("</x:grade></item>"),
    )
    return items.withColumn("pos", pos).select("slug", "pos", item.alias("item"))


def rss(items: DataFrame, site: str) -> DataFrame:
    """One feed document for each slug: ``slug, document``; its description carries the tally."""
    counts = gate.band_counts(items, ["slug"]).select("slug", gate.tally(F.col("paydirt"), F.col("look"), F.col("longshot")).alias("_tally"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "\n")
    each = rss_item(items).groupBy("slug").agg(listed.alias("_items")).join(counts, "slug")
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0" xmlns:x="urn:skyloom:feed"><channel>\n<title>'), text.xml_escape(F.col("slug")), F.lit("</title><link>"),
        text.xml_escape(F.concat(F.lit(site), F.lit("?preset="), F.url_encode("slug"))), F.lit("</link><description>"), text.xml_escape("_tally"), F.lit("</description>\n"),
    )
    return each.select("slug", F.concat(head, "_items", F.lit("\n</channel></rss>\n")).alias("document"))


def report_lines(items: DataFrame, key: str = "id") -> DataFrame:
    """Report items as Markdown: ``pos, line``."""
    z = F.when(F.col("z").isNotNull(), F.concat(F.lit(", z "), short_number(F.col("z")))).otherwise("")
    line = F.concat(F.col("pos").cast("string"), F.lit(". **"), "title", F.lit("** ("), band_name(F.col("band")), F.lit(", grade "), fixed(F.col("grade"), 3), z, F.lit(")"))
    return numbered(items, [], [F.desc("grade"), F.asc(key)], "pos").select("pos", line.alias("line"))


def short_number(c: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(fixed(F.round(c, 2), 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def write_text(document: DataFrame, path: str) -> None:
    """Writes one document column as a text file; a document is one row."""
    document.select(F.col(document.columns[-1])).coalesce(1).write.mode("overwrite").text(path)
