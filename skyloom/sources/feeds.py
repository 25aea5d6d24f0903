"""Announcement feeds, search results, corpora, presets and archives as DataFrames.

Everything is read with Spark's own readers, so paths can be in any store that Spark opens.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text

FEED_SCHEMA = (
    "link string, title string, description string, pubDate string, `arxiv:announce_type` string, `dc:creator` array<string>, category array<string>"
)
ENTRY_SCHEMA = "id string, title string, summary string, published string, author array<struct<name: string>>, `arxiv:primary_category` struct<_term: string>"
CLAIM_SCHEMA = (
    "claim_version int, preset string, name string, blurb string, saved string, scout struct<categories: string, lookback_days: int, max_results: int>, "
    "touchstones array<struct<text: string, weight: string, preset: string>>, cores array<struct<doi: string, weight: string>>, "
    "blend struct<paydirt_n: int>, select struct<min_z: double, min_items: int, soft_z: double, long_z: double, max_items: int>"
)
STONE = ["arxiv_id", "title", "abstract", "authors", "primary_category", "published", "announce", "abs_url", "pdf_url"]


def _stones(rows: DataFrame, arxiv_id, title, abstract, authors, category, published, announce) -> DataFrame:
    named = rows.select(
        arxiv_id.alias("arxiv_id"), text.collapse(F.coalesce(title, F.lit(""))).alias("title"), abstract.alias("abstract"), authors.alias("authors"),
        category.alias("primary_category"), published.alias("published"), announce.alias("announce"), F.monotonically_increasing_id().alias("pos"),
    )
    return named.where((F.col("arxiv_id") != "") & (F.col("abstract") != "")).withColumns({
        "abs_url": F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id"), "pdf_url": F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id"),
    })


def announcement(spark: SparkSession, path: str, category: str | None = None, published: F.Column | None = None) -> DataFrame:
    """An RSS announcement: new and cross-listed items with an id and an abstract; replacements are dropped.

    Items without a type count as new. ``pos`` is the order in the feed.
    """
    rows = spark.read.format("xml").option("rowTag", "item").schema(FEED_SCHEMA).load(path)
    kind = F.coalesce(F.trim("`arxiv:announce_type`"), F.lit("new"))
    abstract = text.collapse(text.de_latex(text.abstract_of(F.col("description"))))
    names = text.listed(F.array_join("`dc:creator`", ","))
    main = F.lit(category) if category else F.get("category", F.lit(0))
    day = published if published is not None else dates.build_date(F.lit(""), F.col("pubDate"))
    return _stones(rows.where(kind.isin("new", "cross")), text.linked_arxiv_id(F.col("link")), F.col("title"), abstract, names, main, day, kind)


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """An Atom search result, normalised to the same text as its announcement; entries without a summary are dropped."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path)
    abstract = text.collapse(text.de_latex(F.coalesce("summary", F.lit(""))))
    names = F.transform("author", lambda a: text.collapse(a["name"]))
    day = F.to_date(F.substring("published", 1, 10))
    return _stones(rows, text.linked_arxiv_id(F.col("id")), F.col("title"), abstract, names, F.col("`arxiv:primary_category`._term"), day, F.lit("earlier"))


def built_on(spark: SparkSession, path: str) -> DataFrame:
    """The UTC date on which each feed was built, null if it doesn't say: ``path, built_on``."""
    head = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(?s)<item\b.*</item>", "").alias("head"))
    tag = lambda name: F.nullif(F.trim(F.regexp_extract("head", rf"(?s)<{name}>\s*(.*?)\s*</{name}>", 1)), F.lit(""))
    return head.select("path", dates.build_date(F.coalesce(tag("lastBuildDate"), F.lit("")), tag("pubDate")).alias("built_on"))


def assert_fresh(built: DataFrame, today: str) -> None:
    """Refuses a run on feeds that are all older than today."""
    newest = built.agg(F.max("built_on")).first()[0]
    if newest is None or str(newest) < today:
        raise RuntimeError(f"stale announcement: built on {newest}, today is {today}")


def take_while(rows: DataFrame, cutoff: F.Column, pos: str = "pos", published: str = "published", keys: list[str] | None = None) -> DataFrame:
    """The rows before the first one that was published before the cutoff; an unknown date doesn't end them.

    The end is found as an aggregate, so rows are not sorted.
    """
    old = F.min(F.when(F.col(published) < cutoff, F.col(pos))).alias("_end")
    if keys:
        joined = rows.join(rows.groupBy(*keys).agg(old), keys)
    else:
        joined = rows.crossJoin(F.broadcast(rows.agg(old)))
    return joined.where(F.col("_end").isNull() | (F.col(pos) < F.col("_end"))).drop("_end")


def merge_sources(sources: list[DataFrame], key: str = "arxiv_id") -> DataFrame:
    """Rows of several sources, one for each key: the earlier source, then the earlier row, wins."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    best = F.row_number().over(Window.partitionBy(key).orderBy("_source", "pos"))
    return every.withColumn("_n", best).where("_n = 1").drop("_n")


def fetch_all(loaders: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All categories' rows; one that fails is left out, and only if all fail is it an error."""
    found, failed = [], []
    for name, load in loaders.items():
        try:
            rows = load()
            rows.schema  # noqa: B018  the reader resolves its path here
            found.append(rows)
        except Exception as error:  # noqa: BLE001  whatever a source raises
            failed.append(f"{name}: {error}")
    if not found:
        raise RuntimeError("no category could be read: " + "; ".join(failed))
    return merge_sources(found)


def haul(announced: DataFrame, earlier: DataFrame | None, cutoff: F.Column, most: int, each: str | None = None) -> DataFrame:
    """The night's candidates: the announcement, then what the lookback adds, at most ``most``; none at all is an error.

    With ``each`` (a category) every category's lookback ends at its own first old row; without, all end at the first of any.
    """
    sources = [announced] if earlier is None else [announced, take_while(earlier, cutoff, keys=[each] if each else None)]
    rows = merge_sources(sources).orderBy("_source", "pos").limit(most).drop("_source")
    if rows.isEmpty():
        raise RuntimeError("nothing was announced")
    return rows


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus snapshot (a JSON object of records by key) with ``corpus_pos``; broken or missing files give an empty one."""
    schema = "corpus_pos long, cite_key string, openalex_id string, doi string, title string, year int, referenced_works array<string>"
    record = "struct<openalex_id: string, doi: string, title: string, year: int, referenced_works: array<string>>"
    try:
        whole = spark.read.text(path, wholetext=True)
        rows = whole.select(F.from_json("value", f"map<string, {record}>").alias("m"), F.json_object_keys("value").alias("names")).where("m is not null")
        each = rows.select(F.posexplode("names").alias("corpus_pos", "cite_key"), "m")
        out = each.select(F.col("corpus_pos").cast("long").alias("corpus_pos"), "cite_key", F.try_element_at("m", F.col("cite_key")).alias("r")).select("corpus_pos", "cite_key", "r.*")
        out.limit(1).collect()
    except Exception:  # noqa: BLE001  no corpus is a valid state
        return spark.createDataFrame([], schema)
    return out


def sync_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Counts and digest of a snapshot; a missing file, broken JSON and anything but an object are separate errors."""
    try:
        value = spark.read.text(path, wholetext=True).first()[0]
    except Exception as error:
        raise FileNotFoundError(path) from error
    kind = spark.range(1).select(F.json_object_keys(F.lit(value)).alias("names"), F.json_array_length(F.lit(value)).alias("items")).first()
    if kind.items is not None:
        raise TypeError("the corpus must be an object")
    if kind.names is None:
        raise ValueError("the corpus is not valid JSON")
    counted = corpus(spark, path).agg(F.count("*").alias("n_records"), F.count_if(F.size("referenced_works") > 0).alias("n_with_references"))
    return counted.withColumn("sha256", F.sha2(F.lit(value), 256))


def eprints(spark: SparkSession, path: str) -> DataFrame:
    """Submissions of a folder as bibliography text: ``arxiv_id`` (the file's name), ``source``."""
    rows = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(\.tar)?\.(gz|pdf|tar|bbl|bib|tex)$", "")
    return rows.select(name.alias("arxiv_id"), text.extract_source("content").alias("source"))


def references(sources: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """One row for each bibliography entry: ``key, ref_pos, raw, ref_doi, ref_arxiv, ref_title``."""
    return sources.select(key, F.posexplode(text.entries(F.col("source"))).alias("ref_pos", "_chunk")).select(key, "ref_pos", text.parsed_entry(F.col("_chunk")).alias("_r")).select(key, "ref_pos", "_r.*")


def presets(spark: SparkSession, path: str) -> DataFrame:
    """Preset files of a folder, with their ``slug``."""
    rows = spark.read.schema(CLAIM_SCHEMA).option("multiLine", True).json(path).withColumn("slug", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return rows.where("slug != 'index'")


def units(claims: DataFrame) -> DataFrame:
    """Query rows of presets: ``slug, row_idx, kind, text, doi, weight``, cores after touchstones; blank ones are dropped, a missing weight is 1."""
    weight = lambda c: F.coalesce(c.try_cast("double"), F.lit(1.0))
    texts = claims.select("slug", F.posexplode("touchstones").alias("row_idx", "t")).select("slug", "row_idx", F.lit("touchstone").alias("kind"), F.trim("t.text").alias("text"), F.lit(None).cast("string").alias("doi"), weight(F.col("t.weight")).alias("weight"))
    cores = claims.withColumn("touchstones", F.coalesce("touchstones", F.array().cast(claims.schema["touchstones"].dataType))).select("slug", "touchstones", F.posexplode("cores").alias("row_idx", "c")).select("slug", (F.col("row_idx") + F.size("touchstones")).alias("row_idx"), F.lit("core").alias("kind"), F.lit(None).cast("string").alias("text"), text.doi_key(F.col("c.doi")).alias("doi"), weight(F.col("c.weight")).alias("weight"))
    return texts.where("text != ''").unionByName(cores.where("doi != ''"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """Items of an archive table, with their month and date."""
    return spark.read.parquet(path)
