"""References matched to a corpus, in a cascade of equi-joins, and what the matches say about a paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .rank import centrality


def indices(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lookup tables of a corpus in file order (``corpus_pos``): by DOI and by title the first record stands, by id the last."""
    keyed = corpus.select("corpus_pos", "cite_key", "openalex_id", text.normalize_doi(F.col("doi")).alias("doi"), text.norm_title(F.col("title")).alias("title"))
    first = lambda c: keyed.where(F.col(c) != "").groupBy(c).agg(F.min_by("cite_key", "corpus_pos").alias("key"))
    ids = keyed.where(F.col("openalex_id").isNotNull()).groupBy("openalex_id").agg(F.max_by("cite_key", "corpus_pos").alias("key"))
    return first("doi"), first("title"), ids


def match_refs(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``matched_key``: by DOI, else by the archive's DOI of the id, else by title; null without a match.

    A missing key is joined as a key of its own row that nothing has, so that rows without one are spread over all tasks.
    """
    by_doi, by_title, _ = indices(corpus)
    keyed = refs.withColumns({
        "_doi": F.nullif(text.normalize_doi(F.col("ref_doi")), F.lit("")), "_arxiv": F.nullif(text.arxiv_doi(F.col("ref_arxiv")), F.lit("")),
        "_title": F.nullif(text.norm_title(F.col("ref_title")), F.lit("")),
    })
    none = F.concat(F.lit("\u0000"), F.xxhash64(*refs.columns).cast("string"))
    out = keyed.withColumns({name: F.coalesce(name, none) for name in ("_doi", "_arxiv", "_title")})
    for name, table, column in (("_doi", by_doi, "doi"), ("_arxiv", by_doi, "doi"), ("_title", by_title, "title")):
        out = out.join(table.select(F.col(column).alias(name), F.col("key").alias(f"{name}_key")), name, "left")
    found = F.coalesce("_doi_key", "_arxiv_key", "_title_key")
    return out.withColumn("matched_key", found).select(*refs.columns, "matched_key")


def ordered_keys(pairs: DataFrame, key: str, pos: str, value: str, out: str) -> DataFrame:
    """The distinct values of each key in the order in which they first come."""
    firsts = pairs.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(pos).alias("_pos"))
    listed = F.array_sort(F.collect_list(F.struct("_pos", value)))
    return firsts.groupBy(key).agg(F.transform(listed, lambda p: p[value]).alias(out))


def overlap(papers: DataFrame, corpus: DataFrame, key: str = "cite_key", refs: str = "referenced_works") -> DataFrame:
    """Each paper's corpus keys among its references, in order, once each; papers without any are left out."""
    _, _, ids = indices(corpus)
    edges = papers.select(key, F.posexplode(refs).alias("_at", "openalex_id"))
    return ordered_keys(edges.join(ids, "openalex_id"), key, "_at", "key", "matched")


def bibliography_matches(refs: DataFrame, key: str = "cite_key") -> DataFrame:
    """Each paper's matched corpus keys in the order of its bibliography."""
    return ordered_keys(refs, key, "ref_pos", "matched_key", "matched")


def titles_of(matches: DataFrame, corpus: DataFrame, key: str = "cite_key") -> DataFrame:
    """The matched keys' titles, or the keys themselves where a title is missing, in the same order."""
    names = corpus.groupBy(F.col("cite_key").alias("_key")).agg(F.max_by("title", "corpus_pos").alias("_title"))
    each = matches.select(key, F.posexplode("matched").alias("_at", "_key")).join(names, "_key", "left")
    title = F.coalesce(F.nullif("_title", F.lit("")), F.col("_key"))
    listed = F.array_sort(F.collect_list(F.struct("_at", title.alias("_name"))))
    return each.groupBy(key).agg(F.transform(listed, lambda p: p["_name"]).alias("cited_in_corpus"))


def connect(papers: DataFrame, refs: DataFrame, resolved: DataFrame, corpus: DataFrame) -> DataFrame:
    """How papers connect to the corpus: ``cite_key, openalex_id, doi, centrality, cited_in_corpus, connected``.

    A bibliography with matches decides alone. Else the resolved record (``cite_key, openalex_id, doi,
    referenced_works``) does: none leaves all unknown; one without references gives its ids only; one with references but no
    overlap gives 0 and an empty list.
    """
    bib = bibliography_matches(refs).withColumnRenamed("matched", "_bib")
    open_ = papers.select("cite_key").join(bib, "cite_key", "left_anti")
    found = resolved.join(open_, "cite_key", "left_semi")
    oa = overlap(found, corpus).withColumnRenamed("matched", "_oa")
    rows = papers.select("cite_key").join(bib, "cite_key", "left").join(found.select("cite_key", "openalex_id", "doi", "referenced_works"), "cite_key", "left").join(oa, "cite_key", "left")
    none = F.array().cast("array<string>")
    known = F.when(F.col("_bib").isNotNull(), F.col("_bib")).when(F.size(F.coalesce("referenced_works", none)) > 0, F.coalesce("_oa", none))
    decided = rows.select("cite_key", "openalex_id", "doi", known.alias("matched"))
    titles = titles_of(decided.where("matched is not null"), corpus)
    out = decided.join(titles, "cite_key", "left")
    named = F.when(F.col("matched").isNotNull(), F.coalesce("cited_in_corpus", none))
    score = F.when(F.col("matched").isNotNull(), centrality(F.col("matched")))
    return out.select("cite_key", "openalex_id", "doi", score.alias("centrality"), named.alias("cited_in_corpus"), F.col("matched").isNotNull().alias("connected"))


def resolve_by_doi(wanted: DataFrame, works: DataFrame) -> DataFrame:
    """Works of the wanted DOIs: every key that shares a DOI gets the record, misses are absent."""
    asked = wanted.select("cite_key", text.normalize_doi(F.col("doi")).alias("_doi")).where(F.col("_doi") != "")
    have = works.select(text.normalize_doi(F.col("doi")).alias("_doi"), *[c for c in works.columns if c != "cite_key"])
    return asked.join(have.dropDuplicates(["_doi"]), "_doi").drop("_doi")


def scites(papers: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Adds ``scites`` from an optional table; null for all that it hasn't."""
    if counts is None:
        return papers.withColumn("scites", F.lit(None).cast("int"))
    return papers.join(counts.select("arxiv_id", "scites"), "arxiv_id", "left")


def category_name(code: Column, names: dict[str, str]) -> Column:
    """A category's name, or its code."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, code), code)


def first_seen(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the first in the given order."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
