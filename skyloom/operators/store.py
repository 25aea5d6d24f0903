"""A keyed store as pure functions: current table and change in, new table out.

Parquet has no MERGE, so each write is a full outer or anti join on the key and the caller swaps versions. A patch is applied
by its columns: a column that it has is written even where it is null, a column that it hasn't stays.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a paper, in order.
STATUSES = ("new", "summarized", "filtered", "ranked", "briefed")
#: Columns that a stage may write.
PAPER_COLUMNS = (
    "arxiv_id", "doi", "openalex_id", "title", "authors", "published", "primary_category", "abstract", "summary", "research_question",
    "contribution", "topics", "relevance_score", "relevant", "filter_reason", "scites", "centrality", "cited_in_corpus", "importance", "claim",
    "stakes", "connection", "verdict", "briefed_on", "first_seen", "llm_model", "status",
)


def assert_columns(patch: DataFrame, keys: Sequence[str], allowed: Sequence[str]) -> None:
    unknown = sorted(set(patch.columns) - set(keys) - set(allowed))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")


def each_once(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows; a key that two of them have is an error when they are read, whichever columns are read."""
    counted = rows.withColumn("_times", F.count("*").over(Window.partitionBy(*keys)))
    good = F.when(F.col("_times") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a key comes twice")).cast("boolean"))
    return counted.where(good).drop("_times")


def upsert(current: DataFrame, patch: DataFrame, keys: Sequence[str], allowed: Sequence[str] | None = None) -> DataFrame:
    """Inserts or enriches by key; only the patch's columns are touched. A patch of keys alone inserts what is missing.

    A null is a key like any other. A patch that has a key twice fails when it is run.
    """
    assert_columns(patch, keys, current.columns if allowed is None else allowed)
    mine = current.select(*[F.col(c).alias(f"_c_{c}") for c in current.columns], F.lit(True).alias("_c"))
    news = each_once(patch, keys).select(*[F.col(c).alias(f"_p_{c}") for c in patch.columns], F.lit(True).alias("_p"))
    on = [F.col(f"_c_{k}").eqNullSafe(F.col(f"_p_{k}")) for k in keys]
    both = mine.join(news, on, "full_outer")
    out = []
    for name in dict.fromkeys((*current.columns, *patch.columns)):
        old, new = F.col(f"_c_{name}"), F.col(f"_p_{name}")
        if name in keys:
            value = F.when(F.col("_c"), old).otherwise(new)
        elif name not in patch.columns:
            value = old
        elif name not in current.columns:
            value = new
        else:
            value = F.when(F.col("_p"), new).otherwise(old)
        out.append(value.alias(name))
    return both.select(*out)


def set_status(current: DataFrame, who: DataFrame, status: str, key: str = "cite_key") -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"not a status: {status}")
    return upsert(current, who.select(key).distinct().withColumn("status", F.lit(status)), [key])


def insert_absent(current: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Adds rows whose key isn't there; rows that are there keep their progress. A null is a key like any other.

    Of several new rows of a key the first by ``order`` counts; without an order they are an error.
    """
    news = each_once(new, keys) if order is None else latest(new, keys, order)
    there = current.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
    fresh = news.join(there, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left_anti")
    return current.unionByName(fresh, allowMissingColumns=True)


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the keys in ``new`` go and its rows come."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def clear_children(children: DataFrame, touched: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Like ``replace_children`` for touched keys that may have no new rows."""
    return children.join(touched.select(key).distinct(), key, "left_anti").unionByName(new)


def with_status(papers: DataFrame, status: str) -> DataFrame:
    """The work list of a stage, newest first; unknown dates last."""
    return papers.where(F.col("status") == status).orderBy(F.desc_nulls_last("published"), "cite_key")


def status_counts(papers: DataFrame, column: str = "status") -> DataFrame:
    return papers.groupBy(column).agg(F.count("*").alias("n"))


def old_papers(papers: DataFrame, before: Column, published: str = "published") -> DataFrame:
    """Papers published before a date; an unknown date is never old."""
    return papers.where(F.col(published) < before)


def prune(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows of doomed keys."""
    gone = doomed.select(key).distinct()
    return {name: table.join(gone, key, "left_anti") for name, table in tables.items()}


def prune_counts(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> DataFrame:
    """How many rows of each table ``prune`` takes: ``table_name, n``."""
    gone = doomed.select(key).distinct()
    out = None
    for name, table in tables.items():
        one = table.join(gone, key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def latest_summary(summaries: DataFrame) -> DataFrame:
    """The newest summary of each paper and user; an undated one only if there is no other."""
    return latest(summaries, ["cite_key", "user_id"], [F.desc_nulls_last("created_at"), F.col("llm_model")])


def visible(rows: DataFrame, user: str) -> DataFrame:
    """Shared rows (user '') and the user's own."""
    return rows.where((F.col("user_id") == "") | (F.col("user_id") == user))


def has_children(parents: DataFrame, children: DataFrame, key: str, has: bool = True) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_semi" if has else "left_anti")


def start_run(runs: DataFrame, started: str, topics: str) -> tuple[DataFrame, int]:
    """Appends a run; its id is one above the largest."""
    run_id = int(runs.agg(F.max("run_id")).first()[0] or 0) + 1
    row = runs.sparkSession.range(1).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(started).alias("started"), F.lit(topics).alias("topics"))
    return runs.unionByName(row, allowMissingColumns=True), run_id


def finish_run(runs: DataFrame, run_id: int, **counters: int) -> DataFrame:
    allowed = {"n_scraped", "n_relevant", "n_briefed"}
    if set(counters) - allowed:
        raise ValueError(f"unknown counters: {sorted(set(counters) - allowed)}")
    mine = F.col("run_id") == run_id
    return runs.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in counters.items()})


# vector cache


def first_vectors(rows: DataFrame, order: str, keys: Sequence[str] = ("text_sha", "model", "dim")) -> DataFrame:
    """Cache rows in write order: the first vector of a key stands, ``seen_at`` moves with each write."""
    rest = [c for c in rows.columns if c not in (*keys, order, "seen_at")]
    firsts = [F.min_by(c, order).alias(c) for c in rest]
    return rows.groupBy(*keys).agg(*firsts, F.max_by("seen_at", order).alias("seen_at"))


def cache_write(cache: DataFrame, new: DataFrame, keys: Sequence[str] = ("text_sha", "model", "dim")) -> DataFrame:
    """Adds checked vectors; a key that is there keeps its vector and takes the new ``seen_at``."""
    right = F.size("vector") == F.col("dim")
    checked = new.where(F.when(right, F.lit(True)).otherwise(F.raise_error(F.lit("a vector's length isn't its dim")).cast("boolean")))
    return first_vectors(cache.withColumn("_seq", F.lit(0)).unionByName(checked.withColumn("_seq", F.lit(1))), "_seq", keys)


def cache_lookup(wanted: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """Wanted keys, once each, with their vector or null."""
    own = cache.where((F.col("model") == model) & (F.col("dim") == dim)).select("text_sha", "vector")
    return wanted.select("text_sha").distinct().join(own, "text_sha", "left")


def cache_touch(cache: DataFrame, hits: DataFrame, day: Column) -> DataFrame:
    """Moves ``seen_at`` of the hit keys, so that what is still wanted isn't pruned."""
    marked = hits.select("text_sha").distinct().withColumn("_hit", F.lit(True))
    out = cache.join(marked, "text_sha", "left").withColumn("seen_at", F.when(F.col("_hit"), day).otherwise(F.col("seen_at")))
    return out.select(*cache.columns)


def cache_prune(cache: DataFrame, before: Column, seen: str = "seen_at", undated_stay: bool = True) -> DataFrame:
    """Drops entries last wanted before a date."""
    fresh = F.col(seen) >= before
    return cache.where(F.coalesce(fresh, F.lit(undated_stay)))


def valid_vector_writes(rows: DataFrame, most: int = 600) -> DataFrame:
    """Rows of a write request with ``error``: a bad key, a wrong number of floats, a bad dim; more than ``most`` rows raise."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vectors in one write")
    error = (
        F.when(~F.regexp_like("text_sha", F.lit("^[0-9a-f]{64}$")) | F.col("text_sha").isNull(), "bad key")
        .when(F.col("vector").isNull() | (F.size("vector") != F.col("dim")), "wrong length")
        .when(F.exists("vector", lambda x: x.isNull() | F.isnan(x)), "not a number")
    )
    return rows.withColumn("error", error)
