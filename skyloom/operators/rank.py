"""Blending of signals that may be missing, and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A signal at this many scites, or corpus citations, is full.
FULL_SCITES, FULL_CITATIONS = 20, 10


def blend(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the signals that are present; one that is null, or weighs nothing, leaves both sides; 0 if none is left."""
    over, under = F.lit(0.0), F.lit(0.0)
    for name, signal in signals.items():
        w = float(weights.get(name, 0.0))
        if w > 0:
            over = over + F.when(signal.isNotNull(), signal.cast("double") * w).otherwise(0.0)
            under = under + F.when(signal.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.coalesce(F.try_divide(over, under), F.lit(0.0))


def saturated(count: Column, full: int) -> Column:
    """A count as a share of what is full, 1 at most; null stays null."""
    return F.when(count.isNotNull(), F.least(count / F.lit(float(full)), F.lit(1.0)))


def importance(papers: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds ``importance`` from relevance, centrality and scites."""
    signals = {"llm": F.col("relevance_score"), "centrality": F.col("centrality"), "scites": saturated(F.col("scites"), FULL_SCITES)}
    return papers.withColumn("importance", blend(signals, weights))


def centrality(matches: Column) -> Column:
    """Aggregate-free: how much of the corpus a list of matched keys cites."""
    return F.least(F.size(matches) / F.lit(float(FULL_CITATIONS)), F.lit(1.0))


def top_ranked(papers: DataFrame, n: int) -> DataFrame:
    """The most important papers that weren't briefed yet; unknown importance last, then by key."""
    return papers.where(F.col("briefed_on").isNull()).orderBy(F.desc_nulls_last("importance"), "cite_key").limit(n)


def also_evaluated(papers: DataFrame, shown: DataFrame) -> DataFrame:
    """Unbriefed papers that aren't shown: relevant first, then by importance and key."""
    rest = papers.where(F.col("briefed_on").isNull()).join(shown.select("cite_key").distinct(), "cite_key", "left_anti")
    return rest.orderBy(F.desc_nulls_last("relevant"), F.desc_nulls_last("importance"), "cite_key")


def relevance(papers: DataFrame, topics: list[str]) -> DataFrame:
    """Records every verdict, keeps only topics that were asked for, and moves the relevant ones on."""
    asked = F.array(*map(F.lit, topics)) if topics else F.array().cast("array<string>")
    return papers.withColumns({"topics": F.filter("matched", lambda t: F.array_contains(asked, t)), "status": F.when(F.col("relevant"), "filtered").otherwise(F.col("status"))})


def verdict(c: Column, allowed: tuple[str, ...] = ("read", "skim", "skip"), otherwise: str = "skim") -> Column:
    """A closed set of words; anything else is ``otherwise``."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*allowed), word).otherwise(otherwise)
