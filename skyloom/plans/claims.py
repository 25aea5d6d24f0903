"""Saved query setups: versioned JSON in, sanitised rows out, and the table that keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import archive, store
from ..sources.feeds import CLAIM_SCHEMA

VERSION, WORKING = 1, "working"


def _within(c: Column, lo: float, hi: float, otherwise: float, whole: bool = False) -> Column:
    value = F.coalesce(F.when(~F.isnan(c.cast("double")), c.cast("double")), F.lit(float(otherwise)))
    clamped = F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), value))
    return F.floor(clamped + 0.5).cast("int") if whole else clamped


def sanitize(raw: Column, name: str = "untitled") -> Column:
    """A claim with a default for every field that is missing or unusable; null if it is no JSON object or of a later version."""
    c = F.from_json(raw, CLAIM_SCHEMA)
    rows = F.coalesce(c.touchstones, F.array().cast("array<struct<text: string, weight: string, preset: string>>"))
    touchstones = F.filter(F.transform(rows, lambda t: F.struct(F.trim(F.coalesce(t.text, F.lit(""))).alias("text"), F.coalesce(t.weight.try_cast("double"), F.lit(1.0)).alias("weight"), t.preset.alias("preset"))), lambda t: t.text != "")
    dois = F.coalesce(c.cores, F.array().cast("array<struct<doi: string, weight: string>>"))
    cores = F.filter(F.transform(dois, lambda d: F.struct(text.normalize_doi(d.doi).alias("doi"), F.coalesce(d.weight.try_cast("double"), F.lit(1.0)).alias("weight"))), lambda d: d.doi != "")
    s = c["select"]
    select = F.struct(
        _within(s.min_z, 0, 4, 2.0).alias("min_z"), _within(s.min_items, 0, 50, 3, True).alias("min_items"), _within(s.soft_z, 0, 4, 1.5).alias("soft_z"),
        _within(s.long_z, 0, 4, 0.5).alias("long_z"), _within(s.max_items, 1, 50, 8, True).alias("max_items"),
    )
    scout = F.struct(
        text.distinct_list(c.scout.categories).alias("categories"), F.greatest(F.coalesce(c.scout.lookback_days, F.lit(1)), F.lit(1)).alias("lookback_days"),
        F.greatest(F.coalesce(c.scout.max_results, F.lit(200)), F.lit(1)).alias("max_results"),
    )
    label = F.coalesce(F.nullif(F.trim(c["name"]), F.lit("")), F.lit(name))
    whole = F.struct(
        F.lit(VERSION).alias("version"), c.preset.alias("preset"), label.alias("name"), F.coalesce(c.blurb, F.lit("")).alias("blurb"), c.saved.alias("saved"), scout.alias("scout"),
        touchstones.alias("touchstones"), cores.alias("cores"), F.greatest(F.coalesce(c.blend.paydirt_n, F.lit(5)), F.lit(1)).alias("paydirt_n"), select.alias("select"),
    )
    return F.when(F.ltrim(raw).startswith("{") & (F.coalesce(c.claim_version, F.lit(VERSION)) <= VERSION), whole)


def to_json(claim: Column) -> Column:
    """A claim as it is exported: no vectors, no abstracts."""
    return F.to_json(claim, {"ignoreNullFields": "false"})


def save(claims: DataFrame, new: DataFrame) -> DataFrame:
    """Saves claims by slug."""
    return store.upsert(claims, new, ["slug"])


def fork(claims: DataFrame, slug: str, name: str) -> DataFrame:
    """A copy under a new name, its slug made unique, without the preset it came from."""
    copy = claims.where(F.col("slug") == slug).withColumns({"name": F.lit(name), "slug": text.slugify(F.lit(name)), "preset": F.lit(None).cast("string")})
    marked = claims.withColumn("_at", F.lit(0)).unionByName(copy.withColumn("_at", F.lit(1)))
    return archive.unique_slugs(marked, order="_at").drop("_at")


def delete(claims: DataFrame, slug: str) -> DataFrame:
    """Without one claim; the working claim can't be deleted."""
    return claims.where((F.col("slug") != slug) | (F.col("slug") == WORKING))


def listed(claims: DataFrame) -> DataFrame:
    """The working claim first, then by name."""
    return claims.orderBy(F.col("slug") != WORKING, "name", "slug")


def active_preset(rows: DataFrame) -> DataFrame:
    """The one preset that all query rows come from, and whether some were added by hand: ``preset, edited``."""
    one = F.when(F.countDistinct("preset") == 1, F.max("preset"))
    return rows.agg(one.alias("preset"), F.coalesce(F.bool_or(F.col("preset").isNull()), F.lit(False)).alias("edited"))


def cacheable(rows: DataFrame) -> DataFrame:
    """Query rows whose text may be cached: published ones; typed text never is."""
    return rows.where((F.col("kind") != "touchstone") | F.col("preset").isNotNull())
