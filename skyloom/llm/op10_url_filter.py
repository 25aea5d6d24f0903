"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests.

Each distinct (host, path) is expanded into the suffixes of its host, at dots, that have as many labels as some rule's host, with
the prefixes of its path whose length some rule has. Expressions meet the rules on the first bits of their SHA-256; full digests confirm, and the longest rule
wins (then the longer host, then block before allow). Verdicts go back to all urls of that (host, path), those of a
frequent one in many tasks; urls without a host are never joined.

A null url, or one without ``://``, has an empty host and path and fits no rule. Urls that no rule fits are allowed.
Repeated rows and null ids stay; an empty table of urls gives an empty one and an empty table of rules allows all; other
columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import spread_join

#: Hexadecimal digits of the digest on which urls and rules are joined.
SHORT = 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without a url or a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``rules``: host, path, verdict. One row per url: ``page_id, host, path, rule, verdict``."""
    keyed = rules.select(F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), "path", F.col("verdict").alias("says"))
    sizes = [r[0] for r in keyed.select(F.length("path")).distinct().collect()]  # as many as a path has characters at most
    depths = [r[0] for r in rules.select(F.size(F.split("host", "\\."))).distinct().collect()]  # as many as a host has labels at most
    digest = F.sha2("rule", 256)
    keyed = keyed.select("rule", "host_size", "says", digest.alias("digest"), F.left(digest, F.lit(SHORT)).alias("short"))

    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.")
    cut = [F.when(F.size(labels) >= d, F.array_join(F.slice(labels, F.size(labels) - (d - 1), F.lit(d)), ".")) for d in depths]
    suffixes = F.filter(F.array(*cut or [F.lit(None).cast("string")]), lambda h: h.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in sizes] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    own = F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))
    expressions = urls.where("host != ''").select("host", "path").distinct().select("host", "path", own.alias("own"))
    expressions = expressions.withColumn("own", F.sha2("own", 256))
    found = expressions.withColumn("short", F.left("own", F.lit(SHORT))).join(keyed, "short").where("own = digest")
    best = F.max(F.struct(F.length("rule").alias("n"), "host_size", (F.col("says") == "block").alias("blocks"), "rule", "says"))
    ruled = found.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.says")
    named = urls.where("host != ''").withColumn("key", F.struct("host", "path"))
    met = spread_join(named, F.xxhash64("page_id"), ruled.select(F.struct("host", "path").alias("key"), "rule", "says"), "key", "left")
    bare = urls.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "says": F.lit(None).cast("string")})
    every = met.select("page_id", "host", "path", "rule", "says").unionByName(bare)
    return every.select("page_id", "host", "path", "rule", F.coalesce("says", F.lit(default)).alias("verdict"))
