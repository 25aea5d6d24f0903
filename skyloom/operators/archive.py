"""The archive of shipped items, feed manifests, and the budget meter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entry(items: DataFrame) -> DataFrame:
    """Items as the archive keeps them: flat, without the abstract, grade to 3 and z to 1 places."""
    text = lambda c: F.coalesce(c, F.lit(""))
    said = [text(F.col("enrichment")[c]).alias(c) for c in ("verdict", "kind", "headline", "so_what", "caveat")]
    return items.select(
        F.col("arxiv_id").alias("id"), F.coalesce(F.nullif("title", F.lit("")), F.col("arxiv_id")).alias("title"), "link", text("authors").alias("authors"),
        F.round("grade", 3).alias("grade"), F.round("z", 1).alias("z"), F.coalesce("band", F.lit("longshot")).alias("band"),
        text(F.col("matched")["label"]).alias("matched"), *said,
    )


def merge_days(archive: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """A day that is built again replaces that day; all other days keep their items."""
    return archive.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_days(new: DataFrame, path: str, date: str = "date") -> None:
    """The same on a table that is partitioned by month and date: only the written dates are replaced."""
    by_month = new.withColumn("month", F.date_format(date, "yyyy-MM"))
    by_month.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", date).parquet(path)


def index(items: DataFrame) -> DataFrame:
    """Items and pay dirt of each month, date and feed, newest first."""
    counts = items.groupBy(F.date_format("date", "yyyy-MM").alias("month"), "date", "slug").agg(F.count("*").alias("items"), F.count_if(F.col("band") == "paydirt").alias("paydirt"))
    return counts.orderBy(F.desc("month"), F.desc("date"), "slug")


def manifest(presets: DataFrame, today: DataFrame, prior: DataFrame) -> DataFrame:
    """Feeds of the presets that exist: today's entry, else the last one; removed presets go."""
    now = today.select("slug", *[F.col(c).alias(f"_t_{c}") for c in ("items", "paydirt", "updated")])
    was = prior.select("slug", *[F.col(c).alias(f"_p_{c}") for c in ("items", "paydirt", "updated")])
    both = presets.select("slug", "name").join(now, "slug", "left").join(was, "slug", "left")
    built = F.col("_t_updated").isNotNull()
    pick = lambda c: F.when(built, F.col(f"_t_{c}")).otherwise(F.col(f"_p_{c}")).alias(c)
    return both.select("slug", "name", pick("items"), pick("paydirt"), pick("updated"))


def menu_note(items: F.Column, paydirt: F.Column) -> F.Column:
    """What a feed's menu entry says."""
    n = F.concat(items.cast("string"), F.lit(" today"))
    some = F.when(paydirt > 0, F.concat(n, F.lit(", "), paydirt.cast("string"), F.lit(" pay dirt"))).otherwise(n)
    return F.when(items.isNull(), "builds tonight").when(items == 0, "nothing today").otherwise(some)


def menu(presets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every preset with its feed's counts and note: ``slug, name, items, paydirt, note``; one that was never built is pending."""
    built = manifest.select("slug", "items", "paydirt").dropDuplicates(["slug"])
    return presets.select("slug", "name").join(built, "slug", "left").withColumn("note", menu_note(F.col("items"), F.col("paydirt")))


def drift(directory: DataFrame, listed: DataFrame, key: str = "slug") -> DataFrame:
    """Slugs that only the directory or only the manifest has: ``slug, only_in``."""
    here = directory.select(key).distinct().join(listed.select(key), key, "left_anti").withColumn("only_in", F.lit("directory"))
    return here.unionByName(listed.select(key).distinct().join(directory.select(key), key, "left_anti").withColumn("only_in", F.lit("manifest")))


def jaccard(items: DataFrame, slug: str = "slug", key: str = "id") -> DataFrame:
    """Overlap of the shipped ids of each two feeds that share one."""
    own = items.select(slug, key).distinct()
    sizes = own.groupBy(slug).agg(F.count("*").alias("n"))
    a, b = own.select(F.col(slug).alias("a"), key), own.select(F.col(slug).alias("b"), key)
    both = a.join(b, key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    named = both.join(sizes.select(F.col(slug).alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col(slug).alias("b"), F.col("n").alias("n_b")), "b")
    return named.select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def spend(requests: DataFrame, client_cap: int, global_cap: int) -> DataFrame:
    """Grants of a day's requests in order: ``day, seq, client, want, granted, client_calls, global_calls``.

    A request gets what it wants, as far as the client's and the day's headroom go; a negative one refunds, never below 0.
    A day is decided by one task, in order, since each grant depends on all before it; the task holds what clients have used, not their requests.
    """

    def grants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        today, calls, every = None, {}, 0
        for batch in batches:
            out = []
            for day, client, want in zip(*(batch.column(c).to_pylist() for c in ("day", "client", "want")), strict=True):
                if day != today:
                    today, calls, every = day, {}, 0
                mine = calls.pop(client, 0)
                grant = want if want < 0 else max(0, min(want, global_cap - every, client_cap - mine))
                mine, every = max(0, mine + grant), max(0, every + grant)
                if mine:
                    calls[client] = mine
                out.append((grant, mine, every))
            made = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("day", "seq", "client", "want")), *made], ["day", "seq", "client", "want", "granted", "client_calls", "global_calls"])

    kind = requests.schema["day"].dataType.simpleString()
    rows = requests.select("day", F.col("seq").cast("long"), F.col("client").cast("string"), F.col("want").cast("long"))
    ordered = rows.repartition("day").sortWithinPartitions("day", F.asc_nulls_last("seq"))
    return ordered.mapInArrow(grants, f"day {kind}, seq long, client string, want long, granted long, client_calls long, global_calls long")


def hourly(requests: DataFrame, cap: int, seconds: int = 3600) -> DataFrame:
    """Grants of a per-client meter whose window opens with the first request after the last one ended."""

    def grants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, used = (), None, 0
        for batch in batches:
            out = []
            for client, at, want in zip(*(batch.column(c).to_pylist() for c in ("client", "at", "want")), strict=True):
                if now != (client,) or (opened is not None and at is not None and at >= opened + seconds):
                    now, opened, used = (client,), at, 0
                ok = want is not None and used + want <= cap
                used += want if ok else 0
                out.append((ok, used))
            made = list(zip(*out, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("client", "seq", "at", "want")), pa.array(made[0], pa.bool_()), pa.array(made[1], pa.int64())], ["client", "seq", "at", "want", "allowed", "used"])

    rows = requests.select(F.col("client").cast("string"), F.col("seq").cast("long"), F.col("at").cast("long"), F.col("want").cast("long"))
    ordered = rows.repartition("client").sortWithinPartitions("client", F.asc_nulls_last("at"), F.asc_nulls_last("seq"))
    return ordered.mapInArrow(grants, "client string, seq long, at long, want long, allowed boolean, used long")


def prune_enrichment(cache: DataFrame, today: F.Column, days: int = 30) -> DataFrame:
    """Entries seen within the last days; undated ones go."""
    return cache.where(F.coalesce(F.col("seen") >= F.date_sub(today, days), F.lit(False)))


def prune_names(names: DataFrame, budget: DataFrame, today: F.Column) -> tuple[DataFrame, DataFrame]:
    """Names seen within 60 days, and meters of the last 7."""
    return names.where(F.col("seen") >= F.date_sub(today, 60)), budget.where(F.col("day") >= F.date_sub(today, 7))


def haul_breakdown(stones: DataFrame, cached: DataFrame, key: str = "text_sha") -> DataFrame:
    """How many of a haul are new, cross-listed or earlier, and how many vectors were cached."""
    have = cached.select(key).distinct().withColumn("_have", F.lit(True))
    kinds = [F.count_if(F.col("announce") == k).alias(k) for k in ("new", "cross", "earlier")]
    return stones.join(have, key, "left").agg(*kinds, F.count_if(F.col("_have")).alias("cached"), F.count("*").alias("total"))


def unique_slugs(claims: DataFrame, slug: str = "slug", order: str = "saved") -> DataFrame:
    """Later claims of a slug get ``-2``, ``-3`` and so on."""
    n = F.row_number().over(Window.partitionBy(slug).orderBy(order))
    return claims.withColumn("_n", n).withColumn(slug, F.when(F.col("_n") > 1, F.concat(slug, F.lit("-"), F.col("_n").cast("string"))).otherwise(F.col(slug))).drop("_n")
