"""Calendar functions of the nightly run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday_cutoff(day: Column, lookback: Column | int) -> Column:
    """The date ``lookback`` weekdays (at least one) before ``day``."""
    n = F.greatest(F.lit(lookback) if isinstance(lookback, int) else lookback, F.lit(1))
    past = F.reverse(F.sequence(F.date_sub(day, 2 * n + 5), F.date_sub(day, 1)))
    return F.get(F.filter(past, lambda d: F.weekday(d) < 5), n - 1)


def retention_cutoff(day: Column, days: int) -> Column:
    return F.date_sub(day, days)


def build_date(last_build: Column, published: Column) -> Column:
    """The UTC date on which a feed was built, from its RFC 822 dates; null if it doesn't say."""
    raw = F.trim(F.coalesce(F.nullif(F.trim(last_build), F.lit("")), published))
    zone = F.replace(F.replace(raw, F.lit("GMT"), F.lit("+0000")), F.lit("UTC"), F.lit("+0000"))
    when = F.try_to_timestamp(F.regexp_replace(zone, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.to_date(F.to_utc_timestamp(when, F.current_timezone()))


def snapshot_age(synced: Column, today: Column) -> Column:
    return F.datediff(today, synced)


def staleness(synced: Column, today: Column, most: int = 30) -> Column:
    """A warning for a missing or old snapshot, else null."""
    age = snapshot_age(synced, today)
    return F.when(synced.isNull(), "the corpus was never synced").when(age > most, F.concat(F.lit("the corpus is "), age.cast("string"), F.lit(" days old")))
