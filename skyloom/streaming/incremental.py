"""The nightly behaviour as Structured Streaming: late data, idempotent stages, windows, and keyed state with an end.

Runs use ``availableNow``: each night reads what is new, and the checkpoint remembers how far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, ts: str = "ts") -> DataFrame:
    """A stream of Parquet files; a timestamp without zone is read as one in the session's zone, since watermarks need it."""
    return spark.readStream.schema(schema).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def first_within(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: overlapping lookbacks bring a row more than once."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handles all that is there, batch by batch, and ends."""
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_available(stream: DataFrame, checkpoint: str, path: str) -> None:
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def replace_days(path: str, date: str) -> Callable[[DataFrame, int], None]:
    """A sink that replaces the dates of a batch, so a batch that is run again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date).parquet(path)

    return write


def tumbling(rows: DataFrame, ts: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows; works on streams and tables."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, keys: list[str]) -> DataFrame:
    """Rows of a key that are less than ``gap`` apart as one session."""
    counted = rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def last_wanted(stream: DataFrame, key: str, ts: str, keep_ms: int, late: str) -> DataFrame:
    """Keyed state with an end: ``key, uses, expired``; a key that isn't seen for ``keep_ms`` is reported and forgotten."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (uses,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "uses": [uses], "expired": [True]})
            return
        uses, newest = (state.get[0] if state.exists else 0), 0
        for rows in batches:
            uses += len(rows)
            newest = max(newest, int(rows[ts].max().timestamp() * 1000))
        state.update((uses,))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + keep_ms)
        yield pd.DataFrame({key: [k[0]], "uses": [uses], "expired": [False]})

    kind = stream.schema[key].dataType.simpleString()
    marked = stream.withWatermark(ts, late).groupBy(key)
    return marked.applyInPandasWithState(step, f"{key} {kind}, uses long, expired boolean", "uses long", "update", GroupStateTimeout.EventTimeTimeout)


def client_meter(stream: DataFrame, cap: int, key: str = "client", want: str = "want") -> DataFrame:
    """A running budget of each client: ``client, asked, granted, used``; a negative request refunds, never below 0."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        asked = granted = 0
        for rows in batches:
            for w in rows[want].tolist():
                grant = w if w < 0 else max(0, min(w, cap - used))
                used = max(0, used + grant)
                asked, granted = asked + w, granted + grant
        state.update((used,))
        yield pd.DataFrame({key: [k[0]], "asked": [asked], "granted": [granted], "used": [used]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, asked long, granted long, used long", "used long", "update", GroupStateTimeout.NoTimeout)
