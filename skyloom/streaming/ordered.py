"""Keyed state over requests in their own order, whatever order they arrive in.

Requests are held in list state until the watermark has passed them, and are then taken by time and sequence, so results don't depend on
batches, partitions or arrival. What is held is what the watermark's delay covers. Timers, not new rows, end a
client: one that isn't asked for again is forgotten.

Reaching state and timers costs the same for one row as for thousands, so a key of the state is not a client but one of ``BUCKETS`` buckets of clients.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stored import folder
from . import incremental

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FAR = 1 << 62
#: Buckets of clients; a bucket's requests that are due and its clients' states are held by a task at once.
BUCKETS = 256


class InOrder(StatefulProcessor):
    """Holds a bucket's rows (client, at in ms, seq, want) until they are due, and gives each client's to ``take`` in order."""

    #: Schema of the state that ``take`` reads and returns.
    kept = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "client string, at long, seq long, want long")
        self.states = handle.getListState("states", f"client string, {self.kept}")

    def take(self, key: tuple, state: tuple | None, rows: list[tuple], now: int) -> tuple[tuple | None, list[tuple], int]:
        """New state (none: forgotten), rows of the result, and when to look again if nothing comes; ``now`` is the watermark in ms."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = _FAR
        for batch in rows:
            clients = (None if c is None or c != c else c for c in batch.client.tolist())
            came = list(zip(clients, *(batch[c].astype("int64").tolist() for c in ("at", "seq", "want")), strict=True))
            if came:
                self.held.appendList(came)
                due = min(due, *(r[1] for r in came), _FAR)
        if due < _FAR and all(t > due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        states = {r[0]: tuple(r[1:]) for r in self.states.get()} if self.states.exists() else {}
        due, rest = {client: [] for client in states}, []
        for client, *row in self.held.get() if self.held.exists() else ():
            if row[0] <= now:
                due.setdefault(client, []).append(tuple(row))
            else:
                rest.append((client, *row))
        following, out = min((r[1] for r in rest), default=_FAR), []
        for client, own in due.items():
            state, found, again = self.take((client,), states.pop(client, None), sorted(own), now)
            out += found
            following = min(following, again)
            if state is not None:
                states[client] = state
        self.held.put(rest) if rest else self.held.clear()
        self.states.put([(client, *state) for client, state in states.items()]) if states else self.states.clear()
        if following < _FAR:
            self.handle.registerTimer(max(following, now + 1))
        yield self.frame(out)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names)

    def close(self) -> None:
        pass


class Meter(InOrder):
    """A running budget: what is used stays between 0 and ``cap``; a request gets what there is room for, a negative one gives back."""

    kept, names = "used long", ["client", "seq", "want", "granted", "used"]

    def __init__(self, cap: int):
        self.cap = cap

    def take(self, key, state, rows, now):
        used, out = state[0] if state else 0, []
        for _, seq, want in rows:
            before, used = used, max(0, min(used + want, self.cap))
            out.append((key[0], seq, want, want if want < 0 else used - before, used))
        return (used,), out, _FAR


class LastWanted(InOrder):
    """How often a key was asked for until it wasn't for ``keep`` ms; it is then reported and forgotten."""

    kept, names = "uses long, first long, last long", ["client", "uses", "first_ms", "last_ms"]

    def __init__(self, keep: int):
        self.keep = keep

    def take(self, key, state, rows, now):
        out = []
        for at, _, _ in rows:
            if state is not None and at >= state[2] + self.keep:
                out.append((key[0], *state))
                state = None
            state = (1, at, at) if state is None else (state[0] + 1, state[1], at)
        if state is not None and now >= state[2] + self.keep:
            out.append((key[0], *state))
            state = None
        return state, out, _FAR if state is None else state[2] + self.keep


def keyed(stream: DataFrame, processor: InOrder, schema: str, late: str) -> DataFrame:
    """``processor`` over ``stream`` (client, ts, seq, want), a row being late once the watermark, ``late`` behind the newest, has passed it."""
    rows = stream.select("client", "ts", F.unix_millis("ts").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("want").cast("long").alias("want"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("client"), F.lit(BUCKETS)).cast("int"))
    return rows.withWatermark("ts", late).groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def meter(stream: DataFrame, cap: int, late: str = "1 hour") -> DataFrame:
    """Every request with what it was granted: ``client, seq, want, granted, used``."""
    return keyed(stream, Meter(cap), "client string, seq long, want long, granted long, used long", late)


def last_wanted(stream: DataFrame, keep_ms: int, late: str = "1 hour") -> DataFrame:
    """Each stretch of use that has ended: ``client, uses, first_ms, last_ms``."""
    return keyed(stream, LastWanted(keep_ms), "client string, uses long, first_ms long, last_ms long", late)


def nightly(rows: DataFrame, make: Callable[[DataFrame], DataFrame], nights: int = 3, beyond: str = "60 days") -> DataFrame:
    """What ``make`` gives over ``rows`` (client, ts, seq, want) that arrive in ``nights`` runs by time, each started on the checkpoint of the one before.

    A last run brings one row that is ``beyond`` all others, so the watermark passes them; what is then still held is that row.
    """
    spark: SparkSession = rows.sparkSession
    base = f"{folder(spark)}/skyloom/nights-{uuid.uuid4().hex}"
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    edge = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        for night in range(nights + 1):
            if night < nights:
                share = (F.unix_micros("ts") - F.unix_micros(F.lit(edge.lo))) * nights / (F.unix_micros(F.lit(edge.hi)) - F.unix_micros(F.lit(edge.lo)) + 1)
                part = rows.where(F.coalesce(F.floor(share), F.lit(0)) == night)
            else:
                part = spark.range(1).select(F.lit(None).cast("string").alias("client"), (F.lit(edge.hi) + F.expr(f"interval {beyond}")).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("want"))
            part.select("client", "ts", F.col("seq").cast("long"), F.col("want").cast("long")).write.mode("append").parquet(f"{base}/in")
            stream = spark.readStream.schema("client string, ts timestamp, seq long, want long").parquet(f"{base}/in")
            incremental.append_available(make(stream), f"{base}/checkpoint", f"{base}/out")
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{base}/out")
