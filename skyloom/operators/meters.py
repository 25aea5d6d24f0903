"""Running budgets in many tasks.

A request moves what is used from x to min(max(x + want, 0), cap). Such steps compose: a run of them moves x to min(max(x + a, lo), hi), whatever x is, so
a client's requests are cut into stretches of time, each stretch is folded to its three numbers where it lies, a prefix over the few stretches gives each its start,
and each is then gone through once more. Grants that are all or nothing (``archive.hourly``) don't compose: whether a request is refused depends on x itself, so
a stretch has as many outcomes as starts; neither do two caps at once (``archive.spend``), since a grant then depends on all clients' requests before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantile import with_group
from .stored import stored


def metered(requests: DataFrame, cap: int, parts: int | None = None) -> DataFrame:
    """Every request of ``requests`` (client, at, seq, want), by time and sequence: ``client, seq, want, granted, used``.

    A request gets what there is room for, a negative one gives back, never below 0. A null client is a client; nulls elsewhere are 0.
    """
    kind = requests.schema["client"].dataType.simpleString()
    rows = requests.select("client", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("at", "seq", "want")))
    order = ["client", "at", "seq", "want"]
    ranged = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    table = stored(ranged.withColumn("part", F.spark_partition_id()), "requests")

    together = lambda df: df.repartition("client", "part").sortWithinPartitions("client", "part", *order[1:])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, lo, hi, client = None, 0, 0, cap, pa.null()
        for batch in batches:
            out, client = [], batch.schema.field("client").type
            for *key, want in zip(*(batch.column(c).to_pylist() for c in ("client", "part", "want")), strict=True):
                if key != now:
                    out += [] if now is None else [(*now, a, lo, hi)]
                    now, a, lo, hi = key, 0, 0, cap
                a, lo, hi = a + want, max(0, min(lo + want, cap)), max(0, min(hi + want, cap))
            yield stretches(out, client)
        if now is not None:
            yield stretches([(*now, a, lo, hi)], client)

    def stretches(rows: list[tuple], client: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [client, pa.int32(), *[pa.int64()] * 3], strict=True)], ["client", "part", "a", "lo", "hi"])

    folded = together(table).mapInArrow(fold, f"client {kind}, part int, a long, lo long, hi long")
    before = Window.partitionBy("client").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    steps = F.collect_list(F.struct("a", "lo", "hi")).over(before)
    start = F.aggregate(steps, F.lit(0).cast("long"), lambda x, s: F.least(F.greatest(x + s.a, s.lo), s.hi))
    starts = folded.select("client", "part", start.alias("start"))

    def grant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, 0
        for batch in batches:
            granted, after = [], []
            for *key, want, start in zip(*(batch.column(c).to_pylist() for c in ("client", "part", "want", "start")), strict=True):
                if key != now:
                    now, used = key, start
                had, used = used, max(0, min(used + want, cap))
                granted.append(want if want < 0 else used - had)
                after.append(used)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("client", "seq", "want")), pa.array(granted, pa.int64()), pa.array(after, pa.int64())], ["client", "seq", "want", "granted", "used"])

    placed = with_group(table, starts, ["client", "part"])
    return together(placed).mapInArrow(grant, f"client {kind}, seq long, want long, granted long, used long")
