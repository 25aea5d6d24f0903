"""Rolling window features from minute panes.

Rows are added up by source, pane (a minute) and length first, so a pane is one row however many rows it holds: their number, the
sum of their lengths, their set of languages and a sorted histogram of lengths. A pane goes to the stretch of time that it lies in and
to the next one if a window there reaches back to it; a stretch is as long as the longest window. So a source, however much of
the table it has, is many groups, each of at most two stretches of panes. Within a group the panes' histograms are
added up along time and along lengths, and a rank is the first length at which the difference of two such sums reaches it.

The window of a row at time t holds the rows of its source at times from t - W up to, without, t. Times are taken down to their pane,
and each W must be a whole number of panes. A null source is a source of its own. A row without a time gets its rows, with empty
windows, and is in no window. Null lengths count as rows, not as lengths. Repeated rows count, and are returned, each;
an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of counts (panes times lengths) that a task holds at a time.
CELLS = 1 << 20


def panes(rows: DataFrame) -> DataFrame:
    """One row for each source and pane of ``rows`` (source, pane, length, lang): a pane's count, sum, languages and histogram."""
    by_length = rows.where("pane is not null").groupBy("source", "pane", "length").agg(F.count("*").alias("n"), F.collect_set("lang").alias("langs"))
    bar = F.when(F.col("length").isNotNull(), F.struct("length", "n"))
    found = by_length.groupBy("source", "pane").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0)).alias("total"), F.array_distinct(F.flatten(F.collect_list("langs"))).alias("langs"), F.array_sort(F.collect_list(bar)).alias("bars")
    )
    return found.select("source", "pane", "n", "total", "langs", F.col("bars.length").alias("lengths"), F.col("bars.n").alias("counts"))


def _ranked(at: np.ndarray, lengths: np.ndarray, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The length of each rank (-1: none) in each window, the panes ``lo`` to ``hi`` of a histogram with entries (at, length, count)."""
    values, where = np.unique(lengths, return_inverse=True)
    found, below = np.full(ranks.shape, -1, np.int64), np.zeros(len(lo), np.int64)
    n_panes = int(hi.max(initial=0)) + 1
    step = max(1, CELLS // n_panes)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(0, len(values) + step, step))
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        sums = np.zeros((n_panes + 1, min(step, len(values) - k * step)), np.int64)
        own = order[a:b]
        np.add.at(sums, (at[own] + 1, where[own] - k * step), counts[own])
        sums = sums.cumsum(axis=0).cumsum(axis=1)
        inside = sums[hi] - sums[lo] + below[:, None]
        for r in range(ranks.shape[1]):
            here = (found[:, r] < 0) & (ranks[:, r] > 0) & (inside[:, -1] >= ranks[:, r])
            found[here, r] = values[k * step + (inside[here] < ranks[here, r, None]).sum(axis=1)]
        below = inside[:, -1]
    return found


def _kinds(at: np.ndarray, names: list[str], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Distinct names in each window, the panes ``lo`` to ``hi``; ``at`` are the names' panes, in order."""
    last: dict[str, int] = {}
    before = np.empty(len(at), np.int64)
    for i, (pane, name) in enumerate(zip(at.tolist(), names, strict=True)):
        before[i] = last.get(name, -1)
        last[name] = pane
    edges = zip(np.searchsorted(at, lo).tolist(), np.searchsorted(at, hi).tolist(), lo.tolist(), strict=True)
    return np.array([np.count_nonzero(before[a:b] < first) for a, b, first in edges], np.int64)


def _features(table: pa.Table, windows: list[int], percents: list[int]) -> Iterator[pa.RecordBatch]:
    """Features of the panes of a group that ask; ``windows`` in panes. Panes are in order of time."""
    columns = table.combine_chunks().to_batches()[0]
    pane, asks = columns.column("pane").to_numpy(), columns.column("asks").to_numpy(zero_copy_only=False)
    hi = np.flatnonzero(asks)
    if not hi.size:
        return
    n, total = (np.concatenate(([0], np.cumsum(columns.column(c).to_numpy()))) for c in ("n", "total"))
    flat = lambda name: columns.column(name).flatten()
    owner = lambda name: np.repeat(np.arange(len(pane)), np.diff(columns.column(name).offsets.to_numpy()))
    at, lengths, counts = owner("lengths"), flat("lengths").to_numpy(), flat("counts").to_numpy()
    m = np.zeros(len(pane) + 1, np.int64)
    np.add.at(m, at + 1, counts)
    m = np.cumsum(m)
    out, names = [columns.column("source").take(pa.array(hi)), pa.array(pane[hi])], ["source", "pane"]
    for k, w in enumerate(windows):
        lo = np.searchsorted(pane, pane[hi] - w)
        inside = m[hi] - m[lo]
        found = _ranked(at, lengths, counts, lo, hi, np.stack([-(-p * inside // 100) for p in percents], axis=1))
        own = [n[hi] - n[lo], total[hi] - total[lo], _kinds(owner("langs"), flat("langs").to_pylist(), lo, hi)]
        out += [*map(pa.array, own), *(pa.array(found[:, r], mask=found[:, r] < 0) for r in range(len(percents)))]
        names += [f"{name}_{k}" for name in ("n", "total", "langs", *(f"p{p}" for p in percents))]
    yield pa.RecordBatch.from_arrays(out, names)


def _merge(windows: list[int], percents: list[int]):
    """Goes through partitions sorted by source, stretch and pane; one group, of at most two stretches, is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            lo = 0
            for i, key in enumerate(zip(batch.column("source").to_pylist(), batch.column("stretch").to_pylist(), strict=True)):
                if key != last and (held or i > lo):
                    yield from _features(pa.Table.from_batches([*held, batch.slice(lo, i - lo)]), windows, percents)
                    held, lo = [], i
                last = key
            held.append(batch.slice(lo))
        if held:
            yield from _features(pa.Table.from_batches(held), windows, percents)

    return run


def window_features(
    rows: DataFrame, time: Column, source: Column, length: Column, lang: Column, windows: list[int], percents: dict[str, int], pane: int = 60, id_col: str = "doc_id"
) -> DataFrame:
    """A row for each row of ``rows`` and each of ``windows`` (seconds): its id, ``window_s``, ``event_s``, ``n_events``, ``sum_chars``,
    ``n_langs``, and for each of ``percents`` (name: p) the length number ceil(p * m / 100) of the window's m lengths.

    ``time`` is in whole seconds; ``source`` and ``lang`` are compared as text.
    """
    if not windows or any(w <= 0 or w % pane for w in windows):
        raise ValueError("every window must be a whole number of panes")
    asked, spans = [w // pane for w in windows], sorted(set(percents.values()))
    reach = max(asked)
    keys = [source.cast("string").alias("source"), F.floor(time / F.lit(pane)).cast("long").alias("pane")]
    found = panes(rows.select(*keys, length.cast("long").alias("length"), lang.cast("string").alias("lang")))
    # a pane asks in its own stretch, and is seen in the next one
    own = F.floor(F.col("pane") / F.lit(reach)).cast("long")
    dealt = found.withColumn("stretch", F.explode(F.array(own, own + 1))).withColumn("asks", F.col("stretch") == own)
    names = ["n", "total", "langs", *(f"p{p}" for p in spans)]
    kinds = ", ".join(f"{name}_{k} long" for k in range(len(asked)) for name in names)
    merged = dealt.repartition("source", "stretch").sortWithinPartitions("source", "stretch", "pane").mapInArrow(_merge(asked, spans), f"source string, pane long, {kinds}")
    of = {"n_events": "n", "sum_chars": "total", "n_langs": "langs"} | {name: f"p{p}" for name, p in percents.items()}
    each = [F.struct(F.lit(w).cast("long").alias("window_s"), *(F.col(f"{c}_{k}").alias(name) for name, c in of.items())) for k, w in enumerate(windows)]
    none = [F.struct(F.lit(w).cast("long").alias("window_s"), *(F.lit(None if name in percents else 0).cast("long").alias(name) for name in of)) for w in windows]
    features = merged.select(F.col("source").alias("_source"), F.col("pane").alias("_pane"), F.array(*each).alias("features"))
    asking = rows.select(F.col(id_col).alias("doc_id"), *keys)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("pane") == F.col("_pane"))
    # the same plan at every size, and a pane that many rows share is split by Spark
    joined = asking.join(features.hint("merge"), same, "left")
    out = joined.select("doc_id", (F.col("pane") * pane).alias("event_s"), F.explode(F.coalesce("features", F.array(*none))).alias("at"))
    return out.select("doc_id", "at.window_s", "event_s", *(F.col("at")[name].alias(name) for name in of))
