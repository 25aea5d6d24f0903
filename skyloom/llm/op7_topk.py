"""Exact top-k search by inner product with pivot-table elimination.

The distances of every vector to a fixed number of pivots are computed once and stored with the vectors, in blocks. For a query
they give, over all pivots, the largest lower bound of its distance to a candidate, hence an upper bound of the inner product.
Candidates are evaluated in the order of that bound until the k-th best score lies above all bounds left, so the
result is exact. Candidates stay where they are stored; queries are sent to them in passes of bounded size, and the k best
found so far go on from block to block, so later blocks begin with a high bar. Pivots are taken far apart from
each other from a bounded sample: groups of alike vectors are told apart by them. Nothing is eliminated among vectors that are
all about equally far from each other.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id; shorter vectors
count as padded with zeros; a query meets no row of its own id. Repeated candidate rows each count, ties going to the
smaller id; a repeated query has one answer, and of different vectors with one id as queries the best of all are kept.
An empty table gives an empty one; other columns are not read.
A vector of a scaled squared length of 2^53 or more is no pivot and is scored with whole numbers of any size. What can't be
answered is an error: squared lengths beyond float64, and a score among the best that doesn't fit into a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import write_table

PIVOTS = 48
#: Vectors that pivots are chosen from: the bound of the sample.
SAMPLE = 2000
#: Vectors in a block of candidates, and bytes of queries in a pass over the candidates.
CANDIDATES, PASS_BYTES = 8192, 64 << 20
#: Candidates whose scores are computed between two looks at the stopping rule.
STEP = 512
#: Squared length from which the products of a float matrix could be inexact.
EXACT = float(1 << 53)
#: Stands for all scores below a long until they are known to be among the best.
LOWEST = -(1 << 63)


def _vectors(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    lists = batch.column(name)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()].astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0))


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different vectors of the sample, each the farthest from those before it."""
    chosen: list[int] = []
    near = np.full(len(sample), np.inf)
    while len(chosen) < count and len(sample) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
        near[chosen] = 0
    return sample[chosen]


def search(
    query: np.ndarray, to_query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, to_pivots: np.ndarray, k: int, best: list[tuple[int, int]] | None = None
) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of one query among a block and those found before, and how many candidates were evaluated.

    ``to_pivots`` has a row for each pivot, in float32.
    """
    best, seen, length = list(best or []), 0, float(query @ query)
    if len(to_pivots):
        near = np.abs(to_pivots - to_query.astype(np.float32)[:, None]).max(axis=0).astype(np.float64)
        near -= 1e-6 * (1 + float(to_query.max()) + float(to_pivots.max(initial=0)))  # float32 of either distance
        np.maximum(near, 0, out=near)
        upper = (length + norms - near * near) / 2 + 1e-9 * (1 + length + norms)
    else:
        upper = np.sqrt(length * norms) * (1 + 1e-9) + 1e-9
    upper[ids == own] = -np.inf
    open_ = np.flatnonzero(upper >= best[-1][0]) if len(best) == k else np.flatnonzero(upper > -np.inf)
    order = open_[np.argsort(-upper[open_], kind="stable")]
    for lo in range(0, len(order), STEP):
        at = order[lo : lo + STEP]
        if len(best) == k and upper[at[0]] < best[-1][0]:
            break
        scores = x[at] @ query
        seen += len(at)
        good = np.flatnonzero(scores >= best[-1][0]) if len(best) == k else np.arange(len(at))
        if len(good):
            best += zip(map(int, scores[good].tolist()), ids[at[good]].tolist(), strict=True)
            best = sorted(best, key=lambda b: (-b[0], b[1]))[:k]
    return best, seen


def search_large(query: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one query by whole numbers, which only candidates within a float's error of the best need."""
    at = np.flatnonzero(ids != own)
    if not len(at):
        return []
    near = x[at] @ query
    error = (len(query) + 4) * 2.0**-51 * np.sqrt((x[at] * x[at]).sum(axis=1)) * np.sqrt(query @ query)
    least = np.sort(near - error)[-min(k, len(at))]
    whole = [int(c) for c in query]
    found = [(sum(int(a) * b for a, b in zip(x[i], whole, strict=True)), int(ids[i])) for i in at[near + error >= least]]
    return sorted(found, key=lambda b: (-b[0], b[1]))[:k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``is_query`` picks, against all rows but the query's own id.

    Components become floor(scale x component); scores are whole inner products.
    """
    spark = vectors.sparkSession
    own = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & own.isNotNull() & F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(own, lambda x: F.lit(float(scale)) * x)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))  # larger ones are whole
    chosen = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"), is_query.alias("asks"))
    square = F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")
    stats = chosen.agg(F.max(F.size("v")), F.max(square)).first()
    width, largest = int(stats[0] or 0), float(stats[1] or 0)
    if largest == float("inf"):
        raise ValueError("a squared length is beyond float64")
    ordinary = chosen.where(square < EXACT) if largest >= EXACT else chosen
    found = ordinary.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # a fixed number of rows
    sample = np.array([[*r.v, *[0.0] * (width - len(r.v))] for r in found]).reshape(len(found), width)
    pivots = far_apart(sample, PIVOTS)
    sent = spark.sparkContext.broadcast(pivots)
    store = np.int32 if largest < 2.0**61 else np.float64  # whole components that fit into 32 bits

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            v = _vectors(batch, "v", width)
            for lo in range(0, len(v), CANDIDATES):
                part = v[lo : lo + CANDIDATES]
                ids = batch.column("vec_id").slice(lo, len(part)).to_numpy()
                far = np.ascontiguousarray(_distances(part, pivots).T.astype(np.float32))
                columns = [pa.array([c.tobytes()], pa.binary()) for c in (ids, part.astype(store), far)]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), *columns], ["n", "ids", "block", "far"])

    def stored(rows: DataFrame, name: str) -> DataFrame:
        return write_table(rows.select("vec_id", "v").mapInArrow(in_blocks, "n long, ids binary, block binary, far binary"), name)

    def loaded(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, np.frombuffer(row["block"], store).astype(np.float64).reshape(len(ids), width), np.frombuffer(row["far"], np.float32).reshape(-1, len(ids))

    def answer(asked):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, to_query = asked.value
            best: list[list] = [[] for _ in names]
            for batch in batches:
                for row in batch.to_pylist():
                    ids, x, far = loaded(row)
                    norms = (x * x).sum(axis=1)
                    small = norms < EXACT
                    all_ids, every, large_ids, large = ids, x, ids[~small], x[~small]
                    if len(large):
                        ids, x, norms, far = ids[small], x[small], norms[small], far[:, small]
                    for i, name in enumerate(names.tolist()):
                        if q[i] @ q[i] >= EXACT:
                            more = best[i] + search_large(q[i], name, all_ids, every, k)
                        else:
                            more, _ = search(q[i], to_query[i], name, ids, x, norms, far, k, best[i])
                            more += search_large(q[i], name, large_ids, large, k)
                        best[i] = more if len(more) <= k and not len(large) else sorted(more, key=lambda b: (-b[0], b[1]))[:k]
            rows = [(name, c, max(s, LOWEST)) for name, own in zip(names.tolist(), best, strict=True) for s, c in own]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

        return run

    held, queries = stored(chosen, "candidates"), stored(chosen.where("asks").dropDuplicates(["vec_id", "v"]), "queries")
    in_pass = max(1, PASS_BYTES // (8 * width + 8 * len(pivots) + 8))
    total = int(queries.agg(F.sum("n")).first()[0] or 0)
    passes = -(-total // in_pass)
    found_in = []
    for p in range(passes):  # a pass holds about ``in_pass`` queries, on the driver as in the tasks
        some = [loaded(r.asDict()) for r in (queries.where(F.pmod(F.xxhash64("ids"), F.lit(passes)) == p).collect() if passes > 1 else queries.collect())]
        if some:
            names, q = np.concatenate([s[0] for s in some]), np.concatenate([s[1] for s in some])
            asked = spark.sparkContext.broadcast((names, q, _distances(q, pivots)))
            found_in.append(write_table(held.select("ids", "block", "far").mapInArrow(answer(asked), "query_id long, vec_id long, score long"), "best"))
            asked.unpersist()
    scored = found_in[0] if found_in else spark.createDataFrame([], "query_id long, vec_id long, score long")
    for more in found_in[1:]:
        scored = scored.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("score") == LOWEST, F.raise_error(F.lit("a score doesn't fit into a long")).cast("long")).otherwise(F.col("score"))
    return best.select("query_id", "rank", "vec_id", (score if largest >= EXACT else F.col("score")).alias("score"))
