"""Coupling of candidates and average-linkage clusters.

Pairs are never rows: blocks of vectors meet as matrices, and what leaves a block is a histogram, a degree or a nearest
neighbour. A haul of at most ``MOST`` members is agglomerated over its matrix in one task, hauls side by side; larger ones
in rounds over all tasks (see ``linkage``). Both are exact, and the work of both grows with the square of the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import linkage
from .numbering import numbered
from .quantile import nth, with_group
from .stored import stored

#: Blocks that meet, as their copies are shuffled once for each other; vectors of a block, at least and at most; rows of a strip of cosines;
#: tasks among which the meetings of a block are dealt.
BLOCKS, BLOCK, MOST_BLOCK, STRIP, SALTS = 40, 1024, 16_384, 512, 4
#: Members of a haul that is agglomerated over its matrix (8 bytes a pair).
MOST = 2000
#: Cuts of the sweep: 0.20 to 0.70 by 0.005.
CUTS = [k / 200 for k in range(40, 141)]
#: Members that make a group a cluster.
LEAST = 3


def centroid(rows: DataFrame, vector: str = "vector", least: int = 200) -> DataFrame:
    """Mean of the unit vectors by place: ``pos, mean``; none from fewer than ``least`` vectors."""
    each = rows.where(F.col(vector).isNotNull()).select(F.posexplode(vectors.unit(vectors.doubles(F.col(vector)))).alias("pos", "x"))
    means = each.groupBy("pos").agg(F.avg("x").alias("mean"), F.count("*").alias("_n"))
    return means.where(F.col("_n") >= least).drop("_n")


def centroid_array(means: DataFrame) -> DataFrame:
    """The centroid as one row: ``centroid, norm``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"])
    return means.agg(listed.alias("centroid")).withColumn("norm", vectors.norm(F.col("centroid")))


def centered(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Vectors centred on their own corpus centroid; unchanged if it is too small for one."""
    mean = centroid_array(centroid(rows, vector))
    own = vectors.doubles(F.col(vector))
    out = F.when(F.size("centroid") > 0, vectors.center(own, F.col("centroid"))).otherwise(vectors.unit(own))
    return rows.crossJoin(F.broadcast(mean)).withColumn(vector, out).drop("centroid", "norm")


def blocks(rows: DataFrame, key: str, vector: str = "vector") -> tuple[DataFrame, int]:
    """Vectors in blocks, ``block, ids, data`` with float64 bytes, and how many blocks there are: ``BLOCKS`` of ``BLOCK`` to ``MOST_BLOCK`` vectors, more if those don't do."""
    own = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), vectors.unit(vectors.doubles(F.col(vector))).alias("v"))
    n = own.count()
    parts = max(1, min(-(-n // BLOCK), BLOCKS), -(-n // MOST_BLOCK))
    numbered = own.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def packed(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        data = group["v"].combine_chunks().flatten().to_numpy().tobytes()
        return pa.table([group["block"].slice(0, 1).cast(pa.int32()), pa.array([group["id"].to_numpy().tobytes()], pa.binary()), pa.array([data], pa.binary())], ["block", "ids", "data"])

    return numbered.groupBy("block").applyInArrow(packed, "block int, ids binary, data binary"), parts


def _meetings(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Each two blocks once, and each with itself: a block goes to the half of the blocks that follow it in a circle, so all take part in as many."""
    own, parts = blocks(rows, key, vector)
    own = stored(own, "blocks")
    salt = lambda step: F.pmod(step, F.lit(SALTS)).cast("int").alias("salt")
    steps = F.sequence(F.lit(0), F.lit(parts // 2))
    # at half of an even circle both would go to each other
    once = (F.col("step") < parts - F.col("step")) | ((F.col("step") * 2 == parts) & (F.col("block") < parts // 2)) | (F.col("step") == 0)
    going = own.withColumn("step", F.explode(steps)).where(once)
    going = going.select("block", "ids", "data", F.pmod(F.col("block") + F.col("step"), F.lit(parts)).alias("block_b"), salt(F.col("step")))
    staying = own.withColumn("salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    staying = staying.select(F.col("block").alias("block_b"), F.col("ids").alias("ids_b"), F.col("data").alias("data_b"), "salt")
    return going.join(staying.hint("shuffle_hash"), ["block_b", "salt"]).select("block", "ids", "data", "block_b", "ids_b", "data_b")


def _products(batch: pa.RecordBatch, tall: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strips of the cosines of the meetings in a batch: both sides' ids, and the cosines, -inf for what isn't a pair (a pair is met once)."""
    for k in range(batch.num_rows):
        ids, data, ids_b, data_b = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("ids", np.int64), ("data", float), ("ids_b", np.int64), ("data_b", float)))
        own, other = data.reshape(len(ids), -1), data_b.reshape(len(ids_b), -1).T
        alone = batch.column("block")[k].as_py() == batch.column("block_b")[k].as_py()
        high, wide = tall * STRIP, 4 * STRIP
        for at in range(0, len(ids), high):
            for to in range(0, len(ids_b), wide):
                a, b = ids[at : at + high], ids_b[to : to + wide]
                sims = own[at : at + high] @ other[:, to : to + wide]
                if alone:
                    sims[a[:, None] >= b[None, :]] = -np.inf
                yield a, b, sims


def similarity_histogram(rows: DataFrame, key: str, vector: str = "vector", digits: int = 6) -> DataFrame:
    """How often each rounded cosine occurs among all pairs: ``sim, n``; the rounding bounds the number of rows, also of a task's counts."""
    unit = 10**digits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, odd = np.zeros(2 * unit + 1, np.int64), {}
        for batch in batches:
            for _, _, sims in _products(batch, 8):  # more pairs at once than there are cells
                sims = sims.ravel()
                sims *= unit
                np.rint(sims, out=sims)
                if len(sims) and not (-unit <= sims.min() and sims.max() <= unit):
                    inside = (sims >= -unit) & (sims <= unit)
                    for value, n in zip(*np.unique(sims[~inside & (sims != -np.inf)], return_counts=True), strict=True):
                        odd[value] = odd.get(value, 0) + int(n)
                    sims = sims[inside]
                if len(sims):
                    low = sims.min()
                    sims -= low
                    found = np.bincount(sims.astype(np.intp))
                    counts[int(low) + unit : int(low) + unit + len(found)] += found
        for at in range(0, len(counts), 1 << 16):
            here = np.flatnonzero(counts[at : at + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array((here + at - unit) / unit), pa.array(counts[at + here])], ["sim", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.array([*odd], float) / unit), pa.array([*odd.values()], pa.int64())], ["sim", "n"])

    return _meetings(rows, key, vector).mapInArrow(count, "sim double, n long").groupBy("sim").agg(F.sum("n").alias("n"))


def similarity_extremes(rows: DataFrame, key: str, vector: str = "vector", digits: int = 6) -> DataFrame:
    """The least and the greatest rounded cosine of the pairs that each two blocks have, as ``sim``."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, sims in _products(batch):
                high = sims.max(initial=-np.inf)
                low = sims.min(initial=np.inf)
                if not (-np.inf < low and high < np.inf):  # some are no pairs, or no numbers
                    pairs = sims[sims != -np.inf]
                    if not len(pairs):
                        continue
                    low, high = np.fmin.reduce(pairs), pairs.max()
                found += [low, high]
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.array(found, float), digits) + 0.0)], ["sim"])

    return _meetings(rows, key, vector).mapInArrow(ends, "sim double")


def percentiles(histogram: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Elements at floor(share x n) (the last at most) of the values that a histogram counts, as one row."""
    histogram = stored(histogram, "histogram")
    found = [nth(histogram, [], F.col("sim"), lambda n, p=p: F.least(n - 1, F.floor(F.lit(p) * n)), name, F.col("n")) for name, p in shares.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), found)


def degrees(rows: DataFrame, key: str, threshold: float, vector: str = "vector") -> DataFrame:
    """Edges of the coupling graph at a threshold, as ``key, degree, strongest`` of every vector that has one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sims in _products(batch):
                hit = sims >= threshold
                tops = [np.fmax.reduce(sims, axis=axis) for axis in (1, 0)] if len(a) and len(b) else [np.zeros(0)] * 2
                for ids, top, n in zip((a, b), tops, (np.count_nonzero(hit, axis=1), np.count_nonzero(hit, axis=0)), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0], pa.int64()), pa.array(top[n > 0])], [key, "degree", "strongest"])

    found = _meetings(rows, key, vector).mapInArrow(count, f"{key} long, degree long, strongest double")
    return found.groupBy(key).agg(F.sum("degree").alias("degree"), F.max("strongest").alias("strongest"))


def agglomerate(sims: np.ndarray) -> list[tuple[int, int, float]]:
    """Average-linkage merges (kept, taken, similarity), most alike first, ties to the lowest index.

    The similarity of two groups is the mean over their pairs; a merged group keeps the lower index.
    """
    n = len(sims)
    s = sims.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    sizes, best = np.ones(n), s.argmax(axis=1) if n else np.zeros(0, int)
    value = s[np.arange(n), best] if n else np.zeros(0)
    merges = []
    for _ in range(n - 1):
        i = int(value.argmax())
        j, sim = int(best[i]), float(value[i])
        a, b = min(i, j), max(i, j)
        merges.append((a, b, sim))
        joined = (sizes[a] * s[a] + sizes[b] * s[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        s[a], s[:, a] = joined, joined
        s[b], s[:, b] = -np.inf, -np.inf
        s[a, a] = s[a, b] = s[b, a] = -np.inf
        value[b] = -np.inf
        # only rows whose best partner was touched, or that now prefer the merged group, change
        for k in np.flatnonzero((best == a) | (best == b) | (s[:, a] > value) | (np.arange(n) == a)):
            if value[k] > -np.inf or k == a:
                best[k] = s[k].argmax()
                value[k] = s[k, best[k]]
        same = (s[:, a] == value) & (best > a) & (value > -np.inf)
        best[same] = a
    return merges


def merges(rows: DataFrame, haul: str, key: str, vector: str = "vector", most: int = MOST, few: int | None = None) -> DataFrame:
    """All merges of each haul: ``haul, a, b, sim``, the groups by their least member's key, with the parts' ``size_a, size_b`` and the likeness
    at which each was made, ``born_a, born_b`` (null for one member).

    Hauls of up to ``most`` members are merged over their matrix in a task each, side by side; larger ones in rounds, with the same result but
    where likenesses tie; rounds of more than ``few`` groups go over all tasks (see ``linkage``).
    """
    own = rows.where(F.col(vector).isNotNull()).select(F.col(haul).alias("haul"), F.col(key).cast("long").alias("id"), vectors.unit(vectors.doubles(F.col(vector))).alias("v"))
    own = stored(own, "units")
    kind = rows.schema[haul].dataType.simpleString()
    sizes = own.groupBy("haul").agg(F.count("*").alias("members"))
    large = sizes.where(F.col("members") > most)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, data = group.id.to_numpy(), np.array(group.v.tolist())
        size, born, out = dict.fromkeys(range(len(ids)), 1), {}, []
        for a, b, sim in agglomerate(data @ data.T):
            out.append((group.haul.iloc[0], ids[a], ids[b], sim, size[a], size[b], born.get(a), born.get(b)))
            size[a], born[a] = size[a] + size[b], sim
        return pd.DataFrame(out, columns=["haul", "a", "b", "sim", "size_a", "size_b", "born_a", "born_b"])

    small = with_group(own, sizes.where(F.col("members") <= most), ["haul"]).drop("members")
    found = small.groupBy("haul").applyInPandas(run, f"haul {kind}, a long, b long, sim double, size_a long, size_b long, born_a double, born_b double")
    if not large.isEmpty():
        found = found.unionByName(linkage.spread_merges(with_group(own, large, ["haul"]).drop("members"), few))
    return found.withColumnRenamed("haul", haul)


def cut(members: DataFrame, merge_list: DataFrame, haul: str, key: str, threshold: float) -> DataFrame:
    """Groups at a threshold: ``haul, key, root``, the root being the least member; who merges with nobody is its own root."""
    units = members.select(F.col(haul).alias("haul"), F.col(key).cast("long").alias("id"))
    found = linkage.roots(units, merge_list.withColumnRenamed(haul, "haul"), threshold)
    return found.select(F.col("haul").alias(haul), F.col("id").alias(key), "root")


def group_counts(cut_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters, their members and the largest of them at a cut."""
    sizes = cut_rows.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    big = F.col("n") >= LEAST
    return sizes.groupBy(*keys).agg(F.count_if(big).alias("clusters"), F.coalesce(F.sum(F.when(big, F.col("n"))), F.lit(0)).alias("placed"), F.coalesce(F.max(F.when(big, F.col("n"))), F.lit(0)).alias("largest"), F.sum("n").alias("total"))


def sweep(members: DataFrame | None, merge_list: DataFrame, haul: str) -> DataFrame:
    """Counts at every cut of the sweep: ``haul, cut, clusters, placed, largest``.

    A group stands at the cuts from the likeness at which it was made down to, without, the one at which it merges, so each counts where it stands.
    """
    part = lambda side: merge_list.select(haul, F.col(f"size_{side}").alias("size"), F.col(f"born_{side}").alias("born"), F.col("sim").alias("died"))
    last = merge_list.groupBy(haul).agg(F.max(F.col("size_a") + F.col("size_b")).alias("size"), F.min("sim").alias("born")).withColumn("died", F.lit(float("-inf")))
    groups = part("a").unionByName(part("b")).unionByName(last).where(F.col("size") >= LEAST)
    cuts = F.array(*map(F.lit, CUTS))
    stands = groups.withColumn("cut", F.explode(F.filter(cuts, lambda c: (c <= F.col("born")) & (c > F.col("died")))))
    counts = stands.groupBy(haul, "cut").agg(F.count("*").alias("clusters"), F.sum("size").alias("placed"), F.max("size").alias("largest"))
    every = merge_list.select(haul).distinct().withColumn("cut", F.explode(cuts))
    out = linkage.left_with(every, counts, [haul, "cut"])
    return out.select(haul, "cut", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("clusters", "placed", "largest")))


def best_cut(swept: DataFrame, sizes: DataFrame, haul: str) -> DataFrame:
    """The cut with most clusters, then most members, then the lowest; no cluster above max(12, a fifth) unless all cuts have one."""
    each = swept.join(sizes, haul)
    cap = F.greatest(F.lit(12), F.floor(0.2 * F.col("n") + 0.5))
    order = F.struct((F.col("largest") <= cap).alias("fits"), "clusters", "placed", (-F.col("cut")).alias("low"))
    return each.groupBy(haul).agg(F.max_by(F.struct("cut", "clusters", "placed", "largest"), order).alias("b")).select(haul, "b.*")


def centers(members: DataFrame, group: str, key: str, vector: str = "vector") -> DataFrame:
    """Each group's member with the largest sum of similarities to the group, the lowest key on ties, and its mean similarity.

    The sum over a group is an inner product with the group's sum, so no pair is made.
    """
    own = members.select(group, key, vectors.unit(vectors.doubles(F.col(vector))).alias("v"))
    sums = own.select(group, F.posexplode("v").alias("pos", "x")).groupBy(group, "pos").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda p: p.s).alias("total"), F.max("n").alias("n"))
    scored = own.join(total, group).withColumn("sum", vectors.dot(F.col("v"), F.col("total")) - vectors.dot(F.col("v"), F.col("v")))
    scored = scored.withColumn("centrality", F.when(F.col("n") > 1, F.col("sum") / (F.col("n") - 1)).otherwise(1.0))
    return scored.select(group, key, "n", F.round("sum", 6).alias("sum"), F.round("centrality", 6).alias("centrality"))


def center_of(scored: DataFrame, group: str, key: str) -> DataFrame:
    return scored.groupBy(group).agg(F.max_by(key, F.struct("sum", (-F.col(key)).alias("low"))).alias("center"), F.count("*").alias("n"))


def top_category(members: DataFrame, group: str, category: str, pos: str) -> DataFrame:
    """The most common category of a group; on ties the one that comes to its count first; blanks don't count."""
    counted = members.where(F.coalesce(F.trim(category), F.lit("")) != "").groupBy(group, category).agg(F.count("*").alias("n"), F.max(pos).alias("last"))
    return counted.groupBy(group).agg(F.max_by(category, F.struct("n", (-F.col("last")).alias("first"))).alias("category"), F.max("n").alias("n"))


def cluster_ids(cut_rows: DataFrame, haul: str) -> DataFrame:
    """Adds ``cluster``: clusters from 0, largest first, then by root; -1 for members of none."""
    sizes = cut_rows.groupBy(haul, "root").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST)
    order = Window.partitionBy(haul).orderBy(F.desc("size"), "root")
    numbered = sizes.withColumn("cluster", F.row_number().over(order) - 1)
    return cut_rows.join(numbered, [haul, "root"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1))).withColumn("size", F.coalesce("size", F.lit(1)))


def stone_order(numbered_rows: DataFrame, members: DataFrame, haul: str, key: str, vector: str = "vector") -> DataFrame:
    """How a haul is laid out: ``haul, key, cluster, place, centrality, spot``.

    ``place`` counts clusters from the largest, the members of each by key, then the members of none; ``spot`` counts a cluster's members from the most central
    (null outside clusters), ties by key. ``numbered_rows`` come from ``cluster_ids``.
    """
    last = F.when(F.col("cluster") < 0, F.lit((1 << 31) - 1)).otherwise(F.col("cluster"))
    placed = numbered(numbered_rows.select(haul, key, "cluster", last.alias("_last")), [haul], [F.asc("_last"), F.asc(key)], "place").drop("_last")
    inside = linkage.left_with(numbered_rows.where("cluster >= 0").select(haul, key, "cluster"), members.select(haul, F.col(key).cast("long").alias(key), vector), [haul, key])
    group = inside.withColumn("_group", F.struct(F.col(haul).alias("haul"), F.col("cluster").alias("cluster")))
    scored = centers(group, "_group", key, vector).select(F.col("_group.haul").alias(haul), "_group.cluster", key, F.round("centrality", 9).alias("centrality"))
    ranked = numbered(scored, [haul, "cluster"], [F.desc("centrality"), F.asc(key)], "spot").drop("cluster")
    return linkage.left_with(placed, ranked, [haul, key])


def same_cluster(pairs: DataFrame, numbered_rows: DataFrame, haul: str, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """Adds ``same``: whether both of a pair are in one cluster."""
    own = numbered_rows.where("cluster >= 0").select(haul, F.col(key).alias(a), F.col("cluster").alias("_a"))
    other = own.select(haul, F.col(a).alias(b), F.col("_a").alias("_b"))
    both = linkage.left_with(linkage.left_with(pairs, own, [haul, a]), other, [haul, b])
    return both.withColumn("same", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).drop("_a", "_b")


def map_scale(histogram: DataFrame) -> DataFrame:
    """The least and greatest likeness of two different members, for colours: ``lo, hi``, hi from 0; both 0 without pairs."""
    return histogram.agg(F.coalesce(F.min("sim"), F.lit(0.0)).alias("lo"), F.greatest(F.lit(0.0), F.coalesce(F.max("sim"), F.lit(0.0))).alias("hi"))


def shares(sizes: DataFrame, haul: str, n: str = "n") -> DataFrame:
    """Adds each cluster's share of its haul, in whole per cent, and its width."""
    total = F.sum(n).over(Window.partitionBy(haul))
    return sizes.withColumns({"percent": F.floor(100 * F.col(n) / total + 0.5).cast("int"), "width": F.col(n) / total})


def keys(members: DataFrame, group: str, key: str, title: str) -> DataFrame:
    """The naming key of each group."""
    return members.groupBy(group).agg(text.cluster_key(F.col(key).cast("string"), F.col(title)).alias("cluster_key"))
