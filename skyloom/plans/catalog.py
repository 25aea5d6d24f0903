"""Queries of the library's own operators over the driver's tables, and SQL for those that SQL can express.

Roles: candidates are all rows of ``embeddings`` and their nights its labels; the query rows are its first six vectors with weight
1 / (1 + vec_id); papers are ``orders``, references ``lineitem``, the corpus ``part``; caches, logs and archives are ``events``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, text, vectors
from ..operators import archive, cluster, gate, grade, match, meters, rank, store
from ..operators.stored import folder, stored
from ..sources import feeds, search
from ..streaming import incremental, ledger, ordered
from . import batching, claims, providers, render

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
ROWS = 6
GATE = gate.Gate()


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# similarity and the gate


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("vector"))


def _rows(candidates: DataFrame) -> DataFrame:
    few = candidates.where(F.col("vec_id") < ROWS)  # the query rows; all candidates are graded
    return few.select(F.col("vec_id").cast("int").alias("row_idx"), F.concat(F.lit("row-"), F.col("vec_id").cast("string")).alias("label"), (1 / (1 + F.col("vec_id"))).alias("weight"), "vector")


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return grade.grade(c, _rows(c)).select("vec_id", "label", F.round("grade", 6).alias("grade"))


def _assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return grade.cosines(c, _rows(c), "vec_id")


_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), r AS (SELECT vec_id AS row_idx, 1.0 / (1 + vec_id) AS w, v AS rv FROM e WHERE vec_id < 6)"
_G = _E + ", g AS (SELECT vec_id, label, round(sum(w * list_dot_product(v, rv)) / sum(w), 6) AS grade FROM e, r GROUP BY vec_id, label)"


def _gate_sql(g: gate.Gate, by: str = "") -> str:
    part, on = (f"PARTITION BY {by} ", f"USING ({by})") if by else ("", "ON true")
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{_G}, m AS (SELECT {cols}list_sort(list(grade))[count(*) // 2 + 1] AS med FROM g {group}),
d AS (SELECT {cols}list_sort(list(abs(grade - med)))[count(*) // 2 + 1] AS mad FROM g JOIN m {on} {group}),
z AS (SELECT g.*, CASE WHEN mad > 0 THEN (grade - med) / ({gate.MAD_SCALE} * mad) END AS z FROM g JOIN m {on} JOIN d {on}),
k AS (SELECT *, row_number() OVER ({part}ORDER BY grade DESC, vec_id) AS rank, count(*) FILTER (z >= {g.ship}) OVER ({part.strip()}) AS ship,
  count(*) FILTER (z >= {min(g.long_z, g.ship)}) OVER ({part.strip()}) AS longs FROM z),
s AS (SELECT vec_id, label, grade, z, CAST(rank AS INTEGER) AS rank, CASE WHEN z >= {g.min_z} THEN 'paydirt' WHEN z >= {g.ship} THEN 'look' ELSE 'longshot' END AS band FROM k
  WHERE rank <= {g.max_items} AND (z IS NULL OR rank <= CASE WHEN ship < {g.floor} THEN least(longs, {g.floor}) ELSE ship END))"""


_SHIPPED = "SELECT vec_id, label, grade, round(z, 4) AS z, rank, band FROM s"


def _shipped(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", "grade", F.round("z", 4).alias("z"), "rank", "band")


@query("grade_candidates", f"WITH {_G} SELECT vec_id, label, grade FROM g")
def grade_candidates(spark, sf_dir):
    return _graded(spark, sf_dir)


@query("best_row", f"WITH {_E}, c AS (SELECT vec_id, row_idx, round(list_dot_product(v, rv), 6) AS cosine FROM e, r) SELECT vec_id, 'row-' || CAST(arg_min(row_idx, struct_pack(a := -cosine, b := row_idx)) AS VARCHAR) AS label, max(cosine) AS cosine FROM c GROUP BY vec_id")
def best_row(spark, sf_dir):
    return grade.best_row(_assay(spark, sf_dir).withColumn("cosine", F.round("cosine", 6)), "vec_id")


@query("assay_matrix_long", f"WITH {_E} SELECT vec_id, CAST(row_idx AS INTEGER) AS row_idx, round(list_dot_product(v, rv), 6) AS cosine FROM e, r")
def assay_matrix_long(spark, sf_dir):
    return _assay(spark, sf_dir).select("vec_id", "row_idx", F.round("cosine", 6).alias("cosine"))


@query("assay_matrix_wide", f"WITH {_G} SELECT vec_id, {', '.join(f'max(CASE WHEN row_idx = {i} THEN round(list_dot_product(v, rv), 6) END) AS row_{i}' for i in range(ROWS))}, max(grade) AS grade FROM e JOIN g USING (vec_id), r GROUP BY vec_id")
def assay_matrix_wide(spark, sf_dir):
    return grade.assay_matrix(_assay(spark, sf_dir), _graded(spark, sf_dir), "vec_id", list(range(ROWS)))


def _gate_query(name: str, g: gate.Gate, by: str = "") -> None:
    def run(spark, sf_dir):
        return _shipped(gate.select(_graded(spark, sf_dir), g, "vec_id", [by] if by else None))

    query(name, f"WITH {_gate_sql(g, by)} {_SHIPPED}")(run)


for _name, _gate, _by in (
    ("gate_default", GATE, ""), ("gate_strict", gate.Gate(min_z=3.0, soft_z=2.5, min_items=1, max_items=5), ""), ("gate_floor", gate.Gate(min_z=4.0, soft_z=4.0, long_z=0.0, min_items=20, max_items=30), ""),
    ("gate_shiny", gate.PRESETS["shiny"], ""), ("gate_by_night", GATE, "label"),
):
    _gate_query(_name, _gate, _by)


@query("gate_degenerate", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings) SELECT vec_id, 0.5 AS grade, CAST(NULL AS DOUBLE) AS z, CAST(rank AS INTEGER) AS rank, 'longshot' AS band FROM r WHERE rank <= 8".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"))
def gate_degenerate(spark, sf_dir):
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0.5).alias("grade"))
    return gate.select(flat, GATE, "vec_id").select("vec_id", "grade", "z", "rank", "band")


@query("gate_report_row", f"WITH {_gate_sql(GATE)} SELECT (SELECT count(*) FROM g) AS n, count(*) AS kept, count(*) FILTER (z >= {GATE.min_z}) AS hard, count(*) FILTER (z IS NULL OR z < {GATE.ship}) AS floored, round(max(z), 4) AS best_z, min(grade) AS cut_grade FROM s")
def gate_report_row(spark, sf_dir):
    return gate.readout(_graded(spark, sf_dir), GATE, "vec_id").withColumn("best_z", F.round("best_z", 4))


@query("z_scores", f"WITH {_gate_sql(GATE)} SELECT vec_id, round(z, 4) AS z FROM z")
def z_scores(spark, sf_dir):
    return gate.z_scores(_graded(spark, sf_dir)).select("vec_id", F.round("z", 4).alias("z"))


@query("clearing_counts", f"WITH {_gate_sql(GATE)} SELECT count(*) FILTER (z >= 1.0) AS z1, count(*) FILTER (z >= 1.5) AS z15, count(*) FILTER (z >= 2.0) AS z2 FROM z")
def clearing_counts(spark, sf_dir):
    z = gate.z_scores(_graded(spark, sf_dir))
    return z.agg(gate.clearing(z, 1.0).alias("z1"), gate.clearing(z, 1.5).alias("z15"), gate.clearing(z, 2.0).alias("z2"))


_COUNTS = "SELECT label, count(*) FILTER (band = 'paydirt') AS paydirt, count(*) FILTER (band = 'look') AS look, count(*) FILTER (band = 'longshot') AS longshot FROM s GROUP BY label"


@query("band_counts", f"WITH {_gate_sql(GATE, 'label')} {_COUNTS}")
def band_counts(spark, sf_dir):
    return gate.band_counts(gate.select(_graded(spark, sf_dir), GATE, "vec_id", ["label"]), ["label"])


@query("tally_sentence", f"""WITH {_gate_sql(GATE, 'label')}, c AS ({_COUNTS})
SELECT label, concat_ws('; ', CASE WHEN paydirt > 0 THEN 'pay dirt: ' || paydirt END, CASE WHEN look > 0 THEN 'worth a look: ' || look END, CASE WHEN longshot > 0 THEN 'long shot: ' || longshot END) AS tally FROM c""")
def tally_sentence(spark, sf_dir):
    return band_counts(spark, sf_dir).select("label", gate.tally(F.col("paydirt"), F.col("look"), F.col("longshot")).alias("tally"))


def _banded(spark, sf_dir) -> DataFrame:
    z = gate.z_scores(_graded(spark, sf_dir))
    return grade.ranked(z, "vec_id").withColumn("band", gate.band(F.col("z"), GATE))


@query("report_paydirt", f"WITH {_gate_sql(GATE)} SELECT vec_id, grade, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 25")
def report_paydirt(spark, sf_dir):
    every = _banded(spark, sf_dir)
    return gate.report(every, every, "paydirt", 25, key="vec_id").select("vec_id", "grade", "rank")


@query("report_picked", f"WITH {_gate_sql(GATE)} SELECT vec_id, CASE WHEN z >= {GATE.min_z} THEN 'paydirt' WHEN z >= {GATE.ship} THEN 'look' ELSE 'picked' END AS band FROM z WHERE label = 3")
def report_picked(spark, sf_dir):
    every = _banded(spark, sf_dir)
    return gate.report(every, every, "picked", 0, every.where("label = 3"), key="vec_id").select("vec_id", "band")


@query("lamp_domain", f"WITH {_G}, l AS (SELECT list_sort(list(grade)) AS x FROM g), b AS (SELECT x[CAST(floor(0.05 * (len(x) - 1)) AS BIGINT) + 1] AS lo, x[len(x)] AS hi FROM l) SELECT CASE WHEN hi - lo >= 0.03 THEN lo ELSE 0.0 END AS lo, CASE WHEN hi - lo >= 0.03 THEN hi ELSE 0.45 END AS hi FROM b")
def lamp_domain(spark, sf_dir):
    return gate.lamp_domain(_graded(spark, sf_dir))


@query("colour_buckets", f"WITH {_G} SELECT CAST(floor(least(1.0, greatest(0.0, grade / 0.55)) * 7 + 0.5) AS INTEGER) AS step, count(*) AS n FROM g GROUP BY 1")
def colour_buckets(spark, sf_dir):
    return _graded(spark, sf_dir).groupBy(gate.bucket(F.col("grade"), 0.0, 0.55, 7).alias("step")).agg(F.count("*").alias("n"))


# centring, coupling, clusters

_UNIT = "u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
_CENTROID = _UNIT + ", p AS (SELECT unnest(range(len(v))) AS pos, unnest(v) AS x FROM u), c AS (SELECT pos, avg(x) AS mean FROM p GROUP BY pos)"


@query("centroid_by_dim", f"WITH {_CENTROID} SELECT CAST(pos AS INTEGER) AS pos, round(mean, 8) AS mean FROM c")
def centroid_by_dim(spark, sf_dir):
    return cluster.centroid(_candidates(spark, sf_dir)).select("pos", F.round("mean", 8).alias("mean"))


@query("centroid_norm", f"WITH {_CENTROID} SELECT round(sqrt(sum(mean * mean)), 8) AS norm FROM c")
def centroid_norm(spark, sf_dir):
    return cluster.centroid_array(cluster.centroid(_candidates(spark, sf_dir))).select(F.round("norm", 8).alias("norm"))


@query("center_vectors", f"WITH {_CENTROID}, a AS (SELECT list(mean ORDER BY pos) AS m FROM c), s AS (SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: v[i] - m[i]) AS d FROM u, a) SELECT vec_id, round(d[1] / sqrt(list_dot_product(d, d)), 6) AS first, round(d[len(d)] / sqrt(list_dot_product(d, d)), 6) AS last FROM s")
def center_vectors(spark, sf_dir):
    out = cluster.centered(_candidates(spark, sf_dir))
    return out.select("vec_id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"))


_PAIRS = _UNIT + ", s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS sim FROM u a JOIN u b ON a.vec_id < b.vec_id)"


@query("coupling_percentiles", f"WITH {_PAIRS}, l AS (SELECT list_sort(list(round(sim, 6))) AS x, count(*) AS n FROM s) SELECT x[least(n - 1, CAST(floor(0.05 * n) AS BIGINT)) + 1] AS p5, x[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, x[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95, round(x[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] - x[least(n - 1, CAST(floor(0.05 * n) AS BIGINT)) + 1], 6) AS spread FROM l")
def coupling_percentiles(spark, sf_dir):
    found = cluster.percentiles(cluster.similarity_histogram(_candidates(spark, sf_dir), "vec_id"), {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    return found.withColumn("spread", F.round(F.col("p95") - F.col("p5"), 6))


@query("coupling_edges_degree", f"WITH {_PAIRS}, e AS (SELECT a AS vec_id, sim FROM s WHERE sim >= 0.25 UNION ALL SELECT b, sim FROM s WHERE sim >= 0.25) SELECT vec_id, count(*) AS degree, round(max(sim), 6) AS strongest FROM e GROUP BY vec_id")
def coupling_edges_degree(spark, sf_dir):
    return cluster.degrees(_candidates(spark, sf_dir), "vec_id", 0.25).withColumn("strongest", F.round("strongest", 6))


#: Merges one by one: each step picks the most alike pair of groups of a haul, lower members first, and adds up what its parts had with others.
_MERGED = f"""{_UNIT},
steps(label, step, a, b, total, na, nb) AS (
  SELECT x.label, 0, x.vec_id, y.vec_id, list_dot_product(x.v, y.v), 1, 1 FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id
  UNION ALL
  SELECT label, step + 1, least(a2, b2), greatest(a2, b2), sum(total), max(CASE WHEN a2 < b2 THEN na2 ELSE nb2 END), max(CASE WHEN a2 < b2 THEN nb2 ELSE na2 END)
  FROM (SELECT label, step, total, CASE WHEN a = pb THEN pa ELSE a END AS a2, CASE WHEN b = pb THEN pa ELSE b END AS b2, CASE WHEN a IN (pa, pb) THEN size ELSE na END AS na2, CASE WHEN b IN (pa, pb) THEN size ELSE nb END AS nb2
    FROM (SELECT *, first_value(a) OVER w AS pa, first_value(b) OVER w AS pb, first_value(na + nb) OVER w AS size FROM steps WINDOW w AS (PARTITION BY label ORDER BY total / (na * nb) DESC, a, b))
    WHERE NOT (a = pa AND b = pb)) GROUP BY label, step, least(a2, b2), greatest(a2, b2)),
merged AS (SELECT label, step, a, b, total / (na * nb) AS sim FROM steps QUALIFY row_number() OVER (PARTITION BY label, step ORDER BY total / (na * nb) DESC, a, b) = 1)"""


def _cut_sql(cuts: str) -> str:
    return f"""{_MERGED}, cuts AS ({cuts}),
up(label, cut, vec_id, root) AS (SELECT label, cut, vec_id, vec_id FROM u, cuts UNION ALL SELECT up.label, cut, vec_id, a FROM up JOIN merged m ON m.label = up.label AND b = root AND sim >= cut),
roots AS (SELECT label, cut, vec_id, min(root) AS root FROM up GROUP BY ALL), sizes AS (SELECT label, cut, root, count(*) AS n FROM roots GROUP BY ALL),
swept AS (SELECT label, cut, count(*) FILTER (n >= 3) AS clusters, CAST(coalesce(sum(n) FILTER (n >= 3), 0) AS BIGINT) AS placed, coalesce(max(n) FILTER (n >= 3), 0) AS largest, CAST(sum(n) AS BIGINT) AS n FROM sizes GROUP BY ALL)"""


_CUTS = "SELECT k / 200.0::DOUBLE AS cut FROM range(40, 141) AS r(k)"


def _merges(spark, sf_dir, **how) -> tuple[DataFrame, DataFrame]:
    c = _candidates(spark, sf_dir)
    return c, stored(cluster.merges(c, "label", "vec_id", **how), "merges")


@query("clusters_at_threshold", f"""WITH RECURSIVE {_cut_sql("SELECT 0.3::DOUBLE AS cut")}, big AS (SELECT label, root, n, row_number() OVER (PARTITION BY label ORDER BY n DESC, root) - 1 AS k FROM sizes WHERE n >= 3)
SELECT label, vec_id, root, CAST(coalesce(k, -1) AS INTEGER) AS cluster, coalesce(n, 1) AS size FROM roots LEFT JOIN big USING (label, root)""")
def clusters_at_threshold(spark, sf_dir):
    c, found = _merges(spark, sf_dir)
    return cluster.cluster_ids(cluster.cut(c, found, "label", "vec_id", 0.3), "label").select("label", "vec_id", "root", "cluster", "size")


@query("clusters_in_rounds", f"WITH RECURSIVE {_MERGED} SELECT label, a, b, round(sim, 6) AS sim FROM merged")
def clusters_in_rounds(spark, sf_dir):
    """The merges of all hauls by rounds over all tasks, whatever their size."""
    return _merges(spark, sf_dir, most=0)[1].select("label", "a", "b", F.round("sim", 6).alias("sim"))


_BIG = "big AS (SELECT label, root, n, CAST(row_number() OVER (PARTITION BY label ORDER BY n DESC, root) - 1 AS INTEGER) AS k FROM sizes WHERE n >= 3), ids AS (SELECT label, vec_id, root, coalesce(k, -1) AS cluster FROM roots LEFT JOIN big USING (label, root))"


def _clusters(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c, found = _merges(spark, sf_dir)
    return c, stored(cluster.cluster_ids(cluster.cut(c, found, "label", "vec_id", 0.3), "label"), "clusters")


@query("stone_order", f"""WITH RECURSIVE {_cut_sql("SELECT 0.3::DOUBLE AS cut")}, {_BIG}, own AS (SELECT label, vec_id, cluster, v FROM ids JOIN u USING (label, vec_id) WHERE cluster >= 0),
central AS (SELECT a.label, a.cluster, a.vec_id, round(round(sum(CASE WHEN a.vec_id <> b.vec_id THEN list_dot_product(a.v, b.v) ELSE 0 END) / (count(*) - 1), 6), 9) AS centrality FROM own a JOIN own b USING (label, cluster) GROUP BY ALL),
spots AS (SELECT label, vec_id, centrality, row_number() OVER (PARTITION BY label, cluster ORDER BY centrality DESC, vec_id) AS spot FROM central)
SELECT label, vec_id, cluster, row_number() OVER (PARTITION BY label ORDER BY cluster < 0, cluster, vec_id) AS place, centrality, spot FROM ids LEFT JOIN spots USING (label, vec_id)""")
def stone_order(spark, sf_dir):
    c, ids = _clusters(spark, sf_dir)
    return cluster.stone_order(ids, c, "label", "vec_id").select("label", "vec_id", "cluster", "place", "centrality", "spot")


@query("same_cluster", f"""WITH RECURSIVE {_cut_sql("SELECT 0.3::DOUBLE AS cut")}, {_BIG}, nexts AS (SELECT label, vec_id AS a, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT label, a, b, coalesce(x.cluster >= 0 AND x.cluster = y.cluster, false) AS same FROM nexts LEFT JOIN ids x USING (label) LEFT JOIN ids y USING (label) WHERE x.vec_id = a AND y.vec_id = b""")
def same_cluster(spark, sf_dir):
    """Whether neighbours by id within a haul are in one cluster."""
    c, ids = _clusters(spark, sf_dir)
    pairs = c.select("label", F.col("vec_id").alias("a"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("b")).where("b is not null")
    return cluster.same_cluster(pairs, ids, "label", "vec_id").select("label", "a", "b", "same")


@query("map_scale", f"WITH {_PAIRS} SELECT min(round(sim, 6)) AS lo, greatest(0.0, max(round(sim, 6))) AS hi FROM s")
def map_scale(spark, sf_dir):
    return cluster.map_scale(cluster.similarity_extremes(_candidates(spark, sf_dir), "vec_id"))


@query("cluster_sweep", f"WITH RECURSIVE {_cut_sql(_CUTS)} SELECT label, cut, clusters, placed, largest FROM swept")
def cluster_sweep(spark, sf_dir):
    _, found = _merges(spark, sf_dir)
    return cluster.sweep(None, found, "label")


@query("cluster_best_cut", f"""WITH RECURSIVE {_cut_sql(_CUTS)}, marked AS (SELECT *, largest <= greatest(12, floor(0.2 * n + 0.5)) AS fits FROM swept)
SELECT label, cut, clusters, placed, largest FROM marked QUALIFY row_number() OVER (PARTITION BY label ORDER BY fits DESC, clusters DESC, placed DESC, cut) = 1""")
def cluster_best_cut(spark, sf_dir):
    c, found = _merges(spark, sf_dir)
    return cluster.best_cut(cluster.sweep(c, found, "label"), c.groupBy("label").agg(F.count("*").alias("n")), "label")


@query("cluster_centers", f"WITH {_UNIT}, s AS (SELECT a.label, a.vec_id, count(*) AS n, sum(CASE WHEN a.vec_id <> b.vec_id THEN list_dot_product(a.v, b.v) ELSE 0 END) AS s FROM u a JOIN u b USING (label) GROUP BY a.label, a.vec_id) SELECT label, vec_id, n, round(s, 6) AS sum, round(CASE WHEN n > 1 THEN s / (n - 1) ELSE 1.0 END, 6) AS centrality FROM s")
def cluster_centers(spark, sf_dir):
    return cluster.centers(_candidates(spark, sf_dir), "label", "vec_id")


@query("cluster_top_category", "WITH c AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL) SELECT user_id, arg_max(event_type, struct_pack(a := n, b := -last)) AS category, max(n) AS n FROM c GROUP BY user_id")
def cluster_top_category(spark, sf_dir):
    return cluster.top_category(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("cluster_keys", "SELECT c_nationkey, sha256(string_agg(CAST(c_custkey AS VARCHAR) || chr(9) || c_name, chr(10) ORDER BY CAST(c_custkey AS VARCHAR) || chr(9) || c_name)) AS cluster_key FROM customer GROUP BY c_nationkey")
def cluster_keys(spark, sf_dir):
    return cluster.keys(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name")


@query("cluster_shares", "SELECT label, count(*) AS n, CAST(floor(100 * count(*) / sum(count(*)) OVER () + 0.5) AS INTEGER) AS percent FROM embeddings GROUP BY label")
def cluster_shares(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).withColumn("haul", F.lit(0))
    return cluster.shares(sizes, "haul").select("label", "n", "percent")


# text

_WS = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
_COLLAPSED = f"trim(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g'))"


@query("text_sha_dedup", f"WITH s AS (SELECT doc_id, sha256({_COLLAPSED}) AS sha FROM documents) SELECT sha, min(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY sha")
def text_sha_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.text_sha(F.col("text")).alias("sha"))
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("first_wins_dedup", "WITH s AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS n FROM documents) SELECT source, lang, doc_id FROM s WHERE n = 1")
def first_wins_dedup(spark, sf_dir):
    return match.first_seen(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), "source", ["lang", "doc_id"])


@query("norm_title_match", "WITH b AS (SELECT regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS t, min(item_id) AS item_id FROM benchmark GROUP BY 1), d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g') AS t FROM documents) SELECT d.doc_id, item_id, length(d.t) AS size FROM d LEFT JOIN b ON d.t = b.t")
def norm_title_match(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").groupBy(text.norm_title(F.col("text")).alias("t")).agg(F.min("item_id").alias("item_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.norm_title(F.col("text")).alias("t"))
    return docs.join(items, "t", "left").select("doc_id", "item_id", F.length("t").cast("long").alias("size"))


@query("slugs", "SELECT p_partkey, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM part)")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.col("p_name")).alias("slug"))


@query("clip_labels", f"WITH c AS (SELECT doc_id, {_COLLAPSED} AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 79)) || '…' ELSE t END AS label FROM c")
def clip_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clip_label(F.col("text")).alias("label"))


@query("xml_escaped", "SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS sha FROM pages")
def xml_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.xml_escape(F.col("html")), 256).alias("sha"))


@query("word_lists", r"SELECT page_id, len(list_distinct(list_filter(list_transform(string_split_regex(url, '[/?#&=.]'), lambda x: trim(x)), lambda x: x <> ''))) AS n FROM pages")
def word_lists(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.distinct_list(F.col("url"), "[/?#&=.]")).cast("long").alias("n"))


@query("doi_forms", "SELECT item_id, 'doi:10.5555/' || item_id AS doi_key, '10.5555/' || item_id AS doi, '10.48550/arxiv.2401.' || lpad(CAST(item_id AS VARCHAR), 5, '0') AS arxiv_doi FROM benchmark")
def doi_forms(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(" https://DOI.org/10.5555/"), "item_id").alias("raw"), F.concat(F.lit("arXiv:2401."), F.lpad(F.col("item_id").cast("string"), 5, "0"), F.lit("v3")).alias("ref"))
    return items.select("item_id", text.doi_key(F.col("raw")).alias("doi_key"), text.normalize_doi(F.col("raw")).alias("doi"), text.arxiv_doi(F.col("ref")).alias("arxiv_doi"))


# signals and ranking


def _papers(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("cite_key"), key.alias("pos"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("published"),
        F.when(key % 3 != 0, F.least(F.lit(1.0), F.col("o_totalprice") / 400000)).alias("relevance_score"), F.when(key % 4 != 0, (key % 11) / 10.0).alias("centrality"),
        F.when(key % 5 != 0, (key % 30).cast("int")).alias("scites"), F.when(key % 7 == 0, F.to_date("o_orderdate")).alias("briefed_on"), (key % 2 == 0).alias("relevant"),
        F.concat(F.lit("Paper "), key.cast("string")).alias("title"), F.concat(F.lit("2401."), key.cast("string")).alias("arxiv_id"), F.col("o_orderpriority").alias("filter_reason"),
    )


_WEIGHTS = {"llm": 0.6, "centrality": 0.3, "scites": 0.1}
_P = """p AS (SELECT CAST(o_orderkey AS VARCHAR) AS cite_key, o_orderkey AS pos, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS published,
CASE WHEN o_orderkey % 3 <> 0 THEN least(1.0, o_totalprice / 400000) END AS relevance_score, CASE WHEN o_orderkey % 4 <> 0 THEN CAST((o_orderkey % 11) / 10.0 AS DOUBLE) END AS centrality,
CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 30 AS INTEGER) END AS scites, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) END AS briefed_on,
o_orderkey % 2 = 0 AS relevant, o_orderpriority AS filter_reason FROM orders),
i AS (SELECT *, round(coalesce((coalesce(CAST(0.6 AS DOUBLE) * relevance_score, 0) + coalesce(CAST(0.3 AS DOUBLE) * centrality, 0) + CASE WHEN scites IS NOT NULL THEN CAST(0.1 AS DOUBLE) * CAST(least(scites / 20.0, 1.0) AS DOUBLE) ELSE 0 END)
 / nullif(CASE WHEN relevance_score IS NOT NULL THEN CAST(0.6 AS DOUBLE) ELSE 0 END + CASE WHEN centrality IS NOT NULL THEN CAST(0.3 AS DOUBLE) ELSE 0 END + CASE WHEN scites IS NOT NULL THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 0), 0.0), 10) AS importance FROM p)"""


def _important(spark, sf_dir) -> DataFrame:
    return rank.importance(_papers(spark, sf_dir), _WEIGHTS).withColumn("importance", F.round("importance", 10))


@query("blend_renormalised", f"WITH {_P} SELECT cite_key, importance FROM i")
def blend_renormalised(spark, sf_dir):
    return _important(spark, sf_dir).select("cite_key", "importance")


@query("rank_topn", f"WITH {_P} SELECT cite_key, importance FROM i WHERE briefed_on IS NULL ORDER BY importance DESC NULLS LAST, cite_key LIMIT 20")
def rank_topn(spark, sf_dir):
    return rank.top_ranked(_important(spark, sf_dir), 20).select("cite_key", "importance")


@query("also_evaluated", f"WITH {_P}, t AS (SELECT cite_key FROM i WHERE briefed_on IS NULL ORDER BY importance DESC NULLS LAST, cite_key LIMIT 20) SELECT cite_key, relevant, importance FROM i WHERE briefed_on IS NULL AND cite_key NOT IN (SELECT cite_key FROM t)")
def also_evaluated(spark, sf_dir):
    papers = _important(spark, sf_dir)
    return rank.also_evaluated(papers, rank.top_ranked(papers, 20)).select("cite_key", "relevant", "importance")


@query("status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, sf_dir):
    return store.status_counts(table(spark, sf_dir, "events"), "event_type")


@query("work_list", "SELECT CAST(o_orderkey AS VARCHAR) AS cite_key, CAST(o_orderdate AS DATE) AS published FROM orders WHERE o_orderstatus = 'O'")
def work_list(spark, sf_dir):
    return store.with_status(_papers(spark, sf_dir), "O").select("cite_key", "published")


@query("relevance_gate", "SELECT CAST(o_orderkey AS VARCHAR) AS cite_key, CASE WHEN o_orderkey % 2 = 0 THEN 'filtered' ELSE o_orderstatus END AS status, list_filter([o_orderpriority, 'other', o_orderpriority], lambda x: x IN ('1-URGENT', '2-HIGH')) AS t FROM orders".replace("list_filter([", "array_to_string(list_filter([").replace("'2-HIGH')) AS t", "'2-HIGH')), ',') AS topics"))
def relevance_gate(spark, sf_dir):
    papers = _papers(spark, sf_dir).withColumn("matched", F.array("filter_reason", F.lit("other"), F.col("filter_reason")))
    return rank.relevance(papers, ["1-URGENT", "2-HIGH"]).select("cite_key", "status", F.array_join("topics", ",").alias("topics"))


# the store


@query("upsert_enrich", "WITH patch AS (SELECT l_orderkey AS k, CASE WHEN count(*) > 3 THEN sum(l_linenumber) END AS s FROM lineitem GROUP BY l_orderkey UNION ALL SELECT -1, 7) SELECT coalesce(o_orderkey, k) AS k, o_orderpriority AS p, CASE WHEN k IS NOT NULL THEN CAST(s AS BIGINT) ELSE CAST(o_custkey AS BIGINT) END AS s FROM orders FULL JOIN patch ON o_orderkey = k")
def upsert_enrich(spark, sf_dir):
    current = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_custkey").cast("long").alias("s"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.when(F.count("*") > 3, F.sum("l_linenumber")).alias("s"))
    return store.upsert(current, lines.unionByName(spark.createDataFrame([(-1, 7)], "k long, s long")), ["k"])


@query("insert_if_absent", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT c_custkey, max(c_name) FROM customer WHERE c_custkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY c_custkey")
def insert_if_absent(spark, sf_dir):
    have = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    return store.insert_absent(have, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), ["k"])


@query("replace_children", "WITH n AS (SELECT o_orderkey AS k, 0 AS pos, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'F') SELECT l_orderkey AS k, l_linenumber AS pos, l_returnflag AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n")
def replace_children(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("v"))
    new = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("pos"), F.col("o_orderpriority").alias("v"))
    return store.replace_children(children, new, "k")


@query("prune_cascade", "WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-01-01') SELECT 'papers' AS table_name, count(*) AS n FROM d UNION ALL SELECT 'refs', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM d)")
def prune_cascade(spark, sf_dir):
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("published"))
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return store.prune_counts({"papers": papers, "refs": refs}, store.old_papers(papers, F.lit("1995-01-01").cast("date")), "k")


@query("vector_first_wins", "SELECT user_id, event_type, arg_min(value, event_id) AS value, arg_max(CAST(ts AS DATE), event_id) AS seen_at FROM events GROUP BY user_id, event_type")
def vector_first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("seen_at"))
    return store.first_vectors(rows, "event_id", ["user_id", "event_type"])


@query("latest_per_key", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 <> 0 THEN ts END DESC NULLS LAST, event_id) AS n FROM events) SELECT user_id, event_id, value FROM r WHERE n = 1")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("created_at", F.when(F.col("event_id") % 4 != 0, F.col("ts")))
    return store.latest(rows, ["user_id"], [F.desc_nulls_last("created_at"), F.col("event_id")]).select("user_id", "event_id", "value")


@query("cache_hit_miss", f"WITH s AS (SELECT DISTINCT sha256({_COLLAPSED}) AS sha, FROM documents), c AS (SELECT DISTINCT sha256({_COLLAPSED}) AS sha FROM documents WHERE lang = 'en') SELECT count(*) FILTER (c.sha IS NOT NULL) AS hits, count(*) FILTER (c.sha IS NULL) AS misses FROM s LEFT JOIN c USING (sha)".replace("AS sha, FROM", "AS sha FROM"))
def cache_hit_miss(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(text.text_sha(F.col("text")).alias("text_sha"), "lang")
    cache = docs.where("lang = 'en'").select("text_sha").distinct().select("text_sha", F.lit("m").alias("model"), F.lit(1).alias("dim"), F.array(F.lit(1.0)).alias("vector"))
    found = store.cache_lookup(docs, cache, "m", 1)
    return found.agg(F.count_if(F.col("vector").isNotNull()).alias("hits"), F.count_if(F.col("vector").isNull()).alias("misses"))


@query("visible_rows", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (0, 7) GROUP BY user_id")
def visible_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("user_id") == 0, "").otherwise(F.col("user_id").cast("string")))
    own = store.visible(rows, "7").groupBy("user_id").agg(F.count("*").alias("n"))
    return own.withColumn("user_id", F.when(F.col("user_id") == "", "0").otherwise(F.col("user_id")).cast("long"))


# matching


def _five(number: F.Column) -> F.Column:
    """A number with zeros before it up to five digits; longer ones stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(5)), F.lit("0"))


def _corpus(spark, sf_dir) -> DataFrame:
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        key.alias("corpus_pos"), F.concat(F.lit("P"), key).alias("cite_key"), F.concat(F.lit("W"), key).alias("openalex_id"),
        F.when(key % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), key)).when(key % 3 == 1, F.concat(F.lit("10.48550/arXiv.2401."), _five(key))).alias("doi"), F.col("p_name").alias("title"),
    )


def _refs(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    kind, key = F.col("l_linenumber") % 4, F.col("l_partkey")
    return lines.select(
        F.col("l_orderkey").alias("cite_key"), F.col("l_linenumber").alias("ref_pos"), F.when(kind == 1, F.concat(F.lit("doi:10.1000/"), key)).alias("ref_doi"),
        F.when(kind == 2, F.concat(F.lit("2401."), _five(key))).alias("ref_arxiv"), F.when(kind == 3, F.upper("p_name")).alias("ref_title"),
    )


_M = """t AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS t, min(p_partkey) AS k FROM part GROUP BY 1),
m AS (SELECT l_orderkey AS cite_key, l_linenumber AS ref_pos, CASE WHEN l_linenumber % 4 = 1 AND l_partkey % 3 = 0 THEN 'P' || l_partkey
 WHEN l_linenumber % 4 = 2 AND l_partkey % 3 = 1 THEN 'P' || l_partkey WHEN l_linenumber % 4 = 3 THEN 'P' || t.k END AS matched_key
 FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN t ON t.t = regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')),
o AS (SELECT cite_key, matched_key, min(ref_pos) AS pos FROM m WHERE matched_key IS NOT NULL GROUP BY ALL)"""


@query("match_cascade", f"WITH {_M} SELECT cite_key, ref_pos, matched_key FROM m")
def match_cascade(spark, sf_dir):
    return match.match_refs(_refs(spark, sf_dir), _corpus(spark, sf_dir)).select("cite_key", "ref_pos", "matched_key")


@query("bibliography_matches", f"WITH {_M} SELECT cite_key, string_agg(matched_key, ' ' ORDER BY pos, matched_key) AS matched FROM o GROUP BY cite_key")
def bibliography_matches(spark, sf_dir):
    found = match.bibliography_matches(match.match_refs(_refs(spark, sf_dir), _corpus(spark, sf_dir)))
    return found.select("cite_key", F.array_join("matched", " ").alias("matched"))


@query("overlap_ordered", "WITH n AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS spot FROM lineitem), f AS (SELECT l_orderkey AS cite_key, s, min(spot) AS pos FROM n WHERE s IN (SELECT s_suppkey FROM supplier) GROUP BY ALL) SELECT cite_key, string_agg('S' || s, ' ' ORDER BY pos) AS matched FROM f GROUP BY cite_key")
def overlap_ordered(spark, sf_dir):
    work = F.when(F.col("l_returnflag") != "R", F.concat(F.lit("W"), "l_suppkey")).otherwise("elsewhere")  # what was returned isn't in the corpus
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("cite_key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", work.alias("work")))), lambda x: x.work).alias("referenced_works"))
    s = F.col("s_suppkey")
    corpus = table(spark, sf_dir, "supplier").select(s.alias("corpus_pos"), F.concat(F.lit("S"), s).alias("cite_key"), F.concat(F.lit("W"), s).alias("openalex_id"), F.lit(None).cast("string").alias("doi"), F.col("s_name").alias("title"))
    return match.overlap(lines, corpus).select("cite_key", F.array_join("matched", " ").alias("matched"))


@query("connect_decision", f"""WITH {_M}, b AS (SELECT cite_key, count(*) AS n FROM o GROUP BY cite_key),
x AS (SELECT o_orderkey AS cite_key, b.n AS bib, o_orderkey % 3 AS kind, 'P' || CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS hit FROM orders LEFT JOIN b ON b.cite_key = o_orderkey)
SELECT CAST(cite_key AS VARCHAR) AS cite_key, CASE WHEN bib IS NOT NULL THEN least(bib / 10.0, 1.0) WHEN kind = 2 THEN CASE WHEN cite_key % 2 = 0 THEN 0.1 ELSE 0.0 END END AS centrality,
 bib IS NOT NULL OR kind = 2 AS connected, CASE WHEN bib IS NULL AND kind > 0 THEN 'O' || cite_key END AS openalex_id FROM x""".replace("least(bib / 10.0, 1.0)", "CAST(least(bib / 10.0, 1.0) AS DOUBLE)").replace("THEN 0.1 ELSE 0.0 END END", "THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END"))
def connect_decision(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cite_key"), F.col("o_orderkey").alias("n"))
    refs = match.match_refs(_refs(spark, sf_dir), corpus).withColumn("cite_key", F.col("cite_key").cast("string"))
    works = F.when(F.col("n") % 3 == 2, F.when(F.col("n") % 2 == 0, F.array(F.lit("W1"))).otherwise(F.array(F.lit("W-none")))).otherwise(F.array().cast("array<string>"))
    resolved = papers.where("n % 3 > 0").select("cite_key", F.concat(F.lit("O"), "cite_key").alias("openalex_id"), F.lit(None).cast("string").alias("doi"), works.alias("referenced_works"))
    return match.connect(papers.select("cite_key"), refs, resolved, corpus).select("cite_key", "centrality", "connected", "openalex_id")


# ingestion


@query("weekday_cutoff", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), w AS (SELECT d, CAST(x AS DATE) AS x, row_number() OVER (PARTITION BY d ORDER BY x DESC) AS n FROM (SELECT d, unnest(range(d - INTERVAL 12 DAY, CAST(d AS TIMESTAMP), INTERVAL 1 DAY)) AS x FROM d) WHERE isodow(x) <= 5) SELECT d AS day, x AS cutoff FROM w WHERE n = 3")
def weekday_cutoff(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", dates.weekday_cutoff(F.col("day"), 3).alias("cutoff"))


@query("take_while_cutoff", "WITH b AS (SELECT o_custkey, min(CASE WHEN o_orderdate < DATE '1995-06-01' THEN o_orderkey END) AS stop FROM orders GROUP BY o_custkey) SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders JOIN b USING (o_custkey) WHERE stop IS NULL OR o_orderkey < stop GROUP BY o_custkey")
def take_while_cutoff(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), F.to_date("o_orderdate").alias("published"))
    kept = feeds.take_while(rows, F.lit("1995-06-01").cast("date"), keys=["o_custkey"])
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query("union_sources_dedup", "SELECT coalesce(n.n_nationkey, c.k) AS arxiv_id, CASE WHEN n.n_nationkey IS NOT NULL THEN 0 ELSE 1 END AS source FROM nation n FULL JOIN (SELECT DISTINCT c_nationkey + 10 AS k FROM customer) c ON c.k = n.n_nationkey")
def union_sources_dedup(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("arxiv_id"), F.col("n_nationkey").cast("long").alias("pos"))
    b = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 10).alias("arxiv_id"), F.col("c_custkey").alias("pos"))
    return feeds.merge_sources([a, b]).select("arxiv_id", F.col("_source").alias("source"))


@query("cap_results", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 200")
def cap_results(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(200)


# archive, documents, meters


def _items(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    band = F.when(F.col("value") >= 80, "paydirt").when(F.col("value") >= 50, "look").otherwise("longshot")
    return e.select(F.to_date("ts").alias("date"), F.col("event_type").alias("slug"), F.col("event_id").cast("string").alias("id"), F.coalesce(band, F.lit("longshot")).alias("band"))


_ITEMS = "it AS (SELECT CAST(ts AS DATE) AS date, event_type AS slug, CAST(event_id AS VARCHAR) AS id, CASE WHEN value >= 80 THEN 'paydirt' WHEN value >= 50 THEN 'look' ELSE 'longshot' END AS band FROM events)"


@query("archive_rollup", f"WITH {_ITEMS} SELECT strftime(date, '%Y-%m') AS month, date, slug, count(*) AS items, count(*) FILTER (band = 'paydirt') AS paydirt FROM it GROUP BY ALL")
def archive_rollup(spark, sf_dir):
    return archive.index(_items(spark, sf_dir))


@query("archive_replace_day", f"WITH {_ITEMS}, m AS (SELECT max(date) AS d FROM it) SELECT date, count(*) AS n FROM it, m WHERE date <> d GROUP BY date UNION ALL SELECT d, (SELECT count(*) FROM it, m WHERE date = d AND slug = 'click') AS n FROM m WHERE n > 0")
def archive_replace_day(spark, sf_dir):
    items = _items(spark, sf_dir)
    newest = items.agg(F.max("date").alias("date"))
    again = items.join(F.broadcast(newest), "date").where("slug = 'click'").select(*items.columns)
    return archive.merge_days(items.join(F.broadcast(newest), "date", "left_anti"), again).groupBy("date").agg(F.count("*").alias("n"))


@query("manifest_merge", f"WITH {_ITEMS}, t AS (SELECT slug, count(*) AS items, count(*) FILTER (band = 'paydirt') AS paydirt FROM it WHERE slug <> 'view' GROUP BY slug), p AS (SELECT DISTINCT slug FROM it) SELECT p.slug, CASE WHEN t.slug IS NOT NULL THEN t.items WHEN p.slug = 'view' THEN 5 END AS items, CASE WHEN t.slug IS NOT NULL THEN t.paydirt WHEN p.slug = 'view' THEN 1 END AS paydirt, CASE WHEN t.slug IS NOT NULL THEN 'today' WHEN p.slug = 'view' THEN 'before' END AS updated FROM p LEFT JOIN t USING (slug)")
def manifest_merge(spark, sf_dir):
    items = _items(spark, sf_dir)
    today = items.where("slug <> 'view'").groupBy("slug").agg(F.count("*").alias("items"), F.count_if(F.col("band") == "paydirt").alias("paydirt")).withColumn("updated", F.lit("today"))
    prior = spark.createDataFrame([("view", 5, 1, "before"), ("gone", 9, 9, "before")], "slug string, items long, paydirt long, updated string")
    return archive.manifest(items.select("slug").distinct().withColumn("name", F.col("slug")), today, prior).drop("name")


@query("feed_overlap", "WITH s AS (SELECT DISTINCT event_type AS slug, user_id AS id FROM events), n AS (SELECT slug, count(*) AS n FROM s GROUP BY slug), b AS (SELECT x.slug AS a, y.slug AS b, count(*) AS shared FROM s x JOIN s y USING (id) WHERE x.slug < y.slug GROUP BY ALL) SELECT a, b, shared, round(shared / CAST(p.n + q.n - shared AS DOUBLE), 6) AS jaccard FROM b JOIN n p ON p.slug = a JOIN n q ON q.slug = b")
def feed_overlap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("slug"), F.col("user_id").alias("id"))
    return archive.jaccard(rows).withColumn("jaccard", F.round("jaccard", 6))


@query("budget_spend", """WITH RECURSIVE e AS (SELECT CAST(ts AS DATE) AS day, event_id AS seq, CAST(user_id AS VARCHAR) AS client, CASE WHEN event_type = 'refund' THEN -2 ELSE event_id % 4 + 1 END AS want,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS n FROM events),
s AS (SELECT day, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, '' AS client, CAST(0 AS BIGINT) AS want, CAST(0 AS BIGINT) AS granted, CAST(0 AS BIGINT) AS mine, CAST(0 AS BIGINT) AS every, CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS m FROM (SELECT DISTINCT day FROM e)
UNION ALL SELECT day, n, seq, client, want, granted, greatest(0, had + granted), greatest(0, every + granted), map_concat(m, MAP([client], [greatest(0, had + granted)])) FROM (
  SELECT e.*, s.every, s.m, coalesce(s.m[e.client], 0) AS had, CASE WHEN e.want < 0 THEN e.want ELSE greatest(0, least(e.want, 100 - s.every, 10 - coalesce(s.m[e.client], 0))) END AS granted
  FROM s JOIN e ON e.day = s.day AND e.n = s.n + 1))
SELECT day, seq, client, want, granted, mine AS client_calls, every AS global_calls FROM s WHERE n > 0""")
def budget_spend(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    want = F.when(F.col("event_type") == "refund", -2).otherwise((F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select(F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("client"), want.alias("want"))
    return archive.spend(rows, client_cap=10, global_cap=100)


@query("brief_lines", f"""WITH {_P}, d AS (SELECT max(briefed_on) AS d FROM i), s AS (SELECT i.* FROM i, d WHERE briefed_on = d), o AS (SELECT * FROM i WHERE briefed_on IS NULL),
c AS (SELECT (SELECT count(*) FROM s) AS n, (SELECT count(*) FROM o) AS m, (SELECT count(*) FROM o WHERE relevant) AS r, (SELECT d FROM d) AS d)
SELECT 0 AS section, CAST(0 AS BIGINT) AS pos, '# Papers of ' || CAST(d AS VARCHAR) || chr(10) || chr(10) || 'chosen: ' || n || ', judged: ' || (n + m) || ', relevant: ' || (n + r) AS line FROM c
UNION ALL SELECT 1, row_number() OVER (ORDER BY importance DESC NULLS LAST, cite_key), '## ' || row_number() OVER (ORDER BY importance DESC NULLS LAST, cite_key) || ' Paper ' || cite_key || chr(10) || '- claim: not said' || chr(10) || '- stakes: not said' || chr(10) || '- connection: not said' || chr(10) || '- verdict: skim' || chr(10) || '- https://arxiv.org/abs/2401.' || cite_key FROM s
UNION ALL SELECT 2, 0, '# Set aside: ' || m FROM c
UNION ALL SELECT 3, row_number() OVER (ORDER BY relevant DESC NULLS LAST, importance DESC NULLS LAST, cite_key), '* Paper ' || cite_key || CASE WHEN relevant THEN ' (relevant)' ELSE '' END || ': ' || filter_reason || ' https://arxiv.org/abs/2401.' || cite_key FROM o""")
def brief_lines(spark, sf_dir):
    papers = _important(spark, sf_dir).withColumns({c: F.lit(None).cast("string") for c in ("claim", "stakes", "connection", "verdict")})
    day = papers.agg(F.max("briefed_on")).first()[0]
    return render.brief(papers, str(day))


@query("rss_guids", f"WITH {_ITEMS} SELECT id, slug || ':' || CAST(date AS VARCHAR) || ':' || id AS guid FROM it")
def rss_guids(spark, sf_dir):
    return _items(spark, sf_dir).select("id", render.guid(F.col("slug"), F.col("date").cast("string"), F.col("id")).alias("guid"))


@query("rss_items")
def rss_items(spark, sf_dir):
    shipped = gate.select(_graded(spark, sf_dir), GATE, "vec_id", ["label"])
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("abstract"))
    items = shipped.join(docs, "vec_id", "left").select(
        F.concat(F.lit("night-"), "label").alias("slug"), F.lit("2026-01-01").alias("day"), F.col("vec_id").cast("string").alias("id"), F.lit("").alias("title"), F.concat(F.lit("https://example.org/"), "vec_id").alias("link"),
        "grade", "z", "band", F.lit("row-0").alias("label"), F.lit("").alias("authors"), F.coalesce("abstract", F.lit("")).alias("abstract"),
    )
    return render.rss(items, "https://example.org/")


@query("dialogue_openers", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, role, sha256(trim(regexp_replace(coalesce(text, ''), '" + _WS + "', ' ', 'g'))) AS sha FROM r WHERE n = 1")
def dialogue_openers(spark, sf_dir):
    return store.latest(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn")]).select("conv_id", "role", text.text_sha(F.col("text")).alias("sha"))


# texts that are made of the rows' own values, so that the SQL says what must come out


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text")


def _said(*parts: str | F.Column) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_ID5 = "lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0')"


@query("bare_ids", f"SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'cond-mat/05' ELSE '2401.' END || {_ID5} AS bare, '2401.' || {_ID5} AS linked FROM documents")
def bare_ids(spark, sf_dir):
    five = F.lpad((F.col("doc_id") % 100_000).cast("string"), 5, "0")
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 0, _said("https://arxiv.org/abs/2401.", five, "v12")).when(kind == 1, _said(" arXiv:2401.", five)).otherwise(_said("cond-mat/05", five, "v1"))
    return _docs(spark, sf_dir).select("doc_id", text.bare_arxiv_id(raw).alias("bare"), text.linked_arxiv_id(_said("http://export.example.org/x/abs/2401.", five, "v3")).alias("linked"))


@query("cite_keys", "SELECT o_orderkey, 'Munoz' || CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE '' END || '_2401.' || o_orderkey AS cite_key FROM orders")
def cite_keys(spark, sf_dir):
    day = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate").cast("string")).otherwise("unknown")
    names = F.array(F.lit("Ana de MUÑOZ"), F.lit("Someone Else"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.cite_key(names, day, _said("arXiv:2401.", F.col("o_orderkey").cast("string"), "v2")).alias("cite_key"))


#: Forms of a reference by (doc_id + place) mod 10: what is written around the numbers, and the DOI and archive id in it.
_FORMS = (
    (r"A. One, J. Sc. 12 (1999), doi:10.1000/ABC.{id}.", "10.1000/abc.{id}", None), ("B. Two, arXiv:2401.{five}v2, 2024", None, "2401.{five}"),
    ("C. Three, cond-mat/0{six}.", None, "cond-mat/0{six}"), (r"\href{https://doi.org/10.1103/PhysRevA.{id}.1}{D. Four}", "10.1103/physreva.{id}.1", None),
    (r"E. Five, \url{http://arxiv.org/abs/quant-ph/9{six}}", None, "quant-ph/9{six}"), ("F. Six, https://dx.doi.org/10.1016/S0{id}(99)1-2;", "10.1016/s0{id}(99)1-2", None),
    ("G. Seven, https://arxiv.org/pdf/2402.{five}", None, "2402.{five}"), ("H. Eight, p. 2401.{five}, no id, 10.99/{id}, 110.1000/{id}", None, None),
    ("I. Nine [math.GT/0{six}], arXiv: 2403.{five}", None, "2403.{five}"), (r"\href{https://arxiv.org/abs/math.AG/0{six}v1}{x}", None, None),
)


def _form(k: int) -> str:
    """A column of the forms as SQL: which one a row has, with its numbers filled in."""
    number = {"id": "CAST(doc_id AS VARCHAR)", "five": "lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0')", "six": "lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0')"}
    cases = []
    for i, form in enumerate(_FORMS):
        if form[k] is not None:
            value = f"'{form[k]}'"
            for name, sql in number.items():
                value = value.replace("{" + name + "}", f"' || {sql} || '")
            cases.append(f"WHEN {i} THEN {value}")
    return f"CASE (doc_id + ref_pos) % {len(_FORMS)} {' '.join(cases)} END"


@query("bibliography_entries", f"SELECT doc_id, ref_pos, {_form(1)} AS ref_doi, {_form(2)} AS ref_arxiv FROM documents, (SELECT unnest([0, 1, 2]) AS ref_pos)")
def bibliography_entries(spark, sf_dir):
    numbers = {"id": F.col("id"), "five": F.lpad((F.col("doc_id") % 10**5).cast("string"), 5, "0"), "six": F.lpad((F.col("doc_id") % 10**6).cast("string"), 6, "0")}

    def written(form: str):
        out = F.lit(form)
        for name, value in numbers.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out

    forms = F.array(*(written(form) for form, _, _ in _FORMS))
    items = [F.concat(F.lit(rf" \bibitem{{r{k}}} "), F.get(forms, ((F.col("doc_id") + k) % len(_FORMS)).cast("int"))) for k in range(3)]
    works = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit(r"\begin{x}{99}"), *items).alias("source"))
    return feeds.references(works, "doc_id").select("doc_id", "ref_pos", "ref_doi", "ref_arxiv")


@query("typed_entries", "SELECT item_id, CASE WHEN k = 0 THEN 'A {nested} title ' || item_id ELSE 'Second ' || item_id END AS ref_title, CASE WHEN k = 0 THEN '10.1000/x' || item_id END AS ref_doi FROM benchmark, (SELECT unnest([0, 1]) AS k)")
def typed_entries(spark, sf_dir):
    own = F.col("item_id").cast("string")
    source = _said("@article{a, booktitle = {None}, title = {A {nested}\n title ", own, "}, doi = {10.1000/X", own, "}}\n@misc{b,\n title=\"Second ", own, "\", year=2001}")
    works = table(spark, sf_dir, "benchmark").select("item_id", source.alias("source"))
    return feeds.references(works, "item_id").select("item_id", "ref_title", "ref_doi")


@query("bib_doi_lists", "SELECT item_id, '10.5/' || item_id || ' ' || '10.6/' || item_id AS dois, 'x.' || item_id AS cleaned FROM benchmark")
def bib_doi_lists(spark, sf_dir):
    own = F.col("item_id").cast("string")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.bib_dois(_said("doi = {10.5/", own, "}, DOI={ 10.6/", own, " }, doi={10.}")), " ").alias("dois"), text.clean_doi(_said("X.", own, ".,;)}]\"'")).alias("cleaned"))


@query("tex_letters", r"SELECT doc_id, 'Schrödinger und Łódź ' || doc_id || ': αβ-Zerfall, 90° \unknown' AS plain, 'E. van Strasse-' || doc_id AS short FROM documents")
def tex_letters(spark, sf_dir):
    markup = _said(r'Schr\"{o}dinger und \L ', r"\'od\'z ", F.col("id"), r": {\alpha}\beta-Zerfall, 90{\deg} \unknown")
    name = _said(r"\'Eva van Stra{\ss}e-", F.col("id"))
    return _docs(spark, sf_dir).select("doc_id", text.de_latex(markup).alias("plain"), text.short_author(name).alias("short"))


@query("author_lists", "SELECT c_custkey, 'J.-P. van ' || c_name || ', A. B. ' || c_name AS authors FROM customer")
def author_lists(spark, sf_dir):
    both = F.array(_said("Jean-Pierre van ", F.col("c_name")), F.lit(None).cast("string"), _said(F.col("c_name"), ", Ana B."))
    return table(spark, sf_dir, "customer").select("c_custkey", text.short_authors(both).alias("authors"))


@query("announced_abstracts", f"SELECT doc_id, sha256({_COLLAPSED}) AS sha, sha256(trim(regexp_replace('Title ' || doc_id || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'Title ' || doc_id ELSE 'body' END, ' +', ' ', 'g'))) AS embed_sha FROM documents")
def announced_abstracts(spark, sf_dir):
    title = _said("Title ", F.col("id"))
    body = F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise("body")
    announced = _said("arXiv:2401.00001 Announce Type: new\nAbstract: ", F.coalesce("text", F.lit("")))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.abstract_of(announced), 256).alias("sha"), F.sha2(text.embed_text(title, body), 256).alias("embed_sha"))


@query("json_lists", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a|' || doc_id WHEN 1 THEN 'not json ' || doc_id WHEN 2 THEN CAST(doc_id AS VARCHAR) WHEN 3 THEN '' ELSE '[broken ' || doc_id END AS items FROM documents")
def json_lists(spark, sf_dir):
    kind, own = F.col("doc_id") % 5, F.col("id")
    raw = F.when(kind == 0, _said('["a", "', own, '"]')).when(kind == 1, _said("not json ", own)).when(kind == 2, own).when(kind == 4, _said("[broken ", own))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.json_list(raw), "|").alias("items"))


@query("rebuilt_abstracts", f"SELECT doc_id, sha256({_COLLAPSED}) AS sha FROM documents WHERE {_COLLAPSED} <> ''")
def rebuilt_abstracts(spark, sf_dir):
    index = _docs(spark, sf_dir).select("doc_id", text.invert_abstract(text.collapse(F.coalesce("text", F.lit("")))).alias("index"))
    sha = F.sha2(text.rebuild_abstract(F.col("index")), 256)
    # an empty text is told by its digest in the lambda, so that a text is rebuilt once and not again for a filter
    found = index.select("doc_id", F.explode(F.array(sha)).alias("sha"))
    return found.where(F.col("sha") != F.sha2(F.lit("").cast("binary"), 256))


@query("vector_codec", "SELECT vec_id, 64 AS floats, true AS same, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(1, 65), lambda x: CAST(x AS DOUBLE))), 6) AS cosine FROM embeddings")
def vector_codec(spark, sf_dir):
    packed = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.pack_vector(F.col("embedding")).alias("data"))
    back = vectors.unpack_vector(F.unbase64(vectors.hex_to_base64(vectors.base64_to_hex(F.base64("data")))))
    ramp = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: x.cast("double"))
    return packed.select("vec_id", vectors.floats_in(F.col("data")).alias("floats"), (back == F.col("embedding")).alias("same"), F.round(vectors.cosine(vectors.doubles(F.col("embedding")), ramp), 6).alias("cosine"))


@query("snapshot_ages", "SELECT o_orderkey, CAST(DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS INTEGER) AS age, CASE WHEN DATE '1999-01-01' - CAST(o_orderdate AS DATE) > 1500 THEN 'the corpus is ' || (DATE '1999-01-01' - CAST(o_orderdate AS DATE)) || ' days old' END AS warning, CAST(CAST(o_orderdate AS DATE) - 30 AS DATE) AS cutoff FROM orders")
def snapshot_ages(spark, sf_dir):
    day, today = F.to_date("o_orderdate"), F.lit("1999-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.snapshot_age(day, today).alias("age"), dates.staleness(day, today, 1500).alias("warning"), dates.retention_cutoff(day, 30).alias("cutoff"))


@query("build_dates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 1 AS built FROM orders")
def build_dates(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", dates.build_date(F.lit(" "), F.date_format("day", "EEE, dd MMM yyyy '22:30:00 -0400'")).alias("built"))


@query("short_numbers", r"SELECT vec_id, regexp_replace(regexp_replace(printf('%.2f', round(CAST(embedding[1] AS DOUBLE) * 8, 2) + 0.0), '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS z FROM embeddings")
def short_numbers(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", render.short_number(F.get("embedding", F.lit(0)).cast("double") * 8).alias("z"))


@query("cached_vectors_pruned", "SELECT user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) - 3 FROM events) GROUP BY user_id")
def cached_vectors_pruned(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("seen_at", F.to_date("ts"))
    newest = events.agg(F.max("seen_at")).first()[0]
    kept = store.cache_prune(events, dates.retention_cutoff(F.lit(newest), 3))
    return kept.groupBy("user_id").agg(F.count("*").alias("n"))


@query("cache_touched", "WITH h AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'click') SELECT event_id, CASE WHEN user_id IN (SELECT k FROM h) THEN DATE '2030-01-01' ELSE CAST(ts AS DATE) END AS seen_at FROM events")
def cache_touched(spark, sf_dir):
    cache = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("text_sha"), F.to_date("ts").alias("seen_at"), "event_type")
    return store.cache_touch(cache, cache.where("event_type = 'click'"), F.lit("2030-01-01").cast("date")).select("event_id", "seen_at")


@query("parents_without_children", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def parents_without_children(spark, sf_dir):
    return store.has_children(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", False).select("c_custkey")


@query("status_patch", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'ranked' ELSE 'new' END AS status FROM orders")
def status_patch(spark, sf_dir):
    papers = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit("new").alias("status"))
    return store.set_status(papers, papers.where("o_totalprice > 150000"), "ranked", "o_orderkey").select("o_orderkey", "status")


@query("latest_summaries", "SELECT o_custkey, max(o_orderdate) AS created_at FROM orders GROUP BY o_custkey")
def latest_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cite_key"), F.lit("").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_clerk" if "o_clerk" in table(spark, sf_dir, "orders").columns else "o_orderstatus").alias("llm_model"))
    return store.latest_summary(rows).select(F.col("cite_key").alias("o_custkey"), "created_at")


@query("resolved_works", "SELECT p_partkey AS cite_key, 'W' || p_partkey AS openalex_id FROM part WHERE p_partkey % 2 = 0")
def resolved_works(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cite_key"), _said("https://doi.org/10.7/P", F.col("p_partkey").cast("string")).alias("doi"))
    works = parts.where("cite_key % 2 = 0").select(_said("W", F.col("cite_key").cast("string")).alias("openalex_id"), F.upper("doi").alias("doi"))
    return match.resolve_by_doi(parts, works.withColumn("doi", F.replace("doi", F.lit("HTTPS://DOI.ORG/"), F.lit("doi:")))).select("cite_key", "openalex_id")


@query("scite_counts", "SELECT o_orderkey AS arxiv_id, CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS BIGINT) END AS scites FROM orders")
def scite_counts(spark, sf_dir):
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("arxiv_id"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").cast("long").alias("scites"))
    return match.scites(papers.select("arxiv_id"), papers.where("s = 'F'")).select("arxiv_id", "scites")


@query("category_names", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'Quantum physics' ELSE 'cat-' || (s_nationkey % 3) END AS name FROM supplier")
def category_names(spark, sf_dir):
    code = _said("cat-", (F.col("s_nationkey") % 3).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", match.category_name(code, {"cat-0": "Quantum physics"}).alias("name"))


@query("verdict_words", "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'other' END AS role FROM conversations")
def verdict_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rank.verdict(F.col("role"), ("user", "assistant"), "other").alias("role"))


@query("haul_counts", "SELECT count(*) FILTER (event_type = 'click') AS \"new\", 0 AS \"cross\", count(*) FILTER (event_type = 'view') AS earlier, count(*) FILTER (user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')) AS cached, count(*) AS total FROM events")
def haul_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "new").when(F.col("event_type") == "view", "earlier").otherwise("other")
    stones = events.select(kind.alias("announce"), F.col("user_id").alias("text_sha"))
    return archive.haul_breakdown(stones, events.where("event_type = 'purchase'").select(F.col("user_id").alias("text_sha")))


@query("slug_suffixes", "SELECT event_id, event_type || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS slug FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)")
def slug_suffixes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("slug"))
    return archive.unique_slugs(rows, order="event_id").select("event_id", "slug")


@query("drifted_slugs", "SELECT CAST(c_custkey AS VARCHAR) AS slug, 'directory' AS only_in FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'x', 'manifest'")
def drifted_slugs(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("slug"))
    listed = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("slug")).distinct().unionByName(spark.createDataFrame([("x",)], "slug string"))
    return archive.drift(own, listed)


@query("cited_titles", "SELECT o_custkey, least(count(*), 8) AS shown, greatest(count(*) - 8, 0) AS more FROM orders GROUP BY o_custkey")
def cited_titles(spark, sf_dir):
    cited = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("cited"))
    said = providers.connection_prompt(F.col("cited"))
    more = F.coalesce(F.nullif(F.regexp_extract(said, r"and (\d+) more$", 1), F.lit("")).cast("long"), F.lit(0))
    return cited.select("o_custkey", F.regexp_count(said, F.lit(r"(?m)^- \d+$")).cast("long").alias("shown"), more.alias("more"))


@query("hourly_meter", """WITH RECURSIVE e AS (SELECT user_id AS client, event_id AS seq, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS t, event_id % 3 + 1 AS want, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(CAST(ts AS TIMESTAMP))), event_id) AS n FROM events),
s AS (SELECT client, seq, n, t AS opened, want AS used, true AS allowed FROM e WHERE n = 1
UNION ALL SELECT client, seq, n, opened, CASE WHEN had + want <= 4 THEN had + want ELSE had END, had + want <= 4 FROM (
  SELECT e.*, CASE WHEN e.t >= s.opened + 86400 THEN e.t ELSE s.opened END AS opened, CASE WHEN e.t >= s.opened + 86400 THEN 0 ELSE s.used END AS had FROM s JOIN e ON e.client = s.client AND e.n = s.n + 1))
SELECT seq, allowed, CAST(used AS BIGINT) AS used FROM s""")
def hourly_meter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("at"), (F.col("event_id") % 3 + 1).alias("want"))
    return archive.hourly(rows, 4, 86_400).select("seq", "allowed", "used")


@query("group_counts", f"WITH s AS (SELECT label, vec_id % 37 AS root, count(*) AS n FROM embeddings GROUP BY ALL) SELECT label, count(*) FILTER (n >= {cluster.LEAST}) AS clusters, CAST(coalesce(sum(n) FILTER (n >= {cluster.LEAST}), 0) AS BIGINT) AS placed, coalesce(max(n) FILTER (n >= {cluster.LEAST}), 0) AS largest, CAST(sum(n) AS BIGINT) AS total FROM s GROUP BY label")
def group_counts(spark, sf_dir):
    return cluster.group_counts(table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 37).alias("root")), ["label"])


@query("cluster_names", "WITH s AS (SELECT label, vec_id, round(CAST(embedding[1] AS DOUBLE), 3) AS s FROM embeddings) SELECT label, arg_min(vec_id, struct_pack(a := -s, b := vec_id)) AS center, count(*) AS n, CASE WHEN label % 2 = 0 THEN 'name ' || label ELSE 'Cluster ' || label END AS said FROM s GROUP BY label")
def cluster_names(spark, sf_dir):
    scored = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("sum"))
    groups = cluster.center_of(scored, "label", "vec_id").withColumn("number", F.col("label"))
    reply = F.to_json(F.array(F.struct(F.col("label").alias("group"), F.when(F.col("label") % 2 == 0, _said("name ", F.col("label").cast("string"))).otherwise("").alias("name"), F.lit("g").alias("gloss")), F.struct(F.col("label").alias("group"), F.lit("late").alias("name"), F.lit("").alias("gloss"))))
    answers = groups.select(F.posexplode(providers.names(F.when(F.col("label") % 2 == 0, reply).otherwise("broken"))).alias("pos", "r")).select("pos", "r.*")
    named = providers.named_groups(groups, answers)
    return named.select("label", "center", "n", providers.cluster_label(F.col("name"), F.col("number")).alias("said"))


@query("enrichment_checks", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{providers.VERDICTS[0]}' ELSE '' END AS verdict, CASE WHEN doc_id % 3 = 2 THEN '' ELSE 'head ' || doc_id END AS headline, CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'a b|c' END AS tools FROM documents WHERE doc_id % 4 <> 3")
def enrichment_checks(spark, sf_dir):
    kind, own = F.col("doc_id") % 3, F.col("id")
    verdict = F.when(kind == 0, f" {providers.VERDICTS[0].upper()} ").otherwise("nonsense")
    reply = _said('{"verdict": "', verdict, '", "headline": "', F.when(kind == 2, "").otherwise(_said(" head  ", own)), '", "tools": ', F.when(kind == 1, "[]").otherwise('["a  b", " ", "c"]'), "}")
    empty = F.when(F.col("doc_id") % 8 == 3, "broken").when(F.col("doc_id") % 8 == 7, '{"verdict": "x", "headline": " "}').otherwise(reply)
    found = _docs(spark, sf_dir).select("doc_id", providers.enrichment(empty).alias("e")).where("e is not null")
    return found.select("doc_id", "e.verdict", "e.headline", F.array_join("e.tools", "|").alias("tools"))


@query("pruned_names", "WITH d AS (SELECT max(CAST(ts AS DATE)) AS d FROM events) SELECT count(*) FILTER (CAST(ts AS DATE) >= d - 60) AS names, count(*) FILTER (CAST(ts AS DATE) >= d - 7) AS meters, count(*) FILTER (CAST(ts AS DATE) >= d - 5) AS enrichments FROM events, d")
def pruned_names(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("seen"), F.to_date("ts").alias("day"))
    today = F.lit(rows.agg(F.max("day")).first()[0])
    names, meters = archive.prune_names(rows.select("seen"), rows.select("day"), today)
    kept = archive.prune_enrichment(rows.select("seen"), today, 5)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(names, "names").crossJoin(count(meters, "meters")).crossJoin(count(kept, "enrichments"))


@query("client_hashes", "SELECT DISTINCT user_id, substr(sha256('salt' || user_id), 1, 32) AS hash FROM events")
def client_hashes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", text.client_hash("salt", F.col("user_id").cast("string")).alias("hash")).distinct()


@query("cacheable_rows", "SELECT event_id FROM events WHERE event_type <> 'click' OR user_id % 2 = 0")
def cacheable_rows(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "touchstone").otherwise("core")
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, "carry").alias("preset"))
    return claims.cacheable(rows).select("event_id")


@query("active_presets", "SELECT CASE WHEN count(DISTINCT event_type) = 1 THEN max(event_type) END AS preset, false AS edited FROM events")
def active_presets(spark, sf_dir):
    return claims.active_preset(table(spark, sf_dir, "events").select(F.col("event_type").alias("preset")))


@query("preset_rows", "SELECT 'f' || c_custkey AS slug, 0 AS row_idx, 'touchstone' AS kind, 'a ' || c_name AS said, CAST(2.5 AS DOUBLE) AS weight FROM customer UNION ALL SELECT 'f' || c_custkey, 2, 'core', 'doi:10.9/' || c_custkey, CAST(1 AS DOUBLE) FROM customer")
def preset_rows(spark, sf_dir):
    own = F.col("c_custkey").cast("string")
    raw = _said('{"name": "n", "touchstones": [{"text": " a ', F.col("c_name"), '", "weight": "2.5"}, {"text": " ", "weight": "1"}], "cores": [{"doi": "https://doi.org/10.9/', own, '", "weight": "x"}]}')
    claim = table(spark, sf_dir, "customer").select(_said("f", own).alias("slug"), F.from_json(raw, "struct<touchstones: array<struct<text: string, weight: string, preset: string>>, cores: array<struct<doi: string, weight: string>>>").alias("c"))
    found = feeds.units(claim.select("slug", "c.*"))
    return found.select("slug", "row_idx", "kind", F.coalesce("text", "doi").alias("said"), "weight")


@query("null_keys_upserted", "WITH c AS (SELECT DISTINCT CASE WHEN user_id % 5 > 0 THEN user_id END AS k FROM events) SELECT k, CASE WHEN k IS NULL OR k % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM c UNION ALL SELECT -1, 'new'")
def null_keys_upserted(spark, sf_dir):
    keys = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 5 > 0, F.col("user_id").cast("long")).alias("k")).distinct()
    patch = keys.where("k is null or k % 2 = 0").unionByName(spark.createDataFrame([(-1,)], "k long"))
    return store.upsert(keys.withColumn("v", F.lit("old")), patch.withColumn("v", F.lit("new")), ["k"])


# providers


@query("embedded_in_batches", "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents), k AS (SELECT *, n // (1 << list_min(list_filter(range(0, 31), lambda x: n // (1 << x) <= 500))) AS kept FROM d) SELECT doc_id, CAST(kept AS BIGINT) AS kept, CAST(CASE WHEN kept > 0 THEN unicode(text) ELSE -1 END AS BIGINT) AS head FROM k")
def embedded_in_batches(spark, sf_dir):
    """Texts sent to a provider that takes 8 texts, 500 characters of one and 2000 together."""
    made = providers.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), batching.Limited())
    return made.select("doc_id", F.get("vector", F.lit(0)).cast("long").alias("kept"), F.get("vector", F.lit(1)).cast("long").alias("head"))


# meters and streams


def _requests(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    want = F.when(F.col("event_type") == "refund", -2).otherwise(F.col("event_id") % 4 + 1)
    return e.select(F.col("user_id").cast("string").alias("client"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), want.cast("long").alias("want"))


_METERED = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id AS seq, CAST(CASE WHEN event_type = 'refund' THEN -2 ELSE event_id % 4 + 1 END AS BIGINT) AS want, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
s AS (SELECT client, seq, n, want, greatest(0, least(20, want)) AS used, CASE WHEN want < 0 THEN want ELSE greatest(0, least(20, want)) END AS granted FROM e WHERE n = 1
UNION ALL SELECT e.client, e.seq, e.n, e.want, greatest(0, least(20, s.used + e.want)), CASE WHEN e.want < 0 THEN e.want ELSE greatest(0, least(20, s.used + e.want)) - s.used END FROM s JOIN e ON e.client = s.client AND e.n = s.n + 1)
SELECT client, seq, want, CAST(granted AS BIGINT) AS granted, CAST(used AS BIGINT) AS used FROM s"""


@query("metered_in_parts", _METERED)
def metered_in_parts(spark, sf_dir):
    return meters.metered(_requests(spark, sf_dir).withColumn("at", F.unix_millis("ts")), 20)


@query("stream_meter", _METERED)
def stream_meter(spark, sf_dir):
    """The same requests as a stream of three nights and keyed state."""
    return ordered.nightly(_requests(spark, sf_dir), lambda s: ordered.meter(s, 20))


@query("stream_last_wanted", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) // 1000 AS t, event_id FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 172800000 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY client ORDER BY t, event_id)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY t, event_id) AS stretch FROM g) SELECT client, count(*) AS uses, min(t) AS first_ms, max(t) AS last_ms FROM k GROUP BY client, stretch""")
def stream_last_wanted(spark, sf_dir):
    """Stretches of use with less than two days between requests, from a stream of three nights."""
    return ordered.nightly(_requests(spark, sf_dir), lambda s: ordered.last_wanted(s, 172_800_000))


@query("stream_stages", "SELECT CAST(user_id AS VARCHAR) AS client, count(*) AS n, CAST(sum(event_id % 4 + 1) AS BIGINT) AS total FROM events WHERE event_type <> 'refund' GROUP BY 1")
def stream_stages(spark, sf_dir):
    """Two stages on a stream of three nights, with a ledger of what is done; the last stage's batches added up."""
    base = f"{folder(spark)}/skyloom/stages-{uuid.uuid4().hex}"
    stages = [("kept", lambda rows: rows.where("want > 0")), ("counted", lambda rows: rows.groupBy("client").agg(F.count("*").alias("n"), F.sum("want").alias("total")))]
    requests = _requests(spark, sf_dir)
    for night in range(3):
        requests.where(F.pmod(F.to_date("ts").cast("timestamp").cast("long") / 86_400, F.lit(3)) == night).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(requests.schema).parquet(f"{base}/in")
        incremental.run_available(stream, f"{base}/checkpoint", ledger.staged(f"{base}/out", "nightly", stages))
    return ledger.result(spark, f"{base}/out", "counted").groupBy("client").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


# a paged search


@query("paged_search", f"SELECT lang AS category, CAST(doc_id AS VARCHAR) AS arxiv_id, DATE '2026-08-17' - CAST(doc_id % 30 AS INTEGER) AS published, sha256({_COLLAPSED}) AS sha FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 30 <= 12 AND {_COLLAPSED} <> ''")
def paged_search(spark, sf_dir):
    """Documents served as a search by language, newest first (a page is a part of a day), and read back from a first date on."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and doc_id is not null")
    back, parts = (F.col("doc_id") % 30).cast("int"), 8
    page = back * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    rows = docs.select(F.col("lang").alias("category"), page.alias("page"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.lit("A title").alias("title"), F.coalesce("text", F.lit("")).alias("summary"), F.date_sub(F.lit("2026-08-17").cast("date"), back).alias("published"), F.lit("A. One").alias("author"))
    path = f"{folder(spark)}/skyloom/search-{uuid.uuid4().hex}"
    search.write_pages(rows, path)
    found = search.search(spark, path, since="2026-08-05").where(F.col("category").isin("en", "fr"))
    return found.select("category", "arxiv_id", "published", F.sha2("abstract", 256).alias("sha"))
