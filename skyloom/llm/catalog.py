"""Queries of the operators in this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_lm_scoring, op2_language, op3_packing, op4_bpe, op5_minhash, op6_secrets, op7_topk, op8_token_counts, op9_fingerprints, op10_url_filter, op11_windows, op12_pii, op13_whitening

#: Rules of the URL filter: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_lm_scoring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op1_lm_scoring.score(table(spark, sf_dir, "documents"), order=3, least=2)
    by_order = [F.get("n_by_order", F.lit(n)).alias(f"n_order_{n + 1}") for n in range(3)]
    return scored.select("doc_id", "n_words", "score_micro", *by_order, F.round("lm_score", 9).alias("lm_score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = op2_language.learn(docs.where(~held_out(F.col("doc_id"))))
    found = op2_language.language(model, F.col("text"))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = op4_bpe.encode(table(spark, sf_dir, "documents"), path, pattern)
    decoded = op4_bpe.decode(encoded, path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = op6_secrets.scan(docs, op6_secrets.learn(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    line = lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))
    base = F.array_join(F.transform(F.filter("spans", lambda s: s.kind.isin(*op6_secrets.BASE)), line), ",")
    every = F.array_join(F.transform("spans", line), ",")
    return found.select("doc_id", *map(count, op6_secrets.BASE), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op9_fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return op10_url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op11_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("doc_id").cast("string")
    event_s = 60 * F.floor((F.col("doc_id") + F.crc32(text.cast("binary")) % 4000) / F.lit(6))
    docs = table(spark, sf_dir, "documents")
    return op11_windows.window_features(docs, event_s, F.col("source"), F.char_length("text"), F.col("lang"), [3600, 21600], {"median_chars": 50, "high_chars": 75})


def op12_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op12_pii.scan(table(spark, sf_dir, "documents"), op12_pii.fit(spark))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(op12_pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(op12_pii.listed(F.col("base")), 256).alias("base_sha256"), op12_pii.listed(F.col("spans")).alias("spans"))


def op13_whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_lm_scoring": op1_lm_scoring_query,
        "op2_language_id": op2_language_id,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_minhash_dedup": op5_minhash_dedup,
        "op6_secret_scan": op6_secret_scan,
        "op7_exact_topk": op7_exact_topk,
        "op8_token_counts": op8_token_counts_query,
        "op9_fingerprints": op9_fingerprints_query,
        "op10_url_filters": op10_url_filters,
        "op11_window_features": op11_window_features,
        "op12_pii_scan": op12_pii_scan,
        "op13_whitening": op13_whitening_query,
    }


_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT row_no, unnest(w) AS w3, unnest(range(1, len(w) + 1)) AS i FROM docs),
hist AS (SELECT row_no, i, w3, lag(w3, 1) OVER o AS w2, lag(w3, 2) OVER o AS w1 FROM words WINDOW o AS (PARTITION BY row_no ORDER BY i)),
counted AS (SELECT *, count(*) OVER () AS n, count(*) OVER (PARTITION BY w3) AS c1,
  CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY w2, w3) END AS c2,
  CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY w1, w2, w3) END AS c3 FROM hist),
past AS (SELECT *, lag(c1) OVER o AS h1, lag(c2) OVER o AS h2 FROM counted WINDOW o AS (PARTITION BY row_no ORDER BY i)),
scored AS (SELECT row_no,
  CASE WHEN i >= 3 AND c3 >= 2 THEN 3 WHEN i >= 2 AND c2 >= 2 THEN 2 ELSE 1 END AS used,
  CASE WHEN i >= 3 AND c3 >= 2 THEN round(1e6 * ln(c3 / h2))
       WHEN i >= 2 AND c2 >= 2 THEN round(1e6 * ln(c2 / h1)) + (least(i, 3) - 2) * round(1e6 * ln(0.4))
       ELSE round(1e6 * ln(c1 / n)) + (least(i, 3) - 1) * round(1e6 * ln(0.4)) END AS micro FROM past),
summed AS (SELECT row_no, sum(micro) AS micro, count(*) FILTER (used = 1) AS n1, count(*) FILTER (used = 2) AS n2, count(*) FILTER (used = 3) AS n3
  FROM scored GROUP BY row_no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(micro, 0) AS BIGINT) AS score_micro, CAST(coalesce(n1, 0) AS BIGINT) AS n_order_1,
  CAST(coalesce(n2, 0) AS BIGINT) AS n_order_2, CAST(coalesce(n3, 0) AS BIGINT) AS n_order_3,
  CASE WHEN len(w) > 0 THEN round(CAST(micro AS DOUBLE) / 1e6 / len(w), 9) END AS lm_score
FROM docs LEFT JOIN summed USING (row_no)
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q, v c WHERE c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10_SQL = f"""
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {_ASCII}) AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fits AS (SELECT *, (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' AS a,
  (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' AS b,
  (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' AS c,
  (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' AS d FROM split)
SELECT page_id, host, path,
  CASE WHEN b THEN 'example.net/en/' WHEN c THEN 'example.com/de/' WHEN d THEN 'org/fr/' WHEN a THEN 'net/' END AS rule,
  CASE WHEN b OR c OR d THEN CASE WHEN c THEN 'block' ELSE 'allow' END WHEN a THEN 'block' ELSE 'allow' END AS verdict
FROM fits
"""

# the checksum goes byte by byte: eight shifts of what is left, with the polynomial where a one falls out
_SHIFT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
OP11_SQL = f"""
WITH RECURSIVE shifted(k, n, c) AS (SELECT k, 0, k FROM range(256) AS r(k) UNION ALL SELECT k, n + 1, {_SHIFT.format("c")} FROM shifted WHERE n < 8),
steps AS (SELECT list(c ORDER BY k) AS tab FROM shifted WHERE n = 8),
docs AS (SELECT row_number() OVER () AS row_no, doc_id, source, lang, CAST(length(text) AS BIGINT) AS len,
  xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS INTEGER)]))) AS h FROM documents, steps),
timed AS (SELECT row_no, doc_id, source, lang, len, 60 * ((doc_id + h % 4000) // 6) AS event_s FROM docs),
pairs AS (SELECT a.row_no, w.window_s, b.row_no AS other, b.len, b.lang FROM timed a, (VALUES (3600), (21600)) AS w(window_s), timed b
  WHERE a.source IS NOT DISTINCT FROM b.source AND b.event_s >= a.event_s - w.window_s AND b.event_s < a.event_s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_no, window_s ORDER BY len) AS place, count(len) OVER (PARTITION BY row_no, window_s) AS m FROM pairs WHERE len IS NOT NULL),
ranks AS (SELECT row_no, window_s, sum(len) AS total, max(len) FILTER (place = (m + 1) // 2) AS median_chars, max(len) FILTER (place = (75 * m + 99) // 100) AS high_chars
  FROM ranked GROUP BY row_no, window_s),
asked AS (SELECT row_no, doc_id, event_s, window_s FROM timed, (VALUES (3600), (21600)) AS w(window_s)),
counted AS (SELECT row_no, window_s, count(*) AS n, count(DISTINCT lang) AS langs FROM pairs GROUP BY row_no, window_s)
SELECT doc_id, CAST(window_s AS BIGINT) AS window_s, CAST(event_s AS BIGINT) AS event_s, CAST(coalesce(n, 0) AS BIGINT) AS n_events,
  CAST(coalesce(total, 0) AS BIGINT) AS sum_chars, CAST(coalesce(langs, 0) AS BIGINT) AS n_langs, median_chars, high_chars
FROM asked LEFT JOIN counted USING (row_no, window_s) LEFT JOIN ranks USING (row_no, window_s)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": OP1_SQL, "op7_exact_topk": OP7_SQL, "op10_url_filters": OP10_SQL, "op11_window_features": OP11_SQL}
