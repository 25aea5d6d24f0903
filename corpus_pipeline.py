"""A training-data pipeline over ``documents``: language ID, near-duplicates, secrets, packing.

Each stage works on all that the stage before it kept, written as Parquet and read again. The first three return the
columns of ``documents``; the last returns the packed pieces.

* language: documents without a language (null text, or none of its characters is a letter) go. If no row is labelled,
  no language can be told apart and all other texts stay.
* near duplicates: one document of each group of near copies stays, the one of the smallest id (of several texts of
  that id, the one of the least digest; of repeated rows, one); documents without words stay. Rows are told apart by id
  and text, so a repeated id loses only the texts that are near copies.
* secrets: spans are masked in the text, whose ``n_chars`` is counted again; no document goes.
* packing: whole texts as token sequences of 2048.

Null ids, extra columns, repeated rows and empty tables pass through every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.llm import op2_language, op3_packing, op5_minhash, op6_secrets
from skyloom.llm.storage import shared_dir, write_table

#: SQL can't express automata, minhash groups, a random field or token ids.
ORACLE_SQL = None


def names(docs: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``docs`` doesn't have, in any case."""
    have = {c.lower() for c in docs.columns}
    return [name for name in (f"_own_{k}" for k in range(n + len(have))) if name not in have][:n]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known, or that have a letter if there is no labelled row to learn from."""
    model = op2_language.learn(docs)
    if not model:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(op2_language.language(model, F.col("text")).getField("lang_pred") != op2_language.UNKNOWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, likeness 0.8 or more)."""
    digest, (text, gone_id, mark, number) = F.unhex(F.sha2("text", 256)), names(docs, 4)
    found = op5_minhash.near_duplicates(docs, shingle=5, percent=80, mark=digest)
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(gone_id), F.col("mark").alias(mark)).distinct()
    gone = write_table(gone, "gone")
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias(gone_id)).agg(F.count("*").alias(number)).where(F.col(number) > 1).drop(number)
    twice = write_table(twice, "twice")
    # rows of an id that occurs once are only tested; a text moves once, by the same plan whatever the number of decisions
    marked, same = docs.withColumn(text, digest), F.col("doc_id") == F.col(gone_id)
    out = gone.unionByName(twice.withColumn(mark, F.lit(None).cast("binary")))
    once = marked.join(out.hint("merge"), same & (F.col(mark).isNull() | (F.col(text) == F.col(mark))), "left_anti").drop(text)
    several = marked.join(twice, same, "left_semi").join(gone, same & (F.col(text) == F.col(mark)), "left_anti")
    first = Window.partitionBy("doc_id", text).orderBy(text)
    return once.unionByName(several.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number, text))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    at, new = names(docs, 2)
    found = docs.withColumn(at, op6_secrets.spans(op6_secrets.learn(docs), F.col("text")))
    out = found.withColumn(new, op6_secrets.masked(F.col("text"), F.col(at)))
    columns = {"text": F.col(new)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size(at) > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences."""
    return op3_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/skyloom/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
