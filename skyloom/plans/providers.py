"""Plug points for language models and embeddings, and the stages that call them.

A provider is any picklable object with ``complete(system, user) -> str`` (a JSON reply) or ``embed(texts) -> vectors``.
Calls run on the executors for whole Arrow batches; a failed call leaves its row as it was, so a stage can be run again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import rank, store
from . import batching

SUMMARY = "summary string, research_question string, contribution string"
RELEVANCE = "relevant boolean, score double, matched array<string>, reason string"
PITCH = "claim string, stakes string, connection string, verdict string"
ENRICHMENT = "verdict string, kind string, headline string, so_what string, caveat string, tools array<string>"
#: Texts of a request to an embedder that doesn't say how many it takes.
BATCH = 64
#: The version of cached enrichment records that is understood, and their closed sets of words.
SHAPE, VERDICTS, KINDS = 2, ("read", "skim", "skip"), ("theory", "experiment", "method", "review", "software", "data")


class Model(Protocol):
    def complete(self, system: str, user: str) -> str: ...


class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic embedder for tests and offline runs: signed hashes of words, at length 1."""

    def __init__(self, dim: int = 64, name: str = "hash"):
        self.dim, self.name = dim, name

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for word in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 40 & 1 else -1
        sizes = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(sizes > 0, sizes, 1)).tolist()


class Scripted:
    """A model for tests: replies by what the prompt contains."""

    def __init__(self, replies: dict[str, str], default: str = ""):
        self.replies, self.default = replies, default

    def complete(self, system: str, user: str) -> str:
        return next((reply for part, reply in self.replies.items() if part in user), self.default)


def ask(model: Model, system: str, user: Column, schema: str) -> Column:
    """The model's reply to each prompt as a struct; null where the call or its JSON fails."""

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            out = []
            for prompt in prompts:
                try:
                    out.append(model.complete(system, prompt))
                except Exception:  # noqa: BLE001  a provider's failure is a retry
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return F.from_json(call(user), schema)


def embed(rows: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "vector") -> DataFrame:
    """Adds a vector to each text, in requests of at most the embedder's ``batch`` texts (64 if it says none); a null text is empty.

    Requests refused as too long are cut and tried again (see ``batching``); a reply that doesn't fit its request raises.
    """

    @F.pandas_udf("array<double>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = batching.embedded(texts.fillna("").tolist(), embedder.embed, embedder.dim, getattr(embedder, "batch", BATCH))
            yield pd.Series(found, index=texts.index, dtype=object)

    return rows.withColumn(out, call(F.col(text_col)))


def vectorize(rows: DataFrame, cache: DataFrame, embedder: Embedder, day: Column, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows with vectors, cache first, and what is new for the cache; each distinct text is embedded once."""
    keyed = rows.withColumn("text_sha", text.text_sha(F.col(text_col)))
    hits = store.cache_lookup(keyed, cache, embedder.name, embedder.dim)
    missing = keyed.join(hits.where("vector is not null"), "text_sha", "left_anti").select("text_sha", F.col(text_col).alias("text")).dropDuplicates(["text_sha"])
    made = embed(missing, embedder).select("text_sha", F.lit(embedder.name).alias("model"), F.lit(embedder.dim).alias("dim"), "vector", day.alias("seen_at"))
    every = hits.where("vector is not null").select("text_sha", F.col("vector").cast("array<double>").alias("vector")).unionByName(made.select("text_sha", "vector"))
    return keyed.join(every, "text_sha"), made


def check_reply(reply: DataFrame, asked: int, model: str, dim: int) -> DataFrame:
    """Vectors of an embedding reply (``index, embedding, model``) in request order; duplicates, gaps, other models or lengths raise."""
    bad = F.count_if((F.col("model") != model) | (F.size("embedding") != dim))
    facts = reply.agg(F.count("*").alias("n"), F.countDistinct("index").alias("d"), bad.alias("bad")).first()
    if facts.n != asked or facts.d != asked or facts.bad:
        raise ValueError(f"bad embedding reply: {facts.n} vectors, {facts.d} places, {facts.bad} of another kind; {asked} were asked for")
    return reply.orderBy("index").select("index", "embedding")


def first_token(grid: Column) -> Column:
    """The vector of a grid of token vectors: the first token's, at length 1."""
    return vectors.unit(F.get(grid, F.lit(0)))


# stages


def summarize(papers: DataFrame, model: Model, system: str) -> DataFrame:
    """``new`` papers get a summary and move on; a failed call leaves them new."""
    said = ask(model, system, F.concat(F.lit("Title: "), "title", F.lit("\n\nAbstract: "), "abstract"), SUMMARY)
    done = papers.where("status = 'new'").withColumn("_r", said).where("_r.summary is not null")
    patch = done.select("cite_key", "_r.*", F.lit("summarized").alias("status"))
    return store.upsert(papers, patch, ["cite_key"], store.PAPER_COLUMNS)


def judge(papers: DataFrame, model: Model, system: str, topics: list[str]) -> DataFrame:
    """``summarized`` papers get a verdict on their relevance; only relevant ones move on."""
    said = ask(model, system, F.concat(F.lit("Topics: " + ", ".join(topics) + "\nTitle: "), "title", F.lit("\nSummary: "), "summary"), RELEVANCE)
    done = papers.where("status = 'summarized'").select("cite_key", "status", said.alias("_r")).where("_r.relevant is not null").select("cite_key", "status", "_r.*")
    patch = rank.relevance(done, topics).select("cite_key", "relevant", F.col("score").alias("relevance_score"), "topics", F.col("reason").alias("filter_reason"), "status")
    return store.upsert(papers, patch, ["cite_key"], store.PAPER_COLUMNS)


def rank_stage(papers: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``filtered`` papers get an importance and move on."""
    done = rank.importance(papers.where("status = 'filtered'"), weights)
    return store.upsert(papers, done.select("cite_key", "scites", "importance", F.lit("ranked").alias("status")), ["cite_key"], store.PAPER_COLUMNS)


def connection_prompt(cited: Column, most: int = 8) -> Column:
    """The library's papers that a paper cites: the first ones by title, and how many more."""
    shown = F.array_join(F.transform(F.slice(cited, 1, most), lambda t: F.concat(F.lit("- "), t)), "\n")
    more = F.when(F.size(cited) > most, F.concat(F.lit("\n- and "), (F.size(cited) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(F.coalesce(F.size(cited), F.lit(0)) > 0, F.concat(F.lit("Cites from the library:\n"), shown, more)).otherwise("No overlap with the library is known, which says nothing about a new preprint.")


def pitch(papers: DataFrame, model: Model, system: str, top_n: int, day: Column) -> DataFrame:
    """The most important unbriefed papers get a pitch and the day's stamp; the model sees only those."""
    chosen = rank.top_ranked(papers.where("status = 'ranked'"), top_n)
    prompt = F.concat(F.lit("Title: "), "title", F.lit("\nSummary: "), F.coalesce("summary", F.lit("")), F.lit("\n"), connection_prompt(F.col("cited_in_corpus")))
    done = chosen.withColumn("_r", ask(model, system, prompt, PITCH)).where("_r.claim is not null")
    patch = done.select("cite_key", "_r.claim", "_r.stakes", "_r.connection", rank.verdict(F.col("_r.verdict")).alias("verdict"), day.alias("briefed_on"), F.lit("briefed").alias("status"))
    return store.upsert(papers, patch, ["cite_key"], store.PAPER_COLUMNS)


def enrichment(reply: Column) -> Column:
    """A parsed enrichment; null if it says nothing. Unknown words of a closed set become empty."""
    r = F.from_json(reply, ENRICHMENT)
    words = lambda c, allowed: F.when(F.lower(F.trim(c)).isin(*allowed), F.lower(F.trim(c))).otherwise("")
    plain = lambda c: text.collapse(F.coalesce(c, F.lit("")))
    tools = F.filter(F.transform(F.coalesce(r.tools, F.array().cast("array<string>")), plain), lambda t: t != "")
    out = F.struct(words(r.verdict, VERDICTS).alias("verdict"), words(r.kind, KINDS).alias("kind"), plain(r.headline).alias("headline"), plain(r.so_what).alias("so_what"), plain(r.caveat).alias("caveat"), tools.alias("tools"))
    return F.when((out.headline != "") | (out.so_what != "") | (F.size(out.tools) > 0), out)


def enrich(items: DataFrame, cache: DataFrame, model: Model, system: str) -> DataFrame:
    """Adds ``enrichment`` to selected items: from the cache by id where its shape is current, else from the model; null on failure."""
    have = cache.where(F.col("shape") == SHAPE).select("arxiv_id", F.col("fields").alias("_have")).dropDuplicates(["arxiv_id"])
    both = items.join(have, "arxiv_id", "left")
    asked = both.where("_have is null").select("arxiv_id", "title", "abstract").dropDuplicates(["arxiv_id"])
    reply = ask(model, system, F.concat("title", F.lit("\n\n"), "abstract"), ENRICHMENT)
    new = asked.select("arxiv_id", enrichment(F.to_json(reply)).alias("_new"))
    return both.join(new, "arxiv_id", "left").withColumn("enrichment", F.coalesce("_have", "_new")).drop("_have", "_new")


def names(reply: Column) -> Column:
    """Names of groups in a reply: an array of (group, name, gloss), the first for a group; empty if the reply is broken."""
    return F.coalesce(F.from_json(reply, "array<struct<group: int, name: string, gloss: string>>"), F.array().cast("array<struct<group: int, name: string, gloss: string>>"))


def named_groups(groups: DataFrame, replies: DataFrame) -> DataFrame:
    """Groups (``number, cluster_key``) with names of a reply (``pos, group, name, gloss``); unknown groups are dropped, the first answer counts."""
    first = replies.where(F.coalesce("name", F.lit("")) != "").groupBy("group").agg(F.min_by("name", "pos").alias("name"), F.min_by("gloss", "pos").alias("gloss"))
    return groups.join(first.withColumnRenamed("group", "number"), "number", "left")


def cluster_label(name: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Cluster "), number.cast("string")))
