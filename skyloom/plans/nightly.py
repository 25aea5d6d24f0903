"""A nightly run over stored tables: chosen stages, each written as a new version before the next one reads it.

A stage that has nothing to do, or was done, changes nothing, so a run that died is run again. Only a full run prunes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import store
from ..sources import search
from ..streaming.ledger import MARK
from . import providers, render
from .settings import Settings, SettingsError

STAGES = ("scout", "summarize", "filter", "rank", "brief")
PAPERS = (
    "cite_key string, arxiv_id string, title string, authors array<string>, published date, primary_category string, abstract string, summary string, research_question string, contribution string, "
    "topics array<string>, relevance_score double, relevant boolean, filter_reason string, scites int, centrality double, cited_in_corpus array<string>, importance double, claim string, stakes string, "
    "connection string, verdict string, briefed_on date, status string"
)
RUNS = "run_id long, started string, topics string, n_scraped long, n_relevant long, n_briefed long"
SYSTEM = {
    "summarize": "Summarise the paper as JSON with the fields summary, research_question and contribution.",
    "filter": "Decide whether the paper concerns one of the topics, as JSON with the fields relevant, score (0 to 1), matched (topics) and reason.",
    "brief": "Write a short pitch of the paper as JSON with the fields claim, stakes, connection and verdict (read, skim or skip).",
}


class Tables:
    """Tables of a folder in versions; the newest one that was written to its end counts."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _newest(self, name: str) -> int:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}/version=*/{MARK}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return max((int(s.getPath().getParent().getName().partition("=")[2]) for s in found or ()), default=0)

    def read(self, name: str, schema: str) -> DataFrame:
        newest = self._newest(name)
        if not newest:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/version={newest}")

    def write(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.base}/{name}/version={self._newest(name) + 1}")


def day_of(raw: str | None) -> dt.date:
    """A date as YYYY-MM-DD; today without one."""
    try:
        return dt.date.fromisoformat(raw) if raw else dt.datetime.now(dt.UTC).date()
    except ValueError:
        raise SettingsError(f"not a date (YYYY-MM-DD): {raw!r}") from None


def candidates(spark: SparkSession, settings: Settings, day: dt.date) -> DataFrame:
    """What the search has within the lookback, a paper of several categories once."""
    since = spark.range(1).select(dates.weekday_cutoff(F.lit(day), settings.scout.lookback_days).alias("d")).first().d
    found = search.search(spark, settings.scout.pages, categories=",".join(settings.scout.categories), since=since, max_results=settings.scout.max_results)
    once = store.latest(found, ["arxiv_id"], [F.array_position(F.array(*map(F.lit, settings.scout.categories)), F.col("category")), F.col("pos")])
    key = text.cite_key(F.col("authors"), F.col("published"), F.col("arxiv_id")).alias("cite_key")
    return once.select(key, "arxiv_id", "title", "authors", "published", "primary_category", "abstract", F.lit("new").alias("status"))


def chosen(stage: str | None, dry_run: bool = False) -> Sequence[str]:
    """All stages, or one; a dry run has the first one only."""
    if stage is not None and stage not in STAGES:
        raise SettingsError(f"no stage {stage!r}; there are: {', '.join(STAGES)}")
    if dry_run and stage not in (None, "scout"):
        raise SettingsError("a dry run is for scout only")
    return (stage,) if stage else STAGES


def run(spark: SparkSession, settings: Settings, base: str, day: dt.date, models: Mapping[str, providers.Model], stage: str | None = None) -> dict[str, int]:
    """Runs the stages for a day and returns the counts of the papers by status; ``models`` by role, light and heavy."""
    tables, today, stages = Tables(spark, base), F.lit(day), chosen(stage)
    runs, number = store.start_run(tables.read("runs", RUNS), day.isoformat(), ", ".join(settings.topics))
    counters: dict[str, int] = {}
    for name in stages:
        papers = tables.read("papers", PAPERS)
        if name == "scout":
            found = candidates(spark, settings, day)
            papers = store.insert_absent(papers, found, ["cite_key"], [F.desc_nulls_last("published"), F.col("title")])
        elif name == "summarize":
            papers = providers.summarize(papers, models["light"], SYSTEM[name])
        elif name == "filter":
            papers = providers.judge(papers, models["light"], SYSTEM[name], settings.topics)
        elif name == "rank":
            papers = providers.rank_stage(papers, settings.ranking.weights)
        else:
            papers = providers.pitch(papers, models["heavy"], SYSTEM[name], settings.ranking.top_n, today)
        columns = [c.strip().split(" ")[0] for c in PAPERS.split(", ")]
        tables.write("papers", papers.select(*columns))
        papers = tables.read("papers", PAPERS)
        if name == "scout":
            counters["n_scraped"] = papers.where("status = 'new'").count()
        elif name == "filter":
            counters["n_relevant"] = papers.where("status = 'filtered'").count()
        elif name == "brief":
            counters["n_briefed"] = papers.where(F.col("briefed_on") == today).count()
            tables.write(f"briefs/day={day}", render.brief_text(papers, day.isoformat()))
    if stage is None and settings.retention.enabled:
        papers = tables.read("papers", PAPERS)
        doomed = store.old_papers(papers, F.date_sub(today, settings.retention.days))
        tables.write("papers", store.prune({"papers": papers}, doomed, "cite_key")["papers"])
    tables.write("runs", store.finish_run(runs, number, **counters))
    return {r.status: r.n for r in store.status_counts(tables.read("papers", PAPERS)).collect()}
