"""A paged search as a Spark data source: newest first, a partition for each category and page, and none that can't matter.

Pages are Atom documents at ``{base}/category={category}/page={n}/``, in any store that Arrow opens; an absent page is empty. The categories asked
for (``=`` or ``IN``) and a first date (``published >=``) are pushed into the source: other categories' pages are never listed, and since results are
sorted by date, the pages from the first one that begins too early are never partitions. ``since`` does the same as an option that keeps
entries of unknown date, as a lookback does: a page is read up to its first entry that is older.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition

from ..functions import text

SCHEMA = "category string, pos long, id string, title string, summary string, published date, authors array<string>, primary_category string"
_ATOM, _ARXIV = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"


class Page(InputPartition):
    def __init__(self, category: str, number: int):
        self.category, self.number = category, number


class PagedSearch(DataSource):
    """Options: ``path``, ``categories`` (comma-separated; all without), ``since`` (a date), ``max_results`` and ``page_size`` (entries of a category, and of a page)."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"].rstrip("/"), int(options.get("page_size", 100))
        self.wanted = {c.strip() for c in options["categories"].split(",")} if options.get("categories") else None
        self.since = dt.date.fromisoformat(options["since"]) if options.get("since") else None
        self.first, self.most = self.since, int(options["max_results"]) if options.get("max_results") else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("category",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
                continue
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("published",):
                day = f.value if isinstance(f.value, dt.date) else dt.date.fromordinal(719163 + f.value)
                self.first = max(self.first or day, day)
            yield f  # Spark looks again

    def partitions(self) -> list[Page]:
        """Pages up to the first that begins before the first date; halving finds it, so few pages are opened here."""
        out = []
        for category, pages in sorted(self._listed().items()):
            lo, hi = 0, max(pages) + 1 if pages else 0
            if self.most is not None:
                hi = min(hi, -(-self.most // self.size))
            while self.first and lo < hi:
                middle = (lo + hi) // 2
                head = next((e for n in range(middle, -1, -1) for e in self._entries(category, n)), None)
                old = head is not None and head[5] is not None and head[5] < self.first
                lo, hi = (lo, middle) if old else (middle + 1, hi)
            out += [Page(category, n) for n in pages if n < hi]
        return out

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # there are no pages
            return
        for row in self._entries(partition.category, partition.number):
            if self.since and row[5] is not None and row[5] < self.since or self.most is not None and row[1] >= self.most:
                return
            yield row

    def _listed(self) -> dict[str, list[int]]:
        store, path = fs.FileSystem.from_uri(self.path)
        found: dict[str, list[int]] = {}
        for top in store.get_file_info(fs.FileSelector(path)):
            category = top.base_name.partition("category=")[2]
            if category and (self.wanted is None or category in self.wanted):
                inside = store.get_file_info(fs.FileSelector(top.path))
                found[category] = sorted(int(p.base_name.partition("page=")[2]) for p in inside if p.base_name.startswith("page="))
        return found

    def _entries(self, category: str, number: int) -> Iterator[tuple]:
        store, path = fs.FileSystem.from_uri(self.path)
        inside = store.get_file_info(fs.FileSelector(f"{path}/category={category}/page={number}", allow_not_found=True))
        at = number * self.size
        for file in sorted((f.path for f in inside if f.is_file and f.size and not f.base_name.startswith(("_", "."))), key=str):
            with store.open_input_stream(file) as stream:
                root = ElementTree.fromstring(stream.read())
            for entry in root.iter(f"{_ATOM}entry"):
                say = lambda tag, entry=entry: entry.findtext(f"{_ATOM}{tag}") or ""
                day = re.match(r"\d{4}-\d\d-\d\d", say("published").strip())
                main = entry.find(f"{_ARXIV}primary_category")
                names = [a.findtext(f"{_ATOM}name") or "" for a in entry.iter(f"{_ATOM}author")]
                yield category, at, say("id"), say("title"), say("summary"), dt.date.fromisoformat(day[0]) if day else None, names, main.get("term") if main is not None else None
                at += 1


def search(spark: SparkSession, path: str, **options) -> DataFrame:
    """Entries of a paged search: ``category, pos, arxiv_id, title, abstract, authors, primary_category, published``; blank ones are dropped."""
    spark.dataSource.register(PagedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("paged_search").options(path=path, **{k: str(v) for k, v in options.items() if v is not None}).load()
    named = rows.select(
        "category", "pos", text.linked_arxiv_id(F.col("id")).alias("arxiv_id"), text.collapse("title").alias("title"), text.collapse(text.de_latex(F.col("summary"))).alias("abstract"),
        F.transform("authors", lambda a: text.collapse(a)).alias("authors"), "primary_category", "published",
    )
    return named.where((F.col("arxiv_id") != "") & (F.col("abstract") != ""))


def write_pages(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` (category, page, pos, id, title, summary, published, author) as pages of a search, each from its page's rows in order."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), text.xml_escape(F.regexp_replace(c, r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", " ")), F.lit(f"</{name}>"))
    main = F.concat(F.lit('<arxiv:primary_category term="'), text.xml_escape(F.col("category")), F.lit('"/>'))
    published = F.coalesce(F.concat(F.lit("<published>"), F.col("published").cast("string"), F.lit("T00:00:00Z</published>")), F.lit(""))
    entry = F.concat(F.lit("<entry>"), tag("id", F.col("id")), tag("title", F.col("title")), tag("summary", F.col("summary")), published, F.lit("<author>"), tag("name", F.col("author")), F.lit("</author>"), main, F.lit("</entry>"))
    pages = rows.select("category", "page", F.struct("pos", entry.alias("entry")).alias("e")).groupBy("category", "page").agg(F.array_sort(F.collect_list("e")).alias("es"))
    head = F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">')
    pages.select("category", "page", F.concat(head, F.array_join("es.entry", "\n"), F.lit("</feed>")).alias("value")).repartition("category", "page").write.partitionBy("category", "page").text(path)
