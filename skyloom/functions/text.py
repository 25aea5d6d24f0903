"""Text, identifier and reference functions: Column in, Column out.

Everything that SQL functions can express stays inside the JVM; accent folding, TeX accents, author initials and archive
bytes need a callback for each match or character tables, and are Arrow functions over whole batches.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tex
from .vectors import once

#: Runs of blanks: one explicit class, since engines differ in what they call a space.
BLANKS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
LABEL_SIZE = 80


def collapse(c: Column) -> Column:
    """Runs of blanks become one blank; none at either end. Null stays null."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def text_sha(c: Column) -> Column:
    """The content key of a text: SHA-256 after collapsing blanks; null counts as empty."""
    return F.sha2(collapse(F.coalesce(c, F.lit(""))), 256)


def bare_arxiv_id(c: Column) -> Column:
    """An id without its address, ``arXiv:`` prefix and version."""
    s = F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), r"(?i)^https?://arxiv\.org/abs/", "")
    s = F.regexp_replace(s, "(?i)^arxiv:", "")
    return F.regexp_replace(s, r"v\d+$", "")


def linked_arxiv_id(c: Column) -> Column:
    """The bare id of a link: whatever comes after its last ``/abs/``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^.*/abs/", ""), "(?i)^arxiv:", ""), r"v\d+$", "")


def arxiv_doi(c: Column) -> Column:
    """The DOI that the archive registers for an id; empty for an empty id."""
    bare = bare_arxiv_id(c)
    return F.when(bare == "", "").otherwise(F.concat(F.lit("10.48550/arxiv."), F.lower(bare)))


def _without_resolver(c: Column) -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(F.trim(F.regexp_replace(s, r"(?i)^doi:\s*", "")))


def normalize_doi(c: Column) -> Column:
    """A bare lower-case DOI; empty if it isn't one."""
    bare = _without_resolver(c)
    return F.when(bare.startswith("10."), bare).otherwise("")


def doi_key(c: Column) -> Column:
    """The lookup form ``doi:...``; empty for an empty DOI."""
    bare = _without_resolver(c)
    return F.when(bare == "", "").otherwise(F.concat(F.lit("doi:"), bare))


def clean_doi(c: Column) -> Column:
    """A DOI found in running text, without what follows it."""
    return F.lower(F.regexp_replace(c, r"""[.,;)}\]"']+$""", ""))


def norm_title(c: Column) -> Column:
    """The matching form of a title: lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def clip_label(c: Column, size: int = LABEL_SIZE) -> Column:
    """At most ``size`` characters, the last one an ellipsis where some were cut."""
    label = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(label) > size, F.concat(F.rtrim(F.substring(label, 1, size - 1)), F.lit("…"))).otherwise(label)


def row_label(title: Column, text: Column) -> Column:
    """What a query row is called: its title, else its text."""
    return clip_label(F.coalesce(F.nullif(title, F.lit("")), text))


def xml_escape(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def title_case(c: Column) -> Column:
    """The first character in upper case, the rest as it is."""
    s = F.coalesce(c, F.lit(""))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def cell(c: Column) -> Column:
    """A table cell of Markdown: pipes are escaped."""
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def slugify(c: Column) -> Column:
    """Lower-case words joined by hyphens; never empty."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def embed_text(title: Column, abstract: Column) -> Column:
    """Title and abstract in one line; a missing abstract repeats the title."""
    t = F.coalesce(title, F.lit(""))
    return F.trim(F.concat(t, F.lit(" "), F.coalesce(F.nullif(abstract, F.lit("")), t)))


def abstract_of(description: Column) -> Column:
    """What follows the header of an announcement, else all of it; blanks collapsed."""
    after = F.regexp_extract(F.coalesce(description, F.lit("")), r"(?s)Abstract:\s*(.*)$", 1)
    return collapse(F.when(F.coalesce(description, F.lit("")).contains("Abstract:"), after).otherwise(F.coalesce(description, F.lit(""))))


def listed(c: Column, sep: str = ",") -> Column:
    """The trimmed, non-empty items of a separated list, in order."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: collapse(x)), lambda x: x != "")


def distinct_list(c: Column, sep: str = r"[\s,]+") -> Column:
    """Like ``listed``, each item once, first come first kept."""
    return F.array_distinct(listed(c, sep))


def json_list(c: Column) -> Column:
    """A JSON list of strings: null or empty text gives no items, broken JSON or a scalar one."""
    s = F.coalesce(c, F.lit(""))
    items = F.from_json(s, "array<string>")
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), s, F.lit("}")), "$.v")
    one = F.array(F.coalesce(F.when(s.startswith("{"), s).otherwise(scalar), s))
    return F.when(s == "", F.array().cast("array<string>")).when(s.startswith("["), F.coalesce(items, F.array(s))).otherwise(one)


def invert_abstract(c: Column) -> Column:
    """A text's words, split at single blanks, as a map of word to ascending places. Words are sorted with their places, and runs of equal ones cut out."""
    placed = F.array_sort(F.transform(F.split(c, " "), lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def runs(words: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(words, i)["word"] != F.get(words, i - 1)["word"])
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), first)
        size = lambda all_, start, k: F.coalesce(F.get(all_, k + 1), F.size(words)) - start
        entry = lambda all_, start, k: F.struct(F.get(words, start)["word"].alias("word"), F.transform(F.slice(words, start + 1, size(all_, start, k)), lambda p: p["at"]).alias("at"))
        return once(starts, lambda all_: F.map_from_entries(F.transform(all_, lambda start, k: entry(all_, start, k))))

    return once(placed, runs)


def rebuild_abstract(index: Column) -> Column:
    """Prose from a map of word to places; the first missing place ends it."""
    pairs = F.array_sort(F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("at"), e.key.alias("word"))))))

    def prose(placed: Column) -> Column:
        whole = F.transform(placed, lambda p: p["word"])
        gaps = F.transform(placed, lambda p, i: (p["at"] == i).cast("int"))
        # words after the first missing place are cut off
        return once(F.array_position(gaps, 0), lambda gap: F.array_join(F.when(gap > 0, F.slice(whole, 1, (gap - 1).cast("int"))).otherwise(whole), " "))

    return F.coalesce(once(pairs, prose), F.lit(""))


def cluster_key(ids: Column, titles: Column) -> Column:
    """Aggregate: a digest of a group's members, whatever their order; titles collapsed to 400 characters."""
    line = F.concat(ids, F.lit("\t"), F.left(collapse(F.coalesce(titles, F.lit(""))), F.lit(400)))
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)


def client_hash(salt: str, client: Column) -> Column:
    return F.left(F.sha2(F.concat(F.lit(salt), client), 256), F.lit(32))


# what needs Python


def fold_ascii(word: str) -> str:
    return unicodedata.normalize("NFKD", word).encode("ascii", "ignore").decode()


def _last_name(author: str | None) -> str:
    words = (author or "").split()
    name = re.sub("[^A-Za-z0-9]", "", fold_ascii(words[-1])) if words else ""
    return name.capitalize() or "Anon"


@F.arrow_udf(T.StringType())
def last_name(authors: pa.Array) -> pa.Array:
    """The folded last word of a name, or ``Anon``."""
    return pa.array([_last_name(a) for a in authors.to_pylist()], pa.string())


def cite_key(authors: Column, published: Column, arxiv_id: Column) -> Column:
    """``{LastName}{Year}_{id}``: readable, and unique because ids are."""
    year = F.substring(F.coalesce(published.cast("string"), F.lit("")), 1, 4)
    year = F.when(F.regexp_like(year, F.lit(r"^\d{4}$")), year).otherwise("")
    return F.concat(last_name(F.get(authors, F.lit(0))), year, F.lit("_"), bare_arxiv_id(arxiv_id))


@F.arrow_udf(T.StringType())
def de_latex(texts: pa.Array) -> pa.Array:
    """TeX accents, Greek letters and special letters as Unicode."""
    return pa.array([tex.to_unicode(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def short_author(names: pa.Array) -> pa.Array:
    """A name with initials for the given names."""
    return pa.array([tex.short_name(n) for n in names.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def short_authors(lists: pa.Array) -> pa.Array:
    """A list of names with initials, joined by commas."""
    return pa.array([", ".join(filter(None, map(tex.short_name, names or []))) for names in lists.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def entries(sources: pa.Array) -> pa.Array:
    """One chunk for each cited work of a bibliography source; the whole text if it has no entries."""
    return pa.array([tex.works(s) for s in sources.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def bib_dois(sources: pa.Array) -> pa.Array:
    """DOI fields of each uploaded bibliography."""
    return pa.array([tex.cited_dois(s) for s in sources.to_pylist()], pa.list_(pa.string()))


_ENTRY = ("raw", "ref_doi", "ref_arxiv", "ref_title")


@F.arrow_udf(T.StructType([T.StructField(name, T.StringType()) for name in _ENTRY]))
def parsed_entry(chunks: pa.Array) -> pa.Array:
    """Struct ``raw, ref_doi, ref_arxiv, ref_title`` of one entry; null where nothing is found."""
    found = [tex.work(c or "") for c in chunks.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([f[n] for f in found], pa.string()) for n in _ENTRY], _ENTRY)


@F.arrow_udf(T.StringType())
def extract_source(archives: pa.Array) -> pa.Array:
    """Bibliography text of each submission's bytes."""
    return pa.array([tex.source_of(a) for a in archives.to_pylist()], pa.string())
