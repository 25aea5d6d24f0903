"""Personal data: fixed base patterns, and spans that boosted trees select from what high-recall generators propose.

All of it is DataFrame functions, and a document never leaves its row. Base spans are found by kind and checked. Generators, patterns far
looser than the base ones, propose spans that may overlap each other; each is described by its format (digits, groups, checksum, domain)
and its context (the characters next to it, hint words and digits before it). Boosted trees score them, and each kind's
threshold, calibrated on held-out lines, selects; a span that overlaps a base span isn't added. Added spans have kinds of their
own, ``likely_`` and the kind.

A pattern's places are sums of the lengths of what ``split`` leaves between its matches, so long texts with many matches cost what
they are long. The patterns take whole runs where a shorter try can't match either, so none tries the same run again and
again.

The trees are fitted here, on candidates found in the same way in lines made by rule (``lines``: their number is the bound of the sample).

Null text counts as empty (no spans). Repeated rows and null ids stay; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone")
_LOCAL, _BYTE = "[A-Za-z0-9._%+-]", "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Base patterns; a run of characters that can't match from its beginning isn't tried from within.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s|\s?@\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
_MARK = r"(?:\x20?[\[(]\.[\])]\x20?|\x20\.\x20)"
#: What proposes spans: kind, and pattern. Repetitions are bounded or possessive.
GENERATORS = (
    ("email", rf"(?:\G|(?<![\p{{L}}\p{{N}}._%+-]))[\p{{L}}\p{{N}}._%+-]++{_AT}[\p{{L}}\p{{N}}-]++(?:{_DOT}[\p{{L}}\p{{N}}-]++)++"),
    ("ip", rf"(?<![0-9.])[0-9]{{1,3}}(?:{_MARK}[0-9]{{1,3}}){{3}}(?![0-9])"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20./_-])[0-9]{6}\1[0-9]{5}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\+|00)[0-9]{1,3}[\x20./-]?(?:\([0-9]{1,4}\)[\x20./-]?)?[0-9]{2,4}(?:[\x20./-][0-9]{2,8}){1,4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+])\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{3,4}(?:[\x20./-]?[0-9]{2,4}){1,2}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z+.-])[0-9]{9,12}(?![0-9A-Za-z])"),
)
#: Words before a span that speak for each kind, and against all.
HINTS = {
    "email": r"e-?mail|contact|write|reach|inquir|courriel|correo|kontakt|schreib",
    "ip": r"\bips?\b|host|server|address|peer|client|ping|login|connect",
    "card": r"card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta|\bpan\b|cc\b",
    "phone": r"phone|\btel|mobile|\bcell|\bcall|\bfax|whatsapp|handy|telefon|portable|tel[eé]fono|m[oó]vil|ring|dial|sms",
}
AGAINST = r"order|invoice|\bids?\b|\bno\b|number|\bref|version|isbn|issue|ticket|serial|page|total|price|amount|date|time|rows|bytes|build|release|batch|parcel|tracking|account|between|score"
_TOPS = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|nl|ch|at|pl|ru|jp|cn|in|br|us|example|test)$"
#: Lookahead of contexts, in characters, and matches that one stretch of a prefix sum has.
BEFORE, AFTER, STRETCH = 28, 4, 512
#: The highest value of a feature.
TOP = 31


def _scan(values: str, step: str, zero: int) -> str:
    """SQL for what ``step``, as in ``{0} + {1}``, makes of all values before each; stretches first, so it costs about their number times STRETCH."""
    grow = lambda own, x: f"aggregate({own}, array({zero}), (done, own) -> array_append(done, {step.format('element_at(done, -1)', x)}))"
    stretches = f"transform(sequence(1, greatest(size({values}), 1), {STRETCH}), k -> slice({values}, k, {STRETCH}))"
    inner = f"transform({stretches}, part -> {grow('part', 'own')})"
    parts = f"slice(arrays_zip({inner}, {grow(inner, 'element_at(own, -1)')}), 1, greatest(1, int(ceil(size({values}) / {STRETCH}))))"
    return f"flatten(transform({parts}, p -> transform(slice(p.`0`, 1, size(p.`0`) - 1), x -> {step.format('p.`1`', 'x')})))"


def _places(df: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` (key, text) with a column for each of ``patterns`` (name: pattern, and where it can occur): an array of (start, end, hit, before, after)."""
    rest, nothing = df.columns, "cast(array() AS array<struct<`0`: string, `1`: string, `2`: string>>)"

    def pieces(pattern: str) -> str:
        gaps = f"split(text, r'{pattern}', -1)"
        return f"arrays_zip({gaps}, regexp_extract_all(text, r'{pattern}', 0), slice({gaps}, 2, greatest(size({gaps}) - 1, 0)))"

    # what stands ahead of a match, the match, and what follows it
    gap, hit, following = "x.`0`", "x.`1`", "x.`2`"
    width, start = f"char_length({gap}) + coalesce(char_length({hit}), 0)", f"ahead + char_length({gap})"
    span = f"named_struct('start', {start}, 'end', {start} + char_length({hit}), 'hit', {hit}, 'before', right({gap}, {BEFORE}), 'after', left({following}, {AFTER}))"
    df = df.selectExpr(*rest, *(f"CASE WHEN {may} THEN {pieces(p)} ELSE {nothing} END AS {name}" for name, (p, may) in patterns.items()))
    df = df.selectExpr(*rest, *patterns, *(f"transform({name}, x -> {width}) AS {name}_w" for name in patterns))
    df = df.selectExpr(*rest, *patterns, *(f"{_scan(f'{name}_w', '{0} + {1}', 0)} AS {name}_s" for name in patterns))
    return df.selectExpr(*rest, *(f"filter(zip_with({name}, {name}_s, (x, ahead) -> {span}), s -> s.hit IS NOT NULL) AS {name}" for name in patterns))


def _valid(kind: str) -> str:
    """SQL for whether a base match ``s`` stays."""
    own = "regexp_replace(s.hit, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": rf"s.hit RLIKE r'^{_BYTE}(?:\.{_BYTE}){{3}}$'",
        "card": f"char_length({own}) BETWEEN 14 AND 19 AND luhn_check({own})",
        "phone": f"char_length({own}) BETWEEN 10 AND 15",
    }[kind]


def _features(generator: int) -> str:
    """SQL for an array of small integers that describe a candidate ``c``."""
    kind, _ = GENERATORS[generator]
    own, words = "regexp_replace(c.hit, '[^0-9]', '')", "lower(c.before)"
    like = lambda text, pattern: f"int(rlike({text}, r'{pattern}'))"
    count = lambda text, pattern: f"(char_length({text}) - char_length(regexp_replace({text}, r'{pattern}', '')))"
    #: a neighbouring character: 0 none or blank, 1 letter, 2 digit, 3 joining mark, 4 other
    side = lambda char: rf"(CASE WHEN {char} RLIKE r'^\s?$' THEN 0 WHEN {char} RLIKE r'^\p{{L}}' THEN 1 WHEN {char} RLIKE '^[0-9]' THEN 2 WHEN {char} RLIKE r'^[-./_:=#@+]' THEN 3 ELSE 4 END)"
    values = [
        str(generator), f"char_length({own})", "char_length(c.hit)", f"int(coalesce(luhn_check({own}), false))", f"coalesce(try_cast(left({own}, 1) AS int), 10)",
        count("c.hit", r"[^\p{L}\p{N}]"), like("c.hit", r"^(?:\+|00)"), like("c.hit", r"[()\[\]{}<>]"), side("right(c.before, 1)"), side("left(c.after, 1)"),
        like(words, HINTS[kind]), like(words, AGAINST), count("c.before", "[0-9]"), like("c.hit", _TOPS), like("c.hit", r"\p{Lu}"),
        f"size(array_distinct(split({own}, '')))", like("c.hit", rf"^{_BYTE}(?:[^0-9]+{_BYTE}){{3}}$"), like("c.hit", r"^[^@]*\s(?:at|AT)\s.*\s(?:dot|DOT)\s"), like("left(c.after, 2)", "^[ ,./-]?[0-9]"),
    ]
    return f"array({', '.join(f'least({v}, {TOP})' for v in values)})"


@dataclass(frozen=True)
class Trees:
    """Boosted trees: each has a (feature, bound) for each level, and a value for each leaf; a threshold for each kind."""

    start: float
    trees: tuple[tuple[tuple[tuple[int, int], ...], tuple[float, ...]], ...] = ()
    thresholds: tuple[tuple[str, float], ...] = ()

    def score(self, features: str) -> str:
        """SQL for the chance that a candidate of ``features`` is personal data."""
        leaf = lambda splits: " + ".join(f"CASE WHEN {features}[{k}] > {bound} THEN {1 << len(splits) - level - 1} ELSE 0 END" for level, (k, bound) in enumerate(splits))
        values = [f"array({', '.join(f'{v!r}D' for v in leaves)})[{leaf(splits)}]" for splits, leaves in self.trees]
        return f"1D / (1D + exp(-({' + '.join([f'{self.start!r}D', *values])})))"


def candidates(texts: DataFrame) -> DataFrame:
    """``texts`` (key, text) with ``base``, an array for each base kind, and ``proposed``: (start, end, generator, features) of each candidate."""
    number, at = "text RLIKE '[0-9]'", r"text RLIKE r'@|\b(?:at|AT)\b'"
    may = {"email": "instr(text, '@') > 0", "ip": number, "card": number, "phone": "instr(text, '+') > 0"}
    patterns = {kind: (BASE[kind], may[kind]) for kind in KINDS}
    patterns |= {f"g{k}": (p, at if kind == "email" else f"({number} OR instr(text, '::') > 0)") for k, (kind, p) in enumerate(GENERATORS)}
    key = [c for c in texts.columns if c != "text"]
    base = ", ".join(f"transform(filter({kind}, s -> {_valid(kind)}), s -> named_struct('start', s.start, 'kind', {k}, 'end', s.`end`))" for k, kind in enumerate(KINDS))
    every = ", ".join(f"transform(g{k}, c -> named_struct('start', c.start, 'end', c.`end`, 'generator', {k}, 'features', {_features(k)}))" for k in range(len(GENERATORS)))
    return _places(texts, patterns).selectExpr(*key, f"array_sort(flatten(array({base}))) AS base", f"flatten(array({every})) AS proposed")


def spans(texts: DataFrame, trees: Trees) -> DataFrame:
    """``texts`` (key, text) with ``base`` and ``spans``, arrays of (start, kind, end) in order; kinds from len(KINDS) on are added."""
    key = [c for c in texts.columns if c != "text"]
    found = candidates(texts)
    number = {kind: k for k, kind in enumerate(KINDS)}
    bounds, kinds = (f"array({', '.join(str(of[kind]) for kind, _ in GENERATORS)})" for of in (dict(trees.thresholds), number))
    chosen = f"filter(proposed, c -> {trees.score('c.features')} >= {bounds}[c.generator])"
    added = f"transform({chosen}, c -> named_struct('start', c.start, 'kind', {kinds}[c.generator] + {len(KINDS)}, 'end', c.`end`))"
    # in order of starts, a span overlaps a base span if one before ends after its start, or one behind starts before its end
    is_base, far = f"s.kind < {len(KINDS)}", (1 << 31) - 1
    listed = found.selectExpr(*key, "base", f"array_sort(concat(base, array_distinct({added}))) AS every")
    ends = listed.selectExpr(*key, "base", "every", f"transform(every, s -> IF({is_base}, s.`end`, 0)) AS ends", f"transform(reverse(every), s -> IF({is_base}, s.start, {far})) AS starts")
    around = ends.selectExpr(*key, "base", "every", f"{_scan('ends', 'greatest({0}, {1})', 0)} AS before", f"reverse({_scan('starts', 'least({0}, {1})', far)}) AS behind")
    clear = f"x.every.kind < {len(KINDS)} OR x.before <= x.every.start AND x.behind >= x.every.`end`"
    return around.selectExpr(*key, "base", f"transform(filter(arrays_zip(every, before, behind), x -> {clear}), x -> x.every) AS spans")


# training


def _card(rng: random.Random, size: int = 16, good: bool = True) -> str:
    body = [rng.choice("3456"), *(rng.choice("0123456789") for _ in range(size - 2))]
    total = sum((int(d) * 2 - 9 * (int(d) > 4)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(body)))
    return "".join(body) + str((-total + (0 if good else rng.randint(1, 9))) % 10)


def made_line(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A line of made words with one item, and the personal data in it: kind, start and end."""
    vowels, others = "aeiouéèáóöü", "bcdfghklmnprstvw"
    word = lambda: "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))
    plain = lambda: "".join(rng.choice(others[:8]) + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    top = lambda: rng.choice(("com", "org", "net", "de", "fr", "es", "io", "example", "edu"))
    small = lambda: str(rng.randint(0, 255))
    sep = rng.choice(" -.")
    fours = lambda s, mark: mark.join(s[k : k + 4] for k in range(0, len(s), 4))
    mark = rng.choice(("[.]", "(.)", " . ", " [.] "))
    hints = {"email": ("email", "mail", "contact", "write to", "kontakt", "reach me:"), "ip": ("ip", "host", "server", "login from", "peer"), "card": ("card", "visa", "credit card", "payment", "karte", "carte"), "phone": ("phone", "tel", "call", "mobile", "fax:", "telefon", "whatsapp")}
    against = ("order", "invoice", "id", "no", "ref", "version", "isbn", "ticket", "serial", "page", "total", "tracking", "date", "batch")
    phone = lambda: rng.choice((f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{sep}{d(3)}{sep}{d(4)}", f"00{rng.randint(1, 99)} {d(2)} {d(4)} {d(4)}", f"+{rng.randint(1, 99)}/{d(3)}/{d(7)}"))
    #: kind, whether it is personal, what stands right before and behind it, and the item
    kind, good, lead, item, rest = rng.choice((
        lambda: ("email", True, "", f"{plain()}{rng.choice(('', '.' + plain(), d(2)))} at {plain()} dot {top()}", ""), lambda: ("email", True, "", f"{plain()}{rng.choice(('[at]', ' [at] ', '(at)', ' (at) ', ' @ '))}{plain()}{rng.choice(('.', '[dot]', ' [dot] ', ' (dot) '))}{top()}", ""),
        lambda: ("email", True, "", f"{word()}ö@{word()}é.{top()}", ""), lambda: ("ip", True, "", mark.join(small() for _ in range(4)), ""), lambda: ("ip", True, "", ":".join(f"{rng.randint(1, 65535):x}" for _ in range(8)), ""),
        lambda: ("ip", True, "", f"{rng.randint(8192, 16383):x}:{rng.randint(1, 65535):x}::{rng.randint(1, 65535):x}", ""), lambda: ("card", True, rng.choice((phone() + " ", d(rng.randint(1, 5)) + " ")), _card(rng), ""), lambda: ("card", True, "", _card(rng), rng.choice((" " + d(3), " " + d(2) + "-" + d(2), " " + d(5)))),
        lambda: ("card", True, rng.choice(("", d(3) + " ")), fours(_card(rng), rng.choice("./_ -")), rng.choice(("", " " + d(3)))), lambda: ("phone", True, "", phone(), " " + _card(rng)), lambda: ("phone", True, rng.choice(("", d(4) + ", ")), phone(), rng.choice(("", " " + d(6), "."))),
        lambda: ("phone", "hint", "", "0" + d(rng.randint(8, 11)), ""), lambda: ("phone", "hint", "", d(10), ""), lambda: ("card", False, rng.choice(("", d(3) + " ")), _card(rng, 16, False), rng.choice(("", " " + d(3)))), lambda: ("card", False, "", fours(_card(rng, 16, False), rng.choice("./_ -")), ""),
        lambda: ("", False, "", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", ""), lambda: ("", False, "", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", ""), lambda: ("", False, "", f"{rng.randint(1, 999)} {d(3)} {d(3)}.{d(2)}", ""),
        lambda: ("", False, "", f"{d(4)}-{d(4)} {d(3)}", ""), lambda: ("", False, "", f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", ""), lambda: ("", False, "", f"{plain()} at {plain()}.{word().title()}", ""), lambda: ("", False, "", f"{plain()} at {plain()} dot {plain()}", ""),
        lambda: ("", False, "", f"{d(10)}", ""), lambda: ("", False, "", d(rng.randint(9, 19)), ""), lambda: ("", False, "", " ".join(d(rng.randint(2, 4)) for _ in range(rng.randint(3, 6))), ""), lambda: ("", False, "", f"{rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}:{rng.randint(10, 29)}", ""),
        lambda: ("", False, "", f"{rng.randint(10, 31)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)} {d(4)}", ""), lambda: ("", False, "", f"{d(2)}/{d(3)}/{d(4)}", ""), lambda: ("", False, "", f"{plain()} :: {plain()}::{plain()[:2]}", ""), lambda: ("", False, "", f"{d(3)}-{d(3)}, {d(3)}-{d(4)}", ""),
    ))()
    say = rng.random()
    hint = rng.choice(hints[kind]) if kind and (good == "hint" or good and say < 0.5) else rng.choice(against) if not good and say < 0.5 or say < 0.05 else word()
    head = " ".join([*(word() for _ in range(rng.randint(2, 6))), hint]) + rng.choice((" ", " ", ": ", ", "))
    start = len(head) + len(lead)
    tail = " " + " ".join(word() for _ in range(rng.randint(0, 4)))
    return head + lead + item + rest + rng.choice((tail, "." + tail)), [(kind, start, start + len(item))] if good else []


def _examples(spark: SparkSession, lines: int, seed: int) -> DataFrame:
    """``kind, label, features`` of the candidates in made lines that no base span overlaps."""
    rng = random.Random(seed)
    made = [made_line(rng) for _ in range(lines)]
    rows = spark.createDataFrame(made, "text string, truth array<struct<kind: string, start: int, end: int>>")
    found = candidates(rows).select("truth", "base", F.explode("proposed").alias("c"))
    kinds = F.array(*(F.lit(kind) for kind, _ in GENERATORS))
    clear = ~F.exists("base", lambda s: (s.start < F.col("c.end")) & (F.col("c.start") < s.end))
    label = F.exists("truth", lambda s: (s.kind == F.get(kinds, F.col("c.generator"))) & (s.start == F.col("c.start")) & (s.end == F.col("c.end")))
    return found.where(clear).select(F.get(kinds, F.col("c.generator")).alias("kind"), label.cast("int").alias("label"), F.col("c.features").alias("features"))


def fit(spark: SparkSession, lines: int = 3000, rounds: int = 24, depth: int = 3, rate: float = 0.5, precision: float = 0.98) -> Trees:
    """Boosts trees on ``lines`` made lines, and calibrates each kind's threshold on as many others: the least score from which ``precision`` of the
    candidates are personal data (no score, if there is none).

    Candidates with equal features are one row, with its number and its number of labels; these rows, of which there are no more than
    the lines have candidates, are what the trees are boosted on. Each level of a tree has the split that gains most over all of its leaves.
    """
    rows = _examples(spark, lines, 7).groupBy("features").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("features").collect()
    x, n, good = np.array([r.features for r in rows]), np.array([r.n for r in rows]), np.array([r.good for r in rows])
    start = math.log((good.sum() + 1) / (n.sum() - good.sum() + 1))
    score, trees = np.full(len(x), start), []
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-score))
        g, h, leaf, splits = good - n * chance, n * chance * (1 - chance), np.zeros(len(x), np.int64), []
        gained = lambda a, b: a * a / (b + 1)
        for level in range(depth):
            gains = np.empty((x.shape[1], TOP))
            for k in range(x.shape[1]):
                a, b = (np.bincount(leaf * (TOP + 1) + x[:, k], w, (1 << level) * (TOP + 1)).reshape(-1, TOP + 1).cumsum(axis=1) for w in (g, h))
                gains[k] = (gained(a, b) + gained(a[:, -1:] - a, b[:, -1:] - b))[:, :-1].sum(axis=0)
            splits.append(tuple(int(v) for v in np.unravel_index(np.round(gains, 9).argmax(), gains.shape)))
            leaf = 2 * leaf + (x[:, splits[-1][0]] > splits[-1][1])
        leaves = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + 1)
        score = score + leaves[leaf]
        trees.append((tuple(splits), tuple(leaves.tolist())))
    found = Trees(start, tuple(trees))
    held_out = _examples(spark, lines, 8).select("kind", "label", F.expr(f"floor(100 * ({found.score('features')}))").alias("score"))
    bars = held_out.groupBy("kind", "score").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy(F.desc("score")).collect()
    thresholds = []
    for kind in KINDS:
        count = right = 0
        bound = 2.0
        for r in (r for r in bars if r.kind == kind):
            count, right = count + r.n, right + r.good
            if right >= precision * count:
                bound = r.score / 100
        thresholds.append((kind, bound))
    return Trees(start, found.trees, tuple(thresholds))


def scan(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``spans``, arrays of (start, kind, end) in order."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return spans(texts, trees)


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, (*KINDS, *(f"likely_{k}" for k in KINDS))))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
