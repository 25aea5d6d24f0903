"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. Reading a text through it from the start yields phrases, each
the longest match of the training text from where the last one ended; the language whose automaton needs the fewest
phrases for each letter wins, ties going to the first name. Whole texts are read: a batch is cut into rows of ``ROW``
letters that go through each automaton's table in step, so no text is a loop of its own. A row is first read as if a phrase
began with it; then its beginning is read again from where the row before it ended, until both readings meet.

A text is null or has no letter: language ``und``, score 0. The score is how far the best language is ahead of the second,
as a share of the second's phrases (1 where only one language was learned). Without labelled rows all texts are ``und``.
Repeated rows and null ids stay; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textarrays import blocks

UNKNOWN = "und"
#: Letters of a row that is read in step with others.
ROW = 128
BLOCK = 1 << 20
_OTHER, _GAP = 1, 2


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def plain(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters being one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _kinds()[points]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return points[keep]


class Automaton:
    """The suffix automaton of a symbol string, as a dense table of transitions; 0 is both the root and none."""

    def __init__(self, symbols: list[int], size: int):
        link, length, step = [-1], [0], [{}]
        last = 0
        for c in symbols:
            new = len(step)
            link.append(0)
            length.append(length[last] + 1)
            step.append({})
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    step.append(step[q].copy())
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.table = np.zeros((len(step), size), np.int32)
        for state, moves in enumerate(step):
            for c, to in moves.items():
                self.table[state, c] = to * size
        self.table = self.table.ravel()

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        to = self.table[state + symbols]
        over = to == 0
        begun = (over | (state == 0)) & (symbols > 0)  # at the root a phrase has yet to begin
        return np.where(over, self.table[symbols], to), begun

    def phrases(self, rows: np.ndarray, goes_on: np.ndarray | None = None) -> np.ndarray:
        """Phrases that begin in each column of ``rows`` (symbols by place); symbol 0 is padding and adds none.

        A column that ``goes_on`` is read from the state that the column before it ends in.
        """
        states, begun = np.empty(rows.shape, np.int32), np.empty(rows.shape, bool)
        state = np.zeros(rows.shape[1], np.int32)
        for place, symbols in enumerate(rows):
            states[place], begun[place] = state, _ = self._step(state, symbols)
        again = np.zeros(0, int) if goes_on is None else np.flatnonzero(goes_on)
        again = again[states[-1, again - 1] != 0]
        while len(again):
            state = states[-1, again - 1]
            for place, symbols in enumerate(rows):
                state, begun[place, again] = self._step(state, symbols[again])
                apart = state != states[place, again]
                again, state = again[apart], state[apart]
                states[place, again] = state
                if not len(again):
                    break
            # columns after those whose last state has changed
            again = again[again + 1 < rows.shape[1]] + 1
            again = again[goes_on[again]]
        return np.count_nonzero(begun, axis=0)


class Languages:
    """The learned languages; ``texts``: language and training text."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        learned = [(name, plain(text)) for name, text in sorted(texts)]
        letters = sorted({int(c) for _, points in learned for c in np.unique(points)} - {32})
        self.symbols = np.full(0x110000, _OTHER, np.uint16)
        self.symbols[32] = _GAP
        self.symbols[letters] = np.arange(_GAP + 1, _GAP + 1 + len(letters))
        size = _GAP + 1 + len(letters)
        self.names = [name for name, _ in learned]
        self.automata = [Automaton(self.symbols[points].tolist(), size) for _, points in learned]

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        points = [plain(t) if t else np.zeros(0, np.uint32) for t in texts]
        sizes = np.array([len(p) for p in points], np.int64)
        rows = -(-sizes // ROW)
        known = np.array([bool((p != 32).any()) for p in points], bool)
        if not self.names or not rows.sum():
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        symbols = np.zeros((rows.sum(), ROW), np.uint16)
        starts = np.repeat(np.cumsum(rows) - rows, sizes) * ROW
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        symbols.ravel()[starts + within] = self.symbols[np.concatenate(points)]
        symbols = np.ascontiguousarray(symbols.T)
        full = rows > 0
        at = (np.cumsum(rows) - rows)[full]
        goes_on = np.ones(rows.sum(), bool)
        goes_on[at] = False
        rates = np.full((len(self.automata), len(texts)), np.inf)
        for k, automaton in enumerate(self.automata):
            rates[k, full] = np.add.reduceat(automaton.phrases(symbols, goes_on), at) / sizes[full]
        best = rates.argmin(axis=0)
        ahead = np.ones(len(texts))
        if len(self.automata) > 1:
            low = np.sort(rates, axis=0)[:2]
            ahead[full] = (low[1, full] - low[0, full]) / low[1, full]
        names = [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, ahead, 0.0).tolist()


@lru_cache(2)
def languages(texts: tuple[tuple[str, str], ...]) -> Languages:
    return Languages(texts)


def learn(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 40, usual: int = 2000
) -> tuple[tuple[str, str], ...]:
    """The training text of each language: the whole texts of a bounded sample of ``most_docs`` documents.

    Documents of at most ``usual`` characters come first, in hash order of the id, then longer ones, shortest first.
    Rows with a null language or text, or text without a letter, teach nothing.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumns({"place": F.xxhash64("id"), "digest": F.xxhash64("text")})
    one = ["lang", "place", "id", "digest"]  # several texts of an id are several documents
    order = Window.partitionBy("lang").orderBy("size", "place", "id", "digest")
    sized = rows.select(*one, F.greatest(F.length("text"), F.lit(usual)).alias("size"))
    few = sized.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_docs).drop("size")
    few = few.select(*(F.col(c).alias(f"few_{c}") for c in one)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"few_{c}")) for c in one))
    texts = rows.join(F.broadcast(few), same, "left_semi")
    found: dict[str, list] = {}
    for r in texts.dropDuplicates(one).collect():  # at most ``most_docs`` rows for a language
        found.setdefault(r.lang, []).append((r.place, r.id, r.digest, r.text))
    return tuple((lang, "\n".join(t for *_, t in sorted(own, key=lambda r: (r[0], r[1] or "", r[2])))) for lang, own in sorted(found.items()))


def language(model: tuple[tuple[str, str], ...], text: Column) -> Column:
    """A struct of ``lang_pred`` and ``score`` for each text."""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = languages(model).classify
        for batch in batches:
            texts, names, scores = batch.tolist(), [], []
            for lo, hi in blocks(texts, BLOCK):
                some = classify(texts[lo:hi])
                names += some[0]
                scores += some[1]
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return run(text)


def identify(docs: DataFrame, model: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score``."""
    return docs.select(F.col(id_col).alias("doc_id"), language(model, F.col(text_col)).alias("found")).select("doc_id", "found.lang_pred", "found.score")
