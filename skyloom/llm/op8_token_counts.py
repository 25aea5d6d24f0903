"""Token counts by the whole-token shortcut.

Before the job starts it is proven which vocabulary strings encode alone as exactly one token. Pre-tokens among them
count as one without any merge; only the rest is merged. A text is cut at blanks first, which no pre-token
spans, and what a cut piece counts is remembered in a bounded table.

Null text counts as empty (0 bytes, 0 tokens). Repeated rows are counted one by one, an empty table gives an empty
one, null ids stay, and columns besides the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .remember import Remembered

#: Entries of a generation of what a worker remembers; bounds its memory.
REMEMBERED = 300_000
#: Fixed value: how the vocabulary file splits normalised text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def prove_single(path: str) -> frozenset[str]:
    """Pre-tokens that the vocabulary at ``path`` encodes alone as one token; as many as the vocabulary at most."""
    tokenizer = Tokenizer.from_file(path)
    byte = {letter: b for b, letter in byte_letters().items()}
    single = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if not entry.endswith(END) or len(entry) == len(END):
            continue
        spelled = entry[: -len(END)]
        found = tokenizer.model.tokenize(spelled)
        if len(found) == 1 and found[0].value == entry and all(c in byte for c in spelled):
            try:
                single.add(bytes(byte[c] for c in spelled).decode())
            except UnicodeDecodeError:  # part of a character: never a whole pre-token
                continue
    return frozenset(single)


class Counter:
    """Counts tokens of whole texts with one vocabulary."""

    def __init__(self, path: str, single: frozenset[str]):
        self.tokenizer, self.single = Tokenizer.from_file(path), single
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.split = regex.compile(PATTERN).findall
        self.known = Remembered(REMEMBERED)

    def merged(self, word: str) -> int:
        """Tokens of a pre-token that the shortcut doesn't cover."""
        return len(self.tokenizer.model.tokenize("".join(self.letters[b] for b in word.encode())))

    def piece(self, piece: str) -> int:
        words = self.split(self.tokenizer.normalizer.normalize_str(piece))
        return sum(1 if w in self.single else self.merged(w) for w in words)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        pieces = text.split(" ")
        known = self.known.of(pieces, lambda new: map(self.piece, new))
        return sum(map(known.__getitem__, pieces))


@lru_cache(2)
def counter(path: str, single: frozenset[str]) -> Counter:
    return Counter(path, single)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    single = docs.sparkSession.sparkContext.broadcast(prove_single(path))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path, single.value).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
