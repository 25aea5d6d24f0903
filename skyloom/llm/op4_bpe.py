"""Byte-level BPE encoding and decoding with length-bucketed padded matrices.

Distinct pre-tokens of a batch are dealt by length into padded integer matrices. In each round every row merges its
leftmost pair of least rank; ranks come from a hashed pair table, finished rows leave, and the columns close up.
What a stretch of text encodes to is remembered in a bounded table, so each batch only merges what is new to it.
A very long pre-token is a matrix of its own of one row, in which a round merges all pairs of the least rank, leftmost first. That
is the same result, since a merge makes no pair of lower or equal rank (see ``own_pairs``).

Null text counts as empty (no ids). Repeated rows are encoded one by one, an empty table gives an empty one, null ids of
documents stay, and columns besides the id and the text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .remember import Remembered
from .textarrays import blocks

#: Entries of a generation of what a worker remembers; bounds its memory.
REMEMBERED = 300_000
#: Longer pre-tokens aren't padded together with others.
LONGEST_ROW = 512
#: Characters of text that are encoded together.
BLOCK = 1 << 20
_NONE = np.int32(2**31 - 1)
_CUT = re.compile(r" (?=\S)")


class PairTable:
    """Open addressing from pairs of ids to the id of their merge, looked up for whole arrays."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        for key, value in pairs.items():
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) % size
            self.keys[at], self.values[at] = key, value

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, or the largest int32; negative ids are padding and never merge."""
        out = np.full(left.shape, _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left.ravel()[todo].astype(np.int64) << 32) | right.ravel()[todo]
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        flat = out.ravel()
        while todo.size:
            here = self.keys[at]
            hit = here == keys
            flat[todo[hit]] = self.values[at[hit]]
            on = ~hit & (here >= 0)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)


def own_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """For each token the one pair that is ever merged to it: what its bytes become by merges of lower rank, if that is a pair.

    When a pair has the least rank of all, nothing lower is left to merge between its ends, so its bytes are in the state in
    which the token's bytes alone are. Both members have been merged before, so a pair's rank is higher than that of any token in it.
    """
    pairs: dict[int, int] = {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [ranks[token[k : k + 1]] for k in range(len(token))]
        while len(parts) > 2:
            found = [pairs.get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
            if (least := min(found)) == _NONE:
                break
            at = found.index(least)
            parts[at : at + 2] = [int(least)]
        if len(parts) == 2:
            pairs[parts[0] << 32 | parts[1]] = rank
    return pairs


class Bpe:
    """A rank vocabulary: encodes pre-tokens, whole texts, and decodes ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(own_pairs(self.ranks))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        most = tokens[-1][1] + 1
        self.sizes = np.zeros(most, np.int64)
        for token, rank in tokens:
            self.sizes[rank] = len(token)
        self.places = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.letters = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.first, self.later = Remembered(REMEMBERED // 10), Remembered(REMEMBERED)

    def _rows(self, pieces: list[bytes], out: dict[bytes, np.ndarray]) -> None:
        """Merges pre-tokens of similar length in one padded matrix."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, _NONE, np.int32)
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        names = np.arange(len(pieces))
        while len(names):
            best = ranks.argmin(axis=1)
            row = np.arange(len(names))
            least = ranks[row, best]
            done = least == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    r = ids[i]
                    out[pieces[names[i]]] = r[r >= 0]
                go = ~done
                ids, ranks, names, best, least = ids[go], ranks[go], names[go], best[go], least[go]
                row = np.arange(len(names))
            if not len(names):
                break
            ids[row, best] = least
            keep = np.ones(ids.shape, bool)
            keep[row, best + 1] = False
            shape = (len(names), ids.shape[1] - 1)
            ids, ranks = ids[keep].reshape(shape), ranks[keep].reshape(shape)
            here, last = ids[row, best], shape[1] - 1
            after = np.where(best < last, ids[row, np.minimum(best + 1, last)], -1)
            before = np.where(best > 0, ids[row, np.maximum(best - 1, 0)], -1)
            ranks[row, best] = self.pairs.find(here, after)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.pairs.find(before[left], here[left])

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long pre-token, all pairs of the least rank in a round."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == least)
            place = np.arange(len(at))
            begun = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, place))
            at = at[(place - begun) % 2 == 0]  # of pairs that overlap every second one
            ids[at] = least
            ids, ranks = np.delete(ids, at + 1), np.delete(ranks, at)
            at -= np.arange(len(at))
            near = np.concatenate((at[at < len(ranks)], at[at > 0] - 1))
            ranks[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids

    def merge(self, pieces: set[bytes]) -> dict[bytes, np.ndarray]:
        """Ids of each pre-token; one that is itself a token has that id."""
        out, buckets = {}, {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                out[p] = np.array([whole], np.int32)
            elif len(p) > LONGEST_ROW:
                out[p] = self._long(p)
            else:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(p)
        for same in buckets.values():
            self._rows(same, out)
        return out

    def _stretches(self, stretches: list[str], lead: str) -> list[bytes]:
        split = [[p.encode() for p in self.split(lead + s)] for s in stretches]
        ids = {p: i.tobytes() for p, i in self.merge({p for ps in split for p in ps}).items()}
        return [b"".join(map(ids.__getitem__, ps)) for ps in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32; a pre-token never spans a blank that comes before a non-blank."""
        cut = [_CUT.split(t) for t in texts]
        first = self.first.of((c[0] for c in cut), lambda new: self._stretches(new, ""))
        later = self.later.of((s for c in cut for s in c[1:]), lambda new: self._stretches(new, " "))
        return [first[c[0]] + b"".join(map(later.__getitem__, c[1:])) for c in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.letters[np.repeat(self.places[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


@lru_cache(2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``ids`` (array of int), each match of ``pattern`` encoded separately."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in blocks(texts, BLOCK):
                found = model.encode(texts[lo:hi])
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], ["doc_id", "ids"])

    return chosen.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that ``ids_col`` stands for; null ids give null."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        model = bpe(path, pattern)
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return pa.array([None if n else model.decode(flat[a:b]) for n, a, b in zip(null, ends[:-1], ends[1:], strict=True)], pa.binary())

    return encoded.withColumn(out_col, run(F.col(ids_col)))
