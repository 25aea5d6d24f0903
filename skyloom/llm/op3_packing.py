"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Documents of one length are interchangeable, so they are held as runs: a length, the first rank within the length and how many.
A gap is a run of sequences that have the same room left. Documents longer than half the capacity each open a sequence. Then
every round range-sorts the runs of documents and gaps by size and sweeps each range in its own task: the longest document
takes its successor, the smallest gap that holds it; where several want one gap, the one of the lower rank gets it (longer
first, then earlier) and the others go on to the next; gaps shrink and are offered again within the range. What a range can't
match goes on to the next round, whose ranges are wider, and the last round has one range, in which what fits nowhere opens
new sequences. All state between rounds is a written table of runs, whose number depends on the capacity and not on
the documents. Each document finds its place by its length and its rank within it.

A document longer than the capacity is cut into pieces of the capacity, the first piece taking the remainder.
Null text counts as empty (the end id alone). Repeated rows are packed one by one; an empty table gives an empty one;
null ids stay; columns besides the id and the text are not read.

Token ids are those of the tokenizer file by its library. If it is proven (``prove_ranks``) that merging by the rank of the
merged token gives the same, texts are encoded by ranks, which is faster; else, and for texts that hold a special
string, the library itself does it.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .op8_token_counts import byte_letters
from .storage import write_table

#: Runs of a range, and how many ranges become one in the next round.
RANGE_RUNS, WIDER = 512, 4
#: Rows of the table of matched runs up to which it is broadcast, and ranks (as a power of two) that one of its join keys covers.
BROADCAST_ROWS, RANKS_BITS = 1_000_000, 20
#: Sequences are numbered by the document that opens them: its length, and its rank in so many bits.
OPENER_BITS = 40
_PLAIN_MODEL = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False, "byte_fallback": False, "fuse_unk": False}
_PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
DOC, GAP, MATCH = 0, 1, 2


def prove_ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of the vocabulary's strings if merging by rank provably gives the library's ids, else none.

    It does if the file splits and merges plainly, if ids rise with the order of merges, and if each string alone becomes
    its own single token. For then, where two neighbours make up a string of the vocabulary and nothing of lower rank is left
    to merge, the string's bytes were merged as they are alone, so the neighbours are the pair whose merge the file lists.
    """
    with open(path, encoding="utf-8") as text:
        file = json.load(text)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and all(model.get(k, v) == v for k, v in _PLAIN_MODEL.items()) and all(split.get(k) == v for k, v in _PLAIN_SPLIT.items())
    if not plain or file.get("normalizer") or file.get("truncation") or file.get("padding"):
        return None
    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    strings = {w: i for w, i in model["vocab"].items() if w not in special}
    byte = {letter: b for b, letter in byte_letters().items()}
    merged = [strings.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    rising = None not in merged and merged == sorted(merged) and len(strings) == len(merged) + 256
    own = rising and all(c in byte for w in strings for c in w) and all([t.id for t in tokenizer.model.tokenize(w)] == [i] for w, i in strings.items())
    return {bytes(map(byte.__getitem__, w)): i for w, i in strings.items()} if own else None


class Ids:
    """Token ids of whole texts by a byte-level tokenizer file, as little-endian uint32."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_rank = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None

    def encode(self, text: str) -> bytes:
        if self.by_rank is None or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.by_rank(text)).tobytes()


_made: dict[str, Ids] = {}


def ids_of(path: str, ranks: dict[bytes, int] | None) -> Ids:
    if path not in _made:
        _made[path] = Ids(path, ranks)
    return _made[path]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Tokenised documents cut to the capacity; ``part`` and ``place`` number the pieces of each length in a task."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", *["ids"] * with_ids]
    ranks = docs.sparkSession.sparkContext.broadcast(prove_ranks(path))  # as many as the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = ids_of(path, ranks.value).encode, TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows, of = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    rows.append((k, a, b - a, zlib.crc32(own), part, int(seen[b - a]), *[np.frombuffer(own, "<u4").tolist()] * with_ids))
                    seen[b - a] += 1
                    of.append(i)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)] if rows else [pa.array([], t) for t in kinds[: len(names) - 1]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names)

    return chosen.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<long>" * with_ids)


def sweep(docs: list[tuple[int, int, int]], open_gaps: list[tuple[int, int, int]], capacity: int, may_open: bool) -> tuple[list, list, list]:
    """Matches runs of documents (length, first rank, count) with runs of gaps (gap, first sequence, count), longest first.

    Returns runs of matches (length, first rank, count, first sequence, offset), of documents left and of gaps left.
    """
    gaps: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences
    out, left_over = [], []

    def put(gap: int, first: int, count: int) -> None:
        if gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append((first, count))

    for run in sorted(open_gaps, reverse=True):
        put(*run)
    for length, rank, left in sorted(docs, key=lambda d: (-d[0], d[1])):
        while left and (at := bisect.bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            first, count = runs[gap].pop()
            taken = min(left, count)
            if count > taken:
                runs[gap].append((first + taken, count - taken))
            if not runs[gap]:
                del runs[gap], gaps[at]
            out.append((length, rank, taken, first, capacity - gap))
            put(gap - length, first, taken)
            rank, left = rank + taken, left - taken
        if left and not may_open:
            left_over.append((length, rank, left))
            left = 0
        each = capacity // length
        while left:  # new sequences, filled one after another
            opened, opener = max(1, left // each), length << OPENER_BITS | rank
            for k in range(min(each, left)):
                taken = min(opened, left)
                out.append((length, rank, taken, opener, k * length))
                rank, left = rank + taken, left - taken
            put(capacity - (k + 1) * length, opener, opened)
    return out, left_over, [(gap, first, count) for gap, own in runs.items() for first, count in own]


def _round(capacity: int, may_open: bool):
    """Sweeps one range of runs; a partition holds a bounded number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        matched, docs, gaps = sweep([r[1:] for r in rows if r[0] == DOC], [r[1:] for r in rows if r[0] == GAP], capacity, may_open)
        found = [(DOC, *d, None, None) for d in docs] + [(GAP, *g, None, None) for g in gaps] + [(MATCH, *m) for m in matched]
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = [pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "size", "first", "n", "sequence", "offset"])

    return run


def match(lengths: DataFrame, capacity: int, range_runs: int = RANGE_RUNS) -> DataFrame:
    """Runs of matches (length, first, n, sequence, offset) for ``lengths`` (length, n)."""
    runs = lengths.select(F.col("length").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), F.col("n").cast("long").alias("n"))
    opener = F.shiftleft("size", OPENER_BITS)
    opening = runs.where(F.col("size") > capacity // 2)
    matched = opening.select(F.col("size").alias("length"), "first", "n", opener.alias("sequence"), F.lit(0).cast("long").alias("offset"))
    gaps = opening.select(F.lit(GAP).alias("kind"), (F.lit(capacity) - F.col("size")).alias("size"), opener.alias("first"), "n").where("size > 0")
    state = write_table(runs.where(F.col("size") <= capacity // 2).select(F.lit(DOC).alias("kind"), "size", "first", "n").unionByName(gaps), "runs")
    ranges = max(1, state.count() // range_runs)
    while True:
        dealt = state.repartitionByRange(ranges, "size") if ranges > 1 else state.coalesce(1)
        swept = write_table(dealt.mapInArrow(_round(capacity, ranges == 1), "kind int, size long, first long, n long, sequence long, offset long"), "runs")
        matched = matched.unionByName(swept.where(F.col("kind") == MATCH).select(F.col("size").alias("length"), "first", "n", "sequence", "offset"))
        if ranges == 1:
            return write_table(matched, "matched")
        state, ranges = swept.where(F.col("kind") != MATCH).select("kind", "size", "first", "n"), max(1, ranges // WIDER)


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``."""
    cut = write_table(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    matched = match(by_part.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.col("place")
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", rank).withColumn("block", F.shiftright(rank, RANKS_BITS))
    block = F.explode(F.sequence(F.shiftright("first", RANKS_BITS), F.shiftright(F.col("first") + F.col("n") - 1, RANKS_BITS)))
    keyed = matched.select(F.col("length").alias("of"), block.alias("in"), "first", "n", "sequence", F.col("offset").alias("from"))
    runs = F.broadcast(keyed) if matched.count() <= BROADCAST_ROWS else keyed
    place = F.col("rank") - F.col("first")
    found = ranked.join(runs, (F.col("length") == F.col("of")) & (F.col("block") == F.col("in")) & (place >= 0) & (place < F.col("n")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + place).alias("sequence_id"), F.col("from").alias("offset"), *["ids"] * with_ids)
