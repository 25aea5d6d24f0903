"""Stupid-backoff scores from n-gram counts of the whole corpus, computed relationally.

Documents are packed into batches of words. Each batch asks for the counts of its distinct n-grams of every order, dealt by
hash into buckets; a bucket adds up what all batches hold of its n-grams (the count tables) and answers each batch; the
batch joins the answers to its exploded n-grams and sums log scores per document. A frequent n-gram is one entry of a batch, so no
key is hot, and the number of buckets follows the number of words.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. The score of a word after its history is count(n-gram) /
count(history) if the n-gram was counted at least ``least`` times in the corpus, else ``ALPHA`` times the score after the
history without its first word; a single word scores count / all words. Logarithms are rounded to millionths, so sums are exact.
Null or wordless texts have no words and a null score. Repeated rows are all counted and scored, null ids stay, an empty
table gives an empty one, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import write_table
from .textarrays import blocks, ngrams, pack, unpack, words

ALPHA = 0.4
#: Bytes of text in a batch; words of the corpus for each bucket.
BATCH, BUCKET = 6 << 20, 1_500_000
_MICRO = 1e6


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in blocks(texts, BATCH):
                hashes, counts = words(texts[lo:hi])
                types, index = np.unique(hashes, return_inverse=True)
                ids = batch.column(0).slice(lo, hi - lo)
                columns = [
                    pa.array([number], pa.int64()), pa.array([len(hashes)], pa.int64()), pa.array([len(types)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids), pa.array([counts.tobytes()], pa.binary()),
                    pa.array([pack(types, True)], pa.binary()), pa.array([pack(index.astype(np.int32))], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["batch", "n_words", "n_types", "ids", "counts", "types", "index"])
                number += 1

    return run, f"batch long, n_words long, n_types long, ids array<{kind}>, counts binary, types binary, index binary"


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    types = unpack(row["types"], row["n_types"], np.uint64, True)
    return types[unpack(row["index"], row["n_words"], np.int32)], np.frombuffer(row["counts"], np.int64)


def _asked(n: int, buckets: int):
    """Distinct n-grams of each batch with their counts, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = _words(row)
                types, times = np.unique(ngrams(hashes, counts, n)[0], return_counts=True)
                bucket = (types >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(types)])) if len(types) else np.zeros(1, int)
                out = [
                    (int(bucket[a]), row["batch"], n, int(b - a), pack(types[a:b], True), pack(times[a:b].astype(np.int32)))
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)
                ]
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "batch", "n", "size", "types", "times"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """Adds up a bucket's n-grams over all batches and answers each batch in its own order."""
    rows, answers = table.to_pylist(), []
    for n in sorted({r["n"] for r in rows}):
        own = [r for r in rows if r["n"] == n]
        every = np.concatenate([unpack(r["types"], r["size"], np.uint64, True) for r in own])
        times = np.concatenate([unpack(r["times"], r["size"], np.int32) for r in own])
        types, index = np.unique(every, return_inverse=True)
        total = np.bincount(index, weights=times, minlength=len(types)).astype(np.int64)[index]
        at = 0
        for r in own:
            answers.append((r["batch"], n, r["bucket"], r["size"], pack(total[at : at + r["size"]])))
            at += r["size"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*answers, strict=True), kinds, strict=True)], ["batch", "n", "bucket", "size", "totals"])


def _scored(order: int, least: int, all_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                hashes, counts = _words(row)
                totals: list[np.ndarray] = []  # count of the n-gram that ends at each word; 0 where the text is too short
                for n in range(1, order + 1):
                    answers = sorted((a["bucket"], a["size"], a["totals"]) for a in row["answers"] or [] if a["n"] == n)
                    total = np.concatenate([unpack(t, s, np.int64) for _, s, t in answers]) if answers else np.zeros(0, np.int64)
                    own, sizes = ngrams(hashes, counts, n)
                    types, index = np.unique(own, return_inverse=True)
                    ends = np.cumsum(counts)
                    short = np.minimum(counts, n - 1)
                    within = np.arange(counts.sum()) - np.repeat(ends - counts, counts)
                    at = np.zeros(len(hashes), np.int64)
                    at[within >= np.repeat(short, counts)] = total[index]
                    totals.append(at)
                used, score = np.ones(len(hashes), np.int64), np.rint(_MICRO * np.log(np.maximum(totals[0], 1) / max(all_words, 1)))
                longest = np.minimum(np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) + 1, order)
                backed = np.rint(_MICRO * np.log(ALPHA))
                score += backed * (longest - 1)
                for n in range(2, order + 1):
                    seen = totals[n - 1] >= least
                    history = np.concatenate(([0], totals[n - 2][:-1]))
                    ratio = np.divide(totals[n - 1], history, out=np.ones(len(hashes)), where=seen)
                    score = np.where(seen, np.rint(_MICRO * np.log(ratio)) + backed * (longest - n), score)
                    used = np.where(seen, n, used)
                of = np.repeat(np.arange(len(counts)), counts)
                add = lambda w: np.bincount(of, weights=w, minlength=len(counts)).astype(np.int64)
                by_order = [add(used == n) for n in range(1, order + 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order * len(counts) + 1, order, dtype=np.int32)), pa.array(np.stack(by_order, axis=1).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(counts), pa.array(add(score)), lists], ["doc_id", "n_words", "score_micro", "n_by_order"])

    return run


def score(docs: DataFrame, order: int = 3, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, score_micro`` (sum of log scores in millionths), ``n_by_order`` (words scored
    by n-grams of each order) and ``lm_score`` (mean log score of a word)."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    packed = write_table(chosen.mapInArrow(*_packed(kind)), "words")
    all_words = int(packed.agg(F.sum("n_words")).first()[0] or 0)
    buckets = max(1, all_words // BUCKET)
    answered = None
    for n in range(1, order + 1):  # one order at a time, so its exchange is gone before the next one's begins
        asked = packed.mapInArrow(_asked(n, buckets), "bucket int, batch long, n int, size long, types binary, times binary")
        counted = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_counted, "batch long, n int, bucket int, size long, totals binary")
        own = write_table(counted, f"answers-{n}")
        answered = own if answered is None else answered.unionByName(own)
    by_batch = answered.groupBy("batch").agg(F.collect_list(F.struct("n", "bucket", "size", "totals")).alias("answers"))
    joined = packed.join(by_batch, "batch", "left")
    out = joined.mapInArrow(_scored(order, least, all_words), f"doc_id {kind}, n_words long, score_micro long, n_by_order array<long>")
    return out.withColumn("lm_score", F.when(F.col("n_words") > 0, F.col("score_micro") / F.lit(_MICRO) / F.col("n_words")))
