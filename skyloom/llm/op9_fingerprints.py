"""Document fingerprints from content-defined chunks.

A gear hash, in which the last 32 bytes count, marks possible boundaries; chunks are cut by normalised chunking (a strict mask
below the usual size, a loose one above it, with a least and a greatest size). A text's fingerprint is the set of
its chunks' digests with their lengths, so an edit changes the chunks around it and no others. Likeness is containment:
the share of a text's distinct chunk bytes whose chunks the other text has too.

Null text counts as empty; an empty text's fingerprint is empty, wholly contained in an empty one and not at all in
others. Repeated rows and ids each get a row (neighbours of one id by text, null ids come last). An empty table gives an
empty one; other columns are not read. Ids must be of a whole-number type; a table whose ids are not is refused.

Texts are range-sorted by id into parts, one task each; null ids are range-sorted among themselves by their texts' digests. A part
is streamed, and gets the first document of the next one besides its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import mix, spans_hash

#: Bytes of a chunk: least, usual and greatest; bits of the strict and the loose mask.
LEAST, USUAL, GREATEST, STRICT, LOOSE = 32, 96, 384, 8, 5
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Texts are range-sorted into parts of about so many bytes, but into no more parts than this; a part is streamed.
PART_BYTES, PARTS = 24 << 20, 20_000


def gear(data: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash after each byte: the sum of the last 32 table values, each shifted by its age."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint32(k) if len(h) > k else 0
        h = h + older
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0) + 1
    strict = loose[h[loose - 1] >> np.uint32(32 - STRICT) == 0].tolist()
    loose = loose.tolist()
    out, at, i, j = [], 0, 0, 0
    while n - at > LEAST:
        while i < len(strict) and strict[i] < at + LEAST:
            i += 1
        if i < len(strict) and strict[i] <= at + USUAL:
            end = strict[i]
        else:
            while j < len(loose) and loose[j] <= at + USUAL:
                j += 1
            end = min(loose[j] if j < len(loose) else n, at + GREATEST, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def chunks(text: str) -> dict[int, int]:
    """Digest and length of each distinct chunk."""
    data = text.encode()
    ends = np.array(cuts(data), np.int64)
    if not len(ends):
        return {}
    starts = np.concatenate(([0], ends[:-1]))
    return dict(zip(spans_hash(data, starts, ends - starts).tolist(), (ends - starts).tolist(), strict=True))


def written(found: dict[int, int]) -> str:
    """A fingerprint as text: ``digest:length`` of each chunk, by digest."""
    return ",".join(f"{d:016x}:{n}" for d, n in sorted(found.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of the bytes of ``a``'s distinct chunks whose chunks ``b`` has."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``after`` (or all of them)."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, the next document in descending id order lending the edit.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Ids must be whole numbers.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be a whole number")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    bytes_of = lambda known: F.sum(F.when(F.col("doc_id").isNotNull() == known, F.octet_length("text")))
    size = chosen.agg(bytes_of(True), F.count("doc_id"), bytes_of(False)).first()
    parts, nulls = (min(PARTS, max(1, int(n or 0) // PART_BYTES + 1)) for n in (size[0], size[2]))
    # part borders from quantiles of the ids: as many numbers as parts
    quantiles = chosen.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if size[1] and parts > 1 else []
    borders = np.array(sorted({int(x) for x in quantiles}), np.int64)

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(borders, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    start = F.conv(F.left(F.sha2("text", 256), F.lit(8)), 16, 10).cast("long")
    among_nulls = F.shiftright(start * nulls, 32).cast("int")
    dealt = chosen.withColumn("part", F.when(F.col("doc_id").isNull(), among_nulls).otherwise(part_of("doc_id") + nulls))
    # the first document of each part, in descending order, follows the last one of the part before
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.sha2("text", 256).alias("digest"))
    heads = sorted(((r.part, r.doc_id, r.digest) for r in dealt.groupBy("part").agg(F.max(key).alias("k")).select("part", "k.doc_id", "k.digest").collect()), reverse=True)  # a row a part
    lent = []
    for (to, *_), (_, doc, digest) in zip(heads, heads[1:] + heads[:1], strict=True):
        lent.append((to, doc, digest))
    spark = docs.sparkSession
    asked = spark.createDataFrame(lent, "to int, head long, digest string")
    same = F.col("doc_id").eqNullSafe(F.col("head")) & (F.sha2("text", 256) == F.col("digest"))
    heads_df = chosen.join(F.broadcast(asked.select("head").distinct()), F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
    ghosts = heads_df.join(F.broadcast(asked), same).dropDuplicates(["to"]).select("doc_id", "text", F.col("to").alias("part"), F.lit(True).alias("ghost"))
    every = dealt.select("doc_id", "text", "part", F.lit(False).alias("ghost")).unionByName(ghosts)
    order = ["part", "ghost", F.desc_nulls_last("doc_id"), F.desc(F.sha2("text", 256))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for doc, text, part, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = chunks(text)
                if held is not None and held[2] == part:
                    new = edited(held[1], text)
                    found = chunks(new)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), written(held[3]), written(found), containment(held[3], found), containment(held[3], own)))
                held = None if ghost else (doc, text, part, own)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    sorted_parts = every.repartitionById(parts + nulls, F.col("part")).sortWithinPartitions(*order)
    return sorted_parts.select("doc_id", "text", "part", "ghost").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
