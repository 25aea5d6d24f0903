"""Near-duplicate documents by MinHash with tensored banding; every link is confirmed on full shingle sets.

A document's table keys are all pairs of one band from each of two small collections: 2 x ``BANDS`` bands of ``ROWS``
minhashes give ``BANDS`` squared keys, so the minhashes to compute are about a square root of what as many separate keys
would need. Documents of one shingle set are one node from the start, so exact copies cost nothing later.

Nodes meet in buckets of equal keys. A bucket's nodes whose sketches leave a link possible are tied by a spanning forest, so a
bucket never yields more ties than nodes; ties of all buckets form candidate groups. Within a group every pair is
decided exactly, though no pair is ever a row: the group's sets are cut into blocks of bounded size, and each node is held against
every block by an inverted index over the block's shingles. Only links that join what was apart leave a block.
The sketches of buckets beyond ``BUCKET`` nodes aren't compared: each of their nodes is tied to the key itself, which is a node in
that step alone, so the whole bucket is in one group, whose blocks decide every pair. Whatever many rows share, a key, a
hub, a group or a text, is met in many tasks.

Null or wordless texts have an empty set and link with nothing. Repeated rows and repeated ids each get their row; a null id
is never a component's id unless it has no other, and is not kept. An empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import SPREAD, spread_join, write_table
from .textarrays import blocks, mix, ngrams, pack, unpack, words

#: Bands in each of the two collections, and minhashes in a band: 64 keys from 32 minhashes. A pair of likeness 0.8 shares
#: none with a chance of 0.0006, one of 0.85 with 0.00007.
BANDS, ROWS = 8, 2
#: A pair is a candidate if so many of the 32 minhashes agree; a pair of likeness 0.8 does all but once in 50,000.
AGREE = 16
#: Nodes of a bucket whose sketches are compared, and shingles of a block that is decided, in one task at a time.
BUCKET, BLOCK = 2000, 1_000_000
TEXT_BLOCK = 1 << 20
#: Bytes of a node, the digest of a set.
NODE = 16
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than ``n`` are one shingle."""
    hashes, counts = words(texts)
    runs, sizes = ngrams(hashes, counts, n)
    ends, word_ends = np.cumsum(sizes), np.cumsum(counts)
    out = []
    for i in range(len(texts)):
        own = runs[ends[i] - sizes[i] : ends[i]]
        if not sizes[i] and counts[i]:
            own = ngrams(hashes[word_ends[i] - counts[i] : word_ends[i]], counts[i : i + 1], int(counts[i]))[0] ^ np.uint64(counts[i])
        out.append(np.unique(own))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minhashes of non-empty sets, one row each."""
    ends = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        x = flat * seed
        out[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), ends[:-1])
    return mix(out)


def keys(sketch: np.ndarray) -> np.ndarray:
    """The table keys of each sketch: every band of the first collection with every band of the second."""
    bands = np.full((len(sketch), 2 * BANDS), 7, np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0xC2B2AE3D27D4EB4F) + sketch[:, r::ROWS])
    first, second = bands[:, :BANDS], bands[:, BANDS:]
    pairs = mix(first[:, :, None] * np.uint64(0x165667B19E3779F9) + second[:, None, :])
    return (pairs + np.arange(BANDS * BANDS, dtype=np.uint64).reshape(BANDS, BANDS)).reshape(len(sketch), -1)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()]


def _node(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=NODE).digest()


def _sketched(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for lo, hi in blocks(texts, TEXT_BLOCK):
                sets = shingle_sets(texts[lo:hi], n)
                full = [i for i, s in enumerate(sets) if len(s)]
                found = sketches([sets[i] for i in full]).tolist() if full else []
                of = dict(zip(full, found, strict=True))
                sketch = [np.array(of[i], np.uint64).tobytes() if i in of else None for i in range(len(sets))]
                node = [_node(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary())],
                    [*batch.schema.names[:-1], "n_shingles", "node", "sketch"],
                )

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            found = keys(sketch).view(np.int64)
            ends = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
            small = (sketch >> np.uint64(56)).astype(np.uint8)  # a byte of each minhash is enough to compare sketches
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in small], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["node", "small", "keys"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Buckets of a partition that is sorted by key; one bucket of at most BUCKET nodes is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        if held and held[-1].column("key")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(starts, starts[1:], strict=False):
            held.append(batch.slice(lo, hi - lo))
            if hi < len(key):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _small(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("small").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties within each bucket: a spanning forest of the nodes whose sketches leave a link possible."""
    out: set[tuple[bytes, bytes]] = set()
    for table in _groups(batches):
        names = table.column("node").to_pylist()
        small = _small(table)
        order = np.array(sorted(range(len(names)), key=names.__getitem__))
        while len(order):  # a tree from the least name that is left
            todo, order = [order[0]], order[1:]
            while todo and len(order):
                i = todo.pop()
                near = (small[order] == small[i]).sum(axis=1) >= AGREE
                out.update((names[i], names[k]) for k in order[near])
                todo += order[near].tolist()
                order = order[~near]
        if len(out) > 20_000:
            yield _batch(sorted(out), a=pa.binary(), b=pa.binary())
            out = set()
    yield _batch(sorted(out), a=pa.binary(), b=pa.binary())


def _batch(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def _decide(percent: int):
    """Links within blocks, whose members come before the nodes that are only held against them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sets, names, out = None, [], [], []
        flat = owner = sizes = None
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def ask(name: bytes, own: np.ndarray) -> None:
            lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            count = hi - lo
            at = np.repeat(hi - np.cumsum(count), count) + np.arange(count.sum())
            both = np.bincount(owner[at], minlength=len(names))
            for k in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                x, y = root(name), root(names[k])
                if x != y:
                    up[max(x, y)] = min(x, y)
                    out.append((name, names[k]))

        def ready() -> None:
            nonlocal flat, owner, sizes
            sizes = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for name, own in zip(names, sets, strict=True):
                ask(name, own)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("label", "part", "member", "node", "n", "shingles"))
            for label, part, member, node, n, data in zip(*columns, strict=True):
                if place != (label, part):
                    if sets and flat is None:
                        ready()
                    place, sets, names, flat = (label, part), [], [], None
                    up.clear()
                own = unpack(data, n, np.uint64, True)
                if member:
                    names.append(node)
                    sets.append(own)
                else:
                    if flat is None:
                        ready()
                    ask(node, own)
            if len(out) > 20_000:
                yield _batch(out, a=pa.binary(), b=pa.binary())
                out = []
        if sets and flat is None:
            ready()
        yield _batch(out, a=pa.binary(), b=pa.binary())

    return run


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` for every node of ``links`` (a, b); the label is the least node that is reachable.

    Alternates large-star and small-star steps until nothing changes; all state is in written tables, and the neighbours of
    a hub are spread over tasks.
    """
    both = F.array_sort(F.array("a", "b"))
    edges = write_table(links.where("a != b").select(both[1].alias("a"), both[0].alias("b")).distinct(), name)
    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = state(edges)
    while True:
        arcs = edges.union(edges.select("b", "a"))
        least = arcs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = spread_join(edges, F.col("a"), least, "b").select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a != b").distinct()
        edges = write_table(small, name)
        before, now = now, state(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", mark: Column | None = None
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``. Links: 100 x intersection >= percent x union.

    With a binary ``mark`` that tells texts of one id apart, there is a column ``mark`` and of a component's rows of the least
    id only those of the least mark are kept.
    """
    marks = [] if mark is None else [mark.alias("mark")]
    chosen = docs.select(F.col(id_col).alias("doc_id"), *marks, F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString() + ", mark binary" * len(marks)
    sketched = write_table(chosen.mapInArrow(_sketched(shingle), f"doc_id {kind}, n_shingles long, node binary, sketch binary"), "sketches")
    nodes = sketched.where("node is not null").groupBy("node").agg(F.any_value("sketch").alias("sketch"))
    keyed = write_table(nodes.mapInArrow(_keyed, "node binary, small binary, keys array<long>"), "keys")
    spread = keyed.select("node", F.explode("keys").alias("key"))
    crowded = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # whether its key is frequent isn't known where a node is read, so all rows of a key are dealt, and each key that two have
    dealt, parts = F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int"), F.explode(F.array(*map(F.lit, range(SPREAD))))
    met = spread.withColumn("_spread", dealt).join(crowded.withColumn("_spread", parts).hint("merge"), ["key", "_spread"])
    mates = write_table(met.select("key", "node", (F.col("n") > BUCKET).alias("large")), "mates")
    name = F.concat(F.lit(b"\x00"), F.unhex(F.lpad(F.hex("key"), 16, "0")))  # a key as a node, of another length than nodes
    whole = mates.where("large").select(name.alias("a"), F.col("node").alias("b"))

    by_bucket = mates.where("not large").join(keyed.select("node", "small").hint("merge"), "node").repartition("key").sortWithinPartitions("key")
    ties = by_bucket.select("key", "node", "small").mapInArrow(_forest, "a binary, b binary")
    grouped = write_table(components(ties.unionByName(whole), "ties").where(F.octet_length("node") == NODE), "groups")

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch)
            for lo, hi in blocks(texts, TEXT_BLOCK):
                sets = shingle_sets(texts[lo:hi], shingle)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([pack(s, True) for s in sets], pa.binary())],
                    ["node", "n", "shingles"],
                )

    # one document of each node that is in a group; its set is made again from its whole text
    wanted = grouped.select("node").join(sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id")), "node")
    wanted = wanted.select("id").distinct()
    texts = chosen.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text").where("text is not null")
    sets = write_table(texts.mapInArrow(set_rows, "node binary, n long, shingles binary").dropDuplicates(["node"]), "sets")

    sized = sets.select("node", "n").join(grouped, "node")
    totals = sized.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = spread_join(sized, F.col("node"), totals, "label").select("label", "node", own.alias("own")).join(sets, "node")
    # a node is a member of its own block, and is held against the blocks before it
    rows = placed.select("label", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("part"), "own", "node", "n", "shingles")
    rows = rows.withColumn("member", F.col("part") == F.col("own")).drop("own")
    blocked = rows.repartition("label", "part").sortWithinPartitions("label", "part", F.desc("member"))
    last = components(blocked.mapInArrow(_decide(percent), "a binary, b binary"), "links")

    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")) if marks else F.col("doc_id")
    of = write_table(
        sketched.where("node is not null").groupBy("node").agg(F.min(own).alias("least")).join(last, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least"), "labels"
    )
    firsts = of.groupBy("label").agg(F.min("least").alias("first"))
    ids = spread_join(of, F.col("node"), firsts, "label").select("node", "first")
    out = spread_join(sketched.drop("sketch"), F.col("doc_id"), ids, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first")["doc_id"] if marks else F.col("first"))
    kept = F.when(F.col("node").isNull(), F.col("doc_id").isNotNull()).otherwise(F.coalesce(own == F.col("first"), F.lit(False)))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *["mark"] * len(marks))
