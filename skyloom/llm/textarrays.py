"""Whole batches of texts as flat numpy arrays: words, 64-bit hashes, packed columns.

Hashes are 64-bit mixes that depend on nothing but the bytes, so they agree between executors and runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG = 64
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``; eight bytes are read at a time."""
    padded = data + b"\0" * 16
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = mix(lengths.astype(np.uint64) * _ODD[0] + _ODD[1])
    at = np.flatnonzero(lengths <= _LONG)
    done = 0
    while at.size:
        left = lengths[at] - done
        piece = eights[starts[at] + done] & _LOW[np.minimum(left, 8)]
        out[at] = mix((out[at] ^ piece) * _ODD[2] + _ODD[0])
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(lengths > _LONG):
        digest = hashlib.blake2b(data[starts[i] : starts[i] + lengths[i]], digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, of all texts in a row, and each text's number of words."""
    data = (b" ".join(texts) + b" ").lower()
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends_of_texts = np.cumsum(sizes + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_texts))))
    return spans_hash(data, starts, ends - starts), counts


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and each text's number of runs; order matters in a run."""
    if n == 1:
        return hashes, counts
    total = len(hashes) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    out = np.full(total, n, np.uint64)
    for k in range(n):
        out = mix((out + _ODD[2]) * _ODD[0] ^ hashes[k : k + total])
    text = np.repeat(np.arange(len(counts)), counts)
    return out[text[:total] == text[n - 1 :]], np.maximum(counts - n + 1, 0)


def blocks(texts: Sequence, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of at most ``limit`` characters together, or one longer text."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """An integer array as zstd bytes, its bytes dealt by place; ``delta``: differences of a sorted array."""
    if not len(values):
        return b""
    if delta:
        values = np.concatenate((values[:1], np.diff(values)))
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, count: int, dtype, delta: bool = False) -> np.ndarray:
    """The array that ``pack`` wrote, of ``count`` values."""
    if not count:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=count * size, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(size, count).T).view(dtype).reshape(count)
    return np.cumsum(values, dtype=dtype) if delta else values
