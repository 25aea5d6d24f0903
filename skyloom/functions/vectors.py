"""Vector functions over ``array<double>`` columns, and a little-endian float32 codec.

A zero or non-finite vector is left as it is and scores 0; vectors of unequal length raise.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; raises if the lengths differ, null if either is null."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    total = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    same = F.size(a) == F.size(b)
    return F.when(a.isNull() | b.isNull(), None).when(same, total).otherwise(F.raise_error(F.lit("vectors of unequal length")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def usable(n: Column) -> Column:
    """Whether a norm can be divided by."""
    return (n > 0) & (n < float("inf")) & ~F.isnan(n)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it: inside a lambda it would be for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero or non-finite one stays."""
    return once(a, lambda v: once(norm(v), lambda n: F.when(usable(n), F.transform(v, lambda x: x / n)).otherwise(v)))


def center(a: Column, centroid: Column) -> Column:
    """The unit vector without the corpus centroid, at length 1 again."""
    return unit(F.zip_with(unit(a), centroid, lambda x, m: x - m))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with both lengths divided out; 0 where that is impossible, never clamped."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when(usable(size), dot(a, b) / size).otherwise(F.lit(0.0))


@F.arrow_udf(T.BinaryType())
def pack_vector(vectors: pa.Array) -> pa.Array:
    """Little-endian float32 bytes of each vector."""
    return pa.array([None if v is None else np.asarray(v, "<f4").tobytes() for v in vectors.to_pylist()], pa.binary())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def unpack_vector(data: pa.Array) -> pa.Array:
    """The vector of little-endian float32 bytes; null if they aren't a whole number of floats."""
    return pa.array([None if d is None or len(d) % 4 else np.frombuffer(d, "<f4").tolist() for d in data.to_pylist()], pa.list_(pa.float32()))


def floats_in(data: Column) -> Column:
    """How many float32 values the bytes hold; null if they aren't a whole number."""
    return F.when(F.octet_length(data) % 4 == 0, (F.octet_length(data) / 4).cast("int"))


def hex_to_base64(c: Column) -> Column:
    """A ``\\x...`` literal as base64."""
    return F.base64(F.unhex(F.regexp_replace(c, r"^\\x", "")))


def base64_to_hex(c: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(F.unbase64(c))))


def decode_centroid(text: str) -> list[float]:
    """A stored centroid: base64 of little-endian float32."""
    return np.frombuffer(base64.b64decode(text), "<f4").astype(float).tolist()
