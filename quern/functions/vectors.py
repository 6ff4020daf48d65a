"""Vector expressions: cosine similarity, validation and the binary codec."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many dimensions the sums are unrolled, which keeps them in generated code.
UNROLL = 256


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Of two vector columns: 0 for different sizes or a zero norm; summed as double, returned as float."""
    d = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (d == 0), F.lit(0.0)).otherwise(dot(a, b) / d).cast("float")


def cosine_to(a: Column, query: Sequence[float], a_norm: Column | None = None) -> Column:
    """Of a vector column and one query vector. ``a_norm``: the column's norm, where the index keeps it."""
    q = [float(x) for x in query]
    if len(q) > UNROLL:
        return cosine(a, F.lit(q))
    parts = [F.get(a, F.lit(i)).cast("double") for i in range(len(q))]
    n = F.sqrt(_sum([p * p for p in parts])) if a_norm is None else a_norm
    d = n * math.sqrt(sum(x * x for x in q))
    return F.when((F.size(a) != len(q)) | (d == 0), F.lit(0.0)).otherwise(_sum([p * x for p, x in zip(parts, q, strict=True)]) / d).cast("float")


def validate_query(query: Sequence[float], dims: int) -> list[float]:
    if len(query) != dims or not all(math.isfinite(x) for x in query):
        raise ValueError(f"query vector must have {dims} finite values")
    return [float(x) for x in query]


def encode_vector(v: Sequence[float]) -> bytes:
    return struct.pack(f"<{len(v)}f", *v)


def decode_vector(data: bytes, dims: int) -> list[float]:
    if len(data) != 4 * dims:
        raise ValueError(f"vector of {dims} dimensions needs {4 * dims} bytes, got {len(data)}")
    return list(struct.unpack(f"<{dims}f", data))
