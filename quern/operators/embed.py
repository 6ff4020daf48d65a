"""Embedding: a deterministic offline embedder, and a build that embeds each distinct content once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.catalog import dedup_cached

Embedder = Callable[[list[str]], np.ndarray]


def fake_embedder(dims: int = 8) -> Embedder:
    """Vectors from the FNV-1a hash of the text, continued by a linear congruential generator."""

    def embed(texts: list[str]) -> np.ndarray:
        seed = np.empty(len(texts), dtype=np.uint64)
        for i, t in enumerate(texts):
            h = 2166136261
            for b in t.encode("utf-8", "surrogatepass"):
                h = (h ^ b) * 16777619 & 0xFFFFFFFF
            seed[i] = h
        out = np.empty((len(texts), dims), dtype=np.float32)
        for k in range(dims):
            seed = (seed * np.uint64(1664525) + np.uint64(1013904223)) & np.uint64(0xFFFFFFFF)
            out[:, k] = (seed % np.uint64(1000)).astype(np.float32) / np.float32(1000)
        return out

    return embed


def embed(rows: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """The rows with a vector column; an embedder that wants clients makes them on first use in each worker."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            v = embedder([x or "" for x in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v), pa.list_(pa.float32()))], [*batch.schema.names, "vector"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(each, f"{fields}, vector array<float>")


def build(chunks: DataFrame, cache: DataFrame, embedder: Embedder, dims: int) -> DataFrame:
    """Chunks (content_hash, content) with vectors: the cache's first of a hash, else embedded once for each hash."""
    joined, misses = dedup_cached(chunks, cache)
    once = chunks.join(misses, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("content").alias("content"))
    fresh = embed(once, embedder).select("content_hash", F.col("vector").alias("fresh"))
    x = joined.join(fresh, "content_hash", "left").withColumn("vector", F.coalesce("cached", "fresh")).drop("cached", "fresh")
    wrong = F.raise_error(F.lit(f"embedding doesn't have {dims} dimensions"))
    return x.withColumn("vector", F.when(F.size("vector") == dims, F.col("vector")).otherwise(wrong.cast("array<float>")))
