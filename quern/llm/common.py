"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import drop_table, materialize, shared_dir, table  # noqa: F401  (re-exported)

WORD_SPACE = "\t\n\x0b\x0c\r "


def spark_schema(**fields: str) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's strings; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


class WordHash(dict):
    """64-bit hash of a word, remembered; emptied when large, which changes no value."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixer of 64-bit values."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hash(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k neighbouring words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        out ^= out >> np.uint64(29)
    return mix64(out)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = fn(batch)
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(each, schema)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


#: Rows of a few bytes that one task can take, whatever their keys.
FEW = 5_000_000
HOT, HOT_KEYS = 10_000, 10_000


def split_join(rows: DataFrame, keyed: DataFrame, *keys: str, total: int | None = None) -> DataFrame:
    """rows joined with ``keyed``: one row for each key, with the number ``n`` of its rows. No key's rows meet in one task.

    A key of more than HOT rows and of more than one in HOT_KEYS of all rows is sent to every executor, so at most HOT_KEYS
    rows are; the others are joined by a shuffle. Tables of at most FEW rows (``total``, else counted) are joined as they are.
    """
    total = rows.count() if total is None else total
    if total <= FEW:
        return rows.join(keyed, list(keys))
    keyed = materialize(keyed, "keyed")
    limit = max(HOT, total // HOT_KEYS)
    if (keyed.agg(F.max("n")).first()[0] or 0) <= limit:
        return rows.join(keyed, list(keys))
    hot = keyed.where(F.col("n") > limit)
    often = rows.join(F.broadcast(hot), list(keys))
    seldom = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(keyed.where(F.col("n") <= limit), list(keys))
    return often.unionByName(seldom)


SAMPLE = 65_536


def borders(keys: DataFrame, weight: str, parts: int) -> list[tuple]:
    """Up to parts - 1 ascending border keys between ranges of about equal weight.

    ``keys`` has the columns that order the rows, then ``weight``. The borders are quantiles of the SAMPLE distinct keys
    with the smallest hashes, whatever the size of the table, its partitions and the spread of its keys, so the same rows
    give the same borders.
    """
    names = [c for c in keys.columns if c != weight]
    x = keys.groupBy(*names).agg(F.sum(weight).cast("double").alias(weight))
    some = sorted(tuple(r) for r in x.orderBy(F.xxhash64(*names), *names).limit(SAMPLE).collect())
    whole, seen, out = sum(r[-1] for r in some), 0.0, []
    for r in some:
        if seen > whole * (len(out) + 1) / parts and len(out) + 1 < parts:
            out.append(r[:-1])
        seen += r[-1]
    return out


def part_of(keys: list[Column], found: list[tuple]) -> Column:
    """The number of borders that are not above a row's key, found in two steps of about the root of their number."""
    if not found:
        return F.lit(0)
    kinds = ", ".join(f"k{i} {'bigint' if isinstance(v, int) else 'string'}" for i, v in enumerate(found[0]))
    each = max(1, int(len(found) ** 0.5))
    own = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))

    def literal(some: list[tuple]) -> Column:
        return F.array(*(F.struct(*(F.lit(v).alias(f"k{i}") for i, v in enumerate(b))) for b in some)).cast(f"array<struct<{kinds.replace(' ', ':')}>>".replace(",:", ","))

    count = lambda a: F.size(F.filter(a, lambda b: b <= own))
    first = F.greatest(count(literal(found[::each])) - 1, F.lit(0)) * each
    return first + count(F.slice(literal(found), first + 1, F.lit(each)))


class Scratch:
    """Written tables of one run; those that its result doesn't read can be dropped before it ends."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        self.tables.append(materialize(df, name, compression))
        return self.tables[-1]

    def drop_all_but(self, *kept: DataFrame) -> None:
        for t in self.tables:
            if not any(t is k for k in kept):
                drop_table(t)
        self.tables = list(kept)


__all__ = ["F", "WORD_SPACE", "Scratch", "WordHash", "arrow_map", "borders", "documents", "materialize", "mix64", "part_of", "run_hash", "shared_dir", "spark_schema", "split_join", "table", "texts"]
