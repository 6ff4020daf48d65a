"""Embedding whitening by cyclic Jacobi rotations of the covariance.

Entries become integers, ``x = floor(64 * c) + 1000000``, so counts, sums and the scatter are whole numbers and the same
whatever the order of rows. Three passes over the table, each in Arrow batches: sums; products of the entries less their
rounded mean (the exact mean's fraction is taken off in whole numbers afterwards, so nothing cancels); and the whitened
rows, whose own covariance is measured for ``identity_error`` before they are returned. Each batch gives one partial sum of
d * (d + 1) / 2 entries; partial sums are added on the executors, and the driver gets d * (d + 1) / 2 numbers, whatever
the number of rows. There it rotates pairs of axes in cyclic order until all entries off the diagonal vanish; rotations by
the smaller angle leave small eigenvalues accurate. The projections, sorted by eigenvalue and scaled, go to the executors
as a matrix of at most d * COMPONENTS doubles.

Edge cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped; so are vectors whose length
is not the commonest (of equally common lengths the larger stays). An empty table gives no rows. A null vec_id is a row like
others, repeated rows all count and are all returned. Components without variance (within rounding: an eigenvalue below
``FLAT`` of the largest) can't be scaled to 1 and are not returned, so equal vectors, or a single one, give no rows. A
deviation that is larger than a long is null. Entries beyond 2**60 / 64 are taken as that. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Share of the largest eigenvalue that counts as none, for each dimension; sweeps of rotations, of which about ten are needed.
FLAT, SWEEPS = 2.0**-48, 60
#: Whole numbers that doubles hold exactly, and longs.
EXACT, LONG = 2**53, 2**63
#: The largest entry, and the bits of a limb: sums are sent as LIMBS longs each, which add up without overflow.
EDGE, LIMB, LIMBS = 2**60, 48, 3


def entries(batch: pa.RecordBatch, size: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: the places of the valid rows in the batch, and their entries as whole numbers."""
    lists = batch.column("embedding")
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.zeros(len(lengths), dtype=bool)
    bad[row[~np.isfinite(values)]] = True
    start = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths[(lengths > 0) & ~bad]).tolist() if size is None else [size]:
        at = np.flatnonzero((lengths == n) & ~bad)
        if len(at):
            c = values[start[at][:, None] + np.arange(n)]
            with np.errstate(over="ignore"):
                c = np.floor(c * SCALE)
            edge = float(EDGE)
            out[n] = at, np.clip(c, -edge, edge).astype(np.int64) + OFFSET
    return out


def _columns(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if not len(x) or int(np.abs(x).max()) < LONG // max(1, len(x)):
        return x.sum(0).tolist()
    return [sum(c) for c in x.T.tolist()]


def _products(y: np.ndarray) -> list[int]:
    """Exact sums of the products of all pairs of columns, the upper triangle in order of rows."""
    upper = np.triu_indices(y.shape[1])
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z)[upper].astype(np.int64).tolist()
    columns = y.T.tolist()
    return [sum(a * b for a, b in zip(columns[i], columns[j], strict=True)) for i, j in zip(*upper, strict=True)]


def limbs(values: list[int]) -> list[int]:
    """Whole numbers of any size that a batch can give as longs: their lowest limbs, then the next ones; the last is signed."""
    low = (1 << LIMB) - 1
    return [v & low for v in values] + [v >> LIMB & low for v in values] + [v >> 2 * LIMB for v in values]


def whole(sums: list[int]) -> list[int]:
    n = len(sums) // LIMBS
    return [sums[i] + (sums[n + i] << LIMB) + (sums[2 * n + i] << 2 * LIMB) for i in range(n)]


def _summed(partial: DataFrame, kind: str = "decimal(38,0)") -> list:
    """The arrays v of partial sums added up on the executors, entry by entry."""
    x = partial.select(F.posexplode("v").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    return [r["v"] for r in x.orderBy("pos").collect()]


def sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """The dimension, the number of vectors and the sum of each entry; 0 without vectors."""

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [{"size": n, "n": len(x), "v": limbs(_columns(x))} for n, (_, x) in entries(batch).items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("size", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.int64()))]))

    parts = materialize(vectors.mapInArrow(one, "size long, n long, v array<long>"), "sums")
    size = parts.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return 0, 0, []
    return size["size"], size["n"], whole([int(v) for v in _summed(parts.where(F.col("size") == size["size"]))])


def scatter(vectors: DataFrame, d: int, n: int, total: list[int]) -> np.ndarray:
    """The covariance: exact sums of products about the rounded mean, less the product of what the rounding left."""
    near = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, x in entries(batch, d).values():
                yield pa.RecordBatch.from_arrays([pa.array([limbs(_products(x - near))], pa.list_(pa.int64()))], ["v"])

    got = whole([int(v) for v in _summed(vectors.mapInArrow(one, "v array<long>"))])
    left = [s - n * m for s, m in zip(total, near.tolist(), strict=True)]  # sums of x less the rounded mean
    out = np.zeros((d, d))
    for (i, j), s in zip(zip(*np.triu_indices(d), strict=True), got, strict=True):
        out[i, j] = out[j, i] = (n * s - left[i] * left[j]) / n**2  # one rounding
    return out


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows of a symmetric matrix, by rotations in cyclic order."""
    a, v = a.copy(), np.eye(len(a))
    for _ in range(SWEEPS):
        rotated = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                if a[p, q] == 0 or abs(a[p, q]) <= 2.0**-60 * math.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                rotated = True
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = math.copysign(1, theta) / (abs(theta) + math.hypot(theta, 1))
                c = 1 / math.hypot(t, 1)
                s, app, aqq, apq = t * c, a[p, p], a[q, q], a[p, q]
                rp, rq = a[p].copy(), a[q].copy()
                a[p], a[q] = c * rp - s * rq, s * rp + c * rq
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
                vp = v[p].copy()
                v[p], v[q] = c * vp - s * v[q], s * vp + c * v[q]
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[order]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each valid vector and component."""
    spark = vectors.sparkSession
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    d, n, total = sums(x.select("embedding"))
    if not n:
        return spark.createDataFrame([], SCHEMA + ", identity_error double")
    v = scatter(x.select("embedding"), d, n, total)
    e, axes = jacobi(v)
    m = int((e[:components] > FLAT * d * e[0]).sum()) if e[0] > 0 else 0
    if not m:
        return spark.createDataFrame([], SCHEMA + ", identity_error double")
    near = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    left = [s - n * k for s, k in zip(total, near.tolist(), strict=True)]
    sent = spark.sparkContext.broadcast((near, np.array([k / n for k in left]), axes[:m] / np.sqrt(e[:m])[:, None], e[:m] / np.trace(v)))

    def projected(x: np.ndarray) -> np.ndarray:
        near, rest, matrix, _ = sent.value
        return (x - near - rest) @ matrix.T

    def deviation(x: np.ndarray) -> list[int | None]:
        y = x - sent.value[0]
        most = max(int(np.abs(y).max(initial=0)) * n + n, 1)
        if most * most * d < LONG:
            z = n * y - np.array(left, dtype=np.int64)
            return (z * z).sum(1).tolist()
        found = [sum((n * int(a) - b) ** 2 for a, b in zip(r, left, strict=True)) for r in y.tolist()]
        return [s if s < LONG else None for s in found]

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, x in entries(batch, d).values():
                w = projected(x)
                both = np.concatenate([w.sum(0), (w.T @ w)[np.triu_indices(m)]])
                yield pa.RecordBatch.from_arrays([pa.array([both.tolist()], pa.list_(pa.float64()))], ["v"])

    got = _summed(x.select("embedding").mapInArrow(measured, "v array<double>"), "double")
    mean, error = np.array(got[:m]) / n, 0.0
    for (i, j), s in zip(zip(*np.triu_indices(m), strict=True), got[m:], strict=True):
        error = max(error, abs(s / n - mean[i] * mean[j] - (i == j)))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, x in entries(batch, d).values():
                k = len(at)
                ids = pa.array(np.repeat(at, m))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(ids),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                        pa.array(np.full(k * m, n, dtype=np.int64)),
                        pa.array(deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), m))),
                        pa.array(projected(x).ravel()),
                        pa.array(np.tile(sent.value[3], k)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return x.mapInArrow(rows, SCHEMA).withColumn("identity_error", F.lit(float(error)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
