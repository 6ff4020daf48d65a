"""Best-fit packing of token sequences by exact-complement hashing.

Documents become pieces of at most ``CAPACITY`` tokens: ids of the public byte-level vocabulary, then id 0; only longer
documents are cut, the first piece taking the remainder. The packing is planned on the histogram of piece lengths,
which has at most ``CAPACITY`` entries whatever the corpus. From the longest length down, the gap that a piece leaves
is looked up among single lengths and in an index of the sums of two and of three lengths, and combinations that fill it
exactly are consumed under the availability counts; every such step uses up a length, so there are at most a few
thousand patterns. What is left goes by best fit, in bulk for equal lengths. Pieces then find their place by their rank among
pieces of equal length: rank ranges belong to patterns. A common length is ranked in buckets of about the square root
of its count, so no task holds a length.

Edge cases: a null text is empty and gives one piece, the closing id; rows that repeat a doc_id are packed each; a null
doc_id is packed like any other; a very long text is many pieces; the string of an added token is that token, as in
``tokenizers``; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, documents, materialize, texts

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
#: Code points on which both tokenizer libraries split words by the same character classes; other texts take the slower one.
_PLAIN = re.compile("[^\x00-ɏ‐-‧€]")


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY):
    """Texts to lists of ids, as the ``tokenizers`` library gives them for the vocabulary ``name``.

    The same vocabulary's ranks give the same ids several times faster; texts with unusual characters or the string of an
    added token go to ``tokenizers``.
    """
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    with open(public.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(public.path(f"{name}.json"))
    added = [t.content for t in full.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        slow = _PLAIN.search(text) or any(t in text for t in added)
        return full.encode(text, add_special_tokens=False).ids if slow else fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens; the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves) of each piece."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary)
        ids_of = batch.column("doc_id").to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for doc, text in zip(ids_of, texts(batch, "text"), strict=True):
            ids = np.array([*encode(text), 0], dtype="<u4")
            for k, (s, n) in enumerate(cut(len(ids), capacity)):
                part = ids[s : s + n]
                for column, v in zip(out, (doc, k, s, n, zlib.crc32(part.tobytes()), part if tokens else None), strict=True):
                    column.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        last = 6 if tokens else 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:last], kinds, strict=False)], names[:last])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * tokens
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, schema)


def _by_sum(largest: np.ndarray, total: np.ndarray) -> dict[int, np.ndarray]:
    """Sum to the largest lengths of the combinations that make it, longest first."""
    order = np.lexsort((-largest, total))
    sums, first = np.unique(total[order], return_index=True)
    return dict(zip(sums.tolist(), np.split(largest[order], first[1:]), strict=True)) if len(sums) else {}


def index_sums(lengths: np.ndarray, capacity: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Hash tables of pair and of triple sums below the capacity: the largest length of each pair, and of each triple.

    The rest of a pair is its other length; the rest of a triple is a pair sum. At most capacity**2 entries each.
    """
    x, y = (v.ravel() for v in np.meshgrid(lengths.astype(np.int32), lengths.astype(np.int32)))
    ok = (x >= y) & (x + y < capacity)
    pairs = _by_sum(x[ok], (x + y)[ok])
    x, y = (v.ravel() for v in np.meshgrid(lengths.astype(np.int32), np.array(list(pairs), dtype=np.int32)))
    ok = (2 * x >= y) & (x + y < capacity)
    return pairs, _by_sum(x[ok], (x + y)[ok])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, longest first) and how many sequences have each."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in histogram.items():
        have[n] = c
    patterns: list[tuple[tuple[int, ...], int]] = []

    def consume(lengths: tuple[int, ...]) -> bool:
        """Take as many of the combination as there are."""
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        times = min(int(have[n]) // k for n, k in need.items())
        if times:
            for n, k in need.items():
                have[n] -= k * times
            patterns.append((tuple(sorted(lengths, reverse=True)), times))
        return times > 0

    pairs, triples = index_sums(np.flatnonzero(have), capacity)
    none = np.zeros(0, dtype=np.int32)

    def of_pair(total: int, most: int) -> list[int]:
        """The longer lengths, up to most, of available pairs of that sum."""
        a = pairs.get(total, none)
        return a[(a <= most) & (have[a] > 0) & (have[total - a] > 0)].tolist()

    for n in range(capacity, 0, -1):
        gap = capacity - n
        if have[n] and not gap:
            consume((n,))
        if have[n] and gap:
            consume((n, gap))  # the single that fits exactly
        for x in of_pair(gap, gap) if have[n] else ():
            consume((n, x, gap - x))
            if not have[n]:
                break
        for x in triples.get(gap, none).tolist() if have[n] else ():
            for y in of_pair(gap - x, x) if have[x] else ():
                consume((n, x, y, gap - x - y))
                if not have[n]:
                    break
            if not have[n]:
                break

    # best fit of the rest: open sequences by their gap, as pattern and count
    by_gap: dict[int, list[list]] = {}
    for n in range(capacity, 0, -1):
        left = int(have[n])
        while left:
            fits = [g for g in by_gap if g >= n]
            if not fits:
                each = capacity // n
                full, some = divmod(left, each)
                for k, times in ((each, full), (some, 1)):
                    if k and times:
                        by_gap.setdefault(capacity - k * n, []).append([(n,) * k, times])
                break
            g = min(fits)
            lengths, times = by_gap[g].pop()
            if not by_gap[g]:
                del by_gap[g]
            each = min(g // n, left)
            used = min(times, left // each)
            left -= each * used
            by_gap.setdefault(g - each * n, []).append([lengths + (n,) * each, used])
            if times > used:
                by_gap.setdefault(g, []).append([lengths, times - used])
    patterns += [(tuple(p), t) for group in by_gap.values() for p, t in group]
    return patterns


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows length, first rank, copies in a sequence, first sequence, first offset; sorted by length and rank."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset, i = 0, 0
        while i < len(lengths):
            n = lengths[i]
            k = 1
            while i + k < len(lengths) and lengths[i + k] == n:
                k += 1
            rows.append((n, ranks.get(n, 0), k, sequence, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += k * n
            i += k
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence_id and offset. ``found`` is read more than once, so it should be a written table."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = slots(plan(histogram, capacity))
    buckets = F.lit([max(1, int(histogram.get(n, 0) ** 0.5)) for n in range(capacity + 1)])
    x = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(buckets, F.col("length").cast("int") + 1)))
    sizes = x.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    x = x.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "bucket"])
    x = x.withColumn("rank", F.col("rank") + F.col("base")).drop("bucket", "base")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        # ranks and lengths in one number, so that one search finds the row
        shift = np.int64(1) << np.int64(44)
        row = np.searchsorted(places[:, 0] * shift + places[:, 1], length * shift + rank, side="right") - 1
        _, first, copies, sequence, offset = places[row].T if len(row) else np.zeros((5, 0), dtype=np.int64)
        k = rank - first
        put = {"sequence_id": sequence + k // np.maximum(copies, 1), "offset": offset + k % np.maximum(copies, 1) * length}
        names = [c for c in batch.schema.names if c != "rank"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(v, pa.int64()) for v in put.values())], [*names, *put])

    order = [*found.columns]
    kinds = dict(found.dtypes)
    x = x.select(*order, "rank")
    return arrow_map(x, one, ", ".join(f"`{c}` {kinds[c]}" for c in order) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokens: bool = False) -> DataFrame:
    return pack(materialize(pieces(docs, tokens=tokens), "pieces"))


def op4(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
