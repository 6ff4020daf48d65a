"""Substring dedup by matching statistics from compressed FM-indexes, one for each shard.

A window is ``WINDOW`` consecutive words of one document. Words covered by a window that also starts in a document with a
smaller doc_id go. Shards are made by content, so what is equal meets without comparing all documents: of the runs of
``GRAM`` words in a window the one with the smallest hash is its anchor, equal windows have equal anchors, and neighbouring
windows with one anchor are a segment. Anchors of a single document are left out. Equal segments are one class, which keeps
its smallest and largest doc_id, and classes go to shards by the hash of their anchor. An anchor with more than
``SHARD_WORDS`` words in its classes (the surroundings of a passage that very many documents hold) would crowd a shard;
its segments are cut into single windows, whose anchors are hashes of all their words.

A shard builds an FM-index of its classes: suffixes ordered by their first 64 words, the transformed text as a wavelet tree
of packed bits with counted blocks. Classes are then streamed through it from their last word to the first, all in step:
each word extends the interval of suffixes that start with the match; where the interval becomes empty, or the match has
``WINDOW`` words, it goes to the enclosing interval of a shorter match. Where a match reaches the threshold, its interval
says in which smallest document the window starts. A document's windows with a smaller one than its own are reported.

Only hashes and places of segments are shuffled for all documents; words of a class are read from its first document alone.
Joins on anchors and classes go through ``split_join``, so a passage that a third of all documents hold is spread.

Edge cases: a null text has no words; fewer than ``WINDOW`` words are no window; texts of any length are taken whole, in
segments of at most ``RUN`` windows; a document's repeats of itself stay, and so do those in rows with the same doc_id; a
null doc_id counts as larger than all others; rows that repeat doc_id and text get the same result; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, WordHash, arrow_map, documents, mix64, split_join, texts

WINDOW, GRAM, RUN = 50, 16, 256
#: Words of a shard's index.
SHARD_WORDS = 200_000
LAST = 2**63 - 1

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 2**64)


class _Powers:
    """Powers of an odd number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.known = np.uint64(base), np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.known):
            steps = np.full(max(n, 2 * len(self.known)), self.base, dtype=np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps)
        return self.known[:n]


_UP, _DOWN = _Powers(_MULTIPLIER), _Powers(_INVERSE)


def runs_of(h: np.ndarray) -> np.ndarray:
    """Sums from which ``run_key`` takes the hash of any run of words."""
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * _UP(len(h)))])


def run_key(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix64((sums[stop] - sums[start]) * _DOWN(len(sums))[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def segments(h: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor, content hash, first window and number of windows of each segment of a text's word hashes."""
    windows = len(h) - WINDOW + 1
    if windows < 1:
        return (np.zeros(0, dtype=np.uint64),) * 2 + (np.zeros(0, dtype=np.int64),) * 2
    sums = runs_of(h)
    at = np.arange(len(h) - gram + 1)
    anchor = _least(run_key(sums, at, at + gram), WINDOW - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(first, windows))
    if n.max() > RUN:  # a text that repeats itself
        pieces = -(-n // RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, left = np.repeat(first, pieces) + nth * RUN, np.repeat(n, pieces) - nth * RUN
        n = np.minimum(left, RUN)
    return anchor[first], run_key(sums, first, first + n + WINDOW - 1), first, n


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class FMIndex:
    """Texts of words (arrays of numbers from 1), each with a number (its document), for matches of up to ``most`` words."""

    def __init__(self, parts: list[np.ndarray], docs: np.ndarray, most: int = WINDOW) -> None:
        self.most = most
        size = np.array([len(p) for p in parts], dtype=np.int64)
        text = np.zeros(int(size.sum()) + len(parts), dtype=np.int64)  # 0 ends each text
        for p, end in zip(parts, np.cumsum(size + 1), strict=True):
            text[end - 1 - len(p) : end - 1] = p
        self.n = n = len(text)
        self.symbols = int(text.max(initial=0)) + 1
        order, ranks = self._suffixes(text)
        self.lcp = self._common(order, ranks)
        bwt = text[order - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.symbols))])
        self._wavelet(bwt)
        owner = np.repeat(docs, size + 1)[order]
        # by their first ``most`` words, suffixes are in groups; so they are by one word less, to which a full match goes back
        self.low = self._grouped(most, np.minimum, owner)
        first = np.arange(n)
        self.less = self._grouped(most - 1, np.minimum, first), self._grouped(most - 1, np.maximum, first) + 1
        self._table: list[np.ndarray] | None = None

    def _suffixes(self, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The order of the suffixes by their first words, at least ``most``, and their ranks by the first 1, 2, 4, ... words."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        ranks, h = [rank], 1
        while True:
            after = np.concatenate([rank[h:] + 1, np.zeros(min(h, len(rank)), dtype=np.int64)])
            key = rank * (len(text) + 2) + after
            order = np.argsort(key)
            key = key[order]
            new = np.empty(len(key), dtype=np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
            rank, h = new, 2 * h
            if h >= self.most + 1:
                return order, ranks
            ranks.append(rank)

    def _common(self, order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Words that each suffix shares with the one before it, 0 at both ends, at most 2 * len - 1."""
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(order) + 1, dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = (a < self.n) & (b < self.n)
            same = np.zeros(len(a), dtype=bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            step = same.astype(np.int64) << k
            a, b, out[1:-1] = a + step, b + step, out[1:-1] + step
        return np.minimum(out, 255).astype(np.uint8)

    def _grouped(self, words: int, of: np.ufunc, values: np.ndarray) -> np.ndarray:
        """For each suffix, ``of`` over the values of those with the same first words."""
        border = np.concatenate([[0], np.flatnonzero(self.lcp[1:-1] < words) + 1]) if self.n else np.zeros(0, dtype=np.int64)
        return np.repeat(of.reduceat(values, border), np.diff(np.append(border, self.n))) if self.n else values

    def _wavelet(self, symbols: np.ndarray) -> None:
        """A level of bits for each bit of a symbol, the highest first; a level is ordered by the bits above."""
        self.levels = max(1, int(self.symbols - 1).bit_length())
        blocks = self.n // 64 + 1
        self.bits, self.counts = np.zeros((self.levels, blocks), dtype=np.uint64), np.zeros((self.levels, blocks), dtype=np.int64)
        self.zeros = np.zeros(self.levels, dtype=np.int64)
        for k in range(self.levels):
            bit = (symbols >> (self.levels - 1 - k)) & 1
            packed = np.zeros(blocks * 8, dtype=np.uint8)
            some = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(some)] = some
            self.bits[k] = packed.view(np.uint64)
            ones = np.bitwise_count(self.bits[k]).astype(np.int64)
            self.counts[k] = np.cumsum(ones) - ones
            self.zeros[k] = self.n - int(bit.sum())
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.base = np.zeros(self.symbols, dtype=np.int64)
        every = np.arange(self.symbols)
        self.base = self.rank(every, np.zeros(self.symbols, dtype=np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands before place i of the transformed text."""
        p = i
        for k in range(self.levels):
            block = p >> 6
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & ((np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            p = np.where((symbol >> (self.levels - 1 - k)) & 1 == 1, self.zeros[k] + ones, p - ones)
        return p - self.base[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with one more word in front."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.concatenate([self.start[symbol]] * 2)
        return both[: len(symbol)], both[len(symbol) :]

    def enclosing(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger intervals of a shorter match, and its length; all of the text has length 0."""
        if self._table is None:
            self._table = [self.lcp]
            while (1 << len(self._table)) <= self.n:
                t, half = self._table[-1], 1 << (len(self._table) - 1)
                self._table.append(np.minimum(t[:-half], t[half:]))
        length = np.maximum(self.lcp[low], self.lcp[high]).astype(np.int64)
        low, high = low.copy(), high.copy()
        for k in range(len(self._table) - 1, -1, -1):  # all of lcp[low - 2**k + 1 .. low] at least length: go on
            t, step = self._table[k], 1 << k
            go = (low >= step) & (t[np.maximum(low - step + 1, 0)] >= length)
            low = np.where(go, low - step, low)
            go = (high + step <= self.n) & (t[np.minimum(high, len(t) - 1)] >= length)
            high = np.where(go, high + step, high)
        return np.where(length > 0, low, 0), np.where(length > 0, high, self.n), length

    def statistics(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each step from the last words to the first: the texts (their numbers), the place, and the length and the interval's first suffix of the longest match there.

        Words that the index lacks are 0. Lengths are at most ``most``.
        """
        size = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        end = np.cumsum(size)
        flat = np.concatenate(texts) if texts else np.zeros(0, dtype=np.int64)
        active = int((size > 0).sum())
        low, high = np.zeros(active, dtype=np.int64), np.full(active, self.n, dtype=np.int64)
        length = np.zeros(active, dtype=np.int64)
        for step in range(int(size.max(initial=0))):
            active = int(np.searchsorted(-size[order], -step, side="left"))
            who = order[:active]
            low, high, length = low[:active], high[:active], length[:active]
            symbol = flat[end[who] - 1 - step]
            symbol = np.where(symbol < self.symbols, symbol, 0)
            full = length == self.most
            low, high = np.where(full, self.less[0][np.minimum(low, self.n - 1)], low), np.where(full, self.less[1][np.minimum(low, self.n - 1)], high)
            length = np.where(full, self.most - 1, length)
            a, b = self.extend(symbol, low, high)
            absent = symbol == 0
            left = np.flatnonzero((a >= b) | absent)
            length = length + 1
            while len(left):
                unknown = absent[left] | ((length[left] == 1) & (a[left] >= b[left]))  # no match of a single word
                done = left[unknown]
                a[done], b[done], length[done] = 0, self.n, 0
                left = left[~unknown]
                low[left], high[left], shorter = self.enclosing(low[left], high[left])
                a[left], b[left] = self.extend(symbol[left], low[left], high[left])
                length[left] = shorter + 1
                left = left[a[left] >= b[left]]
            low, high = a, b
            yield who, size[who] - 1 - step, length, low

    def first_documents(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of ``most`` words of each text the smallest number of an indexed text that has it, LAST if none."""
        out = [np.full(max(0, len(t) - self.most + 1), LAST, dtype=np.int64) for t in texts]
        begin = np.cumsum([0, *map(len, out)])
        every = np.full(begin[-1], LAST, dtype=np.int64)
        for who, place, length, low in self.statistics(texts):
            found = length == self.most
            every[begin[who[found]] + place[found]] = self.low[low[found]]
        return [every[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


SEGMENT = "doc long, copy long, anchor long, content long, at int, n int"


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("copy"), "text")


def cut(docs: DataFrame) -> DataFrame:
    """The segments of each text."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, found = WordHash(), []
        for t in texts(batch, "text"):
            found.append(segments(hashes.all(_words(t))))
        n = [len(f[0]) for f in found]
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4)]
        row = pa.array(np.repeat(np.arange(len(n)), n))
        return pa.RecordBatch.from_arrays([batch.column("doc").take(row), batch.column("copy").take(row), *(pa.array(c.astype(np.uint64).view(np.int64)) for c in columns[:2]), *(pa.array(c.astype(np.int32)) for c in columns[2:])], ["doc", "copy", "anchor", "content", "at", "n"])

    return arrow_map(_identified(docs), one, SEGMENT)


def _classes(held: DataFrame) -> DataFrame:
    """anchor, content, first (the smallest document and the place there), last (the largest document), rows."""
    return held.groupBy("anchor", "content").agg(F.min(F.struct("doc", "copy", "at", "n")).alias("first"), F.max("last").alias("last"), F.count("*").alias("rows"))


def _read(docs: DataFrame, classes: DataFrame, windows: bool) -> DataFrame:
    """anchor, content, doc, last and words of each class, from its first document; or its windows (with their place), each its own anchor."""
    wanted = classes.groupBy(F.col("first.doc").alias("doc"), F.col("first.copy").alias("copy")).agg(F.collect_list(F.struct("anchor", "content", "last", F.col("first.at").alias("at"), F.col("first.n").alias("n"))).alias("asked"))
    rows = _identified(docs).join(wanted, ["doc", "copy"])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        hashes = WordHash()
        for doc, text, asked in zip(batch.column("doc").to_pylist(), texts(batch, "text"), batch.column("asked").to_pylist(), strict=True):
            w = _words(text)
            sums = runs_of(hashes.all(w)) if windows else None
            for a in asked:
                parts = [(i, i + WINDOW) for i in range(a["at"], a["at"] + a["n"])] if windows else [(a["at"], a["at"] + a["n"] + WINDOW - 1)]
                keys = run_key(sums, *np.array(parts).T).view(np.int64).tolist() if windows else [None]
                for (i, j), key in zip(parts, keys, strict=True):
                    for c, v in zip(out, (a["anchor"], a["content"], key, i - a["at"], doc, a["last"], b" ".join(w[i:j])), strict=True):
                        c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["anchor", "content", "key", "place", "doc", "last", "words"])

    return arrow_map(rows.select("doc", "text", "asked"), one, "anchor long, content long, key long, place int, doc long, last long, words binary")


FOUND = "anchor long, content long, runs array<struct<at:int,n:int,low:long>>"


def search(units: DataFrame, shards: int) -> DataFrame:
    """anchor, content, runs: of each class (anchor, content, doc, last, words) the windows that start in a smaller document than ``last``."""

    def one(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        known: dict[bytes, int] = {}
        parts = [np.array([known.setdefault(w, len(known) + 1) for w in t.split()], dtype=np.int64) for t in table.column("words").to_pylist()]
        last = table.column("last").to_numpy()
        index = FMIndex(parts, table.column("doc").to_numpy())
        keep, runs = [], []
        for i, low in enumerate(index.first_documents(parts)):
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            n = np.diff(np.append(first, len(low)))
            some = [{"at": a, "n": k, "low": v} for a, k, v in zip(first.tolist(), n.tolist(), low[first].tolist(), strict=True) if v < last[i]]
            if some:
                keep.append(i)
                runs.append(some)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("low", pa.int64())]))
        at = pa.array(keep, pa.int64())
        return pa.table({"anchor": table.column("anchor").take(at), "content": table.column("content").take(at), "runs": pa.array(runs, kind)})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return units.select("anchor", "content", "doc", "last", "words", shard.alias("shard")).groupBy("shard").applyInArrow(one, FOUND)


def repeats(docs: DataFrame) -> DataFrame:
    """doc, copy, flagged: the windows (runs of first and number) of each text that start in a document with a smaller doc_id."""
    scratch = Scratch()
    every = scratch(cut(docs), "segments")
    anchors = every.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("last"), F.count("*").alias("n")).where("low != last").select("anchor", "n")
    held = scratch(_held(every, anchors), "held")
    classes = scratch(_classes(held.withColumn("last", F.col("doc"))), "classes")
    crowd = classes.groupBy("anchor").agg(F.sum(F.col("first.n") + WINDOW).alias("words"), F.count("*").alias("n"))
    crowd = scratch(crowd, "crowd")
    hot = crowd.where(F.col("words") > SHARD_WORDS).select("anchor", "n")
    total = crowd.where(F.col("words") <= SHARD_WORDS).agg(F.sum("words")).first()[0] or 0
    if hot.isEmpty():
        found = search(_read(docs, classes, False), max(1, -(-total // SHARD_WORDS)))
    else:
        crowded = split_join(classes, hot, "anchor").drop("n")
        units = _read(docs, classes.join(crowd.where(F.col("words") <= SHARD_WORDS).select("anchor"), "anchor", "left_semi"), False)
        found = search(units, max(1, -(-total // SHARD_WORDS))).unionByName(_by_window(docs, crowded, scratch))
    found = scratch(found, "found")
    members = classes.select("anchor", "content", F.col("rows").alias("n")).join(found, ["anchor", "content"])
    x = split_join(held.select("doc", "copy", "anchor", "content", "at"), members, "anchor", "content")
    mine = F.transform(F.filter("runs", lambda r: r["low"] < F.col("doc")), lambda r: F.struct((r["at"] + F.col("at")).alias("at"), r["n"].alias("n")))
    x = x.select("doc", "copy", mine.alias("own")).where(F.size("own") > 0)
    out = scratch(x.groupBy("doc", "copy").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("flagged")), "flagged")
    scratch.drop_all_but(out)
    return out


def _held(every: DataFrame, anchors: DataFrame) -> DataFrame:
    rows = every.withColumnRenamed("n", "windows")
    return split_join(rows, anchors, "anchor").select("doc", "copy", "anchor", "content", "at", F.col("windows").alias("n"))


def _by_window(docs: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``search`` for classes whose anchors have too many words for a shard, window by window."""
    windows = scratch(_read(docs, classes, True), "windows")
    keys = windows.groupBy("key").agg(F.min("doc").alias("doc"), F.max("last").alias("last"), F.count("*").alias("n"), F.min_by("words", "doc").alias("words")).where("doc != last")
    keys = scratch(keys.select(F.col("key").alias("anchor"), F.lit(0).cast("long").alias("content"), "doc", "last", "n", "words"), "window-classes")
    shards = max(1, -(-keys.count() * WINDOW // SHARD_WORDS))
    runs = search(keys, shards).select(F.col("anchor").alias("key"), F.col("runs")[0]["low"].alias("low"))
    runs = runs.join(keys.select(F.col("anchor").alias("key"), "n"), "key")
    x = split_join(windows.select("anchor", "content", "key", "place"), runs, "key")
    return x.groupBy("anchor", "content").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("at"), F.lit(1).alias("n"), "low"))).alias("runs"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces) and kept_sha256 of each document."""
    marks = repeats(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("copy"), "text").join(marks, ["doc", "copy"], "left")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept, digest = [], [], [], []
        for text, flagged in zip(texts(batch, "text"), batch.column("flagged").to_pylist(), strict=True):
            words = _words(text)
            n_words.append(len(words))
            if flagged:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for f in flagged:
                    edge[f["at"]] += 1
                    edge[f["at"] + f["n"] + WINDOW - 1] -= 1
                words = [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    out = arrow_map(rows.select("doc_id", "text", "flagged"), one, "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
    return out.withColumn("kept", F.col("kept").cast("string"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP12_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i, len(ws) AS n FROM w WHERE len(ws) > 0),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ')) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW})),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g),
m AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE low < doc_id),
c AS (SELECT p.doc_id, p.i, word, max(m.i IS NOT NULL) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.i = p.i),
k AS (SELECT doc_id, count(*) AS n, coalesce(string_agg(word, ' ' ORDER BY i), '') AS kept FROM c WHERE NOT gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
