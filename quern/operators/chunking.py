"""Splitting of file contents into overlapping chunks of UTF-8 bytes."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import Chunking

BYTES_PER_TOKEN = 4
#: What counts as blank besides ASCII white space.
_BLANK = " \t\n\v\f\r\x85\xa0                　"


def _aligned(data: bytes, at: int) -> int:
    """The first position from ``at`` that begins a character, or the end."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def spans(data: bytes, config: Chunking = Chunking()) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk: windows cut after their last line break, each beginning within the one before.

    At the end of the data the overlap is a chunk of its own.
    """
    size, overlap = (x * BYTES_PER_TOKEN for x in config.resolved())
    start = 0
    while start < len(data):
        stop = _aligned(data, min(start + size, len(data)))
        if stop < len(data):
            line = data.rfind(b"\n", start, stop)
            if line > start:
                stop = line + 1
        blank = not data[start:stop].decode("utf-8", "replace").strip(_BLANK)
        if not blank:
            yield start, stop
        back = stop - overlap
        start = stop if blank or back <= start else _aligned(data, back)


def chunk(path: str, text: str, config: Chunking = Chunking(), first_line: int = 1, prefix: str = "") -> list[dict]:
    """Chunks with ordinal, 1-based lines, short and content hash; ``prefix`` goes before content, not into hashes."""
    data = text.encode("utf-8", "surrogatepass")
    breaks = [i for i, b in enumerate(data) if b == 10]
    out = []
    for a, b in spans(data, config):
        part = data[a:b]
        out.append(
            {
                "ordinal": len(out),
                "start_line": first_line + bisect.bisect_left(breaks, a),
                "end_line": first_line + bisect.bisect_left(breaks, b - 1),
                "content": prefix + part.decode("utf-8", "replace"),
                "hash": hashlib.sha256(f"{path}:{a}:{b}:".encode() + part).hexdigest()[:16],
                "content_hash": hashlib.sha256(part).hexdigest(),
            }
        )
    return out


def rechunk(path: str, parent: int, text: str, first_line: int, config: Chunking = Chunking()) -> list[dict]:
    """A chunk that is too long, in halves: half the size (64 at least) and half the overlap, lines as in the file."""
    size, overlap = config.resolved()
    return [c | {"id": f"{path}_{parent}_{c['ordinal']}"} for c in chunk(path, text, Chunking(max(64, size // 2), overlap // 2), first_line)]


SCHEMA = "path string, id string, ordinal int, start_line int, end_line int, content string, hash string, content_hash string"


def chunk_files(files: DataFrame, config: Chunking = Chunking(), with_context: bool = False) -> DataFrame:
    """Files (path, content) to chunks; with context, each begins with a line that names its file."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [
                    {"path": p, "id": f"{p}_{c['ordinal']}"} | c
                    for p, t in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True)
                    for c in chunk(p or "", t or "", config, prefix=f"File: {p}\n\n" if with_context else "")
                ]
                names = ["path", "id", "ordinal", "start_line", "end_line", "content", "hash", "content_hash"]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(each, SCHEMA)


def batches(chunks: DataFrame, group: str, max_inputs: int = 2000, max_tokens: int = 280_000) -> DataFrame:
    """Greedy batches of a group's chunks in order (file_index, chunk_index): batch number beside each chunk.

    A batch is closed at ``max_inputs`` inputs, or when the next chunk would exceed ``max_tokens``. Groups keep requests
    within one file set and are what runs in parallel.
    """
    limit = max_inputs if 0 < max_inputs <= 2000 else 2000

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, count, used = None, 0, 0, 0
        for part in it:
            out = []
            for g, t in zip(part.column(group).to_pylist(), part.column("tokens").to_pylist(), strict=True):
                if own is None or g != own[0]:
                    own, number, count, used = (g,), 0, 0, 0
                if count >= limit or count and used + t > max_tokens:
                    number, count, used = number + 1, 0, 0
                count, used = count + 1, used + t
                out.append(number)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], [*part.schema.names, "batch"])

    x = chunks.select(group, "file_index", "chunk_index", F.col("tokens").cast("long").alias("tokens"))
    kinds = dict(x.dtypes)
    x = x.repartition(group).sortWithinPartitions(group, "file_index", "chunk_index")  # read as a stream, so a group need not fit in memory
    return x.mapInArrow(pack, ", ".join(f"`{c}` {kinds[c]}" for c in x.columns) + ", batch long")


def scatter(vectors: DataFrame, file: str = "file_index") -> DataFrame:
    """Vectors (file, chunk_index, vector) that came back from batches as one list a file, in the order of its chunks."""
    pairs = F.array_sort(F.collect_list(F.struct("chunk_index", "vector")))
    return vectors.groupBy(file).agg(F.transform(pairs, lambda p: p["vector"]).alias("vectors"))
