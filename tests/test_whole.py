"""Chunking and index maintenance of whole texts against brute-force versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.config import Chunking
from quern.operators import chunking, embed, index

from .conftest import SMALL


def brute_chunks(text, size, overlap):
    """Byte windows that end after their last line break, if it isn't their first byte, and step back by the overlap."""
    data, at, out = text.encode(), 0, []
    starts = {0, len(data), *(i for i, b in enumerate(data) if b < 0x80 or b >= 0xC0)}
    up = lambda i: next(j for j in range(i, len(data) + 1) if j in starts)
    while at < len(data):
        end = up(min(at + size, len(data)))
        if end < len(data):
            breaks = [i for i in range(at + 1, end) if data[i] == 10]
            end = breaks[-1] + 1 if breaks else end
        part = data[at:end]
        if part.decode().strip():
            out.append(part.decode())
            at = end if end - overlap <= at else up(end - overlap)
        else:
            at = end
    return out


@pytest.fixture(scope="module")
def files(spark):
    """Path and whole text of the smallest table's documents, a text in all scripts, and a file that ends like another."""
    rows = [(f"d{r.doc_id}", r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("text IS NOT NULL").collect()]
    return [*rows, ("scripts", "größe 価格 🙂 é\n" * 300), ("copy", rows[3][1])]


@pytest.mark.parametrize("config", [Chunking(), Chunking(30, 5)])
def test_chunks_of_whole_texts(spark, files, config):
    got = {}
    for r in chunking.chunk_files(spark.createDataFrame(files, "path string, content string"), config).collect():
        got.setdefault(r.path, {})[r.ordinal] = r.content
    want = {p: c for p, t in files if (c := brute_chunks(t, config.size * 4, config.overlap * 4))}
    assert {p: [c[i] for i in range(len(c))] for p, c in got.items()} == want
    assert sum(len(c) > 2 for c in want.values()) > 10


def test_update_of_whole_texts(spark, files):
    """Files of several chunks are kept, changed at an end, cut, added and removed; contents with a vector keep it."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    old = dict(files[::2])
    now = {p: t + " and more" if k % 9 == 0 else t[: len(t) // 2] if k % 9 == 1 else t for k, (p, t) in enumerate(files) if k % 10 != 8}
    cut = lambda t: brute_chunks(t, 120, 20)
    schema = "id string, path string, start_line int, end_line int, content string, vector array<float>, hash string, content_hash string"
    chunks = [(f"{p}_{i}", p, 1, 1, c, [9.0, 9.0], "", sha(c)) for p, t in old.items() for i, c in enumerate(cut(t))]
    documents = [(p, sha(t), 1, [f"{p}_{i}" for i in range(len(cut(t)))]) for p, t in old.items()]
    scanned = [(p, sha(t), 2, t) for p, t in now.items()]
    r = index.update(
        spark.createDataFrame(scanned, "path string, hash string, mtime long, content string"),
        spark.createDataFrame(documents, "path string, hash string, mtime long, chunk_ids array<string>"),
        spark.createDataFrame(chunks, schema),
        embed.fake_embedder(2),
        2,
        Chunking(30, 5),
    )
    known = {c for t in old.values() for c in cut(t)}
    want = {(f"{p}_{i}", c, c in known) for p, t in now.items() for i, c in enumerate(cut(t))}
    got = [tuple(x) for x in r.chunks.select("id", "content", F.col("vector")[0] == 9.0).collect()]
    assert len(got) == len(want) and set(got) == want
    same = lambda p: old.get(p) == now[p] and cut(now[p])
    docs = {x.path: (x.hash, x.mtime, sorted(x.chunk_ids)) for x in r.documents.collect()}
    assert docs == {p: (sha(t), 1 if same(p) else 2, sorted(f"{p}_{i}" for i in range(len(cut(t))))) for p, t in now.items()}
    # several chunks of one file that are new, that are reused from it, and that are reused from another file
    assert any(sum(c in known for c in cut(now[p])) > 1 and old[p] != now[p] for p in old.keys() & now.keys()) and any(p not in old and sum(c in known for c in cut(t)) > 1 for p, t in now.items())
