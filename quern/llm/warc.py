"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of page_id and digest; the borders are quantiles of bytes over a sample by hash, so
the same table gives the same shards whatever the cluster, and ids that lie far apart, repeat or are null don't crowd
one shard. A shard is sorted by page_id and written as gzip members, one for each record; a file is closed when its compressed size reaches ``ROLL``. Every file
is written under a temporary name and renamed when complete, so a task that runs twice replaces a file by the same
bytes; the list of files is written last, by Spark's own committer, and readers follow that list alone. Dates and
record ids are functions of the row, headers and digests are made anew.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the largest page_id is the response and the
others are revisits of it. Payloads cross the network once: the decisions travel as rows of their own and meet the
pages in the sort.

Edge cases: null html is an empty payload; a null url becomes an empty target; a null page_id is always a response and
sorts first; any long is a page_id; rows that repeat a page_id and payload get the same decision; an empty table gives an empty list of files
and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import SAMPLE, borders, materialize, part_of, shared_dir, table

LEAST, ROLL, SHARD_BYTES, MAX_SHARDS = 1000, 32 << 20, 8 << 20, SAMPLE // 8
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1a4b6e-51c8-5b0f-9d0c-2a4f6f0e7a11")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _b32(hexed: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()


def _unb32(value: str) -> str:
    return base64.b32decode(value.partition(":")[2]).hex()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """An uncompressed response or revisit record."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: {_b32(digest)}",
        f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\nsoftware: quern\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time stamp."""
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archive:
    """One file: temporary until closed."""

    def __init__(self, folder: str, shard: int, number: int) -> None:
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.name, self.shard, self.number = f"{shard:08d}-{number:05d}.warc.gz", shard, number
        self.path, self.temporary = f"{root}/{self.name}", f"{root}/_temporary/{self.name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.out, self.size, self.records, self.sha1 = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha1()
        self.write(warcinfo(self.name))
        self.records = 0

    def write(self, data: bytes) -> None:
        z = member(data)
        self.out.write(z)
        self.sha1.update(z)
        self.size += len(z)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.shard, self.number, self.name, self.records, self.size, self.sha1.hexdigest()


MANIFEST = "shard long, number int, name string, records long, bytes long, sha1 string"


def write(pages: DataFrame, folder: str, roll: int = ROLL, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the archives; returns their list, as committed."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    wide = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    narrow = wide.select("page_id", "digest", F.octet_length("html").cast("long").alias("size"))
    key = F.coalesce("page_id", F.lit(-(2**63)))
    weights = narrow.select(key.alias("key"), "digest", (F.col("size") + 600).alias("weight"))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    shards = max(1, min(MAX_SHARDS, -(-total // shard_bytes)))  # larger ones beyond; files are rolled within a shard
    found = borders(weights, "weight", shards)
    shard = part_of([key, F.col("digest")], found).cast("long")

    first = narrow.where(F.col("size") >= LEAST).groupBy("digest").agg(F.max("page_id").alias("ref"), F.count("*").alias("n")).where("n > 1").select("digest", "ref")
    revisits = narrow.where(F.col("size") >= LEAST).join(first, "digest").where("page_id < ref").select("page_id", "digest", "ref").distinct()
    rows = wide.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("ref"))
    rows = rows.unionByName(revisits.withColumn("kind", F.lit(0)), allowMissingColumns=True).withColumn("shard", shard)
    rows = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def save(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        archive, decided = None, (None, None, None)
        for batch in it:
            for page_id, digest, kind, url, html_, ref, shard_ in zip(*(batch.column(c).to_pylist() for c in ("page_id", "digest", "kind", "url", "html", "ref", "shard")), strict=True):
                if kind == 0:
                    decided = page_id, digest, ref
                    continue
                if archive is None or archive.shard != shard_ or archive.size >= roll:
                    number = 0 if archive is None or archive.shard != shard_ else archive.number + 1
                    if archive is not None:
                        done.append(archive.close())
                    archive = _Archive(folder, shard_, number)
                to = decided[2] if decided[:2] == (page_id, digest) else None
                archive.write(record(page_id, url, html_.encode("utf-8", "surrogatepass"), digest, to))
        if archive is not None:
            done.append(archive.close())
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*done, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["shard", "number", "name", "records", "bytes", "sha1"])

    rows.select("page_id", "digest", "kind", "url", "html", "ref", "shard").mapInArrow(save, MANIFEST).write.json(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifest")


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as f:
        rest = b""
        while True:
            rest = rest or f.read(1 << 20)
            if not rest:
                return
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                parts.append(z.decompress(rest))
                rest = z.unused_data
                if not z.eof:
                    rest = f.read(1 << 20)
                    if not rest:
                        raise ValueError(f"{path}: cut off")
            data = b"".join(parts)
            top, _, block = data.partition(b"\r\n\r\n")
            head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in top.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            yield head, block[: int(head["Content-Length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record in the list of files."""
    files = spark.read.schema(MANIFEST).json(f"{folder}/_manifest")

    def load(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for name in batch.column("name").to_pylist():
                out: list[list] = [[], [], [], [], []]
                for head, block in records(f"{folder}/{name}"):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    digest, size = _unb32(head["WARC-Payload-Digest"]), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"{name}: record {head['WARC-Record-ID']} doesn't match its digest")
                    page, to = head["X-Page-Id"], head.get("X-Refers-To-Page-Id")
                    for c, v in zip(out, (int(page) if page else None, size, digest, head["WARC-Type"], int(to) if to else None), strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    dealt = files.select("name").repartition(max(1, files.count()))
    return dealt.mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return materialize(read(spark, folder), "warc-read")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p),
     g AS (SELECT payload_digest, max(page_id) AS last_id FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, q.payload_digest, CASE WHEN page_id < last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last_id THEN last_id END AS refers_to
FROM q LEFT JOIN g ON q.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
