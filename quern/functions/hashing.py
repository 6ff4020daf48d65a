"""Identities: content hashes, chunk and artifact ids, node ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def chunk_hash(path: Column, start: Column, end: Column, content: Column) -> Column:
    """First 16 hex digits of sha256 over path:start:end:content."""
    return F.substring(F.sha2(F.concat_ws(":", path, start.cast("string"), end.cast("string"), content), 256), 1, 16)


def chunk_id(path: Column, ordinal: Column) -> Column:
    return F.concat(path, F.lit("_"), ordinal.cast("string"))


def canonical(*parts: Column) -> Column:
    """sha256 over the parts, each after its length as four big-endian bytes."""
    data = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 8, "0")), F.encode(p, "UTF-8")) for p in parts]
    return F.sha2(F.concat(*data), 256)


def artifact_id(repository: Column, path: Column, source_hash: Column, fingerprint: Column) -> Column:
    return canonical(repository, path, source_hash, fingerprint)


def blob_oid(content: Column) -> Column:
    """Git's name of a blob."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def node_id(kind: str, *parts: Column) -> Column:
    """sym:path:receiver.name, file:path, area:a, cat:a/b, subcat:a/b/c, chunk:id."""
    if kind == "sym":
        path, receiver, name = parts
        return F.concat(F.lit("sym:"), path, F.lit(":"), F.when(receiver == "", name).otherwise(F.concat(receiver, F.lit("."), name)))
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("/", *parts))


def sanitize_utf8(s: Column) -> Column:
    return F.make_valid_utf8(s)
