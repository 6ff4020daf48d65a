"""Point reads of a catalog: each table is written by its key, whole, and one key is read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.plans.base import DOC_PATH, VEC_PATH, Registry, chunks, doc_path
from quern.session import shared_dir, table
from quern.sources.keyed import Keyed, write_keyed

R = Registry()


def keyed(df, *keys: str, rows: int = 2000) -> Keyed:
    path = f"{shared_dir(df.sparkSession)}/keyed-{uuid.uuid4().hex}"
    write_keyed(df, path, list(keys), rows)
    return Keyed(df.sparkSession, path)


@R.add("read_document", f"SELECT {DOC_PATH} AS path, sha256(text) AS hash, n_chars FROM documents WHERE doc_id = 17")
def read_document(spark, d):
    docs = table(spark, d, "documents")
    path = docs.where("doc_id = 17").select(doc_path().alias("path")).first()["path"]
    return keyed(docs.select(doc_path().alias("path"), F.sha2("text", 256).alias("hash"), "n_chars"), "path").get(path=path)


@R.add("file_chunks", f"WITH c AS (SELECT vec_id AS id, {VEC_PATH} AS path FROM embeddings) SELECT * FROM c WHERE path = (SELECT path FROM c WHERE id = 40)")
def file_chunks(spark, d):
    x = chunks(spark, d).select("id", "path")
    return keyed(x, "path").get(path=x.where("id = 40").first()["path"]).select("id", "path")


#: View rows (worktree, path, artifact) of all orders, artifacts of all parts, chunks of artifacts of all line items.
VIEW = "v AS (SELECT 'w' || o_orderkey % 7 AS worktree_id, 'f' || o_orderkey AS path, o_custkey AS artifact_id FROM orders)"


def _view(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("w"), (F.col("o_orderkey") % 7).cast("string")).alias("worktree_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("artifact_id"))


@R.add("resolve_view", f"WITH {VIEW} SELECT * FROM v WHERE worktree_id = 'w3' AND path = 'f3'")
def resolve_view(spark, d):
    return keyed(_view(spark, d), "worktree_id", "path").get(worktree_id="w3", path="f3")


@R.add("view_paths", f"WITH {VIEW} SELECT path FROM v WHERE worktree_id = 'w3'")
def view_paths(spark, d):
    return keyed(_view(spark, d), "worktree_id").get(worktree_id="w3").select("path")


ARTIFACT = "a AS (SELECT p_partkey AS artifact_id, p_partkey % 3 AS repository_id, p_name AS path, p_brand AS source_hash, p_type AS fingerprint, p_size AS symbols_version FROM part)"


def _artifacts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("artifact_id"), (F.col("p_partkey") % 3).alias("repository_id"), F.col("p_name").alias("path"), F.col("p_brand").alias("source_hash"), F.col("p_type").alias("fingerprint"), F.col("p_size").alias("symbols_version"))
    row = p.where("artifact_id = 11").first()
    return p, {k: row[k] for k in ("repository_id", "path", "source_hash", "fingerprint")}


_SAME = "JOIN (SELECT repository_id, path, source_hash, fingerprint FROM a WHERE artifact_id = 11) k USING (repository_id, path, source_hash, fingerprint)"


@R.add("artifact_by_key", f"WITH {ARTIFACT} SELECT artifact_id, path, symbols_version FROM a {_SAME}")
def artifact_by_key(spark, d):
    p, key = _artifacts(spark, d)
    return keyed(p, *key).get(**key).select("artifact_id", "path", "symbols_version")


@R.add("symbols_current", f"WITH {ARTIFACT} SELECT artifact_id, symbols_version >= 20 AS current FROM a {_SAME}")
def symbols_current(spark, d):
    p, key = _artifacts(spark, d)
    return keyed(p, *key).get(**key).select("artifact_id", (F.col("symbols_version") >= 20).alias("current"))


@R.add("chunk_vector", "SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id = 23")
def chunk_vector(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return keyed(e, "chunk_id").get(chunk_id=23)


@R.add("worktree_info", "SELECT s_suppkey AS worktree_id, s_name AS root, s_nationkey AS repository_id FROM supplier WHERE s_suppkey = 5")
def worktree_info(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("worktree_id"), F.col("s_name").alias("root"), F.col("s_nationkey").alias("repository_id"))
    return keyed(s, "worktree_id").get(worktree_id=5)


@R.add("generation_fingerprint", "SELECT c_nationkey AS repository_id, c_custkey AS generation, md5(c_custkey::VARCHAR) AS fingerprint FROM customer WHERE c_custkey = 9")
def generation_fingerprint(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("repository_id"), F.col("c_custkey").alias("generation"), F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("fingerprint"))
    return keyed(c, "repository_id", "generation").get(repository_id=c.where("generation = 9").first()["repository_id"], generation=9)


@R.add("artifact_chunk_ids", "SELECT l_partkey AS artifact_id, list('c' || l_orderkey || '-' || l_linenumber ORDER BY l_orderkey, l_linenumber) AS chunk_ids FROM lineitem WHERE l_partkey = 12 GROUP BY l_partkey")
def artifact_chunk_ids(spark, d):
    """Chunk ids of an artifact in order; ordinals are those of order and line."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("artifact_id"), F.struct("l_orderkey", "l_linenumber").alias("ordinal"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("chunk_id"))
    x = keyed(li, "artifact_id").get(artifact_id=12).groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("c"))
    return x.select("artifact_id", F.transform("c", lambda c: c["chunk_id"]).alias("chunk_ids"))


@R.add("artifacts_of_view", f"WITH {VIEW}, {ARTIFACT} SELECT DISTINCT artifact_id, a.path, source_hash FROM v JOIN a USING (artifact_id)")
def artifacts_of_view(spark, d):
    """Many keys at once: the artifacts that any worktree's view names."""
    p, _ = _artifacts(spark, d)
    return keyed(p, "artifact_id").get_all(_view(spark, d).select("artifact_id")).select("artifact_id", "path", "source_hash")
