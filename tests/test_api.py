"""The facade and index maintenance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.api import Repository, workspace
from quern.operators import embed, extract, graph, index
from quern.operators.catalog import call_edges

CODE = {
    "cli/main.go": "package main\n\nfunc Main() {\n\tLoadConfig()\n\tServe()\n}\n",
    "store/load.go": "package store\n\nfunc LoadConfig() {\n\tParseFile()\n}\n\nfunc ParseFile() {}\n",
    "store/load_test.go": "package store\n\nfunc TestLoad() {\n\tLoadConfig()\n}\n",
}


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame(list(CODE.items()), "path string, content string")
    embedder = embed.fake_embedder(8)
    scanned = files.select("path", F.sha2("content", 256).alias("hash"), F.lit(1).cast("long").alias("mtime"), "content")
    documents = spark.createDataFrame([], "path string, hash string, mtime long, chunk_ids array<string>")
    chunks = spark.createDataFrame([], "id string, path string, start_line int, end_line int, content string, vector array<float>, hash string, content_hash string")
    chunks = index.update(scanned, documents, chunks, embedder, 8).chunks.persist()
    refs = extract.extract_references(files)
    refs = refs.withColumn("ref_id", F.monotonically_increasing_id()).persist()
    symbols = extract.extract_symbols(files, infer_end_line=True).persist()
    nodes = graph.symbol_nodes(symbols.select(F.col("file").alias("path"), F.col("name").alias("symbol_name"), "receiver", "line", "end_line")).withColumn("kind", F.lit("symbol"))
    edges = call_edges(refs).drop("call_type")
    graph_edges = graph.invokes_edges(edges, nodes).unionByName(graph.contains_edges(nodes))
    return Repository(spark, embedder, chunks, symbols, refs, edges, nodes, graph_edges, graph.placed(nodes))


def test_search(repo):
    hits = repo.search(CODE["store/load.go"], 2).collect()
    assert hits[0].path == "store/load.go" and len(hits) == 2  # the same text, and no test file first
    assert {r.path for r in repo.search("x", 5, path="cli/").collect()} == {"cli/main.go"}
    assert '"content":' not in repo.encode(repo.search("x"), "compact").first()[0] and repo.encode(repo.search("x"), "toon").count() == 3


def test_trace(repo):
    assert {(r.caller_name, r.def_file) for r in repo.trace_callers("LoadConfig").collect()} == {("Main", "cli/main.go"), ("TestLoad", "store/load_test.go")}
    assert [r.callee for r in repo.trace_callees("Main").collect()] == ["LoadConfig", "Serve"]
    nodes, edges = repo.trace_graph("Main")
    assert {r.name for r in nodes.collect()} == {"Main", "LoadConfig", "ParseFile"}
    assert {(r.caller, r.callee) for r in edges.collect()} == {("Main", "LoadConfig"), ("Main", "Serve"), ("LoadConfig", "ParseFile")}
    assert repo.refs_readers("x").count() == repo.refs_writers("x").count() == repo.refs_graph("x").count() == 0


def test_graph(repo):
    hits = repo.graph_search("load config").collect()
    assert hits[0].symbol_name == "LoadConfig" and hits[0].feature == "load config"
    assert {r.path for r in repo.graph_search("serve", mode="snippets").collect()} == {"cli/main.go"}
    got = repo.graph_fetch([hits[0].id]).first()
    assert (got.feature_path, got.n_out, got.n_in) == ("store/load/load", 1, 3)
    nodes, edges = repo.graph_explore(hits[0].id, types=["invokes"])
    assert nodes.count() == 4 and edges.count() > 2


def test_workspace(repo):
    assert workspace({"a": repo.symbols, "b": repo.symbols}).groupBy("project").count().count() == 2
    assert workspace({"a": repo.symbols, "b": repo.symbols}, "b").select("project").distinct().first()[0] == "b"


def test_unchanged_files_are_not_embedded(spark):
    """200 files of 80 functions, all known: nothing is indexed, the embedder isn't called."""
    text = "".join(f"func F{i}() {{}}\n" for i in range(80))
    scanned = spark.range(200).select(F.concat(F.lit("f"), "id", F.lit(".go")).alias("path"), F.lit(1).cast("long").alias("mtime"), F.lit(text).alias("content")).withColumn("hash", F.sha2("content", 256))
    documents = scanned.select("path", "hash", "mtime", F.array(F.concat("path", F.lit("_0"))).alias("chunk_ids"))
    chunks = documents.select(F.col("chunk_ids")[0].alias("id"), "path", F.lit(1).alias("start_line"), F.lit(80).alias("end_line"), F.lit("").alias("content"), F.array(F.lit(1.0)).cast("array<float>").alias("vector"), F.lit("").alias("hash"), F.lit("").alias("content_hash"))

    def never(texts):
        raise AssertionError("embedder called")

    r = index.update(scanned, documents, chunks, never, 1)
    assert r.plan.where("action = 'index'").count() == 0 and r.plan.where("action = 'skip_hash'").count() == 200
    assert r.chunks.count() == r.documents.count() == 200


def test_long_texts_are_halved():
    calls = []

    def embedder(texts):
        calls.append(max(map(len, texts)))
        return np.ones((len(texts), 2), dtype=np.float32)

    out = index.embed_within(["short", "word " * 200], embedder, 600)
    assert out.shape == (2, 2) and max(calls) <= 600
    with pytest.raises(ValueError):
        index.embed_within(["x" * 1000], embedder, 10, attempts=1)


def test_materialized_tables_are_dropped(spark):
    from quern.session import drop_materialized, materialize

    drop_materialized(spark)
    x = materialize(spark.range(5), "five")
    path = x.inputFiles()[0].removeprefix("file://")
    assert x.count() == 5 and drop_materialized(spark) == 1

    import os

    assert not os.path.exists(path)
