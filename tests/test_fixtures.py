"""Literal fixtures: ranking, chunking, features, graphs, statistics."""

import math

import pytest
from pyspark.sql import functions as F

from quern.config import Chunking, Search
from quern.functions import text as X
from quern.functions import vectors as V
from quern.operators import catalog, chunking, embed, graph, search, stats, trace


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cosine(spark):
    x = frame(spark, [(1, "a.go", [1.0, 0.0, 0.0]), (2, "b.go", [0.0, 1.0, 0.0]), (3, "c.go", [1.0, 0.0]), (4, "d.go", [0.0, 0.0, 0.0]), (5, "e.go", [math.nan, 0.0, 0.0])], "id long, path string, vector array<float>")
    hits = search.vector_search(x, [0.9, 0.1, 0], 10).collect()
    assert [h.id for h in hits] == [1, 2, 4]  # other dimensions and non-finite scores are skipped
    assert x.select(V.cosine(F.col("vector"), F.array(F.lit(1.0), F.lit(0.0)))).first()[0] == 0
    with pytest.raises(ValueError):
        V.validate_query([1.0, math.inf], 2)
    assert V.decode_vector(V.encode_vector([1.0, 2.5]), 2) == [1.0, 2.5]
    with pytest.raises(ValueError):
        V.decode_vector(b"123", 1)


def test_text_score(spark):
    x = frame(spark, [(1, "p", "func login(user)"), (2, "p", "func logout()"), (3, "p", "the User has an email"), (4, "p", "validateEmail(x)")], "id int, path string, content string")
    hits = search.text_search(x, "user email").collect()
    assert [h.id for h in hits] == [3, 1, 4] and hits[0].score == 1.0
    assert [h.id for h in search.text_search(x, "login").collect()] == [1]
    assert search.text_search(x, "database connection").count() == 0
    assert X.query_words("a b c") == [] and X.query_words("UPPER CASE") == ["upper", "case"]
    assert X.query_words("user user") == ["user", "user"]


def test_rrf(spark):
    lists = [frame(spark, [(i, k) for k, i in enumerate(ids)], "id string, rank int") for ids in (["a", "b", "c"], ["b", "d", "a"])]
    assert [r.id for r in search.fuse(lists).collect()][:2] == ["b", "a"]
    assert search.fuse(lists).count() == 4 and search.fuse(lists[:1], limit=2).count() == 2
    assert Search(rrf_k=0).k == 60


def test_boost(spark):
    x = frame(spark, [(1, "foo_test.go", 0.9), (2, "main.go", 0.8)], "id int, path string, score double")
    got = {r.path: round(r.score, 6) for r in search.boosted(x, Search(penalties=[("_test.go", 0.5)], bonuses=[])).collect()}
    assert got == {"foo_test.go": 0.45, "main.go": 0.8}
    x = frame(spark, [(1, "cmd/main_test.go", 1.0), (2, "internal/handler.go", 0.7)], "id int, path string, score double")
    got = {r.path: round(r.score, 6) for r in search.boosted(x, Search(penalties=[("_test.go", 0.5)], bonuses=[("cmd/", 1.3), ("internal/", 1.1)])).collect()}
    assert got == {"cmd/main_test.go": 0.65, "internal/handler.go": 0.77}


@pytest.mark.parametrize("n,want", [(201, [(0, 201), (1, 201)]), (2049, [(0, 2048), (1848, 2049), (1849, 2049)]), (5000, [(0, 2048), (1848, 3896), (3696, 5000), (4800, 5000)])])
def test_chunk_tail(n, want):
    assert list(chunking.spans(b"a" * n)) == want


def test_chunk_basics():
    c = chunking.chunk("f.go", "line of code\n" * 50, Chunking(100, 10))
    assert c and all(1 <= x["start_line"] <= x["end_line"] <= 50 for x in c)
    assert chunking.chunk("f", "") == [] and chunking.chunk("f", " \n\t\n") == []
    for s in ("═" * 20, "🚀" * 15, "é" * 30):
        assert all("�" not in x["content"] for x in chunking.chunk("f", s, Chunking(3, 1)))
    assert Chunking(0, -1).resolved() == (512, 50) and Chunking(10, 20).resolved() == (10, 1)
    r = chunking.rechunk("f.go", 3, "x = 1\n" * 100, 40)
    assert r[0]["id"] == "f.go_3_0" and r[0]["start_line"] == 40
    a, b = chunking.chunk("f", "abc"), chunking.chunk("f", "abc", prefix="File: f\n\n")
    assert a[0]["hash"] == b[0]["hash"] and b[0]["content"] == "File: f\n\nabc"


def test_fake_embedder():
    v = embed.fake_embedder(4)(["a", "a", "b"])
    assert (v[0] == v[1]).all() and (v[0] != v[2]).any()
    seed = ((2166136261 ^ ord("a")) * 16777619) % 2**32
    seed = (seed * 1664525 + 1013904223) % 2**32
    assert abs(v[0][0] - seed % 1000 / 1000) < 1e-6


@pytest.mark.parametrize("name,label", [("HandleRequest", "handle-request"), ("validateToken", "validate-token"), ("GetUserByID", "get-user-by-id"), ("Server", "operate-server"), ("TokenValidator", "operate-token-validator"), ("", "unknown"), ("GetUserAccountInformationDetails", "get-user-account-information"), ("parse_config_file", "parse-config-file")])
def test_feature_labels(spark, name, label):
    assert spark.range(1).select(X.kebab(X.atomic_feature(F.lit(name)))).first()[0] == label


def test_classify_file(spark):
    from quern.functions.paths import classify_file

    x = frame(spark, [("cli/watch.go",), ("store/gob.go",), ("main.go",), ("./internal/foo/bar.go",)], "p string")
    area, category = classify_file(F.col("p"))
    assert [tuple(r) for r in x.select(area, category).collect()] == [("cli", "watch"), ("store", "gob"), ("root", "main"), ("internal", "foo")]


def test_node_search(spark):
    n = frame(spark, [("1", "symbol", "a.go", "HandleRequest", "handle request"), ("2", "symbol", "a.go", "ValidateToken", "validate token"), ("3", "symbol", "b.go", "HandleResponse", "handle response")], "id string, kind string, path string, symbol_name string, feature string")
    hits = graph.search_nodes(n, "handle request").collect()
    assert hits[0].id == "1" and hits[0].score > 0 and graph.search_nodes(n, "nothing").count() == 0


SYMBOLS = "name string, kind string, file string, line int, end_line int"
EDGES = "caller string, callee string, file string, line int"


def test_unknown_names_are_leaves(spark):
    s = frame(spark, [(n, "function", "a.go", i * 10, i * 10 + 5) for i, n in enumerate(["RootFn", "OtherA", "OtherB"])], SYMBOLS)
    e = frame(spark, [("RootFn", "ExternalCall", "a.go", 2), ("OtherA", "ExternalCall", "a.go", 12), ("OtherB", "ExternalCall", "a.go", 22)], EDGES)
    _, edges = trace.call_graph(e, s, "RootFn", 2)
    assert [(r.caller, r.callee) for r in edges.collect()] == [("RootFn", "ExternalCall")]


def test_ambiguous_names_are_not_followed(spark):
    s = frame(spark, [("Root", "f", "a.go", 1, 5), ("Load", "f", "b.go", 1, 5), ("Load", "f", "c.go", 1, 5), ("Deep", "f", "d.go", 1, 5)], SYMBOLS)
    e = frame(spark, [("Root", "Load", "a.go", 2), ("Load", "Deep", "b.go", 2), ("Root", "Root", "a.go", 1)], EDGES)
    _, edges = trace.call_graph(e, s, "Root", 3)
    assert [(r.caller, r.callee) for r in edges.collect()] == [("Root", "Load")]  # and no edge for the declaration


def test_incremental_edges(spark):
    n = frame(spark, [("caller", "a.go"), ("callee", "b.go"), ("peer", "c.go"), ("far", "d.go")], "id string, path string")
    old = frame(spark, [("caller", "peer", "invokes", 1.0), ("peer", "far", "invokes", 1.0), ("file:a.go", "caller", "contains", 1.0)], "src string, dst string, type string, weight double")
    fresh = frame(spark, [("caller", "callee", "invokes", 1.0), ("peer", "far", "invokes", 1.0)], "src string, dst string, type string, weight double")
    got = graph.refresh_edges(old, fresh, n, frame(spark, [("a.go",)], "path string"), ["invokes"])
    assert {(r.src, r.dst) for r in got.collect()} == {("caller", "callee"), ("peer", "far"), ("file:a.go", "caller")}


ENTRY = "timestamp string, command_type string, output_mode string, output_tokens int, grep_tokens int"


def test_stats(spark):
    e = frame(spark, [("2024-01-02T10:00:00Z", "search", "full", 100, 2560), ("2024-01-01T10:00:00Z", "search", "toon", 300, 1536)], ENTRY)
    r = stats.summarize(e, "openai").first()
    assert (r.total_queries, r.output_tokens, r.grep_tokens, r.tokens_saved) == (2, 400, 4096, 3696)
    assert r.by_command_type["search"] == 2 and r.by_command_type["trace-graph"] == 0 and r.cost_saved_usd > 0
    assert stats.summarize(e, "ollama").first().cost_saved_usd is None
    one = stats.summarize(frame(spark, [("x", "search", "full", 200, 2048)], ENTRY), "ollama").first()
    assert abs(one.savings_pct - 90.234375) < 1e-9
    h = stats.history(frame(spark, [("2024-01-01T1", "s", "f", 1, 1), ("2024-01-02T1", "s", "f", 1, 1), ("2024-01-02T2", "s", "f", 1, 1), ("2024-01-03T1", "s", "f", 1, 1), ("bad", "s", "f", 1, 1)], ENTRY)).collect()
    assert [(r.date, r.query_count) for r in h] == [("unknown", 1), ("2024-01-03", 1), ("2024-01-02", 2), ("2024-01-01", 1)]
    assert stats.summarize(frame(spark, [], ENTRY), "openai").first().total_queries == 0


def test_content_backfill(spark):
    x = frame(spark, [("c", "", 1), ("c", "real", 2), ("c", "other", 3)], "chunk_id string, content string, seq int").withColumn("vector", F.array(F.lit(1.0)))
    assert catalog.put_chunk_vectors(x).first().content == "real"


def test_snapshot(spark, tmp_path):
    s = catalog.Snapshot(spark, f"file://{tmp_path}")
    s.save({"t": spark.range(3)})
    assert s.load("t").count() == 3
    with pytest.raises(ValueError):
        catalog.Snapshot(spark, f"file://{tmp_path}", version=2).load("t")


def test_capped_groups(spark):
    n = spark.range(30).select(F.concat(F.lit("n"), "id").alias("id"), F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f")).alias("path"), F.lit("get").alias("verb"))
    assert graph.cap_groups(n, "verb", 10).count() == 10
    assert graph.cap_groups(n, "verb", 8, by_directory=True).count() == 24


def test_toon(spark):
    from quern.sources import tables

    x = frame(spark, [(1, 'a"b', None)], "i int, s string, n string")
    assert tables.encode_toon(x).first()[0] == '  1,"a\\"b",null' and tables.toon_header(x) == "results{i,s,n}:"
