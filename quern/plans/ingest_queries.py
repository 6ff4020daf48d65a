"""Chunking, embedding, extraction and event queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import catalog as C
from quern.operators import chunking, embed, extract
from quern.plans.base import DOC_PATH, Registry, chunk_sql, doc_path
from quern.session import table
from quern.sources import files, tables
from quern.streaming import events as E
from quern.streaming import watch as W

R = Registry()


def _files(spark, d):
    return table(spark, d, "documents").select(doc_path().alias("path"), F.col("text").alias("content"))


@R.add("chunk_documents", f"""WITH RECURSIVE f AS (SELECT {DOC_PATH} AS path, text FROM documents), {chunk_sql("f")}
SELECT path, path || '_' || ordinal AS id, ordinal::INT AS ordinal, (length(before) - length(replace(before, chr(10), '')) + 1)::INT AS start_line, (length(until) - length(replace(until, chr(10), '')) + 1)::INT AS end_line,
 sha256(content) AS content_hash, substr(sha256(path || ':' || pos || ':' || stop || ':' || content), 1, 16) AS hash FROM piece""")
def chunk_documents(spark, d):
    return chunking.chunk_files(_files(spark, d)).select("path", "id", "ordinal", "start_line", "end_line", "hash", "content_hash")


@R.add("chunk_coverage", f"SELECT {DOC_PATH} AS path, octet_length(encode(text))::BIGINT AS bytes, true AS starts_with, true AS ends_with FROM documents WHERE NOT regexp_matches(text, '^\\s*$')")
def chunk_coverage(spark, d):
    """That the first chunk begins and the last ends its document."""
    c = chunking.chunk_files(_files(spark, d)).groupBy("path").agg(F.min_by("content", "ordinal").alias("a"), F.max_by("content", "ordinal").alias("z"))
    x = _files(spark, d).join(c, "path")
    return x.select("path", F.octet_length("content").cast("long").alias("bytes"), F.startswith("content", F.col("a")).alias("starts_with"), F.endswith(F.rtrim("content"), F.rtrim(F.col("z"))).alias("ends_with"))


@R.add("token_batches", """WITH RECURSIVE x AS (SELECT source, doc_id AS file_index, ((octet_length(encode(text)) + 3) // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
r(source, rn, batch, c, u) AS (SELECT source, rn, 0::BIGINT, 1::BIGINT, tokens FROM x WHERE rn = 1 UNION ALL
 SELECT x.source, x.rn, batch + f::BIGINT, CASE WHEN f THEN 1 ELSE c + 1 END, CASE WHEN f THEN x.tokens ELSE u + x.tokens END FROM (SELECT r.*, x.rn AS rn2, c >= 20 OR c > 0 AND u + x.tokens > 8000 AS f FROM r JOIN x ON x.source = r.source AND x.rn = r.rn + 1) q JOIN x ON x.source = q.source AND x.rn = q.rn2)
SELECT x.source, file_index, 0 AS chunk_index, tokens, batch FROM x JOIN r ON r.source = x.source AND r.rn = x.rn""")
def token_batches(spark, d):
    x = table(spark, d, "documents").select("source", F.col("doc_id").alias("file_index"), F.lit(0).alias("chunk_index"), F.floor((F.octet_length("text") + 3) / 4).cast("long").alias("tokens"))
    return chunking.batches(x, "source", 20, 8000)


@R.add("token_batches_by_count", "SELECT source, doc_id AS file_index, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 7)::BIGINT AS batch FROM documents")
def token_batches_by_count(spark, d):
    """Batches that only the number of inputs closes."""
    x = table(spark, d, "documents").select("source", F.col("doc_id").alias("file_index"), F.lit(0).alias("chunk_index"), F.lit(1).alias("tokens"))
    return chunking.batches(x, "source", 7).select("source", "file_index", "batch")


@R.add("fake_embeddings", """WITH RECURSIVE t AS (SELECT p_partkey, p_name AS s FROM part), h(p_partkey, s, i, h) AS (SELECT p_partkey, s, 0, 2166136261::UBIGINT FROM t UNION ALL
 SELECT p_partkey, s, i + 1, ((xor(h, ascii(s[i + 1])::UBIGINT)) * 16777619::UBIGINT) % 4294967296 FROM h WHERE i < length(s)),
f AS (SELECT p_partkey, h AS x FROM h WHERE i = length(s)), a AS (SELECT p_partkey, (x * 1664525 + 1013904223) % 4294967296 AS x1 FROM f), b AS (SELECT *, (x1 * 1664525 + 1013904223) % 4294967296 AS x2 FROM a)
SELECT p_partkey, round((x1 % 1000) / 1000.0::DOUBLE, 4) AS v0, round((x2 % 1000) / 1000.0::DOUBLE, 4) AS v1 FROM b""")
def fake_embeddings(spark, d):
    x = embed.embed(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("content")), embed.fake_embedder(2))
    return x.select("p_partkey", F.round(F.col("vector")[0].cast("double"), 4).alias("v0"), F.round(F.col("vector")[1].cast("double"), 4).alias("v1"))


@R.add("cached_build", """WITH c AS (SELECT p_partkey, sha256(p_name) AS h FROM part), k AS (SELECT h, min(p_partkey) AS id FROM c WHERE p_partkey % 50 = 0 GROUP BY h)
SELECT p_partkey, k.id IS NOT NULL AS cached, 2::BIGINT AS dims FROM c LEFT JOIN k USING (h)""")
def cached_build(spark, d):
    c = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("content"), F.sha2("p_name", 256).alias("content_hash"))
    cache = c.where("p_partkey % 50 = 0").select("content_hash", F.col("p_partkey").alias("id"), F.array(F.lit(7.0), F.col("p_partkey").cast("double")).cast("array<float>").alias("vector"))
    x = embed.build(c, cache, embed.fake_embedder(2), 2)
    return x.select("p_partkey", (F.col("vector")[0] == 7.0).alias("cached"), F.size("vector").cast("long").alias("dims"))


def _code(spark, d):
    name = F.concat(F.lit("Fn"), F.col("p_partkey").cast("string"))
    go = F.concat(F.lit("package a\n\n// not Called()\nfunc "), name, F.lit("(x int) {\n\tother(x)\n\ts := \"quoted()\"\n\tif ok(s) {\n\t\tobj.Run"), F.col("p_size").cast("string"), F.lit("()\n\t}\n}\n"))
    py = F.concat(F.lit("class C"), F.col("p_partkey").cast("string"), F.lit(":\n    def run(self):\n        return helper(1)\n\n\ndef top():\n    # call()\n    pass\n"))
    even = F.col("p_partkey") % 2 == 0
    return table(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(even, ".go").otherwise(".py")).alias("path"), F.when(even, go).otherwise(py).alias("content"))


@R.add("extract_symbols", """SELECT 'f' || p_partkey || '.go' AS file, 'Fn' || p_partkey AS name, 'function' AS kind, 4 AS line, true AS exported FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'f' || p_partkey || '.py', 'C' || p_partkey, 'class', 1, true FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT 'f' || p_partkey || '.py', 'run', 'method', 2, true FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'f' || p_partkey || '.py', 'top', 'function', 6, true FROM part WHERE p_partkey % 2 = 1""")
def extract_symbols(spark, d):
    return extract.extract_symbols(_code(spark, d)).select("file", "name", "kind", "line", "exported")


@R.add("extract_references", """SELECT 'f' || p_partkey || '.go' AS file, s AS symbol_name, l AS line, 'Fn' || p_partkey AS caller_name FROM part, (VALUES ('other', 5), ('ok', 7)) v(s, l) WHERE p_partkey % 2 = 0
UNION ALL SELECT 'f' || p_partkey || '.go', 'Run' || p_size, 8, 'Fn' || p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'f' || p_partkey || '.py', 'helper', 3, 'run' FROM part WHERE p_partkey % 2 = 1""")
def extract_references(spark, d):
    return extract.extract_references(_code(spark, d)).select("file", "symbol_name", "line", "caller_name")


@R.add("extract_symbols_precise", """SELECT 'f' || p_partkey || '.py' AS file, 'C' || p_partkey AS name, 'class' AS kind, 1 AS line, 3 AS end_line, '' AS receiver FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'f' || p_partkey || '.py', 'run', 'method', 2, 3, 'C' || p_partkey FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT 'f' || p_partkey || '.py', 'top', 'function', 6, 8, '' FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'f' || p_partkey || '.go', 'Fn' || p_partkey, 'function', 4, 10, '' FROM part WHERE p_partkey % 2 = 0""")
def extract_symbols_precise(spark, d):
    return extract.extract_symbols(_code(spark, d), precise=True).select("file", "name", "kind", "line", "end_line", "receiver")


@R.add("extracted_edges", """SELECT 'Fn' || p_partkey AS caller, s AS callee, 'f' || p_partkey || '.go' AS file, l AS line FROM part, (VALUES ('other', 5), ('ok', 7)) v(s, l) WHERE p_partkey % 2 = 0
UNION ALL SELECT 'Fn' || p_partkey, 'Run' || p_size, 'f' || p_partkey || '.go', 8 FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'run', 'helper', 'f' || p_partkey || '.py', 3 FROM part WHERE p_partkey % 2 = 1""")
def extracted_edges(spark, d):
    return C.call_edges(extract.extract_references(_code(spark, d))).drop("call_type")


@R.add("scattered_vectors", """WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
SELECT source AS path, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY i) AS ids FROM x GROUP BY source""")
def scattered_vectors(spark, d):
    """Vectors that come back from batches, put in the order of their file's chunks."""
    x = table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("file_index"), F.lit(0).alias("chunk_index"))
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    made = x.select(F.col("source").alias("path"), i.alias("chunk_index"), F.array(F.col("doc_id").cast("float")).alias("vector"))
    y = chunking.scatter(made.repartition(5, "chunk_index"), "path")
    return y.select("path", F.size("vectors").cast("long").alias("n"), F.array_join(F.transform("vectors", lambda v: v[0].cast("long").cast("string")), ",").alias("ids"))


@R.add("encode_compact", """SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' AS json FROM documents""")
def encode_compact(spark, d):
    return tables.encode_json(table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("content")), compact=True)


@R.add("encode_toon", """SELECT '  ' || p_partkey || ',' || p_name || ',"' || p_brand || ',x"' AS line FROM part""")
def encode_toon(spark, d):
    return tables.encode_toon(table(spark, d, "part").select("p_partkey", "p_name", F.concat("p_brand", F.lit(",x")).alias("b")))


@R.add("debounce_sessions", """WITH e AS (SELECT user_id AS path, ts, CASE event_type WHEN 'error' THEN 'delete' ELSE event_type END AS k FROM events),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS s FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)),
h AS (SELECT *, sum(s) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT path, min(ts) AS start_, count(*) AS n, CASE WHEN bool_or(k = 'delete') THEN 'delete' ELSE arg_max(k, (ts, k)) END AS event_type FROM h GROUP BY path, sid""")
def debounce_sessions(spark, d):
    kind = F.when(F.col("event_type") == "error", "delete").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"))
    return E.coalesce(e, "6 hours").select("path", F.col("start").cast("timestamp_ntz").alias("start_"), "n", "event_type")


#: Rules of the root and of folders of the documents' paths: folder, pattern.
IGNORE_RULES = [
    ("", "*7.txt"), ("", "# no rule"), ("", "src3/"), ("", "doc_[0-2]*5.txt"), ("src1", "!doc_*7.txt"), ("src2/en", "doc_?.txt"), ("src4", "fr/"), ("src4/fr", "!*.txt"), ("src5", "/en/**"), ("src5/en", "!doc_1*.txt"),
    ("src6", "**/doc_*[!0-4].txt"),
]


@R.add("ignored_paths", f"""WITH p AS (SELECT DISTINCT {DOC_PATH} AS path, source, lang, doc_id::VARCHAR AS n FROM documents)
SELECT path FROM p WHERE CASE WHEN source = 'src3' OR source = 'src4' AND lang = 'fr' THEN true
 WHEN source = 'src2' AND lang = 'en' AND length(n) = 1 THEN true
 WHEN source = 'src5' AND lang = 'en' THEN NOT starts_with(n, '1')
 WHEN source = 'src6' AND n[-1] NOT IN ('0', '1', '2', '3', '4') THEN true
 WHEN source = 'src1' AND n[-1] = '7' THEN false
 ELSE n[-1] = '7' OR n[1] IN ('0', '1', '2') AND n[-1] = '5' AND length(n) > 1 END""")
def ignored_paths(spark, d):
    rules = spark.createDataFrame([(folder, pattern, i) for i, (folder, pattern) in enumerate(IGNORE_RULES)], "folder string, pattern string, number long")
    return files.ignored_paths(table(spark, d, "documents").select(doc_path().alias("path")), rules)


#: Two hours of quiet, twelve at most.
WATCH = W.Times(quiet=7_200_000, latency=43_200_000, poll=10**15, safety=10**15)


@R.add("watch_requests", f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, (event_type = 'error')::BIGINT AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'error') AS i FROM events),
r(user_id, i, first, quiet, hints, overflows, asked, late, h, v) AS (
 SELECT user_id, i, t, t + {WATCH.quiet}, 1 - o, o, NULL::BIGINT, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT FROM e WHERE i = 1
 UNION ALL
 SELECT e.user_id, e.i, CASE WHEN done THEN t ELSE first END, t + {WATCH.quiet}, CASE WHEN done THEN 0 ELSE hints END + 1 - o, CASE WHEN done THEN 0 ELSE overflows END + o,
  CASE WHEN done THEN due END, first + {WATCH.latency} <= quiet, hints, overflows
 FROM (SELECT *, least(quiet, first + {WATCH.latency}) AS due FROM r) q JOIN e ON e.user_id = q.user_id AND e.i = q.i + 1, LATERAL (SELECT due <= t AS done))
SELECT 'u' || user_id AS worktree, asked AS "at", CASE WHEN late THEN 'latency' ELSE 'quiet' END AS reason, h AS hints, v AS overflows FROM r WHERE asked IS NOT NULL""")
def watch_requests(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "overflow").otherwise("hint")
    return W.requests_of(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("worktree"), kind.alias("kind"), "ts"), WATCH)
