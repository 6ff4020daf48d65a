"""Catalog, ingest and statistics queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import hashing as H
from quern.functions import paths as P
from quern.functions import text as X
from quern.operators import catalog as C
from quern.operators import stats as T
from quern.plans.base import DOC_PATH, Registry, doc_path
from quern.session import table

R = Registry()
PAGE_PATH = "regexp_replace(url, '^https?://', '')"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


BASE = "regexp_extract(path, '[^/]*$')"
EXT = f"lower(regexp_extract({BASE}, '(\\.[^.]*)$', 1))"
STEM = "regexp_replace({}, '\\.[^.]*$', '')"


@R.add("path_parts", f"""WITH p AS (SELECT page_id, {PAGE_PATH} AS path FROM pages)
SELECT page_id, {BASE} AS base, CASE WHEN NOT contains(path, '/') THEN '.' WHEN regexp_replace(path, '/[^/]*$', '') = '' THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS dir,
 {EXT} AS ext, {STEM.format(BASE)} AS stem FROM p""")
def path_parts(spark, d):
    p = F.col("path")
    return _pages(spark, d).select("page_id", P.base(p).alias("base"), P.directory(p).alias("dir"), P.extension(p).alias("ext"), P.stem(p).alias("stem"))


_EXTS = "(" + ", ".join(f"'{e}'" for e in P.EXTENSIONS) + ")"


@R.add("path_filters", f"""WITH p AS (SELECT page_id, {PAGE_PATH} || CASE page_id % 5 WHEN 0 THEN '.go' WHEN 1 THEN '.min.js' WHEN 2 THEN '.PY' WHEN 3 THEN '.exe' ELSE '' END AS path FROM pages)
SELECT page_id, {EXT} IN {_EXTS} AS supported, (lower(path) LIKE '%.min.js' OR lower(path) LIKE '%.min.css' OR lower(path) LIKE '%.bundle.js' OR lower(path) LIKE '%.bundle.css') AS minified,
 starts_with(path, 'site1') AS prefixed, (regexp_matches(path, '^[^/]*[.]go$') OR contains(path, '.go')) AS globbed FROM p""")
def path_filters(spark, d):
    k = F.col("page_id") % 5
    x = _pages(spark, d).withColumn("path", F.concat("path", F.when(k == 0, ".go").when(k == 1, ".min.js").when(k == 2, ".PY").when(k == 3, ".exe").otherwise("")))
    p = F.col("path")
    return x.select("page_id", P.is_supported(p).alias("supported"), P.is_minified(p).alias("minified"), P.has_prefix(p, "site1").alias("prefixed"), P.matches_pattern(p, "**/*.go").alias("globbed"))


@R.add("prefix_scan", f"SELECT doc_id, {DOC_PATH} AS path FROM documents WHERE starts_with({DOC_PATH}, 'src3/en/')")
def prefix_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", doc_path().alias("path")).where(P.has_prefix(F.col("path"), "src3/en/"))


AREA = """CASE WHEN n = 1 THEN 'root' ELSE s[1] END AS area, CASE WHEN n = 1 THEN regexp_replace(s[1], '\\.[^.]*$', '') WHEN n = 2 THEN regexp_replace(s[2], '\\.[^.]*$', '') ELSE s[2] END AS category"""


@R.add("classify_path", f"WITH p AS (SELECT page_id, string_split({PAGE_PATH}, '/') AS s, len(string_split({PAGE_PATH}, '/')) AS n FROM pages) SELECT page_id, {AREA} FROM p")
def classify_path(spark, d):
    area, category = P.classify_file(F.col("path"))
    return _pages(spark, d).select("page_id", area.alias("area"), category.alias("category"))


@R.add("content_hash", f"""SELECT doc_id, sha256(text) AS content_hash, substr(sha256({DOC_PATH} || ':0:' || octet_length(encode(text)) || ':' || text), 1, 16) AS chunk_hash,
 {DOC_PATH} || '_0' AS chunk_id, ((octet_length(encode(text)) + 3) // 4)::BIGINT AS tokens FROM documents""")
def content_hash(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", H.content_hash(t).alias("content_hash"), H.chunk_hash(doc_path(), F.lit(0), F.octet_length(t), t).alias("chunk_hash"), H.chunk_id(doc_path(), F.lit(0)).alias("chunk_id"), X.estimate_tokens(t).alias("tokens"))


@R.add("blob_oids", "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || '\\x00'::BLOB || encode(text)) AS oid FROM documents")
def blob_oids(spark, d):
    return table(spark, d, "documents").select("doc_id", H.blob_oid(F.col("text")).alias("oid"))


def _hex32(x: str) -> str:
    return f"unhex(lpad(hex(octet_length(encode({x}))), 8, '0')) || encode({x})"


@R.add("artifact_ids", f"SELECT doc_id, sha256({_hex32('source')} || {_hex32(DOC_PATH)} || {_hex32('lang')}) AS artifact_id FROM documents")
def artifact_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", H.canonical(F.col("source"), doc_path(), F.col("lang")).alias("artifact_id"))


@R.add("exact_dup_cache", """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents), c AS (SELECT h, min(doc_id) AS first_id FROM h WHERE doc_id % 2 = 0 GROUP BY h)
SELECT doc_id, first_id AS cached_id, first_id IS NULL AS miss FROM h LEFT JOIN c USING (h)""")
def exact_dup_cache(spark, d):
    x = table(spark, d, "documents").select("doc_id", H.content_hash(F.col("text")).alias("content_hash"))
    cache = x.where("doc_id % 2 = 0").select("content_hash", F.col("doc_id").alias("id"), F.col("doc_id").alias("vector"))
    joined, _ = C.dedup_cached(x, cache)
    return joined.select("doc_id", F.col("cached").alias("cached_id"), F.col("cached").isNull().alias("miss"))


@R.add("embed_misses", """WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT DISTINCT h AS content_hash FROM h WHERE h NOT IN (SELECT h FROM h WHERE doc_id % 2 = 0)""")
def embed_misses(spark, d):
    x = table(spark, d, "documents").select("doc_id", H.content_hash(F.col("text")).alias("content_hash"))
    cache = x.where("doc_id % 2 = 0").select("content_hash", F.col("doc_id").alias("id"), F.col("doc_id").alias("vector"))
    return C.dedup_cached(x, cache)[1]


def _versions(spark, d):
    x = table(spark, d, "documents").select(doc_path().alias("path"), "doc_id", "text")
    desired = x.where("doc_id % 5 <> 0").select("path", F.sha1(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    indexed = x.where("doc_id % 7 <> 0 OR doc_id % 5 = 0").select("path", F.sha1("text").alias("hash"))
    return desired, indexed


VERSIONS = f"""x AS (SELECT {DOC_PATH} AS path, doc_id, text FROM documents),
w AS (SELECT path, sha1(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS hash FROM x WHERE doc_id % 5 <> 0),
h AS (SELECT path, sha1(text) AS hash FROM x WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0)"""


@R.add("reconcile_plan", f"""WITH {VERSIONS} SELECT coalesce(w.path, h.path) AS path, CASE WHEN w.path IS NULL THEN 'DELETE' ELSE 'UPSERT' END AS op, coalesce(w.hash, '') AS desired_hash
FROM w FULL OUTER JOIN h ON w.path = h.path WHERE w.hash IS NULL OR h.hash IS NULL OR w.hash <> h.hash""")
def reconcile_plan(spark, d):
    return C.reconcile(*_versions(spark, d))


@R.add("index_plan", f"""WITH {VERSIONS}, s AS (SELECT w.*, x.doc_id FROM w JOIN x USING (path)), k AS (SELECT h.path, h.hash, x.doc_id % 4 AS n FROM h JOIN x USING (path))
SELECT s.path, s.hash, CASE WHEN coalesce(k.n, 0) > 0 AND s.doc_id <= 100 THEN 'skip_mtime' WHEN coalesce(k.n, 0) > 0 AND s.hash = k.hash THEN 'skip_hash' ELSE 'index' END AS action FROM s LEFT JOIN k USING (path)""")
def index_plan(spark, d):
    desired, indexed = _versions(spark, d)
    ids = table(spark, d, "documents").select(doc_path().alias("path"), "doc_id")
    scanned = desired.join(ids, "path").select("path", "hash", F.col("doc_id").alias("mtime"))
    known = indexed.join(ids, "path").select("path", "hash", (F.col("doc_id") % 4).alias("n_chunks"))
    return C.index_plan(scanned, known, F.lit(100))


@R.add("removed_files", f"WITH {VERSIONS} SELECT path, hash FROM h WHERE path NOT IN (SELECT path FROM w)")
def removed_files(spark, d):
    desired, indexed = _versions(spark, d)
    return C.removed(indexed, desired)


@R.add("unlabelled_documents", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@R.add("latest_wins_upsert", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins_upsert(spark, d):
    return C.latest_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@R.add("keyed_upsert", """WITH n AS (SELECT c_custkey, c_name || '*' AS c_name FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""")
def keyed_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return C.upsert(c, c.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("*"))), ["c_custkey"])


@R.add("replace_by_file", """SELECT l_partkey AS symbol, l_suppkey AS file, 'old' AS origin FROM lineitem WHERE l_suppkey % 4 <> 0 UNION ALL
SELECT p_partkey, p_size AS file, 'new' FROM part WHERE p_size % 4 = 0""")
def replace_by_file(spark, d):
    old = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("file"), F.lit("old").alias("origin"))
    new = table(spark, d, "part").where("p_size % 4 = 0").select(F.col("p_partkey").alias("symbol"), F.col("p_size").cast("long").alias("file"), F.lit("new").alias("origin"))
    files = table(spark, d, "lineitem").where("l_suppkey % 4 = 0").select(F.col("l_suppkey").alias("file"))
    return C.replace_by_file(old, new, files)


@R.add("delete_by_file", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def delete_by_file(spark, d):
    gone = table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return C.delete_by(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), gone, "l_partkey")


@R.add("put_chunk_vectors", """SELECT user_id AS chunk_id, arg_min(value, event_id) AS vector, coalesce(arg_min(CASE WHEN event_type <> 'view' THEN event_type END, CASE WHEN event_type <> 'view' THEN event_id END), '') AS content FROM events GROUP BY user_id""")
def put_chunk_vectors(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("value").alias("vector"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("content"), F.col("event_id").alias("seq"))
    return C.put_chunk_vectors(x)


@R.add("view_switch", """WITH v AS (SELECT o_custkey % 10 AS worktree_id, o_orderpriority AS path, 'a' || max(o_orderkey) AS artifact_id, 3 AS generation FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2),
c AS (SELECT o_custkey % 10 AS worktree_id, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '' END AS path, 'b' || max(o_orderkey) AS artifact_id, o_orderkey % 4 + 1 AS generation FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey % 10, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '2' ELSE '' END, o_orderkey % 4 + 1),
ok AS (SELECT c.*, 1 AS n FROM c WHERE worktree_id >= 5 OR generation = 2 + worktree_id % 3), u AS (SELECT *, 0 AS n FROM v UNION ALL SELECT * FROM ok)
SELECT worktree_id, path, artifact_id, generation::BIGINT AS generation FROM (SELECT *, row_number() OVER (PARTITION BY worktree_id, path ORDER BY generation DESC, n DESC, artifact_id DESC) AS r FROM u) WHERE r = 1""")
def view_switch(spark, d):
    o = table(spark, d, "orders")
    key = (F.col("o_custkey") % 10).alias("worktree_id")
    view = o.where("o_orderkey % 2 = 0").groupBy(key, F.col("o_orderpriority").alias("path")).agg(F.concat(F.lit("a"), F.max("o_orderkey").cast("string")).alias("artifact_id")).withColumn("generation", F.lit(3).cast("long"))
    path = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "2").otherwise("")).alias("path")
    commits = o.where("o_orderkey % 2 = 1").groupBy(key, path, (F.col("o_orderkey") % 4 + 1).alias("generation")).agg(F.concat(F.lit("b"), F.max("o_orderkey").cast("string")).alias("artifact_id"))
    active = spark.range(5).select(F.col("id").alias("worktree_id"), (F.col("id") % 3 + 2).alias("generation"))
    return C.switch_view(view, commits, active)


def _jobs(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 20).alias("repo"), F.col("o_orderpriority").alias("priority"), (F.col("o_orderkey") % 7).alias("attempts"), (F.col("o_orderkey") % 4 == 0).cast("int").alias("claimed"))


JOBS = "j AS (SELECT o_orderkey AS job_id, o_custkey % 20 AS repo, o_orderpriority AS priority, o_orderkey % 7 AS attempts, (o_orderkey % 4 = 0)::INT AS claimed FROM orders)"


@R.add("queue_stats", f"WITH {JOBS} SELECT priority, count(*) AS depth, count(*) FILTER (attempts >= 5) AS dead_letters, count(*) FILTER (claimed = 0) AS pending FROM j GROUP BY priority")
def queue_stats(spark, d):
    return C.queue_stats(_jobs(spark, d))


@R.add("claim_job", f"WITH {JOBS} SELECT job_id, repo, priority FROM j WHERE claimed = 0 ORDER BY priority, job_id LIMIT 1")
def claim_job(spark, d):
    return C.claim_job(_jobs(spark, d)).select("job_id", "repo", "priority")


@R.add("fair_schedule", f"WITH {JOBS} SELECT job_id, repo, row_number() OVER (PARTITION BY repo ORDER BY priority, job_id)::INT AS turn FROM j")
def fair_schedule(spark, d):
    return C.fair_schedule(_jobs(spark, d)).select("job_id", "repo", "turn")


@R.add("job_upsert", """WITH a AS (SELECT o_custkey AS worktree_id, o_orderpriority AS path, o_orderkey % 5 AS generation, 'h' || o_orderkey AS desired_hash, 0 AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
SELECT o_custkey, o_orderpriority, o_orderkey % 5, 'g' || o_orderkey, 1 FROM orders WHERE o_orderkey % 2 = 1)
SELECT worktree_id, path, generation, desired_hash FROM (SELECT *, row_number() OVER (PARTITION BY worktree_id, path ORDER BY generation DESC, n DESC, desired_hash DESC) AS r FROM a) WHERE r = 1""")
def job_upsert(spark, d):
    o = table(spark, d, "orders")
    pick = lambda x, k: x.select(F.col("o_custkey").alias("worktree_id"), F.col("o_orderpriority").alias("path"), (F.col("o_orderkey") % 5).alias("generation"), F.concat(F.lit(k), F.col("o_orderkey").cast("string")).alias("desired_hash"))
    return C.upsert_jobs(pick(o.where("o_orderkey % 2 = 0"), "h"), pick(o.where("o_orderkey % 2 = 1"), "g"))


_STATES = ["pending", "running", "backoff", "dead_letter", "committed"]
_EVENTS = ["claim", "work_complete", "transient_failure", "retry_ready", "superseded", "input_changed"]


@R.add("job_transitions", f"""WITH r(s, e, n) AS (VALUES {", ".join(str(t) for t in C.TRANSITIONS)}), j AS (SELECT o_orderkey AS job_id, {_STATES}[(o_orderkey % 5 + 1)::INT] AS s, CASE WHEN o_orderkey % 8 < 6 THEN {_EVENTS}[(o_orderkey % 8 + 1)::INT] END AS e FROM orders)
SELECT job_id, coalesce(n, j.s) AS state, j.e IS NULL OR n IS NOT NULL AS valid FROM j LEFT JOIN r ON r.s = j.s AND r.e = j.e""")
def job_transitions(spark, d):
    o = table(spark, d, "orders")
    pick = lambda names, k: F.element_at(F.lit(names), k.cast("int"))
    jobs = o.select(F.col("o_orderkey").alias("job_id"), pick(_STATES, F.col("o_orderkey") % 5 + 1).alias("state"))
    events = o.where("o_orderkey % 8 < 6").select(F.col("o_orderkey").alias("job_id"), pick(_EVENTS, F.col("o_orderkey") % 8 + 1).alias("event"))
    return C.advance(jobs, events)


@R.add("import_report", """WITH p AS (SELECT l_orderkey AS path, l_partkey AS chunk_id FROM lineitem), c AS (SELECT p_partkey AS id FROM part WHERE p_size > 10)
SELECT count(*) AS placements, count(*) FILTER (c.id IS NULL) AS dangling, count(DISTINCT c.id) AS unique_chunks, count(DISTINCT path) AS files FROM p LEFT JOIN c ON p.chunk_id = c.id""")
def import_report(spark, d):
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("chunk_ids"))
    return C.import_report(docs, table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")))


@R.add("symbol_backfill", "SELECT p_partkey AS artifact_id, p_size AS symbols_version FROM part WHERE p_size < 7")
def symbol_backfill(spark, d):
    return C.stale_artifacts(table(spark, d, "part").select(F.col("p_partkey").alias("artifact_id"), F.col("p_size").alias("symbols_version")), 7)


# statistics

_TYPES = ["view", "click", "purchase", "signup", "trace-graph"]
ENTRIES = "e AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_type AS command_type, ['full', 'compact', 'toon', 'raw'][(event_id % 4 + 1)::INT] AS output_mode, event_id % 90 AS output_tokens, (event_id % 7) * 512 * 3 AS grep_tokens FROM events)"


def _entries(spark, d):
    e = table(spark, d, "events")
    mode = F.element_at(F.lit(["full", "compact", "toon", "raw"]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("event_type").alias("command_type"), mode.alias("output_mode"), (F.col("event_id") % 90).alias("output_tokens"), ((F.col("event_id") % 7) * 512 * 3).alias("grep_tokens"))


def _map_json(column: str, known: list[str], source: str = "e") -> str:
    rows = " UNION ALL ".join(f"SELECT '{k}' AS k, 0 AS n" for k in known)
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT k, sum(n)::BIGINT AS n FROM (SELECT {column} AS k, count(*) AS n FROM {source} GROUP BY 1 UNION ALL {rows}) GROUP BY k))"


def _flat(column: str):
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@R.add("usage_summary", f"""WITH {ENTRIES} SELECT count(*) AS total_queries, sum(output_tokens)::BIGINT AS output_tokens, sum(grep_tokens)::BIGINT AS grep_tokens, (sum(grep_tokens) - sum(output_tokens))::BIGINT AS tokens_saved,
 round((sum(grep_tokens) - sum(output_tokens))::DOUBLE / sum(grep_tokens)::DOUBLE * 100, 6) AS savings_pct, round((sum(grep_tokens) - sum(output_tokens))::DOUBLE / 1000000 * 5.0, 6) AS cost_saved_usd,
 {_map_json('command_type', _TYPES)} AS by_command_type, {_map_json('output_mode', T.MODES)} AS by_output_mode FROM e""")
def usage_summary(spark, d):
    x = T.summarize(_entries(spark, d), "openai", _TYPES)
    return x.withColumns({"savings_pct": F.round("savings_pct", 6), "cost_saved_usd": F.round("cost_saved_usd", 6), "by_command_type": _flat("by_command_type"), "by_output_mode": _flat("by_output_mode")})


@R.add("usage_history", f"WITH {ENTRIES} SELECT substr(timestamp, 1, 10) AS date, count(*) AS query_count, sum(output_tokens)::BIGINT AS output_tokens, sum(grep_tokens)::BIGINT AS grep_tokens, (sum(grep_tokens) - sum(output_tokens))::BIGINT AS tokens_saved FROM e GROUP BY 1 ORDER BY 1 DESC")
def usage_history(spark, d):
    return T.history(_entries(spark, d))


@R.add("index_stats", "SELECT (SELECT count(*) FROM documents) AS total_files, count(*) AS total_chunks, max(ts) AS last_updated FROM events")
def index_stats(spark, d):
    return T.index_stats(table(spark, d, "documents"), table(spark, d, "events").select(F.col("ts").alias("updated_at")))


@R.add("file_stats", "SELECT source AS path, count(*) AS chunk_count FROM documents GROUP BY 1")
def file_stats(spark, d):
    return T.file_stats(table(spark, d, "documents").select(F.col("source").alias("path")))


@R.add("symbol_stats", "SELECT (SELECT count(*) FROM part) AS total_symbols, (SELECT count(DISTINCT p_brand) FROM part) AS total_files, count(*) AS total_references FROM lineitem")
def symbol_stats(spark, d):
    return T.symbol_stats(table(spark, d, "part").select(F.col("p_brand").alias("file")), table(spark, d, "lineitem"))


@R.add("graph_stats", f"SELECT {_map_json('p_brand', ['none'], 'part')} AS nodes, (SELECT count(*) FROM part) AS total_nodes, {_map_json('l_returnflag', ['none'], 'lineitem')} AS edges, (SELECT count(*) FROM lineitem) AS total_edges".replace("UNION ALL SELECT 'none' AS k, 0 AS n", ""))
def graph_stats(spark, d):
    x = T.graph_stats(table(spark, d, "part").select(F.col("p_brand").alias("kind")), table(spark, d, "lineitem").select(F.col("l_returnflag").alias("type")))
    return x.withColumns({"nodes": _flat("nodes"), "edges": _flat("edges")})


@R.add("token_estimates", "SELECT doc_id, ((octet_length(encode(text)) + 3) // 4)::BIGINT AS tokens, (CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 * 1536 ELSE 50 END)::BIGINT AS grep_tokens FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"), X.grep_tokens(F.col("doc_id") % 5).alias("grep_tokens"))
