"""Index maintenance, views, lookups and text scalars on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.api import workspace
from quern.functions import text as X
from quern.operators import catalog as C
from quern.operators import chunking, embed, index
from quern.operators import lines as L
from quern.operators.rounds import Permanent, index_once
from quern.plans.base import DOC_PATH, Registry, chunk_sql, doc_path
from quern.plans.catalog_queries import JOBS, _jobs
from quern.session import materialize, shared_dir, table

R = Registry()


def _updated(spark, d):
    """An index of all documents brought up to date with a scan of all: every ninth changed, every tenth under another path."""
    docs = table(spark, d, "documents").select("doc_id", doc_path().alias("path"), F.col("text").alias("content"))
    changed = F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    moved = F.when(F.col("doc_id") % 10 == 9, F.concat("path", F.lit(".moved"))).otherwise(F.col("path"))
    scanned = docs.select(moved.alias("path"), F.sha2(changed, 256).alias("hash"), F.col("doc_id").alias("mtime"), changed.alias("content"))
    old = chunking.chunk_files(docs.select("path", "content"))
    ids = old.groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"))
    known = docs.select("path", F.sha2("content", 256).alias("hash"), (F.col("doc_id") - 1).alias("mtime")).join(ids, "path", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>")))
    chunks = old.select("id", "path", "start_line", "end_line", "content", F.array(F.lit(9.0), F.lit(9.0)).cast("array<float>").alias("vector"), "hash", "content_hash")
    return index.update(scanned, known, chunks, embed.fake_embedder(2), 2)


UPDATED = f"""x AS (SELECT doc_id, {DOC_PATH} AS path, text FROM documents),
now_ AS (SELECT doc_id, path AS was, path || CASE WHEN doc_id % 10 = 9 THEN '.moved' ELSE '' END AS path, text || CASE WHEN doc_id % 9 = 0 THEN '!' ELSE '' END AS text, doc_id % 9 = 0 OR doc_id % 10 = 9 AS changed FROM x),
f AS (SELECT 'old ' || path AS path, text FROM x UNION ALL SELECT 'new ' || path, text FROM now_), {chunk_sql("f")},
known AS (SELECT DISTINCT sha256(content) AS h FROM piece WHERE path LIKE 'old %'), c AS (SELECT substr(path, 5) AS path, ordinal, sha256(content) AS content_hash FROM piece WHERE path LIKE 'new %')"""


@R.add("incremental_index", f"WITH RECURSIVE {UPDATED} SELECT path, ordinal::INT AS ordinal, content_hash, content_hash IN (SELECT h FROM known) AS reused FROM c")
def incremental_index(spark, d):
    ordinal = F.substring_index("id", "_", -1).cast("int")
    return _updated(spark, d).chunks.select("path", ordinal.alias("ordinal"), "content_hash", (F.col("vector")[0] == 9.0).alias("reused"))


@R.add("incremental_documents", f"""WITH RECURSIVE {UPDATED}, i AS (SELECT path, string_agg(path || '_' || ordinal, ',' ORDER BY path || '_' || ordinal) AS ids FROM c GROUP BY path)
SELECT now_.path, sha256(text) AS hash, CASE WHEN changed OR ids IS NULL THEN doc_id ELSE doc_id - 1 END AS mtime, coalesce(ids, '') AS chunk_ids FROM now_ LEFT JOIN i ON i.path = now_.path""")
def incremental_documents(spark, d):
    return _updated(spark, d).documents.select("path", "hash", "mtime", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def _view(spark, d):
    view = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_custkey") % 500).alias("artifact_id"))
    artifacts = table(spark, d, "part").select(F.col("p_partkey").alias("artifact_id"), F.md5(F.col("p_name").cast("binary")).alias("source_hash"), F.col("p_size").alias("symbols_version"))
    symbols = table(spark, d, "lineitem").select((F.col("l_suppkey") % 500).alias("artifact_id"), F.concat(F.lit("f"), (F.col("l_partkey") % 200).cast("string")).alias("name"), F.col("l_linenumber").alias("line"))
    return view, artifacts, symbols


VIEW = """v AS (SELECT 'o' || o_orderkey AS path, o_custkey % 500 AS artifact_id FROM orders), a AS (SELECT p_partkey AS artifact_id, md5(p_name) AS source_hash, p_size AS symbols_version FROM part),
s AS (SELECT l_suppkey % 500 AS artifact_id, 'f' || (l_partkey % 200) AS name, l_linenumber AS line FROM lineitem)"""


@R.add("view_symbols", f"WITH {VIEW} SELECT path, name, line FROM v JOIN s USING (artifact_id) WHERE name IN ('f7', 'f8')")
def view_symbols(spark, d):
    v, _, s = _view(spark, d)
    return index.view_symbols(v, s, ["f7", "f8"]).select("path", "name", "line")


@R.add("indexed_hashes", f"WITH {VIEW} SELECT path, source_hash AS hash FROM v JOIN a USING (artifact_id)")
def indexed_hashes(spark, d):
    v, a, _ = _view(spark, d)
    return index.indexed_hashes(v, a)


@R.add("missing_symbols", f"WITH {VIEW} SELECT DISTINCT artifact_id, source_hash, symbols_version FROM v JOIN a USING (artifact_id) WHERE symbols_version < 9")
def missing_symbols(spark, d):
    v, a, _ = _view(spark, d)
    return index.missing_symbols(v, a, 9)


@R.add("index_status", f"WITH {VIEW}, {JOBS} SELECT (SELECT count(*) FROM j WHERE claimed = 0) AS pending, (SELECT count(*) FROM j WHERE attempts >= 5) AS dead_letters, (SELECT count(DISTINCT artifact_id) FROM v JOIN a USING (artifact_id) WHERE symbols_version < 9) AS symbols_to_fill, 3::BIGINT AS generation, false AS fresh")
def index_status(spark, d):
    v, a, _ = _view(spark, d)
    return index.status(_jobs(spark, d), a, v, 3, 9)


@R.add("queue_across_catalogs", f"WITH {JOBS}, q AS (SELECT priority, count(*) AS depth, count(*) FILTER (attempts >= 5) AS dead_letters FROM j GROUP BY priority) SELECT priority, (2 * depth)::BIGINT AS depth, (2 * dead_letters)::BIGINT AS dead_letters FROM q")
def queue_across_catalogs(spark, d):
    q = C.queue_stats(_jobs(spark, d))
    return index.across([q, q])


@R.add("workspace_union", "SELECT 'a' AS project, p_partkey, p_brand FROM part WHERE p_size < 20 UNION ALL SELECT 'b', p_partkey, p_brand FROM part WHERE p_size >= 20")
def workspace_union(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return workspace({"a": p.where("p_size < 20").drop("p_size"), "b": p.where("p_size >= 20").drop("p_size")})


@R.add("get_document", f"SELECT doc_id, {DOC_PATH} AS path, sha256(text) AS hash FROM documents WHERE doc_id = 7")
def get_document(spark, d):
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", doc_path().alias("path"), F.sha2("text", 256).alias("hash"))


@R.add("list_documents", f"SELECT source, count(*) AS n_files, sum(n_chars)::BIGINT AS n_chars, min({DOC_PATH}) AS first_path FROM documents GROUP BY source")
def list_documents(spark, d):
    return table(spark, d, "documents").withColumn("path", doc_path()).groupBy("source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"), F.min("path").alias("first_path"))


@R.add("duplicate_content", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@R.add("source_snippets", """WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, doc_id % 3 + 1 AS s, doc_id % 3 + 2 AS e FROM documents)
SELECT doc_id, array_to_string(list_slice(l, s, e), chr(10)) AS snippet, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short, array_to_string(list_slice(l, 1, 20), chr(10)) AS preview FROM t""")
def source_snippets(spark, d):
    t = F.col("text")
    s = (F.col("doc_id") % 3 + 1).cast("int")
    return table(spark, d, "documents").select("doc_id", X.snippet(t, s, s + 1).alias("snippet"), X.truncate(t, 100).alias("short"), X.code_preview(t, F.lit(0), F.lit(0)).alias("preview"))


@R.add("name_predicates", """SELECT p_partkey, regexp_matches(n, '^[A-Z]') AS go_exported, NOT starts_with(n, '_') AS python_exported, CASE WHEN string_split(string_split(f, '@')[1], '-')[1] = '' THEN 'general' ELSE string_split(string_split(f, '@')[1], '-')[1] END AS kind FROM
(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '_' || p_name ELSE p_name END AS n, CASE WHEN p_partkey % 4 = 0 THEN '@x' ELSE replace(p_name, ' ', '-') || '@f' END AS f FROM part)""")
def name_predicates(spark, d):
    k = F.col("p_partkey")
    n = F.when(k % 3 == 0, F.upper("p_name")).when(k % 3 == 1, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name"))
    f = F.when(k % 4 == 0, "@x").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@f")))
    return table(spark, d, "part").select("p_partkey", X.is_exported(n, F.lit("go")).alias("go_exported"), X.is_exported(n, F.lit("python")).alias("python_exported"), X.classify_symbol(f).alias("kind"))


@R.add("snapshot_roundtrip", "SELECT p_partkey, p_name FROM part")
def snapshot_roundtrip(spark, d):
    """A table saved as a snapshot in the shared folder and read back through its pointer."""
    from quern.session import shared_dir

    s = C.Snapshot(spark, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}")
    s.save({"part": table(spark, d, "part").select("p_partkey", F.lit("old").alias("p_name"))})
    s.save({"part": table(spark, d, "part").select("p_partkey", "p_name")})
    return s.load("part")


@R.add("written_and_read", "SELECT s_suppkey, s_name FROM supplier")
def written_and_read(spark, d):
    return materialize(table(spark, d, "supplier").select("s_suppkey", "s_name"), "supplier")


@R.add("indexed_under", f"SELECT count(*) > 0 AS found FROM documents WHERE starts_with('ws/' || {DOC_PATH}, 'ws/src3/en')")
def indexed_under(spark, d):
    return index.indexed_under(table(spark, d, "documents").select(F.concat(F.lit("ws/"), doc_path()).alias("path")), "ws", "src3", "en")


def _work(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 200).alias("worktree_id"), (F.col("o_orderkey") % 2).alias("claimed"))
    return jobs, table(spark, d, "supplier").select(F.col("s_suppkey").alias("worktree_id"), F.col("s_nationkey").alias("repository_id"))


WORK = "jb AS (SELECT o_orderkey AS job_id, o_custkey % 200 AS worktree_id, o_orderkey % 2 AS claimed FROM orders), wt AS (SELECT s_suppkey AS worktree_id, s_nationkey AS repository_id FROM supplier)"


@R.add("jobs_of_worktrees", f"WITH {WORK} SELECT job_id, repository_id FROM jb JOIN wt USING (worktree_id)")
def jobs_of_worktrees(spark, d):
    return index.jobs_of_worktrees(*_work(spark, d)).select("job_id", "repository_id")


@R.add("repositories_with_work", f"WITH {WORK} SELECT DISTINCT repository_id FROM jb JOIN wt USING (worktree_id) WHERE claimed = 0")
def repositories_with_work(spark, d):
    return index.repositories_with_work(*_work(spark, d))


def _artifacts(spark, d):
    p = table(spark, d, "part")
    artifacts = p.select(F.col("p_partkey").alias("artifact_id"), F.col("p_size").alias("symbols_version"))
    symbols = table(spark, d, "lineitem").select(F.col("l_partkey").alias("artifact_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("name"))
    new = p.where("p_size > 25").select(F.col("p_partkey").alias("artifact_id"), F.lit("new").alias("name"))
    return symbols, artifacts, new


@R.add("put_symbols", "SELECT l_partkey AS artifact_id, 's' || l_linenumber AS name FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size > 25")
def put_symbols(spark, d):
    return C.put_symbols(*_artifacts(spark, d), 99)[0].select("artifact_id", "name")


@R.add("bumped_artifacts", "SELECT p_partkey AS artifact_id, CASE WHEN p_size > 25 THEN 99 ELSE p_size END AS symbols_version FROM part")
def bumped_artifacts(spark, d):
    return C.put_symbols(*_artifacts(spark, d), 99)[1]


#: Worktrees 0 to 4 of repositories 0, 1 and 2; generations of the first two, with one active each, and of the third, with none.
CATALOG_SQL = """trees AS (SELECT DISTINCT n_nationkey % 5 AS worktree_id, n_nationkey % 5 % 3 AS repository_id FROM nation),
gens AS (SELECT DISTINCT s_suppkey % 3 AS repository_id, s_suppkey % 4 AS generation,
  CASE WHEN s_suppkey % 3 = 2 THEN 'building' WHEN s_suppkey % 4 = 2 THEN 'active' ELSE 'retired' END AS state FROM supplier),
act AS (SELECT worktree_id, generation AS active FROM trees JOIN gens USING (repository_id) WHERE state = 'active'),
view0 AS (SELECT o_orderkey % 5 AS worktree_id, 'f' || o_orderkey % 977 AS path, max([o_custkey % 4, o_orderkey])[2] AS artifact_id, max(o_custkey % 4) AS generation FROM orders GROUP BY 1, 2),
jobs0 AS (SELECT c_custkey % 5 AS worktree_id, 'f' || c_custkey % 977 AS path, min(c_custkey % 3 + 1) AS generation, min(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'h' || c_custkey % 3 END) AS desired_hash FROM customer GROUP BY 1, 2)"""


def _catalog(spark, d):
    """worktrees, generations, view and jobs as in CATALOG_SQL."""
    n, s, o, c = (table(spark, d, t) for t in ("nation", "supplier", "orders", "customer"))
    trees = n.select((F.col("n_nationkey") % 5).alias("worktree_id"), (F.col("n_nationkey") % 5 % 3).alias("repository_id")).distinct()
    state = F.when(F.col("s_suppkey") % 3 == 2, "building").when(F.col("s_suppkey") % 4 == 2, "active").otherwise("retired")
    gens = s.select((F.col("s_suppkey") % 3).alias("repository_id"), (F.col("s_suppkey") % 4).alias("generation"), state.alias("state")).distinct()
    path = lambda k: F.concat(F.lit("f"), (F.col(k) % 977).cast("string")).alias("path")
    last = F.max(F.struct((F.col("o_custkey") % 4).alias("generation"), F.col("o_orderkey").alias("artifact_id"))).alias("v")
    view = o.groupBy((F.col("o_orderkey") % 5).alias("worktree_id"), path("o_orderkey")).agg(last).select("worktree_id", "path", "v.artifact_id", "v.generation")
    want = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("c_custkey") % 3).cast("string")))
    jobs = c.groupBy((F.col("c_custkey") % 5).alias("worktree_id"), path("c_custkey")).agg(F.min(F.col("c_custkey") % 3 + 1).alias("generation"), F.min(want).alias("desired_hash"))
    return trees, gens, view, jobs


def _rolled(spark, d):
    _, gens, view, jobs = _catalog(spark, d)
    return C.roll_generation(gens, view, jobs, 3, 0, 1)


@R.add("roll_generation", f"WITH {CATALOG_SQL} SELECT repository_id, generation, CASE WHEN repository_id = 0 AND generation = 1 THEN 'active' WHEN repository_id = 0 AND state = 'active' THEN 'retired' ELSE state END AS state FROM gens")
def roll_generation(spark, d):
    return _rolled(spark, d)[0]


@R.add("rolled_view", f"WITH {CATALOG_SQL} SELECT * FROM view0 WHERE worktree_id <> 3")
def rolled_view(spark, d):
    return _rolled(spark, d)[1]


@R.add("rolled_jobs", f"WITH {CATALOG_SQL} SELECT * FROM jobs0 WHERE worktree_id <> 3")
def rolled_jobs(spark, d):
    return _rolled(spark, d)[2]


#: Deletes of paths by suppliers' line items, with the empty hash or another, in generations 0 to 3.
DELETES_SQL = f"""{CATALOG_SQL},
dels AS (SELECT DISTINCT l_orderkey % 5 AS worktree_id, 'f' || l_orderkey % 977 AS path, l_partkey % 4 AS generation, CASE WHEN l_suppkey % 4 = 0 THEN 'h1' ELSE '' END AS desired_hash FROM lineitem),
done AS (SELECT d.*, j.generation AS job FROM dels d JOIN jobs0 j ON j.worktree_id = d.worktree_id AND j.path = d.path AND j.desired_hash = d.desired_hash AND j.generation <= d.generation),
gone AS (SELECT done.* FROM done LEFT JOIN act USING (worktree_id) WHERE active IS NULL OR active = generation)"""


def _deleted(spark, d):
    trees, gens, view, jobs = _catalog(spark, d)
    li = table(spark, d, "lineitem")
    deletes = li.select((F.col("l_orderkey") % 5).alias("worktree_id"), F.concat(F.lit("f"), (F.col("l_orderkey") % 977).cast("string")).alias("path"), (F.col("l_partkey") % 4).alias("generation"), F.when(F.col("l_suppkey") % 4 == 0, "h1").otherwise("").alias("desired_hash"))
    return C.commit_deletes(view, jobs, deletes, C.active_of(trees, gens))


@R.add("commit_delete", f"WITH {DELETES_SQL} SELECT * FROM view0 v WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.worktree_id = v.worktree_id AND g.path = v.path AND v.generation <= g.generation)")
def commit_delete(spark, d):
    return _deleted(spark, d)[0]


@R.add("deleted_jobs", f"WITH {DELETES_SQL} SELECT * FROM jobs0 j WHERE NOT EXISTS (SELECT 1 FROM done g WHERE g.worktree_id = j.worktree_id AND g.path = j.path AND g.desired_hash = j.desired_hash AND j.generation <= g.generation)")
def deleted_jobs(spark, d):
    return _deleted(spark, d)[1]


@R.add("register_rows", "SELECT n_nationkey AS repository_id, n_name AS root FROM nation UNION ALL SELECT s_suppkey, min(s_name) FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY s_suppkey")
def register_rows(spark, d):
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("repository_id"), F.col("n_name").alias("root"))
    return C.register(known, table(spark, d, "supplier").select(F.col("s_suppkey").alias("repository_id"), F.col("s_name").alias("root")), ["repository_id"])


#: Commits of all line items' parts: generations 0 to 3, hashes that jobs have or not.
COMMITS_SQL = f"""{CATALOG_SQL},
coms AS (SELECT l_orderkey % 5 AS worktree_id, 'f' || l_orderkey % 977 AS path, l_partkey AS artifact_id, l_suppkey % 4 AS generation, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'h' || l_partkey % 3 END AS desired_hash FROM lineitem)"""


def _committed(spark, d):
    """Artifacts of nine tenths of the parts are known; all parts with even keys come, two thirds of them with symbols."""
    trees, gens, view, jobs = _catalog(spark, d)
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    key, text = F.col("p_partkey"), lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    old, new = (key % 5 != 0) | (key % 2 != 0), key % 2 == 0
    chunks = lambda prefix, n: p.select(key.alias("artifact_id"), F.explode(F.sequence(F.lit(0), F.col("p_size") % n)).alias("ordinal")).withColumn("chunk_id", text(prefix, "ordinal"))
    mine = lambda x, w: x.where(F.expr(w))
    names = lambda prefix, c: li.select(F.col("l_partkey").alias("artifact_id"), text(prefix, c).alias("name")).distinct()
    calls = lambda prefix, a, b: li.select(F.col("l_partkey").alias("artifact_id"), text(prefix, a).alias("caller"), text(prefix, b).alias("callee")).distinct()
    store = C.Store(
        p.where(old).select(key.alias("artifact_id"), F.col("p_brand").alias("source_hash"), F.col("p_size").alias("symbols_version")),
        mine(chunks("o", 3), "(artifact_id % 5 <> 0 OR artifact_id % 2 <> 0)"), mine(names("s", "l_linenumber"), "(artifact_id % 5 <> 0 OR artifact_id % 2 <> 0)"), mine(calls("s", "l_linenumber", "l_suppkey"), "(artifact_id % 5 <> 0 OR artifact_id % 2 <> 0)"),
        view, jobs,
    )
    commits = li.withColumn("k", F.col("l_orderkey") % 977).select(
        (F.col("l_orderkey") % 5).alias("worktree_id"), text("f", "k").alias("path"), F.col("l_partkey").alias("artifact_id"), (F.col("l_suppkey") % 4).alias("generation"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("l_partkey") % 3).cast("string"))).alias("desired_hash"),
    )
    even = lambda x: mine(x, "artifact_id % 2 = 0")
    extracted = p.where(new & (key % 3 != 0)).select(key.alias("artifact_id"))
    return C.commit_artifacts(
        store, p.where(new).select(key.alias("artifact_id"), F.col("p_type").alias("source_hash")), even(chunks("n", 5)), even(names("n", "l_suppkey")), even(calls("n", "l_suppkey", "l_linenumber")),
        extracted, commits, C.active_of(trees, gens), 99,
    )


EXTRACTED = "artifact_id % 2 = 0 AND artifact_id % 3 <> 0"


@R.add("commit_artifacts", """SELECT p_partkey AS artifact_id, CASE WHEN (p_partkey % 5 <> 0 OR p_partkey % 2 <> 0) THEN p_brand ELSE p_type END AS source_hash,
 CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 99 WHEN (p_partkey % 5 <> 0 OR p_partkey % 2 <> 0) THEN p_size ELSE 0 END AS symbols_version FROM part WHERE (p_partkey % 5 <> 0 OR p_partkey % 2 <> 0) OR p_partkey % 2 = 0""")
def commit_artifacts(spark, d):
    return _committed(spark, d).artifacts


@R.add("committed_chunks", """WITH o AS (SELECT p_partkey AS artifact_id, unnest(range(p_size % 3 + 1))::INT AS ordinal FROM part WHERE (p_partkey % 5 <> 0 OR p_partkey % 2 <> 0)),
n AS (SELECT p_partkey AS artifact_id, unnest(range(p_size % 5 + 1))::INT AS ordinal FROM part WHERE p_partkey % 2 = 0)
SELECT *, 'o' || ordinal AS chunk_id FROM o UNION ALL SELECT *, 'n' || ordinal FROM n ANTI JOIN o USING (artifact_id, ordinal)""")
def committed_chunks(spark, d):
    return _committed(spark, d).artifact_chunks


@R.add("committed_symbols", f"""WITH s AS (SELECT DISTINCT l_partkey AS artifact_id, 's' || l_linenumber AS name FROM lineitem WHERE (l_partkey % 5 <> 0 OR l_partkey % 2 <> 0)), n AS (SELECT DISTINCT l_partkey AS artifact_id, 'n' || l_suppkey AS name FROM lineitem)
SELECT * FROM s WHERE NOT ({EXTRACTED}) UNION ALL SELECT * FROM n WHERE {EXTRACTED}""")
def committed_symbols(spark, d):
    return _committed(spark, d).symbols


@R.add("committed_symbol_edges", f"""WITH s AS (SELECT DISTINCT l_partkey AS artifact_id, 's' || l_linenumber AS caller, 's' || l_suppkey AS callee FROM lineitem WHERE (l_partkey % 5 <> 0 OR l_partkey % 2 <> 0)),
n AS (SELECT DISTINCT l_partkey AS artifact_id, 'n' || l_suppkey AS caller, 'n' || l_linenumber AS callee FROM lineitem)
SELECT * FROM s WHERE NOT ({EXTRACTED}) UNION ALL SELECT * FROM n WHERE {EXTRACTED}""")
def committed_symbol_edges(spark, d):
    return _committed(spark, d).symbol_edges


@R.add("committed_view", f"""WITH {COMMITS_SQL},
ok AS (SELECT worktree_id, path, max([generation, artifact_id]) AS v FROM coms LEFT JOIN act USING (worktree_id) WHERE active IS NULL OR active = generation GROUP BY 1, 2)
SELECT worktree_id, path, CASE WHEN v IS NULL OR v[1] < generation THEN view0.artifact_id ELSE v[2] END AS artifact_id, CASE WHEN v IS NULL OR v[1] < generation THEN generation ELSE v[1] END AS generation
FROM view0 FULL JOIN ok USING (worktree_id, path)""")
def committed_view(spark, d):
    return _committed(spark, d).view


@R.add("committed_jobs", f"""WITH {COMMITS_SQL} SELECT * FROM jobs0 j WHERE NOT EXISTS
 (SELECT 1 FROM coms c WHERE c.worktree_id = j.worktree_id AND c.path = j.path AND c.desired_hash = j.desired_hash AND j.generation <= c.generation)""")
def committed_jobs(spark, d):
    return _committed(spark, d).jobs


@R.add("prune_import", f"SELECT {DOC_PATH} AS path, sha256(text) AS source_hash, doc_id AS artifact_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 6 <> 0")
def prune_import(spark, d):
    """Artifacts of all documents, of which every fourth has changed since and every sixth is gone."""
    x = table(spark, d, "documents").select(doc_path().alias("path"), F.sha2("text", 256).alias("source_hash"), F.col("doc_id").alias("artifact_id"), "doc_id")
    now = x.where("doc_id % 6 <> 0").select("path", F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("source_hash")).alias("hash"))
    return C.prune_import(x.drop("doc_id"), now).select("path", "source_hash", "artifact_id")


@R.add("verify_import", """WITH p AS (SELECT l_orderkey AS path, 'c' || l_partkey AS chunk_id FROM lineitem), c AS (SELECT 'c' || p_partkey AS chunk_id FROM part WHERE p_partkey % 10 <> 0)
SELECT count(*) AS placements, count(*) FILTER (c.chunk_id IS NULL) AS dangling, count(DISTINCT c.chunk_id) AS unique_chunks, count(DISTINCT path) AS files, true AS agrees FROM p LEFT JOIN c USING (chunk_id)""")
def verify_import(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("chunk_id"))
    documents = li.groupBy("path").agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"))
    chunks = table(spark, d, "part").where("p_partkey % 10 <> 0").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"))
    links = li.join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")
    return C.verify_import(documents, chunks, documents.select(F.col("path").alias("artifact_id")), links.select(F.col("path").alias("artifact_id"), "chunk_id")).select("placements", "dangling", "unique_chunks", "files", "agrees")


def _lines(rows: list[dict], number: int) -> list[int]:
    """Lines of each text; every eleventh document always fails, every seventh in the first two rounds, every thirteenth in all."""
    for r in rows:
        if r["doc_id"] % 11 == 0:
            raise Permanent("unreadable")
        if r["doc_id"] % 7 == 0 and number < 3 or r["doc_id"] % 13 == 0:
            raise TimeoutError("no answer")
    return [r["text"].count("\n") + 1 if r["text"] is not None else 0 for r in rows]


def _indexed_once(spark, d):
    """Of all documents every fourth is new, every fifth has changed, and every third old row has lost its document."""
    docs = table(spark, d, "documents").select(doc_path().alias("path"), F.coalesce(F.md5("text"), F.lit("")).alias("hash"), "doc_id", "text")
    old = docs.where("doc_id % 4 != 0").select("path", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.lit(-1).cast("long").alias("result"))
    gone = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("gone/"), "path").alias("path"), "hash", F.lit(-2).cast("long").alias("result"))
    return index_once(old.unionByName(gone), docs, _lines, "long", attempts=4)


ONCE = f"""d AS (SELECT {DOC_PATH} AS path, coalesce(md5(text), '') AS hash, doc_id, text, doc_id % 4 = 0 AS new, doc_id % 4 = 0 OR doc_id % 5 = 0 AS todo,
  CASE WHEN doc_id % 11 = 0 THEN 'Permanent: unreadable' WHEN doc_id % 13 = 0 THEN 'TimeoutError: no answer' END AS error FROM documents)"""


@R.add("index_once", f"""WITH {ONCE} SELECT path, CASE WHEN todo AND error IS NOT NULL THEN 'old' ELSE hash END AS hash,
 CASE WHEN NOT todo OR error IS NOT NULL THEN -1 ELSE coalesce(length(text) - length(replace(text, chr(10), '')) + 1, 0) END::BIGINT AS result FROM d WHERE NOT (new AND error IS NOT NULL)""")
def index_once_view(spark, d):
    return _indexed_once(spark, d)[0]


@R.add("dead_letters", f"WITH {ONCE} SELECT path, hash, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 4 END AS attempts, error FROM d WHERE todo AND error IS NOT NULL")
def dead_letters(spark, d):
    return _indexed_once(spark, d)[1]


@R.add("member_status", """SELECT 'documents' AS member, true AS ok, count(*) AS rows FROM documents UNION ALL SELECT 'pages', true, count(*) FROM pages
UNION ALL SELECT 'broken', false, 0 UNION ALL SELECT 'missing', false, 0""")
def member_status(spark, d):
    """Two members that can be read, one whose column isn't what it says, and one that isn't there."""
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    broken = lambda: docs.select(F.expr("cast(text AS date)").alias("id"))
    readers = {"documents": lambda: docs.select(F.col("doc_id").alias("id")), "pages": lambda: pages.select(F.col("page_id").alias("id")), "broken": broken, "missing": lambda: spark.read.parquet(f"{d}/no_such.parquet")}
    return C.members(spark, readers)[1].select("member", "ok", "rows")


@R.add("member_rows", "SELECT doc_id AS id, 'documents' AS member FROM documents UNION ALL SELECT page_id, 'pages' FROM pages")
def member_rows(spark, d):
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    readers = {"missing": lambda: spark.read.parquet(f"{d}/no_such.parquet"), "documents": lambda: docs.select(F.col("doc_id").alias("id")), "pages": lambda: pages.select(F.col("page_id").alias("id"))}
    return C.members(spark, readers)[0]


@R.add("migrated_snapshot", "SELECT vec_id AS chunk_id, (embedding[1:48])::DOUBLE[] AS vector, 'm' || label AS model FROM embeddings")
def migrated_snapshot(spark, d):
    """Embeddings saved as version 1; version 2 names its columns anew and has a model, version 3 has vectors of 48."""
    root = f"{shared_dir(spark)}/migrated-{uuid.uuid4().hex}"
    C.Snapshot(spark, root, 1).save({"chunks": table(spark, d, "embeddings")})
    second = lambda t: {"chunks": t["chunks"].select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"))}
    third = lambda t: {"chunks": C.vector_size("vector", 48)(t["chunks"])}
    return C.Snapshot(spark, root, 3, {1: second, 2: third}).load("chunks").withColumn("vector", F.col("vector").cast("array<double>"))


#: A map for two thirds of the brands: some lines have no source, others move by tens.
LINE_MAP = """b AS (SELECT DISTINCT p_brand AS path FROM part WHERE ascii(right(p_brand, 1)) % 3 <> 0), m AS (SELECT path, n::INT AS line, (n + 10 * (n // 12))::INT AS source FROM b, range(1, 61) AS g(n) WHERE n % 17 <> 0)"""


def _runs(spark, d):
    brands = table(spark, d, "part").where(F.ascii(F.right("p_brand", F.lit(1))) % 3 != 0).select(F.col("p_brand").alias("path")).distinct()
    x = brands.select("path", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("line")).where("line % 17 != 0")
    return L.runs(x.withColumn("source", F.col("line") + 10 * F.floor(F.col("line") / 12).cast("int")))


@R.add("line_runs", f"""WITH {LINE_MAP}, s AS (SELECT path, line, source - line AS shift, line - row_number() OVER (PARTITION BY path, source - line ORDER BY line) AS run FROM m)
SELECT path, min(line) AS start, max(line) AS stop, shift FROM s GROUP BY path, shift, run""")
def line_runs(spark, d):
    return _runs(spark, d)


@R.add("remapped_symbols", f"""WITH {LINE_MAP} SELECT p_partkey, p_brand AS path, CASE WHEN b.path IS NULL THEN p_size ELSE coalesce(x.source, 0) END AS line,
 CASE WHEN b.path IS NULL THEN p_size + 13 ELSE coalesce(y.source, 0) END AS end_line FROM part LEFT JOIN b ON b.path = p_brand LEFT JOIN m x ON x.path = p_brand AND x.line = p_size LEFT JOIN m y ON y.path = p_brand AND y.line = p_size + 13""")
def remapped_symbols(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_size").alias("line"), (F.col("p_size") + 13).alias("end_line"))
    return L.remap(p, _runs(spark, d), "line", "end_line")


@R.add("twice_remapped", f"""WITH {LINE_MAP} SELECT p_partkey, p_brand AS path, CASE WHEN b.path IS NULL THEN p_size ELSE coalesce(y.source, 0) END AS line
FROM part LEFT JOIN b ON b.path = p_brand LEFT JOIN m x ON x.path = p_brand AND x.line = p_size LEFT JOIN m y ON y.path = p_brand AND y.line = x.source""")
def twice_remapped(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_size").alias("line"))
    runs = _runs(spark, d)
    return L.remap(p, L.joined(runs, runs), "line")
