"""Retrieval queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.config import BONUSES, PENALTIES, Search
from quern.functions.vectors import cosine, dot, norm
from quern.operators import search as S
from quern.plans.base import DOC_PATH, SCORED, Registry, chunks, doc_path, query_vector, rounded
from quern.session import table

R = Registry()
QUERY = "the and of onthe"
FACTOR = " * ".join(f"CASE WHEN contains(path, '{p}') THEN {f}::DOUBLE ELSE 1.0::DOUBLE END" for p, f in [*PENALTIES, *BONUSES])
WORDS = QUERY.split()
TEXT_SCORE = "((" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS) + f") / {len(WORDS)})::FLOAT"


@R.add("vector_topk", f"WITH {SCORED} SELECT id, path, score::DOUBLE AS score FROM scored ORDER BY scored.score DESC, id LIMIT 20")
def vector_topk(spark, d):
    return rounded(S.vector_search(chunks(spark, d), query_vector(spark, d), 20).select("id", "path", "score"), "score")


@R.add("vector_topk_prefix", f"WITH {SCORED} SELECT id, path, score::DOUBLE AS score FROM scored WHERE starts_with(path, 'label_3/') ORDER BY scored.score DESC, id LIMIT 20")
def vector_topk_prefix(spark, d):
    return rounded(S.vector_search(chunks(spark, d), query_vector(spark, d), 20, "label_3/").select("id", "path", "score"), "score")


@R.add("vector_scores_all", f"WITH {SCORED} SELECT id, score::DOUBLE AS score FROM scored")
def vector_scores_all(spark, d):
    """Search with limit 0: every chunk."""
    return rounded(S.scored(chunks(spark, d), query_vector(spark, d)).select("id", "score"), "score")


@R.add("vector_pairs_cosine", """SELECT a.vec_id AS id, coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0)::FLOAT::DOUBLE AS cosine,
 round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_pairs_cosine(spark, d):
    """Cosine of two vector columns: each vector and the next."""
    e = table(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("y"))
    x = a.join(b, "id").select("id", cosine(F.col("x"), F.col("y")).alias("cosine"), F.round(dot(F.col("x"), F.col("y")), 4).alias("dot"))
    return rounded(x, "cosine")


@R.add("vector_norms", "SELECT vec_id AS id, len(embedding)::BIGINT AS dims, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("dims"), F.round(norm(F.col("embedding")), 6).alias("norm"))


@R.add("best_per_group", f"WITH {SCORED} SELECT label, id, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS n FROM scored) WHERE n = 1")
def best_per_group(spark, d):
    return rounded(S.best_by(S.scored(chunks(spark, d), query_vector(spark, d)), "label").select("label", "id", "score"), "score")


@R.add("text_search", f"SELECT doc_id AS id, {DOC_PATH} AS path, round({TEXT_SCORE}::DOUBLE, 6) AS score FROM documents WHERE {TEXT_SCORE} > 0")
def text_search(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), doc_path().alias("path"), F.col("text").alias("content"))
    return rounded(S.text_search(docs, QUERY).select("id", "path", "score"), "score")


@R.add("text_topk_prefix", f"SELECT doc_id AS id, {DOC_PATH} AS path, round({TEXT_SCORE}::DOUBLE, 6) AS score FROM documents WHERE {TEXT_SCORE} > 0 AND starts_with({DOC_PATH}, 'src1/') ORDER BY {TEXT_SCORE} DESC, id LIMIT 25")
def text_topk_prefix(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), doc_path().alias("path"), F.col("text").alias("content"))
    return rounded(S.text_search(docs, QUERY, 25, "src1/").select("id", "path", "score"), "score")


def _hybrid(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return chunks(spark, d).join(docs, "id")


FUSED = f"""{SCORED}, both_ AS (SELECT s.*, d.text FROM scored s JOIN documents d ON d.doc_id = s.id),
v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT * FROM both_ ORDER BY score DESC, id LIMIT 80)),
t AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS r FROM (SELECT id, {TEXT_SCORE} AS s FROM both_ WHERE {TEXT_SCORE} > 0 ORDER BY s DESC, id LIMIT 80)),
f AS (SELECT id, sum(1.0::DOUBLE / (60 + r + 1)) AS score FROM (SELECT * FROM v UNION ALL SELECT * FROM t) GROUP BY id)"""


@R.add("hybrid_rrf", f"WITH {FUSED} SELECT id, round(score, 8) AS score FROM f ORDER BY f.score DESC, id LIMIT 20")
def hybrid_rrf(spark, d):
    x = _hybrid(spark, d)
    lists = [S.ranked(S.vector_search(x, query_vector(spark, d), 80), "vector"), S.ranked(S.text_search(x, QUERY, 80), "text")]
    return rounded(S.fuse(lists, 60, 20), "score", digits=8)


@R.add("hybrid_search", f"""WITH {FUSED}, h AS (SELECT f.id, s.path, f.score * {FACTOR.replace('path', 's.path')} AS score FROM (SELECT * FROM f ORDER BY score DESC, id LIMIT 80) f JOIN scored s USING (id)),
g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS n FROM h)
SELECT id, path, round(score, 8) AS score FROM g WHERE n = 1 ORDER BY g.score DESC, id LIMIT 20""")
def hybrid_search(spark, d):
    x = S.search(_hybrid(spark, d), query_vector(spark, d), 20, text=QUERY, config=Search(hybrid=True))
    return rounded(x.select("id", "path", "score"), "score", digits=8)


SEMANTIC = f"""WITH {SCORED}, h AS (SELECT id, path, score::DOUBLE * {FACTOR} AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 40)),
g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS n FROM h)
SELECT id, path, round(score, 6) AS score FROM g WHERE n = 1 ORDER BY g.score DESC, id LIMIT 10"""


@R.add("semantic_search", SEMANTIC)
def semantic_search(spark, d):
    """Flagship: vector top-k, boost, dedup by file, cut."""
    return rounded(S.search(chunks(spark, d), query_vector(spark, d), 10).select("id", "path", "score"), "score", digits=6)


@R.add("boosted_search", f"WITH {SCORED} SELECT id, path, round(score::DOUBLE * {FACTOR}, 6) AS score FROM scored")
def boosted_search(spark, d):
    return rounded(S.boosted(S.scored(chunks(spark, d), query_vector(spark, d))).select("id", "path", "score"), "score", digits=6)


@R.add("workspace_search", f"""WITH {SCORED}, h AS (SELECT id, path, score::DOUBLE * {FACTOR} AS score FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 60)),
g AS (SELECT * FROM h ORDER BY score DESC, id LIMIT 30)
SELECT id, path, round(score, 6) AS score FROM g WHERE starts_with('ws/' || path, 'ws/label_1/') OR starts_with('ws/' || path, 'ws/label_2/')""")
def workspace_search(spark, d):
    x = S.search(chunks(spark, d), query_vector(spark, d), 30, workspace=True)
    x = S.of_projects(x.withColumn("path", F.concat(F.lit("ws/"), "path")), "ws", ["label_1", "label_2"])
    return rounded(x.select("id", F.substring("path", 4, 10_000).alias("path"), "score"), "score", digits=6)


@R.add("cross_repo_search", f"""WITH {SCORED}, e AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS n FROM scored)
SELECT label, id, n::BIGINT AS rank, score::DOUBLE AS score FROM e WHERE n <= 15 ORDER BY e.score DESC, label, n LIMIT 15""")
def cross_repo_search(spark, d):
    x = S.search_all(S.scored(chunks(spark, d), query_vector(spark, d)), "label", 15)
    return rounded(x.select("label", "id", F.col("rank").cast("long").alias("rank"), "score"), "score")


@R.add("v2_view_search", f"""WITH {SCORED}, view_ AS (SELECT DISTINCT path, 'a' || (id // 12) AS artifact_id FROM scored WHERE label < 8),
ac AS (SELECT 'a' || (id // 12) AS artifact_id, id AS chunk_id FROM scored),
j AS (SELECT v.path, c.id AS chunk_id, c.score FROM view_ v JOIN ac USING (artifact_id) JOIN scored c ON c.id = ac.chunk_id),
g AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_id) AS n FROM j)
SELECT path, chunk_id, score::DOUBLE AS score FROM g WHERE n = 1 ORDER BY g.score DESC, path LIMIT 20""")
def v2_view_search(spark, d):
    c = chunks(spark, d)
    artifact = F.concat(F.lit("a"), F.floor(F.col("id") / 12).cast("string"))
    view = c.where("label < 8").select("path", artifact.alias("artifact_id")).distinct()
    x = S.view_search(view, c.select(artifact.alias("artifact_id"), F.col("id").alias("chunk_id")), c.select(F.col("id").alias("chunk_id"), "vector"), query_vector(spark, d), 20)
    return rounded(x.select("path", "chunk_id", "score"), "score")


@R.add("topk_overlap", """WITH s AS (SELECT a.label AS query, b.vec_id AS id, b.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c,
  list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS p FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) a JOIN embeddings b ON a.label = b.label),
x AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, id) AS rc, row_number() OVER (PARTITION BY query ORDER BY round(p, 9) DESC, id) AS rp FROM (SELECT query, id, max(c) AS c, max(p) AS p FROM s GROUP BY query, id))
SELECT query, round(sum((rc <= 10 AND rp <= 10)::INT) / sum((rc <= 10 OR rp <= 10)::INT)::DOUBLE, 6) AS overlap FROM x GROUP BY query""")
def topk_overlap(spark, d):
    """Agreement of two rankings (cosine and dot product) of each label's vectors by its first one."""
    from quern.functions.text import topk_overlap as overlap

    e = table(spark, d, "embeddings")
    queries = e.groupBy(F.col("label").alias("query")).agg(F.min_by("embedding", "vec_id").alias("q"))
    s = e.join(queries, F.col("label") == F.col("query"))
    s = s.select("query", F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "q")
    s = s.select("query", "id", (dot(F.col("v"), F.col("q")) / (norm(F.col("v")) * norm(F.col("q")))).alias("c"), dot(F.col("v"), F.col("q")).alias("p")).groupBy("query", "id").agg(F.max("c").alias("c"), F.max("p").alias("p"))
    for name in ("c", "p"):
        s = s.withColumn(f"r{name}", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round(name, 9)), "id")))
    lists = s.where("rc <= 10 OR rp <= 10").groupBy("query").agg(*(F.transform(F.array_sort(F.collect_list(F.when(F.col(f"r{n}") <= 10, F.struct(f"r{n}", "id")))), lambda z: z["id"]).alias(n) for n in ("c", "p")))
    return lists.select("query", F.round(overlap(F.col("c"), F.col("p"), 10), 6).alias("overlap"))


@R.add("chunk_symbol_enrichment", f"""WITH {SCORED}, h AS (SELECT id, path, (id % 50 + 1)::INT AS s1, (id % 50 + 8)::INT AS e1 FROM scored),
sym AS (SELECT DISTINCT path, 'S' || (id % 10) AS symbol, (id % 40)::INT + 1 AS s2, (id % 40)::INT + 12 AS e2, path || '#' || (id % 10) AS fp FROM scored WHERE id % 3 <> 0),
j AS (SELECT h.id, h.path, symbol, s2, fp, CASE WHEN symbol IS NULL THEN 0 ELSE greatest(0, least(e1, e2) - greatest(s1, s2) + 1) END AS o FROM h LEFT JOIN sym ON h.path = sym.path AND s1 <= e2 AND s2 <= e1),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC, s2 NULLS FIRST, symbol NULLS FIRST) AS n FROM j)
SELECT id, symbol, o::BIGINT AS overlap, coalesce(fp, 'file:' || path) AS feature_path FROM g WHERE n = 1""")
def chunk_symbol_enrichment(spark, d):
    c = chunks(spark, d)
    hits = c.select("id", "path", (F.col("id") % 50 + 1).cast("int").alias("start_line"), (F.col("id") % 50 + 8).cast("int").alias("end_line"))
    mod = (F.col("id") % 10).cast("string")
    line = (F.col("id") % 40).cast("int")
    symbols = c.where("id % 3 <> 0").select("path", F.concat(F.lit("S"), mod).alias("symbol"), (line + 1).alias("s"), (line + 12).alias("e"), F.concat("path", F.lit("#"), mod).alias("feature_path")).distinct()
    files = c.select("path", F.concat(F.lit("file:"), "path").alias("file_feature")).distinct()
    return S.enrich(hits, symbols, files).select("id", "symbol", F.col("overlap").cast("long").alias("overlap"), "feature_path")



