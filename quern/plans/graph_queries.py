"""Property-graph queries on the driver's tables: parts are symbols, orders call parts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.ranges import overlapping
from quern.operators import graph as G
from quern.operators import summarize as S
from quern.plans.base import Registry
from quern.session import materialize, table

R = Registry()
_PREFIX = ["get", "handle", "Validate", "", "parse_", "HTTP"]
NAME = f"({_PREFIX}[(p_partkey % 6 + 1)::INT] || list_reduce(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || b))"
VERBS = "[" + ", ".join(f"'{v}'" for v in X.VERBS) + "]"
GENERIC = "(" + ", ".join(f"'{v}'" for v in X.GENERIC_VERBS) + ")"
NODES = f"""n0 AS (SELECT p_partkey, 'area' || (p_partkey % 5) || '/cat' || (p_partkey % 7) || '/f' || (p_partkey % 40) || '.go' AS path, {NAME} AS symbol_name, p_size AS line, p_size + 4 AS end_line FROM part),
n1 AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(symbol_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM n0),
n2 AS (SELECT *, coalesce(list_position(list_transform(w, lambda x: list_contains({VERBS}, x)), true), 0) AS p FROM n1),
node AS (SELECT p_partkey, 'sym:' || path || ':' || symbol_name AS id, 'symbol' AS kind, path, symbol_name, line, end_line,
 array_to_string(list_slice(CASE WHEN p > 0 THEN [w[p]] || list_slice(w, 1, p - 1) || list_slice(w, p + 1, len(w)) ELSE ['operate'] || w END, 1, 4), ' ') AS feature FROM n2),
fw AS (SELECT *, string_split(feature, ' ') AS words FROM node),
k AS (SELECT *, CASE WHEN len(words) >= 2 AND words[1] IN {GENERIC} THEN words[2] ELSE words[1] END AS cluster FROM fw)"""


def nodes(spark, d):
    p = table(spark, d, "part")
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000)))
    name = F.concat(F.element_at(F.lit(_PREFIX), (F.col("p_partkey") % 6 + 1).cast("int")), F.array_join(words, ""))
    path = F.concat(F.lit("area"), (F.col("p_partkey") % 5).cast("string"), F.lit("/cat"), (F.col("p_partkey") % 7).cast("string"), F.lit("/f"), (F.col("p_partkey") % 40).cast("string"), F.lit(".go"))
    x = p.select("p_partkey", path.alias("path"), name.alias("symbol_name"), F.lit("").alias("receiver"), F.col("p_size").alias("line"), (F.col("p_size") + 4).alias("end_line"))
    return G.symbol_nodes(x).withColumn("kind", F.lit("symbol")).drop("receiver")


def unique_nodes(spark, d):
    """Nodes of distinct ids: the smallest part of each."""
    return G.first_of(nodes(spark, d), ["id"], "p_partkey")


UNIQUE = f"{NODES}, un AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS rn FROM k) WHERE rn = 1)"


@R.add("atomic_features", f"WITH {NODES} SELECT p_partkey, symbol_name, feature, replace(feature, ' ', '-') AS kebab, cluster FROM k")
def atomic_features(spark, d):
    f = F.col("feature")
    return nodes(spark, d).select("p_partkey", "symbol_name", "feature", X.kebab(f).alias("kebab"), X.cluster_key(f).alias("cluster"))


@R.add("split_names", f"WITH {NODES} SELECT p_partkey, array_to_string(w, '|') AS words FROM n1")
def split_names(spark, d):
    return nodes(spark, d).select("p_partkey", F.lower(F.array_join(X.split_name(F.col("symbol_name")), "|")).alias("words"))


@R.add("normalize_words", "SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(url), '[-_/ .@]'), lambda w: w <> ''))), '|') AS words FROM pages")
def normalize_words(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(X.normalize_words(F.col("url"))), "|").alias("words"))


@R.add("top_features", f"WITH {NODES}, c AS (SELECT path, feature, count(*) AS n FROM node GROUP BY 1, 2) SELECT path, feature, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, feature)::INT AS rank FROM c) WHERE rank <= 5")
def top_features(spark, d):
    return G.file_features(nodes(spark, d))


CLUSTERS = "cl AS (SELECT path, cluster FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, cluster) AS r FROM (SELECT path, cluster, count(*) AS n FROM k GROUP BY 1, 2)) WHERE r = 1)"
FILES = f"{CLUSTERS}, fl AS (SELECT path, string_split(path, '/')[1] AS area, string_split(path, '/')[2] AS category, cluster AS subcategory FROM cl)"


@R.add("file_clusters", f"WITH {NODES}, {CLUSTERS} SELECT * FROM cl")
def file_clusters(spark, d):
    return G.file_clusters(nodes(spark, d))


@R.add("hierarchy", f"""WITH {NODES}, {FILES}, e AS (SELECT 'area:' || area AS src, 'cat:' || area || '/' || category AS dst FROM fl UNION SELECT 'cat:' || area || '/' || category, 'subcat:' || area || '/' || category || '/' || subcategory FROM fl
UNION SELECT 'subcat:' || area || '/' || category || '/' || subcategory, 'file:' || path FROM fl) SELECT src, dst, 'feature_parent' AS type, 1.0::DOUBLE AS weight FROM e""")
def hierarchy(spark, d):
    return G.hierarchy_edges(G.placed(nodes(spark, d)))


@R.add("labels_top3", f"""WITH {NODES}, {FILES}, x AS (SELECT k.cluster AS verb, area, category FROM k JOIN fl USING (path)), b AS (SELECT 'area:' || area AS id, area AS name, verb FROM x UNION ALL SELECT 'cat:' || area || '/' || category, category, verb FROM x),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, verb) AS r FROM (SELECT id, name, verb, count(*) AS n FROM b GROUP BY ALL)) SELECT id, name || ' [' || string_agg(verb, ', ' ORDER BY r) || ']' AS label FROM c WHERE r <= 3 GROUP BY id, name""")
def labels_top3(spark, d):
    n = nodes(spark, d)
    return G.labels(G.placed(n), n)


@R.add("contains_edges", f"WITH {NODES} SELECT DISTINCT 'file:' || path AS src, id AS dst, 'contains' AS type, 1.0::DOUBLE AS weight FROM node")
def contains_edges(spark, d):
    return G.contains_edges(nodes(spark, d))


SEMANTIC = """g AS (SELECT id, path, words, words[1] AS verb, row_number() OVER (PARTITION BY words[1] ORDER BY md5(id)) AS rn FROM un), h AS (SELECT * FROM g WHERE rn <= 100),
pr AS (SELECT a.id AS a, b.id AS b, len(list_intersect(list_distinct(a.words), list_distinct(b.words))) / len(list_distinct(a.words || b.words))::DOUBLE AS j FROM h a JOIN h b ON a.verb = b.verb AND a.id < b.id AND a.path <> b.path)"""


@R.add("semantic_edges", f"WITH {UNIQUE}, {SEMANTIC} SELECT a AS src, b AS dst, 'semantic_sim' AS type, round(j, 6) AS weight FROM pr WHERE j >= 0.5")
def semantic_edges(spark, d):
    return G.semantic_edges(unique_nodes(spark, d)).withColumn("weight", F.round("weight", 6))


def _calls(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.concat(F.lit("p"), F.lpad((F.col("l_partkey") % 300).cast("string"), 4, "0")).alias("dst"))


CALLS = "ca AS (SELECT l_orderkey AS src, 'p' || lpad((l_partkey % 300)::VARCHAR, 4, '0') AS dst FROM lineitem), hub AS (SELECT src FROM ca GROUP BY src HAVING count(*) BETWEEN 2 AND 50), ok AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS i FROM ca WHERE src IN (SELECT src FROM hub)), co AS (SELECT x.dst AS a, y.dst AS b, count(*) AS n FROM ok x JOIN ok y ON x.src = y.src AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 2)"


@R.add("co_caller", f"WITH {CALLS} SELECT * FROM co")
def co_caller(spark, d):
    return G.co_call_counts(_calls(spark, d))


@R.add("co_caller_edges", f"""WITH {CALLS} SELECT a AS src, b AS dst, 'semantic_sim' AS type, least(1.0, n / 5.0)::DOUBLE AS weight FROM co WHERE a <> b AND a[4:] <> b[4:] AND NOT (a < 'p0010' AND b < 'p0010')""")
def co_caller_edges(spark, d):
    calls = _calls(spark, d)
    n = calls.select(F.col("dst").alias("id")).distinct().withColumn("path", F.substring("id", 4, 9))
    small = n.where("id < 'p0010'").select("id")
    pairs = F.array_sort(F.collect_list("id")).alias("ids")  # ten ids
    existing = small.agg(pairs).select(F.posexplode("ids").alias("i", "src"), "ids").select("src", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("dst"))
    return G.co_call_edges(calls, n, existing)


#: Calls of the parts' symbols, each with its caller's node and its nearest definition.
INVOKES = """c AS (SELECT a.symbol_name AS caller, b.symbol_name AS callee, a.path AS file, (a.line + l_linenumber)::INT AS line FROM lineitem JOIN un a ON a.p_partkey = l_partkey JOIN un b ON b.p_partkey = l_partkey - 1 - l_linenumber),
x AS (SELECT *, row_number() OVER (PARTITION BY caller, callee, file, line ORDER BY s, src) AS n FROM (SELECT DISTINCT c.*, u.id AS src, u.line AS s FROM c JOIN un u ON u.symbol_name = caller AND u.path = file AND c.line BETWEEN u.line AND u.end_line)),
y AS (SELECT src, u.id AS dst, row_number() OVER (PARTITION BY src, callee, file, x.line ORDER BY CASE WHEN u.path = file THEN 0 WHEN regexp_replace(u.path, '/[^/]*$', '') = regexp_replace(file, '/[^/]*$', '') THEN 1 ELSE 2 END, u.path, u.id) AS n FROM x JOIN un u ON u.symbol_name = callee WHERE x.n = 1),
iv AS (SELECT DISTINCT src, dst FROM y WHERE n = 1 AND src <> dst)"""


@R.add("invokes_edges", f"WITH {UNIQUE}, {INVOKES} SELECT src, dst, 'invokes' AS type, 1.0::DOUBLE AS weight FROM iv")
def invokes_edges(spark, d):
    return G.invokes_edges(_node_calls(spark, d), unique_nodes(spark, d))


def _node_calls(spark, d):
    n = unique_nodes(spark, d)
    a = n.select(F.col("p_partkey").alias("l_partkey"), F.col("symbol_name").alias("caller"), F.col("path").alias("file"), F.col("line").alias("start"))
    b = n.select(F.col("p_partkey").alias("to"), F.col("symbol_name").alias("callee"))
    x = table(spark, d, "lineitem").select("l_partkey", "l_linenumber").withColumn("to", F.col("l_partkey") - 1 - F.col("l_linenumber"))
    return x.join(a, "l_partkey").join(b, "to").select("caller", "callee", "file", (F.col("start") + F.col("l_linenumber")).alias("line"))


@R.add("import_edges", f"""WITH {UNIQUE}, iv AS (SELECT DISTINCT a.path AS pa, b.path AS pb FROM un a JOIN un b ON b.p_partkey = a.p_partkey + 3)
SELECT 'file:' || pa AS src, 'file:' || pb AS dst, 'imports' AS type, 1.0::DOUBLE AS weight FROM iv WHERE pa <> pb""")
def import_edges(spark, d):
    n = unique_nodes(spark, d)
    iv = n.select(F.col("id").alias("src"), (F.col("p_partkey") + 3).alias("k")).join(n.select(F.col("id").alias("dst"), F.col("p_partkey").alias("k")), "k").drop("k")
    return G.import_edges(iv, n)


@R.add("chunk_links", f"""WITH {UNIQUE}, c AS (SELECT p_partkey AS chunk_id, path, p_partkey % 55 AS s, p_partkey % 55 + 6 AS e FROM un)
SELECT DISTINCT 'chunk:' || chunk_id AS src, id AS dst, 'maps_to_chunk' AS type, 1.0::DOUBLE AS weight FROM c JOIN un USING (path) WHERE s <= end_line AND line <= e""")
def chunk_links(spark, d):
    n = unique_nodes(spark, d)
    return G.chunk_links(n.select(F.col("p_partkey").alias("chunk_id"), "path", (F.col("p_partkey") % 55).alias("s"), (F.col("p_partkey") % 55 + 6).alias("e")), n)


JACCARD = "len(list_intersect(q, ws)) / len(list_distinct(q || ws))::DOUBLE"


@R.add("jaccard_search", f"""WITH {UNIQUE}, s AS (SELECT id, ['get', 'red', 'ring', 'small'] AS q, list_distinct(words || list_filter(regexp_split_to_array(lower(symbol_name), '[-_/ .@]'), lambda w: w <> '')) AS ws FROM un)
SELECT id, round({JACCARD}, 6) AS score FROM s WHERE {JACCARD} > 0 ORDER BY {JACCARD} DESC, id LIMIT 10""")
def jaccard_search(spark, d):
    return G.search_nodes(unique_nodes(spark, d), "get small red ring").select("id", F.round("score", 6).alias("score"))


@R.add("scoped_search", f"""WITH {UNIQUE}, s AS (SELECT id, ['parse', 'ring'] AS q, list_distinct(words || list_filter(regexp_split_to_array(lower(symbol_name), '[-_/ .@]'), lambda w: w <> '')) AS ws FROM un WHERE starts_with(path, 'area1') AND contains(path, '.go'))
SELECT id, round({JACCARD}, 6) AS score FROM s WHERE {JACCARD} > 0 ORDER BY {JACCARD} DESC, id LIMIT 10""")
def scoped_search(spark, d):
    return G.search_nodes(unique_nodes(spark, d), "parse ring", scopes=["area1"], pattern="*.go").select("id", F.round("score", 6).alias("score"))


@R.add("feature_paths", f"WITH {UNIQUE}, {FILES} SELECT id, area || '/' || category || '/' || subcategory AS feature_path FROM un JOIN fl USING (path)")
def feature_paths(spark, d):
    return G.feature_paths(unique_nodes(spark, d), G.placed(nodes(spark, d)))


_NEXT = "nx AS (SELECT 'n' || (l_partkey % 400) AS src, 'n' || (lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) % 400) AS dst, CASE l_returnflag WHEN 'A' THEN 'invokes' WHEN 'R' THEN 'imports' ELSE 'contains' END AS type FROM lineitem), ne AS (SELECT DISTINCT * FROM nx WHERE dst IS NOT NULL)"


def _next(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    n = lambda c: F.concat(F.lit("n"), (c % 400).cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "invokes").when(F.col("l_returnflag") == "R", "imports").otherwise("contains")
    return table(spark, d, "lineitem").select(n(F.col("l_partkey")).alias("src"), n(F.lead("l_partkey").over(w)).alias("dst"), kind.alias("type")).where("dst IS NOT NULL").distinct()


@R.add("explore", f"""WITH RECURSIVE {_NEXT}, e AS (SELECT * FROM ne WHERE type = 'imports'), r(id, d) AS (SELECT 'n7', 0 UNION SELECT CASE WHEN e.src = r.id THEN e.dst ELSE e.src END, d + 1 FROM r JOIN e ON e.src = r.id OR e.dst = r.id WHERE d < 2 AND (CASE WHEN e.src = r.id THEN e.dst ELSE e.src END)[2:]::INT % 3 <> 0)
SELECT id, min(d) AS depth FROM r GROUP BY id ORDER BY min(d), id LIMIT 100""")
def explore(spark, d):
    e = _next(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.when(F.substring("id", 2, 9).cast("int") % 3 == 0, "file").otherwise("symbol"))
    return G.explore(e, n, "n7", "both", 2, ["imports"], ["function"])[0]


@R.add("explore_forward", f"""WITH RECURSIVE {_NEXT}, r(id, d) AS (SELECT 'n7', 0 UNION SELECT e.dst, d + 1 FROM r JOIN ne e ON e.src = r.id WHERE d < 2), v AS (SELECT id, min(d) AS d FROM r GROUP BY id)
SELECT src, dst, type, d + 1 AS depth FROM ne JOIN v ON v.id = src WHERE d < 2""")
def explore_forward(spark, d):
    e = _next(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("kind", F.lit("symbol"))
    return G.explore(e, n, "n7", "forward", 2)[1]


@R.add("neighbors", f"WITH {_NEXT} SELECT DISTINCT dst AS id FROM ne WHERE src = 'n7' UNION SELECT src FROM ne WHERE dst = 'n7'")
def neighbors(spark, d):
    return G.neighbors(_next(spark, d), "n7")


@R.add("fetch_nodes", f"""WITH {UNIQUE}, {FILES}, e AS (SELECT a.id AS src, b.id AS dst FROM un a JOIN un b ON b.p_partkey = a.p_partkey + 3), w AS (SELECT id, path FROM un WHERE p_partkey IN (5, 6, 7))
SELECT w.id, area || '/' || category || '/' || subcategory AS feature_path, (SELECT count(*) FROM e WHERE src = w.id) AS n_out, (SELECT count(*) FROM e WHERE dst = w.id) AS n_in FROM w JOIN fl USING (path)""")
def fetch_nodes(spark, d):
    n = unique_nodes(spark, d)
    e = n.select(F.col("id").alias("src"), (F.col("p_partkey") + 3).alias("k")).join(n.select(F.col("id").alias("dst"), F.col("p_partkey").alias("k")), "k").drop("k")
    ids = [r[0] for r in n.where("p_partkey IN (5, 6, 7)").select("id").collect()]
    return G.fetch(n, e, G.placed(nodes(spark, d)), ids).select("id", "feature_path", "n_out", "n_in")


@R.add("remove_nodes", f"WITH {_NEXT} SELECT * FROM ne WHERE src[2:]::INT % 4 <> 0 AND dst[2:]::INT % 4 <> 0")
def remove_nodes(spark, d):
    e = _next(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.remove_nodes(n, e, n.where(F.substring("id", 2, 9).cast("int") % 4 == 0))[1]


@R.add("prune_orphans", f"""WITH {NODES}, {FILES}, k1 AS (SELECT * FROM fl WHERE area <> 'area1' AND NOT (area = 'area2' AND category = 'cat3'))
SELECT DISTINCT 'area:' || area AS id, 'area' AS kind FROM k1 UNION SELECT 'cat:' || area || '/' || category, 'category' FROM k1 UNION SELECT 'subcat:' || area || '/' || category || '/' || subcategory, 'subcategory' FROM k1 UNION SELECT 'file:' || path, 'file' FROM k1""")
def prune_orphans(spark, d):
    files = G.placed(nodes(spark, d))
    e = G.hierarchy_edges(files)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kind = F.when(F.startswith("id", F.lit("area:")), "area").when(F.startswith("id", F.lit("cat:")), "category").when(F.startswith("id", F.lit("subcat:")), "subcategory").otherwise("file")
    gone = files.where("area = 'area1' OR area = 'area2' AND category = 'cat3'").select(F.concat(F.lit("file:"), "path").alias("id"))
    return G.prune_orphans(ids.withColumn("kind", kind).join(gone, "id", "left_anti"), e)


@R.add("refresh_edges", f"""WITH {_NEXT}, o AS (SELECT * FROM ne), t AS (SELECT DISTINCT id FROM (SELECT src AS id FROM ne UNION ALL SELECT dst FROM ne) WHERE id[2:]::INT % 20 = 0)
SELECT * FROM o WHERE type = 'contains' OR NOT (src IN (SELECT id FROM t) OR dst IN (SELECT id FROM t)) UNION ALL SELECT src, dst, 'fresh' FROM ne WHERE type = 'invokes' AND (src IN (SELECT id FROM t) OR dst IN (SELECT id FROM t))""")
def refresh_edges(spark, d):
    e = _next(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("path", (F.substring("id", 2, 9).cast("int") % 20).cast("string"))
    changed = spark.createDataFrame([("0",)], "path string")
    return G.refresh_edges(e, e.where("type = 'invokes'").withColumn("type", F.lit("fresh")), n, changed, ["invokes", "imports"])


@R.add("drift", f"""WITH {NODES}, m AS (SELECT a.p_partkey AS id, list_distinct(a.words) AS o, list_distinct(CASE WHEN a.p_partkey % 11 = 0 THEN [] ELSE b.words END) AS n FROM fw a JOIN fw b ON b.p_partkey = a.p_partkey + 2),
x AS (SELECT id, CASE WHEN len(n) = 0 THEN 1.0 ELSE round(1 - len(list_intersect(o, n)) / len(list_distinct(o || n))::DOUBLE, 3) END AS drift FROM m) SELECT id, drift::DOUBLE AS drift, drift >= 0.35 AS rerouted FROM x""")
def drift(spark, d):
    n = nodes(spark, d)
    old = n.select(F.col("p_partkey").alias("id"), F.array("feature").alias("features"))
    new = n.select((F.col("p_partkey") - 2).alias("id"), "feature").select("id", F.when(F.col("id") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("feature")).alias("features"))
    return G.drifted(old, new)


@R.add("summaries", f"""WITH {NODES}, {FILES}, c AS (SELECT DISTINCT area, category, subcategory FROM fl), s AS (SELECT *, row_number() OVER (PARTITION BY area, category ORDER BY subcategory) AS r FROM c)
SELECT 'cat:' || area || '/' || category AS id, count(*) AS n_children, category || ': ' || string_agg(subcategory, ', ' ORDER BY r) FILTER (r <= 20) AS summary FROM s GROUP BY area, category""")
def summaries(spark, d):
    f = G.placed(nodes(spark, d)).select("area", "category", "subcategory").distinct()
    rows = f.select(F.concat(F.lit("cat:"), "area", F.lit("/"), "category").alias("id"), F.col("category").alias("name"), F.col("subcategory").alias("child_id"), F.col("subcategory").alias("child_feature"))
    return G.summaries(rows)


@R.add("range_overlap", """WITH c AS (SELECT p_partkey AS id, p_brand AS path, p_size AS s, p_size + 7 AS e FROM part), m AS (SELECT p_partkey AS sym, p_brand AS path, p_size * 2 AS s2, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size * 2 + 3 END AS e2 FROM part)
SELECT id, sym, greatest(0, least(e, CASE WHEN e2 <= 0 OR e2 < s2 THEN s2 ELSE e2 END) - greatest(s, s2) + 1)::BIGINT AS overlap FROM c JOIN m USING (path) WHERE s <= CASE WHEN e2 <= 0 OR e2 < s2 THEN s2 ELSE e2 END AND s2 <= e""")
def range_overlap(spark, d):
    p = table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("path"), F.col("p_size").alias("s"), (F.col("p_size") + 7).alias("e"))
    m = p.select(F.col("p_partkey").alias("sym"), F.col("p_brand").alias("path"), (F.col("p_size") * 2).alias("s2"), F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.col("p_size") * 2 + 3).alias("e2"))
    m = m.withColumn("e2", X.normalize_end(F.col("s2"), F.col("e2")))
    shared = X.overlap_length(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")).cast("long")
    return overlapping(c, m, "path", made={"overlap": shared}).select("id", "sym", "overlap")


def _built(spark, d):
    n = unique_nodes(spark, d)
    files = n.select("path").distinct().unionByName(spark.createDataFrame([("docs/handle_readme.md",)], "path string"))
    return G.build(files, n.select("path", "symbol_name", F.lit("").alias("receiver"), "line", "end_line"), _node_calls(spark, d))


@R.add("built_nodes", f"""WITH {UNIQUE}, {FILES}, c AS (SELECT path, feature, count(*) AS n FROM un GROUP BY 1, 2), top AS (SELECT path, string_agg(feature, '|' ORDER BY n DESC, feature) AS fs FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, feature) AS r FROM c) WHERE r <= 5 GROUP BY path),
ucl AS (SELECT path, cluster FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, cluster) AS r FROM (SELECT path, cluster, count(*) AS n FROM un GROUP BY 1, 2)) WHERE r = 1),
p AS (SELECT string_split(path, '/')[1] AS area, string_split(path, '/')[2] AS category, cluster AS subcategory FROM ucl UNION ALL SELECT 'docs', 'handle_readme', 'general')
SELECT id, 'symbol' AS kind, feature AS features FROM un UNION ALL SELECT 'file:' || path, 'file', fs FROM top UNION ALL SELECT 'file:docs/handle_readme.md', 'file', 'handle readme'
UNION ALL SELECT DISTINCT 'area:' || area, 'area', area FROM p UNION ALL SELECT DISTINCT 'cat:' || area || '/' || category, 'category', category FROM p
UNION ALL SELECT DISTINCT 'subcat:' || area || '/' || category || '/' || subcategory, 'subcategory', subcategory FROM p""")
def built_nodes(spark, d):
    """Nodes of the whole build, a file without symbols among them."""
    return _built(spark, d)[0].select("id", "kind", F.array_join("features", "|").alias("features"))


@R.add("built_edges", f"""WITH {UNIQUE}, {INVOKES}, {SEMANTIC},
im AS (SELECT DISTINCT a.path AS pa, b.path AS pb FROM iv JOIN un a ON a.id = src JOIN un b ON b.id = dst WHERE a.path <> b.path),
se AS (SELECT a, b, j FROM pr WHERE j >= 0.5),
fit AS (SELECT src FROM iv GROUP BY src HAVING count(*) BETWEEN 2 AND 50),
co AS (SELECT p.dst AS a, q.dst AS b, count(*) AS n FROM iv p JOIN iv q ON p.src = q.src AND p.dst < q.dst WHERE p.src IN (SELECT src FROM fit) GROUP BY 1, 2 HAVING count(*) >= 2),
far AS (SELECT co.* FROM co JOIN un p ON p.id = a JOIN un q ON q.id = b WHERE p.path <> q.path AND NOT EXISTS (SELECT 1 FROM se WHERE se.a = co.a AND se.b = co.b)),
uc AS (SELECT path, cluster FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, cluster) AS r FROM (SELECT path, cluster, count(*) AS n FROM un GROUP BY 1, 2)) WHERE r = 1),
pl AS (SELECT path, string_split(path, '/')[1] AS area, string_split(path, '/')[2] AS category, cluster AS subcategory FROM uc UNION ALL SELECT 'docs/handle_readme.md', 'docs', 'handle_readme', 'general'),
tr AS (SELECT 'area:' || area AS src, 'cat:' || area || '/' || category AS dst FROM pl UNION SELECT 'cat:' || area || '/' || category, 'subcat:' || area || '/' || category || '/' || subcategory FROM pl
 UNION SELECT 'subcat:' || area || '/' || category || '/' || subcategory, 'file:' || path FROM pl)
SELECT DISTINCT 'file:' || path AS src, id AS dst, 'contains' AS type, 1.0::DOUBLE AS weight FROM un UNION ALL SELECT src, dst, 'invokes', 1.0 FROM iv
UNION ALL SELECT 'file:' || pa, 'file:' || pb, 'imports', 1.0 FROM im UNION ALL SELECT a, b, 'semantic_sim', round(j, 6) FROM se
UNION ALL SELECT a, b, 'semantic_sim', round(least(1.0, n / 5.0), 6) FROM far UNION ALL SELECT src, dst, 'feature_parent', 1.0 FROM tr""")
def built_edges(spark, d):
    """All edges of the whole build."""
    return _built(spark, d)[1].withColumn("weight", F.round("weight", 6))


def _digest(features: list[str], contexts: list[str]) -> list[str | None]:
    """A stand-in for a model: a hash of the context, and no answer for six in sixteen."""
    found = [hashlib.sha256(c.encode()).hexdigest() for c in contexts]
    return [h if h[0] > "5" else None for h in found]


def _level_sql(name: str, source: str) -> str:
    """Answers for id, feature and children (child, own, summary), in the order of ids up to three failures in a row."""
    return f"""{name}_c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY child) AS r FROM ({source})),
{name}_x AS (SELECT id, sha256('Node: ' || id || ' (' || feature || ')' || chr(10) || 'Children:' || chr(10) || string_agg('- ' || own || coalesce(': ' || summary, '') || chr(10), '' ORDER BY r) FILTER (r <= 20)) AS h FROM {name}_c GROUP BY id, feature),
{name}_f AS (SELECT *, row_number() OVER w AS i, h[1] <= '5' AND lag(h[1]) OVER w <= '5' AND lag(h[1], 2) OVER w <= '5' AS stop FROM {name}_x WINDOW w AS (ORDER BY id)),
{name} AS (SELECT id, CASE WHEN h[1] > '5' AND i < coalesce((SELECT min(i) FROM {name}_f WHERE stop), 9e18) THEN h END AS summary FROM {name}_f)"""


_SUB_ID, _CAT_ID = "'subcat:' || area || '/' || category || '/' || subcategory", "'cat:' || area || '/' || category"


@R.add("summarized_hierarchy", f"""WITH {NODES}, {FILES},
{_level_sql("sub", f"SELECT {_SUB_ID} AS id, subcategory AS feature, 'file:' || path AS child, 'operate ' || replace(string_split(path, '/')[3], '.go', '') AS own, NULL AS summary FROM fl")},
{_level_sql("cat", f"SELECT DISTINCT {_CAT_ID} AS id, category AS feature, {_SUB_ID} AS child, subcategory AS own, summary FROM fl JOIN sub ON sub.id = {_SUB_ID}")},
{_level_sql("ar", f"SELECT DISTINCT 'area:' || area AS id, area AS feature, {_CAT_ID} AS child, category AS own, summary FROM fl JOIN cat ON cat.id = {_CAT_ID}")}
SELECT * FROM sub UNION ALL SELECT * FROM cat UNION ALL SELECT * FROM ar""")
def summarized_hierarchy(spark, d):
    s = materialize(nodes(spark, d).select("path", "feature"), "symbol-nodes")
    placed = materialize(G.placed(s), "placed")  # read at each level
    none = F.lit(None).cast("string")
    above = G.hierarchy_nodes(placed).select("id", "kind", F.col("name").alias("feature"), none.alias("label"), none.alias("summary"))
    files = G.file_nodes(placed, s).select("id", "kind", "feature", none.alias("label"), none.alias("summary"))
    x = S.summarize_levels(above.unionByName(files), G.hierarchy_edges(placed), _digest)
    return x.where("kind != 'file'").select("id", "summary")


_TREE = f"""{UNIQUE}, {FILES.replace("FROM k ", "FROM un ")}, te AS (SELECT 'file:' || path AS src, id AS dst, 'contains' AS type FROM un
UNION SELECT 'area:' || area, {_CAT_ID}, 'feature_parent' FROM fl UNION SELECT {_CAT_ID}, {_SUB_ID}, 'feature_parent' FROM fl UNION SELECT {_SUB_ID}, 'file:' || path, 'feature_parent' FROM fl)"""


def _tree(spark, d):
    """Nodes (id, kind, path, feature), edges and placed files of the parts' tree."""
    s = materialize(unique_nodes(spark, d).select("id", "kind", "path", "feature"), "symbol-nodes")  # read by each part of the tree
    placed = materialize(G.placed(s), "placed")
    above = G.hierarchy_nodes(placed).select("id", "kind", F.lit(None).cast("string").alias("path"), F.col("name").alias("feature"))
    n = s.select("id", "kind", "path", "feature").unionByName(above).unionByName(G.file_nodes(placed, s).select("id", "kind", "path", "feature"))
    return n, G.contains_edges(s).unionByName(G.hierarchy_edges(placed)), placed


def _lists(df, *names):
    return df.withColumns({c: F.array_join(c, "|") for c in names})


def _edges_text(c):
    return F.array_join(F.transform(c, lambda e: F.concat(e["type"], F.lit(" "), e["n"].cast("string"), F.lit(" "), F.array_join(e["ids"], "|"))), ";")


@R.add("node_records", f"""WITH RECURSIVE {_TREE}, ids AS (SELECT DISTINCT dst AS id FROM te UNION SELECT src FROM te),
up(id, node, hops) AS (SELECT id, id, 0 FROM ids UNION ALL SELECT up.id, te.src, hops + 1 FROM up JOIN te ON te.dst = up.node),
ch AS (SELECT id, coalesce(string_agg(node, '|' ORDER BY hops) FILTER (hops > 0), '') AS chain FROM up GROUP BY id),
kid AS (SELECT src AS id, dst, type, row_number() OVER (PARTITION BY src ORDER BY dst) AS r, count(*) OVER (PARTITION BY src) AS n FROM te),
kids AS (SELECT id, string_agg(dst, '|' ORDER BY r) FILTER (r <= 4) AS children, any_value(type) || ' ' || any_value(n) || ' ' || string_agg(dst, '|' ORDER BY r) FILTER (r <= 4) AS outgoing FROM kid GROUP BY id),
par AS (SELECT dst AS id, type || ' 1 ' || src AS incoming FROM te)
SELECT id, chain, coalesce(children, '') AS children, incoming, outgoing FROM ch LEFT JOIN kids USING (id) LEFT JOIN par USING (id)""")
def node_records(spark, d):
    n, e, files = _tree(spark, d)
    x = G.node_records(n, e, files, n.select("id"), limit=4)
    return _lists(x, "chain", "children").select("id", "chain", "children", _edges_text(F.col("incoming")).alias("incoming"), _edges_text(F.col("outgoing")).alias("outgoing"))


@R.add("feature_path_of_nodes", f"""WITH {_TREE} SELECT id, area || '/' || category || '/' || subcategory AS feature_path FROM un JOIN fl USING (path) UNION ALL SELECT 'file:' || path, area || '/' || category || '/' || subcategory FROM fl
UNION SELECT {_SUB_ID}, area || '/' || category || '/' || subcategory FROM fl UNION SELECT {_CAT_ID}, area || '/' || category FROM fl UNION SELECT 'area:' || area, area FROM fl""")
def feature_path_of_nodes(spark, d):
    n, e, files = _tree(spark, d)
    return G.node_records(n, e, files, n.select("id")).select("id", "feature_path")


def _auto(spark, d, query):
    n, _, _ = _tree(spark, d)
    n = n.withColumn("symbol_name", F.when(F.col("kind") == "symbol", F.substring_index("id", ":", -1)).otherwise(""))
    hits = n.where("kind = 'file'").select("path", (F.expr("substr(path, 5, 1)").cast("int") / 8).alias("score"))
    return G.search_auto(n, hits, query, 7).select("id", "score")


@R.add("search_auto_text", f"WITH {_TREE} SELECT id, path[5]::INT / 8 AS score FROM un JOIN fl USING (path) ORDER BY score DESC, id LIMIT 7")
def search_auto_text(spark, d):
    """No feature has the word, so the files' chunks decide."""
    return _auto(spark, d, "zebra")


@R.add("search_auto_features", f"""WITH {UNIQUE}, s AS (SELECT id, ['get', 'ring'] AS q, list_distinct(words || list_filter(regexp_split_to_array(lower(symbol_name), '[-_/ .@]'), lambda w: w <> '')) AS ws FROM un)
SELECT id, len(list_intersect(q, ws)) / len(list_distinct(q || ws))::DOUBLE AS score FROM s WHERE len(list_intersect(q, ws)) > 0 ORDER BY score DESC, id LIMIT 7""")
def search_auto_features(spark, d):
    return _auto(spark, d, "get ring")
