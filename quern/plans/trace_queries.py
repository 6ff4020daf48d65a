"""Call-graph queries on the driver's tables: parts are symbols, line items references."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import catalog as C
from quern.operators import trace as T
from quern.plans.base import Registry
from quern.session import table

R = Registry()

SYMBOLS = """sym AS (SELECT 'f' || (p_partkey % 1500) AS name, p_brand AS kind, 'd' || (p_partkey % 13) || '/file' || (p_partkey % 100) AS file, p_size AS line, p_size + 5 AS end_line FROM part)"""
REFS = """ref AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, 'f' || (l_partkey % 1500) AS symbol_name, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN CASE l_linestatus WHEN 'F' THEN 'read' ELSE 'write' END ELSE '' END AS kind,
 'd' || (l_suppkey % 13) || '/file' || l_suppkey AS file, l_linenumber AS line, 'f' || (l_orderkey % 1500) AS caller_name, 'd' || (l_orderkey % 13) || '/file' || (l_orderkey % 100) AS caller_file, (l_orderkey % 50)::INT AS caller_line FROM lineitem)"""
EDGES = "edge AS (SELECT caller_name AS caller, symbol_name AS callee, file, line FROM ref WHERE kind IN ('', 'call'))"
BOTH = f"{SYMBOLS}, {REFS}, {EDGES}"


def _name(c: str):
    return F.concat(F.lit("f"), (F.col(c) % 1500).cast("string"))


def _file(c: str, by: int | None = None):
    n = F.col(c) % by if by else F.col(c)
    return F.concat(F.lit("d"), (F.col(c) % 13).cast("string"), F.lit("/file"), n.cast("string"))


def symbols(spark, d):
    return table(spark, d, "part").select(_name("p_partkey").alias("name"), F.col("p_brand").alias("kind"), _file("p_partkey", 100).alias("file"), F.col("p_size").alias("line"), (F.col("p_size") + 5).alias("end_line"))


def refs(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "F", "read").otherwise("write")).otherwise("")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), _name("l_partkey").alias("symbol_name"), kind.alias("kind"), _file("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"),
        _name("l_orderkey").alias("caller_name"), _file("l_orderkey", 100).alias("caller_file"), (F.col("l_orderkey") % 50).cast("int").alias("caller_line"),
    )


def edges(spark, d):
    return C.call_edges(refs(spark, d).where(T.kind_is("call"))).drop("call_type")


@R.add("definitions", f"WITH {BOTH} SELECT * FROM sym WHERE name IN (SELECT symbol_name FROM ref WHERE caller_name = 'f7')")
def definitions(spark, d):
    return T.definitions(symbols(spark, d), refs(spark, d).where("caller_name = 'f7'").select(F.col("symbol_name").alias("name")))


@R.add("callers", f"WITH {BOTH} SELECT * FROM ref WHERE symbol_name = 'f42' AND kind IN ('', 'call')")
def callers(spark, d):
    return T.callers(refs(spark, d), "f42")


@R.add("callees", f"""WITH {BOTH}, e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY callee) AS n FROM edge WHERE caller = 'f42') WHERE n = 1),
x AS (SELECT symbol_name AS callee, caller_name AS caller, file, line, caller_file, caller_line, row_number() OVER (PARTITION BY caller_name, symbol_name, file, line ORDER BY caller_file, caller_line) AS n FROM ref WHERE caller_name = 'f42')
SELECT e.caller, e.callee, e.file, e.line, x.caller_file, x.caller_line FROM e LEFT JOIN x ON x.n = 1 AND e.caller = x.caller AND e.callee = x.callee AND e.file = x.file AND e.line = x.line""")
def callees(spark, d):
    return T.callees(edges(spark, d), refs(spark, d), "f42")


@R.add("readers", f"WITH {BOTH} SELECT * FROM ref WHERE symbol_name = 'f42' AND kind = 'read'")
def readers(spark, d):
    return T.readers(refs(spark, d), "f42")


@R.add("writers", f"WITH {BOTH} SELECT * FROM ref WHERE symbol_name = 'f42' AND kind = 'write'")
def writers(spark, d):
    return T.writers(refs(spark, d), "f42")


@R.add("usage_graph", f"WITH {BOTH} SELECT *, kind AS access FROM ref WHERE symbol_name = 'f42' AND kind IN ('read', 'write')")
def usage_graph(spark, d):
    return T.usage_graph(refs(spark, d), "f42")


@R.add("call_edges", f"WITH {BOTH} SELECT *, 'direct' AS call_type FROM edge")
def call_edges(spark, d):
    return C.call_edges(refs(spark, d).where(T.kind_is("call")))


@R.add("first_definitions", f"WITH {BOTH} SELECT name, file, line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line) AS n FROM sym) WHERE n = 1")
def first_definitions(spark, d):
    return T.first_definitions(symbols(spark, d)).select("name", "file", "line")


@R.add("resolve_callers", f"""WITH {BOTH}, x AS (SELECT ref_id, s.file AS def_file, s.line AS def_line, row_number() OVER (PARTITION BY rid ORDER BY coalesce(s.file = caller_file, false) DESC, s.file NULLS FIRST, s.line) AS n
FROM (SELECT *, row_number() OVER () AS rid FROM ref) LEFT JOIN sym s ON s.name = caller_name) SELECT ref_id, def_file, def_line FROM x WHERE n = 1""")
def resolve_callers(spark, d):
    return T.resolve_callers(refs(spark, d), symbols(spark, d)).select("ref_id", "def_file", "def_line")


@R.add("resolve_definition", f"""WITH {BOTH}, x AS (SELECT ref_id, s.file AS def_file, s.line AS def_line, row_number() OVER (PARTITION BY rid ORDER BY
 CASE WHEN s.file = r.file THEN 0 WHEN regexp_replace(s.file, '/[^/]*$', '') = regexp_replace(r.file, '/[^/]*$', '') THEN 1 ELSE 2 END, s.file, s.line) AS n
FROM (SELECT *, row_number() OVER () AS rid FROM ref) r JOIN sym s ON s.name = symbol_name) SELECT ref_id, def_file, def_line FROM x WHERE n = 1""")
def resolve_definition(spark, d):
    return T.resolve_callees(refs(spark, d), symbols(spark, d)).select("ref_id", "def_file", "def_line")


@R.add("pick_targets", f"""WITH {BOTH}, r AS (SELECT symbol_name AS name, file, count(*) AS n_refs FROM ref GROUP BY 1, 2), x AS (SELECT s.name, s.file, s.line, coalesce(n_refs, 0) AS n_refs,
 row_number() OVER (PARTITION BY s.name ORDER BY coalesce(n_refs, 0) DESC, s.file, s.line) AS n FROM sym s LEFT JOIN r USING (name, file)) SELECT name, file, line, n_refs FROM x WHERE n = 1""")
def pick_targets(spark, d):
    return T.pick_targets(symbols(spark, d), refs(spark, d)).select("name", "file", "line", "n_refs")


@R.add("innermost_function", """WITH f AS (SELECT p_brand AS file, 'f' || p_partkey AS name, p_size * 10 AS start_, p_size * 10 + p_partkey % 60 AS end_ FROM part),
s AS (SELECT p_partkey AS site_id, p_brand AS file, (p_partkey * 7 % 600) AS pos FROM part)
SELECT site_id, arg_max(name, (start_, name)) AS function FROM s LEFT JOIN f ON s.file = f.file AND start_ <= pos AND pos < end_ GROUP BY site_id""")
def innermost_function(spark, d):
    p = table(spark, d, "part")
    f = p.select(F.col("p_brand").alias("file"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") * 10).alias("start"), (F.col("p_size") * 10 + F.col("p_partkey") % 60).alias("end"))
    s = p.select(F.col("p_partkey").alias("site_id"), F.col("p_brand").alias("file"), (F.col("p_partkey") * 7 % 600).alias("pos"))
    return T.innermost(s, f)


V1 = f"""WITH RECURSIVE {BOTH}, e AS (SELECT * FROM edge WHERE NOT (caller = callee AND EXISTS (SELECT 1 FROM sym WHERE sym.name = edge.caller AND sym.file = edge.file AND sym.line = edge.line))),
single AS (SELECT name FROM sym GROUP BY name HAVING count(*) = 1),
r(name, d) AS (SELECT 'f42', 0 UNION SELECT e.callee, d + 1 FROM r JOIN e ON e.caller = r.name JOIN single ON single.name = e.callee WHERE d < 2),
v AS (SELECT name, min(d) AS depth FROM r GROUP BY name),
o AS (SELECT e.* FROM e WHERE caller IN (SELECT name FROM v) UNION ALL SELECT * FROM e WHERE callee = 'f42'),
g AS (SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY file, line) AS n FROM o)"""


@R.add("call_graph_v1", f"{V1} SELECT caller, callee, file, line FROM g WHERE n = 1")
def call_graph_v1(spark, d):
    return T.call_graph(edges(spark, d), symbols(spark, d), "f42", 2)[1].select("caller", "callee", "file", "line")


@R.add("call_graph_v1_nodes", f"{V1} SELECT name, depth FROM v UNION ALL SELECT DISTINCT caller, 1 FROM o WHERE callee = 'f42' AND caller NOT IN (SELECT name FROM v)")
def call_graph_v1_nodes(spark, d):
    return T.call_graph(edges(spark, d), symbols(spark, d), "f42", 2)[0]


V2 = f"""WITH RECURSIVE {BOTH}, r(name, d) AS (SELECT 'f42', 0 UNION SELECT CASE WHEN e.caller = r.name THEN e.callee ELSE e.caller END, d + 1 FROM r JOIN edge e ON e.caller = r.name OR e.callee = r.name WHERE d < 2),
v AS (SELECT name, min(d) AS level FROM r GROUP BY name)"""


@R.add("call_graph_v2", f"""{V2}, o AS (SELECT e.caller, e.callee, e.file, e.line, min(v.level) + 1 AS level FROM edge e JOIN v ON e.caller = v.name OR e.callee = v.name WHERE v.level < 2 GROUP BY ALL)
SELECT caller, callee, file, line, level FROM o ORDER BY level, caller, callee, file, line LIMIT 2000""")
def call_graph_v2(spark, d):
    return T.call_graph_both(edges(spark, d), "f42", 2)[1]


@R.add("call_graph_v2_nodes", f"{V2} SELECT name, level FROM v ORDER BY v.level, name LIMIT 500")
def call_graph_v2_nodes(spark, d):
    return T.call_graph_both(edges(spark, d), "f42", 2)[0]


@R.add("merge_graphs", f"""WITH {BOTH}, u AS (SELECT *, 0 AS s FROM edge WHERE line % 2 = 0 UNION ALL SELECT *, 1 FROM edge WHERE line % 3 = 0)
SELECT caller, callee, file, line FROM (SELECT *, row_number() OVER (PARTITION BY caller, callee ORDER BY s, file, line) AS n FROM u) WHERE n = 1""")
def merge_graphs(spark, d):
    e = edges(spark, d)
    return T.merge_graphs([e.where("line % 2 = 0"), e.where("line % 3 = 0")]).select("caller", "callee", "file", "line")


@R.add("merge_refs", f"WITH {BOTH} SELECT ref_id, symbol_name FROM ref WHERE line % 2 = 0 UNION ALL SELECT ref_id, symbol_name FROM ref WHERE line % 3 = 0")
def merge_refs(spark, d):
    r = refs(spark, d).select("ref_id", "symbol_name", "line")
    return r.where("line % 2 = 0").unionAll(r.where("line % 3 = 0")).drop("line")


@R.add("dedup_refs", f"WITH {BOTH} SELECT DISTINCT symbol_name, kind, file, caller_name, line, caller_line FROM ref")
def dedup_refs(spark, d):
    return T.dedup_refs(refs(spark, d)).select("symbol_name", "kind", "file", "caller_name", "line", "caller_line")


@R.add("trace_symbol", f"""WITH {BOTH}, c AS (SELECT symbol_name AS name, file, count(*) AS n_refs FROM ref WHERE symbol_name = 'f42' GROUP BY 1, 2),
t AS (SELECT 'target' AS role, s.name, s.file, s.line, s.file AS def_file, s.line AS def_line, row_number() OVER (ORDER BY coalesce(n_refs, 0) DESC, s.file, s.line) AS n FROM sym s LEFT JOIN c USING (name, file) WHERE s.name = 'f42'),
u AS (SELECT 'caller' AS role, caller_name AS name, r.file, r.line, s.file AS def_file, s.line AS def_line, row_number() OVER (PARTITION BY rid ORDER BY coalesce(s.file = caller_file, false) DESC, s.file NULLS FIRST, s.line) AS n FROM (SELECT *, row_number() OVER () AS rid FROM ref) r LEFT JOIN sym s ON s.name = caller_name WHERE symbol_name = 'f42' AND r.kind IN ('', 'call')),
w AS (SELECT 'callee' AS role, symbol_name AS name, r.file, r.line, s.file AS def_file, s.line AS def_line, row_number() OVER (PARTITION BY rid ORDER BY s.file NULLS FIRST, s.line) AS n FROM (SELECT *, row_number() OVER () AS rid FROM ref) r LEFT JOIN sym s ON s.name = symbol_name WHERE caller_name = 'f42' AND r.kind IN ('', 'call'))
SELECT role, name, file, line, def_file, def_line FROM (SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT * FROM w) WHERE n = 1""")
def trace_symbol(spark, d):
    return T.trace(symbols(spark, d), refs(spark, d), "f42")
