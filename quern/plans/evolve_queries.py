"""Evolution of the parts' graph: old files, a batch of changes, and the graph that a full build of the new files would give."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evolve as V
from quern.plans.base import Registry
from quern.plans.graph_queries import CLUSTERS, UNIQUE, unique_nodes
from quern.session import materialize

R = Registry()


def _evolved(spark, d):
    """Of every eight files one is deleted, one modified (it loses every third symbol), one renamed and one new; a whole category goes."""
    s = materialize(unique_nodes(spark, d), "symbol-nodes")  # read by both sides and the changes
    s = s.withColumn("f", F.col("p_partkey") % 40 % 8).withColumn("gone", F.startswith("path", F.lit("area1/cat3/")))
    lean = lambda x: x.drop("f", "gone", "p_partkey")
    old = lean(s.where("f != 3 OR gone"))
    op = F.when(F.col("gone") | (F.col("f") == 0), "delete").when(F.col("f") == 1, "modify").when(F.col("f") == 2, "rename").when(F.col("f") == 3, "create")
    changes = s.select("path", op.alias("op"), F.when(op == "rename", F.concat(F.lit("moved"), F.expr("substr(path, 5)"))).alias("new_path")).where("op IS NOT NULL").distinct()
    fresh = lean(s.where("f = 3 OR f = 1 AND p_partkey % 3 <> 0"))
    return V.evolve(V.start(old.select("path").distinct(), old), changes, fresh, threshold=0.0)


#: The new files' symbols, and their files, which may have none.
_AFTER = f"""{UNIQUE},
now AS (SELECT *, CASE WHEN p_partkey % 40 % 8 = 2 THEN 'moved' || substr(path, 5) ELSE path END AS new_path FROM un WHERE p_partkey % 40 % 8 <> 0 AND NOT starts_with(path, 'area1/cat3/')),
sy AS (SELECT 'sym:' || new_path || ':' || symbol_name AS id, new_path AS path, cluster FROM now WHERE NOT (p_partkey % 40 % 8 = 1 AND p_partkey % 3 = 0)),
{CLUSTERS.replace("FROM k ", "FROM sy ")},
fl AS (SELECT DISTINCT new_path AS path, string_split(new_path, '/')[1] AS area, string_split(new_path, '/')[2] AS category, coalesce(cl.cluster, 'general') AS subcategory FROM now LEFT JOIN cl ON cl.path = new_path)"""
_CAT, _SUB = "area || '/' || category", "area || '/' || category || '/' || subcategory"


@R.add("evolved_edges", f"""WITH {_AFTER}, e AS (SELECT 'file:' || path AS src, id AS dst, 'contains' AS type FROM sy
UNION SELECT 'area:' || area, 'cat:' || {_CAT}, 'feature_parent' FROM fl
UNION SELECT 'cat:' || {_CAT}, 'subcat:' || {_SUB}, 'feature_parent' FROM fl
UNION SELECT 'subcat:' || {_SUB}, 'file:' || path, 'feature_parent' FROM fl) SELECT *, 1.0::DOUBLE AS weight FROM e""")
def evolved_edges(spark, d):
    return _evolved(spark, d).edges


@R.add("evolved_hierarchy", f"""WITH {_AFTER} SELECT 'subcategory' AS kind, 'subcat:' || {_SUB} AS id, count(*) AS n FROM fl GROUP BY ALL
UNION ALL SELECT 'category', 'cat:' || {_CAT}, count(DISTINCT subcategory) FROM fl GROUP BY ALL
UNION ALL SELECT 'area', 'area:' || area, count(DISTINCT category) FROM fl GROUP BY ALL""")
def evolved_hierarchy(spark, d):
    return _evolved(spark, d).counts.select("kind", "id", "n")


@R.add("evolved_files", f"WITH {_AFTER} SELECT * FROM fl")
def evolved_files(spark, d):
    return _evolved(spark, d).files.select("path", *V.PLACE)


@R.add("evolved_symbols", f"WITH {_AFTER} SELECT id, path FROM sy")
def evolved_symbols(spark, d):
    return _evolved(spark, d).symbols.select("id", "path")
