"""What is made once: a name's words in its feature and cluster key, counts before joins, nodes before their readers."""

from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import graph as G


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_split_once(spark):
    df = spark.createDataFrame([("getUserName",), (None,), ("",), ("runX",)], "name string").repartition(2)
    x = df.select("name", X.cluster_key(X.atomic_feature(F.col("name"))).alias("cluster"))
    assert {r["name"]: r["cluster"] for r in x.collect()} == {"getUserName": "user", None: None, "": "unknown", "runX": "x"}
    assert _plan(x).count("regexp_replace(") == 1


def test_labels_join_counts(spark):
    files = spark.createDataFrame([("a/b/f.go", "a", "b", "get")], "path string, area string, category string, subcategory string")
    nodes = spark.createDataFrame([("a/b/f.go", f) for f in ["parse x"] * 3 + ["get y"] * 2 + ["send z", "", "open q"]], "path string, feature string")
    x = G.labels(files, nodes)
    assert {tuple(r) for r in x.collect()} == {("area:a", "a [parse, y, open]"), ("cat:a/b", "b [parse, y, open]")}
    plan = _plan(x)
    assert "Aggregate" in plan[plan.index("Join Inner") :]
