"""Reads by key touch the key's bucket only."""

from pyspark.sql import functions as F

from quern.sources import keyed


def files_read(df):
    df = df.select("*", F.input_file_name().alias("_f"))
    return {r["_f"] for r in df.collect()}


def test_one_key_reads_one_bucket(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), F.when(F.col("id") % 7 == 0, None).otherwise("a").alias("other"))
    keyed.write_keyed(rows, str(tmp_path / "t"), ["k"], rows=1000)
    t = keyed.Keyed(spark, str(tmp_path / "t"))
    assert t.buckets == 20 and t.keys == ["k"]
    got = t.get(k=4321)
    assert sorted(r.v for r in got.collect()) == ["v14321", "v19321", "v4321", "v9321"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(k,4321)" in plan
    scan = [x for x in plan.split("\n") if "FileScan" in x]
    assert len(scan) == 1 and len(files_read(got)) == 1
    assert t.get(k=10**9).collect() == [] and t.get(k=None).collect() == []
    many = t.get_all(spark.createDataFrame([(1,), (2,), (1,), (99_999,)], "k long"))
    assert sorted(r.v for r in many.collect()) == sorted(f"v{k + 5000 * i}" for k in (1, 2) for i in range(4))


def test_keys_of_several_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "n")], "p string, n int, v string")
    keyed.write_keyed(rows, str(tmp_path / "t"), ["p", "n"], rows=1)
    t = keyed.Keyed(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in t.get(p="a", n=2).collect()] == [("a", 2, "y")] and t.rows.count() == 4
    empty = rows.where("false")
    keyed.write_keyed(empty, str(tmp_path / "e"), ["p", "n"])
