"""Ranges by blocks against brute force, and joins that compare no pairs of a file."""

import random

from quern.functions import ranges as R
from quern.operators import trace as T


def _joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join " in line and "Join Cross" not in line]


def test_innermost_meets_one_row_a_block(spark):
    r = random.Random(1)
    functions = [(f"f{r.randrange(3)}", f"n{i}", a, a + r.choice([-3, 0, 1, 5, 64, 1000])) for i in range(300) for a in [r.randrange(-50, 900)]] + [(None, "none", 0, 9), ("f0", "half", None, 9)]
    sites = [(i, f"f{r.randrange(4)}", r.randrange(-60, 1200)) for i in range(400)] + [(400, None, 5), (401, "f0", None), (0, "f1", 20)]
    df = T.innermost(spark.createDataFrame(sites, "site_id int, file string, pos int"), spark.createDataFrame(functions, "file string, name string, start int, end int"))
    best = {}
    for site, file, pos in sites:
        held = [(a, n) for f, n, a, b in functions if f == file and None not in (f, a, b, pos) and a <= pos < b]
        best[site] = max([best.get(site), *held], key=lambda v: v or (-999, ""))
    assert {row["site_id"]: row["function"] for row in df.collect()} == {k: v and v[1] for k, v in best.items()}
    assert all("<=" not in j and "<" not in j for j in _joins(df))


def test_overlapping_pairs_once(spark):
    r = random.Random(2)
    make = lambda n: [(i, f"f{r.randrange(3)}", a, a + r.choice([-4, -1, 0, 1, 7, 300])) for i in range(n) for a in [r.randrange(-40, 500)]]
    a, b = [*make(150), (150, None, 0, 9)], [*make(170), (170, None, 0, 9), (171, "f0", None, 9)]
    df = R.overlapping(spark.createDataFrame(a, "i int, path string, s int, e int"), spark.createDataFrame(b, "j int, path string, s2 int, e2 int"), "path")
    want = sorted((i, j) for i, f, s, e in a for j, g, s2, e2 in b if f == g and None not in (f, s2) and s <= e2 and s2 <= e)
    assert sorted((x["i"], x["j"]) for x in df.collect()) == want
    assert all("_block" in j for j in _joins(df))


def test_equal_ranges_meet_in_pieces_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 50)
    a = spark.range(0, 700, 1, 3).selectExpr("id AS i", "'f' AS path", "3 AS s", "9 AS e")
    b = spark.range(0, 400, 1, 3).selectExpr("id AS j", "'f' AS path", "7 AS s2", "7 + cast(id % 2 AS int) AS e2")
    df = R.overlapping(a, b, "path")
    assert df.columns == ["path", "s", "e", "s2", "e2", "i", "j"]
    assert df.select("i", "j").distinct().count() == 280_000
    parts = [r["count"] for r in df.groupBy(R.F.spark_partition_id()).count().collect()]
    assert sum(parts) == 280_000 and len(parts) == 4 and max(parts) < 140_000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan[plan.index("Join ") :]
    monkeypatch.setattr(R, "ROWS", 50)
    assert R.overlapping(a, b, "path").rdd.getNumPartitions() == 14


def test_pieces_keep_all_rows_and_their_nulls(spark, monkeypatch):
    rows = [("f", 1, 2, i) for i in range(100)] + [("f", 1, 2, 7)] * 60 + [("f", 1, 2, None)] * 3 + [("f", 1, None, 5), (None, 1, 2, 6), ("g", 5, 1, 8)]
    df = spark.createDataFrame(rows, "path string, s int, e int, i int")
    for piece, salts in ((256, 1024), (16, 2), (16, 1024), (1, 1)):
        monkeypatch.setattr(R, "PIECE", piece)
        monkeypatch.setattr(R, "SALTS", salts)
        got = R.packed(df, "_a", "path", "s", "e").collect()
        assert max(len(r["_a"]) for r in got) <= piece
        assert sorted(((r["path"], r["s"], r["e"], x["i"]) for r in got for x in r["_a"]), key=repr) == sorted(rows, key=repr)


def test_overlapping_repeats_empty_tables_and_made_columns(spark):
    a = spark.createDataFrame([("f", 1, 4, 1), ("f", 1, 4, 1), ("f", 1, 4, None), ("g", 1, 4, 2)], "path string, s int, e int, i int")
    b = spark.createDataFrame([("f", 3, 9, "x"), ("f", 3, 9, "x"), ("f", 5, 9, "y")], "path string, s2 int, e2 int, j string")
    df = R.overlapping(a, b, "path", made={"common": R.F.least("e", "e2") - R.F.greatest("s", "s2") + 1})
    want = [(i, "x", 2) for i in (1, 1, 1, 1, None, None)]
    assert sorted(((r["i"], r["j"], r["common"]) for r in df.collect()), key=repr) == sorted(want, key=repr)
    assert R.overlapping(a.drop("i"), b.drop("j"), "path").count() == 6
    assert not R.overlapping(a.limit(0), b, "path").count() and not R.overlapping(a, b.limit(0), "path").count()
