"""Failing rows, damaged members and older snapshots."""

import pytest
from pyspark.sql import functions as F

from quern.operators import catalog as C
from quern.operators.rounds import Permanent, attempt, index_once, rounds


def work(rows, number):
    for r in rows:
        if r["path"] == "bad":
            raise Permanent("never")
        if r["path"].startswith("slow") and number < int(r["path"][4:]):
            raise OSError(f"round {number}")
    return [r["path"].upper() for r in rows]


def test_rounds(spark):
    names = ["a", "bad", "slow2", "slow3", "slow9", "z"]
    todo = spark.createDataFrame([(n, n) for n in names], "path string, hash string").coalesce(1)
    one = {r.path: (r.result, r.error, r.permanent) for r in attempt(todo, work, "string").collect()}
    assert one["a"] == ("A", None, None) and one["bad"] == (None, "Permanent: never", True) and one["slow2"] == (None, "OSError: round 1", False)
    done, dead = rounds(todo, work, "string", attempts=4)
    assert {r.path: r.result for r in done.collect()} == {n: n.upper() for n in ("a", "slow2", "slow3", "z")}
    assert {(r.path, r.attempts, r.error) for r in dead.collect()} == {("bad", 1, "Permanent: never"), ("slow9", 4, "OSError: round 4")}
    none, nobody = rounds(todo.where("false"), work, "string")
    assert none.count() == nobody.count() == 0


def test_index_once(spark):
    """Failing rows leave what the view had, gone ones go, a second run has only the failed ones to do."""
    desired = spark.createDataFrame([("bad", "2"), ("a", "1"), ("slow2", "2"), ("z", "1")], "path string, hash string")
    view = spark.createDataFrame([("bad", "1", "old"), ("a", "1", "same"), ("gone", "1", "x")], "path string, hash string, result string")
    now, dead = index_once(view, desired, work, "string")
    assert sorted(map(tuple, now.collect())) == [("a", "1", "same"), ("bad", "1", "old"), ("slow2", "2", "SLOW2"), ("z", "1", "Z")]
    again = index_once(now, desired, lambda rows, n: [r["path"] for r in rows], "string")[0]
    assert sorted(map(tuple, again.collect())) == [("a", "1", "same"), ("bad", "2", "bad"), ("slow2", "2", "SLOW2"), ("z", "1", "Z")]


def test_damaged_member(spark, tmp_path):
    for name in ("one", "two", "bad"):
        spark.range(5).withColumn("name", F.lit(name)).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    part = next((tmp_path / "bad").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-40] + b"x" * 40)
    rows, status = C.members(spark, {n: (lambda n=n: spark.read.schema("id long, name string").parquet(f"{tmp_path}/{n}")) for n in ("bad", "one", "two", "none")})
    got = {r.member: (r.ok, r.rows, bool(r.error)) for r in status.collect()}
    assert got == {"bad": (False, 0, True), "one": (True, 5, False), "two": (True, 5, False), "none": (False, 0, True)}
    assert rows.groupBy("member").count().count() == 2


def test_migrations(spark, tmp_path):
    """A version-1 snapshot loads as version 3, once written; a missing step is an error, and a newer snapshot too."""
    C.Snapshot(spark, str(tmp_path), 1).save({"t": spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, v array<float>"), "u": spark.range(2)})
    calls = []
    steps = {1: lambda t: calls.append(1) or {**t, "t": t["t"].withColumn("model", F.lit("m"))}, 2: lambda t: calls.append(2) or {**t, "t": C.vector_size("v", 2)(t["t"])}}
    with pytest.raises(ValueError, match="version 1, not 3"):
        C.Snapshot(spark, str(tmp_path), 3, {1: steps[1]}).load("t")
    new = C.Snapshot(spark, str(tmp_path), 3, steps)
    assert new.load("t").first().asDict() == {"id": 1, "v": [1.0, 2.0], "model": "m"} and new.load("u").count() == 2 and calls == [1, 2]
    assert C.vector_size("v", 4)(new.load("t")).first()["v"] == [1.0, 2.0, 0.0, 0.0]
    with pytest.raises(ValueError, match="version 3, not 2"):
        C.Snapshot(spark, str(tmp_path), 2, steps).load("t")
