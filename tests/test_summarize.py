"""Summaries level by level: resuming, giving up, and what a context holds."""

import pytest

from quern.operators import summarize as S

NODES = "id string, kind string, feature string, label string, summary string"


def graph(spark):
    subs = [f"subcat:a/c/s{i}" for i in range(8)]
    nodes = [("area:a", "area", "a", "a [x]", None), ("cat:a/c", "category", "c", None, ""), *((s, "subcategory", s[-2:], None, "had one" if s.endswith("s0") else None) for s in subs)]
    nodes += [(f"file:{i}", "file", f"file {i}", None, None) for i in range(30)]
    edges = [("area:a", "cat:a/c"), *(("cat:a/c", s) for s in subs), *((subs[1], f"file:{i}") for i in range(30))]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame([(a, b, "feature_parent", 1.0) for a, b in edges], "src string, dst string, type string, weight double")


def summarizer(log, bad=()):
    def f(features, contexts):
        with open(log, "a") as out:
            out.writelines(f"{x}\n" for x in features)
        return [None if x in bad else f"<{x}, {c.count(chr(10))} lines>" for x, c in zip(features, contexts, strict=True)]

    return f


def asked(log):
    return log.read_text().split() if log.exists() else []


def run(spark, tmp_path, log, bad=(), **more):
    nodes, edges = graph(spark)
    out = S.summarize_levels(nodes, edges, summarizer(str(log), bad), **more)
    return {r.id.split("/")[-1]: r.summary for r in out.where("kind != 'file'").collect()}


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(S, "BATCH", 1)


def test_resume(spark, tmp_path):
    """Three failures in a row end a level; the next run asks for what is missing and nothing else."""
    folder, one, two = str(tmp_path / "out"), tmp_path / "one", tmp_path / "two"
    got = run(spark, tmp_path, one, {"s2", "s4", "s5", "s6"}, folder=folder)
    assert got["s0"] == "had one" and got["s1"] == "<s1, 22 lines>" and got["s3"] == "<s3, 2 lines>"
    assert {k for k, v in got.items() if not v} == {"s2", "s4", "s5", "s6", "s7"} and "s7" not in asked(one)
    again = run(spark, tmp_path, two, folder=folder)
    assert sorted(asked(two)) == ["s2", "s4", "s5", "s6", "s7"] and all(again.values()) and again["s1"] == got["s1"]


def test_failures_across_tasks(spark, tmp_path, monkeypatch):
    """A row of failures that lies in several ranges of ids ends the level too."""
    monkeypatch.setattr(S, "TASK_ROWS", 1)
    got = run(spark, tmp_path, tmp_path / "log", {"s3", "s4", "s5"})
    assert got["s2"] and not any(got[s] for s in ("s3", "s4", "s5", "s6", "s7")) and got["c"]


def test_levels_read_what_is_below(spark):
    nodes, edges = graph(spark)
    full = S.summarize_levels(nodes, edges, lambda f, c: [f"({x})" for x in c], force=True)
    got = {r.id: r.summary for r in full.collect()}
    assert got["cat:a/c"].startswith("(Node: cat:a/c (c)\nChildren:\n- s0: (Node: subcat:a/c/s0 (s0)\nChildren:\n)\n- s1: (Node")
    assert got["area:a"].startswith("(Node: area:a (a)\nLabel: a [x]\nChildren:\n- c: (Node: cat:a/c") and got["file:0"] is None
