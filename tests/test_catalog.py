"""Commits, deletes and generations: small cases written out."""

import pytest

from quern.operators import catalog as C

VIEW = "worktree_id string, path string, artifact_id string, generation long"
JOBS = "worktree_id string, path string, generation long, desired_hash string"


def some(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def active(spark):
    """w1 and w2 belong to a repository whose generation 2 is active; w3's has none yet."""
    trees = some(spark, [("w1", "r1"), ("w2", "r1"), ("w3", "r2")], "worktree_id string, repository_id string")
    gens = some(spark, [("r1", 1, "retired"), ("r1", 2, "active"), ("r1", 3, "building"), ("r2", 1, "building")], "repository_id string, generation long, state string")
    return C.active_of(trees, gens)


def commit(spark, active, rows, jobs, extracted):
    names, calls = "artifact_id string, name string", "artifact_id string, caller string, callee string"
    store = C.Store(
        some(spark, [("a", "hash", 7)], "artifact_id string, source_hash string, symbols_version int"), some(spark, [("a", 0, "c0")], "artifact_id string, ordinal int, chunk_id string"),
        some(spark, [("a", "stale")], names), some(spark, [("a", "stale", "gone")], calls), some(spark, [("w1", "f", "old", 1), ("w1", "g", "old", 3)], VIEW), some(spark, jobs, JOBS),
    )
    new = some(spark, [("a", "other"), ("b", "new")], "artifact_id string, source_hash string")
    chunks = some(spark, [("a", 0, "x"), ("a", 1, "c1"), ("b", 0, "c2")], "artifact_id string, ordinal int, chunk_id string")
    done = some(spark, [(x,) for x in extracted], "artifact_id string")
    return C.commit_artifacts(store, new, chunks, some(spark, [("a", "fresh"), ("b", "fresh")], names), some(spark, [("a", "fresh", "new")], calls), done, some(spark, rows, VIEW + ", desired_hash string"), active, 9)


def test_known_artifact_gets_new_symbols(spark, active):
    """Its row and chunks stay, symbols and edges are replaced and the version rises; the older job of the same hash is done."""
    s = commit(spark, active, [("w1", "f", "a", 2, "h")], [("w1", "f", 1, "h"), ("w1", "e", 1, "h")], ["a"])
    assert got(s.artifacts) == [("a", "hash", 9), ("b", "new", 0)]
    assert got(s.artifact_chunks) == [("a", 0, "c0"), ("a", 1, "c1"), ("b", 0, "c2")]
    assert got(s.symbols) == [("a", "fresh")] and got(s.symbol_edges) == [("a", "fresh", "new")]
    assert got(s.view) == [("w1", "f", "a", 2), ("w1", "g", "old", 3)] and got(s.jobs) == [("w1", "e", 1, "h")]


def test_without_extraction_symbols_stay(spark, active):
    s = commit(spark, active, [("w1", "f", "a", 2, "h")], [], [])
    assert got(s.symbols) == [("a", "stale")] and got(s.artifacts) == [("a", "hash", 7), ("b", "new", 0)]


def test_newer_intents_survive(spark, active):
    """A job of a newer generation or another hash stays; a commit of another than the active generation leaves the view."""
    rows = [("w1", "f", "a", 1, "h"), ("w1", "g", "a", 2, "h"), ("w2", "f", "b", 3, "h"), ("w3", "f", "b", 1, "h")]
    s = commit(spark, active, rows, [("w1", "f", 2, "h"), ("w1", "g", 2, "other"), ("w2", "f", 3, "h")], ["a"])
    assert got(s.view) == [("w1", "f", "old", 1), ("w1", "g", "old", 3), ("w3", "f", "b", 1)]
    assert got(s.jobs) == [("w1", "f", 2, "h"), ("w1", "g", 2, "other")]


def test_deletes(spark, active):
    """A superseded delete, one of another generation, one of a newer row, and one that is carried out."""
    view = some(spark, [("w1", p, "a", g) for p, g in (("superseded", 1), ("building", 1), ("newer", 3), ("gone", 1), ("no job", 2))] + [("w3", "first", "a", 0)], VIEW)
    jobs = some(spark, [("w1", "superseded", 2, "h"), ("w1", "building", 3, ""), ("w1", "newer", 2, ""), ("w1", "gone", 1, ""), ("w3", "first", 1, "")], JOBS)
    deletes = some(spark, [("w1", "superseded", 2, ""), ("w1", "building", 3, ""), ("w1", "newer", 2, ""), ("w1", "gone", 2, ""), ("w1", "no job", 2, ""), ("w3", "first", 1, "")], JOBS)
    v, j = C.commit_deletes(view, jobs, deletes, active)
    assert [r[1] for r in got(v)] == ["building", "newer", "no job", "superseded"]
    assert got(j) == [("w1", "superseded", 2, "h")]


def test_rolling_to_a_missing_generation(spark):
    gens = some(spark, [("r1", 1, "active"), ("r2", 5, "active")], "repository_id string, generation long, state string")
    view = some(spark, [("w1", "f", "a", 1), ("w2", "f", "a", 1)], VIEW)
    with pytest.raises(ValueError, match="no generation 5"):
        C.roll_generation(gens, view, view, "w1", "r1", 5)
    g, v, j = C.roll_generation(gens.union(some(spark, [("r1", 2, "building")], gens.schema)), view, view, "w1", "r1", 2)
    assert got(g) == [("r1", 1, "retired"), ("r1", 2, "active"), ("r2", 5, "active")]
    assert [r[0] for r in got(v)] == [r[0] for r in got(j)] == ["w2"]
