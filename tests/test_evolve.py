"""Evolution of a small graph, change by change."""

from quern.operators import evolve as V
from quern.operators import graph as G

SYMBOLS = "path string, symbol_name string, receiver string, line int, end_line int"


def nodes(spark, rows):
    return G.symbol_nodes(spark.createDataFrame([(p, n, "", i + 1, i + 3) for i, (p, n) in enumerate(rows)], SYMBOLS))


def run(spark, old, changes, fresh, threshold=0.35, more=()):
    s = nodes(spark, old)
    edges = spark.createDataFrame(list(more), "src string, dst string, type string, weight double") if more else None
    state = V.start(s.select("path").distinct(), s, edges)
    c = spark.createDataFrame(changes, "path string, op string, new_path string")
    return V.evolve(state, c, nodes(spark, fresh) if fresh else s.where("false"), threshold)


def place(state):
    return {r.path: f"{r.area}/{r.category}/{r.subcategory}" for r in state.files.collect()}


OLD = [("a/x/one.go", "ParseFile"), ("a/x/one.go", "ParseLine"), ("a/x/two.go", "ParseWord"), ("b/y/three.go", "SendMail"), ("b/y/three.go", "SendNote")]


def test_small_drift_stays_and_large_drift_moves(spark):
    fresh = [("a/x/one.go", "ParseFile"), ("a/x/one.go", "ParseLine"), ("a/x/one.go", "ParseToken"), ("a/x/two.go", "RenderPage"), ("a/x/two.go", "RenderView")]
    state = run(spark, OLD, [("a/x/one.go", "modify", None), ("a/x/two.go", "modify", None)], fresh)
    old, new = "a/x/parse", "a/x/render"
    assert place(state) == {"a/x/one.go": old, "a/x/two.go": new, "b/y/three.go": "b/y/send"}
    counts = {r.id: r.n for r in state.counts.collect()}
    assert counts == {"subcat:a/x/parse": 1, "subcat:a/x/render": 1, "subcat:b/y/send": 1, "cat:a/x": 2, "cat:b/y": 1, "area:a": 1, "area:b": 1}
    parents = {(r.src, r.dst) for r in state.edges.where("type = 'feature_parent'").collect()}
    assert ("subcat:a/x/render", "file:a/x/two.go") in parents and ("cat:a/x", "subcat:a/x/render") in parents and ("subcat:a/x/parse", "file:a/x/two.go") not in parents


def test_deletes_take_the_branch_and_its_edges(spark):
    calls = [("sym:a/x/one.go:ParseFile", "sym:b/y/three.go:SendMail", "invokes", 1.0), ("sym:a/x/one.go:ParseFile", "sym:a/x/two.go:ParseWord", "invokes", 1.0)]
    state = run(spark, OLD, [("b/y/three.go", "delete", None)], [], more=calls)
    assert {r.id for r in state.counts.collect()} == {"subcat:a/x/parse", "cat:a/x", "area:a"}
    left = {(r.src, r.dst) for r in state.edges.collect()}
    assert ("sym:a/x/one.go:ParseFile", "sym:a/x/two.go:ParseWord") in left and not any("b/y" in x or "area:b" in x for e in left for x in e)


def test_modified_symbols_keep_their_edges(spark):
    calls = [("sym:a/x/two.go:ParseWord", "sym:a/x/one.go:ParseFile", "invokes", 1.0), ("sym:a/x/two.go:ParseWord", "sym:a/x/one.go:ParseLine", "invokes", 1.0)]
    state = run(spark, OLD, [("a/x/one.go", "modify", None)], [("a/x/one.go", "ParseFile")], more=calls)
    assert [r.dst for r in state.edges.where("type = 'invokes'").collect()] == ["sym:a/x/one.go:ParseFile"]


def test_rename_and_create_and_empty(spark):
    """A renamed file has its symbols under new ids, a new file is placed, one without symbols is general; nothing changes without changes."""
    state = run(spark, OLD, [("b/y/three.go", "rename", "c/z/four.go"), ("d/new.go", "create", None), ("a/x/two.go", "modify", None)], [("d/new.go", "HandleEvent")], threshold=0.0)
    assert place(state)["c/z/four.go"] == "c/z/send" and place(state)["a/x/two.go"] == "a/x/general" and place(state)["d/new.go"].startswith("d/")
    ids = {r.id for r in state.symbols.collect()}
    assert {"sym:c/z/four.go:SendMail", "sym:d/new.go:HandleEvent"} <= ids and not any("three" in i or "two" in i for i in ids)
    same = run(spark, OLD, [], [])
    assert place(same) == {"a/x/one.go": "a/x/parse", "a/x/two.go": "a/x/parse", "b/y/three.go": "b/y/send"} and same.symbols.count() == 5
