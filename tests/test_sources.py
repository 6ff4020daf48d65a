"""File scans, ignore rules, git listings, extraction and streams."""

import datetime

import pytest

from quern.operators import extract
from quern.sources import files, tables
from quern.streaming import events


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, data in {"src/a.go": b"package a\n", "src/b.min.js": b"x", "src/c.exe": b"x", "src/d.py": b"\xff\xfe", "src/e.py": b"a\0b", "src/f.ts": b"x" * (1 << 20) + b"y", "src/g.md": b"# g", "src/skip.go": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    root = f"file://{tmp_path}"
    kept, skipped = files.scan_metadata(spark, root, [("", "skip.go")])
    assert {r.path for r in kept.collect()} == {"src/a.go", "src/d.py", "src/e.py", "src/g.md"}
    assert {r.path: r.reason for r in skipped.collect()} == {"src/b.min.js": "minified", "src/c.exe": "extension", "src/f.ts": "size", "src/skip.go": "ignored"}
    got = {r.path: r.content for r in files.scan(spark, root, [("", "skip.go")]).collect()}
    assert got == {"src/a.go": "package a\n", "src/g.md": "# g"}
    want = spark.createDataFrame([("src/a.go", "bad"), ("src/g.md", files.scan(spark, root).where("path = 'src/g.md'").first().hash)], "path string, desired_hash string")
    assert [r.path for r in files.verified(files.scan(spark, root), want).collect()] == ["src/g.md"]


IGNORE = [
    ("a.log", [("", "*.log")], True), ("x/a.log", [("", "*.log")], True), ("a.log", [("", "*.log"), ("", "!a.log")], False),
    ("build/x/a.go", [("", "build/")], True), ("src/build", [("", "build/")], False), ("src/build/a", [("", "/build")], False),
    ("a/b/c.go", [("", "a/**/c.go")], True), ("a/c.go", [("", "a/**/c.go")], True), ("docs/x.md", [("docs", "*.md")], True), ("x.md", [("docs", "*.md")], False),
    ("docs/keep.md", [("", "*.md"), ("docs", "!keep.md")], False), ("build/keep.go", [("", "build/"), ("build", "!keep.go")], True), ("a", [("", "# a"), ("", "")], False),
    ("a+b.go", [("", "a+b.go")], True), ("aab.go", [("", "a+b.go")], False), ("x1.go", [("", "x[0-9].go")], True), ("xa.go", [("", "x[!0-9].go")], True), ("x1.go", [("", "x[!0-9].go")], False),
    ("#a", [("", "\\#a")], True), ("!a", [("", "\\!a")], True), ("a*b", [("", "a\\*b")], True), ("axb", [("", "a\\*b")], False), ("ab.go", [("", "a?.go")], True), ("a/.go", [("", "a?.go")], False),
    ("v/a/b", [("", "v/**")], True), ("v", [("", "v/**")], False), ("x/y/z.txt", [("", "**/z.txt")], True), ("p/q/r", [("p", "/q")], True), ("p/o/q", [("p", "/q")], False), ("é[.go", [("", "é[.go")], True),
    ("d/e/f.go", [("d", "e/"), ("d/e", "!f.go")], True), ("d/f.go", [("d", "*.go"), ("", "!f.go")], True), ("x y.go", [("", " x y.go ")], True),
]


def test_ignore(spark):
    """Each case in a folder of its own, all in one job, and none of it in Python."""
    paths = spark.createDataFrame([(f"c{i}/{path}",) for i, (path, _, _) in enumerate(IGNORE)], "path string")
    rules = [(f"c{i}/{folder}".rstrip("/"), pattern) for i, (_, some, _) in enumerate(IGNORE) for folder, pattern in some]
    got = files.ignored_paths(paths, files._rules(spark, rules))
    assert {int(r.path[1:].partition("/")[0]) for r in got.collect()} == {i for i, (_, _, want) in enumerate(IGNORE) if want}
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()


def test_extra_dirs(spark):
    paths = spark.createDataFrame([("a/node_modules/x.js",), ("node_modules",), ("b/x.js",)], "path string")
    assert [r.path for r in files.ignored_paths(paths, files._rules(spark, []), ["node_modules"]).collect()] == ["a/node_modules/x.js"]


def test_git_truth(spark):
    f = lambda rows: spark.createDataFrame(rows, "path string, oid string")
    got = files.git_truth(f([("a", "1"), ("b", "2"), ("c", "3")]), f([("b", "9")]), f([("c", "3")]), f([("d", "4")]))
    assert {(r.path, r.oid) for r in got.collect()} == {("a", "1"), ("b", "9"), ("d", "4")}


def test_entries(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('{"timestamp":"2024-01-01","command_type":"search","output_tokens":1,"grep_tokens":2}\n\nnot json\n')
    assert tables.read_entries(spark, str(p)).count() == 1
    assert tables.read_entries(spark, str(tmp_path / "none.json")).count() == 0


def symbols(path, text):
    return {(d["name"], d["kind"], d["receiver"]) for d in extract.declarations(path, text)}


@pytest.mark.parametrize("path,text,want", [
    ("a.go", "func Run(x int) {\n}\nfunc (s *Server) Serve() {}\ntype Server struct {}\ntype R interface {\n}\n", {("Run", "function", ""), ("Serve", "method", "Server"), ("Server", "type", ""), ("R", "interface", "")}),
    ("a.py", "class A(B):\n    def run(self):\n        pass\nasync def top():\n    pass\n", {("A", "class", ""), ("run", "method", ""), ("top", "function", "")}),
    ("a.ts", "export function go<T>(x: T) {}\nconst f = async (a) => 1\nclass K extends J {\n  m(x) {\n  }\n}\ninterface I { a: string }\ntype T = string\n", {("go", "function", ""), ("f", "function", ""), ("K", "class", ""), ("m", "method", ""), ("I", "interface", ""), ("T", "type", "")}),
    ("a.rs", "pub struct P { x: i32 }\npub trait T {}\nimpl P {\n    pub fn new() -> Self { P { x: 1 } }\n}\nenum E { A }\n", {("P", "class", ""), ("T", "interface", ""), ("new", "function", ""), ("E", "type", "")}),
    ("A.java", "public class A {\n    public static void main(String[] args) {\n    }\n}\ninterface B {}\nenum C { X }\n", {("A", "class", ""), ("main", "method", ""), ("B", "interface", ""), ("C", "type", "")}),
    ("a.c", "static int add(int a, int b) {\n  return a + b;\n}\nstruct P {\n};\n", {("add", "function", ""), ("P", "class", "")}),
    ("a.cpp", "class W {\n};\nvoid W::draw(int x) {\n}\n", {("W", "class", ""), ("draw", "function", "W")}),
    ("a.lua", "local function f(x)\nend\nfunction M.g(y)\nend\n", {("f", "function", ""), ("g", "method", "M")}),
    ("a.php", "<?php\nclass A {\n  function b() {}\n}\n", {("A", "class", ""), ("b", "function", "")}),
    ("a.zig", "pub fn add(a: i32) i32 {\n}\nconst P = struct {\n};\nconst E = enum { a };\n", {("add", "function", ""), ("P", "class", ""), ("E", "type", "")}),
    ("a.txt", "func A() {}", set()),
])
def test_symbols(path, text, want):
    assert symbols(path, text) == want


def test_references():
    text = 'package a\n\nfunc A() {\n\tB()\n\t// C()\n\ts := "D()"\n\tx.E()\n\tif f(s) {\n\t\tmake(y)\n\t}\n}\n\nvar _ = G()\n'
    got = {(r["symbol_name"], r["line"], r["caller_name"]) for r in extract.references("a.go", text)}
    assert got == {("B", 4, "A"), ("E", 7, "A"), ("f", 8, "A"), ("G", 13, "<top-level>")}


def test_property_references():
    text = "function f(s) {\n  s.count = s.total\n  s.n++\n  g(s['key'])\n}\n"
    got = {(r["symbol_name"], r["kind"]) for r in extract.references("a.ts", text)}
    assert got == {("count", "write"), ("total", "read"), ("n", "write"), ("g", "call"), ("key", "read")}


def test_vue():
    text = "<template/>\n<script setup>\nconst a = 1\n</script>\n<style>\n.a { color: v-bind('a.b(1)') }\n</style>\n"
    assert extract.vue_script(text) == ("const a = 1\nvoid (a.b(1));", [3, 6])


def test_vue_lines(spark):
    text = "<template/>\n<script>\nfunction go() {\n  stop()\n}\n</script>\n"
    files = spark.createDataFrame([("a.vue", text)], "path string, content string")
    s, r = extract.extract_symbols(files, True).first(), extract.extract_references(files).first()
    assert (s["name"], s.line, s.end_line) == ("go", 3, 5) and (r.symbol_name, r.line, r.caller_line) == ("stop", 4, 3)


def test_filesystem_truth(spark, tmp_path):
    for name in ("a.bin", ".git/config"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r.path for r in files.filesystem_truth(spark, f"file://{tmp_path}").collect()] == ["a.bin"]
    assert len(files.worktree_id("/x/.git")) == 12


def stream_rows():
    at = lambda ms: datetime.datetime(2024, 1, 1, 0, 0, ms // 1000, ms % 1000 * 1000)
    return [("a.go", "create", at(0)), ("a.go", "modify", at(300)), ("a.go", "delete", at(500)), ("a.go", "create", at(700)), ("a.go", "modify", at(5000)), ("b.go", "modify", at(100)), (".git/x.go", "modify", at(100)), ("c.exe", "modify", at(0))]


def test_coalesce(spark):
    e = events.relevant(spark.createDataFrame(stream_rows(), "path string, event_type string, ts timestamp"))
    got = sorted((r.path, r.event_type, r.n) for r in events.coalesce(e).collect())
    assert got == [("a.go", "delete", 4), ("a.go", "modify", 1), ("b.go", "modify", 1)]


def test_stream_equals_batch(spark, tmp_path):
    """A stream of events applied in micro-batches ends where the batch does."""
    schema = "path string, event_type string, ts timestamp"
    for i, part in enumerate((stream_rows()[:4], stream_rows()[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = events.relevant(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    seen: dict[str, str] = {}

    def apply(changed, removed):
        seen.update({r.path: "changed" for r in changed.collect()} | {r.path: "removed" for r in removed.collect()})

    q = events.maintain(source, apply, lambda: seen.clear(), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert seen.keys() == {"a.go", "b.go"} and seen["b.go"] == "changed"


def test_rebuild_when_many(spark, tmp_path):
    spark.range(10).selectExpr("concat('f', id, '.go') AS path", "'modify' AS event_type", "timestamp'2024-01-01' AS ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("path string, event_type string, ts timestamp").parquet(f"{tmp_path}/in")
    done = []
    events.maintain(source, lambda a, b: done.append("apply"), lambda: done.append("rebuild"), f"{tmp_path}/cp", limit=3).awaitTermination(120)
    assert done == ["rebuild"]


def test_failures_outlive_the_driver(spark, tmp_path):
    """Two failures, with the query started anew between them, end in one rebuild; what was applied isn't applied again."""
    schema = "path string, event_type string, ts timestamp"
    spark.createDataFrame(stream_rows()[:2], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    done = []

    def broken(changed, removed):
        done.append("tried")
        raise RuntimeError("no store")

    def run(apply):
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = events.maintain(source, apply, lambda: done.append("rebuild"), f"{tmp_path}/cp", max_failures=2)
        try:
            q.awaitTermination(120)
        except Exception as e:
            assert "no store" in str(e)

    run(broken)
    assert done == ["tried"]
    run(broken)
    assert done == ["tried", "tried", "rebuild"]
    run(broken)  # nothing new
    spark.createDataFrame(stream_rows()[5:6], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(lambda a, b: done.append([r.path for r in a.collect()]))
    assert done[3:] == [["b.go"]]
    kept = events.Ledger(spark, f"{tmp_path}/cp/ledger").rows().orderBy("number").collect()
    assert [r.outcome for r in kept] == ["failed", "failed", "rebuilt", "applied"]
    import shutil

    last = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"))[-1]
    for f in (last, last.with_name(f".{last.name}.crc")):  # as if the driver had gone before the commit
        shutil.move(f, tmp_path / f.name)
    run(lambda a, b: done.append("twice"))
    assert done[3:] == [["b.go"]]


def test_debounce(spark, tmp_path):
    spark.createDataFrame(stream_rows()[:4], "path string, event_type string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("path string, event_type string, ts timestamp").parquet(f"{tmp_path}/in")
    q = events.debounce(source, quiet_ms=200).writeStream.format("memory").queryName("debounced").outputMode("append").trigger(processingTime="300 milliseconds").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for _ in range(60):
            if spark.sql("SELECT * FROM debounced").count():
                break
            q.awaitTermination(1)
        assert [tuple(r) for r in spark.sql("SELECT * FROM debounced").collect()] == [("a.go", "delete", 4)]
    finally:
        q.stop()
