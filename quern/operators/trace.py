"""Call graph over symbols, references and edges.

symbols: name, kind, file, line, end_line; refs: symbol_name, kind, file, line, caller_name, caller_file, caller_line;
edges: caller, callee, file, line. "First" follows (file, line) unless a table carries its own order. Breadth-first
searches go level by level for at most five levels: a level is an equi-join of the edges with the frontier and an
anti-join with what was visited, written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Graph
from quern.functions import ranges as R
from quern.session import materialize


def kind_is(kind: str) -> Column:
    return F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("call")) == kind


def definitions(symbols: DataFrame, names: DataFrame) -> DataFrame:
    return symbols.join(names.select("name").distinct(), "name", "left_semi")


def callers(refs: DataFrame, name: str) -> DataFrame:
    return refs.where((F.col("symbol_name") == name) & kind_is("call"))


def readers(refs: DataFrame, name: str) -> DataFrame:
    return refs.where((F.col("symbol_name") == name) & kind_is("read"))


def writers(refs: DataFrame, name: str) -> DataFrame:
    return refs.where((F.col("symbol_name") == name) & kind_is("write"))


def usage_graph(refs: DataFrame, name: str) -> DataFrame:
    """Reads and writes with an access column."""
    return readers(refs, name).withColumn("access", F.lit("read")).unionByName(writers(refs, name).withColumn("access", F.lit("write")))


def first_of(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def callees(edges: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """One callee for each place of a call, with the reference's detail."""
    e = first_of(edges.where(F.col("caller") == name), ["file", "line"], "callee")
    detail = refs.where(F.col("caller_name") == name).select(F.col("symbol_name").alias("callee"), F.col("caller_name").alias("caller"), "file", "line", "caller_file", "caller_line")
    detail = first_of(detail, ["caller", "callee", "file", "line"], "caller_file", "caller_line")
    return e.join(detail, ["caller", "callee", "file", "line"], "left")


def first_definitions(symbols: DataFrame) -> DataFrame:
    return first_of(symbols, ["name"], "file", "line")


def nearest(sites: DataFrame, definitions: DataFrame, name: str, file: str, by_folder: bool = True, how: str = "left") -> DataFrame:
    """Sites with def_file, def_line (and other columns of the definitions) of the nearest definition of their name.

    In the same file, then the same folder, then anywhere, each the first by its columns' order. The first of each file,
    folder and name are found before the join, so a site meets one row of each, however often its name is defined.
    """
    folder = lambda c: F.regexp_replace(c, r"/[^/]*$", "")
    value = F.struct(*(c for c in definitions.columns if c != name))
    rest = [c for c in definitions.columns if c != name]
    anywhere = definitions.groupBy(name).agg(F.min(value).alias("_any"))
    x = sites.join(anywhere, name, how)
    same = definitions.groupBy(name, F.col("def_file").alias(file)).agg(F.min(value).alias("_same"))
    x = x.join(same, [name, file], "left")
    best = F.coalesce("_same", "_any")
    if by_folder:
        x = x.withColumn("_folder", folder(file))
        near = definitions.groupBy(name, folder("def_file").alias("_folder")).agg(F.min(value).alias("_near"))
        x = x.join(near, [name, "_folder"], "left")
        best = F.coalesce("_same", "_near", "_any")
    return x.withColumn("_best", best).select(*sites.columns, *(F.col("_best")[c].alias(c) for c in rest))


def resolve_callers(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call site (ref_id, caller_name, caller_file) with its caller's definition: in the same file, else the first."""
    s = symbols.select(F.col("name").alias("caller_name"), F.col("file").alias("def_file"), F.col("line").alias("def_line"))
    return nearest(refs, s, "caller_name", "caller_file", by_folder=False)


def resolve_callees(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each site (ref_id, symbol_name, file) with the callee's definition: same file, then same folder, then the first."""
    s = symbols.select(F.col("name").alias("symbol_name"), F.col("file").alias("def_file"), F.col("line").alias("def_line"))
    return nearest(sites, s, "symbol_name", "file", how="inner")


def pick_targets(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """The definition of each name that its own file refers to most; the first where none does."""
    r = refs.groupBy(F.col("symbol_name").alias("name"), "file").agg(F.count("*").alias("n_refs"))
    x = symbols.join(r, ["name", "file"], "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0).cast("long")))
    return first_of(x, ["name"], F.desc("n_refs"), "file", "line")


def innermost(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """site_id, file, pos with the function (file, name, start, end) that starts last before it and ends after it."""
    f = R.spread(functions.select("file", F.col("name").alias("function"), "start", "end"), F.col("start"), F.col("end"))
    f = f.groupBy("file", *R.BLOCK).agg(F.max(F.struct("start", "function")).alias("best"))  # a site meets one row of each block
    at = R.located(sites.select("file", "pos").distinct(), F.col("pos"), f)
    best = at.join(f, ["file", *R.BLOCK]).groupBy("file", "pos").agg(F.max("best").alias("best"))
    return sites.join(best, ["file", "pos"], "left").groupBy("site_id").agg(F.max("best").alias("best")).select("site_id", F.col("best")["function"].alias("function"))


def once(edges: DataFrame, *extra: str) -> DataFrame:
    """One edge a (caller, callee[, ...]), the first."""
    return first_of(edges, ["caller", "callee", *extra], *(c for c in ("file", "line") if c not in extra))


def call_graph(edges: DataFrame, symbols: DataFrame, root: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, depth) and edges of the calls below a root, and the calls of the root itself.

    Calls of every visited symbol count, at the last depth too; only callees with exactly one definition are visited.
    A call of a symbol by itself on the line of its definition is its declaration, and no edge.
    """
    lines = symbols.select(F.col("name").alias("caller"), "file", "line").distinct()
    loops = edges.where("caller = callee").join(lines, ["caller", "file", "line"], "left_semi").select("caller", "callee", "file", "line").distinct()
    e = materialize(edges.join(loops, ["caller", "callee", "file", "line"], "left_anti"), "call-edges")  # read again at each level
    single = symbols.groupBy("name").agg(F.count("*").alias("n")).where("n = 1").select("name")
    frontier = edges.sparkSession.createDataFrame([(root,)], "name string")
    levels = [frontier.withColumn("depth", F.lit(0))]
    for level in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels).select("name")
        found = e.join(frontier.withColumnRenamed("name", "caller"), "caller", "left_semi").select(F.col("callee").alias("name")).distinct()
        frontier = materialize(found.join(single, "name", "left_semi").join(seen, "name", "left_anti"), "frontier")
        levels.append(frontier.withColumn("depth", F.lit(level)))
    visited = reduce(DataFrame.unionByName, levels)
    below = e.join(visited.select(F.col("name").alias("caller")), "caller", "left_semi")
    out = below.unionByName(e.where(F.col("callee") == root).select(below.columns))
    out = once(out)
    parents = out.where(F.col("callee") == root).select(F.col("caller").alias("name")).join(visited, "name", "left_anti").withColumn("depth", F.lit(1))
    return visited.unionByName(parents.distinct()), out


def call_graph_both(edges: DataFrame, root: str, depth: int = 2, limits: Graph = Graph()) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges in both directions from every symbol reached, within the limits, nearest first."""
    depth = min(5, max(1, depth or 2))
    edges = materialize(edges, "call-edges")  # read again at each level
    frontier = edges.sparkSession.createDataFrame([(root,)], "name string")
    nodes, found = [frontier.withColumn("level", F.lit(0))], []
    for level in range(1, depth + 1):
        out = edges.join(frontier.withColumnRenamed("name", "caller"), "caller", "left_semi").withColumn("other", F.col("callee"))
        back = edges.join(frontier.withColumnRenamed("name", "callee"), "callee", "left_semi").withColumn("other", F.col("caller"))
        both = out.unionByName(back.select(out.columns))
        found.append(both.drop("other").withColumn("level", F.lit(level)))
        seen = reduce(DataFrame.unionByName, nodes).select("name")
        frontier = materialize(both.select(F.col("other").alias("name")).distinct().join(seen, "name", "left_anti"), "frontier")
        nodes.append(frontier.withColumn("level", F.lit(level)))
    e = first_of(reduce(DataFrame.unionByName, found), ["caller", "callee", "file", "line"], "level")
    e = e.orderBy("level", "caller", "callee", "file", "line").limit(limits.max_edges)
    return reduce(DataFrame.unionByName, nodes).orderBy("level", "name").limit(limits.max_symbols), e


def merge_graphs(graphs: list[DataFrame]) -> DataFrame:
    """Edges of several stores; of equal caller and callee the first store's stays."""
    both = reduce(DataFrame.unionByName, (g.withColumn("_store", F.lit(i)) for i, g in enumerate(graphs)))
    return first_of(both, ["caller", "callee"], "_store", "file", "line").drop("_store")


def dedup_refs(refs: DataFrame) -> DataFrame:
    return refs.dropDuplicates(["symbol_name", "kind", "file", "caller_name", "line", "caller_line"])


def trace(symbols: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """Target, callers and callees of a symbol with their definitions, as rows of role, name, file, line, def_file, def_line."""
    target = pick_targets(symbols.where(F.col("name") == name), refs.where(F.col("symbol_name") == name)).select(F.lit("target").alias("role"), "name", "file", "line", F.col("file").alias("def_file"), F.col("line").alias("def_line"))
    up = resolve_callers(callers(refs, name), symbols).select(F.lit("caller").alias("role"), F.col("caller_name").alias("name"), "file", "line", "def_file", "def_line")
    down = refs.where((F.col("caller_name") == name) & kind_is("call"))
    down = down.join(first_definitions(symbols).select(F.col("name").alias("symbol_name"), F.col("file").alias("def_file"), F.col("line").alias("def_line")), "symbol_name", "left")
    down = down.select(F.lit("callee").alias("role"), F.col("symbol_name").alias("name"), "file", "line", "def_file", "def_line")
    return target.unionByName(up).unionByName(down)
