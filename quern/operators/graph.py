"""Property graph of a repository: symbols, files and a feature hierarchy with typed edges.

nodes: id, kind, path, symbol_name, feature, features, start_line, end_line; edges: from, to, type, weight. Similarity
edges compare only symbols of one verb, at most ``group_cap`` of each group, and co-calls skip callers with many
callees, so both joins stay linear in the number of groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Graph
from quern.functions import paths as P
from quern.functions import text as X
from quern.operators.trace import first_of, nearest
from quern.session import materialize

LIMITS = Graph()
KINDS_OF = {"directory": ["area", "category", "subcategory"], "class": ["symbol"], "function": ["symbol"], "method": ["symbol"]}


def edge(src: Column, dst: Column, kind: str, weight: Column | float = 1.0) -> list[Column]:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), w.cast("double").alias("weight")]


def symbol_nodes(symbols: DataFrame) -> DataFrame:
    """Symbols (path, symbol_name, receiver, line, end_line) with id and feature."""
    owner = F.when(F.col("receiver") == "", F.col("symbol_name")).otherwise(F.concat("receiver", F.lit("."), "symbol_name"))
    x = symbols.withColumn("id", F.concat(F.lit("sym:"), "path", F.lit(":"), owner)).withColumn("feature", X.atomic_feature(F.col("symbol_name")))
    return x.withColumn("end_line", X.normalize_end(F.col("line"), F.col("end_line")))


def contains_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(*edge(F.concat(F.lit("file:"), "path"), F.col("id"), "contains")).distinct()


def invokes_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls (caller, callee, file, line): the caller is the symbol of that name whose lines hold the call, the callee the nearest definition."""
    n = nodes.select("id", "symbol_name", "path", "line", "end_line")
    a = n.select(F.col("id").alias("src"), F.col("symbol_name").alias("caller"), F.col("path").alias("file"), F.col("line").alias("_s"), F.col("end_line").alias("_e"))
    x = calls.join(a, ["caller", "file"]).where(F.col("line").between(F.col("_s"), F.col("_e")))
    x = first_of(x, ["caller", "callee", "file", "line"], "_s", "src").select("src", "callee", "file", "line")
    b = n.select(F.col("symbol_name").alias("callee"), F.col("path").alias("def_file"), F.col("id").alias("dst"))
    y = nearest(x, b, "callee", "file", how="inner")
    return y.where("src != dst").select(*edge(F.col("src"), F.col("dst"), "invokes")).distinct()


def import_edges(invokes: DataFrame, nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Distinct pairs of files whose symbols invoke one another; with files (path), only where both are there."""
    p = nodes.select("id", "path")
    x = invokes.join(p.select(F.col("id").alias("src"), F.col("path").alias("pa")), "src").join(p.select(F.col("id").alias("dst"), F.col("path").alias("pb")), "dst")
    if files is not None:
        there = files.select("path").distinct()
        x = x.join(there.withColumnRenamed("path", "pa"), "pa", "left_semi").join(there.withColumnRenamed("path", "pb"), "pb", "left_semi")
    return x.where("pa != pb").select(*edge(F.concat(F.lit("file:"), "pa"), F.concat(F.lit("file:"), "pb"), "imports")).distinct()


def cap_groups(nodes: DataFrame, group: str, cap: int, by_directory: bool = False) -> DataFrame:
    """At most cap nodes of each group (or of each folder of a group that is larger), chosen by the hash of their id."""
    w = Window.partitionBy(group)
    if by_directory:
        x = nodes.withColumn("_dir", P.directory(F.col("path"))).withColumn("_size", F.count("*").over(w))
        x = x.withColumn("_dir", F.when(F.col("_size") > cap, F.col("_dir")).otherwise(""))
        per = Window.partitionBy(group, "_dir")
        x = x.withColumn("_d", F.count("*").over(per)).withColumn("_n", F.row_number().over(per.orderBy(F.md5(F.col("id").cast("binary")))))
        return x.where((F.col("_n") <= cap) & ((F.col("_size") <= cap) | (F.col("_d") >= 2))).withColumn(group, F.concat_ws("\0", F.col(group), "_dir")).drop("_dir", "_size", "_d", "_n")
    return nodes.withColumn("_n", F.row_number().over(w.orderBy(F.md5(F.col("id").cast("binary"))))).where(F.col("_n") <= cap).drop("_n")


def semantic_edges(nodes: DataFrame, limits: Graph = LIMITS) -> DataFrame:
    """Symbols of different files with one verb and word sets of enough Jaccard similarity."""
    x = nodes.select("id", "path", F.array_distinct(X.atomic_words(F.col("feature"))).alias("words"), F.get(F.split("feature", "[-_/ @]"), F.lit(0)).alias("verb"))
    x = cap_groups(x, "verb", limits.group_cap)
    a = x.select("verb", F.col("id").alias("a"), F.col("path").alias("pa"), F.col("words").alias("wa"))
    b = x.select("verb", F.col("id").alias("b"), F.col("path").alias("pb"), F.col("words").alias("wb"))
    y = a.join(b, "verb").where("a < b AND pa != pb").withColumn("j", X.jaccard(F.col("wa"), F.col("wb")))
    return y.where(F.col("j") >= limits.similarity).select(*edge(F.col("a"), F.col("b"), "semantic_sim", F.col("j")))


def co_call_counts(calls: DataFrame, limits: Graph = LIMITS) -> DataFrame:
    """a, b, n: callees (src calls dst) that share callers, by callers with 2 to hub_callees callees."""
    fits = calls.groupBy("src").agg(F.count("*").alias("_n")).where(F.col("_n").between(2, limits.hub_callees)).select("src")
    x = calls.select("src", "dst").join(fits, "src", "left_semi")
    x = x.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("c"))  # hub_callees at most
    pairs = x.select(F.posexplode("c").alias("i", "a"), "c").select("a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= limits.min_co_calls)


def co_call_edges(calls: DataFrame, nodes: DataFrame, existing: DataFrame | None = None, limits: Graph = LIMITS) -> DataFrame:
    """Of callees in different files without a similarity edge; weight by count, at most 1."""
    x = co_call_counts(calls, limits)
    p = nodes.select("id", "path")
    x = x.join(p.select(F.col("id").alias("a"), F.col("path").alias("pa")), "a").join(p.select(F.col("id").alias("b"), F.col("path").alias("pb")), "b").where("pa != pb AND a != b")
    if existing is not None:
        x = x.join(existing.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), ["a", "b"], "left_anti")
    return x.select(*edge(F.col("a"), F.col("b"), "semantic_sim", F.least(F.lit(1.0), F.col("n") / limits.co_call_norm)))


def chunk_links(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks (chunk_id, path, s, e) and the symbols whose lines they share."""
    n = nodes.select("path", "id", "line", "end_line")
    x = chunks.join(n, "path").where((F.col("s") <= F.col("end_line")) & (F.col("line") <= F.col("e")))
    return x.select(*edge(F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")), F.col("id"), "maps_to_chunk")).distinct()


def file_features(nodes: DataFrame, limit: int = 5) -> DataFrame:
    """path, rank, feature, n: the most frequent features of each file, ties by name."""
    c = nodes.groupBy("path", "feature").agg(F.count("*").alias("n"))
    w = Window.partitionBy("path").orderBy(F.desc("n"), "feature")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def file_clusters(nodes: DataFrame) -> DataFrame:
    """path, cluster: the most frequent cluster key of each file's symbols, ties by name."""
    c = nodes.withColumn("cluster", X.cluster_key(F.col("feature"))).groupBy("path", "cluster").agg(F.count("*").alias("n"))
    return first_of(c, ["path"], F.desc("n"), "cluster").select("path", "cluster")


def placed(nodes: DataFrame) -> DataFrame:
    """Files with area, category and subcategory; general without a cluster."""
    area, category = P.classify_file(F.col("path"))
    x = nodes.select("path").distinct().join(file_clusters(nodes), "path", "left")
    return x.select("path", area.alias("area"), category.alias("category"), F.coalesce("cluster", F.lit("general")).alias("subcategory"))


def hierarchy_edges(files: DataFrame) -> DataFrame:
    """feature_parent edges area, category, subcategory, file."""
    a = F.concat(F.lit("area:"), "area")
    c = F.concat(F.lit("cat:"), "area", F.lit("/"), "category")
    s = F.concat(F.lit("subcat:"), "area", F.lit("/"), "category", F.lit("/"), "subcategory")
    f = F.concat(F.lit("file:"), "path")
    kids = F.array(*(F.struct(p.alias("src"), q.alias("dst")) for p, q in ((a, c), (c, s), (s, f))))
    return files.select(F.explode(kids).alias("e")).select(*edge(F.col("e.src"), F.col("e.dst"), "feature_parent")).distinct()


def labels(files: DataFrame, nodes: DataFrame, top: int = 3) -> DataFrame:
    """id, label "name [verb, verb, verb]" of areas and categories by the clusters of the symbols below."""
    x = nodes.groupBy("path", X.cluster_key(F.col("feature")).alias("verb")).agg(F.count("*").alias("n"))  # before the join, so that none is of symbols
    x = x.where("verb != 'misc'").join(files, "path")
    both = F.array(F.struct(F.concat(F.lit("area:"), "area").alias("id"), F.col("area").alias("name")), F.struct(F.concat(F.lit("cat:"), "area", F.lit("/"), "category").alias("id"), F.col("category").alias("name")))
    c = x.select(F.inline(both), "verb", "n").groupBy("id", "name", "verb").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "verb")
    c = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    c = c.groupBy("id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "verb"))), lambda v: v["verb"]), ", ").alias("verbs"))
    return c.select("id", F.concat("name", F.lit(" ["), "verbs", F.lit("]")).alias("label"))


def search_nodes(nodes: DataFrame, query: str, limit: int = 10, kinds: list[str] | None = None, scopes: list[str] | None = None, pattern: str = "") -> DataFrame:
    """Nodes by Jaccard of the query's words and the words of feature and symbol name."""
    words = sorted({w for w in query.lower().replace("-", " ").replace("_", " ").replace("/", " ").replace(".", " ").replace("@", " ").split(" ") if w})
    x = nodes.where(F.col("kind").isin(kinds or ["symbol"]))
    if scopes:
        x = x.where(P.in_scopes(F.col("path"), scopes))
    if pattern:
        x = x.where(P.matches_pattern(F.col("path"), pattern))
    own = F.array_distinct(F.concat(X.normalize_words(F.col("feature")), X.normalize_words(F.col("symbol_name"))))
    x = x.withColumn("score", X.jaccard(F.lit(words), own)).where("score > 0").orderBy(F.desc("score"), "id")
    return x.limit(limit if limit > 0 else 10)


def feature_paths(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, feature_path of symbols: the place of their file in the hierarchy."""
    return nodes.select("id", "path").join(files, "path").select("id", F.concat_ws("/", "area", "category", "subcategory").alias("feature_path"))


def fetch(nodes: DataFrame, edges: DataFrame, files: DataFrame, ids: list[str]) -> DataFrame:
    """Nodes with feature path and numbers of incoming and outgoing edges by type."""
    wanted = nodes.where(F.col("id").isin(ids))
    out = edges.where(F.col("src").isin(ids)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.where(F.col("dst").isin(ids)).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    x = wanted.join(feature_paths(wanted, files), "id", "left").join(out, "id", "left").join(into, "id", "left")
    return x.fillna(0, ["n_out", "n_in"])


def neighbors(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"))
    back = edges.where(F.col("dst") == node).select(F.col("src").alias("id"))
    return {"forward": out, "reverse": back}.get(direction, out.union(back)).distinct()


def explore(edges: DataFrame, nodes: DataFrame, start: str, direction: str = "both", depth: int = 2, types: list[str] | None = None, kinds: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) reached from a start, nearest first up to the limit, and the edges followed.

    A neighbour of another kind is not a result and not followed; in both directions an edge can be listed twice.
    """
    e = materialize(edges.where(F.col("type").isin(types)) if types else edges, "explored")  # read again at each level
    fits = nodes.select("id") if not kinds else nodes.where(F.col("kind").isin([k for x in kinds for k in KINDS_OF.get(x, [x])])).select("id")
    frontier = edges.sparkSession.createDataFrame([(start,)], "id string")
    levels, found = [frontier.withColumn("depth", F.lit(0))], []
    for level in range(1, depth + 1):
        steps = []
        if direction in ("forward", "both"):
            steps.append(e.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi").withColumn("id", F.col("dst")))
        if direction in ("reverse", "both"):
            steps.append(e.join(frontier.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*e.columns).withColumn("id", F.col("src")))
        step = reduce(DataFrame.unionByName, steps)
        found.append(step.drop("id").withColumn("depth", F.lit(level)))
        seen = reduce(DataFrame.unionByName, levels).select("id")
        frontier = materialize(step.select("id").distinct().join(fits, "id", "left_semi").join(seen, "id", "left_anti"), "frontier")
        levels.append(frontier.withColumn("depth", F.lit(level)))
    return reduce(DataFrame.unionByName, levels).orderBy("depth", "id").limit(limit), reduce(DataFrame.unionByName, found)


def remove_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes go with all their edges."""
    gone = ids.select("id").distinct()
    e = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), e.select(edges.columns)


def prune_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without subcategories, then categories, then areas that have no child left."""
    for kind in ("subcategory", "category", "area"):
        parents = edges.where("type = 'feature_parent'").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
        empty = nodes.where(F.col("kind") == kind).join(parents, "id", "left_anti").select("id")
        nodes = nodes.join(empty, "id", "left_anti")
    return nodes


def refresh_edges(edges: DataFrame, fresh: DataFrame, nodes: DataFrame, changed: DataFrame, derived: list[str]) -> DataFrame:
    """Derived edges that touch changed files (path) are replaced by the fresh ones that do; the rest stays."""
    touched = nodes.join(changed.select("path").distinct(), "path", "left_semi").select("id")

    def touching(df: DataFrame) -> DataFrame:
        a, b = touched.select(F.col("id").alias("src"), F.lit(1).alias("_a")), touched.select(F.col("id").alias("dst"), F.lit(1).alias("_b"))
        return df.join(a, "src", "left").join(b, "dst", "left").withColumn("_t", F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_a", "_b")

    kept = touching(edges).where(~F.col("_t") | ~F.col("type").isin(derived)).drop("_t")
    return kept.unionByName(touching(fresh).where("_t").drop("_t")).select(edges.columns)


def drifted(old: DataFrame, new: DataFrame, threshold: float = LIMITS.drift) -> DataFrame:
    """id, drift, rerouted of nodes in both versions (id, features)."""
    x = old.select("id", F.col("features").alias("_o")).join(new.select("id", F.col("features").alias("_n")), "id")
    x = x.withColumn("drift", X.drift(F.col("_o"), F.col("_n")))
    return x.select("id", "drift", (F.col("drift") >= threshold).alias("rerouted"))


def summaries(parents: DataFrame, limit: int = 20) -> DataFrame:
    """Rows of id, name, child_id, child_feature to id and a sentence over the first children by id."""
    x = parents.groupBy("id", "name").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("child_id", "child_feature"))), 1, limit), lambda c: c["child_feature"]).alias("c"), F.count("*").alias("n_children"))
    return x.select("id", "n_children", X.summary_context(F.col("name"), F.col("c"), limit).alias("summary"))


def stem(path: Column) -> Column:
    """The file's name up to its last dot."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_nodes(files: DataFrame, symbols: DataFrame, limit: int = 5) -> DataFrame:
    """Files (path) as nodes: the feature of their name, and the most frequent features of their symbols or, without any, that one."""
    own = X.atomic_feature(stem(F.col("path")))
    top = file_features(symbols, limit).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda f: f["feature"]).alias("features"))
    x = files.select("path").distinct().withColumn("feature", own).join(top, "path", "left")
    return x.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), "path", "feature", F.coalesce("features", F.array("feature")).alias("features"))


def hierarchy_nodes(files: DataFrame) -> DataFrame:
    """Areas, categories and subcategories of placed files: id, kind, name."""
    a, c, s = F.col("area"), F.concat_ws("/", "area", "category"), F.concat_ws("/", "area", "category", "subcategory")
    of = ((F.lit("area:"), a, "area", "area"), (F.lit("cat:"), c, "category", "category"), (F.lit("subcat:"), s, "subcategory", "subcategory"))
    kinds = F.array(*(F.struct(F.concat(p, v).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name")) for p, v, kind, name in of))
    return files.select(F.inline(kinds)).distinct()


def build(files: DataFrame, symbols: DataFrame, calls: DataFrame, chunks: DataFrame | None = None, limits: Graph = LIMITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of a repository: nodes (id, kind, path, name, feature, features, line, end_line, label, summary), edges, placed files.

    files: path; symbols: path, symbol_name, receiver, line, end_line; calls: caller, callee, file, line; chunks: chunk_id,
    path, s, e. In order: file and symbol nodes, containment, invocations, imports, similarity, co-calls, chunk links, the
    hierarchy, its labels and summaries from the bottom up.
    """
    known = symbols.join(files.select("path").distinct(), "path", "left_semi")
    s = materialize(first_of(symbol_nodes(known), ["id"], "line"), "symbol-nodes")
    f = materialize(file_nodes(files, s), "file-nodes")
    invokes = materialize(invokes_edges(calls, s), "invokes")
    semantic = materialize(semantic_edges(s, limits), "semantic")
    parts = [contains_edges(s), invokes, import_edges(invokes, s, f), semantic, co_call_edges(invokes.select("src", "dst"), s, semantic, limits)]
    if chunks is not None:
        parts.append(chunk_links(chunks, s))
    area, category = P.classify_file(F.col("path"))
    where = f.select("path").join(file_clusters(s), "path", "left").select("path", area.alias("area"), category.alias("category"), F.coalesce("cluster", F.lit("general")).alias("subcategory"))
    where = materialize(where, "placed")
    parts.append(hierarchy_edges(where))
    above = hierarchy_nodes(where).join(labels(where, s), "id", "left").join(summarize_hierarchy(where, f), "id", "left")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    nodes = s.select("id", F.lit("symbol").alias("kind"), "path", F.col("symbol_name").alias("name"), "feature", F.array("feature").alias("features"), F.col("line").cast("int").alias("line"), F.col("end_line").cast("int").alias("end_line"), text.alias("label"), text.alias("summary"))
    nodes = nodes.unionByName(f.select("id", "kind", "path", text.alias("name"), "feature", "features", number.alias("line"), number.alias("end_line"), text.alias("label"), X.summary_context(F.col("path"), F.col("features"), 20).alias("summary")))
    nodes = nodes.unionByName(above.select("id", "kind", text.alias("path"), "name", F.col("name").alias("feature"), F.array("name").alias("features"), number.alias("line"), number.alias("end_line"), "label", "summary"))
    return nodes, reduce(DataFrame.unionByName, parts), where


def summarize_hierarchy(files: DataFrame, file_features: DataFrame, done: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """id, summary of subcategories over their files, of categories over theirs and of areas over theirs; ids in ``done`` are skipped.

    file_features: path, feature.
    """
    f = files.join(file_features.select("path", "feature"), "path", "left")
    key = lambda *c: F.concat_ws("/", *c)
    levels = [
        f.select(F.concat(F.lit("subcat:"), key("area", "category", "subcategory")).alias("id"), F.col("subcategory").alias("name"), F.concat(F.lit("file:"), "path").alias("child_id"), F.coalesce("feature", F.lit("")).alias("child_feature")),
        f.select(F.concat(F.lit("cat:"), key("area", "category")).alias("id"), F.col("category").alias("name"), F.concat(F.lit("subcat:"), key("area", "category", "subcategory")).alias("child_id"), F.col("subcategory").alias("child_feature")).distinct(),
        f.select(F.concat(F.lit("area:"), "area").alias("id"), F.col("area").alias("name"), F.concat(F.lit("cat:"), key("area", "category")).alias("child_id"), F.col("category").alias("child_feature")).distinct(),
    ]
    x = reduce(DataFrame.unionByName, levels)
    if done is not None:
        x = x.join(done.select("id"), "id", "left_anti")
    return summaries(x, limit).select("id", "summary")


def all_feature_paths(nodes: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """id, feature_path of every kind: areas and the like their own, files and symbols their file's place, chunks (src of links) their first symbol's."""
    place = files.select("path", F.concat_ws("/", "area", "category", "subcategory").alias("feature_path"))
    above = nodes.where(F.col("kind").isin("area", "category", "subcategory")).select("id", F.expr("substring(id, instr(id, ':') + 1)").alias("feature_path"))
    below = nodes.where(F.col("kind").isin("file", "symbol")).select("id", "path").join(place, "path").select("id", "feature_path")
    first = links.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("symbol"))
    chunks = first.join(nodes.select(F.col("id").alias("symbol"), "path"), "symbol").join(place, "path").select("id", "feature_path")
    return above.unionByName(below).unionByName(chunks)


def resolve_entities(nodes: DataFrame, names: list[str]) -> DataFrame:
    """entity, id: the node of that id, else the file of that path, else the first symbol of that name, else the first of that feature."""
    x = nodes.select("id", F.inline(F.array(*(F.struct(F.lit(rank).alias("rank"), c.alias("entity")) for rank, c in enumerate((F.col("id"), F.when(F.col("kind") == "file", F.col("path")), F.when(F.col("kind") == "symbol", F.col("name")), F.col("feature")))))))
    return first_of(x.where(F.col("entity").isin(names)), ["entity"], "rank", "id").select("entity", "id")


def ancestors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, ancestor, hops along containment and the hierarchy: four hops at most, from a symbol to its area."""
    up = edges.where(F.col("type").isin("contains", "feature_parent")).select(F.col("dst").alias("_at"), F.col("src").alias("_up")).distinct()
    at, out = ids.select("id", F.col("id").alias("_at")), []
    for hop in range(1, 5):
        at = at.join(up, "_at").select("id", F.col("_up").alias("_at")).distinct()
        out.append(at.select("id", F.col("_at").alias("ancestor"), F.lit(hop).alias("hops")))
    return reduce(DataFrame.unionByName, out)


def children(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, child along containment and the hierarchy."""
    x = edges.where(F.col("type").isin("contains", "feature_parent")).select(F.col("src").alias("id"), F.col("dst").alias("child"))
    return x.join(ids.select("id").distinct(), "id", "left_semi").distinct()


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges, each (src, dst, type) once; one that is there takes the new weight."""
    return edges.join(new.select("src", "dst", "type").distinct(), ["src", "dst", "type"], "left_anti").select(edges.columns).unionByName(new.dropDuplicates(["src", "dst", "type"]).select(edges.columns))


def first_that_finds(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of first, or those of second if there are none; one plan, decided as it runs."""
    any_ = first.limit(1).select(F.lit(1).alias("_found"))  # a row or none
    return first.unionByName(second.withColumn("_found", F.lit(1)).join(F.broadcast(any_), "_found", "left_anti").drop("_found"))


def search_auto(nodes: DataFrame, chunk_hits: DataFrame, query: str, limit: int = 10, **scope) -> DataFrame:
    """id, path, score of nodes by features and names, or, where these find nothing, of the symbols in files whose chunks (path, score) were found."""
    hits = search_nodes(nodes, query, limit, **scope).select("id", "path", F.col("score").cast("double").alias("score"))
    best = chunk_hits.groupBy("path").agg(F.max("score").cast("double").alias("score"))
    below = nodes.where("kind = 'symbol'").select("id", "path").join(best, "path").select("id", "path", "score").orderBy(F.desc("score"), "id").limit(limit if limit > 0 else 10)
    return first_that_finds(hits, below)


def node_records(nodes: DataFrame, edges: DataFrame, files: DataFrame, ids: DataFrame, limit: int = 20) -> DataFrame:
    """One record for each of ids (id): kind, feature, feature_path, chain, children, incoming and outgoing.

    chain: the ancestors from the nearest up; children: the first by id; incoming, outgoing: for each type of edge the number
    and the first neighbours by id. Lists hold ``limit`` entries at most, numbers count all; a hub is cut before it is gathered.
    """
    wanted = materialize(nodes.join(ids.select("id").distinct(), "id", "left_semi"), "wanted")
    edges = materialize(edges, "record-edges")  # read by each part of a record
    key = wanted.select("id")
    up = ancestors(edges, key)
    chain = up.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hops", "ancestor"))), lambda c: c["ancestor"]).alias("chain"))
    first = lambda *by: F.row_number().over(Window.partitionBy("id", *by).orderBy("other"))
    kids = children(edges, key).withColumnRenamed("child", "other")
    kids = kids.withColumn("r", first()).where(F.col("r") <= limit).groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("children"))

    def by_type(own: str, other: str, name: str) -> DataFrame:
        x = edges.select(F.col(own).alias("id"), F.col(other).alias("other"), "type").join(key, "id", "left_semi")
        n = x.groupBy("id", "type").agg(F.count("*").alias("n"))
        some = x.withColumn("r", first("type")).where(F.col("r") <= limit).groupBy("id", "type").agg(F.array_sort(F.collect_list("other")).alias("ids"))
        return n.join(some, ["id", "type"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("type", "n", "ids"))).alias(name))

    place = all_feature_paths(wanted, files, edges.where("false").select("src", "dst"))
    out = wanted.select("id", "kind", "feature")
    for part in (place, chain, kids, by_type("dst", "src", "incoming"), by_type("src", "dst", "outgoing")):
        out = out.join(part, "id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"chain": F.coalesce("chain", none), "children": F.coalesce("children", none)})
