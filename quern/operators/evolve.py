"""Incremental evolution of a repository's graph: a batch of file changes as signed deltas.

A graph is kept as its symbols, its placed files with their features, the numbers of children of each node of the feature
hierarchy, and its edges. A change of files takes some placements away and adds others; these deltas are summed for each
subcategory, and where a subcategory appears or has lost its last file, a delta goes on to its category, and so to the area.
A node whose number reaches 0 goes with all its edges. So the work follows the changed files, not the graph: the graph's
tables are only read through joins with what changed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import Graph
from quern.functions import paths as P
from quern.functions import text as X
from quern.operators import graph as G
from quern.session import materialize

PLACE = ["area", "category", "subcategory"]
#: From the lowest level up: kind and prefix of the ids.
LEVELS = (("subcategory", "subcat:"), ("category", "cat:"), ("area", "area:"))


@dataclass(frozen=True)
class State:
    """symbols: as ``symbol_nodes`` gives them; files: path, features, area, category, subcategory; counts: kind, id, area,
    category, subcategory (null above the level), n; edges: src, dst, type, weight."""

    symbols: DataFrame
    files: DataFrame
    counts: DataFrame
    edges: DataFrame


def place(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """files (path) with features and their place by their symbols; general without any."""
    mine = symbols.join(files.select("path"), "path", "left_semi")
    area, category = P.classify_file(F.col("path"))
    x = G.file_nodes(files, mine).select("path", "features").join(G.file_clusters(mine), "path", "left")
    return x.select("path", "features", area.alias("area"), category.alias("category"), F.coalesce("cluster", F.lit("general")).alias("subcategory"))


def carry(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """counts after deltas (area, category, subcategory, d): files that came (1) or went (-1)."""
    out = []
    for depth, (kind, prefix) in zip((3, 2, 1), LEVELS, strict=True):
        keys = PLACE[:depth]
        d = deltas.groupBy(*keys).agg(F.sum("d").cast("long").alias("d"))
        x = counts.where(F.col("kind") == kind).select(*keys, "n").join(d, keys, "full_outer").select(*keys, F.coalesce("n", F.lit(0)).alias("before"), F.coalesce("d", F.lit(0)).alias("d"))
        x = x.withColumn("n", F.col("before") + F.col("d"))
        named = F.concat(F.lit(prefix), F.concat_ws("/", *keys)).alias("id")
        rest = [F.lit(None).cast("string").alias(c) for c in PLACE[depth:]]
        out.append(x.where("n > 0").select(F.lit(kind).alias("kind"), named, *keys, *rest, "n"))
        deltas = x.where("(n > 0) != (before > 0)").select(*keys, F.when(F.col("n") > 0, 1).otherwise(-1).alias("d"))
    return reduce(DataFrame.unionByName, out)


def start(files: DataFrame, symbols: DataFrame, more: DataFrame | None = None) -> State:
    """The state of files (path) and symbol nodes; more: further edges."""
    placed = materialize(place(files, symbols), "files")
    none = symbols.sparkSession.createDataFrame([], "kind string, id string, area string, category string, subcategory string, n long")
    counts = materialize(carry(none, placed.select(*PLACE, F.lit(1).alias("d"))), "counts")
    edges = G.contains_edges(symbols).unionByName(G.hierarchy_edges(placed))
    return State(symbols, placed, counts, edges if more is None else edges.unionByName(more))


def moved(symbols: DataFrame, renames: DataFrame) -> DataFrame:
    """Symbol nodes of renamed files (path, new_path) under their new path and id."""
    x = symbols.join(renames.select("path", "new_path"), "path")
    own = F.expr("substring(id, length(path) + 6)")  # behind "sym:", the path and ":"
    return x.withColumns({"id": F.concat(F.lit("sym:"), "new_path", F.lit(":"), own), "path": F.col("new_path")}).select(symbols.columns)


def evolve(state: State, changes: DataFrame, fresh: DataFrame, threshold: float = Graph().drift) -> State:
    """The state after changes (path, op: create, modify, delete or rename, new_path); fresh: symbol nodes of created and modified files.

    One change a path. A created or renamed file is placed by its symbols; a modified one stays in its place unless its
    features drift by the threshold, and stays as a file if it has lost its last symbol. Symbols that keep their id keep
    their edges; those that go take all theirs along.
    """
    changes = materialize(changes.select("path", "op", "new_path"), "changes")
    renames = changes.where("op = 'rename'")
    written = changes.where("op IN ('create', 'modify')").select("path")
    alive = written.union(renames.select("new_path")).distinct()
    touched = changes.select("path").union(alive).distinct()

    new = materialize(fresh.join(written, "path", "left_semi").select(state.symbols.columns).unionByName(moved(state.symbols, renames)), "new-symbols")
    gone_symbols = state.symbols.join(touched, "path", "left_semi").select("id").join(new.select("id"), "id", "left_anti")
    symbols = state.symbols.join(touched, "path", "left_anti").unionByName(new)

    before = materialize(state.files.join(touched, "path", "left_semi"), "files-before")
    place_now = place(alive, new).alias("n")
    x = place_now.join(before.select("path", F.struct("features", *PLACE).alias("old")), "path", "left")
    stays = F.col("old").isNotNull() & (X.drift(F.col("old.features"), F.col("features")) < threshold)
    after = materialize(x.select("path", "features", *(F.when(stays, F.col("old")[c]).otherwise(F.col(c)).alias(c) for c in PLACE)), "files-after")
    files = state.files.join(touched, "path", "left_anti").unionByName(after.select(state.files.columns))

    deltas = before.select(*PLACE, F.lit(-1).alias("d")).unionByName(after.select(*PLACE, F.lit(1).alias("d")))
    counts = materialize(carry(state.counts, deltas), "counts")

    file_id = lambda df: df.select(F.concat(F.lit("file:"), "path").alias("id"))
    gone_files = before.select("path").join(after.select("path"), "path", "left_anti")
    gone_above = state.counts.select("id").join(counts.select("id"), "id", "left_anti")
    gone = materialize(gone_symbols.union(file_id(gone_files)).union(gone_above).distinct(), "gone")
    _, edges = G.remove_nodes(state.symbols.select("id"), state.edges, gone)
    placed_anew = file_id(after.join(before, ["path", *PLACE], "left_anti")).select(F.col("id").alias("dst"), F.lit("feature_parent").alias("type"))
    edges = edges.join(placed_anew, ["dst", "type"], "left_anti").select(state.edges.columns)
    edges = G.add_edges(edges, G.contains_edges(new).unionByName(G.hierarchy_edges(after)))
    return replace(state, symbols=symbols, files=files, counts=counts, edges=edges)
