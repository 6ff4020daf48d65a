"""One object for the questions that clients ask of an indexed repository."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Search
from quern.operators import graph, search, stats, trace
from quern.operators.embed import Embedder
from quern.sources.tables import encode_json, encode_toon


@dataclass
class Repository:
    """Tables of an index: chunks (id, path, content, vector), symbols, refs, edges, nodes and graph_edges, usage entries."""

    spark: SparkSession
    embedder: Embedder
    chunks: DataFrame | None = None
    symbols: DataFrame | None = None
    refs: DataFrame | None = None
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    graph_edges: DataFrame | None = None
    files: DataFrame | None = None
    entries: DataFrame | None = None
    config: Search = field(default_factory=Search)

    def search(self, query: str, limit: int = 10, path: str = "", workspace: bool = False) -> DataFrame:
        vector = [float(x) for x in self.embedder([query])[0]]
        return search.search(self.chunks, vector, limit, text=query, prefix=path, config=self.config, workspace=workspace)

    def trace_callers(self, name: str) -> DataFrame:
        return trace.resolve_callers(trace.callers(self.refs, name), self.symbols).orderBy("file", "line")

    def trace_callees(self, name: str) -> DataFrame:
        return trace.callees(self.edges, self.refs, name).orderBy("file", "line")

    def trace_graph(self, name: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        return trace.call_graph(self.edges, self.symbols, name, depth)

    def refs_readers(self, name: str) -> DataFrame:
        return trace.readers(self.refs, name)

    def refs_writers(self, name: str) -> DataFrame:
        return trace.writers(self.refs, name)

    def refs_graph(self, name: str) -> DataFrame:
        return trace.usage_graph(self.refs, name)

    def graph_search(self, query: str, limit: int = 10, mode: str = "auto", scopes: list[str] | None = None, kinds: list[str] | None = None, pattern: str = "") -> DataFrame:
        """features: by words of features and names; snippets: by the text of chunks; auto: the first that finds anything."""
        hits = graph.search_nodes(self.nodes, query, limit, kinds, scopes, pattern)
        if mode == "features":
            return hits
        limit = limit if limit > 0 else 10
        text = search.text_search(self.chunks, query, limit * 4).select("path", "score")
        best = text.groupBy("path").agg(F.max("score").alias("score"))
        found = self.nodes.drop("score").join(F.broadcast(best), "path").orderBy(F.desc("score"), "id").limit(limit)  # at most 4 * limit paths
        return graph.first_that_finds(hits, found.select(hits.columns)) if mode == "auto" else found

    def graph_fetch(self, ids: list[str]) -> DataFrame:
        return graph.fetch(self.nodes, self.graph_edges, self.files, ids)

    def graph_explore(self, start: str, direction: str = "both", depth: int = 2, types: list[str] | None = None, kinds: list[str] | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame]:
        return graph.explore(self.graph_edges, self.nodes, start, direction, depth, types, kinds, limit)

    def index_status(self) -> DataFrame:
        return stats.file_stats(self.chunks).agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"))

    def usage(self, provider: str) -> tuple[DataFrame, DataFrame]:
        return stats.summarize(self.entries, provider), stats.history(self.entries)

    @staticmethod
    def encode(hits: DataFrame, form: str = "json") -> DataFrame:
        return encode_toon(hits) if form == "toon" else encode_json(hits, compact=form == "compact")


def workspace(stores: dict[str, DataFrame], project: str = "") -> DataFrame:
    """Tables of several projects as one with a project column, or of one."""
    chosen = {project: stores[project]} if project else stores
    out: DataFrame | None = None
    for name, df in sorted(chosen.items()):
        x = df.withColumn("project", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out
