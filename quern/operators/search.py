"""Ranked retrieval: vector top-k, text score, rank fusion, path boosts, dedup by file, fan-out over repositories.

Ties are broken by id or path, so results are deterministic. Top-k is ``orderBy.limit``, which Spark plans as
per-partition heaps; first-per-group is ``row_number() = 1``, which keeps one row a group on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.config import Search
from quern.functions.paths import has_prefix, in_projects
from quern.functions.text import overlap_length, query_words, text_score
from quern.functions.vectors import cosine_to


def scored(chunks: DataFrame, query: Sequence[float], prefix: str = "", vector: str = "vector") -> DataFrame:
    """Chunks under the prefix whose vectors have the query's size, with finite scores."""
    x = chunks.where(has_prefix(F.col("path"), prefix)) if prefix else chunks
    x = x.withColumn("score", cosine_to(F.col(vector), query))
    return x.where((F.size(vector) == len(query)) & ~F.isnan("score"))


def top(df: DataFrame, limit: int, *ties: str) -> DataFrame:
    """By falling score; limit 0 or less: all."""
    out = df.orderBy(F.desc("score"), *ties)
    return out.limit(limit) if limit > 0 else out


def vector_search(chunks: DataFrame, query: Sequence[float], limit: int, prefix: str = "", vector: str = "vector") -> DataFrame:
    return top(scored(chunks, query, prefix, vector), limit, "id")


def text_search(chunks: DataFrame, query: str, limit: int = 0, prefix: str = "", content: str = "content") -> DataFrame:
    words = query_words(query)
    x = chunks.where(has_prefix(F.col("path"), prefix)) if prefix else chunks
    return top(x.withColumn("score", text_score(F.col(content), words)).where("score > 0"), limit, "id")


def ranked(hits: DataFrame, name: str) -> DataFrame:
    """A list of bounded length with 0-based ranks; call it on limited lists only."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(F.desc("score"), "id")) - 1)


def fuse(lists: list[DataFrame], k: int = 60, limit: int = 0) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: id and the sum of 1 / (k + rank + 1)."""
    part = [x.select("id", (F.lit(1.0).cast("double") / (F.lit(k) + F.col("rank") + 1)).alias("part")) for x in lists]
    both = reduce(DataFrame.unionByName, part)
    return top(both.groupBy("id").agg(F.sum("part").alias("score")), limit, "id")


def boosted(hits: DataFrame, config: Search = Search(), path: str = "path") -> DataFrame:
    """Scores times the factors of all patterns that the path contains."""
    factor = F.lit(1.0)
    for pattern, f in [*config.penalties, *config.bonuses]:
        factor = factor * F.when(F.contains(F.col(path), F.lit(pattern)), f).otherwise(1.0)
    return hits.withColumn("score", (F.col("score") * factor).cast("double"))


def best_by(hits: DataFrame, key: str, *ties: str) -> DataFrame:
    """The best hit of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), *(ties or ("id",)))
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def search(chunks: DataFrame, query: Sequence[float], limit: int, text: str = "", prefix: str = "", config: Search = Search(), workspace: bool = False) -> DataFrame:
    """The whole pipeline: fetch 2x (4x with dedup), fuse, boost, dedup by file, cut.

    workspace: neither fusion nor dedup, whatever the settings. Limit 0 or less: all chunks by vector score, without fusion.
    """
    dedup, hybrid = config.dedup and not workspace, config.hybrid and not workspace
    fetch = limit * (4 if dedup else 2)
    hits = vector_search(chunks, query, fetch, prefix)
    if hybrid and text and limit > 0:  # ranks are of bounded lists
        words = text_search(chunks, text, fetch, prefix)
        fused = fuse([ranked(hits, "vector"), ranked(words, "text")], config.k, fetch)
        hits = chunks.join(F.broadcast(fused), "id")  # at most fetch rows
    if config.boost:
        hits = boosted(hits, config)
    if dedup:
        hits = best_by(hits, "path")
    return top(hits, limit, "id")


def view_search(view: DataFrame, artifact_chunks: DataFrame, chunks: DataFrame, query: Sequence[float], limit: int, prefix: str = "") -> DataFrame:
    """Best chunk of each path of a view: view (path, artifact_id), artifact_chunks (artifact_id, chunk_id), chunks (chunk_id, vector).

    Chunks are scored before the joins, so vectors are not shuffled.
    """
    v = view.where(has_prefix(F.col("path"), prefix)) if prefix else view
    hits = chunks.where(F.size("vector") == len(query)).select("chunk_id", cosine_to(F.col("vector"), query).alias("score")).where(~F.isnan("score"))
    hits = v.join(artifact_chunks, "artifact_id").join(hits, "chunk_id")
    return top(best_by(hits, "path", "chunk_id"), limit, "path")


def search_all(hits: DataFrame, repository: str, limit: int) -> DataFrame:
    """Top of each repository, then of all."""
    w = Window.partitionBy(repository).orderBy(F.desc("score"), "id")
    each = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return each.orderBy(F.desc("score"), repository, "rank").limit(limit)


def of_projects(hits: DataFrame, workspace: str, projects: list[str]) -> DataFrame:
    return hits.where(in_projects(F.col("path"), workspace, projects))


def enrich(hits: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (path, start_line, end_line) with the symbol of largest overlap and its feature path, else the file's.

    symbols: path, symbol, s, e, feature_path; files: path, file_feature. An equi-join on path with a range condition.
    """
    s = symbols.select(F.col("path").alias("_p"), "symbol", F.col("s").alias("_s"), F.col("e").alias("_e"), "feature_path")
    on = (F.col("path") == F.col("_p")) & (F.col("start_line") <= F.col("_e")) & (F.col("_s") <= F.col("end_line"))
    x = hits.join(s, on, "left").withColumn("overlap", F.when(F.col("_p").isNull(), 0).otherwise(overlap_length(F.col("start_line"), F.col("end_line"), F.col("_s"), F.col("_e"))))
    w = Window.partitionBy("id").orderBy(F.desc("overlap"), "_s", "symbol")
    x = x.withColumn("_n", F.row_number().over(w)).where("_n = 1").join(files, "path", "left")
    return x.withColumn("feature_path", F.coalesce("feature_path", "file_feature")).drop("_p", "_s", "_e", "_n", "file_feature")
