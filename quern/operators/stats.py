"""Usage statistics, index statistics and token estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that the entries use, and the price of a million tokens.
COMMANDS = ["search", "trace-callers", "trace-callees", "trace-graph"]
MODES = ["full", "compact", "toon"]
CLOUD = ["openai", "openrouter", "synthetic"]
COST_PER_MTOKEN = 5.0


def summarize(entries: DataFrame, provider: str, commands: list[str] = COMMANDS, modes: list[str] = MODES, cost: float = COST_PER_MTOKEN) -> DataFrame:
    """One row of totals with counts by command and mode; known ones are there even at zero, unknown ones when they occur."""
    totals = entries.agg(F.count("*").alias("total_queries"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"), F.coalesce(F.sum("grep_tokens"), F.lit(0)).cast("long").alias("grep_tokens"))

    def counts(column: str, known: list[str]) -> DataFrame:
        zero = entries.sparkSession.createDataFrame([(k,) for k in known], "key string").withColumn("n", F.lit(0).cast("long"))
        c = entries.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).unionByName(zero).groupBy("key").agg(F.sum("n").alias("n"))
        return c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(f"by_{column}"))

    saved = F.col("grep_tokens") - F.col("output_tokens")
    x = totals.withColumn("tokens_saved", saved).withColumn("savings_pct", F.when(F.col("grep_tokens") > 0, saved / F.col("grep_tokens") * 100).otherwise(0.0))
    x = x.withColumn("cost_saved_usd", F.col("tokens_saved") / 1_000_000 * cost if provider in CLOUD else F.lit(None).cast("double"))
    return x.join(counts("command_type", commands)).join(counts("output_mode", modes))  # three single rows


def history(entries: DataFrame) -> DataFrame:
    """Totals by day, from the first ten characters of the time stamp; newest first."""
    day = F.when(F.octet_length("timestamp") >= 10, F.substring("timestamp", 1, 10)).otherwise("unknown")
    x = entries.groupBy(day.alias("date")).agg(F.count("*").alias("query_count"), F.sum("output_tokens").cast("long").alias("output_tokens"), F.sum("grep_tokens").cast("long").alias("grep_tokens"))
    return x.withColumn("tokens_saved", F.col("grep_tokens") - F.col("output_tokens")).orderBy(F.desc("date"))


def index_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    c = chunks.agg(F.count("*").alias("total_chunks"), F.max("updated_at").alias("last_updated"))
    return documents.agg(F.count("*").alias("total_files")).join(c)


def file_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.count("*").alias("chunk_count"))


def symbol_stats(symbols: DataFrame, refs: DataFrame, updated: str = "") -> DataFrame:
    """Totals, and the last value of the column ``updated`` if named."""
    last = [F.max(updated).alias("last_updated")] if updated else []
    return symbols.agg(F.count("*").alias("total_symbols"), F.countDistinct("file").alias("total_files"), *last).join(refs.agg(F.count("*").alias("total_references")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals and counts by kind and type, as maps in key order."""

    def by(df: DataFrame, column: str, name: str) -> DataFrame:
        x = df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
        return x.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(f"total_{name}"))

    return by(nodes, "kind", "nodes").join(by(edges, "type", "edges"))
