"""Summaries of the feature hierarchy from the bottom up, by any summarizer of texts.

Each level is written before the next one reads it, so a category's context holds its subcategories' summaries. A run with
a folder goes on where an earlier one stopped: nodes that have a summary there, or already had one, are not asked for again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialize

#: Features and contexts of some nodes to their summaries, None for one that failed. Called in tasks, with ``BATCH`` nodes at most.
Summarizer = Callable[[list[str], list[str]], list[str | None]]
BATCH, TASK_ROWS = 16, 1000
KINDS = ("subcategory", "category", "area")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def contexts(parents: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """id, feature, context of the parents (id, feature, label): a line for each of the first children by id, with its summary if it has one."""
    links = edges.where(F.col("type").isin("feature_parent", "contains")).select(F.col("src").alias("id"), F.col("dst").alias("child")).distinct()
    x = links.join(parents.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("child"), F.col("feature").alias("own"), "summary"), "child")
    first = F.row_number().over(Window.partitionBy("id").orderBy("child"))
    x = x.withColumn("r", first).where(F.col("r") <= limit)
    line = F.concat(F.lit("- "), "own", F.when(_filled("summary"), F.concat(F.lit(": "), "summary")).otherwise(""), F.lit("\n"))
    lines = x.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("line")))), lambda c: c["line"]), "").alias("lines"))
    head = F.concat(F.lit("Node: "), "id", F.lit(" ("), "feature", F.lit(")\n"), F.when(_filled("label"), F.concat(F.lit("Label: "), "label", F.lit("\n"))).otherwise(""), F.lit("Children:\n"))
    return parents.join(lines, "id", "left").select("id", "feature", F.concat(head, F.coalesce("lines", F.lit(""))).alias("context"))


def in_order(asked: DataFrame, summarize: Summarizer, failures: int = 3) -> DataFrame:
    """id, summary of nodes (id, feature, context) before the first ``failures`` in a row in the order of ids fail.

    Tasks hold ranges of ids. One that sees so many failures in a row asks for no more; failures in a row across tasks are
    found afterwards, by joins on places, and what stands behind them is left out.
    """
    tasks = max(1, -(-asked.count() // TASK_ROWS))
    rows = asked.repartitionByRange(tasks, "id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id())

    def one(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = 0
        for batch in it:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                if bad < failures:
                    got = summarize(part.column("feature").to_pylist(), part.column("context").to_pylist())
                    for text in got:
                        bad = 0 if text is not None and bad < failures else bad + 1
                else:
                    got = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("id"), pa.array(got, pa.string())], ["at", "id", "summary"])

    found = materialize(rows.select("at", "id", "feature", "context").mapInArrow(one, "at long, id string, summary string"), "answers")
    part = F.shiftright("at", 33)
    sizes = found.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.expr("sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))  # a row for each task
    placed = found.withColumn("part", part).join(sizes.select("part", (before - F.col("least")).alias("shift")), "part").select("id", "summary", (F.col("at") + F.col("shift")).alias("place"))
    bad = placed.where("summary IS NULL").select("place")
    row = bad
    for k in range(1, failures):
        row = row.join(bad.select((F.col("place") + k).alias("place")), "place", "left_semi")
    trip = row.agg(F.min("place")).first()[0]
    kept = placed.where("summary IS NOT NULL")
    return (kept if trip is None else kept.where(F.col("place") <= trip)).select("id", "summary")


def summarize_levels(nodes: DataFrame, edges: DataFrame, summarize: Summarizer, folder: str | None = None, force: bool = False, failures: int = 3) -> DataFrame:
    """nodes (id, kind, feature, label, summary) with the summaries of subcategories, then categories, then areas.

    A node that has a summary keeps it unless ``force``. Without one it gets none if the summarizer failed for it or gave up on
    its level; a later run with the same folder asks for just these.
    """
    spark = nodes.sparkSession
    for kind in KINDS:
        mine = nodes.where(F.col("kind") == kind)
        todo = mine if force else mine.where(~_filled("summary"))
        earlier = None
        if folder is not None:
            spark.createDataFrame([], "id string, summary string").write.mode("append").parquet(f"{folder}/{kind}")
            earlier = spark.read.schema("id string, summary string").parquet(f"{folder}/{kind}")
            todo = todo.join(earlier.select("id"), "id", "left_anti")
        fresh = materialize(in_order(contexts(todo, nodes, edges), summarize, failures), f"summaries-{kind}")
        if folder is not None:
            fresh.write.mode("append").parquet(f"{folder}/{kind}")
            fresh = spark.read.schema("id string, summary string").parquet(f"{folder}/{kind}")
        nodes = nodes.join(fresh.select("id", F.col("summary").alias("_new")), "id", "left").withColumn("summary", F.coalesce("_new", "summary")).select(nodes.columns)
    return nodes
