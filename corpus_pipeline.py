"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing and packing of ``documents``.

Each stage gets the documents its predecessor kept, as a written table, and returns the ones it keeps with the same
columns; the last returns the packed pieces. Documents that the lexicon scores as toxic go; lines of templates that
recur across documents stay once; one document of each near-duplicate component stays; documents of likely high
quality stay at least once while rates bring the quality domains to their target shares; the rest is packed.

Edge cases are those of the operators: an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import line_dedup, mixing, near_dup, packing, toxicity
from quern.session import materialize, ship, table

#: No SQL: learned scores, random trees and iterated rates; the stages are tested against brute-force versions.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, table(spark, sf_dir, "labels"), protect=(1,), keep_likely=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-dedup", near), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
