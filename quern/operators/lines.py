"""Line maps: from the lines of an extracted text to those of its source, for whole tables.

A map is kept as runs: a run's lines all moved by the same number. A table's lines find their run by a join on the path
and the run's bounds, so a map of a file costs a row for each run, not for each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(lines: DataFrame) -> DataFrame:
    """path, start, stop, shift of a map (path, line, source); lines without a source line, or below 1, have none."""
    x = lines.where("line >= 1 AND source >= 1").groupBy("path", "line").agg(F.min("source").alias("source"))
    shift = F.col("source") - F.col("line")
    place = F.row_number().over(Window.partitionBy("path", "shift").orderBy("line"))
    x = x.withColumn("shift", shift).withColumn("run", F.col("line") - place)  # neighbouring lines of one shift have one number
    return x.groupBy("path", "shift", "run").agg(F.min("line").alias("start"), F.max("line").alias("stop")).select("path", "start", "stop", "shift")


def remap(rows: DataFrame, mapped: DataFrame, *columns: str) -> DataFrame:
    """rows (path and line columns) with those lines in the source; a line without a run is 0, files without a map stay as they are."""
    files = mapped.select("path").distinct().withColumn("_has", F.lit(True))
    x = rows.join(files, "path", "left")
    for c in columns:
        run = mapped.select(F.col("path").alias("_path"), "start", "stop", "shift")
        x = x.join(run, (F.col("path") == F.col("_path")) & F.col(c).between(F.col("start"), F.col("stop")), "left")
        x = x.withColumn(c, F.when(F.col("_has").isNull(), F.col(c)).otherwise(F.coalesce(F.col(c) + F.col("shift"), F.lit(0)))).drop("_path", "start", "stop", "shift")
    return x.select(rows.columns)


def joined(first: DataFrame, second: DataFrame) -> DataFrame:
    """The runs of a map and a further one of the same paths behind it: from the first's lines to the second's sources."""
    a = first.select("path", F.col("start").alias("a0"), F.col("stop").alias("a1"), F.col("shift").alias("sa"))
    x = a.join(second, "path").where("a0 + sa <= stop AND start <= a1 + sa")
    low, high = F.greatest(F.col("a0"), F.col("start") - F.col("sa")), F.least(F.col("a1"), F.col("stop") - F.col("sa"))
    return x.select("path", low.alias("start"), high.alias("stop"), (F.col("sa") + F.col("shift")).alias("shift"))
