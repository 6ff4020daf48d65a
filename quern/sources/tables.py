"""Line-delimited statistics, snapshots, and result encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

ENTRY = "timestamp string, command_type string, output_mode string, result_count int, output_tokens int, grep_tokens int"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Usage entries; blank and malformed lines are skipped, a missing file is empty."""
    try:
        return spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ENTRY)


def append_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def encode_json(hits: DataFrame, compact: bool = False) -> DataFrame:
    """One JSON object a hit; compact leaves the content out."""
    columns = [c for c in hits.columns if not (compact and c == "content")]
    return hits.select(F.to_json(F.struct(*columns)).alias("json"))


def toon_header(hits: DataFrame, name: str = "results") -> str:
    """The line that names the fields."""
    return f"{name}{{{','.join(hits.columns)}}}:"


def encode_toon(hits: DataFrame) -> DataFrame:
    """One line of comma-separated values a hit; values with commas, quotes or line breaks are JSON strings."""

    def value(c: str):
        s = F.col(c).cast("string")
        quoted = F.regexp_extract(F.to_json(F.array(s)), r"^\[(.*)\]$", 1)
        return F.when(s.isNull(), "null").when(F.rlike(s, F.lit('[,"\\n]')), quoted).otherwise(s)

    return hits.select(F.concat(F.lit("  "), F.concat_ws(",", *(value(c) for c in hits.columns))).alias("line"))
