"""Tables for reads by key: hash buckets as folders, sorted by key in each, with bloom filters.

A read of one or a few keys lists only their buckets' folders, skips row groups by the keys' ranges, since rows are sorted,
and by the bloom filter, and reads the columns that are asked for. Nothing else of the table is touched, whatever its size.
The number of buckets is part of the table and follows from its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a bucket; bytes of a row group.
BUCKET_ROWS, ROW_GROUP = 250_000, 8 << 20
META = "keys array<string>, buckets long"


def _bucket(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: list[str], rows: int = BUCKET_ROWS) -> None:
    """Write df under path. Rows of one key are in one bucket, in several files if there are very many (``rebalance`` splits them)."""
    spark = df.sparkSession
    buckets = max(1, -(-df.count() // rows))
    x = df.withColumn("bucket", _bucket([F.col(k) for k in keys], buckets)).hint("rebalance", "bucket")
    w = x.sortWithinPartitions("bucket", *keys).write.option("parquet.block.size", ROW_GROUP).option("maxRecordsPerFile", 4 * rows)
    for k in keys:
        w = w.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.expected.ndv#{k}", str(rows))
    w.partitionBy("bucket").parquet(f"{path}/rows")
    spark.createDataFrame([(keys, buckets)], META).coalesce(1).write.json(f"{path}/meta")


class Keyed:
    """A table that ``write_keyed`` has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        meta = spark.read.schema(META).json(f"{path}/meta").first()
        self.keys, self.buckets = list(meta["keys"]), meta["buckets"]
        self.rows = spark.read.parquet(f"{path}/rows")

    def get(self, **key) -> DataFrame:
        """The rows of one key, given whole by the names of its columns."""
        if set(key) != set(self.keys):
            raise ValueError(f"the key is {', '.join(self.keys)}")
        kinds = dict(self.rows.dtypes)
        values = [F.lit(key[k]).cast(kinds[k]) for k in self.keys]
        x = self.rows.where(F.col("bucket") == _bucket(values, self.buckets))
        for k, v in zip(self.keys, values, strict=True):
            x = x.where(F.col(k) == v)
        return x.drop("bucket")

    def get_all(self, keys: DataFrame) -> DataFrame:
        """The rows of many keys (a table with the key's columns): buckets meet buckets, so only those with a key are read."""
        wanted = keys.select(*self.keys).distinct().withColumn("bucket", _bucket([F.col(k) for k in self.keys], self.buckets))
        return self.rows.join(wanted, ["bucket", *self.keys]).select(*(c for c in self.rows.columns if c != "bucket"))
