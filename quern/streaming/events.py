"""File events: coalescing, and maintenance of an index from a stream.

Events are hints: what they trigger reads the truth again, and a batch reconcile repairs whatever they miss. A burst of
events of one path is one change: the last event counts, but a delete stays a delete whatever follows in the burst.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.functions.paths import base, is_supported

REMOVALS = ["delete", "rename"]


def relevant(events: DataFrame) -> DataFrame:
    """Events of visible files with an indexed extension."""
    hidden = F.rlike("path", F.lit(r"(^|/)\.[^/]"))
    return events.where(~hidden & is_supported(F.col("path")) & (base(F.col("path")) != ""))


def coalesce(events: DataFrame, gap: str = "500 milliseconds", watermark: str = "10 seconds") -> DataFrame:
    """path, start, end, event_type, n of each burst: events of a path with less than the gap between them."""
    x = events.withWatermark("ts", watermark) if events.isStreaming else events
    g = x.groupBy("path", F.session_window("ts", gap).alias("w"))
    last = F.max_by("event_type", F.struct("ts", "event_type"))
    kind = F.when(F.bool_or(F.col("event_type") == "delete"), "delete").otherwise(last)
    return g.agg(kind.alias("event_type"), F.count("*").alias("n")).select("path", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


STATE = "first double, last double, kind string, n long"
OUT = "path string, event_type string, n long"


def debounce(events: DataFrame, quiet_ms: int = 1000, max_ms: int = 10_000) -> DataFrame:
    """A burst is emitted after a quiet time, or when it has lasted ``max_ms``, by processing time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = float(state.getCurrentProcessingTimeMs())
        if state.hasTimedOut:
            first, last, kind, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], kind, n)], columns=["path", "event_type", "n"])
            return
        first, last, kind, n = state.get if state.exists else (now, now, "", 0)
        for pdf in batches:
            for t in pdf.sort_values("ts")["event_type"]:
                kind, n = kind if kind == "delete" else t, n + 1
        if now - first >= max_ms:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], kind, n)], columns=["path", "event_type", "n"])
            return
        state.update((first, now, kind, n))
        state.setTimeoutDuration(int(max(1, min(quiet_ms, first + max_ms - now))))

    return events.select("path", "event_type", "ts").groupBy("path").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each path in a batch, deletes sticky within their burst."""
    return changes.groupBy("path").agg(F.max_by("event_type", F.col("end")).alias("event_type"))


LEDGER = "number long, batch long, outcome string"


class Ledger:
    """What became of each attempt at a micro-batch, in a shared folder: a driver that starts anew goes on counting where the last one fell."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).json(self.folder)

    def write(self, batch: int, outcome: str) -> None:
        number = (self.rows().agg(F.max("number")).first()[0] or 0) + 1
        self.spark.createDataFrame([(number, batch, outcome)], LEDGER).coalesce(1).write.mode("append").json(self.folder)

    def done(self, batch: int) -> bool:
        return not self.rows().where((F.col("batch") == batch) & (F.col("outcome") != "failed")).isEmpty()

    def failures(self) -> int:
        """Since the last batch that was applied or rebuilt."""
        rows = self.rows()
        last = rows.where("outcome != 'failed'").agg(F.coalesce(F.max("number"), F.lit(0)).alias("last")).first()["last"]
        return rows.where(F.col("number") > last).count()


def maintain(changes: DataFrame, apply: Callable[[DataFrame, DataFrame], None], rebuild: Callable[[], None], checkpoint: str, limit: int = 128, max_failures: int = 3, available_now: bool = True) -> StreamingQuery:
    """Apply each micro-batch of changes: (changed paths, removed paths), or rebuild when there are too many or it failed too often.

    A failed batch ends the query; started again with its checkpoint, Spark gives the same batch once more. The ledger beside
    the checkpoint holds the failures so far, so ``max_failures`` in a row lead to one rebuild however often the driver went
    down between them, and a batch that was applied before the driver could commit it isn't applied twice. ``apply`` replaces
    what it writes by path, so a batch that broke off in the middle can be repeated.
    """
    ledger = Ledger(changes.sparkSession, f"{checkpoint}/ledger")

    def batch(df: DataFrame, number: int) -> None:
        if ledger.done(number):
            return
        df = df.persist()
        try:
            failed = ledger.failures()
            if failed < max_failures and df.select("path").distinct().limit(limit + 1).count() <= limit:
                gone = F.col("event_type").isin(REMOVALS)
                last = latest(df) if "end" in df.columns else df
                try:
                    apply(last.where(~gone).select("path").distinct(), last.where(gone).select("path").distinct())
                except Exception:
                    ledger.write(number, "failed")
                    if failed + 1 < max_failures:
                        raise
                else:
                    ledger.write(number, "applied")
                    return
            rebuild()
            ledger.write(number, "rebuilt")
        finally:
            df.unpersist()

    w = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="300 milliseconds")).start()
