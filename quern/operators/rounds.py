"""Work on rows that may fail: a result or an error for each row, further rounds for what failed, dead letters for the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quern.operators import catalog as C
from quern.session import materialize

#: Rows (as dicts) and the number of the round, from 1, to a result for each; an exception fails them all.
Work = Callable[[list[dict], int], list]
BATCH = 64


class Permanent(Exception):
    """A failure that trying again won't mend."""


def attempt(rows: DataFrame, work: Work, result: str, number: int = 1) -> DataFrame:
    """rows with ``result`` (of the SQL type), and ``error`` and ``permanent`` where there is none.

    Rows are worked on in small batches; one that fails is tried again row by row, so a bad row costs its neighbours nothing.
    """
    kind = T._parse_datatype_string(result)
    schema = T.StructType([*rows.schema.fields, T.StructField("result", kind), T.StructField("error", T.StringType()), T.StructField("permanent", T.BooleanType())])

    def one(part: list[dict]) -> list[tuple]:
        try:
            return [(r, None, None) for r in work(part, number)]
        except Exception as e:
            if len(part) == 1:
                return [(None, f"{type(e).__name__}: {e}", isinstance(e, Permanent))]
        return [x for row in part for x in one([row])]

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                got = one(part.to_pylist())
                more = [pa.array([g[0] for g in got], to_arrow_type(kind)), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "result", "error", "permanent"])

    return rows.mapInArrow(each, schema)


def rounds(todo: DataFrame, work: Work, result: str, attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """The rows with their results, and dead letters: rows that failed for good or in all rounds, with attempts and the last error.

    Each round is written and reads only what failed in the one before.
    """
    done, dead = [], []
    for number in range(1, attempts + 1):
        got = materialize(attempt(todo, work, result, number), "round")
        done.append(got.where("error IS NULL").drop("error", "permanent"))
        last = number == attempts
        gone = F.col("error").isNotNull() & (F.col("permanent") | F.lit(last))
        dead.append(got.where(gone).drop("result", "permanent").withColumn("attempts", F.lit(number)))
        todo = got.where("error IS NOT NULL AND NOT permanent").select(todo.columns)
        if last or todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, dead)


def index_once(view: DataFrame, desired: DataFrame, work: Work, result: str, attempts: int = 5) -> tuple[DataFrame, DataFrame]:
    """The view (path, hash, result) after one index run over desired (path, hash, and what the work reads), and the dead letters.

    Paths that aren't desired any more go, those with another hash are worked on; where that fails the old row stays.
    """
    plan = materialize(C.reconcile(desired, view), "plan")
    todo = desired.join(plan.where("op = 'UPSERT'").select("path"), "path", "left_semi")
    done, dead = rounds(todo, work, result, attempts)
    kept = view.join(plan.where("op = 'DELETE'").select("path"), "path", "left_anti").select("path", "hash", "result")
    return C.upsert(kept, done.select("path", "hash", "result"), ["path"]), dead.select("path", "hash", "attempts", "error")
