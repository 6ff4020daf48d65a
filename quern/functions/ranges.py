"""Points in ranges by aligned blocks, so that these are found by equi-joins and not among all pairs of a file.

A block of level k holds 2^k integers and begins at a multiple of 2^k. A range is the union of at most two blocks a level,
and a point lies in one block of each level: a point and a range that holds it share exactly one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = ["_level", "_block"]
PIECE = 256  #: rows of an equal range that meet others as one; two pieces make at most its square of pairs
SALTS = 1024  #: keys over which the rows of an equal range are gathered
ROWS = 20_000  #: rows of the first side for each task that makes pairs


def blocks(start: Column, stop: Column) -> Column:
    """Structs of level and block that hold each integer from start to before stop once; none for empty ranges."""
    a, b = start.cast("long"), stop.cast("long")

    def of(k: Column) -> Column:
        low, high = -F.call_function("shiftright", -a, k), F.call_function("shiftright", b, k)
        block = lambda odd, at: F.when((low < high) & (odd.bitwiseAND(F.lit(1).cast("long")) == 1), F.struct(k.alias("_level"), at.alias("_block")))
        return F.array(block(low, low), block(high, high - 1))

    return F.when(a < b, F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(b - a)) - 1), of))))


def spread(ranges: DataFrame, start: Column, stop: Column) -> DataFrame:
    """Ranges, a row for each of their blocks."""
    return ranges.select("*", F.inline(blocks(start, stop)))


def located(points: DataFrame, pos: Column, spread: DataFrame) -> DataFrame:
    """Points, a row for the block of each level that any of the spread ranges has (63 at most)."""
    levels = F.broadcast(spread.agg(F.collect_set("_level").alias("_levels")))
    x = points.crossJoin(levels).select(*points.columns, F.explode("_levels").alias("_level"))
    return x.withColumn("_block", F.call_function("shiftright", pos.cast("long"), F.col("_level")))


def packed(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """Rows in pieces of equal by: an array (name) of at most PIECE structs of the other columns.

    They are gathered over SALTS keys first, and only lists shorter than a piece are joined, so no array has a whole large group.
    """
    row = F.struct(*[F.col(c) for c in rows.columns if c not in by])
    x = rows.groupBy(*by, F.pmod(F.xxhash64(row), F.lit(SALTS)).alias("_salt")).agg(F.collect_list(row).alias(name))
    x = x.groupBy(*by, F.when(F.size(name) >= PIECE, F.col("_salt")).alias("_salt")).agg(F.flatten(F.collect_list(name)).alias(name))
    return x.select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.size(name), F.lit(PIECE)), lambda i: F.slice(name, i, PIECE))).alias(name))


def overlapping(a: DataFrame, b: DataFrame, *keys: str, made: dict[str, Column] | None = None) -> DataFrame:
    """Rows of a (keys, s, e) with those of b (keys, s2, e2) whose ranges, ends included, share an integer; each pair once.

    Either the second range begins in the first, or the first begins behind the second's start and in it. Rows of equal
    ranges meet in pieces, and their pairs are made behind the join; columns to be made of keys and ends are made once for
    two pieces. AQE would size the tasks by their input, which tells nothing of the pairs they make, so the pieces that met
    are dealt over a given number of tasks; it grows with the rows of a, which are counted for it.
    """
    left, right = packed(a, "_a", *keys, "s", "e"), packed(b, "_b", *keys, "s2", "e2")
    of_a, of_b = (F.col("s"), F.col("e") + 1), (F.col("s2") + 1, F.col("e2") + 1)
    first, second = spread(left, *of_a), spread(right, *of_b)
    x = first.join(located(right, F.col("s2"), spread(a.select("s", "e"), *of_a)), [*keys, *BLOCK]).where("s <= e2")
    y = located(left, F.col("s"), spread(b.select("s2", "e2"), *of_b)).join(second, [*keys, *BLOCK]).where("s2 <= e")
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-a.count() // ROWS))
    ends = [*keys, "s", "e", "s2", "e2"]
    x = x.unionByName(y).select(*ends, *[c.alias(n) for n, c in (made or {}).items()], "_a", "_b")
    x = x.repartition(tasks, *ends, F.col("_a")[0], F.col("_b")[0])
    return x.select("*", F.inline("_a")).drop("_a").select("*", F.inline("_b")).drop("_b")
