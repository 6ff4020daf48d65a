"""Merkle manifest of a table, with a proof of every row from lookups by coordinate.

A row's leaf is the SHA-256 of its columns, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value. The
leaves of a group (``lang``) ascend by doc_id; every two neighbours become their hash, level by level, until one node, the
group's subroot, is left. The subroots of all groups, null first and then by their bytes, become the root in the same way.

Nodes are written as a table of coordinates: group, level, index. A leaf's index and the size of its group say which
coordinates hold its siblings; these are exploded, joined with the node table, put in order, concatenated and folded. Work
goes in strata of ``BITS`` levels: nodes are made in blocks of 2**BITS neighbours, and a row looks up the siblings of its
own stratum and takes those above from its ancestor at the stratum's top. So no node is asked for by more than 2**BITS
rows, however large a group is, and no row of the top levels is a hot key.

Positions come from a range sort: rows are numbered in their range, and the ranges' counts are summed for each group. Rows
that are alike in everything are counted where they are read, so a repeated row doesn't crowd a range.

Edge cases: any column may be null; null and empty values have different leaves; a null doc_id comes before all others;
rows with equal doc_id are ordered by their leaf, so the root doesn't depend on how the table is stored; rows alike in
everything are leaves of their own, with one result row each; a group of one row has its leaf as subroot and an empty proof;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch, documents

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a stratum; rows of a range.
BITS, RANGE_ROWS = 8, 250_000
TAMPER = 7


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a row as a binary digest, with some columns replaced."""
    return F.unhex(_hash(*(_part(changed.get(c, F.col(c))) for c in COLUMNS)))


def group_key(c: Column) -> Column:
    """A key that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def _height(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def positions(items: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """items (grp, the columns of order, and others) with idx, the place of a row in its group, and n, the group's size.

    ``copies`` (how many such rows there are) becomes that many rows.
    """
    items = scratch(items, "items")
    ranges = max(1, -(-(items.agg(F.sum("copies")).first()[0] or 0) // RANGE_ROWS))
    keys = ["grp", *order]
    rows = items.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = rows.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("_copy", "copies")
    at = F.monotonically_increasing_id()  # the range, and from bit 33 down the place in it
    rows = scratch(rows.withColumn("at", at), "ranges").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("grp", "part").agg(F.min("at").alias("least"), F.count("*").alias("c"))
    counts = scratch(counts, "counts")
    before = F.expr("sum(c) OVER (PARTITION BY grp ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    shift = counts.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("least")).alias("shift"), F.expr("sum(c) OVER (PARTITION BY grp)").alias("n"))
    return scratch(rows.join(shift, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift"), "leaves")


#: From the digests of a block's nodes to those of the ``m`` levels above, as an array of levels.
_LEVELS = f"""aggregate(slice(sequence(1, {BITS}), 1, m), array(nodes), (levels, k) -> concat(levels, array(
  transform(sequence(0, (size(element_at(levels, -1)) - 1) div 2),
    i -> sha2(concat(element_at(levels, -1)[2 * i], coalesce(get(element_at(levels, -1), 2 * i + 1), '')), 256)))))"""


def build(leaves: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The node table of leaves (grp, idx, n, hash): for each stratum its nodes (grp, n, level, idx, hash), the lowest level included."""
    strata = [leaves.select("grp", "n", F.lit(0).alias("level"), "idx", "hash")]
    top = leaves.agg(F.max(_height(F.col("n")))).first()[0] or 0
    for base in range(0, top, BITS):
        low = strata[-1].where((F.col("level") == base) & (_height(F.col("n")) > base))
        blocks = low.groupBy("grp", "n", F.shiftright("idx", BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("nodes"))
        blocks = blocks.select("grp", "n", "block", F.transform("nodes", lambda x: _hex(x["hash"])).alias("nodes"), F.least(F.lit(BITS), _height(F.col("n")) - base).alias("m"))
        made = blocks.select("grp", "n", "block", F.posexplode(F.expr(_LEVELS)).alias("k", "nodes")).where("k > 0")
        made = made.select("grp", "n", (F.col("k") + base).alias("level"), "block", "k", F.posexplode("nodes").alias("j", "hash"))
        index = F.expr(f"shiftleft(block, {BITS} - k) + j")
        strata.append(scratch(made.select("grp", "n", "level", index.alias("idx"), F.unhex("hash").alias("hash")), "nodes"))
    return strata


def roots(strata: list[DataFrame]) -> DataFrame:
    """grp and hash of each group's last node."""
    found = strata[0]
    for s in strata[1:]:
        found = found.unionByName(s)
    return found.where(F.col("level") == _height(F.col("n"))).select("grp", "hash")


def lookup(leaves: DataFrame, strata: list[DataFrame], above: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves with ``path``, the siblings (level, hash) from the lowest level up, and the columns of ``above`` (grp, ...)."""
    carried = [c for c in above.columns if c != "grp"]
    height = _height(F.col("n"))
    ends = strata[0].where("idx = 0").select("grp", "n")
    above = above.join(ends, "grp").select("grp", F.lit(0).cast("long").alias("up"), height.alias("_height"), F.expr("array()").cast("array<struct<level:int,hash:binary>>").alias("path"), *carried)
    found = None
    for s in range(max(1, len(strata) - 1) - 1, -1, -1):
        base = s * BITS
        # groups whose root is in this stratum take what is above from their root, others from the ancestor in the next stratum
        mine = above.where((F.col("_height") <= base + BITS) & ((F.col("_height") > base) | F.lit(s == 0))).drop("_height")
        if found is not None:
            mine = mine.unionByName(found.select("grp", F.col("idx").alias("up"), "path", *carried))
        units = leaves if s == 0 else strata[s].where((F.col("level") == base) & (height > base)).select("grp", "n", "idx")
        units = units if s else units.withColumn("_row", F.struct("grp", "idx"))
        level = F.explode(F.expr(f"slice(sequence({base}, {base + BITS - 1}), 1, least({BITS}, h - {base}))"))
        asked = units.select("grp", "n", "idx", height.alias("h")).where(F.col("h") > base).select("grp", "n", "idx", level.alias("level"))
        asked = asked.withColumn("sibling", F.expr(f"shiftright(idx, level - {base}) ^ 1L")).where("sibling <= shiftright(n - 1, level)")
        nodes = strata[0] if s == 0 else strata[s].where(F.col("level") == base)
        nodes = nodes if s + 1 >= len(strata) else nodes.unionByName(strata[s + 1].where(F.col("level") < base + BITS))
        nodes = nodes.select("grp", "level", F.col("idx").alias("sibling"), "hash")
        own = asked.join(nodes, ["grp", "level", "sibling"]).groupBy("grp", "idx").agg(F.array_sort(F.collect_list(F.struct("level", "hash"))).alias("own"))
        units = units.drop("_row").withColumn("up", F.shiftright("idx", BITS)).join(mine, ["grp", "up"]).join(own, ["grp", "idx"], "left")
        path = F.when(F.col("own").isNull(), F.col("path")).otherwise(F.concat("own", "path"))
        found = units.withColumn("path", path).drop("own", "up")
        found = scratch(found, "paths") if s else found
    return found


def fold(start: Column, idx: str, n: str, path: str) -> Column:
    """The root that a hex digest at idx of n leaves and its siblings lead to."""
    levels = F.expr(f"slice(sequence(0, 62), 1, length(bin({n} - 1)) * int({n} > 1))")

    def step(h: Column, k: Column) -> Column:
        other = F.get(F.filter(F.col(path), lambda x: x["level"] == k), F.lit(0))["hash"]
        left = F.expr(f"{idx}").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) == 0
        return F.when(other.isNull(), _hash(h)).when(left, _hash(h, _hex(other))).otherwise(_hash(_hex(other), h))

    return F.aggregate(levels, start, step)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings in order, as hex), the folded root and ``tampered``, the leaf that was folded."""
    scratch = Scratch()
    changed = F.crc32(F.col("doc_id").cast("string")) % TAMPER == 0
    rows = docs.select(*COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select(group_key(F.col("lang")).alias("grp"), "doc_id", leaf().alias("hash"), F.when(changed, leaf(n_chars=F.try_add(F.col("n_chars"), F.lit(1)))).alias("tampered"), F.spark_partition_id().alias("salt"))
    rows = rows.groupBy("grp", "doc_id", "hash", "tampered", "salt").agg(F.count("*").alias("copies"))
    leaves = positions(rows, ["doc_id", "hash", "salt"], scratch)
    strata = build(leaves, scratch)
    subroots = scratch(roots(strata), "subroots")

    one = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash", F.lit(1).cast("long").alias("copies"))
    tops = positions(one, ["name"], scratch)
    over = build(tops, scratch)
    root = roots(over).withColumnRenamed("hash", "root")
    tops = lookup(tops, over, root, scratch)
    tops = scratch(tops.select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "root", F.struct("idx", "n", "path").alias("top")), "tops")

    x = lookup(leaves, strata, tops, scratch)
    x = x.withColumns({"top_idx": F.col("top.idx"), "top_n": F.col("top.n"), "top_path": F.col("top.path")})
    x = x.withColumn("folded", fold(_hex(F.coalesce("tampered", "hash")), "idx", "n", "path"))
    siblings = F.array_join(F.transform(F.concat("path", "top_path"), lambda s: _hex(s["hash"])), "")
    out = x.select("doc_id", _hex(F.col("hash")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), siblings.alias("proof"), fold(F.col("folded"), "top_idx", "top_n", "top_path").alias("folded_root"), F.col("tampered").isNotNull().alias("tampered"))
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = manifest(documents(spark, sf_dir, *COLUMNS))
    return x.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_part(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _sql_leaf(**changed: str) -> str:
    return "sha256(" + " || ".join(_sql_part(changed.get(c, c)) for c in COLUMNS) + ")"


#: CRC-32 of a number's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295::BIGINT)"""


def _tree_sql(name: str, source: str) -> str:
    """CTEs: all nodes of the trees over a table (grp, idx, n, h), and each leaf's folds from ``start``."""
    return f"""{name}_t(grp, level, idx, n, h) AS (SELECT grp, 0, idx, n, h FROM {source} UNION ALL
 SELECT grp, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name}_t WHERE n > 1 GROUP BY grp, level, idx // 2, n),
{name}_f(grp, leaf, level, n, cur, proof) AS (SELECT grp, idx, 0, n, start, '' FROM {source} UNION ALL
 SELECT f.grp, f.leaf, f.level + 1, (f.n + 1) // 2, sha256(CASE WHEN (f.leaf >> f.level) % 2 = 0 THEN cur || coalesce(s.h, '') ELSE s.h || cur END), proof || coalesce(s.h, '')
 FROM {name}_f f LEFT JOIN {name}_t s ON s.grp = f.grp AND s.level = f.level AND s.idx = xor(f.leaf >> f.level, 1::BIGINT) WHERE f.n > 1)"""


OP11_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {_sql_leaf()} AS h, CASE WHEN {_CRC} % {TAMPER} = 0 THEN {_sql_leaf(n_chars="(n_chars + 1)")} END AS changed FROM documents),
p AS (SELECT doc_id, grp, h, coalesce(changed, h) AS start, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM l),
{_tree_sql("low", "p")},
sub AS (SELECT grp, h FROM low_t WHERE n = 1),
q AS (SELECT '' AS grp, grp AS name, h, h AS start, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM sub),
{_tree_sql("top", "q")},
root AS (SELECT h FROM top_t WHERE n = 1),
tp AS (SELECT name, q.h AS subroot, q.idx, q.n, f.proof FROM q JOIN top_f f ON f.leaf = q.idx WHERE f.n = 1),
done AS (SELECT p.doc_id, p.h AS leaf, tp.subroot, tp.idx AS top, tp.n AS top_n, f.proof || tp.proof AS proof, f.cur FROM p JOIN low_f f ON f.grp = p.grp AND f.leaf = p.idx AND f.n = 1 JOIN tp ON tp.name = p.grp),
g(k, doc_id, leaf, subroot, proof, top, n, level, cur) AS (SELECT row_number() OVER (), doc_id, leaf, subroot, proof, top, top_n, 0, cur FROM done UNION ALL
 SELECT k, doc_id, leaf, subroot, proof, top, (g.n + 1) // 2, g.level + 1, sha256(CASE WHEN (top >> g.level) % 2 = 0 THEN cur || coalesce(s.h, '') ELSE s.h || cur END)
 FROM g LEFT JOIN top_t s ON s.level = g.level AND s.idx = xor(top >> g.level, 1::BIGINT) WHERE g.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM root) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT h FROM root) AS verified FROM g WHERE n = 1
"""
