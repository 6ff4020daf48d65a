"""Files as DataFrames: metadata and content scans, ignore rules, git listings."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import hashing as H
from quern.functions import paths as P


def _binary(spark: SparkSession, root: str) -> DataFrame:
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    whole = re.sub(r"^file:/*", "/", root).rstrip("/")
    return x.withColumn("path", F.substring_index(F.col("path"), f"{whole}/", -1))


def scan_metadata(spark: SparkSession, root: str, rules: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """path, size, mtime of indexable files, and the skipped ones with a reason; contents are not read."""
    x = _binary(spark, root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if rules:
        x = x.join(ignored_paths(x, _rules(spark, rules)).withColumn("ignored", F.lit(True)), "path", "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))
    else:
        x = x.withColumn("ignored", F.lit(False))
    p = F.col("path")
    reason = F.when(F.col("ignored"), "ignored").when(~P.is_supported(p), "extension").when(P.is_minified(p), "minified").when(F.col("size") > P.MAX_BYTES, "size")
    x = x.withColumn("reason", reason).drop("ignored")
    return x.where("reason IS NULL").drop("reason"), x.where("reason IS NOT NULL").select("path", "reason")


def scan(spark: SparkSession, root: str, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Indexable text files with content and its sha256, in one scan: contents of files that the metadata rules out go no further."""
    x = _binary(spark, root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("data"))
    p = F.col("path")
    x = x.where(P.is_supported(p) & ~P.is_minified(p) & (F.col("size") <= P.MAX_BYTES) & ~P.is_binary(F.col("data")))
    if rules:  # judged by a listing of its own, which reads no contents
        x = x.join(ignored_paths(_binary(spark, root).select("path"), _rules(spark, rules)), "path", "left_anti")
    return x.select("path", "size", "mtime", F.sha2("data", 256).alias("hash"), F.col("data").cast("string").alias("content"))


def scan_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """One file by its path, whatever its extension and the ignore rules; none if it is minified, too large or binary."""
    x = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").select(F.lit(path).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("data"))
    x = x.where(~P.is_minified(F.col("path")) & (F.col("size") <= P.MAX_BYTES) & ~P.is_binary(F.col("data")))
    return x.select("path", "size", "mtime", F.sha2("data", 256).alias("hash"), F.col("data").cast("string").alias("content"))


def filesystem_truth(spark: SparkSession, root: str) -> DataFrame:
    """path, hash of every regular file but git's own."""
    x = _binary(spark, root).where(~F.rlike("path", F.lit(r"(^|/)\.git/")))
    return x.select("path", F.sha2("content", 256).alias("hash"))


def worktree_id(common_dir: str) -> str:
    """Twelve hex digits that name a repository by its common git folder."""
    return hashlib.sha256(common_dir.encode()).hexdigest()[:12]


def verified(files: DataFrame, desired: DataFrame) -> DataFrame:
    """Files whose sha256 or git name is the desired one."""
    x = files.join(desired.select("path", "desired_hash"), "path")
    return x.where((F.col("hash") == F.col("desired_hash")) | (H.blob_oid(F.col("content")) == F.col("desired_hash")))


def git_truth(staged: DataFrame, modified: DataFrame, deleted: DataFrame, untracked: DataFrame) -> DataFrame:
    """path, oid from four listings: staged names, working contents of modified and untracked files, deleted paths."""
    x = staged.join(modified.select("path", F.col("oid").alias("_work")), "path", "left").join(deleted.select("path"), "path", "left_anti")
    x = x.select("path", F.coalesce("_work", "oid").alias("oid"))
    return x.unionByName(untracked.select("path", "oid"))


#: Pieces of an ignore pattern: stars with and without slashes, one character, a class, an escaped character, any other.
_PIECES = r"(?s)(\*\*/|/\*\*$|\*\*|\*|\?|\[.[^\]]*\]|\\.|.)"
#: Copies of the rules of a folder, so that the root's rules don't meet all paths in one task.
SALTS = 32


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\p{L}\p{N}/_])", r"\\$1")


def ignore_rules(rules: DataFrame) -> DataFrame:
    """folder, rank, regex, negated, dirs_only of rules (folder of the ignore file, pattern, number: the place in the file).

    The regex is for a path below the folder. Comments and empty patterns are no rules; a later rule of a deeper file ranks higher.
    """
    p = F.trim("pattern")
    x = rules.where((p != "") & ~F.startswith(p, F.lit("#"))).select("folder", "number", p.alias("p"))
    x = x.withColumn("negated", F.startswith("p", F.lit("!"))).withColumn("p", F.when(F.col("negated"), F.expr("substr(p, 2)")).otherwise(F.col("p")))
    x = x.withColumn("p", F.regexp_replace("p", r"^\\([!#])", "$1")).withColumn("dirs_only", F.endswith("p", F.lit("/")))
    x = x.withColumn("p", F.rtrim("p", F.lit("/"))).withColumn("anchored", F.contains("p", F.lit("/"))).withColumn("p", F.ltrim("p", F.lit("/")))

    def piece(t: Column) -> Column:
        inside = F.regexp_replace(F.regexp_replace(F.substr(t, F.lit(2), F.length(t) - 2), r"([\[\]&\\])", r"\\$1"), r"^[!^]", "^")
        other = F.when(F.startswith(t, F.lit("\\")) & (F.length(t) == 2), _quoted(F.substr(t, F.lit(2)))).otherwise(_quoted(t))
        of_class = F.startswith(t, F.lit("[")) & (F.length(t) > 2)
        return F.when(t == "**/", "(?:.*/)?").when(t == "/**", "/.+").when(t == "**", ".*").when(t == "*", "[^/]*").when(t == "?", "[^/]").when(of_class, F.concat(F.lit("["), inside, F.lit("]"))).otherwise(other)

    regex = F.concat(F.when(F.col("anchored"), "^").otherwise("^(?:.*/)?"), F.array_join(F.transform(F.regexp_extract_all("p", F.lit(_PIECES), 1), piece), ""), F.lit("$"))
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return x.select("folder", F.struct(depth.alias("depth"), F.col("number").alias("number")).alias("rank"), regex.alias("regex"), "negated", "dirs_only")


def ignored_paths(paths: DataFrame, rules: DataFrame, extra_dirs: list[str] | None = None) -> DataFrame:
    """The paths (path, distinct) that nested ignore files (rules: folder, pattern, number) rule out.

    The last matching rule of the deepest file decides on a file or folder; nothing inside an ignored folder comes back. A
    path's folders are judged once for all paths in them: each goes to the rules of the folders above it by an equi-join.
    """
    every = paths.select("path").distinct()
    at = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    steps = every.select("path", F.explode(at).alias("prefix"))
    judged = steps.select("prefix", (F.col("prefix") != F.col("path")).alias("is_dir")).distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("prefix", "/")) - 1), lambda n: F.array_join(F.slice(F.split("prefix", "/"), F.lit(1), n), "/"))
    asked = judged.select("prefix", "is_dir", F.explode(above).alias("folder")).withColumn("salt", F.pmod(F.xxhash64("prefix"), F.lit(SALTS)))
    given = ignore_rules(rules).withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    below = F.when(F.col("folder") == "", F.col("prefix")).otherwise(F.expr("substr(prefix, length(folder) + 2)"))
    met = asked.join(given, ["folder", "salt"]).where((F.col("is_dir") | ~F.col("dirs_only")) & F.rlike(below, F.col("regex")))
    blocked = met.groupBy("prefix", "is_dir").agg(F.max_by("negated", "rank").alias("negated")).where("NOT negated").select("prefix", "is_dir")
    out = steps.withColumn("is_dir", F.col("prefix") != F.col("path")).join(blocked, ["prefix", "is_dir"], "left_semi").select("path")
    if extra_dirs:
        out = out.union(every.where(F.arrays_overlap(F.expr("slice(split(path, '/'), 1, size(split(path, '/')) - 1)"), F.lit(list(extra_dirs)))))
    return out.distinct()


def _rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(folder, pattern, i) for i, (folder, pattern) in enumerate(rules)], "folder string, pattern string, number long")
