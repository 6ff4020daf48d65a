"""Registration of queries and the bindings of the driver's tables to the library's shapes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put


def doc_path():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


DOC_PATH = "concat(source, '/', lang, '/doc_', doc_id, '.txt')"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """embeddings as chunks: id, path, vector, label."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), vec_path().alias("path"), F.col("embedding").alias("vector"), "label")


_FOLDERS = ["src", "docs", "lib", "tests", "pkg", "testdata"]


def vec_path():
    """label_3/src/f7.go and the like: two chunks a file, in six kinds of folder."""
    folder = F.element_at(F.lit(_FOLDERS), (F.col("vec_id") % 6 + 1).cast("int"))
    return F.concat(F.lit("label_"), F.col("label").cast("string"), F.lit("/"), folder, F.lit("/f"), F.floor(F.col("vec_id") / 12).cast("string"), F.when(F.col("vec_id") % 4 == 3, "_test.go").otherwise(".go"))


VEC_PATH = f"concat('label_', label, '/', {_FOLDERS}[(vec_id % 6 + 1)::INT], '/f', vec_id // 12, CASE WHEN vec_id % 4 = 3 THEN '_test.go' ELSE '.go' END)"


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


#: Cosine score of every embedding to that of vec_id 0, as a CTE.
SCORED = f"""q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
scored AS (SELECT vec_id AS id, {VEC_PATH} AS path, label,
  coalesce(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 0)::FLOAT AS score FROM embeddings, q)"""


def rounded(df: DataFrame, *columns: str, digits: int | None = None) -> DataFrame:
    """The columns as doubles, rounded if asked; sums of products of floats are the same on both sides as they are."""
    return df.withColumns({c: F.col(c).cast("double") if digits is None else F.round(F.col(c).cast("double"), digits) for c in columns})


#: Blank characters, as a class of DuckDB's regexes; \x01 pads characters to their number of bytes.
_BLANK = r"[\s\x0b\x01\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def chunk_sql(files: str) -> str:
    """CTEs that cut a table of that name (path, text) into chunks: piece (path, ordinal, pos, stop, content, before).

    Characters of several bytes are padded, so positions are those of bytes; a window that ends or begins on padding
    moves behind it.
    """
    padded = f"regexp_replace(regexp_replace(regexp_replace(text, '([\\x{{80}}-\\x{{7ff}}])', '\\1' || chr(1), 'g'), '([\\x{{800}}-\\x{{ffff}}])', '\\1' || chr(1) || chr(1), 'g'), '([\\x{{10000}}-\\x{{10ffff}}])', '\\1' || chr(1) || chr(1) || chr(1), 'g')"
    up = lambda at: f"({at} + length(regexp_extract(substr(t, ({at}) + 1, 3), '^\\x01*')))"
    blank = f"regexp_matches(substr(t, p + 1, s - p), '^{_BLANK}*$')"
    window = f"""SELECT *, CASE WHEN cut < n AND contains(substr(t, p + 2, cut - p - 1), chr(10)) THEN cut - strpos(reverse(substr(t, p + 1, cut - p)), chr(10)) + 1 ELSE cut END AS s FROM
  (SELECT *, {up("least(p + 2048, n)")} AS cut FROM"""
    return f"""pad_ AS (SELECT path, {padded} AS t FROM {files}), sized_ AS (SELECT path, t, length(t) AS n FROM pad_ WHERE length(t) > 0),
cut_(path, t, n, p, s, blank, k) AS (
 SELECT path, t, n, p, s, {blank}, 0::BIGINT FROM ({window} (SELECT path, t, n, 0::BIGINT AS p FROM sized_)))
 UNION ALL
 SELECT path, t, n, p, s, {blank}, k FROM ({window} (SELECT path, t, n, CASE WHEN blank OR s - 200 <= p THEN s ELSE {up("s - 200")} END AS p, k + (NOT blank)::BIGINT AS k FROM cut_)) WHERE p < n)),
piece AS (SELECT path, k AS ordinal, p AS pos, s AS stop, replace(substr(t, p + 1, s - p), chr(1), '') AS content, substr(t, 1, p) AS before, substr(t, 1, s - 1) AS until FROM cut_ WHERE NOT blank)"""
