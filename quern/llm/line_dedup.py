"""Line dedup by a log-template tree, on DataFrame functions only.

A line's variable fields (numbers, hexadecimal runs, addresses) become marks. A template recurs when enough different
texts have it: ``MIN_TEXTS``, or fewer the longer the line, down to two from ``LONG`` / 2 tokens on. Masked lines that recur
are templates of their own. The others go down a tree of fixed depth: first the token count, then the leading ``DEPTH``
tokens. A leaf holds any number of templates: a token that enough of the leaf's texts have at its position is fixed, the
others are variable fields, and lines with the same fixed tokens, at least ``SIMILAR`` of all, are of one template. Fields
that take a few frequent values are generalised by asking for 4, 16, ... times as many texts; a line belongs to the
strictest template that enough texts share. Exact copies of a text count once, so a copied document doesn't make its own
lines templates, and a text has one vote for each token. Of a template the lines of the document with the smallest doc_id
stay, and all others are dropped. Lines of fewer than ``min_tokens`` tokens are left alone; with 1 all lines are judged.

Lines, tokens and templates are told apart by two hashes of 64 bits with different seeds. Only these are shuffled; the
lines are written beside them once, and read again in leaves that enough texts share. There each different line is cut into
tokens: small leaves within a task, without a shuffle of tokens; others, and those of which a text has several lines, over all
tasks. Counts are partial sums; joins on lines, tokens and templates go through ``split_join``, so a line that a third of all
texts hold is spread over all tasks. Written tables go once their readers are done, so they don't add to the shuffle of texts.

Edge cases: null and empty texts have no lines and are returned as they are; documents that lose every line are dropped
by ``dedup`` but kept, with an empty text, by ``clean``; rows with equal doc_id and text are treated alike; rows without a
doc_id come after all others, so their lines are the last to stay; extra columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import HOT, HOT_KEYS, Scratch, documents, split_join

DEPTH, MIN_TEXTS, LONG, MIN_TOKENS, SIMILAR = 4, 5, 100, 3, 0.8
LAST = 2**63 - 1
#: Lines of 16 bytes each that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Tokens of a leaf that one task takes at most, and of leaves that it takes together; larger leaves are dealt over tasks.
LEAF_TOKENS, TASK_TOKENS = 100_000, 250_000


def _any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def _odd_space(text: Column) -> Column:
    """White space other than single spaces between words."""
    return _any(text, "  ", "\t", "\x0b", "\x0c", "\r") | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))


def _variable(text: Column) -> Column:
    return F.rlike(text, F.lit("[0-9@]")) | _any(text, "www.", "://")


def _masked(line: Column) -> Column:
    """The line with variable fields masked, or as it is if they are more than half of its words."""
    x = F.regexp_replace(line, "[^ ]+@[^ ]+|https?://[^ ]+|www\\.[^ ]+", "<at>")
    x = F.regexp_replace(x, "[0-9a-fA-F]{12,}", "<hex>")
    x = F.regexp_replace(x, "[0-9]+", "<n>")
    words = F.split(x, " ")
    fixed = F.size(F.filter(words, lambda w: ~F.rlike(w, F.lit("<(?:n|hex|at)>"))))
    return F.when(fixed * 2 >= F.size(words), x).otherwise(line)


def lines(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc (id, last if null), copy (hash of the text), at (line number), line (words joined by single spaces, variable
    fields masked), tokens (their number), leaf, lead, key and check (hashes of the line), for each line of enough tokens.

    Rare cases are looked for once in the text, then in its lines, so most lines are never rewritten or split.
    """
    t = F.col("text")
    # the text between line breaks that spaces touch or that has odd white space anywhere
    odd = _odd_space(t) | _any(t, "\n ", " \n")
    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("copy"), odd.alias("odd"), _variable(t).alias("variable"), F.split("text", "\n").alias("all"))
    x = x.select("doc", "copy", "odd", "variable", F.posexplode_outer("all").alias("at", "line"))  # after the columns of the text, which are made once
    space = r"[\x09-\x0D\x20]"
    x = x.where(F.rlike("line", F.lit(f"(?:[^\\x09-\\x0D\\x20]+{space}+){{{min_tokens - 1}}}[^\\x09-\\x0D\\x20]")))
    line = F.when(F.col("odd"), F.regexp_replace(F.btrim("line", F.lit(" \t\x0b\x0c\r")), f"{space}+", " ")).otherwise(F.col("line"))
    x = x.select("doc", "copy", "at", "variable", line.alias("line"))
    x = x.select("doc", "copy", "at", F.when(F.col("variable") & _variable(F.col("line")), _masked(F.col("line"))).otherwise(F.col("line")).alias("line"))
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return x.select("doc", "copy", "at", "line", n.alias("tokens"), F.xxhash64(n, F.substring_index("line", " ", DEPTH)).alias("leaf"), *_hashes(F.col("line")))


def _hashes(c: Column) -> list[Column]:
    return [F.xxhash64(c).alias("key"), F.xxhash64(F.lit(1), c).alias("check")]


def _texts_of(rows: DataFrame, *key: str) -> DataFrame:
    """texts (their number), first (the least document) and n (rows) of each key; partial sums, so no key is gathered."""
    once = rows.groupBy(*key, "copy").agg(F.min("doc").alias("doc"), F.count("*").alias("n"))
    return once.groupBy(*key).agg(F.count("*").alias("texts"), F.min("doc").alias("first"), F.sum("n").alias("n"))


def _needed(tokens: Column) -> Column:
    """How many texts make a template of a line of so many tokens."""
    return F.greatest(F.lit(2), F.least(F.lit(MIN_TEXTS), F.ceil(LONG / tokens)))


def recurring(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc, copy, at and first of every line of a recurring template, written; what it was made from is deleted."""
    scratch = Scratch()
    slim = scratch(lines(docs, min_tokens).select("doc", "copy", "at", "line", "tokens", "leaf", "key", "check"), "lines", "zstd")  # texts are split once
    needed = _needed(F.col("tokens"))
    exact = scratch(_texts_of(slim, "key", "check", "leaf", "tokens"), "different")
    known = scratch(exact.where(F.col("texts") >= needed).select("key", "check", "first", "n"), "known")
    if known.count() <= BROADCAST_ROWS:
        by_exact = slim.join(F.broadcast(known.drop("n")), ["key", "check"])
    else:
        by_exact = split_join(slim.select("doc", "copy", "at", "key", "check"), known, "key", "check")
    by_exact = by_exact.select("doc", "copy", "at", "first")

    # lines of leaves in which enough texts may be left
    rest = exact.where(F.col("texts") < needed)
    leaves = rest.groupBy("leaf", "tokens").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= needed).select("leaf")
    wanted = scratch(rest.join(leaves, "leaf", "left_semi").select("key", "check", "n"), "wanted")
    n = wanted.count()
    if not n:
        out = by_exact
    else:
        if n <= BROADCAST_ROWS:
            words = slim.join(F.broadcast(wanted.drop("n")), ["key", "check"], "left_semi")
        else:  # without the templates of so many rows that they would crowd a task
            often = known.where(F.col("n") > max(HOT, slim.count() // HOT_KEYS)).select("key", "check")
            words = split_join(slim.join(F.broadcast(often), ["key", "check"], "left_anti"), wanted, "key", "check", total=slim.count()).drop("n")
        out = by_exact.unionByName(_by_shape(scratch(words, "words"), scratch))
    out = scratch(out, "recurring")
    scratch.drop_all_but(out)
    return out


def _tokens(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns and two hashes (leaf, position and token) of each token of the lines."""
    every = rows.select(*columns, "leaf", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    return every.select(*columns, "leaf", *(h.alias(f"token_{i}") for i, h in enumerate(_hashes(F.struct("leaf", "pos", "token")))))


def _few(different: DataFrame, parts: int) -> DataFrame:
    """The fixed tokens of lines in small leaves of which a text has one line, so a token has the votes of its lines; a leaf
    is in one task."""
    every = _tokens(different.repartition(parts, "leaf"), "key", "check", "tokens", "texts")
    own = Window.partitionBy("token_0", "token_1", "leaf")
    return every.withColumn("texts", F.sum("texts").over(own)).withColumn("needed", _needed(F.col("tokens"))).where("texts >= needed")


def _many(different: DataFrame, words: DataFrame) -> DataFrame:
    """The fixed tokens of lines in any leaves; no leaf or token is gathered in a task."""
    held = words.select("key", "check", "copy").distinct()  # as few texts as don't make the line a template
    needed = _needed(F.col("tokens"))  # a leaf's lines have equally many tokens
    # a text has one vote for each token of a position; n is the number of different lines that have it
    votes = _tokens(different.drop("texts").join(held, ["key", "check"]), "tokens", "copy").groupBy("tokens", "token_0", "token_1", "copy").agg(F.lit(1).alias("one"))
    votes = votes.groupBy("tokens", "token_0", "token_1").agg(F.count("*").alias("texts")).where(F.col("texts") >= needed).withColumn("needed", needed).drop("tokens")
    every = _tokens(different, "key", "check", "tokens")
    rows = every.groupBy("token_0", "token_1").agg(F.count("*").alias("n"))
    return split_join(every, votes.join(rows, ["token_0", "token_1"]), "token_0", "token_1", total=different.agg(F.sum("tokens")).first()[0] or 0)


def _shapes(fixed: DataFrame) -> DataFrame:
    """key, check, tokens, level and two hashes of the set of fixed tokens, for each level of the lines that are of a template."""
    levels = F.expr("filter(sequence(0, 30), k -> texts >= shiftleft(needed, 2 * k))")
    level = F.explode(F.when(F.expr("texts < shiftleft(needed, 2)"), F.array(F.lit(0))).otherwise(levels)).alias("level")
    held = fixed.select("leaf", "key", "check", "tokens", "token_0", "token_1", level)
    shape = held.groupBy("leaf", "key", "check", "tokens", "level").agg(F.count("*").alias("size"), F.bit_xor("token_0").alias("set_0"), F.bit_xor("token_1").alias("set_1")).where(F.col("size") >= F.col("tokens") * SIMILAR)
    named = [h.alias(f"shape_{i}") for i, h in enumerate(_hashes(F.struct("leaf", "tokens", "level", "size", "set_0", "set_1")))]
    return shape.select("key", "check", "level", "tokens", *named)


def _by_shape(words: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, copy, at and first of the lines of templates with variable fields."""
    needed = _needed(F.col("tokens"))
    different = words.groupBy("leaf", "key", "check", "tokens").agg(F.first("line").alias("line"), F.size(F.collect_set("copy")).alias("texts"), F.count("*").alias("n"))
    different = scratch(different, "distinct")
    size = different.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts"))
    copies = words.select("leaf", "copy").distinct().groupBy("leaf").agg(F.count("*").alias("copies"))
    size = scratch(size.join(copies, "leaf").select("leaf", "tokens", ((F.col("texts") == F.col("copies")) & (F.col("tokens") <= LEAF_TOKENS)).alias("few")), "leaves")
    total = {r.few: r.total for r in size.groupBy("few").agg(F.sum("tokens").alias("total")).collect()}
    shapes = []
    for few in total:
        own = different.join(size.where(F.col("few") == few), "leaf", "left_semi").drop("n")
        shapes.append(_shapes(_few(own, total[few] // TASK_TOKENS + 1) if few else _many(own, words)))
    shape = reduce(DataFrame.unionByName, shapes)
    per_line = different.select("key", "check", "n").join(shape.groupBy("key", "check").agg(F.collect_list(F.struct("level", "tokens", "shape_0", "shape_1")).alias("shapes")), ["key", "check"])
    rows = split_join(words.select("doc", "copy", "at", "key", "check"), per_line, "key", "check").drop("n")
    rows = scratch(rows.select("doc", "copy", "at", "key", "check", F.inline("shapes")), "shaped")
    general = _texts_of(rows, "shape_0", "shape_1", "tokens").where(F.col("texts") >= needed).select("shape_0", "shape_1", "first", "n")
    own = split_join(rows.drop("tokens"), general, "shape_0", "shape_1")
    return own.groupBy("doc", "copy", "at").agg(F.min_by("first", "level").alias("first"))


def _cleaned(docs: DataFrame, min_tokens: int) -> DataFrame:
    """_row (the row as it was), _text without dropped lines, and _n_dropped."""
    gone = recurring(docs, min_tokens).where("doc != first").groupBy("doc", "copy").agg(F.collect_set("at").alias("gone"))
    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("copy"), F.struct(*docs.columns).alias("_row"))
    x = x.join(gone, ["doc", "copy"], "left")
    left = F.array_join(F.filter(F.split("_row.text", "\n"), lambda w, i: ~F.array_contains("gone", i)), "\n")
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return x.select("_row", F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(left).alias("_text"), n.alias("_n_dropped"))


def _columns(docs: DataFrame, **changed) -> list[Column]:
    return [changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns]


def clean(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """All rows and columns, texts without dropped lines, and n_dropped, in place of any column of that name."""
    columns = [c for c in docs.columns if c != "n_dropped"]
    return _cleaned(docs.select(columns), min_tokens).select(*_columns(docs.select(columns), text=F.col("_text")), F.col("_n_dropped").alias("n_dropped"))


def dedup(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The documents that keep a line, without dropped lines; n_chars, if there, follows the text."""
    x = _cleaned(docs, min_tokens)
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_n_dropped") > 0, F.length("_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("_row.n_chars"))
    return x.where((F.col("_n_dropped") == 0) | F.rlike("_text", F.lit(r"[^\x09-\x0D\x20]"))).select(*_columns(docs, **changed))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_dropped and the text that stays of each document."""
    docs = documents(spark, sf_dir)
    return clean(docs).select("doc_id", "n_dropped", "text")


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(doc_id, {LAST}) AS doc, text FROM documents),
o AS (SELECT DISTINCT doc, text FROM d WHERE text IS NOT NULL),
l AS (SELECT doc, text, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS ln FROM o),
w AS (SELECT doc, text, ln, trim(regexp_replace(raw, '[\x09-\x0D\x20]+', ' ', 'g')) AS own FROM l WHERE regexp_matches(raw, '([^\x09-\x0D\x20]+[\x09-\x0D\x20]+){{{MIN_TOKENS - 1}}}[^\x09-\x0D\x20]')),
k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(own, '[^ ]+@[^ ]+|https?://[^ ]+|www\.[^ ]+', '<ln>', 'g'), '[0-9a-fA-F]{{12,}}', '<hex>', 'g'), '[0-9]+', '<n>', 'g') AS mask FROM w),
v AS (SELECT doc, text, ln, CASE WHEN regexp_matches(own, '[0-9@]|www\.|://') AND 2 * len(list_filter(string_split(mask, ' '), lambda z: NOT regexp_matches(z, '<(n|hex|ln)>'))) >= len(string_split(mask, ' ')) THEN mask ELSE own END AS line FROM k),
s AS (SELECT *, string_split(line, ' ') AS ws, len(string_split(line, ' ')) AS n, len(string_split(line, ' ')) || ' ' || array_to_string(list_slice(string_split(line, ' '), 1, {DEPTH}), ' ') AS leaf FROM v),
s2 AS (SELECT *, greatest(2, least({MIN_TEXTS}, ceil({LONG} / n)))::BIGINT AS needed FROM s),
x AS (SELECT line, min(doc) AS first_doc FROM s2 GROUP BY line, needed HAVING count(DISTINCT text) >= needed),
rest AS (SELECT * FROM s2 WHERE line NOT IN (SELECT line FROM x)),
big AS (SELECT leaf FROM rest GROUP BY leaf, needed HAVING count(DISTINCT text) >= needed),
r AS (SELECT rest.* FROM rest JOIN big USING (leaf)),
tok AS (SELECT leaf, needed, line, text, unnest(ws) AS token, unnest(generate_series(1, n)) AS pos FROM r),
often AS (SELECT leaf, pos, token, count(DISTINCT text) AS c FROM tok GROUP BY leaf, needed, pos, token HAVING count(DISTINCT text) >= needed),
held AS (SELECT DISTINCT leaf, line, pos, token, k FROM tok JOIN often USING (leaf, pos, token), generate_series(0, 10) AS g(k) WHERE c >= needed * 4 ** k),
shape AS (SELECT line, k, leaf || chr(10) || string_agg(pos || ' ' || token, chr(10) ORDER BY pos) AS shape FROM held GROUP BY leaf, line, k HAVING count(*) >= len(string_split(line, ' ')) * {SIMILAR}),
g AS (SELECT k, shape, min(doc) AS first_doc FROM r JOIN shape USING (line) GROUP BY k, shape, needed HAVING count(DISTINCT text) >= needed),
pick AS (SELECT line, arg_min(first_doc, k) AS first_doc FROM shape JOIN g USING (k, shape) GROUP BY line),
gone AS (SELECT doc, text, ln FROM s JOIN x USING (line) WHERE doc <> first_doc UNION SELECT doc, text, ln FROM r JOIN pick USING (line) WHERE doc <> first_doc),
a AS (SELECT doc, text, list(ln) AS ats FROM gone GROUP BY doc, text)
SELECT d.doc_id, coalesce(len(ats), 0)::BIGINT AS n_dropped, CASE WHEN ats IS NULL THEN d.text ELSE
 array_to_string(list_transform(list_filter(generate_series(0, len(string_split(d.text, chr(10))) - 1), lambda i: NOT list_contains(ats, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)) END AS text
FROM d LEFT JOIN a ON a.doc = d.doc AND a.text = d.text
"""
