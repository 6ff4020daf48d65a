"""Quality rules as a bitmask ledger.

Each document is measured once and every rule is decided once; the ledger keeps the measurements and one bit for each
failed rule. Policies are versioned masks over those bits, so applying another policy, or asking what each rule alone
rejects (an ablation), is arithmetic on the ledger and never reads a text again.

Edge cases: a null or empty text has no words, measures 0 throughout and fails ``few_words``; a null doc_id is
kept as null; repeated rows are measured each; extra columns, whatever their names, are left out; an empty table gives
an empty ledger.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WORD_SPACE, WordHash, arrow_map, documents, run_hash, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BULLETS, ELLIPSES = ("-", "*", "•"), ("...", "…")
_LETTER, _UPPER = re.compile(rb"[A-Za-z]"), re.compile(rb"[^A-Za-z]*[A-Z][^a-z]*")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter", "n_alpha", "n_distinct", "n_upper", "n_bullets", "n_ellipses", "n_top", "n_marks")


def _c(name: str) -> Column:
    return F.col(name)


#: Rules by bit, lowest first: true when the document fails. Append only; a bit never changes its meaning.
RULES = (
    ("few_words", lambda: _c("n_words") < 20),
    ("repeated_windows", lambda: 100 * _c("n_repeat_words") > 30 * _c("n_words")),
    ("symbols", lambda: 10 * _c("n_symbols") > 3 * _c("n_words")),
    ("stutter", lambda: 100 * _c("n_stutter") > 30 * _c("n_words")),
    ("repeated_lines", lambda: 100 * _c("n_dup_lines") > 60 * _c("n_lines")),
    ("long_words", lambda: _c("word_chars") > 40 * _c("n_words")),
    ("few_letters", lambda: 100 * _c("n_alpha") < 70 * _c("n_words")),
    ("few_distinct_words", lambda: 100 * _c("n_distinct") < 10 * _c("n_words")),
    ("upper_case", lambda: 100 * _c("n_upper") > 60 * _c("n_alpha")),
    ("bullets", lambda: 100 * _c("n_bullets") > 90 * _c("n_lines")),
    ("ellipses", lambda: 100 * _c("n_ellipses") > 30 * _c("n_lines")),
    ("one_word", lambda: 100 * _c("n_top") > 20 * _c("n_words")),
    ("exclamations", lambda: 100 * _c("n_marks") > 50 * _c("n_words")),
    ("no_sentence", lambda: (_c("n_lines") > 3) & (_c("n_words") < 2 * _c("n_lines"))),
    ("very_long", lambda: _c("n_words") > 100_000),
)
#: Masks of the rules that each policy version applies. A version never changes; ``v2`` adds what ``v1`` lacks.
POLICIES = {"base": 0b000011, "v1": 0b111111, "v2": 0b111111111111111}


def repeat_words(words: list[bytes], hashes: WordHash) -> int:
    """Words in windows of WINDOW words that the text has twice or more."""
    if len(words) <= WINDOW:
        return 0
    h = run_hash(hashes.all(words), WINDOW)
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    often = np.flatnonzero(n[back] > 1)
    if not len(often):
        return 0
    exact = Counter(tuple(words[i : i + WINDOW]) for i in often.tolist())
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in often.tolist():
        if exact[tuple(words[i : i + WINDOW])] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((covered.cumsum() > 0).sum())


def measure(text: str, hashes: WordHash) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    full = [x for x in lines if x.strip(WORD_SPACE)]
    count = Counter(words)
    return (
        len(words),
        len(text) - sum(map(text.count, WORD_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(full) - len(set(full)),
        repeat_words(words, hashes),
        len(full),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
        sum(n for w, n in count.items() if not w.isascii() or _LETTER.search(w)),
        len(count),
        sum(n for w, n in count.items() if _UPPER.fullmatch(w)),
        sum(x.lstrip(WORD_SPACE).startswith(BULLETS) for x in full),
        sum(x.rstrip(WORD_SPACE).endswith(ELLIPSES) for x in full),
        max(count.values(), default=0),
        text.count("!") + text.count("?"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that the document fails."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHash()
        rows = np.array([measure(t, hashes) for t in texts(batch, text)], dtype=np.int64).reshape(-1, len(MEASURES))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], ["doc_id", *MEASURES])

    found = arrow_map(docs.select("doc_id", F.col(text).alias(text)), one, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = F.lit(0).cast("long")
    for bit, (_, rule) in enumerate(RULES):
        failed = failed.bitwiseOR(F.when(rule(), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return found.withColumn("failed", failed)


def sole_rule(version: str = "v1") -> Column:
    """The rule that alone rejects the document under a policy: without it, the document would be kept."""
    hit = F.col("failed").bitwiseAND(F.lit(POLICIES[version]).cast("long"))
    out = F.lit(None).cast("string")
    for bit, (name, _) in enumerate(RULES):
        if POLICIES[version] >> bit & 1:
            out = F.when(hit == 1 << bit, F.lit(name)).otherwise(out)
    return out


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    mask = F.lit(POLICIES[version]).cast("long")
    return rows.withColumn("kept", F.col("failed").bitwiseAND(mask) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects. One pass, bitwise."""
    mask = POLICIES[version]
    hit = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    both = []
    for bit, (name, _) in enumerate(RULES):
        if mask >> bit & 1:
            one = F.lit(1 << bit).cast("long")
            both.append(F.struct(F.lit(name).alias("rule"), F.count_if(hit.bitwiseAND(one) != 0).alias("n_failed"), F.count_if(hit == one).alias("n_only")))
    return rows.agg(F.array(*both).alias("r")).select(F.inline("r"))


def quality(docs: DataFrame) -> DataFrame:
    x = apply_policy(ledger(docs))
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"]).cast("long")) != 0
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", F.col("failed").alias("failed_bits"), sole_rule().alias("sole_rule"), (F.col("failed") == 0).alias("kept_v2"))


def op6(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, generate_subscripts(ws, 1) AS i, ws FROM w),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS k FROM g WHERE i + 7 <= len(ws)),
often AS (SELECT rid, k FROM win GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT rid, count(DISTINCT p) AS n FROM
          (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM win JOIN often USING (rid, k)) GROUP BY rid),
m AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        len(list_filter(generate_series(2, len(ws)), lambda j: ws[j] = ws[j - 1]))::BIGINT AS n_stutter,
        len(list_filter(ws, lambda x: regexp_matches(x, '[^\x00-\x7F]|[A-Za-z]'))) AS n_alpha, len(list_distinct(ws)) AS n_distinct,
        len(list_filter(ws, lambda x: regexp_full_match(x, '[^A-Za-z]*[A-Z][^a-z]*'))) AS n_upper,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
        coalesce(list_max(map_values(list_histogram(ws))), 0)::BIGINT AS n_top, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks FROM w),
a AS (SELECT m.*, coalesce(cover.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cover USING (rid)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (10 * n_symbols > 3 * n_words)::BIGINT
        + 8 * (100 * n_stutter > 30 * n_words)::BIGINT + 16 * (100 * n_dup_lines > 60 * n_lines)::BIGINT
        + 32 * (word_chars > 40 * n_words)::BIGINT + 64 * (100 * n_alpha < 70 * n_words)::BIGINT + 128 * (100 * n_distinct < 10 * n_words)::BIGINT
        + 256 * (100 * n_upper > 60 * n_alpha)::BIGINT + 512 * (100 * n_bullets > 90 * n_lines)::BIGINT + 1024 * (100 * n_ellipses > 30 * n_lines)::BIGINT
        + 2048 * (100 * n_top > 20 * n_words)::BIGINT + 4096 * (100 * n_marks > 50 * n_words)::BIGINT
        + 8192 * (n_lines > 3 AND n_words < 2 * n_lines)::BIGINT + 16384 * (n_words > 100000)::BIGINT AS failed_bits FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       (failed_bits & 63) = 0 AS kept, failed_bits, failed_bits = 0 AS kept_v2,
       CASE failed_bits & 63 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'stutter' WHEN 16 THEN 'repeated_lines' WHEN 32 THEN 'long_words' END AS sole_rule FROM b
"""
