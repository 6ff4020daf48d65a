"""License scan with ordered signature rules, on DataFrame functions only.

Texts become lower-cased words joined by single spaces. A document that holds none of the keywords' common parts is
finished there. The others are tried against the rules of the keywords they hold (``license_rules``): first one literal
regex for all rules of a keyword, then each rule of the few keywords left. A detection inside a longer one is
suppressed; of detections of the same words the rule of higher priority stays, then the label that sorts first. As no
match is longer than ``most_words()``, a detection is compared with the few that start within that distance before it, so
the cost is linear in the text and its detections. The four base phrases are always reported.

Edge cases: a null or empty text has no words, no places, empty labels and score 0; a null doc_id stays null; repeated
rows are scanned each; very long texts, and texts of very many detections, are scanned whole; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import documents
from quern.llm.license_rules import families, most_words

BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}

#: Any match of any rule, and any base phrase, holds one of these.
GATE = ("licen", "gpl", " mpl ", " epl ", " eupl ", "cddl", "apache", "cc by", " cc0 ", "cecill", "creative commons", "creativecommons", "available under", "no attribution", "bsd", "public domain", "rights reserved", "proprietary", "redistribut", "permission", "wtfpl", "beerware", "under the same terms as", "distributed under", "released under", "the software is provided", "in no event will the authors", "neither the name of", "all advertising materials", "disclaims copyright", "unauthorized copying", "php software")
MARK = "\u0001"


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split(" ")
    at = lambda i: F.get(words, i)

    def here(i: Column) -> Column:
        out = at(i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            out = out & F.coalesce(at(i + k) == p, F.lit(False))
        return out

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _named(label: str):
    return lambda s: F.struct(s.alias("s"), F.lit(label).alias("label"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    # beyond A-Z, lower() changes only characters that no phrase or rule has, and none into a separator
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    joined = F.trim(F.regexp_replace(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "))
    x = docs.select("doc_id", joined.alias("norm"))
    x = x.withColumn("padded", F.concat(F.lit(" "), "norm", F.lit(" ")))
    gate = F.lit(False)
    for k in GATE:
        gate = gate | F.contains("padded", F.lit(k))
    n_spaces = F.octet_length("norm") - F.octet_length(F.replace("norm", F.lit(" "), F.lit("")))
    x = x.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(n_spaces + 1).cast("long"))
    x = x.withColumn("words", F.when(gate, F.split("norm", " ")))

    # base places
    places = {label: F.when(F.contains("padded", F.lit(f" {phrase} ")), _starts(F.col("words"), phrase)).otherwise(F.array().cast("array<int>")) for label, phrase in BASE.items()}
    found = F.concat(*(F.transform(p, _named(label)) for label, p in places.items()))
    x = x.withColumn("base", F.when(F.col("words").isNotNull(), found))

    # keywords of which any rule matches, then their rules that do, then the places of each
    live = []
    for keyword, some in families().items():
        any_rule = " (?:" + "|".join(f"(?:{rx})" for *_, rx in some) + ") "
        own = F.lit([f"{label}\t{priority}\t{rx}" for label, priority, rx in some])
        live.append(F.when(F.contains("padded", F.lit(keyword)) & F.rlike("padded", F.lit(any_rule)), own))
    tried = F.transform(F.flatten(F.filter(F.array(*live), lambda a: a.isNotNull())), lambda r: F.split(r, "\t"))
    x = x.withColumn("rules", F.when(F.col("words").isNotNull(), F.filter(tried, lambda r: F.regexp_like(F.col("padded"), F.concat(F.lit(" (?:"), r[2], F.lit(") "))))))

    def hits(r: Column) -> Column:
        rx = F.concat(F.lit("(?<= )("), r[2], F.lit(")(?= )"))
        marked = F.split(F.ltrim(F.regexp_replace(F.col("padded"), rx, F.lit(MARK + "$1"))), " ")
        starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit(MARK)), i)), lambda i: i.isNotNull())
        return F.transform(F.arrays_zip(starts.alias("s"), F.regexp_extract_all(F.col("padded"), rx, F.lit(1)).alias("m")), lambda z: F.struct(z["s"].alias("s"), (-z["s"] - F.size(F.split(z["m"], " "))).alias("less_e"), (-r[1].cast("int")).alias("less_priority"), r[0].alias("label")))

    # of detections with the same start the longest, then of highest priority, comes first and holds the others
    x = x.withColumn("sorted", F.array_sort(F.flatten(F.transform("rules", hits))))
    x = x.withColumn("first", F.filter("sorted", lambda h, i: (i == 0) | (F.get(F.col("sorted"), i - 1)["s"] != h["s"])))
    width = most_words()

    def inside(h: Column, i: Column) -> Column:
        before = F.slice(F.col("first"), F.greatest(F.lit(1), i - width + 1), F.least(i, F.lit(width)))
        return F.exists(before, lambda o: o["less_e"] <= h["less_e"])

    x = x.withColumn("alone", F.filter("first", lambda h, i: ~inside(h, i)))
    x = x.withColumn("hits", F.transform("alone", lambda h: F.struct(h["s"].alias("s"), (-h["less_e"]).alias("e"), (-h["less_priority"]).alias("priority"), h["label"].alias("label"))))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"])))
    own = F.transform("hits", lambda h: h["label"])
    all_labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda p: p["label"]), own)))
    sure = F.aggregate("hits", F.lit(0.0), lambda a, h: F.greatest(a, F.when(h["priority"] >= 40, 0.95).when(h["priority"] >= 20, 0.85).otherwise(0.5)))
    n_base = F.coalesce(F.greatest(F.size("base"), F.lit(0)), F.lit(0)).cast("long")
    starts = F.transform("base", lambda p: p["s"])
    return x.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.coalesce(F.array_join(base_labels, ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(all_labels, ","), F.lit("")).alias("labels"),
        F.coalesce(F.greatest(F.when(n_base > 0, 0.99).otherwise(0.0), sure), F.lit(0.0)).alias("score"),
        F.coalesce(F.to_json(F.transform("hits", lambda h: F.struct(h["label"].alias("label"), h["s"].alias("first"), h["e"].alias("end")))), F.lit("[]")).alias("detections"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("detections")


def _op10_sql() -> str:
    """The same by comparing every run of words with every rule that its text can match."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(label)}, {quoted(k)}, {priority}, {quoted(rx)}, {rx.count(' ') + 1})" for k, some in families().items() for label, priority, rx in some)
    base = ", ".join(f"({quoted(label)}, {quoted(p)}, {len(p.split())})" for label, p in BASE.items())
    return rf"""
WITH r(label, keyword, priority, rx, most) AS (VALUES {values}),
b(label, phrase, n) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT rid, ws, ' ' || array_to_string(ws, ' ') || ' ' AS padded FROM d),
live AS (SELECT rid, ws, label, priority, rx, most FROM p JOIN r ON contains(padded, keyword) WHERE regexp_matches(padded, ' (?:' || rx || ') ')),
at_ AS (SELECT rid, ws, label, priority, rx, most, unnest(generate_series(1, len(ws))) AS s FROM live),
run AS (SELECT rid, label, priority, rx, s, s + n AS e, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS words FROM at_, generate_series(1, {most_words()}) AS g(n) WHERE n <= most AND s + n - 1 <= len(ws)),
h AS (SELECT DISTINCT rid, label, priority, s, e FROM run WHERE regexp_full_match(words, rx)),
kept AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.rid = h.rid AND o.s <= h.s AND h.e <= o.e
  AND (o.s <> h.s OR o.e <> h.e OR o.priority > h.priority OR o.priority = h.priority AND o.label < h.label))),
bs AS (SELECT rid, label, s FROM (SELECT rid, ws, b.label, b.phrase, b.n, unnest(generate_series(1, len(ws))) AS s FROM p JOIN b ON contains(padded, ' ' || phrase || ' ')) WHERE array_to_string(list_slice(ws, s, s + n - 1), ' ') = phrase),
ba AS (SELECT rid, count(*) AS n, min(s) - 1 AS lo, max(s) - 1 AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM bs GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT rid, label FROM bs UNION SELECT rid, label FROM kept) GROUP BY rid),
sc AS (SELECT rid, max(CASE WHEN priority >= 40 THEN 0.95 WHEN priority >= 20 THEN 0.85 ELSE 0.5 END) AS sure FROM kept GROUP BY rid)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(ba.n, 0)::BIGINT AS n_base, ba.lo::BIGINT AS first_word, ba.hi::BIGINT AS last_word, coalesce(ba.ls, '') AS base_labels,
       coalesce(al.ls, '') AS labels, greatest(CASE WHEN ba.n > 0 THEN 0.99 ELSE 0.0 END, coalesce(sc.sure, 0.0))::DOUBLE AS score
FROM d LEFT JOIN ba USING (rid) LEFT JOIN al USING (rid) LEFT JOIN sc USING (rid)
"""


OP10_SQL = _op10_sql()
