"""Soft-membership mixing of documents to target domain weights, on DataFrame functions only.

A Gaussian classifier over text shape (symbols, word lengths, text and line lengths, share of different words) is fitted to a column of the labels table by one aggregation, and gives every document a posterior over domains.
Document rates start at 1 and go by projected gradient steps towards the least-squares solution of
"sum of rate * tokens * posterior = target" for each domain, never below each document's lower bound (0 unless asked).
A step moves a rate by the inner product of the posterior with one vector of a length of the number of domains: the
residual, scaled by the Gram matrix of the posteriors of documents whose rate can still move, or of all where that step
doesn't lower the squared residual (in the norm of the inverse Gram matrix, in which the latter step always does). So the
rates are a function of the posterior and the list of steps; a pass over the narrow table of tokens and posteriors sums
the domain totals, nothing is stored for each document between passes, and a lost executor costs a recomputed projection.
The steps end when the targets are met. Targets out of reach would put all weight on a few extreme documents in very many
small steps; there the steps end once ``PATIENCE`` of them are made and one lowers the squared residual by less than a
hundredth. The largest miss that is left, as a share of the target's tokens, is the column ``miss``.

Targets are ``weights`` of the current tokens; with ``protect`` they are scaled up so that no protected domain shrinks.

Edge cases: a null or empty text has no tokens, the prior as posterior and counts for nothing; labels that are null or
of unknown documents are ignored; with fewer than two labelled domains all posteriors are even, the rates stay 1 and the miss is null;
repeated rows are weighed each; an empty table gives no rows; extra columns are kept by ``mix``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, materialize, table

FEATURES = ("symbols", "word_length", "length", "line_words", "different")
WEIGHTS = {0: 0.05, 1: 0.95}
TOLERANCE, STALLED, PATIENCE, TEMPER = 1e-6, 1e-9, 40, 0.5


def with_features(docs: DataFrame) -> DataFrame:
    """The rows with n_tokens and the features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    x = docs.withColumn("_words", F.split(trimmed, r"[\x09-\x0D\x20]+"))
    x = x.withColumn("n_tokens", F.when(F.get("_words", F.lit(0)) == "", 0).otherwise(F.size("_words")).cast("long"))
    n = F.greatest(F.lit(1.0), F.col("n_tokens").cast("double"))
    size = F.octet_length(text)
    made = {
        "symbols": F.log1p((size - F.octet_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))) / n),
        "word_length": F.log1p(size / n),
        "length": F.log1p(n),
        "line_words": F.log1p(n / (1 + size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))))),
        "different": F.size(F.array_distinct("_words")) / n,
    }
    return x.withColumns({f"_f_{k}": v for k, v in made.items()}).drop("_words")


def fit(featured: DataFrame, labels: DataFrame, column: str, domains: list) -> dict[str, np.ndarray] | None:
    """Prior, means and variances of each domain."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("_y")).where(F.col("_y").isin(domains)).groupBy("doc_id").agg(F.max("_y").alias("_y"))
    parts = [f(F.col(f"_f_{k}")).alias(f"{name}_{k}") for k in FEATURES for name, f in (("m", F.avg), ("v", F.var_pop))]
    got = {r["_y"]: r for r in featured.select(F.col("doc_id").cast("long").alias("doc_id"), *(f"_f_{k}" for k in FEATURES)).join(y, "doc_id").groupBy("_y").agg(F.count("*").alias("n"), *parts).collect()}
    if any(d not in got for d in domains) or len(domains) < 2:
        return None
    n = np.array([got[d]["n"] for d in domains], dtype=float)
    m = np.array([[got[d][f"m_{k}"] for k in FEATURES] for d in domains])
    v = np.array([[got[d][f"v_{k}"] for k in FEATURES] for d in domains])
    pooled = (n[:, None] * v).sum(0) / n.sum() + 1e-4
    return {"prior": n / n.sum(), "mean": m, "var": (n[:, None] * v + 20 * pooled) / (n[:, None] + 20) + 1e-4}


def posteriors(model: dict[str, np.ndarray] | None, n_domains: int) -> list[Column]:
    if model is None:
        return [F.lit(1 / n_domains)] * n_domains
    scores = []
    for d in range(n_domains):
        z = F.lit(0.0)
        for i, k in enumerate(FEATURES):
            m, v = float(model["mean"][d, i]), float(model["var"][d, i])
            z = z - TEMPER * (F.pow(F.col(f"_f_{k}") - m, F.lit(2)) / (2 * v) + 0.5 * float(np.log(v)))
        scores.append(F.when(F.col("n_tokens") > 0, z).otherwise(F.lit(0.0)) + float(np.log(model["prior"][d])))
    top = F.greatest(*scores)
    return [F.exp(s - top) / sum((F.exp(t - top) for t in scores[1:]), F.exp(scores[0] - top)) for s in scores]


def rate(steps: list[np.ndarray], n_domains: int, lower: Column) -> Column:
    """The rate after the steps, from the posterior columns _p0, _p1, ..."""
    r: Column = F.greatest(F.lit(1.0), lower)
    for y in steps:
        r = F.greatest(lower, r - sum((F.col(f"_p{d}") * float(y[d]) for d in range(1, n_domains)), F.col("_p0") * float(y[0])))
    return r


def solve(narrow: DataFrame, weights: list[float], lower: Column, protect: list[int]) -> tuple[list[np.ndarray], float]:
    """Steps of the projected gradient and the miss that they leave; narrow has n_tokens and the posterior columns."""
    D = len(weights)
    tokens = F.col("n_tokens").cast("double")

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each domain, and the Gram matrix of the documents above their lower bound."""
        r = rate(steps, D, lower)
        row = narrow.select("n_tokens", *(f"_p{d}" for d in range(D)), r.alias("_r"), (r > lower).alias("_free"))
        sums = [F.sum(tokens * F.col("_r") * F.col(f"_p{d}")) for d in range(D)]
        sums += [F.sum(F.when(F.col("_free"), tokens * F.col(f"_p{i}") * F.col(f"_p{j}")).otherwise(0.0)) for i in range(D) for j in range(D)]
        found = np.array([x or 0.0 for x in row.agg(*sums).first()])
        return found[:D], found[D:].reshape(D, D)

    gram = np.array([x or 0.0 for x in narrow.agg(*(F.sum(tokens * F.col(f"_p{i}") * F.col(f"_p{j}")) for i in range(D) for j in range(D))).first()]).reshape(D, D)
    now, free = totals([])
    if now.sum() <= 0:
        return [], 0.0
    w = np.array(weights) / sum(weights)
    whole = max([now.sum(), *(now[d] / w[d] for d in protect)])
    target = w * whole
    inverse = np.linalg.inv(gram + 1e-9 * np.trace(gram) * np.eye(D))
    squared = lambda m: float(m @ inverse @ m)
    steps: list[np.ndarray] = []
    while np.abs(now - target).max() > TOLERANCE * whole:
        miss = now - target
        whole_step = np.linalg.solve(free + 1e-9 * np.trace(gram) * np.eye(D), miss)
        for y in (whole_step, whole_step / 2, whole_step / 4, whole_step / 16, inverse @ miss):
            then, then_free = totals([*steps, y])
            if squared(then - target) < (1 - STALLED) * squared(miss):
                steps, now, free = [*steps, y], then, then_free
                break
        else:  # no step lowers it: the least-squares rates
            break
        if len(steps) >= PATIENCE and squared(now - target) > 0.99 * squared(miss):
            break
    return steps, float(np.abs(now - target).max() / whole)


def decide(docs: DataFrame, labels: DataFrame, column: str, weights: dict | None, protect: tuple, keep_likely: bool):
    """The narrow table of features, and the function that adds posteriors, rate and copies to rows with features."""
    weights = WEIGHTS if weights is None else weights
    domains = sorted(weights)
    D = len(domains)
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_hash"))
    narrow = materialize(with_features(hashed).drop("text"), "features")
    model = fit(narrow, labels, column, domains)
    kept = [domains.index(d) for d in protect]
    likely = F.lit(False)
    for d in kept:
        likely = likely | (F.col(f"_p{d}") >= 0.5)
    lower = F.when(likely, 1.0).otherwise(0.0) if keep_likely and kept else F.lit(0.0)

    def with_posteriors(x: DataFrame) -> DataFrame:
        return x.withColumns({f"_p{d}": p for d, p in enumerate(posteriors(model, D))}).drop(*(f"_f_{k}" for k in FEATURES))

    steps, miss = solve(materialize(with_posteriors(narrow).drop("doc_id", "_hash"), "posteriors"), [weights[d] for d in domains], lower, kept) if model is not None else ([], None)

    def with_copies(x: DataFrame) -> DataFrame:
        x = with_posteriors(x).withColumn("rate", rate(steps, D, lower))
        chance = F.pmod("_hash", F.lit(1 << 20)) / float(1 << 20)
        copies = F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
        return x.withColumn("copies", copies.cast("long")).withColumn("miss", F.lit(miss).cast("double"))

    return narrow, with_copies, domains


def rates(docs: DataFrame, labels: DataFrame, column: str = "quality", weights: dict | None = None, protect: tuple = (), keep_likely: bool = False) -> tuple[DataFrame, list]:
    """doc_id, n_tokens, posterior columns _p0.., rate, copies and miss of each row; and the domains in their order.

    keep_likely: documents whose likeliest domain is protected have a rate of 1 or more.
    """
    narrow, with_copies, domains = decide(docs, labels, column, weights, protect, keep_likely)
    return with_copies(narrow).drop("_hash"), domains


def mix(docs: DataFrame, labels: DataFrame, column: str = "quality", weights: dict | None = None, protect: tuple = (), keep_likely: bool = False) -> DataFrame:
    """Each row as often as its rate says: the whole part, and one more by a hash of the row for the rest.

    The text is read twice, once to decide and once to write; nothing wide is shuffled.
    """
    _, with_copies, _ = decide(docs, labels, column, weights, protect, keep_likely)
    x = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    x = with_copies(with_features(x))
    # counting from 0 in an outer generator keeps the condition above it; below, it would be evaluated with all it is made from
    return x.select("_row", F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("copies"))).alias("_c")).where("_c > 0").select("_row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, domains = rates(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return x.select("doc_id", "n_tokens", *(F.col(f"_p{d}").alias(f"p_quality_{name}") for d, name in enumerate(domains)), "rate", "copies", "miss")
