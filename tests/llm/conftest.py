import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["set_id", "node", "leaf", "label", "score", "rate", "copies", "bucket", "rank", "shard", "carry", "key", "gone", "copy", "words", "norm", "failed", "n_words", "n_tokens", "n_email", "n_dropped", "items", "base"]


def words(rng, n, size=3000):
    return " ".join(f"w{rng.randrange(size):04d}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty, short and very long texts, copies, near copies, repeated rows and common lines."""
    rng = random.Random(7)
    header = "this line stands in many different documents of the corpus"
    texts = [None, "", "   \n\t", "one two", "a b c d e", words(rng, 30_000)]
    for _ in range(30):
        body = [words(rng, rng.randint(8, 40)) for _ in range(rng.randint(2, 8))]
        texts.append("\n".join([header, *body]))
    base = words(rng, 300).split()
    for k in range(25):  # near copies of one another, to different degrees
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [texts[10]] * 12
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, "a row without an id but with several words", "en", None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, corpus):
    return spark.createDataFrame([(r[0], int(r[0] % 4 > 0), int(r[0] % 9 == 0)) for r in corpus if r[0] is not None], "doc_id long, quality int, toxic int")
