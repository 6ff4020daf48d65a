"""Merkle proofs, substring dedup and whitening against brute force."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import merkle, substring, whitening

from .conftest import CLASHES, SCHEMA


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(r):
    x = dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True))
    return sha("".join("-" if x[c] is None else f"{len(str(x[c]).encode())}:{x[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree_of(nodes):
    """All levels, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 2])) for i in range(0, len(x), 2)])
    return levels


def proof_of(levels, i):
    out = []
    for x in levels[:-1]:
        if i ^ 1 < len(x):
            out.append((i & 1, x[i ^ 1]))
        else:
            out.append(None)
        i >>= 1
    return out


def folded(h, proof):
    for p in proof:
        h = sha(h if p is None else p[1] + h if p[0] else h + p[1])
    return h


def brute_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[b"" if r[2] is None else b"=" + r[2].encode()].append(r)
    names = sorted(groups)
    low = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        low[g] = tree_of([leaf_of(r) for r in groups[g]])
    top = tree_of([low[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            proof = proof_of(low[g], i) + proof_of(top, k)
            start = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                start = (*r[:4], r[4] + 1)
            end = folded(leaf_of(start), proof)
            out.append((r[0], leaf_of(r), low[g][-1][0], top[-1][0], "".join(p[1] for p in proof if p), end))
    return out


def manifest_rows(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in merkle.manifest(df).collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_manifest(spark, corpus, clashing):
    assert ordered(manifest_rows(clashing)) == ordered(brute_manifest(corpus))


def test_manifest_of_groups(spark, empty):
    """Groups of 1 to 9 rows, null, empty and multi-byte names, null columns, rows alike in everything."""
    rows = []
    for n, lang in enumerate([None, "", "a", "é", "zz", "Z", "ü", "b", "c"], 1):
        rows += [(100 * n + i, f"text {i} ü" if i % 3 else None, lang, None if i % 2 else "s", i if i % 4 else None) for i in range(n)]
    rows += [rows[-1]] * 5 + [(None, "x", "c", "s", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = manifest_rows(df)
    assert ordered(got) == ordered(brute_manifest(rows))
    assert manifest_rows(empty) == []


def test_manifest_of_many_strata(spark, monkeypatch):
    """With two levels a stratum and ranges of 20 rows, 300 rows of a group go through five strata."""
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    monkeypatch.setattr(merkle, "_LEVELS", merkle._LEVELS.replace("sequence(1, 8)", "sequence(1, 2)"))
    rows = [(i * 37 % 1009, f"text {i}", "en" if i % 50 else "fr", "s", i) for i in range(300)]
    got = manifest_rows(spark.createDataFrame(rows, SCHEMA))
    assert ordered(got) == ordered(brute_manifest(rows))


def test_only_tampered_rows_fail(spark, docs):
    x = merkle.manifest(docs.where("doc_id IS NOT NULL AND n_chars IS NOT NULL")).select("tampered", (F.col("folded_root") == F.col("root")).alias("ok")).collect()
    assert {r.tampered for r in x} == {True, False} and all(r.ok != r.tampered for r in x)


def brute_removed(rows):
    first = {}
    texts = [(substring.LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    n = substring.WINDOW
    for d, w in texts:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, substring.LAST), d)
    out = []
    for (d, w), r in zip(texts, rows, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def removed_rows(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removed(df).collect()]


def passages(rng, n_docs=60):
    """Documents with passages of 45 to 90 words in common, some twice in a text, and copies."""
    word = lambda: f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(k)] for k in (45, 49, 50, 51, 60, 90, 400)]
    rows = []
    for d in range(n_docs):
        w = [word() for _ in range(rng.randrange(5, 150))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            cut = rng.randrange(0, 10)
            w[at:at] = s[cut:]
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "\t "]).join(w), "en", "s", 1))
    common = " ".join(shared[4])
    rows += [(2000 + i, f"a{i} b{i} {common} c{i} d{i}", "en", "s", 1) for i in range(40)]
    rows += [(3000, "same " * 700, "en", "s", 1), (3001, "same " * 650 + "other", "en", "s", 1), (3002, "x " + "same " * 120, "en", "s", 1)]
    rows += [(3003, " ".join(f"p{i % 3}" for i in range(500)), "en", "s", 1), (3004, " ".join(f"p{i % 3}" for i in range(1, 300)), "en", "s", 1)]
    return [*rows, rows[3], (None, rows[4][1], "en", "s", 1), (None, rows[4][1], None, None, None), (5, None, "en", "s", 1), (6, "", "en", "s", 1)]


def test_substrings(clashing, corpus, empty):
    assert ordered(removed_rows(clashing)) == ordered(brute_removed(corpus))
    assert removed_rows(empty) == []


@pytest.mark.parametrize(("seed", "words"), [(1, 200_000), (2, 3000), (3, 300)])
def test_passages(spark, monkeypatch, seed, words):
    """Also with small shards, in which anchors of many classes are cut into windows."""
    monkeypatch.setattr(substring, "SHARD_WORDS", words)
    seen = []
    monkeypatch.setattr(substring, "_by_window", lambda *a, f=substring._by_window: seen.append(1) or f(*a))
    rows = passages(random.Random(seed))
    want = brute_removed(rows)
    assert ordered(removed_rows(spark.createDataFrame(rows, SCHEMA))) == ordered(want)
    assert sum(r[2] for r in want) > 2000 and bool(seen) == (words < 200_000)


def longest(text, at, others, most):
    """Longest match of text[at:] in any of the others, at most ``most``."""
    return max((next((k for k in range(most) if at + k >= len(text) or i + k >= len(o) or text[at + k] != o[i + k]), most) for o in others for i in range(len(o))), default=0)


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    """Of texts that the index holds and of others, with words it lacks, against all pairs of places."""
    rng = random.Random(seed)
    size = rng.choice([2, 3, 30])
    text = lambda: np.array([rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 60))], dtype=np.int64)
    held = [text() for _ in range(12)]
    docs = np.array([rng.randrange(100) for _ in held])
    index = substring.FMIndex(held, docs, most=9)
    asked = [*held, *(np.concatenate([held[k][3:], text(), [0], held[k + 1][:20]]) for k in range(8)), np.array([], dtype=np.int64), np.array([size + 5, 1])]
    got = [np.full(len(t), -1) for t in asked]
    for who, place, length, _ in index.statistics(asked):
        for w, p, k in zip(who, place, length, strict=True):
            got[w][p] = k
    for t, g in zip(asked, got, strict=True):
        assert g.tolist() == [longest(t.tolist(), i, [h.tolist() for h in held], 9) for i in range(len(t))]
    for t, low in zip(asked, index.first_documents(asked), strict=True):
        for i, d in enumerate(low):
            w = t[i : i + 9].tolist()
            assert d == min((docs[k] for k, h in enumerate(held) if any(h[j : j + 9].tolist() == w for j in range(len(h) - 8))), default=substring.LAST)


def test_segments_cover_all_windows():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 50, 3000).astype(np.uint64)
    h[500:1500] = 7
    anchor, content, at, n = substring.segments(h)
    assert at.tolist() == [0, *np.cumsum(n)[:-1]] and n.sum() == 3000 - substring.WINDOW + 1 and n.max() <= substring.RUN
    shifted = substring.segments(np.concatenate([h[:100], h]))  # equal windows have equal anchors wherever they are
    name = lambda s, k: np.repeat(s[0], s[3])[k]
    assert all(name((anchor, content, at, n), i) == name(shifted, i + 100) for i in range(2900))


def whitened_rows(df):
    return whitening.whiten(df).toPandas()


def brute_whitened(vectors):
    x = np.array([np.floor(64 * np.array(v)) + 1_000_000 for v in vectors])
    z = x - x.mean(0)
    e, u = np.linalg.eigh(z.T @ z / len(x))
    return x, z, e[::-1], u[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 40)) * np.geomspace(5, 0.05, 40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    vectors = [[float(np.float32(c)) for c in v] for v in base]
    bad = [None, [], [None] * 40, [1.0] * 39 + [float("nan")], [float("inf")] + [0.0] * 39, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, vectors[0]), (5, vectors[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in [*CLASHES, "component", "n", "size", "v", "pos"]))
    got = whitened_rows(df)
    used = [v for _, v in rows if v and len(v) == 40 and None not in v and np.isfinite(v).all()]
    x, z, e, u = brute_whitened(used)
    assert len(got) == 32 * len(used) and set(got.n) == {len(used)}
    explained = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(explained, e[:32] / e.sum(), rtol=1e-6) and got.identity_error.iloc[0] < 1e-9
    w = z @ u[:, :32] / np.sqrt(e[:32])
    exact = [sum((len(used) * int(a) - s) ** 2 for a, s in zip(r, map(int, x.sum(0)), strict=True)) for r in x]
    one = got[got.vec_id == 7].sort_values("component")
    assert np.allclose(np.abs(one.whitened), np.abs(w[7]), atol=1e-6) and set(one.deviation) == {exact[7]}
    pivot = got[(got.vec_id < 400) & (got.vec_id != 5)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    mine = np.delete(w[:400], 5, axis=0)
    assert np.allclose(pivot, mine * np.sign((pivot * mine).sum(0)), atol=1e-6)
    assert got[got.vec_id.isna()].whitened.tolist() and len(got[got.vec_id == 5]) == 64


def test_whitening_of_flat_directions(spark):
    """Directions without variance have no component; equal vectors have none at all."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(a), float(b), float(a + b), 3.0]) for i, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)))]
    got = whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert set(got.component) == {1, 2} and got.identity_error.max() < 1e-9 and math.isclose(got.drop_duplicates("component").explained.sum(), 1)
    for some in ([(1, [1.0, 2.0])] * 3, [], [(1, None)]):
        assert not len(whitened_rows(spark.createDataFrame(some, "vec_id long, embedding array<double>")))


def test_whitening_of_large_entries(spark):
    """Sums and deviations stay exact beyond 2**53; what a long can't hold is null."""
    rows = [(i, [1e9 * i, float(i % 3)]) for i in range(20)]
    got = whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((20 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for i, r in enumerate(x)}
    assert want[10] > 2**63 > 2**53
    for i, d in got.drop_duplicates("vec_id").set_index("vec_id").deviation.items():
        assert np.isnan(d) if want[i] >= 2**63 else d == want[i]
    wide = whitened_rows(spark.createDataFrame([(i, [1e300 * (-1) ** i, float(i)]) for i in range(6)], "vec_id long, embedding array<double>"))
    assert len(wide) and np.isfinite(wide.whitened).all()


@pytest.mark.parametrize("seed", range(4))
def test_jacobi(seed):
    """Small eigenvalues keep their digits in a matrix scaled by large and small factors."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(12, 12))
    a = a @ a.T + np.eye(12) * 0.1
    e, v = whitening.jacobi(a)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], rtol=1e-10) and np.allclose(v @ a @ v.T, np.diag(e), atol=1e-10)
    d = np.geomspace(1, 1e-8, 12)
    small = whitening.jacobi(a * d[:, None] * d)[0]
    exact = 1 / np.linalg.eigvalsh(np.linalg.inv(a) / d[:, None] / d)
    assert math.isclose(small[-1], min(exact), rel_tol=1e-9)


def test_pairs_of_partial_sums():
    """Products beyond 2**53 are summed exactly."""
    y = np.array([[2**31, -(2**30)], [2**31 - 1, 5]], dtype=np.int64)
    assert whitening._products(y) == [2**62 + (2**31 - 1) ** 2, -(2**61) + 5 * (2**31 - 1), 2**60 + 25]
    assert whitening._columns(np.array([[2**62], [2**62], [2**62]])) == [3 * 2**62]


def test_all_pairs_of_windows_are_judged_by_words():
    assert list(itertools.islice(substring.FMIndex([np.array([1, 2, 3])], np.array([4]), most=2).first_documents([np.array([2, 3, 1])]), 1))[0].tolist() == [4, substring.LAST]


def test_limbs():
    """Sums of limbs are sums of the numbers, also of negative ones and beyond 2**127."""
    rng = random.Random(3)
    rows = [[rng.randrange(-(2**140), 2**140) >> rng.randrange(140) for _ in range(5)] for _ in range(50)]
    parts = [whitening.limbs(r) for r in rows]
    assert all(-(2**63) <= v < 2**63 for p in parts for v in p)
    assert whitening.whole([sum(c) for c in zip(*parts, strict=True)]) == [sum(c) for c in zip(*rows, strict=True)]
