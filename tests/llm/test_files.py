"""Packing, WARC, mixing and the pipeline."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, packing, warc


@pytest.fixture(scope="module")
def reference_tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


TEXTS = ["", "plain words, here's  one\n\n two", "naïve éèê ÄÖÜß ñ", "日本語のテキスト", "🚀🚀 emoji  ", "a b c　d", "tabs\t\tand\r\n lines \x0b\x0c", "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext|", "x" * 5000, "1234567890 ½ ²", "​﻿́e", "Ǆ ǅ ʰ ͅ"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(reference_tokenizer, text):
    assert packing.encoder()(text) == reference_tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_documents(spark, reference_tokenizer):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    encode = packing.encoder()
    assert all(encode(t) == e.ids for t, e in zip(texts, reference_tokenizer.encode_batch(texts, add_special_tokens=False)))


def check_packing(rows, texts, encode):
    """Every token of every document, once and gapless."""
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(sequences)


def test_packing(clashing, corpus, empty):
    rows = packing.pack_documents(clashing.select("doc_id", "text")).collect()
    n = check_packing(rows, [(r[0], r[1]) for r in corpus], packing.encoder())
    assert n <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
    assert packing.pack_documents(empty).count() == 0


def test_pack_tokens(spark):
    r = packing.pack_documents(spark.createDataFrame([(1, "hello world")], "doc_id long, text string"), tokens=True).first()
    assert r.ids == [*packing.encoder()("hello world"), 0] and (r.sequence_id, r.offset) == (0, 0)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    h = collections.Counter(min(64, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(rng.choice([3, 50, 5000])))
    patterns = packing.plan(dict(h), 64)
    used = collections.Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == h
    total, bins = sum(n * c for n, c in h.items()), sum(t for _, t in patterns)
    assert bins <= max(-(-total // 64) * 1.05 + 1, sum(c for n, c in h.items() if n > 32))


def test_special_token():
    assert packing.encoder()("<|endoftext|>") == [50256]


def test_index_of_sums():
    lengths = np.array([2, 3, 5, 7, 20])
    pairs, triples = packing.index_sums(lengths, 24)
    want2, want3 = collections.defaultdict(set), collections.defaultdict(set)
    for x, y in itertools.combinations_with_replacement(lengths.tolist(), 2):
        if x + y < 24:
            want2[x + y].add(y)
    for x, y, z in itertools.combinations_with_replacement(lengths.tolist(), 3):
        if x + y + z < 24:
            want3[x + y + z].add(z)
    assert {k: set(v.tolist()) for k, v in pairs.items()} == want2
    assert all(want3[k] <= set(triples[k].tolist()) for k in want3) and [v.tolist() == sorted(v.tolist(), reverse=True) for v in triples.values()]


def test_exact_complements():
    assert sorted(packing.plan({1500: 2, 548: 2})) == [((1500, 548), 2)]
    assert sorted(packing.plan({1000: 1, 600: 1, 448: 1})) == [((1000, 600, 448), 1)]
    assert sorted(packing.plan({1000: 3, 600: 3, 300: 3, 148: 3})) == [((1000, 600, 300, 148), 3)]


PAGES = "page_id long, url string, html string, extra string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<html>" + "é" * 700 + "</html>"
    rows = [(i, f"http://a/{i}", big if i % 3 else f"<p>{i}</p>" * (i * 7), "x") for i in range(60)]
    rows += [(100, "http://b", None, "x"), (101, None, "", "x"), (102, "http://c d\r\nX: y", "small", "x"), (103, "http://e", "small", "x"), (None, "http://f", big, "x"), (5, "http://a/5", big, "x")]
    return spark.createDataFrame(rows, PAGES)


def test_warc(spark, pages, tmp_path):
    out = []
    for name in ("a", "b"):  # twice: the same files
        files = warc.write(pages.repartition(3 if name == "a" else 7), f"file://{tmp_path}/{name}", roll=2000, shard_bytes=9000).orderBy("name").collect()
        assert len(files) > 3 and all(hashlib.sha1((tmp_path / name / f["name"]).read_bytes()).hexdigest() == f.sha1 for f in files)
        assert not list((tmp_path / name / "_temporary").iterdir())
        out.append([(f["name"], f.sha1, f.records) for f in files])
    assert out[0] == out[1] and sum(n for *_, n in out[0]) == pages.count()
    assert [warc.records(f"file://{tmp_path}/a/{n}") is not None for n, *_ in out[0]]
    last = {}
    rows = pages.collect()
    for r in rows:
        data = (r.html or "").encode()
        if len(data) >= warc.LEAST:
            last[data] = max(last.get(data, -1), r.page_id if r.page_id is not None else -1)
    want = collections.Counter()
    for r in rows:
        data = (r.html or "").encode()
        to = last.get(data)
        again = to is not None and r.page_id is not None and r.page_id < to
        want[r.page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", to if again else None] += 1
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_of_far_ids(spark, tmp_path):
    """One outlying id, the least and largest longs and many rows without id leave the others in many shards."""
    ids = [*range(300), 2**62, 2**63 - 1, -(2**63) + 1, *[None] * 100]
    rows = [(i, "http://a", f"{k} " * 400) for k, i in enumerate(ids)]
    files = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a", shard_bytes=20_000).collect()
    per = collections.Counter()
    for f in files:
        per[f.shard] += f.records
    assert len(per) > 15 and max(per.values()) < 60
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert collections.Counter((r.page_id, r.payload_bytes) for r in got) == collections.Counter((i, len(h)) for i, _, h in rows)


def test_warc_payloads(spark, pages, tmp_path):
    warc.write(pages, f"file://{tmp_path}/c")
    got = {h["X-Page-Id"]: (h, b) for p in sorted((tmp_path / "c").glob("*.gz")) for h, b in warc.records(f"file://{p}") if h["WARC-Type"] == "response"}
    head, block = got["102"]
    assert block.partition(b"\r\n\r\n")[2] == b"small" and head["WARC-Target-URI"] == "http://c%20d%0D%0AX:%20y"
    assert warc.write(pages.limit(0), f"file://{tmp_path}/d").count() == 0 and warc.read(spark, f"file://{tmp_path}/d").count() == 0


def test_mixing_reaches_targets(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x, domains = mixing.rates(docs.select("doc_id", "text"), labels)
    r = x.toPandas()
    n, p = r.n_tokens.to_numpy(float), r[["_p0", "_p1"]].to_numpy()
    assert domains == [0, 1] and np.allclose(p.sum(1), 1) and (r.rate >= 0).all()
    assert np.allclose((n * r.rate) @ p / n.sum(), [0.05, 0.95], atol=1e-4)
    assert (r.miss <= mixing.TOLERANCE).all()
    # rates are those of a dual vector: 1 less its product with the posterior, or 0
    dual = np.linalg.lstsq(p[r.rate > 0], 1 - r.rate[r.rate > 0], rcond=None)[0]
    assert np.allclose(np.maximum(0, 1 - p @ dual), r.rate, atol=1e-4)
    y = labels.toPandas().set_index("doc_id").quality
    known = r[r.doc_id.isin(y.index)]
    assert ((known._p1 > 0.5) == (known.doc_id.map(y) == 1)).mean() > 0.95


@pytest.mark.parametrize("weights,reached", [({0: 0.9, 1: 0.1}, False), ({0: 0.5, 1: 0.5}, True), ({0: 0.3, 1: 0.7}, True)])
def test_mixing_of_far_targets(spark, weights, reached):
    """Labels that don't belong to the documents: targets in reach are met, and for others the miss is said and lowered."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = docs.select("doc_id", (F.xxhash64("doc_id") % 2 == 0).cast("int").alias("quality"))
    r = mixing.rates(docs, labels, weights=weights)[0].toPandas()
    n, p = r.n_tokens.to_numpy(float), r[["_p0", "_p1"]].to_numpy()
    target = np.array([weights[0], weights[1]])
    first, last = n @ p / n.sum() - target, (n * r.rate.to_numpy()) @ p / n.sum() - target
    assert np.allclose(r.miss, np.abs(last).max(), atol=1e-7) and (r.rate >= 0).all()
    assert (np.abs(last).max() <= mixing.TOLERANCE) == reached
    inverse = np.linalg.inv((p.T * n) @ p / n.sum())
    assert last @ inverse @ last <= first @ inverse @ first


def test_three_domains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = docs.select("doc_id", (F.when(F.length("text") < 500, 0).when(F.length("text") < 2000, 1).otherwise(2)).alias("size"))
    x, domains = mixing.rates(docs, labels, "size", {0: 0.2, 1: 0.3, 2: 0.5})
    r = x.toPandas()
    n, p = r.n_tokens.to_numpy(float), r[["_p0", "_p1", "_p2"]].to_numpy()
    assert domains == [0, 1, 2] and np.allclose((n * r.rate) @ p / n.sum(), [0.2, 0.3, 0.5], atol=1e-5)


def test_mixing_edges(clashing, empty, corpus, labels, spark):
    got = mixing.mix(clashing, labels, protect=(1,), keep_likely=True)
    assert got.columns == clashing.columns and got.where("rate != 'own rate' OR copies != 'own copies'").count() == 0
    assert mixing.mix(empty, labels).count() == 0
    same = mixing.mix(clashing, spark.createDataFrame([], "doc_id long, quality int"))
    assert same.count() == len(corpus)  # no labels: every rate is 1
    assert mixing.rates(empty.select("doc_id", "text"), labels)[0].count() == 0
    x, _ = mixing.rates(clashing.select("doc_id", "text"), labels, protect=(1,), keep_likely=True)
    assert x.where("_p1 >= 0.5 AND copies < 1").count() == 0


def test_pipeline(spark):
    """Stage by stage at a small scale: what each must keep and drop."""
    import corpus_pipeline as c

    from .test_dedup import brute_components

    d = "/root/testdata/sf0.001"
    first = docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in c.STAGES:
        before = docs
        docs = stage(spark, docs, d).persist()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == first.columns
        if name == "near-dedup":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in kept[name]) == sorted({x for _, x in want.values()})
        if name == "packing":
            check_packing(kept[name], [(r.doc_id, r.text) for r in before.collect()], packing.encoder())
    assert [n for n, _ in c.STAGES] == ["toxicity", "line dedup", "near-dedup", "mixing", "packing"]
    assert 0 < len(kept["toxicity"]) < first.count() and kept["packing"]
    assert docs.agg(F.countDistinct("doc_id")).first()[0] <= len(kept["near-dedup"])


@pytest.mark.parametrize("kind", ["corpus", "empty"])
def test_pipeline_edges(spark, clashing, empty, kind):
    """Nulls, repeated rows, empty and long texts and clashing columns, or no rows at all, pass through every stage."""
    import corpus_pipeline
    from quern.session import materialize

    docs = clashing if kind == "corpus" else empty
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "/root/testdata/sf0.001"), "edge-stage")
        if name != "packing":
            assert docs.columns == columns, name
        if kind == "corpus" and name == "near-dedup":
            texts = [r.text for r in docs.where("doc_id IS NOT NULL").collect() if (r.text or "").strip()]
            assert len(texts) == len(set(texts)) > 20
    if kind == "empty":
        assert docs.count() == 0
    else:
        assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(docs.columns)
        packed = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
        assert packed and all(r[1] <= 2048 for r in packed)
