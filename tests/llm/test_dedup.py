"""Near-dedup, line dedup and fingerprints against brute force."""

import collections
import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup, near_dup, spotsigs
from quern.llm.common import WordHash


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        s, t = sets[a], sets[b]
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_dedup(docs, corpus):
    want = brute_components([(r[0], r[1]) for r in corpus if r[0] is not None])
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
        else:
            assert r.component_id is None and not r.kept


def test_near_dedup_of_large_nodes(docs, corpus, monkeypatch):
    """With tiny leaves the near copies go through deeper levels and then blocks; the links are the same."""
    seen = []
    monkeypatch.setattr(near_dup, "_rest_blocks", lambda large, *rest, f=near_dup._rest_blocks: seen.append(large.count()) or f(large, *rest))
    monkeypatch.setattr(near_dup, "LIMIT", 12)
    monkeypatch.setattr(near_dup, "PIVOTS", 4)
    monkeypatch.setattr(near_dup, "MAX_DEPTH", 2)
    want = brute_components([(r[0], r[1]) for r in corpus if r[0] is not None])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert all(got[i] == c for i, (_, c) in want.items()) and seen[0] > 12


def test_near_dedup_without_ids(spark):
    """Rows without doc_id link others; a component without any has a null id and one_of_each keeps one row of it."""
    w = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("x" if i in at else v for i, v in enumerate(w))
    # 7 and 9 are only linked through the row without doc_id
    rows = [(7, near(0)), (None, near()), (9, near(59)), (None, "own words of a row that has no copy at all"), (None, " ".join(f"v{i}" for i in range(30))), (None, " ".join(f"v{i}" for i in range(31)))]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_duplicates(x).collect()}
    assert got[7, 56] == (7, True) and got[9, 56] == (7, False) and got[None, 56] == (7, False)
    assert got[None, 26] == got[None, 27] == (None, False)
    kept = [r.doc_id for r in near_dup.one_of_each(x).collect()]
    assert kept.count(7) == 1 and 9 not in kept and kept.count(None) == 2


def test_near_dedup_of_repeated_ids(spark):
    """Rows that share a doc_id are judged each by its own text."""
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w)), (1, " ".join(f"long{i}" for i in range(500))), (2, " ".join([*w[:59], "other"])), (3, " ".join(f"long{i}" for i in range(495)))]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 56): 1, (1, 496): 1, (2, 56): 1, (3, 491): 1}


def test_near_dedup_in_bounded_blocks(docs, corpus, monkeypatch):
    """Blocks of few shingles, bit sets of few columns and joins that spread every key give the same components."""
    from quern.llm import common

    monkeypatch.setattr(near_dup, "BLOCK", 3000)
    monkeypatch.setattr(near_dup, "BITS", 2000)
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(common, "FEW", -1)
    want = brute_components([(r[0], r[1]) for r in corpus if r[0] is not None])
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    assert all(got[i] == c for i, (_, c) in want.items())


def test_near_dedup_of_long_texts(spark):
    """Near copies of 60,000 words, of which each differs from the one before by about a tenth."""
    w = [f"w{i}" for i in range(60_000)]
    rows = [(k, " ".join("x" if (i + 17 * k) % 50 == 0 and k else v for i, v in enumerate(w))) for k in range(6)]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(x).collect()} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_near_dedup_of_short_texts(spark):
    """Every text of seven words is linked with itself and one word more: three of four shingles."""
    rows = [(2 * i + k, " ".join(f"s{i}w{j}" for j in range(7 + k))) for i in range(1500) for k in range(2)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("component_id != doc_id - doc_id % 2")
    assert got.count() == 0


def test_one_of_each(clashing, corpus, empty):
    want = brute_components([(r[0], r[1]) for r in corpus if r[0] is not None])
    got = near_dup.one_of_each(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted({c for _, c in want.values()})
    assert sum(r.doc_id is None for r in rows) == 1 and all(r.set_id == "own set_id" for r in rows)
    assert near_dup.one_of_each(empty).count() == 0


def brute_lines(rows, min_tokens=line_dedup.MIN_TOKENS):
    """The rows without lines of recurring templates, by dictionaries; for texts without variable fields to mask."""
    split = lambda t: [" ".join(x.split()) for x in (t or "").split("\n")]
    held = collections.defaultdict(set)  # line: texts and ids
    for i, t in rows:
        for line in split(t):
            if len(line.split()) >= min_tokens:
                held[line].add((t, float("inf") if i is None else i))
    texts = lambda some: {t for line in some for t, _ in held[line]}
    first = lambda some: min(i for line in some for _, i in held[line])
    needed = lambda line: max(2, min(line_dedup.MIN_TEXTS, -(-line_dedup.LONG // len(line.split()))))
    keep = {line: first([line]) for line in held if len(texts([line])) >= needed(line)}
    leaves = collections.defaultdict(list)
    for line in held:
        if line not in keep:
            leaves[len(line.split()), *line.split()[: line_dedup.DEPTH]].append(line)
    for some in leaves.values():
        count = {}
        for pos, token in {(p, w) for line in some for p, w in enumerate(line.split())}:
            count[pos, token] = len(texts([line for line in some if line.split()[pos] == token]))
        for level in range(6):
            groups = collections.defaultdict(list)
            for line in some:
                shape = tuple((p, w) for p, w in enumerate(line.split()) if count[p, w] >= needed(line) * 4**level)
                if len(shape) >= line_dedup.SIMILAR * len(line.split()):
                    groups[shape].append(line)
            for group in groups.values():
                if len(texts(group)) >= needed(group[0]):
                    for line in group:
                        keep.setdefault(line, first(group))
    own = lambda i: float("inf") if i is None else i
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if keep.get(" ".join(x.split()), own(i)) == own(i))) for i, t in rows]


def test_line_dedup(docs, corpus):
    got = line_dedup.clean(docs).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_lines([(r[0], r[1]) for r in corpus]))


def test_line_templates(spark):
    """Variable fields, marked or found by comparing lines, make one template."""
    rows = [(i, f"page {i} of {i + 7} printed for user{i}@example.com\nbody text number {chr(97 + i)} with own words\nthe quick brown fox jumps over the lazy {'abcdefgh'[i]} dog today") for i in range(8)]
    got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all("page" not in got[i] and "quick" not in got[i] for i in range(1, 8))


@pytest.mark.parametrize("hot", [1, 10_000])
def test_line_trees(spark, monkeypatch, hot):
    """Lines of few leaves with fields that take rare or frequent values, short and very long, against dictionaries."""
    from quern.llm import common

    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(common, "FEW", -1 if hot == 1 else common.FEW)
    rng = random.Random(11)
    letters = [a + b for a in "abcdef" for b in "ghijkl"]
    rows = []
    for i in range(400):
        own = [f"page {w} belongs to the {rng.choice(letters[:6])} section of our {rng.choice(letters)} site and to {rng.choice(letters)}x{rng.choice(letters)} here" for w in ("alpha", "beta")]
        long = " ".join(["passage of many words"] + [rng.choice(letters) if k == 30 else f"{chr(97 + k % 26)}word" for k in range(60)])
        few = " ".join(rng.choice(letters) for _ in range(rng.choice([2, 3, 4])))
        rows.append((i, "\n".join(rng.sample([*own, long, few, f"own {rng.choice(letters)} line of {i % 7 * 'x'} text"], rng.randint(1, 4)))))
    rows += [(3000 + i, f"home page\nown text {letters[i]}") for i in range(8)] + [(1000 + i, "some words " * 30 + "end") for i in range(3)] + [(2000 + i, f"own text\n{'a long line of two texts ' * 12}{'ab'[i // 2]}") for i in range(4)] + rows[:3] + [(None, rows[5][1])]
    got = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_lines(rows))
    every = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, every)) == collections.Counter(brute_lines(rows, 1)) != collections.Counter(map(tuple, got))


@pytest.mark.parametrize("n", [39, 40, 41, 60, 200])
def test_long_templates(spark, n):
    """A line with one changed word recurs whatever its length."""
    rows = [(i, " ".join(f"x{'abcdefghijkl'[i]}" if k == 7 else f"{chr(97 + k % 26)}word" for k in range(n))) for i in range(12)]
    assert line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 11


def test_passages_of_two_texts(spark):
    """A passage of over 50 words is a template once two texts hold it; a short line isn't."""
    passage = " ".join(f"{chr(97 + k % 26)}word" for k in range(51))
    own = [" ".join(f"{c}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)) for c in "xyz"]
    rows = [(i, f"{passage}\n{own[i]}\na short line") for i in range(2)]
    got = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {1: f"{own[1]}\na short line"}


@pytest.mark.parametrize("own", [30, 31])
@pytest.mark.parametrize("changed", [False, True])
def test_passages_of_four_texts(spark, own, changed):
    """A passage of 60 words goes from all but the first of four texts, whatever stands around it and with a changed name too."""
    around = lambda i: " ".join(f"{'abcd'[i]}{k}x" for k in range(own))
    passage = lambda i: " ".join(f"n{'abcd'[i]}n" if changed and k == 20 else f"{chr(97 + k % 26)}word" for k in range(60))
    rows = [(i, f"{around(i)}\n{passage(i)}\n{around(i)[::-1]}") for i in range(4)]
    got = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_dropped").collect()
    assert dict(map(tuple, got)) == {0: 0, 1: 1, 2: 1, 3: 1}


def test_line_dedup_sql(duck, spark):
    import duckdb

    rng = random.Random(2)
    rows = [(i, "\n".join(f"seen {rng.randrange(9)} times by {rng.choice(['ann', 'bob', 'eve', f'u{chr(97 + i % 26)}'])} in room {rng.choice('abcdefghij')}" for _ in range(3))) for i in range(60)]
    c = duckdb.connect()
    import pandas as pd

    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_dropped", "text").collect()
    assert sorted(map(tuple, got)) == sorted(c.execute(line_dedup.OP7_SQL).fetchall())


def _two_templates(i):
    """Lines of ten tokens of which the first four are alike, of two templates with one variable field each."""
    return f"please note that this offer from {'abcdefgh'[i]}x ends very soon", f"please note that this {'abcdefgh'[i]}y page was moved last week"


def test_templates_of_one_leaf(spark):
    """Each is found, also if as many texts have the one as the other, in the same texts or in others."""
    for rows in ([(i, "\n".join(_two_templates(i))) for i in range(8)], [(2 * i + k, _two_templates(i)[k]) for i in range(8) for k in range(2)]):
        got = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0]
        assert got == 14


def test_copies_do_not_vote(spark):
    """A document of many copies, or a line repeated in a text, hides no template of its leaf."""
    own = "please note that this line stands in many equal copies"
    rows = [(100 + i, own) for i in range(50)] + [(i, _two_templates(i)[0]) for i in range(8)] + [(200, "\n".join([own + "!"] * 50))]
    got = {r.doc_id: r.n_dropped for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: int(0 < i < 8) for i, _ in rows}


def test_copies_make_no_template(spark):
    rows = [(i, "a line that copies share\nand one more line of it") for i in range(50)]
    assert line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_dedup_edges(clashing, empty):
    got = line_dedup.dedup(clashing)
    assert got.columns == clashing.columns and got.where("gone != 'own gone' OR n_dropped != 'own n_dropped'").count() == 0
    assert got.where("text IS NOT NULL AND n_chars != length(text)").count() == 0
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.clean(empty).count() == 0


def test_fingerprints(clashing, corpus, empty):
    rows = sorted(((r[0], r[1] or "") for r in corpus if r[0] is not None), key=lambda r: -r[0])
    got = spotsigs.fingerprints(clashing, 5).collect()
    assert len(got) == len(corpus)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    single = [r for r in rows if len(by[r[0]]) == 1]
    order = [*rows, *((None, r[1]) for r in corpus if r[0] is None)]
    for k, (i, t) in enumerate(order):
        if i is None or (i, t) not in single:
            continue
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = by[i][0]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert spotsigs.fingerprints(empty, 3).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id is not None and dict(rows)[r.doc_id] == corpus[10][1]}) == 1


def test_ranges_of_far_ids(spark):
    """One outlying id, the least and largest longs and rows without id leave the others in many ranges."""
    rows = [(i, f"the cat number {i} sat") for i in range(500)] + [(2**63 - 1, "the last"), (-(2**63) + 1, "the first"), (None, "no id")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    per = spotsigs.with_next(x, 20)[0].groupBy("shard").count().collect()
    assert len(per) > 10 and max(r["count"] for r in per) < 100
    order = sorted(rows, key=lambda r: -(2**64) if r[0] is None else r[0], reverse=True)
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprints(x, 20).collect()}
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]], strict=True):
        m = len(t) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()


def test_repeated_ids_at_a_border(spark):
    """Rows of one id, of more than one range, follow one another, and the last the next id's first."""
    rows = [(1, f"the text {i} of one id") for i in range(300)] + [(0, "the zero")] + [(2, "the two")]
    x = spark.createDataFrame(rows, "doc_id long, text string")
    shards = spotsigs.with_next(x, 10)[0].where("carry = 0").select("shard").distinct().count()
    got = [r.edited_sha256 for r in spotsigs.fingerprints(x, 10).collect()]
    order = [r.text for r in x.orderBy(F.desc("doc_id"), F.desc(F.xxhash64("text"))).collect()]
    want = [hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in zip(order, [*order[1:], order[0]], strict=True)]
    assert shards > 5 and sorted(got) == sorted(want)


def brute_likeness(rows):
    """near_edited and near_next of single documents, by plain sets."""
    h = WordHash()
    sig = lambda t: set(spotsigs.signatures(t, h).tolist())
    like = lambda s, t: len(s & t) / len(s | t) if s | t else 1.0
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        m = len(t) // 3
        out[i] = like(sig(t), sig(t[: len(t) - m] + nxt[:m])), like(sig(t), sig(nxt))
    return out


def test_likeness_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = brute_likeness(sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True))
    found = {r.doc_id: r for r in spotsigs.fingerprints(docs, 7).collect()}
    got = {i: (r.near_edited, r.near_next) for i, r in found.items()}
    for i, j in zip(sorted(found, reverse=True), [*sorted(found, reverse=True)[1:], max(found)], strict=True):  # what is stated is the fingerprints' own
        assert found[i].near_edited == spotsigs.likeness(found[i].fingerprint, found[i].edited_fingerprint) and found[i].near_next == spotsigs.likeness(found[i].fingerprint, found[j].fingerprint)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(w) for i, w in want.items())


def test_similarity_of_full_sets(spark):
    """Sets of more than KEEP signatures are compared whole."""
    h = WordHash()
    rows = [(i, " ".join(f"the w{j} v{j}" for j in range(i, i + 400))) for i in range(0, 300, 60)]
    sets = {i: set(spotsigs.signatures(t, h).tolist()) for i, t in rows}
    for r in spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect():
        s, t = sets[r.doc_id], sets[(r.doc_id - 60) % 300]
        assert len(s) > 300 and r.near_next == pytest.approx(len(s & t) / len(s | t))
        own, nxt = dict(rows)[r.doc_id], dict(rows)[(r.doc_id - 60) % 300]
        e = set(spotsigs.signatures(own[: len(own) - len(own) // 3] + nxt[: len(own) // 3], h).tolist())
        assert r.near_edited == pytest.approx(len(s & e) / len(s | e))


def test_one_row_follows_itself(spark):
    r = spotsigs.fingerprints(spark.createDataFrame([(5, "the cat and the dog sat on the mat")], "doc_id long, text string"), 3).collect()
    assert len(r) == 1 and r[0].near_next == 1.0


@pytest.mark.parametrize("a,b", [("the old cat of my house and the new dog", "the old cat of my house and the new dog"), ("the old cat of my house and a new dog", "the old cat of my house"), ("no anchors here", "no anchors there"), ("", "x"), ("", "")])
def test_likeness(a, b):
    h = WordHash()
    s, t = spotsigs.signatures(a, h), spotsigs.signatures(b, h)
    x, y = set(s.tolist()), set(t.tolist())
    want = len(x & y) / len(x | y) if x and y else float(a == b)
    assert spotsigs.likeness(*(spotsigs.fingerprint(spotsigs.spots(k)) for k in (s, t))) == pytest.approx(want)


def test_matches(spark):
    base = [f"the {w} of {v} and " for w, v in itertools.product(("red", "old", "big", "wet", "low"), ("cat", "dog", "cow", "pig", "hen"))]
    texts = ["".join(base), "".join(base[:-1]), "".join(base[2:]), "".join(base[:8]), "".join(base[12:]), "the end of it all", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    h = WordHash()
    sets = [set(spotsigs.signatures(t or "", h).tolist()) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75}
    assert {(r.a, r.b) for r in spotsigs.matches(docs).collect()} == want and want


def test_line_dedup_reads_texts_once(spark):
    """The lines of the templates come from the written lines, not from another pass over all texts."""
    from quern.llm import line_dedup

    seen = spark.sparkContext.accumulator(0)

    def count(it):
        for batch in it:
            seen.add(batch.num_rows)
            yield batch

    texts = [(i, f"alpha beta gamma delta epsilon {'abcdefgh'[i]}x zeta eta theta iota\nown {'abcdefgh'[i]} words here") for i in range(8)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").mapInArrow(count, "doc_id long, text string")
    found = line_dedup.recurring(docs).where("doc != first").count()
    assert (found, seen.value) == (7, 8)


def _lines_of_leaves():
    """Texts with near copies of long lines, of which a text has one, and several short lines of one leaf."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        long = " ".join(f"{'abcdef'[rng.randrange(6)]}x" if k in (20, 41, i % 9 + 5) else f"{chr(97 + k % 26)}word" for k in range(70))
        short = [f"please see the note {rng.choice('abcdef')} about {rng.choice('xyz')} in our list" for _ in range(rng.randint(0, 3))]
        rows.append((i, "\n".join([*short, f"{'abc'[i % 3]} {long}"])))
    return [*rows, rows[0], (None, rows[1][1]), (500, rows[2][1]), (501, None), (502, "")]


@pytest.mark.parametrize("small", [0, 1000, 10**9])
def test_small_and_large_leaves(spark, monkeypatch, small):
    """Leaves judged within a task and leaves dealt over tasks give what dictionaries give."""
    monkeypatch.setattr(line_dedup, "LEAF_TOKENS", small)
    rows = _lines_of_leaves()
    got = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute_lines(rows))


def test_line_dedup_leaves_one_table(spark):
    """Of the tables it writes only its result stays, so they don't add to the disk of the shuffle of texts."""
    from quern import session

    before = len(session._written(spark))
    found = line_dedup.recurring(spark.createDataFrame(_lines_of_leaves(), "doc_id long, text string"))
    assert [p.split("/")[-1].split("-")[0] for p in session._written(spark)[before:]] == ["recurring"] and found.count()
    line_dedup.recurring(spark.createDataFrame([], "doc_id long, text string"))
    assert len(session._written(spark)) == before + 2


def test_small_leaves_shuffle_no_tokens(spark):
    """The fixed tokens and shapes of small leaves take the one shuffle of their lines."""
    rows = [("k", "c", 5, 9, 3, "one line of nine tokens that stands for many")]
    different = spark.createDataFrame(rows, "key string, check string, leaf long, tokens int, texts int, line string")
    shapes = line_dedup._shapes(line_dedup._few(different, 4))
    shapes.collect()
    text = shapes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("Exchange hashpartitioning") == 1
