"""Toxicity scores from a lexicon read through Levenshtein automata.

The lexicon is learned from labelled rows: words, and stems that several words continue, which many toxic and hardly
any clean documents hold, counted over families of like documents so that copies count once; a few fixed terms come
with it. The terms form a trie. Intersecting the trie with the Levenshtein automaton of each term (one edit from five
letters, two from eight, one for stems; two neighbouring letters that changed places are one edit) gives one automaton
over words, built lazily state by state; each distinct word runs through it once. Near-terms that clean documents use are
ordinary words. How much other misspellings of a term count follows from the toxic documents that hold such ones and from
the clean documents in which near-terms were seen once, which tell how many are still unseen. Every hit is weighed in a
window of ``WINDOW`` words: reporting verbs and quotation marks around it lower it, address in the second person raises it,
other hits nearby add up. A logistic model over a few sums of these, fitted with a prior, gives the score.

The fit uses at most ``PER_CLASS`` labelled documents of each class, the first by hash of their id, and never one
whose crc32(doc_id) mod 5 is 0. Classes that are cut are cut by different shares, which the model's intercept allows for,
so scores keep to the classes' shares among all training labels. Scores use the text alone. What the fit sends to the driver
is bounded by that sample: terms that a hundredth of its toxic documents hold, near-terms of its clean ones, and five numbers
for each row; a labelled doc_id of several rows gives one, its least text. Words of fewer than ``LETTERS`` letters are no
terms.

Edge cases: null and empty texts score as texts without hits; a null doc_id counts as not held out and is never a
training row; a doc_id labelled more than once is toxic if any label says so; null labels are ignored; without
toxic or clean training rows the fixed terms and prior weights decide; repeated rows are scored each; an empty table
gives no rows; extra columns are ignored by ``score`` and kept by ``drop_toxic``.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, documents, table, texts

PER_CLASS, WINDOW, SURPRISE, LETTERS = 4000, 10, 11.0, 4
WORD = re.compile(r"\w+")
#: Fixed values.
TERMS = "idiot moron loser scum trash stupid worthless pathetic disgusting clown imbecile retard bastard scumbag dumbass asshole bitch".split()
REPORTING = frozenset("said says say quote quoted quotes wrote writes called calls reads reported reports stated according dit écrit disait sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your yours youre ur du dich dir dein ihr euch tu toi te vous votre usted tú vosotros".split())
LEET = str.maketrans("013457", "oieast")
QUOTES = "\"“”„«»"
#: Prior weights: intercept, sum of terms, of these misspelled ones, best window, log density.
PRIOR = np.array([-3.0, 3.0, 0.0, 0.5, 0.5])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def edits_of(word: str, stem: bool) -> int:
    """How many edits of a term are looked for."""
    return 0 if len(word) < 5 else 1 if stem or len(word) < 8 else 2


class Lexicon:
    """Terms (word, stem?, weight, trust in misspellings) as one lazily determinised automaton.

    A state is a set of trie nodes, each with the edits spent to reach it. A node below 0 stands for two letters that
    changed places: the second one was read, the first is awaited.
    """

    def __init__(self, terms: list[tuple[str, bool, float, float]], ordinary: frozenset[str] = frozenset()) -> None:
        self.terms, self.ordinary = terms, ordinary
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        self.allowed = [edits_of(word, stem) if trust > 0 else 0 for word, stem, _, trust in terms]
        for k, (word, _, _, _) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], self.allowed[k])
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.ends.append([]), self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], self.allowed[k])
            self.ends[node].append(k)
        self.memo: dict[str, tuple[int, int] | None] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: dict[bytes, int] = {}
        self.sets: list[bytes] = []  # of each state its nodes and edits, packed
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []  # if the word ends here
        self.begun: list[tuple[int, int] | None] = []  # a stem was read: any ending does
        self.start = self._state({0: 0})

    def __reduce__(self):
        return Lexicon, (self.terms, self.ordinary)

    def _better(self, one: tuple[int, int] | None, two: tuple[int, int] | None) -> tuple[int, int] | None:
        """The term of fewer edits, of greater weight, that comes first."""
        return min((x for x in (one, two) if x), key=lambda x: (x[1], -self.terms[x[0]][2], x[0]), default=None)

    def _state(self, near: dict[int, int]) -> int:
        """The state of a set of trie nodes with the edits spent to reach each; -1: none."""
        queue = [n for n in near if n >= 0]
        while queue:  # letters of the term left out
            n = queue.pop()
            for child in self.children[n].values():
                if near[n] + 1 <= self.most[child] and near[n] + 1 < near.get(child, 9):
                    near[child] = near[n] + 1
                    queue.append(child)
        if not near:
            return -1
        key = array("q", sorted(n * 4 + e for n, e in near.items())).tobytes()
        if key in self.states:
            return self.states[key]
        at = self.states[key] = len(self.sets)
        self.sets.append(key), self.moves.append({})
        best, begun = None, None
        for n, e in near.items():
            for k in self.ends[n] if n >= 0 else ():
                if e <= self.allowed[k]:
                    best = self._better(best, (k, e))
                    if self.terms[k][1]:
                        begun = self._better(begun, (k, e))
        self.accepts.append(best), self.begun.append(begun)
        return at

    def _move(self, state: int, c: str) -> int:
        near: dict[int, int] = {}

        def reach(n: int, e: int, most: int) -> None:
            if e <= most and e < near.get(n, 9):
                near[n] = e

        for packed in array("q", self.sets[state]):
            n, e = packed >> 2, packed & 3
            if n < 0:
                if c == chr(-n % 0x110000):
                    reach(-n // 0x110000, e, 9)
                continue
            for letter, child in self.children[n].items():
                reach(child, e if letter == c else e + 1, max(self.most[child], 0 if letter == c else -1))
                if letter != c and (other := self.children[child].get(c)) is not None:
                    reach(-(other * 0x110000 + ord(letter)), e + 1, self.most[other])
            reach(n, e + 1, self.most[n])  # a letter too many
        return self._state(near)

    def find(self, word: str) -> tuple[int, int] | None:
        """Term and edits of a lower-cased word."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 150_000:
            self.memo.clear()
        if len(self.sets) > 30_000:  # start over, which changes no result
            self._clear()
        plain = word.translate(LEET) if not word.isalpha() else word
        state, out = self.start, None
        for c in plain:
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            state = to
            if state < 0:
                break
            if self.begun[state]:
                out = self._better(out, self.begun[state])
                if not out[1]:
                    break
        else:
            out = self._better(out, self.accepts[state])
        if out and out[1] and word in self.ordinary:
            out = None
        self.memo[word] = out
        return out

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Sums of all and of misspelled terms, the best window's sum, and the log of hits in a hundred words."""
        words = WORD.findall(text.lower())
        found = {w: f for w in set(words) if (f := self.find(w))}
        if not found:
            return 0.0, 0.0, 0.0, 0.0
        at = [i for i, w in enumerate(words) if w in found]
        spans = [m.span() for m in WORD.finditer(text.lower())] if any(q in text for q in QUOTES) else None
        weights, exact, fuzzy = [], {}, {}
        for i in at:
            k, edits = found[words[i]]
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            factor = 1.0
            addressed = not ADDRESS.isdisjoint(near)
            if not REPORTING.isdisjoint(near) or spans and _quoted(text, spans, i):
                factor = 0.8 if addressed else 0.4
            elif addressed:
                factor = 1.2
            value = self.terms[k][2] / 5 * factor * (self.terms[k][3] * 0.8**edits if edits else 1)
            weights.append(value)
            into = fuzzy if edits else exact
            into[k] = max(into.get(k, 0.0), value)
        best, low, total = 0.0, 0, 0.0
        for high, i in enumerate(at):
            total += weights[high]
            while at[low] < i - WINDOW:
                total -= weights[low]
                low += 1
            best = max(best, total)
        every = {k: max(exact.get(k, 0.0), fuzzy.get(k, 0.0)) for k in exact | fuzzy}
        return min(4.0, sum(every.values())), min(4.0, sum(v for k, v in fuzzy.items() if k not in exact)), min(4.0, best), float(np.log1p(100 * sum(weights) / len(words)))


def _quoted(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    """A quotation mark opens within the window before the word and one closes within the window after."""
    left, right = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
    start, end = spans[i]
    return any(q in text[left:start] for q in QUOTES) and any(q in text[end:right] for q in QUOTES)


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """text and toxic of at most PER_CLASS labelled documents of each class, and the log of how much that raises the odds of toxic."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = y.where("toxic = 1").orderBy(*order).limit(PER_CLASS).union(y.where("toxic = 0").orderBy(*order).limit(PER_CLASS))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = dict(y.groupBy("toxic").agg(F.count("*")).collect())
    clean, toxic = (max(1.0, n.get(k, 0) / PER_CLASS) for k in (0, 1))
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select("text", "toxic"), float(np.log(clean / toxic))  # at most 2 * PER_CLASS ids


def _stems(word: str) -> list[str]:
    return [f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k]


def fit(docs: DataFrame, labels: DataFrame, correct: bool = True) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and weights learned from the training rows; without ``correct`` misspelled terms don't count."""
    rows, raised = training_rows(docs, labels)
    rows = rows.persist()
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)

    def terms_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for t in texts(batch, "text"):
            words = {w for w in WORD.findall(t.lower()) if len(w) >= LETTERS}
            family = min((hash_of(w) for w in words), default=0)
            for w in words:
                for term in (w, *_stems(w)):
                    out[0].append(term), out[1].append(family), out[2].append(w)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["term", "family", "word"])

    from xxhash import xxh3_64_intdigest

    def hash_of(w: str) -> int:
        return xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1

    least = max(3, n_toxic // 100)
    found = arrow_map(rows.where("toxic = 1").select("text"), terms_of, "term string, family long, word string")
    per = found.groupBy("term").agg(F.countDistinct("family").alias("families"), F.count("*").alias("n"), F.countDistinct("word").alias("words"))
    per = per.where((F.col("families") >= least) & (~F.endswith("term", F.lit("*")) | (F.col("words") >= 4)))
    candidates = {r["term"]: r["families"] for r in per.select("term", "families").collect()}
    wanted = frozenset(candidates)

    def clean_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        c: Counter = Counter()
        for t in texts(batch, "text"):
            words = {w for w in WORD.findall(t.lower()) if len(w) >= LETTERS}
            c.update(wanted & {x for w in words for x in (w, *_stems(w))})
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["term", "n"])

    clean = {r["term"]: r["n"] for r in arrow_map(rows.where("toxic = 0").select("text"), clean_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()} if wanted else {}
    odds = {t: float(np.log((f + 0.5) / (n_toxic + 1)) - np.log((clean.get(t, 0) + 0.5) / (n_clean + 1))) for t, f in candidates.items()}
    share = n_toxic / max(1, n_toxic + n_clean)  # of the sample, as the counts below

    def surprise(t: str) -> float:
        """Negative log of the chance that so many of the term's documents are toxic if it tells nothing."""
        k, c = candidates[t], clean.get(t, 0)
        q = k / (k + c)
        return (k + c) * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)) if c else -np.log(share)) if q > share else 0.0

    chosen: list[tuple[str, bool, float, float]] = []
    stems: list[str] = []
    # the surest and most frequent first; a word that a chosen stem begins adds nothing
    for t in sorted((t for t, o in odds.items() if o > 2.5 and surprise(t) > SURPRISE), key=lambda t: (not t.endswith("*"), -candidates[t], len(t), t)):
        word = t.rstrip("*")
        if not any(word.startswith(s) for s in stems):
            chosen.append((word, t.endswith("*"), min(7.0, odds[t]), 1.0))
            if t.endswith("*"):
                stems.append(word)
    known = {t for t, *_ in chosen}
    chosen += [(t, False, 4.0, 1.0) for t in TERMS if t not in known and clean.get(t, 0) <= n_clean // 500]
    draft = Lexicon(chosen)

    def variants(batch: pa.RecordBatch) -> pa.RecordBatch:
        c: Counter = Counter()
        for t, toxic in zip(texts(batch, "text"), batch.column("toxic").to_pylist(), strict=True):
            c.update((w, toxic) for w in set(WORD.findall(t.lower())) if (f := draft.find(w)) and f[1])
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in c], pa.string()), pa.array([y for _, y in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["word", "toxic", "n"])

    # near-terms that clean documents use are ordinary words; those used once tell how many such words are still unseen
    near = arrow_map(rows, variants, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("toxic")).collect()
    ordinary = frozenset(r["word"] for r in near if r["clean"])
    unseen: Counter = Counter(draft.find(r["word"])[0] for r in near if r["clean"] == 1)
    meant: Counter = Counter()
    for r in near:
        if not r["clean"]:
            meant[draft.find(r["word"])[0]] += r["toxic"]

    def trust(k: int, weight: float) -> float:
        """The log-odds of an unseen misspelling as a share of the term's own; all of them without evidence."""
        got = np.log((meant[k] + 0.5) / (n_toxic + 1)) - np.log((unseen[k] + 0.5 * np.exp(-weight) * (n_clean + 1) / (n_toxic + 1)) / (n_clean + 1))
        return float(np.clip(got / weight, 0, 1))

    lexicon = Lexicon([(w, stem, o, trust(k, o) if correct else 0.0) for k, (w, stem, o, _) in enumerate(chosen)], ordinary)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([lexicon.features(t) for t in texts(batch, "text")]).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(4)), batch.column("toxic")], ["a", "b", "c", "d", "toxic"])

    data = np.array([tuple(r) for r in arrow_map(rows, features, "a double, b double, c double, d double, toxic int").collect()]).reshape(-1, 5)
    rows.unpersist()
    return lexicon, logistic(data[:, :4], data[:, 4], raised=raised)


def logistic(x: np.ndarray, y: np.ndarray, precision: float = 1.0, raised: float = 0.0) -> np.ndarray:
    """Weights of greatest posterior density under the prior, for log-odds that the sample raises; Newton's method with halved steps."""
    if not len(y) or y.min() == y.max():
        return PRIOR.copy()
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()

    def loss(w: np.ndarray) -> float:
        z = x @ w + raised
        return float(np.logaddexp(0, z).sum() - y @ z + precision / 2 * ((w - PRIOR) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w + raised, -30, 30)))
        grad = x.T @ (p - y) + precision * (w - PRIOR)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + precision * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def probability(lexicon: Lexicon, w: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    x = np.array([lexicon.features(t) for t in texts(batch, "text")]).reshape(-1, 4)
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def score(docs: DataFrame, labels: DataFrame, correct: bool = True) -> DataFrame:
    lexicon, w = fit(docs, labels, correct)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(probability(lexicon, w, batch))], ["doc_id", "score"])

    x = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, score double")
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    lexicon, w = fit(docs, labels)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(probability(lexicon, w, batch) < 0.5))

    return arrow_map(docs, one, docs.schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
