"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles; two documents are linked when the Jaccard similarity of
their sets is at least 0.75. Equal sets are one class. Classes are branched by independent random trees: a node
chooses one or two of 64 minwise coordinates, and a class goes on to the child named by its own token at each chosen
coordinate. Nodes of at most ``LIMIT`` classes are compared exhaustively through 2-bit sketches of 256 minwise tokens;
larger nodes branch again. A pair of similarity 0.75 shares a child with probability 0.84 at one level and a leaf of a
tree with probability 0.6 or more, so ten trees miss less than one such pair in ten thousand. Every link is confirmed
on the full sets. Only what connectivity needs is confirmed: first each class with its best partner and its leaf's
hub, then, by bit sets of the shingles that members share, all pairs of a leaf that are still in different components.
A node that stays large after ``MAX_DEPTH`` levels is compared in blocks: all members with common pivots, then the
members outside the node's main component with all members. Joins on nodes, hubs and copies go through ``split_join``,
so a hot key's rows are spread; sets are compared in blocks of about ``BLOCK`` shingles, so long texts stay bounded.

Edge cases: null or empty texts have an empty set, no links, and are kept; fewer than five words are one shingle, the
whole sequence; very long texts are whole sets, in smaller blocks; rows that repeat a doc_id are judged each by its own
text; rows without a doc_id take part, link others, and get the smallest doc_id of their component, or null if no row of it
has one; ``near_duplicates`` leaves out extra columns, ``one_of_each`` keeps them whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, WordHash, arrow_map, mix64, run_hash, split_join, texts

WIDTH, NUM, DEN = 5, 75, 100
TREES, COORDS, PERMS = 10, 64, 256
LIMIT, MAX_DEPTH, PIVOTS, CHUNK = 2048, 10, 32, 256
#: Shingles of the sets that meet in one row, and bits of a comparison held at once.
BLOCK, BITS = 1_000_000, 1 << 26
#: Six standard deviations of the sketch's estimate below the threshold; a pair of similarity 0.75 fails once in 10**8.
SKETCH_LEAST = 0.55

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32, PERMS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, PERMS, dtype=np.uint64).astype(np.uint32)


def shingles(text: str, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = hashes.all(words)
    return np.unique(run_hash(h, WIDTH)) if len(words) >= WIDTH else run_hash(h, len(words)) + np.uint64(len(words))


def set_key(s: np.ndarray) -> int:
    """The identity of a set of hashes, never 0."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s).sum() + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0]) or 1


def minwise(s: np.ndarray) -> np.ndarray:
    """PERMS minwise tokens of a set of hashes."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    least = np.full(PERMS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (x[i : i + 2048, None] * _A + _B).min(0), out=least)
    return least


def sketch(tokens: np.ndarray) -> bytes:
    """Two bits of each token, mixed first: the low bits of two shingles' tokens are alike for all multipliers or for none."""
    tokens = mix64(tokens)
    return np.packbits((tokens & 1).astype(bool)).tobytes() + np.packbits((tokens & 2).astype(bool)).tobytes()


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, copy (hash of the text), n_shingles, set_id (0: empty), coords and bits of each document."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, n, ids, coords, bits = WordHash(), [], [], [], []
        done: dict[int, tuple[bytes, bytes]] = {}
        for t in texts(batch, text):
            s = shingles(t, hashes)
            n.append(len(s))
            if not len(s):
                ids.append(0), coords.append(None), bits.append(None)
                continue
            key = set_key(s)
            if key not in done:
                m = minwise(s)
                done[key] = m[:COORDS].tobytes(), sketch(m)
            ids.append(key), coords.append(done[key][0]), bits.append(done[key][1])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(coords, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "copy", "n_shingles", "set_id", "coords", "bits"])

    return arrow_map(_identified(docs, text), one, "doc_id long, copy long, n_shingles long, set_id long, coords binary, bits binary")


def _identified(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias(text))


def branch(classes: DataFrame) -> DataFrame:
    """set_id, coords, nodes (each class's present nodes) to rows of child node and set_id."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        coords = np.frombuffer(b"".join(batch.column("coords").to_pylist()), dtype=np.uint32).reshape(-1, COORDS)
        lists = batch.column("nodes").to_pylist()
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        parent = np.array([y for x in lists for y in x], dtype=np.int64).view(np.uint64)
        set_id = batch.column("set_id").to_numpy()
        r = mix64(parent ^ np.uint64(0xA5A5A5A55A5A5A5A))
        first = (r % np.uint64(COORDS)).astype(np.int64)
        second = (first + 1 + ((r >> np.uint64(16)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
        two = (r >> np.uint64(40)) & np.uint64(1) == 1

        def child(rows: np.ndarray, p: np.ndarray, c: np.ndarray) -> np.ndarray:
            return mix64(mix64(p + np.uint64(0x51ED270B)) ^ (coords[rows, c].astype(np.uint64) << np.uint64(7)) ^ c.astype(np.uint64))

        node = np.concatenate([child(row, parent, first), child(row[two], parent[two], second[two])])
        return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(np.concatenate([set_id[row], set_id[row[two]]]))], ["node", "set_id"])

    return arrow_map(classes.select("set_id", "coords", "nodes"), one, "node long, set_id long")


def _rows(batch: pa.RecordBatch, *names: str):
    """The rows of a batch, one at a time, since each may hold many sets."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(k)[i].as_py() for k in names)


def _similar(bits: list[bytes]) -> np.ndarray:
    """Estimated similarity of all pairs."""
    x = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(bits), -1)
    half = x.shape[1] // 2
    out = np.empty((len(x), len(x)), dtype=np.float32)
    for i in range(len(x)):
        d = x ^ x[i]
        out[i] = np.bitwise_count(d[:, :half] | d[:, half:]).sum(1)
    return ((1 - out / PERMS) - 0.25) / 0.75


def best_pairs(leaves: DataFrame) -> DataFrame:
    """Rows of leaf, members to candidate pairs a < b: each member's best partner, and the leaf's hub with its partners."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = [], []
        for (members,) in _rows(batch, "members"):
            ids = np.array([m["set_id"] for m in members], dtype=np.int64)
            est = _similar([m["bits"] for m in members])
            np.fill_diagonal(est, -1)
            near = est >= SKETCH_LEAST
            best, some = est.argmax(1), near.any(1)
            hub = near.sum(1).argmax()
            a = np.concatenate([np.flatnonzero(some), np.flatnonzero(near[hub])])
            b = np.concatenate([best[some], np.full(near[hub].sum(), hub)])
            left.append(np.minimum(ids[a], ids[b])), right.append(np.maximum(ids[a], ids[b]))
        z = [np.zeros(0, dtype=np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left or z)), pa.array(np.concatenate(right or z))], ["a", "b"])

    return arrow_map(leaves.select("members"), one, "a long, b long").where("a != b").distinct()


def open_members(leaves: DataFrame) -> DataFrame:
    """Rows of leaf, members to leaf, set_id and label of members that may be linked with one of another label."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[np.zeros(0, dtype=np.int64)] for _ in range(3)]
        for leaf, members in _rows(batch, "leaf", "members"):
            label = np.array([m["label"] for m in members], dtype=np.int64)
            if (label == label[0]).all():
                continue
            near = (_similar([m["bits"] for m in members]) >= SKETCH_LEAST) & (label[:, None] != label[None, :])
            some = near.any(1)
            ids = np.array([m["set_id"] for m in members], dtype=np.int64)[some]
            for c, v in zip(out, (np.full(len(ids), leaf, dtype=np.int64), ids, label[some]), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["leaf", "set_id", "label"])

    return arrow_map(leaves.select("leaf", "members"), one, "leaf long, set_id long, label long")


def crossing_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """leaf, set_id, label to links a, b that join labels of a leaf, decided on the full sets of all its pairs."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = [], []
        for (members_,) in _rows(batch, "members"):
            ids, label = [m["set_id"] for m in members_], np.array([m["label"] for m in members_], dtype=np.int64)
            items = [np.frombuffer(m["items"], dtype=np.uint64) for m in members_]
            size = np.array([len(x) for x in items])
            # one bit for each shingle that several members have, some columns at a time
            row = np.repeat(np.arange(len(items)), size)
            every = np.concatenate(items)
            in_order = np.argsort(every, kind="stable")
            row, every = row[in_order].astype(np.int32), every[in_order]
            again = np.zeros(len(every) + 1, dtype=bool)
            again[1:-1] = every[1:] == every[:-1]
            shared = again[:-1] | again[1:]
            row, column = row[shared], np.cumsum(~again[:-1][shared]) - 1
            others = [np.flatnonzero((label[i + 1 :] != label[i]) & (DEN * np.minimum(size[i + 1 :], size[i]) >= NUM * np.maximum(size[i + 1 :], size[i]))) + i + 1 for i in range(len(ids) - 1)]
            common = [np.zeros(len(o), dtype=np.int64) for o in others]
            width = max(1, BITS // len(items) // 64) * 64
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                low, high = np.searchsorted(column, [first, first + width])
                at = column[low:high] - first
                bits = np.zeros((len(items), (int(at[-1]) // 64 + 1) * 8 if len(at) else 8), dtype=np.uint8)
                np.bitwise_or.at(bits, (row[low:high], at >> 3), (1 << (at & 7)).astype(np.uint8))
                bits = bits.view(np.uint64)
                for i, o in enumerate(others):
                    if len(o):
                        common[i] += np.bitwise_count(bits[o] & bits[i]).sum(1, dtype=np.int64)
            root: dict[int, int] = {}

            def find(v: int, root=root) -> int:
                while root.setdefault(v, v) != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for i, o in enumerate(others):
                for j in o[DEN * common[i] >= NUM * (size[o] + size[i] - common[i])].tolist():
                    a, b = find(int(label[i])), find(int(label[j]))
                    if a != b:
                        root[a] = b
                        left.append(ids[i]), right.append(ids[j])
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    x = _bounded(members, sets.select("set_id", "n")).join(sets.select("set_id", "items"), "set_id")
    return arrow_map(x.groupBy("leaf").agg(F.collect_list(F.struct("set_id", "label", "items")).alias("members")).select("members"), one, "a long, b long")


def _bounded(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """leaf, set_id, label: a leaf of more than BLOCK shingles as several in which every two of its members still meet."""
    x = members.join(sizes, "set_id")
    whole = x.groupBy("leaf").agg(F.sum("n").alias("whole"))
    parts = F.when(F.col("whole") > BLOCK, F.ceil(F.col("whole") * 2 / BLOCK)).otherwise(F.lit(1)).cast("long")
    x = x.join(whole, "leaf").withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("set_id", "leaf"), "parts"))
    x = x.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("p != q OR parts = 1")
    return x.select(F.when(F.col("parts") == 1, F.col("leaf")).otherwise(F.xxhash64("leaf", F.least("p", "q"), F.greatest("p", "q"))).alias("leaf"), "set_id", "label")


def chosen_path(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """classes (set_id, coords) to leaves (leaf, set_id) and members (node, set_id) of nodes that stayed large."""
    frontier = classes.select("set_id", "coords", F.expr(f"sequence(1L, {TREES}L)").alias("nodes"))
    parts: list[DataFrame] = []
    last = None
    for depth in range(1, MAX_DEPTH + 1):
        members = scratch(branch(frontier), "paths")
        members = split_join(members, members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node")
        lists = members.where(F.col("n") <= LIMIT).groupBy("node").agg(F.sort_array(F.collect_list("set_id")).alias("ids"))
        # the same small group shows in many nodes
        parts.append(scratch(lists.select(F.xxhash64("ids").alias("leaf"), F.size("ids").alias("n"), "ids").dropDuplicates(["leaf", "n"]), "leaves"))
        large = scratch(members.where(F.col("n") > LIMIT).select("node", "set_id"), "large")
        if large.isEmpty():
            break
        if depth == MAX_DEPTH:
            last = large
            break
        frontier = classes.join(large.groupBy("set_id").agg(F.collect_list("node").alias("nodes")), "set_id")
    leaves = parts[0]
    for p in parts[1:]:
        leaves = leaves.unionByName(p)
    return leaves.dropDuplicates(["leaf", "n"]).select("leaf", F.explode("ids").alias("set_id")), last


def _pivot_blocks(large: DataFrame) -> DataFrame:
    """Nodes that stayed large, in blocks that each also hold the node's pivots."""
    half = LIMIT - PIVOTS
    mixed = large.withColumn("h", F.xxhash64("node", "set_id"))
    mixed = split_join(mixed, mixed.groupBy("node").agg(F.count("*").alias("n")), "node")
    pivots = mixed.where(F.pmod("h", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * 2 / PIVOTS))) == 0)
    parts = mixed.withColumn("part", F.pmod(F.col("h"), F.ceil(F.col("n") * 2 / half)))
    with_pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") * 2 / half) - 1)))
    return parts.unionByName(with_pivots).select(F.xxhash64("node", "part").alias("leaf"), "set_id").distinct()


def _rest_blocks(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Of nodes that stayed large: members outside the main component with all members, in blocks."""
    part = LIMIT // 4
    x = large.join(labels, "set_id").withColumn("h", F.xxhash64("set_id", "node"))
    per = x.groupBy("node", "label").agg(F.count("*").alias("c"))
    main = per.groupBy("node").agg(F.max_by("label", "c").alias("main"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("rest"))
    x = split_join(x, main.where("rest > 0"), "node", total=large.count())
    rows, cols = F.ceil(F.col("rest") / part), F.ceil(F.col("n") / part)
    outer = x.where("label != main").select("node", "set_id", F.pmod("h", rows).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), cols - 1)).alias("j"))
    inner = x.select("node", "set_id", F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("i"), F.pmod("h", cols).alias("j"))
    return outer.unionByName(inner).select(F.xxhash64("node", "i", "j").alias("leaf"), "set_id").distinct()


def with_members(leaves: DataFrame, classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    x = leaves.join(classes.select("set_id", "bits"), "set_id")
    x = x.withColumn("label", F.col("set_id")) if labels is None else x.join(labels, "set_id")
    return x.groupBy("leaf").agg(F.collect_list(F.struct("set_id", "bits", "label")).alias("members"))


def confirm(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs a, b to links a, b that span the confirmed pairs, decided on the full sets (set_id, n, items).

    Pairs meet in blocks of bounded size, so each set is sent once for each block rather than once for each pair.
    """
    ends = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).toDF("id", "other")
    home = ends.groupBy("id").agg(F.least("id", F.min("other")).alias("home"), F.count("*").alias("n"))
    home = home.join(sets.select(F.col("set_id").alias("id"), F.col("n").alias("size")), "id")
    total = pairs.count()
    x = split_join(pairs, home.select(F.col("id").alias("a"), F.col("home").alias("ha"), F.col("size").alias("sa"), "n"), "a", total=total).drop("n")
    x = split_join(x, home.select(F.col("id").alias("b"), F.col("home").alias("hb"), F.col("size").alias("sb"), "n"), "b", total=total)
    x = x.select("a", "b", F.least("ha", "hb").alias("home"), (F.col("sa") + F.col("sb")).alias("size"))
    # a block holds two of k chunks of the ids that share a home
    few = F.greatest(F.lit(1), F.least(F.ceil(F.sqrt(F.col("n") / CHUNK)), F.ceil(F.col("n") * 2 / CHUNK)))
    chunks = F.when(F.col("size") > BLOCK, F.greatest(few, F.ceil(F.col("size") * 2 / BLOCK))).otherwise(few).cast("long")
    sizes = x.groupBy("home").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    x = split_join(x.drop("size"), sizes.select("home", "n", chunks.alias("k")), "home", total=total)
    ca, cb = F.pmod(F.xxhash64("a"), "k"), F.pmod(F.xxhash64("b"), "k")
    x = scratch(x.select("a", "b", F.xxhash64("home", F.least(ca, cb), F.greatest(ca, cb)).alias("block")), "blocks")
    members = x.select("block", F.col("a").alias("set_id")).union(x.select("block", "b")).distinct().join(sets.select("set_id", "items"), "set_id")
    held = members.groupBy("block").agg(F.collect_list("set_id").alias("ids"), F.collect_list("items").alias("items"))
    asked = x.groupBy("block").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = [], []
        for ids, packed, a, b in _rows(batch, "ids", "items", "a", "b"):
            for x, y in _spanning({k: np.frombuffer(v, dtype=np.uint64) for k, v in zip(ids, packed, strict=True)}, zip(a, b, strict=True)):
                left.append(x), right.append(y)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return arrow_map(held.join(asked, "block").select("ids", "items", "a", "b"), one, "a long, b long")


def _spanning(items: dict[int, np.ndarray], pairs) -> list[tuple[int, int]]:
    """Of the pairs that are links, those that join what the ones before left apart."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for a, b in pairs:
        s, t = items[a], items[b]
        if DEN * min(len(s), len(t)) < NUM * max(len(s), len(t)) or find(a) == find(b):
            continue
        both = np.concatenate([s, t])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        if DEN * common >= NUM * (len(s) + len(t) - common):
            root[find(a)] = find(b)
            out.append((a, b))
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id, label of each connected component (alternating large-star and small-star until all is stars)."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    while True:
        total = 2 * e.count()
        both = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = split_join(both, least, "u", total=total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = split_join(large, least, "u", total=total).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = scratch(small.where("u != v").distinct(), "stars")
        # stars: no vertex has two centres or is a centre itself; centres are few beside the vertices
        if e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("set_id"), F.col("v").alias("label"))


def named_by(classes: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """set_id, label of every class; one without links is its own."""
    return scratch(classes.select("set_id").join(labels, "set_id", "left").select("set_id", F.coalesce("label", "set_id").alias("label")), "labels")


def _full_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """set_id, n and items of the wanted classes (set_id, first: doc_id and copy of a row with that set)."""

    def items(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHash()
        found = [shingles(t, hashes) for t in texts(batch, "text")]
        same = pa.array([set_key(s) == k for s, k in zip(found, batch.column("set_id").to_pylist(), strict=True)])
        out = pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["set_id", "n", "items"])
        return out.filter(same)

    # a null doc_id is joined by the text's hash alone
    key = lambda r: (F.coalesce(r["doc_id"], r["copy"]).alias("_id"), r["doc_id"].isNull().alias("_none"), r["copy"].alias("_copy"))
    rows = _identified(docs, text).withColumnRenamed(text, "text")
    chosen = rows.select(*key(rows), "text").join(wanted.select("set_id", *key(F.col("first"))), ["_id", "_none", "_copy"])
    return arrow_map(chosen.select("set_id", "text"), items, "set_id long, n long, items binary").groupBy("set_id").agg(F.first("n").alias("n"), F.first("items").alias("items"))


def _resolved(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and of each class its set_id, label, first row and number of rows."""
    scratch = Scratch()
    sigs = scratch(signatures(docs, text), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first")
    classes = scratch(sigs.where("set_id != 0").groupBy("set_id").agg(first, F.count("*").alias("rows"), F.first("coords").alias("coords"), F.first("bits").alias("bits")), "classes")
    leaves, large = chosen_path(classes, scratch)
    leaves = leaves if large is None else leaves.unionByName(_pivot_blocks(large))
    pairs = scratch(best_pairs(with_members(leaves, classes, None)), "pairs")

    # the sets of all that may be confirmed in either round
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    if large is not None:
        wanted = wanted.union(large.select("set_id")).distinct()
    sets = scratch(_full_sets(docs, text, classes.select("set_id", "first").join(wanted, "set_id")), "sets")
    links = scratch(confirm(pairs, sets, scratch), "links")
    labels = named_by(classes, components(links, scratch), scratch)
    crossing = open_members(with_members(leaves, classes, labels))
    if large is not None:
        crossing = crossing.union(open_members(with_members(_rest_blocks(large, labels), classes, labels)))
    crossing = scratch(crossing, "crossing")
    if not crossing.isEmpty():
        more = scratch(crossing_links(crossing, sets), "links")
        if not more.isEmpty():
            labels = named_by(classes, components(links.union(more), scratch), scratch)
    named = scratch(classes.select("set_id", "first", F.col("rows").alias("n")).join(labels, "set_id"), "named")
    scratch.drop_all_but(sigs, named)
    return sigs.drop("coords", "bits"), named


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    sigs, named = _resolved(docs, text)
    least = named.groupBy("label").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("n"))
    of_class = split_join(named.select("set_id", "label", F.col("n").alias("rows")), least, "label").select("set_id", "component_id", F.col("rows").alias("n"))
    full = split_join(sigs.where("set_id != 0").select("doc_id", "n_shingles", "set_id"), of_class, "set_id", total=sigs.count()).select("doc_id", "n_shingles", "component_id")
    out = full.union(sigs.where("set_id = 0").select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id's, a row without doc_id only if there is no other.

    A row without words is its own component; rows that repeat such a doc_id count as one, rows without both all stay.
    """
    sigs, named = _resolved(docs, "text")
    chosen = named.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.copy")
    chosen = chosen.union(sigs.where("set_id = 0 AND doc_id IS NOT NULL").select("doc_id", "copy").distinct())
    chosen = chosen.select(F.coalesce("doc_id", "copy").alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("copy").alias("_copy"))
    x = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_copy"))
    x = x.select("_row", "_copy", F.coalesce("_doc", "_copy").alias("_id"), F.col("_doc").isNull().alias("_none"))
    once = Window.partitionBy("_id", "_none", "_copy").orderBy(F.xxhash64(*(F.col("_row")[c] for c in docs.columns)))
    kept = x.join(chosen, ["_id", "_none", "_copy"], "left_semi").withColumn("_n", F.row_number().over(once)).where("_n = 1").select("_row")
    wordless = F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"^[\x09-\x0D\x20]*$")
    return kept.union(x.where(F.col("_none") & wordless).select("_row")).select(*(F.col("_row")[c].alias(c) for c in docs.columns))


def op3(spark, sf_dir: str) -> DataFrame:
    from quern.llm.common import documents

    return near_duplicates(documents(spark, sf_dir))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5_number_lower(array_to_string(list_slice(ws, i, i + 4), ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(m.low, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""
