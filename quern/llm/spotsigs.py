"""Document fingerprints by SpotSigs.

A spot signature is an anchor (a common word) with the next two content words after it, where a content word is any
that is no anchor. A text's signatures are the set of their hashes; a text without any takes runs of three words, or
its whole word sequence. The fingerprint is the whole set: its hashes of 32 bits in order, in base 64, so equal texts have
equal fingerprints. ``likeness`` of two fingerprints is the Jaccard similarity of their sets; the similarities of a document
to its edited text and to the next document are just that.

``matches`` joins the documents' full sets: they are partitioned by set length into ranges so that no pair of
similarity ``tau`` is further apart than neighbouring ranges, candidates share one of the rare leading signatures that
any such pair must share, and pairs whose lengths alone rule them out are pruned before the sets are compared.

``with_next`` gives each document the next one in descending doc_id: rows are dealt by ranges of doc_id and text hash,
whose borders are quantiles, and sorted; the first row of each range also goes to the range before.

Edge cases: a null text is empty, has no signatures and is like only other empty texts; rows that repeat a doc_id
follow one another by descending hash of their text; any long is a doc_id; rows without doc_id come last; a table of one row follows itself;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SAMPLE, WordHash, arrow_map, borders, documents, materialize, mix64, part_of, texts

CHAIN = 2
#: Common words of four languages.
ANCHORS = """
a an the and or of to in on at by for from with is are was were be been this that it as
le la les un une des du de et en que qui dans pour par sur avec est au aux
der die das ein eine und von zu mit auf für ist im den dem sich nicht
el los las una y que por para con es del al se su
""".split()
WORD = re.compile(r"\w+")
_ANCHOR_HASHES = np.unique(WordHash().all([w.encode() for w in ANCHORS]))


def signatures(text: str, hashes: WordHash) -> np.ndarray:
    """Sorted distinct spot signatures."""
    words = WORD.findall(text.lower())
    h = hashes.all([w.encode("utf-8", "surrogatepass") for w in words])
    if not len(h):
        return h if not text.strip() else np.array([hashes[text.encode("utf-8", "surrogatepass")]], dtype=np.uint64)
    anchor = np.isin(h, _ANCHOR_HASHES)
    content = np.flatnonzero(~anchor)
    at = np.flatnonzero(anchor)
    j = np.searchsorted(content, at)
    ok = j + CHAIN <= len(content)
    at, j = at[ok], j[ok]
    if not len(at):  # no anchor with a whole chain
        at, content, j = np.arange(max(1, len(h) - CHAIN)), np.arange(len(h)), np.arange(1, max(2, len(h) - CHAIN + 1))
        if len(h) <= CHAIN:
            return mix64(np.array([np.bitwise_xor.reduce(mix64(h + np.arange(1, len(h) + 1, dtype=np.uint64)))], dtype=np.uint64))
    sig = mix64(h[at])
    for k in range(CHAIN):
        sig = mix64((sig << np.uint64(1)) ^ h[content[j + k]])
    return np.unique(sig)


def spots(s: np.ndarray) -> np.ndarray:
    """The set that a fingerprint holds: the upper halves of the hashes, sorted and distinct."""
    return np.unique((s >> np.uint64(32)).astype(np.uint32))


def fingerprint(spots: np.ndarray) -> str:
    return base64.b64encode(spots.astype(">u4").tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """Jaccard similarity of the sets of two fingerprints, 0 to 1."""
    return jaccard(*(np.frombuffer(base64.b64decode(f), dtype=">u4") for f in (a, b)))


def jaccard(s: np.ndarray, t: np.ndarray) -> float:
    """Jaccard similarity of two sets of signatures; two empty ones are alike."""
    common = len(np.intersect1d(s, t, assume_unique=True))
    return common / (len(s) + len(t) - common) if len(s) or len(t) else 1.0


def with_next(docs: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """doc_id, text, shard, carry: sorted by descending doc_id; rows with carry stand for the first row of what follows."""
    doc = F.col("doc_id").cast("long")
    x = docs.select(F.coalesce(doc, F.lit(-(2**63))).alias("key"), doc.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("hash", F.xxhash64("text"))
    narrow = x.select("key", "hash")
    found = borders(narrow.withColumn("weight", F.lit(1)), "weight", min(shards, SAMPLE // 8))
    own = part_of([F.col("key"), F.col("hash")], found)
    heads = narrow.groupBy(own.alias("own")).agg(F.max(F.struct("key", "hash")).alias("head")).orderBy("own").collect()  # one row for each shard
    n = len(found) + 1
    if not heads:
        return x.select(F.lit(0).alias("shard"), "doc_id", "text", F.lit(0).alias("carry")), n
    # the rows before a shard's in descending order are those of the next shard that has any
    above = [(h.own, h["head"].key, h["head"].hash, heads[(i + 1) % len(heads)].own) for i, h in enumerate(heads)]
    above = docs.sparkSession.createDataFrame(above, "own int, head_key long, head_hash long, above int")
    x = x.withColumn("own", own).join(F.broadcast(above), "own")
    one = F.struct(F.col("own").alias("shard"), F.lit(0).alias("carry"))
    both = F.array(one, F.struct(F.col("above").alias("shard"), F.lit(1).alias("carry")))
    x = x.select("key", "hash", "doc_id", "text", F.inline(F.when((F.col("key") == F.col("head_key")) & (F.col("hash") == F.col("head_hash")), both).otherwise(F.array(one))))
    return x.repartitionById(n, "shard").sortWithinPartitions("shard", "carry", F.desc("key"), F.desc("hash"), "text").select("shard", "doc_id", "text", "carry"), n


def fingerprints(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the similarity of their sets and of the next document's."""
    shards = shards or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows, _ = with_next(docs, shards)

    def follow(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        before: tuple | None = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in it:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out: list[list] = [[] for _ in names]
                for shard, doc, text, carry in zip(*(part.column(c).to_pylist() for c in ("shard", "doc_id", "text", "carry")), strict=True):
                    s = spots(signatures(text, hashes))
                    f = fingerprint(s)
                    if before is not None and before[0] == shard:
                        _, own_doc, own, own_s, own_f = before
                        m = len(own) // 3
                        edited = own[: len(own) - m] + text[:m] if m else own
                        e = own_s if edited == own else spots(signatures(edited, hashes))
                        g = fingerprint(e)
                        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                        for c, v in zip(out, (own_doc, len(own), sha, own_f, g, jaccard(own_s, e), jaccard(own_s, s)), strict=True):
                            c.append(v)
                    # of the rows carried over, only the first follows
                    before = None if carry else (shard, doc, text, s, f)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(follow, schema)


def matches(docs: DataFrame, tau: float = 0.75) -> DataFrame:
    """a, b, similarity of pairs of distinct signature sets of at least ``tau``; equal sets are one, named by their least doc_id."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = WordHash()
        sigs = [signatures(t, hashes).view(np.int64) for t in texts(batch, "text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    x = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, sigs array<long>").where(F.size("sigs") > 0)
    x = materialize(x.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs")), "spots")
    token = x.select("doc_id", "n", F.explode("sigs").alias("sig"))
    often = token.groupBy("sig").agg(F.count("*").alias("df"))
    lead = token.join(often, "sig").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("s"))
    # any pair of similarity tau shares one of its n - ceil(tau n) + 1 rarest signatures, and lies in the same or neighbouring length ranges
    span = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(tau)))).cast("int")
    lead = lead.select("doc_id", "n", span.alias("span"), F.explode(F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * tau - 1e-9).cast("int") + 1)).alias("x"))
    lead = materialize(lead.select("doc_id", "n", "span", F.col("x.sig").alias("sig")).where(F.col("doc_id").isNotNull()), "leads")
    a = lead.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(F.col("span"), F.col("span") + 1)).alias("span"))
    b = lead.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "sig", "span")
    pairs = a.join(b, ["sig", "span"]).where("a != b AND na <= nb AND (na < nb OR a < b)").where(F.col("na") >= F.col("nb") * tau).select("a", "b").distinct()
    pairs = pairs.join(x.select(F.col("doc_id").alias("a"), F.col("sigs").alias("sa")), "a").join(x.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    sim = common / (F.size("sa") + F.size("sb") - common)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), sim.alias("similarity")).where(F.col("similarity") >= tau)


def op8(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
