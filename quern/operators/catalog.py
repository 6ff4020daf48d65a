"""Catalog: reconcile plans, index plans, keyed latest-wins writes, views, import and parity checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import materialize


def reconcile(desired: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, op (UPSERT or DELETE), desired_hash: what makes the index match; both sides have path and hash. Order it, by op and path, where it is shown."""
    x = desired.select("path", F.col("hash").alias("want")).join(indexed.select("path", F.col("hash").alias("have")), "path", "full_outer")
    op = F.when(F.col("want").isNull(), "DELETE").when(F.col("have").isNull() | (F.col("have") != F.col("want")), "UPSERT")
    return x.withColumn("op", op).where("op IS NOT NULL").select("path", "op", F.coalesce("want", F.lit("")).alias("desired_hash"))


def index_plan(scanned: DataFrame, known: DataFrame, last_index: Column | None = None) -> DataFrame:
    """path, hash, action (index, skip_mtime, skip_hash) of scanned files (path, hash, mtime) against documents (path, hash, n_chunks)."""
    k = known.select("path", F.col("hash").alias("known_hash"), F.col("n_chunks").alias("n"))
    x = scanned.join(k, "path", "left")
    has = F.coalesce(F.col("n"), F.lit(0)) > 0
    old = (F.col("mtime") <= last_index) & has if last_index is not None else F.lit(False)
    return x.withColumn("action", F.when(old, "skip_mtime").when(has & (F.col("hash") == F.col("known_hash")), "skip_hash").otherwise("index")).select("path", "hash", "action")


def removed(known: DataFrame, scanned: DataFrame) -> DataFrame:
    """Known paths that the scan no longer has."""
    return known.join(scanned.select("path"), "path", "left_anti")


def latest_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last by order: an upsert of a union of old and new rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_by_file(old: DataFrame, new: DataFrame, files: DataFrame, column: str = "file") -> DataFrame:
    """All rows of the files go, the new ones come."""
    return old.join(files.select(F.col(column)).distinct(), column, "left_anti").unionByName(new)


def delete_by(old: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return old.join(keys.select(column).distinct(), column, "left_anti")


def call_edges(refs: DataFrame) -> DataFrame:
    """Direct edges of call references that have a named caller."""
    x = refs.where((F.coalesce(F.col("caller_name"), F.lit("")) != "") & (F.col("caller_name") != "<top-level>"))
    return x.select(F.col("caller_name").alias("caller"), F.col("symbol_name").alias("callee"), "file", "line", F.lit("direct").alias("call_type"))


def put_chunk_vectors(rows: DataFrame) -> DataFrame:
    """Insert if absent, filling only empty content: chunk_id, first vector and first non-empty content by seq."""
    text = F.col("content") != ""
    return rows.groupBy("chunk_id").agg(F.min_by("vector", "seq").alias("vector"), F.coalesce(F.min_by(F.when(text, F.col("content")), F.when(text, F.col("seq"))), F.lit("")).alias("content"))


def switch_view(view: DataFrame, commits: DataFrame, active: DataFrame) -> DataFrame:
    """worktree_id, path, artifact_id, generation after commits; only those of the active generation, never an older one."""
    ok = commits.join(active.select("worktree_id", F.col("generation").alias("active")), "worktree_id", "left").where("active IS NULL OR generation = active").drop("active")
    both = view.withColumn("_new", F.lit(0)).unionByName(ok.withColumn("_new", F.lit(1)))
    return latest_wins(both, ["worktree_id", "path"], [F.desc("generation"), F.desc("_new"), F.desc("artifact_id")]).drop("_new")


def active_of(worktrees: DataFrame, generations: DataFrame) -> DataFrame:
    """worktree_id, generation: the active one of each worktree's repository, where there is one."""
    return worktrees.join(generations.where("state = 'active'"), "repository_id").select("worktree_id", "generation")


def _fulfilled(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """jobs with ``fulfilled_at``: the newest generation, not below their own, in which done (worktree_id, path, desired_hash, generation) has their desired hash."""
    keys = ["worktree_id", "path", "desired_hash"]
    newest = done.groupBy(*keys).agg(F.max("generation").alias("fulfilled_at"))
    x = jobs.join(newest, keys, "left")
    return x.withColumn("fulfilled_at", F.when(F.col("fulfilled_at") >= F.col("generation"), F.col("fulfilled_at")))


def complete_jobs(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs of the same desired hash and of the same or an older generation go; newer intents, and those of another hash, stay."""
    return _fulfilled(jobs, done).where("fulfilled_at IS NULL").select(jobs.columns)


def commit_deletes(view: DataFrame, jobs: DataFrame, deletes: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """View and jobs after deletes (worktree_id, path, generation, desired_hash).

    A delete completes its jobs. One that has none was superseded and leaves the view to the job that is there; so does one of
    a generation that isn't the active one. Otherwise the path's rows of its generation or an older one go.
    """
    of_active = deletes.join(active.select("worktree_id", F.col("generation").alias("active")), "worktree_id", "left").where("active IS NULL OR generation = active")
    keys = ["worktree_id", "path", "desired_hash"]
    oldest = jobs.groupBy(*keys).agg(F.min("generation").alias("job"))
    held = of_active.join(oldest, keys).where("job <= generation").groupBy("worktree_id", "path").agg(F.max("generation").alias("upto"))
    kept = view.join(held, ["worktree_id", "path"], "left").where("upto IS NULL OR generation > upto")
    return kept.select(view.columns), complete_jobs(jobs, deletes)


def upsert_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """One desired state a (worktree, path); a newer generation wins, at equal generation the newcomer."""
    both = jobs.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_wins(both, ["worktree_id", "path"], [F.desc("generation"), F.desc("_new"), F.desc("desired_hash")]).drop("_new")


def claim_job(jobs: DataFrame) -> DataFrame:
    """The unclaimed job of smallest priority, then id."""
    return jobs.where("claimed = 0").orderBy("priority", "job_id").limit(1)


def fair_schedule(jobs: DataFrame) -> DataFrame:
    """Jobs with their turn in their repository: ordered by turn and repository, repositories take turns."""
    w = Window.partitionBy("repo").orderBy("priority", "job_id")
    return jobs.withColumn("turn", F.row_number().over(w))


#: States of a job, and the state that an event leads to.
TRANSITIONS = [
    ("pending", "claim", "running"), ("pending", "superseded", "superseded"), ("running", "work_complete", "committed"), ("running", "transient_failure", "backoff"),
    ("running", "permanent_failure", "dead_letter"), ("running", "superseded", "superseded"), ("backoff", "retry_ready", "pending"), ("backoff", "attempts_exhausted", "dead_letter"),
    ("backoff", "superseded", "superseded"), ("dead_letter", "input_changed", "pending"),
]


def advance(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs (job_id, state) after one event each (job_id, event); an event that the state doesn't know leaves it, valid false."""
    rules = jobs.sparkSession.createDataFrame(TRANSITIONS, "state string, event string, next string")
    x = jobs.join(events, "job_id", "left").join(F.broadcast(rules), ["state", "event"], "left")  # ten rows
    return x.select("job_id", F.coalesce("next", "state").alias("state"), (F.col("event").isNull() | F.col("next").isNotNull()).alias("valid"))


def retry_delay(attempt: int, base: float, most: float, unit: float) -> float:
    """A delay of up to twice as much with each attempt, by a number from 0 to 1."""
    return min(max(unit, 0.0), 0.999999) * min(most, base * 2 ** (max(1, attempt) - 1))


def queue_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("priority").agg(F.count("*").alias("depth"), F.count_if(F.col("attempts") >= 5).alias("dead_letters"), F.count_if(F.col("claimed") == 0).alias("pending"))


def dedup_cached(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks joined to the cached vector of their content hash, and the distinct hashes still to embed."""
    first = cache.groupBy("content_hash").agg(F.min_by("vector", "id").alias("cached"))
    x = chunks.join(first, "content_hash", "left")
    return x, x.where("cached IS NULL").select("content_hash").distinct()


def import_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of documents (path, chunk_ids) and chunks (id, vector): files, placements, dangling references and unique chunks."""
    x = documents.select("path", F.posexplode("chunk_ids").alias("ordinal", "chunk_id")).join(chunks.select(F.col("id").alias("chunk_id"), F.lit(1).alias("has")), "chunk_id", "left")
    counts = x.agg(F.count("*").alias("placements"), F.count_if(F.col("has").isNull()).alias("dangling"), F.countDistinct(F.when(F.col("has") == 1, F.col("chunk_id"))).alias("unique_chunks"))
    return counts.join(documents.agg(F.count("*").alias("files")))


def stale_artifacts(artifacts: DataFrame, version: int) -> DataFrame:
    return artifacts.where(F.col("symbols_version") < version)


def any_pending(jobs: DataFrame, paths: DataFrame) -> bool:
    return not jobs.join(paths.select("path"), "path", "left_semi").limit(1).isEmpty()


def put_symbols(symbols: DataFrame, artifacts: DataFrame, new: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Symbols of the artifacts in ``new`` are replaced, and those artifacts get the version."""
    done = new.select("artifact_id").distinct()
    kept = symbols.join(done, "artifact_id", "left_anti").unionByName(new)
    bumped = artifacts.join(done.withColumn("_new", F.lit(version)), "artifact_id", "left")
    return kept, bumped.withColumn("symbols_version", F.coalesce("_new", "symbols_version")).drop("_new").select(artifacts.columns)


@dataclass(frozen=True)
class Store:
    """What one commit changes together; kept as one snapshot, so readers see all of it or nothing."""

    artifacts: DataFrame
    artifact_chunks: DataFrame
    symbols: DataFrame
    symbol_edges: DataFrame
    view: DataFrame
    jobs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.__dict__)


def _added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows of keys that aren't there; of several with one key the smallest."""
    rest = [c for c in old.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in rest))
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti"))


def commit_artifacts(store: Store, artifacts: DataFrame, artifact_chunks: DataFrame, symbols: DataFrame, symbol_edges: DataFrame, extracted: DataFrame, commits: DataFrame, active: DataFrame, version: int) -> Store:
    """Artifacts with chunks and symbols, the view switched to those of the active generation, their jobs completed.

    commits: worktree_id, path, artifact_id, generation, desired_hash. Artifacts, and chunks of an ordinal, that exist stay as
    they are. Symbols and their edges are replaced for the ``extracted`` (artifact_id) ones, known or new, which get the
    version; of others nothing is written, and a later extraction makes up for it. An artifact is stored whatever the commit's
    generation; the view follows only the active one and never goes back.
    """
    done = extracted.select("artifact_id").distinct()
    replaced = lambda old, new: old.join(done, "artifact_id", "left_anti").unionByName(new.join(done, "artifact_id", "left_semi").distinct()).select(old.columns)
    known = _added(store.artifacts, artifacts.withColumn("symbols_version", F.lit(0)), ["artifact_id"]).join(done.withColumn("_new", F.lit(version)), "artifact_id", "left")
    known = known.withColumn("symbols_version", F.coalesce("_new", "symbols_version")).select(store.artifacts.columns)
    return Store(
        known,
        _added(store.artifact_chunks, artifact_chunks, ["artifact_id", "ordinal"]),
        replaced(store.symbols, symbols),
        replaced(store.symbol_edges, symbol_edges),
        switch_view(store.view, commits.select(store.view.columns), active),
        complete_jobs(store.jobs, commits),
    )


def roll_generation(generations: DataFrame, view: DataFrame, jobs: DataFrame, worktree: str, repository: str, generation: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The repository's active generation is retired and another one becomes active; view and jobs of the worktree are cleared.

    generations: repository_id, generation, state. A generation that the repository doesn't have is an error, and nothing changes.
    """
    mine = F.col("repository_id") == repository
    if generations.where(mine & (F.col("generation") == generation)).isEmpty():
        raise ValueError(f"repository {repository} has no generation {generation}")
    state = F.when(mine & (F.col("generation") == generation), "active").when(mine & (F.col("state") == "active"), "retired").otherwise(F.col("state"))
    other = F.col("worktree_id") != worktree
    return generations.withColumn("state", state), view.where(other), jobs.where(other)


def register(known: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that are not there yet are added, once each; known ones stay as they are."""
    return known.unionByName(new.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys).select(known.columns))


def prune_import(artifacts: DataFrame, documents: DataFrame) -> DataFrame:
    """Imported artifacts (path, source_hash, ...) whose document (path, hash) is gone or has changed are dropped."""
    now = documents.select("path", F.col("hash").alias("source_hash"))
    return artifacts.join(now, ["path", "source_hash"], "left_semi")


def verify_import(documents: DataFrame, chunks: DataFrame, artifacts: DataFrame, artifact_chunks: DataFrame) -> DataFrame:
    """One row: files, placements and unique chunks of both sides, and whether all agree; dangling references don't count."""
    want = import_report(documents, chunks)
    got = artifact_chunks.agg(F.count("*").alias("got_placements"), F.countDistinct("chunk_id").alias("got_chunks")).join(artifacts.agg(F.count("*").alias("got_files")))
    x = want.join(got)  # single rows
    ok = (F.col("files") == F.col("got_files")) & (F.col("placements") - F.col("dangling") == F.col("got_placements")) & (F.col("unique_chunks") == F.col("got_chunks"))
    return x.withColumn("agrees", ok)


Migration = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


class Snapshot:
    """Tables in numbered folders behind a pointer that is switched last; readers see whole snapshots only."""

    def __init__(self, spark: SparkSession, root: str, version: int = 1, migrations: dict[int, Migration] | None = None) -> None:
        """migrations: by version, what makes the next version's tables of that one's."""
        self.spark, self.root, self.version, self.migrations = spark, root.rstrip("/"), version, migrations or {}

    def _pointers(self) -> DataFrame | None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_pointer")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.schema("name string, version int, number long").json(f"{self.root}/_pointer")

    def save(self, tables: dict[str, DataFrame]) -> str:
        """One writer at a time: snapshots are numbered, and the largest number is the newest."""
        name = uuid.uuid4().hex
        for k, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{k}")
        before = self._pointers()
        number = (before.agg(F.max("number")).first()[0] or 0) + 1 if before is not None else 1
        self.spark.createDataFrame([(name, self.version, number)], "name string, version int, number long").coalesce(1).write.mode("append").json(f"{self.root}/_pointer")
        return name

    def _newest(self) -> Row:
        pointers = self._pointers()
        found = pointers.orderBy(F.desc("number")).first() if pointers is not None else None
        if found is not None and found["version"] < self.version and all(v in self.migrations for v in range(found["version"], self.version)):
            self._upgrade(found)
            found = self._pointers().orderBy(F.desc("number")).first()
        if found is None or found["version"] != self.version:
            raise ValueError(f"snapshot version {found and found['version']}, not {self.version}")
        return found

    def _upgrade(self, found: Row) -> None:
        """Write the newest snapshot once more, as of this version; the old one stays, and a broken-off upgrade is simply done again."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{found['name']}")
        names = [s.getPath().getName() for s in where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where)]
        tables = {n: self.spark.read.parquet(f"{self.root}/{found['name']}/{n}") for n in names}
        for version in range(found["version"], self.version):
            tables = self.migrations[version](tables)
        self.save(tables)

    def load(self, table: str) -> DataFrame:
        """Of the newest snapshot; one of an older version is migrated first, another one is an error."""
        return self.spark.read.parquet(f"{self.root}/{self._newest()['name']}/{table}")


def members(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]], name: str = "member") -> tuple[DataFrame | None, DataFrame]:
    """The rows of all members that can be read, with their member, and each member's status: ok, rows and error.

    Each member is read to its end before it counts, so a damaged file costs that member alone.
    """
    rows, status = None, []
    for key, read in readers.items():
        try:
            x = materialize(read().withColumn(name, F.lit(key)), "member")
            status.append((key, True, x.count(), None))
        except Exception as e:
            status.append((key, False, 0, str(e).strip().split("\n")[0][:300]))
            continue
        rows = x if rows is None else rows.unionByName(x, allowMissingColumns=True)
    return rows, spark.createDataFrame(status, f"{name} string, ok boolean, rows long, error string")


def vector_size(column: str, size: int) -> Callable[[DataFrame], DataFrame]:
    """Vectors of another size: cut, or filled up with zeros."""
    return lambda df: df.withColumn(column, F.slice(F.concat(column, F.array_repeat(F.lit(0).cast("float"), size)), 1, size))
