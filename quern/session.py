"""Session and shared-folder helpers used by every module."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "quern", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.warehouse.dir", tempfile.gettempdir() + "/quern-warehouse")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own in local mode where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"{tempfile.gettempdir()}/checkpoints/quern"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage with a written table in the shared folder, compressed as the session says or as asked."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that ``materialize`` has written, once nothing will read it any more."""
    _delete(df.sparkSession, df._quern_path)
    _written(df.sparkSession).remove(df._quern_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _written(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_quern_written"):
        context._quern_written = []
    return context._quern_written


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` has written in this application; call it when their readers are done."""
    paths = _written(spark)
    for p in paths:
        _delete(spark, p)
    n = len(paths)
    paths.clear()
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the session's Python workers, once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_quern_shipped", False):
        top = pathlib.Path(__file__).resolve().parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="quern-")) / "quern.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        context.addPyFile(str(archive))
        context._quern_shipped = True
    return spark
