"""Spark helpers that the operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and stored bytes up to which a table counts as small enough to broadcast.
SMALL_ROWS, SMALL_BYTES = 400_000, 16 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch of texts (30 MB at most where a text has 30 kB on average).
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS: a batch of texts is held twice, by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with one of this application's own in it.

    Where the session names none, a run on this machine alone (as in tests)
    gets a temporary one; on a cluster that would be lost with an executor, so
    there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evenhand-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/evenhand-{spark.sparkContext.applicationId}"


def discard(spark: SparkSession) -> None:
    """Deletes what ``written`` has put into the shared folder; for a job to call once its results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder as Parquet and read again.

    Cuts the lineage: later jobs read files that survive a lost executor,
    with column pruning and with sizes that the planner knows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that no later job reads."""
    for df in tables:
        for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small by rows and by bytes, else as it is (a shuffle join).

    ``df`` must be a written table: its rows are counted, its files' sizes known.
    """
    stored = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if stored <= size and df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected links (a, b): (id, component), component the least id.

    Large-star and small-star rounds; each is two aggregations and two joins,
    so a hub's links are combined map-side and never gathered in one place.
    Ids without a link do not appear.
    """
    edges = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lower, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lower.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        edges = written(small)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
