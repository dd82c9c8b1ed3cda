"""Incremental ingest of newly arrived state-year files; the checkpoint is the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest_new(spark: SparkSession, folder: str, table: str, checkpoint: str, columns: list[str]) -> int:
    """Reads the CSV files that no earlier run has read, appends them to ``table``, and returns how many rows came."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    stream = spark.readStream.schema(schema).option("header", True).csv(folder)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def ingest_register(spark: SparkSession, folder: str, table: str, aside: str, checkpoint: str, columns: list[str], files_at_once: int = 200) -> int:
    """Loads the CSV files that arrived since the last run, sets aside those that cannot be read, and returns how many files it looked at.

    The stream carries file names only, ``files_at_once`` to a batch.  A batch
    is read as a whole; if that fails, file by file, so that one broken file
    leaves the rest loaded.  ``table`` has the rows with ``file`` and ``batch``
    (a batch that runs again replaces its own rows), ``aside`` (file, reason).
    A header other than ``columns``, a row of another length, or a line break
    inside a value (lines are split between tasks) breaks a file.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def rows(paths: list[str]) -> DataFrame:
        found = spark.read.schema(schema).options(header=True, enforceSchema=False, mode="FAILFAST", quote='"', escape='"').csv(paths)
        return found.withColumn("file", F.col("_metadata.file_name"))

    def load(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # files_at_once at most
        place = f"{table}/batch={number}"
        try:
            rows(paths).write.mode("overwrite").parquet(place)
            return
        except Exception as whole:  # noqa: BLE001  any file may be the broken one
            if len(paths) == 1:
                broken = [(paths[0], _reason(whole))]
                good: list[str] = []
            else:
                broken, good = [], []
                for path in paths:
                    try:
                        rows([path]).write.format("noop").mode("overwrite").save()
                        good.append(path)
                    except Exception as one:  # noqa: BLE001
                        broken.append((path, _reason(one)))
        if good:
            rows(good).write.mode("overwrite").parquet(place)
        spark.createDataFrame(broken, "file string, reason string").coalesce(1).write.mode("overwrite").json(f"{aside}/batch={number}")

    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(folder)
    query = names.select("path", "length").writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _reason(error: Exception) -> str:
    return str(error).strip().partition("\n")[0][:300] or type(error).__name__
