"""Source files as a stream: each batch parses new or changed files, and the
results over all files are saved after it, so that they survive a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtide.functions import paths
from flowtide.plans.engine import Engine
from flowtide.sources.repository import relative_path

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def source_stream(spark: SparkSession, root: str, names: str = "*.{js,jsx,ts,tsx}") -> DataFrame:
    """(file_path, text) of files as they appear below root.

    The file stream reports each path once; hand changed files to ``save_batch``.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    )
    path = relative_path(F.col("path"), root)
    return files.select(path.alias("file_path"), F.decode("content", "UTF-8").alias("text")).where(
        paths.is_scanned(F.col("file_path"))
    )


def current_nodes(spark: SparkSession, out: str, batch: int) -> DataFrame:
    """The nodes of every file as of a batch: each file counts as its latest batch read it."""
    listed = spark.read.parquet(f"{out}/files").where(F.col("batch") <= batch)
    latest = listed.groupBy("file_path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/nodes").join(latest, ["file_path", "batch"], "left_semi").drop("batch")


def save_batch(files: DataFrame, batch: int, out: str, strict: bool = True, **options) -> None:
    """Parse the files of one batch, then analyse all files as they are now.

    Only new and changed files are parsed; calls resolve against all stored
    functions, and a changed file replaces its earlier self. Results lie in the
    folder of the batch; overwriting it makes a repeated batch harmless.
    """
    out = out.rstrip("/")
    files.select("file_path").distinct().write.mode("overwrite").parquet(f"{out}/files/batch={batch}")
    Engine.parse(files, strict).write.mode("overwrite").parquet(f"{out}/nodes/batch={batch}")
    engine = Engine(files.sparkSession, current_nodes(files.sparkSession, out, batch), **options)
    for name, table in (("findings", engine.findings), ("flows", engine.graph.flows), ("failed_files", engine.failed_files)):
        table.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def watch(files: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Analyse all files that are there now, batch by batch."""
    return (
        files.writeStream.foreachBatch(lambda df, batch: save_batch(df, batch, out, **options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def saved(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The results after the latest batch."""
    every = spark.read.parquet(f"{out.rstrip('/')}/{name}")
    last = spark.read.parquet(f"{out.rstrip('/')}/files").agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")
