"""Session defaults, the shared folder, and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings that hold at any size: AQE sizes shuffles at run time, splits skewed
# join partitions, and turns a shuffle join into a broadcast only after it has
# measured the side.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Intermediate tables that ``cut`` has written and ``clear`` deletes.
WRITTEN: list[str] = []
# Spark then deletes the shuffle files of a write when it ends, not when the driver's memory happens to be collected.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "flowtide", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to executors that do not have it, as --py-files would.

    The archive is made on the driver; Spark hands it to every executor.
    """
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="flowtide-"), "flowtide"), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names.

    Only a local master may fall back to a temporary folder; on a cluster the
    executors would not see it, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return named or os.path.dirname(current)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="flowtide-")
    sc.setCheckpointDir(named)
    return named


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for an intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/flowtide-{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write the frame to the shared folder and go on from the written table.

    The files outlive executors, so later stages never recompute what lies
    before the cut. Unlike ``checkpoint()`` this computes the plan once, keeps
    column pruning, and gives the planner the real size of the result. What was
    shuffled for it is deleted at once, as nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(frame: DataFrame) -> None:
    """Delete the table that ``cut`` has written for the frame and that nothing reads any more."""
    some = (frame.inputFiles() or [""])[0]
    for path in [p for p in WRITTEN if f"/{os.path.basename(p)}/" in some]:
        WRITTEN.remove(path)
        _delete(frame.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process, once the results that read them are written."""
    while WRITTEN:
        _delete(spark, WRITTEN.pop())
