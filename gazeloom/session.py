"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame, after: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes df as a table into the cluster's checkpoint folder and continues from there.

    The folder is spark.checkpoint.dir, which all executors share. Only a local session without one
    (tests, a single machine) takes a temporary folder; on a cluster that is an error, as every
    executor would write to a disk of its own. A table rather than checkpoint(): that one hands on
    the constraints of the plan it cuts, which grow without end in a loop. after: earlier tables
    that nothing reads any more once this one is written; they are deleted. The others are deleted
    when the session's JVM ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    path = f"{_table_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _on_files(context, path, "deleteOnExit")
    for table in after:
        if (old := getattr(table, "_lineage_table", None)) is not None:
            _on_files(context, old, "delete", True)
    written = spark.read.schema(df.schema).parquet(path)
    written._lineage_table = path
    return written


def scratch_folder(spark: SparkSession) -> str:
    """The name of a new folder beside the tables of cut_lineage, deleted when the session's JVM ends."""
    path = f"{_table_folder(spark)}/files-{uuid.uuid4().hex}"
    _on_files(spark.sparkContext, path, "mkdirs")
    _on_files(spark.sparkContext, path, "deleteOnExit")  # only what exists can be registered
    return f"{path}/data"


def _table_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not (context.master or "").startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def _on_files(context, path: str, method: str, *args) -> None:
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    getattr(place.getFileSystem(context._jsc.hadoopConfiguration()), method)(place, *args)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once, so that they needn't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_gazeloom", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-ship-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._gazeloom = True
