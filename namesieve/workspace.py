"""Folders for a job's working tables, in the storage that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a statement when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_folder(spark: SparkSession) -> str:
    """A new folder for one job, removed when the application ends.

    It lies in ``spark.checkpoint.dir``. A session without that setting uses its
    warehouse directory, which on a cluster must be a shared one: Spark's default
    is a folder of the machine, and is refused there. The machine's temporary
    folder is never used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "")
        one_machine = spark.sparkContext.master.split("[")[0] == "local"
        if not warehouse or (not one_machine and warehouse.startswith(("file:", "/"))):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{warehouse.rstrip('/')}/_work"
    folder = f"{shared.rstrip('/')}/namesieve-{uuid.uuid4().hex}"
    files, path = _file_system(spark, folder)
    files.deleteOnExit(path)
    return folder


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a work folder before the application ends."""
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def create_file(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if there is one already."""
    files, target = _file_system(spark, path)
    files.mkdirs(target.getParent())
    return files.createNewFile(target)


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _file_system(spark, folder)
    return files.exists(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and read it back: cuts lineage, survives lost executors.

    Working tables are mostly text; zstd keeps them smaller than the default does.
    Nothing reads the write's shuffles afterwards, so their files are removed with it
    and a job's disk is that of its tables and one write.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
