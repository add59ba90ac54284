"""The folder that driver and executors share, and tables cut from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, and a cluster
    an error, as no other folder is known to be shared."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="shared-")
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its rows are computed once."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = hadoop_path(spark, path)
    return files.exists(where)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file from the driver, to any store that Spark knows; folders are made."""
    files, where = hadoop_path(spark, path)
    out = files.create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """One small file's text; a missing one is an error."""
    return spark.read.text(path, wholetext=True).first().value
