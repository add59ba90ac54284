"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a per-source table that may be broadcast; they are counted first.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error,
    as no other folder is known to be shared.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="checkpoints-")
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its rows are computed once and
    survive the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def if_few(table: DataFrame, most: int) -> DataFrame:
    """``table``, written and counted; with a broadcast hint if it has at most ``most`` rows.
    Beyond that a join shuffles both sides."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= most else table


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 5 == 0, F.lit(False))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
