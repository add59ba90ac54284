"""Deduplication of a stream of responses, with a manifest as its state.

Each micro-batch goes through the batch operator against the manifest.  All attempts go to the
runs log, unique ones to the manifest and, with their text and a numbered name, to the unique
responses, in a folder per batch that is overwritten: a batch that is tried again after a crash
leaves the same rows, and reads only the batches before it.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import deduplicate
from ..sources.shared import exists, hadoop_path

SEEN = "hash string, unique_index bigint, compare_mode string"


#: Batches after which what they left in the manifest becomes one table.
COMPACT = 16


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers N of the folders name=N that are complete."""
    files, where = hadoop_path(spark, path)
    if not files.exists(where):
        return []
    found = (str(x.getPath().getName()) for x in files.listStatus(where) if x.isDirectory())
    return sorted(int(x.split("=")[1]) for x in found if x.startswith(f"{name}=") and exists(spark, f"{path}/{x}/_SUCCESS"))


def manifest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """hash, unique_index, compare_mode of the unique rows of all batches, or of those before one:
    the last table that batches were gathered in, and the batches since."""
    gathered = [n for n in _folders(spark, f"{folder}/manifest_until", "batch") if before is None or n <= before]
    first = gathered[-1] if gathered else 0
    paths = [f"{folder}/manifest_until/batch={first}"] if gathered else []
    paths += [f"{folder}/manifest/batch={n}" for n in _folders(spark, f"{folder}/manifest", "batch") if n >= first and (before is None or n < before)]
    return spark.read.schema(SEEN).parquet(*paths) if paths else spark.createDataFrame([], SEEN)


def compact(spark: SparkSession, folder: str, number: int) -> None:
    """Gathers the batches before ``number`` in one table.  A table that was written before stays
    until the next, so that a batch that is tried again finds what it found at first."""
    if number in _folders(spark, f"{folder}/manifest_until", "batch"):
        return
    manifest(spark, folder, number).write.mode("overwrite").parquet(f"{folder}/manifest_until/batch={number}")
    files, _ = hadoop_path(spark, folder)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    for n in _folders(spark, f"{folder}/manifest_until", "batch")[:-2]:
        files.delete(jvm.Path(f"{folder}/manifest_until/batch={n}"), True)


def runs_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every response of the stream with hash, is_unique, unique_index, when its batch began and
    ended, and where a unique one was saved."""
    return spark.read.parquet(f"{folder}/runs")


def finished_runs(spark: SparkSession, folder: str, before: int | None = None) -> int:
    """Responses that all batches, or those before one, have taken."""
    done = [n for n in _folders(spark, f"{folder}/runs", "batch") if before is None or n < before]
    return spark.read.parquet(*(f"{folder}/runs/batch={n}" for n in done)).count() if done else 0


def unique_loop(responses: DataFrame, folder: str, mode: str = "strip", seq: str = "seq", text: str = "text", every: str | None = None, runs: int = 0) -> StreamingQuery:
    """Starts the loop.  Without ``every`` it takes what there is and ends; with it, it goes on
    at that interval until it is stopped.  ``runs`` over 0 is how many responses it takes, by
    ``seq``; all later ones are left alone."""

    def batch(rows: DataFrame, number: int) -> None:
        spark, began = rows.sparkSession, datetime.now(UTC).isoformat()
        seen = manifest(spark, folder, number)
        if runs > 0:
            rows = rows.orderBy(seq).limit(max(0, runs - finished_runs(spark, folder, number)))
        if number and number % COMPACT == 0:
            compact(spark, folder, number)
        done = deduplicate(rows, mode, seq, text, seen).withColumn("compare_mode", F.lit(mode))
        saved = F.when(F.col("is_unique"), F.concat(F.lit(f"{folder}/unique/batch={number}/"), F.format_string("unique_%06d", F.col("unique_index"))))
        done = done.withColumns({"started_at": F.lit(began), "finished_at": F.lit(datetime.now(UTC).isoformat()), "saved_path": saved}).persist()
        done.write.mode("overwrite").parquet(f"{folder}/runs/batch={number}")
        done.where("is_unique").select("hash", "unique_index", "compare_mode").write.mode("overwrite").parquet(f"{folder}/manifest/batch={number}")
        named = F.format_string("unique_%06d", F.col("unique_index")).alias("name")
        done.where("is_unique").select(named, F.col(seq).alias("seq"), F.col(text).alias("text"), "hash", "unique_index", "compare_mode").write.mode("overwrite").json(f"{folder}/unique/batch={number}")
        done.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return responses.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(**trigger).start()
