"""First-seen-wins deduplication of responses against a manifest.

Texts are read and hashed once; what follows works on (row, sequence number, hash).  The first of
each hash is found by an aggregate that combines before it shuffles, and comes back by its row
number, so that a frequent hash is never gathered in one task.  Unique rows are numbered by a sort
into ranges with sampled bounds and the rows' places in them, so that no task sees all rows and
far-off sequence numbers do no harm.

Rows without a sequence number come last.  Rows that share one are told apart, in no given order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import cut


def hashed(responses: DataFrame, mode: str, text: str = "text") -> DataFrame:
    """Adds hash, of the text as ``mode`` compares it."""
    return responses.withColumn("hash", T.digest(T.normalise(F.col(text), mode)))


def first_seen(rows: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """From (row, seq, hash): row, seq of the first of each hash that the manifest does not have."""
    first = rows.groupBy("hash").agg(F.min(F.struct(F.col("seq").isNull().alias("none"), "seq", "row")).alias("x"))
    if manifest is not None:
        first = first.join(manifest.select("hash").distinct(), "hash", "left_anti")
    return first.select("x.none", "x.seq", "x.row")


def numbered(unique: DataFrame, base: int = 0) -> DataFrame:
    """row, unique_index: ``base`` and the place by (none, seq, row)."""
    sorted_ = cut(unique.orderBy("none", "seq", "row").select("row"))
    placed = sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    # One row for each part of the sort.
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    inside = F.col("at").bitwiseAND(F.lit(2**33 - 1)) + 1
    return placed.join(F.broadcast(before), "part").select("row", (F.lit(base) + F.col("before") + inside).alias("unique_index"))


def deduplicate(responses: DataFrame, mode: str, seq: str, text: str = "text", manifest: DataFrame | None = None, kept: list[str] | None = None) -> DataFrame:
    """``kept`` columns (all by default) with hash, is_unique and unique_index (null for others).

    With a manifest (hash, unique_index, and compare_mode if it has one) its hashes of the same
    mode are seen, and numbers go on from its largest.
    """
    base = 0
    if manifest is not None:
        if "compare_mode" in manifest.columns:
            manifest = manifest.where(F.col("compare_mode") == mode)
        base = manifest.agg(F.max("unique_index")).first()[0] or 0
    names = responses.columns if kept is None else kept
    rows = cut(hashed(responses, mode, text).select(F.struct(*names).alias("kept"), F.col(seq).alias("seq"), "hash", F.monotonically_increasing_id().alias("row")))
    found = numbered(first_seen(rows.drop("kept"), manifest), base)
    return rows.join(found, "row", "left").select("kept.*", "hash", F.col("unique_index").isNotNull().alias("is_unique"), "unique_index")
