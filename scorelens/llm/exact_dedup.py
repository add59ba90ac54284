"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries style frequent-items sketch over digests (partial sketches per task, combined in
two steps) proposes frequent digests.  Exact counts and a second hash of their texts verify
them; the winners, at most ``heavy`` rows, are broadcast and their copies are resolved where
they lie.  The other digests are shuffled in the ordinary way: counted by an aggregate that
combines before it shuffles, and joined with their rows, so that no task must hold a group.

Defined cases: null text counts as empty; of equal texts the largest doc_id stays, a null id
being the smallest; a row that repeats both id and text is a further copy and exactly one of
such rows stays; texts of any length count as a whole; an empty table gives an empty result;
further columns are not looked at, and carried along by ``drop_copies`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, if_few

SKETCHES = 64
#: Rows to take out that may be broadcast (about 25 MB).
BROADCAST_GONE = 300_000


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).alias("bytes"),
        F.monotonically_increasing_id().alias("rid"),
    )


def frequent(digests: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """Up to ``heavy`` values of xxhash64(digest) that a sketch of ``tracked`` counters holds
    for frequent.  They are candidates: their counts are checked afterwards."""
    part = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("part")).agg(
        F.expr(f"approx_top_k_accumulate(xxhash64(digest), {tracked})").alias("state")
    )
    # Grouped, though all fall in one group: an ungrouped combination fails on tasks without rows.
    top = part.groupBy((F.col("part") < SKETCHES).alias("all")).agg(F.expr(f"approx_top_k_combine(state, {tracked})").alias("state"))
    items = top.select(F.explode(F.expr(f"approx_top_k_estimate(state, {heavy})")).alias("x"))
    return items.where("x.count > 1").select(F.col("x.item").alias("item"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, tracked: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    d = cut(_digests(docs, id_col, text_col))
    candidates = frequent(d, heavy, tracked)
    one = [F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("top")]
    winners = cut(
        d.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("item"), "left_semi")
        .groupBy("digest")
        .agg(*one, ((F.min("check") == F.max("check")) & (F.min("bytes") == F.max("bytes"))).alias("verified"))
        .where("verified and group_size > 1")
        .drop("verified")
    )
    hot = d.join(F.broadcast(winners), "digest")
    rest = d.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    same = ["digest", "check", "bytes"]
    copies = rest.groupBy(*same).agg(*one).where("group_size > 1")
    alone = [F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("top", F.struct("doc_id", "rid")).alias("top")]
    rest = rest.join(copies, same, "left").select(*d.columns, *alone)
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row for each text.

    The rows that go are found first and taken out by an anti-join on id and digest, so that
    texts are shuffled only where the list of them is counted to be too long to broadcast.  Rows that repeat
    id and text are few; they are brought together by themselves.
    """
    marked = cut(groups(docs, id_col, text_col, **options).select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("d"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("last"), "kept"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256).alias("digest"))

    def match(t: DataFrame):
        return rows["id"].eqNullSafe(t["i"]) & (rows["digest"] == t["d"])

    gone = if_few(marked.where(~F.col("last")).select("i", "d").distinct(), BROADCAST_GONE)
    again = cut(marked.where(F.col("last") & ~F.col("kept")).select("i", "d").distinct())
    if again.isEmpty():
        return rows.join(gone, match(gone), "left_anti").select("row.*")
    once = rows.join(again, match(again), "left_semi").groupBy("id", "digest").agg(F.first("row").alias("row"))
    return rows.join(gone, match(gone), "left_anti").join(again, match(again), "left_anti").select("row.*").unionByName(once.select("row.*"))
