"""Mixing sources to target weights by Pareto order sampling.

Sources share all words by weight, each at most ``most`` times its own; what exceeds that is
shared again.  A document of a source whose target is r times its size gets floor(r) certain
copies.  The rest, a part f of the source, is drawn: documents are ranked by their random odds
divided by their inclusion odds, u/(1-u) over f/(1-f), and taken in this order while their
words fit.  Further documents, each time the largest that fits (of equal ones the first in this
order), close the gap that remains until none fits, so a source misses its target by less than
its shortest document not drawn.  How many of which size go in follows from counts by size.

The order is found without sorting a source in one task: the rank is cut into 1,024 bins, the
bin that crosses the target into 1,024 again, and only the rows of that one are sorted.

Defined cases: null and empty texts have size 0, and documents of size 0 take 0; a very long
text takes memory of its own size only; null is the last source; rows that repeat id and text
are taken or left together; of equal ranks the smaller (id, hash of the text) comes first, a null
id being the smallest; random numbers come from md5 of the id and the seed (null: of the text
'null'), so reruns agree; an empty table gives an empty result; further columns are carried along
by ``mixed`` whatever their names, and left out by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, if_few

WORD = r"[^\x20\x09-\x0D]"
AROUND = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
BINS = 1024


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size -> and target.  One row per source goes through one task.

    A source stops at its limit if the level (target per weight) that would use up all words
    exceeds its limit per weight; with sources in order of that quotient, the level is the words
    beyond the limits of the sources before, over the weight from there on.
    """
    n = len(weights)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n + 1).cast("long"))
    ranked = ranked.withColumn("limit", F.col("source_size") * most)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("w"), F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    heavy = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    ranked = ranked.withColumns({"left": left, "heavy": heavy})
    ranked = ranked.withColumn("open", F.col("left") * F.col("w") < F.col("limit") * F.col("heavy"))
    first = ranked.withColumn("k", F.row_number().over(order)).withColumn("at", F.min(F.when(F.col("open"), F.col("k"))).over(every))
    level = [F.max(F.when(F.col("k") == F.col("at"), F.col(c))).over(every) for c in ("left", "heavy")]
    shared = F.col("w") * level[0] / level[1]
    return first.select("source", "source_size", F.when(F.col("k") >= F.col("at"), shared).otherwise(F.col("limit")).cast("double").alias("target"))


def count_words(text: Column) -> Column:
    """Words of a text.  Each, with the white space around it, becomes one character; no list of
    words is made, so a text takes no more memory than itself."""
    return F.when(has_words(text), F.length(F.regexp_replace(text, AROUND, "x"))).otherwise(0).cast("long")


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(WORD), F.lit(False))


def _facts(seed: str, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What the decision on a row needs besides its size."""
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return [
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        ((hashed.cast("long") + F.lit(0.5)) / F.lit(float(2**52))).alias("u"),
        F.xxhash64(text_col).alias("check"),
    ]


def _with_source(left: DataFrame, right: DataFrame, *columns, few: bool, how: str = "inner", source: str = "source") -> DataFrame:
    """``left`` with columns of its source's row; null is a source like any other.  ``right`` is
    broadcast if the sources were counted to be few."""
    return left.alias("a").join((F.broadcast(right) if few else right).alias("b"), F.col(f"a.{source}").eqNullSafe(F.col("b.source")), how).select("a.*", *columns)


def _rank():
    f, u = F.col("f"), F.col("u")
    return u * (1 - f) / (u * (1 - f) + f * (1 - u))


def _decisions(rows: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, bool, DataFrame]:
    """(table, whether it has few rows, documents drawn beyond).  The table has by source:
    source_size, target, copies, f, the first key that is not drawn.  A key is (rank, doc_id, check)."""
    total = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    s, t = F.col("source_size"), F.col("target")
    copies = F.when(s > 0, F.least(F.lit(most), F.floor(t / s))).otherwise(0).cast("long")
    total = total.withColumn("copies", copies).withColumn("rest", F.greatest(F.lit(0.0), t - F.col("copies") * s))
    total = cut(total.withColumn("f", F.when(s > 0, F.col("rest") / s).otherwise(0.0)))
    few = total.count() <= BROADCAST_ROWS

    drawn = _with_source(rows.where("size > 0"), total, "f", "rest", few=few).where("f > 0").withColumn("rank", _rank())
    drawn = drawn.withColumns({"bin": F.floor(F.col("rank") * BINS), "fine": F.floor(F.col("rank") * (BINS * BINS)) % BINS})
    drawn = drawn.withColumn("key", F.struct("rank", "doc_id", "check")).withColumn("base", F.lit(0).cast("long"))

    def crossing(table: DataFrame, bin_: str) -> DataFrame:
        """For each source the first bin whose words, with those before, exceed the rest."""
        summed = table.groupBy("source", bin_).agg(F.sum("size").alias("n"), F.max("rest").alias("rest"), F.max("base").alias("base"))
        upto = F.col("base") + F.sum("n").over(Window.partitionBy("source").orderBy(bin_))
        first = summed.withColumn("upto", upto).where("upto > rest").groupBy("source")
        return first.agg(F.min(F.struct(F.col(bin_).alias("at"), (F.col("upto") - F.col("n")).alias("before"))).alias("x")).select("source", "x.*")

    inside = drawn
    for bin_ in ("bin", "fine"):
        inside = _with_source(inside, crossing(inside, bin_), "b.at", "b.before", few=few).where(F.col(bin_) == F.col("at")).withColumn("base", F.col("before")).drop("at", "before")
    # Rows of one key are one unit, within the sum up to it.
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("rank", "doc_id", "check"))
    unit = F.sum("size").over(Window.partitionBy("source", "rank", "doc_id", "check"))
    beyond = inside.withColumns({"upto": upto, "unit": unit}).where("upto > rest").groupBy("source")
    state = cut(beyond.agg(F.min(F.struct("key", (F.col("rest") - F.col("upto") + F.col("unit")).alias("gap"))).alias("x")).select("source", "x.*"))
    return cut(_with_source(total, state, "key", few=few, how="left")), few, _fill(drawn, state, few)


def _fill(drawn: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """source, doc_id, check of what goes into the gaps, the largest that fits first."""
    units = _with_source(drawn, state, F.col("b.key").alias("from"), "gap", few=few).where("key >= from and size <= gap")
    units = units.groupBy("source", "key").agg(F.sum("size").alias("size"), F.max("gap").alias("gap")).where("size <= gap")
    sizes = units.groupBy("source", "size").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).groupBy("source")
    down = sizes.agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"), F.max("gap").alias("gap"))
    start = F.struct(F.col("gap"), F.array().cast("array<struct<size:bigint,take:bigint>>").alias("taken"))

    def step(s, x):
        take = F.least(x["n"], F.floor(s["gap"] / x["size"])).cast("long")
        more = F.concat(s["taken"], F.array(F.struct(x["size"].alias("size"), take.alias("take"))))
        return F.when(x["size"] <= s["gap"], F.struct((s["gap"] - take * x["size"]).alias("gap"), more.alias("taken"))).otherwise(s)

    plan = cut(down.select("source", F.inline(F.aggregate("sizes", start, step, lambda s: s["taken"]))))
    most = plan.agg(F.max("take")).first()[0] or 0
    # A constant limit cuts each task's rows before they are shuffled.
    place = F.row_number().over(Window.partitionBy("source", "size").orderBy("key"))
    first = units.withColumn("place", place).where(F.col("place") <= most).alias("a")
    found = first.join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("place") <= F.col("take")))
    return if_few(found.select("a.source", "key.doc_id", "key.check"), BROADCAST_ROWS)


def _decided(rows: DataFrame, per_source: DataFrame, few: bool, beyond: DataFrame) -> DataFrame:
    """Adds source_size, target, copies (0 for size 0) to rows with doc_id, source, u, check and
    ``some`` (whether the size is over 0); no row moves where the tables of sources and of
    documents drawn beyond are broadcast."""
    got = _with_source(rows, per_source, "source_size", "target", F.col("b.copies").alias("whole"), "f", F.col("b.key").alias("from"), few=few)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("source", "doc_id", "check")]
    got = got.alias("a").join(beyond.withColumn("more", F.lit(True)).alias("c"), same, "left").select("a.*", "more")
    key = F.struct(_rank().alias("rank"), "doc_id", "check")
    once = (F.col("f") > 0) & (F.col("from").isNull() | (key < F.col("from")) | F.coalesce("more", F.lit(False)))
    return got.withColumn("copies", F.when(F.col("some"), F.col("whole") + F.coalesce(once, F.lit(False)).cast("long")).otherwise(0).cast("int"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies."""
    rows = cut(docs.select(*_facts(seed, id_col, text_col, source_col), count_words(F.col(text_col)).alias("size")))
    out = _decided(rows.withColumn("some", F.col("size") > 0), *_decisions(rows, weights, most))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` itself with each row as often as the mix takes it.  Texts are not shuffled, and
    their words are counted once; the rows of ``docs`` travel in one struct, so that no name of
    theirs can meet one used here."""
    facts = _facts(seed, id_col, text_col, source_col)
    sizes = cut(docs.select(*facts, count_words(F.col(text_col)).alias("size")))
    rows = docs.select(F.struct("*").alias("row"), *facts, has_words(F.col(text_col)).alias("some"))
    out = _decided(rows, *_decisions(sizes, weights, most)).where("copies > 0")
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
