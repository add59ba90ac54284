"""Token prefixes: validation, forced continuation and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validity(rows: DataFrame, group: str, end_index: Column | None = None) -> DataFrame:
    """group, n, is_valid: whether indexes are 0 .. n-1, each once, and end at ``end_index``."""
    shape = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.count_distinct("index").alias("different"), *([F.max(end_index).alias("end")] if end_index is not None else []))
    right = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("different") == F.col("n"))
    if end_index is not None:
        right &= F.col("high") == F.col("end")
    return shape.select(group, "n", right.alias("is_valid"))


def prefix_ids(rows: DataFrame, group: str) -> DataFrame:
    """group, ids: token ids by index, for groups that are valid."""
    shape = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("index", "token_id"))).alias("x"))
    whole = F.forall(F.transform("x", lambda v, i: v["index"] == i), lambda b: b)
    return shape.where(whole).select(group, F.transform("x", lambda v: v["token_id"]).alias("ids"))


def checked_prefix(rows: DataFrame, end_index: int) -> list[int]:
    """The ids of one prefix up to ``end_index``; an error if any index is missing or double.
    A prefix has at most end_index + 1 tokens."""
    kept = rows.where(F.col("index") <= end_index).orderBy("index").limit(end_index + 2 if end_index >= 0 else 1).collect()
    if not kept:
        raise ValueError(f"no rows up to index {end_index}")
    found = [r["index"] for r in kept]
    if found != list(range(len(found))):
        raise ValueError(f"indexes are not contiguous from 0: {found[:20]}")
    if found[-1] != end_index:
        raise ValueError(f"the prefix ends at {found[-1]}, not {end_index}")
    return [r["token_id"] for r in kept]


def parse_ids(value: Column) -> Column:
    """Comma-separated ids; blanks are skipped, anything else that is no number is an error."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.raise_error(F.lit("no token ids"))).otherwise(F.transform(parts, lambda x: x.cast("int")))


def try_parse_ids(value: Column) -> Column:
    """As ``parse_ids``, null instead of an error."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    ids = F.transform(parts, lambda x: x.try_cast("int"))
    return F.when((F.size(parts) > 0) & F.forall(ids, lambda x: x.isNotNull()), ids)


def append_ids(inputs: DataFrame, new: Column) -> DataFrame:
    """input_ids, attention_mask and, where there is one, token_type_ids with ``new`` appended;
    an error if there is nothing to append."""
    checked = F.when(F.size(new) == 0, F.raise_error(F.lit("no tokens to append"))).otherwise(new)
    out = inputs.withColumn("new_", checked)
    columns = {"input_ids": F.concat("input_ids", "new_"), "attention_mask": F.concat("attention_mask", F.array_repeat(F.lit(1), F.size("new_")))}
    if "token_type_ids" in inputs.columns:
        columns["token_type_ids"] = F.concat("token_type_ids", F.array_repeat(F.lit(0), F.size("new_")))
    return out.withColumns(columns).drop("new_")


def user_message(prompt: Column, image: Column, min_pixels: int, max_pixels: int) -> Column:
    """One user message with an image and a text part, as JSON."""
    picture = F.struct(F.lit("image").alias("type"), image.alias("image"), F.lit(min_pixels).alias("min_pixels"), F.lit(max_pixels).alias("max_pixels"), F.lit(None).cast("string").alias("text"))
    words = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), F.lit(None).cast("int").alias("min_pixels"), F.lit(None).cast("int").alias("max_pixels"), prompt.alias("text"))
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.array(picture, words).alias("content"))))


def with_privileged(prompt: Column, info: Column) -> Column:
    return F.concat_ws("\n\n", prompt, info)
