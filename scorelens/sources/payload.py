"""JSON documents of a run: responses with their token and unit scores, and run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scores import TOKEN_COLUMNS
from ..operators.units import UNIT_COLUMNS

KEEP_NULLS = {"ignoreNullFields": "false"}


def _ordered(table: DataFrame, columns: list[str], name: str) -> DataFrame:
    whole = F.array_sort(F.collect_list(F.struct("index", F.struct(*columns).alias("x"))), lambda a, b: a["index"] - b["index"])
    return table.groupBy("response_id").agg(F.transform(whole, lambda v: v["x"]).alias(name))


def responses(tokens: DataFrame, units: DataFrame | None, label: str, source_image: str) -> DataFrame:
    """response_id, response: label, source image, text, token ids, token scores and unit scores
    (none without ``units``) in order."""
    scored = _ordered(tokens, TOKEN_COLUMNS, "token_scores")
    if units is None:
        scored = scored.withColumn("word_scores", F.array().cast("array<string>"))
    else:
        scored = scored.join(_ordered(units, UNIT_COLUMNS, "word_scores"), "response_id", "left")
    text = F.array_join(F.transform("token_scores", lambda t: t["raw_token"]), "")
    ids = F.transform("token_scores", lambda t: t["token_id"])
    fields = [F.lit(label).alias("label"), F.lit(source_image).alias("source_image"), text.alias("generated_text"), ids.alias("generated_token_ids"), "token_scores", "word_scores"]
    return scored.select("response_id", F.struct(*fields).alias("response"))


def probe(original: DataFrame, masked: DataFrame | None, run: dict[str, Column]) -> DataFrame:
    """response_id, payload: the run's fields, both responses, the original one again at the top
    and the masked one there under masked_ names."""
    rows, both = original, [F.col("response").alias("original_image_response")]
    if masked is not None:
        rows = original.join(masked.withColumnRenamed("response", "second"), "response_id")
        both.append(F.col("second").alias("masked_image_response"))
    shown = ["generated_text", "generated_token_ids", "token_scores", "word_scores"]
    top = [F.col(f"response.{c}").alias(c) for c in shown]
    if masked is not None:
        top += [F.col(f"second.{c}").alias(f"masked_{c}") for c in shown]
    body = F.struct(*(v.alias(k) for k, v in run.items()), F.struct(*both).alias("responses"), *top)
    return rows.select("response_id", F.to_json(body, KEEP_NULLS).alias("payload"))


def privileged(path: str, info: str) -> Column:
    """What a run records of privileged information."""
    text = F.lit(info)
    return F.struct(F.lit(path).alias("path"), F.length(text).alias("num_chars"), F.sha2(text, 256).alias("sha256"), F.lit("masked_condition_prompt").alias("applied_to"))


def meaning(labels: tuple[str, str]) -> str:
    return f"p_original and logp_original score this response under {labels[0]}; p_masked and logp_masked score the same response under {labels[1]}."
