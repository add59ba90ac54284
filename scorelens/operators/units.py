"""Tokens to units: words, punctuation and white space, with scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Column order of a unit table, as in its CSV form.
UNIT_COLUMNS = [
    "index", "unit_type", "text", "raw_text", "token_start", "token_end", "token_count", "token_ids", "tokens",
    "image_dependency_logp", "first_token_logp_original", "first_token_logp_masked", "first_token_delta_logp",
    "p_original", "p_masked", "delta_p", "sum_logp_original", "sum_logp_masked", "delta_sum_logp",
    "mean_logp_original", "mean_logp_masked", "delta_mean_logp", "first_token_p_original", "first_token_p_masked", "first_token_delta_p",
]


def starts_unit(kind: Column, piece: Column, kind_before: Column) -> Column:
    """Whether a token opens a unit: the first, anything next to white space, one that begins
    with a space, line end or tab, or one of another type than the token before."""
    return kind_before.isNull() | (kind_before == "space") | (kind == "space") | F.left(piece, F.lit(1)).isin(" ", "\n", "\t") | (kind != kind_before)


def shown_text(kind: Column, raw: Column) -> Column:
    return F.when(kind == "space", raw).otherwise(T.strip(raw))


def units_of_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, unit, unit_type, token_start, token_end, token_count, raw_text, text for whole texts.

    A text's tokens are in one row, so nothing is shuffled.  The pieces of the tokeniser that open
    a unit by ``starts_unit`` are those where a run of word or of other characters begins (a space
    or line end before a word goes with it), or a single space; so units are matched as a whole.
    Where each starts among the pieces follows from the units' numbers, repeated for each piece.
    Units are made whole before they become rows, so that no row carries the arrays.
    """
    rows = docs.select(id_col, T.units(F.coalesce(F.col(text_col), F.lit(""))).alias("raw")).where(F.size("raw") > 0)
    rows = rows.withColumn("kinds", F.transform("raw", T.piece_type))
    rows = rows.withColumn("counts", F.transform("raw", lambda u, k: T.pieces_in(u, F.get("kinds", k))))
    rows = rows.withColumn("of", F.flatten(F.transform("counts", lambda c, k: F.array_repeat(k, c))))
    first = F.filter(F.sequence(F.lit(0), F.size("of") - 1), lambda i: (i == 0) | (F.get("of", i) != F.get("of", i - 1)))
    rows = rows.withColumn("starts", first)

    def unit(raw: Column, k: Column) -> Column:
        start, n = F.get("starts", k), F.get("counts", k)
        return F.struct(k.alias("unit"), F.get("kinds", k).alias("unit_type"), start.alias("token_start"), (start + n).alias("token_end"), n.alias("token_count"), raw.alias("raw_text"))

    found = rows.select(id_col, F.inline(F.transform("raw", unit)))
    return found.withColumn("text", shown_text(F.col("unit_type"), F.col("raw_text")))


def units_of_tokens(tokens: DataFrame) -> DataFrame:
    """Unit scores from scored tokens: response_id, token_index, token_id, raw_token, token, and
    logp_* and p_* of both conditions.  One exchange, on response_id."""
    w = Window.partitionBy("response_id").orderBy("token_index")
    kind = T.piece_type(F.col("raw_token"))
    marked = tokens.withColumn("kind", kind).withColumn("opens", starts_unit(F.col("kind"), F.col("raw_token"), F.lag("kind").over(w)))
    marked = marked.withColumn("unit", (F.sum(F.col("opens").cast("int")).over(w) - 1).cast("int"))
    conditions = ("original", "masked")
    whole = F.array_sort(F.collect_list(F.struct("token_index", "token_id", "token", "raw_token")))
    grouped = marked.groupBy("response_id", "unit").agg(
        F.first("kind").alias("unit_type"),
        F.min("token_index").alias("token_start"),
        (F.max("token_index") + 1).alias("token_end"),
        F.count(F.lit(1)).cast("int").alias("token_count"),
        whole.alias("whole"),
        *(F.sum(f"logp_{c}").alias(f"sum_logp_{c}") for c in conditions),
        *(F.avg(f"logp_{c}").alias(f"mean_logp_{c}") for c in conditions),
        *(F.min_by(f"{x}_{c}", "token_index").alias(f"first_token_{x}_{c}") for x in ("p", "logp") for c in conditions),
    )
    raw = F.array_join(F.transform("whole", lambda x: x["raw_token"]), "")
    out = grouped.withColumns(
        {
            "raw_text": raw,
            "token_ids": F.transform("whole", lambda x: x["token_id"]),
            "tokens": F.transform("whole", lambda x: x["token"]),
            **{f"p_{c}": V.safe_exp(F.col(f"sum_logp_{c}")) for c in conditions},
        }
    ).drop("whole")
    pairs = {"delta_p": "p", "delta_sum_logp": "sum_logp", "delta_mean_logp": "mean_logp", "first_token_delta_p": "first_token_p", "first_token_delta_logp": "first_token_logp"}
    out = out.withColumn("text", shown_text(F.col("unit_type"), F.col("raw_text")))
    out = out.withColumns({k: F.col(f"{v}_original") - F.col(f"{v}_masked") for k, v in pairs.items()})
    return out.withColumn("image_dependency_logp", F.col("first_token_delta_logp"))


def dependency_top(units: DataFrame, k: int) -> DataFrame:
    """The k units of each response that depend most on the image, with their rank."""
    w = Window.partitionBy("response_id").orderBy(F.desc("image_dependency_logp"), "unit")
    return units.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
