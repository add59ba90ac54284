"""Teacher-forced token scores under two conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.shared import cut

KEY = ["response_id", "token_index"]
#: Rows of a vocabulary that may be broadcast (about 64 MB).
VOCABULARY = 1_000_000
#: Column order of a token table, as in its CSV form.
TOKEN_COLUMNS = [
    "index", "token_id", "token", "raw_token", "p_original", "p_masked", "delta_p", "logp_original", "logp_masked", "delta_logp",
    "top_token_id_original", "top_token_original", "top_raw_token_original", "top_p_original", "top_logp_original",
    "top_token_id_masked", "top_token_masked", "top_raw_token_masked", "top_p_masked", "top_logp_masked",
    "top_token_changed", "target_is_top_original", "target_is_top_masked",
]


def token_statistics(logits: DataFrame) -> DataFrame:
    """response_id, token_index, token_id, z -> logp, p, top_token_id, top_logp, top_p.

    Whole vectors are scored inside their row: no explode and no shuffle.
    """
    scored = logits.withColumn("top", F.array_max("z"))
    scored = scored.withColumn("lse", V.log_sum_exp(F.col("z"), F.col("top")))
    logp, top_logp = F.get("z", F.col("token_id")) - F.col("lse"), F.col("top") - F.col("lse")
    return scored.select(*KEY, "token_id", logp.alias("logp"), F.exp(logp).alias("p"), V.argmax(F.col("z"), F.col("top")).alias("top_token_id"), top_logp.alias("top_logp"), F.exp(top_logp).alias("top_p"))


def shifted(logits: DataFrame) -> DataFrame:
    """Each token with the vector of the position before, which predicts it; first ones go."""
    w = Window.partitionBy("response_id").orderBy("token_index")
    return logits.withColumn("z", F.lag("z").over(w)).where("z is not null")


def paired(original: DataFrame, masked: DataFrame) -> DataFrame:
    """Statistics of the same tokens under both conditions, side by side, with differences."""
    named = ["logp", "p", "top_token_id", "top_logp", "top_p"]
    a = original.select(*KEY, "token_id", *(F.col(c).alias(f"{c}_original") for c in named))
    b = masked.select(*KEY, *(F.col(c).alias(f"{c}_masked") for c in named))
    return a.join(b, KEY).withColumns(
        {
            "delta_p": F.col("p_original") - F.col("p_masked"),
            "delta_logp": F.col("logp_original") - F.col("logp_masked"),
            "top_token_changed": F.col("top_token_id_original") != F.col("top_token_id_masked"),
            "target_is_top_original": F.col("token_id") == F.col("top_token_id_original"),
            "target_is_top_masked": F.col("token_id") == F.col("top_token_id_masked"),
        }
    )


def next_token_topk(vectors: DataFrame, id_col: str, k: int) -> DataFrame:
    """id, rank (from 1), token_id, probability of the k likeliest entries of z."""
    scored = vectors.withColumn("top", F.array_max("z"))
    scored = scored.withColumn("lse", V.log_sum_exp(F.col("z"), F.col("top")))
    best = scored.select(id_col, "lse", F.posexplode(V.ranked(F.col("z"), k)).alias("at", "x"))
    return best.select(id_col, (F.col("at") + 1).alias("rank"), F.col("x.token_id").alias("token_id"), F.exp(-F.col("x.less") - F.col("lse")).alias("probability"))


def inspected(vectors: DataFrame, id_col: str, token_ids: list[int]) -> DataFrame:
    """id, token_id, probability of the given entries of z."""
    scored = vectors.withColumn("lse", V.log_sum_exp(F.col("z"), F.array_max("z")))
    asked = scored.withColumn("token_id", F.explode(F.array(*map(F.lit, token_ids))))
    return asked.select(id_col, "token_id", F.exp(F.get("z", F.col("token_id")) - F.col("lse")).alias("probability"))


def vocabulary(pieces: DataFrame, size: int) -> DataFrame:
    """token_id, raw_token: the most frequent values of ``piece``; ties by value."""
    counted = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "piece").limit(size)
    ids = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "piece")) - 1
    return top.select(ids.cast("int").alias("token_id"), F.col("piece").alias("raw_token"))


def decoded(tokens: DataFrame, vocab: DataFrame, ids: dict[str, str], entry: str | None = None) -> DataFrame:
    """Adds raw and shown pieces for columns of ids: {id column: suffix of the new columns}.

    The vocabulary is written and counted first, and broadcast if it has at most VOCABULARY rows;
    beyond that the join shuffles.  An empty piece falls back to the column ``entry`` of the
    vocabulary, if named.
    """
    vocab = cut(vocab)
    few = vocab.count() <= VOCABULARY
    piece = F.coalesce(F.nullif("raw_token", F.lit("")), F.col(entry)) if entry else F.col("raw_token")
    for column, suffix in ids.items():
        own = vocab.select(F.col("token_id").alias("v_id"), piece.alias("v_piece"))
        tokens = tokens.join(F.broadcast(own) if few else own, tokens[column] == F.col("v_id"), "left").drop("v_id")
        tokens = tokens.withColumnRenamed("v_piece", f"raw_token{suffix}").withColumn(f"token{suffix}", T.display(F.col(f"raw_token{suffix}")))
    return tokens


def trim_tail(tokens: DataFrame, specials: list[int]) -> DataFrame:
    """Tokens up to each response's last one that is not special; special ones before stay."""
    last = F.max(F.when(~F.col("token_id").isin(specials), F.col("token_index"))).over(Window.partitionBy("response_id"))
    return tokens.withColumn("last_", last).where("token_index <= last_").drop("last_")


def decoded_text(tokens: DataFrame, vocab: DataFrame, specials: list[int]) -> DataFrame:
    """response_id, text: pieces in order without special tokens, stripped; '' if none."""
    spoken = decoded(tokens, vocab, {"token_id": ""}).withColumn("said", F.when(F.col("token_id").isin(specials), "").otherwise(F.coalesce("raw_token", F.lit(""))))
    ordered = F.array_sort(F.collect_list(F.struct("token_index", "said")))
    return spoken.groupBy("response_id").agg(T.strip(F.array_join(F.transform(ordered, lambda x: x["said"]), "")).alias("text"))


def limited(tokens: DataFrame, most: int) -> DataFrame:
    """At most so many tokens of each response."""
    return tokens.where(F.col("token_index") < most)


def clamp01(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def hue(p: Column) -> Column:
    """Colour of a probability: 8 (red) to 136 (green), one decimal, halves to even."""
    return F.bround(8 + 128 * clamp01(p), 1)


def ticks(scores: DataFrame, labels: int = 40) -> DataFrame:
    """Adds is_tick: every (n div labels)-th token of its response, at least every one."""
    n = F.count(F.lit(1)).over(Window.partitionBy("response_id"))
    return scores.withColumn("is_tick", F.col("token_index") % F.greatest(F.lit(1), F.floor(n / labels)) == 0)


def non_empty(scores: DataFrame, what: str = "no scoreable tokens") -> DataFrame:
    """``scores``, or an error when it has no rows.  Looks for one row."""
    if scores.isEmpty():
        raise RuntimeError(what)
    return scores
