"""Generation with a model as tables, or with any model that a worker can load.

A bundle holds a vocabulary (token_id, raw_token), the ids of special tokens and a loader.  Each
Python worker calls the loader once; what it returns gives, for lists of ids, the logits of what
comes next.  ``table_model`` is such a loader over a table (last_id, z): the vector after each id.

Prompts go through in batches, all of a batch by one step at a time; nothing is shuffled.  Draws are
by a hash of the seed, the response and the step, so reruns agree and no row depends on its batch.
Shown text leaves special tokens out and is stripped; special ids at the end are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.shared import cut
from .prefix import append_ids

Step = Callable[[list[list[int]]], np.ndarray]

#: Rows of a table of logits that may be sent to every worker.
TABLE_ROWS = 200_000


@dataclass(frozen=True)
class Bundle:
    """vocabulary, a function that gives a step, ids that texts leave out, ids that end a text."""

    vocabulary: DataFrame
    load: Callable[[], Step]
    specials: tuple[int, ...] = ()
    ends: tuple[int, ...] = ()


def table_model(table: DataFrame) -> Callable[[], Step]:
    """A loader over (last_id, z).  The table is counted and sent to each worker once; after an id
    that it does not have, all entries are equal."""
    table = cut(table.select(F.col("last_id").cast("long").alias("last_id"), V.doubles(F.col("z")).alias("z")))
    n = table.count()
    if n > TABLE_ROWS:
        raise ValueError(f"a table model of {n} rows is too large to be sent to workers")
    rows = table.toPandas()
    sent = table.sparkSession.sparkContext.broadcast((rows["last_id"].to_numpy(), np.stack(rows["z"].to_list()) if n else np.zeros((0, 1))))

    def load() -> Step:
        ids, z = sent.value
        place = {int(t): k for k, t in enumerate(ids)}
        whole = np.vstack((z, np.zeros((1, z.shape[1]))))
        return lambda rows: whole[[place.get(r[-1] if r else -1, len(ids)) for r in rows]]

    return load


def bundle(spark: SparkSession, vocabulary: str, table: str, specials: tuple[int, ...] = (), ends: tuple[int, ...] = ()) -> Bundle:
    """From the paths of a vocabulary and of a table of logits."""
    return Bundle(spark.read.parquet(vocabulary), table_model(spark.read.parquet(table)), specials, ends)


def prompt_inputs(prompts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, unknown: int) -> DataFrame:
    """id, input_ids, attention_mask: the pieces of each text by their ids, ``unknown`` for others."""
    pieces = T.pieces(F.coalesce(F.col(text_col), F.lit("")))
    rows = prompts.select(id_col, F.posexplode_outer(pieces).alias("at", "piece"))
    known = cut(vocabulary.select(F.col("raw_token").alias("piece"), "token_id").dropDuplicates(["piece"]))
    joined = rows.join(F.broadcast(known) if known.count() <= TABLE_ROWS else known, "piece", "left")
    ids = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", F.coalesce("token_id", F.lit(unknown)).cast("int").alias("t")))))
    whole = joined.groupBy(id_col).agg(F.transform(ids, lambda x: x["t"]).alias("input_ids"))
    return whole.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def drawn(z: np.ndarray, u: np.ndarray, temperature: float | None, top_p: float | None) -> np.ndarray:
    """An entry of each row by its number in 0..1: likelier ones first, those beyond the first that
    reach ``top_p`` left out."""
    z = z / (temperature or 1.0)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")
    p = np.take_along_axis(p, order, 1)
    if top_p is not None:
        p[np.cumsum(p, axis=1) - p >= top_p] = 0.0
        p[:, 0] = np.maximum(p[:, 0], 1e-300)
    upto = np.cumsum(p, axis=1)
    at = np.minimum((upto <= (u * upto[:, -1])[:, None]).sum(1), (p > 0).sum(1) - 1)
    return order[np.arange(len(z)), at]


def uniform(seed: int, key, step: int) -> float:
    return int(hashlib.md5(f"{seed}:{key}:{step}".encode()).hexdigest()[:12], 16) / 16**12


def generated(inputs: DataFrame, model: Bundle, id_col: str, max_new_tokens: int, do_sample: bool = False, temperature: float | None = None, top_p: float | None = None, seed: int = 7) -> DataFrame:
    """``id_col``, token_ids: what follows input_ids, up to an id that ends a text, without special
    ids at its end.  Temperature and top_p matter only when sampling."""
    load, ends, specials = model.load, frozenset(model.ends), frozenset(model.specials)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = None
        for b in batches:
            step = step or load()
            rows = [list(map(int, x)) for x in b["input_ids"]]
            keys, new, going = b[id_col].tolist(), [[] for _ in rows], list(range(len(rows)))
            for n in range(max_new_tokens):
                if not going:
                    break
                z = np.asarray(step([rows[k] + new[k] for k in going]), dtype=float)
                chosen = drawn(z, np.array([uniform(seed, keys[k], n) for k in going]), temperature, top_p) if do_sample else z.argmax(1)
                for k, t in zip(going, chosen.tolist(), strict=True):
                    new[k].append(t)
                going = [k for k in going if new[k][-1] not in ends]
            for ids in new:
                while ids and ids[-1] in specials:
                    ids.pop()
            yield pd.DataFrame({id_col: b[id_col], "token_ids": new})

    kind = dict(inputs.dtypes)[id_col]
    return inputs.select(id_col, "input_ids").mapInPandas(run, f"{id_col} {kind}, token_ids array<int>")


def shown(ids: str, model: Bundle) -> Column:
    """The stripped text of a column of ids; special ones are left out.  The vocabulary, which is
    counted, goes along as a map."""
    n = model.vocabulary.count()
    if n > TABLE_ROWS:
        raise ValueError(f"a vocabulary of {n} rows is too large to be a map")
    rows = model.vocabulary.select("token_id", F.coalesce("raw_token", F.lit("")).alias("raw_token")).toPandas()
    pieces = dict(zip(rows["token_id"].tolist(), rows["raw_token"].tolist(), strict=True))
    for t in model.specials:
        pieces.pop(t, None)
    sent = model.vocabulary.sparkSession.sparkContext.broadcast(pieces)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: "".join(sent.value.get(int(t), "") for t in x) if x is not None else "")

    return T.strip(text(F.col(ids)))


def from_prompts(inputs: DataFrame, model: Bundle, id_col: str, max_new_tokens: int, **sampling) -> DataFrame:
    """id, token_ids, text of the response to each prompt (see ``prompt_inputs``)."""
    found = generated(inputs, model, id_col, max_new_tokens, **sampling)
    return found.select(id_col, "token_ids", shown("token_ids", model).alias("text"))


def from_prefilled(inputs: DataFrame, prefix: Column, model: Bundle, id_col: str, max_new_tokens: int, **sampling) -> DataFrame:
    """id, continuation_ids, continuation_text, full_ids, full_text: what follows the prompt and the
    tokens of ``prefix``, which are fixed; an empty prefix is an error."""
    rows = cut(inputs.withColumn("given", prefix.cast("array<int>")))
    longer = append_ids(rows, F.col("given"))
    found = generated(longer, model, id_col, max_new_tokens, **sampling).withColumnRenamed("token_ids", "continuation_ids")
    both = rows.select(id_col, "given").join(found, id_col).withColumn("full_ids", F.concat("given", "continuation_ids"))
    return both.select(id_col, "continuation_ids", shown("continuation_ids", model).alias("continuation_text"), "full_ids", shown("full_ids", model).alias("full_text"))
