"""Quality by compression.

Pairs of zstandard dictionaries are trained, one on labelled good and one on labelled bad text;
each pair has texts of its own.  A text is compressed with every dictionary, in blocks so that
a dictionary matters throughout however long the text is.  The difference of the compressed
sizes of a pair over the size of the text, summed over the pairs, is the measure; a logistic
curve fitted on other training rows turns it into a probability.

Only ``sample`` labelled documents, chosen by the hash of their ids, are used to fit: of these
a quarter calibrates and of the rest at most PAIRS * SAMPLE_TEXTS of each class fill the
dictionaries, each with at most SAMPLE_BYTES in blocks from all over its text, chosen by the
hash of id and block.  Held-out rows are never used.

Defined cases: a null or empty text has measure 0 and the score that belongs to it; unusable
labels are left out; without labels of both classes every score is the share of good labels
(0.5 without any); a text of any length is compressed as a whole, block by block; equal texts get
equal scores; repeated rows give repeated rows; an empty table gives an empty result; further
columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out
from .toxicity import linear, training_rows

SAMPLE = 8_000
DICTIONARY = 112_640
BLOCK = 1_024
LEVEL = 3
#: Pairs of dictionaries, texts of each class in a pair, and the most bytes of a text there.
PAIRS = 6
SAMPLE_TEXTS = 260
SAMPLE_BYTES = 2_048


@dataclass
class Model:
    """Pairs of (good, bad) dictionaries; centre and scale of the measure; bias and slope."""

    pairs: list[tuple[bytes, bytes]]
    centre: float = 0.0
    scale: float = 1.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def measure(self, texts: list[str | None]) -> np.ndarray:
        import zstandard as z

        if not hasattr(self, "_tools"):
            options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self._tools = [tuple(z.ZstdCompressor(dict_data=_precomputed(d), **options) for d in pair) for pair in self.pairs]
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            data, less = (text or "").encode(), 0
            for start in range(0, len(data), BLOCK):
                part = data[start : start + BLOCK]
                for good, bad in self._tools:
                    less += len(bad.compress(part)) - len(good.compress(part))
            out[k] = less / max(1, len(data))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * (self.measure(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tools"}


def _precomputed(data: bytes):
    import zstandard as z

    d = z.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return d


def blocks(doc_id: int | None, text: str | None) -> list[bytes]:
    """Blocks from all over a text, in order: those of the lowest hashes of id and number."""
    data = (text or "").encode()
    order = sorted(range(-(-len(data) // BLOCK)), key=lambda k: (crc32(f"{doc_id}:{k}".encode()), k))
    return [data[k * BLOCK : (k + 1) * BLOCK] for k in sorted(order[: SAMPLE_BYTES // BLOCK])]


def dictionary(texts: list[list[bytes]]) -> bytes:
    """A dictionary from texts' blocks; raw content where there is too little to train one, and
    one byte where there is nothing at all."""
    import zstandard as z

    parts = [part for t in texts for part in t]
    try:
        return z.train_dictionary(min(DICTIONARY, max(256, sum(map(len, parts)) // 8)), parts, level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(parts)[-DICTIONARY:] or b" "


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    rows = cut(training_rows(docs, labels, label_col, id_col, text_col, sample).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(4))))
    share = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(share) < 2:
        p = min(max((share.get(1, 0) / sum(share.values())) if share else 0.5, 1e-9), 1 - 1e-9)
        return Model([], curve=np.array([np.log(p / (1 - p)), 0.0]))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [blocks(i.as_py(), t.as_py()) for i, t in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.list_(pa.binary()))], names=["doc_id", "parts"])

    def texts(y: int) -> list[list[bytes]]:
        chosen = rows.where((F.col("part") > 0) & (F.col("y") == y)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        chosen = chosen.mapInArrow(cut_up, "doc_id long, parts array<binary>")
        return [list(map(bytes, r.parts)) for r in chosen.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(PAIRS * SAMPLE_TEXTS).collect()]

    good, bad = texts(1), texts(0)
    n = max(1, min(PAIRS, len(good), len(bad)))
    model = Model([(dictionary(good[k::n]), dictionary(bad[k::n])) for k in range(n)])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.measure(b.column(2).to_pylist()))], names=["doc_id", "y", "x"])

    rest = rows.where("part = 0").select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, x double").orderBy("doc_id").collect()
    x, y = np.array([r.x for r in rest]), np.array([float(r.y) for r in rest])
    if len(x):
        model.centre, model.scale = float(x.mean()), float(x.std()) or 1.0
        model.curve = linear(np.stack((np.ones(len(x)), (x - model.centre) / model.scale), 1), y, penalty=0.01)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with a column of scores; only texts go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(texts.tolist()))

    return docs.withColumn(to, scores(F.col(text_col).cast("string")))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, labels, id_col, text_col, **options))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
