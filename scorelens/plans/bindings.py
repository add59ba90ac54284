"""What stands for responses, logits, pieces and pixels in the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import scores

PER_RESPONSE = 20
ALPHA = 0.55
VOCABULARY = 64
SPECIALS = [0, 2]
ROWS_PER_IMAGE = 50


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty vectors are the tokens of a response; the label is the token."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.floor(F.col("vec_id") / PER_RESPONSE).alias("response_id"),
        (F.col("vec_id") % PER_RESPONSE).cast("int").alias("token_index"),
        F.col("label").alias("token_id"),
        V.doubles(F.col("embedding")).alias("z"),
    )


def masked_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector that follows (the first after the last), moved towards its mean."""
    e = read(spark, sf_dir, "embeddings")
    n = e.count()
    at = (F.col("vec_id") + (n - 1)) % max(1, n)
    return e.select(
        F.floor(at / PER_RESPONSE).alias("response_id"),
        (at % PER_RESPONSE).cast("int").alias("token_index"),
        F.col("label").alias("token_id"),
        V.blend(V.doubles(F.col("embedding")), ALPHA).alias("z"),
    )


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.paired(scores.token_statistics(logits(spark, sf_dir)), scores.token_statistics(masked_logits(spark, sf_dir)))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read(spark, sf_dir, "documents").select(F.explode(T.pieces(F.coalesce("text", F.lit("")))).alias("piece"))
    return scores.vocabulary(pieces, VOCABULARY)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.decoded(paired(spark, sf_dir), vocabulary(spark, sf_dir), {"token_id": ""})


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, text: documents with none, one or two spaces before them."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 3).cast("int")), "text").alias("text"))


def image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", (64 + 3 * F.col("p_size")).alias("width"), (48 + F.col("p_partkey") % 50).cast("int").alias("height"))


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each part: of every third one as shares of the image."""
    sizes = image_sizes(spark, sf_dir).join(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    k, s = F.col("p_partkey"), F.col("p_size")
    box = [s * 3.0, (k % 40).cast("double"), s * 3.0 + (k % 60) - 5.0, k % 40 + s % 13 + 0.5]
    shares = [b / 256.0 for b in box]
    return sizes.withColumn("box", F.array(*(F.when(k % 3 == 0, b).otherwise(a) for a, b in zip(box, shares, strict=True))))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty vectors are the rows of a grey image of 64 columns."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / ROWS_PER_IMAGE).alias("image"), (F.col("vec_id") % ROWS_PER_IMAGE).cast("int").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("image", "y", "x", F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 255 * F.col("v").cast("double")))).cast("int").alias("gray"))


def pixel_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    rows = e.groupBy(F.floor(F.col("vec_id") / ROWS_PER_IMAGE).alias("image")).agg(F.max(F.size("embedding")).alias("width"), (F.max(F.col("vec_id") % ROWS_PER_IMAGE) + 1).cast("int").alias("height"))
    return rows


def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping regions in every image."""
    two = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), b, strict=True))) for b in ((8, 8, 40, 30), (20, 15, 60, 45))))
    return pixel_images(spark, sf_dir).select("image", F.inline(two))
