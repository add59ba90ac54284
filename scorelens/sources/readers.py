"""Sources: images, texts, word boxes, prefix tables and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regions import box_to_region, boxes_of_json
from .shared import exists

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def images(spark: SparkSession, path: str) -> DataFrame:
    """image (its origin), width, height, channels, data, from files Spark can decode; a missing
    path is an error."""
    i = F.col("image")
    return spark.read.format("image").option("dropInvalid", False).load(path).select(i["origin"].alias("image"), i["width"].alias("width"), i["height"].alias("height"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def pixels(decoded: DataFrame) -> DataFrame:
    """image, y, x, r, g, b.  Bytes lie row by row, blue first; one channel is grey."""
    at = F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1))
    rows = decoded.where("width > 0 and height > 0").withColumn("at", at)

    def byte(k: int):
        place = F.col("at") * F.col("channels") + F.when(F.col("channels") > 1, k).otherwise(0) + 1
        return F.conv(F.hex(F.substring("data", place, F.lit(1))), 16, 10).cast("int")

    return rows.select("image", F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), (F.col("at") % F.col("width")).alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def word_boxes(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """x1 y1 x2 y2 of every box in JSON files, for images of the given size."""
    found = boxes_of_json(whole_text(spark, path)).withColumns({"width": F.lit(width), "height": F.lit(height)})
    return box_to_region(found).select("nth", "x1", "y1", "x2", "y2")


def prefix_rows(spark: SparkSession, path: str) -> DataFrame:
    """index, token_id of a token table; only these columns are parsed."""
    return spark.read.options(**CSV).csv(path).select(F.col("index").cast("int").alias("index"), F.col("token_id").cast("int").alias("token_id"))


def token_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A token or unit table as written by ``writers.csv``; empty strings come back as such."""
    got = spark.read.schema(schema).options(**CSV).csv(path)
    return got.withColumns({c: F.coalesce(c, F.lit("")) for c, kind in got.dtypes if kind == "string"})


def hashes_of_lines(lines: DataFrame, mode: str | None = None) -> DataFrame:
    """hash, unique_index, compare_mode from JSON lines in ``value``.  Blank and malformed
    lines, lines that are no object and hashes that are no strings are left out."""
    record = F.try_parse_json("value")
    typed = lines.select(record.alias("v")).where("v is not null")
    kind = F.schema_of_variant(F.try_variant_get("v", "$.hash", "variant"))
    typed = typed.where(F.schema_of_variant("v").startswith("OBJECT") & (kind == "STRING"))
    out = typed.select(*(F.try_variant_get("v", f"$.{c}", t).alias(c) for c, t in (("hash", "string"), ("unique_index", "bigint"), ("compare_mode", "string"))))
    return out if mode is None else out.where(F.col("compare_mode").isNull() | (F.col("compare_mode") == mode))


def manifest(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """The manifest below ``path``; one that does not exist is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "hash string, unique_index bigint, compare_mode string")
    return hashes_of_lines(spark.read.text(path), mode)
