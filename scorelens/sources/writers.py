"""Sinks: tables as CSV, JSON and text; names of single artifacts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import write_bytes

CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "lineSep": "\r\n"}


def csv(table: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns; arrays as JSON, flags as True and False."""
    kinds = dict(table.dtypes)

    def shown(c: str):
        if kinds[c].startswith("array"):
            return F.to_json(c)
        if kinds[c] == "boolean":
            return F.when(F.col(c), "True").when(~F.col(c), "False")
        return F.col(c)

    table.select(*(shown(c).alias(c) for c in columns)).write.mode("overwrite").options(**CSV).csv(path)


def text(table: DataFrame, path: str, column: str = "text") -> None:
    """Each row's text in a file part, with no line end added."""
    table.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def json_lines(table: DataFrame, path: str) -> None:
    table.write.mode("append").json(path)


def documents(table: DataFrame, path: str, column: str) -> None:
    """Each response's text in a folder of its own, response_id=N."""
    table.select("response_id", F.col(column).cast("string").alias("value")).write.mode("overwrite").partitionBy("response_id").text(path)


def json_file(spark: SparkSession, path: str, record: dict) -> None:
    """One small record, to any store that Spark knows; overwritten."""
    write_bytes(spark, path, (json.dumps(record, indent=2, ensure_ascii=False) + "\n").encode())


def compact_json(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False)


def config_json(spark: SparkSession, path: str, config: dict) -> None:
    """Settings of a run; overwritten at every start.  Sampling settings are null unless sampling."""
    if not config.get("do_sample"):
        config = config | {"temperature": None, "top_p": None}
    json_file(spark, path, config)


def merged(columns: dict[str, Column], more: dict[str, Column]) -> Column:
    """A record of both; of equal names the later value counts, in the earlier place."""
    return F.struct(*(v.alias(k) for k, v in (columns | more).items()))


def unique_name(index: int) -> str:
    return f"unique_{index:06d}"


def unique_response(spark: SparkSession, folder: str, index: int, text_: str, metadata: dict) -> None:
    """A unique response as text, and with its metadata as JSON."""
    write_bytes(spark, f"{folder}/{unique_name(index)}.txt", text_.encode())
    json_file(spark, f"{folder}/{unique_name(index)}.json", metadata | {"text": text_})


def rgb_image(rows: DataFrame, path: str) -> None:
    """One image of (y, x, r, g, b) as a PNG.  The pixels of one image reach the driver."""
    import struct
    import zlib

    got = rows.select("y", "x", "r", "g", "b").orderBy("y", "x").collect()
    w, h = max(r.x for r in got) + 1, max(r.y for r in got) + 1
    lines = b"".join(b"\0" + bytes(v for r in got[k * w : (k + 1) * w] for v in (r.r, r.g, r.b)) for k in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    write_bytes(rows.sparkSession, path, b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
