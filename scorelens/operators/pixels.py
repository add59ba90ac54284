"""Pixels as rows: thresholds, text detection and degradation.

Grey tables have (image, y, x, gray), colour tables (image, y, x, r, g, b); degraded values are
computed in double and truncated, each channel on its own.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import regions as R

#: Pixels per side of the tiles by which regions and pixels are joined.
TILE = 16
#: The parts of red, green and blue in grey (thousandths).
LUMA = (299, 587, 114)


def channels_of(pixels: DataFrame) -> list[str]:
    return ["r", "g", "b"] if "gray" not in pixels.columns else ["gray"]


def with_gray(pixels: DataFrame) -> DataFrame:
    """Grey values for detection, of colour tables."""
    return pixels if "gray" in pixels.columns else pixels.withColumn("gray", gray_of(F.col("r"), F.col("g"), F.col("b")))


def gray_of(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * LUMA[0] + g * LUMA[1] + b * LUMA[2]) / 1000).cast("int")


def dark_thresholds(pixels: DataFrame, explicit: int | None = None) -> DataFrame:
    """image, threshold: as given, or the 20th percentile plus 25 within 80..220."""
    if explicit is not None:
        return pixels.select("image").distinct().withColumn("threshold", F.lit(explicit))
    p20 = pixels.groupBy("image").agg(F.percentile("gray", F.lit(0.2)).alias("p"))
    return p20.select("image", F.least(F.lit(220), F.greatest(F.lit(80), F.floor(F.col("p") + 25).cast("int"))).alias("threshold"))


def dark_pixels(pixels: DataFrame, explicit: int | None = None) -> DataFrame:
    """The pixels that are dark."""
    if explicit is not None:
        return pixels.where(F.col("gray") <= explicit)
    return pixels.join(dark_thresholds(pixels), "image").where("gray <= threshold").drop("threshold")


def text_lines(dark: DataFrame, images: DataFrame, min_height: int, max_gap: int = 2) -> DataFrame:
    """image, y1, y2: runs of rows with enough dark pixels; ``images`` has image, width."""
    counts = dark.groupBy("image", "y").agg(F.count(F.lit(1)).alias("n")).join(images.select("image", "width"), "image")
    rows = counts.where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("width") * 0.0015)))
    lines = R.runs(rows, ["image"], "y", max_gap)
    return lines.where(F.col("last") - F.col("first") >= min_height).select("image", F.col("first").alias("y1"), F.col("last").alias("y2"))


def detect_words(pixels: DataFrame, images: DataFrame, threshold: int | None, word_gap: int, min_width: int, min_height: int) -> DataFrame:
    """image, x1 y1 x2 y2 of what looks like words: lines first, then runs of dark columns in
    each.  A row lies in at most one line, so lines are spread over their rows and joined by
    equality."""
    dark = dark_pixels(pixels, threshold)
    lines = text_lines(dark, images, min_height)
    rows = lines.withColumn("y", F.explode(F.sequence("y1", F.col("y2") - 1)))
    columns = dark.join(rows, ["image", "y"]).select("image", "y1", "y2", "x").distinct()
    words = R.runs(columns, ["image", "y1", "y2"], "x", word_gap)
    return words.where(F.col("last") - F.col("first") >= min_width).select("image", F.col("first").alias("x1"), "y1", F.col("last").alias("x2"), "y2")


def _tiles(low: str, high: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / TILE), F.floor((F.col(high) - 1) / TILE)))


def regions_by_tile(regions: DataFrame) -> DataFrame:
    """image, ty, tx, boxes: the regions that touch each tile."""
    spread = regions.withColumn("ty", _tiles("y1", "y2")).withColumn("tx", _tiles("x1", "x2"))
    return spread.groupBy("image", "ty", "tx").agg(F.collect_list(F.struct(*R.BOX)).alias("boxes"))


def degrade(pixels: DataFrame, regions: DataFrame, config: R.MaskConfig) -> DataFrame:
    """image, y, x and ``value`` (of grey tables) or r, g, b: what the regions' effects leave.
    Each region that holds a pixel works on what the one before left, with the mean and the blur
    of the untouched image.

    Effects replace and fade move a pixel to the fill by ``opacity``; blur and blur_fade use a
    Gaussian; noise is drawn from a hash of the seed, the place, the channel and how many regions
    came before.  Pixels meet the regions of their tile by equality, in one exchange; the means,
    one row an image, follow where the fill needs them.
    """
    config.validate()
    channels = channels_of(pixels)
    names = {c: "value" if c == "gray" else c for c in channels}
    plain = pixels.select("image", "y", "x", *(F.col(c).cast("int").alias(c) for c in channels))
    if config.opacity <= 0:
        return plain.withColumnsRenamed(names)
    rows = plain.withColumns({"ty": F.floor(F.col("y") / TILE), "tx": F.floor(F.col("x") / TILE)}).join(regions_by_tile(regions), ["image", "ty", "tx"], "left")
    inside = F.filter("boxes", lambda b: (F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]) & (F.col("y") >= b["y1"]) & (F.col("y") < b["y2"]))
    rows = rows.withColumn("times", F.coalesce(F.size(inside), F.lit(0)))
    soft = config.effect in ("blur", "blur_fade") and config.blur_radius > 0
    if soft:
        rows = rows.join(blurred(plain, config.blur_radius), ["image", "y", "x"])
    if config.fill == "mean" and config.effect in ("replace", "fade", "blur_fade"):
        rows = rows.join(pixels.groupBy("image").agg(*(F.avg(c).alias(f"mean_{c}") for c in channels)), "image")

    def uniform(kind: str, c: str, nth: Column) -> Column:
        place = F.concat_ws(":", F.lit(f"{config.seed}-{kind}-{c}"), "image", "y", "x", nth.cast("string"))
        return F.conv(F.substring(F.md5(place.cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)

    def effect(c: str, current: Column, nth: Column) -> Column:
        fill = {"mean": F.col(f"mean_{c}"), "black": F.lit(0.0), "white": F.lit(255.0), "noise": F.floor(uniform("fill", c, nth) * 256)}[config.fill] if config.effect not in ("blur", "noise") else None
        blur = F.col(f"blurred_{c}") if soft else current
        if config.effect == "blur":
            return blur
        if config.effect == "blur_fade":
            return blur * 0.65 + fill * 0.35
        if config.effect == "noise":
            normal = F.sqrt(-2 * F.log(1 - uniform("a", c, nth))) * F.cos(2 * float(np.pi) * uniform("b", c, nth)) * config.noise_std
            return F.least(F.lit(255.0), F.greatest(F.lit(0.0), current + normal))
        return fill

    def after(c: str) -> Column:
        a, start = config.opacity, F.col(c).cast("double")
        folded = F.aggregate(F.sequence(F.lit(1), F.col("times")), start, lambda v, k: v * (1 - a) + effect(c, v, k) * a)
        changed = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), folded))).cast("int")
        return F.when(F.col("times") > 0, changed).otherwise(F.col(c)).alias(names[c])

    return rows.select("image", "y", "x", *map(after, channels))


def blurred(pixels: DataFrame, radius: float) -> DataFrame:
    """image, y, x, blurred_* of each channel: a Gaussian of deviation ``radius`` with edges
    repeated, rounded to whole values; an image is filtered in one task, as it is one array."""
    channels = channels_of(pixels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[["image", "y", "x"]].copy()
        for c in channels:
            a = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1))
            a[pdf["y"], pdf["x"]] = pdf[c]
            k = kernel(radius)
            reach = len(k) // 2
            for axis in (0, 1):
                padded = np.pad(a, [(reach, reach) if d == axis else (0, 0) for d in (0, 1)], mode="edge")
                a = sum(w * np.take(padded, range(n, n + a.shape[axis]), axis) for n, w in enumerate(k))
            # Sums that differ in their last digits must not differ after rounding.
            out[f"blurred_{c}"] = np.floor(np.round(a[pdf["y"], pdf["x"]], 6) + 0.5)
        return out

    kind = dict(pixels.dtypes)
    made = ", ".join(f"blurred_{c} double" for c in channels)
    return pixels.select("image", "y", "x", *channels).groupBy("image").applyInPandas(run, f"image {kind['image']}, y {kind['y']}, x {kind['x']}, {made}")


def kernel(radius: float) -> np.ndarray:
    reach = max(1, int(np.ceil(3 * radius)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    return k / k.sum()


def apply_mask(pixels: DataFrame, images: DataFrame, config: R.MaskConfig, boxes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(degraded pixels, selected regions, metadata): candidates by strategy, a seeded share of
    them, their effect, on grey or colour tables.  ``images`` has image, width, height; ``boxes``
    given word boxes."""
    config.validate()
    if config.strategy == "patch":
        candidates = R.patch_grid(images, "image", config.patch_size)
    else:
        found = boxes if boxes is not None else detect_words(with_gray(pixels), images, config.text_threshold, config.word_gap, config.word_min_width, config.word_min_height)
        candidates = R.word_regions(found.join(images, "image"), config.word_padding, config.word_min_width, config.word_min_height).select("image", *R.BOX)
    selected = R.sampled(candidates, "image", config.ratio, config.seed)
    return degrade(pixels, selected, config), selected, R.mask_metadata(images, candidates, selected, config)


def apply_patch_mask(pixels: DataFrame, images: DataFrame, config: R.MaskConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``apply_mask`` with tiles, whatever strategy the settings name."""
    return apply_mask(pixels, images, replace(config, strategy="patch"))
