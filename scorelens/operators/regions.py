"""Image regions: boxes, grids, merging and sampling.  Boxes are half-open, in columns x1 y1 x2 y2."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ["x1", "y1", "x2", "y2"]
STRATEGIES, EFFECTS, FILLS = ("patch", "word"), ("replace", "fade", "blur", "noise", "blur_fade"), ("mean", "black", "white", "noise")


@dataclass(frozen=True)
class MaskConfig:
    """Settings of a degradation; ``validate`` says what they may be."""

    strategy: str = "patch"
    ratio: float = 0.35
    patch_size: int = 32
    fill: str = "mean"
    effect: str = "replace"
    opacity: float = 1.0
    blur_radius: float = 1.2
    noise_std: float = 10.0
    word_boxes: str | None = None
    word_padding: int = 2
    word_gap: int = 12
    word_min_width: int = 4
    word_min_height: int = 4
    text_threshold: int | None = None
    seed: int = 7

    def validate(self) -> MaskConfig:
        wrong = [
            what
            for bad, what in (
                (self.strategy not in STRATEGIES, f"strategy must be one of {STRATEGIES}"),
                (self.effect not in EFFECTS, f"effect must be one of {EFFECTS}"),
                (self.fill not in FILLS, f"fill must be one of {FILLS}"),
                (not 0 <= self.ratio <= 1, "ratio must lie in 0..1"),
                (not 0 <= self.opacity <= 1, "opacity must lie in 0..1"),
                (self.patch_size <= 0, "patch_size must be positive"),
                (min(self.blur_radius, self.noise_std, self.word_padding, self.word_gap) < 0, "radius, deviation, padding and gap must not be negative"),
                (min(self.word_min_width, self.word_min_height) <= 0, "minimum sizes must be positive"),
                (self.text_threshold is not None and not 0 <= self.text_threshold <= 255, "text_threshold must lie in 0..255"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def to_dict(self) -> dict:
        """The settings by the names that artifacts give them."""
        return {"word_boxes_path" if k == "word_boxes" else k: v for k, v in asdict(self).items()}


def patch_grid(images: DataFrame, id_col: str, size: int) -> DataFrame:
    """id, x1 y1 x2 y2: tiles row by row, those at the edges clipped.  ``images`` has width and
    height."""

    def starts(extent: str) -> Column:
        return F.sequence(F.lit(0), (F.ceil(F.col(extent) / size) - 1).cast("int"))

    cells = images.where("width > 0 and height > 0").withColumn("gy", F.explode(starts("height"))).withColumn("gx", F.explode(starts("width")))
    x, y = F.col("gx") * size, F.col("gy") * size
    return cells.select(id_col, x.alias("x1"), y.alias("y1"), F.least(x + size, "width").alias("x2"), F.least(y + size, "height").alias("y2"))


def box_to_region(boxes: DataFrame) -> DataFrame:
    """Boxes in ``box`` (four doubles) of images of width and height as whole, clipped regions:
    scaled if none exceeds 1.5, corners put in order, halves rounded to even."""
    b = lambda k: F.get("box", F.lit(k))
    scaled = F.array_max("box") <= 1.5
    across = [F.when(scaled, b(k) * F.col("width" if k % 2 == 0 else "height")).otherwise(b(k)) for k in range(4)]
    ends = {"x1": F.least(across[0], across[2]), "y1": F.least(across[1], across[3]), "x2": F.greatest(across[0], across[2]), "y2": F.greatest(across[1], across[3])}
    return clipped(boxes.withColumns({k: F.rint(v).cast("int") for k, v in ends.items()}), 0)


def clipped(regions: DataFrame, padding: int) -> DataFrame:
    """Regions grown by ``padding`` and cut to their image; empty ones go."""
    grown = regions.withColumns(
        {
            "x1": F.greatest(F.lit(0), F.col("x1") - padding),
            "y1": F.greatest(F.lit(0), F.col("y1") - padding),
            "x2": F.least("width", F.col("x2") + padding),
            "y2": F.least("height", F.col("y2") + padding),
        }
    )
    return grown.where("x2 > x1 and y2 > y1")


def word_regions(boxes: DataFrame, padding: int, min_width: int, min_height: int) -> DataFrame:
    """Clipped and padded boxes that are large enough."""
    return clipped(boxes, padding).where((F.col("x2") - F.col("x1") >= min_width) & (F.col("y2") - F.col("y1") >= min_height))


def sampled(regions: DataFrame, id_col: str, ratio: float, seed: int) -> DataFrame:
    """A seeded share of each image's regions, at least one if any (none for ratio 0), with their
    order in ``rank``.  Counts round halves to even; the order is that of md5 over seed and
    position, so it is the same for every run."""
    by_place = Window.partitionBy(id_col).orderBy("y1", "x1", "y2", "x2")
    placed = regions.withColumns({"at_": F.row_number().over(by_place) - 1, "n_": F.count(F.lit(1)).over(Window.partitionBy(id_col))})
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("at_").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    drawn = placed.withColumn("draw_", F.row_number().over(Window.partitionBy(id_col).orderBy(number, "at_")))
    most = F.lit(0) if ratio <= 0 else F.least("n_", F.greatest(F.lit(1), F.rint(F.col("n_") * ratio).cast("int")))
    kept = drawn.where(F.col("draw_") <= most)
    return kept.withColumn("rank", F.row_number().over(by_place)).drop("at_", "n_", "draw_")


def runs(positions: DataFrame, keys: list[str], position: str, max_gap: int) -> DataFrame:
    """keys, first, last (exclusive): positions joined over gaps of at most ``max_gap``."""
    w = Window.partitionBy(*keys).orderBy(position)
    opens = F.coalesce(F.col(position) - F.lag(position).over(w) > max_gap + 1, F.lit(True))
    numbered = positions.withColumn("opens_", opens).withColumn("run_", F.sum(F.col("opens_").cast("int")).over(w))
    return numbered.groupBy(*keys, "run_").agg(F.min(position).alias("first"), (F.max(position) + 1).alias("last")).drop("run_")


def metadata(candidates: DataFrame, selected: DataFrame, id_col: str) -> DataFrame:
    """id, num_candidates, num_selected."""
    a = candidates.groupBy(id_col).agg(F.count(F.lit(1)).alias("num_candidates"))
    b = selected.groupBy(id_col).agg(F.count(F.lit(1)).alias("num_selected"))
    return a.join(b, id_col, "left").select(id_col, "num_candidates", F.coalesce("num_selected", F.lit(0)).cast("long").alias("num_selected"))


def mask_metadata(images: DataFrame, candidates: DataFrame, selected: DataFrame, config: MaskConfig) -> DataFrame:
    """One row per image: its size, what was done, counts, the selected regions in order with
    their source, the grid of tiles or the source of word boxes, and the settings as JSON."""
    patch = config.strategy == "patch"
    source = "patch" if patch else "word_boxes" if config.word_boxes else "auto"
    whole = F.array_sort(F.collect_list(F.struct("y1", "x1", "y2", "x2")))
    regions = F.transform(whole, lambda r: F.struct(*(r[c].alias(c) for c in BOX), F.lit(source).alias("source")))
    chosen = selected.groupBy("image").agg(regions.alias("selected_regions"))
    counted = metadata(candidates, selected, "image")
    none = F.array().cast(f"array<struct<{', '.join(f'{c}:int' for c in BOX)}, source:string>>")
    cells = [F.ceil(F.col(c) / config.patch_size).cast("int") if patch else F.lit(None).cast("int") for c in ("width", "height")]
    return images.join(counted, "image", "left").join(chosen, "image", "left").select(
        "image",
        F.col("width").alias("image_width"),
        F.col("height").alias("image_height"),
        F.lit(config.strategy).alias("strategy"),
        F.lit(config.effect).alias("effect"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("num_candidates", "num_selected")),
        cells[0].alias("grid_width"),
        cells[1].alias("grid_height"),
        F.lit(None if patch else config.word_boxes or "auto_text_threshold").cast("string").alias("word_box_source"),
        F.coalesce("selected_regions", none).alias("selected_regions"),
        F.lit(json.dumps(config.to_dict())).alias("config"),
    )


def is_box(value) -> bool:
    return isinstance(value, list) and len(value) == 4 and all(isinstance(v, (int, float)) for v in value)


#: Keys that are never looked into, whether they gave a box or not.
BOX_KEYS = frozenset(("bbox", "box", "x", "y", "w", "h"))


def iter_boxes(data):
    """Boxes at any depth: under 'bbox' or 'box', from x, y, w, h (numbers or their texts), or a
    bare list of four numbers.  Four such keys that are no numbers are an error."""
    todo = [data]
    while todo:
        value = todo.pop()
        if is_box(value):
            yield [float(v) for v in value]
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            for k in ("bbox", "box"):
                if is_box(value.get(k)):
                    yield [float(v) for v in value[k]]
            if all(k in value for k in "xywh"):
                x, y, w, h = (float(value[k]) for k in "xywh")
                yield [x, y, x + w, y + h]
            todo += reversed([v for k, v in value.items() if k not in BOX_KEYS])


def _boxes(text: str | None) -> list[list[float]]:
    try:
        return list(iter_boxes(json.loads(text)))
    except (TypeError, ValueError):
        return []


def boxes_of_json(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with a row for each box of its JSON: columns nth and box.  Text that is not
    JSON, or holds a malformed box, gives none.  Texts go to Python in Arrow batches."""

    @F.pandas_udf("array<array<double>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_boxes)

    return documents.select("*", F.posexplode(found(F.col(text_col))).alias("nth", "box"))
