"""Decoding of OCR model tensors inside Arrow-fed tasks: small numpy steps, one row per image or patch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import utrim

MAX_SIDE = 1536


def resized(width: Column, height: Column, limit: int = MAX_SIDE) -> Column:
    """Width and height with the longer side cut to a limit, rounded, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(limit)) / F.greatest(width, height))
    side = lambda x: F.greatest(F.lit(1), F.round(x * scale).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def components(heat: np.ndarray, least: float, pixels: int, scale: float) -> list[tuple]:
    """x1, y1, x2, y2, mean score and size of each 4-connected region of a heat map, in reading order."""
    inside = heat >= least
    label = np.where(inside, np.arange(1, heat.size + 1).reshape(heat.shape), 0)
    while True:
        wide = np.pad(label, 1)
        best = np.where(inside, np.max([label, wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]], axis=0), 0)
        if (best == label).all():
            break
        label = best
    out = []
    for k in np.unique(label[label > 0]):
        y, x = np.nonzero(label == k)
        if len(x) >= pixels:
            out.append((x.min() * scale, y.min() * scale, (x.max() + 1) * scale, (y.max() + 1) * scale, float(heat[y, x].mean(dtype="f8")), len(x)))
    return sorted(out, key=lambda r: (r[1], r[0]))


REGIONS = "id long, position int, x1 float, y1 float, x2 float, y2 float, confidence float, pixels int"


def detect(maps: DataFrame, least: float = 0.3, pixels: int = 4, scale: float = 1.0) -> DataFrame:
    """Regions of heat maps (id, height, width, values)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in REGIONS.split(", ")]
        for rows in batches:
            found = []
            for r in rows.itertuples():
                heat = np.asarray(r.values, "f4").reshape(r.height, r.width)
                found += [(r.id, i, *region) for i, region in enumerate(components(heat, least, pixels, scale))]
            yield pd.DataFrame(found, columns=names)

    return maps.select("id", "height", "width", F.col("values")).mapInPandas(run, REGIONS)


def argmax_last(scores: Column) -> Column:
    """Index of the largest score, the last of equals."""
    return F.size(scores) - F.array_position(F.reverse(scores), F.array_max(scores)).cast("int")


def orientation(scores: Column) -> Column:
    """Degrees of a patch from 2 or 4 class scores; null for other sizes."""
    return F.when(F.size(scores) == 2, argmax_last(scores) * 180).when(F.size(scores) == 4, argmax_last(scores) * 90)


def blank_index(classes: int, tokens: int) -> int:
    """Place of the blank among the classes: first if it is extra, last if the tokens fill all classes."""
    if classes == tokens + 1:
        return 0
    if classes == tokens:
        return classes - 1
    raise ValueError(f"{classes} classes do not fit {tokens} tokens")


def plane(values: Column, shape: Column, dims: int) -> Column:
    """The first plane of a tensor: its last ``dims`` sizes and values; null where values and shape don't fit."""
    size = F.aggregate(F.slice(shape, -dims, dims), F.lit(1), lambda a, x: a * x)
    whole = F.size(shape) == dims
    fits = (F.size(shape) >= dims) & (F.size(shape) <= dims + 2) & F.when(whole, F.size(values) == size).otherwise(F.size(values) >= size)
    return F.when(fits, F.struct(F.slice(shape, -dims, dims).alias("shape"), F.slice(values, F.lit(1), size).alias("values")))


def decode_ctc(values: Column, steps: Column, tokens: list[str]) -> Column:
    """Text, mean confidence and number of tokens of recognition scores (steps x classes): the best class of each step,
    repeats and blanks dropped. Null if the classes don't fit the tokens."""
    names = F.array(*(F.lit(t) for t in tokens))
    classes = (F.size(values) / steps).cast("int")
    blank = F.when(classes == len(tokens) + 1, 0).when(classes == len(tokens), classes - 1)

    def best(t: Column) -> Column:
        row = F.slice(values, t * classes + 1, classes)
        return F.struct(argmax_last(row).alias("k"), F.array_max(row).alias("score"))

    def close(path: Column) -> Column:
        kept = F.filter(path, lambda x, i: ((i == 0) | (F.get(path, i - 1)["k"] != x["k"])) & (x["k"] != blank))
        text = F.array_join(F.transform(kept, lambda x: F.get(names, x["k"] - F.when(blank == 0, 1).otherwise(0))), "")
        total = F.aggregate(kept, F.lit(0.0).cast("float"), lambda a, x: (a + x["score"]).cast("float"))
        mean = F.when(F.size(kept) > 0, (total / F.size(kept).cast("float")).cast("float")).otherwise(F.lit(0.0).cast("float"))
        return F.struct(text.alias("text"), mean.alias("confidence"), F.size(kept).alias("tokens"))

    return F.when(blank.isNotNull() & (steps > 0), F.get(F.transform(F.array(F.transform(F.sequence(F.lit(0), steps - 1), best)), close), 0))


def recognized_lines(detections: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of recognised patches (image_id, patch_index, text, confidence) with the box of their detection
    (image_id, patch_index, score, bbox), and (image_id, error) of predictions without one."""
    rows = predictions.join(detections.select("image_id", "patch_index", "score", "bbox", F.lit(True).alias("__seen")), ["image_id", "patch_index"], "left")
    lost = rows.where("__seen is null").select("image_id", F.lit("OCR recognition prediction index is out of bounds").alias("error")).distinct()
    lines = rows.where(F.col("__seen") & (utrim(F.col("text")) != "")).select(
        "image_id", "patch_index", utrim(F.col("text")).alias("text"), F.least("confidence", "score").alias("confidence"), "bbox"
    )
    return lines.join(lost.select("image_id"), "image_id", "left_anti"), lost


def turned(values: Column, width: Column, height: Column, channels: Column, turns: Column) -> Column:
    """A tensor of channels x height x width turned clockwise by quarter turns, with its new width and height."""
    odd = turns % 2 == 1
    new_width, new_height = F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height)
    area = width * height

    def source(i: Column) -> Column:
        r = i % area
        y, x = F.floor(r / new_width).cast("int"), r % new_width
        row = F.when(turns == 1, height - 1 - x).when(turns == 2, height - 1 - y).when(turns == 3, x).otherwise(y)
        column = F.when(turns == 1, y).when(turns == 2, width - 1 - x).when(turns == 3, width - 1 - y).otherwise(x)
        return F.get(values, F.floor(i / area).cast("int") * area + row * width + column)

    moved = F.transform(F.sequence(F.lit(0), area * channels - 1), source)
    return F.struct(moved.alias("values"), new_width.alias("width"), new_height.alias("height"))


def rotate_patches(patches: DataFrame, classes: DataFrame) -> DataFrame:
    """Patches (image_id, patch_index, width, height, channels, values) turned as classified (image_id, patch_index, rotation_degrees, confidence).

    Classes without a finite confidence above 0 and those of no rotation change nothing.
    """
    sure = (F.col("confidence") > 0) & ~F.isnan("confidence") & (F.col("confidence") < float("inf"))
    rotation = F.pmod(F.col("rotation_degrees"), F.lit(360)).cast("int")
    told = classes.where(sure & (rotation != 0)).select("image_id", "patch_index", rotation.alias("rotation"))
    rows = patches.join(told, ["image_id", "patch_index"], "left").withColumn("rotation", F.coalesce("rotation", F.lit(0)))
    new = turned(F.col("values"), F.col("width"), F.col("height"), F.col("channels"), F.floor(F.col("rotation") / 90).cast("int"))
    return rows.withColumn("__t", new).select("image_id", "patch_index", "channels", "rotation", "__t.width", "__t.height", "__t.values")


def patch_bounds(bbox: Column, width: Column, height: Column, scale_x: Column, scale_y: Column, patch_height: int = 48, max_width: int = 320) -> Column:
    """Where a box lies in the resized image, and the width of its recognition patch; null if nothing of it is there."""
    clamp = lambda x, low, high: F.greatest(low, F.least(x, high)).cast("int")
    x1, y1 = clamp(F.floor(bbox["x1"] / scale_x), F.lit(0), width - 1), clamp(F.floor(bbox["y1"] / scale_y), F.lit(0), height - 1)
    x2, y2 = clamp(F.ceil(bbox["x2"] / scale_x), F.lit(1), width), clamp(F.ceil(bbox["y2"] / scale_y), F.lit(1), height)
    wide = F.least(F.greatest(F.round((x2 - x1).cast("float") / (y2 - y1).cast("float") * patch_height), F.lit(1)), F.lit(max_width)).cast("int")
    return F.when((x2 > x1) & (y2 > y1), F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), wide.alias("patch_width")))


def charset(text: str) -> list[str]:
    """The tokens of a character set file: its lines, without a byte order mark and empty lines."""
    tokens = [line for line in text.removeprefix("\ufeff").splitlines() if line]
    if not tokens:
        raise ValueError("the character set is empty")
    return tokens
