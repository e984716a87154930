"""Regions of an image as rows: which may be letters, how they align, what area they cover, and the saliency that follows.

A region is ``frame, x, y, w, h`` in whole pixels. Regions of a frame meet by its key; alignment is two aggregates, and only
the union of overlapping rectangles needs the regions of one frame together, as an array.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.pixels import union_area
from tessera.functions.scores import clip, passes_geometry, textness


def letters(regions: DataFrame, width: int, height: int) -> DataFrame:
    """The regions that may be letters."""
    return regions.where(passes_geometry(F.col("w"), F.col("h"), F.lit(float(width * height))))


def alignment(regions: DataFrame, height: int) -> DataFrame:
    """``frame, n, alignment``: the most regions that share a band of the height, on a scale of eight; 0 for a single one."""
    band = max(height // 40, 4)
    rows = regions.groupBy("frame", F.floor((F.col("y") + F.floor(F.col("h") / 2)) / band).alias("band")).agg(F.count("*").alias("n"))
    found = rows.groupBy("frame").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return found.select("frame", "n", F.when(F.col("n") < 2, 0.0).otherwise(clip((F.col("most") - 1) / 8.0)).alias("alignment"))


@F.pandas_udf(T.LongType())
def _area(boxes: pd.Series) -> pd.Series:
    return boxes.map(lambda own: int(union_area([tuple(b) for b in own])))


def covered(regions: DataFrame) -> DataFrame:
    """``frame, area``: the pixels that the regions of a frame cover, overlaps once."""
    box = F.array(*[F.col(c).cast("long") for c in ("x", "y", "w", "h")])
    return regions.groupBy("frame").agg(F.collect_set(box).alias("boxes")).select("frame", _area("boxes").alias("area"))


def saliency(regions: DataFrame, width: int, height: int) -> DataFrame:
    """``frame, n, area, alignment, textness`` of the frames that have letters."""
    kept = letters(regions, width, height)
    met = alignment(kept, height).join(covered(kept), "frame")
    return met.withColumn("textness", textness(F.col("area") / F.lit(float(width * height)), F.col("n"), F.col("alignment")))


def detected(rects: DataFrame, scale: float, unclip: float = 1.6) -> DataFrame:
    """``frame, n, area``: rectangles ``frame, w, h, p`` of a detector that pass its filters, and their grown area.

    A rectangle passes with a shorter side of 3 and a mean probability of 0.5 at least, if it is grown to 5 and to over 3 pixels
    of the image that is ``scale`` times as large.
    """
    w, h, by = F.col("w"), F.col("h"), F.col("w") * F.col("h") * unclip / (F.col("w") + F.col("h"))
    side = F.least(w, h) + by
    passed = rects.where((F.least(w, h) >= 3) & (F.col("p") >= 0.5) & (side >= 5) & (side * scale > 3))
    return passed.groupBy("frame").agg(F.count("*").alias("n"), F.sum((w + by) * (h + by) * scale * scale).alias("area"))


def histogram(rows: DataFrame, key: str, channels: dict[str, tuple[float, int]]) -> DataFrame:
    """``key, bin, share``: shares of a joint histogram; a channel is given by its upper end and its number of bins.

    Values are in ``[0, end)``; the last channel varies fastest.
    """
    at = F.lit(0)
    for name, (end, bins) in channels.items():
        at = at * bins + F.least(F.lit(bins - 1), F.floor(F.col(name) * bins / end))
    counted = rows.groupBy(key, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counted.groupBy(key).agg(F.sum("n").alias("total"))
    return counted.join(total, key).select(key, "bin", (F.col("n") / F.col("total")).alias("share"))


def pixel_stats(pixels: DataFrame, key: str) -> DataFrame:
    """Exposure and colourfulness of pixels that are rows ``key, gray, r, g, b`` in 0..255; population deviations.

    One pass with partial aggregation, whatever the number of pixels of a key.
    """
    rg, yb = F.col("r") - F.col("g"), 0.5 * (F.col("r") + F.col("g")) - F.col("b")
    share = lambda c: F.avg(c.cast("double"))
    found = pixels.groupBy(key).agg(
        (F.avg("gray") / 255).alias("luma"), share(F.col("gray") <= 8).alias("clip_low"), share(F.col("gray") >= 247).alias("clip_high"), (F.stddev_pop("gray") / 255).alias("rms"),
        F.var_pop(rg).alias("_vrg"), F.var_pop(yb).alias("_vyb"), F.avg(rg).alias("_mrg"), F.avg(yb).alias("_myb"),
    )
    colour = F.sqrt(F.col("_vrg") + F.col("_vyb")) + 0.3 * F.sqrt(F.col("_mrg") * F.col("_mrg") + F.col("_myb") * F.col("_myb"))
    return found.select(key, "luma", "clip_low", "clip_high", "rms", colour.alias("colorfulness"))
