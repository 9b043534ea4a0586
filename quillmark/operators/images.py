"""Geometry of crops, and trimming of white margins from pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crop_boxes(slices: DataFrame, clearance: int = 10) -> DataFrame:
    """Adds crop_bottom, crop_right and ``problem``: what the slice's box is cut to, or why it can't be.

    slices: top, bottom, left, right (null: the width), clear (whether marks need room below),
    width, height.  The room below is cut at the image's height.
    """
    bottom = F.when(F.col("clear"), F.least(F.col("bottom") + clearance, F.col("height"))).otherwise(F.col("bottom"))
    right = F.coalesce(F.nullif("right", F.lit(0)), F.col("width"))
    rows = slices.withColumn("crop_bottom", bottom).withColumn("crop_right", right)
    problem = F.when(F.col("top") < 0, "top").when(F.col("crop_bottom") > F.col("height"), "bottom").when(F.col("left") < 0, "left").when(F.col("crop_right") > F.col("width"), "right")
    return rows.withColumn("problem", problem)


def trimmed_boxes(pixels: DataFrame, sizes: DataFrame, key: str, percentile: float = 0.98, least_white: int = 200, padding: int = 4, divisor: int = 50, least_width: float = 0.6) -> DataFrame:
    """(key, left, top, right, bottom) of each image without its white margins.

    pixels: key, x, y, value; sizes: key, width, height.  What is darker than the percentile of
    the image's values, and than ``least_white`` at least, is content; it keeps a padding of
    width / ``divisor`` or more; the full width stays where less than ``least_width`` of it
    would.  Images without content stay whole.
    """
    white = pixels.groupBy(key).agg(F.greatest(F.lit(least_white), F.percentile("value", F.lit(percentile)).cast("int")).alias("__w"))
    dark = pixels.join(white, key).filter(F.col("value") < F.col("__w")).groupBy(key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    pad = F.greatest(F.lit(padding), F.floor(F.col("width") / divisor))
    box = sizes.join(dark, key, "left").withColumn("__p", pad)
    box = box.withColumn("__l", F.greatest(F.lit(0), F.col("x0") - F.col("__p"))).withColumn("__r", F.least("width", F.col("x1") + F.col("__p")))
    wide = F.coalesce(F.col("__r") - F.col("__l") >= F.col("width") * least_width, F.lit(False))
    return box.select(
        key,
        F.when(wide, F.col("__l")).otherwise(0).cast("int").alias("left"),
        F.coalesce(F.greatest(F.lit(0), F.col("y0") - F.col("__p")), F.lit(0)).cast("int").alias("top"),
        F.when(wide, F.col("__r")).otherwise(F.col("width")).cast("int").alias("right"),
        F.coalesce(F.least("height", F.col("y1") + F.col("__p")), F.col("height")).cast("int").alias("bottom"),
    )
