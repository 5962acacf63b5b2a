"""Smoothing and gradients over pixels in long form (frame_id, x, y, v), as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _blurred(value: str, line: list[str], along: str) -> Column:
    """Binomial weights 1 4 6 4 1 along a line; beyond an end the line is mirrored about its last pixel."""
    w = Window.partitionBy(*line).orderBy(along)
    v = F.col(value)
    left, right = F.lag(value).over(w), F.lead(value).over(w)
    left2 = F.coalesce(F.lag(value, 2).over(w), F.when(left.isNull(), F.lead(value, 2).over(w)).otherwise(v))
    right2 = F.coalesce(F.lead(value, 2).over(w), F.when(right.isNull(), F.lag(value, 2).over(w)).otherwise(v))
    return (left2 + 4.0 * F.coalesce(left, right) + 6.0 * v + 4.0 * F.coalesce(right, left) + right2) / 16.0


def gaussian_blur(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y", value: str = "v") -> DataFrame:
    """5 x 5 Gaussian blur, one axis after the other; frames are at least 3 pixels wide and high."""
    across = pixels.withColumn("__b", _blurred(value, [*keys, y], x))
    return across.withColumn(value, _blurred("__b", [*keys, x], y)).drop("__b")


def edge_energy(pixels: DataFrame, keys: list[str], x: str = "x", y: str = "y", value: str = "v") -> DataFrame:
    """(keys, y, energy): per row the sum of absolute vertical differences across each pixel."""
    w = Window.partitionBy(*keys, x).orderBy(y)
    step = F.abs(F.coalesce(F.lead(value).over(w), F.col(value)) - F.coalesce(F.lag(value).over(w), F.col(value)))
    return pixels.withColumn("__e", step).groupBy(*keys, y).agg(F.sum("__e").alias("energy"))
