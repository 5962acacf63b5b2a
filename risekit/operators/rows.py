"""Row reductions and histograms over pixels in long form (frame_id, x, y, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_sum(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias("row_sum"))


def row_median(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Median per row; an even count averages the middle two."""
    return pixels.groupBy(*keys).agg(F.percentile(F.col(value).cast("double"), F.lit(0.5)).alias("row_median"))


def histogram_median(pixels: DataFrame, keys: list[str], bin_: Column, bins: int = 256, fallback: int = 128) -> DataFrame:
    """First of bins whose cumulative count reaches half of all (rows out of range count in no bin).

    Counts are aggregated to at most bins rows a key before they are ordered.
    """
    counts = pixels.withColumn("bin", bin_.cast("int")).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("bin")
    run = counts.withColumn("so_far", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    reached = run.groupBy(*keys).agg(F.min(F.when(F.col("so_far") >= F.col("total") / 2, F.col("bin"))).alias("median_bin"))
    return reached.withColumn("median_bin", F.coalesce("median_bin", F.lit(fallback)))


def strip(pixels: DataFrame, width: Column, x: str = "x") -> DataFrame:
    """The central half of a column's pixels."""
    first = F.floor(width / 4)
    return pixels.where((F.col(x) >= first) & (F.col(x) < first + F.greatest(F.lit(1), F.floor(width / 2))))
