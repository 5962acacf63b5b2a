"""Profiles of any length as rows, cut into blocks: positions, prefix sums and moving averages without a whole series in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risekit.scratch import scratch_path

BLOCK = 1 << 16


def positions(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with pos, the place of each from 0 in the order of its series.

    Rows are dealt by ranges of (keys, order), which cut a long series over many tasks. Rows are
    numbered within a series and range, and the counts of the ranges before are added; only these
    counts, a row for each series and range, meet by series. Rows of equal keys and order count in
    any order, and share a range.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "positions")
    dealt = rows.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id())
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = kept.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    base = counts.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy(*keys, "range").orderBy(*order)) - 1
    same = F.col("range") == F.col("at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"key_{i}"))
    return kept.withColumn("nth", nth).join(base, same).select(*rows.columns, (F.col("base") + F.col("nth")).alias("pos"))


def prefix_sums(rows: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """rows (with pos) with so_far, the sum of value up to each: by block, with the blocks before carried over."""
    cut = rows.withColumn("block", F.floor(F.col("pos") / block))
    sums = cut.groupBy(*keys, "block").agg(F.sum(value).alias("whole"))
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "block", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("carried"))
    within = F.sum(value).over(Window.partitionBy(*keys, "block").orderBy("pos"))
    return cut.withColumn("within", within).join(carried, [*keys, "block"]).select(*rows.columns, (F.col("carried") + F.col("within")).alias("so_far"))


def moving_average(rows: DataFrame, keys: list[str], value: str, window: int, block: int = BLOCK) -> DataFrame:
    """rows (with pos) with m, the mean of value over a centred window cut off at the series' ends.

    A block also gets the rows next to it that its windows reach; it is as long as the window at least.
    """
    half = window // 2
    if block < window:
        raise ValueError("a block is shorter than the window")
    own, at = F.floor(F.col("pos") / block), F.pmod(F.col("pos"), F.lit(block))
    homes = F.filter(F.array(own, F.when((at < half) & (own > 0), own - 1), F.when(at >= block - half, own + 1)), lambda b: b.isNotNull())
    dealt = rows.select("*", own.alias("own"), F.explode(homes).alias("block"))
    near = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(-half, half)
    return dealt.withColumn("m", F.avg(value).over(near)).where("own = block").select(*rows.columns, "m")
