"""A sampling cycle: fetch and measure, with other attempts where either fails."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risekit.options import SnapshotOptions
from risekit.scratch import scratch_path
from risekit.sources.snapshots import SnapshotSource


def capture(spark: SparkSession, urls: Sequence[str], measure: Callable[[DataFrame], DataFrame], options: SnapshotOptions = SnapshotOptions()) -> DataFrame:
    """A row for each URL: url, attempts, fetched, and the columns that measure adds, null where nothing was measured.

    measure takes (url, content) of frames and gives a row for each with a column level, null where
    it measures nothing. URLs without a frame or a level are fetched and measured again, all that
    are left side by side, until the options' retries are used up.
    """
    spark.dataSource.register(SnapshotSource)

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    left, parts = list(dict.fromkeys(urls)), []
    for attempt in range(1, options.retry_count + 2):
        if attempt > 1:
            time.sleep(options.retry_delay_seconds)
        source = spark.read.format("snapshot").options(urls="\n".join(left), retries="0", token=options.access_token or "", timeout=str(options.timeout_seconds))
        frames = kept(source.load().select("url", "content"), "frames")
        measured = measure(frames.where("content IS NOT NULL"))
        rows = frames.select("url", F.lit(attempt).alias("attempts"), F.col("content").isNotNull().alias("fetched")).join(measured, "url", "left")
        parts.append(kept(rows, "captured"))
        failed = [r["url"] for r in parts[-1].where("level IS NULL").select("url").collect()]  # of the cameras, whose list is the driver's
        if not failed or attempt > options.retry_count:
            break
        parts[-1] = parts[-1].where("level IS NOT NULL")
        left = failed
    return reduce(DataFrame.unionByName, parts)
