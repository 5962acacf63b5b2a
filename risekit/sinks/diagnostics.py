"""Diagnostics as daily JSON lines, and which exported files are due for deletion."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risekit.sinks.messages import iso


#: Fields of a line after time and image, each with the column of frames.measure() that it comes from.
FIELDS = {
    "method": "method",
    "band_contrast": "band_contrast",
    "band_top_row": "band_top",
    "final_row": "surface",
    "jar_left_px": "jar_left",
    "jar_right_px": "jar_right",
    "jar_top_px": "jar_top",
    "dough_top_px": "dough_top",
    "jar_bottom_px": "jar_bottom",
    "session_start_surface_px": "session_line",
}


def diagnostics_lines(frames: DataFrame, ts: str = "ts", image: str = "image") -> DataFrame:
    """(day, value): one JSON line per frame; missing columns are nulls.

    band_top and surface are rows of the searched column, what ends in _px is a place in the frame.
    """
    cells = [iso(F.col(ts)).alias("time"), (F.col(image) if image in frames.columns else F.lit(None).cast("string")).alias("image")]
    cells += [(F.col(c) if c in frames.columns else F.lit(None).cast("int")).alias(k) for k, c in FIELDS.items()]
    return frames.select(F.date_format(ts, "yyyyMMdd").alias("day"), F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def append_lines(lines: DataFrame, path: str, batch: int | None = None, by_day: bool = True) -> None:
    """Append to folders by day. With a batch's number its own folders are written anew, so a batch that runs again leaves its lines once.

    A folder costs many calls of the file system. Batches of very many days go without by_day to one
    folder each, whose files hold ranges of days, in order; a line has its time. Their files are as
    old as their batch either way, so pruning takes the same lines.
    """
    if not by_day:
        name = "0" if batch is None else str(batch)
        whole = lines.repartitionByRange("day").sortWithinPartitions("day", "value").select("value")
        whole.write.mode("append" if batch is None else "overwrite").text(f"{path}/batch={name}")
    elif batch is None:
        lines.write.mode("append").partitionBy("day").text(path)
    else:
        mine = lines.withColumn("batch", F.lit(batch))
        mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").text(path)


def expired_files(files: DataFrame, now: Column, hours: float = 48.0, modified: str = "modificationTime") -> DataFrame:
    """Files older than the retention, of whatever name; nothing is deleted here."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(modified).cast("timestamp"))) / 3_600_000_000.0
    return files.where(age > hours)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime) of all files below a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")


def prune(spark: SparkSession, path: str, now: Column, hours: float = 48.0) -> None:
    """Delete the files below a folder that are older than the retention, from tasks; those that are gone or can't be deleted are left to the next time."""

    def delete(rows: Iterator) -> None:
        for r in rows:
            system, file = fs.FileSystem.from_uri(r["path"])
            try:
                system.delete_file(file)
            except OSError:
                continue

    expired_files(log_files(spark, path), now, hours).select("path").foreachPartition(delete)
