"""Snapshot sources: where a frame comes from, and a data source that fetches it, once or as a stream."""

from __future__ import annotations

import hashlib
import os
import time
import urllib.request
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from risekit.options import SnapshotOptions

#: The path of a camera's latest frame under a base URL, before and after the camera's name.
LATEST = ("/api/", "/latest.jpg?quality=90&height=1080&width=1920")
#: Frames of a list that one task fetches.
FRAMES_PER_TASK = 64
#: Pixels of an image that leave a task at a time.
PIXELS = 1 << 18


def _given(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def snapshot_url(url: Column, proxy: Column, token: Column, base: Column, camera: Column) -> Column:
    """An explicit URL, else the proxy's where its token is set, else one made of the base; null without any."""
    made = F.concat(F.rtrim(_given(base), F.lit("/")), F.lit(LATEST[0]), F.coalesce(camera, F.lit("")), F.lit(LATEST[1]))
    return F.coalesce(_given(url), F.when(_given(token).isNotNull(), proxy), made)


def bearer(token: Column, own: Column) -> Column:
    """The proxy's token first, then the options' own."""
    return F.coalesce(_given(token), _given(own))


class SnapshotReader(DataSourceReader):
    """Reads one frame per URL; failures and statuses other than success are null frames."""

    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.token = options.get("token", "")
        self.timeout = float(options.get("timeout", SnapshotOptions.timeout_seconds))
        self.retries = int(options.get("retries", SnapshotOptions.retry_count))
        self.delay = float(options.get("delay", SnapshotOptions.retry_delay_seconds))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, u)) for i, u in enumerate(self.urls)]

    def frame(self, url: str) -> tuple[bytes | None, int]:
        """A frame, and how many attempts it took."""
        frame, attempts = None, 0
        while frame is None and attempts <= self.retries:
            if attempts:
                time.sleep(self.delay)
            attempts += 1
            frame = fetch(url, self.token, self.timeout)
        return frame, attempts

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        position, url = partition.value
        yield url, *self.frame(url), position


class ListedSnapshots(DataSourceStreamReader):
    """Each frame of a growing list once, in order; the offset counts frames.

    The list is a folder of text files with a URL a line, also in folders below it, taken in order of
    their paths; files are added behind the others and never changed. Tasks read their own part of
    the list.
    """

    def __init__(self, options: dict[str, str]):
        self.frames = SnapshotReader(options)
        self.list = options["list"]

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, path = fs.FileSystem.from_uri(self.list)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        return system, sorted((f for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)

    def _lines(self, begin: tuple[str, int] | None = None) -> Iterator[tuple[tuple[str, int], str]]:
        """Lines with their places (file and byte), from a place on."""
        system, files = self._files()
        for f in files:
            if begin is not None and f.path < begin[0]:
                continue
            at = begin[1] if begin is not None and f.path == begin[0] else 0
            with system.open_input_file(f.path) as stream:
                stream.seek(at)
                left = b""
                while chunk := stream.read(1 << 16):
                    *whole, left = (left + chunk).split(b"\n")
                    for x in whole:
                        if x.strip():
                            yield (f.path, at), x.decode()
                        at += len(x) + 1
                if left.strip():
                    yield (f.path, at), left.decode()

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        return {"frames": sum(1 for _ in self._lines())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["frames"], end["frames"]
        begins = ((i, place) for i, (place, _) in enumerate(islice(self._lines(), last)) if i >= first and (i - first) % FRAMES_PER_TASK == 0)
        return [InputPartition((i, min(i + FRAMES_PER_TASK, last), place)) for i, place in begins]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first, last, begin = partition.value
        for i, (_, url) in enumerate(islice(self._lines(begin), last - first), first):
            yield url, *self.frames.frame(url), i


class LiveSnapshots(DataSourceStreamReader):
    """A frame of each URL in each sampling interval; the offset is the number of the interval since 1970.

    A live frame can't be fetched again, so it is put into the folder spool, which all machines
    share, before it is handed on; a batch that runs again reads it there. Intervals that are
    committed leave the spool. Intervals that passed while the stream was down have no frames.
    """

    def __init__(self, options: dict[str, str]):
        self.frames = SnapshotReader(options)
        self.spool = options["spool"]
        self.interval = 60.0 * float(options.get("interval", SnapshotOptions.sample_interval_minutes))

    def initialOffset(self) -> dict:
        return {"interval": int(time.time() // self.interval) - 1}

    def latestOffset(self) -> dict:
        return {"interval": int(time.time() // self.interval)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["interval"] <= start["interval"]:
            return []
        return [InputPartition((end["interval"], u)) for u in self.frames.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        interval, url = partition.value
        system, path = fs.FileSystem.from_uri(self.spool)
        folder = f"{path}/{interval}"
        file = f"{folder}/{hashlib.sha256(url.encode()).hexdigest()}.parquet"
        if system.get_file_info(file).type == fs.FileType.NotFound:
            content, attempts = self.frames.frame(url)
            system.create_dir(folder)
            part = f"{folder}/.{uuid.uuid4().hex}"
            pq.write_table(pa.table({"content": pa.array([content], pa.binary()), "attempts": [attempts]}), part, filesystem=system)
            system.move(part, file)  # there as a whole or not at all
        kept = pq.read_table(file, filesystem=system).to_pylist()[0]
        yield url, kept["content"], kept["attempts"], interval

    def commit(self, end: dict) -> None:
        system, path = fs.FileSystem.from_uri(self.spool)
        for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if f.base_name.isdigit() and int(f.base_name) <= end["interval"]:
                system.delete_dir(f.path)


class SnapshotSource(DataSource):
    """Format ``snapshot``: options urls (one a line), token, timeout, retries, delay.

    As a stream: list (a folder that lists frames), or urls with spool (a shared folder) and interval
    (minutes). position is the place in the list, or the interval's number.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return "url string, content binary, attempts int, position long"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListedSnapshots(self.options) if "list" in self.options else LiveSnapshots(self.options)


def write_frames(frames: DataFrame, folder: str) -> DataFrame:
    """(path) of the files into which tasks put the rows (name, content) of frames, a file each; run it once.

    Files lie in a folder a task, and are called by name, task and row: a task that runs again writes the same ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        task, row = TaskContext.get().partitionId(), 0
        base = f"{path}/{task}"
        system.create_dir(base)
        shown = f"file://{base}" if system.type_name == "local" else f"{folder}/{task}"
        for batch in batches:
            files = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                files.append(f"{name}-{row}")
                with system.open_output_stream(f"{base}/{files[-1]}") as out:
                    out.write(content.as_buffer())
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{shown}/{f}" for f in files], pa.string())], names=["path"])

    return frames.select("name", "content").mapInArrow(run, "path string")


def fetch(url: str, token: str = "", timeout: float = 5.0) -> bytes | None:
    """The body of a GET request, or of a file; None where it can't be had."""
    request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read() or None
    except OSError:
        return None


def fetch_and_keep(url: str, keep: str, token: str = "", timeout: float = 5.0) -> bytes | None:
    """fetch, and keep the last frame in a file if that can be written."""
    frame = fetch(url, token, timeout)
    if frame:
        try:
            os.makedirs(os.path.dirname(keep) or ".", exist_ok=True)
            with open(keep, "wb") as f:
                f.write(frame)
        except OSError:
            pass
    return frame


def gray_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, x, y, v) of the images under a path; colour becomes 0.299 R + 0.587 G + 0.114 B, broken files nothing."""
    return decoded(spark.read.format("image").option("dropInvalid", True).load(path).select("image.*"))


def decoded(images: DataFrame) -> DataFrame:
    """(frame_id, x, y, v) of images as Spark's image source gives them: origin, height, width, nChannels, data.

    Bytes are unpacked as arrays, an image at a time, and its pixels leave the task in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, height, width, channels, data in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                raw = np.frombuffer(data.as_buffer(), np.uint8)[: height * width * channels].reshape(-1, channels)
                for i in range(0, len(raw), PIXELS):
                    part = raw[i : i + PIXELS].astype(np.float64)
                    gray = part[:, 0] if channels == 1 else np.rint(0.114 * part[:, 0] + 0.587 * part[:, 1] + 0.299 * part[:, 2])
                    at = np.arange(i, i + len(part), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([origin] * len(part), pa.string()), pa.array(at % width), pa.array(at // width), pa.array(gray)], names=["frame_id", "x", "y", "v"])

    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "frame_id string, x int, y int, v double")
