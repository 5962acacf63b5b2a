"""An outbox for a stream's messages: each batch once, as JSON lines, as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

FIELDS = ("topic", "payload", "retain")


@dataclass
class Staged(WriterCommitMessage):
    """What a task hands to the driver: the file that it has staged ("" for none), and its messages."""

    file: str
    messages: int


class OutboxWriter(DataSourceStreamWriter):
    """Tasks stage files, the driver moves them to their batch's folder and notes the batch as sent, last of all."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator) -> Staged:
        system, path = self._files()
        file, n, out = f"{path}/staged/{uuid.uuid4().hex}.json", 0, None
        for row in iterator:
            if out is None:
                system.create_dir(f"{path}/staged")
                out = system.open_output_stream(file)
            out.write(json.dumps({k: row[k] for k in FIELDS}).encode() + b"\n")
            n += 1
        if out is None:
            return Staged("", 0)
        out.close()
        return Staged(file, n)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        system, path = self._files()
        if system.get_file_info(f"{path}/sent/{batchId}").type == fs.FileType.NotFound:
            folder = f"{path}/batches/{batchId}"
            if system.get_file_info(folder).type != fs.FileType.NotFound:
                system.delete_dir(folder)  # what a lost driver left of this batch
            system.create_dir(folder)
            for k, m in enumerate(messages):
                if m is not None and m.file:
                    system.move(m.file, f"{folder}/{k}.json")
            system.create_dir(f"{path}/sent")
            with system.open_output_stream(f"{path}/sent/{batchId}") as out:
                out.write(str(batchId).encode())
        self._sweep()

    def abort(self, messages: list[Staged | None], batchId: int) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """A stream has one batch at a time, so what is still staged belongs to no batch."""
        system, path = self._files()
        if system.get_file_info(f"{path}/staged").type != fs.FileType.NotFound:
            system.delete_dir_contents(f"{path}/staged")


class Outbox(DataSource):
    """Format ``outbox``: streams of (topic, payload, retain) into the folder path, which driver and tasks share.

    A batch that runs again (after a driver was lost between writing and committing) is ignored if
    it was sent before, else what there is of it is replaced: nothing is sent twice or in part.
    """

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema, overwrite: bool) -> OutboxWriter:
        return OutboxWriter(self.options)


def sent(spark: SparkSession, path: str) -> DataFrame:
    """(topic, payload, retain, batch) of the batches that an outbox has sent."""
    schema = "topic string, payload string, retain boolean"
    batches = F.regexp_extract(F.input_file_name(), "/batches/([0-9]+)/", 1).cast("long")
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{path}/batches").withColumn("batch", batches)
    noted = spark.read.text(f"{path}/sent").select(F.col("value").cast("long").alias("batch"))
    return rows.join(noted, "batch", "left_semi").select("topic", "payload", "retain", "batch")
