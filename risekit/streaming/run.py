"""Running the streaming fold: a trigger, a sink for its messages, and availability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from risekit.options import SnapshotOptions
from risekit.sinks import diagnostics, messages, outbox
from risekit.streaming import stream

Send = Callable[[str, str, bool], None]


def to_end(rows: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> None:
    """Run a stream until its input of now ends, into a folder."""
    with stream.typed_state(rows.sparkSession):
        q = rows.writeStream.format(form).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()


def start(readings: DataFrame, device: str, connect: Callable[[], Send], checkpoint: str, options: SnapshotOptions = SnapshotOptions(), available_now: bool = False) -> StreamingQuery:
    """Publish readings batch by batch, at the sampling interval or (available_now) until the input ends.

    A broker's connection knows no batches, so a batch is published again if it fails half-way; the
    messages are states, so that does no harm. An outbox takes each batch once.
    """

    def batch(df: DataFrame, _: int) -> None:
        messages.publish(messages.reading_messages(df, F.lit(device)), connect)

    return _started(readings.writeStream.foreachBatch(batch), checkpoint, options, available_now)


def start_outbox(sent: DataFrame, path: str, checkpoint: str, options: SnapshotOptions = SnapshotOptions(), available_now: bool = False) -> StreamingQuery:
    """Put the messages (topic, payload, retain) of a stream into an outbox, each batch once."""
    sent.sparkSession.dataSource.register(outbox.Outbox)
    return _started(sent.select(*outbox.FIELDS).writeStream.format("outbox").option("path", path), checkpoint, options, available_now)


def _started(writer: DataStreamWriter, checkpoint: str, options: SnapshotOptions, available_now: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{options.sample_interval_minutes * 60:g} seconds"}
    with stream.typed_state(SparkSession.active()):
        return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_log(lines: DataFrame, path: str, checkpoint: str, hours: float = 48.0, options: SnapshotOptions = SnapshotOptions(), available_now: bool = False) -> StreamingQuery:
    """Keep a stream's diagnostics lines (day, value) in folders by day, each batch once, and delete files past the retention after each batch."""

    def batch(df: DataFrame, number: int) -> None:
        diagnostics.append_lines(df.select("day", "value"), path, number)
        diagnostics.prune(df.sparkSession, path, F.current_timestamp(), hours)

    return _started(lines.writeStream.foreachBatch(batch), checkpoint, options, available_now)


class Availability(StreamingQueryListener):
    """Says online when a query starts and offline when it ends.

    A driver that is lost can't say so: willed() gives the broker the offline message as the last will
    of the driver's connection. Connections of tasks have no will, as they end with every batch.
    """

    def __init__(self, device: str, send: Send):
        self.topic, self.send = f"{device}/availability", send

    @classmethod
    def willed(cls, device: str, connect: Callable[[tuple[str, str, bool]], Send]) -> Availability:
        """connect takes the will (topic, payload, retain) and gives a send."""
        return cls(device, connect((f"{device}/availability", "offline", True)))

    def onQueryStarted(self, event) -> None:
        self.send(self.topic, "online", True)

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.send(self.topic, "offline", True)
