"""The fold as a keyed streaming operator with typed state in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from risekit.options import AnalysisOptions
from risekit.plans.batch import micros, reading_columns
from risekit.plans.fold import NO_TIME, State, restored
from risekit.plans.sigmoid import Fit
from risekit.schemas import READING_FIELDS

#: What a series' state holds besides its session's samples and slopes; fit_ is null without a fit.
HEAD = (
    "heights array<double>, baseline double, session_start long, peaked boolean, fit_limit double, fit_rate double, fit_middle double, fit_error double, "
    "accepted_height double, accepted_time long, rejects int, collapses int, saved boolean"
)
SAMPLES, SLOPES = "time long, rise double", "time long, slope double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which typed state needs; the setting is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class SeriesProcessor(StatefulProcessor):
    """One series: a value of what is small, and lists of its session's samples and slopes, which grow by what is new."""

    def __init__(self, options: AnalysisOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.samples = handle.getListState("samples", SAMPLES)
        self.slopes = handle.getListState("slopes", SLOPES)

    def _load(self) -> tuple[State, bool]:
        """The state, and whether it comes from a saved one that no row has met yet."""
        head = self.head.get()
        if head is None:
            return State(), False
        heights, baseline, session_start, peaked, *fit, accepted_height, accepted_time, rejects, collapses, saved = head
        samples, slopes = ([(int(t), float(v)) for t, v in items.get()] for items in (self.samples, self.slopes))
        last_fit = None if fit[0] is None else Fit(*fit)
        return State(list(heights), samples, slopes, baseline, session_start, peaked, last_fit, accepted_height, accepted_time, rejects, collapses), saved

    def _store(self, s: State, stored: tuple = (None, None), counts: tuple[int, int] = (0, 0), saved: bool = False) -> None:
        """Write s; lists that are still the stored ones grow by what comes after their counts, others are written anew."""
        fit = (None,) * 4 if s.last_fit is None else (s.last_fit.limit, s.last_fit.rate, s.last_fit.middle, s.last_fit.relative_error)
        self.head.update(([float(h) for h in s.heights], s.baseline, s.session_start, s.peaked, *fit, s.accepted_height, s.accepted_time, s.rejects, s.collapses, saved))
        for store, now, before, n in zip((self.samples, self.slopes), (s.samples, s.slopes), stored, counts):
            if now is before:
                if len(now) > n:
                    store.appendList([(t, float(v)) for t, v in now[n:]])
            elif now:
                store.put([(t, float(v)) for t, v in now])
            elif store.exists():
                store.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        text = initialState["state"].iloc[0]
        if isinstance(text, str):
            self._store(State.loads(text), saved=True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        batch = parts[0] if len(parts) == 1 else pd.concat(parts)
        us = batch["us"].to_numpy()
        order = np.argsort(us, kind="stable")
        us = us[order].tolist()
        heights, kinds = (batch[c].to_numpy()[order].tolist() for c in ("height", "kind"))
        state, saved = self._load()
        stored = state.samples, state.slopes
        counts = len(state.samples), len(state.slopes)
        first = next((t for t in us if t != NO_TIME), None)
        if saved and first is not None:
            state, saved = restored(state, self.options, first), False
        out = reading_columns([0] * len(us), us, heights, kinds, {0: state}, self.options)
        self._store(state, stored, counts, saved)
        yield pd.DataFrame({"series_id": batch["series_id"].array.take(order), "ts": batch["ts"].array.take(order), **out})

    def close(self) -> None:
        pass


def stream_readings(measurements: DataFrame, options: AnalysisOptions, lateness: str | None = None, saved: DataFrame | None = None) -> DataFrame:
    """Readings of a streaming (series_id, ts, height, kind): series_id, ts and READING_FIELDS. Start it within typed_state().

    Rows of a micro-batch are taken in order of ts within their series, and a series' rows of one
    micro-batch are held in memory: bound it at the source. Rows older than what was accepted
    before are rejected by the fold itself (its gate counts them); a lateness, if given, sets a
    watermark that only bounds what the engine keeps. A row without a time leaves its series alone.

    saved (series_id, state), one row a series, holds states as JSON. They are the state store's
    initial state: read once, when the stream begins, and a series starts from its saved state as
    after a restart at its first row.
    """
    rows = measurements.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness:
        rows = rows.withWatermark("ts", lateness)
    kind = rows.schema["series_id"].dataType.simpleString()
    rows = rows.select("series_id", "ts", micros(F.col("ts")).alias("us"), F.col("height").cast("double").alias("height"), "kind")
    initial = None if saved is None else saved.select(F.col("series_id").cast(kind).alias("series_id"), "state").groupBy("series_id")
    return rows.groupBy("series_id").transformWithStateInPandas(SeriesProcessor(options), f"series_id {kind}, ts timestamp, {READING_FIELDS}", "Append", "None", initialState=initial)
