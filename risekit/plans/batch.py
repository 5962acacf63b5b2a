"""The fold over stored series: one shuffle by series, sorted partitions, streamed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risekit.options import AnalysisOptions
from risekit.plans.fold import NO_TIME, take_rows
from risekit.plans.sigmoid import fit_many
from risekit.schemas import READING_FIELDS

FIELDS = [f.split()[0] for f in READING_FIELDS.split(", ")]
TIMES = ("peak_eta", "session_start")
NUMBERS = ("rise_percent", "rise_rate", "predicted_peak_percent", "smoothed", "rise_raw")
#: Samples of whole series that are fitted together.
SERIES_SAMPLES = 200_000
#: Rows that are taken together: fits of many sessions go side by side, and a step of few costs as much.
TAKEN_ROWS = 100_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970; NO_TIME for null."""
    return F.coalesce(F.unix_micros(ts.cast("timestamp")), F.lit(NO_TIME))


def reading_columns(series: list, times: list[int], heights: list, kinds: list, states: dict, options: AnalysisOptions) -> dict[str, np.ndarray | pd.arrays.FloatingArray]:
    """Columns of the readings of rows in order, as arrays: for few rows pandas' own conversions cost more than the fold; states is by series and is updated."""
    rows = [(s, t, None if h is None or h != h else h, k) for s, t, h, k in zip(series, times, heights, kinds)]
    readings = take_rows(rows, states, options)
    columns = {}
    for f in FIELDS:
        cells = [getattr(r, f) for r in readings]
        if f in TIMES:
            columns[f] = np.array([NO_TIME if x is None else x for x in cells], np.int64).view("datetime64[us]")  # NO_TIME is NaT
        elif f in NUMBERS:
            columns[f] = pd.arrays.FloatingArray(np.array([math.nan if x is None else x for x in cells], np.float64), np.array([x is None for x in cells], bool))  # a NaN stays apart from a null
        else:
            columns[f] = np.array(cells, object)
    return columns


def reading_frame(series: list, times: list[int], heights: list, kinds: list, states: dict, options: AnalysisOptions) -> pd.DataFrame:
    return pd.DataFrame(reading_columns(series, times, heights, kinds, states, options))


def _dealt(rows: DataFrame, series: str) -> DataFrame:
    """Rows by series over all shuffle partitions: named, as few bytes of rows make much work and must not be merged into few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), series)


def _ordered(measurements: DataFrame, keep: list[str], kind: Column | None) -> DataFrame:
    """keep, and series, time, height and kind as __s, __us, __h, __kind: in order within partitions that hold whole series."""
    source = measurements.withColumn("__us", micros(F.col("ts"))).withColumn("__kind", kind if kind is not None else F.lit(None).cast("string"))
    rows = source.select(*keep, F.col("series_id").alias("__s"), "__us", F.col("height").cast("double").alias("__h"), "__kind")
    return _dealt(rows, "__s").sortWithinPartitions("__s", "__us", *keep)


def _gathered(frames: Iterator[pd.DataFrame], rows: int = TAKEN_ROWS) -> Iterator[pd.DataFrame]:
    """The frames, so many in one that it has rows of them or more; the last may have fewer."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _take(frame: pd.DataFrame, states: dict, options: AnalysisOptions) -> pd.DataFrame:
    return reading_frame(frame["__s"].tolist(), frame["__us"].tolist(), frame["__h"].tolist(), frame["__kind"].tolist(), states, options)


def readings(measurements: DataFrame, options: AnalysisOptions, keep: list[str] | None = None, kind: Column | None = None) -> DataFrame:
    """Readings of rows (series_id, ts, height): the columns in keep, and those of READING_FIELDS.

    Every row in gives a row out; rejected ones have a status that starts with no_reading, as do
    rows without a time, which come first and leave their series alone. Rows of a series are taken
    in order of ts, then of keep. A partition is sorted and streamed, and holds the state of one
    session at a time and TAKEN_ROWS rows, so a series of any length takes bounded memory.
    """
    keep = ["series_id", "ts"] if keep is None else keep
    rows = _ordered(measurements, keep, kind)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", " + READING_FIELDS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for frame in _gathered(frames):
            out = _take(frame, states, options)
            if len(frame):
                last = frame["__s"].iloc[-1]
                states = {last: states[last]}  # series come one after the other
            yield pd.concat([frame[keep].reset_index(drop=True), out], axis=1)

    return rows.mapInPandas(run, schema)


def final_states(measurements: DataFrame, options: AnalysisOptions, kind: Column | None = None) -> DataFrame:
    """(series_id, state): what the fold knows of each series after its last row, as the JSON that a stream starts from."""
    series = measurements.schema["series_id"].dataType.simpleString()

    def dumped(states: dict) -> pd.DataFrame:
        return pd.DataFrame({"series_id": list(states), "state": [s.dumps() for s in states.values()]}, dtype="object")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for frame in frames:
            _take(frame, states, options)
            if len(frame):
                last = frame["__s"].iloc[-1]
                done = {s: state for s, state in states.items() if s != last}
                states = {last: states[last]}
                yield dumped(done)
        yield dumped(states)

    return _ordered(measurements, [], kind).mapInPandas(run, f"series_id {series}, state string")


def final_fits(measurements: DataFrame) -> DataFrame:
    """(series_id, limit, rate, middle, relative_error, samples): a logistic for each series' (ts, value) rows, null without one.

    Partitions are sorted and streamed; series are fitted many at once. A fit needs all samples of
    its series at a time, 16 bytes each. Rows without a time or a value are not fitted.
    """
    kind = measurements.schema["series_id"].dataType.simpleString()
    rows = measurements.select("series_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"))
    rows = _dealt(rows, "series_id").sortWithinPartitions("series_id", "us", "value")

    def fitted(held: list[pd.DataFrame]) -> pd.DataFrame:
        names, hours, values = [], [], []
        for name, group in pd.concat(held).groupby("series_id", sort=False, dropna=False):
            group = group.dropna(subset=["us", "value"])
            names.append(name)
            hours.append(group["us"].to_numpy(np.float64) / 3_600_000_000)
            values.append(group["value"].to_numpy(np.float64))
        fits = [(f.limit, f.rate, f.middle, f.relative_error) if f else (None,) * 4 for f in fit_many(hours, values)]
        return pd.DataFrame([(s, *f, len(v)) for s, f, v in zip(names, fits, values)], columns=["series_id", "limit", "rate", "middle", "relative_error", "samples"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            last = frame["series_id"].eq(frame["series_id"].iloc[-1]) | (frame["series_id"].isna() & pd.isna(frame["series_id"].iloc[-1]))
            first = int(np.flatnonzero(last)[0])  # the last series may go on in the next frame
            held.append(frame[:first])
            if sum(map(len, held)) >= SERIES_SAMPLES and first:
                yield fitted(held)
                held = []
            held.append(frame[first:])
        if held:
            yield fitted(held)

    return rows.mapInPandas(run, f"series_id {kind}, limit double, rate double, middle double, relative_error double, samples long")
