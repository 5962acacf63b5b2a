"""Saved states as JSON: import for a streaming start, and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risekit.schemas import STATE


_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def parse_state(text: Column) -> Column:
    """The state of a JSON text; a fresh one (empty lists, no baseline) where it is missing or broken."""
    fresh = F.from_json(F.lit('{"samples": [], "slopes": [], "peaked": false}'), STATE)
    parsed = F.from_json(text, STATE, {"mode": "PERMISSIVE"} | _TIME)
    return F.when(parsed["samples"].isNull() | parsed["slopes"].isNull(), fresh).otherwise(parsed)


def read_states(files: DataFrame, content: str = "value") -> DataFrame:
    """Rows of state files (a text column) with their columns samples, slopes, baseline, session_start, peaked."""
    return files.withColumn("state", parse_state(F.col(content))).select("*", "state.*").drop("state")


def dump_state(samples: Column, slopes: Column, baseline: Column, session_start: Column, peaked: Column) -> Column:
    state = F.struct(samples.alias("samples"), slopes.alias("slopes"), baseline.alias("baseline"), session_start.alias("session_start"), peaked.alias("peaked"))
    return F.to_json(state, {"ignoreNullFields": "false"} | _TIME)
