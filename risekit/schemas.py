"""Schemas of the engine's tables."""

MEASUREMENT = "series_id string, ts timestamp, top double, jar_top double, bottom double"
CONTROL = "series_id string, ts timestamp, kind string"
PROFILE = "frame_id string, v array<float>"
SEGMENT = "frame_id string, idx int, x1 int, y1 int, x2 int, y2 int"
READING_FIELDS = (
    "status string, rise_percent double, rise_rate double, predicted_peak_percent double, peak_eta timestamp, "
    "peaked boolean, new_session boolean, session_start timestamp, smoothed double, rise_raw double"
)
STATE = (
    "struct<samples: array<struct<ts: timestamp, rise_percent: double>>, slopes: array<struct<ts: timestamp, slope: double>>, "
    "baseline: double, session_start: timestamp, peaked: boolean>"
)
