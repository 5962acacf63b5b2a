"""Messages (topic, payload, retain) of readings, diagnostics and entity configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risekit.options import PublishOptions

#: Sensors by key: name, unit, device class. Values come from the state message.
SENSORS = {
    "rise_percent": ("Rise", "%", None),
    "rise_rate": ("Rise Rate", "%/h", None),
    "predicted_peak_percent": ("Predicted Peak Rise", "%", None),
    "peak_eta": ("Peak ETA", None, "timestamp"),
    "session_start": ("Session Started", None, "timestamp"),
}
#: Fields of the diagnostics message, in order.
DIAGNOSTICS = ("method", "band_contrast", "band_top_row", "final_row", "dough_top_px", "jar_bottom_px", "jar_height_px", "dough_height_px")
#: Sensors of the debug mode by key: name, unit, field of the diagnostics message.
DEBUG_SENSORS = {
    "detection_method": ("Detection Method", None, "method"),
    "band_contrast": ("Band Contrast", None, "band_contrast"),
    "dough_top_px": ("Dough Top", "px", "dough_top_px"),
    "jar_bottom_px": ("Jar Bottom", "px", "jar_bottom_px"),
    "jar_height_px": ("Jar Height", "px", "jar_height_px"),
    "dough_height_px": ("Dough Height", "px", "dough_height_px"),
}


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSxxx")


def _json(**cells: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in cells.items()]), {"ignoreNullFields": "false"})


def reading_messages(readings: DataFrame, device: Column) -> DataFrame:
    """One message per reading: its state, retained, or that there is no reading. JSON has no NaN, so what is one is null."""
    state = _json(
        rise_percent=F.when(~F.isnan("rise_percent"), F.col("rise_percent")),
        rise_rate=F.when(~F.isnan("rise_rate"), F.col("rise_rate")),
        predicted_peak_percent=F.col("predicted_peak_percent"),
        peak_eta=iso(F.col("peak_eta")),
        peaked=F.when(F.col("peaked"), "ON").otherwise("OFF"),
        new_session=F.col("new_session"),
        last_update=iso(F.col("ts").cast("timestamp")),
        session_start=iso(F.col("session_start")),
    )
    ok = F.col("status") == "ok"
    topic = F.concat(device, F.when(ok, "/state").otherwise("/measurement_status"))
    return readings.select(topic.alias("topic"), F.when(ok, state).otherwise("no_reading").alias("payload"), ok.alias("retain"))


def diagnostics_messages(frames: DataFrame, device: Column) -> DataFrame:
    """Retained diagnostics of frames, for the debug mode.

    frames has method, band_contrast, band_top and surface as rows of the searched column, and the
    measurement dough_top, jar_top and jar_bottom as rows of the frame (null where there is none).
    """
    cells = (
        F.coalesce("method", F.lit("none")),
        F.rint(F.coalesce("band_contrast", F.lit(0.0))).cast("int"),
        F.col("band_top"),
        F.col("surface"),
        F.col("dough_top"),
        F.col("jar_bottom"),
        F.col("jar_bottom") - F.col("jar_top"),
        F.col("jar_bottom") - F.col("dough_top"),
    )
    payload = _json(**dict(zip(DIAGNOSTICS, cells, strict=True)))
    return frames.select(F.concat(device, F.lit("/diagnostics")).alias("topic"), payload.alias("payload"), F.lit(True).alias("retain"))


def availability_message(device: Column, online: bool) -> Column:
    return F.struct(F.concat(device, F.lit("/availability")).alias("topic"), F.lit("online" if online else "offline").alias("payload"), F.lit(True).alias("retain"))


def discovery_rows(devices: DataFrame, device: str = "device", options: PublishOptions = PublishOptions()) -> DataFrame:
    """Retained configuration messages of every device: sensors, a binary sensor, a reset button, and in debug mode a camera and more sensors."""
    sensors = [(k, name, unit, kind, "state", k, None) for k, (name, unit, kind) in SENSORS.items()]
    if options.debug_mode:
        sensors += [(k, name, unit, None, "diagnostics", source, "diagnostic") for k, (name, unit, source) in DEBUG_SENSORS.items()]
    d = F.col(device)
    about = F.struct(F.array(d).alias("identifiers"), F.lit("Rise Monitor").alias("name"))

    def entity(kind: str, key: str, cells: dict[str, Column]) -> Column:
        cells = {k: c for k, c in cells.items() if c is not None}
        payload = F.to_json(F.struct(*[c.alias(k) for k, c in cells.items()], F.concat(d, F.lit("/availability")).alias("availability_topic"), about.alias("device")))
        topic = F.concat(F.lit(f"{options.discovery_prefix}/{kind}/"), d, F.lit(f"/{key}/config"))
        return F.struct(topic.alias("topic"), payload.alias("payload"), F.lit(True).alias("retain"))

    def named(name: str, key: str) -> dict[str, Column]:
        return {"name": F.lit(name), "unique_id": F.concat(d, F.lit(f"_{key}"))}

    rows = []
    for key, name, unit, device_class, topic, source, category in sensors:
        more = {k: F.lit(v) if v else None for k, v in (("unit_of_measurement", unit), ("device_class", device_class), ("entity_category", category))}
        rows.append(entity("sensor", key, named(name, key) | {"state_topic": F.concat(d, F.lit(f"/{topic}")), "value_template": F.lit(f"{{{{ value_json.{source} }}}}")} | more))
    rows.append(entity("binary_sensor", "peaked", named("Peaked", "peaked") | {"state_topic": F.concat(d, F.lit("/state")), "value_template": F.lit("{{ value_json.peaked }}")}))
    rows.append(entity("button", "reset", named("Reset Session", "reset") | {"command_topic": F.concat(d, F.lit("/cmd/reset"))}))
    if options.debug_mode:
        rows.append(entity("camera", "debug_image", named("Debug Image", "debug_image") | {"topic": F.concat(d, F.lit("/debug_image"))}))
    return devices.select(F.explode(F.array(*rows)).alias("m")).select("m.*")


def publish(messages: DataFrame, connect) -> None:
    """Send messages from the tasks: connect() gives a send(topic, payload, retain) for each partition."""

    def run(rows) -> None:
        send = connect()
        for r in rows:
            send(r["topic"], r["payload"], r["retain"])

    messages.foreachPartition(run)
