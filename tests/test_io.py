import datetime as dt
import json
import time

from pyspark.sql import functions as F

from risekit import options, queries
from risekit.plans import batch
from risekit.sinks import diagnostics, messages
from risekit.sources import snapshots, states
from risekit.streaming import run as run_
from risekit.streaming import stream


def test_options_from_mapping_and_environment():
    o = options.monitor_options({"analysis": {"median_window_size": "7"}, "publish": {"debug_mode": "true"}})
    assert o.analysis.median_window_size == 7 and o.publish.debug_mode and o.publish.port == 1883
    e = options.from_environment(env={"MONITOR__SNAPSHOT__RETRY_COUNT": "4", "OTHER": "x"})
    assert e.snapshot.retry_count == 4
    try:
        options.monitor_options(None)
    except ValueError:
        pass
    else:
        raise AssertionError("a missing section is an error")


def test_snapshot_source_reads_and_retries(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(bytes([1, 2, 3]))
    spark.dataSource.register(snapshots.SnapshotSource)
    df = spark.read.format("snapshot").option("urls", f"file://{tmp_path}/a.jpg\nfile://{tmp_path}/none.jpg").option("delay", "0").load()
    got = {r["url"].rsplit("/", 1)[1]: (r["content"], r["attempts"]) for r in df.collect()}
    assert got == {"a.jpg": (bytearray([1, 2, 3]), 1), "none.jpg": (None, 3)}


def test_keeping_a_frame_may_fail(tmp_path):
    (tmp_path / "f").write_bytes(bytes([7, 8, 9]))
    (tmp_path / "file").write_text("not a folder")
    assert snapshots.fetch_and_keep(f"file://{tmp_path}/f", f"{tmp_path}/file/last.jpg") == bytes([7, 8, 9])


def test_bearer_prefers_the_proxy_token(spark):
    df = spark.sql("SELECT 'p' AS p, 'o' AS o").select(snapshots.bearer(F.col("p"), F.col("o")).alias("a"), snapshots.bearer(F.lit(" "), F.col("o")).alias("b"))
    assert tuple(df.first()) == ("p", "o")


def test_state_text(spark):
    df = spark.createDataFrame([("{broken",), (None,), ('{"samples": [{"ts": "2024-01-01T00:00:00.123456Z", "rise_percent": 5.0}], "slopes": [], "baseline": 100.0, "peaked": true}',)], "value string")
    got = states.read_states(df).collect()
    assert [len(r["samples"]) for r in got] == [0, 0, 1] and [r["baseline"] for r in got] == [None, None, 100.0]
    assert got[2]["samples"][0]["ts"] == dt.datetime(2024, 1, 1, 0, 0, 0, 123456) and got[2]["peaked"]


def test_reading_messages_keep_nulls(spark):
    t = dt.datetime(2024, 1, 1)
    r = spark.createDataFrame([(t, "ok", 12.5, None, None, None, True, False, t), (t, "no_reading:collapse", None, None, None, None, False, False, None)], "ts timestamp, status string, rise_percent double, rise_rate double, predicted_peak_percent double, peak_eta timestamp, peaked boolean, new_session boolean, session_start timestamp")
    a, b = messages.reading_messages(r, F.lit("jar")).collect()
    state = json.loads(a["payload"])
    assert a["topic"] == "jar/state" and a["retain"] and state["peaked"] == "ON" and state["rise_rate"] is None and state["last_update"] == "2024-01-01T00:00:00.0000000+00:00"
    assert tuple(b) == ("jar/measurement_status", "no_reading", False)


def test_discovery_has_more_in_debug_mode(spark):
    d = spark.createDataFrame([("jar",)], "device string")
    assert messages.discovery_rows(d).count() == 7
    rows = messages.discovery_rows(d, options=options.PublishOptions(debug_mode=True)).collect()
    assert len(rows) == 14 and all(json.loads(r["payload"])["availability_topic"] == "jar/availability" for r in rows)


def test_diagnostics_lines_by_day(spark, tmp_path):
    f = spark.createDataFrame([(dt.datetime(2024, 1, 2), "band", 60.4, 5, 6, 16, 10, 100)], "ts timestamp, method string, band_contrast double, band_top int, surface int, dough_top int, jar_top int, jar_bottom int")
    diagnostics.append_lines(diagnostics.diagnostics_lines(f), f"{tmp_path}/log")
    (row,) = spark.read.text(f"{tmp_path}/log").collect()
    line = json.loads(row["value"])
    assert str(row["day"]) == "20240102" and len(line) == 12
    assert {k: line[k] for k in ("final_row", "jar_top_px", "dough_top_px", "jar_bottom_px", "jar_left_px")} == {"final_row": 6, "jar_top_px": 10, "dough_top_px": 16, "jar_bottom_px": 100, "jar_left_px": None}
    (m,) = messages.diagnostics_messages(f, F.lit("jar")).collect()
    size = {"dough_top_px": 16, "jar_bottom_px": 100, "jar_height_px": 90, "dough_height_px": 84}
    assert m["retain"] and json.loads(m["payload"]) == {"method": "band", "band_contrast": 60, "band_top_row": 5, "final_row": 6} | size


def test_image_pixels(spark, tmp_path):
    # a binary PGM isn't read by the image source; a 2 x 1 BMP with one gray and one blue pixel is
    pixels = bytes([100, 100, 100, 255, 0, 0]) + bytes(2)
    head = b"BM" + (54 + len(pixels)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.bmp").write_bytes(head + info + pixels)
    got = {(r["x"], r["y"]): r["v"] for r in snapshots.gray_pixels(spark, f"{tmp_path}/img").collect()}
    assert got == {(0, 0): 100.0, (1, 0): 29.0}


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    events = queries._events(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    cut = dt.datetime(2024, 1, 15)
    rows = events.select(F.col("user_id").alias("series_id"), "ts", F.col("value").alias("height"), F.when(F.col("event_id") % 97 == 0, "reset").alias("kind"))
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"

    def run():
        s = spark.readStream.schema(rows.schema).parquet(source)
        run_.to_end(stream.stream_readings(s, queries.NO_FIT), out, state)

    rows.where(F.col("ts") < F.lit(cut)).coalesce(1).write.parquet(source)
    run()
    rows.where(F.col("ts") >= F.lit(cut)).coalesce(1).write.mode("append").parquet(source)
    run()
    columns = ["series_id", "ts", "status", "rise_percent", "new_session", "smoothed", "session_start"]
    streamed = sorted(map(str, spark.read.parquet(out).select(*columns).collect()))
    stored = sorted(map(str, batch.readings(rows, queries.NO_FIT, keep=["series_id", "ts"], kind=F.col("kind")).select(*columns).collect()))
    assert streamed == stored and streamed


def test_published_states_and_availability(spark, tmp_path):
    from risekit.streaming import run

    seen = []
    listener = run.Availability("jar", lambda *m: seen.append(m))
    spark.streams.addListener(listener)
    rows = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, m), 100.0 + m, None) for m in range(3)], "series_id string, ts timestamp, height double, kind string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/sent"

    def connect():
        def send(topic, payload, retain):
            with open(out, "a") as f:
                f.write(f"{topic} {retain}\n")

        return send

    s = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = run.start(stream.stream_readings(s, options.AnalysisOptions()), "jar", connect, f"{tmp_path}/state", available_now=True)
    q.awaitTermination()
    with open(out) as f:
        assert f.read() == "jar/state True\n" * 3
    for _ in range(100):
        if len(seen) == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert [m[1] for m in seen] == ["online", "offline"]


def test_late_rows_in_the_stream_and_fits_over_restarts(spark, tmp_path):
    """Batches of one row file each: a late row that the reject cap lets through, and a fit that starts from the last one."""
    t0 = dt.datetime(2024, 1, 1, 12)
    o = options.AnalysisOptions(min_samples_for_fit=4, median_window_size=1)
    rows = [(m, 100.0 + 10 * m / (1 + 0.01 * m * m)) for m in range(10)] + [(-98, 118.0)] * 3 + [(m, 126.0 + m / 10) for m in range(10, 14)]
    source, state, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    schema = "series_id string, ts timestamp, height double, kind string"
    from risekit.plans.fold import State, take_rows

    states, want = {"s": State()}, []
    for part in (rows[:6], rows[6:11], rows[11:12], rows[12:]):
        frame = spark.createDataFrame([("s", t0 + dt.timedelta(minutes=m), h, None) for m, h in part], schema)
        frame.coalesce(1).write.mode("append").parquet(source)
        run_.to_end(stream.stream_readings(spark.readStream.schema(schema).parquet(source), o), out, state)
        us = [round((t0 + dt.timedelta(minutes=m)).replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) for m, _ in part]
        order = sorted(range(len(part)), key=lambda i: us[i])
        want += take_rows([("s", us[i], part[i][1], None) for i in order], states, o)
    got = spark.read.parquet(out).collect()
    key = lambda r: (r["status"], r["rise_rate"], r["predicted_peak_percent"], r["rise_raw"])
    assert sorted(map(key, got), key=str) == sorted(((r.status, r.rise_rate, r.predicted_peak_percent, r.rise_raw) for r in want), key=str)
    assert sum(r["predicted_peak_percent"] is not None for r in got) > 3 and sum(r["status"] == "no_reading:implausible" for r in got) >= 2


def test_saved_states_are_read_once(spark, tmp_path):
    from risekit.plans.fold import State

    source, state, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    t0 = dt.datetime(2024, 1, 1)
    us = round(t0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    saved = State(samples=[(us, 5.0)], baseline=100.0, session_start=us, accepted_height=105.0, accepted_time=us)
    schema = "series_id string, ts timestamp, height double, kind string"

    def run(minutes, text):
        rows = [(s, t0 + dt.timedelta(minutes=minutes), 110.0, None) for s in ("a", "b")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        frame = spark.createDataFrame([("a", text), ("c", text)], "series_id string, state string")
        run_.to_end(stream.stream_readings(spark.readStream.schema(schema).parquet(source), options.AnalysisOptions(median_window_size=1), saved=frame), out, state)

    run(5, saved.dumps())
    run(6, "{}")  # a text that can't be read: nobody does
    got = {(r["series_id"], r["ts"].minute): (r["new_session"], r["rise_raw"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 5): (False, 10.0), ("b", 5): (True, 0.0), ("a", 6): (False, 10.0), ("b", 6): (False, 0.0)}


def test_listed_snapshots_are_fetched_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(snapshots.SnapshotSource)
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "_SUCCESS").write_text("no frame")
    state, out = f"{tmp_path}/state", f"{tmp_path}/out"

    def run(name, frames):
        for i in frames:
            (tmp_path / f"{i}.jpg").write_bytes(bytes([i]) * 3)
        (tmp_path / "list" / name).write_text("".join(f"file://{tmp_path}/{i}.jpg\n" for i in frames) + f"\nfile://{tmp_path}/none.jpg")
        rows = spark.readStream.format("snapshot").option("list", f"{tmp_path}/list").option("retries", "1").option("delay", "0").load()
        run_.to_end(rows, out, state)
        return sorted((r["position"], r["content"] and r["content"][0], r["attempts"]) for r in spark.read.parquet(out).collect())

    first = run("a", range(100))
    assert first == [*((i, i, 1) for i in range(100)), (100, None, 2)]
    assert run("b", range(150, 160)) == [*first, *((101 + i, 150 + i, 1) for i in range(10)), (111, None, 2)]


def test_live_snapshots_are_replayed_from_the_spool(tmp_path, monkeypatch):
    seen = iter(range(100))
    monkeypatch.setattr(snapshots, "fetch", lambda *a: bytes([next(seen)]))
    clock = [1000.0]
    monkeypatch.setattr(snapshots.time, "time", lambda: clock[0])
    reader = snapshots.LiveSnapshots({"urls": "a\nb", "spool": f"file://{tmp_path}", "interval": "1"})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert (start, end) == ({"interval": 15}, {"interval": 16}) and reader.partitions(end, end) == []
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    assert rows == [("a", b"\0", 1, 16), ("b", b"\1", 1, 16)]
    again = snapshots.LiveSnapshots({"urls": "a\nb", "spool": f"file://{tmp_path}", "interval": "1"})
    assert [r for p in again.partitions(start, end) for r in again.read(p)] == rows
    clock[0] += 130
    late = again.latestOffset()
    assert late == {"interval": 18} and [r for p in again.partitions(end, late) for r in again.read(p)] == [("a", b"\2", 1, 18), ("b", b"\3", 1, 18)]
    again.commit(end)
    assert [x.name for x in tmp_path.iterdir()] == ["18"]


def test_an_outbox_takes_each_batch_once(spark, tmp_path):
    import os

    from risekit.sinks import outbox

    source, state, box = (f"{tmp_path}/{x}" for x in ("in", "state", "box"))
    schema = "topic string, payload string, retain boolean"

    def run(k):
        if k is not None:
            spark.createDataFrame([(f"t{k}", str(i), i % 2 == 0) for i in range(20)], schema).repartition(3).write.mode("append").parquet(source)
        run_.start_outbox(spark.readStream.schema(schema).parquet(source), f"file://{box}", state, available_now=True).awaitTermination()
        return sorted((r["topic"], int(r["payload"]), r["retain"], r["batch"]) for r in outbox.sent(spark, f"file://{box}").collect())

    first = run(0)
    assert first == sorted(("t0", i, i % 2 == 0, 0) for i in range(20))
    lost = lambda: [os.remove(f"{state}/commits/{x}") for x in ("0", ".0.crc")]
    lost()  # the driver, after the sink's commit: the batch runs again
    assert run(None) == first
    lost()  # in the middle of the sink's commit: files are there, the note isn't
    os.remove(f"{box}/sent/0")
    os.rename(f"{box}/batches/0/0.json", f"{box}/batches/0/77.json")
    assert run(None) == first
    both = run(1)
    assert both == first + sorted(("t1", i, i % 2 == 0, 1) for i in range(20)) and os.listdir(f"{box}/staged") == []


def test_decoded_images_of_every_kind(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(f"i{c}", 7, 5, c, bytearray(r.integers(0, 256, 7 * 5 * c, np.uint8).tobytes())) for c in (1, 3, 4)] + [("empty", 0, 0, 1, bytearray())]
    images = spark.createDataFrame(rows, "origin string, height int, width int, nChannels int, data binary")
    got = {(x["frame_id"], x["x"], x["y"]): x["v"] for x in snapshots.decoded(images).collect()}
    want = {}
    for name, h, w, c, data in rows:
        for i in range(h * w):
            b = data[i * c : i * c + c]
            want[name, i % w, i // w] = float(b[0]) if c == 1 else float(round(0.114 * b[0] + 0.587 * b[1] + 0.299 * b[2]))
    assert got == want


def test_a_log_keeps_each_batch_once_and_prunes_old_files(spark, tmp_path):
    import os

    path, source = f"{tmp_path}/log", f"{tmp_path}/in"
    schema = "day string, value string"

    def run(day, n):
        spark.createDataFrame([(day, f"{day} {i}") for i in range(n)], schema).coalesce(2).write.mode("append").parquet(source)
        run_.start_log(spark.readStream.schema(schema).parquet(source), path, f"{tmp_path}/state", available_now=True).awaitTermination()
        return sorted(r["value"] for r in spark.read.option("basePath", path).text(f"{path}/day=*/batch=*").collect())

    assert run("20240101", 3) == [f"20240101 {i}" for i in range(3)]
    for x in ("0", ".0.crc"):
        os.remove(f"{tmp_path}/state/commits/{x}")  # the first batch runs again, then a second one
    both = run("20240102", 2)
    assert both == [*(f"20240101 {i}" for i in range(3)), *(f"20240102 {i}" for i in range(2))]
    files = [os.path.join(d, f) for d, _, names in os.walk(f"{path}/day=20240101") for f in names if f.startswith("part-")]
    for f in files:
        os.utime(f, (time.time() - 49 * 3600,) * 2)
    diagnostics.prune(spark, path, F.current_timestamp())
    assert not any(map(os.path.exists, files))
    assert sorted(r["value"] for r in spark.read.text(f"{path}/day=20240102/batch=1").collect()) == both[3:]
    diagnostics.prune(spark, path, F.current_timestamp())


def test_batches_of_many_days_have_few_folders(spark, tmp_path):
    import os

    path = f"{tmp_path}/log"
    days = spark.range(300).select(F.concat(F.lit("d"), "id").alias("day"), F.col("id").cast("string").alias("value"))
    for batch, part in ((0, "id < 200"), (1, "id >= 200"), (0, "id < 200")):
        diagnostics.append_lines(days.where(part.replace("id", "int(value)")), path, batch, by_day=False)
    got = sorted((r["batch"], int(r["value"])) for r in spark.read.option("basePath", path).text(path).collect())
    assert got == [(int(i >= 200), i) for i in range(300)]
    assert sorted(d for d in os.listdir(path) if "=" in d) == ["batch=0", "batch=1"]
    diagnostics.prune(spark, path, F.current_timestamp() + F.expr("interval 50 hours"))
    assert not [f for _, _, names in os.walk(path) for f in names if f.startswith("part-")]


def test_a_message_has_no_nan(spark):
    r = spark.range(1).selectExpr("'ok' status", "double('nan') rise_percent", "double('nan') rise_rate", "double(null) predicted_peak_percent", "timestamp'2024-01-01' ts", "timestamp(null) peak_eta", "false peaked", "false new_session", "timestamp(null) session_start")
    (m,) = messages.reading_messages(r, F.lit("jar")).collect()
    assert json.loads(m["payload"])["rise_percent"] is None and json.loads(m["payload"])["rise_rate"] is None


def test_capture_tries_again_where_nothing_was_measured(spark, tmp_path):
    from risekit.sources.capture import capture

    for name, data in (("a", b"1"), ("b", b"22"), ("c", b"333")):
        (tmp_path / name).write_bytes(data)
    rounds = []

    def measure(frames):
        rounds.append(sorted(r["url"][-1] for r in frames.collect()))
        good = F.octet_length("content") <= len(rounds)  # longer frames need more attempts
        return frames.select("url", F.when(good, F.octet_length("content")).alias("level"))

    urls = [f"file://{tmp_path}/{x}" for x in "abcd"]
    o = options.SnapshotOptions(retry_count=1, retry_delay_seconds=0.0)
    got = {r["url"][-1]: tuple(r)[1:] for r in capture(spark, urls, measure, o).collect()}
    assert rounds == [["a", "b", "c"], ["b", "c"]]
    assert got == {"a": (1, True, 1), "b": (2, True, 2), "c": (2, True, None), "d": (2, False, None)}


def test_the_last_will():
    wills, seen = [], []
    a = run_.Availability.willed("jar", lambda will: wills.append(will) or (lambda *m: seen.append(m)))
    a.onQueryStarted(None)
    assert wills == [("jar/availability", "offline", True)] and seen == [("jar/availability", "online", True)]


def test_scratch_folders_off_one_machine_must_be_shared(spark):
    """A stand-in for a session on a cluster whose warehouse is a folder of each machine."""
    from types import SimpleNamespace

    import pytest

    from risekit.scratch import scratch_path

    def session(master, **conf):
        context = SimpleNamespace(master=master, applicationId="app")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.split(".")[1], d)), sparkContext=context, _jvm=spark._jvm, _jsc=spark._jsc)

    with pytest.raises(RuntimeError):
        scratch_path(session("yarn", sql="file:/tmp/warehouse"), "x")
    assert scratch_path(session("yarn", sql="file:/tmp/warehouse", checkpoint="file:/shared"), "x").startswith("file:/shared/x-")
    assert "/rise-app/x-" in scratch_path(session("local[2]"), "x")


def test_tasks_read_only_their_own_part_of_the_list(tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FRAMES_PER_TASK", 3)
    monkeypatch.setattr(snapshots.SnapshotReader, "frame", lambda self, url: (url.encode(), 1))
    (tmp_path / "a").write_text("".join(f"u{i}\n\n" for i in range(4)) + "ü4")
    (tmp_path / "b").write_text("".join(f"u{i}\n" for i in range(5, 10)))
    source = snapshots.ListedSnapshots({"list": f"file://{tmp_path}"})
    parts = source.partitions({"frames": 1}, {"frames": 9})
    seen, lines = [], snapshots.ListedSnapshots._lines

    def watched(self, *begin):
        for x in lines(self, *begin):
            seen.append(x)
            yield x

    monkeypatch.setattr(snapshots.ListedSnapshots, "_lines", watched)
    got = [r for p in parts for r in source.read(p)]
    assert [(r[0], r[3]) for r in got] == [(f"{'ü' if i == 4 else 'u'}{i}", i) for i in range(1, 9)]
    assert len(seen) == 8


def test_frames_of_one_id_have_a_file_each(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"page_id": [7, 7, -1], "html": ["a", "b", None]}).to_parquet(tmp_path / "pages.parquet")
    from risekit.queries import snapshot_stream

    assert sorted((r["page_id"], r["bytes"]) for r in snapshot_stream(spark, f"file://{tmp_path}").collect()) == [(-1, 1), (7, 2), (7, 2)]
