import datetime as dt

import pytest
from pyspark.sql import functions as F

from risekit.functions import rise
from risekit.operators import edges, hough, profiles, rolling, rows, segmented, segments

EDGE_A = [0.8, 0.8, 0.8, 0.1, 0.1, 0.1, 0.1, 0.95, 0.95, 0.95, 0.95]
EDGE_B = [0.1, 0.1, 0.1, 0.1, 0.2, 0.25, 0.3, 0.35, 0.3, 0.28, 0.24, 0.2]


def one(df):
    return df.collect()[0]


def frame(spark, **profile):
    names = list(profile)
    return spark.createDataFrame([tuple([float(x) for x in profile[n]] for n in names)], ", ".join(f"{n} array<double>" for n in names))


@pytest.mark.parametrize(("energy", "row"), [(EDGE_A, 8), (EDGE_B, 9), ([], None), ([0.0] * 20, None)])
def test_edge_surface(spark, energy, row):
    assert one(profiles.edge_surface(frame(spark, e=energy), "e"))["surface"] == row


@pytest.mark.parametrize(("intensity", "row", "contrast"), [([200] * 50 + [150] * 10, None, 0.0), ([220] * 50 + [40] * 10, 47, 175.54), ([200] * 9, None, 0.0), ([], None, 0.0)])
def test_band_top(spark, intensity, row, contrast):
    r = one(profiles.band_top(frame(spark, v=intensity), "v"))
    assert r["band_top"] == row and r["band_contrast"] == pytest.approx(contrast, abs=0.01)


def test_combined_surface(spark):
    band = [220] * 50 + [40] * 10
    peak = [0.0] * 60
    peak[49] = 9.0
    r = one(profiles.combined_surface(frame(spark, e=peak, v=band), "e", "v"))
    assert (r["surface"], r["method"]) == (49, "band")
    r = one(profiles.combined_surface(frame(spark, e=[0.0] * 60, v=band), "e", "v"))
    assert (r["surface"], r["method"]) == (47, "band")
    r = one(profiles.combined_surface(frame(spark, e=EDGE_A, v=[100.0] * 11), "e", "v"))
    assert (r["surface"], r["method"]) == (8, "edge")
    r = one(profiles.combined_surface(frame(spark, e=[0.0] * 11, v=[100.0] * 11), "e", "v"))
    assert (r["surface"], r["method"]) == (None, "none")


def test_bottom_from_energy(spark):
    e = [0.0] * 40
    e[30] = 5.0
    df = frame(spark, e=e).withColumns({"last": F.lit(39), "top": F.lit(5)})
    assert abs(one(profiles.bottom_from_energy(df, "e", "last", "top"))["bottom"] - 30) <= 2
    flat = frame(spark, e=[1.0] * 40).withColumns({"last": F.lit(39), "top": F.lit(5)})
    assert one(profiles.bottom_from_energy(flat, "e", "last", "top"))["bottom"] == 39


def test_moving_average_is_cut_at_the_ends(spark):
    df = frame(spark, v=[1, 2, 3, 4, 5]).select(profiles.moving_average(F.col("v"), 3).alias("m"))
    assert one(df)["m"] == [1.5, 2, 3, 4, 4.5]


def test_shift_and_crop(spark):
    df = spark.createDataFrame([(20.0, 10.0, 30.0)], "top double, jar_top double, bottom double")
    assert tuple(one(profiles.shift_rows(df, ["top", "jar_top", "bottom"], F.lit(15)))) == (35, 25, 45)
    p = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x int, y int")
    assert profiles.crop(p, {"x": 1, "y": 1, "width": 2, "height": 2}).count() == 4
    assert profiles.crop(p, {"x": None, "y": 1, "width": 2, "height": 2}).count() == 16


def test_histogram_median(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 300)], "frame_id string, v int")
    got = {r["frame_id"]: r["median_bin"] for r in rows.histogram_median(p, ["frame_id"], F.col("v")).collect()}
    assert got == {"a": 2}  # no interpolation; values out of range are in no bin


def test_row_median_of_even_count(spark):
    p = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0)], "y int, v double")
    assert {r["y"]: r["row_median"] for r in rows.row_median(p, ["y"]).collect()} == {0: 1.5, 1: 5.0}


def test_wall_pairs_take_the_first_of_equals(spark):
    walls = spark.createDataFrame([("f", 0, 10, 0, 50), ("f", 1, 40, 0, 50), ("f", 2, 60, 0, 50), ("f", 3, 11, 0, 20)], "frame_id string, idx int, x int, top int, bottom int")
    r = one(segments.wall_pairs(walls, 20, 20))
    assert (r["left"], r["right"], r["overlap"]) == (10, 40, 50)
    assert segments.wall_pairs(walls, 100, 20).count() == 0


def test_segments(spark):
    s = spark.createDataFrame([("f", 0, 10, 0, 12, 50), ("f", 1, 0, 30, 40, 31), ("f", 2, 5, 60, 45, 60), ("f", 3, 0, 5, 50, 5)], "frame_id string, idx int, x1 int, y1 int, x2 int, y2 int")
    assert [r["idx"] for r in segments.near_vertical(s).collect()] == [0]
    assert one(segments.lowest_long_horizontal(s, F.lit(10), F.lit(90)))["bottom"] == 60


def test_formulas(spark):
    df = spark.createDataFrame([(120.0, 100.0, 0.25, float("nan"), None)], "h double, b double, q double, nan double, none double")
    r = one(df.select(
        rise.rise_percent(F.col("h"), F.col("b")).alias("rise"), rise.rise_percent(F.col("h"), F.lit(0.0)).alias("zero"),
        rise.rounded(F.col("q"), 1).alias("even"), F.isnan(rise.clamp(F.col("nan"), 0, 500)).alias("nan"), rise.clamp(F.col("none"), 0, 500).alias("none"),
        rise.predicted_peak(F.lit(600.0)).alias("peak"), rise.hours_at_fraction(F.lit(1.0), F.lit(2.0)).alias("hours"),
        *[c.alias(n) for n, c in zip(("lower", "upper"), rise.auto_threshold(F.lit(100.0), 0.6))], rise.session_line(F.lit(50.0), F.lit(200.0), F.lit(100.5)).alias("line"),
    ))
    assert r["rise"] == 20 and r["zero"] is None and r["even"] == 0.2 and r["nan"] and r["none"] is None and r["peak"] == 500
    assert r["hours"] == pytest.approx(5.4761, abs=1e-4)
    assert r["lower"] == pytest.approx(39.6) and r["upper"] == pytest.approx(133) and r["line"] == 150  # half-even: 149.5


def test_eta_is_to_the_microsecond(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp").select(rise.after_hours(F.col("t"), F.lit(1.5)).alias("t"))
    assert one(df)["t"] == dt.datetime(2024, 1, 1, 1, 30)


def test_equal_times_go_by_their_ties(spark):
    rows = [(1, 5, k, float(v)) for k, v in enumerate((9, 1, 7, 3))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "s int, ts long, k int, v double")
        got = {r["k"]: r["m"] for r in rolling.rolling_median(df, ["s"], "v", 2, out="m", ties=["k"]).collect()}
        assert got == {0: 9.0, 1: 5.0, 2: 4.0, 3: 5.0}


def test_wall_pairs_of_large_frames(spark):
    """Frames on both sides of the block's size, against all pairs; many equal walls, and a frame without a pair."""
    import random

    r = random.Random(3)
    rows = [(f, i, r.randrange(200), 0, 0) for f, n in (("few", 30), ("many", 700), ("equal", 300), ("thin", 100)) for i in range(n)]
    walls = []
    for f, i, x, _, _ in rows:
        top = 5 if f == "equal" else r.randrange(100)
        walls.append((f, i, x % 9 if f == "thin" else x, top, top + (40 if f == "equal" else r.randrange(1, 90))))
    want = {}
    for f, i, x, t, b in walls:
        for g, j, y, u, c in walls:
            if f == g and y - x >= 10 and min(b, c) - max(t, u) >= 8:
                key = (-(min(b, c) - max(t, u)), x, i, y, j)
                want[f] = min(want.get(f, (key,)), (key, (x, y, max(t, u), min(b, c), min(b, c) - max(t, u))))
    df = spark.createDataFrame(walls, "frame_id string, idx long, x int, top int, bottom int")
    for block in (16, 100, 10_000):
        got = {row[0]: tuple(row[1:]) for row in segments.wall_pairs(df, 10, 16, block).collect()}
        assert got == {f: v[1] for f, v in want.items()} and len(got) == 3
    assert segments.wall_pairs(df.limit(0), 10, 16).count() == 0


def _thinned_by_hand(v):
    """Strength where it is largest across the edge, pixel by pixel."""
    h, w = len(v), len(v[0])
    at = lambda y, x: v[min(max(y, 0), h - 1)][min(max(x, 0), w - 1)]
    g = {}
    for y in range(h):
        for x in range(w):
            gx = sum(k * (at(y + d, x + 1) - at(y + d, x - 1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(y + 1, x + d) - at(y - 1, x + d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
            g[y, x] = gx, gy
    m = {k: abs(a) + abs(b) for k, (a, b) in g.items()}
    out = {}
    for (y, x), (gx, gy) in g.items():
        tangent = abs(gy) / abs(gx) if gx else float("inf") if gy else 1.0
        dy, dx = (0, 1) if tangent < edges.SLANT else (1, 0) if tangent > edges.SLANT + 2 else (1, 1) if (gx >= 0) == (gy >= 0) else (1, -1)
        first, second = m.get((y - dy, x - dx), 0), m.get((y + dy, x + dx), 0)
        if m[y, x] > first and (m[y, x] > second or m[y, x] == second and 0 in (dy, dx)):
            out[y, x] = m[y, x]
    return out


def test_edges_over_tiles(spark):
    import random

    r = random.Random(8)
    frames = {"noise": [[r.randrange(0, 256, 16) for _ in range(33)] for _ in range(21)]}
    spiral = [[0] * 40 for _ in range(40)]  # one long weak edge with a strong end, over many tiles
    y, x, dy, dx, size = 2, 2, 0, 1, 36
    while size > 4:
        for _ in range(2):
            for _ in range(size):
                spiral[y][x] = 40
                y, x = y + dy, x + dx
            dy, dx = dx, -dy
        size -= 6
    spiral[2][2] = spiral[2][3] = 255
    frames["spiral"] = spiral
    frames["flat"] = [[7] * 9 for _ in range(9)]
    rows = [(f, x, y, v) for f, rows_ in frames.items() for y, line in enumerate(rows_) for x, v in enumerate(line)]
    want = set()
    for f, v in frames.items():
        m = {k: s for k, s in _thinned_by_hand(v).items() if s > 100}
        stack = [k for k, s in m.items() if s > 500]
        seen = set(stack)
        while stack:
            y, x = stack.pop()
            for k in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if k in m and k not in seen:
                    seen.add(k)
                    stack.append(k)
        want |= {(f, x, y) for y, x in seen}
    df = spark.createDataFrame(rows, "frame_id string, x int, y int, v int")
    for tile in (4, 7, 256):
        got = [tuple(r) for r in edges.edge_pixels(df, F.lit(100), F.lit(500), tile).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert {f for f, *_ in want} == {"noise", "spiral"} and sum(f == "spiral" for f, *_ in want) > 100
    assert edges.edge_pixels(df.limit(0), F.lit(1), F.lit(2)).count() == 0


def test_segments_of_drawn_lines(spark):
    drawn = {(10, y) for y in range(5, 80) if not 30 < y < 36} | {(x, 60) for x in range(20, 90)} | {(20 + i, 5 + i) for i in range(40)} | {(70, y) for y in range(5, 15)}
    df = spark.createDataFrame([("a", x, y) for x, y in drawn] + [(None, 1, 1)], "frame_id string, x int, y int")
    got = [tuple(r)[2:] for r in hough.segments(df, 30, 25, 8).collect()]
    exact = [s for s in got if s[0] == s[2] or s[1] == s[3]]
    assert (10, 5, 10, 79) in [tuple(sorted((s[:2], s[2:]))[0] + sorted((s[:2], s[2:]))[1]) for s in exact]
    assert any(s[1] == s[3] == 60 and {s[0], s[2]} == {20, 89} for s in exact)
    assert any({s[:2], s[2:]} == {(20, 5), (59, 44)} for s in got)
    cut = [tuple(r)[2:] for r in hough.segments(df, 30, 25, 3).collect()]
    assert any({s[1], s[3]} == {5, 30} and s[0] == s[2] == 10 for s in cut) and any({s[1], s[3]} == {36, 79} and s[0] == s[2] == 10 for s in cut)
    assert hough.segments(df.limit(0), 3, 2, 1).count() == 0


def test_segmented_profiles(spark):
    """One series of many blocks and ranges, others of one row and of a null key; repeated times."""
    rows = [("long", i // 2, i, float(i * 7919 % 101)) for i in range(2000)] + [("one", 0, 0, 3.0)] + [(None, i, i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double").repartition(5)
    placed = segmented.positions(df, ["k"], ["t", "i"]).cache()
    got = {(r["k"], r["i"]): r["pos"] for r in placed.collect()}
    assert got == {(k, i): i for k, _, i, _ in rows}
    placed = placed.where("k IS NOT NULL")
    sums = {(r["k"], r["pos"]): r["so_far"] for r in segmented.prefix_sums(placed, ["k"], "v", block=64).collect()}
    means = {(r["k"], r["pos"]): r["m"] for r in segmented.moving_average(placed, ["k"], "v", 5, block=8).collect()}
    v, so_far = [x[3] for x in rows[:2000]], 0.0
    for i in range(2000):
        so_far += v[i]
        window = v[max(0, i - 2) : i + 3]
        assert sums["long", i] == so_far and means["long", i] == pytest.approx(sum(window) / len(window))
    assert sums["one", 0] == means["one", 0] == 3.0 and len(sums) == len(means) == 2001
    assert segmented.positions(df.limit(0), ["k"], ["t"]).count() == 0
    with pytest.raises(ValueError):
        segmented.moving_average(placed, ["k"], "v", 9, block=8)


def test_hough_deals_votes_lines_and_pixels_once(spark):
    df = spark.createDataFrame([(f, 7, y) for f in (1, 2) for y in range(12)], "frame_id long, x long, y long")
    plan = hough.segments(df, 5, 4, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and plan.count("Join") == 1 and "SortAggregate" not in plan


def test_edges_of_a_stack_of_tiles_and_of_tiles_cut_by_batches(spark):
    import numpy as np

    v = np.random.default_rng(5).integers(0, 256, (3, 9, 7))
    assert (edges.thinned(v) == np.stack([edges.thinned(x) for x in v])).all()
    df = spark.createDataFrame([(f"f{k}", x, y, int(v[k, y, x])) for k in range(3) for y in range(9) for x in range(7)], "frame_id string, x int, y int, v long")
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(most), []
    for n in (before, "5"):
        spark.conf.set(most, n)
        try:
            got.append(sorted(map(tuple, edges.edge_pixels(df, F.lit(140), F.lit(280), tile=5).collect())))
        finally:
            spark.conf.set(most, before)
    assert got[0] == got[1] and got[0] == sorted(map(tuple, edges.edge_pixels(df, F.lit(140), F.lit(280)).collect()))


def test_groups_go_over_batches():
    import pyarrow as pa

    from risekit.operators.sorted_groups import whole_groups

    rows = [(f, a) for f, n in (("a", 3), ("b", 11), ("c", 1), ("d", 4)) for a in (0, 1) for _ in range(n)]
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_pydict({"f": [f for f, _ in rows[i : i + size]], "a": [a for _, a in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        for keys in (1, 2):
            tables = [list(zip(*t.to_pydict().values())) for t in whole_groups(iter(batches), keys)]
            groups = [{r[:keys] for r in t} for t in tables]
            assert [r for t in tables for r in t] == rows and all(not g & h for i, g in enumerate(groups) for h in groups[:i])
