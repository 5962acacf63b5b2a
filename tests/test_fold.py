"""The fold against hand-calculated vectors: (minutes, surface row), jar bottom at row 200."""

import math
from dataclasses import replace

import numpy as np
import pytest

from risekit.options import AnalysisOptions
from risekit.plans.fold import NO_TIME, State, reset, restored, step, take_rows
from risekit.plans.sigmoid import fit

A = AnalysisOptions(min_samples_for_fit=3)
B = replace(A, min_samples_for_fit=1000, median_window_size=1)
T0 = 1_704_067_200_000_000
MIN = 60_000_000


def run(rows, options=A, state=None):
    state = state or State()
    return [step(state, T0 + round(m * MIN), None if top is None else 200.0 - top, options) for m, top in rows], state


def test_rise_of_twenty_per_cent():
    (a, b), state = run([(0, 100), (5, 80)])
    assert (a.new_session, b.new_session) == (True, False)
    assert a.rise_percent == 0 and b.rise_percent == 20  # the baseline row is not in the next median
    assert b.rise_rate is None and state.baseline == 100


def test_session_start_and_baseline():
    (a, b), state = run([(0, 100), (5, 80)])
    assert State().baseline is None and state.baseline == 100
    assert a.session_start == b.session_start == T0


def test_clamps():
    (_, low), _ = run([(0, 100), (5, 120)])
    assert low.rise_percent == 0 and low.rise_raw == -20
    (_, high), _ = run([(0, 100), (240, -500)])
    assert high.rise_percent == 500 and high.rise_raw == 600


def test_jump_is_rejected_until_the_streak_ends():
    rs, _ = run([(0, 100), (5, -500), (10, -500), (15, -500)])
    assert [r.status.split(":")[0] for r in rs] == ["ok", "no_reading", "no_reading", "ok"]
    assert rs[3].rise_percent == 500


RISES = [(0, 100), (30, 50), (60, 50), (90, 50), (120, 50), (150, 50)]


def test_single_collapse_is_ignored():
    rs, _ = run([*RISES, (180, 110), (210, 55)], B)
    assert rs[6].status == "no_reading:collapse"
    assert rs[7].status == "ok" and not rs[7].new_session and rs[7].rise_percent == 45


def test_confirmed_collapse_opens_a_session():
    rs, state = run([*RISES, (180, 110), (210, 110), (240, 110)], B)
    assert [r.status for r in rs[6:8]] == ["no_reading:collapse"] * 2
    assert rs[8].new_session and rs[8].rise_percent == 0 and state.baseline == 90


@pytest.mark.parametrize(("legacy", "rise", "rate"), [(True, 30.0, 47.1), (False, 20.0, 30.0)])
def test_restart(legacy, rise, rate):
    options = replace(A, legacy_restore=legacy)
    rs, state = run([(0, 100), (5, 95), (10, 90), (15, 85), (20, 80), (25, 75)], options)
    assert [r.rise_raw for r in rs[1:]] == pytest.approx([5, 7.5, 10, 12.5, 15])
    assert rs[4].rise_rate == rs[5].rise_rate == 30.0
    back = restored(State.loads(state.dumps()), options, T0 + 35 * MIN)
    (r,), _ = run([(35, 70)], options, back)
    assert not r.new_session and (r.rise_percent, r.rise_rate) == (rise, rate)


def test_expiry_is_strict_and_needs_samples():
    o = replace(A, max_session_hours=1)
    rs, _ = run([(0, 100), (60, 100), (120, 100)], o)
    assert [r.new_session for r in rs] == [True, False, True]
    rs, _ = run([(0, 100), (600, 100)], o)
    assert not rs[1].new_session  # a session of its baseline alone never expires


def test_reset_keeps_the_reject_streak():
    _, state = run([(0, 100), (5, -500)])
    r = reset(state, T0)
    assert r.new_session and r.session_start is None and state.rejects == 1
    (a,), _ = run([(10, 100)], state=state)
    assert a.new_session and state.rejects == 0


def test_out_of_order_and_missing_rows():
    rs, _ = run([(5, 100), (5, 100), (0, 100), (0, 100), (9, None)])
    assert [r.status for r in rs] == ["ok", "no_reading:implausible", "no_reading:implausible", "ok", "no_reading:measurement"]


def test_a_row_without_a_time_leaves_the_state_alone():
    state = State()
    step(state, T0, 102.0, A)
    before = state.dumps()
    assert step(state, NO_TIME, 9000.0, A).status == "no_reading:time" and state.dumps() == before
    assert step(state, T0 + MIN, 9000.0, A).status == "no_reading:implausible"


def test_rows_together_and_one_by_one_agree():
    r = np.random.default_rng(5)
    rows, series = [], list(range(6))
    for i in range(90):
        for s in series:
            height = 100 + 80 / (1 + math.exp(-0.15 * (i - 30 - s))) + r.normal(0, 0.5) - (60 if i == 70 and s < 2 else 0)
            rows.append((s, T0 + 5 * MIN * i, None if i % 17 == 3 else height, "reset" if i == 50 and s == 4 else None))
    one, out = {}, []
    for row in rows:
        out += take_rows([row], one, A)
    together: dict = {}
    assert take_rows(rows, together, A) == out and {s: x.dumps() for s, x in one.items()} == {s: x.dumps() for s, x in together.items()}
    assert sum(x.predicted_peak_percent is not None for x in out) > 50 and any(x.peaked for x in out)


def test_zero_baseline_is_not_a_number():
    rs, _ = run([(0, 200), (5, 190)])
    assert math.isnan(rs[1].rise_percent)


def test_peak_latches_without_a_fit():
    rows = [(0, 100), *((30 * i, 60) for i in range(1, 12))]
    rs, _ = run(rows, replace(B, slope_window_minutes=120))
    flags = [r.peaked for r in rs]
    assert flags[-1] and flags == sorted(flags)


def test_fit_recovers_a_logistic():
    h = np.linspace(0, 10, 40)
    f = fit(h, 120 / (1 + np.exp(-1.1 * (h - 4))))
    assert f.limit == pytest.approx(120, rel=1e-3) and f.rate == pytest.approx(1.1, rel=1e-3) and f.middle == pytest.approx(4, rel=1e-3)
    assert f.relative_error < 1e-3
    assert f.hours_at_fraction(0.97) == pytest.approx(4 + 3.4761 / 1.1, rel=1e-3)


def test_fit_needs_enough():
    h = np.arange(6.0)
    assert fit(h[:4], h[:4] * 10) is None
    assert fit(h, h * 0.5) is None
    assert fit(h, 1000 * np.exp(h)) is None or fit(h, 1000 * np.exp(h)).limit <= 500


def test_slope_after_late_rows():
    rows = [(m, 100 - m) for m in range(8)]
    late = [(-98, 92), (-98, 92), (-98, 92)]  # the third one ends the streak of rejects
    rs, state = run([*rows, *late, (8, 92)], B)
    assert [r.status for r in rs[8:]] == ["no_reading:implausible"] * 2 + ["ok"] * 2
    x = [m for m, _ in rows[1:]] + [8]
    y = [r.rise_raw for r in rs[1:8]] + [rs[-1].rise_raw]
    assert rs[-1].rise_rate == pytest.approx(np.polyfit(np.array(x) / 60, y, 1)[0], abs=0.05)
    again = State.loads(state.dumps())
    assert again == state and again.latest == state.latest == [T0 + m * MIN for m in (1, 2, 3, 4, 5, 6, 7, 7, 8)]


def test_rows_of_small_batches_are_taken_together():
    import pandas as pd

    from risekit.plans import batch

    frames = [pd.DataFrame({"x": range(i, i + 3)}) for i in range(0, 21, 3)]
    taken = list(batch._gathered(iter(frames), 6))
    assert [len(f) for f in taken] == [6, 6, 6, 3] and [x for f in taken for x in f["x"]] == list(range(21))
    assert list(batch._gathered(iter([]))) == []


def test_columns_of_readings_keep_nulls_apart():
    from risekit.plans import batch

    out = batch.reading_columns([1] * 3, [T0, T0 + 5 * MIN, T0 + 6 * MIN], [0.0, 0.0, None], [None] * 3, {}, B)
    assert out["session_start"].dtype == np.dtype("datetime64[us]") and out["session_start"].view(np.int64).tolist()[:2] == [T0, T0] and np.isnat(out["session_start"][2])
    assert out["rise_raw"][0] == 0 and math.isnan(out["rise_raw"].to_numpy(np.float64, na_value=-1.0)[1]) and out["rise_raw"].isna().tolist() == [False, False, True]
    assert out["status"].tolist()[2] == "no_reading:measurement"
