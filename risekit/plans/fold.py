"""The per-series fold: measurements in order of time, one state, one reading or none for each.

Gates, sessions, collapses and the peak latch depend on which earlier rows were accepted, so no
window expresses them. Gates and sessions don't depend on fits: rows are first taken into their
sessions, and what a fit decides is filled in afterwards, with the fits of many sessions at once.
The state holds one session at most, whose length the options bound, and is shared by the batch and
the streaming plan.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from itertools import accumulate
from statistics import median

import numpy as np

from risekit.options import AnalysisOptions
from risekit.plans.sigmoid import Fit, descend, first_start, fittable, sound

US_PER_MINUTE, US_PER_HOUR = 60_000_000, 3_600_000_000
#: A fit whose peak lies further off has no peak time.
MAX_ETA_HOURS = 1_000_000
#: Stands for a null time.
NO_TIME = -(1 << 63)
#: Rows of each session whose fits are prepared together.
FIT_ROWS = 32


@dataclass
class State:
    """Times are microseconds since 1970."""

    heights: list[float] = field(default_factory=list)
    samples: list[tuple[int, float]] = field(default_factory=list)
    slopes: list[tuple[int, float]] = field(default_factory=list)
    baseline: float | None = None
    session_start: int = 0
    peaked: bool = False
    last_fit: Fit | None = None
    accepted_height: float | None = None
    accepted_time: int | None = None
    rejects: int = 0
    collapses: int = 0
    #: The latest time among the samples up to each, for late ones may follow.
    latest: list[int] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        self.latest = list(accumulate((t for t, _ in self.samples), max))

    def dumps(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "latest"})

    @classmethod
    def loads(cls, text: str) -> State:
        d = json.loads(text)
        d["last_fit"] = Fit(**d["last_fit"]) if d["last_fit"] else None
        for k in ("samples", "slopes"):
            d[k] = [tuple(x) for x in d[k]]
        return cls(**d)

    def saved(self) -> State:
        """What a state file keeps: the session; the last accepted pair comes back from its last sample."""
        s = State(samples=list(self.samples), slopes=list(self.slopes), baseline=self.baseline, session_start=self.session_start, peaked=self.peaked)
        if s.samples and s.baseline is not None:
            s.accepted_time = s.samples[-1][0]
            s.accepted_height = s.baseline * (1 + s.samples[-1][1] / 100.0)
        return s

    def open(self, time: int, baseline: float | None) -> None:
        """A new session; the reject streak and the last accepted pair live on."""
        self.samples, self.latest, self.slopes, self.heights = [], [], [], []
        self.baseline, self.session_start = baseline, time
        self.peaked, self.last_fit, self.collapses = False, None, 0


@dataclass(frozen=True)
class Reading:
    status: str
    rise_percent: float | None = None
    rise_rate: float | None = None
    predicted_peak_percent: float | None = None
    peak_eta: int | None = None
    peaked: bool = False
    new_session: bool = False
    session_start: int | None = None
    smoothed: float | None = None
    rise_raw: float | None = None


@dataclass(frozen=True)
class Draft:
    """A sample of a session, whose fit and peak are still to be decided."""

    samples: list[tuple[int, float]]  # the session's; count of them up to this one
    count: int
    session_start: int
    smoothed: float
    rise: float
    slope: float | None
    flat: bool  # the last slopes are
    top: float  # the largest rise so far, where they are


def rounded(x: float, low: float, high: float, digits: int) -> float:
    """x within bounds, rounded half-even as functions.rise.rounded does it."""
    return x if math.isnan(x) else float(np.rint(min(max(x, low), high) * 10.0**digits)) / 10.0**digits


def _slope(samples: list[tuple[int, float]], latest: list[int], now: int, minutes: float) -> float | None:
    """The regression slope over the samples of the last minutes; late ones may stand between them."""
    window = []
    for (t, r), last in zip(reversed(samples), reversed(latest)):
        if (now - last) / US_PER_MINUTE > minutes:
            break
        if (now - t) / US_PER_MINUTE <= minutes:
            window.append((t, r))
    if len(window) < 4:
        return None
    window.reverse()
    x = np.array([(t - window[0][0]) / US_PER_HOUR for t, _ in window])
    y = np.array([r for _, r in window])
    dx = x - x.mean()
    spread = float(dx @ dx)
    return float(dx @ (y - y.mean())) / spread if spread else math.nan


def reset(state: State, now: int) -> Reading:
    """A manual reset: no session until the next measurement."""
    state.open(0, None)
    return Reading("ok", rise_percent=0.0, new_session=True)


def advance(state: State, time: int, height: float | None, options: AnalysisOptions) -> Reading | Draft:
    """Take a measurement into the state: a reading where no fit matters, else a draft.

    status is ok, or no_reading with the reason after a colon. A row without a time or a
    measurement leaves the state alone.
    """
    o = options
    if time == NO_TIME:
        return Reading("no_reading:time")
    if height is None:
        return Reading("no_reading:measurement")
    expired = bool(state.samples) and (time - state.session_start) / US_PER_HOUR > o.max_session_hours
    active = state.baseline is not None and not expired
    if active and state.accepted_height is not None and state.accepted_time is not None:
        minutes = (time - state.accepted_time) / US_PER_MINUTE
        if minutes <= 0 or abs(height - state.accepted_height) > o.max_rise_px_per_minute * minutes + o.jitter_tolerance_px:
            state.rejects += 1
            if state.rejects <= o.max_implausible_jump_rejects:
                return Reading("no_reading:implausible")
    state.rejects = 0
    state.heights = [*state.heights, height][-o.median_window_size :]
    smoothed = median(state.heights)
    state.accepted_height, state.accepted_time = smoothed, time
    if not active:
        state.open(time, smoothed)
        return Reading("ok", rise_percent=0.0, new_session=True, session_start=time, smoothed=smoothed, rise_raw=0.0)
    rise = (smoothed - state.baseline) / state.baseline * 100.0 if state.baseline else math.nan
    if len(state.samples) >= 5:
        recent = median(r for _, r in state.samples[-5:])
        if recent > 20 and rise < recent * (1 - o.reset_drop_fraction):
            state.collapses += 1
            if state.collapses < o.collapse_confirm_samples:
                return Reading("no_reading:collapse", smoothed=smoothed, rise_raw=rise)
            state.open(time, smoothed)
            return Reading("ok", rise_percent=0.0, new_session=True, session_start=time, smoothed=smoothed, rise_raw=0.0)
    state.collapses = 0
    state.samples.append((time, rise))
    state.latest.append(max(time, state.latest[-1] if state.latest else time))
    slope = _slope(state.samples, state.latest, time, o.slope_window_minutes)
    if slope is not None:
        state.slopes.append((time, slope))
    n = o.peak_confirm_windows
    flat = slope is not None and not state.peaked and len(state.slopes) >= n and all(s <= o.flat_slope_percent_per_hour for _, s in state.slopes[-n:])
    top = max(r for _, r in state.samples) if flat else math.nan
    return Draft(state.samples, len(state.samples), state.session_start, smoothed, rise, slope, flat, top)


def judged(draft: Draft, found: Fit | None, peaked: bool, options: AnalysisOptions) -> Reading:
    """The reading of a draft, given its fit and whether its session had its peak before."""
    o = options
    if draft.flat and not peaked:
        peaked = (found is not None and draft.top >= found.limit * o.peak_fraction) or draft.top >= o.min_rise_percent_for_peak
    eta = None
    if found is not None:
        hours = found.hours_at_fraction(o.peak_fraction)
        if abs(hours) <= MAX_ETA_HOURS:
            eta = draft.session_start + round(hours * US_PER_HOUR)
    return Reading(
        "ok",
        rise_percent=rounded(draft.rise, 0.0, 500.0, 1),
        rise_rate=None if draft.slope is None else rounded(draft.slope, -100.0, 500.0, 1),
        predicted_peak_percent=None if found is None else rounded(found.limit * o.peak_fraction, 0.0, 500.0, 0),
        peak_eta=eta,
        peaked=peaked,
        session_start=draft.session_start,
        smoothed=draft.smoothed,
        rise_raw=draft.rise,
    )


class _Session:
    """The drafts of one session, what was known before the first, and its samples as arrays."""

    def __init__(self, state: State):
        self.state, self.samples = state, state.samples
        self.peaked, self.last_fit = state.peaked, state.last_fit
        self.drafts: list[tuple[int, Draft]] = []

    def ready(self) -> None:
        self.hours = np.array([t for t, _ in self.samples], np.float64) / US_PER_HOUR
        self.hours -= self.hours[0]
        self.values = np.array([r for _, r in self.samples])

    def wanted(self, i: int, options: AnalysisOptions) -> int:
        """Samples to fit for the i-th draft; 0 for none."""
        if self.peaked or i >= len(self.drafts):
            return 0
        n = self.drafts[i][1].count
        return n if n >= options.min_samples_for_fit and fittable(self.values[:n]) else 0


def take_rows(rows: Sequence[tuple], states: dict, options: AnalysisOptions) -> list[Reading]:
    """Readings of rows (series, time, height, kind) in order; states is by series and is updated.

    Sessions go side by side: the first fits of all, then the second ones, and so on, as a fit
    starts from the one before and ends with the peak.
    """
    out: list[Reading | None] = [None] * len(rows)
    sessions: dict[int, _Session] = {}
    for i, (series, time, height, kind) in enumerate(rows):
        state = states.get(series)
        if state is None:
            state = states[series] = State()
        r = reset(state, time) if kind == "reset" else advance(state, time, height, options)
        if isinstance(r, Draft):
            if id(r.samples) not in sessions:  # the drafts keep the list alive
                sessions[id(r.samples)] = _Session(state)
            sessions[id(r.samples)].drafts.append((i, r))
        else:
            out[i] = r
    fitting = [s for s in sessions.values() if not s.peaked and s.drafts[-1][1].count >= options.min_samples_for_fit]
    for s in fitting:
        s.ready()
    for begin in range(0, max((len(s.drafts) for s in sessions.values()), default=0), FIT_ROWS):
        steps = range(begin, begin + FIT_ROWS)
        lanes = [(s, i, n) for s in fitting for i in steps if (n := s.wanted(i, options))]
        first = descend([first_start(s.hours[:n], s.values[:n]) for s, _, n in lanes], [s.hours[:n] for s, _, n in lanes], [s.values[:n] for s, _, n in lanes])
        found = {(id(s), i): [r] for (s, i, _), r in zip(lanes, first)}
        for i in steps:
            again = [(s, n) for s in fitting if s.last_fit is not None and (n := s.wanted(i, options))]
            warm = descend([(s.last_fit.limit, s.last_fit.rate, s.last_fit.middle) for s, _ in again], [s.hours[:n] for s, n in again], [s.values[:n] for s, n in again])
            for (s, _), r in zip(again, warm):
                found[id(s), i].append(r)
            for s in sessions.values():
                if i >= len(s.drafts):
                    continue
                row, draft = s.drafts[i]
                best = None if s.peaked else sound(found.get((id(s), i), []), draft.count)
                if best is not None and best.relative_error > options.max_eta_relative_std_error:
                    best = None
                s.last_fit = best or s.last_fit
                out[row] = judged(draft, best, s.peaked, options)
                s.peaked = out[row].peaked
    for s in sessions.values():
        if s.state.samples is s.samples:
            s.state.peaked, s.state.last_fit = s.peaked, s.last_fit
    return out


def step(state: State, time: int, height: float | None, options: AnalysisOptions) -> Reading:
    """Take one measurement into a state."""
    return take_rows([(0, time, height, None)], {0: state}, options)[0]


def restored(state: State, options: AnalysisOptions, now: int) -> State:
    """The state after a restart: all of it, or with legacy_restore what a state file keeps, unless expired by now."""
    if not options.legacy_restore:
        return replace(state)
    s = state.saved()
    if s.samples and (now - s.session_start) / US_PER_HOUR > options.max_session_hours:
        s.open(0, None)
    return s
