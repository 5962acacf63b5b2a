"""Logistic growth fits by Nelder-Mead on the sum of squared errors, many at once.

A fit is a lane of numpy arrays: all lanes of a batch take their steps together, and lanes that have
settled leave it. What a lane finds doesn't depend on the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

TOLERANCE, MAX_ITERATIONS, MAX_LIMIT = 1e-8, 5000, 500.0
#: Samples, padding included, that a batch of lanes holds.
LANE_CELLS = 2_000_000


@dataclass(frozen=True)
class Fit:
    limit: float
    rate: float
    middle: float
    relative_error: float

    def hours_at_fraction(self, fraction: float) -> float:
        return self.middle - math.log(1.0 / fraction - 1.0) / self.rate


def squared_errors(p: np.ndarray, hours: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The objective of each lane (weight 0 pads a row); out of bounds it is infinite."""
    with np.errstate(over="ignore", invalid="ignore"):
        error = (p[:, :1] / (1.0 + np.exp(-p[:, 1:2] * (hours - p[:, 2:]))) - value) * weight
        total = np.einsum("ij,ij->i", error, error)
    return np.where((p[:, 0] > 0) & (p[:, 1] > 0), total, np.inf)


def nelder_mead(start: np.ndarray, hours: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and errors of the minima near start (lanes, 3): simplexes that reflect, expand, contract and shrink."""
    lanes, n = start.shape
    x = np.repeat(start[:, None], n + 1, axis=1)
    for i in range(n):
        x[:, i + 1, i] += np.where(start[:, i] != 0, 0.05 * start[:, i], 0.00025)
    f = np.stack([squared_errors(x[:, i], hours, value, weight) for i in range(n + 1)], axis=1)
    points, errors = np.empty_like(start), np.empty(lanes)
    lane = np.arange(lanes)  # which lanes the rows are
    for step in range(MAX_ITERATIONS + 1):
        # stable, and a new point stands last: of equal values the older goes first
        order = np.argsort(f, axis=1, kind="stable")
        f, x = np.take_along_axis(f, order, axis=1), np.take_along_axis(x, order[:, :, None], axis=1)
        best, worst = f[:, 0], f[:, -1]
        with np.errstate(invalid="ignore"):
            done = np.isfinite(worst) & (2 * np.abs(worst - best) <= TOLERANCE * (np.abs(worst) + np.abs(best) + 1e-10))
        if step == MAX_ITERATIONS:
            done[:] = True
        if done.any():
            points[lane[done]], errors[lane[done]] = x[done, 0], best[done]
            left = ~done
            lane, x, f, hours, value, weight = lane[left], x[left], f[left], hours[left], value[left], weight[left]
            if not len(lane):
                break
            best, worst = f[:, 0], f[:, -1]
        centre = x[:, :-1].mean(axis=1)
        away = centre - x[:, -1]
        p = centre + away
        v = squared_errors(p, hours, value, weight)
        better, taken = v < best, v < f[:, -2]
        again = np.flatnonzero(better | ~taken)
        if len(again):
            reach = np.where(better[again], 2.0, np.where(v[again] < worst[again], 0.5, -0.5))
            q = centre[again] + reach[:, None] * away[again]
            w = squared_errors(q, hours[again], value[again], weight[again])
            use = np.where(better[again], w < v[again], w < np.minimum(v[again], worst[again]))
            p[again[use]], v[again[use]] = q[use], w[use]
            taken[again[use]] = True
        x[taken, -1], f[taken, -1] = p[taken], v[taken]
        small = np.flatnonzero(~taken)
        if len(small):
            for i in range(1, n + 1):
                x[small, i] = x[small, 0] + 0.5 * (x[small, i] - x[small, 0])
                f[small, i] = squared_errors(x[small, i], hours[small], value[small], weight[small])
    return points, errors


def _padded(rows: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def descend(starts: Sequence[Sequence[float]], hours: Sequence[np.ndarray], values: Sequence[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Nelder-Mead's (point, error) for each start and its samples, in batches of lanes of about one length."""
    out: list = [None] * len(starts)
    order = sorted(range(len(starts)), key=lambda i: -len(values[i]))
    at = 0
    while at < len(order):
        lanes = order[at : at + max(1, LANE_CELLS // len(values[order[at]]))]
        at += len(lanes)
        weight = _padded([np.ones(len(values[i])) for i in lanes])
        points, errors = nelder_mead(np.array([starts[i] for i in lanes], np.float64), _padded([hours[i] for i in lanes]), _padded([values[i] for i in lanes]), weight)
        for i, p, e in zip(lanes, points, errors):
            out[i] = (p, float(e))
    return out


def fittable(value: np.ndarray) -> bool:
    return len(value) >= 5 and bool(value.max() >= 5)


def first_start(hours: np.ndarray, value: np.ndarray) -> tuple[float, float, float]:
    return max(1.5 * float(value.max()), 30.0), 1.0, max(float(hours[-1]), 1.0)


def sound(found: Sequence[tuple[np.ndarray, float]], samples: int) -> Fit | None:
    """The best of what several starts found, of those within bounds."""
    best, least = None, math.inf
    for p, error in found:
        if p[0] > 0 and p[1] > 0 and p[0] <= MAX_LIMIT and not np.isnan(p).any() and error < least:
            best, least = p, error
    return None if best is None else Fit(float(best[0]), float(best[1]), float(best[2]), math.sqrt(least / samples) / float(best[0]))


def fit_many(hours: Sequence[np.ndarray], values: Sequence[np.ndarray], before: Sequence[Fit | None] | None = None) -> list[Fit | None]:
    """Best logistics, each over hours since its first sample; None where there is too little to fit or none is sound.

    A fit starts from the samples' own range and, where there is one, from the fit before. A simplex
    may shrink before its error is level, so what is found is the start of another one.
    """
    before = [None] * len(values) if before is None else before
    starts, lanes, at = [], [], []
    for i, (h, v) in enumerate(zip(hours, values)):
        if fittable(v):
            h = h - h[0]
            for s in [first_start(h, v)] + ([] if before[i] is None else [(before[i].limit, before[i].rate, before[i].middle)]):
                starts.append(s)
                lanes.append((h, v))
                at.append(i)
    found: list[list] = [[] for _ in values]
    once = descend(starts, [h for h, _ in lanes], [v for _, v in lanes])
    again = [(k, p) for k, (p, _) in enumerate(once) if p[0] > 0 and p[1] > 0 and np.isfinite(p).all()]
    twice = descend([p for _, p in again], [lanes[k][0] for k, _ in again], [lanes[k][1] for k, _ in again])
    for i, r in [*zip(at, once), *((at[k], r) for (k, _), r in zip(again, twice))]:
        found[i].append(r)
    return [sound(f, len(v)) for f, v in zip(found, values)]


def fit(hours: np.ndarray, value: np.ndarray, before: Fit | None = None) -> Fit | None:
    """fit_many of one."""
    return fit_many([hours], [value], [before])[0]
