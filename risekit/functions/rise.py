"""Column builders of the rise formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from risekit.options import AnalysisOptions

MIN_RISE, MAX_RISE = 0.0, 500.0
MIN_RATE, MAX_RATE = -100.0, 500.0


def height(top: Column, bottom: Column) -> Column:
    return bottom - top


def rise_percent(value: Column, baseline: Column) -> Column:
    """Rise over a baseline in per cent; null over a baseline of 0."""
    return F.try_divide(value - baseline, baseline) * 100.0


def clamp(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; a null and a NaN stay what they are."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def rounded(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the double that c times a power of ten is, as DuckDB's round_even and numpy do it.

    (bround rounds the shortest decimal that names c, which at ties may be another one.)
    """
    scale = F.lit(10.0**digits)
    return F.rint((F.col(c) if isinstance(c, str) else c).cast("double") * scale) / scale


def shown_rise(c: Column) -> Column:
    return rounded(clamp(c, MIN_RISE, MAX_RISE), 1)


def shown_rate(c: Column) -> Column:
    return rounded(clamp(c, MIN_RATE, MAX_RATE), 1)


def predicted_peak(limit: Column, fraction: float = AnalysisOptions.peak_fraction) -> Column:
    return rounded(clamp(limit * fraction, MIN_RISE, MAX_RISE), 0)


def logistic(hours: Column, limit: Column, rate: Column, middle: Column) -> Column:
    return limit / (1.0 + F.exp(-rate * (hours - middle)))


def hours_at_fraction(rate: Column, middle: Column, fraction: float = AnalysisOptions.peak_fraction) -> Column:
    """When the logistic reaches a fraction of its limit."""
    return middle - F.log(F.lit(1.0 / fraction - 1.0)) / rate


def after_hours(start: Column, hours: Column) -> Column:
    """start plus fractional hours, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(start) + F.rint(hours * 3_600_000_000.0).cast("long"))


def squared_error(hours: Column, value: Column, limit: Column, rate: Column, middle: Column) -> Column:
    """Aggregate: sum of squared errors of a logistic; the largest double where limit or rate isn't positive."""
    error = F.sum(F.pow(logistic(hours, limit, rate, middle) - value, F.lit(2.0)))
    return F.when((F.max(limit) <= 0) | (F.max(rate) <= 0), F.lit(1.7976931348623157e308)).otherwise(error)


def auto_threshold(median: Column, relax: float = 1.0) -> tuple[Column, Column]:
    """Lower and upper edge thresholds from an intensity median."""
    lower = F.greatest(F.lit(10.0), median * 0.66 * relax)
    return lower, F.greatest(lower + 20.0, median * 1.33)


def session_line(top: Column, bottom: Column, baseline: Column) -> Column:
    """Row at which the surface stood when the session began."""
    return F.rint(top + bottom - baseline)


def inset(width: Column) -> Column:
    return F.greatest(F.lit(3), F.floor(width / 10)).cast("int")


def fallback_column(width: Column, height_: Column) -> dict[str, Column]:
    """Column to search when no walls are found."""
    mx, my = F.greatest(F.lit(3), F.floor(width / 20)), F.greatest(F.lit(2), F.floor(height_ / 30))
    return {"left": mx.cast("int"), "right": (width - mx).cast("int"), "top": my.cast("int"), "bottom": (height_ - my).cast("int")}
