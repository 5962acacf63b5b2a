"""Row-profile operators on array columns: no shuffle, one row per frame in and out.

A profile is an array of numbers by pixel row. Positions are 0-based; ties go to the first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risekit.functions.once import once

MIN_STEP_CONTRAST = 55.0


def doubles(profile: Column) -> Column:
    """Sums are taken in double precision, whatever the profile's type."""
    return profile.cast("array<double>")


def range_mean(values: Column, start: Column, end: Column) -> Column:
    """Mean of values[start..end], both included; values[start] where end is before start."""
    part = F.slice(values, start + 1, F.greatest(end - start + 1, F.lit(0)))
    mean = F.try_divide(F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x), F.size(part).cast("double"))
    return F.when(end < start, F.get(values, start)).otherwise(mean)


def moving_average(values: Column, window: int) -> Column:
    """Centred mean over window rows, cut off at both ends."""
    half = window // 2

    def of(v: Column) -> Column:
        last = F.size(v) - 1
        return F.transform(v, lambda _, i: range_mean(v, F.greatest(i - half, F.lit(0)), F.least(i + half, last)))

    return once(values, of)


def _at(values: Column, i: Column) -> Column:
    return F.get(values, i.cast("int"))


def _neighbours(s: Column, y: Column) -> tuple[Column, Column, Column]:
    here = _at(s, y)
    return here, F.when(y > 0, _at(s, y - 1)).otherwise(here), F.coalesce(_at(s, y + 1), here)


def _rows(start: Column, stop: Column) -> Column:
    """start .. stop - 1; empty where stop isn't larger."""
    return F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))


def _best(rows: Column, score) -> Column:
    """(score, -row) of the best row; null for no rows."""
    return F.array_max(F.transform(rows, lambda y: F.struct(score(y).alias("score"), (-y).alias("minus"))))


def edge_surface(df: DataFrame, energy: str, out: str = "surface") -> DataFrame:
    """Row of the surface in an edge-energy profile; null where it is empty or has no energy."""
    s = F.col("__s")
    df = df.withColumn("__s", moving_average(doubles(F.col(energy)), 5)).withColumn("__n", F.size("__s"))
    start = F.floor(F.col("__n") * 0.10).cast("int")
    df = df.withColumn("__a", start).withColumn("__z", F.greatest(F.col("__a") + 1, F.floor(F.col("__n") * 0.90).cast("int")))
    a, z = F.col("__a"), F.col("__z")
    df = df.withColumn("__top", F.array_max(s)).withColumn("__base", range_mean(s, a, F.least(z, F.col("__n")) - 1))
    base = F.col("__base")
    floor = base + (F.col("__top") - base) * 0.20
    span = F.greatest(F.lit(1), z - a)

    def score(w_base: float, w_prom: float, w_depth: float):
        def of(y: Column) -> Column:
            here, left, right = _neighbours(s, y)
            return (here - base) * w_base + (here - F.least(left, right)) * w_prom + (y - a) / span * w_depth

        return of

    rows = _rows(a, z)
    strong = F.filter(rows, lambda y: _at(s, y) >= floor)
    best = F.coalesce(_best(strong, score(1.2, 0.8, 0.25)), _best(rows, score(0.8, 0.4, 0.15)))
    df = df.withColumn(out, F.when((F.col("__n") > 0) & (F.col("__top") > 0), -best["minus"]).cast("int"))
    return df.drop("__s", "__n", "__a", "__z", "__top", "__base")


def band_top(df: DataFrame, intensity: str, out: str = "band_top", contrast: str = "band_contrast") -> DataFrame:
    """Top row of the dark band under a bright region, and its step contrast (0 where there is none)."""
    s, n, p = F.col("__s"), F.col("__n"), F.col("__p")
    df = df.withColumn("__s", moving_average(doubles(F.col(intensity)), 7)).withColumn("__n", F.size("__s"))
    a = F.greatest(F.lit(1), F.floor(n * 0.05).cast("int"))
    z = F.least(n - 1, F.floor(n * 0.95).cast("int"))
    running = F.aggregate(s, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), acc), -1), F.lit(0.0)) + x)))
    df = df.withColumn("__p", running).withColumn("__a", a).withColumn("__z", z)
    a, z = F.col("__a"), F.col("__z")
    total = F.get(p, n - 1)
    inside = F.slice(s, a + 1, F.greatest(z - a, F.lit(0)))
    usable = (n >= 10) & (z - a >= 5) & (F.array_max(inside) - F.array_min(inside) >= MIN_STEP_CONTRAST)
    reach = F.greatest(F.lit(2), F.floor(n / 20).cast("int"))

    def step(y: Column) -> Column:
        # the sums include row y itself, and the divisors don't
        return _at(p, y) / y - (total - _at(p, y)) / (n - y)

    def score(y: Column) -> Column:
        _, left, right = _neighbours(s, y)
        first = F.greatest(F.lit(0), y - reach)
        before = range_mean(s, first, F.greatest(first, y - 1))
        after = range_mean(s, F.least(n - 1, y + 1), F.least(n - 1, y + reach))
        return step(y) * 1.1 + F.greatest(F.lit(0.0), before - after) * 0.8 + F.greatest(F.lit(0.0), left - right) * 0.25

    rows = F.when(usable, _rows(a, z)).otherwise(F.array().cast("array<int>"))
    scored = F.transform(rows, lambda y: F.struct(score(y).alias("score"), (-y).alias("minus"), step(y).alias("step")))
    df = df.withColumn("__scored", scored).withColumn("__best", F.array_max("__scored"))
    found = F.col("__best.step") >= MIN_STEP_CONTRAST
    early = F.filter("__scored", lambda x: (-x["minus"] <= -F.col("__best.minus")) & (x["score"] >= F.col("__best.score") * 0.85))
    first = F.coalesce(-F.get(early, F.lit(0))["minus"], -F.col("__best.minus"))
    df = df.withColumn(out, F.when(found, first).cast("int")).withColumn(contrast, F.when(found, F.col("__best.step")).otherwise(F.lit(0.0)))
    return df.drop("__s", "__n", "__p", "__a", "__z", "__scored", "__best")


def combined_surface(df: DataFrame, energy: str, intensity: str) -> DataFrame:
    """surface, method (band, edge or none), band_top and band_contrast.

    A band's top is snapped to the strongest edge near it; without a band the edge surface counts.
    """
    df = edge_surface(band_top(df, intensity), energy, "__edge")
    df = df.withColumn("__e", doubles(F.col(energy)))
    e = F.col("__e")
    reach = F.greatest(F.lit(3), F.floor(F.size(e) * 3 / 100).cast("int"))
    first = F.greatest(F.lit(0), F.col("band_top") - reach)
    rows = _rows(first, F.least(F.size(e) - 1, F.col("band_top") + reach) + 1)
    peak = _best(rows, lambda y: _at(e, y))
    snapped = F.when(peak["score"] > 0, -peak["minus"]).otherwise(F.col("band_top"))
    has_band = F.col("band_top").isNotNull() & (F.col("band_contrast") >= MIN_STEP_CONTRAST)
    df = df.withColumn("surface", F.when(has_band, snapped).otherwise(F.col("__edge")).cast("int"))
    method = F.when(has_band, "band").when(F.col("__edge").isNotNull(), "edge").otherwise("none")
    return df.withColumn("method", method).drop("__edge", "__e")


def bottom_from_energy(df: DataFrame, energy: str, fallback: str, top: str, out: str = "bottom") -> DataFrame:
    """Row of the lower edge below a surface; the fallback where the window is flat or empty."""
    s, n = F.col("__s"), F.col("__n")
    df = df.withColumn("__s", moving_average(doubles(F.col(energy)), 5)).withColumn("__n", F.size("__s"))
    start = F.greatest(F.lit(0), F.coalesce(F.col(top), F.lit(0)) + 1, F.floor(n * 0.35).cast("int"))
    df = df.withColumn("__a", start).withColumn("__z", F.greatest(F.col("__a") + 1, F.least(n - 1, F.col(fallback))))
    a, z = F.col("__a"), F.col("__z")
    window = F.slice(s, a + 1, F.greatest(F.lit(1), z - a + 1))
    df = df.withColumn("__w", window)
    mean = F.try_divide(F.aggregate("__w", F.lit(0.0), lambda acc, x: acc + x), F.size("__w").cast("double"))
    df = df.withColumn("__base", mean)
    span = F.greatest(F.lit(1), z - a + 1)

    def score(y: Column) -> Column:
        here, left, right = _neighbours(s, y)
        return (here - F.col("__base")) * 1.35 + (here - F.least(left, right)) * 0.75 + (z - y) / span * 0.15 - (y - a) / span * 0.05

    usable = (n > 0) & (F.size("__w") > 0) & (F.array_max("__w") > F.col("__base"))
    best = _best(_rows(a, F.least(z, n - 1) + 1), score)
    df = df.withColumn(out, F.when(usable, F.coalesce(-best["minus"], F.col(fallback))).otherwise(F.col(fallback)).cast("int"))
    return df.drop("__s", "__n", "__a", "__z", "__w", "__base")


def shift_rows(df: DataFrame, columns: list[str], roi_y: Column) -> DataFrame:
    """Row coordinates moved down by the region's offset."""
    return df.withColumns({c: F.col(c) + F.coalesce(roi_y, F.lit(0)) for c in columns})


def crop(df: DataFrame, roi: dict[str, int | None], x: str = "x", y: str = "y") -> DataFrame:
    """Pixels inside a region; all of them unless all four of its fields are set."""
    if any(roi.get(k) is None for k in ("x", "y", "width", "height")):
        return df
    return df.where((F.col(x) >= roi["x"]) & (F.col(x) < roi["x"] + roi["width"]) & (F.col(y) >= roi["y"]) & (F.col(y) < roi["y"] + roi["height"]))
