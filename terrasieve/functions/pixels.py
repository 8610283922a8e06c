"""Pixel arithmetic as columns. NoData is SQL NULL inside the engine; raw products mark it with 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasieve import constants as C


def no_data(v: Column) -> Column:
    """Raw 0 and NaN are NoData."""
    return F.nullif(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def zero_filled(v: Column) -> Column:
    return F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def harmonised(v: Column, baseline: Column) -> Column:
    """Digital numbers of newer baselines lose their offset; what lies at or below it becomes 0."""
    shifted = F.greatest(v, F.lit(float(C.BASELINE_OFFSET))) - C.BASELINE_OFFSET
    return F.when(baseline >= C.BASELINE_OFFSET_FROM, shifted).otherwise(v)


def reflectance(v: Column) -> Column:
    return v / float(C.REFLECTANCE)


def snow_index(green: Column, swir: Column) -> Column:
    """Normalised difference; NULL for 0/0."""
    g, s = reflectance(green), reflectance(swir)
    return F.try_divide(g - s, g + s)


def clear_of_snow(b03: Column, b08: Column, b11: Column) -> Column:
    """False where snow is likely; unknown counts as clear."""
    snow = (snow_index(b03, b11) > C.SNOW_NDSI) & (reflectance(b08) > C.SNOW_NIR) & (reflectance(b03) > C.SNOW_GREEN)
    return ~F.coalesce(snow, F.lit(False))


def softmax(logits: Column) -> Column:
    powers = lambda m: F.transform(logits, lambda x: F.exp(x - m))
    top = F.array_max(logits)
    total = F.aggregate(powers(top), F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers(top), lambda x: x / total)


def cloud_class(probabilities: Column) -> Column:
    """Index of the largest probability, the first of equal ones; 0 (clear) where there is none."""
    return F.coalesce(F.array_position(probabilities, F.array_max(probabilities)) - 1, F.lit(0)).cast("int")


def masked(v: Column, keep: Column) -> Column:
    return F.when(keep, v)


def all_or_none(values: Sequence[Column]) -> list[Column]:
    """Each value, or NULL for all where one is NoData."""
    bad = F.lit(False)
    for v in values:
        bad = bad | v.isNull()
    return [F.when(~bad, v) for v in values]


def s1_band(polarisation: Column, orbit_state: Column) -> Column:
    """Such as vv_asc; NULL for an unknown orbit."""
    short = F.when(F.lit(False), "")
    for state, name in C.ORBITS.items():
        short = short.when(orbit_state == state, name)
    return F.concat(polarisation, F.lit("_"), short)


def coordinate(origin: float | Column, index: Column, step: float) -> Column:
    return F.lit(origin) + index * F.lit(float(step))


def uint16(v: Column) -> Column:
    """Half-even rounding, clipped; NoData is 0. Spark has no unsigned 16-bit type, so it is an int."""
    return F.least(F.greatest(F.rint(zero_filled(v)), F.lit(0.0)), F.lit(65535.0)).cast("int")


def source_index(index: Column, factor: int) -> Column:
    """Index in a band of coarser native resolution, for nearest upsampling."""
    return F.floor(index / factor).cast("long")


def lerp(at: Column, x0: Column, v0: Column, x1: Column, v1: Column) -> Column:
    """The straight line through two points, also beyond them."""
    return v0 + (at - x0) * (v1 - v0) / (x1 - x0)
