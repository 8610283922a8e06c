"""Nadir BRDF adjustment: kernel-driven c-factors as columns (Ross-Thick, Li-Sparse-Reciprocal; Roy et al. 2016)."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.pixels import lerp

# Published isotropic, volumetric and geometric weights for each band.
KERNEL_WEIGHTS = {
    "B02": (0.0774, 0.0372, 0.0079),
    "B03": (0.1306, 0.0580, 0.0178),
    "B04": (0.1690, 0.0574, 0.0227),
    "B05": (0.2085, 0.0845, 0.0256),
    "B06": (0.2316, 0.1003, 0.0273),
    "B07": (0.2599, 0.1197, 0.0294),
    "B08": (0.3093, 0.1535, 0.0330),
    "B11": (0.3430, 0.1154, 0.0453),
    "B12": (0.2658, 0.0639, 0.0387),
}


def volumetric(sun: Column, view: Column, azimuth: Column) -> Column:
    """Ross-Thick kernel; angles in radians, azimuth relative."""
    cos_xi = F.cos(sun) * F.cos(view) + F.sin(sun) * F.sin(view) * F.cos(azimuth)
    cos_xi = F.least(F.greatest(cos_xi, F.lit(-1.0)), F.lit(1.0))
    xi = F.acos(cos_xi)
    return ((F.lit(math.pi / 2) - xi) * cos_xi + F.sin(xi)) / (F.cos(sun) + F.cos(view)) - math.pi / 4


def geometric(sun: Column, view: Column, azimuth: Column) -> Column:
    """Li-Sparse-Reciprocal kernel for spherical crowns (b/r = 1) and h/b = 2."""
    cos_xi = F.cos(sun) * F.cos(view) + F.sin(sun) * F.sin(view) * F.cos(azimuth)
    ts, tv = F.tan(sun), F.tan(view)
    distance = ts * ts + tv * tv - 2 * ts * tv * F.cos(azimuth)
    sec = 1 / F.cos(sun) + 1 / F.cos(view)
    side = F.sqrt(F.greatest(distance + (ts * tv * F.sin(azimuth)) ** 2, F.lit(0.0)))
    t = F.acos(F.least(F.greatest(2 * side / sec, F.lit(-1.0)), F.lit(1.0)))
    overlap = (t - F.sin(t) * F.cos(t)) * sec / math.pi
    return overlap - sec + (1 + cos_xi) / (F.cos(sun) * F.cos(view)) / 2


def modelled(band: str, sun: Column, view: Column, azimuth: Column) -> Column:
    iso, vol, geo = KERNEL_WEIGHTS[band]
    return iso + vol * volumetric(sun, view, azimuth) + geo * geometric(sun, view, azimuth)


def c_factor(band: str, sun: Column, view: Column, azimuth: Column) -> Column:
    """Modelled reflectance seen from nadir by the modelled reflectance as seen; angles in degrees."""
    sun, view, azimuth = F.radians(sun), F.radians(view), F.radians(azimuth)
    return modelled(band, sun, F.lit(0.0), F.lit(0.0)) / modelled(band, sun, view, azimuth)


def adjusted(v: Column, c: Column) -> Column:
    """Bands without a factor, and places without one, stay as they are."""
    return v * F.coalesce(c, F.lit(1.0))


def interpolated(pixels: DataFrame, factors: DataFrame, on: Sequence[str], step: int, x: str = "x", y: str = "y") -> DataFrame:
    """pixels with c, linear between the factors (on, cx, cy, c) that lie every step pixels from the top left, and beyond the last ones; NULL without a factor.

    The four corners of a cell are brought together in the coarse grid, so pixels are joined once.
    """
    grid = factors.select(*on, "cx", "cy", "c")
    cells = grid.select(*on, F.col("cx").alias("_ix"), F.col("cy").alias("_iy"), F.col("c").alias("_c00"))
    for name, i, j in (("_c10", 1, 0), ("_c01", 0, 1), ("_c11", 1, 1)):
        cells = cells.join(grid.select(*on, (F.col("cx") - i).alias("_ix"), (F.col("cy") - j).alias("_iy"), F.col("c").alias(name)), [*on, "_ix", "_iy"])
    last = [F.max("cx").alias("_lx"), F.max("cy").alias("_ly")]
    ends = grid.groupBy(*on).agg(*last) if on else grid.agg(*last)
    met = pixels.join(ends, list(on), "left") if on else pixels.crossJoin(F.broadcast(ends))  # one row
    low = lambda c, end: F.least(F.floor(F.col(c) / step), F.col(end) - 1).cast("long")
    met = met.withColumn("_ix", low(x, "_lx")).withColumn("_iy", low(y, "_ly")).join(cells, [*on, "_ix", "_iy"], "left")
    x0, y0 = F.col("_ix") * step, F.col("_iy") * step
    row = lambda a, b: lerp(F.col(x), x0, F.col(a), x0 + step, F.col(b))
    return met.select(*pixels.columns, lerp(F.col(y), y0, row("_c00", "_c10"), y0 + step, row("_c01", "_c11")).alias("c"))
