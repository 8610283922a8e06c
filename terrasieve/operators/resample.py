"""Resampling between grids as joins on computed source indices."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.plans.grid import Transform


def target_pixels(like: DataFrame, to: Transform, at: Transform) -> DataFrame:
    """tx, ty with sx, sy: the real-valued place of the target pixel's center in source pixels (centers at whole numbers), and its size ux, uy in them."""
    x = F.lit(to.left) + (F.col("tx") + 0.5) * F.lit(to.res)
    y = F.lit(to.top) - (F.col("ty") + 0.5) * F.lit(to.res)
    size = F.lit(float(to.res) / float(at.res))
    return like.withColumn("sx", (x - at.left) / at.res - 0.5).withColumn("sy", (F.lit(at.top) - y) / at.res - 0.5).withColumn("ux", size).withColumn("uy", size)


def nearest(source: DataFrame, targets: DataFrame, image: list[str], value: str = "value", on: Sequence[str] = ()) -> DataFrame:
    """Each target pixel gets the source pixel it lies in: an equality join, on more columns too where targets differ by them."""
    found = targets.withColumn("x", F.floor(F.col("sx") + 0.5).cast("long")).withColumn("y", F.floor(F.col("sy") + 0.5).cast("long"))
    return source.join(found, [*on, "x", "y"]).select(*image, "tx", "ty", value)


def _bilinear(d: Column) -> Column:
    return 1 - d


def _cubic(d: Column) -> Column:
    return F.when(d < 1, (1.5 * d - 2.5) * d * d + 1).otherwise(((2.5 - 0.5 * d) * d - 4) * d + 2)


def _cubic_spline(d: Column) -> Column:
    return F.when(d < 1, (0.5 * d - 1) * d * d + F.lit(2 / 3)).otherwise((2 - d) * (2 - d) * (2 - d) / 6)


def _lanczos(d: Column) -> Column:
    p = d * math.pi
    return F.when(d < 1e-9, 1.0).otherwise(3 * F.sin(p) * F.sin(p / 3) / (p * p))


#: Weight by the distance in pixels, and the distance from which it is 0.
KERNELS: dict[str, tuple[Callable[[Column], Column], int]] = {"bilinear": (_bilinear, 1), "cubic": (_cubic, 2), "cubic_spline": (_cubic_spline, 2), "lanczos": (_lanczos, 3)}
QUANTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}


def _neighbours(targets: DataFrame, on: Sequence[str], reach_x: Column, reach_y: Column) -> DataFrame:
    """A row for each whole x, y within reach of a target's center."""
    span = lambda c, reach: F.explode(F.sequence(F.ceil(F.col(c) - reach).cast("long"), F.floor(F.col(c) + reach).cast("long")))
    every = targets.withColumn("_rx", reach_x).withColumn("_ry", reach_y).withColumn("x", span("sx", F.col("_rx"))).withColumn("y", span("sy", F.col("_ry")))
    return every.select(*on, "tx", "ty", "x", "y", F.abs(F.col("x") - F.col("sx")).alias("_dx"), F.abs(F.col("y") - F.col("sy")).alias("_dy"), "ux", "uy")


def convolved(source: DataFrame, targets: DataFrame, image: list[str], kernel: str, value: str = "value", on: Sequence[str] = ()) -> DataFrame:
    """Kernel weights of the neighbours that have data; the kernel widens where a target pixel is larger than a source pixel."""
    weigh, radius = KERNELS[kernel]
    wide = lambda c: F.greatest(F.col(c), F.lit(1.0))
    near = _neighbours(targets, on, wide("ux") * radius, wide("uy") * radius)
    dx, dy = F.col("_dx") / wide("ux"), F.col("_dy") / wide("uy")
    near = near.where((dx < radius) & (dy < radius)).select(*on, "tx", "ty", "x", "y", (weigh(dx) * weigh(dy)).alias("w")).where("w != 0")
    met = source.where(F.col(value).isNotNull()).join(near, [*on, "x", "y"])
    total = met.groupBy(*image, "tx", "ty").agg(F.sum(F.col(value) * F.col("w")).alias("_v"), F.sum("w").alias("_w"))
    return total.where("_w > 1e-6").select(*image, "tx", "ty", (F.col("_v") / F.col("_w")).alias(value))


def bilinear(source: DataFrame, targets: DataFrame, image: list[str], value: str = "value", on: Sequence[str] = ()) -> DataFrame:
    return convolved(source, targets, image, "bilinear", value, on)


def covered(source: DataFrame, targets: DataFrame, image: list[str], method: str, value: str = "value", on: Sequence[str] = ()) -> DataFrame:
    """A statistic of the source pixels that a target pixel covers.

    average, sum, rms and mode weigh them by the covered area; of equal modes the least wins. max, min, med and quartiles take each pixel
    that is touched once; a quantile is the least value that has its share of the values at or below it.
    """
    reach = lambda c: F.col(c) / 2 + 0.5
    share = lambda d, u: F.least(F.lit(1.0), F.col(u), reach(u) - F.col(d))
    near = _neighbours(targets, on, reach("ux"), reach("uy")).withColumn("_sx", share("_dx", "ux")).withColumn("_sy", share("_dy", "uy"))
    near = near.where("_sx > 1e-9 and _sy > 1e-9").select(*on, "tx", "ty", "x", "y", (F.col("_sx") * F.col("_sy")).alias("w"))
    met = source.where(F.col(value).isNotNull()).join(near, [*on, "x", "y"])
    keys, v, w = [*image, "tx", "ty"], F.col(value), F.col("w")
    if method == "mode":
        met = met.groupBy(*keys, value).agg(F.round(F.sum("w"), 9).alias("w"))
    result = {
        "average": lambda: F.sum(v * w) / F.sum(w),
        "sum": lambda: F.sum(v * w),
        "rms": lambda: F.sqrt(F.sum(v * v * w) / F.sum(w)),
        "mode": lambda: F.max_by(v, F.struct(w, -v)),
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
    } | {n: lambda q=q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)") for n, q in QUANTILES.items()}
    return met.groupBy(*keys).agg(result[method]().alias(value))


def resampled(source: DataFrame, targets: DataFrame, image: list[str], method: str, value: str = "value", on: Sequence[str] = ()) -> DataFrame:
    """Any method of constants.RESAMPLING."""
    if method == "nearest":
        return nearest(source, targets, image, value, on)
    return (convolved if method in KERNELS else covered)(source, targets, image, method, value, on)


def projected(targets: DataFrame, to: Transform, to_crs: int, res: float) -> DataFrame:
    """target_pixels() of targets (tile, epsg, left, top, tx, ty) in each tile's own system, as tile, tx, ty and places; the projection runs in Arrow batches."""
    import numpy as np
    import pandas as pd

    from terrasieve.functions.crs import transformed

    def run(frames):
        for frame in frames:
            for (tile, code, left, top), f in frame.groupby(["tile", "epsg", "left", "top"], sort=False):
                x, y = to.left + (f.tx.to_numpy() + 0.5) * to.res, to.top - (f.ty.to_numpy() + 0.5) * to.res
                px, py = transformed(x, y, to_crs, int(code))
                size = {}
                for name, dx, dy in (("ux", to.res, 0.0), ("uy", 0.0, to.res)):
                    qx, qy = transformed(x + dx, y + dy, to_crs, int(code))
                    size[name] = np.hypot(np.asarray(qx) - px, np.asarray(qy) - py) / res
                yield pd.DataFrame({"tile": tile, "tx": f.tx.to_numpy(), "ty": f.ty.to_numpy(), "sx": (np.asarray(px) - left) / res - 0.5, "sy": (top - np.asarray(py)) / res - 0.5, **size})

    return targets.select("tile", "epsg", "left", "top", "tx", "ty").mapInPandas(run, "tile string, tx long, ty long, sx double, sy double, ux double, uy double")
