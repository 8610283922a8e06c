"""Mosaics of one acquisition and composites of many, in long or wide pixel tables with NULL as NoData."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasieve.functions.pixels import all_or_none

REDUCERS = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}


def mosaic(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """The mean of valid contributions of overlapping subtiles; map-side partial sums, one shuffle on keys."""
    return pixels.groupBy(*keys).agg(*[F.avg(b).alias(b) for b in bands])


def summed(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Several items at one time without compositing are summed; a sum of 0 is NoData."""
    return pixels.groupBy(*keys).agg(*[F.nullif(F.sum(b), F.lit(0.0)).alias(b) for b in bands])


def composite(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str], method: str) -> DataFrame:
    """Valid values of each pixel and slot reduced by mean, median, min or max.

    For the mean a pixel loses only the bands without a valid value; for the others, one such band costs the pixel all.
    """
    reduce = REDUCERS[method]
    out = pixels.groupBy(*keys).agg(*[reduce(b).cast("double").alias(b) for b in bands])
    return out if method == "mean" else any_band_rule(out, bands)


def any_band_rule(pixels: DataFrame, bands: Sequence[str], where: Column | None = None) -> DataFrame:
    """A pixel without one raw band is NoData in all; only in the rows of where, if that is given."""
    ruled = all_or_none([F.col(b) for b in bands])
    return pixels.withColumns({b: v if where is None else F.when(where, v).otherwise(F.col(b)) for b, v in zip(bands, ruled, strict=True)})


def apply_mask(pixels: DataFrame, bands: Sequence[str], keep: Column) -> DataFrame:
    return pixels.withColumns({b: F.when(keep, F.col(b)) for b in bands})


def first_items(items: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """One item for each key, the first by name; min_by keeps partial aggregation, so a hot key needs no sorted group."""
    rest = [c for c in items.columns if c not in keys]
    return items.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def melted(wide: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Long form: keys, band, value."""
    return wide.unpivot(list(keys), list(bands), "band", "value")


def joined_bands(parts: Sequence[DataFrame]) -> DataFrame:
    """Bands of several long tables in one cube, bound by name."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_order(long: DataFrame, order: Sequence[str]) -> DataFrame:
    """Only the bands asked for, with their ordinal in canonical order."""
    ordinal = F.when(F.lit(False), 0)
    for k, band in enumerate(order):
        ordinal = ordinal.when(F.col("band") == band, k)
    return long.where(F.col("band").isin(list(order))).withColumn("ordinal", ordinal)
