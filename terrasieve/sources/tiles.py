"""The tile grid: placemarks of a published KML file as a table of tiles with their system and bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.functions.crs import from_lonlat

#: The description is an HTML table; one row names the system, the next cell is its number.
EPSG_CELL = r"(?is)EPSG\s*</t[dh]>.*?<t[dh][^>]*>\s*(?:<[^>]+>\s*)*(\d{4,5})"


def placemarks(spark: SparkSession, path: str) -> DataFrame:
    """tile, epsg and outline ("lon,lat,height lon,lat,height ..."), read by Spark's own XML source; placemarks without a system or an outline are no tiles."""
    fields = "name string, description string, Polygon string, MultiGeometry string"
    read = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true").schema(fields).load(path)
    shape = F.coalesce("MultiGeometry", "Polygon")
    rings = F.regexp_extract_all(shape, F.lit(r"(?s)<outerBoundaryIs>.*?<coordinates>\s*(.*?)\s*</coordinates>"), 1)
    out = read.select(F.col("name").alias("tile"), F.regexp_extract("description", EPSG_CELL, 1).alias("epsg"), F.array_join(rings, " ").alias("outline"))
    return out.where("epsg != '' and outline != ''").withColumn("epsg", F.col("epsg").cast("int"))


def tile_grid(spark: SparkSession, path: str) -> DataFrame:
    """tile, epsg, minx, miny, maxx, maxy in that system, to the metre: what process() takes as tiles. Outlines across the antimeridian stay whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for tile, code, outline in zip(f.tile, f.epsg, f.outline, strict=True):
                lon, lat = np.array([p.split(",")[:2] for p in outline.split()], float).T
                center = 6 * (code % 100) - 183  # of the UTM zone
                lon = (lon - center + 180) % 360 - 180 + center
                x, y = from_lonlat(lon, lat, code)
                rows.append((tile, code, *(float(round(v)) for v in (np.min(x), np.min(y), np.max(x), np.max(y)))))
            yield pd.DataFrame(rows, columns=["tile", "epsg", "minx", "miny", "maxx", "maxy"])

    return placemarks(spark, path).mapInPandas(run, "tile string, epsg int, minx double, miny double, maxx double, maxy double")
