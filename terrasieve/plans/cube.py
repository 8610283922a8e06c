"""From a request to a cube: the whole plan over catalog tables, raster files and a sink.

The order is fixed: harmonise, score clouds, adjust for BRDF, resample (probabilities too), mosaic, classify, dilate, find
snow, mask, composite, then the NoData rule. Planning tables are as large as one request's area; pixels never leave
the executors.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve import constants as C
from terrasieve.functions import nbar, pixels
from terrasieve.functions.crs import epsg, transformed_bounds
from terrasieve.operators import clouds, composite, planner, resample
from terrasieve.plans import grid, timeaxis
from terrasieve.plans.spec import CubeSpec
from terrasieve.sinks.store import Skeleton, create_zarr, fill_zarr
from terrasieve.sources.catalog import Provider, provider, within
from terrasieve.sources.raster import open_npy, pixels_of, read_blocks

PROBABILITIES = [f"p{k}" for k in range(4)]


def slotted(items: DataFrame, spec: CubeSpec) -> DataFrame:
    """Items of the requested time with their slot; composites also take what lies half a step outside of the range."""
    start, end = timeaxis.requested(spec.datetime)
    if spec.time_composite_freq is None:
        return items.where((F.col("second") >= start) & (F.col("second") <= end)).withColumn("slot", F.col("second"))
    step = timeaxis.seconds_of(spec.time_composite_freq)
    first = timeaxis.rounded(start, step)
    last = first + (max(end, first) - first) // step * step
    near = items.where((F.col("second") >= first - step / 2) & (F.col("second") <= last + step / 2))
    return timeaxis.assigned(near, "second", step).where((F.col("slot") >= first) & (F.col("slot") <= last))


def planned(tiles: list, area: tuple, crs: int, subtile: int, res: float = 10.0) -> list[tuple]:
    """(tile, epsg, left, top, col_off, row_off) of the windows to read; redundancy is removed among tiles of one zone."""
    out = []
    for zone in sorted({t["epsg"] for t in tiles}):
        for box in transformed_bounds(*area, crs, zone):
            found: dict[str, list] = {}
            for t in (t for t in tiles if t["epsg"] == zone):
                n_col, n_row = round((t["maxx"] - t["minx"]) / res) // subtile, round((t["maxy"] - t["miny"]) / res) // subtile
                for i in range(n_col):
                    for j in range(n_row):
                        left, top = t["minx"] + i * subtile * res, t["maxy"] - j * subtile * res
                        w = (left, top - subtile * res, left + subtile * res, top)
                        if w[0] < box[2] and w[2] > box[0] and w[1] < box[3] and w[3] > box[1]:
                            found.setdefault(t["tile"], []).append(((i * subtile, j * subtile), w))
            by_name = {t["tile"]: t for t in tiles}
            out += [(n, zone, by_name[n]["minx"], by_name[n]["maxy"], c, r) for n, (c, r) in planner.keep_windows(found, box)]
    return sorted(set(out))


def read_bands(chosen: DataFrame, bands: list[str], subtile: int, opener: Callable, named: Provider) -> DataFrame:
    """item_id, tile, band and block columns, for chosen (item_id, tile, assets, col_off, row_off); assets are named as the provider does.

    A band without an asset is NoData; an item without any of the assets is an error, as its names must be another provider's.
    """
    assets = [F.col("assets")[named.asset(F.lit(b), None)] for b in bands]
    lost = F.raise_error(F.concat(F.lit(f"no asset that {named.name} has for {bands} in item "), F.col("item_id").cast("string"))).cast("string")
    first = F.coalesce(*assets, lost)
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.lit(C.S2_BANDS.get(b, 10) // 10).alias("factor"), named.href(F.when(first.isNotNull(), a)).alias("href")) for b, a in zip(bands, assets, strict=True)]))
    asked = chosen.withColumn("_b", each).select("item_id", "tile", "col_off", "row_off", "_b.band", "_b.factor", "_b.href").where("href is not null")
    blocks = read_blocks(asked.select("href", "col_off", "row_off", "factor").distinct(), subtile, opener)
    return asked.drop("factor").join(blocks, ["href", "col_off", "row_off"])


def met_cells(places: list[tuple], spec: CubeSpec, shape: tuple[int, int], t: grid.Transform, subtile: int, res: float = 10.0) -> list[tuple]:
    """(tile, epsg, left, top, x0, x1, y0, y1): the target pixels that a tile's windows can reach, ends included; a margin holds the widest kernel."""
    margin, out = 4, []
    height, width = shape
    for tile, zone, left, top in sorted({p[:4] for p in places}):
        own = [p for p in places if p[:4] == (tile, zone, left, top)]
        cols, rows = [p[4] for p in own], [p[5] for p in own]
        box = (left + (min(cols) - margin) * res, top - (max(rows) + subtile + margin) * res, left + (max(cols) + subtile + margin) * res, top - (min(rows) - margin) * res)
        free = 0  # of two boxes, either side of the antimeridian, the second begins where the first ends
        for low_x, low_y, high_x, high_y in sorted(transformed_bounds(*box, zone, spec.target_crs)):
            x0, x1 = max(math.floor((low_x - t.left) / t.res) - margin, free), min(math.ceil((high_x - t.left) / t.res) + margin, width - 1)
            y0, y1 = max(math.floor((t.top - high_y) / t.res) - margin, 0), min(math.ceil((t.top - low_y) / t.res) + margin, height - 1)
            if x0 <= x1 and y0 <= y1:
                out.append((tile, zone, left, top, x0, x1, y0, y1))
                free = x1 + 1
    return out


def on_grid(source: DataFrame, places: list[tuple], spec: CubeSpec, shape: tuple[int, int], t: grid.Transform, subtile: int) -> DataFrame:
    """source (tile, x, y, band, value and more) resampled to the target grid: tx, ty instead of x, y.

    A tile's pixels are met with the part of the grid below its windows only, so the work grows with the area and not with tiles times area.
    """
    boxes = source.sparkSession.createDataFrame(met_cells(places, spec, shape, t, subtile), "tile string, epsg int, left double, top double, x0 long, x1 long, y0 long, y1 long")
    lines = boxes.withColumn("ty", F.explode(F.sequence("y0", "y1"))).repartition("tile", "ty")  # a task's share is lines of the grid
    cells = lines.withColumn("tx", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1", "y0", "y1")
    image = [c for c in source.columns if c not in ("x", "y", "value")]
    return resample.resampled(source, resample.projected(cells, t, epsg(spec.target_crs), 10.0), image, spec.resampling_method, on=["tile"])


def sentinel2(spark: SparkSession, spec: CubeSpec, items: DataFrame, tiles: list, shape, t, area, subtile: int, opener: Callable, model: Callable, c_factors: DataFrame | None) -> DataFrame | None:
    """slot, tx, ty, band, value."""
    places = planned(tiles, area, epsg(spec.target_crs), subtile)
    if not places:
        return None
    bands = spec.raw_bands
    plan = spark.createDataFrame(places, "tile string, epsg int, left double, top double, col_off long, row_off long")
    scenes = composite.first_items(items.where("collection = 'sentinel-2-l2a'").select("tile", "second", "item_id", "baseline", "assets"), ["tile", "second"], "item_id")
    chosen = scenes.join(F.broadcast(plan), "tile")  # one area's windows
    blocks = read_bands(chosen.select("item_id", "tile", "assets", "col_off", "row_off"), bands, subtile, opener, provider(spec.provider))
    raw = pixels_of(blocks, ["item_id", "tile", "band"]).join(scenes.select("item_id", "baseline"), "item_id")
    raw = raw.withColumn("value", pixels.no_data(pixels.harmonised(F.col("value"), F.col("baseline")))).drop("baseline")
    parts = [raw]
    if spec.S2_cloud_classification:
        full = raw.join(blocks.select("item_id", "tile", "band", "col_off", "row_off").distinct(), ["item_id", "tile", "band"]).where(
            (F.col("x") >= F.col("col_off")) & (F.col("x") < F.col("col_off") + subtile) & (F.col("y") >= F.col("row_off")) & (F.col("y") < F.col("row_off") + subtile)
        )
        stack = full.groupBy("item_id", "tile", "col_off", "row_off").agg(F.sort_array(F.collect_list(F.struct(_ordinal(bands).alias("o"), "y", "x", F.coalesce("value", F.lit(0.0)).cast("float").alias("v")))).alias("s"))
        key = F.concat_ws("|", "item_id", "tile", "col_off", "row_off")
        stack = stack.select(key.alias("key"), F.lit(len(bands)).alias("bands"), F.lit(subtile).alias("height"), F.lit(subtile).alias("width"), F.transform("s", lambda r: r["v"]).alias("data"))
        probs = clouds.scored(stack, model).withColumn("k", F.split("key", r"\|")).select("k", F.posexplode("probs").alias("at", "value"))
        n = subtile * subtile
        here = F.col("at") % n
        parts.append(
            probs.select(
                F.get("k", F.lit(0)).alias("item_id"), F.get("k", F.lit(1)).alias("tile"), F.concat(F.lit("p"), F.floor(F.col("at") / n).cast("string")).alias("band"),
                (F.get("k", F.lit(2)).cast("long") + here % subtile).alias("x"), (F.get("k", F.lit(3)).cast("long") + F.floor(here / subtile)).alias("y"), "value",
            )
        )
    if spec.S2_nbar and c_factors is None:
        warnings.warn("S2_nbar needs c_factors; reflectances stay unadjusted", stacklevel=2)
    if spec.S2_nbar and c_factors is not None:
        if "cx" in c_factors.columns:
            parts[0] = nbar.interpolated(raw, c_factors, ["item_id", "band"], C.ANGLE_STEP)
        else:
            parts[0] = raw.join(c_factors.select("item_id", "band", "c"), ["item_id", "band"], "left")
        parts[0] = parts[0].withColumn("value", nbar.adjusted(F.col("value"), F.col("c"))).drop("c")
    warped = on_grid(composite.joined_bands(parts), places, spec, shape, t, subtile)
    extra = PROBABILITIES * spec.S2_cloud_classification
    wide = warped.join(items.select("item_id", "second", "slot"), "item_id").groupBy("slot", "second", "tx", "ty")
    image = wide.agg(*[F.avg(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in [*bands, *extra]])
    if spec.S2_cloud_classification:
        cells = image.withColumn("cls", pixels.cloud_class(F.array(*PROBABILITIES))).withColumnRenamed("tx", "x").withColumnRenamed("ty", "y")
        dense = clouds.densified(cells, ["slot", "second"], shape[1], shape[0])
        image = clouds.dilated(dense, ["slot", "second"]).withColumnRenamed("x", "tx").withColumnRenamed("y", "ty").withColumn("cls", F.col("cls").cast("double"))
    if spec.S2_mask_snow:
        image = image.withColumn("clear", pixels.clear_of_snow(F.coalesce("B03", F.lit(0.0)), F.coalesce("B08", F.lit(0.0)), F.coalesce("B11", F.lit(0.0))))
    masked = [*bands, *extra]
    if spec.S2_apply_snow_mask:
        image = composite.apply_mask(image, masked, F.col("clear"))
    if spec.S2_apply_cloud_mask:
        image = composite.apply_mask(image, masked, F.col("cls") == 0)
    keys = ["slot", "tx", "ty"]
    saved = list(bands)
    if spec.time_composite_freq is not None:
        reduced = image.groupBy(*keys).agg(*[composite.REDUCERS[spec.time_composite_method](b).cast("double").alias(b) for b in masked])
        if spec.time_composite_method == "mean":
            # a slot of one acquisition is no composite: there the rule of single images holds
            times = items.where("collection = 'sentinel-2-l2a'").join(plan.select("tile").distinct(), "tile", "left_semi").groupBy("slot").agg(F.countDistinct("second").alias("_times"))
            image = composite.any_band_rule(reduced.join(times, "slot", "left"), bands, F.coalesce("_times", F.lit(1)) == 1).drop("_times")
        else:
            image = composite.any_band_rule(reduced, bands)
    else:
        image = composite.any_band_rule(image, bands)
        named = {C.SNOW_BAND: F.col("clear").cast("double")} if spec.S2_mask_snow else {}
        named |= {C.CLOUD_BAND: F.col("cls")} if spec.S2_cloud_classification else {}
        image, saved = image.withColumns(named), [*saved, *named]
    if spec.S2_return_cloud_probabilities:
        image = image.withColumns(dict(zip(C.CLOUD_PROBABILITIES, [F.col(p) for p in PROBABILITIES], strict=True)))
        saved += C.CLOUD_PROBABILITIES
    return composite.melted(image, keys, saved)


def _ordinal(bands: list[str]):
    o = F.when(F.lit(False), 0)
    for k, b in enumerate(bands):
        o = o.when(F.col("band") == b, k)
    return o


def sentinel1(spark: SparkSession, spec: CubeSpec, items: DataFrame, scenes: list, shape, t, area, subtile: int, opener: Callable) -> DataFrame | None:
    """slot, tx, ty, band, value; a scene is read like a tile of its own, named by its item."""
    places = [p for s in scenes for p in planned([s], area, epsg(spec.target_crs), subtile)]
    if not places:
        return None
    plan = spark.createDataFrame(places, "tile string, epsg int, left double, top double, col_off long, row_off long")
    own = items.where("collection = 'sentinel-1-rtc'")
    chosen = own.withColumn("tile", F.col("item_id")).select("item_id", "tile", "assets").dropDuplicates(["item_id"]).join(F.broadcast(plan), "tile")
    raw = pixels_of(read_bands(chosen, ["vv", "vh"], subtile, opener, provider(spec.provider)), ["item_id", "tile", "band"])
    warped = on_grid(raw, places, spec, shape, t, subtile).join(own.select("item_id", "slot", "orbit"), "item_id")
    named = warped.withColumn("band", pixels.s1_band(F.col("band"), F.col("orbit"))).where(F.col("band").isin(list(spec.S1_assets or ())))
    groups = named.groupBy("slot", "tx", "ty", "band")
    if spec.time_composite_freq is None:
        return groups.agg(F.nullif(F.sum("value"), F.lit(0.0)).alias("value"))
    return groups.agg(composite.REDUCERS[spec.time_composite_method]("value").cast("double").alias("value"))


def process(
    spark: SparkSession, spec: CubeSpec, items: DataFrame, tiles: DataFrame, *, scenes: DataFrame | None = None, opener: Callable = open_npy,
    model: Callable[[np.ndarray], np.ndarray] = clouds.stand_in_model, c_factors: DataFrame | None = None, subtile: int = C.SUBTILE,
) -> DataFrame:
    """The cube (time_idx, time, band, y_idx, x_idx, value); also written to spec.zarr_store if that is set.

    items: item_id, second, collection, tile, baseline, orbit, assets (map to hrefs) and a box in degrees (minx ...).
    tiles, and scenes for Sentinel-1 (tile is the item_id): tile, epsg and bounds in that system at 10 m.
    c_factors: item_id, band, c; with cx, cy too it is a grid of factors every constants.ANGLE_STEP pixels of the tile, interpolated. An area without scenes gives an empty cube. Spark plans workers, block sizes and open files by
    itself, so num_workers, processing_spatial_chunk_size and reuse_open_datasets are checked and have no further effect; a model's
    device is the model's own affair.
    """
    spec.validate()
    area = grid.trimmed(spec.bound_left, spec.bound_bottom, spec.bound_right, spec.bound_top, spec.target_resolution)
    shape, t = grid.shape(*area, spec.target_resolution), grid.transform(*area, spec.target_resolution)
    boxes = transformed_bounds(*area, spec.target_crs, 4326)
    near = within(items, boxes[0])
    for box in boxes[1:]:
        near = near.unionByName(within(items, box))
    near = slotted(near.dropDuplicates(["item_id"]), spec)
    used = near.select(F.col("tile")).union(near.select("item_id")).distinct()
    where = lambda table: table.join(used, "tile", "left_semi").collect()  # noqa: E731  tiles and scenes that meet one area
    parts = []
    if spec.S2_bands:
        parts.append(sentinel2(spark, spec, near, [r.asDict() for r in where(tiles)], shape, t, area, subtile, opener, model, c_factors))
    if spec.S1_assets and scenes is not None:
        parts.append(sentinel1(spark, spec, near, [r.asDict() for r in where(scenes)], shape, t, area, subtile, opener))
    parts = [p for p in parts if p is not None]
    if not parts:
        return spark.createDataFrame([], "time_idx int, time long, band string, y_idx long, x_idx long, value double")
    axis = timeaxis.indexed(near, "slot")
    long = composite.joined_bands(parts).join(F.broadcast(axis), "slot")  # a time axis is short
    cube = long.select("time_idx", F.col("slot").alias("time"), "band", F.col("ty").alias("y_idx"), F.col("tx").alias("x_idx"), "value").where("value is not null")
    if spec.zarr_store:
        times = tuple(r["slot"] for r in axis.collect())
        size = spec.zarr_store_chunk_size
        skeleton = Skeleton(times, tuple(spec.bands), area[0], area[3], spec.target_resolution, *shape, epsg(spec.target_crs), size["time"], size["y"], size["x"], spec.save_as_uint16, spec.coord_save_mode == "center")
        create_zarr(spec.zarr_store, skeleton, spec.overwrite, spec.consolidate_metadata)
        fill_zarr(cube, spec.zarr_store, skeleton)
    return cube
