"""Composites, masks, clouds, sinks and whole requests on small data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasieve import constants as C
from terrasieve.functions import crs, nbar, pixels
from terrasieve.operators import clouds, composite, resample
from terrasieve.plans import cube, grid, timeaxis
from terrasieve.plans.spec import CubeSpec
from terrasieve.sinks import store
from terrasieve.sources import catalog
from terrasieve.sources.tiles import tile_grid


def test_snow(spark):
    rows = [(5000.0, 2000.0, 1000.0), (2000.0, 2000.0, 3000.0), (500.0, 2000.0, 100.0), (0.0, 0.0, 0.0), (None, 1.0, 1.0)]
    got = spark.createDataFrame(rows, "g double, n double, s double").select(pixels.clear_of_snow(F.col("g"), F.col("n"), F.col("s")).alias("c"))
    assert [r.c for r in got.collect()] == [False, True, True, True, True]


@pytest.mark.parametrize(("method", "want", "gap"), [("mean", 200.0, 250.0), ("median", 100.0, 250.0), ("min", 100.0, 100.0), ("max", 400.0, 400.0)])
def test_composites(spark, method, want, gap):
    rows = [("a", v, v) for v in (100.0, 100.0, 400.0)] + [("gap", v, 1.0) for v in (100.0, None, 400.0)] + [("none", None, 5.0)]
    got = {r.k: (r.b1, r.b2) for r in composite.composite(spark.createDataFrame(rows, "k string, b1 double, b2 double"), ["k"], ["b1", "b2"], method).collect()}
    assert got["a"] == (want, want) and got["gap"][0] == gap
    assert got["none"] == ((None, 5.0) if method == "mean" else (None, None))


def test_softmax_and_classes(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0, 0.0],), ([1000.0, 0.0, 0.0, 0.0],), (None,)], "l array<double>").select(pixels.softmax(F.col("l")).alias("p"), pixels.cloud_class(F.col("l")).alias("c")).collect()
    assert [r.c for r in row] == [1, 0, 0] and sum(row[0].p) == pytest.approx(1) and row[1].p[0] == 1.0


def test_dilation_matches_a_square_filter(spark):
    r = np.random.default_rng(3)
    image = np.where(r.random((20, 17)) < 0.02, r.integers(1, 4, (20, 17)), 0)
    sparse = [(1, x, y, int(image[y, x])) for y in range(20) for x in range(17) if image[y, x]]
    dense = clouds.densified(spark.createDataFrame(sparse, "img long, x long, y long, cls int"), ["img"], 17, 20)
    got = {(c.x, c.y): c.cls for c in clouds.dilated(dense, ["img"]).collect()}
    padded = np.pad(image, 3)
    assert all(got[x, y] == padded[y : y + 7, x : x + 7].max() for y in range(20) for x in range(17))


def test_c_factor(spark):
    row = spark.createDataFrame([(35.0, 0.0, 50.0), (35.0, 8.0, 50.0)], "s double, v double, a double").select(*[nbar.c_factor(b, F.col("s"), F.col("v"), F.col("a")).alias(b) for b in nbar.KERNEL_WEIGHTS]).collect()
    assert all(row[0][b] == pytest.approx(1) for b in C.NBAR_BANDS) and all(0.8 < row[1][b] < 1.2 and row[1][b] != 1 for b in C.NBAR_BANDS)


def test_interval_boundaries(spark):
    day = 86400
    items = spark.createDataFrame([(1, 15 * day), (2, 15 * day + 1), (3, 45 * day), (4, 30 * day)], "id long, e long")
    got = {(r.id, r.slot // day) for r in timeaxis.assigned(items, "e", 30 * day).collect()}
    assert got == {(1, 0), (1, 30), (2, 30), (3, 30), (3, 60), (4, 30)}


def test_chunks_tile_the_grid(spark):
    for height, width, size in ((4200, 3000, 4000), (10000, 8000, 4000), (50, 50, 4000)):
        cells = grid.chunks(spark, 0, 0, height, width, 10, size).collect()
        assert sum((c.x_end - c.x_off) * (c.y_end - c.y_off) for c in cells) == height * width
        assert all(c.right - c.left == 10 * (c.x_end - c.x_off) and c.top == -10 * c.y_off for c in cells)


def test_providers(spark):
    p = catalog.provider("cdse")
    good = "S2A_MSIL2A_20230615T102031_N0510_R065_T32TPS_20240912T065622"
    ids = spark.createDataFrame([(good,)], "id string")
    assert ids.select(p.tile(F.col("id"), None), p.baseline(F.col("id"), None)).first() == ("32TPS", 5.1)
    with pytest.raises(Exception, match="no tile"):
        spark.createDataFrame([("odd",)], "id string").select(p.tile(F.col("id"), None)).collect()


def test_item_source(spark, tmp_path):
    page = {"features": [{"id": "a", "collection": "sentinel-2-l2a", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2020-01-01T00:00:00Z", "s2:mgrs_tile": "32TPS"}, "assets": {"B02": {"href": "x.npy"}}}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    catalog.register(spark)
    row = spark.read.format("stac_items").option("pages", f"{tmp_path}/p.json").load().first()
    assert row.id == "a" and row.properties["s2:mgrs_tile"] == "32TPS" and row.assets == {"B02": "x.npy"} and row.bbox == [1, 2, 3, 4]


def test_items_of_a_catalog_as_a_request_takes_them(spark, tmp_path):
    tall = [10.5, 45.25, 0, 11.5, 46.0, 900]
    features = [
        {"id": "a", "collection": "sentinel-2-l2a", "bbox": [10, 45, 11, 46], "properties": {"datetime": "2021-03-04T05:06:07.890Z", "s2:mgrs_tile": "32TPR", "s2:processing_baseline": "05.09"}, "assets": {"B02": {"href": "x"}}},
        {"id": "b", "collection": "sentinel-1-rtc", "bbox": tall, "properties": {"datetime": "2021-03-04T05:06:08Z", "sat:orbit_state": "ascending"}, "assets": {}},
        {"id": "c", "collection": "landsat", "bbox": [10, 45, 11, 46], "properties": {"datetime": "2021-03-04T05:06:08Z"}, "assets": {}},
    ]
    (tmp_path / "items.json").write_text(json.dumps({"features": features}))
    catalog.register(spark)
    found = catalog.prepared(spark.read.format("stac_items").option("pages", f"{tmp_path}/items.json").load(), catalog.provider("planetary_computer"))
    a, b = sorted(found.collect())
    assert (a.second, a.tile, a.baseline, a.orbit, a.assets, a.maxx, a.maxy) == (1614834367, "32TPR", 5.09, None, {"B02": "x"}, 11, 46)
    assert (b.second, b.tile, b.baseline, b.orbit, b.minx, b.miny, b.maxx, b.maxy) == (1614834368, None, None, "ascending", 10.5, 45.25, 11.5, 46.0)


def test_tile_grid(spark, tmp_path):
    marks, want = [], {}
    for name, zone, left, top in (("32TPR", 32632, 600000, 5100000), ("01KAB", 32701, 300000, 8000000), ("60NXX", 32660, 700000, 600000)):
        corners = [(left, top), (left + 109800, top), (left + 109800, top - 109800), (left, top - 109800), (left, top)]
        lon, lat = crs.to_lonlat(*np.array(corners, float).T, zone)
        ring = " ".join(f"{a:.12f},{b:.12f},0" for a, b in zip(lon, lat, strict=True))
        table = f"<table><tr><th>TILE_ID</th><td>{name}</td></tr><tr><td>EPSG</td><td><font color='#1'>{zone}</font></td></tr><tr><td>MGRS_REF</td><td>12345</td></tr></table>"
        polygon = f"<Polygon><outerBoundaryIs><LinearRing><coordinates>\n {ring} </coordinates></LinearRing></outerBoundaryIs></Polygon>"
        if name != "60NXX":
            polygon = f"<MultiGeometry>{polygon}<Point><coordinates>{lon[0]},{lat[0]}</coordinates></Point></MultiGeometry>"
        marks.append(f"<Placemark><name>{name}</name><description><![CDATA[{table}]]></description>{polygon}</Placemark>")
        want[name] = (zone, left, top - 109800, left + 109800, top)
    marks.append("<Placemark><name>note</name><description>no tile</description></Placemark>")
    (tmp_path / "grid.kml").write_text(f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{"".join(marks)}</Document></kml>')
    got = {r.tile: tuple(r)[1:] for r in tile_grid(spark, str(tmp_path / "grid.kml")).collect()}
    assert got == want


def test_every_resampling_method_keeps_a_grid(spark):
    """On the same grid each method but the smoothing ones gives the pixels back; NoData stays NoData and a constant stays constant."""
    values = [(x, y, None if (x, y) == (2, 2) else float(x * 7 + y * y)) for x in range(6) for y in range(6)]
    source = spark.createDataFrame(values, "x long, y long, value double").withColumn("image", F.lit("a"))
    cells = spark.range(6).select(F.col("id").alias("tx")).crossJoin(spark.range(6).select(F.col("id").alias("ty")))
    same = resample.target_pixels(cells, grid.Transform(0, 60, 10), grid.Transform(0, 60, 10))
    want = {(x, y): v for x, y, v in values if v is not None}
    flat = source.withColumn("value", F.when(F.col("value").isNotNull(), 4.0))
    half = resample.target_pixels(cells, grid.Transform(0, 60, 7), grid.Transform(0, 60, 10))
    for method in C.RESAMPLING:
        got = {(r.tx, r.ty): r.value for r in resample.resampled(source, same, ["image"], method).collect() if r.value is not None}
        if method != "cubic_spline":
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want), method
        if method != "sum":
            assert {round(r.value, 9) for r in resample.resampled(flat, half, ["image"], method).collect() if r.value is not None} == {4.0}, method


def test_factors_on_a_grid_are_interpolated(spark):
    factors = spark.createDataFrame([("i", b, cx, cy, 1 + 0.1 * cx + 0.2 * cy + k) for k, b in enumerate(("B02", "B03")) for cx in range(3) for cy in range(4)], "item_id string, band string, cx long, cy long, c double")
    places = [(i, b, x, y) for i in ("i", "j") for b in ("B02", "B03", "B05") for x in (0, 250, 1300) for y in (10, 1700)]
    got = nbar.interpolated(spark.createDataFrame(places, "item_id string, band string, x long, y long"), factors, ["item_id", "band"], 500).collect()
    assert len(got) == len(places)
    for r in got:
        known = r.item_id == "i" and r.band != "B05"
        assert (r.c is None) if not known else abs(r.c - (1 + 0.1 * r.x / 500 + 0.2 * r.y / 500 + (r.band == "B03"))) < 1e-9


def test_zarr_round_trip(spark, tmp_path):
    path = f"{tmp_path}/cube.zarr"
    for as_uint16, center in ((False, False), (True, True)):
        s = store.Skeleton((1592179200, 1592611200, 1592179200), ("B02", "B03", "B04"), 300000, 5000300, 10, 30, 50, 32633, 10, 16, 16, as_uint16, center)
        store.create_zarr(path, s, overwrite=True)
        r = np.random.default_rng(1)
        values = [(t, b, y, x, float(np.float32(r.uniform(-5, 70000)))) for t in (0, 1) for b in s.bands for y in range(20) for x in range(50) if r.random() < 0.5]
        n = store.fill_zarr(spark.createDataFrame(values, "time_idx int, band string, y_idx long, x_idx long, value double"), path, s)
        data, axes = store.read_zarr(path)
        assert data.shape == (2, 3, 30, 50) and list(axes["band"]) == list(s.bands) and list(axes["time"]) == [1592611200, 1592179200]
        assert axes["x"][0] == 300000 + 5 * center and axes["y"][0] == 5000300 - 5 * center and n == 2 * 4  # rows below 20 lie in the first two chunk rows
        want = np.full((2, 3, 30, 50), 0 if as_uint16 else np.nan)
        for t, b, y, x, v in values:
            want[t, s.bands.index(b), y, x] = np.clip(np.rint(v), 0, 65535) if as_uint16 else v
        assert np.array_equal(data, want, equal_nan=True)
        with pytest.raises(FileExistsError):
            store.create_zarr(path, s)
    only = store.Skeleton((1,), ("vv_asc", "vh_asc"), 0, 0, 10, 1, 1, 32633)
    assert only.chunks[1] == 2 and store.Skeleton((1,), ("B02", "vv_asc"), 0, 0, 10, 1, 1, 32633).chunks[1] == 1


@pytest.fixture(scope="module")
def scene(spark, tmp_path_factory):
    """Two dates of one 40 x 40 tile and a radar scene of the same place."""
    folder = tmp_path_factory.mktemp("scene")
    left, top = 600000.0, 5000000.0
    arrays = {}
    for k in range(2):
        for band, res in C.S2_BANDS.items():
            n = 40 * 10 // res if res < 60 else 7
            arrays[k, band] = np.full((n, n), 1500.0 + 100 * k, np.float32) + np.arange(n, dtype=np.float32)[None, :]
            np.save(folder / f"{k}_{band}.npy", arrays[k, band])
    arrays["vv"] = np.full((40, 40), 7.0, np.float32)
    arrays["vv"][0, 0] = 0
    np.save(folder / "vv.npy", arrays["vv"])
    box = cube.transformed_bounds(left, top - 400, left + 400, top, 32632, 4326)[0]
    s2 = [(f"i{k}", 1590969600 + k * 86400, "sentinel-2-l2a", "T1", 5.0 if k else 3.0, "ascending", {b: str(folder / f"{k}_{b}.npy") for b in C.S2_BANDS}, *box) for k in range(2)]
    s1 = [("r0", 1590969600, "sentinel-1-rtc", None, None, "descending", {"vv": str(folder / "vv.npy"), "vh": str(folder / "missing.npy")}, *box)]
    items = spark.createDataFrame(s2 + s1, "item_id string, second long, collection string, tile string, baseline double, orbit string, assets map<string,string>, minx double, miny double, maxx double, maxy double")
    tile = lambda name: spark.createDataFrame([(name, 32632, left, top - 400, left + 400, top)], "tile string, epsg int, minx double, miny double, maxx double, maxy double")
    return items, tile("T1"), tile("r0"), arrays, (left, top)


def spec(scene, **options) -> CubeSpec:
    left, top = scene[4]
    return CubeSpec(32632, 10, left + 50, top - 250, left + 250, top - 50, "2020-06-01/2020-06-02", **{"S1_assets": None, **options})


def as_array(rows, band, shape=(20, 20), time=0):
    out = np.full(shape, np.nan)
    for r in rows:
        if r.band == band and r.time_idx == time:
            out[r.y_idx, r.x_idx] = r.value
    return out


def test_request_without_compositing(spark, scene, tmp_path):
    items, tiles, scenes, arrays, _ = scene
    request = spec(scene, S1_assets=("vv_desc", "vh_desc"), S2_bands=("B05", "B02"), zarr_store=f"{tmp_path}/c.zarr", zarr_store_chunk_size={"time": 1, "x": 16, "y": 16})
    rows = cube.process(spark, request, items, tiles, scenes=scenes, subtile=10).collect()
    assert np.array_equal(as_array(rows, "B02", time=1), arrays[0, "B02"][5:25, 5:25])
    assert np.array_equal(as_array(rows, "B02", time=0), arrays[1, "B02"][5:25, 5:25] - 1000)  # harmonised
    assert np.array_equal(as_array(rows, "B05", time=1), np.repeat(np.repeat(arrays[0, "B05"], 2, 0), 2, 1)[5:25, 5:25])
    assert (as_array(rows, "vv_desc", time=1) == 7).all() and not any(r.band == "vh_desc" for r in rows)
    data, axes = store.read_zarr(request.zarr_store)
    assert list(axes["band"]) == ["B02", "B05", "vv_desc", "vh_desc"]
    for t in (0, 1):
        for b, name in enumerate(axes["band"]):
            assert np.array_equal(data[t, b], as_array(rows, name, time=t).astype(np.float32), equal_nan=True)


def test_request_with_masks_and_compositing(spark, scene):
    items, tiles, _, arrays, _ = scene
    options = {"time_composite_freq": "30D", "S2_cloud_classification": True, "S2_apply_cloud_mask": True, "S2_mask_snow": True, "S2_apply_snow_mask": True, "S2_return_cloud_probabilities": True}
    rows = cube.process(spark, spec(scene, **options), items, tiles, subtile=10).collect()
    want = (arrays[0, "B02"][5:25, 5:25] + arrays[1, "B02"][5:25, 5:25] - 1000) / 2
    assert np.array_equal(as_array(rows, "B02"), want) and {r.time_idx for r in rows} == {0}
    total = sum(as_array(rows, p) for p in C.CLOUD_PROBABILITIES)
    assert np.allclose(total, 1)
    thick = lambda stack: np.stack([np.zeros(stack.shape[1:]), np.ones(stack.shape[1:]), np.zeros(stack.shape[1:]), np.zeros(stack.shape[1:])])
    assert cube.process(spark, spec(scene, **options), items, tiles, subtile=10, model=thick).where("band = 'B02'").count() == 0


def test_tiles_meet_only_their_part_of_the_grid():
    request = CubeSpec(32632, 10, 600000, 5000000, 610000, 5004000, "2020-06-01", S1_assets=None, S2_bands=("B02",))
    places = [("A", 32632, 600000.0, 5004000.0, 0, 0), ("A", 32632, 600000.0, 5004000.0, 0, 20), ("B", 32632, 605000.0, 5004000.0, 10, 0)]
    got = {r[0]: r[4:] for r in cube.met_cells(places, request, (400, 1000), grid.Transform(600000, 5004000, 10), 20)}
    a, b = got["A"], got["B"]
    assert a[0] == 0 and 19 <= a[1] < 35 and a[2] == 0 and 39 <= a[3] < 55
    assert 495 <= b[0] <= 510 and 529 <= b[1] < 545 and b[2] == 0 and 19 <= b[3] < 35


def test_request_in_another_projection(spark, scene):
    items, tiles, _, _, (left, top) = scene
    box = cube.transformed_bounds(left + 100, top - 200, left + 200, top - 100, 32632, 3857)[0]
    base = [round(v) for v in box]
    request = CubeSpec(3857, 10, base[0], base[1], base[0] + 100, base[1] + 100, "2020-06-01", S1_assets=None, S2_bands=("B02",), resampling_method="bilinear")
    a = as_array(cube.process(spark, request, items, tiles, subtile=10).collect(), "B02", (10, 10))
    assert not np.isnan(a).any() and (1500 < a).all() and (a < 1540).all() and (np.diff(a, axis=1) > 0).all()
    nowhere = CubeSpec(32632, 10, 0, 0, 100, 100, "2020-06-01", S1_assets=None)
    assert cube.process(spark, nowhere, items, tiles).count() == 0
