"""Grids, time axes, projections, planning and validation: plain arithmetic, no session."""

import math
import random
import urllib.error
import warnings
from dataclasses import replace

import numpy as np
import pytest

from terrasieve import constants as C
from terrasieve.functions import crs
from terrasieve.operators.planner import keep_windows
from terrasieve.plans import grid, timeaxis
from terrasieve.plans.spec import CubeSpec
from terrasieve.sources.catalog import provider, with_retries
from terrasieve.sources.raster import read_window

SPEC = CubeSpec(32633, 10, 300000, 5000000, 300500, 5000300, "2020-06-01/2020-06-30", S1_assets=None)


def test_pixel_counts():
    assert [grid.pixels(*a) for a in ((0.7, 0.1), (-90, 30), (1e6, 20))] == [7, 3, 50000]
    with pytest.raises(ValueError, match="multiple"):
        grid.pixels(95, 30)


def test_trimming():
    with pytest.warns(UserWarning):
        assert grid.trimmed(0, 0, 105, 100, 10) == (0, 0, 100, 100)
    with pytest.warns(UserWarning):
        assert grid.trimmed(0, 0, 11.0, 5.0, 2.5)[2] == 10.0
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert grid.trimmed(0, 0, 0.3, 0.3, 0.1) == (0, 0, 0.3, 0.3)


def test_windows():
    w = grid.Window
    assert grid.clipped(w(-5, 10, 20, 20), 100, 100) == (w(0, 10, 15, 20), w(5, 0, 15, 20))
    assert grid.clipped(w(-5, -5, 200, 200), 100, 100)[0] == w(0, 0, 100, 100)
    assert not grid.overlaps(w(100, 0, 5, 5), 100, 100) and not grid.overlaps(w(-5, 0, 5, 5), 100, 100) and grid.overlaps(w(99, 99, 5, 5), 100, 100)
    g = grid.Transform(1000, 9000, 10)
    assert grid.window(1009.995, 8000, 1109.995, 8500, g) == w(1, 50, 10, 50) and grid.window(995, 8004, 1099, 8996, g) == w(-1, 0, 10, 99)
    t, height, width = grid.aligned(412347, 1233, 412989, 2081, 10)
    assert t.left % 10 == 0 and t.top % 10 == 0 and t.left <= 412347 and t.left + width * 10 >= 412989 and t.top >= 2081 and t.top - height * 10 <= 1233


def test_rounding_is_half_even_from_the_epoch():
    from datetime import UTC, datetime

    second = lambda text: int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())
    week = timeaxis.seconds_of("7D")
    for moment, want in (("2020-01-05T12:00", "2020-01-09"), ("2020-01-12T12:00", "2020-01-09"), ("2019-12-29T12:00", "2019-12-26")):
        assert timeaxis.rounded(second(moment), week) == second(want)
    assert timeaxis.requested("2020-01-05") == (second("2020-01-05"), second("2020-01-06") - 1)
    assert timeaxis.requested("2020-02/2021") == (second("2020-02-01"), second("2022-01-01") - 1)
    assert timeaxis.requested("2020-01-05T01:00:00Z/2020-01-06")[0] == second("2020-01-05T01:00")
    with pytest.raises(ValueError, match="ends before"):
        timeaxis.requested("2020-02-01/2020-01-01")
    for bad in ("M", "0D", "x", "1MS"):
        with pytest.raises(ValueError, match="frequency"):
            timeaxis.seconds_of(bad)


def test_projections():
    rng = np.random.default_rng(1)
    for code, (west, east), (south, north) in ((32632, (6, 12), (0, 83)), (32732, (6, 12), (-79, 0)), (3857, (-180, 180), (-84, 84)), (32601, (-180, -174), (10, 60))):
        lon, lat = rng.uniform(west, east, 200), rng.uniform(south, north, 200)
        back = crs.to_lonlat(*crs.from_lonlat(lon, lat, code), code)
        assert np.allclose(back[0], lon, atol=1e-9) and np.allclose(back[1], lat, atol=1e-9)
    # published UTM example: 43 38 33.24 N, 79 23 13.7 W in zone 17 is 630084 m E, 4833438 m N
    x, y = crs.from_lonlat(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600, 32617)
    assert abs(x - 630084) < 1 and abs(y - 4833438) < 1
    assert math.isclose(crs.from_lonlat(180, 0, 3857)[0], 20037508.342789244)
    assert len(crs.transformed_bounds(200000, 6000000, 300000, 6100000, 32601, 4326)) >= 1
    boxes = crs.transformed_bounds(300000, 5000000, 900000, 5100000, 32660, 4326)
    assert len(boxes) == 2 and boxes[0][2] == 180 and boxes[1][0] == -180
    with pytest.raises(ValueError, match="unknown"):
        crs.epsg("EPSG:99999")


def test_redundancy_keeps_coverage():
    r = random.Random(4)
    for _ in range(30):
        tiles = {f"T{k}": [((i, j), (x + i * 10, y + j * 10, x + i * 10 + 10, y + j * 10 + 10)) for i in range(5) for j in range(5)] for k, (x, y) in enumerate((r.randrange(0, 40, 2), r.randrange(0, 40, 2)) for _ in range(4))}
        area = (5, 5, 61, 57)
        tiles = {n: [w for w in ws if w[1][0] < area[2] and w[1][2] > area[0] and w[1][1] < area[3] and w[1][3] > area[1]] for n, ws in tiles.items()}
        kept = keep_windows(tiles, area)
        assert len(set(kept)) == len(kept)
        boxes = {(n, k): b for n, ws in tiles.items() for k, b in ws}
        inside = lambda found, p: any(b[0] <= p[0] < b[2] and b[1] <= p[1] < b[3] for b in found)
        for p in ((x + 0.5, y + 0.5) for x in range(5, 61) for y in range(5, 57)):
            assert inside(boxes.values(), p) == inside([boxes[k] for k in kept], p)
    one = {"A": [((0, 0), (0, 0, 10, 10))], "B": [((0, 0), (0, 0, 10, 10)), ((1, 0), (10, 0, 20, 10))]}
    assert keep_windows(one, (0, 0, 20, 10)) == [("B", (0, 0)), ("B", (1, 0))]


@pytest.mark.parametrize(
    "change",
    [
        {"provider": "x"}, {"provider": "cdse", "S1_assets": ("vv_asc",)}, {"provider": "cdse", "S2_nbar": True}, {"zarr_store": 3}, {"target_crs": "EPSG:1"}, {"target_resolution": 0},
        {"target_resolution": True}, {"bound_left": "a"}, {"bound_right": 0}, {"processing_spatial_chunk_size": 999}, {"processing_spatial_chunk_size": 1e4}, {"overwrite": 1}, {"S1_assets": ("vv",)},
        {"S1_assets": "vv_asc"}, {"S2_bands": ("B99",)}, {"S2_cloud_classification_device": "tpu"}, {"num_workers": 1.5}, {"time_composite_freq": 7}, {"time_composite_freq": "1M"},
        {"time_composite_method": "mode"}, {"S2_apply_snow_mask": True}, {"S2_apply_cloud_mask": True}, {"S2_return_cloud_probabilities": True}, {"zarr_store_chunk_size": {"x": 1}},
        {"coord_save_mode": "middle"}, {"resampling_method": "gauss"}, {"save_as_uint16": True, "S1_assets": ("vv_asc",)}, {"S2_bands": None}, {"S2_bands": None, "S1_assets": ("vv_asc",), "S2_nbar": True},
        {"S2_bands": ("B02",), "S2_cloud_classification": True}, {"S2_bands": ("B02", "B03"), "S2_mask_snow": True}, {"S2_bands": ("B02",), "S2_nbar": True}, {"datetime": "soon"},
    ],
)
def test_broken_rules(change):
    with pytest.raises(ValueError):  # noqa: PT011
        replace(SPEC, **change).validate()


def test_bands_of_a_request():
    SPEC.validate()
    spec = replace(SPEC, S2_bands=("B11", "B03", "B08"), S2_mask_snow=True, S1_assets=("vv_asc",))
    assert spec.validate().bands == ["B03", "B08", "B11", C.SNOW_BAND, "vv_asc"]
    with pytest.warns(UserWarning, match="without"):
        assert replace(spec, time_composite_freq="7D").validate().bands == ["B03", "B08", "B11", "vv_asc"]
    assert replace(SPEC, S2_bands=None, S1_assets=("vh_desc",)).validate().bands == ["vh_desc"]


def test_retries():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise urllib.error.HTTPError("u", 503, "busy", None, None)
        return b"x"

    assert with_retries(flaky, sleep=waits.append) == b"x" and waits == [1, 2, 4]
    with pytest.raises(urllib.error.HTTPError):
        with_retries(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", None, None)), sleep=waits.append)
    with pytest.raises(ValueError, match="unknown provider"):
        provider("x")


def test_reading_windows():
    a = np.arange(36, dtype=np.float32).reshape(6, 6)
    assert (read_window(a, 2, 1, 3, 1) == a[1:4, 2:5]).all()
    assert (read_window(a, 4, 4, 4, 2) == np.repeat(np.repeat(a[2:4, 2:4], 2, 0), 2, 1)).all()
    edge = read_window(a, 4, 4, 4, 1)
    assert (edge[:2, :2] == a[4:, 4:]).all() and edge[2:].sum() == 0
    assert (read_window(a, -2, 0, 4, 1)[:, :2] == 0).all()
