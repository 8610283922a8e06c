"""Named queries of the cube engine and the SQL they are compared with."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasieve.constants import S2_BANDS
from terrasieve.functions import nbar as N
from terrasieve.functions import pixels as P
from terrasieve.functions.crs import transformed_bounds
from terrasieve.operators import clouds, composite, planner, resample
from terrasieve.plans import adapters as A
from terrasieve.plans import grid, timeaxis
from terrasieve.plans.cube import process
from terrasieve.plans.spec import CubeSpec
from terrasieve.sinks import store
from terrasieve.sources import catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BANDS = ["b03", "b08", "b11"]
DAY = 86400
MONTH = 30 * DAY
AREA = (950.0, 10.0, 1900.0, 110.0)

CLEAR = """NOT coalesce((b03 / 1e4 - b11 / 1e4) / nullif(b03 / 1e4 + b11 / 1e4, 0) > 0.15::DOUBLE AND b08 / 1e4 > 0.11::DOUBLE AND b03 / 1e4 > 0.1::DOUBLE, false)"""
SLOTTED = f"""slotted AS (SELECT tile, x, y, unnest(range(CAST(ceil((e - {MONTH // 2}) / {MONTH}) AS BIGINT), CAST(floor((e + {MONTH // 2}) / {MONTH}) AS BIGINT) + 1)) * {MONTH} AS slot,
 CASE WHEN {CLEAR} THEN nullif(b03, 0) END AS b03, CASE WHEN {CLEAR} THEN nullif(b08, 0) END AS b08, CASE WHEN {CLEAR} THEN nullif(b11, 0) END AS b11 FROM pixels)"""
ALL_BANDS = "CASE WHEN b03 IS NOT NULL AND b08 IS NOT NULL AND b11 IS NOT NULL THEN {} END AS {}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def snow_free(spark, d) -> DataFrame:
    p = A.pixels(spark, d).withColumn("clear", P.clear_of_snow(F.col("b03"), F.col("b08"), F.col("b11")))
    return p.withColumns({b: P.masked(P.no_data(F.col(b)), F.col("clear")) for b in BANDS}).drop("clear")


def composed(spark, d, method: str) -> DataFrame:
    slotted = timeaxis.assigned(snow_free(spark, d), "e", MONTH)
    return composite.composite(slotted, ["tile", "x", "y", "slot"], BANDS, method)


def composed_sql(f: str, all_bands: bool) -> str:
    inner = f"SELECT tile, x, y, slot, {', '.join(f'CAST({f}({b}) AS DOUBLE) AS {b}' for b in BANDS)} FROM slotted GROUP BY ALL"
    if all_bands:
        inner = f"SELECT tile, x, y, slot, {', '.join(ALL_BANDS.format(b, b) for b in BANDS)} FROM ({inner})"
    return f"WITH {A.PIXELS}, {SLOTTED} {inner}"


for _method, _f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")):
    QUERIES[f"composite_{_method}"] = lambda spark, d, m=_method: composed(spark, d, m)
    ORACLES[f"composite_{_method}"] = composed_sql(_f, _method != "mean")


@query(f"WITH {A.PIXELS} SELECT e, x, y, avg(nullif(b03, 0)) AS b03, avg(nullif(b08, 0)) AS b08, avg(nullif(b11, 0)) AS b11 FROM pixels GROUP BY ALL")
def mosaic_mean(spark, d):
    p = A.pixels(spark, d).withColumns({b: P.no_data(F.col(b)) for b in BANDS})
    return composite.mosaic(p, ["e", "x", "y"], BANDS)


@query(f"""WITH {A.RADAR}, k AS (SELECT pol || '_' || CASE orbit WHEN 'ascending' THEN 'asc' WHEN 'descending' THEN 'desc' END AS band, x, y,
 unnest(range(CAST(ceil((e - {MONTH // 2}) / {MONTH}) AS BIGINT), CAST(floor((e + {MONTH // 2}) / {MONTH}) AS BIGINT) + 1)) * {MONTH} AS slot, nullif(value, 0) AS value FROM radar)
 SELECT band, x, y, slot, avg(value) AS v_mean, median(value) AS v_median, min(value) AS v_min, max(value) AS v_max FROM k WHERE band IN ('vv_asc', 'vh_asc', 'vv_desc') GROUP BY ALL""")
def s1_composite(spark, d):
    r = A.radar(spark, d).withColumn("band", P.s1_band(F.col("pol"), F.col("orbit"))).where(F.col("band").isin("vv_asc", "vh_asc", "vv_desc"))
    slotted = timeaxis.assigned(r.withColumn("value", P.no_data(F.col("value"))), "e", MONTH)
    return slotted.groupBy("band", "x", "y", "slot").agg(*[f("value").cast("double").alias(f"v_{m}") for m, f in composite.REDUCERS.items()])


@query(f"WITH {A.PIXELS} SELECT tile, x, y, e, {', '.join(f'nullif(sum(nullif({b}, 0)), 0) AS {b}' for b in BANDS)} FROM pixels GROUP BY ALL")
def multi_item_sum(spark, d):
    return composite.summed(A.pixels(spark, d).withColumns({b: P.no_data(F.col(b)) for b in BANDS}), ["tile", "x", "y", "e"], BANDS)


def orders(spark, d) -> DataFrame:
    return A.read(spark, d, "orders").select("o_orderkey", A.second_of(F.col("o_orderdate")).alias("e"))


ORDERS = "o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS e FROM orders)"


@query(f"""WITH {ORDERS}, s AS (SELECT DISTINCT CAST(round_even(e / {MONTH}, 0) AS BIGINT) * {MONTH} + k * {MONTH} AS slot FROM o, (SELECT unnest([-1, 0, 1]) AS k))
 SELECT o_orderkey, slot FROM o JOIN s ON e BETWEEN slot - {MONTH // 2} AND slot + {MONTH // 2}""")
def slot_interval_join(spark, d):
    return timeaxis.assigned(orders(spark, d), "e", MONTH).select("o_orderkey", "slot")


@query(f"""WITH {ORDERS}, b AS (SELECT CAST(round_even(min(e) / {7 * DAY}, 0) AS BIGINT) * {7 * DAY} AS lo, max(e) AS hi FROM o),
 t AS (SELECT unnest(range(lo, greatest(hi, lo) + 1, {7 * DAY})) AS slot FROM b) SELECT CAST(row_number() OVER (ORDER BY slot DESC) - 1 AS INTEGER) AS time_idx, slot FROM t""")
def slot_axis(spark, d):
    lo, hi = orders(spark, d).agg(F.min("e"), F.max("e")).first()
    return timeaxis.indexed(timeaxis.slots(spark, lo or 0, hi or 0, 7 * DAY), "slot").select("time_idx", "slot")


@query(f"WITH {ORDERS} SELECT o_orderkey, CAST(round_even(e / {2 * DAY}, 0) AS BIGINT) * {2 * DAY} AS slot FROM o")
def slot_round_half_even(spark, d):
    return orders(spark, d).select("o_orderkey", timeaxis.rounded_column(F.col("e"), 2 * DAY).alias("slot"))


@query(f"WITH {ORDERS} SELECT e, CAST(row_number() OVER (ORDER BY e DESC) - 1 AS INTEGER) AS time_idx FROM (SELECT DISTINCT e FROM o)")
def slot_index(spark, d):
    return timeaxis.indexed(orders(spark, d), "e")


@query(f"WITH {A.ITEMS} SELECT DISTINCT collection, second // {DAY} * {DAY} AS slot FROM items")
def distinct_slots(spark, d):
    return A.items(spark, d).select("collection", (F.floor(F.col("second") / DAY) * DAY).alias("slot")).distinct()


@query(f"WITH {A.ITEMS} SELECT tile, second // {DAY} AS day, min(item_id) AS item_id, arg_min(product, item_id) AS product FROM items GROUP BY ALL")
def first_item_per_tile_ts(spark, d):
    return composite.first_items(A.items(spark, d).select("tile", F.floor(F.col("second") / DAY).alias("day"), "item_id", "product"), ["tile", "day"], "item_id")


CHUNKS = """cells AS (SELECT xi, yi, xi * 4000 AS x_off, least((xi + 1) * 4000, 10000) AS x_end, yi * 4000 AS y_off, least((yi + 1) * 4000, 9000) AS y_end
 FROM (SELECT unnest(range(3)) AS xi), (SELECT unnest(range(3)) AS yi))"""


@query(f"WITH {A.ITEMS}, {CHUNKS}, s AS (SELECT DISTINCT collection, second // {DAY} * {DAY} AS slot FROM items) SELECT xi, yi, collection, slot FROM cells, s")
def jobs_cross(spark, d):
    cells = grid.chunks(spark, 300000.0, 5000000.0, 9000, 10000, 10.0, 4000).select("xi", "yi")
    return distinct_slots(spark, d).crossJoin(F.broadcast(cells)).select("xi", "yi", "collection", "slot")  # chunks of one request


@query(f"""WITH {A.ITEMS} SELECT item_id, collection, second, tile FROM items WHERE collection = 'sentinel-2-l2a' AND second BETWEEN 1704412800 AND 1705622399
 AND minx <= 15 AND maxx >= 5 AND miny <= 50 AND maxy >= -20""")
def catalog_bbox_time(spark, d):
    start, end = timeaxis.requested("2024-01-05/2024-01-18")
    return catalog.within(A.items(spark, d), (5, -20, 15, 50), start, end, ("sentinel-2-l2a",)).select("item_id", "collection", "second", "tile")


@query(f"WITH {A.ITEMS} SELECT item_id, regexp_extract(product, '_T(\\d{{2}}[A-Z]{{3}})_', 1) AS tile, CAST(regexp_extract(product, '_N(\\d{{4}})_', 1) AS DOUBLE) / 100 AS baseline FROM items")
def provider_parse(spark, d):
    p = catalog.provider("cdse")
    none = F.lit(None)
    return A.items(spark, d).select("item_id", p.tile(F.col("product"), none).alias("tile"), p.baseline(F.col("product"), none).alias("baseline"))


@query(f"""WITH {A.ITEMS}, h AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 's3://eodata/' ELSE 'https://h/' END || product || '.jp2?sig=' || CAST(item_id AS VARCHAR) AS href,
 ['B01', 'B02', 'B05', 'B8A'][item_id % 4 + 1] AS band FROM items)
 SELECT item_id, split_part(href, '?', 1) AS bare, CASE WHEN starts_with(href, 's3://') THEN '/vsis3/' || substr(href, 6) ELSE href END AS vsi,
 band || CASE band WHEN 'B01' THEN '_60m' WHEN 'B02' THEN '_10m' ELSE '_20m' END AS asset FROM h""")
def href_prepare(spark, d):
    head = F.when(F.col("item_id") % 2 == 0, "s3://eodata/").otherwise("https://h/")
    band = F.get(F.array(*[F.lit(b) for b in ("B01", "B02", "B05", "B8A")]), (F.col("item_id") % 4).cast("int"))
    h = A.items(spark, d).select("item_id", F.concat(head, "product", F.lit(".jp2?sig="), F.col("item_id").cast("string")).alias("href"), band.alias("band"))
    pc, cdse = catalog.provider("planetary_computer"), catalog.provider("cdse")
    return h.select("item_id", pc.href(F.col("href")).alias("bare"), cdse.href(F.col("href")).alias("vsi"), cdse.asset(F.col("band"), None).alias("asset"))


@query(f"WITH {A.ITEMS} SELECT item_id, baseline, CASE WHEN baseline >= 4 THEN greatest(v, 1000) - 1000 ELSE v END AS dn FROM (SELECT item_id, baseline, CAST(item_id % 3001 AS DOUBLE) AS v FROM items)")
def harmonize(spark, d):
    v = (F.col("item_id") % 3001).cast("double")
    return A.items(spark, d).select("item_id", "baseline", P.harmonised(v, F.col("baseline")).alias("dn"))


@query(f"""WITH {A.PIXELS} SELECT tile, x, y, e, b03, b08, b11, (b03 / 1e4 - b11 / 1e4) / nullif(b03 / 1e4 + b11 / 1e4, 0) AS ndsi, {CLEAR} AS clear FROM pixels""")
def snow_mask(spark, d):
    c = {b: F.col(b) for b in BANDS}
    return A.pixels(spark, d).select("*", P.snow_index(c["b03"], c["b11"]).alias("ndsi"), P.clear_of_snow(c["b03"], c["b08"], c["b11"]).alias("clear"))


@query(f"WITH {A.PIXELS} SELECT tile, x, y, e, CASE WHEN {CLEAR} THEN nullif(b03, 0) END AS b03, CASE WHEN {CLEAR} THEN nullif(b08, 0) END AS b08, CASE WHEN {CLEAR} THEN nullif(b11, 0) END AS b11 FROM pixels")
def apply_snow_mask(spark, d):
    return snow_free(spark, d)


@query(f"""WITH {A.PIXELS}, {A.CLASSES} SELECT tile, p.x, p.y, e, CASE WHEN coalesce(cls, 0) = 0 THEN nullif(b03, 0) END AS b03, CASE WHEN coalesce(cls, 0) = 0 THEN nullif(b08, 0) END AS b08
 FROM pixels p LEFT JOIN classes c ON c.img = p.tile AND c.x = p.x AND c.y = p.y""")
def apply_cloud_mask(spark, d):
    classes = A.classes(spark, d).withColumnRenamed("img", "tile")
    p = A.pixels(spark, d).join(classes, ["tile", "x", "y"], "left").withColumns({b: P.no_data(F.col(b)) for b in ("b03", "b08")})
    return composite.apply_mask(p, ["b03", "b08"], F.coalesce("cls", F.lit(0)) == 0).select("tile", "x", "y", "e", "b03", "b08")


@query(f"WITH {A.PIXELS} SELECT tile, x, y, e, {', '.join(f'CASE WHEN b03 <> 0 AND b08 <> 0 AND b11 <> 0 THEN {b} END AS {b}' for b in BANDS)} FROM pixels")
def any_band_nodata(spark, d):
    return composite.any_band_rule(A.pixels(spark, d).withColumns({b: P.no_data(F.col(b)) for b in BANDS}), BANDS)


@query(f"WITH {A.RADAR} SELECT pol, orbit, x, y, e, nullif(value, 0) AS value FROM radar")
def s1_nodata(spark, d):
    return A.radar(spark, d).withColumn("value", P.no_data(F.col("value")))


@query("SELECT vec_id, CAST(list_position(embedding[1:4], list_max(embedding[1:4])) - 1 AS INTEGER) AS cls FROM embeddings")
def cloud_argmax(spark, d):
    return A.logits(spark, d).select("vec_id", P.cloud_class(F.col("logits")).alias("cls"))


_L = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS l{i}" for i in range(1, 5))
_S = " + ".join(f"exp(l{i} - m)" for i in range(1, 5))


@query(f"WITH l AS (SELECT vec_id, {_L} FROM embeddings), m AS (SELECT *, greatest(l1, l2, l3, l4) AS m FROM l) SELECT vec_id, {', '.join(f'round(exp(l{i} - m) / ({_S}), 6) AS p{i - 1}' for i in range(1, 5))} FROM m")
def cloud_softmax(spark, d):
    p = A.logits(spark, d).withColumn("p", P.softmax(F.col("logits")))
    return p.select("vec_id", *[F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(4)])




@query(f"""WITH {A.CLASSES}, g AS (SELECT img, x, y FROM (SELECT DISTINCT img FROM classes), (SELECT unnest(range(24)) AS x), (SELECT unnest(range(24)) AS y)),
 dense AS (SELECT g.img, g.x, g.y, coalesce(cls, 0) AS cls FROM g LEFT JOIN classes c ON g.img = c.img AND g.x = c.x AND g.y = c.y)
 SELECT a.img, a.x, a.y, CAST(max(b.cls) AS INTEGER) AS cls FROM dense a JOIN dense b ON a.img = b.img AND b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY ALL""")
def cloud_dilate(spark, d):
    return clouds.dilated(clouds.densified(A.classes(spark, d), ["img"], 24, 24), ["img"]).select("img", "x", "y", "cls")


CGRID = "cgrid AS (SELECT n_nationkey % 5 AS cx, n_nationkey // 5 AS cy, CAST(100 + n_nationkey AS DOUBLE) / 128 AS c FROM nation)"


@query(f"WITH {A.PIXELS}, {CGRID} SELECT tile, x, y, e, nullif(b03, 0) * coalesce(c, 1) AS b03 FROM pixels LEFT JOIN cgrid ON cx = x AND cy = y")
def nbar_apply(spark, d):
    c = c_grid(spark, d).select(F.col("cx").alias("x"), F.col("cy").alias("y"), "c")
    joined = A.pixels(spark, d).join(c, ["x", "y"], "left")  # the coarse factor grid of an item; broadcast if Spark measures it small
    return joined.select("tile", "x", "y", "e", N.adjusted(P.no_data(F.col("b03")), F.col("c")).alias("b03"))


def c_grid(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return A.read(spark, d, "nation").select((k % 5).cast("long").alias("cx"), F.floor(k / 5).alias("cy"), ((100 + k).cast("double") / 128).alias("c"))


@query(f"""WITH {CGRID}, t AS (SELECT tx, ty, least(tx // 12, 3) AS ix, least(ty // 12, 3) AS iy FROM (SELECT unnest(range(64)) AS tx), (SELECT unnest(range(64)) AS ty)),
 v AS (SELECT tx, ty, ix, iy, a.c AS c00, b.c AS c10, e.c AS c01, f.c AS c11 FROM t JOIN cgrid a ON a.cx = ix AND a.cy = iy JOIN cgrid b ON b.cx = ix + 1 AND b.cy = iy
 JOIN cgrid e ON e.cx = ix AND e.cy = iy + 1 JOIN cgrid f ON f.cx = ix + 1 AND f.cy = iy + 1),
 x AS (SELECT tx, ty, iy, c00 + (tx - ix * 12) * (c10 - c00) / 12 AS lo, c01 + (tx - ix * 12) * (c11 - c01) / 12 AS hi FROM v)
 SELECT tx, ty, round(lo + (ty - iy * 12) * (hi - lo) / 12, 6) AS c FROM x""")
def cfactor_lerp(spark, d):
    """Factors every 120 m, interpolated to 10 m pixels and carried on beyond the last ones."""
    pixels = spark.range(64).select(F.col("id").alias("tx")).crossJoin(spark.range(64).select(F.col("id").alias("ty")))
    return N.interpolated(pixels, c_grid(spark, d), [], 12, "tx", "ty").withColumn("c", F.round("c", 6))


@query(f"""WITH {CHUNKS} SELECT xi, yi, x_off, x_end, y_off, y_end, 300000 + x_off * 10.0::DOUBLE AS "left", 5000000 + y_end * -10.0::DOUBLE AS bottom,
 300000 + x_end * 10.0::DOUBLE AS "right", 5000000 + y_off * -10.0::DOUBLE AS top FROM cells""")
def chunk_grid(spark, d):
    return grid.chunks(spark, 300000.0, 5000000.0, 9000, 10000, 10.0, 4000)


@query(f"""WITH {A.RASTER} SELECT tile, x, y, 300000 + x * 10.0::DOUBLE AS px, 5000000 + y * -10.0::DOUBLE AS py, 300005 + x * 10.0::DOUBLE AS cx, 4999995 + y * -10.0::DOUBLE AS cy FROM raster""")
def coords(spark, d):
    at = lambda o, c, s: P.coordinate(o, F.col(c), s)
    return A.raster(spark, d).select("tile", "x", "y", at(300000.0, "x", 10).alias("px"), at(5000000.0, "y", -10).alias("py"), at(300005.0, "x", 10).alias("cx"), at(4999995.0, "y", -10).alias("cy"))


@query(f"""WITH {A.TILES} SELECT tile, minx + 123 - ((minx + 123) % 60 + 60) % 60 AS "left", maxy + 7 - ((maxy + 7) % 60 + 60) % 60 + 60 AS top FROM tiles""")
def aligned_origin(spark, d):
    left, top = grid.aligned_columns(F.col("minx") + 123, F.col("maxy") + 7, 60.0)
    return A.tiles(spark, d).select("tile", left.alias("left"), top.alias("top"))


@query("""WITH w AS (SELECT event_id AS id, event_id % 140 - 20 AS c, user_id % 150 - 30 AS r, 40 AS w, 25 AS h FROM events),
 g AS (SELECT id, greatest(c, 0) AS g_col, greatest(r, 0) AS g_row, least(c + w, 100) - greatest(c, 0) AS width, least(r + h, 100) - greatest(r, 0) AS height,
 greatest(c, 0) - c AS l_col, greatest(r, 0) - r AS l_row FROM w) SELECT * FROM g WHERE width > 0 AND height > 0""")
def write_window_clip(spark, d):
    e = A.read(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 140 - 20).alias("c"), (F.col("user_id") % 150 - 30).alias("r"))
    cut = grid.clipped_columns(F.col("c"), F.col("r"), F.lit(40), F.lit(25), 100, 100)
    return e.select("id", *[c.cast("long").alias(n) for n, c in cut.items()]).where("width > 0 AND height > 0")


@query("SELECT p_partkey, floor(p_retailprice / 2.5::DOUBLE) * 2.5::DOUBLE AS trimmed, CAST(floor(p_retailprice / 2.5::DOUBLE) AS BIGINT) AS n FROM part")
def bounds_trim(spark, d):
    price = F.col("p_retailprice").cast("double")
    return A.read(spark, d, "part").select("p_partkey", grid.trimmed_column(F.lit(0.0), price, 2.5).alias("trimmed"), grid.counted_columns(price, 2.5)[0].alias("n"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 3000 * 2.5::DOUBLE - 700 AS l, l_suppkey % 500 * 4.0::DOUBLE - 300 AS b, 7320 + l_linenumber * 1.25::DOUBLE AS w, 7320 - l_linenumber * 1.75::DOUBLE AS h FROM lineitem)
 SELECT l_orderkey, l_linenumber, CAST(floor((l - 0) / 10.0::DOUBLE + 0.001::DOUBLE) AS BIGINT) AS col, CAST(floor((9000.0::DOUBLE - (b + h)) / 10.0::DOUBLE + 0.001::DOUBLE) AS BIGINT) AS "row",
 CAST(floor((l + w - l) / 10.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS width, CAST(floor((b + h - b) / 10.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS height FROM b""")
def write_window_rounding(spark, d):
    """Warped windows of lines on a grid of 10 m: offsets down, lengths to the nearest."""
    n = F.col("l_linenumber")
    b = A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3000 * 2.5 - 700).alias("l"), (F.col("l_suppkey") % 500 * 4.0 - 300).alias("b"), (n * 1.25 + 7320).alias("w"), (7320 - n * 1.75).alias("h"))
    l, low = F.col("l"), F.col("b")
    return b.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in grid.window_columns(l, low, l + F.col("w"), low + F.col("h"), grid.Transform(0.0, 9000.0, 10.0)).items()])


_AREA_SQL = f"minx < {AREA[2]} AND maxx > {AREA[0]} AND miny < {AREA[3]} AND maxy > {AREA[1]}"
WINDOWS = f"""{A.TILES}, win AS (SELECT tile, wi, wj, minx + wi * ((maxx - minx) / 15) AS minx, maxy - (wj + 1) * ((maxy - miny) / 15) AS miny, minx + (wi + 1) * ((maxx - minx) / 15) AS maxx,
 maxy - wj * ((maxy - miny) / 15) AS maxy FROM tiles, (SELECT CAST(unnest(range(15)) AS INTEGER) AS wi), (SELECT CAST(unnest(range(15)) AS INTEGER) AS wj)), found AS (SELECT * FROM win WHERE {_AREA_SQL})"""


@query(f"WITH {A.TILES} SELECT * FROM tiles WHERE {_AREA_SQL}")
def tile_aoi_intersect(spark, d):
    return planner.intersecting(A.tiles(spark, d), AREA)


def found_windows(spark, d) -> DataFrame:
    return planner.intersecting(planner.windows(planner.intersecting(A.tiles(spark, d), AREA)), AREA)


@query(f"WITH {WINDOWS} SELECT * FROM found")
def subtile_windows(spark, d):
    return found_windows(spark, d)


COVERED = f"covered AS (SELECT tile, sum((least(maxx, {AREA[2]}) - greatest(minx, {AREA[0]})) * (least(maxy, {AREA[3]}) - greatest(miny, {AREA[1]}))) AS area FROM found GROUP BY tile)"


@query(f"WITH {WINDOWS}, {COVERED} SELECT tile, area, CAST(row_number() OVER (ORDER BY area DESC, tile) AS INTEGER) AS rank FROM covered")
def tile_priority(spark, d):
    return planner.priority(planner.coverage(found_windows(spark, d), AREA))


@query(f"""WITH {WINDOWS}, {COVERED}, cell AS (SELECT found.*, cx, unnest(range(CAST(floor((greatest(miny, {AREA[1]}) - {AREA[1]}) / 2) AS BIGINT), CAST(ceil((least(maxy, {AREA[3]}) - {AREA[1]}) / 2) AS BIGINT))) AS cy
 FROM (SELECT *, unnest(range(CAST(floor((greatest(minx, {AREA[0]}) - {AREA[0]}) / 2) AS BIGINT), CAST(ceil((least(maxx, {AREA[2]}) - {AREA[0]}) / 2) AS BIGINT))) AS cx FROM found) AS found),
 r AS (SELECT cell.tile, wi, wj, row_number() OVER (PARTITION BY cx, cy ORDER BY area DESC, cell.tile, wi, wj) AS rn FROM cell JOIN covered ON cell.tile = covered.tile)
 SELECT DISTINCT tile, wi, wj FROM r WHERE rn = 1""")
def redundancy_elim(spark, d):
    found = found_windows(spark, d)
    return planner.winners(found, planner.coverage(found, AREA), AREA, 2.0)


TARGETS = "t AS (SELECT tx, ty, (({o} + (tx + 0.5::DOUBLE) * {r}) - 0) / 10 - 0.5::DOUBLE AS sx, (80 - (80 - {o} - (ty + 0.5::DOUBLE) * {r})) / 10 - 0.5::DOUBLE AS sy FROM (SELECT unnest(range({n})) AS tx), (SELECT unnest(range({n})) AS ty))"


def targets(spark, n: int, origin: float, res: float) -> DataFrame:
    cells = spark.range(n).select(F.col("id").alias("tx")).crossJoin(spark.range(n).select(F.col("id").alias("ty")))
    return resample.target_pixels(cells, grid.Transform(origin, 80.0 - origin, res), grid.Transform(0.0, 80.0, 10.0))


@query(f"WITH {A.RASTER}, {TARGETS.format(o='2.5::DOUBLE', r='5.0::DOUBLE', n=15)} SELECT tile, tx, ty, value FROM raster JOIN t ON x = floor(sx + 0.5::DOUBLE) AND y = floor(sy + 0.5::DOUBLE)")
def resample_nearest(spark, d):
    return resample.nearest(A.raster(spark, d), targets(spark, 15, 2.5, 5.0), ["tile"])


@query(f"""WITH {A.RASTER}, {TARGETS.format(o='4.0::DOUBLE', r='8.0::DOUBLE', n=9)},
 c AS (SELECT tx, ty, CAST(floor(sx) + i AS BIGINT) AS cx, CAST(floor(sy) + j AS BIGINT) AS cy, CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END * CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END AS w
 FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
 SELECT tile, tx, ty, round(sum(value * w) / sum(w), 6) AS value FROM raster JOIN c ON x = cx AND y = cy WHERE value IS NOT NULL AND w > 0 GROUP BY ALL""")
def resample_bilinear(spark, d):
    return resample.bilinear(A.raster(spark, d), targets(spark, 9, 4.0, 8.0), ["tile"]).withColumn("value", F.round("value", 6))


# a target pixel of 25 m lies on source pixels of 10 m; the area of each that it covers
AREAS = """f AS (SELECT tx, ty, px, py, (least(px + 1, (tx + 1) * 2.5::DOUBLE) - greatest(px, tx * 2.5::DOUBLE)) * (least(py + 1, (ty + 1) * 2.5::DOUBLE) - greatest(py, ty * 2.5::DOUBLE)) AS w
 FROM (SELECT unnest(range(3)) AS tx), (SELECT unnest(range(3)) AS ty), (SELECT unnest(range(8)) AS px), (SELECT unnest(range(8)) AS py)
 WHERE px + 1 > tx * 2.5::DOUBLE AND px < (tx + 1) * 2.5::DOUBLE AND py + 1 > ty * 2.5::DOUBLE AND py < (ty + 1) * 2.5::DOUBLE),
 met AS (SELECT tile, tx, ty, value, w FROM raster JOIN f ON x = px AND y = py WHERE value IS NOT NULL)"""


@query(f"""WITH {A.RASTER}, {AREAS}, m AS (SELECT tile, tx, ty, value, sum(w) AS w FROM met GROUP BY ALL),
 o AS (SELECT tile, tx, ty, value AS mode FROM m QUALIFY row_number() OVER (PARTITION BY tile, tx, ty ORDER BY round(w, 9) DESC, value) = 1)
 SELECT tile, tx, ty, round(sum(value * w) / sum(w), 6) AS average, round(sum(value * w), 6) AS total, round(sqrt(sum(value * value * w) / sum(w)), 6) AS rms, max(value) AS most, min(value) AS least,
 quantile_disc(value, 0.5) AS med, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.75) AS q3, any_value(mode) AS mode FROM met JOIN o USING (tile, tx, ty) GROUP BY ALL""")
def resample_areas(spark, d):
    """Every statistic of the source pixels under larger target pixels."""
    named = {"average": "average", "sum": "total", "rms": "rms", "max": "most", "min": "least", "med": "med", "q1": "q1", "q3": "q3", "mode": "mode"}
    source, to, out = A.raster(spark, d), targets(spark, 3, 0.0, 25.0), None
    for method, name in named.items():
        part = resample.resampled(source, to, ["tile"], method).withColumnRenamed("value", name)
        out = part if out is None else out.join(part, ["tile", "tx", "ty"])
    return out.withColumns({c: F.round(c, 6) for c in ("average", "total", "rms")})


@query(f"""WITH {A.RASTER}, {TARGETS.format(o='3.0::DOUBLE', r='7.0::DOUBLE', n=10)},
 c AS (SELECT tx, ty, CAST(floor(sx) + i AS BIGINT) AS cx, CAST(floor(sy) + j AS BIGINT) AS cy, abs(floor(sx) + i - sx) AS dx, abs(floor(sy) + j - sy) AS dy
 FROM t, (SELECT unnest([-1, 0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1, 2]) AS j)),
 k AS (SELECT tx, ty, cx, cy, CASE WHEN dx < 1 THEN 1.5::DOUBLE * dx ** 3 - 2.5::DOUBLE * dx ** 2 + 1 ELSE -0.5::DOUBLE * dx ** 3 + 2.5::DOUBLE * dx ** 2 - 4 * dx + 2 END
 * CASE WHEN dy < 1 THEN 1.5::DOUBLE * dy ** 3 - 2.5::DOUBLE * dy ** 2 + 1 ELSE -0.5::DOUBLE * dy ** 3 + 2.5::DOUBLE * dy ** 2 - 4 * dy + 2 END AS w FROM c WHERE dx < 2 AND dy < 2)
 SELECT tile, tx, ty, round(sum(value * w) / sum(w), 5) AS value FROM raster JOIN k ON x = cx AND y = cy WHERE value IS NOT NULL GROUP BY ALL HAVING sum(w) > 1e-6::DOUBLE""")
def resample_cubic(spark, d):
    return resample.resampled(A.raster(spark, d), targets(spark, 10, 3.0, 7.0), ["tile"], "cubic").withColumn("value", F.round("value", 5))


@query(f"WITH {A.RASTER} SELECT r.tile, ux, uy, value FROM (SELECT unnest(range(48)) AS ux), (SELECT unnest(range(48)) AS uy) JOIN raster r ON x = ux // 6 AND y = uy // 6")
def upsample_index(spark, d):
    """A 60 m band repeated to 10 m pixels."""
    fine = spark.range(48).select(F.col("id").alias("ux")).crossJoin(spark.range(48).select(F.col("id").alias("uy")))
    indexed = fine.withColumn("x", P.source_index(F.col("ux"), 6)).withColumn("y", P.source_index(F.col("uy"), 6))
    return A.raster(spark, d).join(indexed, ["x", "y"]).select("tile", "ux", "uy", "value")


@query(f"""WITH {A.PIXELS}, {A.RADAR}, s2 AS (SELECT x, y, e, avg(nullif(b03, 0)) AS B03, avg(nullif(b08, 0)) AS B08 FROM pixels GROUP BY ALL),
 s1 AS (SELECT pol || CASE orbit WHEN 'ascending' THEN '_asc' ELSE '_desc' END AS band, x, y, e, avg(nullif(value, 0)) AS value FROM radar GROUP BY ALL)
 SELECT x, y, e, 'B03' AS band, B03 AS value FROM s2 UNION ALL SELECT x, y, e, 'B08', B08 FROM s2 UNION ALL SELECT x, y, e, band, value FROM s1""")
def band_union(spark, d):
    s2 = mosaic_mean(spark, d).select("x", "y", "e", F.col("b03").alias("B03"), F.col("b08").alias("B08"))
    s1 = s1_nodata(spark, d).withColumn("band", P.s1_band(F.col("pol"), F.col("orbit"))).groupBy("band", "x", "y", "e").agg(F.avg("value").alias("value"))
    return composite.joined_bands([composite.melted(s2, ["x", "y", "e"], ["B03", "B08"]), s1.select("x", "y", "e", "band", "value")])


@query(f"""WITH {A.PIXELS}, l AS (SELECT x, y, e, unnest(['B03', 'B08', 'B11']) AS band, unnest([sum(b03), sum(b08), sum(b11)]) AS value FROM pixels GROUP BY x, y, e)
 SELECT x, y, e, band, value, CASE band WHEN 'B03' THEN 0 ELSE 1 END AS ordinal FROM l WHERE band IN ('B11', 'B03')""")
def band_select_order(spark, d):
    sums = A.pixels(spark, d).groupBy("x", "y", "e").agg(*[F.sum(b).alias(b.upper()) for b in BANDS])
    wanted = {"B11", "B03"}  # asked for in this order; saved in canonical order
    return composite.in_order(composite.melted(sums, ["x", "y", "e"], ["B03", "B08", "B11"]), [b for b in S2_BANDS if b in wanted])


@query("SELECT event_id, CAST(least(greatest(round_even(coalesce(value * 200 - 1000.5, 0), 0), 0), 65535) AS INTEGER) AS v FROM events")
def uint16_encode(spark, d):
    return A.read(spark, d, "events").select("event_id", P.uint16(F.col("value") * 200 - 1000.5).alias("v"))


@query("SELECT event_id, event_id % 37 // 10 AS kt, event_id // 3 % 1000 // 250 AS ky, user_id % 1100 // 250 AS kx FROM events")
def zarr_chunk_ids(spark, d):
    e = F.col("event_id")
    places = A.read(spark, d, "events").select("event_id", (e % 37).alias("time_idx"), (F.floor(e / 3) % 1000).alias("y_idx"), (F.col("user_id") % 1100).alias("x_idx"))
    return store.chunk_ids(places, store.Skeleton((0,), ("B02",), 0, 0, 10, 1000, 1100, 32632)).select("event_id", "kt", "ky", "kx")


@query(f"""WITH {A.PIXELS}, v AS (SELECT e, x // 4 AS kx, y // 4 AS ky, CASE WHEN {CLEAR} THEN nullif(b11, 0) END AS v FROM pixels) SELECT e, kx, ky, count(v) AS n FROM v GROUP BY ALL HAVING count(v) > 0""")
def skip_empty_chunks(spark, d):
    cube = snow_free(spark, d).select("e", F.lit(0).alias("time_idx"), F.col("y").alias("y_idx"), F.col("x").alias("x_idx"), F.col("b11").alias("value"))
    small = store.Skeleton((0,), ("B11",), 0, 0, 10, 8, 8, 32632, 1, 4, 4)
    return store.filled_chunks(cube, small, ["e"]).select("e", "kx", "ky", "n")


@query(f"""WITH {A.PIXELS}, {A.CLASSES}, m AS (SELECT tile, x, y, e, avg(nullif(b03, 0)) AS b03, avg(nullif(b08, 0)) AS b08, avg(nullif(b11, 0)) AS b11 FROM pixels GROUP BY ALL),
 k AS (SELECT m.tile, m.x, m.y, e, b03, b08, b11 FROM m LEFT JOIN classes c ON c.img = m.tile AND c.x = m.x AND c.y = m.y WHERE coalesce(cls, 0) = 0),
 s AS (SELECT tile, x, y, unnest(range(CAST(ceil((e - {MONTH // 2}) / {MONTH}) AS BIGINT), CAST(floor((e + {MONTH // 2}) / {MONTH}) AS BIGINT) + 1)) * {MONTH} AS slot,
 CASE WHEN {CLEAR} THEN b03 END AS b03, CASE WHEN {CLEAR} THEN b08 END AS b08, CASE WHEN {CLEAR} THEN b11 END AS b11 FROM k),
 c AS (SELECT tile, x, y, slot, median(b03) AS b03, median(b08) AS b08, median(b11) AS b11 FROM s GROUP BY ALL)
 SELECT tile, slot, 300000 + x * 10.0::DOUBLE AS px, 5000000 + y * -10.0::DOUBLE AS py, {', '.join(f'CAST(least(greatest(round_even(coalesce(CASE WHEN b03 IS NOT NULL AND b08 IS NOT NULL AND b11 IS NOT NULL THEN {b} END, 0), 0), 0), 65535) AS INTEGER) AS {b}' for b in BANDS)} FROM c""")
def end_to_end_cube(spark, d):
    """Mosaic, cloud mask, snow mask, 30-day median, NoData rule, coordinates and encoding."""
    p = A.pixels(spark, d).withColumns({b: P.no_data(F.col(b)) for b in BANDS})
    m = composite.mosaic(p, ["tile", "x", "y", "e"], BANDS)
    classes = A.classes(spark, d).withColumnRenamed("img", "tile")
    kept = m.join(classes, ["tile", "x", "y"], "left").where(F.coalesce("cls", F.lit(0)) == 0)
    clear = composite.apply_mask(kept, BANDS, P.clear_of_snow(*[F.col(b) for b in BANDS]))
    cube = composite.composite(timeaxis.assigned(clear, "e", MONTH), ["tile", "x", "y", "slot"], BANDS, "median")
    return cube.select("tile", "slot", P.coordinate(300000.0, F.col("x"), 10).alias("px"), P.coordinate(5000000.0, F.col("y"), -10).alias("py"), *[P.uint16(F.col(b)).alias(b) for b in BANDS])


def ramp(href: str) -> np.ndarray:
    """A raster made of its own name, "ramp:item:band": 60 x 60 pixels at 10 m, rising by 1 from column to column and by 3 from row to row."""
    _, item, band = href.split(":")
    n = 600 // S2_BANDS[band]
    return (2000 + 7 * int(item) + np.arange(n)[None, :] + 3 * np.arange(n)[:, None]).astype(np.float32) + 100 * list(S2_BANDS).index(band)


_STEP = 2 * DAY


@query(f"""WITH n AS (SELECT n_nationkey AS k, 'T' || CAST(n_nationkey % 2 AS VARCHAR) AS tile, 1590969600 + n_nationkey * 50000 AS e, CASE WHEN n_regionkey < 2 THEN 3 ELSE 5 END AS baseline FROM nation),
 s AS (SELECT * FROM (SELECT n.*, unnest(range(CAST(ceil((e - {_STEP // 2}) / {_STEP}) AS BIGINT), CAST(floor((e + {_STEP // 2}) / {_STEP}) AS BIGINT) + 1)) * {_STEP} AS slot FROM n) WHERE slot BETWEEN 1590969600 AND 1592006400),
 i AS (SELECT slot, CAST(row_number() OVER (ORDER BY slot DESC) - 1 AS INTEGER) AS time_idx FROM (SELECT DISTINCT slot FROM s)),
 g AS (SELECT x_idx, y_idx, 'T' || CAST((x_idx + 10) // 60 AS VARCHAR) AS tile, (x_idx + 10) % 60 AS px, y_idx + 5 AS py FROM (SELECT unnest(range(100)) AS x_idx), (SELECT unnest(range(50)) AS y_idx)),
 b AS (SELECT * FROM (VALUES ('B02', 1, 1), ('B05', 4, 2), ('B11', 10, 2)) AS t(band, o, f)),
 v AS (SELECT slot, band, x_idx, y_idx, CAST(2000 + 7 * k + px // f + 3 * (py // f) + 100 * o AS DOUBLE) AS v, baseline FROM s JOIN g ON s.tile = g.tile, b)
 SELECT time_idx, slot AS "time", band, y_idx, x_idx, avg(CASE WHEN baseline >= 4 THEN greatest(v, 1000) - 1000 ELSE v END) AS value FROM v JOIN i USING (slot) GROUP BY ALL""")
def process_request(spark, d):
    """process() itself: two tiles side by side, an acquisition for each nation, assets as cdse names them, harmonised and averaged every two days."""
    k, folder = F.col("n_nationkey"), F.lit("ramp:")
    assets = F.create_map(*[x for b in ("B02", "B05", "B11") for x in (F.lit(f"{b}_{S2_BANDS[b]}m"), F.concat(folder, k.cast("string"), F.lit(f":{b}")))])
    left, bottom, right, top = transformed_bounds(600000, 4999400, 601200, 5000000, 32632, 4326)[0]
    items = A.read(spark, d, "nation").select(
        F.concat(F.lit("n"), k.cast("string")).alias("item_id"), (1590969600 + k * 50000).cast("long").alias("second"), F.lit("sentinel-2-l2a").alias("collection"), F.concat(F.lit("T"), (k % 2).cast("string")).alias("tile"),
        F.when(F.col("n_regionkey") < 2, 3.0).otherwise(5.0).alias("baseline"), F.lit("ascending").alias("orbit"), assets.alias("assets"),
        F.lit(left).alias("minx"), F.lit(bottom).alias("miny"), F.lit(right).alias("maxx"), F.lit(top).alias("maxy"),
    )
    tiles = spark.createDataFrame([(f"T{i}", 32632, 600000.0 + 600 * i, 4999400.0, 600600.0 + 600 * i, 5000000.0) for i in range(2)], "tile string, epsg int, minx double, miny double, maxx double, maxy double")
    bands = ("B02", "B05", "B11")
    request = CubeSpec(32632, 10, 600100, 4999450, 601100, 4999950, "2020-06-01/2020-06-14", provider="cdse", S1_assets=None, S2_bands=bands, time_composite_freq="2D")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of compositing without a mask
        return process(spark, request, items, tiles, opener=ramp, subtile=20)
