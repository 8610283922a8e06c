"""Views of the test tables as scenes, pixels and tiles, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def second_of(moment: Column) -> Column:
    """Epoch seconds of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), moment)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tile, x, y, e (epoch seconds), b03, b08, b11 as whole digital numbers; 0 is NoData. Several rows may share a pixel."""
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_suppkey") % 2).alias("tile"), (F.col("l_partkey") % 8).alias("x"), (F.col("l_orderkey") % 8).alias("y"), second_of(F.col("l_shipdate")).alias("e"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.floor(F.col("l_extendedprice") / 10).cast("double")).alias("b03"),
        F.when(F.col("l_tax") == 0, 0.0).otherwise(F.floor(F.col("l_quantity") * 200).cast("double")).alias("b08"),
        F.floor(F.col("l_extendedprice") * F.col("l_tax")).cast("double").alias("b11"),
    )


PIXELS = """pixels AS (SELECT l_suppkey % 2 AS tile, l_partkey % 8 AS x, l_orderkey % 8 AS y, CAST(epoch(l_shipdate) AS BIGINT) AS e,
 CASE WHEN l_discount = 0 THEN 0::DOUBLE ELSE floor(l_extendedprice / 10) END AS b03,
 CASE WHEN l_tax = 0 THEN 0::DOUBLE ELSE floor(l_quantity * 200) END AS b08,
 floor(l_extendedprice * l_tax) AS b11 FROM lineitem)"""


def radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pol, orbit, x, y, e, value: Sentinel-1 pixels, 0 is NoData."""
    t = read(spark, sf_dir, "lineitem")
    return t.select(
        F.when(F.col("l_linestatus") == "O", "vv").otherwise("vh").alias("pol"), F.when(F.col("l_suppkey") % 2 == 0, "ascending").otherwise("descending").alias("orbit"),
        (F.col("l_partkey") % 8).alias("x"), (F.col("l_orderkey") % 8).alias("y"), second_of(F.col("l_shipdate")).alias("e"),
        F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("value"),
    )


RADAR = """radar AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'vv' ELSE 'vh' END AS pol, CASE WHEN l_suppkey % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit,
 l_partkey % 8 AS x, l_orderkey % 8 AS y, CAST(epoch(l_shipdate) AS BIGINT) AS e, CASE WHEN l_discount = 0 THEN 0::DOUBLE ELSE l_quantity END AS value FROM lineitem)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes: item_id, second, collection, tile, baseline, orbit, product and a box."""
    t = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    base = t.select("event_id", "user_id", "event_type", second_of(F.col("ts")).alias("second"), k.alias("k"))
    lon = (F.col("user_id") % 36 * 10 - 180).cast("double")
    lat = (F.col("event_id") % 17 * 10 - 80).cast("double")
    tile = F.concat(F.lpad((F.col("user_id") % 60 + 1).cast("string"), 2, "0"), F.lit("TPS"))
    return base.select(
        F.col("event_id").alias("item_id"), "second", F.when(F.col("event_type").isin("click", "view", "signup"), "sentinel-2-l2a").otherwise("sentinel-1-rtc").alias("collection"),
        tile.alias("tile"), (F.col("k") / 10).alias("baseline"), F.when(F.col("event_id") % 2 == 0, "ascending").otherwise("descending").alias("orbit"),
        F.concat(F.lit("S2A_MSIL2A_N"), F.lpad((F.col("k") * 10).cast("string"), 4, "0"), F.lit("_R065_T"), tile, F.lit("_"), F.col("event_id").cast("string")).alias("product"),
        lon.alias("minx"), (lon + 10).alias("maxx"), lat.alias("miny"), (lat + 10).alias("maxy"),
    )


ITEMS = """ev AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS second, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
items AS (SELECT event_id AS item_id, second, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'sentinel-2-l2a' ELSE 'sentinel-1-rtc' END AS collection,
 lpad(CAST(user_id % 60 + 1 AS VARCHAR), 2, '0') || 'TPS' AS tile, k / 10 AS baseline, CASE WHEN event_id % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit,
 'S2A_MSIL2A_N' || lpad(CAST(k * 10 AS VARCHAR), 4, '0') || '_R065_T' || lpad(CAST(user_id % 60 + 1 AS VARCHAR), 2, '0') || 'TPS_' || CAST(event_id AS VARCHAR) AS product,
 CAST(user_id % 36 * 10 - 180 AS DOUBLE) AS minx, CAST(user_id % 36 * 10 - 170 AS DOUBLE) AS maxx, CAST(event_id % 17 * 10 - 80 AS DOUBLE) AS miny, CAST(event_id % 17 * 10 - 70 AS DOUBLE) AS maxy FROM ev)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes in a row: tile, minx, miny, maxx, maxy."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T"), F.lpad(s.cast("string"), 6, "0")).alias("tile"), (s * 90).cast("double").alias("minx"), F.lit(0.0).alias("miny"), (s * 90 + 120).cast("double").alias("maxx"), F.lit(120.0).alias("maxy")
    )


TILES = """tiles AS (SELECT 'T' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS tile, CAST(s_suppkey * 90 AS DOUBLE) AS minx, 0::DOUBLE AS miny,
 CAST(s_suppkey * 90 + 120 AS DOUBLE) AS maxx, 120::DOUBLE AS maxy FROM supplier)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("logits"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class code for some pixels of two images of 24 x 24: img, x, y, cls."""
    t = read(spark, sf_dir, "lineitem")
    return t.groupBy((F.col("l_suppkey") % 2).alias("img"), (F.col("l_partkey") % 24).alias("x"), (F.col("l_orderkey") % 24).alias("y")).agg(F.max(F.when(F.col("l_quantity") >= 50, F.col("l_linenumber") % 4).otherwise(0)).cast("int").alias("cls"))


CLASSES = """classes AS (SELECT l_suppkey % 2 AS img, l_partkey % 24 AS x, l_orderkey % 24 AS y, CAST(max(CASE WHEN l_quantity >= 50 THEN l_linenumber % 4 ELSE 0 END) AS INTEGER) AS cls
 FROM lineitem GROUP BY ALL)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for each pixel of an 8 x 8 raster of tile 0: tile, x, y, value; NULL is NoData."""
    p = pixels(spark, sf_dir)
    return p.groupBy("tile", "x", "y").agg(F.nullif(F.max("b03") % 97, F.lit(0.0)).alias("value"))


RASTER = PIXELS + ", raster AS (SELECT tile, x, y, nullif(max(b03) % 97, 0) AS value FROM pixels GROUP BY ALL)"
