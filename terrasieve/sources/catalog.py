"""Scene catalogs: providers that name assets and parse ids, and the item search as filters and joins."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from terrasieve.constants import S2_BANDS

ITEM_SCHEMA = "id string, datetime timestamp, collection string, bbox array<double>, properties map<string,string>, assets map<string,struct<href:string>>"


@dataclass(frozen=True)
class Provider:
    """How a catalog names things; each function maps columns to a column."""

    name: str
    collections: tuple[str, ...]
    tile: Callable[[Column, Column], Column]
    baseline: Callable[[Column, Column], Column]
    asset: Callable[[Column, Column], Column]
    href: Callable[[Column], Column]
    metadata_asset: str


def bare_url(url: Column) -> Column:
    """Without query string; signing needs the bare url."""
    return F.split_part(url, F.lit("?"), F.lit(1))


def parsed(text: Column, pattern: str, what: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit(f"no {what} in "), text)).cast("string")).otherwise(found)


def _native(band: Column) -> Column:
    name = F.when(F.lit(False), "")
    for b, res in S2_BANDS.items():
        name = name.when(band == b, f"{b}_{res}m")
    return name


# Collections, property and asset names, id patterns and path prefix of the public catalogs.
PROVIDERS = {
    p.name: p
    for p in (
        Provider(
            "planetary_computer", ("sentinel-2-l2a", "sentinel-1-rtc"),
            lambda item, properties: properties["s2:mgrs_tile"],
            lambda item, properties: properties["s2:processing_baseline"].cast("double"),
            lambda band, properties: band,
            bare_url,
            "granule-metadata",
        ),
        Provider(
            "cdse", ("sentinel-2-l2a",),
            lambda item, properties: parsed(item, r"_T(\d{2}[A-Z]{3})_", "tile"),
            lambda item, properties: parsed(item, r"_N(\d{4})_", "baseline").cast("double") / 100,
            lambda band, properties: _native(band),
            lambda href: F.when(href.startswith("s3://"), F.concat(F.lit("/vsis3/"), F.substring(href, 6, 1 << 20))).otherwise(href),
            "granule_metadata",
        ),
    )
}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; known: {', '.join(PROVIDERS)}")
    return PROVIDERS[name]


def prepared(items: DataFrame, named: Provider) -> DataFrame:
    """Items as a catalog gives them (format("stac_items")) as process() takes them.

    second is the whole second of the time; tile and baseline are NULL for Sentinel-1, orbit for Sentinel-2. An item without a time or a box is none.
    """
    optical = F.col("collection") == "sentinel-2-l2a"
    box = [F.get("bbox", F.lit(i)) for i in range(4)]
    # a box of six numbers has heights too
    high = [F.when(F.size("bbox") == 6, F.get("bbox", F.lit(i + 1))).otherwise(box[i]) for i in (2, 3)]
    return items.where((F.size("bbox") >= 4) & F.col("datetime").isNotNull() & F.col("collection").isin(list(named.collections))).select(
        F.col("id").alias("item_id"), F.unix_seconds(F.to_timestamp("datetime")).alias("second"), "collection",
        F.when(optical, named.tile(F.col("id"), F.col("properties"))).alias("tile"), F.when(optical, named.baseline(F.col("id"), F.col("properties"))).alias("baseline"),
        F.col("properties")["sat:orbit_state"].alias("orbit"), "assets", box[0].alias("minx"), box[1].alias("miny"), high[0].alias("maxx"), high[1].alias("maxy"),
    )


def within(items: DataFrame, bounds: tuple[float, float, float, float], start: int | None = None, end: int | None = None, collections: tuple[str, ...] = ()) -> DataFrame:
    """Items of the collections whose box meets the bounds (edges count) and whose time lies in the range, ends included."""
    left, bottom, right, top = (float(v) for v in bounds)
    keep = (F.col("minx") <= right) & (F.col("maxx") >= left) & (F.col("miny") <= top) & (F.col("maxy") >= bottom)
    if start is not None:
        keep = keep & (F.col("second") >= start)
    if end is not None:
        keep = keep & (F.col("second") <= end)
    if collections:
        keep = keep & F.col("collection").isin(list(collections))
    return items.where(keep)


def with_retries(call: Callable[[], bytes], attempts: int = 15, most: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """call(), again after 502, 503 and 504 with waiting times that double up to most seconds."""
    for k in range(attempts + 1):
        try:
            return call()
        except urllib.error.HTTPError as error:
            if error.code not in (502, 503, 504) or k == attempts:
                raise
            sleep(min(most, 2.0**k))
    raise AssertionError


class ItemSource(DataSource):
    """Items of STAC pages: format("stac_items") with option pages, a comma-separated list of urls or paths of item collections."""

    @classmethod
    def name(cls) -> str:
        return "stac_items"

    def schema(self) -> str:
        return "id string, datetime string, collection string, bbox array<double>, properties map<string,string>, assets map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _ItemReader([p for p in self.options.get("pages", "").split(",") if p])


class _ItemReader(DataSourceReader):
    def __init__(self, pages: list[str]):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.pages] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        url = partition.value
        if "://" in url:
            body = with_retries(lambda: urllib.request.urlopen(url, timeout=60).read())  # noqa: S310
        else:
            with open(url, "rb") as f:
                body = f.read()
        for item in json.loads(body)["features"]:
            properties = {k: str(v) for k, v in item.get("properties", {}).items()}
            assets = {k: v["href"] for k, v in item.get("assets", {}).items()}
            yield item["id"], properties.get("datetime"), item.get("collection"), [float(x) for x in item["bbox"]], properties, assets


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ItemSource)
