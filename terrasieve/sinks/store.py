"""Cube sinks: a partitioned Parquet cube, and a Zarr (version 3) store that tasks fill chunk by chunk."""

from __future__ import annotations

import itertools
import json
import math
import os
import shutil
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasieve.constants import S2_BANDS, TIME_ATTRIBUTES
from terrasieve.functions.pixels import uint16


@dataclass(frozen=True)
class Skeleton:
    """Axes and layout of a cube; times are epoch seconds."""

    times: tuple[int, ...]
    bands: tuple[str, ...]
    left: float
    top: float
    res: float
    height: int
    width: int
    crs: int
    chunk_time: int = 10
    chunk_y: int = 250
    chunk_x: int = 250
    as_uint16: bool = False
    center: bool = False

    @property
    def axis(self) -> list[int]:
        """Distinct times, latest first."""
        return sorted(set(self.times), reverse=True)

    @property
    def x(self) -> np.ndarray:
        return (self.left + (self.res / 2 if self.center else 0) + np.arange(self.width) * self.res).astype(np.float32)

    @property
    def y(self) -> np.ndarray:
        return (self.top - (self.res / 2 if self.center else 0) - np.arange(self.height) * self.res).astype(np.float32)

    @property
    def shape(self) -> tuple[int, int, int, int]:
        return len(self.axis), len(self.bands), self.height, self.width

    @property
    def chunks(self) -> tuple[int, int, int, int]:
        """Sentinel-1 and Sentinel-2 bands lie in different chunks."""
        s2 = sum(b in S2_BANDS for b in self.bands)
        return self.chunk_time, s2 or len(self.bands), self.chunk_y, self.chunk_x

    @property
    def dtype(self) -> str:
        return "uint16" if self.as_uint16 else "float32"


def write_parquet(cube: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Valid pixels only, partitioned by band and time, so a request prunes to the files it needs."""
    cube.where("value is not null").repartition("band", "time").sortWithinPartitions("band", "time", "y_idx", "x_idx").write.mode(mode).partitionBy("band", "time").parquet(path)


def _array(path: str, shape: Sequence[int], chunks: Sequence[int], dtype: str, fill, names: Sequence[str], attributes: dict) -> None:
    os.makedirs(path, exist_ok=True)
    meta = {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype,
        "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [max(1, c) for c in chunks]}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
        "fill_value": fill, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}],
        "dimension_names": list(names), "attributes": attributes,
    }
    with open(f"{path}/zarr.json", "w") as f:
        json.dump(meta, f)


def _coordinate(path: str, values: np.ndarray, dtype: str, name: str, attributes: dict) -> None:
    _array(path, values.shape, values.shape or (), dtype, 0, [name] if values.ndim else [], attributes)
    target = f"{path}/c/0" if values.ndim else f"{path}/c"
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as f:
        f.write(values.astype(values.dtype.newbyteorder("<")).tobytes())


def create_zarr(path: str, s: Skeleton, overwrite: bool = False, consolidate: bool = True, wkt: str = "") -> None:
    """Groups, coordinates and the empty array; chunks come later."""
    if os.path.exists(path):
        if not overwrite:
            raise FileExistsError(path)
        shutil.rmtree(path)
    os.makedirs(path)
    root = {"zarr_format": 3, "node_type": "group", "attributes": {"crs_wkt": wkt or f"EPSG:{s.crs}"}}
    fill = 0 if s.as_uint16 else "NaN"
    _array(f"{path}/cube", s.shape, s.chunks, s.dtype, fill, ("time", "band", "y", "x"), {"grid_mapping": "spatial_ref", "coordinates": "spatial_ref"})
    _coordinate(f"{path}/x", s.x, "float32", "x", {"standard_name": "projection_x_coordinate"})
    _coordinate(f"{path}/y", s.y, "float32", "y", {"standard_name": "projection_y_coordinate"})
    _coordinate(f"{path}/time", np.array(s.axis, np.int64), "int64", "time", TIME_ATTRIBUTES)
    _coordinate(f"{path}/spatial_ref", np.array(0, np.int64), "int64", "", {"crs_wkt": wkt or f"EPSG:{s.crs}", "spatial_ref": f"EPSG:{s.crs}"})
    names = [b.encode("utf-32-le") for b in s.bands]
    longest = max(map(len, names), default=4)
    _array(f"{path}/band", (len(names),), (len(names),), "fixed_length_utf32", "", ["band"], {})
    meta = json.load(open(f"{path}/band/zarr.json"))
    meta["data_type"] = {"name": "fixed_length_utf32", "configuration": {"length_bytes": longest}}
    json.dump(meta, open(f"{path}/band/zarr.json", "w"))
    os.makedirs(f"{path}/band/c")
    with open(f"{path}/band/c/0", "wb") as f:
        f.write(b"".join(n.ljust(longest, b"\0") for n in names))
    if consolidate:
        root["consolidated_metadata"] = {"kind": "inline", "must_understand": False, "metadata": {n: json.load(open(f"{path}/{n}/zarr.json")) for n in ("cube", "x", "y", "time", "band", "spatial_ref")}}
    with open(f"{path}/zarr.json", "w") as f:
        json.dump(root, f)


def fill_zarr(cube: DataFrame, path: str, s: Skeleton) -> int:
    """Writes cube (time_idx, band, y_idx, x_idx, value) into the store and gives the number of chunks written.

    All pixels of a chunk meet in one task, which alone owns its file, so nothing is locked and a task that runs again
    writes the same bytes. Chunks without a valid pixel are left out. path must be on storage that all executors share.
    """
    ct, cb, cy, cx = s.chunks
    band = F.create_map(*itertools.chain.from_iterable((F.lit(b), F.lit(i)) for i, b in enumerate(s.bands)))[F.col("band")]
    valid = cube.where("value is not null").withColumn("b", band)
    if s.as_uint16:
        valid = valid.withColumn("value", uint16(F.col("value")).cast("double"))
    cell = lambda c, size: F.floor(F.col(c) / size).cast("int")
    placed = valid.select(
        cell("time_idx", ct).alias("kt"), cell("b", cb).alias("kb"), cell("y_idx", cy).alias("ky"), cell("x_idx", cx).alias("kx"),
        (((F.col("time_idx") % ct * cb + F.col("b") % cb) * cy + F.col("y_idx") % cy) * cx + F.col("x_idx") % cx).cast("long").alias("at"),
        F.col("value").cast("double"),
    )
    size, dtype = ct * cb * cy * cx, s.dtype

    def write(key, table):
        out = np.full(size, 0 if dtype == "uint16" else np.nan, "<u2" if dtype == "uint16" else "<f4")
        out[table.column("at").to_numpy()] = table.column("value").to_numpy().astype(out.dtype)
        folder = f"{path}/cube/c/" + "/".join(str(k.as_py()) for k in key[:3])
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{key[3].as_py()}"
        part = f"{name}.part{TaskContext.get().taskAttemptId()}"  # no two attempts share a number, on whatever machine
        with open(part, "wb") as f:
            f.write(out.tobytes())
        os.replace(part, name)
        return pa.table({"chunk": ["/".join(str(k.as_py()) for k in key)]})

    chunks = [r["chunk"] for r in placed.groupBy("kt", "kb", "ky", "kx").applyInArrow(write, "chunk string").collect()]  # names of one request's chunks
    lost = [c for c in chunks if not os.path.exists(f"{path}/cube/c/{c}")]
    if lost:
        raise OSError(f"{len(lost)} of {len(chunks)} chunks aren't in {path}: executors must share that folder")
    return len(chunks)


def read_zarr(path: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The array and its coordinates, for checks of small cubes."""
    meta = json.load(open(f"{path}/cube/zarr.json"))
    chunks, shape = meta["chunk_grid"]["configuration"]["chunk_shape"], meta["shape"]
    kind = "<u2" if meta["data_type"] == "uint16" else "<f4"
    data = np.full(shape, 0 if kind == "<u2" else np.nan, kind)
    for at in itertools.product(*(range(math.ceil(n / c)) for n, c in zip(shape, chunks, strict=True))):
        name = f"{path}/cube/c/" + "/".join(map(str, at))
        if os.path.exists(name):
            block = np.fromfile(name, kind).reshape(chunks)
            where = tuple(slice(a * c, min((a + 1) * c, n)) for a, c, n in zip(at, chunks, shape, strict=True))
            data[where] = block[tuple(slice(0, w.stop - w.start) for w in where)]
    axes = {n: np.fromfile(f"{path}/{n}/c/0", d) for n, d in (("x", "<f4"), ("y", "<f4"), ("time", "<i8"))}
    length = json.load(open(f"{path}/band/zarr.json"))["data_type"]["configuration"]["length_bytes"]
    raw = open(f"{path}/band/c/0", "rb").read()
    axes["band"] = np.array([raw[i : i + length].decode("utf-32-le").rstrip("\0") for i in range(0, len(raw), length)])
    return data, axes


def filled_chunks(cube: DataFrame, s: Skeleton, keys: Sequence[str] = ()) -> DataFrame:
    """keys, kt, ky, kx and n, the valid pixels, of the chunks that have one; no other chunk is written."""
    return chunk_ids(cube.where("value is not null"), s).groupBy(*keys, "kt", "ky", "kx").agg(F.count(F.lit(1)).alias("n"))


def chunk_ids(cube: DataFrame, s: Skeleton) -> DataFrame:
    ct, _, cy, cx = s.chunks
    return cube.withColumns({"kt": F.floor(F.col("time_idx") / ct), "ky": F.floor(F.col("y_idx") / cy), "kx": F.floor(F.col("x_idx") / cx)})

