"""Raster blocks: windowed reads of array files into rows.

No raster library is needed: a band file is a .npy array (row, column), opened memory-mapped so that a window reads only
its own pages. opener is pluggable; it maps an href to an object with shape and slicing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_SCHEMA = "href string, col_off long, row_off long, height int, width int, data array<float>, ok boolean, error string"


def open_npy(href: str) -> np.ndarray:
    return np.load(href, mmap_mode="r")


def read_window(source, col: int, row: int, size: int, factor: int) -> np.ndarray:
    """A size x size window at 10 m from a band that is factor times coarser, upsampled by repetition; 0 outside of the raster."""
    c, r = col // factor, row // factor
    n = -(-size // factor) + 1
    high, wide = source.shape
    r0, r1, c0, c1 = max(r, 0), min(r + n, high), max(c, 0), min(c + n, wide)
    block = np.zeros((n, n), np.float32)
    if r0 < r1 and c0 < c1:
        block[r0 - r : r1 - r, c0 - c : c1 - c] = source[r0:r1, c0:c1]
    at = lambda off, first: (off + np.arange(size)) // factor - first
    return block[np.ix_(at(row, r), at(col, c))]


def read_blocks(requests: DataFrame, size: int, opener: Callable[[str], object] = open_npy) -> DataFrame:
    """requests (href, col_off, row_off, factor) with the data of their windows.

    Rows are clustered by href, and a task keeps the file it has open. A file that can't be read gives ok = false
    and the error instead of ending the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, source = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data, error = None, None
                try:
                    if r["href"] != last:
                        source, last = opener(r["href"]), r["href"]
                    data = read_window(source, r["col_off"], r["row_off"], size, r["factor"]).ravel()
                except (OSError, ValueError) as e:
                    last, error = None, f"{type(e).__name__}: {e}"
                rows.append((r["href"], r["col_off"], r["row_off"], size, size, data, error is None, error))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.bool_(), pa.string())
            names = ["href", "col_off", "row_off", "height", "width", "data", "ok", "error"]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    asked = requests.select("href", F.col("col_off").cast("long"), F.col("row_off").cast("long"), F.col("factor").cast("int"))
    return asked.repartition("href").sortWithinPartitions("href").mapInArrow(run, BLOCK_SCHEMA)


def pixels_of(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y (in the whole raster) and value of each pixel of good blocks; 0 is NULL."""
    good = blocks.where("ok").select(*keys, "col_off", "row_off", "width", F.posexplode("data").alias("at", "value"))
    return good.select(
        *keys,
        (F.col("col_off") + F.col("at") % F.col("width")).alias("x"),
        (F.col("row_off") + F.floor(F.col("at") / F.col("width"))).alias("y"),
        F.nullif(F.col("value").cast("double"), F.lit(0.0)).alias("value"),
    )
