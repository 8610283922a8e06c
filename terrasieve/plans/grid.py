"""The output grid: pixel counts, chunks, transforms, windows. Plain arithmetic on the driver, and columns for tables of windows."""

from __future__ import annotations

import math
import warnings
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A span may differ from a whole number of pixels by this share of one.
TOLERANCE = 1e-6


class Window(NamedTuple):
    col: int
    row: int
    width: int
    height: int


class Transform(NamedTuple):
    """North-up: x = left + column * res, y = top - row * res."""

    left: float
    top: float
    res: float


def counted(span: float, res: float) -> tuple[int, bool]:
    """Whole pixels that fit a span, and whether they fill it."""
    n = abs(span) / res
    full = abs(n - round(n)) <= TOLERANCE
    return (round(n) if full else math.floor(n)), full


def pixels(span: float, res: float) -> int:
    """Whole pixels of a span; ValueError unless they fill it."""
    n, full = counted(span, res)
    if not full:
        raise ValueError(f"{span} isn't a multiple of {res}")
    return n


def trimmed(left: float, bottom: float, right: float, top: float, res: float) -> tuple[float, float, float, float]:
    """The bounds with right and top moved in to whole pixels, with a warning where that changes them."""
    out = []
    for low, high in ((left, right), (bottom, top)):
        n, full = counted(high - low, res)
        if not full:
            warnings.warn("the bounds are no whole number of pixels and are trimmed", stacklevel=2)
            high = low + n * res
        out.append((low, high))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def shape(left: float, bottom: float, right: float, top: float, res: float) -> tuple[int, int]:
    """Height and width."""
    return pixels(top - bottom, res), pixels(right - left, res)


def transform(left: float, bottom: float, right: float, top: float, res: float) -> Transform:
    shape(left, bottom, right, top, res)
    return Transform(left, top, res)


def bounds(t: Transform, height: int, width: int) -> tuple[float, float, float, float]:
    return t.left, t.top - height * t.res, t.left + width * t.res, t.top


def aligned(left: float, bottom: float, right: float, top: float, res: float) -> tuple[Transform, int, int]:
    """A grid whose origin is a multiple of res and that covers the bounds, one pixel larger each way."""
    width, height = math.ceil((right - left) / res) + 1, math.ceil((top - bottom) / res) + 1
    return Transform(left - left % res, top - top % res + res, res), height, width


def overlaps(w: Window, height: int, width: int) -> bool:
    return min(width, w.col + w.width) > max(0, w.col) and min(height, w.row + w.height) > max(0, w.row)


def clipped(w: Window, height: int, width: int) -> tuple[Window, Window]:
    """The part of a window that lies on the grid, and the same part in the window's own pixels."""
    col, row = max(w.col, 0), max(w.row, 0)
    wide, high = min(w.col + w.width, width) - col, min(w.row + w.height, height) - row
    if wide <= 0 or high <= 0:
        raise AssertionError("the window lies beside the grid")
    return Window(col, row, wide, high), Window(col - w.col, row - w.row, wide, high)


def chunks(spark: SparkSession, left: float, top: float, height: int, width: int, res: float, size: int) -> DataFrame:
    """xi, yi, x_off, x_end, y_off, y_end and bounds of the chunks that tile the grid, rows counted from the top."""
    x = spark.range(math.ceil(width / size)).select(F.col("id").alias("xi"))
    y = spark.range(math.ceil(height / size)).select(F.col("id").alias("yi"))
    cells = x.crossJoin(y).select(
        "xi", "yi",
        (F.col("xi") * size).alias("x_off"), F.least((F.col("xi") + 1) * size, F.lit(width).cast("long")).alias("x_end"),
        (F.col("yi") * size).alias("y_off"), F.least((F.col("yi") + 1) * size, F.lit(height).cast("long")).alias("y_end"),
    )
    at = lambda origin, c, sign: F.lit(float(origin)) + F.col(c) * F.lit(sign * float(res))
    return cells.select("*", at(left, "x_off", 1).alias("left"), at(top, "y_end", -1).alias("bottom"), at(left, "x_end", 1).alias("right"), at(top, "y_off", -1).alias("top"))


def counted_columns(span: Column, res: float) -> tuple[Column, Column]:
    """counted() for a table of spans."""
    n = F.abs(span) / F.lit(float(res))
    full = F.abs(n - F.rint(n)) <= TOLERANCE
    return F.when(full, F.rint(n)).otherwise(F.floor(n)).cast("long"), full


def trimmed_column(low: Column, high: Column, res: float) -> Column:
    """The upper end that trimmed() gives, for a table of bounds."""
    n, full = counted_columns(high - low, res)
    return F.when(full, high).otherwise(low + n * F.lit(float(res)))


def aligned_columns(left: Column, top: Column, res: float) -> tuple[Column, Column]:
    """The origin that aligned() gives, for a table of bounds."""
    step = F.lit(float(res))
    return left - F.pmod(left, step), top - F.pmod(top, step) + step


def window(left: float, bottom: float, right: float, top: float, t: Transform) -> Window:
    """The window of bounds on a grid: offsets go down unless they lack less than a thousandth, lengths to the nearest whole number."""
    col, row = math.floor((left - t.left) / t.res + 0.001), math.floor((t.top - top) / t.res + 0.001)
    return Window(col, row, math.floor((right - left) / t.res + 0.5), math.floor((top - bottom) / t.res + 0.5))


def window_columns(left: Column, bottom: Column, right: Column, top: Column, t: Transform) -> dict[str, Column]:
    """window() for a table of bounds."""
    res = F.lit(float(t.res))
    down = lambda v, more: F.floor(v / res + more).cast("long")
    return {"col": down(left - t.left, 0.001), "row": down(F.lit(float(t.top)) - top, 0.001), "width": down(right - left, 0.5), "height": down(top - bottom, 0.5)}


def clipped_columns(col: Column, row: Column, width: Column, height: Column, grid_height: int, grid_width: int) -> dict[str, Column]:
    """clipped() for a table of windows; keep rows with width and height above 0 only."""
    g_col, g_row = F.greatest(col, F.lit(0)), F.greatest(row, F.lit(0))
    return {
        "g_col": g_col,
        "g_row": g_row,
        "width": F.least(col + width, F.lit(grid_width)) - g_col,
        "height": F.least(row + height, F.lit(grid_height)) - g_row,
        "l_col": g_col - col,
        "l_row": g_row - row,
    }
