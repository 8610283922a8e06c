"""Which windows of which tiles to read: boxes against the area, and removal of windows that earlier tiles cover."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasieve.constants import SUBTILE, TILE_PIXELS

Box = tuple[float, float, float, float]


def overlap(low1, high1, low2, high2) -> Column:
    return F.least(high1, high2) - F.greatest(low1, low2)


def intersecting(boxes: DataFrame, area: Box) -> DataFrame:
    """Boxes that share more than an edge with the area; range filters that reach the scan."""
    left, bottom, right, top = (float(v) for v in area)
    return boxes.where((F.col("minx") < right) & (F.col("maxx") > left) & (F.col("miny") < top) & (F.col("maxy") > bottom))


def windows(tiles: DataFrame, per_side: int = TILE_PIXELS // SUBTILE) -> DataFrame:
    """tile, wi, wj and bounds of the windows of each tile, rows counted from the top."""
    side = F.sequence(F.lit(0), F.lit(per_side - 1))
    w, h = (F.col("maxx") - F.col("minx")) / per_side, (F.col("maxy") - F.col("miny")) / per_side
    each = tiles.select("tile", "minx", "miny", "maxx", "maxy", F.explode(side).alias("wi")).withColumn("wj", F.explode(side))
    return each.select(
        "tile", "wi", "wj",
        (F.col("minx") + F.col("wi") * w).alias("minx"), (F.col("maxy") - (F.col("wj") + 1) * h).alias("miny"),
        (F.col("minx") + (F.col("wi") + 1) * w).alias("maxx"), (F.col("maxy") - F.col("wj") * h).alias("maxy"),
    )


def coverage(found: DataFrame, area: Box) -> DataFrame:
    """tile, area: how much of the area each tile's windows cover."""
    left, bottom, right, top = (F.lit(float(v)) for v in area)
    size = overlap(F.col("minx"), F.col("maxx"), left, right) * overlap(F.col("miny"), F.col("maxy"), bottom, top)
    return found.groupBy("tile").agg(F.sum(size).alias("area"))


def priority(covered: DataFrame) -> DataFrame:
    """Tiles by covered area, the largest first, then by name; there is a row for each tile of one area only."""
    return covered.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("area"), "tile")))


def winners(found: DataFrame, covered: DataFrame, area: Box, cell: float) -> DataFrame:
    """Windows that own at least one cell of a regular grid over the area; a cell goes to its first tile by priority.

    Relational and stricter than keep_windows(): cells are compared, not exact areas.
    """
    left, bottom, right, top = (float(v) for v in area)
    clip = lambda c, low, high: F.least(F.greatest(c, F.lit(low)), F.lit(high))
    span = lambda low, high, origin: F.sequence(F.floor((low - origin) / cell).cast("long"), (F.ceil((high - origin) / cell) - 1).cast("long"))
    cells = (
        intersecting(found, area)
        .withColumn("cx", F.explode(span(clip(F.col("minx"), left, right), clip(F.col("maxx"), left, right), left)))
        .withColumn("cy", F.explode(span(clip(F.col("miny"), bottom, top), clip(F.col("maxy"), bottom, top), bottom)))
    )
    ranked = cells.join(covered, "tile").groupBy("cx", "cy").agg(F.min_by(F.struct("tile", "wi", "wj"), F.struct(-F.col("area"), F.col("tile"), F.col("wi"), F.col("wj"))).alias("w"))
    return ranked.select("w.tile", "w.wi", "w.wj").distinct()


def _minus(box: Box, other: Box) -> list[Box]:
    l, b, r, t = box
    ol, ob, o_r, ot = max(l, other[0]), max(b, other[1]), min(r, other[2]), min(t, other[3])
    if ol >= o_r or ob >= ot:
        return [box]
    return [p for p in ((l, b, ol, t), (o_r, b, r, t), (ol, b, o_r, ob), (ol, ot, o_r, t)) if p[0] < p[2] and p[1] < p[3]]


def keep_windows(tiles: dict[str, list[tuple[tuple[int, int], Box]]], area: Box, least: float = 1e-6) -> list[tuple[str, tuple[int, int]]]:
    """The windows to read, exactly: tiles by covered area and name; a window stays if more than least of its whole footprint is unclaimed.

    What a tile claims is clipped to the area, so windows at the area's edge stay. Plain box algebra for one area's plan.
    """

    def clip(box: Box) -> Box:
        return max(box[0], area[0]), max(box[1], area[1]), min(box[2], area[2]), min(box[3], area[3])

    def size(boxes: Iterable[Box]) -> float:
        return sum(max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) for b in boxes)

    claimed: list[Box] = []
    kept = []
    for name in sorted(tiles, key=lambda n: (-size(clip(b) for _, b in tiles[n]), n)):
        mine = []
        for key, box in tiles[name]:
            free = [box]
            for c in claimed:
                free = [p for f in free for p in _minus(f, c)]
            if size(free) > least * size([box]):
                kept.append((name, key))
                mine.append(clip(box))
        claimed += [b for b in mine if b[0] < b[2] and b[1] < b[3]]
    return kept
