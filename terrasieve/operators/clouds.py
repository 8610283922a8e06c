"""Cloud classes: dilation of the class map, and model inference through a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REACH = 3


def dilated(classes: DataFrame, image: Sequence[str], x: str = "x", y: str = "y", value: str = "cls", reach: int = REACH) -> DataFrame:
    """The largest class within reach pixels each way, in two passes along lines of the image; the grid must be dense.

    Each line is a window of its own, so no task holds an image.
    """
    rows = Window.partitionBy(*image, y).orderBy(x).rangeBetween(-reach, reach)
    columns = Window.partitionBy(*image, x).orderBy(y).rangeBetween(-reach, reach)
    return classes.withColumn(value, F.max(value).over(rows)).withColumn(value, F.max(value).over(columns))


def densified(pixels: DataFrame, image: Sequence[str], width: int, height: int, value: str = "cls", empty: int = 0) -> DataFrame:
    """Every pixel of every image; missing ones hold empty."""
    line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    every = pixels.select(*image).distinct().withColumn("y", line(height)).repartition(*image, "y").withColumn("x", line(width))
    return every.join(pixels, [*image, "x", "y"], "left").withColumn(value, F.coalesce(value, F.lit(empty)))


def stand_in_model(stack: np.ndarray) -> np.ndarray:
    """Logits (4, h, w) from reflectances (bands, h, w): bright is cloud, dark is shadow. Deterministic, for tests and as an example."""
    bright, spread = stack.mean(axis=0), stack.std(axis=0)
    return np.stack([1.0 - bright, 6 * bright - 2.0, 3 * bright - 1.0, 0.2 - 4 * bright + spread])


def scored(blocks: DataFrame, model: Callable[[np.ndarray], np.ndarray] = stand_in_model, pad: int = 2) -> DataFrame:
    """blocks (key, bands, height, width, data of raw numbers, band by band) with probs, four class probabilities for each pixel.

    Blocks are padded by repeating their edge, scaled to reflectance, scored, and cropped again. The model is
    called in Python workers, one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array([])]
            for row in range(batch.num_rows):
                bands, height, width = (batch.column(c)[row].as_py() for c in ("bands", "height", "width"))
                stack = batch.column("data")[row].values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(bands, height, width)
                logits = model(np.pad(stack, ((0, 0), (pad, pad), (pad, pad)), mode="edge") / 10000.0)
                if logits.shape != (4, height + 2 * pad, width + 2 * pad):
                    raise ValueError(f"the cloud model gave {logits.shape} for {stack.shape}")
                logits = logits[:, pad : pad + height, pad : pad + width]
                powers = np.exp(logits - logits.max(axis=0))
                out.append((powers / powers.sum(axis=0)).astype(np.float64).ravel())
            offsets = pa.array(np.cumsum([len(p) for p in out]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out)))], names=["key", "probs"])

    return blocks.select("key", "bands", "height", "width", "data").mapInArrow(run, "key string, probs array<double>")
