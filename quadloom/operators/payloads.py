"""Images as arrays, encoded payloads, and pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_images(images: DataFrame, height: int, width: int, channels: int, data: str = "data") -> DataFrame:
    """``images`` with payload, the PNG of the array ``data``, in place of it."""
    from ..functions.codec import encode_png

    kept = [c for c in images.columns if c != data]
    at = [images.columns.index(c) for c in kept]
    held = images.columns.index(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_png(np.array(x, np.uint8).reshape(height, width, channels)) for x in b.column(held).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in at] + [pa.array(made, pa.binary())], [*kept, "payload"])

    schema = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in kept)
    return images.mapInArrow(run, f"{schema}, payload binary")


def decode_images(tiles: DataFrame, payload: str = "payload") -> DataFrame:
    """``tiles`` with height, width, channels and data in place of the payload; a payload that can't be read has nulls."""
    from ..functions.codec import decode_png, is_png

    kept = [c for c in tiles.columns if c != payload]
    at = [tiles.columns.index(c) for c in kept]
    held = tiles.columns.index(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            images = [decode_png(x) if is_png(x) else None for x in b.column(held).to_pylist()]
            shape = [pa.array([None if x is None else x.shape[k] for x in images], pa.int32()) for k in range(3)]
            data = pa.array([None if x is None else x.ravel().astype(np.int32) for x in images], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in at] + [*shape, data], [*kept, "height", "width", "channels", "data"])

    schema = ", ".join(f"`{c}` {tiles.schema[c].dataType.simpleString()}" for c in kept)
    return tiles.mapInArrow(run, f"{schema}, height int, width int, channels int, data array<int>")


def pixels(decoded: DataFrame) -> DataFrame:
    """``decoded`` with a row for each number: (row, col, ch, value)."""
    kept = [c for c in decoded.columns if c not in ("height", "width", "channels", "data")]
    each = decoded.select(*kept, "width", "channels", F.posexplode("data").alias("k", "value"))
    wide = F.col("width") * F.col("channels")
    return each.select(*kept, F.floor(F.col("k") / wide).cast("int").alias("row"), F.floor((F.col("k") % wide) / F.col("channels")).cast("int").alias("col"), (F.col("k") % F.col("channels")).cast("int").alias("ch"), "value")
