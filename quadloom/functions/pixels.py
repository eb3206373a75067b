"""Pixel arrays as Spark columns: rows, then columns, then channels.

All are array expressions of the JVM.  Sizes are Python numbers, because a
tile archive has one tile size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import once


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def _pick(data: Column, n: int, at: Callable[[Column, Column], Column]) -> Column:
    """at(data, k) for k below n."""
    return once(data, lambda d: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: at(d, k)))


def remove_channels(data: Column, channels: int, drop: list[int]) -> Column:
    """The other channels in order; numbers beyond the channels do nothing."""
    return F.filter(data, lambda v, i: ~(i % channels).isin(drop or [-1]))


def channels_first(data: Column, height: int, width: int, channels: int) -> Column:
    n = height * width
    return _pick(data, n * channels, lambda d, k: F.get(d, (k % n) * channels + _div(k, n)))


def half_resolution(data: Column, width: int, channels: int) -> Column:
    """Every second row and column, from the first."""
    return F.filter(data, lambda v, i: (_div(i, channels * width) % 2 == 0) & (_div(i, channels) % width % 2 == 0))


def ensure_alpha(data: Column, pixels: int, channels: int, full: int = 255) -> Column:
    """Four channels: as they are, or the first three and a full alpha."""
    if channels == 4:
        return data
    return _pick(data, pixels * 4, lambda d, k: F.when(k % 4 == 3, F.lit(full)).otherwise(F.get(d, _div(k, 4) * channels + k % 4)))


def add_blank_channel(data: Column, pixels: int, channels: int, position: int = 0, fill: int = 0) -> Column:
    """A constant channel before channel ``position``."""
    wide = channels + 1
    source = lambda k: _div(k, wide) * channels + k % wide - (k % wide > position).cast("int")
    return _pick(data, pixels * wide, lambda d, k: F.when(k % wide == position, F.lit(fill)).otherwise(F.get(d, source(k))))


def scale_channels(data: Column, low: Column | None = None, high: Column | None = None, top: int = 255) -> Column:
    """Values clipped to [low, high] and stretched to [0, top], cut to integers; zeros if the range is empty."""
    own = F.struct(data.alias("d"), (F.array_min(data) if low is None else low).alias("lo"), (F.array_max(data) if high is None else high).alias("hi"))

    def stretch(s: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        return F.transform(s["d"], lambda v: F.when(hi == lo, 0).otherwise((F.least(F.greatest(v, lo), hi) - lo) / (hi - lo) * top).cast("int"))

    return once(own, stretch)


def sar_scale(value: Column, wrap: bool = False) -> Column:
    """Backscatter in thousandths to a byte.

    Saturated values become 255.  With ``wrap`` they become 0, as in archives
    written by a scale of 256 and a cast that wraps.
    """
    unit = F.least(F.greatest(value / 1000, F.lit(0.0)), F.lit(1.0))
    return (F.floor(unit * 256) % 256).cast("int") if wrap else F.floor(unit * 255).cast("int")


def zero_alpha_share(data: Column, channels: int = 4) -> Column:
    """Share of pixels with alpha 0; null without an alpha channel or without pixels."""
    if channels != 4:
        return F.lit(None).cast("double")
    alpha = F.filter(data, lambda v, i: i % 4 == 3)
    return F.when(F.size(alpha) > 0, F.size(F.filter(alpha, lambda v: v == 0)) / F.size(alpha))


def band_stack(a: Column, b: Column) -> Column:
    """Two single bands as one two-channel array."""
    return F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.array(p["a"], p["b"])))


def patchify(data: Column, height: int, width: int, channels: int, patch: int) -> Column:
    """Channels-first array to patches in row order, each with its channels, rows, columns."""
    across, size = width // patch, channels * patch * patch

    def at(d: Column, k: Column) -> Column:
        p, e = _div(k, size), k % size
        row = _div(p, across) * patch + _div(e, patch) % patch
        return F.get(d, _div(e, patch * patch) * (height * width) + row * width + (p % across) * patch + e % patch)

    return _pick(data, height * width * channels, at)


def unpatchify(data: Column, height: int, width: int, channels: int, patch: int) -> Column:
    """The inverse of ``patchify``."""
    across, size = width // patch, channels * patch * patch

    def at(d: Column, k: Column) -> Column:
        ch, row, col = _div(k, height * width), _div(k, width) % height, k % width
        p = _div(row, patch) * across + _div(col, patch)
        return F.get(d, p * size + ch * patch * patch + (row % patch) * patch + col % patch)

    return _pick(data, height * width * channels, at)
