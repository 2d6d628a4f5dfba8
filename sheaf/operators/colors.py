"""Colour arithmetic on components from 0 to 1, clamped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rgb = tuple[Column, Column, Column]


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def luma(rgb: Rgb) -> Column:
    return 0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]


def grayscale(rgb: Rgb) -> Rgb:
    y = luma(rgb)
    return y, y, y


def inverted(rgb: Rgb) -> Rgb:
    return tuple(1 - c for c in rgb)


def adjusted(rgb: Rgb, brightness: float = 0.0, contrast: float = 1.0, saturation: float = 1.0, gamma: float = 1.0) -> Rgb:
    """Brightness, contrast around the middle, saturation around the luma, then gamma."""
    out = tuple(_clamped((c + brightness - 0.5) * contrast + 0.5) for c in rgb)
    y = luma(out)
    return tuple(F.pow(_clamped(y + (c - y) * saturation), F.lit(1 / gamma)) for c in out)


def replaced(rgb: Rgb, old: tuple[float, float, float], new: tuple[float, float, float], tolerance: float) -> Rgb:
    """Colours within the tolerance of `old`, by the largest difference of a component, become `new`."""
    far = F.greatest(*[F.abs(c - o) for c, o in zip(rgb, old, strict=True)])
    return tuple(F.when(far <= tolerance, n).otherwise(c) for c, n in zip(rgb, new, strict=True))
