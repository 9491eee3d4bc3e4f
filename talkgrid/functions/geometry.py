"""Box arithmetic and layout rules for video tiles, and their numpy counterparts on pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Share of the tile's height, least and most pixels of the name strip, and its most width.
BAND_SHARE, BAND_LEAST, BAND_MOST, BAND_WIDE = 0.22, 24, 64, 560


def normalize_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    return F.struct((x / width).alias("x"), (y / height).alias("y"), (w / width).alias("w"), (h / height).alias("h"))


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """Pixels of a normalised box, halves to even."""
    px = lambda v, n: F.bround(v * n, 0).cast("int")
    return F.struct(px(box["x"], width).alias("x"), px(box["y"], height).alias("y"), px(box["w"], width).alias("w"), px(box["h"], height).alias("h"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    side = lambda p, n: F.greatest(F.lit(0.0), F.least(a[p] + a[n], b[p] + b[n]) - F.greatest(a[p], b[p]))
    both = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def name_band(tile: Column, width: Column, height: Column) -> Column:
    """The name strip at the bottom left of a tile, inside the frame, as a normalised box."""
    t = to_pixels(tile, width, height)
    h = F.least(F.greatest(F.bround(F.lit(BAND_SHARE) * t["h"], 0).cast("int"), F.lit(BAND_LEAST)), F.lit(BAND_MOST), t["h"])
    w = F.least(t["w"], F.lit(BAND_WIDE))
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v, F.greatest(F.lit(0), most)))
    return normalize_box(inside(t["x"], width - w), inside(t["y"] + t["h"] - h, height - h), w, h, width, height)


def layout(tiles: Column) -> Column:
    """`unknown` without tiles, `full_frame` or `screen_share_pip` with one, `gallery` with more."""
    one = F.get(tiles, F.lit(0))
    large = (one["w"] * one["h"] >= 0.6) | (one["h"] >= 0.95)
    return F.when(F.size(tiles) >= 2, "gallery").when(F.size(tiles) == 1, F.when(large, "full_frame").otherwise("screen_share_pip")).otherwise("unknown")


def speaker_tile(tiles: Column) -> Column:
    """The tile, where there is exactly one."""
    return F.when(F.size(tiles) == 1, F.get(tiles, F.lit(0)))


def _margins(peaks: np.ndarray, dark: float) -> tuple[int, int] | None:
    """How many leading and trailing values aren't over `dark`; None if none of them is."""
    lit = peaks > dark
    return (int(lit.argmax()), int(lit[::-1].argmax())) if lit.any() else None


def _grey(frame: np.ndarray) -> np.ndarray:
    return frame if frame.ndim == 2 else frame.mean(axis=2)


def lit_area(frame: np.ndarray, dark: float = 16) -> tuple[int, int, int, int]:
    """x, y, w, h of what is left when dark margins are cut off; the whole frame if all of it is dark."""
    grey = _grey(frame)
    high, wide = grey.shape
    left, right = _margins(grey.max(axis=0), dark) or (0, 0)
    above, below = _margins(grey.max(axis=1), dark) or (0, 0)
    return left, above, wide - left - right, high - above - below


def has_side_bars(frame: np.ndarray, share: float = 0.10, dark: float = 16) -> bool:
    """Are both side margins dark over `share` of the frame's width or more, around something that is lit?"""
    margins = _margins(_grey(frame).max(axis=0), dark)
    return margins is not None and min(margins) >= max(1, int(frame.shape[1] * share))


def box_smooth(signal: np.ndarray, window: int) -> np.ndarray:
    """Mean over `window` samples around each, three at least; what lies past an end counts as 0."""
    n, at = max(3, window), np.arange(len(signal))
    total = np.concatenate([[0.0], np.cumsum(signal, dtype=np.float64)])
    return (total[np.minimum(at + (n + 1) // 2, len(signal))] - total[np.maximum(at - n // 2, 0)]) / n


# Shares of red, green and blue in luminance; the least luminance of a name label's letters.
LUMA, WHITE = (0.299, 0.587, 0.114), 170


def white_text(crop: np.ndarray, least: float = WHITE) -> np.ndarray:
    """Label letters alone, for a reader of text: 255 where a picture (blue, green, red) is brighter than `least`,
    or lies in a gap of one pixel between such, and 0 elsewhere, in three equal channels."""
    light = np.pad(crop[..., ::-1] @ np.array(LUMA) > least, 1)
    across = light[1:-1, :-2] & light[1:-1, 2:]
    down = light[:-2, 1:-1] & light[2:, 1:-1]
    found = light[1:-1, 1:-1] | across | down
    return np.repeat((found * np.uint8(255))[..., None], 3, axis=2)


def is_audible(samples: np.ndarray, least: float = 0.001) -> bool:
    """Root mean square over a floor; empty audio is not."""
    return bool(len(samples)) and float(np.sqrt(np.mean(np.square(samples, dtype=np.float64)))) > least
