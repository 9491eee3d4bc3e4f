"""Where a participant's tile is in a video frame: numpy on pixels, no image library.

A shared screen leaves the tile at the right edge, with black above and below it. So the rows of the rightmost
strip tell whether there is one, and the columns of those rows how wide it is. Everything is a profile (the share
of bright pixels in each row or column) and its runs: stretches over a level, with short gaps bridged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from talkgrid.functions.geometry import LUMA, box_smooth, has_side_bars, lit_area

# Grey levels from which a pixel counts as content, as part of a dim tile, as part of a camera's
# picture; and the mean under which a row is padding.
CONTENT, DIM, FEED, PADDING = 28, 14, 28, 6
# Fixed values, shares of the canvas: the strip at the right; the least and most width of a tile; the most height
# of its rows, the least of black around them, the least of a camera's rows.
STRIP, NARROWEST, WIDEST, TALLEST, BLACK_ROWS, CAMERA_ROWS = 0.13, 0.03, 0.45, 0.90, 0.08, 0.125
# Fixed values, shares of a profile's length: its smoothing along columns and rows; the gap that ends a tile in a
# smoothed profile and in a plain one.
SMOOTH_X, SMOOTH_Y, GAP, PLAIN_GAP = 0.01, 0.012, 0.012, 0.006
# Fixed values, shares of bright pixels: the least of a tile's columns, and relative to their peak; the least of a
# page's columns, and relative to their median; of a lit column; of a dim page's columns; of the strip's rows, and of
# their peak; of what is left of a tile (which stands more than EDGE from the left); of a camera's tile.
TILE_COLUMN, OF_PEAK, PAGE_COLUMN, OF_PAGE, LIT, DIM_PAGE, TILE_ROW, STRIP_PEAK, LEFT_OF_TILE, EDGE, CAMERA_FILL = 0.10, 0.40, 0.40, 0.55, 0.04, 0.60, 0.12, 0.18, 0.015, 0.04, 0.55
# A camera's least width; how far below its rows a name may stand, and the most height then, in shares
# of the canvas; the least share of dim pixels in a row of a tile, the gap in a camera's picture, in shares of the tile.
CAMERA_WIDE, NAME_BELOW, DEEPEST, DIM_ROW, FEED_GAP = 0.05, 0.20, 0.92, 0.05, 0.03
# Confidence of a tile beside a shared screen, of a full frame with a face, and without one.
PIP_SURE, FACE_SURE, PLAIN_SURE = 0.8, 0.9, 0.3
#: Mean grey level under which a frame is blank.
BLANK = 8

Box = tuple[int, int, int, int]


def grey_of(frame: np.ndarray) -> np.ndarray:
    """Luminance of a picture (blue, green, red), rounded; a grey picture as it is."""
    return frame if frame.ndim == 2 else np.rint(frame[..., ::-1] @ np.array(LUMA))


def last_run(mask: np.ndarray, gap: int) -> tuple[int, int] | None:
    """First and last place of the rightmost run of a mask, where gaps of fewer than `gap` places part nothing."""
    at = np.flatnonzero(mask)
    if not at.size:
        return None
    breaks = np.flatnonzero(np.diff(at) > gap)
    return int(at[breaks[-1] + 1 if breaks.size else 0]), int(at[-1])


def _span(mask: np.ndarray) -> tuple[int, int] | None:
    at = np.flatnonzero(mask)
    return (int(at[0]), int(at[-1])) if at.size else None


def _fits(span: tuple[int, int] | None, wide: int) -> bool:
    return span is not None and wide * NARROWEST <= span[1] - span[0] + 1 <= wide * WIDEST


def columns_in_rows(content: np.ndarray, rows: tuple[int, int]) -> tuple[int, int] | None:
    """The tile's columns, told from the rows it stands in: what is right of the last dark gutter there.

    The smoothed profile is tried first; a gutter too narrow to survive smoothing shows in the plain one.
    """
    wide = content.shape[1]
    plain = content[rows[0] : rows[1] + 1].mean(axis=0)
    smooth = box_smooth(plain, int(wide * SMOOTH_X))
    floor = max(TILE_COLUMN, OF_PEAK * float(smooth[wide - _strip(wide) :].max()))
    edge = _span(smooth >= floor)
    if edge is None or edge[1] < wide * 0.5:
        return None
    for profile, gap in ((smooth, GAP), (plain, PLAIN_GAP)):
        held = profile[: edge[1] + 1] >= floor / 2
        held[-1] = True
        found = last_run(held, max(6, int(wide * gap)))
        if _fits(found, wide):
            return found
    return None


def columns_by_plateau(content: np.ndarray) -> tuple[int, int] | None:
    """The tile's columns where a bright page touches it: right of the last column as full as the page's are."""
    wide = content.shape[1]
    profile = box_smooth(content.mean(axis=0), int(wide * SMOOTH_X))
    page = profile[profile >= PAGE_COLUMN]
    edge = _span(profile >= LIT)
    if not page.size or edge[1] < wide * 0.5:
        return None
    inner = profile[: edge[1]] >= OF_PAGE * float(np.median(page))
    start = int(np.flatnonzero(inner)[-1]) + 1 if inner.any() else 0
    first, last = last_run(profile[start : edge[1] + 1] >= LIT, max(6, int(wide * GAP)))
    found = start + first, start + last
    return found if _fits(found, wide) else None


def _strip(wide: int) -> int:
    return max(8, round(wide * STRIP))


def _strip_rows(content: np.ndarray) -> tuple[int, int] | None:
    """First and last row of what the rightmost strip holds; None if it is as good as black."""
    high, wide = content.shape
    profile = box_smooth(content[:, wide - _strip(wide) :].mean(axis=1), int(high * SMOOTH_Y))
    return _span(profile >= max(TILE_ROW, profile.max() / 2)) if profile.max() >= STRIP_PEAK else None


def _has_page(content: np.ndarray, left: int) -> bool:
    return left <= content.shape[1] * EDGE or float(content[:, :left].mean()) >= LEFT_OF_TILE


def _camera(grey: np.ndarray, rows: tuple[int, int], columns: tuple[int, int]) -> Box:
    """A camera's box, down to the last row near it that still shows something dim: the name stands there."""
    high, (left, right), wide = len(grey), columns, columns[1] - columns[0] + 1
    below = min(high, rows[1] + 1 + int(NAME_BELOW * high))
    dim = (grey[rows[0] : below, left : right + 1] >= DIM).sum(axis=1) > max(2, int(DIM_ROW * wide))
    found = _span(dim)
    deep = min(found[1] if found else rows[1] - rows[0], int(high * DEEPEST))
    return left, rows[0], wide, deep + 1


def _avatar(grey: np.ndarray) -> Box | None:
    """The dim container around an avatar's disk: by its own rows and gutter, else right of the bright page."""
    high, wide = grey.shape
    dim = grey >= DIM
    rows = _strip_rows(dim)
    if rows and rows[1] - rows[0] + 1 <= high * TALLEST:
        columns = columns_in_rows(dim, rows)
        if columns and _has_page(dim, columns[0]):
            return columns[0], rows[0], columns[1] - columns[0] + 1, rows[1] - rows[0] + 1
    profile = box_smooth(dim.mean(axis=0), int(wide * SMOOTH_X))
    edge = _span(profile >= LIT)
    if edge is None:
        return None
    page = np.flatnonzero(profile[: edge[1]] >= DIM_PAGE)
    start = int(page[-1]) + 1 if page.size else 0
    left = start + _span(profile[start : edge[1] + 1] >= LIT)[0]
    size = edge[1] - left + 1
    rows = _span(dim[:, left : edge[1] + 1].sum(axis=1) > max(3, int(DIM_ROW * size)))
    if rows is None or not _fits((left, edge[1]), wide):
        return None
    return left, rows[0], size, min(rows[1] - rows[0] + 1, int(high * DEEPEST))


def right_tile(grey: np.ndarray) -> tuple[Box, str] | None:
    """The box, in pixels, and kind (`camera`, `avatar`) of a tile at the right of a shared screen; None where the
    right edge is black or filled from top to bottom, where no width fits, or where nothing is left of the tile."""
    high, wide = grey.shape
    if min(high, wide) < 20:
        return None
    content = grey >= CONTENT
    rows = _strip_rows(content)
    if rows is None:
        return None
    tall = rows[1] - rows[0] + 1
    if tall > high * TALLEST or high - tall < high * BLACK_ROWS:
        return None
    columns = columns_in_rows(content, rows) or columns_by_plateau(content)
    if columns is None or not _has_page(content, columns[0]):
        return None
    size = columns[1] - columns[0] + 1
    filled = float(content[rows[0] : rows[1] + 1, columns[0] : columns[1] + 1].mean())
    if filled >= CAMERA_FILL and tall >= high * CAMERA_ROWS and size >= wide * CAMERA_WIDE:
        return _camera(grey, rows, columns), "camera"
    return _avatar(grey) or (columns[0], rows[0], size, tall), "avatar"


def feed_box(grey: np.ndarray, box: Box) -> Box:
    """A camera's box cut to its picture: the rightmost run of lit columns, without rows of padding at its ends.
    Dark rows inside, and dim ones at the ends, stay. The box as it is if no column is lit."""
    x, y, w, h = box
    columns = last_run((grey[y : y + h, x : x + w] >= FEED).mean(axis=0) > LIT, max(4, int(FEED_GAP * w))) if w > 0 and h > 0 else None
    if columns is None:
        return box
    left, right = columns
    rows = _span(grey[y : y + h, x + left : x + right + 1].mean(axis=1) >= PADDING) or (h - 1, h - 1)
    return x + left, y + rows[0], right - left + 1, rows[1] - rows[0] + 1


def find_tiles(frame: np.ndarray, has_face: Callable[[np.ndarray], bool] | None = None) -> tuple[int, int, list[dict]]:
    """Width, height and tiles of a frame (blue, green, red), as media.detect_tiles takes them.

    One tile beside a shared screen, else the whole frame (a portrait picture between side bars: that column),
    none in a blank frame. has_face, if given, looks at the lit area's luminance; a face makes a full frame a
    camera, else it is an avatar.
    """
    high, wide = frame.shape[:2]
    x, y, w, h = lit_area(frame)
    grey = grey_of(frame[y : y + h, x : x + w])
    portrait = has_side_bars(frame)

    def tile(kind: str, box: Box, confidence: float) -> tuple[int, int, list[dict]]:
        share = {k: v / n for k, v, n in zip("xywh", box, (wide, high, wide, high), strict=True)}
        return wide, high, [{"kind": kind, **share, "confidence": confidence}]

    beside = None if portrait else right_tile(grey)
    if beside:
        box, kind = beside
        left, top, *size = feed_box(grey, box) if kind == "camera" else box
        return tile(kind, (x + left, y + top, *size), PIP_SURE)
    whole = (x, y, w, h) if portrait else (0, 0, wide, high)
    if has_face is not None and has_face(grey):
        return tile("camera", whole, FACE_SURE)
    return tile("avatar", whole, PLAIN_SURE) if grey.mean() > BLANK else (wide, high, [])
