"""Column functions on rectangles, matrices, page rotation and image limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# An object covers a page from 0.9 of its width and height; extents below 1 point grow to 1;
# A4 in points; dots per inch of the image limits, by level.
FULL_PAGE = 0.9
LEAST_EXTENT = 1.0
A4 = (595.28, 841.89)
LIMIT_DPI = [92, 140, 200, 300, 400]


def padded(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """left, bottom, right, top of a rectangle: negative extents are turned around, extents below 1 grow evenly to 1."""
    out = {}
    for low, high, at, extent in (("left", "right", x, w), ("bottom", "top", y, h)):
        a, size = F.least(at, at + extent).cast("double"), F.abs(extent).cast("double")
        grow = F.greatest(F.lit(LEAST_EXTENT) - size, F.lit(0.0)) / 2
        out |= {low: a - grow, high: a + size + grow}
    return out


def covers_page(w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """At least 0.9 of a page in both directions; false for an unknown page or one without extent."""
    return F.coalesce((page_w > 0) & (page_h > 0) & (w / page_w >= FULL_PAGE) & (h / page_h >= FULL_PAGE), F.lit(False))


def apply_matrix(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """The point (x, y) under the matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """m applied first, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def mapped_box(m: list[Column], x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """The upright box around a rectangle's four mapped corners."""
    points = [apply_matrix(m, p, q) for p, q in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))]
    xs, ys = zip(*points, strict=True)
    return {"left": F.least(*xs), "bottom": F.least(*ys), "right": F.greatest(*xs), "top": F.greatest(*ys)}


def rotation(degrees: Column) -> Column:
    """Degrees in 0, 90, 180, 270; other angles count as 0."""
    turned = F.pmod(degrees, F.lit(360))
    return F.when(turned % 90 == 0, turned).otherwise(0)


def display_size(w: Column, h: Column, degrees: Column) -> tuple[Column, Column]:
    """Width and height of a page as it is seen."""
    on_side = rotation(degrees).isin(90, 270)
    return F.when(on_side, h).otherwise(w), F.when(on_side, w).otherwise(h)


def display_rect(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, degrees: Column) -> dict[str, Column]:
    """A content rectangle (y up) on the page as it is seen (y down, after a clockwise turn)."""
    turn = rotation(degrees)
    case = lambda at0, at90, at180, at270: F.when(turn == 90, at90).when(turn == 180, at180).when(turn == 270, at270).otherwise(at0)
    return {
        "dx": case(x, y, page_w - x - w, page_h - y - h),
        "dy": case(page_h - y - h, x, y, page_w - x - w),
        "dw": case(w, h, w, h),
        "dh": case(h, w, h, w),
    }


def pixel_ceiling(points: Column, dpi: Column) -> Column:
    """Most pixels that a stretch of points needs at a resolution: half to even, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.bround(points / 72 * dpi, 0).cast("long"))


def page_ceilings(page_w: Column, page_h: Column, dpi: Column) -> tuple[Column, Column]:
    """Pixel ceilings of a page; a page without extent counts as A4."""
    known = (page_w > 0) & (page_h > 0)
    return tuple(pixel_ceiling(F.when(known, p).otherwise(a), dpi) for p, a in zip((page_w, page_h), A4, strict=True))


def flatten_dpi(enabled: Column, limit: Column) -> Column:
    """Resolution of flattened places: 200, or the limit if it is on and higher."""
    return F.when(enabled, F.greatest(F.lit(200), limit)).otherwise(200)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def colour_byte(share: Column) -> Column:
    """A colour share as a byte: cut off to 0..255, decimals dropped."""
    return F.floor(F.least(F.greatest(share * 255, F.lit(0)), F.lit(255)))


def cmyk(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [colour_byte((1 - v) * (1 - k)) for v in (c, m, y)]


def needs_dark_background(parts: Column) -> Column:
    """Every painted colour (r, g, b) is brighter than (211, 211, 211)."""
    bright = 211.0
    return (F.size(parts) > 0) & F.forall(parts, lambda p: luminance(p["r"], p["g"], p["b"]) > bright)
