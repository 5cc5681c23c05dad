"""Box geometry as Column expressions. A box is (x0, y0, x1, y1)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from formlake.functions.text import half_even


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    def array(self) -> Column:
        return F.array(*self)


def columns(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in Box._fields))


def of_array(box: Column) -> Box:
    return Box(*(F.get(box, F.lit(i)) for i in range(4)))


def clamp(value: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, value))


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def center_x(b: Box) -> Column:
    return (b.x0 + b.x1) / F.lit(2.0)


def center_y(b: Box) -> Column:
    return (b.y0 + b.y1) / F.lit(2.0)


def height(b: Box) -> Column:
    return F.greatest(F.lit(1.0), (b.y1 - b.y0).cast("double"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), (b.x1 - b.x0).cast("double")) * F.greatest(F.lit(0.0), (b.y1 - b.y0).cast("double"))


def intersection(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def overlap_area(a: Box, b: Box) -> Column:
    return area(intersection(a, b))


def iou(a: Box, b: Box) -> Column:
    inter = overlap_area(a, b)
    joined = area(a) + area(b) - inter
    return F.when((inter > 0) & (joined > 0), inter / joined).otherwise(F.lit(0.0))


def coverage(word: Box, region: Box) -> Column:
    """Share of the word's area inside the region."""
    return overlap_area(word, region) / F.greatest(area(word), F.lit(1.0))


def vertical_overlap(a: Box, b: Box) -> Column:
    shared = F.greatest(F.lit(0.0), (F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)).cast("double"))
    return shared / F.least(height(a), height(b))


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def to_thousand(b: Box, width: Column, height_: Column, mode: str = "round") -> Box:
    """Pixels to 0-1000. `round` is half-even; `trunc` first swaps reversed corners."""
    if mode == "trunc":
        b = Box(F.least(b.x0, b.x1), F.least(b.y0, b.y1), F.greatest(b.x0, b.x1), F.greatest(b.y0, b.y1))

    def scale(v: Column, size: Column) -> Column:
        scaled = v.cast("double") * 1000 / F.greatest(size, F.lit(1))
        return clamp(scaled if mode == "trunc" else half_even(scaled), 0.0, 1000.0).cast("int")

    return Box(scale(b.x0, width), scale(b.y0, height_), scale(b.x1, width), scale(b.y1, height_))


def pixels(norm: Box, width: Column, height_: Column) -> Box:
    """0-1 box to pixels, at least one pixel wide and high."""
    x0 = clamp(half_even(norm.x0 * width).cast("int"), 0, width - 1)
    y0 = clamp(half_even(norm.y0 * height_).cast("int"), 0, height_ - 1)
    x1 = F.greatest(x0 + 1, F.least(width, half_even(norm.x1 * width).cast("int")))
    y1 = F.greatest(y0 + 1, F.least(height_, half_even(norm.y1 * height_).cast("int")))
    return Box(x0, y0, x1, y1)


def clamp_thousand(box: Column) -> Column:
    """Array box clamped to 0-1000 with extent of at least 1; malformed becomes [0,0,1,1]."""
    x0, y0, x1, y1 = (clamp(half_even(v.cast("double")).cast("int"), 0, 1000) for v in of_array(box))

    def after(low: Column, high: Column) -> Column:
        return F.when(high <= low, F.least(F.lit(1000), low + 1)).otherwise(high)

    return F.when(F.size(box) == 4, F.array(x0, y0, after(x0, x1), after(y0, y1))).otherwise(
        F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    )


def of_polygon(normalized: Column, vertices: Column, width: Column, height_: Column) -> Column:
    """0-1 struct box of a polygon: normalised vertices first, else pixels over size, else null.

    A vertex coordinate that is absent counts as 0.
    """

    # the scale keeps the order, so only the least and largest coordinates are scaled, not every point
    def hull(points: Column, w: Column, h: Column) -> Column:
        def side(axis: str, size: Column, pick, worse) -> Column:
            values = points[axis].cast("array<double>")
            # with a lambda here the step is compiled in parts; without one it is a method too long for the JVM's compiler
            absent = F.coalesce(F.exists(values, lambda v: v.isNull()), F.lit(False))
            edge = F.coalesce(F.when(absent, worse(pick(values), F.lit(0.0))).otherwise(pick(values)), F.lit(0.0))
            return clamp(edge / size, 0.0, 1.0)

        return F.struct(
            side("x", w, F.array_min, F.least).alias("x0"), side("y", h, F.array_min, F.least).alias("y0"),
            side("x", w, F.array_max, F.greatest).alias("x1"), side("y", h, F.array_max, F.greatest).alias("y1"),
        )

    one = F.lit(1.0)
    return F.when(F.size(normalized) > 0, hull(normalized, one, one)).when(
        (F.size(vertices) > 0) & (width > 0) & (height_ > 0), hull(vertices, width.cast("double"), height_.cast("double"))
    )


def percent(b: Box, width: Column, height_: Column) -> Column:
    """Struct left/top/width/height in percent of the image; null when degenerate."""
    x0, x1 = (clamp(f(b.x0, b.x1), F.lit(0.0), width) for f in (F.least, F.greatest))
    y0, y1 = (clamp(f(b.y0, b.y1), F.lit(0.0), height_) for f in (F.least, F.greatest))
    finite = b.x0.isNotNull() & b.y0.isNotNull() & b.x1.isNotNull() & b.y1.isNotNull()
    return F.when(
        finite & (width > 0) & (height_ > 0) & (x1 > x0) & (y1 > y0),
        F.struct(
            (x0 / width * 100).alias("left"),
            (y0 / height_ * 100).alias("top"),
            ((x1 - x0) / width * 100).alias("width"),
            ((y1 - y0) / height_ * 100).alias("height"),
        ),
    )


def percent_union(a: Column, b: Column) -> Column:
    """Bounds of the percent boxes that are present; null when both are absent."""

    def far(box: Column, start: str, extent: str) -> Column:
        return box[start] + box[extent]

    left, top = F.least(a["left"], b["left"]), F.least(a["top"], b["top"])
    return F.when(
        left.isNotNull(),
        F.struct(
            left.alias("left"),
            top.alias("top"),
            (F.greatest(far(a, "left", "width"), far(b, "left", "width")) - left).alias("width"),
            (F.greatest(far(a, "top", "height"), far(b, "top", "height")) - top).alias("height"),
        ),
    )
