"""Bounding-box arithmetic on columns.

A box is a :class:`Box` of four columns in ``x1, y1, x2, y2`` order.  Everything is plain
column arithmetic, so it stays inside whole-stage code generation and can be pushed
below joins and aggregates by the optimizer.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "", table: str | None = None) -> Box:
    """Columns ``{prefix}x1`` ... ``{prefix}y2``, optionally qualified by a table alias."""
    head = f"{table}." if table else ""
    return Box(*(F.col(f"{head}{prefix}{n}") for n in ("x1", "y1", "x2", "y2")))


def finite(value: Column) -> Column:
    """True for ordinary numbers; NaN, infinities and null are not finite."""
    return F.coalesce(
        ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False)
    )


def all_finite(*values: Column) -> Column:
    """True when every value is finite: zero times anything else is NaN."""
    total = values[0] * 0.0
    for value in values[1:]:
        total = total + value * 0.0
    return F.coalesce(~F.isnan(total), F.lit(False))


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1)


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.y2 - b.y1)


def area(b: Box) -> Column:
    return width(b) * height(b)


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2.0


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2.0


def valid(b: Box) -> Column:
    """Finite with a positive area."""
    return all_finite(*b) & (area(b) > 0.0)


def aspect_ratio(b: Box) -> Column:
    return F.when(valid(b), width(b) / height(b))


def sanitized(b: Box) -> Box:
    """The box itself when finite, otherwise the empty box at the origin."""
    ok = all_finite(*b)
    return Box(*(F.when(ok, c).otherwise(F.lit(0.0)) for c in b))


def clip(b: Box, frame_width: Column, frame_height: Column) -> Box:
    def bound(value: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(limit.cast("double"), value))

    return Box(
        bound(b.x1, frame_width),
        bound(b.y1, frame_height),
        bound(b.x2, frame_width),
        bound(b.y2, frame_height),
    )


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Box, b: Box) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(all_finite(*a, *b) & (union > 0.0), inter / union).otherwise(F.lit(0.0))


def cover_ratio(target: Box, other: Box) -> Column:
    """Share of ``target`` covered by ``other``; deliberately not symmetric."""
    base = area(target)
    return F.when(base > 0.0, intersection(target, other) / base).otherwise(F.lit(0.0))


def min_area_overlap(a: Box, b: Box) -> Column:
    smaller = F.least(area(a), area(b))
    return F.when(
        valid(a) & valid(b) & (smaller > 0.0), intersection(a, b) / smaller
    ).otherwise(F.lit(0.0))


def center_distance(a: Box, b: Box) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def diagonal(b: Box) -> Column:
    return F.greatest(F.hypot(width(b), height(b)), F.lit(1e-6))


def center_distance_ratio(a: Box, b: Box) -> Column:
    """Distance of the centres in units of the first box's diagonal."""
    return center_distance(a, b) / diagonal(a)


def edge_truncation(b: Box, frame_width: Column, frame_height: Column) -> Column:
    raw = area(b)
    kept = area(clip(b, frame_width, frame_height))
    return F.when(raw > 0.0, F.greatest(F.lit(0.0), 1.0 - kept / raw))


def _clamp_int(value: Column, limit: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(limit.cast("long"), value.cast("long")))


def _crop(b: Box, lower, upper, frame_width: Column, frame_height: Column) -> Column:
    x1, y1 = _clamp_int(lower(b.x1), frame_width), _clamp_int(lower(b.y1), frame_height)
    x2, y2 = _clamp_int(upper(b.x2), frame_width), _clamp_int(upper(b.y2), frame_height)
    return F.when(
        all_finite(*b) & (x2 > x1) & (y2 > y1),
        F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")),
    )


def outer_crop(b: Box, frame_width: Column, frame_height: Column) -> Column:
    """Integer crop that contains the box; null when nothing of it is in the frame."""
    return _crop(b, F.floor, F.ceil, frame_width, frame_height)


def rounded_crop(b: Box, frame_width: Column, frame_height: Column) -> Column:
    """Integer crop with half-even rounding (``rint``; ``round`` would be half-up)."""
    return _crop(b, F.rint, F.rint, frame_width, frame_height)


def bounded_size(w: Column, h: Column, max_side: int = 720) -> Column:
    """Shrink so that the longer side is at most ``max_side``; never below one pixel."""
    longest = F.greatest(w, h).cast("double")
    factor = F.when(longest > max_side, F.lit(float(max_side)) / longest)

    def scaled(side: Column) -> Column:
        return F.when(
            factor.isNotNull(), F.greatest(F.lit(1).cast("long"), F.rint(side * factor).cast("long"))
        ).otherwise(side.cast("long"))

    return F.struct(scaled(w).alias("width"), scaled(h).alias("height"))


def roi_to_box(x: Column, y: Column, w: Column, h: Column) -> Box:
    """A region given by corner and signed size as an ordered box."""
    return Box(
        F.least(x, x + w), F.least(y, y + h), F.greatest(x, x + w), F.greatest(y, y + h)
    )


def box_to_roi(b: Box) -> Column:
    """Ordered ``x, y, width, height``; null unless both sides are positive."""
    left, top = F.least(b.x1, b.x2), F.least(b.y1, b.y2)
    w, h = F.greatest(b.x1, b.x2) - left, F.greatest(b.y1, b.y2) - top
    return F.when(
        all_finite(*b) & (w > 0.0) & (h > 0.0),
        F.struct(left.alias("x"), top.alias("y"), w.alias("width"), h.alias("height")),
    )


def drag_to_roi(b: Box, frame_width: Column, frame_height: Column, min_size: int) -> Column:
    """A mouse drag (any corner order) as a clipped integer box of a minimum size."""

    def side(a: Column, c: Column, limit: Column) -> tuple[Column, Column]:
        a, c = F.rint(a), F.rint(c)
        return _clamp_int(F.least(a, c), limit), _clamp_int(F.greatest(a, c), limit)

    x1, x2 = side(b.x1, b.x2, frame_width)
    y1, y2 = side(b.y1, b.y2, frame_height)
    return F.when(
        (x2 - x1 >= min_size) & (y2 - y1 >= min_size),
        F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")),
    )


class Display(NamedTuple):
    """Source and display sizes of one view; the display is never larger than the source."""

    source_width: Column
    source_height: Column
    display_width: Column
    display_height: Column
    scale: Column


def display_of(source_width: Column, source_height: Column, max_width: int = 1280) -> Display:
    scale = F.least(F.lit(1.0), F.lit(float(max_width)) / source_width)
    one = F.lit(1).cast("long")
    return Display(
        source_width,
        source_height,
        F.greatest(one, F.rint(source_width * scale).cast("long")),
        F.greatest(one, F.rint(source_height * scale).cast("long")),
        scale,
    )


def _ordered(b: Box) -> Box:
    return Box(
        F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2)
    )


def to_display(b: Box, d: Display) -> Box:
    o = _ordered(b)
    return Box(
        _clamp_int(F.rint(o.x1 * d.display_width / d.source_width), d.display_width),
        _clamp_int(F.rint(o.y1 * d.display_height / d.source_height), d.display_height),
        _clamp_int(F.rint(o.x2 * d.display_width / d.source_width), d.display_width),
        _clamp_int(F.rint(o.y2 * d.display_height / d.source_height), d.display_height),
    )


def to_source(b: Box, d: Display) -> Box:
    o = _ordered(b)
    return Box(
        _clamp_int(F.rint(o.x1 * d.source_width / d.display_width), d.source_width),
        _clamp_int(F.rint(o.y1 * d.source_height / d.display_height), d.source_height),
        _clamp_int(F.rint(o.x2 * d.source_width / d.display_width), d.source_width),
        _clamp_int(F.rint(o.y2 * d.source_height / d.display_height), d.source_height),
    )


class Letterbox(NamedTuple):
    scale: Column
    pad_x: Column
    pad_y: Column


def letterbox(frame_width: Column, frame_height: Column, input_width: int, input_height: int) -> Letterbox:
    """Uniform scale into the model input plus the left/top padding in whole pixels."""
    scale = F.least(
        F.lit(float(input_width)) / frame_width, F.lit(float(input_height)) / frame_height
    )
    one = F.lit(1.0)
    new_w = F.greatest(one, F.rint(frame_width * scale))
    new_h = F.greatest(one, F.rint(frame_height * scale))
    pad_x = F.rint((F.lit(float(input_width)) - new_w) / 2.0 - 0.1)
    pad_y = F.rint((F.lit(float(input_height)) - new_h) / 2.0 - 0.1)
    return Letterbox(scale, pad_x, pad_y)


def from_letterbox(b: Box, lb: Letterbox, frame_width: Column, frame_height: Column) -> Box:
    restored = Box(
        (b.x1 - lb.pad_x) / lb.scale,
        (b.y1 - lb.pad_y) / lb.scale,
        (b.x2 - lb.pad_x) / lb.scale,
        (b.y2 - lb.pad_y) / lb.scale,
    )
    return clip(restored, frame_width, frame_height)


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0)
