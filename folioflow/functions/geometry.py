"""Geometry of boxes and ink on normalized pages, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b["right"] - b["left"]) * (b["bottom"] - b["top"])


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0.0))
    h = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0.0))
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where there is no union."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u <= 0, F.lit(0.0)).otherwise(i / u)


def containment(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies in the outer one."""
    return F.when(area(inner) <= 0, F.lit(0.0)).otherwise(intersection(inner, outer) / area(inner))


def corner_box(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Centre and size -> corners within the page."""
    c = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(c(cx - w / 2).alias("left"), c(cy - h / 2).alias("top"), c(cx + w / 2).alias("right"), c(cy + h / 2).alias("bottom"))


def holds(b: Column, x: Column, y: Column) -> Column:
    return (x >= b["left"]) & (x <= b["right"]) & (y >= b["top"]) & (y <= b["bottom"])


def owns_point(b: Column, mask: Column, x: Column, y: Column, side: int = 200) -> Column:
    """Whether a region's box, and its mask if it has one, holds the point. The mask is side x side bytes."""
    cell = lambda v: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * side).cast("int")))
    at = F.substring(mask, cell(y) * side + cell(x) + 1, F.lit(1))
    return holds(b, x, y) & (mask.isNull() | (F.octet_length(mask) == 0) | (F.hex(at) != "00"))


def column_overlap(a: Column, b: Column) -> Column:
    """Overlap of two boxes' widths, as a share of the narrower."""
    o = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0.0))
    return o / F.greatest(F.least(a["right"] - a["left"], b["right"] - b["left"]), F.lit(0.001))


def point_distance2(b: Column, x: Column, y: Column, width: float, height: float) -> Column:
    """Squared distance in pixels from a point to a box; 0 inside."""
    dx = F.greatest(b["left"] - x, x - b["right"], F.lit(0.0)) * width
    dy = F.greatest(b["top"] - y, y - b["bottom"], F.lit(0.0)) * height
    return dx * dx + dy * dy


def pixel_crop(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels of a box on a page image, at least one each way."""
    left = F.least(F.greatest(F.floor(b["left"] * width + 0.5), F.lit(0)), width - 1).cast("int")
    top = F.least(F.greatest(F.floor(b["top"] * height + 0.5), F.lit(0)), height - 1).cast("int")
    right = F.least(F.greatest(F.floor(b["right"] * width + 0.5), left + 1), width).cast("int")
    bottom = F.least(F.greatest(F.floor(b["bottom"] * height + 0.5), top + 1), height).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))


def padded(b: Column, dx: float = 0.02, dy: float = 0.015) -> Column:
    c = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.struct(c(b["left"] - dx).alias("left"), c(b["top"] - dy).alias("top"), c(b["right"] + dx).alias("right"), c(b["bottom"] + dy).alias("bottom"))


def formula_margins(inline: Column, height: Column) -> Column:
    """Margins of a formula crop in pixels: (across, along), at least 2 each."""
    m = lambda share: F.greatest(F.floor(height * share + 0.5), F.lit(2)).cast("int")
    return F.struct(F.when(inline, m(0.04)).otherwise(m(0.10)).alias("across"), F.when(inline, m(0.08)).otherwise(m(0.10)).alias("along"))


def even_glyphs(text: Column, left: Column, top: Column, right: Column, bottom: Column, confidence: Column) -> Column:
    """One glyph per character of a line that has none: the box split evenly."""
    n = F.length(text)
    step = (right - left) / F.greatest(n, F.lit(1))
    glyph = lambda i: F.struct(F.substring(text, i, F.lit(1)).alias("text"), (left + step * (i - 1)).alias("left"), top.alias("top"), (left + step * i).alias("right"), bottom.alias("bottom"), confidence.alias("confidence"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), glyph)).otherwise(F.array().cast("array<struct<text:string,left:double,top:double,right:double,bottom:double,confidence:double>>"))


# ---------------------------------------------------------------- ink


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _point(x: Column, y: Column, p: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), p.alias("pressure"))


def moved(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: _point(_unit(p["x"] + dx), _unit(p["y"] + dy), p["pressure"]))


def scaled(points: Column, fx: Column, fy: Column, sx: Column, sy: Column) -> Column:
    return F.transform(points, lambda p: _point(_unit(fx + (p["x"] - fx) * sx), _unit(fy + (p["y"] - fy) * sy), p["pressure"]))


def rotated(points: Column, cx: Column, cy: Column, angle: Column) -> Column:
    def turn(p: Column) -> Column:
        dx, dy = p["x"] - cx, p["y"] - cy
        return _point(_unit(cx + dx * F.cos(angle) - dy * F.sin(angle)), _unit(cy + dx * F.sin(angle) + dy * F.cos(angle)), p["pressure"])

    return F.transform(points, turn)


def safe_scale(value: Column, base: Column) -> Column:
    return F.when(F.abs(base) < 0.0001, F.lit(1.0)).otherwise(F.greatest(F.lit(-8.0), F.least(F.lit(8.0), value / base)))


def wrapped_angle(a: Column) -> Column:
    """An angle in (-pi, pi], whole turns taken off."""
    import math

    t = a - F.lit(2 * math.pi) * F.ceil((a - math.pi) / (2 * math.pi))
    return F.when((a <= math.pi) & (a >= -math.pi), a).otherwise(t)


def bounds(points: Column) -> Column:
    """(left, top, right, bottom) of points, null without any."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom")))


def any_inside(points: Column, b: Column) -> Column:
    return F.exists(points, lambda p: holds(b, p["x"], p["y"]))


def segment_pressure(points: Column, enabled: Column) -> Column:
    """Pressure of each segment: the mean of its ends within 0.2 and 1.5, or 1 where pressure is off."""
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda a, b: (a["pressure"] + b["pressure"]) / 2)
    return F.when(F.size(points) < 2, F.array().cast("array<double>")).otherwise(F.transform(pairs, lambda p: F.when(enabled, F.greatest(F.lit(0.2), F.least(F.lit(1.5), p))).otherwise(F.lit(1.0))))


def snapped_end(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A line's end drawn to the nearest eighth of a turn if it is within six degrees of it."""
    import math

    step = math.pi / 4
    length, angle = F.hypot(x2 - x1, y2 - y1), F.atan2(y2 - y1, x2 - x1)
    to = F.floor(angle / step + 0.5) * F.lit(step)
    near = F.abs(wrapped_angle(angle - to)) * 180 / math.pi <= 6
    snap = (length >= 0.0001) & near
    return F.struct(F.when(snap, x1 + F.cos(to) * length).otherwise(x2).alias("x"), F.when(snap, y1 + F.sin(to) * length).otherwise(y2).alias("y"))


def line_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Label of a line: whole degrees in 0..180."""
    return F.floor(((F.degrees(F.atan2(y2 - y1, x2 - x1)) + 360) % 180) + 0.5).cast("int")


def ellipse_points(cx: Column, cy: Column, ax: Column, ay: Column, bx: Column, by: Column, pressure: Column, steps: int = 72) -> Column:
    """Points of an ellipse about a centre with half axes a and b."""
    import math

    def at(i: Column) -> Column:
        t = i / float(steps) * (2 * math.pi)
        return _point(cx + ax * F.cos(t) + bx * F.sin(t), cy + ay * F.cos(t) + by * F.sin(t), pressure)

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def rectangle_points(cx: Column, cy: Column, ax: Column, ay: Column, bx: Column, by: Column, pressure: Column) -> Column:
    """Closed outline of a rectangle about a centre with half sides a and b."""
    signs = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)]
    return F.array(*[_point(cx + ax * s + bx * t, cy + ay * s + by * t, pressure) for s, t in signs])


def bezier_points(c: Column, steps: int = 72) -> Column:
    """Points of a cubic curve over four control points."""
    p = F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x["pressure"]) / 4

    def at(i: Column) -> Column:
        t = i / float(steps)
        u = 1 - t
        w = [u * u * u, 3 * u * u * t, 3 * u * t * t, t * t * t]
        xy = [sum((w[k] * c[k][d] for k in range(1, 4)), w[0] * c[0][d]) for d in ("x", "y")]
        return _point(xy[0], xy[1], p)

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def regular_shape(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether half axes make a square or a circle: lengths within 2 %, angle within 3 %."""
    la, lb = F.hypot(ax, ay), F.hypot(bx, by)
    return (F.abs(la - lb) <= F.greatest(la, lb) * 0.02) & (F.abs(ax * bx + ay * by) <= la * lb * 0.03)


def shape_controls(x1: Column, y1: Column, x2: Column, y2: Column, pressure: Column, snap: Column, centred: Column) -> Column:
    """Controls of a rectangle or ellipse drawn from one point to another: its centre and the middles of its right and lower side.

    With `snap` sides that differ by at most 12 % become equal; `centred` takes the first point for the centre.
    """
    dx, dy = x2 - x1, y2 - y1
    side = F.greatest(F.abs(dx), F.abs(dy))
    equal = snap & (F.abs(F.abs(dx) - F.abs(dy)) <= side * 0.12)
    ex, ey = F.when(equal, x1 + F.signum(dx) * side).otherwise(x2), F.when(equal, y1 + F.signum(dy) * side).otherwise(y2)
    low = [F.when(centred, a - F.abs(e - a)).otherwise(F.least(a, e)) for a, e in ((x1, ex), (y1, ey))]
    high = [F.when(centred, a + F.abs(e - a)).otherwise(F.greatest(a, e)) for a, e in ((x1, ex), (y1, ey))]
    cx, cy = (low[0] + high[0]) / 2, (low[1] + high[1]) / 2
    return F.array(_point(cx, cy, pressure), _point(high[0], cy, pressure), _point(cx, high[1], pressure))


def edited_control(c: Column, mobile: Column, other: Column) -> Column:
    """A control of a rectangle or ellipse that was moved: at the other control's distance from the centre if it is within 12 % of it."""
    a, b = F.hypot(mobile["x"] - c["x"], mobile["y"] - c["y"]), F.hypot(other["x"] - c["x"], other["y"] - c["y"])
    k = F.when((F.abs(a - b) <= F.greatest(a, b) * 0.12) & (a > 0.0001), b / a).otherwise(F.lit(1.0))
    return _point(c["x"] + (mobile["x"] - c["x"]) * k, c["y"] + (mobile["y"] - c["y"]) * k, mobile["pressure"])


def stroke_controls(tool: Column, points: Column, controls: Column) -> Column:
    """The controls a stroke is edited by: its own, else a line's ends, else centre and sides of a shape's bounds, else none."""
    b, n = bounds(points), F.size(points)
    cx, cy, one = (b["left"] + b["right"]) / 2, (b["top"] + b["bottom"]) / 2, F.lit(1.0)
    shape = F.array(_point(cx, cy, one), _point(b["right"], cy, one), _point(cx, b["bottom"], one))
    ends = F.array(F.element_at(points, 1), F.element_at(points, -1))
    return F.when(F.size(controls) > 0, controls).when((tool == "LINE") & (n >= 2), ends).when(tool.isin("RECTANGLE", "ELLIPSE") & (n > 0), shape).otherwise(F.slice(points, 1, 0))


# Input events of a pen.
PEN_TOOLS, PEN_SOURCES, SIDE_BUTTONS, CANCEL_ACTION, CANCEL_FLAG = (2, 4), (0x4002, 0xC002), 0x60, 3, 0x20


def pen_event(tool_type: Column, source: Column) -> Column:
    """Whether an event comes from a pen or its eraser, by its tool or its source."""
    out = tool_type.isin(*PEN_TOOLS)
    for s in PEN_SOURCES:
        out = out | (source.bitwiseAND(F.lit(s)) == s)
    return out


def side_button(buttons: Column) -> Column:
    return buttons.bitwiseAND(F.lit(SIDE_BUTTONS)) != 0


def cancelled(action: Column, flags: Column) -> Column:
    return (action == CANCEL_ACTION) | (flags.bitwiseAND(F.lit(CANCEL_FLAG)) != 0)


def corner_handles(b: Column) -> Column:
    one = F.lit(1.0)
    return F.array(_point(b["left"], b["top"], one), _point(b["right"], b["top"], one), _point(b["right"], b["bottom"], one), _point(b["left"], b["bottom"], one))


def rotation_handle(b: Column) -> Column:
    return _point((b["left"] + b["right"]) / 2, F.greatest(b["top"] - 0.055, F.lit(0.01)), F.lit(1.0))


def stylus_pressure(raw: Column, generic: bool = False) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.5), raw))
    return F.greatest(x, F.lit(0.05)) if generic else F.greatest(F.sqrt(x), F.lit(0.03))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def night_channel(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), c * -0.90 + 245.0))
