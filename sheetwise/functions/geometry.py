"""Plane geometry as column expressions.

A point is ``struct<x double, y double>``; a quad is an array of four of them (top left, top right,
bottom right, bottom left) and its formulas are unrolled, so they stay in generated code. Longer
polylines use array functions.

Divisors that can be zero go through ``try_divide`` (null), because Spark may evaluate a shared term
before the condition that guards it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SAMPLES = 33
MAX_EDGE_POINTS = 257
STANDARD_RATIOS = (297.0 / 210.0, 11.0 / 8.5)
MAX_LONG_EDGE, MAX_OUTPUT_PIXELS, MIN_OUTPUT_SIDE = 6000.0, 24_000_000.0, 64


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def quad_points(quad: Column) -> list[Column]:
    return [quad[k] for k in range(4)]


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def cross_at(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - b["x"] * a["y"]


def quad_signed_area(quad: Column) -> Column:
    """Shoelace area; positive means clockwise on screen (y grows downward)."""
    p = quad_points(quad)
    return (cross_at(p[0], p[1]) + cross_at(p[1], p[2]) + cross_at(p[2], p[3]) + cross_at(p[3], p[0])) / 2


def turn(a: Column, b: Column, c: Column) -> Column:
    """Cross product of the steps a to b and b to c."""
    return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])


def quad_is_convex(quad: Column) -> Column:
    """True when all non-zero turns share a sign."""
    p = quad_points(quad)
    turns = [turn(p[i], p[(i + 1) % 4], p[(i + 2) % 4]) for i in range(4)]
    left, right = F.lit(False), F.lit(False)
    for t in turns:
        left, right = left | (t > 0), right | (t < 0)
    return ~(left & right)


def corner_angle(before: Column, corner: Column, after: Column) -> Column:
    """Inner angle in degrees."""
    ax, ay = before["x"] - corner["x"], before["y"] - corner["y"]
    bx, by = after["x"] - corner["x"], after["y"] - corner["y"]
    cos = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by) + 1e-9)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))) * (180 / 3.141592653589793)


def quad_angles(quad: Column) -> list[Column]:
    p = quad_points(quad)
    return [corner_angle(p[(i + 3) % 4], p[i], p[(i + 1) % 4]) for i in range(4)]


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance from ``p`` to the segment a-b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    along = ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / (dx * dx + dy * dy + 1e-9)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = p["x"] - (a["x"] + dx * t), p["y"] - (a["y"] + dy * t)
    return F.sqrt(ex * ex + ey * ey)


def quad_distance(p: Column, quad: Column) -> Column:
    """Distance from ``p`` to the nearest side."""
    q = quad_points(quad)
    return F.least(*[segment_distance(p, q[i], q[(i + 1) % 4]) for i in range(4)])


def polygon_distance(p: Column, ring: Column) -> Column:
    """Distance from ``p`` to the nearest side of a ring of any (format-bounded) length."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.array_min(F.zip_with(ring, nexts, lambda a, b: segment_distance(p, a, b)))


def ring_signed_area(ring: Column) -> Column:
    """Shoelace area of a ring of any (format-bounded) length."""
    nexts = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, nexts, cross_at), F.lit(0.0), lambda acc, v: acc + v) / 2


def mean_corner(quad: Column) -> Column:
    p = quad_points(quad)
    return point(
        (p[0]["x"] + p[1]["x"] + p[2]["x"] + p[3]["x"]) / 4, (p[0]["y"] + p[1]["y"] + p[2]["y"] + p[3]["y"]) / 4
    )


def line_edge(a: Column, b: Column, n: int = EDGE_SAMPLES) -> Column:
    """``n`` points straight from a to b."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: point(a["x"] + (b["x"] - a["x"]) * (i / (n - 1)), a["y"] + (b["y"] - a["y"]) * (i / (n - 1))),
    )


def straight_outline(quad: Column, confident: Column) -> Column:
    """Outline struct with straight edges, all stored in reading direction."""
    tl, tr, br, bl = quad_points(quad)
    return F.struct(
        quad.alias("corners"), line_edge(tl, tr).alias("top"), line_edge(tr, br).alias("right"),
        line_edge(bl, br).alias("bottom"), line_edge(tl, bl).alias("left"), confident.alias("confident"),
    )


def outline_ring(outline: Column) -> Column:
    """Ring of an outline: top, right, bottom backwards, left backwards."""
    return F.concat(outline["top"], outline["right"], F.reverse(outline["bottom"]), F.reverse(outline["left"]))


def full_frame() -> Column:
    """Corners of the frame with a 3 % inset, offered when no page was found."""
    lo, hi = F.lit(0.03), F.lit(0.97)
    return F.array(point(lo, lo), point(hi, lo), point(hi, hi), point(lo, hi))


def valid_pair(pair: Column) -> Column:
    """True for two finite numbers strictly between -0.5 and 1.5."""

    def near(v: Column) -> Column:
        return (v > -0.5) & (v < 1.5)  # false for NaN and infinities

    return F.coalesce((F.size(pair) == 2) & near(F.try_element_at(pair, F.lit(1))) & near(F.try_element_at(pair, F.lit(2))), F.lit(False))


def pair_point(pair: Column) -> Column:
    return point(F.try_element_at(pair, F.lit(1)), F.try_element_at(pair, F.lit(2)))


def clean_edge(edge: Column, start: Column, end: Column, n: int = EDGE_SAMPLES) -> Column:
    """``n`` points of a received edge, resampled by index with its ends pinned; straight when unusable."""
    usable = F.coalesce(
        (F.size(edge) >= 2) & (F.size(edge) <= MAX_EDGE_POINTS) & F.forall(edge, valid_pair), F.lit(False)
    )

    def sample(i: Column) -> Column:
        at = i / F.lit(float(n - 1)) * (F.size(edge) - 1)
        lo = F.floor(at).cast("int")
        hi = F.least(lo + 1, F.size(edge) - 1)
        f, a, b = at - lo, pair_point(F.get(edge, lo)), pair_point(F.get(edge, hi))
        return (
            F.when(i == 0, start).when(i == n - 1, end)
            .otherwise(point(a["x"] + (b["x"] - a["x"]) * f, a["y"] + (b["y"] - a["y"]) * f))
        )

    return F.when(usable, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), sample)).otherwise(line_edge(start, end, n))


def arc_lengths(points: Column) -> Column:
    """Running length at each point of a polyline (array of doubles, first is 0)."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), distance)
    return F.aggregate(
        steps, F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s))
    )


def chord_deviation(points: Column) -> Column:
    """Largest distance of a point to the line from the first to the last; 0 for a closed run."""
    a, b = points[0], F.element_at(points, -1)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = F.sqrt(dx * dx + dy * dy)
    off = F.array_max(F.transform(points, lambda p: F.abs((p["x"] - a["x"]) * dy - (p["y"] - a["y"]) * dx)))
    return F.when(length < 1e-9, F.lit(0.0)).otherwise(F.try_divide(off, length))


# ---- projective maps --------------------------------------------------------------------------


def square_to_quad(quad: Column) -> list[Column]:
    """Row-major coefficients of the map from the unit square to the quad (last one is 1)."""
    p0, p1, p2, p3 = quad_points(quad)
    sx, sy = p0["x"] - p1["x"] + p2["x"] - p3["x"], p0["y"] - p1["y"] + p2["y"] - p3["y"]
    dx1, dx2 = p1["x"] - p2["x"], p3["x"] - p2["x"]
    dy1, dy2 = p1["y"] - p2["y"], p3["y"] - p2["y"]
    den = dx1 * dy2 - dx2 * dy1
    g, h = F.try_divide(sx * dy2 - dx2 * sy, den), F.try_divide(dx1 * sy - sx * dy1, den)
    return [
        p1["x"] - p0["x"] + g * p1["x"], p3["x"] - p0["x"] + h * p3["x"], p0["x"],
        p1["y"] - p0["y"] + g * p1["y"], p3["y"] - p0["y"] + h * p3["y"], p0["y"],
        g, h, F.lit(1.0),
    ]


def adjugate(m: Sequence[Column]) -> list[Column]:
    """Inverse of a projective map up to scale, which the divide removes."""

    def minor(r: int, c: int) -> Column:
        rows = [i for i in range(3) if i != r]
        cols = [i for i in range(3) if i != c]
        value = m[rows[0] * 3 + cols[0]] * m[rows[1] * 3 + cols[1]] - m[rows[0] * 3 + cols[1]] * m[rows[1] * 3 + cols[0]]
        return value if (r + c) % 2 == 0 else -value

    return [minor(c, r) for r in range(3) for c in range(3)]


def project(m: Sequence[Column], x: Column, y: Column) -> Column:
    """Apply a projective map and divide."""
    w = m[6] * x + m[7] * y + m[8]
    return point(F.try_divide(m[0] * x + m[1] * y + m[2], w), F.try_divide(m[3] * x + m[4] * y + m[5], w))


def flat_corners(quad: Column) -> Column:
    """The corners as one struct of numbers ``x0, y0, .. y3``; later terms read it without looking into the array again."""
    return F.struct(*[F.get(quad, F.lit(k))[a].alias(f"{a}{k}") for k in range(4) for a in "xy"])


def quad_terms(flat: Column) -> Column:
    """What :func:`quad_depth` needs of flat corners, as one struct of numbers: start and step of each side, and which way it turns."""
    fields, twice = [], F.lit(0.0)
    for i in range(4):
        j = (i + 1) % 4
        dx, dy = flat[f"x{j}"] - flat[f"x{i}"], flat[f"y{j}"] - flat[f"y{i}"]
        fields += [flat[f"x{i}"].alias(f"x{i}"), flat[f"y{i}"].alias(f"y{i}"), dx.alias(f"dx{i}"), dy.alias(f"dy{i}"), (1 / (dx * dx + dy * dy + 1e-9)).alias(f"per{i}")]
        twice = twice + flat[f"x{i}"] * flat[f"y{j}"] - flat[f"x{j}"] * flat[f"y{i}"]
    return F.struct(*fields, F.when(twice < 0, -1.0).otherwise(1.0).alias("way"))


def side_offset(x: Column, y: Column, terms: Column, i: int) -> Column:
    """Squared distance of a point from a side, and on which side of it the point lies (positive is inside)."""
    px, py, dx, dy = x - terms[f"x{i}"], y - terms[f"y{i}"], terms[f"dx{i}"], terms[f"dy{i}"]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) * terms[f"per{i}"]))
    ex, ey = px - dx * t, py - dy * t
    return F.struct((ex * ex + ey * ey).alias("square"), ((dx * py - dy * px) * terms["way"]).alias("turn"))


def quad_depth(offsets: list[Column]) -> Column:
    """How deep a point lies in a convex quad, from its offsets: its distance from the outline, negative outside."""
    return F.sqrt(F.least(*[o["square"] for o in offsets])) * F.when(F.least(*[o["turn"] for o in offsets]) >= 0, 1.0).otherwise(-1.0)
