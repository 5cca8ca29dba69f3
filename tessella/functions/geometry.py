"""Geometry as Catalyst expressions: points are struct<x,y>, lines array<point>, boxes four columns.

Nothing here leaves the JVM. Lines need no closing rule; rings repeat their first point at the end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def point(x, y) -> Column:
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def as_column(c) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def pick(a: str, b: str | None = None) -> tuple[list[Column], list[Column]]:
    """Box columns of two sides of a join, by alias."""
    return [F.col(f"{a}.{c}") for c in BOX], [F.col(f"{b}.{c}") for c in BOX]


def boxes_meet(a: list[Column], b: list[Column]) -> Column:
    """Bounding boxes that share a point, borders included."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def box_covers(outer: list[Column], inner: list[Column]) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def boxes_equal(a: list[Column], b: list[Column]) -> Column:
    return (a[0] == b[0]) & (a[1] == b[1]) & (a[2] == b[2]) & (a[3] == b[3])


def shared_box(a: list[Column], b: list[Column]) -> list[Column]:
    return [F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])]


def box_area(b: list[Column]) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def expand(b: list[Column], by: float) -> list[Column]:
    """A box grown (or, with a negative distance, shrunk) on all sides."""
    return [b[0] - by, b[1] - by, b[2] + by, b[3] + by]


def box_ring(b: list[Column]) -> Column:
    """The counter-clockwise ring of a box."""
    return F.array(point(b[0], b[1]), point(b[2], b[1]), point(b[2], b[3]), point(b[0], b[3]), point(b[0], b[1]))


def envelope(pts: Column) -> list[Column]:
    x, y = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return [F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)]


def line_parts(pts: Column) -> Column:
    """An n-point line as n - 1 segments struct<a,b>."""
    return F.transform(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(pts, i + 1).alias("b")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def line_length(pts: Column) -> Column:
    return F.aggregate(line_parts(pts), F.lit(0.0), lambda s, g: s + distance(g["a"], g["b"]))


def azimuth(a: Column, b: Column) -> Column:
    """Radians clockwise from north; null where the points are equal."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    turn = F.atan2(dx, dy)
    return F.when((dx == 0) & (dy == 0), None).otherwise(F.when(turn < 0, turn + 2 * math.pi).otherwise(turn))


def vertex_angle(before: Column, at: Column, after: Column) -> Column:
    """Degrees between the directions to the neighbours, as an absolute difference of azimuths."""
    return F.abs(F.degrees(azimuth(at, before) - azimuth(at, after)))


def snap(pts: Column, step: float) -> Column:
    """Points moved to the lattice (half to even), with repeated points left out."""
    moved = F.transform(pts, lambda p: point(F.rint(p["x"] / step) * step, F.rint(p["y"] / step) * step))
    return drop_repeated(moved, 0.0)


def drop_repeated(pts: Column, tolerance: float) -> Column:
    """Leaves out points within the tolerance of the last one kept; the end point always stays."""
    if tolerance == 0:
        # equal neighbours alone: no list grows point by point
        apart = lambda line: F.filter(line, lambda p, i: (i == 0) | (distance(F.get(line, i - 1), p) > 0))
        return F.get(F.transform(F.array(pts), apart), 0)
    empty = F.array().cast("array<struct<x:double,y:double>>")
    kept = F.aggregate(pts, empty, lambda s, p: F.when(F.size(s) == 0, F.array(p)).when(distance(F.get(s, F.size(s) - 1), p) <= tolerance, s).otherwise(F.concat(s, F.array(p))))
    end = F.element_at(pts, -1)

    def closed(line: Column) -> Column:
        last = F.get(line, F.size(line) - 1)
        return F.when(distance(last, end) == 0, line).when(F.size(line) > 1, F.concat(F.slice(line, 1, F.size(line) - 1), F.array(end))).otherwise(F.concat(line, F.array(end)))

    return F.when(F.size(pts) < 2, pts).otherwise(F.get(F.transform(F.array(kept), closed), 0))


def extend_line(pts: Column, by: float) -> Column:
    """The chord from the first to the last point, drawn out by a length at both ends; null where they are equal."""
    a, b = F.element_at(pts, 1), F.element_at(pts, -1)
    turn = azimuth(a, b)
    dx, dy = by * F.sin(turn), by * F.cos(turn)
    return F.when(turn.isNotNull(), F.array(point(a["x"] - dx, a["y"] - dy), point(b["x"] + dx, b["y"] + dy)))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, taken about the first point."""
    o = F.element_at(ring, 1)
    cross = F.aggregate(line_parts(ring), F.lit(0.0), lambda s, g: s + (g["a"]["x"] - o["x"]) * (g["b"]["y"] - o["y"]) - (g["b"]["x"] - o["x"]) * (g["a"]["y"] - o["y"]))
    return cross / 2


def ring_centroid(ring: Column) -> Column:
    o = F.element_at(ring, 1)

    def add(s: Column, g: Column) -> Column:
        ax, ay, bx, by = g["a"]["x"] - o["x"], g["a"]["y"] - o["y"], g["b"]["x"] - o["x"], g["b"]["y"] - o["y"]
        c = ax * by - bx * ay
        return F.struct((s["c"] + c).alias("c"), (s["x"] + (ax + bx) * c).alias("x"), (s["y"] + (ay + by) * c).alias("y"))

    zero = F.lit(0.0)
    total = F.aggregate(line_parts(ring), F.struct(zero.alias("c"), zero.alias("x"), zero.alias("y")), add)
    return F.when(total["c"] != 0, point(o["x"] + total["x"] / (3 * total["c"]), o["y"] + total["y"] / (3 * total["c"])))


def sharp(before: Column, at: Column, after: Column, *, max_length: float, min_degrees: float, max_degrees: float, min_steep: float, max_steep: float) -> Column:
    """Whether a vertex is to be smoothed: its angle is small or wide and both sides are short, or it is very small or wide."""
    angle = vertex_angle(before, at, after)
    short = (distance(before, at) < max_length) & (distance(at, after) < max_length)
    found = (short & ((angle <= min_degrees) | (angle >= max_degrees))) | (angle <= min_steep) | (angle >= max_steep)
    return F.coalesce(found, F.lit(False))


def chaikin(pts: Column, rounds: int = 1, **limits: float) -> Column:
    """Cuts sharp vertices of lines, `rounds` times; both ends stay, repeated points are left out.

    A segment starts at its quarter if its first vertex is sharp or the one before, and stops at its three quarters if
    its second is sharp or the one after it in the list; else at its own points.
    """

    def once(line: Column) -> Column:
        n = F.size(line)
        flags = F.transform(line, lambda p, i: F.when((i > 0) & (i < n - 1), sharp(F.get(line, i - 1), p, F.get(line, i + 1), **limits)).otherwise(False))

        def cut(v: Column) -> Column:
            is_sharp = lambda i: F.coalesce(F.get(v["f"], i), F.lit(False))

            def part(p: Column, i: Column) -> Column:
                q = F.get(v["l"], i + 1)
                dx, dy = q["x"] - p["x"], q["y"] - p["y"]
                early = is_sharp(i) | F.when(i > 0, is_sharp(i - 1)).otherwise(False)
                late = is_sharp(i) | is_sharp(i + 1)
                start = F.when(early, point(p["x"] + 0.25 * dx, p["y"] + 0.25 * dy)).otherwise(p)
                stop = F.when(late, point(p["x"] + 0.75 * dx, p["y"] + 0.75 * dy)).otherwise(q)
                return F.array(start, stop)

            inner = F.flatten(F.transform(F.slice(v["l"], 1, F.size(v["l"]) - 1), part))
            return F.concat(F.array(F.element_at(v["l"], 1)), inner, F.array(F.element_at(v["l"], -1)))

        smooth = F.get(F.transform(F.array(F.struct(line.alias("l"), flags.alias("f"))), cut), 0)
        return F.when(n < 3, line).otherwise(drop_repeated(smooth, 0.0))

    for _ in range(rounds):
        pts = F.get(F.transform(F.array(pts), once), 0)
    return pts


def half_plane(a: Column, b: Column, p: Column) -> Column:
    """1, 0 or -1: p left of, on, or right of the line from a to b."""
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def translate(pts: Column, dx: float, dy: float) -> Column:
    return F.transform(pts, lambda p: point(p["x"] + dx, p["y"] + dy))


def make_line(a: Column, b: Column) -> Column:
    return F.array(a, b)


def crossing_direction(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How the segment from a to b crosses the one from c to d: -1 to its left, 1 to its right, 0 if it doesn't.

    An end of a-b on the line of c-d counts as to the right of it.
    """
    left = lambda p: half_plane(c, d, p) > 0
    through = half_plane(a, b, c) * half_plane(a, b, d) < 0
    return F.when(through & ~left(a) & left(b), -1).when(through & left(a) & ~left(b), 1).otherwise(0)


def optional(geometry: Column | None, predicate) -> Column:
    """A predicate on a geometry that may be missing: true without one, and where its value is null."""
    return F.lit(True) if geometry is None else F.coalesce(predicate(geometry), F.lit(True))
