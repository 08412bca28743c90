"""Plane geometry as Column expressions. A point is struct(x, y), a polygon an array of points, a box four columns."""

from __future__ import annotations

import math
from collections import namedtuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = namedtuple("Box", "x1 y1 x2 y2")


def box(prefix: str = "bbox_") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in Box._fields))


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2


def area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b.x2 - b.x1) * F.greatest(zero, b.y2 - b.y1)


def contains(b: Box, x: Column, y: Column) -> Column:
    """Edges count as inside."""
    return x.between(b.x1, b.x2) & y.between(b.y1, b.y2)


def above(upper: Box, lower: Box) -> Column:
    """The upper box's centre lies over the lower box's width and above its centre."""
    return center_x(upper).between(lower.x1, lower.x2) & (center_y(upper) < center_y(lower))


def iou(a: Box, b: Box) -> Column:
    shared = area(Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2)))
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def heading(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.atan2(y2 - y1, x2 - x1)


def angle_diff(a: Column, b: Column) -> Column:
    """The absolute difference of two angles, 0 to pi."""
    return F.abs(F.pmod(a - b + F.lit(math.pi), F.lit(2 * math.pi)) - F.lit(math.pi))


def _side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_intersect(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """Whether segments ab and cd cross; touching is no crossing. Points are (x, y) pairs of columns."""
    s1, s2 = _side(*a, *b, *c), _side(*a, *b, *d)
    s3, s4 = _side(*c, *d, *a), _side(*c, *d, *b)
    return (((s1 > 0) & (s2 < 0)) | ((s1 < 0) & (s2 > 0))) & (((s3 > 0) & (s4 < 0)) | ((s3 < 0) & (s4 > 0)))


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting; fewer than three points hold nothing."""
    n = F.size(polygon)
    before = F.concat(F.slice(polygon, F.greatest(n, F.lit(1)), F.lit(1)), F.slice(polygon, F.lit(1), F.greatest(n - 1, F.lit(0))))
    cross = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"])
    odd = F.aggregate(F.zip_with(polygon, before, lambda p, q: F.coalesce(cross(p, q), F.lit(False))), F.lit(False), lambda acc, c: acc != c)
    return F.coalesce((n >= 3) & odd, F.lit(False))


def polygon_centroid(polygon: Column) -> Column:
    """The mean of the vertices, (0, 0) of none."""
    mean = lambda f: F.when(F.size(polygon) > 0, F.aggregate(polygon, F.lit(0.0), lambda acc, p: acc + p[f]) / F.size(polygon)).otherwise(0.0)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def clip_length(x1: Column, y1: Column, x2: Column, y2: Column, b: Box) -> Column:
    """The length of a segment inside a box, by its parameter's range between the four edges."""
    dx, dy = x2 - x1, y2 - y1
    enter, leave, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q in ((-dx, x1 - b.x1), (dx, b.x2 - x1), (-dy, y1 - b.y1), (dy, b.y2 - y1)):
        t = q / F.nullif(p, F.lit(0.0))
        enter = F.greatest(enter, F.when(p < 0, t))
        leave = F.least(leave, F.when(p > 0, t))
        out = out | ((p == 0) & (q < 0))
    share = F.when(out | (enter > leave), 0.0).otherwise(leave - enter)
    return F.sqrt(dx * dx + dy * dy) * share


def path_length(points: Column) -> Column:
    """Of an array of points."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda acc, d: acc + d)


def displacement(points: Column) -> Column:
    first, last = F.get(points, F.lit(0)), F.get(points, F.size(points) - 1)
    return F.when(F.size(points) >= 2, distance(first["x"], first["y"], last["x"], last["y"])).otherwise(0.0)


def is_stationary(points: Column, radius: float) -> Column:
    """All points lie within the radius of their mean; a single point does."""
    mean = polygon_centroid(points)
    return F.forall(points, lambda p: distance(p["x"], p["y"], mean["x"], mean["y"]) <= radius)


def displacement_speed_kmh(points: Column, elapsed_ms: Column, meters_per_px: Column) -> Column:
    """Of the way from the first to the last of an array of points."""
    return speed_kmh(displacement(points), elapsed_ms, meters_per_px)


def speed_kmh(path_px: Column, elapsed_ms: Column, meters_per_px: Column) -> Column:
    """0 where no time passes."""
    seconds = elapsed_ms / 1000.0
    return F.when(seconds > 0, path_px * meters_per_px / seconds * 3.6).otherwise(0.0)
