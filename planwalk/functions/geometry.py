"""Plane geometry as Column expressions; coordinates are pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distance from an edge within which a point counts as on a polygon.
EDGE_TOLERANCE = 2.0
#: Below this determinant two segments are parallel and never cross.
PARALLEL = 1e-10


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def in_rectangle(px: Column, py: Column, rect: Column) -> Column:
    """Inside a struct (x, y, w, h), its four sides included."""
    return px.between(rect["x"], rect["x"] + rect["w"]) & py.between(rect["y"], rect["y"] + rect["h"])


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether segments a-b and c-d share a point; parallel ones don't."""
    den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(den, F.lit(0))
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.nullif(den, F.lit(0))
    return (F.abs(den) >= PARALLEL) & t.between(0, 1) & u.between(0, 1)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment; to its point if it has no length."""
    long = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    along = F.coalesce(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(long, F.lit(0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return distance(px, py, ax + t * (bx - ax), ay + t * (by - ay))


def edges(points: Column) -> Column:
    """The closed outline of array<struct<x, y>>: array<struct<a, b>>, the last point joined to the first."""
    return F.arrays_zip(points.alias("a"), F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1)).alias("b"))


def in_polygon(px: Column, py: Column, outline: Column) -> Column:
    """Inside by ray casting, or within EDGE_TOLERANCE of an edge of `outline` (array<struct<a, b>>)."""

    def ray(e: Column) -> Column:
        a, b = e["a"], e["b"]
        level = (a["y"] > py) != (b["y"] > py)
        return level & (px < (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0)) + a["x"])

    near = F.exists(outline, lambda e: segment_distance(px, py, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]) <= EDGE_TOLERANCE)
    return (F.size(F.filter(outline, ray)) % 2 == 1) | near


def crosses_outline(ax: Column, ay: Column, bx: Column, by: Column, outline: Column) -> Column:
    return F.exists(outline, lambda e: segments_cross(ax, ay, bx, by, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]))


def rectangle_corners(rect: Column) -> Column:
    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(point(rect["x"], rect["y"]), point(rect["x"] + rect["w"], rect["y"]), point(rect["x"] + rect["w"], rect["y"] + rect["h"]), point(rect["x"], rect["y"] + rect["h"]))


def centre(points: Column) -> Column:
    """Mean of a polygon's vertices."""
    n = F.size(points)
    return F.struct(*[(F.aggregate(points[c], F.lit(0.0), lambda s, v: s + v) / n).alias(c) for c in ("x", "y")])
