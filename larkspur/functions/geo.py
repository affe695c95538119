"""Planar geometry. A point is struct<x,y>; a polygon is an array of rings, each
an array of points whose last equals the first; a line is an array of points.
All but decoding and hulls are built-in expressions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points; both have to be there."""
    dx, dy = a.getField("x") - b.getField("x"), a.getField("y") - b.getField("y")
    return F.sqrt(dx * dx + dy * dy)


def dwithin(a: Column, b: Column, most: float) -> Column:
    return distance(a, b) <= most


def _segments(line: Column) -> Column:
    """struct(a, b) for each pair of neighbours."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>"))


def _to_segment(p: Column, s: Column) -> Column:
    ax, ay, bx, by = (s.getField(e).getField(c) for e in "ab" for c in "xy")
    px, py = p.getField("x"), p.getField("y")
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(size == 0, 1.0).otherwise(size))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _crossings(p: Column, ring: Column) -> Column:
    """How often a ray from the point to the right meets the ring."""

    def meets(s: Column) -> Column:
        ax, ay, bx, by = (s.getField(e).getField(c) for e in "ab" for c in "xy")
        px, py = p.getField("x"), p.getField("y")
        across = (ay > py) != (by > py)
        at = ax + (py - ay) * (bx - ax) / F.when(by == ay, 1.0).otherwise(by - ay)
        return across & (px < at)

    return F.size(F.filter(_segments(ring), meets))


def within(p: Column, polygon: Column) -> Column:
    """Whether a point lies inside a polygon, holes left out."""
    total = F.aggregate(F.transform(polygon, lambda r: _crossings(p, r)), F.lit(0), lambda s, v: s + v)
    return total % 2 == 1


def distance_to_polygon(p: Column, polygon: Column) -> Column:
    """0 inside, else the distance to the nearest edge."""
    edges = F.flatten(F.transform(polygon, _segments))
    return F.when(within(p, polygon), 0.0).otherwise(F.array_min(F.transform(edges, lambda s: _to_segment(p, s))))


def _shoelace(ring: Column) -> Column:
    def part(s: Column) -> Column:
        return s.getField("a").getField("x") * s.getField("b").getField("y") - s.getField("b").getField("x") * s.getField("a").getField("y")

    return F.abs(F.aggregate(F.transform(_segments(ring), part), F.lit(0.0), lambda t, v: t + v)) / 2


def area(polygon: Column) -> Column:
    """The outer ring's area less those of the holes."""
    areas = F.transform(polygon, _shoelace)
    return F.aggregate(areas, F.lit(0.0), lambda t, v: t - v) + 2 * F.coalesce(F.get(areas, F.lit(0)), F.lit(0.0))


def length(line: Column) -> Column:
    return F.aggregate(F.transform(_segments(line), lambda s: distance(s.getField("a"), s.getField("b"))), F.lit(0.0), lambda t, v: t + v)


def make_line(a: Column, b: Column) -> Column:
    return F.array(a, b)


def decode_wkb(raw: bytes) -> tuple[str, list]:
    """('point', [x, y]) or ('polygon', rings) of well-known bytes."""
    order = "<" if raw[0] == 1 else ">"
    kind = struct.unpack(order + "I", raw[1:5])[0]
    if kind == 1:
        return "point", list(struct.unpack(order + "2d", raw[5:21]))
    if kind != 3:
        raise ValueError(f"geometry type {kind} isn't supported")
    rings, at = [], 9
    for _ in range(struct.unpack(order + "I", raw[5:9])[0]):
        n = struct.unpack(order + "I", raw[at : at + 4])[0]
        flat = struct.unpack(f"{order}{2 * n}d", raw[at + 4 : at + 4 + 16 * n])
        rings.append([list(p) for p in zip(flat[::2], flat[1::2], strict=True)])
        at += 4 + 16 * n
    return "polygon", rings


def point_from_wkb(c: Column) -> Column:
    @F.pandas_udf("x double, y double")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([decode_wkb(bytes(b))[1] for b in s], columns=["x", "y"])

    return decode(c)


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise."""
    todo = sorted(set(points))
    if len(todo) < 3:
        return todo

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(todo) + half(reversed(todo))


def convex_hull(points: Column) -> Column:
    """The closed hull of an array of points, as a polygon."""

    @F.udf(f"array<array<{POINT}>>", useArrow=False)
    def make(ps):
        corners = hull([(p["x"], p["y"]) for p in ps or []])
        return [[*corners, corners[0]]] if corners else []

    return make(points)
