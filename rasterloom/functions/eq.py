"""Curves through control points with handles, as column expressions: what the colour matrix and the equalizers are drawn with."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.tone import num

#: Newton steps that find a handle curve's place.
STEPS = 8
LEAST = 1e-4


@dataclass(frozen=True)
class Point:
    """A place, and how far its handles reach to the left and to the right; None for the slope of the neighbours."""

    x: float
    y: float
    l: tuple[float, float] | None = None
    r: tuple[float, float] | None = None


def read(found) -> list[Point]:
    """Points of a list or its JSON, in order; anything else is no curve, and points that aren't finite are left out."""
    if isinstance(found, str):
        try:
            found = json.loads(found)
        except ValueError:
            return []
    out = []
    for item in found if isinstance(found, list) else []:
        try:
            handles = [tuple(map(float, item[k])) if item.get(k) else None for k in ("l", "r")]
            p = Point(float(item["x"]), float(item["y"]), *handles)
        except (KeyError, TypeError, ValueError, AttributeError):
            return []
        if math.isfinite(p.x) and math.isfinite(p.y):
            out.append(p)
    return sorted(out, key=lambda p: p.x)


def bent(points: list[Point], how: str) -> list[Point]:
    """Points with the handles that a way of joining them asks for: none (smooth), straight lines (linear), or as they are."""
    if how == "smooth":
        return [replace(p, l=None, r=None) for p in points]
    if how != "linear" or len(points) < 2:
        return points
    thirds = []
    for p, q in zip(points, points[1:], strict=False):
        w = max(q.x - p.x, 1e-6)
        thirds.append((w / 3, (q.y - p.y) / 3))
    return [replace(p, l=(-thirds[i - 1][0], -thirds[i - 1][1]) if i else None, r=thirds[i] if i < len(thirds) else None) for i, p in enumerate(points)]


def around(points: list[Point], period: float) -> list[Point]:
    """Points repeated a period to each side."""
    return points if len(points) < 2 else [replace(p, x=p.x + k * period) for k in (-1, 0, 1) for p in points]


def active(points: list[Point]) -> bool:
    return len(points) > 1 and any(abs(p.y) > 1e-6 for p in points)


def slope(points: list[Point], i: int) -> float:
    a, b = points[max(0, i - 1)], points[min(len(points) - 1, i + 1)]
    return (b.y - a.y) / (b.x - a.x) if b.x - a.x > 1e-6 else 0.0


def cubic(a: float, b: float, c: float, d: float) -> tuple[float, ...]:
    """Coefficients, of the highest power first, of a curve with these control values."""
    return d - 3 * c + 3 * b - a, 3 * c - 6 * b + 3 * a, 3 * b - 3 * a, a


def segment(points: list[Point], i: int) -> tuple[tuple[float, ...] | None, tuple[float, ...]]:
    """Of the part from point i on: the cubic of its place (None if that is even) and of its value."""
    p, q = points[i], points[i + 1]
    w, m, n = max(q.x - p.x, 1e-6), slope(points, i), slope(points, i + 1)
    if not p.r and not q.l:
        return None, (2 * p.y + w * m - 2 * q.y + w * n, -3 * p.y - 2 * w * m + 3 * q.y - w * n, w * m, p.y)
    rx, ry = p.r or (w / 3, m * w / 3)
    lx, ly = q.l or (-w / 3, -n * w / 3)
    # a handle is made longer or shorter, never turned
    if rx < LEAST:
        rx, ry = LEAST, ry * LEAST / rx if rx > 0 else 0.0
    if -lx < LEAST:
        lx, ly = -LEAST, ly * LEAST / -lx if lx < 0 else 0.0
    k = min(1.0, w / (rx - lx))
    return cubic(p.x, p.x + rx * k, q.x + lx * k, q.x), cubic(p.y, p.y + ry * k, q.y + ly * k, q.y)


def poly(c: tuple[float, ...], t):
    a, b, c_, d = (num(v) for v in c) if isinstance(t, Column) else c
    return ((a * t + b) * t + c_) * t + d


def nearer(place: tuple[float, ...], x: Column):
    """A Newton step toward where a cubic is x."""
    a, b, c, _ = place

    def step(t: Column, _: Column) -> Column:
        steep = (num(3 * a) * t + num(2 * b)) * t + num(c)
        safe = F.when(steep == 0, num(1)).otherwise(steep)
        return F.when(F.abs(steep) < 1e-8, t).otherwise(F.least(F.greatest(t - (poly(place, t) - x) / safe, num(0)), num(1)))

    return step


def along(y: tuple[float, ...]):
    return lambda t: poly(y, t)


def value(points: list[Point], x: Column) -> Column:
    """The curve at x, flat beyond its ends."""
    if any(p.r or q.l for p, q in zip(points, points[1:], strict=False)):
        # bound once: a column's name inside a loop would mean a new column of that name in the same select
        return F.transform(F.array(x), lambda v: at(points, v))[0]
    return at(points, x)


def at(points: list[Point], x: Column) -> Column:
    if not points:
        return num(0)
    out = num(points[-1].y)
    for i in range(len(points) - 2, -1, -1):
        p, q = points[i], points[i + 1]
        place, y = segment(points, i)
        t = (x - num(p.x)) / num(max(q.x - p.x, 1e-6))
        if place:
            here = F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), t, nearer(place, x))), along(y))[0]
        else:
            here = poly(y, t)
        out = F.when(x <= q.x, here).otherwise(out) if i < len(points) - 2 else F.when(x < q.x, here).otherwise(out)
    return F.when(x <= points[0].x, num(points[0].y)).otherwise(out)


def value_at(points: list[Point], x: float) -> float:
    """value() of a number."""
    if not points:
        return 0.0
    if len(points) == 1 or x <= points[0].x:
        return points[0].y
    if x >= points[-1].x:
        return points[-1].y
    i = 0
    while i < len(points) - 2 and points[i + 1].x < x:
        i += 1
    place, y = segment(points, i)
    t = (x - points[i].x) / max(points[i + 1].x - points[i].x, 1e-6)
    for _ in range(STEPS if place else 0):
        steep = (3 * place[0] * t + 2 * place[1]) * t + place[2]
        if abs(steep) < 1e-8:
            break
        t = min(1.0, max(0.0, t - (poly(place, t) - x) / steep))
    return poly(y, t)
