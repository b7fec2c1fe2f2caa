"""Drawn warps: frames read through the inverse of a displacement field, a grid of handles or shapes that move what lies under them.

Where a pixel reads from depends on the field alone, so it is solved without the frames, tile by tile in tasks of their own: fixed-point
steps, then Newton steps that are halved until they help. Where the field folds, several places land on a pixel, and the one that is
carried furthest is shown. A pixel that covers several of the source averages them, one that enlarges reads a cubic. What comes out is a
table of source pixels and weights, joined to the frames by place and summed up by pixel.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, Rel
from rasterloom.functions.tone import clamp, num
from rasterloom.operators.geometry import grid
from rasterloom.operators.node import Param, choice, node, number

# Cells of a grid, fixed-point steps, how near a solved place must land, samples of a fold's probe and cells of its cover, steps
# and halvings for a shape's share, magnifications from which and to which a tap becomes cubic, steps from which a pixel covers several of
# the source, the largest footprint, how far off a line it is bent, its parts' side and number, a fold's parts.
MAX_CELLS, ROUNDS, LANDED = 64, 6, 4e-6
PROBE, COVER = 96, 256
SHARE_STEPS, SHARE_HALVINGS = 32, 16
ENLARGE_FROM, ENLARGE_FULL = 1.01, 1.25
SQUEEZE, MAX_FOOT, BENT, PART, MAX_PARTS, SEAM = 1.25, 16.0, 0.25, 0.5, 8, 4
#: Pixels along the side of a tile whose places are solved in one go.
TILE = 128
Pair = tuple[np.ndarray, np.ndarray]


# -- fields: where a place of the frame is carried, all in fractions of the frame
def numbers(text: str) -> list | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, list) and all(isinstance(v, int | float) for v in found) else None


def spline(t: np.ndarray) -> list[np.ndarray]:
    """Weights of the four points around a cell."""
    a, b = t * t, t * t * t
    return [(-b + 2 * a - t) / 2, (3 * b - 5 * a + 2) / 2, (-3 * b + 4 * a + t) / 2, (b - a) / 2]


@dataclass(frozen=True)
class Grid:
    """Handles of a grid with a spline between them."""

    us: np.ndarray
    vs: np.ndarray
    d: np.ndarray  # rows + 1, columns + 1, 2
    turn: tuple[float, ...] | None = None  # from the frame's fractions to the grid's

    @staticmethod
    def read(p: dict) -> Grid:
        cols, rows = (int(min(MAX_CELLS, max(1, math.floor(p[k] + 0.5)))) for k in ("cols", "rows"))

        def lines(text: str, cells: int) -> np.ndarray:
            v = numbers(text)
            sound = v and len(v) == cells + 1 and v[0] == 0 and v[-1] == 1 and all(b > a for a, b in zip(v, v[1:], strict=False))
            return np.array(v if sound else np.arange(cells + 1) / cells, float)

        flat = numbers(p["mesh"]) or []
        d = np.zeros(((rows + 1) * (cols + 1), 2))
        for i, (dx, dy) in enumerate(zip(flat[::2], flat[1::2], strict=False)):
            if i < len(d) and math.isfinite(dx) and math.isfinite(dy):
                d[i] = dx, dy
        turn = numbers(p["lattice"]) if p["lattice"] else None
        turn = tuple(turn) if turn and len(turn) == 6 and all(map(math.isfinite, turn)) and abs(turn[0] * turn[4] - turn[1] * turn[3]) > 1e-9 else None
        return Grid(lines(p["cols_u"], cols), lines(p["rows_v"], rows), d.reshape(rows + 1, cols + 1, 2), turn)

    def moves(self) -> bool:
        return bool(self.d.any())

    def inside(self, u, v) -> Pair:
        if not self.turn:
            return u, v
        a, b, c, d, e, f = self.turn
        return a * u + b * v + c, d * u + e * v + f

    def back(self, x, y) -> Pair:
        if not self.turn:
            return x, y
        a, b, _, d, e, _ = self.turn
        det = a * e - b * d
        return (e * x - b * y) / det, (a * y - d * x) / det

    def field(self, u: np.ndarray, v: np.ndarray, aspect: float) -> Pair:
        u, v = self.inside(u, v)
        out = []
        at = []
        for lines, x in ((self.us, u), (self.vs, v)):
            i = np.clip(np.searchsorted(lines, x, "right") - 1, 0, len(lines) - 2)
            at.append((i, spline((x - lines[i]) / np.maximum(lines[i + 1] - lines[i], 1e-6))))
        (i, wu), (j, wv) = at
        for axis in (0, 1):
            total = np.zeros(np.shape(u))
            for b in range(4):
                for a in range(4):
                    total = total + self.d[np.clip(j + b - 1, 0, len(self.vs) - 1), np.clip(i + a - 1, 0, len(self.us) - 1), axis] * wu[a] * wv[b]
            out.append(total)
        return self.back(*out)

    def seeds(self, u: np.ndarray, v: np.ndarray, aspect: float):
        """Places that near handles may have been carried from: (which points, their u and v)."""
        gu, gv = self.inside(u, v)
        width = [np.maximum(np.append(0, np.diff(x)), np.append(np.diff(x), 0)) for x in (self.us, self.vs)]
        for j, i in np.argwhere(self.d.any(axis=2)):
            d = self.d[j, i]
            near = (np.abs(gu - self.us[i] - d[0]) <= 2 * width[0][i]) & (np.abs(gv - self.vs[j] - d[1]) <= 2 * width[1][j])
            k = np.flatnonzero(near)
            if len(k):
                m = self.back(*d)
                yield k, u[k] - m[0], v[k] - m[1]

    def probes(self, aspect: float) -> list[tuple[float, ...]]:
        return [(0.0, 0.0, 1.0, 1.0)]

    def reaches(self, u, v, aspect: float) -> np.ndarray:
        return (u >= 0) & (u <= 1) & (v >= 0) & (v <= 1)


def shape_distance(shape: str, x: np.ndarray, y: np.ndarray, amount: float) -> np.ndarray:
    """Signed distance to a shape of unit size, negative inside."""
    disc = np.hypot(x, y) - 1

    def box(a: float, b: float) -> np.ndarray:
        dx, dy = np.abs(x) - a, np.abs(y) - b
        return np.hypot(np.maximum(dx, 0), np.maximum(dy, 0)) + np.minimum(np.maximum(dx, dy), 0)

    def hull(corners: list[tuple[float, float]]) -> np.ndarray:
        sides = []
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
            ex, ey = bx - ax, by - ay
            n = max(math.hypot(ex, ey), 1e-6)
            sides.append((x - ax) * (ey / n) + (y - ay) * (-ex / n))
        return np.maximum.reduce(sides)

    if shape == "rectangle":
        return box(1, 1)
    if shape == "triangle":
        return hull([(0, -4 / 3), (1, 2 / 3), (-1, 2 / 3)])
    if shape == "trapeze":
        top = max(1 - 0.8 * amount, 0.05)
        return hull([(-top, -1), (top, -1), (1, 1), (-1, 1)])
    if shape == "cross":
        arm = min(0.1 + 0.55 * amount, 0.95)
        return np.minimum(box(1, arm), box(arm, 1))
    if shape == "crescent":
        return np.maximum(disc, 1 - np.hypot(x + 0.15 + 1.25 * amount, y))
    if shape == "semicircle":
        return np.maximum(disc, -y)
    return disc


@dataclass(frozen=True)
class Shape:
    """A region that is moved, turned and scaled about its middle, or held where it is."""

    cx: float = 0.5
    cy: float = 0.5
    radius: float = 0.25
    feather: float = 0.3
    aspect: float = 1.0
    rotation: float = 0.0
    dx: float = 0.0
    dy: float = 0.0
    angle: float = 0.0
    scale: float = 1.0
    scale_y: float = 1.0
    amount: float = 1.0
    shape: str = "ellipse"
    shape_amount: float = 0.5
    enabled: bool = True
    hold: bool = False

    def moves(self) -> bool:
        return self.enabled and not self.hold and self.amount > 0 and (self.dx, self.dy, self.angle, self.scale, self.scale_y) != (0, 0, 0, 1, 1)

    def weight(self, u, v, aspect: float) -> np.ndarray:
        ax, ay = (aspect, 1.0) if aspect >= 1 else (1.0, 1 / aspect)
        nx, ny, r = (u - self.cx) * ax, (v - self.cy) * ay, -math.radians(self.rotation)
        x = (nx * math.cos(r) - ny * math.sin(r)) / (self.radius * math.sqrt(self.aspect))
        y = (nx * math.sin(r) + ny * math.cos(r)) / (self.radius / math.sqrt(self.aspect))
        d = shape_distance(self.shape, x, y, self.shape_amount)
        if self.feather <= 0:
            return (d < 0).astype(float)
        t = np.clip((d + self.feather) / self.feather, 0, 1)
        return 1 - t * t * (3 - 2 * t)

    def transformed(self, u, v, aspect: float) -> Pair:
        ax, ay = (aspect, 1.0) if aspect >= 1 else (1.0, 1 / aspect)
        turn = lambda a, x, y: (x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a))
        r = math.radians(self.rotation)
        x, y = turn(-r, (u - self.cx) * ax, (v - self.cy) * ay)
        x, y = turn(math.radians(self.angle), *turn(r, x * self.scale, y * self.scale_y))
        return self.cx + x / ax + self.dx, self.cy + y / ay + self.dy

    def reach(self, aspect: float) -> tuple[float, ...]:
        ax, ay = (aspect, 1.0) if aspect >= 1 else (1.0, 1 / aspect)
        r = 1.5 * self.radius * math.sqrt(self.aspect + 1 / self.aspect)
        return self.cx - r / ax, self.cy - r / ay, self.cx + r / ax, self.cy + r / ay


@dataclass(frozen=True)
class Shapes:
    shapes: tuple[Shape, ...]

    @staticmethod
    def read(text: str) -> Shapes:
        try:
            items = json.loads(text)
        except ValueError:
            items = []
        out = []
        bounds = {"radius": (0.01, math.inf), "feather": (0, 1), "aspect": (0.1, 10), "scale": (0.01, math.inf), "scale_y": (0.01, math.inf), "amount": (0, 1), "shape_amount": (0, 1)}
        for item in items if isinstance(items, list) else []:
            if not isinstance(item, dict):
                continue
            given = {}
            for k, kind in Shape.__annotations__.items():
                v = item.get(k)
                if kind == "float" and isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v):
                    given[k] = min(max(float(v), bounds.get(k, (-math.inf,))[0]), bounds.get(k, (0, math.inf))[1])
                elif kind == "bool" and isinstance(v, bool) or kind == "str" and isinstance(v, str):
                    given[k] = v
            given.setdefault("scale_y", given.get("scale", 1.0))
            out.append(Shape(**given))
        return Shapes(tuple(out))

    def moves(self) -> bool:
        return any(s.moves() for s in self.shapes)

    def field(self, u: np.ndarray, v: np.ndarray, aspect: float) -> Pair:
        total, x, y, held = (np.zeros(np.shape(u)) for _ in range(4))
        for s in self.shapes:
            if s.moves():
                w = s.weight(u, v, aspect)
                tu, tv = s.transformed(u, v, aspect)
                total, x, y = total + w, x + w * s.amount * (tu - u), y + w * s.amount * (tv - v)
            elif s.enabled and s.hold:
                held = np.maximum(held, s.weight(u, v, aspect))
        k = (1 - np.clip(held, 0, 1)) / np.maximum(total, 1)  # shapes that overlap share the pull
        return x * k, y * k

    def seeds(self, u: np.ndarray, v: np.ndarray, aspect: float):
        """Places that a shape's own move may have brought the points from: those whose share of the move is what the shape's weight there gives."""
        for s in self.shapes:
            if not s.moves():
                continue
            c, ex, ey = (s.transformed(np.float64(s.cx + a), np.float64(s.cy + b), aspect) for a, b in ((0, 0), (1, 0), (0, 1)))
            (l00, l10), (l01, l11) = (tuple(e[i] - c[i] for i in (0, 1)) for e in (ex, ey))

            def source(a, k):
                m00, m01, m10, m11 = 1 - a + a * l00, a * l01, a * l10, 1 - a + a * l11
                r0, r1 = u[k] - s.cx - a * (c[0] - s.cx), v[k] - s.cy - a * (c[1] - s.cy)
                det = m00 * m11 - m01 * m10
                det = np.where(np.abs(det) > 1e-9, det, np.nan)
                return s.cx + (m11 * r0 - m01 * r1) / det, s.cy + (m00 * r1 - m10 * r0) / det

            def gap(a, k):
                return s.amount * s.weight(*source(a, k), aspect) - a

            every = np.arange(len(u))
            before = np.full(len(u), np.nan)
            for step in range(SHARE_STEPS + 1):
                share = s.amount * step / SHARE_STEPS
                now = gap(share, every)
                k = np.flatnonzero(now == 0)
                if len(k):
                    yield k, *source(share, k)
                k = np.flatnonzero((now != 0) & (before != 0) & np.isfinite(now) & np.isfinite(before) & ((before < 0) != (now < 0)))
                if len(k):
                    low, high, at_low = np.full(len(k), s.amount * (step - 1) / SHARE_STEPS), np.full(len(k), share), before[k]
                    for _ in range(SHARE_HALVINGS):
                        mid = (low + high) / 2
                        g = gap(mid, k)
                        same = (g < 0) == (at_low < 0)
                        low, high = np.where(same, mid, low), np.where(same, high, mid)
                    yield k, *source((low + high) / 2, k)
                before = now

    def probes(self, aspect: float) -> list[tuple[float, ...]]:
        return [s.reach(aspect) for s in self.shapes if s.moves()]

    def reaches(self, u, v, aspect: float) -> np.ndarray:
        found = np.zeros(np.shape(u), bool)
        for a, b, c, d in self.probes(aspect):
            found |= (u >= a) & (u <= c) & (v >= b) & (v <= d)
        return found


@dataclass(frozen=True)
class Padded:
    """A picture's field on a larger frame that holds it in the middle; with still, the margin travels with the picture's edge."""

    inner: Grid | Shapes
    w: int
    h: int
    px: int
    py: int
    still: bool

    def size(self) -> Pair:
        return self.w + 2 * self.px, self.h + 2 * self.py

    def own(self, u, v) -> Pair:
        pw, ph = self.size()
        return (u * pw - self.px) / self.w, (v * ph - self.py) / self.h

    def outer(self, u, v) -> Pair:
        pw, ph = self.size()
        return (u * self.w + self.px) / pw, (v * self.h + self.py) / ph

    def moves(self) -> bool:
        return self.inner.moves()

    def field(self, u, v, aspect: float) -> Pair:
        a, b = self.own(u, v)
        if self.still:
            a, b = np.clip(a, 0, 1), np.clip(b, 0, 1)
        x, y = self.inner.field(a, b, self.w / self.h)
        pw, ph = self.size()
        return x * self.w / pw, y * self.h / ph

    def seeds(self, u, v, aspect: float):
        for k, a, b in self.inner.seeds(*self.own(u, v), self.w / self.h):
            yield k, *self.outer(a, b)

    def probes(self, aspect: float) -> list[tuple[float, ...]]:
        return [(*self.outer(b[0], b[1]), *self.outer(b[2], b[3])) for b in self.inner.probes(self.w / self.h)]

    def reaches(self, u, v, aspect: float) -> np.ndarray:
        return self.inner.reaches(*self.own(u, v), self.w / self.h)


# -- the inverse --------------------------------------------------------------
class Inverse:
    """Where each place of a w by h frame reads from."""

    def __init__(self, field, w: int, h: int):
        self.f, self.w, self.h, self.aspect = field, w, h, w / h
        self.cover, self.boxes = self.folds()

    def off(self, su, sv, u, v) -> Pair:
        x, y = self.f.field(su, sv, self.aspect)
        return su + x - u, sv + y - v

    def folds(self) -> tuple[np.ndarray, list[tuple[float, ...]]]:
        """Cells of the frame that more than one place may land on, and boxes in pixels around the folds."""
        cover, boxes = np.zeros((COVER, COVER), bool), []

        def forward(u, v):
            x, y = self.f.field(u, v, self.aspect)
            return u + x, v + y

        for u0, v0, u1, v1 in self.f.probes(self.aspect):
            bw, bh = (u1 - u0) / PROBE, (v1 - v0) / PROBE
            if not (bw > 0 and bh > 0):
                continue
            v, u = np.meshgrid(v0 + (np.arange(PROBE) + 0.5) * bh, u0 + (np.arange(PROBE) + 0.5) * bw, indexing="ij")
            p, px, py = forward(u, v), forward(u + bw / 2, v), forward(u, v + bh / 2)
            fold = (px[0] - p[0]) * (py[1] - p[1]) - (px[1] - p[1]) * (py[0] - p[0]) <= 0
            if not fold.any():
                continue
            wide = np.pad(fold, 1)
            near = np.logical_or.reduce([wide[1 + a : 1 + a + PROBE, 1 + b : 1 + b + PROBE] for a in (-1, 0, 1) for b in (-1, 0, 1)])
            corners = [forward(u[near] + a * bw, v[near] + b * bh) for a, b in ((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0, 0))]
            low, high = (np.stack([agg([c[i] for c in corners], axis=0) for i in (0, 1)], 1) for agg in (np.min, np.max))
            cell = lambda t: np.clip(np.floor(t * COVER), 0, COVER - 1).astype(int)
            for (x0, y0), (x1, y1) in zip(np.maximum(cell(low) - 1, 0), np.minimum(cell(high) + 1, COVER - 1), strict=True):
                cover[y0 : y1 + 1, x0 : x1 + 1] = True
            xs, ys = (np.concatenate([q[i][fold] for q in (p, px, py)]) for i in (0, 1))
            sx, sy = 4 * bw * self.w + 16, 4 * bh * self.h + 16
            boxes.append((xs.min() * self.w - sx, ys.min() * self.h - sy, xs.max() * self.w + sx, ys.max() * self.h + sy))
        return cover, boxes

    def newton(self, su, sv, u, v) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places reached from su, sv and how far off they land."""
        su, sv = su.copy(), sv.copy()
        rx, ry = self.off(su, sv, u, v)
        error = np.maximum(np.abs(rx), np.abs(ry))
        live = np.flatnonzero(~(error < 1e-13))
        h = 1e-4
        for _ in range(20):
            if not len(live):
                break
            s, t, a, b = su[live], sv[live], u[live], v[live]
            ax, ay = self.off(s + h, t, a, b)
            bx, by = self.off(s, t + h, a, b)
            x, y = rx[live], ry[live]
            m00, m01, m10, m11 = (ax - x) / h, (bx - x) / h, (ay - y) / h, (by - y) / h
            det = m00 * m11 - m01 * m10
            sound = np.isfinite(det) & (np.abs(det) >= 1e-8)
            det = np.where(sound, det, 1)
            px, py = (m11 * x - m01 * y) / det, (m00 * y - m10 * x) / det
            scale = np.minimum(1, 0.25 / np.maximum(np.maximum(np.abs(px), np.abs(py)), 1e-6))
            todo = np.flatnonzero(sound)
            better = np.zeros(len(live), bool)
            for _ in range(10):
                if not len(todo):
                    break
                qs, qt = s[todo] - scale[todo] * px[todo], t[todo] - scale[todo] * py[todo]
                nx, ny = self.off(qs, qt, a[todo], b[todo])
                e = np.maximum(np.abs(nx), np.abs(ny))
                ok = np.isfinite(e) & (e < error[live[todo]])
                at = live[todo[ok]]
                su[at], sv[at], rx[at], ry[at], error[at] = qs[ok], qt[ok], nx[ok], ny[ok], e[ok]
                better[todo[ok]] = True
                todo = todo[~ok]
                scale[todo] /= 2
            live = live[better]
            live = live[~(error[live] < 1e-13)]
        return su, sv, error

    def from_themselves(self, u, v) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        su, sv = u, v
        for _ in range(ROUNDS):
            x, y = self.f.field(su, sv, self.aspect)
            su, sv = u - x, v - y
        size = lambda r: np.maximum(np.abs(r[0]), np.abs(r[1]))
        after, before = size(self.off(su, sv, u, v)), size(self.off(u, v, u, v))
        stay = ~np.isfinite(after) | (before < after)
        return self.newton(np.where(stay, u, su), np.where(stay, v, sv), u, v)

    def sources(self, u: np.ndarray, v: np.ndarray) -> Pair:
        """The places that land on u, v (flat arrays): where the field may fold the one that is carried furthest, else the only one."""
        ax, ay = (self.aspect, 1.0) if self.aspect >= 1 else (1.0, 1 / self.aspect)
        cell = lambda t: np.clip(np.floor(t * COVER), 0, COVER - 1).astype(int)
        folds = self.cover[cell(v), cell(u)] if self.cover.any() else np.zeros(len(u), bool)
        su, sv, far = u.copy(), v.copy(), np.full(len(u), -1.0)
        k = np.flatnonzero(folds)
        if len(k):
            for i, a, b in self.f.seeds(u[k], v[k], self.aspect):
                at = k[i]
                fine = np.isfinite(a) & np.isfinite(b)
                at, a, b = at[fine], a[fine], b[fine]
                qu, qv, error = self.newton(a, b, u[at], v[at])
                x, y = self.f.field(qu, qv, self.aspect)
                carried = np.hypot(x * ax, y * ay)
                take = (error <= LANDED) & self.f.reaches(qu, qv, self.aspect) & (carried > far[at] + 1e-6 * (far[at] >= 0))
                su[at[take]], sv[at[take]], far[at[take]] = qu[take], qv[take], carried[take]
        k = np.flatnonzero(far < 0)
        if len(k):
            su[k], sv[k], error = self.from_themselves(u[k], v[k])
            lost = k[(error > LANDED) & ~folds[k]]
            open_ = np.ones(len(lost), bool)
            for i, a, b in self.f.seeds(u[lost], v[lost], self.aspect) if len(lost) else ():
                i, a, b = (x[open_[i]] for x in (i, a, b))
                fine = np.isfinite(a) & np.isfinite(b)
                i, a, b = i[fine], a[fine], b[fine]
                qu, qv, error = self.newton(a, b, u[lost[i]], v[lost[i]])
                ok = error <= LANDED
                su[lost[i[ok]]], sv[lost[i[ok]]] = qu[ok], qv[ok]
                open_[i[ok]] = False
        return su, sv

    def at_pixels(self, x: np.ndarray, y: np.ndarray) -> Pair:
        """Source pixels of places in pixels."""
        su, sv = self.sources(np.ravel(x) / self.w, np.ravel(y) / self.h)
        return (su * self.w).reshape(np.shape(x)), (sv * self.h).reshape(np.shape(y))


def enlarged(dx: Pair, dy: Pair) -> np.ndarray:
    """The cubic's share of a tap whose steps across and down are dx and dy."""
    t = dx[0] ** 2 + dx[1] ** 2 + dy[0] ** 2 + dy[1] ** 2
    det = dx[0] * dy[1] - dx[1] * dy[0]
    low = t + np.sqrt(np.maximum(t * t - 4 * det * det, 0))
    small = np.where(low > 0, 2 * det * det / np.where(low > 0, low, 1), 0)
    e = np.clip((1 / np.sqrt(np.maximum(small, 1e-30)) - ENLARGE_FROM) / (ENLARGE_FULL - ENLARGE_FROM), 0, 1)
    return np.where(np.isfinite(t) & (small < 1 / ENLARGE_FROM**2), e * e * (3 - 2 * e), 0.0)


def taps(inverse: Inverse, y0: int, y1: int, x0: int, x1: int) -> dict[str, np.ndarray]:
    """What the pixels of a tile read: y, x, the place fx, fy (in pixels), its part of the pixel, the cubic's share, and whether there are several."""
    w, h = inverse.w, inverse.h
    a, b, c, d = max(0, y0 - 2), min(h, y1 + 2), max(0, x0 - 2), min(w, x1 + 2)
    ys, xs = np.mgrid[a:b, c:d]
    px, py = inverse.at_pixels(xs + 0.5, ys + 0.5)
    y, x = (v.ravel() for v in np.mgrid[y0:y1, x0:x1])

    def at(dy, dx) -> Pair:
        j, i = np.clip(y + dy, 0, h - 1) - a, np.clip(x + dx, 0, w - 1) - c
        return px[j, i], py[j, i]

    def less(p: Pair, q: Pair, n) -> Pair:
        n = np.maximum(n, 1)
        return (p[0] - q[0]) / n, (p[1] - q[1]) / n

    length = lambda v: np.nan_to_num(np.hypot(*v), posinf=0.0)
    s, (l, r, u, o) = at(0, 0), (at(0, -1), at(0, 1), at(-1, 0), at(1, 0))
    nx, ny = np.minimum(x + 1, w - 1) - np.maximum(x - 1, 0), np.minimum(y + 1, h - 1) - np.maximum(y - 1, 0)
    dx, dy = less(r, l, nx), less(o, u, ny)
    off_line = lambda p, q: length((p[0] + q[0] - 2 * s[0], p[1] + q[1] - 2 * s[1])) / 2
    bend = np.maximum(np.where(nx == 2, off_line(l, r), 0), np.where(ny == 2, off_line(u, o), 0))
    tl, tr, bl, br = at(-1, -1), at(-1, 1), at(1, -1), at(1, 1)
    twist = length(tuple(br[i] - tr[i] - bl[i] + tl[i] for i in (0, 1))) / 2 / np.maximum(nx * ny, 1)
    peaks = []
    for two, step, sound in (((at(0, -2), at(0, 2)), dx, (x >= 2) & (x + 2 < w)), ((at(-2, 0), at(2, 0)), dy, (y >= 2) & (y + 2 < h))):
        peaks.append(np.where(sound, length(((two[1][0] - two[0][0]) / 4 - step[0], (two[1][1] - two[0][1]) / 4 - step[1])), 0))
    folded = np.zeros(len(x), bool)
    for bx0, by0, bx1, by1 in inverse.boxes:
        folded |= (x + 0.5 >= bx0) & (x + 0.5 <= bx1) & (y + 0.5 >= by0) & (y + 0.5 <= by1)
    wide = (length(dx) > SQUEEZE) | (length(dy) > SQUEEZE)
    single = ~wide & ~(folded & (bend > BENT))
    bent = ~single & (np.maximum.reduce([bend, twist, *peaks]) > BENT)
    out = {k: [] for k in ("y", "x", "fx", "fy", "part", "share", "many")}

    def put(k, fx, fy, part, share, many):
        for name, v in zip(out, (y[k], x[k], fx, fy, part, share, many), strict=True):
            out[name].append(np.broadcast_to(v, fx.shape).ravel())

    def span(v: Pair) -> tuple[Pair, np.ndarray]:
        n = length(v)
        reach = np.where(n > SQUEEZE, np.minimum(n - 1, MAX_FOOT), 0)
        k = reach / np.maximum(n, 1e-12)
        return (v[0] * k, v[1] * k), np.where(n > SQUEEZE, np.ceil(reach).astype(int) + 1, 1)

    def spread(k, cx, cy, across: Pair, down: Pair, part):
        """Taps evenly over a footprint around cx, cy."""
        (ax, ay), na = span(across)
        (bx, by), nb = span(down)
        for n, m in set(zip(na.tolist(), nb.tolist(), strict=True)):
            i = np.flatnonzero((na == n) & (nb == m))
            for q in range(m):
                tb = q / (m - 1) - 0.5 if m > 1 else 0.0
                for p in range(n):
                    ta = p / (n - 1) - 0.5 if n > 1 else 0.0
                    put(k[i], cx[i] + ta * ax[i] + tb * bx[i], cy[i] + ta * ay[i] + tb * by[i], part[i] / (n * m), 0.0, True)

    k = np.flatnonzero(single)
    put(k, s[0][k], s[1][k], 1.0, enlarged(dx, dy)[k], False)
    k = np.flatnonzero(~single & ~bent)
    if len(k):
        pick = lambda v: (v[0][k], v[1][k])
        spread(k, *pick(s), pick(dx), pick(dy), np.ones(len(k)))
    k = np.flatnonzero(bent)
    if len(k):
        parts = lambda v: np.clip(np.ceil(np.minimum(length(v), MAX_FOOT) / PART).astype(int), 2, MAX_PARTS)
        ns, ms = (np.where(folded, SEAM, parts(v))[k] for v in (dx, dy))
        for n, m in set(zip(ns.tolist(), ms.tolist(), strict=True)):
            i = k[(ns == n) & (ms == m)]
            for q in range(m):
                for p in range(n):
                    fx, fy = inverse.at_pixels(x[i] + (p + 0.5) / n, y[i] + (q + 0.5) / m)
                    # where the field folds, the steps between neighbours tell nothing of a part
                    scale = np.where(folded[i], 0.0, 1.0)
                    spread(i, fx, fy, tuple(v[i] / n * scale for v in dx), tuple(v[i] / m * scale for v in dy), np.full(len(i), 1 / (n * m)))
    return {name: np.concatenate(v) for name, v in out.items()}


def texels(t: dict[str, np.ndarray], w: int, h: int, stretch: bool) -> dict[str, np.ndarray]:
    """The source pixels that taps read and with what weights: y, x, sy, sx, w, core (of the four around a place), sharp, many."""
    fx, fy = t["fx"], t["fy"]
    inside = np.isfinite(fx) & np.isfinite(fy)
    if not stretch:
        inside &= (fx >= 0) & (fy >= 0) & (fx <= w) & (fy <= h)
    t = {k: v[inside] for k, v in t.items()}
    gx, gy = np.clip(np.clip(t["fx"], 0, w) - 0.5, 0, w - 1), np.clip(np.clip(t["fy"], 0, h) - 0.5, 0, h - 1)
    axes = []
    for g, n in ((gx, w), (gy, h)):
        g = np.where(np.abs(g - np.round(g)) < 1e-9, np.round(g), g)  # a whole pixel stays one
        i = np.floor(g).astype(int)
        f = g - i
        plain, cubic = [np.zeros(len(f)), 1 - f, f, np.zeros(len(f))], spline(f)
        axes.append([(np.clip(i + k - 1, 0, n - 1), plain[k] + (cubic[k] - plain[k]) * t["share"]) for k in range(4)])
    out = {k: [] for k in ("y", "x", "sy", "sx", "w", "core", "sharp", "many")}
    sharp = t["share"] > 0
    for j in range(4):
        for i in range(4):
            core = i in (1, 2) and j in (1, 2)
            (sx, wx), (sy, wy) = axes[0][i], axes[1][j]
            k = np.flatnonzero(sharp | (wx * wy != 0)) if core else np.flatnonzero(sharp)
            for name, v in zip(out, (t["y"][k], t["x"][k], sy[k], sx[k], (wx * wy * t["part"])[k], np.full(len(k), core), sharp[k], t["many"][k]), strict=True):
                out[name].append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def reads(spark: SparkSession, field, w: int, h: int, stretch: bool) -> DataFrame:
    """texels() of all pixels of a w by h frame, tile by tile."""
    ny, nx = -(-h // TILE), -(-w // TILE)

    def run(batches):
        import pandas as pd

        inverse = None
        for pdf in batches:
            for tile in pdf["id"]:
                inverse = inverse or Inverse(field, w, h)
                ty, tx = divmod(int(tile), nx)
                with np.errstate(all="ignore"):
                    found = taps(inverse, ty * TILE, min(h, (ty + 1) * TILE), tx * TILE, min(w, (tx + 1) * TILE))
                    yield pd.DataFrame(texels(found, w, h, stretch))

    tiles = spark.range(0, ny * nx, 1, min(ny * nx, 4096))
    return tiles.mapInPandas(run, "y int, x int, sy int, sx int, w double, core boolean, sharp boolean, many boolean")


def warped(rel: Rel, field, stretch: bool, weight: Rel | None = None) -> Rel:
    """Frames read through a field; with stretch what lies beyond the edge is the edge, else nothing. With a weight, pixels that gather several of the source count each by it."""
    if not field.moves():
        return rel
    channels = rel.channels
    source = rel.df
    if weight is not None:
        source = weight_joined(rel, weight)
    at = reads(source.sparkSession, field, rel.width, rel.height, stretch)
    # by merging: from its tiles the table of reads looks small enough to broadcast, but it has several rows a pixel
    joined = at.hint("merge").join(source.select("frame_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *channels, *(["_m"] if weight is not None else [])), ["sy", "sx"])
    sums = [F.sum(F.col("w") * F.col(c)).alias(c) for c in channels]
    near = [x for c in channels for x in (F.min(F.when(F.col("core"), F.col(c))).alias(f"_low_{c}"), F.max(F.when(F.col("core"), F.col(c))).alias(f"_high_{c}"))]
    weighed = [F.sum(F.col("w") * F.col(c) * F.col("_m")).alias(f"_w_{c}") for c in channels] + [F.sum(F.col("w") * F.col("_m")).alias("_w")] if weight is not None else []
    found = joined.groupBy(*KEY).agg(*sums, *near, *weighed, F.first("sharp").alias("_sharp"), F.first("many").alias("_many"))
    everywhere = rel.df.select(*KEY).hint("merge").join(found, KEY, "left")

    def value(c: str):
        held = F.when(F.col("_sharp"), F.least(F.greatest(F.col(c), F.col(f"_low_{c}")), F.col(f"_high_{c}"))).otherwise(F.col(c))
        if weight is not None:
            held = F.when(F.col("_many") & (F.col("_w") > 1e-6), F.col(f"_w_{c}") / F.col("_w")).otherwise(held)
        return F.coalesce(held, num(0)).alias(c)

    return Rel(everywhere.select(*KEY, *map(value, channels)), rel.kind, rel.width, rel.height)


def weight_joined(rel: Rel, weight: Rel) -> DataFrame:
    return rel.df.hint("merge").join(weight.df.select(*KEY, clamp(F.coalesce("v", num(0))).alias("_m")), KEY, "left").fillna(0.0, ["_m"])


# -- nodes --------------------------------------------------------------------
GRID = {"cols": number(4, 1, 64), "rows": number(3, 1, 64), "cols_u": Param(""), "rows_v": Param(""), "mesh": Param("[]"), "lattice": Param("")}
EDGES = choice("clamp", "transparent")
LAYER = GRID | {"shapes": Param("[]"), "edges": EDGES, "space": choice("frame", "picture"), "room": number(25, 0, 100), "kind": choice("auto", "grid", "shapes")}
REST = Grid(np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.zeros((2, 2, 2)))


@node("grid_warp", params=GRID, edges=EDGES)
def grid_warp(inputs, p):
    """Handles of a grid pull the picture along."""
    return warped(inputs["in"], Grid.read(p), p["edges"] != "transparent")


@node("shape_warp", shapes=Param("[]"), edges=EDGES)
def shape_warp(inputs, p):
    """Shapes move, turn and scale what lies under them, or hold it."""
    return warped(inputs["in"], Shapes.read(p["shapes"]), p["edges"] != "transparent")


def of_layer(p: dict) -> tuple[Grid, Shapes]:
    """The grid and the shapes of a layer; the kind that isn't chosen is at rest."""
    shapes = Shapes.read(p["shapes"])
    if p["kind"] == "shapes" or p["kind"] == "auto" and shapes.shapes:
        return REST, shapes
    return Grid.read(p), Shapes(())


def picture_warped(rel: Rel, mesh: Grid, shapes: Shapes, room: float, stretch: bool) -> Rel:
    """A layer's own picture with a transparent margin of room percent of each side, through the grid and then the shapes, weighed by alpha."""
    px, py = (math.floor(n * min(100.0, max(0.0, room)) / 100 + 0.5) for n in (rel.width, rel.height))
    still = not mesh.moves() and not shapes.moves()
    if still and not px and not py:
        return rel
    w, h = rel.width + 2 * px, rel.height + 2 * py
    if px or py:
        moved = rel.df.select("frame_id", (F.col("y") + py).alias("y"), (F.col("x") + px).alias("x"), *rel.channels)
        rel_wide = Rel(grid(rel, w, h).hint("merge").join(moved, KEY, "left").fillna(0.0, rel.channels), IMAGE, w, h)
    else:
        rel_wide = rel
    if still:
        return rel_wide
    stretch = stretch and not px and not py
    out = rel_wide.image(*[F.col(c) * clamp(F.col("a")) for c in "rgb"])
    out = warped(out, Padded(mesh, rel.width, rel.height, px, py, True), stretch)
    out = warped(out, Padded(shapes, rel.width, rel.height, px, py, False), stretch)
    alpha = clamp(F.col("a"))
    return out.image(*[F.when(alpha > 1e-6, F.col(c) / alpha).otherwise(num(0)) for c in "rgb"])


@node("layer_warp", takes=("weight",), params=LAYER)
def layer_warp(inputs, p):
    """A layer's warp, of the frame below it or of its own picture."""
    rel, (mesh, shapes), stretch = inputs["in"], of_layer(p), p["edges"] != "transparent"
    if p["space"] == "picture":
        return picture_warped(rel, mesh, shapes, p["room"], stretch)
    weight = inputs.get("weight")
    weight = weight if weight is not None and weight.kind == FIELD and weight.same_size(rel) else None
    return warped(warped(rel, mesh, stretch, weight), shapes, stretch, weight)


def read_beyond(rel: Rel, beyond: Rel, field) -> Rel:
    """A mask read through a field from a larger one that holds it in the middle."""
    px, py = (beyond.width - rel.width) // 2, (beyond.height - rel.height) // 2
    found = warped(beyond, Padded(field, rel.width, rel.height, px, py, False), True)
    df = found.df.select("frame_id", (F.col("y") - py).alias("y"), (F.col("x") - px).alias("x"), "v").filter(F.col("x").between(0, rel.width - 1) & F.col("y").between(0, rel.height - 1))
    return Rel(df, FIELD, rel.width, rel.height)


@node("layer_warp_mask", takes=("beyond",), gives=FIELD, params=LAYER)
def layer_warp_mask(inputs, p):
    """A layer's mask carried along by the layer's warp."""
    rel, (mesh, shapes), stretch = inputs["in"], of_layer(p), p["edges"] != "transparent"
    if p["space"] == "picture":
        return rel
    beyond = inputs.get("beyond")
    if stretch and beyond is not None and rel.kind == beyond.kind == FIELD and (mesh.moves() or shapes.moves()):
        gaps = (beyond.width - rel.width, beyond.height - rel.height)
        if min(gaps) >= 0 and max(gaps) > 0 and all(g % 2 == 0 for g in gaps):
            return read_beyond(rel, beyond, mesh if mesh.moves() else shapes)
    return warped(warped(rel, mesh, stretch), shapes, stretch)
