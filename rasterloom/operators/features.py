"""Feature points of frames: extremes of a scale space, with their direction and a descriptor of their surroundings.

Each octave of the scale space is a relation of runs of pixels along a line. Its tiles, with as much around them as blurs and descriptors
reach, go to tasks of their own, which give the points that lie in the tile and the tile's part of the next octave at half the size; so
a frame is never in one task, and an octave takes one shuffle. Points come out the same wherever tiles begin.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.frame import Rel
from rasterloom.functions.tone import num
from rasterloom.operators.match import FEATURE_LIMIT
from rasterloom.operators.tiles import blurred
from rasterloom.session import checkpointed

# Blur of an octave's first level and that of a photograph, levels to a doubling, least response, ratio of curvatures,
# bins of directions and the share of the highest one that counts, cells and bins of a descriptor, width of a cell, largest part.
SIGMA, SOURCE_BLUR, SCALES = 1.6, 0.5, 3
CONTRAST, EDGE_RATIO = 0.013, 10.0
DIRECTIONS, PEAK = 36, 0.8
CELLS, BINS, CELL, CLIP = 4, 8, 3.0, 0.2

#: Pixels in a run, along a tile's side, and around it: the blurs reach 38, a descriptor 52, and a point may move by 5.
RUN, CORE, AROUND = 32, 256, 96
POINT, PIXELS = 0, 1
ROW = "kind int, frame_id int, octave int, level int, at_y int, at_x int, y double, x double, scale double, angle double, response double, desc array<double>"


def octaves_of(width: int, height: int) -> int:
    """Octaves until a descriptor no longer fits."""
    least = min(width, height)
    return 1 if least < 16 else max(1, min(8, int(math.floor(math.log2(least / 16))) + 1))


def levels_of(base: np.ndarray, first: bool) -> np.ndarray:
    """The levels of an octave: each blurred on from the one before."""
    at = lambda i: SIGMA * 2 ** (i / SCALES)
    out = [blurred(base, math.sqrt(SIGMA**2 - SOURCE_BLUR**2)) if first else base]
    for i in range(1, SCALES + 3):
        out.append(blurred(out[-1], math.sqrt(at(i) ** 2 - at(i - 1) ** 2)))
    return np.stack(out)


def extremes(dogs: np.ndarray) -> np.ndarray:
    """(level, y, x) of the values above or below all 26 around them, in levels and pixels that have all of them."""
    inner = dogs[1:-1, 1:-1, 1:-1]
    high, low = (np.abs(inner) >= CONTRAST / 2 for _ in range(2))
    for di in range(3):
        for dy in range(3):
            for dx in range(3):
                if (di, dy, dx) != (1, 1, 1):
                    other = dogs[di : di + inner.shape[0], dy : dy + inner.shape[1], dx : dx + inner.shape[2]]
                    high &= inner > other
                    low &= inner < other
    return np.argwhere(high | low) + 1


def placed(dogs: np.ndarray, i: int, y: int, x: int) -> tuple[float, float, float, float] | None:
    """(level, y, x, response) where a quadratic through the neighbours has its extreme, moving to a nearer pixel up to five times; None for weak points, edges and those that leave the frame."""
    for _ in range(5):
        cube = dogs[i - 1 : i + 2, y - 1 : y + 2, x - 1 : x + 2]
        v = cube[1, 1, 1]
        slope = np.array([cube[1, 1, 2] - cube[1, 1, 0], cube[1, 2, 1] - cube[1, 0, 1], cube[2, 1, 1] - cube[0, 1, 1]]) / 2
        xx, yy, ss = cube[1, 1, 2] + cube[1, 1, 0] - 2 * v, cube[1, 2, 1] + cube[1, 0, 1] - 2 * v, cube[2, 1, 1] + cube[0, 1, 1] - 2 * v
        xy = (cube[1, 2, 2] - cube[1, 2, 0] - cube[1, 0, 2] + cube[1, 0, 0]) / 4
        xs = (cube[2, 1, 2] - cube[2, 1, 0] - cube[0, 1, 2] + cube[0, 1, 0]) / 4
        ys = (cube[2, 2, 1] - cube[2, 0, 1] - cube[0, 2, 1] + cube[0, 0, 1]) / 4
        curve = np.array([[xx, xy, xs], [xy, yy, ys], [xs, ys, ss]])
        if abs(np.linalg.det(curve)) < 1e-12:
            return None
        off = np.linalg.solve(curve, -slope)
        if np.abs(off).max() < 0.5:
            response = v + slope @ off / 2
            trace, det = xx + yy, xx * yy - xy * xy
            if abs(response) < CONTRAST or det <= 0 or trace * trace / det >= (EDGE_RATIO + 1) ** 2 / EDGE_RATIO:
                return None
            return i + off[2], y + off[1], x + off[0], abs(response)
        x, y, i = (int(c + math.copysign(math.floor(abs(o) + 0.5), o)) for c, o in zip((x, y, i), off, strict=True))
        if not (1 <= i <= len(dogs) - 2 and 1 <= y < dogs.shape[1] - 1 and 1 <= x < dogs.shape[2] - 1):
            return None
    return None


def gradients(img: np.ndarray, y: float, x: float, radius: int):
    """Around a place: offsets (dy, dx), size and direction of the gradient, of the pixels that have all neighbours."""
    cy, cx = (int(math.floor(c + 0.5)) for c in (y, x))
    y0, y1 = max(1, cy - radius), min(img.shape[0] - 2, cy + radius)
    x0, x1 = max(1, cx - radius), min(img.shape[1] - 2, cx + radius)
    if y0 > y1 or x0 > x1:
        return (np.zeros(0) for _ in range(4))
    dx = img[y0 : y1 + 1, x0 + 1 : x1 + 2] - img[y0 : y1 + 1, x0 - 1 : x1]
    dy = img[y0 + 1 : y1 + 2, x0 : x1 + 1] - img[y0 - 1 : y1, x0 : x1 + 1]
    oy, ox = np.mgrid[y0 - cy : y1 - cy + 1, x0 - cx : x1 - cx + 1].astype(float)
    return oy.ravel(), ox.ravel(), np.hypot(dx, dy).ravel(), np.arctan2(dy, dx).ravel()


def directions(img: np.ndarray, y: float, x: float, sigma: float) -> list[float]:
    """The directions that gradients around a place point to most; one point may have several."""
    oy, ox, size, angle = gradients(img, y, x, int(math.floor(4.5 * sigma + 0.5)))
    turn = angle / math.tau * DIRECTIONS
    bins = (np.sign(turn) * np.floor(np.abs(turn) + 0.5)).astype(int) % DIRECTIONS
    hist = np.bincount(bins, np.exp(-(oy**2 + ox**2) / (2 * (1.5 * sigma) ** 2)) * size, DIRECTIONS)
    for _ in range(6):
        hist = np.roll(hist, 1) / 4 + hist / 2 + np.roll(hist, -1) / 4
    before, after = np.roll(hist, 1), np.roll(hist, -1)
    tops = np.flatnonzero((hist > before) & (hist > after) & (hist >= PEAK * hist.max()) & (hist.max() > 0))
    out = []
    for b in tops:
        bend = before[b] - 2 * hist[b] + after[b]
        out.append((b if abs(bend) < 1e-12 else b + (before[b] - after[b]) / (2 * bend)) / DIRECTIONS * math.tau)
    return out or [0.0]


def described(img: np.ndarray, y: float, x: float, sigma: float, angle: float) -> np.ndarray:
    """Histograms of gradient directions, turned by the point's own, in a grid of cells around it; each gradient is spread over the cells and bins next to it."""
    cell = CELL * sigma
    oy, ox, size, direction = gradients(img, y, x, int(math.floor(cell * math.sqrt(2) * (CELLS + 1) / 2 + 0.5)))
    sin, cos = math.sin(angle), math.cos(angle)
    rx, ry = (ox * cos + oy * sin) / cell, (oy * cos - ox * sin) / cell
    bx, by = rx + CELLS / 2 - 0.5, ry + CELLS / 2 - 0.5
    keep = (bx > -1) & (by > -1) & (bx < CELLS) & (by < CELLS)
    bx, by, rx, ry = (v[keep] for v in (bx, by, rx, ry))
    value = size[keep] * np.exp(-(rx**2 + ry**2) / (0.5 * CELLS * CELLS))
    turn = (direction[keep] - angle) % math.tau / math.tau * BINS
    x0, y0, t0 = np.floor(bx).astype(int), np.floor(by).astype(int), np.floor(turn).astype(int)
    hist = np.zeros(CELLS * CELLS * BINS)
    for iy in (0, 1):
        for ix in (0, 1):
            for it in (0, 1):
                w = np.where(iy, by - y0, 1 - by + y0) * np.where(ix, bx - x0, 1 - bx + x0) * np.where(it, turn - t0, 1 - turn + t0)
                cy, cx = y0 + iy, x0 + ix
                inside = (cy >= 0) & (cy < CELLS) & (cx >= 0) & (cx < CELLS)
                np.add.at(hist, ((cy * CELLS + cx) * BINS + (t0 + it) % BINS)[inside], (value * w)[inside])
    for limit in (CLIP, None):
        norm = math.sqrt(float(hist @ hist))
        hist = hist / norm if norm > 1e-12 else hist
        hist = np.minimum(hist, limit) if limit else hist
    return hist


def pyramid_step(runs: DataFrame, octave: int, width: int, height: int, bare: bool = False) -> DataFrame:
    """Rows of ROW: the points of an octave (bare: its extremes, with their value as response), and the runs of the next one. runs(frame_id, at_y, at_x, desc) are those of this octave."""
    import pandas as pd

    columns = [c.split()[0] for c in ROW.split(", ")]
    nx, ny = -(-width // CORE), -(-height // CORE)

    def near(c: str, length: int, n: int):
        low, high = F.floor((F.col(c) - AROUND) / CORE), F.floor((F.col(c) + length - 1 + AROUND) / CORE)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(n - 1)).cast("int")))

    dealt = runs.withColumn("ty", near("at_y", 1, ny)).withColumn("tx", near("at_x", RUN, nx))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        frame, ty, tx = (int(v) for v in key)
        y0, x0 = max(0, ty * CORE - AROUND), max(0, tx * CORE - AROUND)
        y1, x1 = min(height, ty * CORE + CORE + AROUND), min(width, tx * CORE + CORE + AROUND)
        base = np.zeros((y1 - y0, x1 - x0))
        for y, x, values in zip(pdf["at_y"], pdf["at_x"], pdf["desc"], strict=True):
            low, high = max(x, x0), min(x + len(values), x1)
            if low < high:
                base[y - y0, low - x0 : high - x0] = values[low - x : high - x]
        levels = levels_of(base, octave == 0)
        dogs, scale, out = np.diff(levels, axis=0), float(1 << octave), []
        for i, y, x in extremes(dogs) if min(base.shape) >= 4 else []:
            if (y + y0) // CORE != ty or (x + x0) // CORE != tx:
                continue
            if bare:
                out.append((POINT, frame, octave, int(i), int(y + y0), int(x + x0), None, None, None, None, float(dogs[i, y, x]), None))
                continue
            if (found := placed(dogs, i, y, x)) is None:
                continue
            fi, fy, fx, response = found
            sigma, img = SIGMA * 2 ** (fi / SCALES), levels[min(int(math.floor(fi + 0.5)), len(levels) - 1)]
            for angle in directions(img, fy, fx, sigma):
                desc = described(img, fy, fx, sigma, angle)
                out.append((POINT, frame, octave, int(i), int(y + y0), int(x + x0), (fy + y0) * scale, (fx + x0) * scale, sigma * scale, angle, response, desc))
        nw, nh = max(1, width // 2), max(1, height // 2)
        for y in range(ty * CORE // 2, min(nh, (ty + 1) * CORE // 2)):
            for x in range(tx * CORE // 2, min(nw, (tx + 1) * CORE // 2), RUN):
                end = min(x + RUN, nw, (tx + 1) * CORE // 2)
                out.append((PIXELS, frame, octave, SCALES, y, x, None, None, None, None, None, levels[SCALES][2 * y - y0, 2 * x - x0 : 2 * end - 1 - x0 : 2]))
        return pd.DataFrame(out, columns=columns)

    return dealt.groupBy("frame_id", "ty", "tx").applyInPandas(run, ROW)


def scale_space_points(rel: Rel, bare: bool = False, octaves: int | None = None) -> DataFrame:
    """frame_id, octave, level, at_y, at_x (where the extreme was found, in the octave's pixels), y, x, scale (in the frame's), angle, response, desc of every feature point; bare: of every extreme, with its value as response and no more. Of as many octaves as fit, or fewer."""
    luma = num(0.2126) * F.col("r") + num(0.7152) * F.col("g") + num(0.0722) * F.col("b")
    seen = F.pow(F.greatest(F.coalesce(luma, num(0)), num(0)), num(1 / 2.2))  # as an eye sees it, so that shadows have points too
    runs = rel.df.select(F.col("frame_id").cast("int"), F.col("y").alias("at_y"), (F.floor(F.col("x") / RUN) * RUN).cast("int").alias("at_x"), "x", seen.alias("v"))
    runs = runs.groupBy("frame_id", "at_y", "at_x").agg(F.array_sort(F.collect_list(F.struct("x", "v")))["v"].alias("desc"))
    width, height, found = rel.width, rel.height, None
    for octave in range(min(octaves or 8, octaves_of(width, height))):
        step = checkpointed(pyramid_step(runs, octave, width, height, bare))
        points = step.filter(F.col("kind") == POINT).drop("kind")
        found = points if found is None else found.unionByName(points)
        runs = step.filter(F.col("kind") == PIXELS).select("frame_id", "at_y", "at_x", "desc")
        width, height = max(1, width // 2), max(1, height // 2)
    return found


def detect(rel: Rel, limit: int = FEATURE_LIMIT) -> DataFrame:
    """frame_id, id (from 1, by response), x, y, scale, angle, response, desc of the limit strongest feature points of each frame."""
    order = [F.desc("response"), "octave", "at_y", "at_x", "level", "angle"]
    w = Window.partitionBy("frame_id").orderBy(*order)
    ranked = scale_space_points(rel).withColumn("id", F.row_number().over(w)).filter(F.col("id") <= limit)
    return ranked.select("frame_id", "id", "x", "y", "scale", "angle", "response", "desc")
