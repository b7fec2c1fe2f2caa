"""Depth of field: a picture blurred by how far each place lies from the plane in focus."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, Rel
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.geometry import resized
from rasterloom.operators.node import Param, node, number
from rasterloom.operators.point import SIGNED
from rasterloom.operators.spatial import gaussian
from rasterloom.operators.tiles import over_tiles

# Slices of depth; shares of the frame's short side that the widest disc and the halo take, stretches of a disc by fringe and
# swirl; sectors and rings of a swirl; light from which a place glows, and how far from focus it may lie.
SLICES = 16
DISC, FRINGE, SWIRL, HALO = 0.03, 0.35, 1.4, 0.015
SECTORS, RINGS = 12, 3
GLOW_FROM, GLOW_FOCUS = 0.82, 0.15


def middle(k: int) -> float:
    return (k + 0.5) / SLICES * 2 - 1


def aperture(radius: float, blades: int, curve: float, bubble: float, squeeze: float, stretch: float, angle: float) -> list[tuple[int, int, float]]:
    """Places under a lens's opening and their weights: a polygon whose sides may bulge, squeezed, stretched along an angle, and darker in its middle."""
    n, r = max(3, blades), max(radius, 0.6)
    sx, sy = (1.0, 1 - 0.8 * squeeze) if squeeze < 0 else (1 + 0.8 * squeeze, 1.0)
    plain = bubble <= 0 and squeeze == 0 and abs(stretch - 1) < 1e-6
    reach = math.ceil(r) if plain else math.ceil(r * max(sx, sy) * max(stretch, 1.0) + 1)
    step, seg, out = max(1, int(r / 12)), math.pi / n, []
    sin, cos = math.sin(angle), math.cos(angle)
    for dy in range(-reach, reach + 1, step):
        for dx in range(-reach, reach + 1, step):
            along, across = (dx * cos + dy * sin) / max(stretch, 1.0), dy * cos - dx * sin
            ux, uy = (dx, dy) if plain else ((along * cos - across * sin) / sx, (along * sin + across * cos) / sy)
            d = math.hypot(ux, uy)
            if d > r + 1:
                continue
            poly = math.cos(seg) / math.cos(math.atan2(uy, ux) % (2 * seg) - seg)
            limit = r * (poly + (1 - poly) * curve)
            w = min(1.0, max(0.0, 1 - (d - limit)))
            if bubble > 0:
                w *= 1 - bubble * (1 - min(1.0, max(0.0, d / max(limit, 1e-3))) ** 3)
            if w > 0:
                out.append((dx, dy, w))
    return out


def kernels(radius: float, p: dict) -> list[list[tuple[int, int, float]]]:
    """The opening for each ring and sector of the frame, of which there is one without a swirl."""
    shape = (max(3, math.floor(p["blades"] + 0.5)), p["blade_curve"] / 100, p["bubble"] / 100, min(1.0, max(-1.0, p["squeeze"] / 100)))
    if p["swirl"] <= 0:
        return [aperture(radius, *shape, 1.0, 0.0)]
    return [aperture(radius, *shape, 1 + p["swirl"] / 100 * SWIRL * (ring + 0.5) / RINGS, (sector + 0.5) / SECTORS * math.tau + math.pi / 2) for ring in range(RINGS) for sector in range(SECTORS)]


def reach_of(width: int, height: int, p: dict) -> int:
    widest = p["aperture"] / 100 * min(width, height) * DISC * (1 + p["fringe"] / 100 * FRINGE)
    return max((max(abs(dx), abs(dy)) for k in kernels(widest, p) for dx, dy, _ in k), default=0) + 1


def layered(planes: dict[str, np.ndarray], y0: int, x0: int, width: int, height: int, p: dict) -> dict[str, np.ndarray]:
    """A tile's slices, near to far, each blurred by its own opening and given as much of what is left to see as it covers."""
    h, w = planes["f"].shape
    y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w].astype(float)
    off = 2 * ((x / width - 0.5) ** 2 + (y / height - 0.5) ** 2)
    signed = planes["f"] - np.clip(p["focus"] / 100 + p["field_curve"] / 100 * 0.6 * off, 0, 1)
    dx, dy = x + 0.5 - width / 2, y + 0.5 - height / 2
    far = np.minimum(np.hypot(dx, dy) / max(1.0, math.hypot(width / 2, height / 2)), 0.999)
    turn = (np.arctan2(dy, dx) % math.tau) / math.tau * SECTORS
    which = ((far * RINGS).astype(int) * SECTORS + turn.astype(int) % SECTORS) if p["swirl"] > 0 else np.zeros((h, w), int)
    widest = p["aperture"] / 100 * min(width, height) * DISC
    sums, left = {c: np.zeros((h, w)) for c in "rgba"}, np.ones((h, w))
    for k in range(SLICES):
        cover = np.maximum(0, 1 - np.abs(signed - middle(k)) * SLICES / 2) * planes["a"]
        if not (cover > 0).any():
            continue
        sharp = {c: planes[c] * cover for c in "rgb"} | {"a": cover}
        r = max(0.0, widest * (abs(middle(k)) - 1 / SLICES))
        split = p["fringe"] / 100 * FRINGE * math.copysign(1, middle(k))
        radii = {"r": max(0.0, r * (1 + split)), "g": r, "b": max(0.0, r * (1 - split)), "a": r}
        if max(radii.values()) >= 0.5:
            soft = {}
            for radius in set(radii.values()):
                same = [c for c in "rgba" if radii[c] == radius]
                opened = kernels(radius, p)
                total = {c: np.zeros((h, w)) for c in same}
                for v in np.unique(which):
                    here, taps = which == v, opened[v]
                    norm = max(sum(t_[2] for t_ in taps), 1e-6)
                    for tx, ty, tw in taps:
                        # places beyond the frame are its edge; the tile holds all others
                        ys, xs = np.clip(np.arange(h) + ty, 0, h - 1), np.clip(np.arange(w) + tx, 0, w - 1)
                        for c in same:
                            total[c] += np.where(here, sharp[c][np.ix_(ys, xs)] * (tw / norm), 0) if len(opened) > 1 else sharp[c][np.ix_(ys, xs)] * (tw / norm)
                soft |= total
        else:
            soft = sharp
        seen = np.minimum(soft["a"], left)
        share = np.where(soft["a"] > 0, seen / np.where(soft["a"] > 0, soft["a"], 1), 0)
        for c in "rgb":
            sums[c] += soft[c] * share
        sums["a"] += seen
        left -= seen
    alpha = np.maximum(sums["a"], 1e-6)
    return {c: sums[c] / alpha for c in "rgb"} | {"a": np.clip(sums["a"], 0, 1), "off": np.clip(np.abs(signed), 0, 1), "there": planes["there"]}


@node(
    "dof", masked=True, takes=("depth",), aperture=number(0), focus=number(0), blades=number(6, 3, 9), blade_curve=number(100), fringe=number(0), field_curve=SIGNED(), glow=number(0), bubble=number(0), squeeze=SIGNED(), swirl=number(0), character=Param("")
)
def dof(inputs, p):
    """What lies off the plane in focus is blurred by a lens's opening, slice by slice of depth: nearer slices cover what is behind them, and nothing behind crosses a sharp edge. Bright places in focus may glow."""
    rel, depth = inputs["in"], inputs.get("depth")
    if p["aperture"] <= 0 or depth is None:
        return rel
    depth = depth if depth.kind == FIELD else depth.field(F.col("r"))
    depth = depth if depth.same_size(rel) else resized(depth, rel.width, rel.height)
    df = rel.df.hint("merge").join(depth.df.select(*KEY, F.col("v").alias("f")), KEY, "left").withColumn("f", F.coalesce("f", num(0)))
    w, h = rel.width, rel.height
    found = over_tiles(df, w, h, reach_of(w, h, p), ["r", "g", "b", "a", "f"], ["r", "g", "b", "a", "off"], lambda planes, y0, x0: layered(planes, y0, x0, w, h, p))
    out = Rel(found.select(*KEY, *"rgba"), IMAGE, w, h)
    if p["glow"] <= 0:
        return out
    least = ((GLOW_FROM + 0.055) / 1.055) ** 2.4
    sharp = t.clamp(num(1) - F.col("off") / num(GLOW_FOCUS))
    lift = t.clamp((t.luma(*map(F.col, "rgb")) - num(least)) / num(max(least, 1e-3)), 0, 4) * sharp
    bright = Rel(found, IMAGE, w, h).image(*[F.col(c) * lift for c in "rgb"], num(1))
    halo = gaussian(bright, max(2.0, min(w, h) * HALO))
    return Rel(out.joined(halo, "h_"), IMAGE, w, h).image(*[F.col(c) + F.col(f"h_{c}") * num(0.9 * p["glow"] / 100) for c in "rgb"])
