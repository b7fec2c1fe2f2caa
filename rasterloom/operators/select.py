"""Selections drawn by hand, and colour worked on by bands of hue."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, Rel
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.masks import DEPTH, finish
from rasterloom.operators.node import EngineError, Param, node, number
from rasterloom.operators.point import SIGNED
from rasterloom.operators.spatial import COLOURS, box_columns, box_mean


def place(rel: Rel) -> tuple[Column, Column]:
    """A pixel's centre, 0 to 1 over the frame."""
    return (F.col("x") + num(0.5)) / num(rel.width), (F.col("y") + num(0.5)) / num(rel.height)


def in_polygon(x: Column, y: Column, points: list[list[float]]) -> Column:
    """Even-odd: how many sides a ray to the right crosses."""
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if ay != by:
            at = num(ax) + (y - num(ay)) * num((bx - ax) / (by - ay))
            crossed = crossed + ((y >= min(ay, by)) & (y < max(ay, by)) & (x < at)).cast("int")
    return F.when(crossed % 2 == 1, num(1)).otherwise(num(0))


def to_segment(x: Column, y: Column, a, b) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    k = t.clamp(((x - num(a[0])) * num(dx) + (y - num(a[1])) * num(dy)) / num(n)) if n > 0 else num(0)
    ex, ey = x - num(a[0]) - k * num(dx), y - num(a[1]) - k * num(dy)
    return F.sqrt(ex * ex + ey * ey)


def to_line(rel: Rel, points: list[list[float]]) -> Column:
    """The distance to a line of points, as a share of the frame's short side."""
    short = min(rel.width, rel.height)
    kx, ky = rel.width / short, rel.height / short
    x, y = place(rel)
    at = [(p[0] * kx, p[1] * ky) for p in points]
    near = [to_segment(x * num(kx), y * num(ky), a, b) for a, b in zip(at, at[1:] or at, strict=False)]
    return near[0] if len(near) == 1 else F.least(*near)


def region(rel: Rel, r: dict) -> Column:
    """Coverage of one region."""
    kind = r.get("kind", "path")
    x, y = place(rel)
    if kind == "path":
        return in_polygon(x, y, r["points"]) if len(r["points"]) > 2 else num(0)
    if kind == "marquee":
        x0, x1 = sorted((r["x0"], r["x1"]))
        y0, y1 = sorted((r["y0"], r["y1"]))
        if r.get("shape") == "ellipse":
            u, v = (x - num((x0 + x1) / 2)) / num(max((x1 - x0) / 2, 1e-9)), (y - num((y0 + y1) / 2)) / num(max((y1 - y0) / 2, 1e-9))
            return F.when(u * u + v * v <= 1, num(1)).otherwise(num(0))
        return F.when(x.between(x0, x1) & y.between(y0, y1), num(1)).otherwise(num(0))
    if kind == "brush":
        return F.when(to_line(rel, r["points"]) <= r["radius"], num(1)).otherwise(num(0))
    if kind == "range":
        c = {"red": F.col("r"), "green": F.col("g"), "blue": F.col("b")}.get(r.get("channel", ""), t.luma(*[F.col(k) for k in COLOURS]))
        soft = r.get("soft", 0.0)
        return t.ramp(t.encode(c), r["lo"] - soft, r["lo"]) * (num(1) - t.ramp(t.encode(c), r["hi"], r["hi"] + max(soft, 1e-9)))
    raise EngineError(f"no region of kind {kind!r}")


def folded(rel: Rel, regions: list[dict]) -> Column:
    """Regions in order: replaced, joined, taken out, or cut with what was there."""
    out = num(0)
    for i, r in enumerate(regions):
        new = region(rel, r)
        op = r.get("op", "replace" if i == 0 else "add")
        out = {"replace": new, "add": F.greatest(out, new), "subtract": out * (num(1) - new), "intersect": F.least(out, new)}[op]
    return out


def listed(text: str, owner: str) -> list:
    try:
        found = json.loads(text or "[]")
    except ValueError as e:
        raise EngineError(f"{owner}: {e}") from e
    if not isinstance(found, list):
        raise EngineError(f"{owner}: a list is wanted")
    return found


@node("selection_mask", takes=("depth",), gives=FIELD, params=DEPTH, regions=Param("[]"), feather=number(0, 0, 1), invert=Param(False))
def selection_mask(inputs, p):
    """Regions folded in order, feathered by two boxes."""
    rel = inputs["in"]
    plain = Rel(rel.df, rel.kind, rel.width, rel.height).field(folded(rel, listed(p["regions"], "selection_mask")))
    radius = round(p["feather"] * 0.05 * min(rel.width, rel.height))
    for _ in range(2 if radius else 0):
        plain = box_mean(plain, radius)
    return finish(plain, inputs, p, F.col("v"))


@node("brush_mask", takes=("depth",), gives=FIELD, params=DEPTH, strokes=Param("[]"), invert=Param(False))
def brush_mask(inputs, p):
    """Strokes in order: paint takes the larger coverage, erase multiplies down; a stroke fades from its hardness to its radius."""
    rel = inputs["in"]
    v = num(0)
    for s in listed(p["strokes"], "brush_mask"):
        radius, hard = max(float(s.get("radius", 0.05)), 1e-6), max(0.0, min(0.999, float(s.get("hardness", 0.5))))
        cover = num(float(s.get("flow", 1.0))) * (num(1) - t.ramp(to_line(rel, s["points"]), radius * hard, radius))
        v = v * (num(1) - cover) if s.get("erase") else F.greatest(v, cover)
    return finish(rel, inputs, p, v)


@node("smart_mask", takes=("raster", "depth"), gives=FIELD, params=DEPTH, regions=Param("[]"), threshold=number(50), feather=number(0), expand=SIGNED(), invert=Param(False))
def smart_mask(inputs, p):
    """A model's planted raster cut around a threshold, grown or shrunk, joined with drawn regions, feathered."""
    rel, raster = inputs["in"], inputs.get("raster")
    drawn = listed(p["regions"], "smart_mask")
    if raster is None:
        out = rel.field(folded(rel, drawn))
    else:
        from rasterloom.operators.combine import fitted

        plane = fitted(raster, rel.width, rel.height, "stretch")
        plane = plane if plane.kind == FIELD else plane.field(F.col("r"))
        cut = p["threshold"] / 100
        out = rel.joined(plane, "m_")
        out = Rel(out, rel.kind, rel.width, rel.height).field(t.ramp(F.coalesce("m_v", num(0)), cut - 0.1, cut + 0.1))
        grow = round(abs(p["expand"]) / 100 * min(rel.width, rel.height) * 0.05)
        if grow:
            at = 0.12 if p["expand"] > 0 else 0.88
            out = box_mean(out, grow).field(t.ramp(F.col("v"), at - 0.1, at + 0.1))
        if drawn:
            regions = rel.field(folded(rel, drawn))
            out = Rel(out.joined(regions, "o_", "inner"), FIELD, rel.width, rel.height).field(F.greatest("v", "o_v"))
    radius = round(p["feather"] / 100 * 0.05 * min(rel.width, rel.height))
    for _ in range(3 if radius else 0):
        out = box_mean(out, radius)
    return finish(out, inputs, p, F.col("v"))


@node("color_console", masked=True, bands=Param(""), smoothing=number(50))
def color_console(inputs, p):
    """Bands of hue, each with a centre and a width: shifts of hue, pulls toward a wheel's direction, saturation, vibrance and exposure, gated by chroma and led by a smoothed colour field."""
    rel = inputs["in"]
    bands = [b for b in listed(p["bands"], "color_console") if any(b.get(k) for k in ("hue", "sat", "vib", "lum")) or any(b.get("wheel", ()))]
    if not bands:
        return rel
    lab = t.to_oklab(*[F.greatest(F.col(c), num(0)) for c in COLOURS])
    df = rel.df.withColumns(dict(zip(("_l", "_a", "_b2"), lab, strict=True)))
    df = df.withColumn("_sa", F.col("_a")).withColumn("_sb", F.col("_b2"))
    radius = int(min(rel.width, rel.height) * 0.02 * min(1.0, p["smoothing"] / 100))
    if radius:
        df = box_columns(df, ["_sa", "_sb"], radius, rel.width, rel.height, True)
    df = df.withColumn("_ci", F.hypot("_sa", "_sb")).withColumn("_hi", F.degrees(F.atan2("_sb", "_sa"))).withColumn("_c0", F.hypot("_a", "_b2"))
    df = df.withColumn("_hi", F.when(F.col("_hi") < 0, F.col("_hi") + num(360)).otherwise(F.col("_hi"))).withColumn("_gate", t.ramp(F.least("_ci", "_c0"), 0.01, 0.05))
    dh, sat, ev = num(0), num(1), num(0)
    rest = num(1) - F.least(F.col("_ci") / num(0.3), num(1))
    for b in bands:
        centre, width = float(b["center"]) % 360, max(5.0, min(120.0, float(b.get("width", 30.0))))
        off = t.hue_gap(F.col("_hi"), centre)
        e = (num(1) - t.ramp(off, width, 2 * width)) * F.col("_gate")
        wx, wy = (list(b.get("wheel", ())) + [0.0, 0.0])[:2]
        pull = min(1.0, math.hypot(wx, wy))
        signed = num(centre) - F.col("_hi")
        signed = F.when(signed > 180, signed - num(360)).when(signed < -180, signed + num(360)).otherwise(signed)
        turn = (math.degrees(math.atan2(wy, wx)) - centre) % 360
        dh = dh + (num(float(b.get("hue", 0.0))) + (num(turn - 360 if turn > 180 else turn) + signed) * num(pull)) * e
        sat = sat * (num(1) + num(float(b.get("sat", 0.0)) / 100) * e) * (num(1) + num(float(b.get("vib", 0.0)) / 100) * e * rest)
        ev = ev + num(float(b.get("lum", 0.0))) * e
    df = df.withColumn("_dh", t.clamp(dh, -90, 90)).withColumn("_k", sat).withColumn("_ev", t.clamp(ev, -2, 2))
    df = df.withColumn("_h", F.atan2("_b2", "_a") + F.radians("_dh")).withColumn("_c", F.least(F.col("_c0") * F.greatest("_k", num(0)), num(1.5)))
    new = t.from_oklab((F.col("_l"), F.col("_c") * F.cos("_h"), F.col("_c") * F.sin("_h")))
    still = (F.col("_dh") == 0) & (F.col("_k") == 1) & (F.col("_ev") == 0)
    return Rel(df, IMAGE, rel.width, rel.height).image(*[F.when(still, F.col(c)).otherwise(F.greatest(n, num(0)) * F.pow(num(2), F.col("_ev"))) for c, n in zip(COLOURS, new, strict=True)])


__all__ = ["KEY", "selection_mask", "brush_mask", "smart_mask", "color_console"]
