"""Nodes that make and combine fields: masks as fuzzy predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, A, B, G, O, R, Rel, V
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.node import EngineError, Param, choice, node, number
from rasterloom.operators.point import SIGNED

DEPTH = {
    "depth_on": Param(False), "depth_invert": Param(False), "depth_black": number(0, 0, 0.99), "depth_white": number(1, 0.01, 1), "depth_gamma": number(1, 0.1, 10),
    "depth_black_soft": number(0), "depth_white_soft": number(0), "depth_band": Param(False), "depth_center": number(0.5, 0, 1), "depth_range": number(0.1, 0, 0.5), "depth_band_soft": number(0.1, 0, 0.5),
}


def plane_levels(near: Column, p) -> Column:
    """Levels of a depth plane: points, knees, clamp, gamma."""
    n = (near - num(p["depth_black"])) / num(max(p["depth_white"] - p["depth_black"], 1e-6))
    n = t.soft_low(n, p["depth_black_soft"] / 400)
    n = num(1) - t.soft_low(num(1) - n, p["depth_white_soft"] / 400)
    return F.pow(t.clamp(n), num(1 / max(0.1, p["depth_gamma"])))


def finish(rel: Rel, inputs, p, v: Column) -> Rel:
    """A mask inverted if asked, then weighted by nearness if it has a depth plane and is told to."""
    if p["invert"]:
        v = num(1) - v
    out = rel.field(v)
    depth = inputs.get("depth")
    if not p.get("depth_on") or depth is None or not depth.same_size(rel):
        return out
    near = plane_levels(num(1) - t.clamp(F.coalesce("d_v", num(1))), p)
    if p["depth_band"]:
        d = F.abs(near - num(p["depth_center"]))
        soft = num(0) if p["depth_band_soft"] <= 0 else num(1) - t.ramp(d, p["depth_range"], p["depth_range"] + p["depth_band_soft"])
        near = F.when(d <= p["depth_range"], num(1)).otherwise(soft)
    if p["depth_invert"]:
        near = num(1) - near
    return Rel(out.joined(depth, "d_"), FIELD, rel.width, rel.height).field(V() * near)


@node("luminance_extract", gives=FIELD)
def luminance_extract(inputs, p):
    return inputs["in"].field(t.luma(R(), G(), B()))


@node("luminance_range_mask", gives=FIELD, low=number(0, 0, 1), high=number(1, 0, 1), feather=number(0.1, 0, 1), invert=Param(False))
def luminance_range_mask(inputs, p):
    f, y = max(p["feather"], 1e-6), t.luma(R(), G(), B())
    return finish(inputs["in"], inputs, p, t.ramp(y, p["low"] - f, p["low"]) * (num(1) - t.ramp(y, p["high"], p["high"] + f)))


@node("invert_mask", needs=("mask",), gives=FIELD)
def invert_mask(inputs, p):
    return inputs["mask"].field(num(1) - V())


@node("measure", gives=FIELD, metric=choice("luma", "red", "green", "blue", "hue", "chroma", "saturation", "alpha"), smoothing=number(0))
def measure(inputs, p):
    """One quantity a pixel, smoothed by a box if asked."""
    rel = inputs["in"]
    c, h = t.chroma_hue(t.to_oklab(R(), G(), B()))
    high, low = F.greatest(R(), G(), B()), F.least(R(), G(), B())
    v = {
        "luma": t.luma(R(), G(), B()), "red": R(), "green": G(), "blue": B(), "alpha": A(),
        "hue": F.when(c > 1e-6, h / num(360)).otherwise(num(0)), "chroma": c / num(0.4),
        "saturation": F.when(high > 1e-6, F.greatest((high - low) / F.when(high == 0, num(1)).otherwise(high), num(0))).otherwise(num(0)),
    }[p["metric"]]
    out = rel.field(v)
    radius = round(p["smoothing"])
    if radius:
        from rasterloom.operators.spatial import box_mean

        return box_mean(out, radius)
    return out


def empty_field(rel: Rel | None) -> Rel:
    """A field of one pixel, 0: what an open port gives."""
    if rel is None:
        raise EngineError("nothing is connected")
    return Rel(rel.df.limit(1).select(F.lit(0).alias("frame_id"), F.lit(0).alias("y"), F.lit(0).alias("x"), num(0).alias("v")), FIELD, 1, 1)


@node("compare", gives=FIELD, op=choice("gt", "lt", "le", "ge", "eq", "neq", strict=True), level=number(0.5, 0, 1), softness=number(0, 0, 1))
def compare(inputs, p):
    """A predicate, hard or as a ramp."""
    op, at, soft = p["op"], p["level"], min(1.0, p["softness"])
    if op in ("eq", "neq"):
        k = t.clamp(num(1) - F.abs(V() - num(at)) / num(max(soft, 0.001)))
        return inputs["in"].field(k if op == "eq" else num(1) - k)
    if soft > 0:
        s = t.ramp(V(), at - soft / 2, at + soft / 2)
        return inputs["in"].field(num(1) - s if op in ("lt", "le") else s)
    test = {"gt": V() > at, "ge": V() >= at, "lt": V() < at, "le": V() <= at}[op]
    return inputs["in"].field(F.when(test, num(1)).otherwise(num(0)))


def two_fields(name: str, a: Rel, b: Rel) -> Rel:
    if not a.same_size(b):
        raise EngineError(f"{name}: the fields are of different sizes")
    return Rel(a.joined(b, "o_", "inner"), FIELD, a.width, a.height)




@node("logic", needs=(), takes=("in", "fg"), gives=FIELD, op=choice("and", "or", "xor", "subtract", strict=True))
def logic(inputs, p):
    """Fuzzy and, or, exclusive or, and subtract; with one side open the other passes."""
    a, b = inputs.get("in"), inputs.get("fg")
    if a is None or b is None:
        if a is None and b is None:
            raise EngineError("logic: nothing is connected")
        return a or b
    return two_fields("logic", a, b).field({"and": F.least(V(), O()), "or": F.greatest(V(), O()), "xor": F.abs(V() - O()), "subtract": t.clamp(V() - O())}[p["op"]])


@node("math", needs=(), takes=("in", "fg"), gives=FIELD, op=choice("add", "subtract", "multiply", "divide", "min", "max", "difference", "power", strict=True), constant=SIGNED(m=1), scale=SIGNED(1, 4), offset=SIGNED(m=1))
def math_node(inputs, p):
    """Arithmetic of two fields, or of one and a constant."""
    a, b = inputs.get("in"), inputs.get("fg")
    if a is None and b is None:
        raise EngineError("math: nothing is connected")
    rel = two_fields("math", a, b) if a and b else a or b
    x, y = (V(), O()) if a and b else (V(), num(p["constant"])) if a else (num(0), V())
    v = {
        "add": x + y, "subtract": x - y, "multiply": x * y, "min": F.least(x, y), "max": F.greatest(x, y), "difference": F.abs(x - y),
        "divide": F.when(F.abs(y) > 1e-9, x / F.when(F.abs(y) > 1e-9, y).otherwise(num(1))).otherwise(num(0)), "power": F.pow(F.greatest(x, num(0)), y),
    }[p["op"]]
    return rel.field(v * num(p["scale"]) + num(p["offset"]))


@node("remap", gives=FIELD, in_low=SIGNED(0, 1), in_high=SIGNED(1, 1), gamma=number(1, 0.1, 10), out_low=SIGNED(0, 1), out_high=SIGNED(1, 1), clamp=Param(True))
def remap(inputs, p):
    u = F.pow(t.clamp((V() - num(p["in_low"])) / num(max(p["in_high"] - p["in_low"], 1e-6))), num(1 / max(0.01, p["gamma"])))
    v = num(p["out_low"]) + u * num(p["out_high"] - p["out_low"])
    return inputs["in"].field(t.clamp(v) if p["clamp"] else v)


@node("conditional", takes=("fg", "mask"))
def conditional(inputs, p):
    """Per pixel if and else: fg where the mask says so."""
    rel, then, mask = inputs["in"], inputs.get("fg"), inputs.get("mask")
    if then is None or mask is None or not then.same_size(rel) or not mask.same_size(rel):
        return rel
    from rasterloom.operators.node import blend_by_mask

    return blend_by_mask(rel, then, mask)


@node("channel_join", needs=(), takes=("r", "g", "b", "alpha"))
def channel_join(inputs, p):
    """Fields as channels; missing ones are 0, alpha 1."""
    given = [k for k in ("r", "g", "b", "alpha") if k in inputs]
    if not given:
        raise EngineError("channel_join: nothing is connected")
    first = inputs[given[0]]
    df = first.df.select(*KEY)
    for k in given:
        if not inputs[k].same_size(first):
            raise EngineError("channel_join: the fields are of different sizes")
        df = df.hint("merge").join(inputs[k].df.select(*KEY, F.col("v").alias(f"_{k}")), KEY, "left")
    chan = [F.coalesce(f"_{k}", num(0)) if k in given else num(0) for k in "rgb"]
    alpha = t.clamp(F.coalesce("_alpha", num(1))) if "alpha" in given else num(1)
    return Rel(df, IMAGE, first.width, first.height).image(*chan, alpha)


def window(v: Column, low: float, high: float, soft: float) -> Column:
    return t.quintic(v, low - soft, low) * (num(1) - t.quintic(v, high, high + soft))


@node("range_mask", takes=("depth",), gives=FIELD, params=DEPTH, luma_low=number(0, 0, 1), luma_high=number(1, 0, 1), sat_low=number(0, 0, 1), sat_high=number(1, 0, 1), hue_center=SIGNED(m=180), hue_width=number(180, 0, 180), softness=number(0.15, 0, 1), invert=Param(False))
def range_mask(inputs, p):
    """Windows of tone, saturation and hue, all at once."""
    soft = max(p["softness"], 1e-4)
    h, s = t.hue_sat(R(), G(), B())
    v = window(t.clamp(t.encode(F.greatest(t.luma(R(), G(), B()), num(0)))), p["luma_low"], p["luma_high"], soft) * window(s, p["sat_low"], p["sat_high"], soft)
    if p["hue_width"] < 179.5:
        v = v * (num(1) - t.ramp(t.hue_gap(h, p["hue_center"]), p["hue_width"], p["hue_width"] + soft * 180))
    return finish(inputs["in"], inputs, p, v)


@node("color_range_mask", gives=FIELD, color=Param("#ffffff"), range=number(0.2, 0, 1), falloff=number(0.1, 0, 1), invert=Param(False))
def color_range_mask(inputs, p):
    target = t.hex_linear(p["color"])
    d = F.sqrt(sum(((c - num(v)) * (c - num(v)) for c, v in zip((R(), G(), B()), target, strict=True)), num(0)))
    return finish(inputs["in"], inputs, p, num(1) - t.ramp(d, p["range"], p["range"] + max(p["falloff"], 1e-6)))


@node("hue_range_mask", takes=("depth",), gives=FIELD, params=DEPTH, band_center=number(30, 0, 360), hue_range=number(60, 0, 180), hue_falloff=number(30, 0, 120), invert=Param(False))
def hue_range_mask(inputs, p):
    c, h = t.chroma_hue(t.to_oklab(R(), G(), B()))
    half = p["hue_range"] / 2
    return finish(inputs["in"], inputs, p, (num(1) - t.quintic(t.hue_gap(h, p["band_center"]), half, half + max(p["hue_falloff"], 1e-3))) * t.quintic(c, 0.01, 0.05))


def box_distance(x: Column, y: Column, bx: float, by: float) -> Column:
    dx, dy = F.abs(x) - num(bx), F.abs(y) - num(by)
    ox, oy = F.greatest(dx, num(0)), F.greatest(dy, num(0))
    return F.sqrt(ox * ox + oy * oy) + F.least(F.greatest(dx, dy), num(0))


def hull_distance(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    sides = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        ex, ey = bx - ax, by - ay
        n = max(math.hypot(ex, ey), 1e-6)
        sides.append((x - num(ax)) * num(ey / n) + (y - num(ay)) * num(-ex / n))
    return F.greatest(*sides)


def shape_distance(shape: str, x: Column, y: Column, amount: float) -> Column:
    """Signed distance to a shape of unit size, negative inside."""
    k = max(0.0, min(1.0, amount))
    disc = F.sqrt(x * x + y * y) - num(1)
    if shape == "rectangle":
        return box_distance(x, y, 1, 1)
    if shape == "triangle":
        return hull_distance(x, y, [(0, -4 / 3), (1, 2 / 3), (-1, 2 / 3)])
    if shape == "trapeze":
        top = max(1 - 0.8 * k, 0.05)
        return hull_distance(x, y, [(-top, -1), (top, -1), (1, 1), (-1, 1)])
    if shape == "cross":
        arm = min(0.1 + 0.55 * k, 0.95)
        return F.least(box_distance(x, y, 1, arm), box_distance(x, y, arm, 1))
    if shape == "crescent":
        off = 0.15 + 1.25 * k
        return F.greatest(disc, num(1) - F.sqrt((x + num(off)) * (x + num(off)) + y * y))
    if shape == "semicircle":
        return F.greatest(disc, -y)
    return disc


@node("radial_mask", takes=("depth",), gives=FIELD, params=DEPTH, center_x=SIGNED(0.5, 2), center_y=SIGNED(0.5, 2), radius=number(0.4, 0.01, 1), feather=number(0.3, 0, 1), shape=Param(""), aspect=number(1, 0.1, 10), rotation=SIGNED(m=180), shape_amount=number(0.5, 0, 1), invert=Param(False))
def radial_mask(inputs, p):
    """A shape in a turned frame with an inner feather. With a named shape the frame's aspect is corrected."""
    rel = inputs["in"]
    w, h = rel.width, rel.height
    short = min(w, h)
    ax, ay = (w / short, h / short) if p["shape"] else (1.0, 1.0)
    radius, aspect = max(p["radius"], 0.01), max(0.1, min(10.0, p["aspect"]))
    rx, ry = radius * math.sqrt(aspect), radius / math.sqrt(aspect)
    s, c = math.sin(-math.radians(p["rotation"])), math.cos(-math.radians(p["rotation"]))
    nx = ((F.col("x") + num(0.5)) / num(w) - num(p["center_x"])) * num(ax)
    ny = ((F.col("y") + num(0.5)) / num(h) - num(p["center_y"])) * num(ay)
    d = shape_distance(p["shape"], (nx * num(c) - ny * num(s)) / num(rx), (nx * num(s) + ny * num(c)) / num(ry), p["shape_amount"])
    return finish(rel, inputs, p, num(1) - t.ramp(d, -min(1.0, p["feather"]), 0.0))


@node("linear_mask", takes=("depth",), gives=FIELD, params=DEPTH, angle=SIGNED(90, 180), position=SIGNED(0.5, 2), span=number(0.25, 0.02, 1), invert=Param(False))
def linear_mask(inputs, p):
    rel, half = inputs["in"], max(p["span"], 0.02) / 2
    a = math.radians(p["angle"])
    at = ((F.col("x") + num(0.5)) / num(rel.width) - num(0.5)) * num(math.cos(a)) + ((F.col("y") + num(0.5)) / num(rel.height) - num(0.5)) * num(math.sin(a)) + num(0.5)
    return finish(rel, inputs, p, num(1) - t.ramp(at, p["position"] - half, p["position"] + half))


@node("depth_map", takes=("depth",))
def depth_map(inputs, p):
    return inputs["in"]


@node("fog", takes=("depth",), masked=True, density=number(0), start=number(0), falloff=number(50), fog_level=number(72), fog_hue=number(220, 0, 360), fog_sat=number(10), desat=number(0), texture=number(0), texture_size=number(30), texture_shift=number(0), params={k: DEPTH[k] for k in ("depth_black", "depth_white", "depth_gamma", "depth_black_soft", "depth_white_soft")})
def fog(inputs, p):
    """Farness fades a picture into a fog colour."""
    rel, depth = inputs["in"], inputs.get("depth")
    density = p["density"] / 100
    if density <= 0 or depth is None or not depth.same_size(rel):
        return rel
    df = rel.joined(depth, "d_")
    far = num(1) - plane_levels(num(1) - t.clamp(F.coalesce("d_v", num(0))), p)
    start = p["start"] / 100
    df = df.withColumn("_x", t.clamp((far - num(start)) / num(max(1 - start, 1e-3))))
    df = df.withColumn("_f", num(1) - F.exp(num(-3 * density) * F.pow("_x", num(10 ** ((p["falloff"] - 50) / 50)))))
    if p["texture"] > 0:
        wave = max(1.0, min(rel.width, rel.height) / (1.5 + p["texture_size"] / 100 * 10))
        df = df.withColumn("_n", t.fractal_noise(F.col("x") / num(wave) + num(p["texture_shift"] * 7.77), F.col("y") / num(wave) + num(p["texture_shift"] * 3.33)))
        df = df.withColumn("_f", t.clamp(F.col("_f") * (num(1) + num(p["texture"] / 100 * 0.85) * (F.col("_n") * num(2) - num(1)))))
    level = max(0.02, min(0.98, p["fog_level"] / 100))
    base = level / 12.92 if level <= 0.04045 else ((level + 0.055) / 1.055) ** 2.4
    sat = p["fog_sat"] / 100
    colour = [base * (1 - sat + sat * v) for v in t.hexcone_of(p["fog_hue"])]
    y = t.luma(R(), G(), B())
    faded = [c + (y - c) * num(p["desat"] / 100) * F.col("_x") for c in (R(), G(), B())]
    return Rel(df, IMAGE, rel.width, rel.height).image(*[c + (num(v) - c) * F.col("_f") for c, v in zip(faded, colour, strict=True)])


@node("mask_crop", gives=FIELD, crop_x=number(0, 0, 0.95), crop_y=number(0, 0, 0.95), crop_w=number(1, 0.05, 1), crop_h=number(1, 0.05, 1))
def mask_crop(inputs, p):
    """A bilinear cut of a field."""
    from rasterloom.operators.geometry import sampled

    rel = inputs["in"]
    cx, cy = min(0.95, p["crop_x"]), min(0.95, p["crop_y"])
    cw, ch = max(0.05, min(1 - cx, p["crop_w"])), max(0.05, min(1 - cy, p["crop_h"]))
    if (cx, cy, cw, ch) == (0, 0, 1, 1):
        return rel
    w, h = max(1, math.floor(rel.width * cw + 0.5)), max(1, math.floor(rel.height * ch + 0.5))
    return sampled(rel, w, h, num(cx * rel.width) + F.col("x") + num(0.5), num(cy * rel.height) + F.col("y") + num(0.5))
