"""Nodes that lay one picture over another: joins on the pixel key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, A, Rel
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.node import EngineError, Param, choice, node, number

MODES = ("normal", "multiply", "screen", "add", "overlay", "hard_light", "vivid_light", "linear_light", "soft_light", "darken", "lighten", "difference", "exclusion", "color_burn", "color_dodge", "hue", "saturation", "color", "luminosity")
COMPONENT = ("hue", "saturation", "color", "luminosity")


def divided(a: Column, b: Column) -> Column:
    return a / F.when(b == 0, num(1)).otherwise(b)


def blend_channel(mode: str, b: Column, s: Column) -> Column:
    """One channel of a separable blend: b below, s above."""
    one, two = num(1), num(2)
    screen2 = one - two * (one - b) * (one - s)
    if mode == "multiply":
        return b * s
    if mode == "screen":
        return one - (one - b) * (one - s)
    if mode == "add":
        return b + s
    if mode == "overlay":
        return F.when(b <= 0.5, two * b * s).otherwise(screen2)
    if mode == "hard_light":
        return F.when(s <= 0.5, two * b * s).otherwise(screen2)
    if mode == "vivid_light":
        burn, dodge = F.greatest(one - divided(one - b, two * s), num(0)), F.least(divided(b, two * (one - s)), one)
        return F.when(s <= 0, num(0)).when(s <= 0.5, burn).when(s >= 1, one).otherwise(dodge)
    if mode == "linear_light":
        return b + two * s - one
    if mode == "soft_light":
        d = F.when(b <= 0.25, ((num(16) * b - num(12)) * b + num(4)) * b).otherwise(F.sqrt(F.greatest(b, num(0))))
        return F.when(s <= 0.5, b - (one - two * s) * b * (one - b)).otherwise(b + (two * s - one) * (d - b))
    if mode == "darken":
        return F.least(b, s)
    if mode == "lighten":
        return F.greatest(b, s)
    if mode == "difference":
        return F.abs(b - s)
    if mode == "exclusion":
        return b + s - two * b * s
    if mode == "color_burn":
        return F.when(s <= 0, num(0)).otherwise(one - F.least(divided(one - b, s), one))
    if mode == "color_dodge":
        return F.when(s >= 1, one).otherwise(F.least(divided(b, one - s), one))
    return s


def lum(c) -> Column:
    return num(0.3) * c[0] + num(0.59) * c[1] + num(0.11) * c[2]


def span(c) -> Column:
    return F.greatest(*c) - F.least(*c)


def with_lum(c, y: Column):
    """c moved to a luminosity, then pulled into 0..1 around it."""
    d = y - lum(c)
    c = [v + d for v in c]
    at, low, high = lum(c), F.least(*c), F.greatest(*c)
    up = [F.when(low < 0, at + divided((v - at) * at, F.greatest(at - low, num(1e-6)))).otherwise(v) for v in c]
    return [F.when(high > 1, at + (v - at) * (num(1) - at) / F.greatest(high - at, num(1e-6))).otherwise(v) for v in up]


def with_span(c, s: Column):
    low, wide = F.least(*c), span(c)
    return [F.when(wide > 0, (v - low) * s / F.when(wide > 0, wide).otherwise(num(1))).otherwise(num(0)) for v in c]


def blend_pixel(mode: str, b, s):
    if mode == "hue":
        return with_lum(with_span(s, span(b)), lum(b))
    if mode == "saturation":
        return with_lum(with_span(b, span(s)), lum(b))
    if mode == "color":
        return with_lum(s, lum(b))
    if mode == "luminosity":
        return with_lum(b, lum(s))
    return [blend_channel(mode, x, y) for x, y in zip(b, s, strict=True)]


def laid_over(base: Rel, df, mode: str, cover: Column) -> Rel:
    """Porter-Duff over with a blend mode: df holds base's channels and the top's as t_*; cover is the top's coverage."""
    df = df.withColumn("_a", cover).withColumn("_ba", t.clamp(A()))
    b, s = [F.col(c) for c in "rgb"], [F.col(f"t_{c}") for c in "rgb"]
    df = df.withColumns({f"_m{c}": v for c, v in zip("rgb", blend_pixel(mode, b, s), strict=True)})
    a, ba = F.col("_a"), F.col("_ba")
    df = df.withColumn("_oa", a + ba * (num(1) - a))
    out = []
    for c, x, y in zip("rgb", b, s, strict=True):
        m = F.col(f"_m{c}")
        part = ((num(1) - ba) * a * y + (num(1) - a) * ba * x + a * ba * m) / F.when(F.col("_oa") > 1e-6, F.col("_oa")).otherwise(num(1))
        out.append(F.when(ba >= 1, x + (m - x) * a).when(F.col("_oa") > 1e-6, part).otherwise(num(0)))
    return Rel(df, IMAGE, base.width, base.height).image(*out, F.col("_oa"))


def fitted(rel: Rel, width: int, height: int, fit: str) -> Rel:
    if (rel.width, rel.height) == (width, height):
        return rel
    from rasterloom.operators.geometry import resized

    return resized(rel, width, height, fit)


@node("blend", needs=("base",), takes=("blend", "mask", "clip"), fit=choice("stretch", "fit", "fill", "none", "place"), mode=choice(*MODES), opacity=number(100), adjustment=Param(False))
def blend(inputs, p):
    """A layer over a base in one of 19 modes, weighted by opacity, its alpha, a clip layer's alpha and a mask. An adjustment layer changes colours by the weight and leaves alpha."""
    base, top = inputs["base"], inputs.get("blend")
    if top is None:
        return base
    df = base.joined(fitted(top, base.width, base.height, p["fit"]), "t_")
    df = df.fillna(0.0, [f"t_{c}" for c in "rgba"])
    weight = num(min(1.0, p["opacity"] / 100))
    if "clip" in inputs:
        clip = fitted(inputs["clip"], base.width, base.height, p["fit"])
        df = df.hint("merge").join(clip.df.select(*KEY, F.col("a").alias("_clip")), KEY, "left")
        weight = weight * t.clamp(F.coalesce("_clip", num(0)))
    if "mask" in inputs:
        mask = inputs["mask"]
        if mask.same_size(base):
            df = df.hint("merge").join(mask.df.select(*KEY, F.col("v" if mask.kind == FIELD else "r").alias("_mask")), KEY, "left")
            weight = weight * t.clamp(F.coalesce("_mask", num(0)))
        else:
            weight = num(0)
    if p["adjustment"]:
        df = df.withColumn("_w", weight)
        b, s = [F.col(c) for c in "rgb"], [F.col(f"t_{c}") for c in "rgb"]
        return Rel(df, IMAGE, base.width, base.height).image(*[x + (m - x) * F.col("_w") for x, m in zip(b, blend_pixel(p["mode"], b, s), strict=True)])
    return laid_over(base, df, p["mode"], weight * t.clamp(F.col("t_a")))


@node("merge", needs=("base",), takes=("fg",), fit=choice("stretch", "fit", "fill", "none"), opacity=number(100))
def merge(inputs, p):
    """A foreground over a base by its alpha."""
    base, fg = inputs["base"], inputs.get("fg")
    if fg is None:
        return base
    df = base.joined(fitted(fg, base.width, base.height, p["fit"]), "t_").fillna(0.0, [f"t_{c}" for c in "rgba"])
    df = df.withColumn("_fa", t.clamp(F.col("t_a") * num(min(1.0, p["opacity"] / 100)))).withColumn("_oa", F.col("_fa") + A() * (num(1) - F.col("_fa")))
    fa, oa = F.col("_fa"), F.col("_oa")
    out = []
    for c in "rgb":
        top, low = F.col(f"t_{c}") * fa, F.col(c) * (num(1) - fa)
        out.append(F.when(A() >= 1, top + low).when(oa > 1e-6, (top + low * A()) / F.when(oa > 1e-6, oa).otherwise(num(1))).otherwise(num(0)))
    return Rel(df, IMAGE, base.width, base.height).image(*out, oa)


@node("export_layer", needs=(), takes=("image", "mask", "alpha"), part=choice("rgb", "alpha"), name=Param(""), source=Param(""))
def export_layer(inputs, p):
    """A tap: the picture, or else the mask."""
    found = inputs.get("image") or inputs.get("mask")
    if found is None:
        raise EngineError("export_layer: nothing is connected")
    return found


@node("output", takes=("alpha",), format=Param("jpeg"), quality=number(90, 1, 100), long_edge=number(0, 0, 30000), color_space=Param("srgb"))
def output(inputs, p):
    return inputs["in"]
