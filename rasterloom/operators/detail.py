"""Nodes with wide neighbourhoods, per-frame kernels or planted rasters: local contrast, layer effects, light, distance, lenses."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, Rel
from rasterloom.functions import eq
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.geometry import gathered, moved
from rasterloom.operators.node import EngineError, Param, choice, node, number
from rasterloom.operators.point import DETAIL, SIGNED
from rasterloom.operators.spatial import COLOURS, along, box_means, clamped_mean, gaussian, guided
from rasterloom.operators.tiles import over_tiles


def luma() -> Column:
    return t.luma(*[F.col(c) for c in COLOURS])


def self_guided(df, column: str, out: str, radius: int, eps: float, width: int, height: int):
    """df with out: column smoothed where it varies little in a box, kept where it varies much."""
    return all_self_guided(df, {out: (column, radius)}, eps, width, height)


def all_self_guided(df, wanted: dict[str, tuple[str, int]], eps: float, width: int, height: int):
    """df with several self_guided() columns, by name from a column and a radius: they share their passes along rows and columns."""
    c = F.col
    boxes = {out: (column, radius) for out, (column, radius) in wanted.items() if radius > 0}
    if boxes:
        df = df.withColumns({f"_m{o}": c(v) for o, (v, _) in boxes.items()} | {f"_c{o}": c(v) * c(v) for o, (v, _) in boxes.items()})
        df = box_means(df, {f"_{k}{o}": r for o, (_, r) in boxes.items() for k in "mc"}, width, height, True)
        var = {o: F.greatest(c(f"_c{o}") - c(f"_m{o}") * c(f"_m{o}"), num(0)) for o in boxes}
        df = df.withColumns({f"_a{o}": v / (v + num(eps)) for o, v in var.items()})
        df = df.withColumns({f"_b{o}": c(f"_m{o}") * (num(1) - c(f"_a{o}")) for o in boxes}).drop(*[f"_{k}{o}" for o in boxes for k in "mc"])
        df = box_means(df, {f"_{k}{o}": r for o, (_, r) in boxes.items() for k in "ab"}, width, height, True)
    return df.withColumns({o: c(f"_a{o}") * c(v) + c(f"_b{o}") if o in boxes else c(v) for o, (v, _) in wanted.items()}).drop(*[f"_{k}{o}" for o in boxes for k in "ab"])


# Shares of the frame's short side, least sigmas, and the common limits of the three scales of local contrast.
SCALES = ((4 / 1365, 1.0), (20 / 1365, 2.0), (55 / 1365, 4.0))
GAIN, LIMIT_UP, LIMIT_DOWN, EPS, DARK = 2.5, 0.16, 0.6, 0.005, 0.45


def gains(y: Column, weights: dict[str, float] | None, range_ev: float) -> list[Column]:
    """What an effect weighs in each channel: its tonal ranges' weights at luma y times its channels'."""
    if weights is None:
        return [num(1)] * 3
    parts = t.tonal(t.seen(y, range_ev))
    k = sum((part * num(weights[name]) for part, name in zip(parts, ("shadows", "midtones", "highlights"), strict=True)), num(0))
    return [k * num(weights[name]) for name in ("red", "green", "blue")]


def lit_luma() -> Column:
    """Luma to divide by: 1 where there is none."""
    return F.when(F.col("_l") > 1e-6, F.col("_l")).otherwise(num(1))


def local_contrast(rel: Rel, strengths, weights=(None, None, None), range_ev: float = 0.0) -> Rel:
    """The difference of display luma from its guided base at three scales, limited, times a strength, as a ratio of luma; weights scale what each scale changes."""
    short = min(rel.width, rel.height)
    df = rel.df.withColumn("_l", luma()).withColumn("_d", t.encode(F.greatest("_l", num(0)))).select("*", *[num(1).alias(f"_f{c}") for c in COLOURS])
    radii = [max(1, math.floor(max(short * share, least) * math.sqrt(3) + 0.5)) for share, least in SCALES]
    df = all_self_guided(df, {f"_base{k}": ("_d", r) for k, r in enumerate(radii) if strengths[k]}, EPS, rel.width, rel.height)
    for k, (strength, weight) in enumerate(zip(strengths, weights, strict=True)):
        if strength:
            raw = F.col("_d") - F.col(f"_base{k}")
            soft = raw / (num(1) + F.abs(raw / F.when(raw > 0, num(LIMIT_UP)).otherwise(num(LIMIT_DOWN))))
            new = F.greatest(F.col("_d") + num(GAIN * strength) * soft, F.col("_d") * num(DARK))
            df = df.withColumn("_ratio", t.decode(new) / lit_luma())
            for c, gain in zip(COLOURS, gains(F.col("_l"), weight, range_ev), strict=True):
                factor = F.col("_ratio")
                if weight is not None:  # more than the whole darkening stops at the floor
                    factor = F.when(gain == 1, factor).otherwise(F.greatest(num(1) + gain * (factor - num(1)), t.decode(F.col("_d") * num(DARK)) / lit_luma()))
                df = df.withColumn(f"_f{c}", F.when(F.col("_l") > 1e-6, F.col(f"_f{c}") * factor).otherwise(F.col(f"_f{c}")))
    return Rel(df, IMAGE, rel.width, rel.height).image(*[F.col(c) * F.col(f"_f{c}") for c in COLOURS])


# How much light a whole dehaze takes for haze, of luma and of each channel, and the tones below which colour is left alone.
VEIL, CHROMA_VEIL, CHROMA_FADE = 0.10, 0.15, (0.12, 0.40)


def luma_dehazed(rel: Rel, k: float) -> list[Column]:
    """A veil of light taken from luma (or laid on it) in display values; colour goes along as a ratio."""
    a, safe = VEIL * k, F.when(luma() > 1e-6, luma()).otherwise(num(1))
    y, d = luma(), t.encode(F.greatest(luma(), num(0)))
    lifted = t.decode((d - num(a)) / num(1 - a))
    ratio = F.when((y > 1e-6) & (d < 1), t.decode(F.greatest((d - num(a)) / num(1 - a), num(0))) / safe).otherwise(num(1))
    dark = (y <= 1e-6) & F.lit(k < 0)
    return [F.when(dark, F.col(c) + lifted - y).otherwise(F.col(c) * ratio) for c in COLOURS]


def chroma_dehazed(k: float) -> list[Column]:
    """The veil taken from each channel, at the luma there was; greys stay, and so do dark tones."""
    a, y = CHROMA_VEIL * max(-1.0, min(1.0, k)), luma()
    shown = {c: t.encode(F.greatest(c, num(0))) for c in COLOURS}
    clear = {c: F.when(d < 1, t.decode(F.greatest((d - num(a)) / num(1 - a), num(0)))).otherwise(F.col(c)) for c, d in shown.items()}
    left = t.luma(*clear.values())
    w = t.ramp(t.encode(F.greatest(y, num(0))), *CHROMA_FADE)
    sound = (y > 1e-6) & (left > 1e-6)
    return [F.when(sound, F.col(c) + (v * (y / F.when(sound, left).otherwise(num(1))) - F.col(c)) * w).otherwise(F.col(c)) for c, v in clear.items()]


def replaced(rel: Rel, new: list[Column], weights: dict[str, float] | None = None, guide: Column | None = None, range_ev: float = 0.0) -> Rel:
    """rel with new colours; under weights each channel goes that part of the way, by the tone of guide, and not below black."""
    if weights is None:
        return rel.image(*new)
    out = []
    for c, v, k in zip(COLOURS, new, gains(guide, weights, range_ev), strict=True):
        step = k * (v - F.col(c))
        out.append(F.when(step != 0, F.greatest(F.col(c) + step, num(0))).otherwise(F.col(c)))
    return rel.image(*out)


def detail_pass(rel: Rel, p) -> Rel:
    """Dehaze of luma, texture and clarity, then dehaze of colour, each weighed by tone and channel where weights aren't even. The tones are those of the picture that comes in."""
    k, strengths = p["dehaze"] / 100, [p["texture"] / 100, p["clarity"] / 100, 0.0]
    weights = []
    for name in ("texture", "clarity", "dehaze"):
        found = {part: p[f"{name}_{part}"] / 100 for part in ("shadows", "midtones", "highlights", "red", "green", "blue")}
        weights.append(found)
    even = all(abs(v - 1) < 1e-6 for w in weights for v in w.values())
    weights = [None if all(abs(v - 1) < 1e-6 for v in w.values()) else w for w in weights]
    if not k and not any(strengths):
        return rel
    first = None
    if not even and k:  # the luma that comes in steers the colour half too
        first = F.col("_first")
        rel = Rel(rel.df.withColumn("_first", luma()), rel.kind, rel.width, rel.height)

    def carried(new: Rel, old: Rel) -> Rel:
        if first is None:
            return new
        return Rel(new.df.hint("merge").join(old.df.select(*KEY, "_first"), KEY), new.kind, new.width, new.height)

    if k:
        rel = carried(replaced(rel, luma_dehazed(rel, k), weights[2], first, p["range_ev"]), rel)
    if any(strengths):
        rel = carried(local_contrast(rel, strengths, (weights[0], weights[1], None), p["range_ev"]), rel)
    if k:
        rel = replaced(rel, chroma_dehazed(k), weights[2], first, p["range_ev"])
    return rel


@node("clarity", masked=True, texture=SIGNED(), clarity=SIGNED(), local_contrast=SIGNED())
def clarity(inputs, p):
    s = [p[k] / 100 for k in ("texture", "clarity", "local_contrast")]
    return local_contrast(inputs["in"], s) if any(s) else inputs["in"]


@node("detail", masked=True, params=DETAIL)
def detail(inputs, p):
    return detail_pass(inputs["in"], p)


# The five bands of detail, finest first, as shares of the short side with least sigmas, and how a band is shown alone.
BANDS = {"fine": (1.2 / 1365, 0.6), "small": (4 / 1365, 1.0), "medium": (12 / 1365, 2.0), "large": (36 / 1365, 4.0), "broad": (100 / 1365, 8.0)}
VIEW_GREY, VIEW_GAIN = 0.5, 3.0


@node("detail_eq", masked=True, params={k: SIGNED() for k in BANDS} | {k: number(100, 0, 200) for k in ("shadows", "midtones", "highlights", "red", "green", "blue")} | {"range_ev": SIGNED(m=20), "view": Param("")})
def detail_eq(inputs, p):
    """Display luma split into five bands by guided bases of widening radii: a raised band comes back through a soft limit, a lowered one goes in proportion; the new luma lands as a ratio, weighed by tone and channel. A view shows one band alone."""
    rel = inputs["in"]
    strengths = [max(-1.0, min(1.0, p[k] / 100)) for k in BANDS]
    shown = int(p["view"][5:]) if p["view"].startswith("band:") and p["view"][5:] in ("1", "2", "3", "4", "5") else 0
    needed = shown or max((k + 1 for k, v in enumerate(strengths) if v), default=0)
    if not needed:
        return rel
    short = min(rel.width, rel.height)
    df = rel.df.withColumn("_l", luma()).withColumn("_d", t.encode(F.greatest("_l", num(0)))).withColumn("_finer", F.col("_d")).withColumn("_change", num(0))
    radii = [max(1, math.floor(max(short * share, least) * math.sqrt(3) + 0.5)) for share, least in BANDS.values()]
    bands = [k for k in range(needed) if not shown or k + 2 >= shown]
    df = all_self_guided(df, {f"_base{k}": ("_d", radii[k]) for k in bands}, EPS, rel.width, rel.height)
    for k in bands:
        band = F.col("_finer") - F.col(f"_base{k}")
        if strengths[k] and not shown:
            soft = band / (num(1) + F.abs(band / F.when(band > 0, num(LIMIT_UP)).otherwise(num(LIMIT_DOWN))))
            df = df.withColumn("_change", F.col("_change") + (num(GAIN * strengths[k]) * soft if strengths[k] > 0 else num(strengths[k]) * band))
        df = df.withColumn("_band", band).withColumn("_finer", F.col(f"_base{k}")).drop(f"_base{k}")
    if shown:
        grey = t.decode(t.clamp(num(VIEW_GREY) + num(VIEW_GAIN) * F.col("_band")))
        return Rel(df, IMAGE, rel.width, rel.height).image(grey, grey, grey)
    weights = {k: p[k] / 100 for k in ("shadows", "midtones", "highlights", "red", "green", "blue")}
    weights = None if all(abs(v - 1) < 1e-6 for v in weights.values()) else weights
    # columns of their own, as the code of one step has a largest size
    df = df.withColumns({"_ratio": t.decode(F.greatest(F.col("_d") + F.col("_change"), F.col("_d") * num(DARK))) / lit_luma(), "_floor": t.decode(F.col("_d") * num(DARK)) / lit_luma()})
    df = df.withColumns({f"_k{c}": k for c, k in zip(COLOURS, gains(F.col("_l"), weights, p["range_ev"]), strict=True)})
    still = (F.col("_l") <= 1e-6) | (F.col("_change") == 0)
    ratio, out = F.col("_ratio"), []
    for c in COLOURS:
        k = F.col(f"_k{c}")
        factor = ratio if weights is None else F.when(k == 1, ratio).otherwise(F.greatest(num(1) + k * (ratio - num(1)), F.col("_floor")))
        out.append(F.when(still, F.col(c)).otherwise(F.col(c) * factor))
    return Rel(df, IMAGE, rel.width, rel.height).image(*out)


@node("sharpen", masked=True, amount=number(0, 0, 300), radius=number(1, 0.1, 5), threshold=number(0, 0, 255))
def sharpen(inputs, p):
    """Unsharp mask against the guided base of each display channel; small differences stay."""
    rel, k = inputs["in"], p["amount"] / 100
    if k == 0:
        return rel
    size = max(0.1, p["radius"]) * math.sqrt(3)
    low, part = math.floor(size), size - math.floor(size)
    df = rel.df.withColumns({f"_e{c}": t.encode(F.greatest(c, num(0))) for c in COLOURS})
    df = all_self_guided(df, {f"_{name}{c}": (f"_e{c}", r) for c in COLOURS for name, r in (("lo", low), ("hi", low + 1))}, EPS, rel.width, rel.height)
    out = []
    for c in COLOURS:
        base = t.decode(F.greatest(F.col(f"_lo{c}") + (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * num(part), num(0)))
        d = F.col(c) - base
        out.append(F.when(F.abs(d) > p["threshold"] / 255, F.col(c) + num(k) * d).otherwise(F.col(c)))
    return Rel(df, IMAGE, rel.width, rel.height).image(*out)


@node("black_white", masked=True, red=number(30, -200, 300), green=number(59, -200, 300), blue=number(11, -200, 300), amount=number(0), hue_curve=Param(""), hue_curve_on=Param(True), eq_interp=Param(""))
def black_white(inputs, p):
    """Grey as a weighted sum of the channels, lighter or darker by a curve of the hue that a place has among its neighbours, blended by amount. Neutral places have no hue."""
    rel, k = inputs["in"], min(1.0, p["amount"] / 100)
    if k == 0:
        return rel
    grey = F.greatest(sum((F.col(c) * num(p[n] / 100) for c, n in zip(COLOURS, ("red", "green", "blue"), strict=True)), num(0)), num(0))
    points = eq.read(p["hue_curve"])
    if p["hue_curve_on"] and len(points) > 1 and any(q.y != 0 for q in points):
        df = rel.df.withColumns(dict(zip(("_l", "_a", "_b2"), t.to_oklab(*[F.greatest(F.col(c), num(0)) for c in COLOURS]), strict=True)))
        df = df.withColumn("_ta", F.col("_a")).withColumn("_tb", F.col("_b2"))
        if radius := int(min(rel.width, rel.height) * 0.006):
            df = df.withColumn("_ga", F.col("_a") * num(2)).withColumn("_gb", F.col("_b2") * num(2))
            df = guided(df, ["_ta", "_tb"], ["_l", "_ga", "_gb"], radius, 0.02 * 0.02, rel.width, rel.height, True)
            df = df.withColumn("_ta", F.col("_q_ta")).withColumn("_tb", F.col("_q_tb"))
        # hues count from a saturation of six hundredths of a tenth on, and in full four hundredths further
        gate = t.ramp(F.hypot("_ta", "_tb") / F.greatest(F.col("_l"), num(0.15)), 0.006, 0.046)
        hue = F.degrees(F.atan2("_tb", "_ta"))
        df = df.withColumn("_hue", F.when(hue < 0, hue + num(360)).otherwise(hue)).withColumn("_gate", gate)
        ev = t.clamp(eq.value(eq.bent(eq.around(points, 360.0), p["eq_interp"]), F.col("_hue")), -2, 2) * F.col("_gate")
        rel = Rel(df.withColumn("_k", F.pow(num(2), ev)), IMAGE, rel.width, rel.height)
        grey = grey * F.col("_k")
    return rel.image(*[F.col(c) + (grey - F.col(c)) * num(k) for c in COLOURS])


@node("halation", takes=("depth",), masked=True, threshold=number(50), background=number(50), by_depth=SIGNED(), radius=number(4, 0.5, 30), diffusion=number(60), hue=number(18, 0, 360), saturation=number(70), blue_comp=number(0), amount=number(100, 0, 300), mix=number(100), bloom=number(0), bloom_radius=number(20, 5, 60), view=Param(""))
def halation(inputs, p):
    """Light over a threshold spreads, tinted, around its source; with bloom it spreads wide and white."""
    rel = inputs["in"]
    amount, mix, bloom = p["amount"] / 100, p["mix"] / 100, p["bloom"] / 100
    if p["view"] != "source" and (amount <= 0 or mix <= 0) and bloom <= 0:
        return rel
    short = min(rel.width, rel.height)
    cut = 0.18 * 2 ** (p["threshold"] / 100 * 4)
    radius, wide = max(0.5, p["radius"] / 100 * short), max(0.5, p["bloom_radius"] / 100 * short)
    df = rel.df.withColumn("_y", luma()).withColumn("_o", F.greatest(F.col("_y") - num(cut), num(0)))
    k = F.col("_o") / F.greatest("_y", num(1e-6))
    depth = inputs.get("depth")
    if p["by_depth"] and depth is not None and depth.same_size(rel):
        df = df.hint("merge").join(depth.df.select(*KEY, F.col("v").alias("_far")), KEY, "left")
        k = k * t.clamp(num(1) + num(p["by_depth"] / 100) * (num(2) * F.coalesce("_far", num(0.5)) - num(1)), 0, 2)
    if p["background"] > 0:
        dim = Rel(df.withColumn("v", F.when(F.col("_y") < cut, F.col("_y")).otherwise(num(0))).select(*KEY, "v"), FIELD, rel.width, rel.height)
        df = df.hint("merge").join(gaussian(dim, radius, ["v"]).df.select(*KEY, F.col("v").alias("_near")), KEY)
        dark = F.sqrt(num(1) - t.clamp(F.col("_near") / num(cut)))
        gate = num(1) - num(p["background"] / 100) * (num(1) - dark)
    else:
        gate = num(1)
    source = Rel(df, IMAGE, rel.width, rel.height).image(*[F.col(c) * k * gate for c in COLOURS], F.col("_o") * gate)
    if p["view"] == "source":
        peak = source.df.groupBy("frame_id").agg(F.greatest(F.max("a"), num(1e-6)).alias("_peak"))
        shown = Rel(source.df.join(peak, "frame_id"), IMAGE, rel.width, rel.height)
        v = t.clamp(F.col("a") / F.col("_peak"))
        return shown.image(v, v, v, num(1))

    def spread(sigma: float, name: str):
        return gaussian(source, sigma, COLOURS).df.select(*KEY, *[F.col(c).alias(f"{name}{c}") for c in COLOURS])

    df = rel.df
    halo = [num(0)] * 3
    d = p["diffusion"] / 100
    if amount > 0:
        df = df.hint("merge").join(spread(radius, "_w"), KEY)
        halo = [F.col(f"_w{c}") for c in COLOURS]
        if d < 1:
            df = df.hint("merge").join(spread(radius * 0.45, "_n"), KEY)
            halo = [h * num(d) + F.greatest(h - F.col(f"_n{c}"), num(0)) * num(1 - d) for h, c in zip(halo, COLOURS, strict=True)]
    df = df.withColumns({f"_h{c}": h for c, h in zip(COLOURS, halo, strict=True)})
    hr, hg, hb = (F.col(f"_h{c}") for c in COLOURS)
    blue = F.greatest(hb - hr, num(0)) / F.greatest(hr + hg + hb, num(1e-6))
    df = df.withColumn("_lh", t.luma(hr, hg, hb) * (num(1) + num(2 * p["blue_comp"] / 100) * blue) * num(amount))
    glow = num(0)
    if bloom > 0:
        df = df.hint("merge").join(spread(wide, "_b"), KEY)
        glow = t.luma(*[F.col(f"_b{c}") for c in COLOURS]) * num(bloom)
    tint = [1 + (v - 1) * p["saturation"] / 100 for v in t.hexcone_of(p["hue"])]
    return Rel(df, IMAGE, rel.width, rel.height).image(*[F.greatest(F.col(c) + (F.col("_lh") * num(v) + glow) * num(mix), num(0)) for c, v in zip(COLOURS, tint, strict=True)])


def spread_alpha(rel: Rel, radius: float, dx: float, dy: float, invert: bool, gain: float) -> Rel:
    """A layer's coverage moved and blurred, on a frame with room around it for what lies outside."""
    sigma = radius / 2
    pad = math.ceil(2.5 * sigma) + math.ceil(max(abs(dx), abs(dy))) + 1
    w, h = rel.width + 2 * pad, rel.height + 2 * pad
    from rasterloom.operators.geometry import grid

    cover = Rel(rel.df.select("frame_id", (F.col("y") + pad).alias("y"), (F.col("x") + pad).alias("x"), t.clamp(F.col("a")).alias("v")), FIELD, w, h)
    room = grid(rel, w, h).hint("merge").join(cover.df, KEY, "left").select(*KEY, F.coalesce("v", num(0)).alias("v"))
    cover = Rel(room, FIELD, w, h)
    if dx or dy:
        places = room.select(*KEY, (F.col("x") - num(dx)).alias("_gx"), (F.col("y") - num(dy)).alias("_gy"))
        cover = Rel(gathered(cover, places), FIELD, w, h)
    if invert:
        cover = cover.field(num(1) - F.col("v"))
    if radius >= 0.5:
        cover = gaussian(cover, max(sigma, 0.3), ["v"])
    return moved(cover, rel.width, rel.height, F.col("x") - pad, F.col("y") - pad).field(t.clamp(F.col("v") * num(gain)))


SHADOW = {"size": number(12, 0, 250), "opacity": number(75), "color": Param("#000000"), "inner": Param(False)}


def cast_shadow(rel: Rel, p, distance: float, angle: float) -> Rel:
    dx, dy = -distance * math.cos(math.radians(angle)), distance * math.sin(math.radians(angle))
    spread = spread_alpha(rel, p["size"], dx, dy, p["inner"], 2.0)
    df = rel.joined(spread, "s_", "inner").withColumn("_s", F.col("s_v") * num(min(1.0, p["opacity"] / 100)))
    s, a = F.col("_s"), F.col("a")
    colour = t.hex_display(p["color"])
    placed = Rel(df, IMAGE, rel.width, rel.height)
    if p["inner"]:
        return placed.image(*[F.col(c) + (num(v) - F.col(c)) * t.clamp(s * a) for c, v in zip(COLOURS, colour, strict=True)])
    out = a + s * (num(1) - a)
    return placed.image(*[(F.col(c) * a + num(v) * s * (num(1) - a)) / F.greatest(out, num(1e-6)) for c, v in zip(COLOURS, colour, strict=True)], out)


@node("fx_shadow", params=SHADOW, distance=number(8, 0, 250), angle=SIGNED(135, 180))
def fx_shadow(inputs, p):
    """A layer's shadow under it, or inside its edge."""
    return cast_shadow(inputs["in"], p, p["distance"], p["angle"])


@node("fx_glow", params=SHADOW)
def fx_glow(inputs, p):
    return cast_shadow(inputs["in"], p, 0.0, 135.0)


@node("fx_bevel", size=number(6), depth=number(100, 0, 400), angle=SIGNED(135, 180), opacity=number(75), highlight=Param("#ffffff"), shadow=Param("#000000"))
def fx_bevel(inputs, p):
    """Light and shade on the slopes of a layer's blurred coverage."""
    rel = inputs["in"]
    a = spread_alpha(rel, max(1.0, p["size"]), 0, 0, False, 1.0)
    from rasterloom.operators.spatial import neighbours

    df = a.df.withColumns(dict(zip(("_l", "_r"), neighbours("x", F.col("v"), [-1, 1]), strict=True)))
    df = df.withColumns(dict(zip(("_u", "_d"), neighbours("y", F.col("v"), [-1, 1]), strict=True)))
    c, s = math.cos(math.radians(p["angle"])), -math.sin(math.radians(p["angle"]))
    lit = -((F.col("_r") - F.col("_l")) * num(c) + (F.col("_d") - F.col("_u")) * num(s)) * num(p["depth"] / 100 * 4)
    df = rel.df.hint("merge").join(df.select(*KEY, lit.alias("_lit")), KEY)
    k = F.least(F.abs("_lit"), num(1)) * num(min(1.0, p["opacity"] / 100)) * F.col("a")
    still = (F.col("a") <= 0) | (F.abs("_lit") < 1e-4)
    hi, lo = t.hex_display(p["highlight"]), t.hex_display(p["shadow"])
    return Rel(df, IMAGE, rel.width, rel.height).image(*[F.when(still, F.col(ch)).otherwise(F.col(ch) + (F.when(F.col("_lit") > 0, num(u)).otherwise(num(v)) - F.col(ch)) * k) for ch, u, v in zip(COLOURS, hi, lo, strict=True)])


@node("distance_field", gives=FIELD, max_distance=number(20, 0, 200))
def distance_field(inputs, p):
    """The signed distance to a mask's contour as a ramp. Only distances up to the ramp's end count, so a row's nearest other pixel within reach comes from a running window, and rows within reach are brought together."""
    rel = inputs["in"]
    most = p["max_distance"]
    inside = t.clamp(F.nanvl(F.col("v"), num(0))) >= 0.5
    df = rel.df.select(*KEY, inside.alias("_in"))
    if most <= 0:
        return Rel(df, FIELD, rel.width, rel.height).field(F.when(F.col("_in"), num(1)).otherwise(num(0)))
    reach = math.ceil(most + 0.5)
    row = along("x")
    back, ahead = row.rowsBetween(-reach, 0), row.rowsBetween(0, reach)
    for name, wanted in (("_o", ~F.col("_in")), ("_i", F.col("_in"))):
        place = F.when(wanted, F.col("x"))
        left, right = F.last(place, ignorenulls=True).over(back), F.first(place, ignorenulls=True).over(ahead)
        near = F.least(F.col("x") - left, right - F.col("x"))
        df = df.withColumn(name, near.cast("double") * near)
    col = along("y")
    for name in ("_o", "_i"):
        whole = F.collect_list(F.struct(F.col("y"), F.coalesce(name, num(1e12)).alias("d"))).over(col.rowsBetween(-reach, reach))
        df = df.withColumn(f"{name}2", F.sqrt(F.aggregate(whole, num(1e12), lambda best, s: F.least(best, s["d"] + (s["y"] - F.col("y")) * (s["y"] - F.col("y")).cast("double")))))
    signed = F.when(F.col("_in"), F.col("_o2") - num(0.5)).otherwise(num(0.5) - F.col("_i2"))
    return Rel(df, FIELD, rel.width, rel.height).field(t.clamp(num(0.5) + num(0.5) * t.clamp(signed / num(most), -1, 1)))


def read_cube(text: str) -> tuple[int, list[float], list[float], np.ndarray]:
    """Size, lowest and highest input, and values of a .cube table, red first."""
    size, low, high, rows = 0, [0.0] * 3, [1.0] * 3, []
    for line in text.splitlines():
        part = line.split()
        if not part or part[0].startswith("#") or part[0] == "TITLE":
            continue
        if part[0] == "LUT_3D_SIZE":
            size = int(part[1])
        elif part[0] == "LUT_1D_SIZE":
            raise EngineError("lut: one-dimensional tables aren't read")
        elif part[0] == "DOMAIN_MIN":
            low = [float(v) for v in part[1:4]]
        elif part[0] == "DOMAIN_MAX":
            high = [float(v) for v in part[1:4]]
        else:
            try:
                rows.append([float(v) for v in part[:3]])
            except ValueError:
                continue
    if not 2 <= size <= 256 or len(rows) != size**3:
        raise EngineError(f"lut: {len(rows)} entries for a table of size {size}")
    return size, low, high, np.array(rows)


#: Steps a side up to which a lookup table is part of the expression; a larger one is joined, a row a cell with its eight corners.
INLINE_SIZE = 33


def corners_of(size: int, table: np.ndarray) -> np.ndarray:
    """The values at the eight corners of each cell, by the cell's lowest corner."""
    grid = table.reshape(size, size, size, 3)  # blue, green, red
    n = size - 1
    return np.stack([grid[b : b + n, g : g + n, r : r + n] for b in (0, 1) for g in (0, 1) for r in (0, 1)], 3).reshape(n**3, 24)


@node("lut", masked=True, path=Param(""), amount=number(100))
def lut(inputs, p):
    """A .cube table looked up trilinearly in display values. Tables of up to INLINE_SIZE steps a side are one constant array in the expression, so nothing is joined; of larger ones each pixel meets its cell by one join."""
    rel, k = inputs["in"], min(1.0, p["amount"] / 100)
    if not p["path"].strip() or k <= 0:
        return rel
    spark = rel.df.sparkSession
    lines = spark.read.text(p["path"].strip(), wholetext=True).first()
    size, low, high, table = read_cube(lines[0] if lines else "")
    df = rel.df
    for c, lo, hi in zip(COLOURS, low, high, strict=True):
        at = t.clamp((t.encode(F.greatest(c, num(0))) - num(lo)) / num(max(hi - lo, 1e-6))) * num(size - 1)
        df = df.withColumn(f"_t{c}", at).withColumn(f"_n{c}", F.least(F.floor(f"_t{c}"), F.lit(size - 2)).cast("int")).withColumn(f"_f{c}", F.col(f"_t{c}") - F.col(f"_n{c}"))
    if size <= INLINE_SIZE:
        entries = F.split(F.lit(" ".join(map(repr, table.ravel().tolist()))), " ").cast("array<double>")
        first = F.col("_nr") + F.col("_ng") * size + F.col("_nb") * size * size

        def corner(r: int, g: int, b: int, channel: int) -> Column:
            return F.element_at(entries, (first + (r + g * size + b * size * size)) * 3 + (channel + 1))
    else:
        import pandas as pd

        cells = pd.DataFrame({"_cell": np.arange((size - 1) ** 3, dtype=np.int32)} | {f"_k{i}": v for i, v in enumerate(corners_of(size, table).T)})
        cell = F.col("_nr") + F.col("_ng") * (size - 1) + F.col("_nb") * (size - 1) ** 2
        df = df.withColumn("_at", cell).join(spark.createDataFrame(cells), F.col("_at") == F.col("_cell"))

        def corner(r: int, g: int, b: int, channel: int) -> Column:
            return F.col(f"_k{(b * 4 + g * 2 + r) * 3 + channel}")

    def mixed(channel: int) -> Column:
        total = num(0)
        for r, g, b in np.ndindex(2, 2, 2):
            w = num(1)
            for c, d in zip(COLOURS, (r, g, b), strict=True):
                w = w * (F.col(f"_f{c}") if d else num(1) - F.col(f"_f{c}"))
            total = total + w * corner(int(r), int(g), int(b), channel)
        return total

    return Rel(df, IMAGE, rel.width, rel.height).image(*[F.col(c) + (t.decode(t.clamp(mixed(i))) - F.col(c)) * num(k) for i, c in enumerate(COLOURS)])


LENS = {k: SIGNED(m=100) for k in ("distortion", "ca_red", "ca_blue", "vignette")} | {k: SIGNED(m=3) for k in ("dist_a", "dist_b", "dist_c", "tca_cr", "tca_br", "tca_cb", "tca_bb", "vig_k1", "vig_k2", "vig_k3")} | {k: number(1, 0.1, 4) for k in ("dist_scale", "tca_vr", "tca_vb")} | {"vignette_mid": number(50), "dist_model": choice("none", "ptlens", "poly3", "poly5")}


@node("lens_correct", masked=True, params=LENS)
def lens_correct(inputs, p):
    """Each channel read from a place scaled about the centre by distortion, colour error and a lens profile; falloff lifted. Alpha stays where it is."""
    rel = inputs["in"]
    k, red, blue = p["distortion"] / 1000, p["ca_red"] / 20000, p["ca_blue"] / 20000
    vig, mid = p["vignette"] / 100, max(0.0, min(0.95, p["vignette_mid"] / 100))
    a, b, c, scale = p["dist_a"], p["dist_b"], p["dist_c"], max(0.1, min(4.0, p["dist_scale"]))
    cx, cy = (rel.width - 1) / 2, (rel.height - 1) / 2
    norm, short = max(math.hypot(cx, cy), 1e-6), max(min(cx, cy), 1e-6)
    dx, dy = F.col("x") - num(cx), F.col("y") - num(cy)
    df = rel.df.withColumn("_q", F.sqrt(dx * dx + dy * dy))
    r, u = F.col("_q") / num(norm), F.col("_q") / num(short) * num(scale)
    gain = num(1) + num(vig) * t.ramp(r, mid, 1.0)
    if p["vig_k1"] or p["vig_k2"] or p["vig_k3"]:
        q = r * r * num(scale * scale)
        gain = gain / F.greatest(num(1) + num(p["vig_k1"]) * q + num(p["vig_k2"]) * q * q + num(p["vig_k3"]) * q * q * q, num(0.05))
    profile = num(1)
    if p["dist_model"] != "none" and (a or b or c):
        profile = {"poly3": num(1 - a) + num(a) * u * u, "poly5": num(1) + num(a) * u * u + num(b) * u * u * u * u, "ptlens": num(a) * u * u * u + num(b) * u * u + num(c) * u + num(1 - a - b - c)}[p["dist_model"]]
    tca = {"r": num(p["tca_br"]) * u * u + num(p["tca_cr"]) * u + num(p["tca_vr"]), "g": num(1), "b": num(p["tca_bb"]) * u * u + num(p["tca_cb"]) * u + num(p["tca_vb"])}
    untouched = not (k or red or blue or vig) and p["dist_model"] == "none" and (p["tca_vr"], p["tca_vb"]) == (1, 1) and not any(p[n] for n in ("tca_cr", "tca_br", "tca_cb", "tca_bb", "vig_k1", "vig_k2", "vig_k3"))
    if untouched:
        return rel
    df = df.withColumns({f"_s{ch}": profile * tca[ch] * (num(1) + num(extra) * r * r) for ch, extra in zip(COLOURS, (k + red, k, k + blue), strict=True)})
    # a pixel's three places and its own, for alpha, are gathered together by bare keys and meet again as one row
    clipped = lambda v, n: F.least(F.greatest(v, num(0)), num(n - 1))
    corners = []
    for i, ch in enumerate(COLOURS):
        gx, gy = clipped(num(cx) + dx * F.col(f"_s{ch}"), rel.width), clipped(num(cy) + dy * F.col(f"_s{ch}"), rel.height)
        df = df.withColumns({f"_gx{ch}": gx, f"_gy{ch}": gy})
        gx, gy = F.col(f"_gx{ch}"), F.col(f"_gy{ch}")
        x0, y0 = F.floor(gx), F.floor(gy)
        tx, ty = gx - x0, gy - y0
        for px, py, w in ((x0, y0, (num(1) - tx) * (num(1) - ty)), (F.least(x0 + 1, F.lit(rel.width - 1)), y0, tx * (num(1) - ty)), (x0, F.least(y0 + 1, F.lit(rel.height - 1)), (num(1) - tx) * ty), (F.least(x0 + 1, F.lit(rel.width - 1)), F.least(y0 + 1, F.lit(rel.height - 1)), tx * ty)):
            corners.append(F.struct(F.lit(i).alias("ch"), px.cast("int").alias("sx"), py.cast("int").alias("sy"), w.alias("w")))
    corners.append(F.struct(F.lit(3).alias("ch"), F.col("x").alias("sx"), F.col("y").alias("sy"), num(1).alias("w")))
    wide = df.select(*KEY, F.explode(F.filter(F.array(*corners), lambda c: c["w"] > 0)).alias("_c")).select(*KEY, "_c.*")
    source = rel.df.select("frame_id", F.col("x").alias("sx"), F.col("y").alias("sy"), *[F.col(c).alias(f"_v{c}") for c in "rgba"])
    joined = wide.hint("merge").join(source, ["frame_id", "sx", "sy"], "left")
    found = joined.groupBy(*KEY).agg(*[F.sum(F.when(F.col("ch") == i, F.col("w") * F.col(f"_v{c}"))).alias(c) for i, c in enumerate("rgba")])
    found = found.withColumn("_q", F.sqrt(dx * dx + dy * dy)).withColumn("_gain", gain)
    return Rel(found, IMAGE, rel.width, rel.height).image(*[F.col(ch) * F.col("_gain") for ch in COLOURS])


@node("model_denoise", takes=("raster",), masked=True, luminance=number(50), chroma=number(50), detail=number(50))
def model_denoise(inputs, p):
    """A denoised raster blended in display values, luma and colour on their own; where it has edges luma gives way."""
    rel, raster = inputs["in"], inputs.get("raster")
    lum, chroma, keep = (min(1.0, p[k] / 100) for k in ("luminance", "chroma", "detail"))
    if raster is None or not raster.same_size(rel) or (lum <= 0 and chroma <= 0):
        return rel
    sound = F.lit(True)
    for c in COLOURS:
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    held = [t.clamp(F.col(c)) for c in COLOURS]
    near = Rel(raster.df.withColumn("v", F.when(sound, t.luma(*held))).select(*KEY, "v", *[h.alias(f"_d{c}") for h, c in zip(held, COLOURS, strict=True)]), FIELD, rel.width, rel.height)
    rows, cols = along("x"), along("y")
    steps = [F.coalesce(F.abs(F.col("v") - f("v").over(w)), num(0)) for w in (rows, cols) for f in (F.lag, F.lead)]
    df = near.df.withColumn("_g", F.greatest(*steps))
    df = rel.df.hint("merge").join(df.withColumnRenamed("v", "_yd"), KEY)
    df = df.withColumns({f"_s{c}": t.encode(F.greatest(c, num(0))) for c in COLOURS})
    df = df.withColumn("_ys", t.luma(*[F.col(f"_s{c}") for c in COLOURS]))
    ys, yd = F.col("_ys"), F.col("_yd")
    y = ys + (yd - ys) * num(lum) + (ys - yd) * num(lum * keep) * t.ramp(F.col("_g"), 0.01, 0.08)
    still = yd.isNull() | (F.greatest(*COLOURS) >= 1)
    out = []
    for c in COLOURS:
        cs, cd = F.col(f"_s{c}") - ys, F.col(f"_d{c}") - yd
        out.append(F.when(still, F.col(c)).otherwise(t.decode(t.clamp(y + cs + (cd - cs) * num(chroma)))))
    return Rel(df, IMAGE, rel.width, rel.height).image(*out)


@node("inpaint", takes=("raster",), masked=True, hole=choice("wire", "layer", strict=True), fill_id=Param(""), model=Param(""))
def inpaint(inputs, p):
    """A planted fill, where there is a hole: a mask is wired, or the layer itself is one."""
    rel, raster = inputs["in"], inputs.get("raster")
    if raster is None or ("mask" not in inputs and p["hole"] != "layer"):
        return rel
    from rasterloom.operators.combine import fitted

    fill = fitted(raster, rel.width, rel.height, "stretch")
    return Rel(rel.joined(fill, "f_"), IMAGE, rel.width, rel.height).image(*[F.coalesce(f"f_{c}", F.col(c)) for c in COLOURS])


@node("matte_mask", takes=("raster", "depth"), gives=FIELD, feather=number(0), invert=Param(False))
def matte_mask(inputs, p):
    """A planted coverage, feathered by three boxes."""
    rel, raster = inputs["in"], inputs.get("raster")
    if raster is None:
        out = rel.field(num(0))
    else:
        from rasterloom.operators.combine import fitted

        plane = fitted(raster, rel.width, rel.height, "stretch")
        plane = plane if plane.kind == FIELD else plane.field(F.col("r"))
        out = rel.field(num(0)).joined(plane, "m_")
        out = Rel(out, FIELD, rel.width, rel.height).field(t.clamp(F.coalesce("m_v", num(0))))
    radius = round(p["feather"] / 100 * min(rel.width, rel.height) / 4)
    for _ in range(3 if radius > 0 else 0):
        for axis, size in (("x", rel.width), ("y", rel.height)):
            if size > 1:
                out = Rel(out.df.select(*KEY, clamped_mean(axis, radius, size)(F.col("v")).alias("v")), FIELD, rel.width, rel.height)
    return out.field(num(1) - F.col("v")) if p["invert"] else out


def hashed(seed: int) -> Column:
    """A number from 0 to 1 for each pixel of each frame, the same everywhere."""
    return t.lattice_hash(F.col("x") + F.lit(7919 * seed), F.col("y") + F.col("frame_id").cast("long") * F.lit(104_729))


def noise_plane(rel: Rel, size: float, seed: int) -> Rel:
    """Noise of mean 0 and deviation 1 in each frame: a hash a pixel, smoothed to a grain size."""
    plane = rel.field(hashed(seed) - num(0.5))
    plane = gaussian(plane, max(0.0, size / 50.0))
    stats = plane.df.groupBy("frame_id").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    return Rel(plane.df.join(stats, "frame_id"), FIELD, rel.width, rel.height).field((F.col("v") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(num(1)))


@node("noise", size=number(25, 1, 100), color_grain=Param(False), seed=number(0, 0, 9999))
def noise(inputs, p):
    """A grain field as a picture about middle grey."""
    rel, seed = inputs["in"], int(p["seed"])
    df = rel.df
    for i, c in enumerate(COLOURS):
        plane = noise_plane(rel, p["size"], seed * 8 + (i if p["color_grain"] else 0))
        df = df.hint("merge").join(plane.df.select(*KEY, F.col("v").alias(f"_n{c}")), KEY)
    return Rel(df, IMAGE, rel.width, rel.height).image(*[t.clamp(num(0.5) + F.col(f"_n{c}") * num(0.15)) for c in COLOURS], num(1))


@node("grain", masked=True, intensity=number(0), size=number(25, 1, 100), color_grain=Param(False), shadows_gain=number(100, 0, 200), midtones_gain=number(100, 0, 200), highlights_gain=number(100, 0, 200), red_gain=number(100, 0, 200), green_gain=number(100, 0, 200), blue_gain=number(100, 0, 200))
def grain(inputs, p):
    """Noise strongest in the midtones, with gains by tone and channel."""
    rel = inputs["in"]
    if p["intensity"] <= 0:
        return rel
    df = rel.df
    for i, c in enumerate(COLOURS):
        plane = noise_plane(rel, p["size"], 1 + (i if p["color_grain"] else 0))
        df = df.hint("merge").join(plane.df.select(*KEY, F.col("v").alias(f"_n{c}")), KEY)
    y = luma()
    held = t.clamp(y)
    s, m, h = t.tonal(t.seen(y))
    by_tone = s * num(p["shadows_gain"] / 100) + m * num(p["midtones_gain"] / 100) + h * num(p["highlights_gain"] / 100)
    k = num(p["intensity"] / 100 * 0.1) * (num(0.35) + num(0.65) * num(4) * held * (num(1) - held)) * by_tone
    return Rel(df, IMAGE, rel.width, rel.height).image(*[F.col(c) + k * num(p[f"{n}_gain"] / 100) * F.col(f"_n{c}") for c, n in zip(COLOURS, ("red", "green", "blue"), strict=True)])


@node("tone_eq", masked=True, params={f"ev_{k}": SIGNED(m=2) for k in ("m4", "m3", "m2", "m1", "0", "p1", "p2", "p3", "p4")}, smoothing=number(50), range_shift=SIGNED(m=4))
def tone_eq(inputs, p):
    """Gains in stops for nine zones of a smoothed illuminance about middle grey, straight between zones."""
    rel = inputs["in"]
    zones = [p[f"ev_{k}"] for k in ("m4", "m3", "m2", "m1", "0", "p1", "p2", "p3", "p4")]
    if not any(zones):
        return rel
    radius = max(0, round(p["smoothing"] / 100 * min(rel.width, rel.height) / 20))
    df = rel.df.withColumn("_l", t.encode(F.greatest(luma(), num(0))))
    df = self_guided(df, "_l", "_g", radius, EPS, rel.width, rel.height)
    ev = t.clamp(F.log2(F.greatest(t.decode(F.greatest("_g", num(0))), num(1e-9)) / num(0.18)), -8, 6) - num(p["range_shift"])
    df = df.withColumn("_ev", t.clamp(ev, -4, 4) + num(4))
    gain = num(zones[-1])
    for i in range(7, -1, -1):
        gain = F.when(F.col("_ev") <= i + 1, num(zones[i]) + num(zones[i + 1] - zones[i]) * (F.col("_ev") - num(i))).otherwise(gain)
    df = df.withColumn("_k", F.pow(num(2), gain))
    return Rel(df, IMAGE, rel.width, rel.height).image(*[F.col(c) * F.col("_k") for c in COLOURS])


#: Pixels around one that non-local means look at, and around those that patches compare; weights from which two agree, and the share of the neighbours that must, for the mean to hold in full.
SEARCH, PATCH, AGREE, FLAT = 3, 2, 0.36, 0.66


@node("nlm_denoise", masked=True, strength=number(0), mode=choice("knn", "nlm"))
def nlm_denoise(inputs, p):
    """Each pixel a mean of those around it, weighed by how near their colours (knn) or the colours of the patches around them (nlm) are to its own; where few agree the pixel stays. One pass a shift, with box sums of the shifted differences."""
    rel, s = inputs["in"], p["strength"] / 100
    if s <= 0:
        return rel
    h2, block = (0.008 + 0.10 * s * s) ** 2, PATCH if p["mode"] == "nlm" else 0
    reach, n = SEARCH + block, 2 * block + 1

    def run(planes, y0, x0):
        own = [planes[c] for c in "rgb"]
        tall, wide = own[0].shape
        rgb = [np.pad(v, reach, mode="edge") for v in own]
        sums, total, agree = [np.zeros_like(v) for v in own], np.zeros_like(own[0]), np.zeros_like(own[0])
        at = lambda v, dy, dx, grow: v[SEARCH + block - grow + dy : SEARCH + block + grow + dy + tall, SEARCH + block - grow + dx : SEARCH + block + grow + dx + wide]
        for dy in range(-SEARCH, SEARCH + 1):
            for dx in range(-SEARCH, SEARCH + 1):
                apart = sum((at(v, 0, 0, block) - at(v, dy, dx, block)) ** 2 for v in rgb) / 3
                rows = sum(apart[i : i + tall] for i in range(n))
                weight = np.exp(-sum(rows[:, i : i + wide] for i in range(n)) / (n * n * h2))
                agree += weight > AGREE
                total += weight
                for k, v in enumerate(rgb):
                    sums[k] += at(v, dy, dx, 0) * weight
        blend = np.minimum(agree / (2 * SEARCH + 1) ** 2 / FLAT, 1) ** 2
        return {c: v + (m / total - v) * blend for c, v, m in zip("rgb", own, sums, strict=True)} | {"a": planes["a"], "there": planes["there"]}

    return Rel(over_tiles(rel.df, rel.width, rel.height, reach, ["r", "g", "b", "a"], ["r", "g", "b", "a"], run), IMAGE, rel.width, rel.height)
