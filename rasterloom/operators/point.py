"""Nodes that look at one pixel at a time: tone and colour as column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, KEY, A, B, G, R, Rel
from rasterloom.functions import eq
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.node import EngineError, Param, choice, node, number

SIGNED = lambda d=0.0, m=100.0: number(d, -m, m)


def rgb(rel: Rel, function: Callable[[Column, Column, Column], tuple]) -> Rel:
    return rel.image(*function(R(), G(), B()))


@node("exposure", masked=True, exposure=SIGNED(m=5), contrast=SIGNED(), color_contrast=SIGNED(), highlights=SIGNED(), shadows=SIGNED(), whites=SIGNED(), blacks=SIGNED())
def exposure(inputs, p):
    """Gain in linear light, then contrast and four range controls on the display tone as one scale a pixel, then contrast by channel at constant luma."""
    rel = inputs["in"]
    if not any(p.values()):
        return rel
    gain = num(2.0 ** p["exposure"])
    rel = rel.image(R() * gain, G() * gain, B() * gain)
    hi, sh, wt, bl = (p[k] / 100 for k in ("highlights", "shadows", "whites", "blacks"))
    if p["contrast"] or hi or sh or wt or bl:
        y = t.luma(R(), G(), B())
        d = t.encode(y)
        if p["contrast"]:
            d = t.contrast(d, t.contrast_gamma(p["contrast"]))
        df = rel.df.withColumn("_y", y).withColumn("_d", d)
        d = F.col("_d")
        n = d + num(wt * 0.12) * t.ramp(d, 0.3, 1) + num(bl * (0.05 if bl > 0 else 0.12)) * (num(1) - t.ramp(d, 0, 0.5))
        df = df.withColumn("_n", n)
        n = F.col("_n")
        room = num(0.5) * F.greatest(num(0.5) - n, num(0)) if sh > 0 else num(0.8) * F.greatest(n, num(0))
        df = df.withColumn("_n", n + num(sh) * (num(1) - t.ramp(d, 0, 0.55)) * room)
        room = F.greatest(num(1) - n, num(0)) if hi > 0 else num(0.06) + num(0.45) * F.greatest(n - num(0.5), num(0))
        df = df.withColumn("_n", n + num(hi) * t.ramp(d, 0.35, 1) * room)
        scale = F.when(F.col("_y") > 1e-6, t.decode(F.greatest(n, num(0))) / F.col("_y")).otherwise(num(1))
        rel = Rel(df.withColumn("_s", scale).select(*KEY, *[(c * F.col("_s")).alias(k) for c, k in zip((R(), G(), B()), "rgb", strict=True)], "a"), rel.kind, rel.width, rel.height)
    if p["color_contrast"]:
        gamma = t.contrast_gamma(p["color_contrast"])
        df = rel.df.withColumns({f"_{k}": t.decode(t.contrast(t.encode(F.greatest(c, num(0))), gamma)) for c, k in zip((R(), G(), B()), "rgb", strict=True)})
        y0, y1 = t.luma(R(), G(), B()), t.luma(F.col("_r"), F.col("_g"), F.col("_b"))
        df = df.withColumn("_k", F.when((y0 > 1e-6) & (y1 > 1e-6), y0 / y1))
        rel = Rel(df.select(*KEY, *[F.when(F.col("_k").isNull(), F.col(k)).otherwise(F.col(f"_{k}") * F.col("_k")).alias(k) for k in "rgb"], "a"), rel.kind, rel.width, rel.height)
    return rel


@node("white_balance", masked=True, temperature=number(6500, 2000, 50000), tint=SIGNED(m=150))
def white_balance(inputs, p):
    r, g, b = t.balance_gains(p["temperature"], p["tint"])
    return inputs["in"].image(R() * num(r), G() * num(g), B() * num(b))


@node("color_checker", masked=True, exposure=SIGNED(m=5), amount=number(100), sample=number(40, 10, 90), chart=Param("colorchecker-classic"), quad=Param(""), patches=Param(""), fit=Param(""), params={f"m{i}{j}": number(float(i == j), -4, 4) for i in range(3) for j in range(3)})
def color_checker(inputs, p):
    """A 3x3 matrix with gain, blended by amount."""
    gain, k = 2.0 ** p["exposure"], max(0.0, min(1.0, p["amount"] / 100))
    m = [[p[f"m{i}{j}"] * gain for j in range(3)] for i in range(3)]
    if k == 0 or m == np.eye(3).tolist():
        return inputs["in"]
    new = t.matrix(m, (R(), G(), B()))
    return inputs["in"].image(*[c + (n - c) * num(k) for c, n in zip((R(), G(), B()), new, strict=True)])


#: What the detail pass reads: three effects, each weighed by tonal range and channel.
DETAIL = {k: SIGNED() for k in ("texture", "clarity", "dehaze")} | {f"{k}_{part}": number(100, 0, 200) for k in ("texture", "clarity", "dehaze") for part in ("shadows", "midtones", "highlights", "red", "green", "blue")} | {"range_ev": SIGNED(m=20)}


@node("standard_color", masked=True, temperature=number(6500, 2000, 50000), tint=SIGNED(m=150), exposure=SIGNED(m=5), contrast=SIGNED(), saturation=SIGNED(), vibrance=SIGNED(), params=DETAIL)
def standard_color(inputs, p):
    """White balance, gain, contrast on luma, then saturation and vibrance as distance from luma, and the detail pass, which older graphs ask for here."""
    from rasterloom.operators.detail import detail_pass

    gains = [g * 2.0 ** p["exposure"] for g in t.balance_gains(p["temperature"], p["tint"])]
    rel = inputs["in"].image(R() * num(gains[0]), G() * num(gains[1]), B() * num(gains[2]))
    if p["contrast"]:
        y = t.luma(R(), G(), B())
        scale = F.when(y > 1e-6, t.decode(t.contrast(t.encode(y), t.contrast_gamma(p["contrast"]))) / y).otherwise(num(1))
        rel = Rel(rel.df.withColumn("_s", scale).select(*KEY, *[(F.col(k) * F.col("_s")).alias(k) for k in "rgb"], "a"), rel.kind, rel.width, rel.height)
    y, high, low = t.luma(R(), G(), B()), F.greatest(R(), G(), B()), F.least(R(), G(), B())
    chroma = t.clamp((high - low) / F.greatest(F.abs(high), num(1e-6)))
    factor = num(1 + p["saturation"] / 100) * (num(1) + num(p["vibrance"] / 100) * (num(1) - chroma))
    return detail_pass(rel.image(*[y + (c - y) * factor for c in (R(), G(), B())]), p)


@node("levels", masked=True, black=number(0, 0, 0.99), white=number(1, 0.01, 1), gamma=number(1, 0.1, 10), black_soft=number(0), white_soft=number(0))
def levels(inputs, p):
    """Black and white points with knees and gamma, in display tone; what is above white keeps its excess."""
    low, high, gamma = p["black"], p["white"], max(0.1, p["gamma"])
    soft = [p[k] / 400 for k in ("black_soft", "white_soft")]
    if (low, high, gamma, *soft) == (0, 1, 1, 0, 0):
        return inputs["in"]

    def one(c):
        n = t.soft_low((t.encode(F.greatest(c, num(0))) - num(low)) / num(max(high - low, 1e-6)), soft[0])
        if soft[1] > 0:
            n = num(1) - t.soft_low(num(1) - n, soft[1]) + F.greatest(n - num(1), num(0))
        return F.when(n <= 0, n).otherwise(t.decode(F.pow(F.greatest(n, num(0)), num(1 / gamma))))

    return inputs["in"].image(*map(one, (R(), G(), B())))


@node("color_balance", masked=True, params={f"{k}_{part}": SIGNED(m=180 if part == "hue" else 100) for k in ("shadows", "midtones", "highlights") for part in ("hue", "sat", "lum")})
def color_balance(inputs, p):
    """Colour wheels for three tonal ranges, and a gain for each."""
    ranges = ("shadows", "midtones", "highlights")
    push = [t.wheel(p[f"{k}_hue"], p[f"{k}_sat"]) for k in ranges]
    w = t.tonal(t.seen(t.luma(R(), G(), B())))
    gain = num(1) + sum((num(0.4 * p[f"{k}_lum"] / 100) * w[i] for i, k in enumerate(ranges)), num(0))
    mixed = [sum((num(push[i][c]) * w[i] for i in range(3)), num(0)) for c in range(3)]
    return inputs["in"].image(*[(v + m) * gain for v, m in zip((R(), G(), B()), mixed, strict=True)])


@node("split_tone", masked=True, shadow_hue=SIGNED(m=180), shadow_sat=SIGNED(), highlight_hue=SIGNED(m=180), highlight_sat=SIGNED(), balance=SIGNED())
def split_tone(inputs, p):
    low, high = t.wheel(p["shadow_hue"], p["shadow_sat"]), t.wheel(p["highlight_hue"], p["highlight_sat"])
    mid = 0.5 - max(-1.0, min(1.0, p["balance"] / 100)) * 0.35
    w = t.ramp(t.seen(t.luma(R(), G(), B())), mid - 0.35, mid + 0.35)
    return inputs["in"].image(*[c + num(low[i]) * (num(1) - w) + num(high[i]) * w for i, c in enumerate((R(), G(), B()))])


@node("channel_gain", takes=("mask",), channel=choice("luma", "red", "green", "blue"), gain=number(100, 0, 400))
def channel_gain(inputs, p):
    """A gain on one channel or all; a picture as mask interpolates it."""
    k = p["gain"] / 100
    rel = inputs["in"]
    if k == 1:
        return rel
    which = {"red": "r", "green": "g", "blue": "b"}.get(p["channel"])
    mask = inputs.get("mask")
    gain = num(k)
    if mask is not None and mask.kind != FIELD:
        df = rel.joined(mask, "m_")
        rel = Rel(df, rel.kind, rel.width, rel.height)
        gain = num(1) + num(k - 1) * t.clamp(F.coalesce("m_r", num(0)))
    return rel.image(*[c * gain if which in (None, name) else c for c, name in zip((R(), G(), B()), "rgb", strict=True)])


@node("tone_mask", range=choice("midtones", "shadows", "highlights", "bell"))
def tone_mask(inputs, p):
    y = t.luma(R(), G(), B())
    s, m, h = t.tonal(t.seen(y))
    held = t.clamp(y)
    w = {"shadows": s, "midtones": m, "highlights": h, "bell": num(0.35) + num(0.65) * (num(4) * held * (num(1) - held))}[p["range"]]
    return inputs["in"].image(w, w, w, num(1))


@node("vignette", masked=True, vignette=SIGNED(), vignette_mid=number(50), softness=number(0.5, 0, 1))
def vignette(inputs, p):
    rel, k = inputs["in"], p["vignette"] / 100
    if k == 0:
        return rel
    mid, soft = max(0.05, min(1.0, p["vignette_mid"] / 100)), max(0.05, min(1.0, p["softness"]))
    cx, cy = rel.width / 2, rel.height / 2
    dx, dy = F.col("x") - num(cx), F.col("y") - num(cy)
    d = F.sqrt(dx * dx + dy * dy) * num(1 / math.hypot(cx, cy))
    gain = F.greatest(num(1) + num(k) * t.ramp(d, max(0.0, mid * (1 - soft)), mid * (1 + soft)), num(0))
    return rel.image(R() * gain, G() * gain, B() * gain)


@node("soft_clip", masked=True, ceiling=number(1, 0, 16), knee=number(0.2, 0, 1), toe=number(0, 0, 0.1), by=choice("max", "channel"))
def soft_clip(inputs, p):
    """A toe at zero, then a knee toward the ceiling."""
    share, width = min(1.0, p["knee"]), p["toe"]
    start, span = p["ceiling"] * (1 - share), p["ceiling"] * share

    def toe(c):
        return c if width <= 0 else F.when(c < width, F.greatest(num(width) - num(width) * t.tanh((num(width) - c) / num(width)), num(0))).otherwise(c)

    def knee(c):
        bent = num(start) if span <= 0 else F.least(num(start) + num(span) * t.tanh((c - num(start)) / num(span)), num(start + span))
        return F.when(c > start, bent).otherwise(c)

    rel = rgb(inputs["in"], lambda *c: tuple(map(toe, c)))
    if p["by"] == "channel":
        return rgb(rel, lambda *c: tuple(map(knee, c)))
    m = F.greatest(R(), G(), B())
    scale = knee(m) / F.when(m > start, m).otherwise(num(1))
    return rel.image(*[F.when(m > start, F.when(c == m, knee(m)).otherwise(F.least(c * scale, knee(m)))).otherwise(c) for c in (R(), G(), B())])


KEY_COLOUR = {"key_r": number(0, 0, 1), "key_g": number(0.694, 0, 1), "key_b": number(0.251, 0, 1)}


def key_ab(p) -> tuple[float, float]:
    """OkLab chroma of the key colour, given in display values."""
    lin = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (p["key_r"], p["key_g"], p["key_b"])]
    lab = np.array(t.OKLAB_LAB) @ np.cbrt(np.array(t.OKLAB_LMS) @ lin)
    return float(lab[1]), float(lab[2])


@node("chroma_key", gives=FIELD, params=KEY_COLOUR, tolerance=number(0.05, 0, 0.5), softness=number(0.1, 0, 0.5))
def chroma_key(inputs, p):
    a, b = key_ab(p)
    size = math.hypot(a, b)
    lab = t.to_oklab(R(), G(), B())
    if size <= 1e-6:
        d = F.hypot(lab[1] - num(a), lab[2] - num(b))
    else:
        u, v = a / size, b / size
        along = lab[1] * num(u) + lab[2] * num(v)
        d = F.hypot(F.greatest(num(size) - along, num(0)), F.hypot(lab[1] - along * num(u), lab[2] - along * num(v)))
    hard = F.when(d > p["tolerance"], num(1)).otherwise(num(0))
    return inputs["in"].field(hard if p["softness"] <= 1e-6 else t.clamp((d - num(p["tolerance"])) / num(p["softness"])))


@node("chroma_key_despill", masked=True, params=KEY_COLOUR, spill=number(1, 0, 1))
def chroma_key_despill(inputs, p):
    a, b = key_ab(p)
    c = math.hypot(a, b)
    if p["spill"] <= 0 or c <= 1e-6:
        return inputs["in"]
    u, v = a / c, b / c
    lab = t.to_oklab(R(), G(), B())
    along = lab[1] * num(u) + lab[2] * num(v)
    cut = num(min(1.0, p["spill"])) * along
    new = t.from_oklab((lab[0], lab[1] - cut * num(u), lab[2] - cut * num(v)))
    return inputs["in"].image(*[F.when(along > 0, n).otherwise(o) for n, o in zip(new, (R(), G(), B()), strict=True)])


# Chromaticities of the named colour spaces and published matrices.
D65, ACES_WHITE = (0.3127, 0.3290), (0.32168, 0.33767)
GAMUTS = {
    "709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), D65),
    "2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), D65),
    "p3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), D65),
    "ap1": ((0.713, 0.293), (0.165, 0.830), (0.128, 0.044), ACES_WHITE),
    "ap0": ((0.7347, 0.2653), (0.0, 1.0), (0.0001, -0.0770), ACES_WHITE),
}
SPACES = {"linear_rec709": ("709", "linear"), "srgb": ("709", "srgb"), "linear_rec2020": ("2020", "linear"), "acescg": ("ap1", "linear"), "acescct": ("ap1", "cct"), "aces2065_1": ("ap0", "linear"), "linear_p3": ("p3", "linear"), "display_p3": ("p3", "srgb")}
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
CCT = {"x": 0.0078125, "y": 0.155251141552511, "a": 10.5402377416545, "b": 0.0729055341958355}


def white_point(xy) -> np.ndarray:
    return np.array([xy[0] / xy[1], 1.0, (1 - xy[0] - xy[1]) / xy[1]])


def space_matrix(source: str, target: str) -> list[list[float]]:
    """Linear light of one gamut to another's, with Bradford adaptation of the white."""

    def to_xyz(name):
        *primaries, white = GAMUTS[name]
        cols = np.array([[x, y, 1 - x - y] for x, y in primaries]).T
        return cols * np.linalg.solve(cols, white_point(white))

    a, b = GAMUTS[source][3], GAMUTS[target][3]
    adapt = np.eye(3) if a == b else np.linalg.inv(BRADFORD) @ np.diag((BRADFORD @ white_point(b)) / (BRADFORD @ white_point(a))) @ BRADFORD
    return (np.linalg.inv(to_xyz(target)) @ adapt @ to_xyz(source)).tolist()


@node("color_transform", masked=True, **{"from": choice("linear_rec709", *[s for s in SPACES if s != "linear_rec709"]), "to": choice("acescg", *[s for s in SPACES if s != "acescg"])})
def color_transform(inputs, p):
    if p["from"] == p["to"]:
        return inputs["in"]
    (g0, t0), (g1, t1) = SPACES[p["from"]], SPACES[p["to"]]
    read = {
        "linear": lambda c: c,
        "srgb": t.decode,
        "cct": lambda c: F.when(c <= CCT["y"], (c - num(CCT["b"])) / num(CCT["a"])).otherwise(F.least(F.pow(num(2), c * num(17.52) - num(9.72)), num(65504))),
    }[t0]
    write = {
        "linear": lambda c: c,
        "srgb": t.encode,
        "cct": lambda c: F.when(c <= CCT["x"], num(CCT["a"]) * c + num(CCT["b"])).otherwise((F.log2(c) + num(9.72)) / num(17.52)),
    }[t1]
    rel = rgb(inputs["in"], lambda *c: tuple(read(F.nanvl(v, num(0))) for v in c))
    rel = rgb(rel, lambda *c: t.matrix(space_matrix(g0, g1), c))
    return rgb(rel, lambda *c: tuple(map(write, c)))


@node("color_bend", masked=True, src_hue=number(0, 0, 360), src_sat=number(0, 0, 1), dst_hue=number(0, 0, 360), dst_sat=number(0, 0, 1), falloff=number(1 / 3, 0.15, 2), amount=number(100))
def color_bend(inputs, p):
    """Colours near a source in the disc of hue and saturation move toward a target; luma stays."""
    k = min(1.0, p["amount"] / 100)
    (sx, sy), (dx, dy) = [(p[f"{e}_sat"] * math.cos(math.radians(p[f"{e}_hue"])), p[f"{e}_sat"] * math.sin(math.radians(p[f"{e}_hue"]))) for e in ("src", "dst")]
    if k == 0 or max(abs(dx - sx), abs(dy - sy)) < 1e-6:
        return inputs["in"]
    rel = inputs["in"]
    h, s = t.hue_sat(R(), G(), B())
    df = rel.df.withColumn("_y", t.luma(R(), G(), B())).withColumn("_h", F.radians(h)).withColumn("_sat", s)
    df = df.withColumn("_px", F.col("_sat") * F.cos("_h")).withColumn("_py", F.col("_sat") * F.sin("_h"))
    px, py = F.col("_px"), F.col("_py")
    away = F.sqrt((px - num(sx)) * (px - num(sx)) + (py - num(sy)) * (py - num(sy)))
    df = df.withColumn("_w", num(1) - t.ramp(away, 0, max(p["falloff"], 1e-4)))
    w = F.col("_w") * num(k)
    df = df.withColumn("_nx", px + w * num(dx - sx)).withColumn("_ny", py + w * num(dy - sy))
    nx, ny = F.col("_nx"), F.col("_ny")
    df = df.withColumn("_ns", t.clamp(F.sqrt(nx * nx + ny * ny))).withColumn("_nh", F.degrees(F.atan2(ny, nx)))
    base = t.hexcone(F.when(F.col("_nh") < 0, F.col("_nh") + num(360)).otherwise(F.col("_nh")))
    df = df.withColumns({f"_m{c}": num(1) + F.col("_ns") * (v - num(1)) for c, v in zip("rgb", base, strict=True)})
    scale = F.col("_y") / F.greatest(t.luma(F.col("_mr"), F.col("_mg"), F.col("_mb")), num(1e-6))
    still = (F.col("_y") <= 0) | (F.col("_w") <= 0)
    return Rel(df.select(*KEY, *[F.when(still, F.col(c)).otherwise(F.col(f"_m{c}") * scale).alias(c) for c in "rgb"], "a"), rel.kind, rel.width, rel.height)


def shoulder(d: Column, k: float) -> Column:
    """Values above a knee that falls with k approach 1."""
    if k <= 0:
        return F.least(d, num(1))
    start = 1 - 0.6 * k
    return F.when(d <= start, d).otherwise(num(start) + num(1 - start) * (num(1) - F.exp((num(start) - d) / num(1 - start))))


# Fixed values of film stocks: slope of the straight line, its change by development, where the toe ends and how softly, speed by development, density range.
STOCKS = {
    "hp5": (0.62, 0.18, -1.45, 0.25, 0.10, 2.6),
    "fp4": (0.65, 0.18, -1.35, 0.18, 0.08, 2.2),
    "trix": (0.651, 0.20, -1.40, 0.30, 0.12, 2.8),
    "tmax400": (0.66, 0.16, -1.30, 0.12, 0.08, 3.0),
    "ortho": (0.80, 0.20, -1.20, 0.15, 0.06, 2.4),
    "rolleiir": (0.65, 0.18, -1.35, 0.2, 0.1, 2.5),
    "hie": (0.72, 0.2, -1.25, 0.18, 0.1, 2.0),
}
WHITE_EXPOSURE, PAPER_GAMMA, SHOULDER, GREY = 0.7447275, 1.65, 0.35, 0.18


def negative(stock: str, development: float, scale: float):
    """Density over the log of exposure: a line from a soft toe to a soft end."""
    gamma, by_n, foot, soft, speed, most = STOCKS[stock]
    slope, start = gamma * max(1 + by_n * development, 0.1) * max(scale, 0.05), foot - speed * development

    def density(x: Column) -> Column:
        u = (x - num(start)) / num(soft)
        line = num(slope * soft) * F.when(u > 20, u).otherwise(F.log(num(1) + F.exp(F.least(u, num(20)))))
        return num(-SHOULDER) * F.log(F.exp(line / num(-SHOULDER)) + num(math.exp(-most / SHOULDER)))

    return density


def printed(stock: str, development: float, scale: float):
    """Scene light through a film and onto normal paper, so that scene white is the paper's."""
    density = negative(stock, development, scale)
    white = density(num(WHITE_EXPOSURE))

    def light(v: Column) -> Column:
        return t.clamp(F.pow(num(10), num(PAPER_GAMMA) * (density(F.log10(F.greatest(v, num(1e-6)) / num(GREY))) - white)))

    return light


def own_tone(text: str):
    """A curve from stops around middle grey to display values, out of its JSON; None if there is none."""
    if not text.strip():
        return None
    try:
        found = json.loads(text)
        points = [(float(x), min(1.0, max(0.0, float(y)))) for x, y in found["points"]]
        how = found.get("interp", "smooth")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise EngineError(f"tone_profile: curve: {e}") from e
    order = sorted(range(len(points)), key=lambda i: points[i][0])
    points = [points[i] for i in order]
    if how not in ("smooth", "linear", "tangent") or not 2 <= len(points) <= 1024 or any(not math.isfinite(v) for p in points for v in p) or max(abs(x) for x, _ in points) > 24 or any(b[0] - a[0] < 1e-4 for a, b in zip(points, points[1:], strict=False)):
        raise EngineError("tone_profile: curve: two points or more at stops of their own, up to 24 from grey, joined smooth, linear or tangent")
    handles = found.get("handles") if how == "tangent" else None
    given = [handles[i] or {} for i in order] if isinstance(handles, list) and len(handles) == len(points) else []
    tangents = found.get("tangents") if how == "tangent" and not any(h.get("l") or h.get("r") for h in given) else None
    low, high = points[0][0], points[-1][0]

    def display(v: Column) -> Column:
        x = t.clamp(F.log2(F.greatest(v, num(1e-12)) / num(GREY)), low, high)
        if how == "linear":
            y = eq.value(eq.bent([eq.Point(*p) for p in points], "linear"), x)
        elif any(h.get("l") or h.get("r") for h in given):
            y = eq.value(eq.read([{"x": px, "y": py, **h} for (px, py), h in zip(points, given, strict=True)]), x)
        elif isinstance(tangents, list) and len(tangents) == len(points) and all(isinstance(m, int | float) for m in tangents):
            y = curve(x, points, [float(tangents[i]) for i in order])
        else:
            y = curve(x, points)
        return t.clamp(y)

    return display


@node("tone_profile", masked=True, mode=choice("standard", "film", "linear", "custom"), contrast=number(100, 0, 200), highlight_rolloff=number(0), colorfulness=SIGNED(), baseline_ev=SIGNED(m=3), shadow_toe=number(0), film=Param(""), development=SIGNED(m=2), curve=Param(""))
def tone_profile(inputs, p):
    """The base rendering: an S curve in display tone with shoulder and toe, or a film's, or a curve of one's own; then colourfulness."""
    strength, gain = p["contrast"] / 100, num(2.0 ** p["baseline_ev"])
    roll, crush = min(1.0, p["highlight_rolloff"] / 100), min(1.0, p["shadow_toe"] / 100)
    colour = 1 + max(-1.0, min(1.0, p["colorfulness"] / 100))
    if p["film"] in STOCKS:
        light = printed(p["film"], max(-2.0, min(2.0, p["development"])), strength)
        rel = rgb(inputs["in"], lambda *c: tuple(light(F.greatest(v, num(0)) * gain) for v in c))
    elif p["mode"] == "custom":
        display = own_tone(p["curve"])
        if display is None and p["baseline_ev"] == 0 and colour == 1:
            return inputs["in"]
        rel = rgb(inputs["in"], lambda *c: tuple(F.greatest(v, num(0)) * gain for v in c))
        rel = rgb(rel, lambda *c: tuple(t.decode(t.clamp((d := t.encode(F.least(v, num(1)))) + ((display(v) if display else d) - d) * num(strength))) for v in c))
    else:
        amount, lift = {"linear": (0.0, 0.0), "film": (0.62 * strength, 0.012 * strength), "standard": (0.34 * strength, 0.0)}[p["mode"]]
        if (amount, roll, p["baseline_ev"], crush, colour) == (0, 0, 0, 0, 1):
            return inputs["in"]
        rel = rgb(inputs["in"], lambda *c: tuple(shoulder(t.encode(F.greatest(v, num(0)) * gain), roll) for v in c))
        rel = rgb(rel, lambda *c: tuple(t.clamp(d + (d * d * (num(3) - num(2) * d) - d) * num(amount) + num(lift) * (num(1) - d)) for d in c))
        rel = rgb(rel, lambda *c: tuple(t.decode(d - num(crush) * d * (num(1) - d) * (num(1) - d) * (num(1) - d)) for d in c))
    y = t.luma(R(), G(), B())
    return rel if colour == 1 else rgb(rel, lambda *c: tuple(F.greatest(y + (v - y) * num(colour), num(0)) for v in c))


@node("channel_extract", channel=choice("luma", "r", "g", "b"))
def channel_extract(inputs, p):
    v = {"r": R(), "g": G(), "b": B()}.get(p["channel"])
    v = t.luma(R(), G(), B()) if v is None else v
    return inputs["in"].image(v, v, v)


@node("color_grade", masked=True, hue_shift=SIGNED(m=180), saturation=SIGNED(), vibrance=SIGNED(), exposure=SIGNED(m=3), uniformity=number(0), band_center=number(30, 0, 360))
def color_grade(inputs, p):
    """Hue, chroma and evenness of hues in OkLCh, brought into gamut, with a gain."""
    if not any(v for k, v in p.items() if k != "band_center"):
        return inputs["in"]
    rel = inputs["in"]
    lab = t.to_oklab(R(), G(), B())
    df = rel.df.withColumns({"_l": lab[0], "_a": lab[1], "_b2": lab[2]})
    a, b = F.col("_a"), F.col("_b2")
    df = df.withColumn("_c0", F.sqrt(a * a + b * b)).withColumn("_h", F.atan2(b, a) + num(math.radians(p["hue_shift"])))
    c = F.col("_c0") * num(max(0.0, 1 + p["saturation"] / 100))
    if p["vibrance"]:
        c = F.greatest(c * (num(1) + num(p["vibrance"] / 100) * (num(1) - F.least(F.col("_c0") / num(0.3), num(1)))), num(0))
    h = F.col("_h")
    u = min(1.0, p["uniformity"] / 100)
    if u > 0:
        d = F.degrees(h) - num(p["band_center"])
        d = d - num(360) * F.signum(d) * F.floor(F.abs(d) / num(360))
        d = F.when(d > 180, d - num(360)).when(d < -180, d + num(360)).otherwise(d)
        h = num(math.radians(p["band_center"])) + F.radians(d) * num(1 - u)
    df = df.withColumn("_c", c).withColumn("_h", h)
    out = t.from_oklab((F.col("_l"), F.col("_c") * F.cos("_h"), F.col("_c") * F.sin("_h")))
    df = df.select(*KEY, *[o.alias(k) for o, k in zip(out, "rgb", strict=True)], "a")
    gain = num(2.0 ** p["exposure"])
    return Rel(df, rel.kind, rel.width, rel.height).image(*[c * gain for c in t.inside_gamut((R(), G(), B()))])


# The published matrices of CAT16 and of linear sRGB to XYZ.
RGB_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
XYZ_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
CAT16 = ((0.401288, 0.650173, -0.051461), (-0.250268, 1.204414, 0.045854), (-0.002079, 0.048952, 0.953127))
CAT16_BACK = ((1.86206786, -1.01125463, 0.14918677), (0.38752654, 0.62144744, -0.00897398), (-0.01584150, -0.03412294, 1.04996444))
ILLUMINANTS = {"d65": (0.31270, 0.32900), "d50": (0.34567, 0.35850), "a": (0.44757, 0.40745), "f2": (0.37208, 0.37529)}


def planckian(kelvin: float) -> tuple[float, float]:
    """Chromaticity of a colour temperature by the published cubic fits."""
    k = max(1667.0, min(25000.0, kelvin))
    u = (1e9 / k**3, 1e6 / k**2, 1e3 / k, 1.0)
    if k < 4000:
        x = np.dot((-0.2661239, -0.2343589, 0.8776956, 0.179910), u)
        c = (-1.1063814, -1.34811020, 2.18555832, -0.20219683) if k < 2222 else (-0.9549476, -1.37418593, 2.09137015, -0.16748867)
        return float(x), float(np.dot(c, (x**3, x**2, x, 1)))
    c = (-4.6070, 2.9678, 0.09911, 0.244063) if k < 7000 else (-2.0064, 1.9018, 0.24748, 0.237040)
    x = float(np.dot(c, u))
    return x, -3 * x * x + 2.87 * x - 0.275


def adaptation(illuminant: str, kelvin: float, degree: float) -> list[list[float]]:
    whites = [np.array(CAT16) @ white_point(xy) for xy in (ILLUMINANTS.get(illuminant) or planckian(kelvin), ILLUMINANTS["d65"])]
    gains = degree * whites[1] / np.maximum(whites[0], 1e-6) + 1 - degree
    return (np.array(XYZ_RGB) @ np.array(CAT16_BACK) @ np.diag(gains) @ np.array(CAT16) @ np.array(RGB_XYZ)).tolist()


@node("chromatic_adapt", masked=True, illuminant=choice("custom", "d65", "d50", "a", "f2"), temperature=number(6500, 1667, 25000), strength=number(100))
def chromatic_adapt(inputs, p):
    if p["illuminant"] == "d65" or p["strength"] == 0:
        return inputs["in"]
    return inputs["in"].image(*t.matrix(adaptation(p["illuminant"], p["temperature"], min(1.0, p["strength"] / 100)), (R(), G(), B())))


@node("channel_mixer", masked=True, preserve_gray=number(1, 0, 1), params={f"mix_{i}{j}": number(100.0 * (i == j), -200, 200) for i in "rgb" for j in "rgb"})
def channel_mixer(inputs, p):
    m = [[max(-2.0, min(2.0, p[f"mix_{i}{j}"] / 100)) for j in "rgb"] for i in "rgb"]
    if p["preserve_gray"] >= 0.5:
        m = [[v / sum(row) for v in row] if abs(sum(row)) > 1e-4 else row for row in m]
    return inputs["in"] if m == np.eye(3).tolist() else inputs["in"].image(*t.matrix(m, (R(), G(), B())))


# The published constants of the view curves.
HABLE = {"a": 0.15, "b": 0.50, "c": 0.10, "d": 0.20, "e": 0.02, "f": 0.30}
AGX_IN = ((0.842479062253094, 0.0784335999999992, 0.0792237451477643), (0.0423282422610123, 0.878468636469772, 0.0791661274605434), (0.0423756549057051, 0.0784336, 0.879142973793104))
AGX_OUT = ((1.19687900512017, -0.0980208811401368, -0.0990297440797205), (-0.0528968517574562, 1.15190312990417, -0.0989611768448433), (-0.0529716355144438, -0.0980434501171241, 1.15107367264116))
AGX_POLY = (15.5, -40.14, 31.96, -6.868, 0.4298, 0.1191, -0.00232)
AGX_EV = (-12.47393, 4.026069)


def hable(x):
    k = HABLE
    return (x * (x * k["a"] + k["c"] * k["b"]) + k["d"] * k["e"]) / (x * (x * k["a"] + k["b"]) + k["d"] * k["f"]) - k["e"] / k["f"]


@node("view_transform", masked=True, mode=choice("sigmoid", "filmic", "agx", "aces"), exposure_ev=SIGNED(m=4), contrast=number(100, 25, 300), white_ev=number(6, 1, 10))
def view_transform(inputs, p):
    gain = num(2.0 ** max(-4.0, min(4.0, p["exposure_ev"])))
    rel = rgb(inputs["in"], lambda *c: tuple(v * gain for v in c))
    mode = p["mode"]
    if mode == "filmic":
        white = max(hable(0.18 * 2.0 ** max(1.0, min(10.0, p["white_ev"]))), 1e-6)
        return rgb(rel, lambda *c: tuple(t.clamp(hable(F.greatest(v, num(0))) / num(white)) for v in c))
    if mode == "aces":
        return rgb(rel, lambda *c: tuple(t.clamp((v * (v * num(2.51) + num(0.03))) / (v * (v * num(2.43) + num(0.59)) + num(0.14))) for v in (F.greatest(x, num(0)) for x in c)))
    if mode == "agx":
        low, high = AGX_EV
        rel = rgb(rel, lambda *c: t.matrix(AGX_IN, tuple(F.greatest(v, num(1e-10)) for v in c)))
        rel = rgb(rel, lambda *c: tuple((t.clamp(F.log2(v), low, high) - num(low)) / num(high - low) for v in c))

        def poly(v):
            out = num(AGX_POLY[0])
            for k in AGX_POLY[1:]:
                out = out * v + num(k)
            return t.clamp(out)

        rel = rgb(rel, lambda *c: tuple(map(poly, c)))
        return rgb(rel, lambda *c: tuple(F.least(F.pow(F.greatest(v, num(0)), num(2.2)), num(1)) for v in t.matrix(AGX_OUT, c)))
    slope = 1.7 * max(25.0, min(300.0, p["contrast"])) / 100
    return rgb(rel, lambda *c: tuple(t.decode(w / (w + num(0.18**slope))) for w in (F.pow(F.greatest(v, num(0)), num(slope)) for v in c)))


@node("gamut_map", masked=True, amount=number(100))
def gamut_map(inputs, p):
    k = min(1.0, p["amount"] / 100)
    return inputs["in"] if k <= 0 else inputs["in"].image(*[c + (n - c) * num(k) for c, n in zip((R(), G(), B()), t.inside_gamut((R(), G(), B())), strict=True)])


@node("lift")
def lift(inputs, p):
    return inputs["in"].image(R(), G(), B(), num(1))


@node("fill", color=Param("#808080"))
def fill(inputs, p):
    return inputs["in"].image(*map(num, t.hex_display(p["color"])), num(1))


GRADIENT = {"color_a": Param("#000000"), "color_b": Param("#ffffff"), "angle": SIGNED(m=180), "shape": choice("linear", "radial", "tone"), "midpoint": number(50, 5, 95), "stops": Param("")}


def gradient_stops(p) -> list[tuple[float, tuple[float, ...], float]]:
    """(place 0 to 1, red, green, blue and alpha, middle to the next stop)."""
    if p["stops"].strip():
        found = sorted(json.loads(p["stops"]), key=lambda s: s["pos"])
        if len(found) > 1:
            return [(s["pos"] / 100, (*t.hex_display(s["color"]), min(1.0, max(0.0, s.get("alpha", 100) / 100))), s.get("mid", 50) / 100) for s in found]
    return [(k, (*t.hex_display(p[f"color_{e}"]), min(1.0, p.get(f"alpha_{e}", 100.0) / 100)), m) for k, e, m in ((0.0, "a", p["midpoint"] / 100), (1.0, "b", 0.5))]


def gradient_at(rel: Rel, p) -> Column:
    """Place along a gradient, 0 to 1: by tone, from the centre out, or along an angle that spans the frame."""
    if p["shape"] == "tone":
        return t.clamp(t.luma(R(), G(), B()))
    fx, fy = (F.col("x") + num(0.5)) / num(rel.width) - num(0.5), (F.col("y") + num(0.5)) / num(rel.height) - num(0.5)
    if p["shape"] == "radial":
        return t.clamp(F.sqrt(fx * fx + fy * fy) / num(0.5))
    aspect = rel.width / rel.height
    c, s = math.cos(math.radians(p["angle"])), math.sin(math.radians(p["angle"]))
    return t.clamp((fx * num(aspect * c) + fy * num(s)) / num(max(abs(c) * aspect + abs(s), 1e-6)) + num(0.5))


def gradient_values(at: Column, stops) -> list[Column]:
    """Red, green, blue and alpha at a place: straight between stops, with the middle of each pair moved."""
    out = [num(v) for v in stops[-1][1]]
    for (x0, v0, mid), (x1, v1, _) in zip(reversed(stops[:-1]), reversed(stops[1:]), strict=True):
        m = max(0.05, min(0.95, mid))
        u = t.clamp((at - num(x0)) / num(max(x1 - x0, 1e-8)))
        k = F.when(u <= m, num(0.5) * u / num(m)).otherwise(num(0.5) + num(0.5) * (u - num(m)) / num(1 - m))
        out = [F.when(at <= x1, num(a) + num(b - a) * k).otherwise(o) for a, b, o in zip(v0, v1, out, strict=True)]
    return [F.when(at <= stops[0][0], num(v)).otherwise(o) for v, o in zip(stops[0][1], out, strict=True)]


@node("gradient", params=GRADIENT, alpha_a=number(100), alpha_b=number(100))
def gradient(inputs, p):
    """A gradient over the frame, by place or by tone, with its own alpha."""
    rel = inputs["in"]
    placed = Rel(rel.df.withColumn("_t", gradient_at(rel, p)), rel.kind, rel.width, rel.height)
    return placed.image(*gradient_values(F.col("_t"), gradient_stops(p)))


@node("gradient_map", masked=True, color_lo=Param("#000000"), color_mid=Param("#808080"), color_hi=Param("#ffffff"), midpoint=number(50, 1, 99), amount=number(100))
def gradient_map(inputs, p):
    """Luma through three colours."""
    y = t.clamp(t.luma(R(), G(), B()))
    m, k = max(0.01, min(0.99, p["midpoint"] / 100)), min(1.0, p["amount"] / 100)
    lo, mid, hi = (t.hex_display(p[c]) for c in ("color_lo", "color_mid", "color_hi"))
    low, high = y / num(m), (y - num(m)) / num(1 - m)
    new = [F.when(y <= m, num(a) + num(b - a) * low).otherwise(num(b) + num(c - b) * high) for a, b, c in zip(lo, mid, hi, strict=True)]
    return inputs["in"].image(*[o + (n - o) * num(k) for o, n in zip((R(), G(), B()), new, strict=True)])


@node("fx_color_overlay", opacity=number(100), color=Param("#808080"))
def fx_color_overlay(inputs, p):
    k = min(1.0, p["opacity"] / 100)
    return inputs["in"].image(*[c + (num(v) - c) * num(k) for c, v in zip((R(), G(), B()), t.hex_display(p["color"]), strict=True)])


@node("fx_gradient_overlay", params=GRADIENT, opacity=number(100))
def fx_gradient_overlay(inputs, p):
    rel, k = inputs["in"], min(1.0, p["opacity"] / 100)
    placed = Rel(rel.df.withColumn("_t", gradient_at(rel, p)), rel.kind, rel.width, rel.height)
    *new, alpha = gradient_values(F.col("_t"), gradient_stops(p))
    return placed.image(*[c + (n - c) * num(k) * alpha for c, n in zip((R(), G(), B()), new, strict=True)])


@node("to_display", gamma=number(0, 0, 4))
def to_display(inputs, p):
    g = p["gamma"]
    return rgb(inputs["in"], lambda *c: tuple(F.pow(t.clamp(v), num(1 / g)) if g > 0 else t.encode_display(v) for v in c))


@node("to_scene", takes=("reference",), gamma=number(0, 0, 4))
def to_scene(inputs, p):
    """Display to linear; a reference of the same size gives back what it holds above 1."""
    g, rel, ref = p["gamma"], inputs["in"], inputs.get("reference")
    out = rgb(rel, lambda *c: tuple(F.pow(t.clamp(v), num(g)) if g > 0 else t.decode_display(v) for v in c))
    if ref is None or not ref.same_size(rel):
        return out
    both = Rel(out.joined(ref, "o_"), rel.kind, rel.width, rel.height)
    return both.image(*[F.col(c) + F.greatest(F.coalesce(f"o_{c}", num(1)) - num(1), num(0)) for c in "rgb"])


@node("luma_chroma_split", part=choice("luma", "color", strict=True))
def luma_chroma_split(inputs, p):
    y = t.luma(R(), G(), B())
    return inputs["in"].image(y, y, y) if p["part"] == "luma" else inputs["in"].image(R() - y, G() - y, B() - y)


@node("luma_chroma_join", takes=("chroma",))
def luma_chroma_join(inputs, p):
    rel, chroma = inputs["in"], inputs.get("chroma")
    if chroma is None or not chroma.same_size(rel):
        return rel
    y = t.luma(R(), G(), B())
    return Rel(rel.joined(chroma, "c_"), rel.kind, rel.width, rel.height).image(*[y + F.coalesce(f"c_{c}", num(0)) for c in "rgb"])


@node("invert", masked=True, amount=number(1, 0, 1))
def invert(inputs, p):
    k = min(1.0, p["amount"])
    return rgb(inputs["in"], lambda *c: tuple(v + (num(1) - t.clamp(v) - v) * num(k) for v in c))


@node("desaturate", masked=True, amount=number(1, 0, 1))
def desaturate(inputs, p):
    y, k = t.luma(R(), G(), B()), min(1.0, p["amount"])
    return inputs["in"].image(*[c + (y - c) * num(k) for c in (R(), G(), B())])


@node("alpha_association", takes=("alpha",), mode=choice("replace", "extract", "premultiply", "unpremultiply", strict=True))
def alpha_association(inputs, p):
    rel, alpha, mode = inputs["in"], inputs.get("alpha"), p["mode"]
    sound = ~F.isnan(A()) & (A() != 1)
    if mode == "extract":
        return rel.image(A(), A(), A(), num(1))
    if mode == "premultiply":
        return rel.image(*[F.when(sound, c * F.greatest(A(), num(0))).otherwise(c) for c in (R(), G(), B())])
    if mode == "unpremultiply":
        return rel.image(*[F.when(sound & (A() > 1e-6), c / F.when(A() == 0, num(1)).otherwise(A())).otherwise(c) for c in (R(), G(), B())])
    if alpha is None:
        return rel
    if not alpha.same_size(rel):
        raise EngineError("alpha_association: alpha is of another size")
    return Rel(rel.joined(alpha, "p_"), rel.kind, rel.width, rel.height).image(R(), G(), B(), t.clamp(F.nanvl(F.coalesce("p_v", num(0)), num(0))))


def cubic_parts(points: list[tuple[float, float]], slopes: list[float] | None = None) -> list[tuple[float, ...]]:
    """Of each part of a monotone cubic through the points, or of one with these slopes: start, width and the coefficients, of the lowest power first."""
    xs, ys = (np.array(v) for v in zip(*points, strict=True))
    h = np.diff(xs)
    slope = np.diff(ys) / np.maximum(h, 1e-9)
    m = np.concatenate([[slope[0]], np.where(slope[1:] * slope[:-1] <= 0, 0.0, (slope[1:] + slope[:-1]) / 2), [slope[-1]]])
    for i, s in enumerate(slope):  # Fritsch and Carlson's bound
        if s == 0:
            m[i] = m[i + 1] = 0.0
        elif (r := math.hypot(m[i] / s, m[i + 1] / s)) > 3:
            m[i], m[i + 1] = 3 * m[i] / r, 3 * m[i + 1] / r
    m = np.array(slopes) if slopes else m
    return [(xs[i], h[i], ys[i], m[i] * h[i], 3 * (ys[i + 1] - ys[i]) - h[i] * (2 * m[i] + m[i + 1]), 2 * (ys[i] - ys[i + 1]) + h[i] * (m[i] + m[i + 1])) for i in range(len(h))]


def curve(d: Column, points: list[tuple[float, float]], slopes: list[float] | None = None) -> Column:
    """A monotone cubic through the points, or one with these slopes, with slope 1 outside them."""
    if len(points) == 1:
        return d + num(points[0][1] - points[0][0])
    out = num(points[-1][1]) + (d - num(points[-1][0]))
    for (x, w, a, b, c, e), (end, _) in zip(reversed(cubic_parts(points, slopes)), reversed(points[1:]), strict=True):
        u = (d - num(x)) / num(w)
        out = F.when(d <= end, num(a) + u * (num(b) + u * (num(c) + u * num(e)))).otherwise(out)
    return F.when(d < points[0][0], num(points[0][1]) + (d - num(points[0][0]))).otherwise(out)


def straight(d: Column, points: list[tuple[float, float]]) -> Column:
    """Straight lines through the points, with slope 1 outside them."""
    low, high = points[0], points[-1]
    inside = eq.value(eq.bent([eq.Point(*p) for p in points], "linear"), d)
    return F.when(d < low[0], num(low[1]) + (d - num(low[0]))).when(d > high[0], num(high[1]) + (d - num(high[0]))).otherwise(inside)


class Drawn:
    """A tone curve of the node: straight, smooth, or with slopes or handles of one's own."""

    def __init__(self, found: dict, name: str):
        points = [(float(x), float(y)) for x, y in found[name]]
        order, n = sorted(range(len(points)), key=lambda i: points[i][0]), len(points)
        self.points, self.how, self.slopes, self.handles = [points[i] for i in order], found.get("interp"), None, []
        own = lambda suffix: v if self.how == "tangent" and isinstance(v := found.get(f"{name}_{suffix}"), list) and len(v) == n > 1 else None
        if (handles := own("h")) and any(h and (h.get("l") or h.get("r")) for h in handles):
            self.handles = eq.read([{"x": points[i][0], "y": points[i][1], **(handles[i] or {})} for i in order])
        elif slopes := own("m"):
            self.slopes = [float(slopes[i]) for i in order]
        self.top = self.at_one()

    def at_one(self) -> float:
        """The curve's value at display white."""
        if self.handles:
            return eq.value_at(self.handles, 1.0)
        (x0, y0), (x1, y1) = self.points[0], self.points[-1]
        if x0 >= 1 or x1 <= 1:
            return y0 + 1 - x0 if x0 >= 1 else y1 + 1 - x1
        if self.how not in ("smooth", "tangent"):
            return eq.value_at(eq.bent([eq.Point(*p) for p in self.points], "linear"), 1.0)
        x, w, a, b, c, e = next(p for p in cubic_parts(self.points, self.slopes) if p[0] + p[1] >= 1)
        u = (1 - x) / w
        return a + u * (b + u * (c + u * e))

    def value(self, d: Column) -> Column:
        if self.handles:
            inside = eq.value(self.handles, d)
        elif len(self.points) == 1 or self.how in ("smooth", "tangent"):
            inside = curve(d, self.points, self.slopes)
        else:
            inside = straight(d, self.points)
        return F.when(d >= 1, num(self.top) + (d - num(1))).otherwise(inside)

    def whole(self, v: Column, d: Column) -> Column:
        """Whether light passes as it is: from white on, if the curve leaves white where it is."""
        return (v >= 1) | (d >= 1) if self.top == 1 else F.lit(False)

    def apply(self, v: Column) -> Column:
        d = t.encode(F.greatest(v, num(0)))
        return F.when(self.whole(v, d), v).otherwise(t.decode(F.greatest(self.value(d), num(0))))

    def hue_kept(self, rgb_: tuple[Column, ...]) -> tuple[Column, ...]:
        """The outer channels through the curve, the middle one as far between them as it was."""
        shown = [t.encode(F.greatest(v, num(0))) for v in rgb_]
        low, high = F.least(*shown), F.greatest(*shown)
        spread = high - low
        plain = (spread <= 1e-6) | (self.whole(rgb_[0], shown[0]) & self.whole(rgb_[1], shown[1]) & self.whole(rgb_[2], shown[2]))
        a, b = (F.greatest(self.value(x), num(0)) for x in (low, high))
        between = [t.decode(F.greatest(a + (b - a) * (d - low) / F.when(spread > 0, spread).otherwise(num(1)), num(0))) for d in shown]
        return tuple(F.when(plain | (d == low) | (d == high), self.apply(v)).otherwise(m) for v, d, m in zip(rgb_, shown, between, strict=True))


@node("curves", masked=True, points=Param("[]"), rgb_mode=Param(""))
def curves(inputs, p):
    """Tone curves in display values: all channels, then each, then luma as a scale. With rgb_mode hue the middle channel keeps its place between the others."""
    try:
        found = json.loads(p["points"] or "{}")
        found = {"rgb": found} if isinstance(found, list) else found
        drawn = {k: Drawn(found, k) for k in ("rgb", "r", "g", "b", "luma") if found.get(k)}
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise EngineError(f"curves: {e}") from e
    rel = inputs["in"]
    if "rgb" in drawn:
        rel = rgb(rel, lambda *c: drawn["rgb"].hue_kept(c) if p["rgb_mode"] == "hue" else tuple(map(drawn["rgb"].apply, c)))
    if {"r", "g", "b"} & set(drawn):
        rel = rgb(rel, lambda *c: tuple(drawn[k].apply(v) if k in drawn else v for v, k in zip(c, "rgb", strict=True)))
    if "luma" in drawn:
        y = t.luma(R(), G(), B())
        scale = F.when(y > 1e-6, drawn["luma"].apply(y) / y).otherwise(num(1))
        rel = Rel(rel.df.withColumn("_s", scale), rel.kind, rel.width, rel.height).image(*[c * F.col("_s") for c in (R(), G(), B())])
    return rel


# Tints of toners and paper bases.
TINTS = {"selenium": (0.93, 0.90, 1.08), "sepia": (1.22, 1.0, 0.72), "gold": (0.84, 0.94, 1.18), "warm": (1.0, 0.975, 0.92), "cold": (0.93, 0.965, 1.0)}


def paper_density(d: Column, grade: float, time: float, dmax: float) -> Column:
    """Density on paper of a grade: contrast about a pivot, exposure in stops, a soft shoulder into dmax."""
    lin = F.greatest(num(1.16 ** (max(0.0, min(5.0, grade)) - 2)) * (d - num(0.7447275) + num(1.65 * 0.301 * time)) + num(0.7447275), num(0))
    return num(-0.25) * F.log(F.exp(lin / num(-0.25)) + num(math.exp(-dmax / 0.25)))


@node("paper", masked=True, grade=number(2, 0, 5), time=SIGNED(m=2), split=Param(False), soft=SIGNED(m=2), hard=SIGNED(m=2), dmax=number(2.1, 1.4, 2.4), base=SIGNED(), toner=Param(""), toning=number(0), crossover=number(50))
def paper(inputs, p):
    """A print: luma to density by grade and time, back to light, tinted by toner and base."""
    rel, dmax, toning = inputs["in"], max(1.0, min(3.0, p["dmax"])), min(1.0, p["toning"] / 100)
    y = t.luma(*(F.greatest(c, num(0)) for c in (R(), G(), B())))
    df = rel.df.withColumn("_y", y).withColumn("_d", -F.log10(t.clamp(F.col("_y"), 1e-6, 1)))
    d = F.col("_d")
    if p["split"]:
        dens = num(0.5) * paper_density(d, 0, p["soft"], dmax) + num(0.5) * paper_density(d, 5, p["hard"], dmax)
    else:
        dens = paper_density(d, p["grade"], p["time"], dmax)
    df = df.withColumn("_d", dens)
    centre = 0.3 + 1.2 * min(100.0, p["crossover"]) / 100

    def in_shadow(v):
        return t.ramp(v, centre - 0.4, centre + 0.4)

    if p["toner"] == "selenium" and toning > 0:
        df = df.withColumn("_d", d + num(0.15 * toning) * in_shadow(d))
    df = df.withColumn("_d", t.clamp(d, 0, dmax))
    shadow, high = {"selenium": ("selenium", None), "gold": ("gold", None), "sepia": (None, "sepia"), "split": ("gold", "sepia")}.get(p["toner"], (None, None))

    def level(name):
        rgb_ = TINTS[name]
        return [v / sum(w * c for w, c in zip(t.LUMA, rgb_, strict=True)) for v in rgb_]

    tint = [num(1)] * 3
    if toning > 0:
        ws = in_shadow(d)
        for name, w in ((shadow, ws), (high, num(1) - ws)):
            if name:
                tint = [c + (num(v) - c) * num(toning) * w for c, v in zip(tint, level(name), strict=True)]
    if p["base"]:
        tint = [c + (num(v) - c) * num(min(1.0, abs(p["base"]) / 100)) for c, v in zip(tint, level("warm" if p["base"] > 0 else "cold"), strict=True)]
    df = df.withColumn("_v", F.pow(num(10), -d)).withColumns({f"_t{c}": v for c, v in zip("rgb", tint, strict=True)})
    dark = F.col("_y") <= 1e-6
    scale = F.col("_v") / F.when(dark, num(1)).otherwise(F.col("_y"))
    return Rel(df, rel.kind, rel.width, rel.height).image(*[F.when(dark, F.col("_v")).otherwise(F.greatest(F.col(c), num(0)) * scale) * F.col(f"_t{c}") for c in "rgb"])
