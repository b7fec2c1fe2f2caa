"""Nodes that look at a pixel's neighbours: window frames along rows and columns."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, Rel
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.node import choice, node, number
from rasterloom.operators.point import SIGNED
from rasterloom.operators.tiles import over_tiles


def along(axis: str):
    """The window of a row (axis x) or a column (axis y) in order."""
    return Window.partitionBy("frame_id", "y" if axis == "x" else "x").orderBy(axis)


def neighbours(axis: str, c: Column, offsets: list[int]) -> list[Column]:
    """Values at offsets along an axis, with those beyond the frame's edge taken from the edge."""
    w = along(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = []
    for k in offsets:
        if k == 0:
            out.append(c)
        elif k < 0:
            out.append(F.coalesce(F.lag(c, -k).over(w), F.first(c).over(whole)))
        else:
            out.append(F.coalesce(F.lead(c, k).over(w), F.last(c).over(whole)))
    return out


def swept(rel: Rel, axis: str, function: Callable[[Column], Column], channels: list[str] | None = None) -> Rel:
    """Each channel replaced by a function of its window along an axis."""
    chosen = channels or rel.channels
    df = rel.df.select(*KEY, *[function(F.col(c)).alias(c) if c in chosen else F.col(c) for c in rel.channels])
    return Rel(df, rel.kind, rel.width, rel.height)


def clamped_mean(axis: str, radius: int, size: int) -> Callable[[Column], Column]:
    """Mean over 2 * radius + 1 places, the edge's value standing for places beyond it. Only running sums of one window; the places beyond are counted, not read."""
    r = min(radius, size - 1)
    n = 2 * r + 1
    w = along(axis)
    frame = w.rowsBetween(-r, r)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.col(axis)

    def mean(c: Column) -> Column:
        before, after = F.greatest(F.lit(r) - at, F.lit(0)), F.greatest(at + F.lit(r - size + 1), F.lit(0))
        return (F.sum(c).over(frame) + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / num(n)

    return mean


def box_mean(rel: Rel, radius: int, channels: list[str] | None = None) -> Rel:
    """A box mean with clamped edges, rows and then columns."""
    if radius <= 0:
        return rel
    for axis, size in (("x", rel.width), ("y", rel.height)):
        if size > 1:
            rel = swept(rel, axis, clamped_mean(axis, radius, size), channels)
    return rel


def kernel(sigma: float, reach: float = 2.5) -> list[float]:
    """A normalised gaussian over so many sigmas to each side."""
    r = math.ceil(reach * sigma)
    k = [math.exp(-i * i / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(k) for v in k]


#: Beyond this sigma frames are reduced before they are blurred, to a sigma of about REDUCED_SIGMA.
WIDE_SIGMA, REDUCED_SIGMA = 12.0, 6.0
#: Up to so many places of a kernel are neighbours by name, more are summed up in tiles.
NAMED = 9


def convolved(rel: Rel, k: list[float], channels: list[str], held: list[str] | None = None) -> Rel:
    """Channels weighed by k along rows and along columns, the edge's value standing for places beyond it, in tiles with what lies around them: one shuffle for both directions and all channels."""
    r, weights, held = len(k) // 2, [float(v) for v in k], held or rel.channels

    def run(planes, y0, x0):
        out = {c: planes[c] for c in held} | {"there": planes["there"]}
        for c in channels:
            v = planes[c]
            for axis in (1, 0):
                wide, n = np.pad(v, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge"), v.shape[axis]
                v = sum(w * (wide[:, i : i + n] if axis else wide[i : i + n]) for i, w in enumerate(weights))
            out[c] = v
        return out

    return Rel(over_tiles(rel.df, rel.width, rel.height, r, held, held, run), rel.kind, rel.width, rel.height)


def reduced_gaussian(rel: Rel, sigma: float, factor: int, channels: list[str]) -> Rel:
    """A wide gaussian: means of squares, blurred, and drawn up again between their centres. Its cost hardly depends on the sigma."""
    from rasterloom.operators.geometry import area_mean, gathered

    chosen = Rel(rel.df.select(*KEY, *channels), rel.kind, rel.width, rel.height)
    small = area_mean(chosen, factor, channels)
    small = convolved(small, kernel(sigma / factor), channels, channels)
    places = rel.df.select(*KEY, *[((F.col(c) + num(0.5)) / num(factor) - num(0.5)).alias(f"_g{c}") for c in "xy"])
    wide = gathered(small, places, channels)
    if set(channels) == set(rel.channels):
        return Rel(wide.select(*KEY, *rel.channels), rel.kind, rel.width, rel.height)
    others = [c for c in rel.channels if c not in channels]
    return Rel(rel.df.select(*KEY, *others).hint("merge").join(wide, KEY).select(*KEY, *rel.channels), rel.kind, rel.width, rel.height)


def gaussian(rel: Rel, sigma: float, channels: list[str] | None = None, reach: float = 2.5) -> Rel:
    """A separable gaussian with clamped edges: weighted neighbours along rows and then columns; wide ones on a reduced frame."""
    if sigma <= 0:
        return rel
    channels = channels or rel.channels
    factor = math.floor(sigma / REDUCED_SIGMA)
    if sigma > WIDE_SIGMA and min(rel.width, rel.height) >= 4 * factor:
        return reduced_gaussian(rel, sigma, factor, channels)
    k = kernel(sigma, reach)
    r = len(k) // 2
    if len(k) > NAMED:
        return convolved(rel, k, channels)
    for axis in "xy":

        def weighted(c: Column, axis=axis) -> Column:
            return sum((num(v) * n for v, n in zip(k, neighbours(axis, c, list(range(-r, r + 1))), strict=True)), num(0))

        rel = swept(rel, axis, weighted, channels)
    return rel


COLOURS = ["r", "g", "b"]


def lerp(rel: Rel, other: Rel, k: float, channels: list[str]) -> Rel:
    df = rel.joined(other, "n_", "inner")
    return Rel(df.select(*KEY, *[(F.col(c) + (F.col(f"n_{c}") - F.col(c)) * num(k) if c in channels else F.col(c)).alias(c) for c in rel.channels]), rel.kind, rel.width, rel.height)


@node("denoise", masked=True, strength=number(0))
def denoise(inputs, p):
    k = p["strength"] / 100
    rel = inputs["in"]
    return rel if k <= 0 else lerp(rel, gaussian(rel, 0.6 + 2.4 * k, COLOURS), k, COLOURS)


def premultiplied(rel: Rel) -> Rel:
    return rel.image(*[F.col(c) * F.col("a") for c in COLOURS])


def unpremultiplied(rel: Rel) -> Rel:
    """Straight colour again, not below black; nothing where nothing covers."""
    a = F.col("a")
    return rel.image(*[F.when(a > 1e-6, F.greatest(F.col(c) / F.when(a > 1e-6, a).otherwise(num(1)), num(0))).otherwise(num(0)) for c in COLOURS], a)


def motion(rel: Rel, length: float, angle: float) -> Rel:
    """Mean of the pixels that a line through each pixel passes, the edge's standing for those beyond it."""
    half = max(1, math.floor(length + 0.5)) // 2
    dx, dy = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    steps = Counter((math.floor(dx * k + 1e-9), math.floor(dy * k + 1e-9)) for k in range(-half, half + 1))
    taps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), num(n / (2 * half + 1)).alias("w")) for (x, y), n in sorted(steps.items())]))
    held = lambda c, size: F.least(F.greatest(F.col(c) + F.col(f"_t.{c}"), F.lit(0)), F.lit(size - 1)).alias(f"_s{c}")
    wide = rel.df.select(*KEY, taps.alias("_t")).select(F.col("frame_id"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("_t.w").alias("_w"), held("x", rel.width), held("y", rel.height))
    source = rel.df.select("frame_id", F.col("y").alias("_sy"), F.col("x").alias("_sx"), *rel.channels)
    found = wide.hint("merge").join(source, ["frame_id", "_sy", "_sx"]).groupBy("frame_id", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in rel.channels])
    return Rel(found, rel.kind, rel.width, rel.height)


@node("blur", masked=True, radius=number(0, 0, 200), kind=choice("gaussian", "box", "motion"), angle=SIGNED(m=180))
def blur(inputs, p):
    """Gaussian, box or motion blur of premultiplied colour, so that what is transparent doesn't bleed."""
    rel, radius = inputs["in"], p["radius"]
    if radius <= 0:
        return rel
    pre = premultiplied(rel)
    if p["kind"] == "box":
        return unpremultiplied(box_mean(pre, math.floor(radius + 0.5)))
    return unpremultiplied(motion(pre, 2 * radius, p["angle"]) if p["kind"] == "motion" else gaussian(pre, radius))


def high_passed(rel: Rel, radius: float) -> Rel:
    if radius <= 0:
        return rel.image(num(0.5), num(0.5), num(0.5))
    df = rel.joined(gaussian(rel, radius, COLOURS), "n_", "inner")
    return Rel(df, IMAGE, rel.width, rel.height).image(*[t.clamp((F.col(c) - F.col(f"n_{c}")) * num(0.5) + num(0.5)) for c in COLOURS])


@node("high_pass", masked=True, radius=number(3, 0, 200))
def high_pass(inputs, p):
    return high_passed(inputs["in"], p["radius"])


def opaque_blend(base: Rel, top: Rel, mode: str, opacity: float) -> Rel:
    """A blend on base's colours by the top's alpha, whatever the base's own."""
    from rasterloom.operators.combine import blend_pixel

    df = base.joined(top, "t_", "inner").withColumn("_k", num(opacity) * t.clamp(F.col("t_a")))
    b, s, k = [F.col(c) for c in COLOURS], [F.col(f"t_{c}") for c in COLOURS], F.col("_k")
    return Rel(df, IMAGE, base.width, base.height).image(*[x + (m - x) * k for x, m in zip(b, blend_pixel(mode, b, s), strict=True)], k + t.clamp(F.col("a")) * (num(1) - k))


def back_to_scene(display: Rel, source: Rel) -> Rel:
    """Display values decoded; what the source holds above 1 stays, changed by as much as its place at white was."""
    df = display.joined(source, "o_", "inner")
    new, old = [t.decode_display(F.col(c)) for c in COLOURS], [F.col(f"o_{c}") for c in COLOURS]
    return Rel(df, IMAGE, source.width, source.height).image(*[F.when(o > 1, o + (n - num(1))).otherwise(n) for n, o in zip(new, old, strict=True)])


def inverted(rel: Rel) -> Rel:
    return rel.image(*[num(1) - t.clamp(F.col(c)) for c in COLOURS])


@node("sharpening", masked=True, radius=number(3, 0, 200), intensity=number(50), keep_color=number(100), mode=choice("vivid", "hipass"))
def sharpening(inputs, p):
    """A high pass or vivid light of the inverted blur, laid over in display values; keep_color takes its luminosity only."""
    rel, k = inputs["in"], min(1.0, p["intensity"] / 100)
    if k <= 0:
        return rel
    display = rel.image(*[t.encode_display(F.col(c)) for c in COLOURS])
    y = t.luma(*[F.col(c) for c in COLOURS])
    if p["mode"] == "hipass":
        top = high_passed(display.image(y, y, y), p["radius"])
    else:
        soft = inverted(display)
        top = opaque_blend(display, unpremultiplied(gaussian(premultiplied(soft), p["radius"])) if p["radius"] > 0 else soft, "vivid_light", 1.0)
    over = opaque_blend(display, top, "overlay", k)
    kept = opaque_blend(over, opaque_blend(display, over, "luminosity", 1.0), "normal", min(1.0, p["keep_color"] / 100))
    return back_to_scene(kept, rel)


@node("skin_soften", masked=True, softening=number(8, 0, 200), detail_back=number(4, 0, 200), strength=number(50))
def skin_soften(inputs, p):
    """The inverted high pass, blurred for detail, in vivid light over the picture, by strength."""
    rel, k = inputs["in"], min(1.0, p["strength"] / 100)
    if k <= 0:
        return rel
    display = rel.image(*[t.encode_display(F.col(c)) for c in COLOURS])
    passed = high_passed(inverted(display), p["softening"])
    top = unpremultiplied(gaussian(premultiplied(passed), p["detail_back"])) if p["detail_back"] > 0 else passed
    return back_to_scene(opaque_blend(display, opaque_blend(display, top, "vivid_light", 1.0), "normal", k), rel)


@node("hot_pixel", masked=True, sensitivity=number(50))
def hot_pixel(inputs, p):
    """Channels far from the median of their eight neighbours take it; the frame's border stays."""
    rel, s = inputs["in"], p["sensitivity"] / 100
    if s <= 0:
        return rel
    limit, w = 0.5 * 0.04**s, along("x")
    rows = rel.df
    for c in COLOURS:  # three pixels of each row, then three rows
        rows = rows.withColumn(f"_{c}", F.array(F.lag(c).over(w), F.col(c), F.lead(c).over(w)))
    v = along("y")
    inner = F.col("x").between(1, rel.width - 2) & F.col("y").between(1, rel.height - 2)
    out = []
    for c in COLOURS:
        own = F.array(F.element_at(f"_{c}", 1), F.element_at(f"_{c}", 3))
        eight = F.array_sort(F.concat(F.lag(f"_{c}").over(v), own, F.lead(f"_{c}").over(v)))
        rows = rows.withColumn(f"_m{c}", F.when(inner, (F.element_at(eight, 4) + F.element_at(eight, 5)) / num(2)))
        out.append(F.when(F.abs(F.col(c) - F.col(f"_m{c}")) > limit, F.col(f"_m{c}")).otherwise(F.col(c)))
    return Rel(rows, IMAGE, rel.width, rel.height).image(*out)


def disc(half: int) -> list[int]:
    """How far a disc reaches to each side in the row so many rows off its centre."""
    return [math.isqrt(half * half - dy * dy) for dy in range(half + 1)]


def extreme(rel: Rel, half: int, shape: str, largest: bool) -> Rel:
    """The least or largest value of a square or disc around each pixel, cut at the frame's edge."""
    pick = F.max if largest else F.min
    if half == 0:
        return rel
    if shape == "square":
        for axis in "xy":
            rel = swept(rel, axis, lambda c, axis=axis: pick(c).over(along(axis).rowsBetween(-half, half)))
        return rel
    # a disc is one run of each row: runs along x first, then the rows joined along y
    df = rel.df
    reach = disc(half)
    for width in sorted(set(reach)):
        df = df.withColumn(f"_w{width}", pick("v").over(along("x").rowsBetween(-width, width)))
    w = along("y")
    parts = []
    for dy in range(-half, half + 1):
        c = F.col(f"_w{reach[abs(dy)]}")
        parts.append(c if dy == 0 else F.lag(c, -dy).over(w) if dy < 0 else F.lead(c, dy).over(w))
    return Rel(df, FIELD, rel.width, rel.height).field((F.greatest if largest else F.least)(*parts))


@node("morphology", gives=FIELD, mode=choice("erode", "dilate", "open", "close", strict=True), radius=number(2, 0, 50), shape=choice("round", "square"), coverage=choice("soft", "hard"))
def morphology(inputs, p):
    v = t.clamp(F.nanvl(F.col("v"), num(0)))
    rel = inputs["in"].field(F.when(v >= 0.5, num(1)).otherwise(num(0)) if p["coverage"] == "hard" else v)
    for largest in {"erode": [False], "dilate": [True], "open": [False, True], "close": [True, False]}[p["mode"]]:
        rel = extreme(rel, math.floor(p["radius"] + 0.5), p["shape"], largest)
    return rel


STENCILS = {"sobel": (0.25, 0.5, 0.25), "scharr": (0.1875, 0.625, 0.1875)}


def step_peak(k: list[float], second: bool) -> float:
    """The largest answer to a unit step, by which a magnitude is normalised."""
    r = len(k) // 2
    n = 2 * r + 8
    smooth = [sum(v * float(min(max(i + j - r, 0), n - 1) >= n // 2) for j, v in enumerate(k)) for i in range(n)]
    return max(1e-12, *[abs(smooth[i + 1] - 2 * smooth[i] + smooth[i - 1]) if second else abs(smooth[i + 1] - smooth[i - 1]) / 2 for i in range(1, n - 1)])


@node("edge_field", needs=(), takes=("in", "field"), gives=FIELD, operator=choice("sobel", "scharr", "laplacian"), scale=number(1, 0, 10), threshold=number(0, 0, 1), softness=number(0, 0, 1))
def edge_field(inputs, p):
    """Edge magnitude of a field, or of display luma, after a gaussian; a unit step gives 1."""
    rel = inputs["field"].field(t.clamp(F.col("v"))) if "field" in inputs else inputs["in"].field(t.encode(t.luma(F.col("r"), F.col("g"), F.col("b"))))
    sigma = p["scale"] if p["scale"] > 0.05 else 0.0
    k = kernel(sigma, 3.0) if sigma else [1.0]
    rel = gaussian(rel, sigma, reach=3.0)
    second = p["operator"] == "laplacian"
    df = rel.df.withColumns(dict(zip(("_l", "_r"), neighbours("x", F.col("v"), [-1, 1]), strict=True)))
    if second:
        up, down = neighbours("y", F.col("v"), [-1, 1])
        m = F.abs(F.col("_l") + F.col("_r") + up + down - num(4) * F.col("v"))
    else:
        a, b, _ = STENCILS[p["operator"]]
        df = df.withColumn("_dx", (F.col("_r") - F.col("_l")) * num(0.5)).withColumn("_sx", num(a) * (F.col("_l") + F.col("_r")) + num(b) * F.col("v"))
        (u, d), (su, sd) = neighbours("y", F.col("_dx"), [-1, 1]), neighbours("y", F.col("_sx"), [-1, 1])
        gx, gy = num(a) * (u + d) + num(b) * F.col("_dx"), (sd - su) * num(0.5)
        df = df.withColumn("_gx", gx).withColumn("_gy", gy)
        m = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    m = m / num(step_peak(k, second))
    low, soft = min(1.0, p["threshold"]), min(1.0, p["softness"])
    v = m if low == soft == 0 else F.when(m >= low, num(1)).otherwise(num(0)) if soft <= 1e-6 else (m - num(low)) / num(soft)
    return Rel(df, FIELD, rel.width, rel.height).field(t.clamp(v))


@node("median_mask", gives=FIELD, radius=number(2, 0, 50), percentile=number(50))
def median_mask(inputs, p):
    """The value of a rank in a disc around each pixel, cut at the frame's edge."""
    rel = inputs["in"].field(t.clamp(F.nanvl(F.col("v"), num(0))))
    half = math.floor(p["radius"] + 0.5)
    return rel if half == 0 else ranked(rel, half, p["percentile"], "v", ["v"])


#: Pixels of a disc up to which the ranks are taken from gathered lists; larger discs are ranked in tiles.
LISTED = 49


def ranked_in_tiles(rel: Rel, half: int, percentile: float, key: str, keep: list[str]) -> Rel:
    """ranked() for wide discs: a line of a tile at a time, its pixels' discs as columns of one array."""
    reach = disc(half)
    offsets = [(dy, dx) for dy in range(-half, half + 1) for dx in range(-reach[abs(dy)], reach[abs(dy)] + 1)]
    share = min(1.0, max(0.0, percentile / 100))
    names = list(dict.fromkeys([key, *keep, *rel.channels]))

    def run(planes, y0, x0):
        h, w = planes[key].shape
        wide = {c: np.pad(np.where(planes["there"], planes[c], np.inf), half, constant_values=np.inf) for c in {key, *keep}}
        out = {c: planes[c].copy() for c in names} | {"there": planes["there"]}
        across = np.arange(w)
        for y in range(h):
            rows = {c: np.stack([v[y + half + dy, half + dx : half + dx + w] for dy, dx in offsets]) for c, v in wide.items()}
            keys = rows[key]
            place = np.floor((np.maximum(np.isfinite(keys).sum(axis=0), 1) - 1) * share + 0.5).astype(int)
            value = np.partition(keys, np.unique(place), axis=0)[place, across]
            alike = keys == value
            for c in keep:
                out[c][y] = value if c == key else np.where(alike, rows[c], -np.inf).max(axis=0)
            if set(keep) != {key}:
                for x in np.flatnonzero(alike.sum(axis=0) > 1):  # of pixels with the same key the one whose turn it is, by its channels
                    ties = sorted(zip(*(rows[c][alike[:, x], x] for c in keep), strict=True))
                    for c, v in zip(keep, ties[place[x] - int((keys[:, x] < value[x]).sum())], strict=True):
                        out[c][y, x] = v
        return out

    return Rel(over_tiles(rel.df, rel.width, rel.height, half, names, rel.channels, run), rel.kind, rel.width, rel.height)


def ranked(rel: Rel, half: int, percentile: float, key: str, keep: list[str]) -> Rel:
    """Of the pixels in a disc, the one whose key has the wanted rank. Values of a row are gathered in a window, and rows in another, so no pixel is sent more than once for each; wide discs go by tiles."""
    reach = disc(half)
    if sum(2 * reach[abs(dy)] + 1 for dy in range(-half, half + 1)) > LISTED:
        return ranked_in_tiles(rel, half, percentile, key, keep)
    row, col = along("x"), along("y")
    item = F.struct(F.col(key).alias("k"), *[F.col(c) for c in keep])
    df = rel.df
    for width in sorted(set(reach)):
        df = df.withColumn(f"_w{width}", F.collect_list(item).over(row.rowsBetween(-width, width)))
    parts = []
    for dy in range(-half, half + 1):
        c = F.col(f"_w{reach[abs(dy)]}")
        parts.append(c if dy == 0 else F.coalesce(F.lag(c, -dy).over(col) if dy < 0 else F.lead(c, dy).over(col), F.slice(c, 1, 0)))
    df = df.withColumn("_all", F.array_sort(F.concat(*parts)))
    place = F.floor((F.size("_all") - 1) * num(min(1.0, max(0.0, percentile / 100))) + num(0.5)).cast("int") + 1
    df = df.withColumn("_at", F.element_at("_all", place))
    return Rel(df.select(*KEY, *[F.col(f"_at.{c}").alias(c) if c in keep else F.col(c) for c in rel.channels]), rel.kind, rel.width, rel.height)


@node("median", masked=True, radius=number(2, 0, 50), percentile=number(50), rank=choice("luminance", "channel"))
def median(inputs, p):
    """A rank filter: by luminance a real pixel of the disc, by channel each on its own."""
    rel, half = inputs["in"], math.floor(p["radius"] + 0.5)
    if half == 0:
        return rel
    if p["rank"] == "channel":
        for c in COLOURS:
            rel = ranked(rel, half, p["percentile"], c, [c])
        return rel
    lit = Rel(rel.df.withColumn("_y", t.luma(F.col("r"), F.col("g"), F.col("b"))), rel.kind, rel.width, rel.height)
    return ranked(lit, half, p["percentile"], "_y", COLOURS)


def truncated_mean(rel: Rel, radius: int) -> Rel:
    """A box mean over the part of the box inside the frame."""
    for axis in "xy":
        rel = swept(rel, axis, lambda c, axis=axis: F.avg(c).over(along(axis).rowsBetween(-radius, radius)))
    return rel


def box_columns(df, columns: list[str], radius: int, width: int, height: int, clamped: bool):
    """Box means of columns in place."""
    return box_means(df, dict.fromkeys(columns, radius), width, height, clamped)


def box_means(df, radii: dict[str, int], width: int, height: int, clamped: bool):
    """Box means of columns in place, each over its own radius: one pass along rows and one along columns for all."""
    for axis, size in (("x", width), ("y", height)):
        mean = (lambda c, r, axis=axis, size=size: clamped_mean(axis, r, size)(c)) if clamped else (lambda c, r, axis=axis: F.avg(c).over(along(axis).rowsBetween(-r, r)))
        df = df.withColumns({c: mean(F.col(c), r) for c, r in radii.items()})
    return df


def guided(df, targets: list[str], guide: list[str], radius: int, eps: float, width: int, height: int, clamped: bool):
    """The colour guided filter: each target as a local linear function of the guide's three channels. Box means of products, a 3x3 solve a pixel, box means of the coefficients."""
    g = guide
    products = {f"_{a}{b}": F.col(a) * F.col(b) for i, a in enumerate(g) for b in g[i:]}
    products |= {f"_{a}_{q}": F.col(a) * F.col(q) for a in g for q in targets}
    means = {f"_m{c}": F.col(c) for c in [*g, *targets]}
    df = df.withColumns({**products, **means})
    df = box_columns(df, [*products, *means], radius, width, height, clamped)

    def cov(a, b):
        name = f"_{a}{b}" if f"_{a}{b}" in products else f"_{b}{a}"
        return F.col(name) - F.col(f"_m{a}") * F.col(f"_m{b}") + (num(eps) if a == b else num(0))

    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    df = df.withColumns({f"_c{i}{j}": cov(g[i], g[j]) for i, j in pairs})
    c = lambda i, j: F.col(f"_c{min(i, j)}{max(i, j)}")
    minor = {(i, j): c((i + 1) % 3, (j + 1) % 3) * c((i + 2) % 3, (j + 2) % 3) - c((i + 1) % 3, (j + 2) % 3) * c((i + 2) % 3, (j + 1) % 3) for i in range(3) for j in range(3)}
    df = df.withColumns({f"_i{i}{j}": minor[i, j] for i, j in pairs})
    df = df.withColumn("_det", c(0, 0) * F.col("_i00") + c(0, 1) * F.col("_i01") + c(0, 2) * F.col("_i02"))
    inv = lambda i, j: F.col(f"_i{min(i, j)}{max(i, j)}") / F.col("_det")
    coefficients = {}
    for q in targets:
        own = [F.col(f"_{a}_{q}") - F.col(f"_m{a}") * F.col(f"_m{q}") for a in g]
        for i in range(3):
            coefficients[f"_a{i}{q}"] = inv(i, 0) * own[0] + inv(i, 1) * own[1] + inv(i, 2) * own[2]
    df = df.withColumns(coefficients)
    df = df.withColumns({f"_b{q}": F.col(f"_m{q}") - sum((F.col(f"_a{i}{q}") * F.col(f"_m{g[i]}") for i in range(3)), num(0)) for q in targets})
    df = box_columns(df, [*coefficients, *[f"_b{q}" for q in targets]], radius, width, height, clamped)
    return df.withColumns({f"_q{q}": sum((F.col(f"_a{i}{q}") * F.col(g[i]) for i in range(3)), F.col(f"_b{q}")) for q in targets})


GUIDED = {"radius": number(8), "epsilon": number(0.01, 0, 0.1)}


@node("guided_filter", takes=("guide",), masked=True, params=GUIDED)
def guided_filter(inputs, p):
    """A picture smoothed in display values along a guide picture's edges, or its own."""
    rel, radius = inputs["in"], round(p["radius"])
    if radius <= 0:
        return rel
    guide = inputs.get("guide")
    guide = rel if guide is None or not guide.same_size(rel) else guide
    df = rel.joined(guide, "g_", "inner")
    df = df.withColumns({f"t{c}": t.encode(F.col(c)) for c in COLOURS} | {f"u{c}": t.encode(F.col(f"g_{c}")) for c in COLOURS})
    df = guided(df, [f"t{c}" for c in COLOURS], [f"u{c}" for c in COLOURS], radius, max(p["epsilon"], 1e-8), rel.width, rel.height, True)
    return Rel(df, IMAGE, rel.width, rel.height).image(*[t.decode(F.col(f"_qt{c}")) for c in COLOURS])


@node("guided_filter_mask", takes=("target",), gives=FIELD, params=GUIDED)
def guided_filter_mask(inputs, p):
    """A field smoothed along a picture's edges."""
    rel, target, radius = inputs["in"], inputs.get("target"), round(p["radius"])
    df = rel.df.withColumn("t", num(0)) if target is None else rel.joined(target, "m_").withColumn("t", t.clamp(F.coalesce("m_v", num(0))))
    if radius <= 0:
        return Rel(df, FIELD, rel.width, rel.height).field(F.col("t"))
    df = df.withColumns({f"u{c}": t.encode(F.col(c)) for c in COLOURS})
    df = guided(df, ["t"], [f"u{c}" for c in COLOURS], radius, max(p["epsilon"], 1e-8), rel.width, rel.height, False)
    return Rel(df, FIELD, rel.width, rel.height).field(t.clamp(F.col("_qt")))


@node("depth_normals", gives=IMAGE, reads=choice("depth", "height"), strength=number(2000, 0, 10000), cliff=number(0.15, 0, 1))
def depth_normals(inputs, p):
    """Unit normals of a height field from slopes that don't reach over a cliff: of the two one-sided slopes those within the cliff are averaged."""
    rel = inputs["in"]
    v = t.clamp(F.nanvl(F.col("v"), num(0)))
    df = rel.df.select(*KEY, (v if p["reads"] == "height" else num(1) - v).alias("v"))

    def slope(axis: str) -> Column:
        w = along(axis)
        back, ahead = F.col("v") - F.lag("v").over(w), F.lead("v").over(w) - F.col("v")
        ok = [F.when(F.abs(d) <= p["cliff"], d) for d in (back, ahead)]
        both = (ok[0] + ok[1]) / num(2)
        return F.coalesce(both, *ok, num(0)) * num(p["strength"])

    df = df.withColumn("_gx", slope("x")).withColumn("_gy", slope("y"))
    df = df.withColumn("_n", F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy") + num(1)))
    n = [-F.col("_gx") / F.col("_n"), -F.col("_gy") / F.col("_n"), num(1) / F.col("_n")]
    return Rel(df, FIELD, rel.width, rel.height).image(*[(c + num(1)) * num(0.5) for c in n], num(1))
