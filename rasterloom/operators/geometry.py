"""Nodes that move pixels: gathers at computed places, as joins on the four pixels around each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.frame import KEY, Rel
from rasterloom.functions.tone import num
from rasterloom.operators.node import choice, node, number
from rasterloom.operators.point import SIGNED


def gathered(rel: Rel, places: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Bilinear samples at _gx, _gy, in pixel centres from 0, with edges clamped; places without a value keep their key and have nulls. Each place is sent to the four pixels around it, which meet again by its columns, the same after a lost task; places alike in all columns are one."""
    channels = channels or rel.channels
    others = [c for c in places.columns if c not in ("_gx", "_gy")]
    x, y = F.least(F.greatest("_gx", num(0)), num(rel.width - 1)), F.least(F.greatest("_gy", num(0)), num(rel.height - 1))
    at = places.select(*others, x.alias("_gx"), y.alias("_gy"))
    x0, y0 = F.floor("_gx"), F.floor("_gy")
    tx, ty = F.col("_gx") - x0, F.col("_gy") - y0
    x1, y1 = F.least(x0 + 1, F.lit(rel.width - 1)), F.least(y0 + 1, F.lit(rel.height - 1))
    corner = lambda a, b, w: F.struct(a.cast("int").alias("x"), b.cast("int").alias("y"), w.alias("w"))
    four = F.array(corner(x0, y0, (num(1) - tx) * (num(1) - ty)), corner(x1, y0, tx * (num(1) - ty)), corner(x0, y1, (num(1) - tx) * ty), corner(x1, y1, tx * ty))
    wide = at.select(*[F.col(c).alias(f"_k_{c}") for c in others], F.explode(F.filter(four, lambda c: c["w"] > 0)).alias("_c"))
    wide = wide.select("*", F.col("_c.x").alias("_sx"), F.col("_c.y").alias("_sy"), F.col("_c.w").alias("_w"))
    source = rel.df.select(F.col("frame_id").alias("_k_frame_id"), F.col("x").alias("_sx"), F.col("y").alias("_sy"), *channels)
    joined = wide.hint("merge").join(source, ["_k_frame_id", "_sx", "_sy"], "left")
    found = joined.groupBy(*[f"_k_{c}" for c in others]).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in channels])
    return found.select(*[F.col(f"_k_{c}").alias(c) for c in others], *channels)


def grid(rel: Rel, width: int, height: int) -> DataFrame:
    """The keys of frames of another size."""
    frames = rel.df.select("frame_id").distinct()
    spark = rel.df.sparkSession
    return frames.crossJoin(spark.range(height).select(F.col("id").cast("int").alias("y"))).select("frame_id", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))


def sampled(rel: Rel, width: int, height: int, fx: Column, fy: Column, inside: bool = True) -> Rel:
    """A frame of a size whose pixels are bilinear samples at fx, fy, in pixel edges from 0; with inside, places off the frame are 0."""
    places = rel.df.select(*KEY) if (width, height) == (rel.width, rel.height) else grid(rel, width, height)
    places = places.withColumn("_fx", fx).withColumn("_fy", fy).select(*KEY, (F.col("_fx") - num(0.5)).alias("_gx"), (F.col("_fy") - num(0.5)).alias("_gy"), (F.col("_fx").between(0, rel.width) & F.col("_fy").between(0, rel.height)).alias("_in"))
    found = gathered(rel, places)
    cols = [(F.when(F.col("_in"), F.coalesce(c, num(0))).otherwise(num(0)) if inside else F.coalesce(c, num(0))).alias(c) for c in rel.channels]
    return Rel(found.select(*KEY, *cols), rel.kind, width, height)


def resized(rel: Rel, width: int, height: int, fit: str = "stretch") -> Rel:
    """Brought to another size: stretched, fitted inside, filling, or centred as it is."""
    sx, sy = rel.width / width, rel.height / height
    if fit in ("fit", "place"):
        sx = sy = max(sx, sy)
    elif fit == "fill":
        sx = sy = min(sx, sy)
    elif fit == "none":
        sx = sy = 1.0
    ox, oy = (rel.width - width * sx) / 2, (rel.height - height * sy) / 2
    return sampled(rel, width, height, num(ox) + (F.col("x") + num(0.5)) * num(sx), num(oy) + (F.col("y") + num(0.5)) * num(sy))


def moved(rel: Rel, width: int, height: int, x: Column, y: Column) -> Rel:
    """Whole pixels put at other places; those off the frame go."""
    df = rel.df.withColumn("_x", x.cast("int")).withColumn("_y", y.cast("int"))
    df = df.filter(F.col("_x").between(0, width - 1) & F.col("_y").between(0, height - 1))
    return Rel(df.select("frame_id", F.col("_y").alias("y"), F.col("_x").alias("x"), *rel.channels), rel.kind, width, height)


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


@node("crop_rotate", angle=SIGNED(m=45), aspect=SIGNED(), crop_x=number(0, 0, 0.95), crop_y=number(0, 0, 0.95), crop_w=number(1, 0.05, 1), crop_h=number(1, 0.05, 1), flip_h=number(0, 0, 1), flip_v=number(0, 0, 1), turn=number(0, 0, 3))
def crop_rotate(inputs, p):
    """Mirror, quarter turns, then a cut: whole pixels without angle or aspect, else bilinear about the centre."""
    rel = inputs["in"]
    x, y = F.col("x"), F.col("y")
    if p["flip_h"] >= 0.5 or p["flip_v"] >= 0.5:
        rel = moved(rel, rel.width, rel.height, F.lit(rel.width - 1) - x if p["flip_h"] >= 0.5 else x, F.lit(rel.height - 1) - y if p["flip_v"] >= 0.5 else y)
    w, h, turn = rel.width, rel.height, half_up(p["turn"]) % 4
    if turn:
        to = {1: (h, w, F.lit(h - 1) - y, x), 2: (w, h, F.lit(w - 1) - x, F.lit(h - 1) - y), 3: (h, w, y, F.lit(w - 1) - x)}[turn]
        rel = moved(rel, *to)
        w, h = rel.width, rel.height
    cx, cy = min(0.95, p["crop_x"]), min(0.95, p["crop_y"])
    cw, ch = max(0.05, min(1 - cx, p["crop_w"])), max(0.05, min(1 - cy, p["crop_h"]))
    angle, aspect = math.radians(p["angle"]), p["aspect"] / 100
    if (angle, aspect, cx, cy, cw, ch) == (0, 0, 0, 0, 1, 1):
        return rel
    ow, oh = max(1, half_up(w * cw)), max(1, half_up(h * ch))
    if angle == 0 and aspect == 0:
        ow, oh = min(ow, w), min(oh, h)
        return moved(rel, ow, oh, x - min(half_up(cx * w), w - ow), y - min(half_up(cy * h), h - oh))
    kx, ky = (1.0, 1 / (1 + aspect)) if aspect > 0 else (1 / (1 - aspect), 1.0)
    ox, oy = cx * w, cy * h
    mx, my = ox + ow / 2, oy + oh / 2
    s, c = math.sin(-angle), math.cos(-angle)
    dx = num(mx - w / 2) + (x + num(0.5 + ox - mx)) * num(kx)
    dy = num(my - h / 2) + (y + num(0.5 + oy - my)) * num(ky)
    return sampled(rel, ow, oh, num(w / 2) + dx * num(c) - dy * num(s), num(h / 2) + dx * num(s) + dy * num(c))


@node("transform", move_x=SIGNED(m=200), move_y=SIGNED(m=200), size=number(100, 1, 400), rotate=SIGNED(m=180), pivot_x=number(50), pivot_y=number(50))
def transform(inputs, p):
    """Move, scale and turn about a pivot; what comes from off the frame is transparent."""
    rel = inputs["in"]
    if (p["move_x"], p["move_y"], p["size"], p["rotate"]) == (0, 0, 100, 0):
        return rel
    w, h, k = rel.width, rel.height, max(p["size"], 0.01) / 100
    px, py = p["pivot_x"] / 100 * w, p["pivot_y"] / 100 * h
    s, c = math.sin(math.radians(p["rotate"])), math.cos(math.radians(p["rotate"]))
    dx, dy = F.col("x") + num(0.5 - p["move_x"] / 100 * w - px), F.col("y") + num(0.5 - p["move_y"] / 100 * h - py)
    return sampled(rel, w, h, num(px) + (dx * num(c) + dy * num(s)) / num(k), num(py) + (dy * num(c) - dx * num(s)) / num(k))


def homography(source, target) -> np.ndarray:
    """The projective map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1.0).reshape(3, 3)


@node("perspective", masked=True, vertical=SIGNED(), horizontal=SIGNED(), zoom=number(0))
def perspective(inputs, p):
    """Keystone: the frame's corners move out by up to a quarter of a side, about the centre with zoom."""
    rel = inputs["in"]
    v, hz, zoom = p["vertical"] / 100, p["horizontal"] / 100, 1 + p["zoom"] / 200
    if v == 0 and hz == 0 and zoom == 1:
        return rel
    w, h = rel.width, rel.height
    top, bottom, left, right = max(-v, 0) * w / 4, max(v, 0) * w / 4, max(-hz, 0) * h / 4, max(hz, 0) * h / 4
    corners = [(-top, -left), (w + top, -right), (w + bottom, h + right), (-bottom, h + left)]
    corners = [(w / 2 + (x - w / 2) * zoom, h / 2 + (y - h / 2) * zoom) for x, y in corners]
    m = homography(corners, [(0, 0), (w, 0), (w, h), (0, h)])
    x, y = F.col("x") + num(0.5), F.col("y") + num(0.5)
    u, q, z = (x * num(r[0]) + y * num(r[1]) + num(r[2]) for r in m)
    return sampled(rel, w, h, u / z, q / z)


@node("displacement_map", takes=("x", "y"), strength=number(20, 0, 500), max_displacement=number(50, 0, 500), edges=choice("clamp", "transparent"))
def displacement_map(inputs, p):
    """Each pixel is read from a place shifted by two fields, 0.5 being no shift."""
    rel = inputs["in"]
    fields = {k: inputs[k] for k in "xy" if k in inputs and inputs[k].same_size(rel)}
    if not fields or p["strength"] == 0 or p["max_displacement"] == 0:
        return rel
    df = rel.df.select(*KEY)
    for k, f in fields.items():
        df = df.hint("merge").join(f.df.select(*KEY, F.col("v").alias(f"_{k}")), KEY, "left")
    most = num(p["max_displacement"])

    def shift(k):
        return F.least(F.greatest((F.coalesce(f"_{k}", num(0.5)) - num(0.5)) * num(2 * p["strength"]), -most), most) if k in fields else num(0)

    gx, gy = F.col("x") - shift("x"), F.col("y") - shift("y")
    places = df.select(*KEY, gx.alias("_gx"), gy.alias("_gy"), (gx.between(-0.5, rel.width - 0.5) & gy.between(-0.5, rel.height - 0.5)).alias("_in"))
    found = gathered(rel, places)
    cut = p["edges"] == "transparent"
    return Rel(found.select(*KEY, *[(F.when(F.col("_in"), F.col(c)).otherwise(num(0)) if cut else F.col(c)).alias(c) for c in rel.channels]), rel.kind, rel.width, rel.height)


def area_mean(rel: Rel, factor: int, channels: list[str] | None = None) -> Rel:
    """A frame reduced by a whole factor: the mean of each square; at the right and lower edge of what is there."""
    w, h = -(-rel.width // factor), -(-rel.height // factor)
    df = rel.df.withColumn("x", F.floor(F.col("x") / factor).cast("int")).withColumn("y", F.floor(F.col("y") / factor).cast("int"))
    return Rel(df.groupBy(*KEY).agg(*[F.avg(c).alias(c) for c in channels or rel.channels]), rel.kind, w, h)
