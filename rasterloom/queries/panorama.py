"""Queries of the panorama chain, of drawn warps, of regions and of colour by colour, over the events table as a picture and over parts."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import depth, features, paint, panorama, recolor, regions, warp  # noqa: F401
from rasterloom.operators.node import run
from rasterloom.queries.raster import OFF, Query, events, one, picture, plane, shown, swapped

SLIDE, SHEAR = 0.031, 0.1
#: A grid of one cell whose lower edge is pulled to the right.
SHEARED = {"cols": 1.0, "rows": 1.0, "mesh": json.dumps([0, 0, 0, 0, SHEAR, 0, SHEAR, 0])}
CURVES = {
    "hue_hue": [{"x": 40, "y": 25}, {"x": 160, "y": -30}, {"x": 300, "y": 10}],
    "hue_sat": [{"x": 10, "y": 40}, {"x": 200, "y": -50}],
    "sat_lum": [{"x": 0, "y": 0.3}, {"x": 50, "y": -0.4}, {"x": 100, "y": 0.2}],
    "lum_temp": [{"x": -6, "y": 30}, {"x": 2, "y": -40}],
    "lum_pastel": [{"x": -4, "y": 20}, {"x": 1, "y": -10}],
}
ROWS = {"depth_lum": [{"x": 0, "y": -0.5}, {"x": 60, "y": 0.8}], "mask_tint": [{"x": 0, "y": 0}, {"x": 100, "y": 60}], "around_vib": [{"x": 90, "y": 50}, {"x": 270, "y": -40}], "hue_hue": [{"x": 30, "y": 60}, {"x": 210, "y": -60}]}
PAIRS = [{"a": {"h": 40, "ev": 1}, "b": {"h": 220, "ev": -1}, "width": 80, "sep": -60, "sat": 50, "lum": 70}, {"a": {"h": 100, "ev": -2}, "b": {"h": 140, "ev": 0}, "width": 60, "sep": 80, "sat": -30, "lum": -90}]
GRIDS = {"huelum_sat": [[(7 * r + 5 * c) % 41 - 20 for c in range(12)] for r in range(5)]}

LENS = {"aperture": 80.0, "focus": 40.0, "blades": 5.0, "blade_curve": 50.0, "fringe": 60.0, "field_curve": 30.0, "bubble": 40.0}
STROKES = [
    {"points": [[0.3, 0.4]], "radius": 0.22, "hardness": 0.5, "color": "#ff8000"},
    {"points": [[0.45, 0.5]], "radius": 0.2, "hardness": 0.2, "flow": 0.6, "color": "#2040c0"},
    {"points": [[0.4, 0.45]], "radius": 0.1, "hardness": 0.7, "flow": 0.8, "erase": True},
    {"points": [[0.6, 0.5]], "radius": 0.15, "hardness": 0.4, "src_dx": 0.25, "src_dy": -0.1},
]

HUES = [{"x": 20, "y": 1.2}, {"x": 140, "y": -1.5}, {"x": 260, "y": 0.4}]
TONE = {"interp": "smooth", "points": [[-7, 0.0], [-2, 0.2], [0, 0.5], [2, 0.95], [3, 1.0]]}

BENT = {"rgb": [[0.1, 0.0], [0.5, 0.62], [0.9, 0.9]], "g": [[0.0, 0.05], [0.6, 0.5]]}
HANDLES = {"interp": "tangent", "rgb": [[0.0, 0.0], [0.4, 0.5], [1.0, 1.0]], "rgb_h": [{"r": [0.1, 0.25]}, {"l": [-0.15, -0.02], "r": [0.2, 0.03]}, None], "b": [[0.0, 0.1], [1.0, 0.8]], "b_m": [0.2, 1.5]}

NODES: dict[str, Query] = {
    "curves__hue": one("curves", {"points": json.dumps(BENT), "rgb_mode": "hue"}),
    "curves__handles": one("curves", {"points": json.dumps(HANDLES)}),
    "median_mask__wide": one("median_mask", {"radius": 9.0, "percentile": 30.0}, field=True),
    "median__wide": one("median", {"radius": 6.0}),
    "black_white__hues": one("black_white", {"amount": 90.0, "hue_curve": json.dumps(HUES)}),
    "tone_profile__stock": one("tone_profile", {"film": "trix", "development": 1.0, "contrast": 90.0, "baseline_ev": 0.3, "colorfulness": 20.0}),
    "tone_profile__custom": one("tone_profile", {"mode": "custom", "curve": json.dumps(TONE), "contrast": 80.0, "baseline_ev": -0.2}),
    "dof": one("dof", LENS, depth="plane"),
    "dof__glow": one("dof", {"aperture": 50.0, "focus": 30.0, "glow": 60.0, "swirl": 40.0, "squeeze": 30.0}, depth="plane", digits=5),
    "paint": one("paint", {"strokes": json.dumps(STROKES)}),
    "clone__heal": one("clone", {"strokes": json.dumps([{"points": [[0.3, 0.4], [0.4, 0.5]], "radius": 0.08, "src_dx": 0.3}]), "heal": True}, digits=4),
    "grid_warp__slide": one("grid_warp", {"cols": 2.0, "rows": 2.0, "mesh": json.dumps([SLIDE, -SLIDE] * 9)}),
    "grid_warp__off": one("grid_warp", {"cols": 2.0, "rows": 2.0, "mesh": json.dumps([SLIDE, -SLIDE] * 9), "edges": "transparent"}),
    "grid_warp__shear": one("grid_warp", SHEARED),
    "shape_warp": one("shape_warp", {"shapes": json.dumps([{"cx": 0.4, "cy": 0.5, "radius": 0.2, "dx": 0.1, "scale": 1.3, "angle": 20}, {"cx": 0.7, "cy": 0.4, "radius": 0.1, "hold": True}])}, digits=5),
    "layer_warp": one("layer_warp", SHEARED | {"kind": "grid"}, weight="plane"),
    "layer_warp__room": one("layer_warp", {"space": "picture", "room": 10.0}),
    "layer_warp_mask": one("layer_warp_mask", SHEARED, field=True),
    "nlm_denoise__patches": one("nlm_denoise", {"strength": 60.0, "mode": "nlm"}),
    "recolor__curves": one("recolor", {"curves": json.dumps(CURVES)}),
    "recolor__rows": one("recolor", {"curves": json.dumps(ROWS), "eq_interp": "linear", "neutral_guard": 30.0, "smoothing": 0.0, "around_radius": 4.0, "hue_hue_mode": "spread"}, depth="plane", by="luma", ref="swapped"),
    "recolor__pairs": one("recolor", {"pairs": json.dumps(PAIRS), "smoothing": 0.0, "surfaces": json.dumps(GRIDS)}),
}


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extremes of the picture's scale space in its first octave."""
    found = features.scale_space_points(picture(spark, sf_dir), bare=True, octaves=1)
    return found.select("level", F.col("at_y").alias("y"), F.col("at_x").alias("x"), F.round("response", 6).alias("response"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features.detect(picture(spark, sf_dir))
    return found.select("id", *[F.round(c, 4).alias(c) for c in ("x", "y", "scale", "angle", "response")], F.transform("desc", lambda v: F.round(v, 4)).alias("desc"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture's regions, with their size and mean colour."""
    rel = picture(spark, sf_dir)
    labels = regions.segment(rel, 0.8, 20)
    return labels.join(rel.df.hint("merge"), ["frame_id", "y", "x"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c) + F.lit(OFF), 6).alias(c) for c in "rgb"])


#: Cameras that parts are seen by: focal lengths and rotations, the first of which is none.
PLANTED = {k: panorama.Camera(600.0 + 7 * k, panorama.rotation(np.array([0.03 * k, -0.25 * k, 0.02 * k]))) for k in range(4)}


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, a, b, ax, ay, bx, by: where two neighbouring cameras see a part, taken for a direction."""
    k = F.col("p_partkey")
    u, v = (k * 7919 % 1973).cast("double") / F.lit(986.5) - F.lit(1.0), (k * 104729 % 1487).cast("double") / F.lit(1487.0) - F.lit(0.5)
    rays = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("part"), u.alias("u"), v.alias("v"))
    seen = []
    for f, c in PLANTED.items():
        x, y, z = (F.col("u") * F.lit(float(r[0])) + F.col("v") * F.lit(float(r[1])) + F.lit(float(r[2])) for r in c.r)
        front = z > 0.2
        seen.append(F.struct(F.lit(f).cast("long").alias("f"), F.when(front, F.lit(c.f) * x / z).alias("x"), F.when(front, F.lit(c.f) * y / z).alias("y")))
    inside = lambda s: (F.abs(s["x"]) <= 400) & (F.abs(s["y"]) <= 300)
    pairs = F.array(*[F.struct(seen[i].alias("a"), seen[i + 1].alias("b")) for i in range(len(seen) - 1)])
    rows = rays.select("part", F.explode(pairs).alias("p")).filter(inside(F.col("p.a")) & inside(F.col("p.b")))
    return rows.select("part", F.col("p.a.f").alias("a"), F.col("p.b.f").alias("b"), F.col("p.a.x").alias("ax"), F.col("p.a.y").alias("ay"), F.col("p.b.x").alias("bx"), F.col("p.b.y").alias("by"))


def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras from what two of them see at a time, begun well off; and where they take each place of the one frame in the other."""
    rows = sightings(spark, sf_dir)
    start = {k: panorama.Camera(640.0, panorama.rotation(panorama.axis_of(c.r) + (k > 0) * np.array([0.02, -0.03, 0.01]))) for k, c in PLANTED.items()}
    cameras, _ = panorama.bundle_adjust(start, rows)
    x = y = F.lit(None).cast("double")
    for k in range(len(PLANTED) - 1):
        u, v, z = (F.col("ax") * F.lit(float(r[0])) + F.col("ay") * F.lit(float(r[1])) + F.lit(float(r[2])) for r in panorama.homography(cameras[k], cameras[k + 1]))
        x, y = (F.when(F.col("a") == k, p / z).otherwise(q) for p, q in ((u, x), (v, y)))
    return rows.select("part", "a", "b", F.round(x + F.lit(OFF), 3).alias("x"), F.round(y + F.lit(OFF), 3).alias("y"))


def two_warps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Two frames of the picture that overlap, the second with its channels in another order."""
    rel = picture(spark, sf_dir)
    parts = []
    for k, (frame, seen) in enumerate(((rel, F.col("x") < 70), (swapped(rel), F.col("x") >= 30))):
        weight = F.lit(1.0) - F.abs(F.col("x") - F.lit(29.5 + 40 * k)) / F.lit(100.0)
        parts.append(frame.df.filter(seen).select(F.lit("p").alias("pano"), F.lit(k).cast("long").alias("frame_id"), "y", "x", "r", "g", "b", weight.alias("w")))
    return parts[0].unionByName(parts[1]), rel.width, rel.height


def seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panorama.seam_owners(*two_warps(spark, sf_dir)).select("y", "x", "frame_id")


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    warps, width, height = two_warps(spark, sf_dir)
    owners = warps.groupBy("pano", "y", "x").agg(F.when(F.col("x") < 50, F.min("frame_id")).otherwise(F.max("frame_id")).alias("frame_id"))
    return panorama.multiband(warps, owners, width, height, 2).select("y", "x", *[F.round(F.col(c) + F.lit(OFF), 6).alias(c) for c in "rgba"])


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains that level two kinds of a user's events over the hours that have both."""
    e = events(spark, sf_dir).filter(F.col("event_type").isin("click", "view"))
    hours = e.groupBy("user_id", "event_type", F.hour("ts").alias("h")).agg((F.avg("value") / F.lit(500.0)).alias("v"))
    one_, other = (hours.filter(F.col("event_type") == k).select("user_id", "h", F.col("v").alias(c)) for k, c in (("click", "va"), ("view", "vb")))
    both = one_.join(other, ["user_id", "h"]).groupBy(F.col("user_id").alias("pano")).agg(F.count(F.lit(1)).alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"))
    overlaps = both.select("pano", F.lit("click").alias("a"), F.lit("view").alias("b"), "n", "mean_a", "mean_b")
    return panorama.gains(overlaps).select("pano", "frame", F.round(F.col("gain") + F.lit(OFF), 6).alias("gain"))


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask carried by a shape's move, where the picture goes along: both read the same places."""
    params = {"shapes": json.dumps([{"cx": 0.35, "cy": 0.5, "radius": 0.15, "dx": 0.3}])}
    rel = plane(spark, sf_dir)
    mask = run("layer_warp_mask", {"in": rel}, params)
    whole = run("layer_warp", {"in": rel.image(F.col("v"), F.col("v"), F.col("v"), F.lit(1.0))}, params)
    return shown(mask, 5).join(shown(whole, 5).select("y", "x", "r"), ["y", "x"])


def queries() -> dict[str, Query]:
    return NODES | {
        "detect__extremes": extremes, "detect__points": points, "segment": segments, "match__bundle": bundle, "match__seams": seams, "match__multiband": bands, "match__gains": gains, "layer_warp__carried": carried,
    }


