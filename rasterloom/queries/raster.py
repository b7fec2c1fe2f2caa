"""Queries of the raster nodes over the events table as a picture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, KEY, Rel, field_rel, frame_from_events, image_rel, plane_from_events, scene_from_events
from rasterloom.functions import exif
from rasterloom.operators import combine, detail, geometry, masks, match, point, select, spatial, stack, views  # noqa: F401
from rasterloom.operators.node import run
from rasterloom.plans.graph import Graph
from rasterloom.session import shared_path

Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def picture(spark: SparkSession, sf_dir: str) -> Rel:
    return frame_from_events(events(spark, sf_dir))


def plane(spark: SparkSession, sf_dir: str) -> Rel:
    return plane_from_events(events(spark, sf_dir))


def swapped(rel: Rel) -> Rel:
    """Another picture of the same size: channels in another order, alpha from green."""
    return rel.image(F.col("b"), F.col("r"), F.col("g"), F.col("g"))


def scene(spark: SparkSession, sf_dir: str) -> Rel:
    return scene_from_events(events(spark, sf_dir))


#: Added before rounding: values that differ in their last bit round alike, off the halves.
OFF = 1e-9


def shown(rel: Rel, digits: int = 6) -> DataFrame:
    return rel.df.select("y", "x", *[(F.round(F.col(c) + F.lit(OFF), digits) + F.lit(0.0)).alias(c) for c in rel.channels])


#: Rows of a frame in a result that holds several, so that y tells frames apart.
FRAME_ROWS = 500_000_000


def shown_frames(rel: Rel, digits: int = 6) -> DataFrame:
    y = (F.col("frame_id") * FRAME_ROWS + F.col("y")).cast("int").alias("y")
    return rel.df.select(y, "x", *[(F.round(F.col(c) + F.lit(OFF), digits) + F.lit(0.0)).alias(c) for c in rel.channels])


def one(node: str, params: dict | None = None, port: str = "in", field: bool = False, digits: int = 6, **extra: str) -> Query:
    """A node over the picture (or the plane) with other inputs by name: picture, plane, swapped, luma."""

    def query(spark: SparkSession, sf_dir: str, base=picture, show=shown) -> DataFrame:
        inputs = {port: plane(spark, sf_dir) if field else base(spark, sf_dir)}
        for k, what in extra.items():
            inputs[k] = {"plane": plane, "picture": base, "swapped": lambda s, d: swapped(base(s, d)), "luma": lambda s, d: run("luminance_extract", {"in": base(s, d)})}[what](spark, sf_dir)
        return show(run(node, inputs, params), digits)

    return query


def in_scene(query: Query) -> Query:
    """A query of one() over several pictures of scene light."""
    return lambda spark, sf_dir: query(spark, sf_dir, base=scene, show=shown_frames)


#: Nodes that look at one pixel only, so that pictures of scene light show all their cases.
SCENE = (
    "exposure exposure__gain white_balance color_checker standard_color levels color_balance split_tone channel_gain soft_clip soft_clip__channel chroma_key chroma_key_despill channel_extract channel_mixer color_transform "
    "color_grade gamut_map tone_profile lift gradient__tone gradient_map fx_color_overlay to_display to_display__gamma to_scene luma_chroma_split luma_chroma_join invert desaturate alpha_association__extract alpha_association__premultiply "
    "alpha_association__unpremultiply luminance_extract luminance_range_mask range_mask color_range_mask hue_range_mask merge chromatic_adapt paper black_white detail__dehaze tone_mask__shadows tone_mask__midtones tone_mask__highlights tone_mask__bell "
    "measure__luma measure__red measure__green measure__blue measure__hue measure__chroma measure__saturation measure__alpha view_transform__sigmoid view_transform__filmic view_transform__agx view_transform__aces"
).split()


TONE = {"exposure": 0.5, "contrast": 30.0, "highlights": -40.0, "shadows": 35.0, "whites": 10.0, "blacks": -15.0, "color_contrast": 20.0}
WHEELS = {"shadows_hue": 40.0, "shadows_sat": 50.0, "midtones_lum": 20.0, "highlights_hue": -120.0, "highlights_sat": 30.0, "highlights_lum": -10.0}

NODES: dict[str, Query] = {
    "exposure": one("exposure", TONE),
    "exposure__gain": one("exposure", {"exposure": 1.0}),
    "exposure__masked": one("exposure", {"exposure": 1.0}, mask="plane"),
    "white_balance": one("white_balance", {"temperature": 7500.0, "tint": 20.0}),
    "color_checker": one("color_checker", {"m00": 1.2, "m01": -0.1, "m12": 0.3, "m22": 0.9, "exposure": 0.25, "amount": 80.0}),
    "standard_color": one("standard_color", {"temperature": 5500.0, "exposure": 0.3, "contrast": 25.0, "saturation": 20.0, "vibrance": 30.0}),
    "levels": one("levels", {"black": 0.1, "white": 0.9, "gamma": 1.4, "black_soft": 20.0, "white_soft": 30.0}),
    "color_balance": one("color_balance", WHEELS),
    "split_tone": one("split_tone", {"shadow_hue": 220.0, "shadow_sat": 60.0, "highlight_hue": 40.0, "highlight_sat": 40.0, "balance": 20.0}),
    "channel_gain": one("channel_gain", {"channel": "green", "gain": 150.0}),
    "vignette": one("vignette", {"vignette": -60.0, "vignette_mid": 40.0, "softness": 0.6}),
    "soft_clip": one("soft_clip", {"ceiling": 0.7, "knee": 0.4, "toe": 0.05}),
    "soft_clip__channel": one("soft_clip", {"ceiling": 0.7, "knee": 0.4, "by": "channel"}),
    "chroma_key": one("chroma_key", {"tolerance": 0.1, "softness": 0.2}),
    "chroma_key_despill": one("chroma_key_despill", {"spill": 0.8}),
    "channel_extract": one("channel_extract", {"channel": "luma"}),
    "channel_mixer": one("channel_mixer", {"mix_rr": 80.0, "mix_rg": 20.0, "mix_gb": -30.0, "mix_br": 50.0, "preserve_gray": 1.0}),
    "color_transform": one("color_transform", {"from": "linear_rec709", "to": "srgb"}),
    "color_grade": one("color_grade", {"hue_shift": 20.0, "saturation": 15.0, "vibrance": 25.0, "exposure": 0.2}),
    "gamut_map": one("gamut_map", {"amount": 70.0}),
    "tone_profile": one("tone_profile", {"highlight_rolloff": 40.0, "shadow_toe": 20.0, "colorfulness": 10.0, "baseline_ev": 0.3}),
    "lift": one("lift"),
    "fill": one("fill", {"color": "#336699"}),
    "gradient": one("gradient", {"angle": 30.0, "midpoint": 40.0, "alpha_b": 50.0}),
    "gradient__radial": one("gradient", {"shape": "radial"}),
    "gradient__tone": one("gradient", {"shape": "tone", "color_a": "#102030", "color_b": "#f0e0d0"}),
    "gradient_map": one("gradient_map", {"color_lo": "#101040", "color_mid": "#c04040", "color_hi": "#ffffc0", "midpoint": 40.0, "amount": 80.0}),
    "fx_color_overlay": one("fx_color_overlay", {"opacity": 40.0, "color": "#ff8000"}),
    "fx_gradient_overlay": one("fx_gradient_overlay", {"opacity": 60.0, "angle": 90.0}),
    "to_display": one("to_display"),
    "to_display__gamma": one("to_display", {"gamma": 2.2}),
    "to_scene": one("to_scene", reference="swapped"),
    "luma_chroma_split": one("luma_chroma_split", {"part": "color"}),
    "luma_chroma_join": one("luma_chroma_join", chroma="swapped"),
    "invert": one("invert", {"amount": 0.7}),
    "desaturate": one("desaturate", {"amount": 0.6}),
    "alpha_association__extract": one("alpha_association", {"mode": "extract"}),
    "alpha_association__premultiply": one("alpha_association", {"mode": "premultiply"}),
    "alpha_association__unpremultiply": one("alpha_association", {"mode": "unpremultiply"}),
    "alpha_association__replace": one("alpha_association", {"mode": "replace"}, alpha="plane"),
    "luminance_extract": one("luminance_extract"),
    "luminance_range_mask": one("luminance_range_mask", {"low": 0.3, "high": 0.6, "feather": 0.1}),
    "invert_mask": one("invert_mask", port="mask", field=True),
    "remap": one("remap", {"in_low": 0.2, "in_high": 0.8, "gamma": 1.5, "out_low": 0.1, "out_high": 0.9}, field=True),
    "conditional": one("conditional", fg="swapped", mask="plane"),
    "channel_join": one("channel_join", port="r", field=True, g="luma", alpha="plane"),
    "range_mask": one("range_mask", {"luma_low": 0.3, "luma_high": 0.8, "sat_low": 0.2, "hue_center": 60.0, "hue_width": 80.0, "softness": 0.2}, digits=5),
    "range_mask__depth": one("range_mask", {"luma_low": 0.3, "depth_on": True, "depth_gamma": 1.2, "depth_black": 0.1}, depth="plane"),
    "color_range_mask": one("color_range_mask", {"color": "#8090a0", "range": 0.3, "falloff": 0.3}),
    "hue_range_mask": one("hue_range_mask", {"band_center": 120.0, "hue_range": 90.0, "hue_falloff": 60.0}, digits=5),
    "linear_mask": one("linear_mask", {"angle": 60.0, "position": 0.4, "span": 0.5}),
    "fog": one("fog", {"density": 60.0, "start": 10.0, "falloff": 60.0, "desat": 30.0}, depth="plane"),
    "merge": one("merge", {"opacity": 70.0}, port="base", fg="swapped"),
    "blur__box": one("blur", {"radius": 2.0, "kind": "box"}),
    "blur__gaussian": one("blur", {"radius": 0.8}),
    "denoise": one("denoise", {"strength": 20.0}),
    "high_pass": one("high_pass", {"radius": 1.0}),
    "hot_pixel": one("hot_pixel", {"sensitivity": 60.0}),
    "edge_field": one("edge_field", {"scale": 0.0}),
    "edge_field__laplacian": one("edge_field", {"operator": "laplacian", "scale": 0.0, "threshold": 0.1, "softness": 0.5}),
    "median_mask": one("median_mask", {"radius": 1.0}, field=True),
    "median_mask__low": one("median_mask", {"radius": 2.0, "percentile": 20.0}, field=True),
    "median__luminance": one("median", {"radius": 1.0}),
    "depth_normals": one("depth_normals", {"strength": 2.0, "cliff": 0.4}, field=True),
    "crop_rotate__flip": one("crop_rotate", {"flip_h": 1.0, "turn": 1.0}),
    "crop_rotate__cut": one("crop_rotate", {"crop_x": 0.1, "crop_w": 0.5, "crop_y": 0.2, "crop_h": 0.4}),
    "crop_rotate__angle": one("crop_rotate", {"angle": 10.0}),
    "mask_crop": one("mask_crop", {"crop_x": 0.105, "crop_w": 0.5, "crop_y": 0.2, "crop_h": 0.5}, field=True),
    "transform": one("transform", {"move_x": 3.0, "move_y": -2.0, "size": 90.0, "rotate": 15.0}),
    "perspective": one("perspective", {"vertical": 30.0, "zoom": 10.0}),
    "displacement_map": one("displacement_map", {"strength": 5.0, "max_displacement": 3.0}, x="plane", y="luma"),
    "guided_filter_mask": one("guided_filter_mask", {"radius": 2.0, "epsilon": 0.01}, target="plane"),
    "guided_filter": one("guided_filter", {"radius": 2.0, "epsilon": 0.02}),
    "sharpening": one("sharpening", {"radius": 0.8, "intensity": 40.0}),
    "skin_soften": one("skin_soften", {"softening": 1.0, "detail_back": 0.6, "strength": 50.0}),
    "chromatic_adapt": one("chromatic_adapt", {"illuminant": "a", "strength": 80.0}),
    "color_bend": one("color_bend", {"src_hue": 30.0, "src_sat": 0.5, "dst_hue": 60.0, "dst_sat": 0.8}),
    "curves": one("curves", {"points": '{"interp": "smooth", "rgb": [[0, 0], [0.4, 0.5], [1, 1]], "luma": [[0, 0.05], [1, 0.95]]}'}),
    "paper": one("paper", {"grade": 3.0, "time": 0.5, "toner": "sepia", "toning": 50.0, "base": 30.0}),
}
NODES |= {
    "clarity": one("clarity", {"texture": 30.0, "clarity": 40.0}),
    "detail": one("detail", {"texture": 20.0, "dehaze": 30.0}),
    "detail__dehaze": one("detail", {"dehaze": 30.0}),
    "detail_eq": one("detail_eq", {"fine": 40.0, "medium": -60.0, "large": 30.0, "midtones": 150.0, "blue": 50.0}),
    "detail_eq__band": one("detail_eq", {"view": "band:2"}),
    "fog__texture": one("fog", {"density": 70.0, "texture": 80.0, "texture_size": 40.0, "texture_shift": 2.0}, depth="plane"),
    "detail__weighed": one("detail", {"dehaze": 40.0, "dehaze_shadows": 50.0, "dehaze_highlights": 150.0, "dehaze_red": 80.0}),
    "standard_color__dehaze": one("standard_color", {"saturation": 20.0, "dehaze": -25.0}),
    "detail__texture": one("detail", {"texture": 30.0, "clarity": -20.0, "texture_midtones": 60.0}),
    "blur__wide": one("blur", {"radius": 14.0}, digits=5),
    "blur__gaussian_8": one("blur", {"radius": 8.0}, digits=5),
    "blur__motion": one("blur", {"radius": 3.0, "kind": "motion", "angle": 30.0}),
    "depth_map": one("depth_map"),
    "export_layer": one("export_layer", port="image"),
    "output": one("output"),
    "sharpen": one("sharpen", {"amount": 80.0, "radius": 0.6}),
    "black_white": one("black_white", {"amount": 80.0, "red": 40.0, "green": 50.0}),
    "halation": one("halation", {"threshold": 20.0, "radius": 8.0, "bloom": 20.0, "bloom_radius": 10.0}),
    "fx_shadow": one("fx_shadow", {"size": 3.0, "distance": 2.0}),
    "fx_glow": one("fx_glow", {"size": 3.0, "color": "#ff0000", "inner": True}),
    "fx_bevel": one("fx_bevel", {"size": 2.0}),
    "distance_field": one("distance_field", {"max_distance": 3.0}, field=True),
    "lens_correct": one("lens_correct", {"distortion": 20.0, "ca_red": 30.0, "vignette": 25.0}),
    "lens_correct__falloff": one("lens_correct", {"vignette": 40.0, "vignette_mid": 30.0}),
    "model_denoise": one("model_denoise", {"luminance": 70.0, "detail": 20.0}, raster="swapped"),
    "inpaint": one("inpaint", raster="swapped", mask="plane"),
    "matte_mask": one("matte_mask", raster="plane"),
    "noise": one("noise", {"size": 20.0, "color_grain": True}),
    "grain": one("grain", {"intensity": 40.0, "shadows_gain": 150.0}),
    "tone_eq": one("tone_eq", {"ev_m2": 0.5, "ev_p1": -0.7, "smoothing": 40.0}),
    "selection_mask": one("selection_mask", {"regions": '[{"kind": "marquee", "x0": 0.1, "y0": 0.1, "x1": 0.7, "y1": 0.8}, {"kind": "marquee", "shape": "ellipse", "op": "subtract", "x0": 0.3, "y0": 0.2, "x1": 0.6, "y1": 0.9}]'}),
    "brush_mask": one("brush_mask", {"strokes": '[{"points": [[0.1, 0.5], [0.9, 0.5]], "radius": 0.2, "hardness": 0.5}]'}),
    "smart_mask": one("smart_mask", {"threshold": 40.0}, raster="plane"),
    "color_console": one("color_console", {"bands": '[{"id": "a", "center": 120, "width": 40, "hue": 15, "sat": 30, "lum": 0.3}]'}),
    "nlm_denoise": one("nlm_denoise", {"strength": 40.0}),
}
NODES |= {f"tone_mask__{m}": one("tone_mask", {"range": m}) for m in ("shadows", "midtones", "highlights", "bell")}
NODES |= {f"measure__{m}": one("measure", {"metric": m}, digits=5) for m in ("luma", "red", "green", "blue", "hue", "chroma", "saturation", "alpha")}
NODES["measure__smooth"] = one("measure", {"metric": "luma", "smoothing": 1.0})
NODES |= {f"compare__{m}": one("compare", {"op": m, "level": 0.4}, field=True) for m in ("gt", "ge", "lt", "le", "eq", "neq")}
NODES["compare__soft"] = one("compare", {"op": "gt", "level": 0.4, "softness": 0.3}, field=True)
NODES |= {f"logic__{m}": one("logic", {"op": m}, field=True, fg="luma") for m in ("and", "or", "xor", "subtract")}
NODES |= {f"math__{m}": one("math", {"op": m, "scale": 0.5, "offset": 0.1}, field=True, fg="luma") for m in ("add", "subtract", "multiply", "divide", "min", "max", "difference", "power")}
NODES |= {f"view_transform__{m}": one("view_transform", {"mode": m, "exposure_ev": 0.5}) for m in ("sigmoid", "filmic", "agx", "aces")}
NODES |= {f"radial_mask__{m}": one("radial_mask", {"shape": m, "radius": 0.35, "aspect": 1.5, "rotation": 30.0}) for m in ("ellipse", "rectangle", "triangle", "crescent", "trapeze", "cross", "semicircle")}
NODES |= {f"blend__{m}": one("blend", {"mode": m, "opacity": 80.0}, port="base", blend="swapped") for m in combine.MODES}
NODES |= {f"morphology__{m}": one("morphology", {"mode": m, "radius": 1.0, "shape": "square"}, field=True) for m in ("erode", "dilate", "open", "close")}
NODES["morphology__round"] = one("morphology", {"mode": "dilate", "radius": 2.0, "shape": "round"}, field=True)


SCENE += [f"blend__{m}" for m in combine.MODES]


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table of three steps a side, written for the occasion: channels turned round and bent."""
    steps = (0.0, 0.5, 1.0)
    rows = [f"{b * b} {r * 0.9 + 0.05} {g * (1 - 0.2 * r)}" for b in steps for g in steps for r in steps]
    path = shared_path(spark, "lut")
    spark.createDataFrame([("\n".join(["LUT_3D_SIZE 3", *rows]),)], "value string").coalesce(1).write.text(path)
    return shown(run("lut", {"in": picture(spark, sf_dir)}, {"path": path, "amount": 80.0}))


def area_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(geometry.area_mean(picture(spark, sf_dir), 4))


def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame an event type over day and hour, with gaps where nothing happened."""
    e = events(spark, sf_dir)
    return e.groupBy(F.col("event_type").alias("frame_id"), F.hour("ts").alias("y"), F.dayofmonth("ts").alias("x")).agg(F.round(F.avg("value"), 6).alias("v"))


EXPOSURES = {"click": 1.0, "error": 2.0, "purchase": 0.5, "signup": 1.5, "view": 4.0}


def stack_query(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = stack_frames(spark, sf_dir)
        if mode == "hdr":
            kinds = sorted(r[0] for r in frames.select("frame_id").distinct().collect())
            frames = frames.withColumn("v", F.col("v") / F.lit(500.0))
            out = stack.merge_frames(frames, mode, ["v"], ["y", "x"], {k: 1.0 + i for i, k in enumerate(kinds)})
        else:
            out = stack.merge_frames(frames, mode, ["v"], ["y", "x"])
        return out.select("y", "x", F.round(F.col("v") + F.lit(OFF), 5).alias("v"))

    return query


def noise_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stack.noise_levels(picture(spark, sf_dir), tile=5, least=1)
    return out.select("frame_id", F.round("luma_sigma", 6).alias("luma_sigma"), F.round("chroma_sigma", 6).alias("chroma_sigma"))


def chroma_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack.chroma_histogram(picture(spark, sf_dir)).select("bin", F.round("share", 9).alias("share"))


def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane in four steps as labels, and the region at its middle."""
    labels = plane(spark, sf_dir).field(F.floor(F.col("v") * F.lit(3.999)).cast("double"))
    return stack.region_coverage(labels, 0.5, 0.5, 16).select("gy", "gx", "covered")


#: How far the frames of the shifting query are moved, and the furthest that is looked for.
MOVES, FURTHEST = ((0, 0, 0), (1, 3, -2), (2, -5, 4)), 8


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture, blurred, and two copies that are moved and cut where they leave it, found again."""
    rel = run("blur", {"in": picture(spark, sf_dir)}, {"radius": 3.0, "kind": "box"})
    copies = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for f, dx, dy in MOVES])).alias("m")
    df = rel.df.select("y", "x", *"rgba", copies)
    y, x = F.col("y") + F.col("m.dy"), F.col("x") + F.col("m.dx")
    df = df.filter(x.between(0, rel.width - 1) & y.between(0, rel.height - 1)).select(F.col("m.f").alias("frame_id"), y.alias("y"), x.alias("x"), *"rgba")
    return stack.find_shifts(image_rel(df, rel.width, rel.height), 0, FURTHEST)


def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture covered but where a user's event is an error of a small value: the largest rectangle without such a hole."""
    rel = picture(spark, sf_dir)
    hole = (F.col("a") < 1) & (F.col("r") < 0.02)
    rel = rel.image(F.col("r"), F.col("g"), F.col("b"), F.when(hole, F.lit(0.0)).otherwise(F.lit(1.0)))
    out = match.auto_crop(rel.df, rel.width, rel.height)
    return out.select(F.round(F.col("w") * F.col("h"), 9).alias("area"))


#: A projective map that points of the fitting query follow.
TURNED = ((1.02, -0.13, 40.0), (0.08, 0.97, -25.0), (0.00004, -0.00002, 1.0))


#: Parts in a row that are the points of one frame.
FRAME_PARTS = 300


def point_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as points of frames, some hundreds in a row each, with the places where a map takes them; every third one is far off."""
    k = F.col("p_partkey")
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.floor(k / FRAME_PARTS).alias("a"), (F.floor(k / FRAME_PARTS) + 1).alias("b"), k, (k * 7919 % 1973).cast("double").alias("ax"), (k * 104729 % 1487).cast("double").alias("ay"))
    u, v, z = (F.col("ax") * F.lit(r[0]) + F.col("ay") * F.lit(r[1]) + F.lit(r[2]) for r in TURNED)
    off = F.when(k % 3 == 0, F.lit(60.0) + (k % 101).cast("double")).otherwise(F.lit(0.0))
    return df.select("a", "b", "ax", "ay", (u / z + off).alias("bx"), (v / z - off).alias("by"))


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = match.fitted_pairs(point_pairs(spark, sf_dir))
    return out.select("a", "b", "n", "inliers", *[F.round(F.col("h")[i], 6).alias(f"h{i}") for i in range(8)])


def strongest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as features of a frame a type, by value; the strongest hundred of each."""
    return match.strongest(events(spark, sf_dir).select(F.col("event_type").alias("frame_id"), F.col("event_id").alias("id"), (F.col("value") - F.lit(250.0)).alias("response")), 100).select("frame_id", "id")


def influence(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rel = picture(spark, sf_dir)
        return shown(views.influence(rel, run("color_grade", {"in": rel}, {"exposure": 0.4, "saturation": 40.0}), mode))

    return query


def cut_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What shows of the picture under a linear mask, cut to its bounds."""
    rel = picture(spark, sf_dir)
    mask = run("linear_mask", {"in": rel}, {"angle": 0.0, "position": 0.7, "span": 0.2})
    return views.cut(rel, 0.5, mask).select("y", "x", *[F.round(F.col(c) + F.lit(OFF), 6).alias(c) for c in "rgba"])


def exif_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("double")
    values = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(F.col("p_size") % 7 == 0, F.lit(0.0)).when(F.col("p_size") % 2 == 0, n / F.lit(4.0)).otherwise(F.lit(1.0) / (n * F.lit(5.0))).alias("s"), (n / F.lit(8.0)).alias("f"), (n * F.lit(3.7)).alias("mm"), ((n - F.lit(25.0)) / F.lit(8.0)).alias("ev"))
    return values.select("p_partkey", exif.shutter(F.col("s")).alias("shutter"), exif.aperture(F.col("f")).alias("aperture"), exif.focal(F.col("mm")).alias("focal"), exif.bias(F.col("ev")).alias("bias"))


def render_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph as one plan: a brighter picture where it is mid-grey, and its mean luma by row."""
    g = Graph.from_json('{"nodes": [{"id": "src", "type": "image_source"}, {"id": "m", "type": "luminance_range_mask", "params": {"low": 0.3, "high": 0.6}}, {"id": "e", "type": "exposure", "params": {"exposure": 1.0}}], "wires": [{"from": "src", "to": "m"}, {"from": "src", "to": "e"}, {"from": "m", "to": "e", "port": "mask"}]}')
    rel = g.render("e", {"src": picture(spark, sf_dir)})
    y = F.lit(0.2126) * F.col("r") + F.lit(0.7152) * F.col("g") + F.lit(0.0722) * F.col("b")
    return rel.df.groupBy("y").agg(F.round(F.avg(y), 6).alias("luma"), F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    out = dict(NODES)
    out |= {f"stack__{m}": stack_query(m) for m in stack.MODES}
    out |= {f"scene__{k}": in_scene(NODES[k]) for k in SCENE}
    out |= {"chroma_histogram": chroma_histogram, "region_coverage": region_coverage, "stack__shifts": shifts, "match__auto_crop": cropped, "match__fit": fitted, "match__strongest": strongest, "exif__texts": exif_texts, "view__cut": cut_out} | {f"view__influence_{m}": influence(m) for m in views.MODES}
    out |= {"lut": looked_up, "area_downscale": area_downscale, "noise_estimate": noise_estimate, "render_slice": render_slice}
    return out


__all__ = ["queries", "field_rel", "image_rel", "FIELD", "KEY"]
