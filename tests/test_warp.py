"""Drawn warps, curves with handles, colour by colour and non-local means against brute force and planted answers."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.frame import field_rel, image_rel
from rasterloom.functions import eq
from rasterloom.operators import detail, recolor, warp  # noqa: F401
from rasterloom.operators.node import run

PIXEL = "frame_id int, y int, x int, r double, g double, b double, a double"


def picture(spark, img):
    h, w, _ = img.shape
    rows = [(0, y, x, *map(float, img[y, x]), 1.0) for y in range(h) for x in range(w)]
    return image_rel(spark.createDataFrame(rows, PIXEL), w, h)


def pixels(rel):
    out = np.full((rel.height, rel.width, len(rel.channels)), np.nan)
    for q in rel.df.collect():
        out[q["y"], q["x"]] = [q[c] for c in rel.channels]
    assert not np.isnan(out).any()
    return out


def shapes(*items):
    return {"shapes": json.dumps(items)}


# -- warps --------------------------------------------------------------------
def test_a_grid_at_rest_and_shapes_that_only_hold_change_nothing(spark):
    rel = picture(spark, np.random.default_rng(0).random((6, 8, 3)))
    assert run("grid_warp", {"in": rel}) is rel
    assert run("shape_warp", {"in": rel}, shapes({"hold": True}, {"dx": 0.3, "enabled": False}, {"dx": 0.3, "amount": 0})) is rel
    assert run("layer_warp", {"in": rel}, {"mesh": "no json", "shapes": "[]"}) is rel


@pytest.mark.parametrize("name", ["grid_warp", "layer_warp", "layer_warp_mask"])
def test_what_pixels_read_is_never_broadcast(spark, name):
    """The table of reads comes from a few tiles and has several rows a pixel of the frame."""
    rel = picture(spark, np.random.default_rng(0).random((6, 8, 3)))
    rel = rel.field(F.col("r")) if name == "layer_warp_mask" else rel
    out = run(name, {"in": rel}, {"cols": 1.0, "rows": 1.0, "mesh": json.dumps([0, 0, 0, 0, 0.1, 0, 0.1, 0])})
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [sy#" in plan and "BroadcastHashJoin [sy#" not in plan


def test_no_frame_is_broadcast_to_another(spark, tmp_path):
    """A frame's file may be small, and its rows are many all the same: a weight, a mask, a second picture, what a place gathers."""
    from rasterloom.operators import combine, geometry, point  # noqa: F401

    picture(spark, np.random.default_rng(0).random((6, 8, 3))).df.write.parquet(f"{tmp_path}/frame")
    rel = image_rel(spark.read.parquet(f"{tmp_path}/frame"), 8, 6)
    plane = rel.field(F.col("r"))
    mesh = {"cols": 1.0, "rows": 1.0, "mesh": json.dumps([0, 0, 0, 0, 0.1, 0, 0.1, 0])}
    outs = [run("layer_warp", {"in": rel, "weight": plane}, mesh), run("exposure", {"in": rel, "mask": plane}, {"exposure": 1.0}), run("blend", {"base": rel, "blend": rel}, {}), run("transform", {"in": rel}, {"move_x": 3.0})]
    for out in outs:
        plan = out.df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan


@pytest.mark.parametrize("field", ["grid", "shapes", "turned"])
def test_places_read_from_what_is_carried_there(field):
    """Where a field doesn't fold, what a place reads from is carried to it."""
    if field == "shapes":
        f = warp.Shapes.read(json.dumps([{"cx": 0.4, "cy": 0.5, "radius": 0.3, "dx": 0.04, "scale": 1.15, "scale_y": 0.9, "angle": 12, "aspect": 1.6, "rotation": 30, "feather": 0.9}, {"cx": 0.9, "cy": 0.2, "radius": 0.3, "shape": "triangle", "dy": -0.01, "feather": 1}]))
    else:
        mesh = np.zeros((4, 5, 2))
        mesh[1, 2], mesh[2, 1] = (0.06, -0.04), (-0.03, 0.02)
        f = warp.Grid.read({"cols": 4, "rows": 3, "cols_u": "[0, 0.2, 0.5, 0.7, 1]", "rows_v": "", "mesh": json.dumps(mesh.ravel().tolist()), "lattice": "[0.9, 0.1, 0.02, -0.1, 0.9, 0.05]" if field == "turned" else ""})
    inverse = warp.Inverse(f, 90, 60)
    assert not inverse.cover.any()
    ys, xs = np.mgrid[:60, :90] + 0.5
    px, py = inverse.at_pixels(xs, ys)
    dx, dy = f.field(px / 90, py / 60, 1.5)
    assert np.abs(px / 90 + dx - xs / 90).max() < 1e-9 and np.abs(py / 60 + dy - ys / 60).max() < 1e-9


def test_the_spline_passes_through_its_handles():
    mesh = np.random.default_rng(1).random((4, 5, 2)) * 0.1
    g = warp.Grid.read({"cols": 4, "rows": 3, "cols_u": "", "rows_v": "", "mesh": json.dumps(mesh.ravel().tolist()), "lattice": ""})
    for j, i in itertools.product(range(4), range(5)):
        x, y = g.field(np.array([i / 4]), np.array([j / 3]), 1.0)
        assert np.allclose([x[0], y[0]], mesh[j, i])


def test_where_a_field_folds_the_one_carried_furthest_shows():
    f = warp.Shapes.read(json.dumps([{"cx": 0.35, "cy": 0.5, "radius": 0.15, "dx": 0.3}]))
    inverse = warp.Inverse(f, 120, 80)
    assert inverse.cover.any()
    v, u = np.meshgrid(np.linspace(0, 1, 1601), np.linspace(0, 1, 2401), indexing="ij")
    x, y = f.field(u, v, 1.5)
    for pu, pv in ((0.65, 0.5), (0.6, 0.55), (0.55, 0.45), (0.72, 0.5), (0.2, 0.2), (0.5, 0.5)):
        near = np.hypot(u + x - pu, v + y - pv) < 4e-3
        furthest = np.where(near, np.hypot(x * 1.5, y), -1).max()
        su, sv = inverse.sources(np.array([pu]), np.array([pv]))
        dx, dy = f.field(su, sv, 1.5)
        assert abs(su[0] + dx[0] - pu) < 1e-5 and abs(sv[0] + dy[0] - pv) < 1e-5
        assert math.hypot(dx[0] * 1.5, dy[0]) > furthest - 0.05


def test_pixels_do_not_depend_on_tiles(spark, monkeypatch):
    rel = picture(spark, np.random.default_rng(2).random((40, 60, 3)))
    params = shapes({"cx": 0.4, "cy": 0.5, "radius": 0.25, "dx": 0.2, "scale": 1.4}, {"cx": 0.8, "cy": 0.3, "radius": 0.15, "scale": 0.4})
    whole = pixels(run("shape_warp", {"in": rel}, params))
    monkeypatch.setattr(warp, "TILE", 16)
    assert np.allclose(pixels(run("shape_warp", {"in": rel}, params)), whole, atol=1e-9)


def test_a_squeezed_pixel_is_the_mean_of_what_it_covers(spark):
    """A shape far wider than the frame halves it: pixels are means of two by two, about."""
    img = np.repeat(np.random.default_rng(3).random((40, 40, 1)), 3, 2)
    out = pixels(run("shape_warp", {"in": picture(spark, img)}, shapes({"radius": 9, "feather": 0, "scale": 0.5})))[:, :, 0]
    means = img[:, :, 0].reshape(20, 2, 20, 2).mean(axis=(1, 3))
    inner = out[10:30, 10:30]
    assert np.abs(inner - means).mean() < 0.12 * 1.0 and np.corrcoef(inner.ravel(), means.ravel())[0, 1] > 0.9
    grown = pixels(run("shape_warp", {"in": picture(spark, img)}, shapes({"radius": 9, "feather": 0, "scale": 2})))[:, :, 0]
    assert grown.min() >= img.min() and grown.max() <= img.max()  # a cubic held within the pixels around


def test_a_mask_goes_where_the_picture_goes(spark):
    v = np.random.default_rng(4).random((24, 30))
    params = shapes({"cx": 0.4, "cy": 0.5, "radius": 0.3, "dx": 0.15, "angle": 20})
    mask = field_rel(spark.createDataFrame([(0, y, x, float(v[y, x])) for y in range(24) for x in range(30)], "frame_id int, y int, x int, v double"), 30, 24)
    moved = pixels(run("layer_warp_mask", {"in": mask}, params))[:, :, 0]
    whole = run("layer_warp", {"in": picture(spark, np.repeat(v[:, :, None], 3, 2))}, params)
    assert np.allclose(pixels(whole)[:, :, 0], moved, atol=1e-12)
    # a margin that goes on as the edge does changes nothing
    wide = np.pad(v, 6, mode="edge")
    beyond = field_rel(spark.createDataFrame([(0, y, x, float(wide[y, x])) for y in range(36) for x in range(42)], "frame_id int, y int, x int, v double"), 42, 36)
    assert np.allclose(pixels(run("layer_warp_mask", {"in": mask, "beyond": beyond}, params))[:, :, 0], moved, atol=1e-6)
    ones = field_rel(mask.df.withColumn("v", F.lit(1.0)), 30, 24)
    weighed = run("layer_warp", {"in": picture(spark, np.repeat(v[:, :, None], 3, 2)), "weight": ones}, params)
    assert np.allclose(pixels(weighed)[:, :, 0], moved, atol=1e-9)


def test_a_picture_has_room_around_it(spark):
    img = np.random.default_rng(5).random((10, 20, 3))
    out = run("layer_warp", {"in": picture(spark, img)}, {"space": "picture", "room": 25.0, **shapes({"radius": 9, "feather": 0, "dx": 0.2})})
    got = pixels(out)
    assert got.shape == (16, 30, 4)
    assert np.allclose(got[3:13, 9:29, :3], img, atol=1e-6) and np.allclose(got[3:13, 9:29, 3], 1, atol=1e-6)  # moved by a fifth of its width
    assert np.allclose(got[:, :8], 0)


# -- curves with handles ------------------------------------------------------
def test_curves_with_handles(spark):
    points = eq.read('[{"x": 5, "y": 2, "l": [-1, 3]}, {"x": 0, "y": 1, "r": [2, 4]}, {"x": 9, "y": -1, "l": [-9, 0]}, {"x": 12, "y": 0}]')
    assert [p.x for p in points] == [0, 5, 9, 12] and eq.read("none") == eq.read("{}") == []
    xs = [-1, 0, 0.3, 2, 4.9, 5, 6, 8.5, 9, 11, 12, 14]
    for curve in (points, eq.bent(points, "smooth"), eq.bent(points, "linear"), eq.around(points[:2], 20)):
        df = spark.createDataFrame([(float(x),) for x in xs], "x double")
        for q in df.select("x", eq.value(curve, F.col("x")).alias("v")).collect():
            assert math.isclose(q["v"], eq.value_at(curve, q["x"]), abs_tol=1e-12)
    straight = eq.bent(points, "linear")
    assert math.isclose(eq.value_at(straight, 7), 0.5) and math.isclose(eq.value_at(straight, 2.5), 1.5)
    # a handle's curve: a point of it by its parameter
    t, (a, b, c, d_) = 0.37, (0, 2, 4, 5)
    bez = lambda p: (1 - t) ** 3 * p[0] + 3 * t * (1 - t) ** 2 * p[1] + 3 * t * t * (1 - t) * p[2] + t**3 * p[3]
    assert math.isclose(eq.value_at(points, bez((a, b, c, d_))), bez((1, 5, 5, 2)), rel_tol=1e-6)


# -- colour by colour ---------------------------------------------------------
def lch(rgb):
    m1 = np.array([[0.41222147, 0.53633254, 0.05144599], [0.2119035, 0.68069955, 0.10739696], [0.08830246, 0.28171884, 0.6299787]])
    m2 = np.array([[0.21045426, 0.79361779, -0.004072047], [1.9779985, -2.4285922, 0.4505937], [0.025904037, 0.78277177, -0.80867577]])
    light, a, b = m2 @ np.cbrt(m1 @ np.array(rgb))
    return light, math.hypot(a, b), math.degrees(math.atan2(b, a)) % 360


def test_a_hue_is_turned_and_grey_is_left(spark):
    img = np.array([[[0.5, 0.2, 0.1], [0.3, 0.3, 0.3], [0.1, 0.2, 0.5]]])
    out = pixels(run("recolor", {"in": picture(spark, img)}, {"curves": json.dumps({"hue_hue": [{"x": 0, "y": 30}, {"x": 120, "y": 30}, {"x": 200, "y": 0}, {"x": 330, "y": 0}]}), "smoothing": 0.0}))
    before, after = lch(img[0, 0]), lch(out[0, 0, :3])
    turn = eq.value_at(eq.around(eq.read([{"x": 0, "y": 30}, {"x": 120, "y": 30}, {"x": 200, "y": 0}, {"x": 330, "y": 0}]), 360.0), before[2])
    assert np.allclose(after[:2], before[:2], atol=1e-5) and math.isclose(after[2], before[2] + turn, abs_tol=1e-3)
    assert np.allclose(out[0, 1, :3], 0.3, atol=1e-5)


def test_light_is_a_gain_and_what_is_missing_is_nothing(spark):
    rel = picture(spark, np.array([[[0.5, 0.2, 0.1], [0.1, 0.4, 0.2]]]))
    out = pixels(run("recolor", {"in": rel}, {"curves": json.dumps({"sat_lum": [{"x": 0, "y": 1}, {"x": 100, "y": 1}]})}))
    assert np.allclose(out[:, :, :3], 2 * pixels(rel)[:, :, :3], atol=1e-5)
    for idle in ({}, {"curves": "no"}, {"curves": json.dumps({"depth_lum": [{"x": 0, "y": 1}, {"x": 9, "y": 1}]})}, {"pairs": '[{"a": {}}]'}, {"surfaces": '{"huelum_sat": [[1]]}'}):
        assert run("recolor", {"in": rel}, idle) is rel


# -- non-local means ----------------------------------------------------------
@pytest.mark.parametrize("mode", ["knn", "nlm"])
def test_non_local_means_pixel_by_pixel(spark, mode, monkeypatch):
    r, (h, w) = np.random.default_rng(6), (9, 11)
    img = 0.4 + 0.03 * r.random((h, w, 3)) + 0.3 * (np.arange(w) > 5)[None, :, None]
    at = lambda y, x: img[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    block, h2 = (2 if mode == "nlm" else 0), (0.008 + 0.1 * 0.25) ** 2
    offsets = list(itertools.product(range(-block, block + 1), repeat=2))
    want = np.zeros_like(img)
    for y, x in itertools.product(range(h), range(w)):
        total, acc, agree = 0.0, np.zeros(3), 0
        for dy, dx in itertools.product(range(-3, 4), repeat=2):
            d2 = np.mean([((at(y + a, x + b) - at(y + a + dy, x + b + dx)) ** 2).mean() for a, b in offsets])
            k = math.exp(-d2 / h2)
            total, acc, agree = total + k, acc + k * at(y + dy, x + dx), agree + (k > 0.36)
        want[y, x] = img[y, x] + (acc / total - img[y, x]) * min(1, agree / 49 / 0.66) ** 2
    rel = picture(spark, img)
    assert np.allclose(pixels(run("nlm_denoise", {"in": rel}, {"strength": 50.0, "mode": mode}))[:, :, :3], want, atol=1e-12)
    assert run("nlm_denoise", {"in": rel}) is rel
