"""Painted layers: what strokes lay, read, repair and take away."""

import itertools
import json

import numpy as np
import pytest

from rasterloom.frame import image_rel
from rasterloom.operators import paint as painting
from rasterloom.operators.node import EngineError, run

PIXEL = "frame_id int, y int, x int, r double, g double, b double, a double"


def picture(spark, img):
    h, w, _ = img.shape
    rows = [(f, y, x, *map(float, img[y, x]), 1.0) for f in (0, 1) for y in range(h) for x in range(w)]
    return image_rel(spark.createDataFrame(rows, PIXEL), w, h)


def painted(spark, img, *strokes, node="paint", **params):
    out = run(node, {"in": picture(spark, img)}, {"strokes": json.dumps(strokes), **params})
    got = np.full((2, *img.shape[:2], 4), np.nan)
    for q in out.df.collect():
        got[q["frame_id"], q["y"], q["x"]] = [q[c] for c in "rgba"]
    assert not np.isnan(got).any() and np.allclose(got[0], got[1])
    return got[0]


GREY = np.full((16, 16, 3), 0.2)


def test_paint_lies_where_the_stroke_went_and_nowhere_else(spark):
    got = painted(spark, GREY, {"points": [[0.5, 0.5]], "radius": 0.25, "hardness": 1.0, "flow": 1.0, "color": "#ff8000"})
    assert np.allclose(got[8, 8], [1, 128 / 255, 0, 1], atol=1e-6) and got[0, 0, 3] == 0
    half = painted(spark, GREY, {"points": [[0.5, 0.5]], "radius": 0.25, "hardness": 1.0, "flow": 0.5, "color": "#ffffff"}, {"points": [[0.5, 0.5]], "radius": 0.25, "hardness": 1.0, "flow": 0.5, "color": "#000000"})
    assert np.allclose(half[8, 8], [1 / 3, 1 / 3, 1 / 3, 0.75])  # one coat over another


def test_a_stroke_keeps_the_selection_it_was_painted_under(spark):
    left = json.dumps([{"kind": "marquee", "op": "replace", "x0": 0.0, "y0": 0.0, "x1": 0.5, "y1": 1.0, "shape": "rect"}])
    dab = {"points": [[0.5, 0.5]], "radius": 0.5, "hardness": 1.0, "color": "#ffffff"}
    free, held = painted(spark, GREY, dab), painted(spark, GREY, dab | {"clip": left})
    assert free[8, 4, 3] > 0.9 and free[8, 12, 3] > 0.9 and held[8, 4, 3] > 0.9 and held[8, 12, 3] == 0


def test_erasing_lifts_paint_off_again(spark):
    got = painted(spark, GREY, {"points": [[0.5, 0.5]], "radius": 0.4, "hardness": 1.0, "color": "#ffffff"}, {"points": [[0.5, 0.5]], "radius": 0.2, "hardness": 1.0, "erase": True})
    assert got[8, 8, 3] < 0.05 and got[3, 8, 3] > 0.9


def test_a_blend_meets_two_colours_in_a_gradient(spark):
    two = [{"points": [[0.38, 0.5]], "radius": 0.12, "hardness": 1.0, "color": "#ff0000"}, {"points": [[0.62, 0.5]], "radius": 0.12, "hardness": 1.0, "color": "#0000ff"}]
    img = np.zeros((40, 40, 3))
    plain, got = painted(spark, img, *two), painted(spark, img, *two, {"points": [[0.5, 0.5]], "radius": 0.2, "hardness": 1.0, "blend": True})
    assert plain[20, 19, 0] > 0.9 and plain[20, 20, 2] > 0.9
    line = got[20, 16:25]
    assert (np.diff(line[:, 0]) < 1e-9).all() and (np.diff(line[:, 2]) > -1e-9).all() and 0.1 < line[4, 0] < 0.9 and 0.1 < line[4, 2] < 0.9


def test_softening_reads_below_and_builds_only_if_told(spark):
    img = np.zeros((30, 30, 3))
    img[:, 15:] = 1.0
    dab = {"points": [[0.5, 0.5]], "radius": 0.3, "hardness": 1.0, "blur": True, "blur_strength": 0.3}
    once, twice = painted(spark, img, dab), painted(spark, img, dab, dab)
    assert np.allclose(once, twice, atol=1e-9) and 0.3 < once[15, 14, 0] < 0.5
    built = painted(spark, img, dab | {"blur_build": True}, dab | {"blur_build": True})
    assert built[15, 12, 0] > once[15, 12, 0] + 0.02
    nothing = painted(spark, img, dab | {"sample_layer": True})  # an empty layer has nothing to soften
    assert (nothing[:, :, 3] == 0).all()


def test_clones_read_elsewhere_and_repairs_keep_the_ground(spark):
    r = np.random.default_rng(1)
    img = r.random((32, 40, 3)) * 0.5
    stroke = {"points": [[0.3, 0.5]], "radius": 0.15, "hardness": 1.0, "src_dx": 0.25, "src_dy": -0.125}
    got = painted(spark, img, stroke, node="clone")
    for y, x in itertools.product(range(32), range(40)):
        if got[y, x, 3] > 0.999:
            assert np.allclose(got[y, x, :3], img[y - 4, x + 10], atol=1e-9)
    assert painted(spark, img, stroke | {"src_dx": 5.0})[:, :, 3].max() == 0  # off the frame there is nothing
    assert painted(spark, img, {"points": [[0.3, 0.5]], "radius": 0.1}, heal=True)[:, :, 3].max() == 0  # a repair without a source
    # texture from there, shading from here
    ys, xs = np.mgrid[:32, :40]
    ground = np.repeat((0.2 + 0.012 * xs)[:, :, None], 3, 2)
    texture = np.repeat((0.03 * ((ys + xs) % 2))[:, :, None], 3, 2)
    marked = ground + texture
    marked[14:18, 10:14] += 0.3
    healed = painted(spark, marked, stroke | {"heal": True})
    solid = healed[:, :, 3] > 0.999
    assert solid[16, 12] and np.abs(healed[solid][:, :3] - (ground + texture)[solid]).max() < 0.02
    assert np.abs(painted(spark, marked, stroke)[solid][:, :3] - (ground + texture)[solid]).max() > 0.1


def test_a_repair_solves_its_equations():
    r = np.random.default_rng(3)
    inside = np.zeros((9, 11), bool)
    inside[2:7, 3:9] = r.random((5, 6)) < 0.8
    frame, reads = np.ones_like(inside), r.random(inside.shape) < 0.9
    frame[:, 0] = False
    dest, source = r.random((9, 11, 3)), r.random((9, 11, 3))
    v = painting.healed(inside, frame, dest, source, reads)
    for y, x in np.argwhere(inside):
        near = [(y + a, x + b) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)) if frame[y + a, x + b]]
        want = sum(v[q] + (source[y, x] - source[q] if reads[y, x] and reads[q] else 0) for q in near)
        assert np.allclose(len(near) * v[y, x], want, atol=1e-6)
    assert np.allclose(v[~inside], dest[~inside])


def test_a_copy_of_the_layer_reads_it_as_it_was(spark):
    dot = {"points": [[0.25, 0.5]], "radius": 0.1, "hardness": 1.0, "color": "#00ff00"}
    got = painted(spark, GREY, dot, {"points": [[0.5, 0.5]], "radius": 0.1, "hardness": 1.0, "src_dx": -0.25, "sample_layer": True}, {"points": [[0.75, 0.5]], "radius": 0.1, "hardness": 1.0, "src_dx": -0.25, "sample_layer": True})
    assert np.allclose(got[8, 8, :2], [0, 1]) and np.allclose(got[8, 12, :2], [0, 1])


def test_many_strokes_are_one_plan(spark):
    r = np.random.default_rng(5)
    strokes = [{"points": r.random((3, 2)).tolist(), "radius": 0.08, "hardness": 0.6, "flow": 0.7, "color": f"#{r.integers(0, 1 << 24):06x}", "erase": bool(k % 7 == 0), "brush": "square" if k % 3 == 0 else ""} for k in range(120)]
    rel = picture(spark, np.zeros((20, 24, 3)))
    plans = [len(run("paint", {"in": rel}, {"strokes": json.dumps(s)}).df._jdf.queryExecution().optimizedPlan().toString().split("\n")) for s in (strokes[:2], strokes)]
    assert plans[0] == plans[1]
    got = painted(spark, np.zeros((20, 24, 3)), *strokes)
    canvas = np.zeros((20, 24, 4))
    for s in strokes:
        stroke = painting.Stroke.read(s)
        c = painting.drawn(stroke, 0, 19, 0, 23, 24, 20)[0][:, :, None]
        if stroke.erase:
            canvas[:, :, 3:] *= 1 - c
            continue
        full = c + canvas[:, :, 3:] * (1 - c)
        canvas[:, :, :3] = np.where(c > 0, (np.array(stroke.rgb()) * c + canvas[:, :, :3] * canvas[:, :, 3:] * (1 - c)) / np.maximum(full, 1e-6), canvas[:, :, :3])
        canvas[:, :, 3:] = np.where(c > 0, full, canvas[:, :, 3:])
    assert np.allclose(got, canvas, atol=1e-9)


def test_strokes_that_are_none(spark):
    assert painted(spark, GREY)[:, :, 3].max() == painted(spark, GREY, {"points": [], "radius": 0.1})[:, :, 3].max() == 0
    with pytest.raises(EngineError):
        run("paint", {"in": picture(spark, GREY)}, {"strokes": '[{"radius": 1}]'})
