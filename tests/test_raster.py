"""Rules of the nodes on tiny frames worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, Rel, field_rel, image_rel
from rasterloom.operators import combine, detail, geometry, masks, point, select, spatial, stack  # noqa: F401
from rasterloom.operators.node import REGISTRY, EngineError, run


def picture(spark, rows):
    """Rows of pixels, each a number (grey) or (r, g, b, a)."""
    data = [(0, y, x, *(map(float, p if isinstance(p, tuple) else (p, p, p, 1.0)))) for y, row in enumerate(rows) for x, p in enumerate(row)]
    return image_rel(spark.createDataFrame(data, "frame_id int, y int, x int, r double, g double, b double, a double"), len(rows[0]), len(rows))


def plane(spark, rows):
    data = [(0, y, x, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return field_rel(spark.createDataFrame(data, "frame_id int, y int, x int, v double"), len(rows[0]), len(rows))


def values(rel: Rel, channel=None):
    c = channel or ("v" if rel.kind == FIELD else "r")
    out = [[None] * rel.width for _ in range(rel.height)]
    for r in rel.df.collect():
        out[r.y][r.x] = r[c]
    return out


def test_gain_doubles_and_zero_hands_through(spark):
    p = picture(spark, [[0.1, 0.2], [0.3, (0.1, 0.2, 0.3, 0.5)]])
    assert values(run("exposure", {"in": p}, {"exposure": 1.0})) == [[0.2, 0.4], [0.6, 0.2]]
    assert run("exposure", {"in": p}) is p


def test_contrast_keeps_middle_grey(spark):
    out = values(run("exposure", {"in": picture(spark, [[0.18, 0.5, 0.05]])}, {"contrast": 60.0}))[0]
    assert out[0] == pytest.approx(0.18, abs=1e-6) and out[1] > 0.5 and out[2] < 0.05


def test_mask_limits_a_node_and_another_size_does_nothing(spark):
    p, m = picture(spark, [[0.1, 0.1]]), plane(spark, [[0.0, 0.5]])
    assert values(run("exposure", {"in": p, "mask": m}, {"exposure": 1.0}))[0] == pytest.approx([0.1, 0.15])
    assert run("exposure", {"in": p, "mask": plane(spark, [[1.0]])}, {"exposure": 1.0}) is p
    assert values(run("exposure", {"in": p, "mask": plane(spark, [[float("nan"), 1.0]])}, {"exposure": 1.0}))[0] == pytest.approx([0.1, 0.2])


def test_disabled_nodes(spark):
    p, f = picture(spark, [[0.2]]), plane(spark, [[0.4]])
    assert run("exposure", {"in": p}, {"exposure": 1.0}, enabled=False) is p
    grey = run("channel_join", {"r": f}, enabled=False)
    assert grey.kind == IMAGE and values(grey, "g") == [[0.4]]


def test_parameters_are_checked(spark):
    p = picture(spark, [[0.2]])
    with pytest.raises(EngineError):
        run("exposure", {"in": p}, {"nothing": 1})
    with pytest.raises(EngineError):
        run("exposure", {"in": p}, {"exposure": float("nan")})
    with pytest.raises(EngineError):
        run("exposure", {})
    with pytest.raises(EngineError):
        run("compare", {"in": plane(spark, [[0.1]])}, {"op": "like"})
    assert values(run("tone_mask", {"in": p}, {"range": " Bell "})) == values(run("tone_mask", {"in": p}, {"range": "bell"}))


def test_logic_with_one_side_open_and_sizes_that_differ(spark):
    f = plane(spark, [[0.3]])
    assert run("logic", {"fg": f}) is f
    with pytest.raises(EngineError):
        run("logic", {"in": f, "fg": plane(spark, [[0.1, 0.2]])})
    assert values(run("math", {"in": f}, {"op": "divide", "constant": 0.0})) == [[0.0]]


def test_display_pair_is_a_round_trip(spark):
    p = picture(spark, [[0.0, 0.001, 0.2, 1.0, 3.0]])  # a display ends at white; only a reference gives back what was above
    assert values(run("to_scene", {"in": run("to_display", {"in": p})}))[0] == pytest.approx([0.0, 0.001, 0.2, 1.0, 1.0])
    assert values(run("to_scene", {"in": run("to_display", {"in": p}), "reference": p}))[0] == pytest.approx([0.0, 0.001, 0.2, 1.0, 3.0])
    split = {k: run("luma_chroma_split", {"in": picture(spark, [[(0.1, 0.5, 0.3, 1)]])}, {"part": k}) for k in ("luma", "color")}
    assert values(run("luma_chroma_join", {"in": split["luma"], "chroma": split["color"]}), "g")[0] == pytest.approx([0.5])


def test_over_transparent_base(spark):
    base, top = picture(spark, [[(0.2, 0.2, 0.2, 0.0), (0.2, 0.2, 0.2, 1.0)]]), picture(spark, [[(0.8, 0.8, 0.8, 0.5), (0.8, 0.8, 0.8, 0.5)]])
    out = run("blend", {"base": base, "blend": top})
    assert values(out)[0] == pytest.approx([0.8, 0.5]) and values(out, "a")[0] == pytest.approx([0.5, 1.0])
    assert values(run("blend", {"base": base, "blend": top}, {"opacity": 0.0}))[0] == pytest.approx([0.0, 0.2])
    assert run("blend", {"base": base}) is base
    assert values(run("blend", {"base": base, "blend": top}, {"mode": "multiply", "adjustment": True}))[0] == pytest.approx([0.16, 0.16])


def test_box_edges_are_clamped(spark):
    p = plane(spark, [[0.0, 3.0, 6.0]])
    assert values(spatial.box_mean(p, 1))[0] == pytest.approx([1.0, 3.0, 5.0])
    assert values(spatial.truncated_mean(p, 1))[0] == pytest.approx([1.5, 3.0, 4.5])
    assert values(spatial.box_mean(p, 9))[0] == pytest.approx(values(spatial.box_mean(p, 2))[0])


def test_gaussian_keeps_flat_frames_and_sums(spark):
    flat = plane(spark, [[0.4] * 5] * 4)
    assert all(v == pytest.approx(0.4) for row in values(spatial.gaussian(flat, 1.0)) for v in row)
    point_ = plane(spark, [[1.0 if (x, y) == (4, 4) else 0.0 for x in range(9)] for y in range(9)])
    assert sum(map(sum, values(spatial.gaussian(point_, 0.8)))) == pytest.approx(1.0)


def test_transparent_pixels_do_not_bleed(spark):
    p = picture(spark, [[(1, 1, 1, 1), (9, 9, 9, 0), (1, 1, 1, 1)]])
    assert values(run("blur", {"in": p}, {"radius": 1.0, "kind": "box"}))[0] == pytest.approx([1.0, 1.0, 1.0])


def test_hot_pixel_goes_and_the_border_stays(spark):
    p = picture(spark, [[5.0, 0.1, 0.1], [0.1, 5.0, 0.1], [0.1, 0.1, 0.1]])
    assert values(run("hot_pixel", {"in": p})) == [[5.0, 0.1, 0.1], [0.1, 0.1, 0.1], [0.1, 0.1, 0.1]]


def test_guided_filter_keeps_a_flat_frame_and_edges(spark):
    flat = picture(spark, [[0.3] * 6] * 6)
    assert all(v == pytest.approx(0.3, abs=1e-9) for row in values(run("guided_filter", {"in": flat}, {"radius": 2.0})) for v in row)
    step = picture(spark, [[0.1] * 6 + [0.8] * 6] * 6)
    out = values(run("guided_filter", {"in": step}, {"radius": 2.0, "epsilon": 1e-6}))[3]
    assert out[5] == pytest.approx(0.1, abs=0.01) and out[6] == pytest.approx(0.8, abs=0.01)


def test_turns_flips_and_cuts_are_exact(spark):
    p = plane(spark, [[1, 2, 3], [4, 5, 6]])
    g = picture(spark, [[1, 2, 3], [4, 5, 6]])
    assert values(run("crop_rotate", {"in": g}, {"turn": 1.0})) == [[4, 1], [5, 2], [6, 3]]
    assert values(run("crop_rotate", {"in": g}, {"turn": 3.0})) == [[3, 6], [2, 5], [1, 4]]
    assert values(run("crop_rotate", {"in": g}, {"flip_h": 1.0})) == [[3, 2, 1], [6, 5, 4]]
    four = run("crop_rotate", {"in": run("crop_rotate", {"in": g}, {"turn": 2.0})}, {"turn": 2.0})
    assert values(four) == values(g)
    assert values(geometry.moved(p, 2, 1, F.col("x") - 1, F.col("y") - 1)) == [[5, 6]]


def test_whole_shifts_are_exact_and_off_the_frame_is_transparent(spark):
    g = picture(spark, [[0.1, 0.2, 0.3, 0.4]])
    out = run("transform", {"in": g}, {"move_x": 25.0})
    assert values(out)[0] == pytest.approx([0.0, 0.1, 0.2, 0.3]) and values(out, "a")[0] == pytest.approx([0, 1, 1, 1])
    shift = plane(spark, [[1.0] * 4])
    assert values(run("displacement_map", {"in": g, "x": shift}, {"strength": 1.0}))[0] == pytest.approx([0.1, 0.1, 0.2, 0.3])
    half = values(run("displacement_map", {"in": g, "x": plane(spark, [[0.75] * 4])}, {"strength": 1.0}))[0]
    assert half == pytest.approx([0.1, 0.15, 0.25, 0.35])


def test_perspective_without_keystone_is_a_zoom(spark):
    g = picture(spark, [[0.1 * (x + y) for x in range(6)] for y in range(6)])
    assert run("perspective", {"in": g}) is g
    out = values(run("perspective", {"in": g}, {"zoom": 100.0}))
    assert out[2][2] + out[3][3] == pytest.approx(0.1 * (2 + 2) + 0.1 * (3 + 3), abs=1e-9)


def test_stack_leaves_out_what_is_not_finite(spark):
    rows = [(f, 0, 0, v) for f, v in enumerate([1.0, 3.0, float("nan"), float("inf"), None])] + [(0, 0, 1, float("nan"))]
    df = spark.createDataFrame(rows, "frame_id int, y int, x int, v double")
    got = {m: {r.x: r.v for r in stack.merge_frames(df, m, ["v"]).collect()} for m in ("mean", "median", "max", "min")}
    assert got == {"mean": {0: 2.0, 1: 0.0}, "median": {0: 2.0, 1: 0.0}, "max": {0: 3.0, 1: 0.0}, "min": {0: 1.0, 1: 0.0}}


def test_hdr_weighs_by_noise_and_falls_back_to_the_brightest(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.2), (1, 0, 0, 0.4), (0, 0, 1, 0.99), (1, 0, 1, 0.99)], "frame_id int, y int, x int, v double")
    got = {r.x: r.v for r in stack.merge_frames(df, "hdr", ["v"], exposures={0: 1.0, 1: 2.0}).collect()}
    anchor = math.sqrt(2.0)
    assert got[0] == pytest.approx(0.2 * anchor) and got[1] == pytest.approx(0.99 * anchor)
    assert stack.anchor([1.0, 4.0, 2.0]) == 2.0 and stack.anchor([]) == 1.0


def test_exposures_from_samples():
    base = [0.05 * k for k in range(1, 17)]
    got = stack.exposure_ratios({"a": base, "b": [2 * v for v in base], "c": [0.5 * v for v in base]})
    assert got == pytest.approx({"a": 1.0, "b": 2.0, "c": 0.5})


def test_noise_of_a_flat_frame_is_nothing(spark):
    out = stack.noise_levels(picture(spark, [[0.3] * 8] * 8), tile=4, least=1).collect()[0]
    assert out.luma_sigma == pytest.approx(0, abs=1e-9) and out.chroma_sigma == pytest.approx(0, abs=1e-9)


def test_every_node_declares_itself():
    assert len(REGISTRY) > 70
    for name, spec in REGISTRY.items():
        assert spec.name == name and spec.gives in (IMAGE, FIELD)
        for key, p in spec.params.items():
            assert p.read(p.default, key, name) == p.default


def test_selections_fold_in_order(spark):
    p = picture(spark, [[0.2] * 8] * 8)
    half = '{"kind": "marquee", "x0": 0, "y0": 0, "x1": 0.5, "y1": 1}'
    top = '{"kind": "path", "op": "%s", "points": [[0, 0], [1, 0], [1, 0.5], [0, 0.5]]}'
    want = {"add": 48, "subtract": 16, "intersect": 16, "replace": 32}
    for op, n in want.items():
        assert sum(map(sum, values(run("selection_mask", {"in": p}, {"regions": f"[{half}, {top % op}]"})))) == n
    assert sum(map(sum, values(run("selection_mask", {"in": p}, {"regions": f"[{half}]", "invert": True})))) == 32
    stroke = '{"points": [[0, 0.5], [1, 0.5]], "radius": 0.2, "hardness": 0.9}'
    painted = values(run("brush_mask", {"in": p}, {"strokes": f"[{stroke}]"}))
    assert painted[4][4] == 1 and painted[0][0] == 0
    gone = values(run("brush_mask", {"in": p}, {"strokes": f'[{stroke}, {stroke[:-1]}, "erase": true}}]'}))
    assert gone[4][4] == 0 and max(map(max, gone)) <= 0.25
    with pytest.raises(EngineError):
        run("selection_mask", {"in": p}, {"regions": "{"})


def test_console_leaves_other_hues_alone(spark):
    p = picture(spark, [[(0.5, 0.1, 0.1, 1), (0.1, 0.1, 0.5, 1), (0.3, 0.3, 0.3, 1)]])
    out = run("color_console", {"in": p}, {"bands": '[{"id": "red", "center": 25, "width": 40, "lum": 1.0}]', "smoothing": 0.0})
    assert values(out)[0] == pytest.approx([1.0, 0.1, 0.3], abs=0.02)


def test_frames_round_trip(spark, tmp_path):
    from rasterloom.sources.frames import read_frames, write_frames

    p = picture(spark, [[0.1 * y] * 3 for y in range(6)])
    write_frames(p, str(tmp_path / "f"), band_rows=2)
    assert values(read_frames(spark, str(tmp_path / "f"), IMAGE, 3, 6)) == values(p)
    assert read_frames(spark, str(tmp_path / "f"), IMAGE, 3, 6, rows=(3, 3), band_rows=2).df.count() == 3


def test_distance_and_cubes(spark, tmp_path):
    m = plane(spark, [[0, 0, 1, 1, 1, 1]])
    assert values(run("distance_field", {"in": m}, {"max_distance": 2.0}))[0] == pytest.approx([0.125, 0.375, 0.625, 0.875, 1.0, 1.0])
    lines = ["LUT_3D_SIZE 2"] + [f"{1 - r} {1 - g} {1 - b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)]
    (tmp_path / "n.cube").write_text("\n".join(lines))
    display = run("to_scene", {"in": picture(spark, [[0.25, 0.75]])})
    out = run("to_display", {"in": run("lut", {"in": display}, {"path": str(tmp_path / "n.cube")})})
    assert values(out)[0] == pytest.approx([0.75, 0.25])


def test_lookup_tables_in_line_and_joined(spark, tmp_path, monkeypatch):
    import numpy as np

    from rasterloom.operators import detail

    r = np.random.default_rng(7)
    n, entries = 5, r.random((125, 3))
    (tmp_path / "t.cube").write_text("\n".join(["LUT_3D_SIZE 5", *(" ".join(map(str, e)) for e in entries)]))
    img = [[float(v) for v in r.random(6)] for _ in range(4)]
    rel = picture(spark, img)
    rel = rel.image(F.col("r"), F.col("r") * F.col("r"), F.lit(1.0) - F.col("r"))
    rows = lambda: {(q.y, q.x): (q.r, q.g, q.b) for q in run("lut", {"in": rel}, {"path": str(tmp_path / "t.cube")}).df.collect()}
    inline = rows()
    monkeypatch.setattr(detail, "INLINE_SIZE", 1)
    joined = rows()
    enc = lambda v: v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
    dec = lambda v: v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4
    grid = entries.reshape(n, n, n, 3)
    for (y, x), got in inline.items():
        v = img[y][x]
        at = [enc(c) * (n - 1) for c in (v, v * v, 1 - v)]
        low = [min(int(c), n - 2) for c in at]
        want = sum(np.prod([(c - i) if d else 1 - (c - i) for c, i, d in zip(at, low, ds, strict=True)]) * grid[low[2] + ds[2], low[1] + ds[1], low[0] + ds[0]] for ds in np.ndindex(2, 2, 2))
        assert got == pytest.approx([dec(c) for c in want], abs=1e-12) and joined[y, x] == pytest.approx(got, abs=1e-12)
