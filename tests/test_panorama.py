"""Regions, feature points, cameras, seams and bands against brute force and planted answers."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.frame import image_rel
from rasterloom.operators import features, match, panorama, regions, tiles

PIXEL = "frame_id int, y int, x int, r double, g double, b double, a double"


def picture(spark, *frames):
    h, w = frames[0].shape[:2]
    rows = [(k, y, x, *(map(float, f[y, x]) if f.ndim == 3 else [float(f[y, x])] * 3), 1.0) for k, f in enumerate(frames) for y in range(h) for x in range(w)]
    return image_rel(spark.createDataFrame(rows, PIXEL), w, h)


# -- regions ------------------------------------------------------------------
def brute_regions(img, k, least):
    h, w, _ = img.shape
    gap = lambda p, q: float(np.sqrt(((p - q) ** 2).sum()))
    edges = [(gap(img[y, x], img[y, x + 1]), 2 * (y * w + x), y * w + x, y * w + x + 1) for y in range(h) for x in range(w - 1)]
    edges = sorted(edges + [(gap(img[y, x], img[y + 1, x]), 2 * (y * w + x) + 1, y * w + x, y * w + x + w) for y in range(h - 1) for x in range(w)])
    top, size, bar = list(range(h * w)), [1] * (h * w), [k] * (h * w)

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for merging in (True, False):
        for gap_, _, a, b in edges:
            a, b = find(a), find(b)
            if a != b and (gap_ <= min(bar[a], bar[b]) if merging else min(size[a], size[b]) < least):
                top[b], size[a] = a, size[a] + size[b]
                bar[a] = gap_ + k / size[a]
    return [find(i) for i in range(h * w)]


def test_the_plan_of_regions_grows_by_a_step_a_level(spark, monkeypatch):
    monkeypatch.setattr(regions, "TILE", 2)
    plans = []
    for n in (8, 32):  # two levels and four
        labels = regions.segment(picture(spark, np.random.default_rng(0).random((n, n, 3))), 0.5, 7)
        plans.append(labels._jdf.queryExecution().optimizedPlan())
    assert len({p.toString().count("Join ") for p in plans}) == 1
    assert len(str(plans[1].stats().sizeInBytes())) < 40


@pytest.mark.parametrize("kind", ["noise", "ties", "slope"])
def test_regions_are_those_of_one_pass_over_all_edges(spark, monkeypatch, kind):
    monkeypatch.setattr(regions, "TILE", 8)
    r, (h, w) = np.random.default_rng(3), (21, 34)
    img = r.random((h, w, 3)) * 0.2 + (np.arange(w) > w // 2)[None, :, None] * 0.5
    if kind == "ties":
        img = np.round(img, 1)
    if kind == "slope":
        img = np.linspace(0, 1, w)[None, :, None] + r.random((h, w, 3)) * 0.01
    found = regions.segment(picture(spark, img, img[::-1]), 0.5, 7).collect()
    assert len(found) == 2 * h * w
    for frame, pixels in enumerate((img, img[::-1])):
        got = {(q["y"], q["x"]): q["label"] for q in found if q["frame_id"] == frame}
        want = brute_regions(pixels, 0.5, 7)
        pairs = {(want[y * w + x], got[y, x]) for y in range(h) for x in range(w)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1


def test_reduced_picture_holds_means(spark):
    img = np.random.default_rng(1).random((7, 10, 3))
    small = regions.reduced(picture(spark, img), 5)
    assert (small.width, small.height) == (5, 3)
    got = {(q["y"], q["x"]): q["r"] for q in small.df.collect()}
    for y, x in itertools.product(range(3), range(5)):
        own = [img[j, i, 0] for j in range(7) for i in range(10) if (j * 3 // 7, i * 5 // 10) == (y, x)]
        assert math.isclose(got[y, x], sum(own) / len(own))


# -- feature points -----------------------------------------------------------
def blobs(h, w, places):
    ys, xs = np.mgrid[:h, :w]
    return 0.05 + sum(0.6 * np.exp(-((xs - x) ** 2 + (ys - y) ** 2) / (2 * s * s)) for y, x, s in places)


def test_blobs_are_found_where_they_are(spark):
    places = [(30, 40, 4.0), (70, 25, 5.0), (60, 90, 6.0)]
    found = features.detect(picture(spark, blobs(100, 120, places))).collect()
    for y, x, s in places:
        near = [q for q in found if math.hypot(q["x"] - x, q["y"] - y) < 1.5]
        assert any(s / 2 < q["scale"] < 2 * s for q in near)
    assert [q["id"] for q in sorted(found, key=lambda q: -q["response"])][:3] == [1, 2, 3]
    assert all(math.isclose(sum(v * v for v in q["desc"]), 1, rel_tol=1e-9) for q in found)


def test_points_do_not_depend_on_tiles(spark, monkeypatch):
    r = np.random.default_rng(5)
    rel = picture(spark, tiles.blurred(r.random((90, 150)), 1.2))
    rows = lambda: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in q[:-1]) + tuple(round(v, 7) for v in q["desc"]) for q in features.scale_space_points(rel).collect())
    whole = rows()
    monkeypatch.setattr(features, "CORE", 64)
    assert rows() == whole and len(whole) > 10


def test_extremes_and_descriptors_are_as_told_pixel_by_pixel():
    r = np.random.default_rng(2)
    levels = features.levels_of(tiles.blurred(r.random((40, 40)), 1.0), True)
    dogs = np.diff(levels, axis=0)
    want = []
    for i, y, x in itertools.product(range(1, len(dogs) - 1), range(1, 39), range(1, 39)):
        others = [dogs[i + a, y + b, x + c] for a, b, c in itertools.product((-1, 0, 1), repeat=3) if (a, b, c) != (0, 0, 0)]
        v = dogs[i, y, x]
        if abs(v) >= features.CONTRAST / 2 and (v > max(others) or v < min(others)):
            want.append([i, y, x])
    assert features.extremes(dogs).tolist() == want and want
    img, cy, cx, sigma, angle = levels[2], 19.3, 21.8, 1.9, 0.7
    hist = np.zeros((4, 4, 8))
    for y, x in itertools.product(range(1, 39), range(1, 39)):
        oy, ox = y - 19, x - 22
        rx, ry = ((ox * math.cos(angle) + oy * math.sin(angle)) / (3 * sigma), (oy * math.cos(angle) - ox * math.sin(angle)) / (3 * sigma))
        gx, gy = img[y, x + 1] - img[y, x - 1], img[y + 1, x] - img[y - 1, x]
        at = (math.atan2(gy, gx) - angle) % math.tau / math.tau * 8
        value = math.hypot(gx, gy) * math.exp(-(rx * rx + ry * ry) / 8)
        for i, j in itertools.product(range(4), repeat=2):
            for b in range(8):
                turn = min((at - b) % 8, (b - at) % 8)
                hist[i, j, b] += value * max(0, 1 - abs(ry + 1.5 - i)) * max(0, 1 - abs(rx + 1.5 - j)) * max(0, 1 - turn)
    hist = hist.ravel() / np.linalg.norm(hist)
    hist = np.minimum(hist, 0.2)
    got = features.described(img, cy, cx, sigma, angle)
    assert np.allclose(got, hist / np.linalg.norm(hist), atol=1e-12)


def test_a_turned_picture_has_the_same_descriptors(spark):
    base = tiles.blurred(np.random.default_rng(8).random((96, 96)), 1.5)
    base = (base - base.min()) / (base.max() - base.min())
    rel = picture(spark, base, np.rot90(base))
    points = features.detect(rel, 80)
    a = points.filter("frame_id = 0").select("id", "desc")
    b = points.filter("frame_id = 1").select("id", "desc")
    pairs = match.match_features(a, b).select("a_id", "b_id").collect()
    at = {(q["frame_id"], q["id"]): (q["x"], q["y"]) for q in points.collect()}
    right = sum(math.hypot(at[1, q["b_id"]][0] - at[0, q["a_id"]][1], at[1, q["b_id"]][1] - (95 - at[0, q["a_id"]][0])) < 1.0 for q in pairs)
    assert len(pairs) > 15 and right >= 0.9 * len(pairs)


# -- cameras ------------------------------------------------------------------
def seen(cameras, n=150, noise=0.0):
    """Pairs of places that cameras see of the same directions."""
    r = np.random.default_rng(4)
    rays = np.column_stack([r.uniform(-1.1, 1.1, n), r.uniform(-0.5, 0.5, n), np.ones(n)])
    views = {}
    for k, c in cameras.items():
        d = rays @ c.r.T
        p = c.f * d[:, :2] / np.where(d[:, 2:] > 0.2, d[:, 2:], np.nan)
        views[k] = np.where((np.abs(p) < [400, 300]).all(1)[:, None], p, np.nan) + r.normal(0, noise, (n, 2))
    out = []
    for a, b in itertools.combinations(cameras, 2):
        both = ~np.isnan(views[a] + views[b]).any(1)
        out += [(a, b, *map(float, (*p, *q))) for p, q in zip(views[a][both], views[b][both], strict=True)]
    return out


def test_planted_cameras_come_back(spark):
    true = {k: panorama.Camera(620.0 + 5 * k, panorama.rotation(np.array([0.02 * k, -0.33 * k, 0.015 * k]))) for k in range(4)}
    rows = seen(true)
    matches = spark.createDataFrame(rows, "a long, b long, ax double, ay double, bx double, by double")
    fits = []
    for q in match.fitted_pairs(matches).collect():
        if q["h"]:
            fits.append((q["a"], q["b"], q["inliers"], q["h"]))
    start = panorama.first_cameras(fits, dict.fromkeys(true, 800.0))
    assert all(abs(start[k].f - true[k].f) < 60 for k in true)
    rough = {k: panorama.Camera(c.f * 1.03, panorama.rotation(np.array([0.01, -0.01 * k, 0.005]) * (k > 0)) @ c.r) for k, c in true.items()}
    for first in (start, rough):
        first = panorama.turned(first, first[0].r)  # the first one keeps its rotation, which is none
        got, history = panorama.bundle_adjust(first, matches)
        assert history == sorted(history, reverse=True) and history[-1] < 1e-3
        for k, c in true.items():
            assert abs(got[k].f / c.f - 1) < 1e-3 and np.abs(got[k].r - c.r).max() < 1e-3


def test_focal_lengths_come_from_a_turn():
    a, b = panorama.Camera(500.0, np.eye(3)), panorama.Camera(640.0, panorama.rotation(np.array([0.1, 0.3, 0.05])))
    source, to = panorama.focals(panorama.homography(a, b))
    assert math.isclose(source, 500, rel_tol=1e-6) and math.isclose(to, 640, rel_tol=1e-6)
    assert panorama.focals(np.eye(3)) == (None, None)


def test_straightening_levels_a_tilted_pan():
    tilt = panorama.rotation(np.array([0.0, 0.0, 0.2]))
    cameras = {k: panorama.Camera(500.0, panorama.rotation(np.array([0.0, 0.3 * k, 0.0])) @ tilt) for k in range(5)}
    level = panorama.turned(cameras, panorama.straighten(cameras))
    assert max(abs(c.r[0, 1]) for c in level.values()) < 1e-9
    assert all(c.r[1, 1] > 0.99 for c in level.values())


# -- seams --------------------------------------------------------------------
def test_the_cut_is_the_cheapest_of_all():
    r = np.random.default_rng(0)
    for _ in range(60):
        h, w = r.integers(1, 4), r.integers(1, 5)
        nodes = r.random((h, w)) < 0.9
        right, down = r.integers(1, 20, (h, w)), r.integers(1, 20, (h, w))
        source, sink = (np.where(r.random((h, w)) < 0.4, r.integers(0, 30, (h, w)), 0) for _ in range(2))
        cost, keep = panorama.min_cut(nodes, right, down, source, sink)

        def price(side):
            total = int((source * (nodes & ~side)).sum() + (sink * (nodes & side)).sum())
            for y, x in itertools.product(range(h), range(w)):
                for links, (v, u) in ((right, (y, x + 1)), (down, (y + 1, x))):
                    if v < h and u < w and nodes[y, x] and nodes[v, u] and side[y, x] != side[v, u]:
                        total += int(links[y, x])
            return total

        sides = [np.array(bits, bool).reshape(h, w) & nodes for bits in itertools.product([0, 1], repeat=h * w)]
        prices = [price(s) for s in sides]
        assert cost == min(prices) == price(keep & nodes)
        fewest = np.logical_and.reduce([s for s, p in zip(sides, prices, strict=True) if p == min(prices)])
        assert ((keep & nodes) == fewest).all()


def warps_of(spark, pano, frames):
    """frames: {id: (rgb, weight)} on one canvas."""
    rows = [(pano, k, y, x, *map(float, rgb[y, x]), float(wt[y, x])) for k, (rgb, wt) in frames.items() for y, x in np.argwhere(wt > 0).tolist()]
    return spark.createDataFrame(rows, "pano string, frame_id long, y int, x int, r double, g double, b double, w double")


def test_a_seam_goes_round_what_moved(spark):
    h, w = 24, 60
    ground = np.repeat(np.linspace(0.2, 0.4, w)[None, :, None], h, 0) * np.ones(3)
    ramp = np.linspace(1, 0.05, 40)
    first, second = np.zeros((h, w)), np.zeros((h, w))
    first[:, :40], second[:, 20:] = ramp, ramp[::-1]
    walker = ground.copy()
    walker[8:16, 26:34] = 0.9  # only the second frame saw it, across the middle of the overlap
    frames = {1: (ground, first), 2: (walker, second)}
    found = panorama.seam_owners(warps_of(spark, "p", frames).unionByName(warps_of(spark, "q", {5: (ground, first)})), w, h).collect()
    own = {(q["y"], q["x"]): q["frame_id"] for q in found if q["pano"] == "p"}
    assert len(own) == h * w and {q["frame_id"] for q in found if q["pano"] == "q"} == {5}
    assert all(own[y, x] == 1 for y in range(h) for x in range(20)) and all(own[y, x] == 2 for y in range(h) for x in range(40, w))
    assert len({own[y, x] for y in range(8, 16) for x in range(26, 34)}) == 1  # shown by one frame, whole or not at all


def test_bands_of_whole_frames_are_the_frame_and_soften_a_step(spark):
    h, w = 20, 64
    flat, seen_ = np.full((h, w, 3), 0.5), np.ones((h, w))
    for bands in (1, 3):
        for step in (0.0, 0.1):
            warps = warps_of(spark, "p", {1: (flat, seen_), 2: (flat + step, seen_)})
            owners = warps.groupBy("pano", "y", "x").agg(F.when(F.col("x") < 32, F.min("frame_id")).otherwise(F.max("frame_id")).alias("frame_id"))
            got = {(q["y"], q["x"]): q["r"] for q in panorama.multiband(warps, owners, w, h, bands).collect()}
            line = [got[10, x] for x in range(w)]
            assert len(got) == h * w and abs(line[2] - 0.5) < 2e-3 and abs(line[61] - 0.5 - step) < 2e-3
            assert all(b >= a - 1e-9 for a, b in itertools.pairwise(line))
            assert step == 0 or 0.5 + step * 0.3 < line[32] < 0.5 + step * 0.7


def test_bands_do_not_depend_on_tiles(spark, monkeypatch):
    h, w, r = 30, 70, np.random.default_rng(6)
    weights = [np.zeros((h, w)), np.zeros((h, w))]
    weights[0][:, :45], weights[1][:, 20:] = 1.0, 1.0
    warps = warps_of(spark, "p", {k: (r.random((h, w, 3)), wt) for k, wt in enumerate(weights)})
    owners = warps.groupBy("pano", "y", "x").agg(F.when(F.col("x") + F.col("y") < 45, F.min("frame_id")).otherwise(F.max("frame_id")).alias("frame_id"))
    monkeypatch.setattr(panorama, "BAND_SIGMA", 1.5)
    whole = {(q["y"], q["x"]): (q["r"], q["g"], q["b"]) for q in panorama.multiband(warps, owners, w, h, 3).collect()}
    monkeypatch.setattr(panorama.over_tiles, "__defaults__", (16, *panorama.over_tiles.__defaults__[1:]))
    small = {(q["y"], q["x"]): (q["r"], q["g"], q["b"]) for q in panorama.multiband(warps, owners, w, h, 3).collect()}
    assert whole.keys() == small.keys() and all(np.allclose(whole[k], small[k], atol=1e-12) for k in whole)
