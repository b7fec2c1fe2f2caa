"""Depth of field: what is in focus stays, what is near covers, and nothing behind crosses a sharp edge."""

import itertools
import math

import numpy as np

from rasterloom.frame import field_rel, image_rel
from rasterloom.operators import depth
from rasterloom.operators.node import run

NEUTRAL = {"focus": 0.0, "blades": 6.0, "blade_curve": 100.0, "fringe": 0.0, "field_curve": 0.0, "glow": 0.0, "bubble": 0.0, "squeeze": 0.0, "swirl": 0.0}


def shot(spark, img, far, **params):
    h, w, _ = img.shape
    rel = image_rel(spark.createDataFrame([(0, y, x, *map(float, img[y, x]), 1.0) for y in range(h) for x in range(w)], "frame_id int, y int, x int, r double, g double, b double, a double"), w, h)
    plane = field_rel(spark.createDataFrame([(0, y, x, float(far[y, x])) for y in range(h) for x in range(w)], "frame_id int, y int, x int, v double"), w, h)
    out = np.zeros((h, w, 4))
    for q in run("dof", {"in": rel, "depth": plane}, params).df.collect():
        out[q["y"], q["x"]] = [q[c] for c in "rgba"]
    return out


def test_what_is_in_focus_stays(spark):
    img = np.random.default_rng(1).random((40, 50, 3)) * 3
    got = shot(spark, img, np.full((40, 50), 0.5), aperture=100.0, focus=50.0)
    assert np.allclose(got[:, :, :3], img, atol=1e-9) and np.allclose(got[:, :, 3], 1)
    assert not np.allclose(shot(spark, img, np.full((40, 50), 0.9), aperture=100.0, focus=10.0)[:, :, :3], img, atol=0.05)


def test_a_sharp_edge_keeps_what_is_behind_it_out(spark):
    """A sharp dark foreground before a blurred bright ground: its own pixels stay dark; blurred, it spills over the ground."""
    img = np.ones((120, 120, 3))
    img[:, :60] = 0.0
    far = np.where(np.arange(120) < 60, 0.0, 1.0)[None, :] * np.ones((120, 1))
    sharp = shot(spark, img, far, aperture=100.0, focus=0.0)[60, :, 0]
    assert np.abs(sharp[:60]).max() < 0.02
    soft = shot(spark, img, far, aperture=100.0, focus=100.0)[60, :, 0]
    assert soft[60] < 0.9 and abs(soft[75] - 1) < 1e-6


def test_slices_against_pixel_by_pixel(monkeypatch):
    r, (h, w) = np.random.default_rng(2), (14, 17)
    p = NEUTRAL | {"aperture": 300.0, "focus": 30.0, "fringe": 80.0, "field_curve": 40.0, "squeeze": -40.0, "swirl": 50.0, "bubble": 30.0, "blades": 5.0, "blade_curve": 20.0}
    planes = {c: r.random((h, w)) for c in "rgbf"} | {"a": 0.5 + 0.5 * r.random((h, w)), "there": np.ones((h, w), bool)}
    got = depth.layered(planes, 0, 0, w, h, p)
    widest = 3 * min(w, h) * 0.03
    for y, x in itertools.product(range(0, h, 3), range(0, w, 4)):
        left, acc = 1.0, np.zeros(4)
        dx, dy = x + 0.5 - w / 2, y + 0.5 - h / 2
        ring, sector = int(min(math.hypot(dx, dy) / math.hypot(w / 2, h / 2), 0.999) * 3), int(math.atan2(dy, dx) % math.tau / math.tau * 12)
        for k in range(16):
            c0 = (k + 0.5) / 8 - 1

            def cover(v, u, c0=c0):
                focal = min(1, max(0, 0.3 + 0.4 * 0.6 * 2 * ((u / w - 0.5) ** 2 + (v / h - 0.5) ** 2)))
                return max(0.0, 1 - abs(planes["f"][v, u] - focal - c0) * 8) * planes["a"][v, u]

            radius = max(0.0, widest * (abs(c0) - 1 / 16))
            split = 0.8 * 0.35 * math.copysign(1, c0)
            radii = [radius * (1 + split), radius, radius * (1 - split), radius]
            soft = np.zeros(4)
            for i, rr in enumerate(radii):
                taps = [(0, 0, 1.0)] if max(radii) < 0.5 else depth.kernels(rr, p)[ring * 12 + sector]
                total = sum(t[2] for t in taps)
                for tx, ty, tw in taps:
                    v, u = min(h - 1, max(0, y + ty)), min(w - 1, max(0, x + tx))
                    soft[i] += cover(v, u) * (planes["rgb"[i]][v, u] if i < 3 else 1.0) * tw / total
            if soft[3] > 0:
                seen = min(soft[3], left)
                acc[:3] += soft[:3] * seen / soft[3]
                acc[3], left = acc[3] + seen, left - seen
        assert np.allclose([got[c][y, x] for c in "rgba"], [*(acc[:3] / max(acc[3], 1e-6)), min(acc[3], 1)], atol=1e-9)


def test_an_opening_is_a_polygon_or_round():
    ring = depth.aperture(10.0, 6, 1.0, 0.0, 0.0, 1.0, 0.0)
    assert max(math.hypot(dx, dy) for dx, dy, _ in ring) <= 11 and math.isclose(sum(w for *_, w in ring), math.pi * 100, rel_tol=0.15)
    assert len(depth.aperture(10.0, 3, 0.0, 0.0, 0.0, 1.0, 0.0)) < 0.7 * len(ring)


def test_glow_and_no_depth(spark):
    img = np.full((40, 40, 3), 0.1)
    img[20, 20] = 5.0
    got = shot(spark, img, np.zeros((40, 40)), aperture=10.0, focus=0.0, glow=100.0)
    plain = shot(spark, img, np.zeros((40, 40)), aperture=10.0, focus=0.0)
    assert got[21, 21, 0] > plain[21, 21, 0] + 0.05 and np.allclose(plain[:, :, :3], img, atol=1e-9)
    rel = image_rel(spark.createDataFrame([(0, 0, 0, 0.1, 0.2, 0.3, 1.0)], "frame_id int, y int, x int, r double, g double, b double, a double"), 1, 1)
    assert run("dof", {"in": rel}, {"aperture": 50.0}) is rel
