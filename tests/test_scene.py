"""Highlights, wide blurs, new operators on small frames, each against numbers told here."""

import itertools
import math
import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.frame import image_rel
from rasterloom.operators import detail, match, spatial, stack  # noqa: F401
from rasterloom.operators.node import run


def picture(spark, values, alpha=1.0):
    """A frame from rows of grey values or triples."""
    a = np.array(values, float)
    a = np.repeat(a[:, :, None], 3, axis=2) if a.ndim == 2 else a
    rows = [(0, y, x, *map(float, a[y, x]), alpha) for y in range(a.shape[0]) for x in range(a.shape[1])]
    df = spark.createDataFrame(rows, "frame_id int, y int, x int, r double, g double, b double, a double")
    return image_rel(df, a.shape[1], a.shape[0])


def grid(rel, c="r"):
    out = np.zeros((rel.height, rel.width))
    for r in rel.df.collect():
        out[r.y, r.x] = r[c]
    return out


@pytest.mark.parametrize(("name", "params"), [("sharpening", {"intensity": 70.0}), ("sharpening", {"mode": "hipass"}), ("skin_soften", {"strength": 60.0})])
def test_a_flat_highlight_stays(spark, name, params):
    flat = picture(spark, np.full((6, 6), 2.0))
    assert np.allclose(grid(run(name, {"in": flat}, params)), 2.0, atol=0.02)


def test_displays_end_at_white(spark):
    rel = picture(spark, [[-1.0, 0.0, 0.5, 2.0]])
    assert np.allclose(grid(run("to_display", {"in": rel}))[0], [0, 0, 0.7353569, 1], atol=1e-6)
    assert np.allclose(grid(run("to_scene", {"in": rel}))[0], [0, 0, 0.2140411, 1], atol=1e-6)
    assert grid(run("to_scene", {"in": rel, "reference": rel}))[0][3] == pytest.approx(2.0)


def test_dehaze_restores_colour(spark):
    veiled = picture(spark, np.tile(np.array([0.5, 0.42, 0.36]), (3, 3, 1)))
    got = run("detail", {"in": veiled}, {"dehaze": 80.0}).df.first()
    assert (got.r - got.b) / got.r > 1.15 * 0.14 / 0.5
    luma_only = run("detail", {"in": veiled}, {"dehaze": 80.0, "dehaze_red": 0.0, "dehaze_green": 0.0, "dehaze_blue": 0.0}).df.first()
    assert (luma_only.r, luma_only.g, luma_only.b) == pytest.approx((0.5, 0.42, 0.36))
    grey = grid(run("detail", {"in": picture(spark, np.full((3, 3), 0.4))}, {"dehaze": 80.0}), "r")
    assert np.allclose(grey, grid(run("detail", {"in": picture(spark, np.full((3, 3), 0.4))}, {"dehaze": 80.0}), "b"))


@pytest.mark.parametrize(("name", "params"), [("clarity", {"clarity": 50.0}), ("detail", {"texture": 40.0, "dehaze": 30.0}), ("detail", {"clarity": 40.0, "clarity_red": 50.0, "dehaze": -30.0}), ("detail_eq", {"fine": 50.0, "red": 50.0}), ("standard_color", {"contrast": 40.0, "dehaze": 20.0}), ("tone_eq", {"ev_0": 1.0})])
def test_pixels_without_light(spark, name, params):
    a = np.random.default_rng(6).random((5, 5))
    a[1:3, 1:4] = 0.0
    got = grid(run(name, {"in": picture(spark, a)}, params))
    assert np.isfinite(got).all() and (params.get("dehaze", 0) < 0 or np.allclose(got[1:3, 1:4], 0.0))


def slow_gaussian(a, sigma):
    r = math.ceil(2.5 * sigma)
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (1, 0):
        at = np.clip(np.arange(a.shape[axis])[:, None] + np.arange(-r, r + 1)[None, :], 0, a.shape[axis] - 1)
        a = np.moveaxis((np.moveaxis(a, axis, -1)[..., at] * k).sum(axis=-1), -1, axis)
    return a


@pytest.mark.parametrize("sigma", [0.8, 3.0, 11.9])
def test_gaussians_of_any_way_are_the_same(spark, sigma):
    a = np.random.default_rng(1).random((7, 23))
    assert np.allclose(grid(run("blur", {"in": picture(spark, a)}, {"radius": sigma})), slow_gaussian(a, sigma), atol=1e-9)


def test_wide_blurs_run_and_have_no_step(spark):
    r = np.random.default_rng(2)
    a = slow_gaussian(r.random((64, 64)), 1.5)
    # where a blur is about as wide as the frame its edges count most, and those are means of squares
    for sigma, room in ((12.0, 1e-9), (12.5, 0.03), (60.0, 0.1), (200.0, 0.1)):
        got = grid(run("blur", {"in": picture(spark, a)}, {"radius": sigma}))
        assert np.abs(got - slow_gaussian(a, sigma)).max() < room and got.min() >= a.min() and got.max() <= a.max()


def test_motion_is_a_mean_along_a_line(spark):
    a = np.zeros((1, 9))
    a[0, 4] = 1.0
    got = grid(run("blur", {"in": picture(spark, a)}, {"radius": 1.0, "kind": "motion"}))
    assert np.allclose(got[0], [0, 0, 0, 1 / 3, 1 / 3, 1 / 3, 0, 0, 0])


def test_bands_add_up(spark):
    a = 0.3 + 0.2 * np.random.default_rng(3).random((20, 20))
    rel = picture(spark, a)
    assert np.allclose(grid(run("detail_eq", {"in": rel})), a)
    flat = grid(run("detail_eq", {"in": rel}, dict.fromkeys(("fine", "small", "medium", "large", "broad"), -100.0)))
    raised = grid(run("detail_eq", {"in": rel}, {"fine": 80.0}))
    assert flat.std() < 0.5 * a.std() < a.std() < raised.std()


def test_most_points_decide_a_fit():
    r = np.random.default_rng(4)
    m = np.array([[1.05, 0.1, 30], [-0.07, 0.98, -12], [1e-4, -5e-5, 1]])
    source = r.random((80, 2)) * 900
    target = match.applied(m, source)
    target[::2] += 40 + 200 * r.random((40, 2))
    found, votes = match.ransac(source, target)
    assert np.allclose(found, m, rtol=1e-6, atol=1e-6) and votes.tolist() == [i % 2 == 1 for i in range(80)]
    assert match.ransac(source[:3], target[:3]) is None
    line = np.stack([np.arange(9.0), np.arange(9.0)], 1)
    assert match.fit_homography(line, line) is None


def test_the_largest_rectangle(spark):
    r = random.Random(5)
    for _ in range(6):
        w, h = r.randint(3, 9), r.randint(3, 9)
        full = [[r.random() < 0.8 for _ in range(w)] for _ in range(h)]
        rows = [(0, y, x, 1.0 if full[y][x] else 0.0) for y in range(h) for x in range(w)]
        got = match.auto_crop(spark.createDataFrame(rows, "frame_id int, y int, x int, a double"), w, h).collect()
        areas = {}
        for x0, x1 in itertools.combinations(range(w + 1), 2):
            for y0, y1 in itertools.combinations(range(h + 1), 2):
                if all(full[y][x] for y in range(y0, y1) for x in range(x0, x1)):
                    areas.setdefault((x1 - x0) * (y1 - y0), []).append((x0, y0, x1, y1))
        inner = [(x0 + (x0 > 0), y0 + (y0 > 0), x1 - (x1 < w), y1 - (y1 < h)) for x0, y0, x1, y1 in areas[max(areas)]]
        seen = [(round(g.x * w), round(g.y * h), round((g.x + g.w) * w), round((g.y + g.h) * h)) for g in got]
        assert (seen and seen[0] in inner) or (not seen and any(x1 <= x0 or y1 <= y0 for x0, y0, x1, y1 in inner))


def test_shifts_are_found(spark):
    y, x = np.mgrid[0:48, 0:64]
    smooth = lambda dx, dy: 0.5 + 0.3 * np.sin((x - dx) / 5) * np.cos((y - dy) / 4) + 0.1 * np.sin((x - dx) / 11)
    rows = [(f, int(b), int(a), *[float(s[b, a])] * 3, 1.0) for f, s in enumerate((smooth(0, 0), smooth(4, -3))) for b in range(48) for a in range(64)]
    rel = image_rel(spark.createDataFrame(rows, "frame_id int, y int, x int, r double, g double, b double, a double"), 64, 48)
    assert [tuple(r) for r in stack.find_shifts(rel, 0, 8).orderBy("frame_id").collect()] == [(0, 0, 0), (1, 4, -3)]


def test_a_shift_counts_every_place(spark):
    """Where every second place of every second row is noise in the base frame, the others tell the shift."""
    h, w = 40, 256
    rng = np.random.default_rng(3)
    v = rng.random((h + 2, w + 2))
    base, other = v[1:-1, 1:-1].copy(), v[1:-1, :-2]
    base[::2, ::2] = rng.random((h // 2, w // 2))
    ys, xs = np.mgrid[0:h, 0:w]
    frames = pd.concat([pd.DataFrame({"frame_id": np.int32(f), "y": ys.ravel().astype(np.int32), "x": xs.ravel().astype(np.int32), "r": s.ravel(), "g": s.ravel(), "b": s.ravel(), "a": 1.0}) for f, s in enumerate((base, other))])
    assert [tuple(r) for r in stack.find_shifts(image_rel(spark.createDataFrame(frames), w, h), 0, 1).orderBy("frame_id").collect()] == [(0, 0, 0), (1, 1, 0)]


@pytest.mark.parametrize(("name", "params"), [("detail_eq", {"fine": 40.0, "medium": -60.0, "large": 30.0}), ("sharpen", {"amount": 80.0, "radius": 0.6}), ("clarity", {"texture": 30.0, "clarity": 40.0})])
def test_bases_share_their_passes(spark, name, params):
    """Guided bases of several radii and channels go along rows and along columns twice in all."""
    df = spark.range(400).selectExpr("0 as frame_id", "int(id div 20) as y", "int(id % 20) as x", "id % 7 / 7D as r", "id % 5 / 5D as g", "id % 3 / 3D as b", "1D as a")
    out = run(name, {"in": image_rel(df, 20, 20)}, params)
    assert out.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4


def test_lens_places_meet_in_one_shuffle(spark):
    """A pixel's three places and its alpha meet at once: shuffles of what is read, of the frame, and of the pixels."""
    df = spark.range(400).selectExpr("0 as frame_id", "int(id div 20) as y", "int(id % 20) as x", "id % 7 / 7D as r", "id % 5 / 5D as g", "id % 3 / 3D as b", "if(id = 45, null, id / 400D) as a")
    out = run("lens_correct", {"in": image_rel(df, 20, 20)}, {"ca_red": 30.0, "vignette": 20.0})
    assert out.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    assert {(r.y, r.x): r.a for r in out.df.collect()} == {(r.y, r.x): r.a for r in df.collect()}


def test_shifts_over_words_and_holes(spark):
    """Rows of several words, one of them not full, and places that a frame doesn't have."""
    h, w = 40, 150
    rng = np.random.default_rng(8)
    v = rng.random((h + 8, w + 8))
    moves = ((0, 0), (-4, 1), (3, -2))
    ys, xs = np.mgrid[0:h, 0:w]
    frames = []
    for f, (dx, dy) in enumerate(moves):
        s = v[4 - dy : 4 - dy + h, 4 - dx : 4 - dx + w]
        frames.append(pd.DataFrame({"frame_id": np.int32(f), "y": ys.ravel().astype(np.int32), "x": xs.ravel().astype(np.int32), "r": s.ravel(), "g": s.ravel(), "b": s.ravel(), "a": 1.0})[rng.random(h * w) < 0.8])
    df = spark.createDataFrame(pd.concat(frames))
    for around in (1, 0):
        bits = df.select("frame_id", "y", "x", (F.col("r") > 0.5).alias("bit"))
        known = stack.in_words(bits, around).select(F.sum(F.bit_count("known"))).first()[0]
        assert known == sum(map(len, frames)) + around * sum(int(((f.x % 62 == 0).sum() + (f.x % 62 == 61).sum())) for f in frames)
    seen = {}
    for f, frame in enumerate(frames):
        q = np.percentile(frame.r, (25, 50, 75))
        seen[f] = {(y, x): r > q[1] for y, x, r in zip(frame.y, frame.x, frame.r, strict=True) if abs(r - q[1]) >= max(0.05 * (q[2] - q[0]), 1e-4)}
    want = []
    for f in seen:
        met = {(i, j): [b != seen[0][y - j, x - i] for (y, x), b in seen[f].items() if (y - j, x - i) in seen[0]] for j in (-1, 0, 1) for i in (-1, 0, 1)}
        want.append((f, *min(met, key=lambda c: (np.mean(met[c]), c != (0, 0), 3 * c[1] + c[0]))))
    assert [tuple(r) for r in stack.find_shifts(image_rel(df, w, h), 0, 1).orderBy("frame_id").collect()] == want


def test_quartiles_are_exact(spark):
    """Of more values than are looked through, with copies, nulls and values that are no numbers."""
    n = stack.FEW * 3
    at = F.col("id")
    values = {0: at * 7919 % n / F.lit(float(n)), 1: F.floor(at % 5).cast("double"), 2: F.when(at % 3 == 0, F.lit(None)).when(at % 7 == 0, F.lit(float("nan"))).when(at % 11 == 0, F.lit(float("inf"))).otherwise(F.exp(at % 600)), 3: F.when(at < 6, at * 1.5)}
    df = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(f).alias("frame_id"), v.cast("double").alias("l")) for f, v in values.items()])).alias("s")).select("s.*")
    want = df.groupBy("frame_id").agg(F.percentile("l", F.array(*[F.lit(s) for s in (0.25, 0.5, 0.75)])).alias("q"))
    assert sorted(map(repr, stack.quartiles(df).collect())) == sorted(map(repr, want.withColumnRenamed("q", "_q").collect()))


def test_thresholds_of_many_values_need_little_memory(tmp_path):
    """Two frames of 2.5 million different values each, in a process with a heap of 512 MB."""
    told = tmp_path / "told.py"
    told.write_text(
        "from pyspark.sql import functions as F\n"
        "from rasterloom.operators import stack\n"
        "from rasterloom.session import local_session\n"
        "spark = local_session(1, 'small', **{'spark.driver.memory': '512m'})\n"
        "n, at = 5_000_000, F.col('id')\n"
        "df = spark.range(0, n, 1, 8).select((at % 2).cast('int').alias('frame_id'), at.cast('int').alias('y'), F.lit(0).alias('x'), ((at * 2654435761 % n + 0.5) / n).alias('l'))\n"
        "print('bits', *sorted(tuple(r) for r in stack.thresholded(df).groupBy('frame_id').agg(F.count('*'), F.sum(F.col('bit').cast('int'))).collect()))\n"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))} | {"PYTHONPATH": str(Path(stack.__file__).parents[2]), "TMPDIR": str(tmp_path)}
    ran = subprocess.run([sys.executable, str(told)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "bits (0, 2375000, 1187500) (1, 2375000, 1187500)" in ran.stdout, ran.stderr[-2000:]
