"""Cameras of a panorama solved together, seams where frames agree, and blending by bands.

Frames of a panorama are seen from one place by a camera that turns, so each is four numbers: a focal length in pixels and a rotation
(world to camera). They are solved from pairs of places that show the same thing, measured from the frames' middles: Spark adds up each
pair's share of the normal equations, the driver holds and solves only the small system of the cameras. Seams are minimum cuts on a reduced
canvas of a bounded number of cells, a frame against all before it, many panoramas at a time. Bands are blurred in tiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.tiles import blurred, over_tiles
from rasterloom.session import checkpointed


# -- cameras ------------------------------------------------------------------
@dataclass(frozen=True)
class Camera:
    f: float
    r: np.ndarray

    def k(self) -> np.ndarray:
        return np.diag([self.f, self.f, 1.0])


def rotation(w: np.ndarray) -> np.ndarray:
    """The rotation about an axis by its length in radians."""
    angle = float(np.linalg.norm(w))
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = w / angle
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * cross @ cross


def axis_of(r: np.ndarray) -> np.ndarray:
    """The axis times the angle of a rotation."""
    angle = math.acos(min(1.0, max(-1.0, (np.trace(r) - 1) / 2)))
    if angle < 1e-12:
        return np.zeros(3)
    if math.pi - angle < 1e-6:  # half a turn: the axis is what stays
        values, vectors = np.linalg.eigh((r + r.T) / 2)
        return vectors[:, values.argmax()] * angle
    return np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]]) * angle / (2 * math.sin(angle))


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(m)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v


def homography(a: Camera, b: Camera) -> np.ndarray:
    """From the places of a frame to those of another, both from their middles."""
    return b.k() @ b.r @ a.r.T @ np.linalg.inv(a.k())


def focals(h: np.ndarray) -> tuple[float | None, float | None]:
    """The focal lengths of the two cameras that a turn's homography implies; None where it tells nothing."""
    m = (h / h[2, 2] if abs(h[2, 2]) > 1e-12 else h).ravel()

    def pick(n1: float, d1: float, n2: float, d2: float) -> float | None:
        v1, v2 = (n / d if d else math.nan for n, d in ((n1, d1), (n2, d2)))
        sound = [v for v in (v1, v2) if math.isfinite(v) and v > 0]
        if len(sound) == 2:
            return math.sqrt(v1 if abs(d1) > abs(d2) else v2)
        return math.sqrt(sound[0]) if sound else None

    to = pick(-(m[0] * m[1] + m[3] * m[4]), m[6] * m[7], m[0] ** 2 + m[3] ** 2 - m[1] ** 2 - m[4] ** 2, m[7] ** 2 - m[6] ** 2)
    source = pick(-m[2] * m[5], m[0] * m[3] + m[1] * m[4], m[5] ** 2 - m[2] ** 2, m[0] ** 2 + m[1] ** 2 - m[3] ** 2 - m[4] ** 2)
    return source, to


def first_cameras(fits: list[tuple], sizes: dict) -> dict:
    """Cameras to begin with, from fits (a, b, points, h) of pairs and the frames' longer sides: the median of the focal lengths that pairs imply, in shares of the longer side; rotations handed on from the first frame along the pairs of most points."""
    implied = sorted(f / sizes[frame] for a, b, _, h in fits for frame, f in zip((a, b), focals(np.asarray(h, float).reshape(3, 3)), strict=True) if f and f > 1)
    share = implied[len(implied) // 2] if implied else 1.0
    f = {frame: max(1.0, share * size) for frame, size in sizes.items()}
    order = sorted(fits, key=lambda x: (-x[2], x[0], x[1]))
    turned: dict = {}
    for start in sorted(sizes):  # frames that no pair leads to begin a group of their own
        if start in turned:
            continue
        turned[start], moving = np.eye(3), True
        while moving:
            moving = False
            for a, b, _, h in order:
                h = np.asarray(h, float).reshape(3, 3)
                if b in turned and a not in turned and abs(np.linalg.det(h)) > 1e-12:
                    a, b, h = b, a, np.linalg.inv(h)
                elif a not in turned or b in turned:
                    continue
                k, back = np.diag([f[a], f[a], 1]), np.diag([1 / f[b], 1 / f[b], 1])
                m = back @ h @ k
                turned[b] = nearest_rotation(m * np.sign(np.linalg.det(m))) @ turned[a]
                moving = True
    return {frame: Camera(f[frame], turned[frame]) for frame in sizes}


def projected(m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, v, z = (r[0] * x + r[1] * y + r[2] for r in m)
    sound = np.abs(z) > 1e-12
    z = np.where(sound, z, 1.0)
    return u / z, v / z, sound


def differences(p: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How far the points of two cameras (eight numbers) land from each other's, both ways: four rows."""
    a, b = (Camera(max(1.0, q[0]), rotation(q[1:])) for q in (p[:4], p[4:]))
    ax, ay, bx, by = points.T
    u, v, sound = projected(homography(a, b), ax, ay)
    s, t, back = projected(homography(b, a), bx, by)
    return np.stack([np.where(sound, u - bx, 0), np.where(sound, v - by, 0), np.where(back, s - ax, 0), np.where(back, t - ay, 0)])


#: Sums of a pair: the products of its eight numbers' slopes, their products with the differences, the squares, the points.
SUMS = 64 + 8 + 2


def equations(matches: DataFrame, cameras: dict) -> tuple[dict, float, int]:
    """Each pair's share of the normal equations at these cameras, with the sum of squares and the points. matches holds a, b, ax, ay, bx, by."""
    packed = matches.sparkSession.sparkContext.broadcast({k: np.concatenate([[c.f], axis_of(c.r)]) for k, c in cameras.items()})  # four numbers a frame
    kinds = [f"`{c}` {matches.schema[c].dataType.simpleString()}" for c in "ab"]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for (a, b), part in pdf.groupby(["a", "b"]):
                points = part[["ax", "ay", "bx", "by"]].to_numpy(float)
                p = np.concatenate([packed.value[a], packed.value[b]])
                r = differences(p, points).ravel()
                slopes = []
                for i in range(8):
                    step = np.zeros(8)
                    step[i] = max(abs(p[i]) * 1e-6, 1e-7)
                    slopes.append((differences(p + step, points) - differences(p - step, points)).ravel() / (2 * step[i]))
                j = np.stack(slopes)
                out.append((a, b, *(j @ j.T).ravel(), *(j @ r), r @ r, len(points)))
            yield pd.DataFrame(out, columns=["a", "b", *[f"s{i}" for i in range(SUMS)]])

    sums = matches.select("a", "b", "ax", "ay", "bx", "by").mapInPandas(run, ", ".join([*kinds, *[f"s{i} double" for i in range(SUMS)]]))
    rows = sums.groupBy("a", "b").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(SUMS)]).collect()  # one row a pair of frames
    shares = {(r[0], r[1]): np.array(r[2:]) for r in rows}
    return shares, sum(v[72] for v in shares.values()), int(sum(v[73] for v in shares.values()))


def bundle_adjust(cameras: dict, matches: DataFrame, rounds: int = 200, settled: float = 1e-10) -> tuple[dict, list[float]]:
    """The cameras that bring the points of all pairs nearest to each other, by damped least squares, and the root mean square difference in pixels after each round that brought it down. The first frame of each group that pairs link keeps its rotation, or all could turn. Raises if rounds don't settle it."""
    matches = checkpointed(matches.filter("a <> b"))
    shares, cost, n = equations(matches, cameras)
    if not shares:
        return cameras, []
    frames = sorted({f for pair in shares for f in pair})
    group = {f: f for f in frames}
    for _ in frames:
        before = dict(group)
        for a, b in shares:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    at = {f: 4 * i for i, f in enumerate(frames)}
    free = [at[f] + i for f in frames for i in range(4) if i == 0 or group[f] != f]
    damping, history = 1e-3, [math.sqrt(cost / n)]
    for _ in range(rounds):
        m, g = np.zeros((4 * len(frames),) * 2), np.zeros(4 * len(frames))
        for (a, b), v in shares.items():
            own = [at[a] + i for i in range(4)] + [at[b] + i for i in range(4)]
            m[np.ix_(own, own)] += v[:64].reshape(8, 8)
            g[own] -= v[64:72]
        m, g = m[np.ix_(free, free)], g[free]
        better = False
        while damping < 1e9 and not better:
            step = np.zeros(4 * len(frames))
            # damped by the diagonal: focal lengths are pixels, rotations radians
            step[free] = np.linalg.solve(m + np.diag(damping * np.maximum(np.diag(m), 1e-12)), g)
            moved = {f: Camera(max(1.0, cameras[f].f + step[at[f]]), rotation(axis_of(cameras[f].r) + step[at[f] + 1 : at[f] + 4])) for f in frames}
            tried, new, _ = equations(matches, cameras | moved)
            better = new < cost
            damping = max(damping * 0.3, 1e-9) if better else damping * 10
        if not better:
            return cameras, history
        gain, cameras, shares, cost = (cost - new) / max(cost, 1e-300), cameras | moved, tried, new
        history.append(math.sqrt(cost / n))
        if gain < settled or cost / n < 1e-24:
            return cameras, history
    raise ValueError(f"the cameras weren't settled in {rounds} rounds")


def straighten(cameras: dict) -> np.ndarray:
    """The turn of the whole that makes it level: the cameras' own horizontal axes lie in one plane, and what is upright on it becomes the world's."""
    if len(cameras) < 2:
        return np.eye(3)
    across = np.stack([c.r[0] for c in cameras.values()])
    _, vectors = np.linalg.eigh(across.T @ across)
    up = vectors[:, 0]
    up = -up if up @ sum(c.r[1] for c in cameras.values()) < 0 else up
    axis = np.cross(up, [0.0, 1.0, 0.0])
    if np.linalg.norm(axis) < 1e-12:
        return np.eye(3)
    return rotation(axis / np.linalg.norm(axis) * math.acos(min(1.0, max(-1.0, up[1]))))


def turned(cameras: dict, r: np.ndarray) -> dict:
    return {k: Camera(c.f, c.r @ r.T) for k, c in cameras.items()}


# -- exposure -----------------------------------------------------------------
#: How far frames may differ where they show the same, in steps of 255, and how far gains may stray from 1.
SIGMA_N, SIGMA_G = 10.0, 0.1


def gains(overlaps: DataFrame) -> DataFrame:
    """pano, frame, gain: what levels the frames of each panorama, drawn toward 1, from overlaps(pano, a, b, n, mean_a, mean_b), one row for each two frames with n places in common and their mean luma there. A panorama's frames are one small system in one task."""
    import pandas as pd

    kinds = [overlaps.schema[c].dataType.simpleString() for c in ("pano", "a")]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        frames = sorted(set(pdf["a"]) | set(pdf["b"]))
        at = {f: i for i, f in enumerate(frames)}
        m, r = np.eye(len(frames)) / SIGMA_G**2, np.full(len(frames), 1 / SIGMA_G**2)
        for a, b, n, u, v in pdf[["a", "b", "n", "mean_a", "mean_b"]].itertuples(index=False):
            i, j, u, v = at[a], at[b], 255 * u, 255 * v
            for p, q, x, y in ((i, j, u, v), (j, i, v, u)):
                m[p, p] += n * x * x / SIGMA_N**2
                m[p, q] -= n * x * y / SIGMA_N**2
        return pd.DataFrame({"pano": [pdf["pano"].iloc[0]] * len(frames), "frame": frames, "gain": np.linalg.solve(m, r)})

    return overlaps.groupBy("pano").applyInPandas(solve, f"pano {kinds[0]}, frame {kinds[1]}, gain double")


# -- seams --------------------------------------------------------------------
# Cells of the reduced canvas at most, costs' steps to 1, the tie to a frame, weight under which a frame is near its border,
# cost of a seam anywhere, how much an edge cheapens it, pixels it keeps from what differs, pull to the more direct frame, what has moved.
SEAM_CELLS, STEPS, TIE = 1 << 19, 256.0, (2**31 - 1) // 8
MARGIN, FLOOR, RELIEF, CLEAR, PULL, MOVED = 0.02, 0.01, 4.0, 8, 0.02, 0.2
#: Neighbours of a cell: right, left, down, up; each two are opposite.
SIDES = ((0, 1), (0, -1), (1, 0), (-1, 0))


def shifted(v: np.ndarray, side: tuple[int, int], fill) -> np.ndarray:
    """v as each cell's neighbour on a side has it."""
    out = np.full_like(v, fill)
    dy, dx = side
    h, w = v.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = v[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def min_cut(nodes: np.ndarray, right: np.ndarray, down: np.ndarray, source: np.ndarray, sink: np.ndarray) -> tuple[int, np.ndarray]:
    """The cost of the cheapest cut of a grid between source and sink, and the cells that stay with the source: the fewest that a cheapest cut can leave it. right and down are what it costs to part a cell from its neighbour there, source and sink what it costs to part it from those.

    Preflows pushed by all cells at once, from the sink's side, with heights measured anew from time to time."""
    link = [np.where(nodes & shifted(nodes, s, False), c, 0).astype(np.int64) for s, c in zip(SIDES, (right, shifted(right, (0, -1), 0), down, shifted(down, (-1, 0), 0)), strict=True)]
    both = np.where(nodes, np.minimum(source, sink), 0).astype(np.int64)
    held, drain = np.where(nodes, sink, 0) - both, np.where(nodes, source, 0) - both
    total, far = int(both.sum() + held.sum()), np.int64(nodes.size + 2)
    while True:
        height = np.where(drain > 0, np.int64(1), far)
        reached = drain > 0
        level, front = 1, reached
        while front.any():  # a cell can send to a neighbour that is reached over a link with room
            level += 1
            new = np.zeros_like(reached)
            for s, c in zip(SIDES, link, strict=True):
                new |= shifted(front, s, False) & (c > 0)
            front = new & ~reached & nodes
            height[front] = level
            reached |= front
        active = (held > 0) & reached
        if not active.any():
            return total - int(held.sum()), reached
        for _ in range(64):
            sent = np.where((held > 0) & (height == 1), np.minimum(held, drain), 0)
            held, drain = held - sent, drain - sent
            for k, s in enumerate(SIDES):
                to = shifted(height, s, far)
                sent = np.where((held > 0) & (height < far) & (height == to + 1), np.minimum(held, link[k]), 0)
                if sent.any():
                    held = held - sent + shifted(sent, SIDES[k ^ 1], 0)
                    link[k] = link[k] - sent
                    link[k ^ 1] = link[k ^ 1] + shifted(sent, SIDES[k ^ 1], 0)
            lowest = np.where(drain > 0, np.int64(0), far)
            for s, c in zip(SIDES, link, strict=True):
                lowest = np.minimum(lowest, np.where(c > 0, shifted(height, s, far), far))
            height = np.where((held > 0) & (height < far), np.maximum(height, np.minimum(lowest + 1, far)), height)
            if not ((held > 0) & (height < far)).any():
                break


def widest(v: np.ndarray, r: int) -> np.ndarray:
    """The largest value within r cells, across and then down; -1 where there is none."""
    for axis in (1, 0):
        side = (0, 1) if axis else (1, 0)
        best, ahead, back = v, v, v
        for _ in range(r):
            ahead, back = shifted(ahead, side, -1), shifted(back, (-side[0], -side[1]), -1)
            best = np.maximum(best, np.maximum(ahead, back))
        v = best
    return v


def stays(held_rgb: np.ndarray, own_rgb: np.ndarray, held_w: np.ndarray, own_w: np.ndarray, radius: int) -> np.ndarray:
    """Where what a canvas holds stays rather than a further frame's part, cell by cell. rgb are (h, w, 3); weights are 0 where there is nothing."""
    has, sees = held_w > 0, own_w > 0
    both = has & sees
    apart = np.where(both, np.abs(held_rgb - own_rgb).sum(2), -1.0)
    clear = widest(apart, radius)
    light = [v @ np.array([0.2126, 0.7152, 0.0722]) for v in (held_rgb, own_rgb)]
    costs = []
    for s in (SIDES[0], SIDES[2]):
        edge = sum(np.abs(v - shifted(v, s, 0)) for v in light)
        costs.append(np.clip(np.floor(((clear + shifted(clear, s, 0)) / (1 + RELIEF * edge) + FLOOR) * STEPS + 0.5), 1, TIE).astype(np.int64))
    source, sink = (np.zeros(has.shape, np.int64) for _ in range(2))
    for s in SIDES:
        source += np.where(both & shifted(has & ~sees, s, False), TIE, 0)
        sink += np.where(both & shifted(sees & ~has, s, False), TIE, 0)
    source += np.where(own_w < MARGIN, TIE, 0)
    sink += np.where((own_w >= MARGIN) & (held_w < MARGIN), TIE, 0)
    pull = np.floor(PULL * np.abs(held_w - own_w) / np.maximum(held_w + own_w, 1e-6) * STEPS + 0.5).astype(np.int64)
    source += np.where(held_w > own_w, pull, 0)
    sink += np.where(held_w > own_w, 0, pull)
    cost, keep = min_cut(both, *costs, source, sink)
    moved = apart > MOVED
    if (moved & keep).any() and (moved & ~keep).any():
        # what moved between the frames is shown once: all of it from one of them, unless that cuts more ties than the free cut
        best, tied = None, np.where(moved, TIE, 0)
        for a, b in ((source + tied, sink), (source, sink + tied)):
            other, side = min_cut(both, *costs, a, b)
            if other // TIE == cost // TIE and (best is None or other < best):
                best, keep = other, side
    return keep


def cell_size(width: int, height: int) -> int:
    s = max(1, math.ceil(math.sqrt(width * height / SEAM_CELLS)))
    while -(-width // s) * -(-height // s) > SEAM_CELLS:
        s += 1
    return s


def seam_owners(warps: DataFrame, width: int, height: int) -> DataFrame:
    """pano, y, x, frame_id: which frame each place of a canvas is taken from, with seams where the frames agree. warps holds pano, frame_id, y, x, r, g, b, w, of places with a weight above 0; frames count in the order of their ids.

    A step for each frame of the panorama with most of them, all panoramas at once; a panorama's reduced canvas, SEAM_CELLS cells at most, is one group."""
    import pandas as pd

    s = cell_size(width, height)
    gw, gh, radius = -(-width // s), -(-height // s), -(-CLEAR // s)
    pano, frame = (warps.schema[c].dataType.simpleString() for c in ("pano", "frame_id"))
    warps = warps.filter("w > 0")
    cy, cx = F.floor(F.col("y") / s).cast("int"), F.floor(F.col("x") / s).cast("int")
    whole = F.least(F.lit(s), F.lit(width) - F.col("cx") * s) * F.least(F.lit(s), F.lit(height) - F.col("cy") * s)
    cells = warps.groupBy("pano", "frame_id", cy.alias("cy"), cx.alias("cx")).agg(*[F.avg(c).alias(c) for c in "rgbw"], F.count(F.lit(1)).alias("n")).filter(F.col("n") == whole).drop("n")
    cells = checkpointed(cells)
    order = cells.select("pano", "frame_id").distinct().groupBy("pano").agg(F.array_sort(F.collect_list("frame_id")).alias("frames"))
    order = order.select("pano", F.posexplode("frames").alias("k", "frame_id"))
    cells = checkpointed(cells.join(order, ["pano", "frame_id"]))
    last = cells.agg(F.max("k")).first()[0]
    state = f"pano {pano}, frame_id {frame}, cy int, cx int, r double, g double, b double, w double"
    columns = [c.split()[0] for c in state.split(", ")]

    def grid(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rgb, w = np.zeros((gh, gw, 3)), np.zeros((gh, gw))
        at = pdf["cy"].to_numpy(), pdf["cx"].to_numpy()
        rgb[at], w[at] = pdf[["r", "g", "b"]].to_numpy(float), pdf["w"].to_numpy(float)
        return rgb, w

    def step(held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if held.empty or own.empty:
            return (own if held.empty else held)[columns]
        a, b = grid(held), grid(own)
        keep = stays(a[0], b[0], a[1], b[1], radius)
        both = (a[1] > 0) & (b[1] > 0)
        to_own = (b[1] > 0) & ~(both & keep) & (both | (a[1] <= 0))
        stay = held[~to_own[held["cy"], held["cx"]]]
        taken = own[to_own[own["cy"], own["cx"]]]
        return pd.concat([stay[columns], taken[columns]])

    canvas = cells.filter("k = 0").drop("k")
    for k in range(1, (last or 0) + 1):
        canvas = checkpointed(canvas.groupBy("pano").cogroup(cells.filter(F.col("k") == k).groupBy("pano")).applyInPandas(step, state))
    owned = canvas.select("pano", "cy", "cx", F.col("frame_id").alias("owner"))
    pixels = warps.select("pano", "frame_id", "y", "x", "w", cy.alias("cy"), cx.alias("cx")).join(owned, ["pano", "cy", "cx"], "left")
    # a place that its cell's owner doesn't see, or of a cell that no frame wholly covers, goes to the frame of most weight
    rank = F.struct(F.coalesce(F.col("frame_id") != F.col("owner"), F.lit(True)), -F.col("w"), F.col("frame_id").alias("frame_id"))
    return pixels.groupBy("pano", "y", "x").agg(F.min(rank)["frame_id"].alias("frame_id"))


# -- blending -----------------------------------------------------------------
#: Width of the finest band; each further one is twice as wide.
BAND_SIGMA = 5.0


def multiband(warps: DataFrame, owners: DataFrame, width: int, height: int, bands: int = 4) -> DataFrame:
    """pano, y, x, r, g, b, a: frames joined by bands of detail, each with masks as soft as the band is coarse. warps holds pano, frame_id, y, x, r, g, b; owners pano, y, x, frame_id. Places that no frame owns are left out.

    Each frame's bands are found in tiles; what they give is added up by place."""
    bands = max(1, bands)
    sigmas = [BAND_SIGMA * 2**k for k in range(max(1, bands - 1))]
    reach = sum(math.ceil(3 * s) for s in sigmas)
    mine = owners.withColumn("m", F.lit(1.0))
    # tiles that hold none of a frame's own places get nothing of it
    layers = warps.select("pano", "frame_id", "y", "x", "r", "g", "b").join(mine, ["pano", "frame_id", "y", "x"], "left").fillna(0.0, ["m"])
    gives = [f"{c}{k}" for k in range(bands) for c in "rgbm"]

    def run(planes, y0, x0):
        rgb, mask, out = [planes[c] for c in "rgb"], planes["m"], {}
        if bands == 1:
            mask = blurred(mask, sigmas[0])
        for k in range(bands):
            if k < bands - 1:
                softer = [blurred(v, sigmas[k]) for v in rgb]
                detail = [a - b for a, b in zip(rgb, softer, strict=True)]
            else:
                softer, detail = rgb, rgb
            out |= {f"{c}{k}": d * mask for c, d in zip("rgb", detail, strict=True)} | {f"m{k}": mask}
            rgb, mask = softer, blurred(mask, sigmas[k]) if k < bands - 1 else mask
        out["there"] = sum(out[f"m{k}"] for k in range(bands)) > 0
        return out

    parts = over_tiles(layers, width, height, reach, ["r", "g", "b", "m"], gives, run, by=["pano", "frame_id", "y", "x"])
    sums = parts.groupBy("pano", "y", "x").agg(*[F.sum(g).alias(g) for g in gives])

    def level(c: str):
        total = F.lit(0.0)
        for k in range(bands):
            total = total + F.when(F.col(f"m{k}") > 1e-6, F.col(f"{c}{k}") / F.col(f"m{k}")).otherwise(0.0)
        return F.greatest(total, F.lit(0.0)).alias(c)

    return sums.join(owners.select("pano", "y", "x"), ["pano", "y", "x"]).select("pano", "y", "x", *map(level, "rgb"), F.lit(1.0).alias("a"))
