"""Feature matching: nearest-neighbour joins of descriptors, verification, groups of frames, gains."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.tone import num
from rasterloom.session import checkpointed

RATIO = 0.8
#: Descriptors on a shelf and in a cell of an index, about, and cells at most.
BLOCK, CELL, PIVOTS = 2048, 256, 1024
#: Askers whose distances to the pivots are taken at a time, and their visits to shelves that leave a task at a time, at most.
PIECE, VISITS = 512, 1 << 16


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), num(0), lambda s, v: s + v)


def stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def best_two(a_ids: np.ndarray, u: np.ndarray, ids: np.ndarray, v: np.ndarray) -> list[tuple]:
    """(a_id, b_id, distance) of the two nearest of v to each of u, ties to the smaller id; ids are in order."""
    out, lengths = [], (v * v).sum(axis=1)
    for at in range(0, len(u), 256):
        part = u[at : at + 256]
        # products choose, with slack for their rounding; each distance is then taken alone
        near = lengths[None, :] - 2 * (part @ v.T)
        second = np.partition(near, min(1, len(v) - 1), axis=1)[:, min(1, len(v) - 1)]
        slack = 1e-9 * ((part * part).sum(axis=1) + lengths.max() + 1)
        for aid, row, own, limit in zip(a_ids[at : at + 256], part, near, second + slack, strict=True):
            places = np.flatnonzero(own <= limit)
            d = np.sqrt(((v[places] - row) ** 2).sum(axis=1))
            out += [(aid, ids[places[k]], d[k]) for k in np.argsort(d, kind="stable")[:2]]
    return out


def packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cells put on shelves of BLOCK rows at most, in order: each one's first shelf, how many it is dealt over, and how many there are. Small ones share a shelf."""
    parts = np.maximum(1, -(-sizes // BLOCK))
    first, shelves, room = np.zeros(len(sizes), np.int64), 0, 0
    for k, (n, p) in enumerate(zip(sizes.tolist(), parts.tolist(), strict=True)):
        if not shelves or p > 1 or n > room:
            first[k], shelves, room = shelves, shelves + p, BLOCK - n if p == 1 else 0
        else:
            first[k], room = shelves - 1, room - n
    return first, parts, shelves


def two_nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_id, b_id, d1, d2: for each descriptor of a its nearest of b and the distances to the two nearest; ties to the smaller id. a and b hold id and desc.

    Descriptors of b lie in cells around pivots, with the distance to the furthest of each. One of a is first compared with the cells next to it that hold two; how far the second of these is says which other cells may hold a nearer one, and only those are looked through as well. So the answer is exact, and the work follows how descriptors cluster. Cells and askers lie on shelves of BLOCK rows; an asker goes to a shelf once, with the cells it looks through there."""
    import pandas as pd

    spark = a.sparkSession
    kinds = [df.schema["id"].dataType.simpleString() for df in (a, b)]
    vectors = [df.filter(F.col("id").isNotNull()).select("id", F.col("desc").cast("array<double>").alias("desc")) for df in (a, b)]
    wanted = min(PIVOTS, max(1, vectors[1].count() // CELL))
    pivots = np.array([r[0] for r in vectors[1].orderBy(F.xxhash64("id", "desc"), "id").limit(wanted).select("desc").collect()], float)
    empty = spark.createDataFrame([], f"a_id {kinds[0]}, b_id {kinds[1]}, d1 double, d2 double")
    if not len(pivots):
        return empty
    shared = spark.sparkContext.broadcast(pivots)

    def apart(v: np.ndarray) -> np.ndarray:
        p = shared.value
        return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * v @ p.T, 0))

    def pieces(batches, rows: int):
        """Batches in parts of so many rows, as each row has a distance to every pivot."""
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                yield pdf.iloc[at : at + rows]

    def place(batches):
        for pdf in pieces(batches, PIECE):
            d = apart(stacked(pdf["desc"]))
            yield pdf.assign(cell=d.argmin(1), far=d.min(1))

    cells = checkpointed(vectors[1].mapInPandas(place, f"id {kinds[1]}, desc array<double>, cell int, far double"))
    held, reach = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for cell, n, far in cells.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect():  # PIVOTS rows at most
        held[cell], reach[cell] = n, far
    shelf, parts, shelves = packed(held)
    asked = checkpointed(vectors[0].mapInPandas(place, f"id {kinds[0]}, desc array<double>, cell int, far double").withColumnRenamed("cell", "home"))
    askers = np.zeros(len(pivots), np.int64)
    for cell, n in asked.groupBy("home").count().collect():  # PIVOTS rows at most
        askers[cell] = n
    index = spark.sparkContext.broadcast((held, reach, shelf, parts, *packed(askers)[:2]))

    def first(d: np.ndarray) -> np.ndarray:
        """The nearest cells that hold two, of each row of distances to pivots."""
        order = np.argsort(d, axis=1, kind="stable")
        so_far = np.cumsum(index.value[0][order], axis=1)
        needed = np.concatenate([np.zeros((len(d), 1), bool), so_far[:, :-1] >= 2], axis=1)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, ~needed, axis=1)
        return out

    def visits(batches):
        """Where each asker goes: with a bound to every cell that may hold something nearer, without to the first ones."""
        held, reach, shelf, parts, block, blocks = index.value
        # cells by shelf; one that is dealt over several is on each
        places = np.array([(s, c) for c in np.flatnonzero(held) for s in range(shelf[c], shelf[c] + parts[c])], np.int64).reshape(-1, 2)
        places = places[np.lexsort((places[:, 1], places[:, 0]))]
        for pdf in pieces(batches, max(1, min(PIECE, VISITS // max(1, shelves)))):
            d = apart(stacked(pdf["desc"]))
            to = first(d)
            if "bound" in pdf:
                bound = pdf["bound"].fillna(np.inf).to_numpy(float)[:, None]
                to = ~to & (d - reach[None, :] <= bound * (1 + 1e-9) + 1e-6)
            row, k = np.nonzero(to[:, places[:, 1]])
            if not len(row):
                continue
            on, cell = places[k, 0], places[k, 1]
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (on[1:] != on[:-1])]))
            r, h, home = row[new], pdf["h"].to_numpy(), pdf["home"].to_numpy()
            own = block[home[r]] + h[r] % blocks[home[r]]
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[r], "desc": pdf["desc"].to_numpy()[r], "block": own, "shelf": on[new], "cells": np.split(cell, new[1:])})

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = []
        if not x.empty and not y.empty:
            u, lists = stacked(x["desc"]), x["cells"]
            row, wants = np.repeat(np.arange(len(x)), lists.str.len()), np.concatenate(lists.to_numpy())
            ids = x["id"].to_numpy()
            for cell, own in y.sort_values("id").groupby("cell"):
                k = row[wants == cell]
                if len(k):
                    found += best_two(ids[k], u[k], own["id"].to_numpy(), stacked(own["desc"]))
        return pd.DataFrame(found, columns=["a_id", "b_id", "d"])

    def looked_through(askers_: DataFrame) -> DataFrame:
        going = checkpointed(askers_.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInPandas(visits, f"id {kinds[0]}, desc array<double>, block long, shelf long, cells array<int>"))
        of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
        own = cells.withColumn("shelf", of(shelf) + F.pmod(F.xxhash64("id"), of(parts)))
        met = own.join(going.select("shelf", "block").distinct(), "shelf").select("id", "desc", "cell", F.col("shelf").alias("_shelf"), F.col("block").alias("_block"))
        return going.groupBy("shelf", "block").cogroup(met.groupBy("_shelf", "_block")).applyInPandas(compare, f"a_id {kinds[0]}, b_id {kinds[1]}, d double")

    def two(found: DataFrame) -> DataFrame:
        return found.groupBy("a_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b_id"))), 1, 2).alias("n"))

    start = checkpointed(two(looked_through(asked)))
    bounds = start.select(F.col("a_id").alias("id"), F.try_element_at("n", F.lit(2))["d"].alias("bound"))
    more = looked_through(asked.join(bounds, "id", "left"))
    best = two(start.select("a_id", F.explode("n").alias("n")).select("a_id", "n.b_id", "n.d").unionByName(more))
    return best.select("a_id", F.col("n")[0]["b_id"].alias("b_id"), F.col("n")[0]["d"].alias("d1"), F.try_element_at("n", F.lit(2))["d"].alias("d2"))


def match_features(a: DataFrame, b: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Pairs whose nearest is clearly nearer than the second."""
    return two_nearest(a, b).filter((F.col("d2") > 1e-12) & (F.col("d1") / F.col("d2") < ratio))


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs of frames with enough inliers for their overlap: rows (a, b, inliers, in_overlap)."""
    return pairs.filter(F.col("inliers") > num(8) + num(0.3) * F.col("in_overlap"))


def features_in_overlap(points: DataFrame, h: np.ndarray, width: int, height: int) -> DataFrame:
    """How many points a projective map puts inside another frame."""
    x, y = F.col("px"), F.col("py")
    u, v, z = (x * num(r[0]) + y * num(r[1]) + num(r[2]) for r in h)
    inside = (F.abs(z) > 1e-12) & (u / z).between(0, width) & (v / z).between(0, height)
    return points.agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("n"))


def frame_groups(edges: DataFrame, frames: DataFrame) -> DataFrame:
    """frame, grp: frames that are linked, directly or through others, by the smallest of them. Each frame hands its larger neighbours to the smallest frame it knows, then itself and its smaller ones; that leaves a star a group after about as many turns as a chain's length has binary digits, in whatever order its frames are numbered."""
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    while True:
        links = checkpointed(links)
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == before:
            break
        before = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        larger = checkpointed(larger)
        least = checkpointed(larger.groupBy("u").agg(F.min("v").alias("m")))
        links = larger.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    tops = links.select(F.col("u").alias("frame"), F.col("v").alias("grp"))
    return frames.select("frame").join(tops, "frame", "left").select("frame", F.coalesce("grp", "frame").alias("grp"))


def overlap_means(rel_df: DataFrame) -> DataFrame:
    """a, b, n, mean_a, mean_b of luma where two frames overlap; frames hold alpha > 0 where they have a value."""
    y = num(0.2126) * F.col("r") + num(0.7152) * F.col("g") + num(0.0722) * F.col("b")
    one = rel_df.filter("a > 0").select("frame_id", "y", "x", y.alias("l"))
    other = one.select(F.col("frame_id").alias("f2"), "y", "x", F.col("l").alias("l2"))
    return one.join(other, ["y", "x"]).filter("frame_id < f2").groupBy(F.col("frame_id").alias("a"), F.col("f2").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("mean_a"), F.avg("l2").alias("mean_b"))


def owners(weights: DataFrame) -> DataFrame:
    """The frame that owns each place: the largest weight, ties to the first frame. Rows (frame_id, y, x, w)."""
    w = Window.partitionBy("y", "x").orderBy(F.desc("w"), "frame_id")
    return weights.filter("w > 0").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("y", "x", "frame_id")


#: Features kept of a frame, trials of a fit, points of a trial, and how near in pixels a point must land.
FEATURE_LIMIT, TRIALS, SAMPLE, INLIER = 1500, 500, 4, 3.0


def strongest(features: DataFrame, limit: int = FEATURE_LIMIT) -> DataFrame:
    """A frame's features of the largest response, ties to the smaller id."""
    w = Window.partitionBy("frame_id").orderBy(F.desc(F.abs("response")), "id")
    return features.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def levelled(points: np.ndarray) -> np.ndarray:
    """The map that brings points to their centre, at a mean distance of root two."""
    centre = points.mean(axis=0)
    far = np.hypot(*(points - centre).T).mean()
    k = np.sqrt(2) / far if far > 1e-12 else 1.0
    return np.array([[k, 0, -k * centre[0]], [0, k, -k * centre[1]], [0, 0, 1]])


def applied(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points through a projective map; far away where they have no place."""
    u = np.hstack([points, np.ones((len(points), 1))]) @ m.T
    sound = np.abs(u[:, 2]) > 1e-12
    return np.where(sound[:, None], u[:, :2] / np.where(sound, u[:, 2], 1)[:, None], np.inf)


def fit_homography(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The projective map nearest to taking points to others, by least squares in levelled coordinates; None if they don't determine one."""
    if len(source) < SAMPLE:
        return None
    a, b = levelled(source), levelled(target)
    (x, y), (u, v) = applied(a, source).T, applied(b, target).T
    one, zero = np.ones(len(x)), np.zeros(len(x))
    rows = np.vstack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], 1)])
    normal = rows.T @ rows
    if np.linalg.cond(normal) > 1e12:
        return None
    m = np.linalg.inv(b) @ np.append(np.linalg.solve(normal, rows.T @ np.concatenate([u, v])), 1.0).reshape(3, 3) @ a
    return m / m[2, 2] if abs(m[2, 2]) > 1e-12 else None


def ransac(source: np.ndarray, target: np.ndarray, trials: int = TRIALS, near: float = INLIER) -> tuple[np.ndarray, np.ndarray] | None:
    """The map that most pairs of points agree on, and which they are: fits to four pairs at a time are voted on by all, and the winner is fitted again to those that agree."""
    if len(source) < SAMPLE:
        return None
    rng = np.random.default_rng(len(source))

    def agreeing(m: np.ndarray) -> np.ndarray:
        return ((applied(m, source) - target) ** 2).sum(axis=1) <= near * near

    best, votes = None, np.zeros(len(source), bool)
    for _ in range(trials):
        chosen = rng.choice(len(source), SAMPLE, replace=False)
        m = fit_homography(source[chosen], target[chosen])
        if m is not None and (found := agreeing(m)).sum() > votes.sum():
            best, votes = m, found
    if votes.sum() < SAMPLE:
        return None
    again = fit_homography(source[votes], target[votes])
    if again is not None and (found := agreeing(again)).sum() >= votes.sum():
        return again, found
    return best, votes


def fitted_pairs(matches: DataFrame) -> DataFrame:
    """a, b, n, inliers, h (nine numbers by rows; null without a fit) of each pair of frames, from rows (a, b, ax, ay, bx, by). A pair has as many rows as features are kept of a frame, at most."""
    import pandas as pd

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ax", "ay", "bx", "by"])
        found = ransac(pdf[["ax", "ay"]].to_numpy(float), pdf[["bx", "by"]].to_numpy(float))
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "n": [len(pdf)], "inliers": [int(found[1].sum()) if found else 0], "h": [found[0].ravel().tolist() if found else None]})

    kinds = [matches.schema[c].dataType.simpleString() for c in "ab"]
    return matches.groupBy("a", "b").applyInPandas(fit, f"a {kinds[0]}, b {kinds[1]}, n long, inliers long, h array<double>")


#: Cells of a grid of coverage along a frame's longer side.
CROP_EDGE = 1024


def auto_crop(rel_df: DataFrame, width: int, height: int) -> DataFrame:
    """frame_id, x, y, w, h: the largest rectangle of each frame without an uncovered pixel, in cells of the frame, one cell in from where it doesn't reach the edge, as shares of the frame; frames without one are left out. Cells are counted where pixels lie; a frame is then at most CROP_EDGE squared cells."""
    import pandas as pd

    size = max(1, -(-max(width, height) // CROP_EDGE))
    gw, gh = -(-width // size), -(-height // size)
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    full = rel_df.groupBy("frame_id", cell("y").alias("cy"), cell("x").alias("cx")).agg(F.min((F.col("a") >= 0.5).cast("int")).alias("full"), F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.lit(size), F.lit(width) - F.col("cx") * size) * F.least(F.lit(size), F.lit(height) - F.col("cy") * size)
    rows = full.filter((F.col("full") == 1) & (F.col("n") == wanted)).groupBy("frame_id", "cy").agg(F.collect_list("cx").alias("cells"))  # at most CROP_EDGE rows a frame

    def largest(pdf: pd.DataFrame) -> pd.DataFrame:
        covered = np.zeros((gh, gw), bool)
        for y, xs in zip(pdf["cy"], pdf["cells"], strict=True):
            covered[y, xs] = True
        high, best = np.zeros(gw, int), (0, 0, 0, 0, 0)
        for y in range(gh):
            high = np.where(covered[y], high + 1, 0)
            open_: list[tuple[int, int]] = []  # (first column, height), rising
            for x, tall in enumerate([*high.tolist(), 0]):
                first = x
                while open_ and open_[-1][1] >= tall:
                    first, top = open_.pop()
                    if top * (x - first) > best[0]:
                        best = (top * (x - first), first, y + 1 - top, x, y + 1)
                open_.append((first, tall))
        area, x0, y0, x1, y1 = best
        x0, y0, x1, y1 = x0 + (x0 > 0), y0 + (y0 > 0), x1 - (x1 < gw), y1 - (y1 < gh)
        if not area or x1 <= x0 or y1 <= y0:
            return pd.DataFrame({"frame_id": [], "x": [], "y": [], "w": [], "h": []})
        left, right = (min(c * size, width) / width for c in (x0, x1))
        top, foot = (min(c * size, height) / height for c in (y0, y1))
        return pd.DataFrame({"frame_id": [pdf["frame_id"].iloc[0]], "x": [left], "y": [top], "w": [right - left], "h": [foot - top]})

    return rows.groupBy("frame_id").applyInPandas(largest, f"frame_id {rel_df.schema['frame_id'].dataType.simpleString()}, x double, y double, w double, h double")
