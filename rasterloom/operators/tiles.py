"""Frames as square tiles with their surroundings, for what needs many pixels around each one at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.frame import KEY

#: Pixels along a tile's side.
CORE = 256
#: What a tile's function gets: its planes by name, and where its first row and column lie in the frame.
Planes = dict[str, np.ndarray]


def over_tiles(df: DataFrame, width: int, height: int, around: int, planes: list[str], gives: list[str], function: Callable[[Planes, int, int], Planes], core: int = CORE, fill: float = 0.0, by: list[str] | None = None) -> DataFrame:
    """The keys of df and the double columns gives, of every pixel that function gives for its tile.

    Each tile goes to a task with the pixels up to around beyond its sides, no further than the frame's edge; pixels that aren't there hold
    fill, and the plane "there" says which are. function takes arrays of that size and returns arrays of it; the tile's own part is kept. The
    result is the same wherever tiles begin if each pixel needs no more than around it. A pixel is sent to the tiles that need it, about
    (1 + 2 around / core) squared, in one shuffle."""
    keys = [k for k in (by or KEY) if k not in ("y", "x")]
    nx, ny = -(-width // core), -(-height // core)

    def near(c: str, n: int):
        low, high = (F.floor((F.col(c) + d) / core) for d in (-around, around))
        return F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(n - 1)).cast("int")))

    dealt = df.select(*keys, "y", "x", *[F.col(p).cast("double").alias(p) for p in planes]).withColumn("_ty", near("y", ny)).withColumn("_tx", near("x", nx))
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "y int", "x int", *[f"`{g}` double" for g in gives]])

    def run(key, pdf):
        import pandas as pd

        *own, ty, tx = key
        ty, tx = int(ty), int(tx)
        y0, x0 = max(0, ty * core - around), max(0, tx * core - around)
        y1, x1 = min(height, ty * core + core + around), min(width, tx * core + core + around)
        at = (pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0)
        given = {}
        for p in planes:
            given[p] = np.full((y1 - y0, x1 - x0), fill)
            given[p][at] = pdf[p].to_numpy(float)
        given["there"] = np.zeros((y1 - y0, x1 - x0), bool)
        given["there"][at] = True
        out = function(given, y0, x0)
        a, b = ty * core - y0, tx * core - x0
        part = np.s_[a : a + min(core, height - ty * core), b : b + min(core, width - tx * core)]
        ys, xs = np.mgrid[part]
        keep = out["there"][part].ravel() if "there" in out else np.ones(ys.size, bool)
        columns = {k: [v] * int(keep.sum()) for k, v in zip(keys, own, strict=True)}
        columns |= {"y": (ys.ravel() + y0)[keep], "x": (xs.ravel() + x0)[keep]} | {g: out[g][part].ravel()[keep] for g in gives}
        return pd.DataFrame(columns)

    return dealt.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema)


def kernel(sigma: float) -> np.ndarray:
    """Weights of a gaussian, three deviations to each side."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def blurred(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, with the edge's values beyond the edge."""
    if sigma <= 0:
        return v
    k = kernel(sigma)
    r = len(k) // 2
    for axis in (1, 0):
        wide = np.pad(v, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n = v.shape[axis]
        v = sum(w * (wide[:, i : i + n] if axis else wide[i : i + n]) for i, w in enumerate(k))
    return v
