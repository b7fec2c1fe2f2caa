"""Painted layers: strokes of colour, copies of other places, repairs, softening and erasing, folded in order into a transparent layer.

What strokes cover is drawn band by band and joined to the pixels; what they lay there (a colour, a sample from elsewhere, a repair, a
softened picture) is found for all strokes at once; then each pixel folds its own strokes in their order. Only a stroke that reads the
layer itself needs what the strokes before it made: there the layer is written and read again, so the plan grows with such strokes alone,
however many others there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.frame import IMAGE, KEY, Rel
from rasterloom.functions.tone import clamp, num
from rasterloom.operators.geometry import gathered
from rasterloom.operators.node import EngineError, Param, node
from rasterloom.operators.select import folded, listed
from rasterloom.operators.tiles import blurred, over_tiles
from rasterloom.session import checkpointed

#: Rows of pixels that a stroke is drawn in at once, samples along a pixel's side (of brushes under a pixel in the second place), and pixels of a repair that are solved together.
BAND, SAMPLES, FINE, MOST = 64, 4, 16, 2_000_000
OVER, SOFT, GENTLE, ERASE = 0, 1, 2, 3
LAID = ["lr", "lg", "lb", "la"]


@dataclass(frozen=True)
class Stroke:
    points: tuple[tuple[float, float], ...]
    radius: float
    hardness: float = 0.5
    flow: float = 1.0
    erase: bool = False
    blend: bool = False
    blur: bool = False
    blur_strength: float = 0.5
    blur_build: bool = False
    sample_layer: bool = False
    brush: str = ""
    color: str = ""
    src_dx: float = 0.0
    src_dy: float = 0.0
    heal: bool | None = None
    clip: str | None = None

    @staticmethod
    def read(item: dict) -> Stroke:
        try:
            given = {k: v for k, v in item.items() if k in Stroke.__annotations__ and v is not None}
            given["points"] = tuple((float(x), float(y)) for x, y in item["points"])
            return Stroke(**{"radius": 0.05} | given)
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            raise EngineError(f"paint: {e}") from e

    def kind(self, healing: bool) -> str:
        """What it lays: soft, erase, heal, clone, colour, or nothing."""
        if (self.blend or self.blur) and not self.erase:
            return "soft"
        if self.erase:
            return "erase"
        away, heals = self.src_dx != 0 or self.src_dy != 0, healing if self.heal is None else self.heal
        return ("heal" if heals else "clone") if away else "nothing" if heals else "colour"

    def reads_layer(self, kind: str) -> bool:
        return kind == "soft" and (self.blend or self.blur_build or self.sample_layer) or kind in ("heal", "clone") and self.sample_layer

    def rgb(self) -> tuple[float, ...]:
        """As it was picked, in display values; black if it is no colour."""
        h = self.color.removeprefix("#")
        try:
            return tuple(int(h[i : i + 2], 16) / 255 for i in (0, 2, 4)) if self.color.startswith("#") and len(h) == 6 else (0.0, 0.0, 0.0)
        except ValueError:
            return 0.0, 0.0, 0.0

    def sigma(self, short: int) -> float:
        return max(self.radius * short * 0.5, 0.6) if self.blend else max(self.radius * short * self.blur_strength, 0.3)


def from_path(points: list[tuple[float, float]], x: np.ndarray, y: np.ndarray, square: bool) -> np.ndarray:
    """The distance of places from a path, round or square."""
    best = np.full(x.shape, np.inf)
    for (ax, ay), (bx, by) in zip(points, points[1:] or points, strict=False):
        dx, dy, ex, ey = bx - ax, by - ay, x - ax, y - ay
        if not square:
            n = dx * dx + dy * dy
            t = np.clip((ex * dx + ey * dy) / n, 0, 1) if n > 0 else 0.0
            best = np.minimum(best, np.hypot(ex - t * dx, ey - t * dy))
            continue
        turns = [np.zeros(x.shape), np.ones(x.shape)]
        turns += [np.clip(p / q, 0, 1) for p, q in ((ex, dx), (ey, dy), (ex - ey, dx - dy), (ex + ey, dx + dy)) if abs(q) > 1e-12]
        for t in turns:
            best = np.minimum(best, np.maximum(np.abs(ex - t * dx), np.abs(ey - t * dy)))
    return best


def box_of(s: Stroke, w: int, h: int, ring: int = 0) -> tuple[int, int, int, int]:
    """First and last row and column that a stroke may cover."""
    r = max(s.radius * min(w, h), 1e-4) + 1
    xs, ys = [p[0] * w for p in s.points], [p[1] * h for p in s.points]
    return max(0, math.floor(min(ys) - r) - ring), min(h - 1, math.ceil(max(ys) + r) + ring), max(0, math.floor(min(xs) - r) - ring), min(w - 1, math.ceil(max(xs) + r) + ring)


def drawn(s: Stroke, y0: int, y1: int, x0: int, x1: int, w: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Coverage of pixels (the brush's profile, averaged over each), and whether their middles lie within the radius."""
    radius, square = max(s.radius * min(w, h), 1e-4), s.brush == "square"
    path = [(px * w, py * h) for px, py in s.points]
    inner = radius * min(1.0, max(0.0, s.hardness))
    y, x = np.mgrid[y0 : y1 + 1, x0 : x1 + 1].astype(float)
    n, total = FINE if radius < 1 else SAMPLES, 0.0
    for j in range(n):
        for i in range(n):
            d = from_path(path, x + (i + 0.5) / n, y + (j + 0.5) / n, square)
            t = np.clip((d - inner) / (radius - inner), 0, 1) if radius > inner else (d >= radius).astype(float)
            total = total + 1 - t * t * (3 - 2 * t)
    return np.clip(s.flow, 0, 1) * total / (n * n), from_path(path, x + 0.5, y + 0.5, square) <= radius


def covers(rel: Rel, strokes: dict[int, tuple[Stroke, str]]) -> DataFrame:
    """k, y, x, c (coverage), inside: the pixels of each stroke; of repairs, with a pixel around their box."""
    w, h = rel.width, rel.height
    boxes = {k: box_of(s, w, h, int(kind == "heal")) for k, (s, kind) in strokes.items()}
    bands = [(k, top, min(b[1], top + BAND - 1)) for k, b in boxes.items() for top in range(b[0], b[1] + 1, BAND)]
    spark = rel.df.sparkSession
    rows = spark.createDataFrame(bands, "k int, top int, foot int")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for k, top, foot in pdf.itertuples(index=False):
                s, kind = strokes[k]
                x0, x1 = boxes[k][2:]
                c, inside = drawn(s, top, foot, x0, x1, w, h)
                keep = np.ones(c.shape, bool) if kind == "heal" else c > 0
                y, x = np.nonzero(keep)
                yield pd.DataFrame({"k": k, "y": y + top, "x": x + x0, "c": c[keep], "inside": inside[keep]}).astype({"k": "int32", "y": "int32", "x": "int32"})

    return rows.repartition(max(1, min(len(bands), 4096)), "k", "top").mapInPandas(run, "k int, y int, x int, c double, inside boolean")


def by_stroke(values: dict[int, float | int], default, column: str = "k") -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col(column)), F.lit(default))


def sampled(source: Rel, at: DataFrame, strokes: dict[int, tuple[Stroke, str]]) -> DataFrame:
    """at(frame_id, k, y, x) with sr, sg, sb, sa: what each stroke reads from elsewhere; alpha 0 off the frame."""
    dx = by_stroke({k: float(s.src_dx * source.width) for k, (s, _) in strokes.items()}, 0.0)
    dy = by_stroke({k: float(s.src_dy * source.height) for k, (s, _) in strokes.items()}, 0.0)
    fx, fy = F.col("x") + num(0.5) + dx, F.col("y") + num(0.5) + dy
    inside = fx.between(0, source.width) & fy.between(0, source.height)
    found = gathered(source, at.filter(inside).select(*KEY, "k", (fx - num(0.5)).alias("_gx"), (fy - num(0.5)).alias("_gy")))
    found = found.select(*KEY, "k", *[F.col(c).alias(f"s{c}") for c in "rgba"])
    return at.select(*KEY, "k").join(found, [*KEY, "k"], "left").fillna(0.0, ["sr", "sg", "sb", "sa"])


def healed(inside: np.ndarray, frame: np.ndarray, dest: np.ndarray, source: np.ndarray, reads: np.ndarray) -> np.ndarray:
    """The colours (h, w, 3) inside a stroke whose differences are the source's and which meet the destination around it, by conjugate gradients; the destination elsewhere."""
    sides = ((0, 1), (0, -1), (1, 0), (-1, 0))

    def near(v, side, fill):
        out = np.full_like(v, fill)
        dy, dx = side
        h, w = v.shape[:2]
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = v[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
        return out

    n, right = np.zeros(inside.shape), np.zeros_like(dest)
    for side in sides:
        there, within = near(frame, side, False), near(inside, side, False)
        n += there
        slope = np.where((reads & near(reads, side, False) & there)[:, :, None], source - near(source, side, 0.0), 0.0)
        right += slope + np.where((there & ~within)[:, :, None], near(dest, side, 0.0), 0.0)
    hold = (inside & (n > 0))[:, :, None]

    def applied(v):
        return np.where(hold, n[:, :, None] * v - sum(np.where(near(inside, s, False)[:, :, None], near(v, s, 0.0), 0.0) for s in sides), 0.0)

    v = np.where(hold, dest, 0.0)
    r = np.where(hold, right, 0.0) - applied(v)
    p, size = r.copy(), (r * r).sum(axis=(0, 1))
    for _ in range(20 * sum(inside.shape) + 1000):
        if np.abs(r).max() < 1e-9:
            break
        q = applied(p)
        step = size / np.maximum((p * q).sum(axis=(0, 1)), 1e-300)
        v, r = v + step * p, r - step * q
        new = (r * r).sum(axis=(0, 1))
        p, size = r + new / np.maximum(size, 1e-300) * p, new
    else:
        raise RuntimeError("a repair didn't settle")
    return np.where(hold, v, dest)


def repairs(source: Rel, at: DataFrame, strokes: dict[int, tuple[Stroke, str]]) -> DataFrame:
    """frame_id, k, y, x, lr, lg, lb, la: what repairs lay. Each is solved by itself; those of over MOST pixels take the source with its mean shifted to the destination's."""
    import pandas as pd

    own = source.df.select(*KEY, *[F.col(c).alias(f"d{c}") for c in "rgb"])
    rows = checkpointed(at.join(own, KEY).join(sampled(source, at, strokes), [*KEY, "k"]))
    sizes = {k: (b := box_of(s, source.width, source.height, 1), (b[1] - b[0] + 1) * (b[3] - b[2] + 1))[1] for k, (s, _) in strokes.items()}
    large = [k for k, n in sizes.items() if n > MOST]
    frame = source.df.schema["frame_id"].dataType.simpleString()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = pdf["y"].min(), pdf["x"].min()
        at_ = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        shape = at_[0].max() + 1, at_[1].max() + 1

        def grid(columns, fill):
            out = np.full((*shape, len(columns)), fill)
            out[at_] = pdf[columns].to_numpy(float)
            return out

        inside, frame_, reads = np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, bool)
        inside[at_], frame_[at_], reads[at_] = pdf["inside"].to_numpy(bool), True, pdf["sa"].to_numpy(float) > 0
        found = np.clip(healed(inside, frame_, grid(["dr", "dg", "db"], 0.0), grid(["sr", "sg", "sb"], 0.0), reads), 0, 1)[at_]
        return pd.DataFrame({"frame_id": pdf["frame_id"], "k": pdf["k"], "y": pdf["y"], "x": pdf["x"], "lr": found[:, 0], "lg": found[:, 1], "lb": found[:, 2], "la": 1.0})

    small = rows.filter(~F.col("k").isin(large)) if large else rows
    out = small.groupBy("frame_id", "k").applyInPandas(solve, f"frame_id {frame}, k int, y int, x int, lr double, lg double, lb double, la double")
    if large:
        wide = rows.filter(F.col("k").isin(large) & (F.col("sa") > 0))
        shifts = wide.groupBy("frame_id", "k").agg(*[(F.sum((F.col(f"d{c}") - F.col(f"s{c}")) * F.col("c")) / F.sum("c")).alias(f"m{c}") for c in "rgb"])
        wide = wide.join(shifts, ["frame_id", "k"]).select(*KEY, "k", *[clamp(F.col(f"s{c}") + F.col(f"m{c}")).alias(f"l{c}") for c in "rgb"], num(1).alias("la"))
        out = out.unionByName(wide.select(*out.columns))
    return out


def softened(source: Rel, at: DataFrame, strokes: dict[int, tuple[Stroke, str]]) -> DataFrame:
    """frame_id, k, y, x, lr, lg, lb, la: a premultiplied picture blurred by each stroke's own sigma where it covers; strokes of one sigma share a blur, over the rows and columns that they need."""
    short, out = min(source.width, source.height), None
    by_sigma: dict[float, list[int]] = {}
    for k, (s, _) in strokes.items():
        by_sigma.setdefault(s.sigma(short), []).append(k)
    for sigma, ks in by_sigma.items():
        reach = math.ceil(3 * sigma) + 1
        boxes = [box_of(strokes[k][0], source.width, source.height, reach) for k in ks]
        near = None
        for y0, y1, x0, x1 in boxes:
            here = F.col("y").between(y0, y1) & F.col("x").between(x0, x1)
            near = here if near is None else near | here

        def run(planes, y0, x0, sigma=sigma):
            return {f"l{c}": blurred(planes[c], sigma) for c in "rgba"} | {"there": planes["there"]}

        soft = over_tiles(source.df.filter(near), source.width, source.height, reach, ["r", "g", "b", "a"], LAID, run)
        part = at.filter(F.col("k").isin(ks)).select(*KEY, "k").join(soft, KEY)
        out = part if out is None else out.unionByName(part)
    return out.select(*KEY, "k", *LAID)


def coat(acc: Column, s: Column) -> Column:
    """The layer under one more stroke: state r, g, b, a; stroke c, how, lr, lg, lb, la."""
    a, how = acc["a"], s["how"]
    there = clamp(s["la"])
    soft = (how == SOFT) | (how == GENTLE)
    c = clamp(s["c"]) * F.when(soft, there).otherwise(num(1))
    full = c + a * (num(1) - c)
    nothing = (c <= 0) | ((how == OVER) & (s["la"] <= 0))

    def channel(k: str) -> Column:
        lay = F.when(soft, clamp(s[f"l{k}"] / F.greatest(there, num(1e-6)))).otherwise(s[f"l{k}"])
        return F.when(nothing | (how == ERASE), acc[k]).otherwise((lay * c + acc[k] * a * (num(1) - c)) / F.greatest(full, num(1e-6))).alias(k)

    alpha = F.when(nothing, a).when(how == ERASE, a * (num(1) - c)).when(how == GENTLE, F.greatest(a, c)).otherwise(full)
    return F.struct(*map(channel, "rgb"), alpha.alias("a"))


def laid(rel: Rel, canvas: DataFrame | None, run: dict[int, tuple[Stroke, str]]) -> DataFrame:
    """frame_id, y, x, r, g, b, a: the layer after a run of strokes, where there is anything. canvas is the layer before it, None if empty."""
    clips = {text: f"_clip{i}" for i, text in enumerate(dict.fromkeys(s.clip for s, _ in run.values() if s.clip))}
    base = rel.df.select(*KEY, *[folded(rel, listed(text, "paint")).alias(name) for text, name in clips.items()])
    at = base.join(covers(rel, run), ["y", "x"])
    for text, name in clips.items():
        mine = [k for k, (s, _) in run.items() if s.clip == text]
        at = at.withColumn("c", F.when(F.col("k").isin(mine), F.col("c") * F.col(name)).otherwise(F.col("c")))
    at = checkpointed(at.select(*KEY, "k", "c", "inside"))
    layer = Rel(rel.df.select(*KEY).join(canvas, KEY, "left").fillna(0.0, [*"rgba"]), IMAGE, rel.width, rel.height) if canvas is not None else None

    def of(kind: str, reads: bool | None = None) -> dict[int, tuple[Stroke, str]]:
        return {k: v for k, v in run.items() if v[1] == kind and (reads is None or v[0].sample_layer == reads)}

    def rows(strokes) -> DataFrame:
        return at.filter(F.col("k").isin(list(strokes)))

    parts = []
    for reads in (False, True):
        source = layer if reads and layer is not None else rel.image(num(0), num(0), num(0), num(0)) if reads else rel
        if found := of("clone", reads):
            parts.append(sampled(source, rows(found), found).select(*KEY, "k", *[clamp(F.col(f"s{c}")).alias(f"l{c}") for c in "rgb"], F.col("sa").alias("la")))
        if found := of("heal", reads):
            parts.append(repairs(source, rows(found), found))
    for build in (False, True):
        for reads in (False, True):
            found = {k: v for k, v in of("soft", reads).items() if (v[0].blend or v[0].blur_build or reads) == build}
            if not found:
                continue
            a = F.coalesce("c_a", num(0)) if build and layer is not None else num(0)
            joined = rel.joined(layer, "c_") if layer is not None else rel.df
            under = num(0) if reads else F.col("a") * (num(1) - a)
            mixed = [(F.coalesce(f"c_{c}", num(0)) * a if layer is not None else num(0)) + (num(0) if reads else F.col(c) * under) for c in "rgb"]
            source = Rel(joined, IMAGE, rel.width, rel.height).image(*mixed, a + under)
            parts.append(softened(source, rows(found), found))
    lays = None
    for part in parts:
        part = part.select(*KEY, "k", *LAID)
        lays = part if lays is None else lays.unionByName(part)
    how = by_stroke({k: ERASE if kind == "erase" else OVER if kind != "soft" else SOFT if s.blend or s.blur_build else GENTLE for k, (s, kind) in run.items()}, OVER)
    plain = at.filter("c > 0")
    if lays is not None:
        plain = plain.join(lays, [*KEY, "k"], "left")
    colours = {k: s.rgb() for k, (s, kind) in run.items() if kind == "colour"}
    for i, c in enumerate("rgb"):
        fixed = by_stroke({k: float(v[i]) for k, v in colours.items()}, 0.0)
        plain = plain.withColumn(f"l{c}", F.coalesce(f"l{c}", fixed) if lays is not None else fixed)
    whole = by_stroke({k: 1.0 for k, (_, kind) in run.items() if kind in ("colour", "erase")}, 0.0)
    plain = plain.withColumn("la", F.coalesce("la", whole) if lays is not None else whole)
    coats = plain.withColumn("how", how).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "c", "how", *LAID))).alias("coats"))
    if canvas is not None:
        coats = coats.join(canvas, KEY, "full")
    start = F.struct(*[(F.coalesce(c, num(0)) if canvas is not None else num(0)).alias(c) for c in "rgba"])
    done = F.aggregate(F.coalesce("coats", F.array().cast(coats.schema["coats"].dataType)), start, coat)
    return coats.select(*KEY, done.alias("o")).select(*KEY, *[F.col(f"o.{c}").alias(c) for c in "rgba"])


@node("paint", takes=("clip",), strokes=Param("[]"), heal=Param(False))
def paint(inputs, p):
    """A transparent layer with strokes laid on in order, over the picture that they may read."""
    rel = inputs["in"]
    strokes = [Stroke.read(s) for s in listed(p["strokes"], "paint")]
    runs: list[dict[int, tuple[Stroke, str]]] = [{}]
    for k, s in enumerate(strokes):
        kind = s.kind(p["heal"])
        if not s.points or kind == "nothing":
            continue
        if s.reads_layer(kind) and any(runs):
            runs.append({})
        runs[-1][k] = (s, kind)
    canvas = None
    for i, run in enumerate(r for r in runs if r):
        canvas = laid(rel, canvas, run)
        if i < len(runs) - 1:
            canvas = checkpointed(canvas)
    if canvas is None:
        return rel.image(num(0), num(0), num(0), num(0))
    return Rel(rel.df.select(*KEY).join(canvas, KEY, "left").fillna(0.0, [*"rgba"]), IMAGE, rel.width, rel.height)


@node("clone", strokes=Param("[]"), heal=Param(False))
def clone(inputs, p):
    """Copies and repairs alone: the same strokes."""
    return paint(inputs, p)
