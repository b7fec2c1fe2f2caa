"""Merging frames: group-bys on the pixel place over a stack of fields or pictures."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.frame import KEY, Rel
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.tiles import CORE
from rasterloom.session import written

READ_VARIANCE = (3 / 40_000) ** 2
MODES = ("mean", "median", "max", "min", "hdr")


def finite(c: Column) -> Column:
    """c where it is a finite number, else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def sample_weight(v: Column, exposure: Column) -> Column:
    """Trust in a sample: squared exposure over its noise, nothing where it nears saturation."""
    return (num(1) - t.ramp(v, 0.80, 0.95)) * exposure * exposure / (num(READ_VARIANCE) + F.abs(v) / num(40_000))


def anchor(exposures: Sequence[float]) -> float:
    """The middle of the exposures relative to the first; of an even number the geometric mean of the two in the middle."""
    good = [e for e in exposures if 0 < e < float("inf")]
    if not good:
        return 1.0
    s = sorted(e / good[0] for e in good)
    k = len(s) // 2
    return s[k] if len(s) % 2 else float(np.sqrt(s[k - 1] * s[k]))


def merge_frames(frames: DataFrame, mode: str, channels: Sequence[str] = ("r", "g", "b"), by: Sequence[str] = ("y", "x"), exposures: dict | None = None, frame_col: str = "frame_id") -> DataFrame:
    """One frame of a stack: per place and channel over its finite samples; 0 where there are none. hdr takes each frame's exposure."""
    if mode not in MODES:
        raise ValueError(f"no stack mode {mode!r}")
    if mode != "hdr":
        of = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}[mode]
        return frames.groupBy(*by).agg(*[F.coalesce(of(finite(F.col(c))), num(0)).alias(c) for c in channels])
    if not exposures:
        raise ValueError("hdr needs the frames' exposures")
    first = next(iter(exposures.values()))
    spark = frames.sparkSession
    table = spark.createDataFrame([(k, float(e) / float(first)) for k, e in exposures.items()], f"_frame {frames.schema[frame_col].dataType.simpleString()}, _e double")
    df = frames.join(F.broadcast(table), F.col(frame_col) == F.col("_frame"))  # one row a frame of the stack
    aggregates = []
    for c in channels:
        v = finite(F.col(c))
        w = sample_weight(v, F.col("_e"))
        aggregates += [F.sum(w * v / F.col("_e")).alias(f"_s{c}"), F.sum(w).alias(f"_w{c}"), F.max(v / F.col("_e")).alias(f"_b{c}")]
    scale = num(anchor(list(exposures.values())))
    out = df.groupBy(*by).agg(*aggregates)
    return out.select(*by, *[(scale * F.coalesce(F.when(F.col(f"_w{c}") > 0, F.col(f"_s{c}") / F.col(f"_w{c}")).otherwise(F.col(f"_b{c}")), num(0))).alias(c) for c in channels])


def stack(rel: Rel, mode: str, exposures: dict | None = None) -> Rel:
    """All frames of a relation merged into frame 0, opaque."""
    out = merge_frames(rel.df, mode, rel.channels[:3] if rel.kind == "image" else rel.channels, ("y", "x"), exposures)
    out = out.withColumn("frame_id", F.lit(0))
    if rel.kind == "image":
        out = out.withColumn("a", num(1))
    return Rel(out.select(*KEY, *rel.channels), rel.kind, rel.width, rel.height)


def exposure_ratios(samples: dict, low: float = 0.02, high: float = 0.85) -> dict:
    """Exposures of frames from luma samples at shared places, each chained to the next darker frame through the places that both expose well; frames in order of median and mean. The first key is 1."""
    order = sorted(samples, key=lambda k: (float(np.median(samples[k])), float(np.mean(samples[k])), str(k)))
    found = {order[0]: 1.0}
    for i, k in enumerate(order[1:], 1):
        for back in reversed(order[:i]):
            a, b = np.asarray(samples[back], float), np.asarray(samples[k], float)
            good = (a > low) & (a < high) & (b > low) & (b < high)
            if good.sum() >= 8:
                found[k] = found[back] * max(1e-4, float(np.median(b[good] / a[good])))
                break
        else:
            found[k] = found[order[i - 1]]
    first = next(iter(samples))
    return {k: found[k] / found[first] for k in samples}


def noise_levels(rel: Rel, tile: int = 16, bins: int = 8, least: int = 4) -> DataFrame:
    """luma_sigma, chroma_sigma: tiles' deviations in display values by brightness, a low percentile of each well-filled bin, the mean of the two lowest."""
    y = t.luma(F.col("r"), F.col("g"), F.col("b"))
    tx, ty = F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)
    inside = ((tx + 1) * tile <= rel.width) & ((ty + 1) * tile <= rel.height)
    df = rel.df.withColumn("_y", y).filter(inside).select("frame_id", tx.alias("tx"), ty.alias("ty"), t.encode(F.greatest("_y", num(0))).alias("l"), (t.encode(F.abs(F.col("r") - F.col("_y"))) + t.encode(F.abs(F.col("b") - F.col("_y")))).alias("c"))
    tiles = df.groupBy("frame_id", "tx", "ty").agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("ls"), F.stddev_pop("c").alias("cs"))
    tiles = tiles.withColumn("bin", F.least(F.floor(F.col("m") * bins), F.lit(bins - 1)))
    out = None
    for name, c in (("luma_sigma", "ls"), ("chroma_sigma", "cs")):
        w = Window.partitionBy("frame_id", "bin")
        ranked = tiles.select("frame_id", "bin", c, F.row_number().over(w.orderBy(c)).alias("k"), F.count(F.lit(1)).over(w).alias("n")).filter(F.col("n") >= least)
        takes = ranked.filter(F.col("k") == F.floor((F.col("n") - 1) * num(0.1) + num(0.5)) + 1)
        low = takes.withColumn("i", F.row_number().over(Window.partitionBy("frame_id").orderBy(c))).filter("i <= 2").groupBy("frame_id").agg(F.avg(c).alias(name))
        out = low if out is None else out.join(low, "frame_id", "full")
    return rel.df.select("frame_id").distinct().join(out, "frame_id", "left").fillna(0.0)


#: Bins of a histogram of chroma, up to the largest; the last takes the rest.
CHROMA_BINS, CHROMA_MOST = 500, 0.5


def chroma_histogram(rel: Rel, smoothing: float = 50.0) -> DataFrame:
    """frame_id, bin, share of each frame's pixels by OkLab chroma, their own or that of their smoothed surroundings if that is less. Every pixel counts."""
    from rasterloom.operators.spatial import box_columns

    lab = t.to_oklab(*[F.greatest(F.col(c), num(0)) for c in ("r", "g", "b")])
    df = rel.df.select(*KEY, lab[1].alias("_a"), lab[2].alias("_b")).withColumn("_sa", F.col("_a")).withColumn("_sb", F.col("_b"))
    radius = int(min(rel.width, rel.height) * 0.02 * min(1.0, smoothing / 100))
    if radius:
        df = box_columns(df, ["_sa", "_sb"], radius, rel.width, rel.height, True)
    chroma = F.least(F.hypot("_a", "_b"), F.hypot("_sa", "_sb"))
    at = F.least(F.floor(chroma / num(CHROMA_MOST) * num(CHROMA_BINS)), F.lit(CHROMA_BINS - 1)).cast("int")
    counted = df.groupBy("frame_id", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("frame_id", "bin", (F.col("n") / num(rel.width * rel.height)).alias("share"))


def region_coverage(labels: Rel, x: float, y: float, cells: int) -> DataFrame:
    """frame_id, gy, gx, covered: how much of each cell of a grid belongs to the region at a place, from 0 to 255, for a field of labels."""
    w, h = labels.width, labels.height
    at_x, at_y = min(int(x * w), w - 1), min(int(y * h), h - 1)
    target = labels.df.filter((F.col("x") == at_x) & (F.col("y") == at_y)).select("frame_id", F.col("v").alias("_target"))
    gx, gy = (F.least(F.floor(F.col(c) * F.lit(cells) / F.lit(n)), F.lit(cells - 1)).cast("int").alias(f"g{c}") for c, n in (("x", w), ("y", h)))
    parts = labels.df.select("frame_id", gy, gx, "v").groupBy("frame_id", "gy", "gx", "v").agg(F.count(F.lit(1)).alias("n"))
    joined = parts.join(F.broadcast(target), "frame_id")
    return joined.groupBy("frame_id", "gy", "gx").agg(F.floor(F.sum(F.when(F.col("v") == F.col("_target"), F.col("n")).otherwise(F.lit(0))) * F.lit(255) / F.sum("n")).cast("int").alias("covered"))


#: Luma values this share of a frame's middle half from its median tell nothing, and a shift needs so many places that do.
TOLERANCE, LEAST_TOLERANCE, LEAST_PLACES = 0.05, 1e-4, 16
#: How exact the approximate percentiles are that tell where to look for the exact ones, as values in one wrong; frames of up to FEW values are looked through.
ACCURACY, FEW = 10_000, 100_000
#: Places of a row that lie in one number, as its bits 1 to 62; bits 0 and 63 are for the neighbours.
WORD = 62


def quartiles(lumas: DataFrame) -> DataFrame:
    """frame_id, _q: the three quartiles of each frame's l, as percentile gives them. Only values near them are told apart: approximate percentiles bound where each must lie, and the values between these bounds are counted as one."""
    shares = (0.25, 0.5, 0.75)
    v = F.when(F.isnan("l"), num(float("inf"))).otherwise(F.col("l"))
    lumas = lumas.filter(F.col("l").isNotNull()).withColumn("_v", v)
    reach = F.percentile_approx("_v", [s + d / ACCURACY for s in shares for d in (-2, 2)], ACCURACY)
    bounds = lumas.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_n"), reach.alias("_e"))  # one row a frame
    bounds = bounds.select("frame_id", "_n", *[F.when(F.col("_n") > FEW, F.col("_e")[2 * i + k]).otherwise(num(e)).alias(f"_{name}{i}") for i in range(3) for k, (name, e) in enumerate((("low", float("-inf")), ("high", float("inf"))))])
    df = lumas.join(F.broadcast(written(bounds)), "frame_id")
    near = F.lit(False)
    for i in range(3):
        near = near | F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}"))
    after = sum(((F.col("_v") > F.col(f"_high{i}")).cast("int") for i in range(3)), F.lit(0))
    counted = df.groupBy("frame_id", "_n", near.alias("_near"), after.alias("_after"), F.when(near, F.col("l")).alias("_own")).agg(F.min("l").alias("l"), F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy("frame_id").orderBy("l").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto)
    place = {s: num(s) * (F.col("_n") - 1) for s in shares}
    one = F.when(F.col("_near"), F.col("l")).otherwise(F.raise_error(F.lit("a quartile is not where its bounds are")))
    at = lambda rank: F.max(F.when((F.col("_upto") - F.col("_k") <= rank) & (rank < F.col("_upto")), one))
    found = ranked.groupBy("frame_id", "_n").agg(*[at(of(place[s])).alias(f"{name}{i}") for i, s in enumerate(shares) for name, of in (("_a", F.floor), ("_b", F.ceil))])
    between = [F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise((F.ceil(place[s]) - place[s]) * F.col(f"_a{i}") + (place[s] - F.floor(place[s])) * F.col(f"_b{i}")) for i, s in enumerate(shares)]
    return found.select("frame_id", F.array(*between).alias("_q"))


def thresholded(lumas: DataFrame) -> DataFrame:
    """frame_id, y, x, bit: whether a place is brighter than its frame's median, where it clearly is or isn't."""
    df = lumas.join(F.broadcast(written(quartiles(lumas))), "frame_id")  # one row a frame
    near = F.greatest((F.col("_q")[2] - F.col("_q")[0]) * num(TOLERANCE), num(LEAST_TOLERANCE))
    return df.filter(F.abs(F.col("l") - F.col("_q")[1]) >= near).select("frame_id", "y", "x", (F.col("l") > F.col("_q")[1]).alias("bit"))


def shifted(c: Column, by: int) -> Column:
    """A number's bits, each by places further."""
    return F.shiftleft(c, by) if by > 0 else F.shiftrightunsigned(c, -by) if by < 0 else c


def in_words(bits: DataFrame, around: int) -> DataFrame:
    """frame_id, y, word, known, bright: WORD places of a row as the bits of two numbers, those that have a bit and those where it is set; with around, the place to each side too."""
    word = lambda d: F.floor((F.col("x") + d) / WORD).cast("int")
    df = bits.withColumn("word", F.explode(F.sequence(word(-1), word(1))) if around else word(0))
    at = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x") - F.col("word") * WORD + 1)
    return df.groupBy("frame_id", "y", "word").agg(F.bit_or(at).alias("known"), F.bit_or(F.when(F.col("bit"), at).otherwise(F.lit(0).cast("long"))).alias("bright"))


def find_shifts(rel: Rel, base: int, radius: int) -> DataFrame:
    """frame_id, dx, dy: whole-pixel shifts that best line frames up with one of them. Frames are halved until a search of one pixel to each side finds the coarsest shift, which every finer level doubles and corrects; a shift's error is the share of places whose bits differ, of all that both frames have. Each level is written and its places packed into words; one join brings each word of the base frame to the three rows that candidates look for it from, and counts bits for three columns at once, so that one row a frame and row remains."""
    spark = rel.df.sparkSession
    levels, w, h = [], rel.width, rel.height
    lumas = rel.df.select(*KEY, t.luma(F.col("r"), F.col("g"), F.col("b")).alias("l"))
    for k in range(max(0, int(np.ceil(np.log2(max(1, radius))))) + 1):
        if k:
            if w < 16 or h < 16:
                break
            w, h = w // 2, h // 2
            half = lumas.filter((F.col("x") < 2 * w) & (F.col("y") < 2 * h))
            lumas = half.groupBy("frame_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.avg("l").alias("l"))
        lumas = written(lumas.repartition("frame_id", F.floor(F.col("y") / CORE), F.floor(F.col("x") / CORE)))  # what is halved and packed together is met in one task
        levels.append(lumas)
    shifts = {r[0]: (0, 0) for r in levels[0].select("frame_id").distinct().collect()}
    for k in range(len(levels) - 1, -1, -1):
        bits = thresholded(levels[k])
        if k < len(levels) - 1:
            shifts = {f: (2 * dx, 2 * dy) for f, (dx, dy) in shifts.items()}
        moved = spark.createDataFrame([(f, *s) for f, s in shifts.items()], "frame_id int, _dx int, _dy int")  # one row a frame
        still = in_words(bits.filter(F.col("frame_id") == base), 1).withColumn("j", F.explode(F.array(*[F.lit(j) for j in (-1, 0, 1)])))
        still = still.select((F.col("y") + F.col("j")).alias("y"), "word", "j", F.col("known").alias("_known"), F.col("bright").alias("_bright"))
        wide = in_words(bits.join(F.broadcast(moved), "frame_id").select("frame_id", (F.col("y") - F.col("_dy")).alias("y"), (F.col("x") - F.col("_dx")).alias("x"), "bit"), 0)
        counts = []
        for i in (-1, 0, 1):
            both = F.col("known").bitwiseAND(shifted(F.col("_known"), i))
            differ = both.bitwiseAND(F.col("bright").bitwiseXOR(shifted(F.col("_bright"), i)))
            counts.append(F.struct(F.lit(i).alias("i"), F.sum(F.bit_count(differ)).alias("e"), F.sum(F.bit_count(both)).alias("n")))
        errors = wide.join(still.hint("merge"), ["y", "word"]).groupBy("frame_id", "j").agg(F.array(*counts).alias("c")).select("frame_id", "j", F.inline("c"))
        order = F.struct((F.col("e") / F.col("n")).alias("e"), (F.abs("i") + F.abs("j") > 0).alias("away"), (3 * (F.col("j") + 1) + F.col("i") + 1).alias("turn"), "i", "j")
        best = errors.filter(F.col("n") >= LEAST_PLACES).groupBy("frame_id").agg(F.min(order).alias("b"))
        shifts |= {r[0]: (shifts[r[0]][0] + r[1], shifts[r[0]][1] + r[2]) for r in best.select("frame_id", "b.i", "b.j").collect()}  # one row a frame
    return spark.createDataFrame([(f, *s) for f, s in sorted(shifts.items())], "frame_id int, dx int, dy int")
