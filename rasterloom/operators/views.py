"""What a node changes, and what of a picture shows: views of two pictures, and cuts to the bounds of coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, Rel
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.node import EngineError

# The change of display tone that is painted in full, how far the picture is dimmed under the paint, how far a difference is magnified, and the paints.
FULL_CHANGE, DIM, ISOLATED = 0.15, 0.35, 2.0
BRIGHTER, DARKER, COLOUR = (1.0, 0.55, 0.12), (0.2, 0.55, 1.0), (0.95, 0.25, 0.85)
MODES = ("luma", "color", "both", "isolate")


def influence(before: Rel, after: Rel, mode: str = "both") -> Rel | None:
    """Where and how a node changes a picture, painted over its dimmed result, or the magnified difference alone; None if it changes the size."""
    if mode not in MODES:
        raise EngineError(f"no view {mode!r}")
    if not before.same_size(after):
        return None
    df = after.joined(before, "i_", "inner")
    shown = {c: t.encode(F.greatest(c, num(0))) for c in "rgb"}
    first = {c: t.encode(F.greatest(f"i_{c}", num(0))) for c in "rgb"}
    rel = Rel(df.withColumns({f"_d{c}": shown[c] - first[c] for c in "rgb"}), IMAGE, after.width, after.height)
    if mode == "isolate":
        return rel.image(*[t.decode(t.clamp(num(0.5) + num(ISOLATED) * F.col(f"_d{c}"))) for c in "rgb"])
    y = t.encode(F.greatest(t.luma(*[F.col(c) for c in "rgb"]), num(0)))
    y0 = t.encode(F.greatest(t.luma(*[F.col(f"i_{c}") for c in "rgb"]), num(0)))
    df = rel.df.withColumn("_y", y).withColumn("_dl", y - y0)
    apart = F.sqrt(sum(((F.col(f"_d{c}") - F.col("_dl")) * (F.col(f"_d{c}") - F.col("_dl")) for c in "rgb"), num(0)))
    part = lambda v: F.least(v / num(FULL_CHANGE), num(1))
    df = df.withColumn("_tl", num(0) if mode == "color" else part(F.abs("_dl"))).withColumn("_tc", num(0) if mode == "luma" else part(apart))
    both, k = F.col("_tl") + F.col("_tc"), F.least(F.col("_tl") + F.col("_tc"), num(1))
    out = []
    for i in range(3):
        light = F.when(F.col("_dl") >= 0, num(BRIGHTER[i])).otherwise(num(DARKER[i]))
        paint = F.when(both > 0, (light * F.col("_tl") + num(COLOUR[i]) * F.col("_tc")) / F.when(both > 0, both).otherwise(num(1))).otherwise(num(0))
        out.append(t.decode(t.clamp(F.col("_y") * num(DIM) * (num(1) - k) + paint * k)))
    return Rel(df, IMAGE, after.width, after.height).image(*out)


def bounds(rel: Rel, floor: float = 1e-6, coverage: Rel | None = None) -> DataFrame:
    """frame_id, x, y, width, height of what shows of each frame: alpha, times a coverage field if there is one, of at least floor. Frames that don't show are left out."""
    df, a = rel.df, t.clamp(F.col("a"))
    if coverage is not None:
        df = df.hint("merge").join(coverage.df.select(*KEY, F.col("v" if coverage.kind == FIELD else "r").alias("_v")), KEY, "left")
        a = a * t.clamp(F.coalesce("_v", num(0)))
    found = df.filter(a >= floor).groupBy("frame_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return found.select("frame_id", "x", "y", (F.col("x1") - F.col("x") + 1).alias("width"), (F.col("y1") - F.col("y") + 1).alias("height"))


def cut(rel: Rel, floor: float = 1e-6, coverage: Rel | None = None) -> DataFrame:
    """Each frame's pixels within the bounds of what shows, from 0 there, with the alpha that shows. One row a frame is sent to all tasks."""
    box = bounds(rel, floor, coverage).select("frame_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "width", "height")
    df, a = rel.df, t.clamp(F.col("a"))
    if coverage is not None:
        df = df.hint("merge").join(coverage.df.select(*KEY, F.col("v" if coverage.kind == FIELD else "r").alias("_v")), KEY, "left")
        a = a * t.clamp(F.coalesce("_v", num(0)))
    inside = df.join(F.broadcast(box), "frame_id").withColumn("x", F.col("x") - F.col("_x")).withColumn("y", F.col("y") - F.col("_y"))
    inside = inside.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))
    return inside.select("frame_id", "y", "x", "r", "g", "b", a.alias("a"))
