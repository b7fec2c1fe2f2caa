"""Rasters as relations: one row a pixel, keyed by (frame_id, y, x)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["frame_id", "y", "x"]
IMAGE, FIELD = "image", "field"
CHANNELS = {IMAGE: ["r", "g", "b", "a"], FIELD: ["v"]}


@dataclass(frozen=True)
class Rel:
    """A raster: its rows, whether it is a picture (r, g, b, a) or a field (v), and the size that all its frames have."""

    df: DataFrame
    kind: str
    width: int
    height: int

    @property
    def channels(self) -> list[str]:
        return CHANNELS[self.kind]

    def same_size(self, other: Rel) -> bool:
        return (self.width, self.height) == (other.width, other.height)

    def image(self, r: Column, g: Column, b: Column, a: Column | None = None) -> Rel:
        alpha = F.col("a") if a is None else a
        return replace(self, df=self.df.select(*KEY, r.alias("r"), g.alias("g"), b.alias("b"), alpha.alias("a")), kind=IMAGE)

    def field(self, v: Column) -> Rel:
        return replace(self, df=self.df.select(*KEY, v.alias("v")), kind=FIELD)

    def joined(self, other: Rel, prefix: str, how: str = "left") -> DataFrame:
        """This raster's rows with another's channels, prefixed, on the pixel key; by merging, as a file of pixels may be small enough for a broadcast that its rows don't fit."""
        renamed = other.df.select(*KEY, *[F.col(c).alias(f"{prefix}{c}") for c in other.channels])
        return self.df.hint("merge").join(renamed, KEY, how)


def image_rel(df: DataFrame, width: int, height: int) -> Rel:
    return Rel(df.select(*KEY, *CHANNELS[IMAGE]), IMAGE, width, height)


def field_rel(df: DataFrame, width: int, height: int) -> Rel:
    return Rel(df.select(*KEY, "v"), FIELD, width, height)


def frame_from_events(events: DataFrame, width: int = 100) -> Rel:
    """The events table as one picture, row-major by event_id: value, user and a hash as channels, half transparent where the event is an error."""
    n = events.count()
    at = F.col("event_id")
    df = events.select(
        F.lit(0).alias("frame_id"),
        F.floor(at / F.lit(float(width))).cast("int").alias("y"),
        (at % width).cast("int").alias("x"),
        (F.col("value") / F.lit(500.0)).alias("r"),
        ((F.col("user_id") % 97).cast("double") / F.lit(97.0)).alias("g"),
        ((at * 7919 % 1009).cast("double") / F.lit(1009.0)).alias("b"),
        F.when(F.col("event_type") == "error", F.lit(0.5)).otherwise(F.lit(1.0)).alias("a"),
    )
    return image_rel(df, width, -(-n // width))


def scene_from_events(events: DataFrame, frames: int = 3, width: int = 100) -> Rel:
    """The events table as several pictures of scene light, dealt in turn by event_id: channels from -0.5 to 4, alpha 0 where the event is a signup and half where it is an error."""
    n = -(-events.count() // frames)
    k = F.floor(F.col("event_id") / F.lit(float(frames)))
    spread = lambda c: c * F.lit(4.5) - F.lit(0.5)
    df = events.select(
        (F.col("event_id") % frames).cast("int").alias("frame_id"),
        F.floor(k / F.lit(float(width))).cast("int").alias("y"),
        (k % width).cast("int").alias("x"),
        spread(F.col("value") / F.lit(500.0)).alias("r"),
        spread((F.col("user_id") % 97).cast("double") / F.lit(97.0)).alias("g"),
        spread((F.col("event_id") * 7919 % 1009).cast("double") / F.lit(1009.0)).alias("b"),
        F.when(F.col("event_type") == "error", F.lit(0.5)).when(F.col("event_type") == "signup", F.lit(0.0)).otherwise(F.lit(1.0)).alias("a"),
    )
    return image_rel(df, width, -(-n // width))


def plane_from_events(events: DataFrame, width: int = 100) -> Rel:
    """A field over the same grid, as a depth plane."""
    n = events.count()
    at = F.col("event_id")
    df = events.select(F.lit(0).alias("frame_id"), F.floor(at / F.lit(float(width))).cast("int").alias("y"), (at % width).cast("int").alias("x"), ((at * 104729 % 1013).cast("double") / F.lit(1012.0)).alias("v"))
    return field_rel(df, width, -(-n // width))


def R() -> Column:
    return F.col("r")


def G() -> Column:
    return F.col("g")


def B() -> Column:
    return F.col("b")


def A() -> Column:
    return F.col("a")


def V() -> Column:
    return F.col("v")


def O() -> Column:  # noqa: E743
    """The other field of two that are joined."""
    return F.col("o_v")
