"""Reading and writing frames."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterloom.frame import CHANNELS, KEY, Rel


def write_frames(rel: Rel, path: str, band_rows: int = 256, mode: str = "errorifexists") -> None:
    """Frames as Parquet, a folder for each band of rows, sorted inside, so that a range of rows reads few files."""
    df = rel.df.withColumn("band", F.floor(F.col("y") / band_rows).cast("int"))
    df.repartition("frame_id", "band").sortWithinPartitions(*KEY).write.mode(mode).partitionBy("band").parquet(path)


def read_frames(spark: SparkSession, path: str, kind: str, width: int, height: int, rows: tuple[int, int] | None = None, band_rows: int = 256) -> Rel:
    """Frames that write_frames wrote; with rows, only those, by folders and then by statistics. Columns that a plan doesn't use aren't read."""
    df = spark.read.parquet(path)
    if rows is not None:
        low, high = rows
        df = df.filter(F.col("band").between(low // band_rows, high // band_rows) & F.col("y").between(low, high))
    return Rel(df.select(*KEY, *CHANNELS[kind]), kind, width, height)
