"""Session defaults for local runs; a cluster's own settings always win."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "rasterloom", **extra: str) -> SparkSession:
    """A local session with UTC timestamps, AQE and as many shuffle partitions as cores."""
    n = "8" if cores == "*" else str(cores)
    conf = {
        "spark.sql.shuffle.partitions": n,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in spark.checkpoint.dir. Unset, a local master takes one that goes with this process, and no other master is guessed for."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    local = tempfile.mkdtemp(prefix="rasterloom-")
    atexit.register(shutil.rmtree, local, True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return f"file://{local}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read from there. Unlike a checkpoint, which keeps the estimate of its plan's size, it is as large as its files: estimates of steps upon steps don't multiply."""
    path = shared_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with each row's place in an order, from 1. Rows are dealt by ranges of the order and numbered within them, after those of the ranges before; no task sees more than its range."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = checkpointed(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect())  # one row a range
    before, total = [], 0
    for part, n in sizes:
        before += [F.lit(part), F.lit(total)]
        total += n
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    first = F.element_at(F.create_map(*before), F.col("_range")) if before else F.lit(0)
    return dealt.withColumn(name, (first + own).cast("int" if total < 2**31 else "long")).drop("_range")
