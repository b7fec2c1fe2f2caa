"""Streams: frames merged as they come, and journals of undoable settings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators.stack import finite


def running_merge(frames: DataFrame, channels=("v",), by=("y", "x")) -> DataFrame:
    """Mean, largest and smallest of a stream of frames by place, in complete or update mode. What is kept is one row a place."""
    aggregates = []
    for c in channels:
        v = finite(F.col(c))
        aggregates += [F.avg(v).alias(f"{c}_mean"), F.max(v).alias(f"{c}_max"), F.min(v).alias(f"{c}_min"), F.count(v).alias(f"{c}_n")]
    return frames.groupBy(*by).agg(*aggregates)


OUT = "user_id long, event_id long, value double, depth long, undone long"
STATE = "done array<double>, undone array<double>"


def fold(done: list[float], undone: list[float], rows: list[tuple[int, str, float]]):
    """One user's settings: click sets a value, error takes the last back, signup sets it again. A new value ends what could be set again."""
    out = []
    for event_id, kind, value in rows:
        if kind == "click":
            done.append(value)
            undone.clear()
        elif kind == "error" and done:
            undone.append(done.pop())
        elif kind == "signup" and undone:
            done.append(undone.pop())
        else:
            continue
        out.append((event_id, done[-1] if done else None, len(done), len(undone)))
    return out


def journal(events: DataFrame) -> DataFrame:
    """Each user's value in force after each event that changed it. For a stream with state by user; rows of a batch are taken in order of time and id."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, undone = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = fold(done, undone, list(zip(rows["event_id"].tolist(), rows["event_type"].tolist(), rows["value"].tolist(), strict=True)))
        state.update((done, undone))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["user_id", "event_id", "value", "depth", "undone"])

    return events.select("user_id", "event_id", "ts", "event_type", "value").groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def journal_batch(events: DataFrame) -> DataFrame:
    """The same over a table: each user's events pass through a task in order, in batches, and only the settings in force are held."""
    rows = events.select("user_id", "ts", "event_id", "event_type", "value").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, done, undone = None, [], []
        for pdf in batches:
            out = []
            for key, part in pdf.groupby("user_id", sort=False, dropna=False):
                if key != user:
                    user, done, undone = key, [], []
                found = fold(done, undone, list(zip(part["event_id"].tolist(), part["event_type"].tolist(), part["value"].tolist(), strict=True)))
                out += [(key, *r) for r in found]
            yield pd.DataFrame(out, columns=["user_id", "event_id", "value", "depth", "undone"]).astype({"user_id": "int64", "event_id": "int64", "value": "float64", "depth": "int64", "undone": "int64"})

    return rows.mapInPandas(run, OUT)


def watched_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the pictures that turn up in a folder, as path, length and modification time; started with started(), a scan at a time, each after the last has ended."""
    from rasterloom.sources.library import is_supported

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(is_supported(F.element_at(F.split(name, r"\."), -1)) & ~name.startswith(".")).select("path", "length", "modificationTime")


def started(stream: DataFrame, handle, checkpoint: str, every: str | None = "15 seconds"):
    """A watched folder handed on batch by batch: handle takes a DataFrame and the batch's number. Without a time between scans, what is there now is handled and the query ends."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An engine extra: events by type in tumbling windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
