"""Mixing sources to target weights by entropy balancing.

A document of source s with x words, y = x / (the source's mean), may be taken between 0 and ``most`` times. Of all rates that give a
source its target of words, the ones nearest to 1 in relative entropy are min(most, exp(lambda_s y)); lambda solves the source's
convex dual, by Newton steps within a bracket. Each step is one Spark aggregate over (source, size, count); the driver holds
lambda, one number a source, which is the model that is fitted. Rates become copies by carrying the rounding error from document
to document, longest first, within buckets of a few hundred documents of a source, so that a source's words end within a few
words of its target and a source that holds a third of the rows is still dealt over many tasks.

Null texts have size 0; null sources are a source of their own, last in order. Documents of size 0 are taken once. Repeated
rows are documents of their own in ``mix``; in ``mixed_documents`` rows alike in id, source and text all take the rounded mean of
their copies. An empty table gives an empty result; further columns are carried along by ``mixed_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import WORD, map_arrow, materialise, partitions, text_of

WEIGHTS = (3.0, 1.0, 2.0)
#: The mix's words, as a share of all words.
TOTAL = 1.5
#: A document is taken so many times at most, and so a source.
MOST = 2
#: Documents in a bucket in which rounding errors are carried on.
BUCKET_ROWS = 512
#: Newton ends when every source's words are within this share of its target.
TOLERANCE = 1e-6


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> dict[str | None, float]:
    """Words for each source: weights go round by code point, null last; what a target would have over most times its source's size is shared again by weight until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, active, out = total * sum(sizes.values()), set(order), {}
    while active:
        unit = left / sum(weight[s] for s in order if s in active)
        over = [s for s in order if s in active and unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in active}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            active.remove(s)
    return out


class Dual:
    """lambda of one source and the bracket that holds the solution."""

    def __init__(self, target: float, size: int, most: float):
        self.low, self.high, self.value = -math.inf, math.inf, 0.0
        self.target = target
        self.done, self.steps = False, 0
        if target <= 0 or size <= 0:
            self.value, self.done = -math.inf, True
        elif target >= most * size:
            self.value, self.done = math.inf, True

    def step(self, words: float, slope: float) -> None:
        """One Newton step from the words at value, by halves where it would leave the bracket."""
        gap = self.target - words
        if abs(gap) <= TOLERANCE * self.target or math.nextafter(self.low, self.high) >= self.high:
            self.done = True  # met, or as near as numbers allow
            return
        if gap > 0:
            self.low = self.value
        else:
            self.high = self.value
        self.steps += 1
        # every third step halves the bracket, whatever Newton would do, so the bracket ends
        new = self.value + gap / slope if slope > 0 and self.steps % 3 else math.nan
        if not self.low < new < self.high:
            new = (self.low + self.high) / 2 if math.isfinite(self.low + self.high) else self.value + math.copysign(1 + abs(self.value), gap)
        self.value = new


def fit(counts: DataFrame, stats: dict[str | None, tuple[int, int]], goal: dict[str | None, float], most: float = MOST) -> dict[str | None, Dual]:
    """Solve the dual of every source. counts: (source, size, n); stats: a source's size and documents."""
    spark = counts.sparkSession
    duals = {s: Dual(goal[s], stats[s][0], most) for s in stats}
    while True:  # brackets shrink, so every dual ends
        at = [(s, d.value, stats[s][0] / stats[s][1]) for s, d in duals.items() if not d.done]
        if not at:
            break
        state = spark.createDataFrame(at, "to_source string, value double, mean double")
        y = F.col("size") / F.col("mean")
        rate = F.exp(F.col("value") * y)
        rows = counts.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("to_source"))).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * F.least(F.lit(float(most)), rate)).alias("words"),
            F.sum(F.when(rate < most, F.col("n") * F.col("size") * y * rate).otherwise(0.0)).alias("slope"),
        )
        for source, words, slope in rows.collect():
            duals[source].step(words, slope)
    return duals


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: int = MOST, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source, text_key, size, source_size, target, rate, copies, taken; one row a row of docs."""
    spark = docs.sparkSession
    text = text_of(text_col)
    sized = materialise(docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "size-counts")
    stats = {r[0]: (r[1], r[2]) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")), F.sum("n")).collect()}
    goal = targets({s: size for s, (size, _) in stats.items()}, weights, total, most)
    duals = fit(counts, stats, goal, most)

    schema = "to_source string, source_size long, target double, value double, mean double, buckets long"
    state = spark.createDataFrame([(s, size, goal[s], duals[s].value, max(size, 1) / n, max(1, n // BUCKET_ROWS)) for s, (size, n) in stats.items()], schema)
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.exp(F.col("value") * (F.col("size") / F.col("mean"))))).otherwise(F.lit(1.0))
    rated = sized.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("to_source"))).select(id_col, "source", "text_key", "size", "source_size", "target", rate.alias("rate"), F.pmod(F.xxhash64(id_col, "text_key"), F.col("buckets")).alias("bucket"))
    dealt = rated.repartition(partitions(spark), "source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), id_col, "text_key")

    def round_off(batches):
        group, carry = object(), 0.0
        for batch in batches:
            copies = []
            for source, size, rate, bucket in zip(*(batch.column(c).to_pylist() for c in ("source", "size", "rate", "bucket")), strict=True):
                if (source, bucket) != group:
                    group, carry = (source, bucket), 0.0
                n = 1
                if size:
                    wanted = rate * size + carry
                    n = min(most, max(0, math.floor(wanted / size + 0.5)))
                    carry = wanted - n * size
                copies.append(n)
            out = {c: batch.column(c) for c in (id_col, "source", "text_key", "size", "source_size", "target", "rate")}
            yield out | {"copies": copies, "taken": [n * x for n, x in zip(copies, batch.column("size").to_pylist(), strict=True)]}

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(dealt, round_off, f"`{id_col}` {id_type}, source string, text_key long, size long, source_size long, target double, rate double, copies int, taken long")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all its columns."""
    found = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    copies = found.groupBy(F.col(id_col).alias("to_id"), F.col("source").alias("to_source"), F.col("text_key").alias("to_key")).agg(F.round(F.avg("copies")).cast("int").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_of(text_col)).alias("key"))
    same = F.col("id").eqNullSafe(F.col("to_id")) & F.col("source").eqNullSafe(F.col("to_source")) & (F.col("key") == F.col("to_key"))
    return rows.join(copies, same).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
