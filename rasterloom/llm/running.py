"""Running totals along an order within keys, of which any may hold most rows."""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce
from operator import add, xor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise

#: How totals of parts are joined: on the driver for the ranges of a key, and in columns.
JOINED = {"sum": (add, lambda a, b: a + b), "bit_xor": (xor, lambda a, b: a.bitwiseXOR(b))}


def running(df: DataFrame, key: str, order: list[Column], totals: dict[str, tuple[Column, str]], name: str = "running") -> DataFrame:
    """df with a column for each of totals (long column, "sum" or "bit_xor"): its total over the rows of the same key up to and with this one, in the given order. Keys must not be null; rows that tie in the order come in any order.

    Rows are dealt by ranges of key and order and summed up within their range, then what the key has in the ranges before is added. Only a range's first and last key can reach into other ranges, so what passes the driver and what is broadcast are at most two rows a range."""
    spark = df.sparkSession
    inner = {n: f"_of_{n}" for n in totals}
    dealt = df.withColumns({inner[n]: c.cast("long") for n, (c, _) in totals.items()})
    dealt = materialise(dealt.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id()), name)
    so_far = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({n: getattr(F, how)(inner[n]).over(so_far) for n, (_, how) in totals.items()})

    edges = dealt.groupBy("_range").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()  # one row a range
    split = sorted(k for k, n in Counter(k for r in edges for k in {r["low"], r["high"]}).items() if n > 1)
    if split:
        kind = df.schema[key].dataType.simpleString()
        few = spark.createDataFrame([(k,) for k in split], f"`{key}` {kind}")
        parts = dealt.join(F.broadcast(few), key).groupBy(key, "_range").agg(*[getattr(F, how)(inner[n]).alias(n) for n, (_, how) in totals.items()])
        of_key = defaultdict(list)
        for r in parts.collect():  # two rows a range at most
            of_key[r[key]].append((r["_range"], [r[n] for n in totals]))
        before = []
        for k, own in of_key.items():
            own.sort()
            for i in range(1, len(own)):
                values = zip(*[v for _, v in own[:i]], strict=True)
                before.append((k, own[i][0], *(reduce(JOINED[how][0], v) for v, (_, how) in zip(values, totals.values(), strict=True))))
        columns = ", ".join(f"_before_{n} long" for n in totals)
        earlier = spark.createDataFrame(before, f"`{key}` {kind}, _range int, {columns}")
        out = out.join(F.broadcast(earlier), [key, "_range"], "left")
        out = out.withColumns({n: JOINED[how][1](F.col(n), F.coalesce(f"_before_{n}", F.lit(0))) for n, (_, how) in totals.items()})
    out = out.select(*df.columns, *totals)
    out.stored = dealt.stored
    return out
