"""Shared helpers: tables written between steps, Arrow steps, words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.session import shared_path

#: Words everywhere in this package: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in an Arrow batch of whole texts, so that long texts don't pile up in a worker.
TEXT_ROWS = 1000


def materialise(df: DataFrame, name: str = "step", compression: str = "snappy") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "stored", None):
            context = table.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python steps by TEXT_ROWS rows, for this session: Spark reads the bound when a lazy step runs at last, so it can't be put back before. A session that has set a lower one keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow over record batches; function takes batches and yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    struct = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(batches):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    text_batches(df.sparkSession)
    return df.mapInArrow(run, struct)


# -- texts and arrays within a row, in time about linear in their size ---------
#: Elements, and code points, that are walked at once.
SPAN = 256


def let(value: Column, use) -> Column:
    """use(value), with the value found once, however often use names it and in whatever loops."""
    return F.transform(F.array(value), use)[0]


def before_each(values: Column, join) -> Column:
    """For each of an array of ints what join(a, b) makes of all values before it, from 0. Values are walked in spans, so that what is gathered is copied within a span only."""

    def walk(own: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(own, state, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def spans(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SPAN).cast("int")), lambda k: F.slice(v, k * SPAN + 1, F.lit(SPAN)))

    def whole(v: Column) -> Column:
        joined = let(spans(v), lambda own: F.flatten(F.zip_with(own, walk(F.transform(own, lambda x: F.aggregate(x, F.lit(0), lambda a, b: join(a, b))), F.lit(0)), walk)))
        return F.when(F.size(v) > 0, joined).otherwise(F.array().cast("array<int>"))

    return let(values, whole)


def cut_into(text: Column) -> Column:
    """A text as an array of strings of SPAN code points each, for part_of."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SPAN}}}"), F.lit(0))


def part_of(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text that cut_into cut; it looks at the pieces that the part lies in only."""
    a, b = F.floor(start / SPAN).cast("int"), F.floor((end - 1) / SPAN).cast("int")
    first, last = F.try_element_at(pieces, a + 1), F.try_element_at(pieces, b + 1)
    one = F.substring(first, start - a * SPAN + 1, end - start)
    many = F.concat(F.substring(first, start - a * SPAN + 1, F.lit(SPAN)), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(last, F.lit(1), end - b * SPAN))
    return F.when(start >= end, F.lit("")).when(a == b, one).otherwise(many)
