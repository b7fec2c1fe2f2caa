"""Substring deduplication by content-defined chunks.

A gear hash rolls over a text's code points; where its upper bits are zero, a chunk may end, so chunk borders depend only on the
``REACH`` code points before them and an insertion shifts no border but its own. Chunks have ``SMALLEST`` to ``LARGEST`` code points. A
chunk whose digest was seen before, in a document with a smaller id or earlier in the same one, is a duplicate; runs of duplicate
chunks of at least ``min_run`` code points, or of a whole text, are cut out, so that one place keeps each passage. A shorter run is
taken for a phrase and stays; with a min_run of 0 every run counts. Runs are put together by windows over the chunks of a text, in time linear in its length.

Null texts count as empty and have no chunks. Rows with a null id take no part. Rows
that share an id are told apart by their texts; rows alike in id and text are one text. An empty table
gives an empty result; ``without_repeats`` carries all further columns along.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import cut_into, let, map_arrow, materialise, part_of, partitions, text_batches, text_of

SMALLEST, LARGEST = 24, 256
#: A border every 2**BORDER_BITS code points, on average, beyond SMALLEST.
BORDER_BITS = 4
#: Code points that the rolling hash reaches back over, a power of two.
REACH = 16
#: Code points of a run that isn't a phrase, unless the caller says otherwise.
MIN_RUN = 96
GEARS = 4096


def gears() -> np.ndarray:
    x = np.arange(1, GEARS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32) & np.uint32((1 << REACH) - 1)


def rolled(points: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The gear hash at each code point, REACH bits wide: h = (h << 1) + gear, in doubling steps. What is older than REACH points is shifted out."""
    h = gear[points & (GEARS - 1)]
    span = 1
    while span < REACH:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h & np.uint32((1 << REACH) - 1)


def borders(points: np.ndarray, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of a text, ascending."""
    n = len(points)
    open_ = np.flatnonzero(rolled(points, gear) >> np.uint32(REACH - BORDER_BITS) == 0) + 1
    ends, at, k = [], 0, 0
    open_ = open_.tolist()
    while at < n:
        while k < len(open_) and open_[k] < at + SMALLEST:
            k += 1
        end = min(open_[k] if k < len(open_) else n, at + LARGEST, n)
        ends.append(end)
        at = end
    return ends


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, start, end, whole (the text's length), d1, d2: every chunk with the halves of its 128-bit digest."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        gear = gears()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), 100):
                out_id, keys, starts, ends, wholes, digests = [], [], [], [], [], []
                for doc, text in zip(ids[at : at + 100], texts[at : at + 100], strict=True):
                    raw = text.encode("utf-32-le", "replace")
                    found = borders(np.frombuffer(raw, "<u4"), gear)
                    begin = [0, *found[:-1]] if found else []
                    view = memoryview(raw)
                    out_id += [doc] * len(found)
                    keys += [xxhash.xxh3_64_intdigest(raw) - (1 << 63)] * len(found)
                    starts += begin
                    ends += found
                    wholes += [len(raw) // 4] * len(found)
                    digests += [xxhash.xxh3_128_digest(view[4 * a : 4 * b]) for a, b in zip(begin, found, strict=True)]
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield {"id": out_id, "text_key": keys, "start": starts, "end": ends, "whole": wholes, "d1": d[:, 0], "d2": d[:, 1]}

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_arrow(rows, run, f"id {id_type}, text_key long, start int, end int, whole int, d1 long, d2 long")


def long_enough(min_run: int) -> Column:
    return (F.col("end") - F.col("start") >= min_run) | (F.col("end") - F.col("start") == F.col("whole"))


def runs(parts: DataFrame, also: str | None = None) -> DataFrame:
    """parts (id, text_key, start, end, whole, again) with run: the start of the run of touching chunks that each lies in, of those alike in the column also."""
    text = Window.partitionBy("id", "text_key").orderBy("start")
    new = F.coalesce(F.lag("end").over(text) != F.col("start"), F.lit(True))
    if also:
        new = new | (F.lag(also).over(text) != F.col(also))
    return parts.withColumn("new", new).withColumn("run" if not also else f"{also}_run", F.last(F.when(F.col("new"), F.col("start")), True).over(text.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """id, text_key, start, end, removed (arrays of start, end): every run of a text that stands elsewhere too, and what of it goes, as spans in order."""
    found = materialise(chunks(docs, id_col, text_col), "chunks")
    place = F.struct("id", "text_key", "start")
    # counts are written before they are joined: a join that shares its exchange with an aggregate can't split a digest that very many chunks have
    seen = found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    seen = materialise(seen.filter("n > 1").select("d1", "d2", "first_id"), "seen")
    often = materialise(found.join(seen, ["d1", "d2"]), "repeated")
    # the first place of each digest, within its first document
    first = materialise(often.filter("id = first_id").groupBy("d1", "d2").agg(F.min(place).alias("first")), "first")
    marked = often.join(first, ["d1", "d2"]).select("id", "text_key", "start", "end", "whole", (place != F.col("first")).alias("again"))
    # rows alike in id and text are one text
    alone = marked.groupBy("id", "text_key", "start", "end", "whole").agg(F.max("again").alias("again")).repartition(partitions(docs.sparkSession), "id", "text_key")
    dealt = runs(runs(alone), "again")
    later = dealt.groupBy("id", "text_key", "whole", "run", "again", "again_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gone = F.when(F.col("again") & long_enough(min_run), F.struct("start", "end"))
    whole = later.groupBy("id", "text_key", "whole", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(gone)).alias("removed"))
    return whole.filter(long_enough(min_run)).select("id", "text_key", "start", "end", "removed")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """id, start, end, n_removed: every run of a text that repeats elsewhere, and how many of its code points go; the place that keeps a passage has 0."""
    total = F.aggregate("removed", F.lit(0), lambda a, x: a + x["end"] - x["start"])
    return repeats(docs, id_col, text_col, min_run).select(F.col("id").alias(id_col), "start", "end", total.alias("n_removed"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """docs with the duplicate runs cut out of their texts."""
    spans = F.array_sort(F.flatten(F.collect_list("removed")))
    cut = repeats(docs, id_col, text_col, min_run).filter(F.size("removed") > 0).groupBy("id", "text_key").agg(spans.alias("spans"))
    keyed = map_keys(docs, id_col, text_col)
    joined = keyed.join(cut.withColumnRenamed("id", "cut_id"), (F.col("id") == F.col("cut_id")) & (F.col("key") == F.col("text_key")), "left")
    text = F.col(f"row.`{text_col}`")

    def left_of(spans: Column, pieces: Column) -> Column:
        # what lies between each span and the one before it, and after the last
        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
        ends = F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.length(text)))
        return F.array_join(F.zip_with(begins, ends, lambda a, b: part_of(pieces, a, b)), "")

    left = let(F.col("spans"), lambda spans: let(cut_into(text), lambda pieces: left_of(spans, pieces)))
    clean = F.when(F.col("spans").isNotNull(), left).otherwise(text)
    return joined.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def map_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs as row, with id and key, the text_key of chunks()."""
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            keys = [xxhash.xxh3_64_intdigest(t.encode("utf-32-le", "replace")) - (1 << 63) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], names=["row", "id", "key"])

    text_batches(docs.sparkSession)
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("key", LongType())]))
