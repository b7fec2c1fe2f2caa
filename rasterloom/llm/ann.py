"""Nearest neighbours by inner product through an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook, so that a pair of centroids names a cell; codebooks grow with the
table until cells hold about ``CELL_ROWS`` vectors, up to ``MOST_CODES`` centroids each, and are fitted on a bounded sample of at most
``TRAIN_ROWS`` vectors. Every vector is put in the cell of its nearest centroids, which keeps q.v near q.c. A query visits cells in the
order of the summed distances of its halves to the two centroids, distance being the negative inner product that the measure asks for;
a heap over the two sorted lists yields the pairs one by one, until the cells hold as many vectors as are wanted, and the vectors in
them are ranked by exact inner products. How many are wanted is measured on the table itself: the true neighbours of ``TUNE_QUERIES``
queries are found by comparing them with all vectors, and queries visit as far as holds ``RECALL`` of those.

Cells lie in shards of about ``SHARD_ROWS`` vectors, in the order of their centroids, and a larger cell is spread over several shards;
queries are dealt in blocks of about ``BLOCK_ROWS`` by their own cells. A query goes to the shards that hold cells it visits, a vector to
the blocks that have such a query, and only visited cells are multiplied. So neither a cell that holds a third of all vectors nor the
number of queries makes a task grow. Where neighbours are hardly nearer than others, as among random vectors of many dimensions, no
order of cells saves much, and the measure says so by wanting most of them.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id. Only vectors of equally
many components have an inner product, so each number of components is searched on its own. Ties go to the smaller id. Rows that
share an id with a query are no candidates for it; repeated rows are candidates of their own, and a query that is repeated is asked
once. An empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import materialise, partitions

#: The most centroids of a codebook, and the vectors that a cell holds on average as long as there are no more centroids.
MOST_CODES, CELL_ROWS = 256, 32
#: The most vectors that the codebooks are fitted on, and the rounds of fitting.
TRAIN_ROWS, ROUNDS = 20_000, 15
#: The most queries whose true neighbours are found to measure how many cells to visit, and the share of those that is to be found.
TUNE_QUERIES, RECALL = 256, 0.96
SHARD_ROWS, BLOCK_ROWS = 8_192, 4_096
#: Shards whose finds are merged first.
MERGED = 256


def codebook(x: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from a spread-out start; with fewer distinct rows than codes, those."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= codes:
        return distinct
    rng = np.random.default_rng(7)
    centres = distinct[rng.choice(len(distinct), codes, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        for k in range(codes):
            inside = x[own == k]
            if len(inside):
                centres[k] = inside.mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


def cells_of(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = halves(x)
    return nearest(a, books[0]) * len(books[1]) + nearest(b, books[1])


def visited(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], held: np.ndarray, wanted: int) -> list[int]:
    """The cells that a query visits: pairs of centroids by summed distance, until they hold as many vectors as wanted."""
    cut = len(query) // 2
    near = (-(books[0] @ query[:cut]), -(books[1] @ query[cut:]))
    order = [np.argsort(d, kind="stable") for d in near]
    sums = [d[o] for d, o in zip(near, order, strict=True)]
    heap, seen, out, got = [(sums[0][0] + sums[1][0], 0, 0)], {(0, 0)}, [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * len(books[1]) + int(order[1][j])
        if held[cell]:
            out.append(cell)
            got += held[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(sums[0]) and b < len(sums[1]) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (sums[0][a] + sums[1][b], a, b))
    return out


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def best(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best, ties to the smaller id. Block products choose with some slack; each score is then summed alone, so equal vectors score equally."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))
    else:
        keep = np.arange(len(scores))
    exact = (vectors[keep] * query).sum(axis=1)
    first = np.lexsort((ids[keep], -exact))[:k]
    return ids[keep][first], exact[first]


def needed(query: np.ndarray, cells: list[int], books: tuple[np.ndarray, np.ndarray], held: np.ndarray) -> list[int]:
    """How many vectors a query must want for it to visit each of the cells."""
    order = visited(query, books, held, int(held.sum()))
    before = dict(zip(order, (np.cumsum(held[order]) - held[order]).tolist(), strict=True))
    return [before[c] + 1 for c in cells]


def dealt(held: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first part and in how many parts it lies: cells in order fill parts of about rows, larger cells have parts of their own."""
    many = np.maximum(1, -(-held // rows))
    first, part, room = np.zeros(len(held), np.int64), -1, 0
    for cell in np.flatnonzero(held):
        if many[cell] > 1 or held[cell] > room:
            part, room = part + 1, rows
        first[cell] = part
        if many[cell] > 1:
            part, room = part + int(many[cell]) - 1, 0
        room -= held[cell]
    return first, many


def nearest_of_few(indexed: DataFrame, asked: list[tuple], k: int) -> list[tuple]:
    """(number of the query, cell) of the true k nearest of a few queries (id, vector), by comparing them with all vectors."""
    shared = indexed.sparkSession.sparkContext.broadcast(([i for i, _ in asked], np.array([v for _, v in asked], np.float64)))

    def run(batches):
        own, x = shared.value
        kept = [(np.zeros(0), np.zeros(0, np.int64))] * len(own)
        for pdf in batches:
            if not len(pdf):
                continue
            products, ids, cells = x @ stack(pdf["v"]).T, pdf["id"].to_numpy(), pdf["cell"].to_numpy()
            for q, i in enumerate(own):
                score = np.where(ids == i, -np.inf, products[q])
                best_ = np.argpartition(-score, k)[:k] if len(score) > k else np.arange(len(score))
                score, cell = np.concatenate([kept[q][0], score[best_]]), np.concatenate([kept[q][1], cells[best_]])
                first = np.argsort(-score, kind="stable")[:k]
                kept[q] = score[first], cell[first]
        rows = [(q, int(c), float(s)) for q, (score, cell) in enumerate(kept) for s, c in zip(score, cell, strict=True) if np.isfinite(s)]
        yield pd.DataFrame(rows, columns=["query", "cell", "score"]).astype({"query": "int32", "cell": "int32", "score": "float64"})

    found = indexed.select("id", "v", "cell").mapInPandas(run, "query int, cell int, score double")
    return [(q, b.cell) for q, best_ in best_first(found.withColumn("part", F.spark_partition_id()), "query", "part", k, "score", "cell").collect() for b in best_]


def best_first(found: DataFrame, by: str, part: str, k: int, score: str, then: str) -> DataFrame:
    """by, best: the k rows of each group with the largest score, ties by then. Parts are merged some at a time, so that no group gathers k rows of every part at once."""
    row = F.struct((-F.col(score)).alias("o"), then, score)
    one = found.groupBy(by, F.floor(F.col(part) / MERGED).alias("part")).agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("best"))
    return one.groupBy(by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def search(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the condition is_query holds."""
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = table.filter(F.coalesce(sound, F.lit(False))).select(F.col(id_col).alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = sorted((r[0], r[1]) for r in rows.groupBy(F.size("v")).count().collect())
    if not lengths:
        kind = rows.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    return reduce(DataFrame.union, [search_alike(rows.filter(F.size("v") == n) if len(lengths) > 1 else rows, total, k) for n, total in lengths])


def sampled(rows: DataFrame, most: int, total: int, *columns: str) -> list:
    """At most so many of total rows, by a hash; all if they are no more."""
    share = int((1 << 20) * min(1.0, most / max(total, 1)))
    return rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 20)) < share).select(*columns).limit(most).collect() or rows.select(*columns).limit(most).collect()


def search_alike(rows: DataFrame, total: int, k: int) -> DataFrame:
    """search() over rows (id, v, asks) of vectors with equally many components."""
    spark, id_type = rows.sparkSession, rows.schema["id"].dataType.simpleString()
    codes = max(1, min(MOST_CODES, int((total / CELL_ROWS) ** 0.5)))
    sample = np.array([r[0] for r in sampled(rows, TRAIN_ROWS, total, "v")], np.float64)
    books = spark.sparkContext.broadcast(tuple(codebook(x, codes) for x in halves(sample)))

    def place(batches):
        for pdf in batches:
            yield pdf.assign(cell=cells_of(stack(pdf["v"]), books.value) if len(pdf) else [])

    indexed = materialise(rows.mapInPandas(place, f"id {id_type}, v array<double>, asks boolean, cell int"), "cells")
    cells = len(books.value[0]) * len(books.value[1])
    held, asking = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for cell, n, asks in indexed.groupBy("cell").agg(F.count(F.lit(1)), F.sum(F.col("asks").cast("long"))).collect():  # MOST_CODES ** 2 rows at most
        held[cell], asking[cell] = n, asks
    # few rows, but each walks a heap; of several vectors under one id the first in order asks
    queries = indexed.filter("asks").repartition(partitions(spark), "id").groupBy("id").agg(F.min(F.struct("v", "cell")).alias("q")).select("id", "q.v", "q.cell")

    few = [(r[0], list(r[1])) for r in sampled(indexed.filter("asks"), TUNE_QUERIES, int(asking.sum()), "id", "v")]
    true: dict[int, list[int]] = {}
    for q, cell in nearest_of_few(indexed, few, k) if few else []:
        true.setdefault(q, []).append(cell)
    needs = np.sort([n for q, found in true.items() for n in needed(np.array(few[q][1]), found, books.value, held)])
    wanted = int(needs[min(len(needs) - 1, int(np.ceil(RECALL * len(needs))))]) if len(needs) else 0
    index = spark.sparkContext.broadcast((held, wanted, *dealt(held, SHARD_ROWS), *dealt(asking, BLOCK_ROWS)))

    def route(batches):
        held, wanted, first, many, *_ = index.value
        for pdf in batches:
            visits = []
            for x in stack(pdf["v"]):
                by_shard: dict[int, list[int]] = {}
                for cell in visited(x, books.value, held, wanted):
                    for shard in range(first[cell], first[cell] + many[cell]):
                        by_shard.setdefault(shard, []).append(cell)
                visits.append([{"shard": s, "cells": c} for s, c in by_shard.items()])
            yield pdf.assign(visits=visits)

    def parts(which: int, name: str):
        """The part of each row by its cell: the cell's first one, and one of its others by a hash."""

        def run(batches):
            first, many = index.value[which], index.value[which + 1]
            for pdf in batches:
                cell = pdf["cell"].to_numpy()
                yield pdf.assign(**{name: first[cell] + pdf["h"].to_numpy() % many[cell]}).drop(columns="h")

        return run

    hashed = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)).alias("h")
    routed = queries.select("id", "v", "cell", hashed).mapInPandas(parts(4, "block"), f"id {id_type}, v array<double>, cell int, block long")
    routed = routed.mapInPandas(route, f"id {id_type}, v array<double>, cell int, block long, visits array<struct<shard:long,cells:array<int>>>")
    routed = materialise(routed.select("id", "v", "block", F.explode("visits").alias("to")).select("id", "v", "block", "to.shard", F.col("to.cells").alias("visits")), "routed")
    entries = indexed.select("id", "v", "cell", hashed).mapInPandas(parts(2, "shard"), f"id {id_type}, v array<double>, cell int, shard long")
    meetings = routed.select(F.col("shard").alias("at"), F.col("block").alias("asking")).distinct()
    entries = entries.join(meetings, F.col("shard") == F.col("at")).select("id", "v", "cell", "shard", F.col("asking").alias("block"))

    def rank(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        asked, found, scores = [], [], []
        if len(q) and len(e):
            e = e.sort_values("cell", kind="stable")
            vectors, cell, own = stack(e["v"]), e["cell"].to_numpy(), e["id"].to_numpy()
            names, starts = np.unique(cell, return_index=True)
            ends = np.append(starts[1:], len(cell))
            for at in range(0, len(q), 256):
                part = q.iloc[at : at + 256]
                x = stack(part["v"])
                visits = np.zeros((len(part), len(names)), bool)
                for i, wanted_cells in enumerate(part["visits"]):
                    visits[i] = np.isin(names, wanted_cells)
                products = np.full((len(part), len(cell)), -np.inf)
                for c in np.flatnonzero(visits.any(axis=0)):
                    who = np.flatnonzero(visits[:, c])
                    products[who, starts[c] : ends[c]] = x[who] @ vectors[starts[c] : ends[c]].T
                for i, qid in enumerate(part["id"]):
                    rows_ = np.flatnonzero((products[i] > -np.inf) & (own != qid))
                    a, b = best(products[i, rows_], own[rows_], vectors[rows_], x[i], k)
                    asked.append(np.full(len(a), qid))
                    found.append(a)
                    scores.append(b)
        flat = [np.concatenate(c) if c else [] for c in (asked, found, scores)]
        return pd.DataFrame({"query_id": flat[0], "vec_id": flat[1], "score": flat[2], "shard": int(q["shard"].iloc[0]) if len(q) else 0})

    partial = routed.groupBy("shard", "block").cogroup(entries.groupBy("shard", "block")).applyInPandas(rank, f"query_id {id_type}, vec_id {id_type}, score double, shard long")
    ranked = best_first(partial, "query_id", "shard", k, "score", "vec_id")
    return ranked.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
