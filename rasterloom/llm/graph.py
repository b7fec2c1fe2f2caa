"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, materialise

#: Links that a task unites in its memory at once; a graph of no more links is united by one task.
CHUNK = 500_000


def united(edges: DataFrame, chunk: int) -> DataFrame:
    """a, b (the smallest node linked to a by the links of its part) for the nodes of edges(a, b). Parts are of at most chunk links, within a partition."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        top: dict = {}
        held = 0

        def root(x):
            while (up := top[x]) != x:
                top[x] = top[up]
                x = top[x]
            return x

        def rows():
            return {"a": list(top), "b": [root(x) for x in top]}

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                top.setdefault(a, a)
                top.setdefault(b, b)
                p, q = root(a), root(b)
                if p != q:
                    top[max(p, q)] = min(p, q)
                held += 1
                if held == chunk:
                    yield rows()
                    top.clear()
                    held = 0
        yield rows()

    return map_arrow(edges.select("a", "b"), run, f"a {kind}, b {kind}")


def star(near: DataFrame) -> DataFrame:
    """near(a, b) with the smallest of a and all its b as m."""
    # written before it is joined, so that the join has its exchanges to itself and can split a node with very many links
    low = materialise(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lows")
    return near.join(low, "a")


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node, label (the smallest node that is linked to it), for the nodes of edges(a, b). Up to chunk links are united by one task. Of more, each task first unites what it holds, so that links are no more than nodes a part; then large and small stars take turns: each node links its larger neighbours to its smallest one, then itself and its smaller neighbours, until nothing changes, which leaves one star a component. A chain of n nodes takes about log n turns in any order, and links don't grow in number; every step is a join or a minimum by key, so a node with very many links is split like any hot key. No edges give an empty result; links to oneself and repeated links don't matter."""
    if edges.count() <= chunk:
        return united(edges.coalesce(1), chunk).toDF("node", "label")
    links = materialise(united(edges, chunk), "forest")
    nodes = materialise(links.select(F.col("a").alias("node")).distinct(), "nodes")
    links = materialise(links.filter("a <> b").distinct(), "edges")
    before = None
    # equal links have equal sums, and the stars change the links of any graph that isn't made of stars
    while (now := links.agg(F.count("a"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()) != before:
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        ends = star(large).select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = materialise(ends.filter("a <> b").distinct(), "edges")
    return nodes.join(links, nodes["node"] == links["a"], "left").select("node", F.coalesce("b", "node").alias("label"))
