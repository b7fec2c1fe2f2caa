"""Regions of alike pixels, by merging along the edges between neighbours in the order of their difference.

Two regions merge over an edge if it is no more than each one's own largest edge plus k over its size; in the end regions below a least
size join their most alike neighbour. That is an order over all edges of a frame, yet most of it can be decided anywhere: an edge is
settled once both of its regions have no earlier edge that isn't. So square tiles settle what they can, and hand on only the regions
that still wait for an edge across their border, with these edges; four tiles at a time do the same with what was handed on, until a
frame has no edge left. No task sees more than its tile and what its four parts couldn't settle.

Joins are by merging: tables of pixels are small as files and large in a driver that broadcasts them.

Among equal differences the edge of the smaller pixel comes first, that to the right before that below. Null channels count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.frame import KEY, Rel
from rasterloom.functions.tone import num
from rasterloom.session import written

#: Pixels along a tile's side.
TILE = 64
ROW = "kind int, frame_id int, ty int, tx int, node long, into long, size long, bar double, stuck boolean, e long, w double"
NODE, HALF, GONE = 0, 1, 2


class Forest:
    """Regions of a tile: their size, the difference up to which they merge, and whether nothing changes them any more."""

    def __init__(self, nodes, sizes, bars, stuck):
        self.top = {n: n for n in nodes}
        self.size, self.bar, self.stuck = (dict(zip(nodes, v, strict=True)) for v in (sizes, bars, stuck))
        self.waits: set[int] = set()

    def find(self, n: int) -> int:
        while (up := self.top[n]) != n:
            self.top[n] = n = self.top[up]
        return n

    def unite(self, a: int, b: int, into: int) -> None:
        other = b if into == a else a
        self.top[other] = into
        self.size[into] = self.size[a] + self.size[b]


def grows(f: Forest, a: int, b: int, w: float, k: float) -> bool:
    """Settle an edge of the merging itself; False if it must wait. A region that an edge is too much for is done: all later edges are no smaller."""
    if f.stuck[a] or f.stuck[b]:
        return True
    if a in f.waits or b in f.waits:
        f.waits |= {a, b}
        return False
    if w <= min(f.bar[a], f.bar[b]):
        into = min(a, b)
        f.unite(a, b, into)
        f.bar[into] = w + k / f.size[into]
    else:
        f.stuck[a], f.stuck[b] = w > f.bar[a], w > f.bar[b]
    return True


def absorbs(f: Forest, a: int, b: int, w: float, k: float) -> bool:
    """Settle an edge when small regions (not stuck) join others; False if it must wait. Two that aren't small stay apart for good."""
    small = [x for x in (a, b) if not f.stuck[x]]
    if not small:
        return True
    if any(x in f.waits for x in small):
        f.waits.update(small)
        return False
    into = min(a, b) if len(small) == 2 else b if small == [a] else a
    f.unite(a, b, into)
    f.stuck[into] = f.stuck[into] or f.size[into] >= k
    return True


def settled(nodes: DataFrame, halves: DataFrame, decide, k: float, levels: int) -> DataFrame:
    """frame_id, node, into: regions that became part of others. nodes(frame_id, ty, tx, node, size, bar, stuck) are the regions of a tile, halves(frame_id, ty, tx, node, e, w) the edges that they have, one row a region; an edge's other row may be in another tile."""
    import pandas as pd

    columns = [c.split()[0] for c in ROW.split(", ")]

    def run(key, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        frame, ty, tx = (int(v) for v in key)
        own = own.drop_duplicates("node")
        f = Forest(*(own[c].tolist() for c in ("node", "size", "bar", "stuck")))
        edges = edges.sort_values(["w", "e"], kind="stable")
        e, w, n = (edges[c].tolist() for c in ("e", "w", "node"))
        left, i = [], 0
        while i < len(e):
            j = i + 1
            while j < len(e) and e[j] == e[i]:
                j += 1
            ends = [f.find(x) for x in n[i:j]]
            if len(ends) == 1:  # it leaves the tile
                if not f.stuck[ends[0]]:
                    f.waits.add(ends[0])
                left.append((e[i], w[i], ends))
            elif ends[0] != ends[1] and not decide(f, ends[0], ends[1], w[i], k):
                left.append((e[i], w[i], ends))
            i = j
        out, carried = [], set()
        for edge, weight, ends in left:
            for x in ends:
                x = f.find(x)
                carried.add(x)
                out.append((HALF, frame, ty, tx, x, None, None, None, None, edge, weight))
        out += [(NODE, frame, ty, tx, x, None, f.size[x], f.bar[x], bool(f.stuck[x]), None, None) for x in carried]
        out += [(GONE, frame, ty, tx, x, f.find(x), None, None, None, None, None) for x in f.top if f.find(x) != x]
        return pd.DataFrame(out, columns=columns)

    found = []
    for level in range(levels + 1):
        at = ["frame_id", F.shiftright("ty", min(level, 1)).alias("ty"), F.shiftright("tx", min(level, 1)).alias("tx")]
        a = nodes.select(*at, "node", "size", "bar", "stuck").groupBy("frame_id", "ty", "tx")
        b = halves.select(*at, "node", "e", "w").groupBy("frame_id", "ty", "tx")
        done = written(a.cogroup(b).applyInPandas(run, ROW))
        found.append(done.filter(F.col("kind") == GONE).select("frame_id", "node", "into"))
        nodes, halves = done.filter(F.col("kind") == NODE), done.filter(F.col("kind") == HALF)
        if level == levels or halves.isEmpty():
            break
    whole = found[-1]
    for lower in reversed(found[:-1]):  # where a region went, followed up the levels; each is written, or the plan would double with every level
        further = whole.select("frame_id", F.col("node").alias("into"), F.col("into").alias("last"))
        followed = lower.join(further.hint("merge"), ["frame_id", "into"], "left").select("frame_id", "node", F.coalesce("last", "into").alias("into"))
        whole = written(followed).unionByName(whole)
    return whole


def neighbours(rel: Rel, *carried: str) -> DataFrame:
    """frame_id, e, w, a, b of every two neighbouring pixels, with the carried columns of both (suffixes _a, _b)."""
    pixel = (F.col("y").cast("long") * rel.width + F.col("x")).alias("n")
    rgb = [F.coalesce(c, num(0)).alias(c) for c in "rgb"]
    rows = rel.df.select(*KEY, pixel, *rgb, *carried)
    fields = ["n", *"rgb", *carried]
    out = None
    for direction, (line, along) in enumerate((("y", "x"), ("x", "y"))):
        after = F.lead(F.struct(*fields)).over(Window.partitionBy("frame_id", line).orderBy(along))
        both = rows.withColumn("_b", after).filter("_b is not null")
        gaps = [F.col(c) - F.col(f"_b.{c}") for c in "rgb"]
        w = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
        part = both.select("frame_id", (F.col("n") * 2 + direction).alias("e"), w.alias("w"), *[x for c in ("n", *carried) for x in (F.col(c).alias(f"{c}_a"), F.col(f"_b.{c}").alias(f"{c}_b"))])
        out = part if out is None else out.unionByName(part)
    return out


def tile_of(node: Column, width: int) -> list[Column]:
    """The tile that a pixel number lies in."""
    y, x = F.floor(node / F.lit(width)), node % width
    return [F.floor(y / TILE).cast("int").alias("ty"), F.floor(x / TILE).cast("int").alias("tx")]


def segment(rel: Rel, k: float = 0.5, min_size: int = 20) -> DataFrame:
    """frame_id, y, x, label: the regions of each frame. A larger k merges more; a region's label is the number, row by row, of one of its pixels."""
    levels = max(-(-rel.width // TILE), -(-rel.height // TILE), 1)
    levels = (levels - 1).bit_length()
    n = (F.col("y").cast("long") * rel.width + F.col("x")).alias("node")
    frame = F.col("frame_id").cast("int").alias("frame_id")
    pixels = rel.df.select(frame, "y", "x", n, *"rgb")
    nodes = pixels.select("frame_id", *tile_of(F.col("node"), rel.width), "node", F.lit(1).cast("long").alias("size"), num(k).alias("bar"), F.lit(False).alias("stuck"))
    edges = written(neighbours(rel).select(frame, "e", "w", "n_a", "n_b"))
    halves = edges.select("frame_id", "e", "w", F.explode(F.array("n_a", "n_b")).alias("node")).select("frame_id", *tile_of(F.col("node"), rel.width), "node", "e", "w")
    merged = settled(nodes, halves, grows, k, levels)
    labels = pixels.join(merged.withColumnRenamed("into", "label").hint("merge"), ["frame_id", "node"], "left").withColumn("label", F.coalesce("label", "node"))
    labels = written(labels.select("frame_id", "y", "x", "node", "label"))

    # the least edge of two regions is the one that counts; those of two large ones never do
    sizes = labels.groupBy("frame_id", "label").count()
    small = written(sizes.filter(F.col("count") < min_size))
    where = labels.join(small.hint("merge"), ["frame_id", "label"], "left").select("frame_id", F.col("node"), "label", F.col("count").alias("size"))
    tops = edges
    for end in "ab":
        tops = tops.join(where.select("frame_id", F.col("node").alias(f"n_{end}"), F.col("label").alias(f"l_{end}"), F.col("size").alias(f"s_{end}")).hint("merge"), ["frame_id", f"n_{end}"])
    tops = tops.filter("l_a <> l_b and (s_a is not null or s_b is not null)")
    first, last = F.least("l_a", "l_b"), F.greatest("l_a", "l_b")
    size_first, size_last = (F.when(F.col("l_a") == x, F.col("s_a")).otherwise(F.col("s_b")) for x in (first, last))
    pairs = tops.groupBy("frame_id", first.alias("a"), last.alias("b")).agg(F.min(F.struct("w", "e")).alias("m"), F.first(size_first).alias("s_a"), F.first(size_last).alias("s_b"))
    pairs = written(pairs.select("frame_id", "a", "b", "s_a", "s_b", "m.w", "m.e"))
    # a small region has its home in the tile of its label; a large one is told to each home that it borders on
    ends = F.array(*[F.struct(F.col(p).alias("home"), F.col(p).alias("node"), F.col(f"s_{p}").alias("size")) for p in "ab"])
    both = F.array(*[F.struct(F.col(h).alias("home"), F.col(p).alias("node"), F.col(f"s_{p}").alias("size")) for h in "ab" for p in "ab"])
    alike = F.col("s_a").isNotNull() & F.col("s_b").isNotNull()
    told = F.when(alike, ends).otherwise(F.filter(both, lambda x: x["home"] == F.when(F.col("s_a").isNotNull(), F.col("a")).otherwise(F.col("b"))))
    rows = pairs.select("frame_id", "w", "e", F.explode(told).alias("t")).select("frame_id", *tile_of(F.col("t.home"), rel.width), F.col("t.node").alias("node"), F.col("t.size").alias("size"), "e", "w")
    regions = rows.select("frame_id", "ty", "tx", "node", F.coalesce("size", F.lit(min_size)).cast("long").alias("size"), num(0).alias("bar"), F.col("size").isNull().alias("stuck")).distinct()
    joined = settled(regions, rows, absorbs, min_size, levels)
    return labels.join(joined.withColumnRenamed("node", "label").hint("merge"), ["frame_id", "label"], "left").select("frame_id", "y", "x", F.coalesce("into", "label").alias("label"))


def reduced(rel: Rel, longest: int) -> Rel:
    """The picture at a scale for segmenting: at most so many pixels along its longer side, each the mean of those that fall in it."""
    most = max(rel.width, rel.height)
    if most <= longest:
        return rel
    w, h = max(1, rel.width * longest // most), max(1, rel.height * longest // most)
    y, x = (F.floor(F.col(c) * n / F.lit(size)).cast("int").alias(c) for c, n, size in (("y", h, rel.height), ("x", w, rel.width)))
    return Rel(rel.df.groupBy("frame_id", y, x).agg(*[F.avg(c).alias(c) for c in rel.channels]), rel.kind, w, h)
