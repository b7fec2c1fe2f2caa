"""The prefix tree of conversations: which of them begin alike, and what reusing the shared beginnings saves.

A turn's digest is that of its role and text, with its depth; the digest of a prefix is the exclusive or of its turns' digests, so
that prefixes of any conversation, however long, are running totals over ranges (see running.py). The smallest conversation of a
prefix owns its node. Who owns a prefix owns all longer ones of its own, so each conversation's nodes are a chain from its first
owned depth to its end; that depth is found by binary search, all conversations at once: a round looks their middle depths up in the
prefixes' minima by joins. The last minimum that wasn't their own is the node that the chain hangs on. Totals of chains are summed up
the tree of chains by pointers that double their reach, a round for each bit of its height, and put together with suffix sums along
each chain.

Turns come in the order of turn, null first; those of equal turn by the digest of role and text, and repeated rows count as turns of
their own. Null role or text is empty. Rows without conv_id belong to no conversation and take no part. An empty table has no
conversation, so not even the root. Further columns are left alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import WORD, discard, map_arrow, materialise, partitions, text_of
from rasterloom.llm.running import running

#: Ids of conversations that end at a node, joined in one string at once.
ENDS = 4096


def as_longs(digest: Column) -> list[Column]:
    """Two longs of 60 bits each of a digest in hex."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, content (digest), words, place (from 1) of every turn."""
    role, text = text_of("role"), text_of("text")
    content = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), F.col("content"), F.col("row")]  # the row parts repeated rows, of which any range may take some
    return running(turns, "conv_id", order, {"place": (F.lit(1), "sum")}, "turns").drop("turn", "row")


def rebuilt(placed: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one: conv_id, length; and conv_id, depth (from 1), content, words. The first h turns of c - c % every come first, then c's own after its first h, where h is crc32 of the decimal c, % most."""
    own = placed.groupBy("conv_id").agg(F.max("place").alias("n"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    bases = own.filter(F.col("conv_id") == F.col("base")).select("base", F.col("n").alias("n_base"))
    whole = own.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0))))
    whole = materialise(whole.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    kept = placed.join(whole, "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "content", "words")
    first = placed.filter((F.col("place") < most) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    lent = whole.filter("k > 0").join(first, "base").filter("place <= k").select("conv_id", F.col("place").alias("depth"), "content", "words")
    return whole, kept.unionByName(lent)


def prefixes(whole: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the digest of the first depth turns), words (of the last of them), with depth 0 for every conversation."""
    rows = turns.unionByName(whole.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("content"), F.lit(0).cast("long").alias("words")))
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("content")), 256)
    a, b = (F.when(F.col("depth") == 0, F.lit(0)).otherwise(x) for x in as_longs(mixed))
    return running(rows, "conv_id", [F.col("depth")], {"a": (a, "bit_xor"), "b": (b, "bit_xor")}, "prefixes").drop("content")


def first_owned(whole: DataFrame, prefix: DataFrame, minima: DataFrame) -> DataFrame:
    """conv_id, length, first (the first depth whose prefix has no smaller conversation; length + 1 if there is none), parent (the smallest conversation of the prefix one shorter; null at the root). Owned depths reach to the end, so halving finds the first."""
    active = whole.select("conv_id", "length", F.lit(0).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"), F.lit(None).cast("long").alias("parent"))
    found = []
    while not found or not active.isEmpty():
        asked = active.withColumn("depth", F.floor((F.col("lo") + F.col("hi")) / 2)).join(prefix.drop("words"), ["conv_id", "depth"])
        asked = asked.join(minima.select("depth", "a", "b", "owner"), ["depth", "a", "b"])
        owns = F.col("owner") == F.col("conv_id")
        step = asked.select("conv_id", "length", F.when(owns, F.col("lo")).otherwise(F.col("depth") + 1).alias("lo"), F.when(owns, F.col("depth")).otherwise(F.col("hi")).alias("hi"), F.when(owns, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        step = materialise(step, "search")
        found.append(step.filter("lo = hi").select("conv_id", "length", F.col("lo").alias("first"), "parent"))
        active = step.filter("lo < hi")
    return reduce(DataFrame.unionByName, found)


def chain_totals(chains: DataFrame) -> DataFrame:
    """conv_id, leaves, saved of each chain and all that hang on it, directly or not, for chains(conv_id, parent, leaves, saved). A chain holds what lies less than its pointer's reach below it; each round adds to every chain what is held by those whose pointer is at it, and doubles the pointers."""
    now = materialise(chains.select("conv_id", F.col("parent").alias("up"), "leaves", "saved"), "chains")
    while not (below := now.filter("up is not null")).isEmpty():
        more = below.groupBy("up").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnRenamed("up", "conv_id")
        sums = materialise(now.join(more, "conv_id", "left").select("conv_id", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "chains")
        ups = now.select(F.col("conv_id").alias("up"), F.col("up").alias("further"))
        after = materialise(sums.join(ups, "up", "left").select("conv_id", F.col("further").alias("up"), "leaves", "saved"), "chains")
        discard(now, sums)
        now = after
    return now.drop("up")


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """owner, depth, ends_sha256: the digest of the decimal conv_ids that end at a node, ascending, comma-joined. Ids are joined by chunks within ranges; a node of many chunks passes them through its digest one after the other, so that no task holds the ids of a node at once."""
    dealt = materialise(ends.repartitionByRange("owner", "depth", "conv_id").withColumn("_range", F.spark_partition_id()), "ends")
    own = Window.partitionBy("_range", "owner", "depth").orderBy("conv_id")
    chunk = F.floor((F.row_number().over(own) - 1) / ENDS).alias("chunk")
    chunks = dealt.select("owner", "depth", "conv_id", "_range", chunk).groupBy("owner", "depth", "_range", "chunk")
    chunks = materialise(chunks.agg(F.min("conv_id").alias("first"), F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")), "chunks")
    counted = chunks.groupBy("owner", "depth").agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    single = counted.filter("n = 1").select("owner", "depth", F.sha2("ids", 256).alias("ends_sha256"))
    several = chunks.join(counted.filter("n > 1").select("owner", "depth"), ["owner", "depth"]).select("owner", "depth", "first", "ids")
    several = several.repartition(partitions(ends.sparkSession), "owner", "depth").sortWithinPartitions("owner", "depth", "first")

    def run(batches):
        key, digest = None, None
        for batch in batches:
            out = []
            for owner, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (owner, depth) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = (owner, depth), hashlib.sha256(ids.encode())
            if out:
                yield dict(zip(("owner", "depth", "ends_sha256"), zip(*out, strict=True), strict=True))
        if key:
            yield {"owner": [key[0]], "depth": [key[1]], "ends_sha256": [digest.hexdigest()]}

    kind = ends.schema["owner"].dataType.simpleString()
    return single.unionByName(map_arrow(several, run, f"owner {kind}, depth long, ends_sha256 string"))


def trie(whole: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the tree of whole(conv_id, length) with turns(conv_id, depth, content, words): conv_id (the smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens (over the node's subtree, the words of each node's last turn, for all members but one), ends_sha256."""
    running_digests = prefixes(whole, turns)
    prefix = materialise(running_digests, "prefix")
    discard(running_digests)
    minima = materialise(prefix.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "minima")
    found = materialise(first_owned(whole, prefix, minima), "found")
    discard(prefix)

    chains = found.filter("first <= length")
    hung = chains.filter("first > 0").select(F.col("conv_id").alias("chain"), F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"))
    forks = hung.select("owner", "depth").distinct()
    tails = chains.select(F.col("conv_id").alias("owner"), F.col("length").alias("depth"))
    childless = tails.join(forks, ["owner", "depth"], "left_anti").select(F.col("owner").alias("conv_id"), F.lit(1).cast("long").alias("leaves"))
    own = minima.groupBy(F.col("owner").alias("conv_id")).agg(F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    totals = chain_totals(chains.join(own, "conv_id").join(childless, "conv_id", "left").select("conv_id", "parent", F.coalesce("leaves", F.lit(0)).alias("leaves"), "saved"))

    none = F.lit(None)
    on = hung.join(totals, hung["chain"] == totals["conv_id"]).groupBy("owner", "depth")
    facts = {"children": "long", "leaves": "long", "saved": "long", "above": found.schema["conv_id"].dataType.simpleString(), "tail": "long", "ends_sha256": "string"}

    def told(df: DataFrame, **given: Column) -> DataFrame:
        return df.select("owner", "depth", *[given.get(n, none).cast(kind).alias(n) for n, kind in facts.items()])

    known = told(on.agg(F.count(F.lit(1)).alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s")), children=F.col("c"), leaves=F.col("l"), saved=F.col("s"))
    known = known.unionByName(told(chains.select(F.col("conv_id").alias("owner"), F.col("first").alias("depth"), "parent"), above=F.col("parent")))
    known = known.unionByName(told(tails, tail=F.lit(1)))
    ends = found.select(F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(F.col("parent")).alias("owner"), F.col("length").alias("depth"), "conv_id")
    known = known.unionByName(told(digests_of_ends(ends).withColumnRenamed("ends_sha256", "e"), ends_sha256=F.col("e")))
    known = known.groupBy("owner", "depth").agg(*[F.max(n).alias(n) for n in facts])  # each fact stands in one row of a node at most

    nodes = minima.drop("a", "b").join(known, ["owner", "depth"], "left").fillna(0, ["children", "leaves", "saved", "tail"])
    nodes = nodes.select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "owner")).alias("parent_conv_id"), "n_convs",
        (F.col("children") + 1 - F.col("tail")).alias("n_children"),
        (F.col("leaves") + F.when((F.col("tail") == 1) & (F.col("children") == 0), 1).otherwise(0)).alias("leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    out = running(nodes, "conv_id", [F.col("depth").desc()], {"n_leaves": (F.col("leaves"), "sum"), "saved_tokens": (F.col("saved"), "sum")}, "nodes")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations(conv_id, turn, role, text), rebuilt to share beginnings."""
    running_places = placed_turns(conversations)
    placed = materialise(running_places, "placed")
    discard(running_places)
    return trie(*rebuilt(placed))
