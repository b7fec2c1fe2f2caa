"""A manifest of a dataset: digests of all rows joined to one root, and for each row the proof that leads there.

Nodes of a group are numbered in their order; runs of a few consecutive ones become the digest of their digests, level by level, until
one is left. Every level is written. Proofs go down again: the children of a level meet their parents by a join, and each puts its
siblings before the proof that its parent has. Groups' roots are the leaves of one more tree of the same kind, so a row's proof leads
over its group's root to the dataset's. A group may hold most rows: numbers come from ranges (running.py), all else goes by runs.

Rows are numbered by their id, null first, those of equal id by their digest; repeated rows are leaves of their own. A null group comes
before all others. An empty table has no root and no rows. Further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, materialise
from rasterloom.llm.running import running

#: Nodes that have a parent in common, at most.
WIDTH = 3
STEP = "array<struct<before:string,after:string>>"


def row_digest(*values: Column) -> Column:
    """SHA-256 in hex of values one after the other: the bytes of each with their count before, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered_leaves(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows(key, digest, ...) with idx, their place within key from 0, written."""
    placed = running(rows, "key", order, {"idx": (F.lit(1), "sum")}, "leaves")
    out = materialise(placed.withColumn("idx", F.col("idx") - 1), "level")
    discard(placed)
    return out


def build(leaves: DataFrame, width: int = WIDTH) -> tuple[list[DataFrame], DataFrame]:
    """The levels from leaves(key, idx, digest, ...) up, and roots(key, digest, height). Levels above the leaves have the digests of their children too."""
    levels, roots = [leaves], None
    while roots is None or not levels[-1].isEmpty():
        runs = levels[-1].groupBy("key", F.floor(F.col("idx") / width).alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), "digest")))["digest"].alias("children"))
        runs = materialise(runs, "level")
        alone = (F.col("idx") == 0) & (F.size("children") == 1)  # the only node of its level
        tops = runs.filter(alone).select("key", F.col("children")[0].alias("digest"), F.lit(len(levels) - 1).alias("height"))
        roots = tops if roots is None else roots.unionByName(tops)
        levels.append(runs.filter(~alone).withColumn("digest", F.sha2(F.array_join("children", ""), 256)))
    return levels[:-1], materialise(roots, "roots")


def push(levels: list[DataFrame], roots: DataFrame, proofs: DataFrame, width: int = WIDTH) -> DataFrame:
    """leaves of build() with top (their key's root) and proof (what stands before and after the node's digest at each step up), where proofs(key, proof) leads on from the roots."""
    tops = materialise(roots.join(proofs, "key").select("key", "height", F.col("digest").alias("top"), "proof"), "tops")
    parents, own = None, ["key", "idx", "digest"]
    for height in range(len(levels) - 1, -1, -1):
        nodes = levels[height].drop("children") if height else levels[0]
        here = nodes.filter("idx = 0").join(tops.filter(F.col("height") == height).drop("height"), "key")
        if parents is not None:
            above = parents.select("key", F.col("idx").alias("_up"), "children", "top", "proof")
            found = nodes.withColumn("_up", F.floor(F.col("idx") / width)).join(above, ["key", "_up"])
            at = (F.col("idx") % width).cast("int")
            step = F.struct(F.array_join(F.slice("children", F.lit(1), at), "").alias("before"), F.array_join(F.slice("children", at + 2, F.lit(width)), "").alias("after"))
            found = found.withColumn("proof", F.concat(F.array(step), "proof")).drop("children", "_up")
            here = here.unionByName(found.select(*here.columns))
        if height:
            here = here.join(levels[height].select(*own[:2], "children"), own[:2])
            parents = materialise(here, "proofs")
    return here


def manifest(rows: DataFrame, order: list[Column], width: int = WIDTH) -> tuple[str | None, DataFrame]:
    """The root, and rows(group, digest, ...) with subroot and proof. Proofs have a step a level, so their length is the logarithm of the rows."""
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("-"))  # null first
    levels, subroots = build(numbered_leaves(rows.withColumn("key", key), [*order, F.col("digest")]), width)
    groups = subroots.select(F.lit("").alias("key"), F.col("key").alias("of"), "digest")
    upper, roots = build(numbered_leaves(groups, [F.col("of")]), width)
    root = roots.first()
    start = spark.createDataFrame([("", [])], f"key string, proof {STEP}")
    lower_proofs = push(upper, roots, start, width).select(F.col("of").alias("key"), "proof")
    out = push(levels, subroots, lower_proofs, width).drop("key", "idx").withColumnRenamed("top", "subroot")
    return (root["digest"] if root else None), out


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def audited(docs: DataFrame, touched: Column, changed: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, proof_sha256 of each of docs(doc_id, text, lang, source, n_chars), and folded_root, verified: what the proof leads to from a copy of the row in which text is changed where touched holds."""
    head = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    leaf, text = row_digest(*head, F.col("text")), F.col("text").cast("string")
    # hashed again only where it differs
    other = F.when(F.coalesce(touched & (changed != text), F.lit(False)), row_digest(*head, changed))
    root, rows = manifest(docs.select("doc_id", F.col("source").alias("group"), leaf.alias("digest"), other.alias("other")), [F.col("doc_id").asc_nulls_first()])
    rows = rows.withColumn("root", F.lit(root).cast("string")).withColumn("folded_root", folded(F.coalesce("other", "digest"), F.col("proof")))
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
