"""Near-duplicates by consistent weighted sampling over TF-IDF shingles.

A text's shingles are its windows of five words; a text of one to four words has one shingle, one without words none. A shingle
weighs its count times an inverse document frequency between 1 and 1 + ``idf_span``; frequencies come from all documents, counted
in ``BINS`` hashed bins, a table whose size doesn't depend on the corpus. Improved consistent weighted sampling draws
``BANDS * ROWS`` samples a text, each equal for two texts with the probability of their weighted Jaccard similarity. Texts that
agree in all rows of a band meet in a bucket; of buckets that hold the same texts one stays. All texts of a bucket are compared, by
products of matrices, and linked at a weighted Jaccard similarity of at least ``threshold``; linked texts form classes.

A bucket is dealt into blocks of about ``BLOCK`` texts or ``BLOCK_CHARS`` characters, and every two blocks are a group that one task
compares. A bucket of more than ``WIDE`` blocks is compared in rounds, each of which costs in proportion to the bucket: a block of its
texts, taken from outside its largest class, meets all others and then leaves the bucket, until all of a bucket is one class or has
left. A caller of ``classes`` may have buckets that are still so large after some rounds split by ``SPLITS`` further bands of
``SPLIT_ROWS`` samples each, in which two texts at the threshold meet again with a chance of 1 - (1 - 0.8 ** SPLIT_ROWS) ** SPLITS =
0.9998; ``near_duplicates`` doesn't, so that what is found doesn't depend on a bucket's size. No bucket is capped, and none is left before all of its texts have met or are of one class.

Texts alike to the letter are one node throughout, so copies cost a hash each. Null texts count as empty and are copies of one
another. Rows that share an id count as one document. Rows with a null id take no part and have no class. An empty table gives an
empty result; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import discard, map_arrow, materialise, partitions, text_of
from rasterloom.llm.graph import components

WINDOW = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
#: Document frequencies are counted in so many hashed bins.
BINS = 1 << 19
#: How far rare shingles outweigh frequent ones, unless the caller says otherwise: small, so that large groups of near copies, whose shingles are frequent, stay alike.
IDF_SPAN = 0.15
#: Random variates that samples draw from.
POOL = 1 << 16
#: Texts and characters in a block of a bucket, about; buckets of more than WIDE blocks are compared in rounds.
BLOCK, BLOCK_CHARS, WIDE = 512, 8_000_000, 4
SPLITS, SPLIT_ROWS = 28, 6
#: Columns of a matrix of shingles that is held at once.
COLUMNS = 8192

MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted 64-bit hashes, and their counts."""
    words = text.encode("utf-8", "replace").split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(WINDOW, len(h))
    if not size:
        return h, np.zeros(0, np.int64)
    acc = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        acc = (acc ^ h[k : len(h) - size + 1 + k]) * MIX
        acc ^= acc >> np.uint64(29)
    return np.unique(mixed(acc), return_counts=True)


def bins_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


class Sampler:
    """Ioffe's sampling with variates drawn from a fixed pool by (shingle, sample)."""

    def __init__(self, samples: int = BANDS * ROWS):
        u = mixed(np.arange(1, 5 * POOL + 1, dtype=np.uint64) * MIX).astype(np.float64) / 2.0**64
        u = np.clip(u, 1e-12, 1 - 1e-12).reshape(5, POOL)
        self.r = -np.log(u[0] * u[1])
        self.log_c = np.log(-np.log(u[2] * u[3]))
        self.beta = u[4]
        self.factor = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def after(self, samples: int) -> Sampler:
        """The sampler without its first samples."""
        self.factor = self.factor[samples:]
        return self

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit value for each sample, equal for two texts if they drew the same shingle at the same level."""
        log_w = np.log(weights)
        best = np.full(len(self.factor), np.inf)
        out = np.zeros(len(self.factor), np.uint64)
        rows = np.arange(len(self.factor))
        for at in range(0, len(hashes), 4096):
            h = hashes[at : at + 4096]
            i = ((h[None, :] * self.factor[:, None]) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[i], self.beta[i]
            level = np.floor(log_w[at : at + 4096] / r + beta)
            log_a = self.log_c[i] - r * (level - beta + 1)
            first = log_a.argmin(axis=1)
            better = log_a[rows, first] < best
            best = np.where(better, log_a[rows, first], best)
            found = mixed(h[first] ^ mixed((level[rows, first] + 2**20).astype(np.uint64)))
            out = np.where(better, found, out)
        return out


def bands_of(samples: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = samples.reshape(bands, -1)
    acc = mixed(np.arange(1, bands + 1, dtype=np.uint64) * MIX)
    for k in range(parts.shape[1]):
        acc = mixed(acc ^ parts[:, k]) * MIX
    return acc.view(np.int64)


def frequencies(docs: DataFrame, text_col: str, idf_span: float = IDF_SPAN) -> np.ndarray:
    """Inverse document frequency by bin, over all texts, from 1 to 1 + idf_span."""

    def held(batches):
        total, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            found = [bins_of(shingles(t)[0]) for t in batch.column(0).to_pylist()]
            n += len(found)
            total += np.bincount(np.concatenate([np.unique(x) for x in found]), minlength=BINS) if found else 0
        if n:
            used = np.flatnonzero(total)
            yield {"bin": np.append(used, -1), "n": np.append(total[used], n)}

    rows = map_arrow(docs.select(text_of(text_col).alias("text")), held, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    n, df = 0, np.zeros(BINS)
    if len(rows):
        at = rows["bin"].to_numpy()
        n = rows["n"].to_numpy()[at < 0].sum()
        df[at[at >= 0]] = rows["n"].to_numpy()[at >= 0]
    share = np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 2)
    return (1 + idf_span * share).astype(np.float32)


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = shingles(text)
    return hashes, counts * idf[bins_of(hashes)].astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of the smaller weights over the sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - common
    return float(common / total) if total > 0 else 0.0


def fingerprints(docs: DataFrame, idf, id_col: str, text_col: str) -> DataFrame:
    """id, the two halves of the text's 128-bit hash, its characters, and its band values (none without words)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        sampler = Sampler()
        for batch in batches:
            halves, bands, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                halves.append(np.frombuffer(xxhash.xxh3_128_digest(text.encode("utf-8", "replace")), np.int64))
                h, w = weighted(text, idf.value)
                bands.append(bands_of(sampler(h, w)) if len(h) else [])
                sizes.append(len(text))
            halves = np.array(halves, np.int64).reshape(-1, 2)
            yield {"id": batch.column(0), "h1": halves[:, 0], "h2": halves[:, 1], "size": sizes, "bands": bands}

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_arrow(rows, run, f"id {id_type}, h1 long, h2 long, size long, bands array<long>")


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (key, node, size, label) of the buckets that hold several classes, with blocks (how many the bucket makes), low (its largest class) and outer (how many blocks the texts outside that class make). Of buckets that hold the same texts one stays."""
    # by class first, so that a bucket's texts are counted where they lie
    classes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    buckets = classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "size", "label")).alias("most")).filter("classes > 1")
    one = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("key", "size", "most")).alias("b")).select("n", "b.*")

    def blocks(n, size):
        return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / F.lit(float(BLOCK_CHARS)))).cast("int")

    sizes = one.select("key", F.col("most.label").alias("low"), blocks(F.col("n"), F.col("size")).alias("blocks"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("outer"))
    sizes = materialise(sizes, "buckets")
    out = materialise(rows.join(sizes, "key"), "bucketed")
    discard(sizes)
    return out


def split(rows: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """rows (key, node, size, label) of large buckets, dealt to smaller ones by further bands."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches):
        sampler = Sampler(BANDS * ROWS + SPLITS * SPLIT_ROWS).after(BANDS * ROWS)
        for batch in batches:
            yield {"node": batch.column(0), "further": [bands_of(sampler(*weighted(t, idf.value)), SPLITS) for t in batch.column(1).to_pylist()]}

    used = rows.select(F.col("node").alias("id")).distinct()
    further = materialise(map_arrow(texts.join(used, "id", "left_semi").select("id", "text").repartition(partitions(texts.sparkSession)), run, f"node {id_type}, further array<long>"), "further")
    dealt = rows.join(further, "node").select("key", "node", "size", "label", F.posexplode("further").alias("band", "part"))
    return dealt.select(F.xxhash64("key", "band", "part").alias("key"), "node", "size", "label")


def links_of(nodes: list, labels: list, texts: list[str], first: np.ndarray, idf: np.ndarray, threshold: float) -> list[tuple]:
    """Links between texts of different classes that are similar enough: each text of the first block with each of the second, or all with all if there is one block. Links between texts that others of this call link already are left out."""
    vectors = [weighted(t, idf) for t in texts]
    top = {x: x for x in labels}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    total = np.array([v[1].sum() for v in vectors])
    # a shingle that a text holds n times is n elements, so that the smaller of two weights is a sum over common elements
    counts = [np.rint(v[1] / idf[bins_of(v[0])]).astype(np.int64) for v in vectors]
    times = [np.arange(c.sum()) - np.repeat(c.cumsum() - c, c) for c in counts]
    elements = [mixed(np.repeat(v[0], c) + t.astype(np.uint64) * MIX) for v, c, t in zip(vectors, counts, times, strict=True)]
    weight = np.concatenate([np.repeat(idf[bins_of(v[0])], c) for v, c in zip(vectors, counts, strict=True)])
    _, at, column, held = np.unique(np.concatenate(elements), return_index=True, return_inverse=True, return_counts=True)
    line = np.repeat(np.arange(len(nodes)), [len(x) for x in elements])
    used = np.flatnonzero(held > 1)
    place = np.full(len(held), -1)
    place[used] = np.arange(len(used))
    column, one = place[column], not first.any() or first.all()
    shared = column >= 0
    line, column, weight = line[shared], column[shared], weight[at[used]]
    order = column.argsort(kind="stable")
    line, column = line[order], column[order]
    left = np.arange(len(nodes)) if one else np.flatnonzero(first)
    right = left if one else np.flatnonzero(~first)
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(used), COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        held_by = np.zeros((len(nodes), min(COLUMNS, len(used) - low)), np.float32)
        held_by[line[i:j], column[i:j] - low] = 1
        common += (held_by[left] * weight[low : low + COLUMNS]) @ held_by[right].T
    # candidates by single precision with room for its error, then told exactly
    near = common >= (threshold - 0.001) * (total[left][:, None] + total[right][None, :] - common)
    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = left[i], right[j]
        if one and b <= a:
            continue
        p, q = root(labels[a]), root(labels[b])
        if p != q and similarity(vectors[a], vectors[b]) >= threshold:
            top[p] = q
            out.append((nodes[a], nodes[b]))
    return out


def leads(turn: int, width: int):
    """Whether a text of a large bucket is one of the block that meets all others in this turn."""
    return (F.col("blocks") > width) & (F.col("label") != F.col("low")) & (F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.col("outer")) == 0)


def met(rows: DataFrame, turn: int = 0, width: int = WIDE) -> DataFrame:
    """rows of bucketed(), dealt to the groups (key, i, j) in which blocks meet, with own (a text's block). In buckets of up to width blocks every block meets every other and itself; in larger ones only one block of texts outside the largest class meets all, itself too."""
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    rows = rows.withColumn("leads", leads(turn, width)).withColumn("own", F.when(F.col("leads"), F.lit(-1)).otherwise(own))
    everyone = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    groups = F.when(F.col("leads"), F.concat(everyone, F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))))
    groups = groups.when(F.col("blocks") > width, F.array(F.struct(F.lit(-1).alias("i"), F.col("own").alias("j")))).otherwise(everyone)
    return rows.withColumn("group", F.explode(groups)).select("key", "group.i", "group.j", "own", "node", "label")


def compared(meetings: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links a, b of the groups of met(), between texts that aren't of one class."""
    id_type = texts.schema["id"].dataType.simpleString()
    groups = ["key", "i", "j"]
    dealt = meetings.join(texts.hint("merge"), F.col("node") == F.col("id")).select(*groups, (F.col("own") == F.col("i")).alias("first"), "node", "label", "text")
    dealt = dealt.repartition(partitions(meetings.sparkSession), *groups).sortWithinPartitions(*groups)

    def compare(batches):
        at, group = None, []

        def found():
            if len({x[2] for x in group}) < 2:
                return {"a": [], "b": []}
            first, nodes, labels, held = zip(*group, strict=True)
            pairs = links_of(nodes, labels, held, np.array(first), idf.value, threshold)
            return {"a": [x for x, _ in pairs], "b": [y for _, y in pairs]}

        for batch in batches:
            for *key, first, node, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != at:
                    yield found()
                    at, group = key, []
                group.append((first, node, label, text))
        yield found()

    return map_arrow(dealt, compare, f"a {id_type}, b {id_type}")


def classes(rows: DataFrame, texts: DataFrame, idf, threshold: float, width: int = WIDE, split_at: int | None = None) -> DataFrame | None:
    """node, label of the texts of buckets rows (key, node, size) that have a link; None without links. Every two texts of a bucket meet or are of one class, however large it is; with split_at buckets that are still large after so many rounds are split, which may lose links."""
    labels, turn = None, 0
    rows = bucketed(rows.withColumn("label", F.col("node")))
    while not rows.isEmpty():
        links = materialise(compared(met(rows, turn, width), texts, idf, threshold), "links")
        if not links.isEmpty():
            known, labels = labels, materialise(components(links if labels is None else links.union(labels)), "labels")
            discard(*[x for x in (known,) if x is not None])
        discard(links)
        left = rows.filter(F.col("blocks") > width).filter(~leads(turn, width)).select("key", "node", "size", "label")
        turn += 1
        if left.isEmpty():
            break
        if labels is not None:
            left = left.join(labels.toDF("node", "new"), "node", "left").select("key", "node", "size", F.coalesce("new", "label").alias("label"))
        met_before, rows = rows, bucketed(left)
        discard(met_before)
        if turn == split_at:
            large = rows.filter(F.col("blocks") > width)
            if not large.isEmpty():
                columns = ["key", "node", "size", "label"]
                rows = bucketed(rows.filter(F.col("blocks") <= width).select(columns).union(split(large, texts, idf).select(columns)))
    discard(rows)
    return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", width: int = WIDE, idf_span: float = IDF_SPAN) -> DataFrame:
    """id, class_id (the smallest id of its class), kept (whether it is the one that stays); one row a row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    idf = spark.sparkContext.broadcast(frequencies(docs, "text", idf_span))
    prints = materialise(fingerprints(docs, idf, id_col, "text"), "prints")
    # written before it is joined, so that the join has its exchanges to itself and can split a text that very many rows hold
    nodes = materialise(prints.groupBy("h1", "h2").agg(F.min(F.struct("id", "size", "bands")).alias("n")).select("h1", "h2", F.col("n.id").alias("node"), "n.size", "n.bands"), "nodes")

    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    shared = materialise(shared, "shared")
    rows = materialise(keyed.join(shared, "key", "left_semi").distinct(), "keyed")
    used = rows.select(F.col("node").alias("id")).distinct()
    # by merging at any size: whether ids would fit a broadcast depends on the input
    texts = materialise(docs.select(F.col(id_col).alias("id"), "text").join(used.hint("merge"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    labels = classes(rows, texts, idf, threshold, width)
    discard(shared, rows, texts)

    members = prints.select("id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"])
    if labels is None:
        members = members.withColumn("label", F.col("node"))
    else:
        members = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return members.select(F.col("id").alias(id_col), F.col("label").alias("class_id"), (F.col("id") == F.col("label")).alias("kept"))


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", idf_span: float = IDF_SPAN) -> DataFrame:
    """docs with one document of each class, with all its columns; rows with a null id stay, as do all rows of an id that stays."""
    gone = near_duplicates(docs, threshold, id_col, text_col, idf_span=idf_span).filter("not kept").select(F.struct(F.col(id_col).alias("id")).alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.struct(F.col(f"row.`{id_col}`").alias("id")) == F.col("gone"), "left_anti").select("row.*")
