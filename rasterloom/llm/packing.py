"""Packing token sequences: dominance reduction, then best fit.

A piece counts only by its length, so an instance is a histogram of at most ``capacity`` lengths, which Spark sums up and the
driver packs: first every set of at most three pieces that provably dominates all other sets with its longest piece is fixed and
taken out (Martello and Toth), as often as its lengths last; best fit, longest first, packs the remainder, many equal sequences at
once. What the driver holds is bounded by the capacity, however many documents there are. Each piece finds its place by its rank
among the pieces of its length; a rank is the rank in one of many buckets, by a hash, plus the counts of the buckets before, so that
a length that many pieces share is dealt over all tasks.

Null texts count as empty: one piece of just the end id. Rows are packed one by one: repeated rows, null ids and ties each get their
own place, an empty table gives an empty result, further columns are left alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, materialise, partitions, text_of

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Marks that the tokenizer parts from the letters before them.
MARKS = ".,;:!?#$%&*()[]{}+=/^~"
#: Words remembered with their ids in a worker, in each of two generations.
REMEMBERED = 500_000
#: Buckets that the ranks of a length are counted in, at least, and pieces in a bucket of a larger corpus.
BUCKETS, BUCKET_PIECES = 1024, 200_000


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers. The tokenizer drops white space and never joins what it parts, so the ids of a text are those of its words, which are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def ids_of_letters(self, words: list[str]) -> list[bytes]:
        """As ids, for words of letters only. Each ends at the one id that ends a word, so all go through the tokenizer as one text."""
        if not words:
            return []
        found = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[found]) + 1
        if len(ends) != len(words) or ends[-1] != len(found):
            return self.ids(words)
        raw, at = found.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        plain: dict[str, tuple[str, str]] = {}
        others = []
        for w in words:
            if (b := self.old.get(w)) is not None:
                self.young[w] = b
                continue
            # a word of plain letters with marks behind it is encoded as the word and the marks, and letters are lower-cased
            stem = w.rstrip(MARKS)
            low, mark = stem.lower(), w[len(stem) :]
            if stem.isalpha() and (stem.isascii() or max(stem) < "ɐ" and len(low) == len(stem)):
                plain[w] = low, mark
            else:
                others.append(w)
        stems = sorted({s for s, _ in plain.values()}.difference(self.young))
        self.young.update(zip(stems, self.ids_of_letters(stems), strict=True))
        rest = sorted({m for _, m in plain.values() if m not in self.young}.union(others))
        self.young.update(zip(rest, self.ids(rest), strict=True))
        for w, (stem, mark) in plain.items():
            self.young[w] = self.young[stem] + self.young[mark]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {"": b""}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if missing := set().union(*split).difference(self.young):
            self.learn(missing)
        return [b"".join(map(self.young.__getitem__, words)) for words in split]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32: every text's ids and the end id, cut only if longer than capacity."""
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        import public_tokenizers

        enc = encoder(tokenizer or public_tokenizers.path(TOKENIZER))
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), defaultdict(list)
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 50):
                for doc, raw in zip(ids[at : at + 50], enc.encode(texts[at : at + 50]), strict=True):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw) // 4, capacity)):
                        part = raw[4 * start : 4 * (start + capacity)]
                        for k, v in ((id_col, doc), ("piece", piece), ("start", start), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                            out[k].append(v)
            if out:
                yield out

    return map_arrow(docs.select(F.col(id_col), text_of(text_col).alias("text")), cut, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long")


class Lengths:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {w: n for w, n in counts.items() if n > 0}
        self.order = sorted(self.counts)

    def take(self, pattern: Counter, times: int) -> None:
        for w, n in pattern.items():
            self.counts[w] -= n * times
            if not self.counts[w]:
                del self.counts[w]
                self.order.pop(bisect_left(self.order, w))

    def without(self, used: Counter, w: int) -> int:
        return self.counts.get(w, 0) - used[w]

    def smallest(self, n: int, used: Counter, above: int = 0) -> list[int]:
        """The n smallest lengths over above that are left beside used."""
        out: list[int] = []
        for i in range(bisect_right(self.order, above), len(self.order)):
            w = self.order[i]
            out += [w] * min(n - len(out), self.without(used, w))
            if len(out) == n:
                break
        return out

    def largest(self, most: int, used: Counter) -> int | None:
        """The largest length up to most that is left beside used."""
        for i in range(bisect_right(self.order, most) - 1, -1, -1):
            if self.without(used, self.order[i]) > 0:
                return self.order[i]
        return None

    def best_pair(self, room: int, used: Counter) -> int:
        """The largest sum of two pieces within room, 0 if there is none."""
        best, low, high = 0, 0, bisect_right(self.order, room) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            if self.without(used, a) < 1 or (low == high and self.without(used, a) < 2):
                low += 1
            elif self.without(used, b) < 1:
                high -= 1
            elif a + b > room:
                high -= 1
            else:
                best, low = max(best, a + b), low + 1
        return best


def dominating(left: Lengths, w: int, capacity: int) -> Counter | None:
    """A set with w that dominates all others with w: whatever they hold besides w, it holds something at least as long in place of it."""
    used, room = Counter([w]), capacity - w
    few = left.smallest(3, used)
    if not few or few[0] > room:
        return used
    a = left.largest(room, used)
    if a == room or sum(few[:2]) > room or len(few) < 2:
        return used + Counter([a])
    if len(few) == 3 and sum(few) <= room:
        return None
    if a >= left.best_pair(room, used):
        return used + Counter([a])
    c = left.largest(room - a, used + Counter([a]))
    if c is None:
        return None
    over = left.smallest(2, used, above=c)
    if len(over) < 2 or sum(over) > room:
        return used + Counter([a, c])
    return None


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """The sequences that dominance fixes, as patterns and how often, and the lengths left over. Taking pieces out never ends a pattern's dominance, so it is taken as often as its lengths last."""
    left, fixed = Lengths(counts), []
    for w in sorted(counts, reverse=True):
        while left.counts.get(w) and (pattern := dominating(left, w, capacity)):
            times = min(left.counts[x] // n for x, n in pattern.items())
            fixed.append((pattern, times))
            left.take(pattern, times)
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best fit, longest first. Sequences with equal room are open together, as patterns and how often."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[Counter, int]]] = defaultdict(list)

    def put(room: int, pattern: Counter, times: int) -> None:
        if times:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, Counter(), n
            fit = room // w
            full = min(times, n // fit)
            put(room - fit * w, pattern + Counter({w: fit}), full)
            n -= full * fit
            if times > full and n:
                put(room - n * w, pattern + Counter({w: n}), 1)
                full, n = full + 1, 0
            if room < capacity or pattern:
                put(room, pattern, times - full)
    return [x for group in open_.values() for x in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[tuple[Counter, int]]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), by length and rank: pieces of a length take the sequences in the order of their ranks."""
    rows, ranks, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for w, n in sorted(pattern.items(), reverse=True):
            rows.append((w, ranks[w], n, sequence, offset))
            ranks[w] += n * times
            offset += n * w
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of docs with sequence_id and offset, in few sequences of at most capacity ids."""
    spark = docs.sparkSession
    cut = materialise(pieces(docs, capacity, end_id, tokenizer, id_col, text_col), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # one row a length, capacity rows at most
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))

    buckets = max(BUCKETS, -(-sum(counts.values()) // BUCKET_PIECES))
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    in_bucket = bucketed.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = in_bucket.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("bucket", "length").orderBy(id_col, "piece", "ids_crc32")
    ranked = bucketed.repartition(partitions(spark), "bucket").withColumn("own", F.row_number().over(own) - 1)
    ranked = ranked.join(first, ["bucket", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank"))

    def place(batches):
        rows = table.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (3, 5))
            _, first_rank, n, sequence, offset = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
            i = rank - first_rank
            yield {c: batch.column(k) for k, c in enumerate([id_col, "piece", "start", "length", "ids_crc32"])} | {"sequence_id": sequence + i // n, "offset": offset + i % n * length}

    id_type = docs.schema[id_col].dataType.simpleString()
    return map_arrow(ranked, place, f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
