"""Byte-level BPE by tree reduction: halves are encoded and neighbours joined.

What parts a text and what merges its bytes both look a little beyond a cut, so ids of two halves can't just be put together. Two facts
say how far to look:

- The pattern parts a text between a letter and anything else, a digit and anything else, and a mark and white space or a digit, whatever
  stands around. Only what lies between the last such place of the left half and the first one of the right half is encoded anew.
- A sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of theirs: a merge across a
  border would be made in the two tokens alone as well. So in a long run without such a place (letters of a script without spaces,
  digits, white space) a window of tokens around the cut is encoded anew and grows until its outer tokens agree with their neighbours.

Long texts are cut into segments that Spark deals out; levels of neighbours are joined by a group-by on half their number until each text
is one. Ids are decoded by the same tree: each half gives its bytes, joined in order.

Null texts count as empty and have no ids. Rows are encoded one by one, whatever their id; repeated rows each give a row. Further columns
are left alone. What stands for a special token elsewhere is ordinary text here.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, materialise, partitions, text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Code points encoded at once, and ids decoded at once, at the tree's leaves.
LEAF = 2048
#: Code points between two sure places that are encoded anew as they are; longer ones go by windows of tokens.
PLAIN = 256
#: Code points of a segment.
SEGMENT = 1 << 16
#: Code points or ids that pass on to Spark at once, about.
BATCH = 1 << 20
#: White space as the pattern knows it; fixed values of Unicode.
SPACES = frozenset("\t\n\v\f\r \x85\xa0                　")


@cache
def kind(c: str) -> str:
    """L letter, N digit, S white space, P mark; ? where tables of Unicode may differ."""
    general = unicodedata.category(c)
    return "S" if c in SPACES else "?" if general == "Cn" else general[0] if general[0] in "LN" else "P"


def parts_here(before: str, after: str) -> bool:
    """Whether the pattern parts a text between these characters, whatever else it holds."""
    a, b = kind(before), kind(after)
    if "?" in (a, b):
        return False
    return a in "LN" and a != b or a == "P" and b in "SN"


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        spaces = "".join(sorted(SPACES))
        self.pattern = regex.compile(pattern.replace(r"[^\s", rf"[^{spaces}").replace(r"\S", rf"[^{spaces}]").replace(r"\s", rf"[{spaces}]"))

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def merged(self, raw: bytes) -> list[int]:
        """The ids of bytes that the pattern doesn't part."""
        return self.library._encode_single_piece(raw)

    # -- joining ids of neighbours
    def agree(self, a: int, b: int) -> bool:
        return self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def fuse(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbours' bytes that the pattern doesn't part: the window around the cut grows until both its ends agree with what lies outside."""
        if not left or not right:
            return left + right
        w = 4
        while True:
            i, j = max(0, len(left) - w), min(len(right), w)
            new = self.merged(self.raw(left[i:]) + self.raw(right[:j]))
            if (i == 0 or self.agree(left[i - 1], new[0])) and (j == len(right) or self.agree(new[-1], right[j])):
                return left[:i] + new + right[j:]
            w *= 2

    def tail(self, ids: list[int]) -> tuple[int, str]:
        """Where in ids the part after the last sure place begins, and its text."""
        n = 8
        while True:
            raw = self.raw(ids[-n:])
            at = 0
            while n < len(ids) and at < len(raw) and raw[at] & 0xC0 == 0x80:  # within a character
                at += 1
            text = raw[at:].decode()
            for q in range(len(text) - 1, 0, -1):
                if parts_here(text[q - 1], text[q]):
                    rest = text[q:]
                    return self.count_back(ids, len(rest.encode())), rest
            if n >= len(ids):
                return 0, text
            n *= 4

    def count_back(self, ids: list[int], n_bytes: int) -> int:
        i = len(ids)
        while n_bytes > 0:
            i -= 1
            n_bytes -= len(self.bytes_of[ids[i]])
        return i

    def head(self, ids: list[int]) -> tuple[int, str]:
        """Where in ids the part before the first sure place ends, and its text."""
        n = 8
        while True:
            raw = self.raw(ids[:n])
            if n < len(ids):
                end = len(raw)
                while end and raw[end - 1] & 0xC0 == 0x80:
                    end -= 1
                raw = raw[: max(0, end - 1)]  # the last character may be cut
            text = raw.decode()
            for q in range(1, len(text)):
                if parts_here(text[q - 1], text[q]):
                    first = text[:q]
                    return self.count_on(ids, len(first.encode())), first
            if n >= len(ids):
                return len(ids), text
            n *= 4

    def count_on(self, ids: list[int], n_bytes: int) -> int:
        i = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[i]])
            i += 1
        return i

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the text of left followed by that of right."""
        if not left or not right:
            return left + right
        i, a = self.tail(left)
        j, b = self.head(right)
        if parts_here(a[-1], b[0]):
            return left + right
        if len(a) + len(b) <= PLAIN or any(kind(c) == "?" for c in a + b):
            return left[:i] + self.library.encode_ordinary(a + b) + right[j:]
        return left[:i] + self.join_runs(a, left[i:], b, right[:j]) + right[j:]

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int, list[int]]]:
        """The matches of the pattern in a text, with their ids out of the text's."""
        out, at = [], 0
        for m in self.pattern.finditer(text):
            to = at + self.count_on(ids[at:], len(m[0].encode())) if m.end() < len(text) else len(ids)
            out.append((m.start(), m.end(), ids[at:to]))
            at = to
        return out

    def join_runs(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """join() where a + b has no sure place but perhaps between the two: matches that stay keep their ids, those that change are put together from what is left of them."""
        before = {s: (e, ids) for s, e, ids in self.spans(a, left)}
        after = {e + len(a): (s + len(a), ids) for s, e, ids in self.spans(b, right)}
        out: list[int] = []
        text = a + b
        for m in self.pattern.finditer(text):
            s, e = m.span()
            if s in before and before[s][0] == e:
                out += before[s][1]
            elif e in after and after[e][0] == s:
                out += after[e][1]
            else:
                start, first = s, []
                if s in before:  # the match began so: its ids as far as it still goes
                    n, most = 0, len(text[s : min(e, before[s][0])].encode())
                    for t in before[s][1]:
                        if n + len(self.bytes_of[t]) > most:
                            break
                        n += len(self.bytes_of[t])
                        first.append(t)
                    start = n
                else:
                    start = 0
                raw = text[s:e].encode()
                last = after[e][1] if e in after and after[e][0] > s else []
                stop = len(raw) - len(self.raw(last))
                if stop < start:
                    last, stop = [], len(raw)
                middle = self.merged(raw[start:stop]) if stop > start else []
                out += self.fuse(self.fuse(first, middle), last)
        return out

    # -- trees
    def encode(self, text: str) -> list[int]:
        if len(text) <= LEAF:
            return self.library.encode_ordinary(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return self.raw(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@cache
def codec(ranks: str | None = None) -> Codec:
    """One for each worker, kept from task to task."""
    import public_tokenizers

    return Codec(ranks or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def mapped(df: DataFrame, columns: list[str], schema: str, size, result) -> DataFrame:
    """df's rows, of which the last of columns goes through result(); passed on some at a time, by their size()."""

    def run(batches):
        for batch in batches:
            out, held = {c: [] for c in columns}, 0
            for *others, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for c, v in zip(columns, [*others, result(value)], strict=True):
                    out[c].append(v)
                held += size(value)
                if held > BATCH:
                    yield out
                    out, held = {c: [] for c in columns}, 0
            if out[columns[0]]:
                yield out

    return map_arrow(df, run, schema)


def segments(docs: DataFrame, id_type: str, segment: int) -> DataFrame:
    """row, id, seg, text: texts cut into segments, in order."""

    def run(batches):
        for batch in batches:
            for row, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at in range(0, len(text), 16 * segment):
                    cut = [text[i : i + segment] for i in range(at, min(len(text), at + 16 * segment), segment)]
                    yield {"row": [row] * len(cut), "id": [own] * len(cut), "seg": list(range(at // segment, at // segment + len(cut))), "text": cut}

    return map_arrow(docs, run, f"row long, id {id_type}, seg long, text string")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """id, ids: every text's ids, as the tiktoken library gives them with these ranks."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    long = F.char_length("text") > segment
    short = mapped(rows.filter(~long), ["id", "ids"], f"id {id_type}, ids array<int>", len, lambda t: codec(ranks).encode(t))

    cut = segments(rows.filter(long).select(F.monotonically_increasing_id().alias("row"), "id", "text"), id_type, segment)
    cut = cut.repartition(partitions(docs.sparkSession), "row", "seg")
    schema = f"row long, id {id_type}, seg long, ids array<int>"
    level = materialise(mapped(cut, ["row", "id", "seg", "ids"], schema, len, lambda t: codec(ranks).encode(t)), "segments")
    last = level.agg(F.max("seg")).first()[0] or 0
    while last:
        pairs = level.groupBy("row", F.floor(F.col("seg") / 2).alias("seg")).agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct(F.col("seg").alias("s"), "ids")))["ids"].alias("halves"))

        def joined(halves):
            return codec(ranks).join(*halves) if len(halves) == 2 else halves[0]

        level = materialise(mapped(pairs.select("row", "id", "seg", "halves"), ["row", "id", "seg", "ids"], schema, lambda h: sum(map(len, h)), joined), "segments")
        last //= 2
    return short.unionByName(level.select("id", "ids")).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """encoded(id, ids) with decoded, the bytes that the ids stand for."""
    own = encoded.columns[0]
    kind_ = encoded.schema[own].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                yield {own: part.column(0), "ids": part.column(1), "decoded": [codec(ranks).decode(x) for x in part.column(1).to_pylist()]}

    return map_arrow(encoded.select(own, "ids"), run, f"`{own}` {kind_}, ids array<int>, decoded binary")
