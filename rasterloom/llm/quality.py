"""Quality rules as a short-circuit cascade.

Each rule rejects a text or lets it pass. ``rule_order`` times every rule and counts its rejections on a sample of bounded size, and puts
the rules in order of rejections per second; ``quality`` then stops at the first rule that rejects a text. A text is kept if no
rule rejects it, so the order changes the cost and never the verdict.

Null texts count as empty, have no words and are not kept. Rows are judged one by one: repeated rows, ties and null ids are
returned as they come, an empty table gives an empty result, and further columns are left alone.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, text_batches, text_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words in a window that may repeat.
WINDOW = 5
#: Rows on which costs and rejections are estimated.
SAMPLE_ROWS = 400
#: Words beyond which windows are ranked in numpy, not held as tuples.
LONG = 50_000


class Text:
    """The measures of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # bytes.split() splits at ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return covered(repeated_windows(self.words))

    @cached_property
    def n_capitals(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, CAPITALS))

    @cached_property
    def n_stutters(self) -> int:
        return sum(map(eq, self.words, self.words[1:]))


def repeated_windows(words: list[bytes]) -> list[int]:
    """Starts of the windows that the text holds twice or more, ascending."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return []
    if len(words) > LONG:
        ids: dict[bytes, int] = {}
        rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        dense = rank
        for k in range(1, WINDOW):
            pairs = dense[: len(words) - k] * len(ids) + rank[k:]
            _, dense = np.unique(pairs, return_inverse=True)
        times = np.bincount(dense)
        return np.flatnonzero(times[dense] > 1).tolist()
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == n:
        return []
    times = Counter(windows)
    return [i for i, w in enumerate(windows) if times[w] > 1]


def covered(starts: list[int]) -> int:
    total = end = 0
    for i in starts:
        total += i + WINDOW - max(i, end)
        end = i + WINDOW
    return total


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: The first two are the base rules.
BASE = (
    Rule("few_words", lambda t: t.n_words < 10),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t: 100 * t.n_symbols > 25 * t.n_words),
    Rule("dup_lines", lambda t: 100 * t.n_dup_lines > 40 * len(t.lines)),
    Rule("exclamations", lambda t: 100 * t.text.count("!") > 50 * t.n_words),
    Rule("capitals", lambda t: 100 * t.n_capitals > 30 * t.word_chars),
    Rule("stutter", lambda t: 100 * t.n_stutters > 30 * t.n_words),
    Rule("long_words", lambda t: t.word_chars > 12 * t.n_words),
)


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected), best first, estimated in the executors on about sample_rows rows, a share of every partition. A rule is timed on a fresh text, so that each bears the cost of its own measures."""

    def estimate(batches):
        spent, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for k, rule in enumerate(rules):
                    fresh, began = Text(text), time.perf_counter()
                    rejected[k] += bool(rule.rejects(fresh))
                    spent[k] += time.perf_counter() - began
        if n:
            yield {"rule": list(range(len(rules))), "s": spent, "rejected": rejected, "n": [n] * len(rules)}

    texts = docs.select(text_of(text_col).alias("text"))
    total = texts.count()
    # a share of each partition, estimated where it lies; which rows are drawn changes the order of the rules, never the verdict
    sample = texts.sample(fraction=sample_rows / total, seed=7) if total > sample_rows else texts
    rows = map_arrow(sample, estimate, "rule int, s double, rejected long, n long").groupBy("rule").agg(F.sum("s"), F.sum("rejected"), F.sum("n")).collect()
    found = {r[0]: (r[1] / r[3], r[2] / r[3]) for r in rows}
    cost = [(rule.name, *found.get(k, (0.0, 0.0))) for k, rule in enumerate(rules)]
    return sorted(cost, key=lambda x: -x[2] / max(x[1], 1e-9))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", measures: bool = True, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: the id, kept, and the first rule in the cascade's order that rejects it (null if kept); with measures also the base counts."""
    order = [name for name, _, _ in rule_order(docs, rules, text_col, sample_rows)]
    cascade = sorted(rules, key=lambda r: order.index(r.name))
    id_type = docs.schema[id_col].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if measures else ()

    def judge(batches):
        for batch in batches:
            out = {id_col: batch.column(0), "rejected_by": [], "kept": []} | {c: [] for c in counts} | ({"base_failed": []} if measures else {})
            for text in batch.column(1).to_pylist():
                t = Text(text)
                reject = next((r.name for r in cascade if r.rejects(t)), None)
                out["rejected_by"].append(reject)
                out["kept"].append(reject is None)
                for c in counts:
                    out[c].append(getattr(t, c))
                if measures:
                    out["base_failed"].append(any(r.rejects(t) for r in BASE))
            yield out

    schema = f"`{id_col}` {id_type}, rejected_by string, kept boolean" + "".join(f", {c} long" for c in counts) + ", base_failed boolean" * measures
    return map_arrow(docs.select(F.col(id_col), text_of(text_col).alias("text")), judge, schema)


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rejected rows, with all its columns."""
    order = [name for name, _, _ in rule_order(docs, rules, text_col, sample_rows)]
    cascade = sorted(rules, key=lambda r: order.index(r.name))

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            yield batch.filter(pa.array([not any(r.rejects(t) for r in cascade) for t in map(Text, texts)], pa.bool_()))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
