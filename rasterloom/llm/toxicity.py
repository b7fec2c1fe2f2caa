"""Severity of toxicity by a cumulative-link ordinal regression.

Grades are the labels' distinct values in their order, the lowest of which means not toxic; labels that only say toxic or not are two
grades with one threshold. P(grade > k) = sigmoid(w.x - theta_k): one weight vector serves all thresholds, which are ordered. Features
x are the words of a text and their prefixes of four and five letters, binary, lower case, hashed to ``FEATURES`` columns; the expected
severity is the sum of P(grade > k). The model is fitted, until it is settled, on at most ``TRAIN_ROWS`` labelled texts, by a hash of
their ids, and on every column that tells the grades on both sides of some threshold apart, whichever side it speaks for, by a
likelihood-ratio test; every text is scored, whole.

Null texts count as empty; rows are scored one by one, so repeated rows and null ids are returned as they come. Labels of ids that
aren't in the table, and null labels, are left out; ids with several labels count once for each. Without labels of two kinds
every text has severity 0; labels of more than ``MOST_GRADES`` kinds are refused. An empty table gives an empty result; further columns
are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, materialise, text_of

#: Grades that labels may have.
MOST_GRADES = 32
FEATURES = 1 << 22
#: Labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
#: Texts that must hold a column on the side that it speaks for, and the likelihood ratio (twice its logarithm) by which it must tell a threshold's sides apart.
LEAST_TEXTS, LEAST_RATIO = 4, 24.0
PREFIXES = (4, 5)
LETTERS = regex.compile(r"\p{L}+")
REMEMBERED = 300_000


@dataclass
class Model:
    columns: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def score(self, x: float) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -40, 40)))


def columns_of(word: str) -> tuple[int, ...]:
    """A word's columns: the word and its prefixes."""
    return tuple(xxhash.xxh3_64_intdigest(f"{n}:{word[:n] if n else word}") % FEATURES for n in (0, *(p for p in PREFIXES if len(word) >= p)))


class Reader:
    """Columns of texts; words are remembered."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def columns(self, text: str) -> set[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out: set[int] = set()
        for w in set(LETTERS.findall(text.lower())):
            if (found := self.known.get(w)) is None:
                found = self.known[w] = columns_of(w)
            out.update(found)
        return out


def telling(read: DataFrame, totals: dict[int, int], least: float = LEAST_RATIO) -> list[int]:
    """The columns that tell the texts above a threshold from those up to it, for any of the thresholds, ascending. read holds columns and y (the grade), one row a text; totals are the texts of each grade."""
    grades = sorted(totals)
    counts = read.select(F.explode("columns").alias("c"), "y").groupBy("c").agg(*[F.count_if(F.col("y") == g).alias(f"n{g}") for g in grades])
    every = sum(totals.values())

    def part(n, of: float, share):
        """What n of so many texts say against a share of all texts."""
        return F.when(n > 0, n * F.log(n / (F.lit(of) * share))).otherwise(0.0) + F.when(n < of, (F.lit(of) - n) * F.log((F.lit(of) - n) / (F.lit(of) * (F.lit(1.0) - share)))).otherwise(0.0)

    tells = F.lit(False)
    for g in grades[1:]:
        above, below = (sum((F.col(f"n{k}") for k in side), F.lit(0)).cast("double") for side in ([k for k in grades if k >= g], [k for k in grades if k < g]))
        of_above, of_below = (float(sum(n for k, n in totals.items() if (k >= g) == up)) for up in (True, False))
        share = (above + below) / F.lit(float(every))
        enough = F.when(above / of_above > below / of_below, above).otherwise(below) >= LEAST_TEXTS
        tells = tells | (enough & (share < 1.0) & (part(above, of_above, share) + part(below, of_below, share) >= least / 2))
    return sorted(r[0] for r in counts.filter(tells).select("c").collect())  # as many as the labelled texts bear out, however large the corpus


def fit(columns: list[int], rows: list[tuple[list[int], int]], grades_: int = 2, ridge: float = 1e-4, settled: float = 1e-6, rounds: int = 20_000) -> Model:
    """Fit weights and thresholds by limited-memory quasi-Newton steps on the log-likelihood of the grades until its slope is settled; thresholds are a first one and positive gaps. rows hold each text's columns, of the given ones only, and its grade, below grades_. Raises if that takes more than so many rounds."""
    if len({t for _, t in rows}) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(max(1, grades_ - 1), 40.0))
    at = {c: k for k, c in enumerate(columns)}
    sizes = np.array([len(cs) for cs, _ in rows])
    row, col = np.repeat(np.arange(len(rows)), sizes), np.array([at[c] for cs, _ in rows for c in cs], np.int64)
    grades = np.array([t for _, t in rows], np.int64)
    share, i, width = 1 / len(rows), np.arange(len(rows)), len(columns)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[width] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(p[width + 1 :], -30, 30)))])

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        theta = thresholds(p)
        x = np.bincount(row, p[:width][col], len(rows)) if width else np.zeros(len(rows))
        above = 1 / (1 + np.exp(-np.clip(x[:, None] - theta[None, :], -500, 500)))
        bounded = np.hstack([np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))])
        low, high = bounded[i, grades], bounded[i, grades + 1]  # P(grade >= g), P(grade > g)
        # of the outer grades the difference is taken where it is exact
        chance = np.where(grades == 0, 1 / (1 + np.exp(np.clip(x - theta[0], -500, 500))), np.where(grades == grades_ - 1, low, low - high))
        chance = np.maximum(chance, 1e-300)
        d_low, d_high = low * (1 - low) / chance * share, high * (1 - high) / chance * share
        g_theta = np.array([-(d_low * (grades == k + 1)).sum() + (d_high * (grades == k)).sum() for k in range(grades_ - 1)])
        g_w = np.bincount(col, (d_low - d_high)[row], width) if width else np.zeros(0)
        gaps = p[width + 1 :]
        g_gaps = np.array([g_theta[k + 1 :].sum() * np.exp(min(30.0, max(-30.0, gaps[k]))) for k in range(grades_ - 2)])
        value = -np.log(chance).sum() * share + ridge / 2 * (p[:width] @ p[:width] + gaps @ gaps)
        return value, -np.concatenate([g_w, [g_theta.sum()], g_gaps]) + ridge * np.concatenate([p[:width], [0.0], gaps])

    p = np.concatenate([np.zeros(width), [1.0], np.zeros(grades_ - 2)])
    value, slope = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(slope).max() < settled:
            break
        step, shares = slope.copy(), []
        for s, y, r in reversed(past):
            shares.append(r * (s @ step))
            step -= shares[-1] * y
        if past:
            s, y, r = past[-1]
            step *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(shares), strict=True):
            step += (a - r * (y @ step)) * s
        down, length = slope @ step, 1.0
        if down <= 0:
            step, down, past = slope.copy(), slope @ slope, []
        while True:
            new = p - length * step
            new_value, new_slope = loss(new)
            if new_value <= value - 1e-4 * length * down or length < 1e-12:
                break
            length /= 2
        s, y = new - p, new_slope - slope
        stuck = new_value >= value - 1e-15 * abs(value)
        p, value, slope = (p, value, slope) if new_value > value else (new, new_value, new_slope)
        if s @ y > 1e-14:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
        if stuck:  # at the last digit of the likelihood
            if not past or length < 1e-12:
                break
            past = []
    else:
        raise RuntimeError(f"the grades weren't fitted in {rounds} rounds")
    return Model(np.array(columns, np.int64), p[:width], thresholds(p))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most rows labelled texts."""
    found = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label"))
    values = sorted(r[0] for r in found.select("label").distinct().limit(MOST_GRADES + 1).collect())
    if len(values) > MOST_GRADES:
        raise ValueError(f"labels have more than {MOST_GRADES} values")
    if len(values) < 2:
        return fit([], [(0, 0) for _ in values])
    grade = F.coalesce(*[F.when(F.col("label") == v, F.lit(k)) for k, v in enumerate(values)])
    marked = found.select("label_id", grade.alias("y"))
    total = marked.count()
    if total > rows:
        share = int((1 << 20) * rows / total)
        marked = marked.filter(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < share).limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(marked, F.col("id") == F.col("label_id")).select("text", "y")

    def read(batches):
        reader = Reader()
        for batch in batches:
            yield {"columns": [sorted(reader.columns(t)) for t in batch.column(0).to_pylist()], "y": batch.column(1)}

    read_in = materialise(map_arrow(texts, read, "columns array<int>, y int"), "labelled")
    totals = {r[0]: r[1] for r in read_in.groupBy("y").count().collect()}
    columns = telling(read_in, totals) if len(totals) > 1 else []
    shared = docs.sparkSession.sparkContext.broadcast(np.array(columns, np.int32))

    def keep(batches):
        for batch in batches:
            yield {"columns": [np.intersect1d(np.array(x, np.int32), shared.value).tolist() for x in batch.column(0).to_pylist()], "y": batch.column(1)}

    kept = map_arrow(read_in.select("columns", "y"), keep, "columns array<int>, y int")
    return fit(columns, [(r[0], r[1]) for r in kept.collect()], len(values))  # at most rows texts, of each its telling columns


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity (expected), grade (the likeliest, from 0), toxic (whether a grade above the lowest is likelier than not)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(model.columns.tolist(), model.weights.tolist(), strict=True)))
    scorer = Model(np.zeros(0), np.zeros(0), model.thresholds)

    def run(batches):
        weight_of, known = shared.value, {}

        def word_columns(w: str) -> tuple[int, ...]:
            return tuple(c for c in columns_of(w) if c in weight_of)

        for batch in batches:
            out = {"severity": [], "grade": [], "toxic": []}
            for text in batch.column(1).to_pylist():
                held: set[int] = set()
                for w in set(LETTERS.findall(text.lower())):
                    if (found := known.get(w)) is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        found = known[w] = word_columns(w)
                    if found:
                        held.update(found)
                above = scorer.score(sum(weight_of[c] for c in sorted(held)))
                exact = np.concatenate([[1.0], above]) - np.concatenate([above, [0.0]])
                out["severity"].append(float(above.sum()))
                out["grade"].append(int(exact.argmax()))
                out["toxic"].append(bool(above[0] >= 0.5))
            yield {id_col: batch.column(0)} | out

    return map_arrow(docs.select(F.col(id_col), text_of(text_col).alias("text")), run, f"`{id_col}` {id_type}, severity double, grade int, toxic boolean")
