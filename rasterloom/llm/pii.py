"""Personal data by weak supervision, in DataFrame functions only.

Base spans of four kinds are found by fixed patterns and always stay. Beside them, wide patterns propose candidates of three more
kinds: secrets, telephone numbers without a plus sign, and e-mail addresses in words. Labelers vote on every span: a strict pattern
for its kind, a gazetteer, words before it, and the mix of its characters; each may abstain, which is a vote of its own, since a
labeler that knows only true spans tells as much by its silence. Votes are counted over all documents by pattern, of which there are a
few hundred at most; expectation maximisation on those counts estimates how often each labeler votes for, against or not at all on true
and on false spans of each kind, and a logistic classifier over votes, kind and length is trained on the posteriors. Candidates that it
accepts, and that touch no base span, are added.

Offsets are code points, end exclusive. Null texts count as empty and have no spans. Rows are treated one by one: repeated rows
and null ids are returned as they come, an empty table gives an empty result; ``redact`` carries all further columns along.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import before_each, cut_into, let, materialise, part_of, text_of

# The kinds in their order, the patterns of the base kinds in possessive form, the words of the labelers.
BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret", "tel", "contact")
KINDS = BASE_KINDS + EXTRA_KINDS
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
    "tel": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?(?:[\x20.-]\(?[0-9]{2,4}\)?){2,3}+(?![0-9.-])",
    "contact": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{2,63}+\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z]{2,24}",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9]", "tel": r"[0-9][)\x20.-]", "contact": r"[\[(]\x20?dot"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
STRICT = {
    "email": r"^[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$",
    "card": r"^[3-6][0-9]{3}(?:[\x20-]?[0-9]{4}){3}$|^3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}$",
    "phone": r"^\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,5}$",
    "secret": r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/=-]{20,})$",
    "tel": r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$|^0[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){2,3}$",
    "contact": r"(?i)dot\x20?[\])]\x20?(?:com|org|net|edu|io|de|fr|es|uk)$",
}
GAZETTEER = {
    "email": r"(?i)@(?:gmail|yahoo|hotmail|outlook|mail)[A-Za-z0-9-]*\.|\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$",
    "ip": r"^(?:10|127|172|192)\.",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65)",
    "phone": r"^\+(?:1|33|34|44|49)[^0-9]",
    "secret": r"^(?:sk|pk|ghp|gho|xox[bp]|AKIA|AIza|eyJ)[-_A-Za-z0-9]",
    "tel": r"^\(?(?:800|888|877|555|0[1-9])",
    "contact": r"(?i)gmail|yahoo|hotmail|outlook|mail",
}
CONTEXT = {
    "email": r"(?i)mail|contact|write|adres",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|credit|carte|tarjeta|karte",
    "phone": r"(?i)phone|tel|call|mobil|fax",
    "secret": r"(?i)token|secret|key|passw|auth|bearer",
    "tel": r"(?i)phone|tel|call|mobil|fax",
    "contact": r"(?i)mail|contact|write|adres",
}
#: Code points before a span in which its context is looked for.
BEFORE = 30
LABELERS = ("strict", "gazetteer", "context", "shape")
#: Steps in which the estimates must settle; if they don't, that is an error.
EM_STEPS, NEWTON_STEPS = 100_000, 1_000
VOTES = "10-"
#: What is taken for a labeler's rates of VOTES on false and on true spans beforehand, as so many spans.
PRIOR, PRIOR_SPANS = ((0.2, 0.5, 0.3), (0.6, 0.1, 0.3)), 4.0
SPAN = "array<struct<start:int,kind:int,end:int,votes:string,size:int>>"


def located(text: Column, kind: str) -> Column:
    """Matches with start, end, value and what stands before; null-free, leftmost first, never overlapping."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(matches, F.split(text, pattern, -1), lambda m, gap: F.struct(m.alias("value"), gap.alias("gap")))
    kind_of = "array<struct<start:int,end:int,value:string,before:string>>"

    def place(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(BEFORE)).alias("before"))

    def placed(found: Column) -> Column:
        return F.zip_with(found, before_each(F.transform(found, lambda x: F.length(x["gap"]) + F.length(x["value"])), lambda a, b: a + b), place)

    with_value = F.filter(parts, lambda x: x["value"].isNotNull())
    return F.when(text.rlike(NEEDS[kind]), let(with_value, placed)).otherwise(F.array().cast(kind_of))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    backwards = F.reverse(digits(value))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern is a span."""
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(value)).between(12, 19), luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def votes(kind: str, x: Column) -> Column:
    """One character a labeler: 1 for, 0 against, - abstains."""
    value = x["value"]
    n_digits = F.length(digits(value))
    mixed = {
        "email": value.rlike("[A-Za-z].*@"),
        "ip": F.length(value) >= 7,
        "card": F.length(F.array_join(F.array_distinct(F.split(digits(value), "")), "")) >= 4,
        "phone": n_digits >= 9,
        "secret": (n_digits >= 4) & (F.length(F.array_join(F.array_distinct(F.split(value, "")), "")) >= 8),
        "tel": n_digits.between(9, 12),
        "contact": ~value.rlike("[0-9]{5}"),
    }[kind]
    one = F.lit("1")
    return F.concat(
        F.when(value.rlike(STRICT[kind]), one).otherwise("0"),
        F.when(value.rlike(GAZETTEER[kind]), one).otherwise("-"),
        F.when(x["before"].rlike(CONTEXT[kind]), one).otherwise("-"),
        F.when(mixed, one).otherwise("0"),
    )


def spans(text: Column, kind: str) -> Column:
    found = located(text, kind)
    if kind in BASE_KINDS:
        found = F.filter(found, lambda x: holds(kind, x["value"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), votes(kind, x).alias("votes"), F.least(F.length(x["value"]) / 8, F.lit(5)).cast("int").alias("size")))


def candidates(text: Column) -> tuple[Column, Column]:
    """The base spans and the further candidates of a text, by start and kind; a candidate that touches a base span is left out."""
    base = F.array_sort(F.concat(*[spans(text, k) for k in BASE_KINDS])).cast(SPAN)
    return base, F.array_sort(F.concat(*[spans(text, k) for k in EXTRA_KINDS])).cast(SPAN)


def with_candidates(rows: DataFrame) -> DataFrame:
    """rows (row, text) with base and extra, their spans."""
    base, wide = candidates(F.col("text"))
    found = rows.select("row", "text", base.alias("base"), wide.alias("wide"))
    return found.select("row", "text", "base", F.when(F.size("wide") > 0, apart_from(F.col("base"), F.col("wide"))).otherwise(F.col("wide")).alias("extra"))


def apart_from(base: Column, wide: Column) -> Column:
    """The spans of wide that share no code point with one of base, both in order. Of all spans in order it is enough to know how far those before reach, and where the next one begins."""
    most = 2**31 - 1

    def told(spans_: Column, own: bool) -> Column:
        return F.transform(spans_, lambda x: F.struct(x.alias("x"), F.lit(own).alias("own")))

    def kept(all_: Column) -> Column:
        reach = before_each(F.transform(all_, lambda s: F.when(s["own"], s["x"]["end"]).otherwise(0)), F.greatest)
        next_ = F.reverse(before_each(F.reverse(F.transform(all_, lambda s: F.when(s["own"], F.lit(most) - s["x"]["start"]).otherwise(0))), F.greatest))
        ends = F.zip_with(F.zip_with(all_, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), next_, lambda s, n: F.struct(s["s"].alias("s"), s["r"].alias("r"), n.alias("n")))
        alone = F.filter(ends, lambda e: ~e["s"]["own"] & (e["r"] <= e["s"]["x"]["start"]) & (F.lit(most) - e["n"] >= e["s"]["x"]["end"]))
        return F.transform(alone, lambda e: e["s"]["x"])

    return let(F.array_sort(F.concat(told(base, True), told(wide, False))), kept)


def reliabilities(patterns: list[tuple[int, str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern (kind, votes, count), and rates by kind, truth (false, true), labeler and vote (VOTES)."""
    kinds = np.array([k for k, _, _ in patterns])
    cast = np.array([[[c == v for v in VOTES] for c in ballot] for _, ballot, _ in patterns], float)  # pattern, labeler, vote
    n = np.array([c for _, _, c in patterns], float)
    yes, no = cast[:, :, 0].sum(1), cast[:, :, 1].sum(1)
    p = np.clip((yes + 0.5) / (yes + no + 1.0), 0.05, 0.95)
    of_kind = (kinds[None, :] == np.arange(len(KINDS))[:, None]).astype(float)
    prior = np.array(PRIOR)[None, :, None, :] * PRIOR_SPANS
    for _ in range(EM_STEPS):
        weight = np.stack([n * (1 - p), n * p])  # truth, pattern
        counts = np.einsum("kp,tp,plv->ktlv", of_kind, weight, cast) + prior
        rates = counts / counts.sum(axis=3, keepdims=True)
        share = (of_kind @ (n * p) + 1.0) / (of_kind @ n + 2.0)
        logs = np.einsum("ptlv,plv->pt", np.log(rates)[kinds], cast)
        logit = np.log(share / (1 - share))[kinds] + logs[:, 1] - logs[:, 0]
        new = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1e-6, 1 - 1e-6)
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            return p, rates
    raise RuntimeError(f"the labelers' rates weren't settled in {EM_STEPS} steps")


def train(patterns: list[tuple[int, str, int, float]], ridge: float = 1.0) -> np.ndarray:
    """Coefficients of the span classifier: one for each kind, each labeler's vote for and against, and each size."""
    merged: dict[tuple[int, str], float] = {}
    for k, v, _, c in patterns:
        merged[k, v] = merged.get((k, v), 0) + c
    keys = list(merged)
    width = len(KINDS) + 2 * len(LABELERS) + 6
    if not keys:
        return np.concatenate([np.full(len(KINDS), -1.5), np.ones(len(LABELERS)), -np.ones(len(LABELERS)), np.zeros(6)])
    posterior, _ = reliabilities([(k, v, merged[k, v]) for k, v in keys])
    target = dict(zip(keys, posterior, strict=True))
    x = np.zeros((len(patterns), width))
    for i, (k, v, size, _) in enumerate(patterns):
        x[i, k] = 1
        for j, c in enumerate(v):
            if c != "-":
                x[i, len(KINDS) + j + (c == "0") * len(LABELERS)] = 1
        x[i, len(KINDS) + 2 * len(LABELERS) + size] = 1
    y = np.array([target[k, v] for k, v, _, _ in patterns])
    n = np.sqrt(np.array([c for *_, c in patterns], float))  # so that a frequent pattern doesn't drown the others
    beta = np.zeros(width)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * beta
        curve = (x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(width)
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            return beta
    raise RuntimeError(f"the classifier wasn't settled in {NEWTON_STEPS} steps")


def fit(found: DataFrame) -> np.ndarray:
    """Train the classifier on the votes of all documents' spans (base, extra), counted by pattern."""
    counted = found.filter((F.size("base") > 0) | (F.size("extra") > 0)).select(F.explode(F.concat("base", "extra")).alias("s")).groupBy("s.kind", "s.votes", "s.size").agg(F.count(F.lit(1)).alias("n"))
    return train(sorted((r[0], r[1], r[2], float(r[3])) for r in counted.collect()))


def accepted(beta: np.ndarray) -> Callable[[Column], Column]:
    """The classifier as an expression on a span."""
    kinds, yes, no, sizes = np.split(beta, np.cumsum([len(KINDS), len(LABELERS), len(LABELERS)]))

    def pick(values: np.ndarray, index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), index + 1)

    def score(x: Column) -> Column:
        total = pick(kinds, x["kind"]) + pick(sizes, x["size"])
        for j in range(len(LABELERS)):
            vote = F.substring(x["votes"], j + 1, 1)
            total = total + F.when(vote == "1", F.lit(float(yes[j]))).when(vote == "0", F.lit(float(no[j]))).otherwise(F.lit(0.0))
        return total >= 0

    return score


def written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and accepted extra ones), n_extra."""
    rows = with_candidates(docs.select(F.col(id_col).alias("row"), text_of(text_col).alias("text")))
    rows = materialise(rows.select("row", "base", "extra"), "candidates")
    extra = F.filter("extra", accepted(fit(rows)))

    def count_of(kind: str) -> Column:
        k = KINDS.index(kind)
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{kind}")

    counts = map(count_of, BASE_KINDS)
    return rows.select(F.col("row").alias(id_col), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", extra))).alias("spans"), F.size(extra).cast("long").alias("n_extra"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every span of its texts replaced by its kind in brackets, and with their lengths, if it has them, put right. Spans that overlap are replaced from the first one's start to the last one's end, by the first one's kind. The rows are written with their spans, so that the patterns run once."""
    rows = with_candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text")))
    rows = materialise(rows.select("row", "base", "extra"), "candidates")
    accept, text = accepted(fit(rows)), F.col(f"row.`{text_col}`")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def put(found: Column, pieces: Column) -> Column:
        # a span that begins within those before it is part of what they stand for
        after = before_each(F.transform(found, lambda x: x["end"]), F.greatest)
        apart = F.filter(F.zip_with(found, after, lambda x, end: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), end.alias("from"))), lambda x: x["start"] >= x["from"])
        parts = F.transform(apart, lambda x: F.concat(part_of(pieces, x["from"], x["start"]), F.element_at(names, x["kind"] + 1)))
        last = F.array_max(F.transform(found, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), part_of(pieces, last, F.length(text)))

    rows = rows.select("row", F.array_sort(F.concat("base", F.filter("extra", accept))).alias("found"))
    clean = let(F.col("found"), lambda found: let(cut_into(text), lambda pieces: put(found, pieces)))
    rows = rows.select("row", F.when(F.size("found") > 0, clean).otherwise(text).alias("clean"))
    columns = []
    for c in docs.columns:
        value = F.col(f"row.`{c}`")
        if c == text_col:
            value = F.col("clean")
        elif c == length_col:
            value = F.coalesce(F.length("clean").cast(docs.schema[c].dataType), value)
        columns.append(value.alias(c))
    return rows.select(*columns)
