"""Main text of web pages: a host's suffix arrays over its pages' token streams, and marks of the pages' structure.

A page is read into blocks, each in the article (inside article, main and the like), in doubt (there, but inside an element whose only
mark is a word that may head prose as well, as a section "discussion"), open (outside, unmarked) or out (inside an element that is
marked as a menu, header, footer, side bar, notice, advert, form or comments). Out blocks go. All others of a host are token
streams, one a page, joined in a suffix array with its common prefixes; equal streams are one page. A substring of at least
``OPEN_RUN.tokens`` tokens on at least ``OPEN_RUN.pages`` distinct pages and ``OPEN_RUN.share`` of the host's is boilerplate to blocks that
are open or in doubt, one of at least ``ARTICLE_RUN.tokens`` on ``ARTICLE_RUN.pages`` pages and ``ARTICLE_RUN.share`` of them to blocks in the
article, where quotations and passages that some pages share are text. A block of which ``COVERED`` of the tokens lie in boilerplate
goes, unique runs stay. So marks say how much repetition a block may have, and the arrays what is repeated. A host of very many pages is
several arrays of about ``ARRAY_PAGES``, dealt by a digest of the stream. What stands on a share of a host's pages stands on that share of
one array's at least, so the arrays propose runs, all count the proposed ones, and the sums decide for the whole host. On a host of one
or two distinct pages nothing is known to repeat, so only marks decide.

White space is what Python's str.split() takes for it, no-break spaces included. Null html counts as empty and has an empty text. Pages
are treated one by one but for the arrays; repeated rows are told apart, so each gets its row back; pages without a host share the
host "". An empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import map_arrow, materialise, partitions, text_of



class Run(NamedTuple):
    """What makes a substring boilerplate: its tokens, and the distinct pages of a host that hold it, as a number and as a share."""

    tokens: int
    pages: int
    share: float


OPEN_RUN, ARTICLE_RUN = Run(4, 3, 0.2), Run(8, 5, 0.6)
#: A block is covered if this share of its tokens is.
COVERED = 0.7
#: Pages in a suffix array, about.
ARRAY_PAGES = 256
#: Hosts whose numbers of arrays, and runs that are sent to all tasks; more are joined.
FEW_HOSTS, FEW_RUNS = 100_000, 500_000

# Elements by what they hold, and words in class, id and role that mark an element.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
DROPPED = frozenset("nav footer aside form head select button menu template svg canvas audio video map datalist fieldset label input search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset(["article", "main"])
MARKS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside header masthead topbar banner footer colophon ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login register search form comment comments commentlist respond replies disqus discussion reactions share sharing social "
    "related recommended recommendations widget pagination pager toolbar skip copyright disclaimer".split()
)
#: Words that stand beside a mark in a name of several words, as in comment-list; other words make it a name of its own, as in form-factor.
BESIDE = frozenset(
    "area articles author bar block body bottom box button buttons center column container content count entry footer global group header heading icons info inner inline item items left level link links list main message outer page panel "
    "post posts primary reader right row secondary section side site slot stories sticky sub text thread title top unit user widget wrap wrapper".split()
)
#: Marks that, alone in a name, may head prose inside an article as well, on such elements; and those that may on a plain division.
DOUBTFUL = frozenset("menu header banner footer notice alert login register search form comment discussion reactions social related disclaimer copyright".split())
PROSE, DIVISION = frozenset("section pre code blockquote table dl figure".split()), frozenset("alert discussion copyright search".split())
#: Marks that don't count on paragraphs, headings and inline elements, which such names merely place.
LAYOUT = frozenset("header masthead topbar banner footer colophon aside nav navigation menu search form".split())
PHRASES = frozenset("p h1 h2 h3 h4 h5 h6 a abbr b cite code del em font i ins kbd mark q s samp small span strong sub sup time u var".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CONTENT_MARKS = frozenset("article main content articlebody entry post story".split())

TAG = re.compile(r"""<(?:!--(.*?)(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|itemprop|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""", re.I)
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
ENDS_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

OUT, OPEN, IN, DOUBT = 0, 1, 2, 3


def marked(tag: str, attributes: str, in_article: bool) -> bool | None:
    """Whether an element is something other than text; None in doubt."""
    if tag in DROPPED and not (tag == "label" and in_article) or (tag == "header" and not in_article):
        return True
    if not attributes:
        return False
    doubt = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                parts = [x for x in re.split(r"[-_]+", word) if x]
                if word in CONTENT_MARKS or parts and parts[0] in CONTENT_MARKS and parts[-1] in ("body", "content", "text", "main"):
                    return False
                found = MARKS.intersection(parts)
                if found and MARKS.union(BESIDE).issuperset(parts) and not (tag in PHRASES and found <= LAYOUT):
                    if in_article and len(parts) == 1 and (tag in PROSE and found <= DOUBTFUL or tag == "div" and found <= DIVISION):
                        doubt = True
                    else:
                        return True
    return None if doubt else False


def blocks(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order, each as (OUT, OPEN, IN or DOUBT, text)."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with the state inside them
    held: Counter[str] = Counter()  # how many of each are open
    run: list[tuple[int, str]] = []  # of the block so far, with the states that pieces were read in
    state, at, n = OPEN, 0, page.rfind(">") + 1
    unclosed = page[n:]

    def close(k: int) -> None:
        nonlocal state
        held.subtract(t for t, _ in stack[k:])
        del stack[k:]
        state = stack[-1][1] if stack else OPEN

    def flush() -> None:
        for s in dict.fromkeys(s for s, _ in run):
            text = " ".join(entities.unescape("".join(x for t, x in run if t == s)).split())
            if text:
                out.append((s, text))
        run.clear()

    while at < n:
        m = TAG.search(page, at, n)
        if not m:
            run.append((state, page[at:n]))
            break
        if m.start() > at:
            run.append((state, page[at : m.start()]))
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            if tag == "br":
                run.append((state, " "))
            if tag in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1) if held[tag] else ():
                if stack[k][0] == tag:
                    if any(t in BLOCKS for t, _ in stack[k:]):
                        flush()
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        attributes = m[4] or m[7] or ""
        if tag in RAW:
            if tag == "title":
                flush()
            at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at, n).end()
            continue
        if tag in ("br", "img", "wbr", "input"):
            if tag != "wbr":
                run.append((state, " "))
            continue
        if tag in BLOCKS:
            flush()
            closed = ("p",) if tag in CLOSES_P else ENDS_BY.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in closed:
                    close(k)
                    break
                if stack[k][0] in BLOCKS:
                    break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if state != OUT or tag in ARTICLE and not any(s == OUT and t not in ("form",) for t, s in stack):
            mark = marked(tag, attributes, state in (IN, DOUBT))
            new = OUT if mark else DOUBT if mark is None or state == DOUBT and tag not in ARTICLE else IN if tag in ARTICLE or state == IN or re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", attributes) else state
        else:
            new = OUT
        if new == OUT != state and tag not in BLOCKS:
            run.append((state, " "))  # what stands before and after it are two words
        stack.append((tag, new))
        held[tag] += 1
        state = new
    run.append((state, re.split(r"<[a-zA-Z/!?]", unclosed, maxsplit=1)[0]))
    flush()
    return out


def suffix_array(tokens: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all pages' tokens in order, and how many tokens each has in common with the one before it. A suffix ends with its page. Prefixes double in length; only suffixes that still have equals are sorted again."""
    n = len(tokens)
    last = np.append(np.flatnonzero(pages[1:] != pages[:-1]), n - 1) if n else np.zeros(0, np.int64)
    left = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(n) + 1  # tokens up to the page's end
    _, rank = np.unique(tokens, return_inverse=True)
    levels, length = [rank.astype(np.int64)], 1
    while n:
        rank = levels[-1]
        times = np.bincount(rank, minlength=n)
        active = np.flatnonzero(times[rank] > 1)
        if not len(active):
            break
        # what a suffix has beyond its prefix: nothing if its page ends, which sets it apart from all others
        after = np.where(left[active] > length, rank[np.minimum(active + length, n - 1)] + n, active - n)
        order = np.lexsort((after, rank[active]))
        first, second = rank[active][order], after[order]
        own = np.concatenate([[True], first[1:] != first[:-1]])
        step = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        # ranks are places: a suffix's rank is how many have a smaller prefix
        place = np.arange(len(order))
        group, part = np.maximum.accumulate(np.where(own, place, 0)), np.maximum.accumulate(np.where(step, place, 0))
        smaller = np.concatenate([[0], np.cumsum(times)])[:-1] if length == 1 else np.arange(n)
        new = smaller[rank] if length == 1 else rank.copy()
        new[active[order]] = smaller[first] + part - group
        if length == 1:
            levels[0] = smaller[rank]
        levels.append(new)
        length *= 2
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        span = 1 << k
        same = (left[order[1:]] - common[1:] >= span) & (left[order[:-1]] - common[1:] >= span)
        same[same] &= levels[k][a[same]] == levels[k][b[same]]
        common[1:] += span * same
        a, b = np.minimum(a + span * same, n - 1), np.minimum(b + span * same, n - 1)
    return order, common


#: Odd numbers that windows' tokens are mixed with.
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(tokens: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the tokens of each window that begins at one of these places."""
    h = np.full(len(at), length, np.uint64)
    for k in range(length):
        h = (h ^ tokens[at + k].astype(np.uint64)) * MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


class Streams:
    """The token streams of an array's distinct pages with their suffixes grouped by each kind of run."""

    def __init__(self, streams: list[np.ndarray], kinds: tuple[Run, ...]):
        self.sizes = np.array([len(s) for s in streams], np.int64)
        self.total, self.kinds = int(self.sizes.sum()), kinds
        self.tokens = np.concatenate(streams) if self.total else np.zeros(0, np.int64)
        self.page = np.repeat(np.arange(len(streams)), self.sizes)
        self.distinct = int((self.sizes > 0).sum())
        self.order, self.common = suffix_array(self.tokens, self.page)

    def groups(self, kind: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes with a common prefix of a run's length: each suffix's group, and the first suffix of each group, its distinct pages, and whether its prefix is long enough."""
        first = self.common < kind.tokens
        start, group = np.flatnonzero(first), np.cumsum(first) - 1
        by_page = np.lexsort((self.page[self.order], group))
        g, p = group[by_page], self.page[self.order][by_page]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])]) if self.total else np.zeros(0, bool)
        at = self.order[start]
        whole = (at + kind.tokens <= self.total) & (self.page[np.minimum(at + kind.tokens, self.total) - 1] == self.page[at]) if self.total else np.zeros(0, bool)
        return group, at, np.bincount(g[new], minlength=len(start)), whole

    def covers(self, often: list[np.ndarray]) -> list[list[np.ndarray]]:
        """For each kind and each page, which tokens lie in a run of a group that is often. A suffix's longest such run is covered by those of the suffixes that begin within it, so groups of just a run's length tell all."""
        out = []
        for kind, flags in zip(self.kinds, often, strict=True):
            at = self.order[flags[self.groups(kind)[0]]] if self.total else np.zeros(0, np.int64)
            delta = np.zeros(self.total + kind.tokens + 1, np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + kind.tokens, -1)
            out.append(np.split(np.cumsum(delta)[: self.total] > 0, np.cumsum(self.sizes)[:-1]))
        return out


def often_here(held: Streams, least: bool = True) -> list[np.ndarray]:
    """For each kind of run, which groups are on enough of the pages held here; without least on the share of them alone."""
    out = []
    for kind in held.kinds:
        _, _, pages, whole = held.groups(kind)
        out.append(whole & (pages >= max(kind.pages if least else 1, kind.share * held.distinct)))
    return out


def repeated(streams: list[np.ndarray], kinds: tuple[Run, ...]) -> list[list[np.ndarray]]:
    """For each kind of run and each page's stream, which tokens lie in a substring of that many tokens on that many distinct pages."""
    held = Streams(streams, kinds)
    return held.covers(often_here(held))


def held_streams(group: pd.DataFrame) -> tuple[Streams, list[int]]:
    """The distinct streams of an array's pages, and each page's."""
    raw: dict[bytes, int] = {}
    which = [raw.setdefault(t, len(raw)) for t in group["tokens"]]  # equal streams are one page
    return Streams([np.frombuffer(t, "<u2").astype(np.int64) for t in raw], (OPEN_RUN, ARTICLE_RUN)), which


def gone_of(states, sizes, open_cover: np.ndarray, article_cover: np.ndarray) -> list[int]:
    """Of a page's blocks the numbers of those that boilerplate covers."""
    ends = np.cumsum(sizes)
    return [i for i, (s, n, e) in enumerate(zip(states, sizes, ends, strict=True)) if n and (article_cover if s == IN else open_cover)[e - n : e].mean() >= COVERED]


LOOK = "row_key string, gone array<int>, host string, kind int, run long, pages long"


def first_look(group: pd.DataFrame) -> pd.DataFrame:
    """Of an array's pages: those of a host that is one array are decided, of others the runs that are on the share of the pages here are proposed. Kind -1 counts the array's distinct pages."""
    columns = [c.split()[0] for c in LOOK.split(", ")]
    held, which = held_streams(group)
    if group["arrays"].iloc[0] == 1:
        covers = held.covers(often_here(held))
        rows = [(key, gone_of(st, sz, covers[0][k], covers[1][k]), None, None, None, None) for key, k, st, sz in zip(group["row_key"], which, group["states"], group["sizes"], strict=True)]
        return pd.DataFrame([r for r in rows if r[1]], columns=columns)
    host, rows = group["host"].iloc[0], []
    for k, (kind, flags) in enumerate(zip(held.kinds, often_here(held, least=False), strict=True)):
        _, at, _, _ = held.groups(kind)
        rows += [(None, None, host, k, run, None) for run in windows(held.tokens, at[flags], kind.tokens).tolist()]
    return pd.DataFrame([*rows, (None, None, host, -1, 0, held.distinct)], columns=columns)


Wanted = dict[tuple[str, int], np.ndarray]


def as_wanted(rows) -> Wanted:
    """Runs by host and kind, from (host, kind, run)."""
    found: dict[tuple[str, int], list[int]] = defaultdict(list)
    for host, kind, run in rows:
        found[host, kind].append(run)
    return {k: np.sort(np.array(v, np.int64)) for k, v in found.items()}


def runs_of(raw: bytes) -> list[np.ndarray]:
    """The hash of the run of each kind that begins at each token."""
    tokens = np.frombuffer(raw, "<u2").astype(np.int64)
    return [windows(tokens, np.arange(max(0, len(tokens) - kind.tokens + 1)), kind.tokens) for kind in (OPEN_RUN, ARTICLE_RUN)]


def held_runs(hosts, streams, tokens, wanted: Wanted) -> dict[str, list]:
    """host, kind, run, stream for each wanted run of each page."""
    out = {c: [] for c in ("host", "kind", "run", "stream")}
    for host, stream, raw in zip(hosts, streams, tokens, strict=True):
        for kind, runs in enumerate(runs_of(raw)):
            if (host, kind) in wanted:
                found = np.intersect1d(runs, wanted[host, kind]).tolist()
                for c, v in zip(out, (host, kind, None, stream), strict=True):
                    out[c] += found if c == "run" else [v] * len(found)
    return out


def gone_pages(keys, hosts, states, sizes, tokens, often: Wanted) -> dict[str, list]:
    """row_key, gone for each page of which blocks go, by the runs that are often on its host."""
    out = {"row_key": [], "gone": []}
    for key, host, st, sz, raw in zip(keys, hosts, states, sizes, tokens, strict=True):
        covers = []
        for kind, runs in enumerate(runs_of(raw)):
            at = np.flatnonzero(np.isin(runs, often[host, kind])) if (host, kind) in often else np.zeros(0, np.int64)
            delta = np.zeros(len(raw) // 2 + 1, np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + (OPEN_RUN, ARTICLE_RUN)[kind].tokens, -1)
            covers.append(np.cumsum(delta)[:-1] > 0)
        if gone := gone_of(st, sz, *covers):
            out["row_key"].append(key)
            out["gone"].append(gone)
    return out


GONE, HELD = "row_key string, gone array<int>", "host string, kind int, run long, stream long"


def with_runs(streams: DataFrame, runs: DataFrame, function, names: list[str], schema: str) -> DataFrame:
    """function over streams with the runs(host, kind, run) of their hosts, which are sent to all tasks while they are few and meet the streams of their host's arrays else."""
    if runs.count() <= FEW_RUNS:
        shared = streams.sparkSession.sparkContext.broadcast(as_wanted(runs.select("host", "kind", "run").collect()))

        def mapped(batches):
            for batch in batches:
                yield function(*(batch.column(c).to_pylist() for c in names), shared.value)

        return map_arrow(streams.select(*names), mapped, schema)

    def met(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(function(*(own[c] for c in names), as_wanted(wanted[["host", "kind", "run"]].itertuples(index=False))))

    n = partitions(streams.sparkSession)
    places = materialise(streams.select("host", "array").distinct(), "places")
    told = runs.join(places, "host").repartition(n, "host", "array").groupBy("host", "array")
    return streams.repartition(n, "host", "array").groupBy("host", "array").cogroup(told).applyInPandas(met, schema)


def whole_hosts(streams: DataFrame, looks: DataFrame, proposed: DataFrame) -> DataFrame:
    """What goes of the pages of hosts that are several arrays: all of such a host's pages count the runs that any of its arrays proposed."""
    hosts = proposed.select("host").distinct()
    streams = streams.join(hosts, "host")
    held = with_runs(streams, proposed, held_runs, ["host", "stream", "tokens"], HELD).distinct()
    counts = held.groupBy("host", "kind", "run").agg(F.count(F.lit(1)).alias("pages"))
    distinct = looks.filter("kind = -1").groupBy("host").agg(F.sum("pages").alias("distinct"))
    open_, article = (F.greatest(F.lit(float(r.pages)), F.col("distinct") * r.share) for r in (OPEN_RUN, ARTICLE_RUN))
    often = counts.join(distinct, "host").filter(F.col("pages") >= F.when(F.col("kind") == 0, open_).otherwise(article)).select("host", "kind", "run")
    often = materialise(often, "often")
    return with_runs(streams, often, gone_pages, ["row_key", "host", "states", "sizes", "tokens"], GONE)


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars; one row a row of pages."""
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"), text_of(html_col).alias("html"))

    def read(batches):
        for batch in batches:
            out = {k: [] for k in ("row_key", "states", "texts")}
            for i, (page, url, html) in enumerate(zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                found = [x for x in blocks(html) if x[0] != OUT]
                out["row_key"].append(xxhash.xxh3_128_hexdigest(f"{page}\0{url}\0{i}\0{html}".encode("utf-8", "replace")))
                out["states"].append([s for s, _ in found])
                out["texts"].append([t for _, t in found])
            yield {"id": batch.column("id"), "url": batch.column("url"), "host": batch.column("host")} | out

    parsed = materialise(map_arrow(rows, read, f"id {id_type}, url string, host string, row_key string, states array<int>, texts array<string>"), "blocks", "zstd")

    def tokens(batches):
        for batch in batches:
            out = {"sizes": [], "tokens": [], "stream": []}
            for texts in batch.column("texts").to_pylist():
                words = [t.split() for t in texts]
                out["sizes"].append([len(w) for w in words])
                # sixteen bits a token: runs are several tokens long
                raw = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) & 0xFFFF for block in words for w in block], "<u2").tobytes()
                out["tokens"].append(raw)
                out["stream"].append(xxhash.xxh3_64_intdigest(raw) - (1 << 63))
            yield {c: batch.column(c) for c in ("row_key", "host", "states")} | out

    read_in = parsed.filter(F.size("states") > 0)
    streams = map_arrow(read_in.select("row_key", "host", "states", "texts"), tokens, "row_key string, host string, states array<int>, sizes array<int>, tokens binary, stream long")
    arrays = materialise(read_in.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / ARRAY_PAGES).alias("arrays")), "arrays")
    n_hosts, most = arrays.agg(F.count(F.lit(1)), F.max("arrays")).first()
    # streams needn't move for the sizes of hosts as long as these are few
    dealt = streams.join(F.broadcast(arrays) if n_hosts <= FEW_HOSTS else arrays, "host").withColumn("array", F.pmod("stream", F.col("arrays")))
    spread = dealt.drop("stream").repartition(partitions(spark), "host", "array")  # the join deals by host alone, and so would a grouping on top of it
    looks = materialise(spread.groupBy("host", "array").applyInPandas(first_look, LOOK), "looks")
    gone = looks.filter("row_key is not null").select("row_key", "gone")
    proposed = looks.filter("kind >= 0").select("host", "kind", "run").distinct() if (most or 0) > 1 else None
    if proposed is not None and not proposed.isEmpty():
        gone = gone.unionByName(whole_hosts(dealt.drop("arrays"), looks, materialise(proposed, "proposed")))
    gone = materialise(gone.dropDuplicates(["row_key"]), "gone")

    kept = F.filter("texts", lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    joined = parsed.select("id", "url", "row_key", "texts").join(gone, "row_key", "left")
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("texts")).otherwise(kept), "\n\n")
    return joined.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
