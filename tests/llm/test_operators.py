"""Every operator against a brute-force version on small rows, with nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size int, label int, text_key string, class_id int, path string"
ALPHABET = ["the", "of", "and", "loom", "warp", "weft", "thread", "shuttle", "heddle", "reed", "selvage", "bobbin", "treadle", "beam", "cloth", "dye"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(ALPHABET) + r.choice(["", "", "s", "ing", "ed", str(r.randint(0, 99))]) for _ in range(n))


def table(spark, rows):
    """rows of (doc_id, text, source); further columns carry names that operators use inside."""
    full = [(i, t, "en", s, len(t) if t is not None else None, "x", 1, 2, "y", 3, "z") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def rows():
    base = [(i, prose(30 + 7 * i, i), f"s{i % 3}") for i in range(24)]
    base += [(100, None, "s0"), (101, "", None), (102, " \n\t ", "s1"), (103, "one two", None), (104, base[3][1], "s2"), (105, base[3][1], "s0")]
    base += [(106, base[5][1].replace("loom", "room", 1), "s1"), (107, prose(9000, 99), "s0"), (108, "x" * 50_000, "s1")]
    base += [(None, prose(40, 7), "s2"), (3, base[3][1], "s0"), (3, base[3][1], "s0")]
    return base


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# -- op1 ----------------------------------------------------------------------
def optimal(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in tried:
                tried.add(bins[k])
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_dominance_reduction_keeps_the_optimum():
    from rasterloom.llm.packing import plan, reduce_dominated

    r = random.Random(5)
    for _ in range(150):
        capacity = r.choice([10, 20, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 8))]
        fixed, left = reduce_dominated(Counter(items), capacity)
        rest = [w for w, n in left.items() for _ in range(n)]
        assert sum(t for _, t in fixed) + (optimal(rest, capacity) if rest else 0) == optimal(items, capacity)
        placed = Counter()
        for pattern, times in plan(Counter(items), capacity):
            assert sum(w * n for w, n in pattern.items()) <= capacity
            for w, n in pattern.items():
                placed[w] += n * times
        assert placed == Counter(items)


def test_packing_round_trip(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from rasterloom.llm.packing import pack

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 512)):
            part = ids[start : start + 512]
            want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = pack(docs, capacity=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= 1.1 * math.ceil(sum(r.length for r in got) / 512) + 1
    assert pack(empty).count() == 0


def test_word_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    from rasterloom.llm.packing import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), WordEncoder(path)
    texts = ["Straße, É́a İSTANBUL. <|endoftext|>x 'Tis don't", "a\x1cb\tc\r\n d\x85e", "ªº. ŉ ﬁ ſ. 12,5 $$$ word*** x!!", "", " "] + [chr(c) + "." for c in range(33, 0x250)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# -- op2 ----------------------------------------------------------------------
@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<nav>menu</nav><article><h1>T</h1><p>a &amp; b<br>c</p><p>d</article><footer>f</footer>", "T\n\na & b c\n\nd"),
        ("<article><p>x</p><aside>no</aside><form>no</form><div class='share-buttons'>no</div><section id=comments>no</section><p>y &lt;z&gt;</p></article>", "x\n\ny <z>"),
        ('<article><p title="a>b">q</p><script>if (a<b) {"</p>"}</script><style>p{}</style><!-- <p>c</p> --></article>', "q"),
        ("<div class=ad>no</div><main><ul><li>1<li>2</ul></main>", "1\n\n2"),
        ("<article><p>Read <button>Share this</button> more</p></article>", "Read more"),
        ('<article><p>a<span class="share">no</span>b <span hidden>no</span><svg><text>no</text></svg>c</p></article>', "a b c"),
        ('<article><div class="form-factor">x</div><div class="ad-hoc">y</div><section class="legal">z</section><math>m</math></article>', "x\n\ny\n\nz\n\nm"),
        ('<article><p class="advert">no</p><p class="comment">no</p><div id="ad_slot">no</div><ol class="comment-list"><li>no</ol><h2 class="header">h</h2></article>', "h"),
        (None, ""),
        ("", ""),
    ],
)
def test_main_text(spark, html, want):
    from rasterloom.llm.html_extract import extract

    got = extract(spark.createDataFrame([(1, "http://h/x", html, "k")], "page_id long, url string, html string, host string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want))]


PAGES = "page_id long, url string, html string, row_key string, gone int"


def page_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def test_repeats_on_a_host_are_boilerplate(spark):
    from rasterloom.llm.html_extract import extract

    pages = [(i, f"http://h/{i}", f"<div>welcome to our little site</div><div>{prose(20, i)}</div>") for i in range(6)] + [(9, "http://other/", "<div>welcome to our little site</div>")]
    pages += [(10, "http://h/copy", pages[0][2]), (0, "http://h/0", pages[0][2])]
    got = [(r.page_id, r.text) for r in extract(page_table(spark, pages)).collect()]
    assert Counter(got) == Counter([(i, prose(20, i)) for i in range(6)] + [(9, "welcome to our little site"), (10, prose(20, 0)), (0, prose(20, 0))])
    assert extract(page_table(spark, [])).count() == 0


def test_arrays_decide_on_blocks_of_the_article(spark):
    """A long passage on most of a host's pages goes even from within articles, one on some of them and one on another host stay."""
    from rasterloom.llm.html_extract import extract

    template, quoted = "read more of our stories every day on this site", prose(30, 77)
    page = lambda i, more: f"<article><p>{prose(25, i)}</p>{more}</article>"
    pages = [(i, f"http://h/{i}", page(i, f"<p>{template}</p>" + f"<p>{quoted}</p>" * (i % 4 == 0))) for i in range(12)] + [(20, "http://g/", page(20, f"<p>{template}</p>"))]
    got = {r.page_id: r.text for r in extract(page_table(spark, pages)).collect()}
    assert got == {i: prose(25, i) + ("\n\n" + quoted) * (i % 4 == 0) for i in range(12)} | {20: prose(25, 20) + "\n\n" + template}


def slow_extract(pages):
    """What extract() gives, by windows of every page against every other."""
    from rasterloom.llm.html_extract import ARTICLE_RUN, COVERED, IN, OPEN_RUN, OUT, blocks

    read = [(i, re.match(r"\w+://([^/]*)", u)[1], [b for b in blocks(h or "") if b[0] != OUT]) for i, u, h in pages]
    stream = lambda found: tuple(w for _, t in found for w in t.split())
    out = []
    for i, host, found in read:
        distinct = {stream(f) for _, g, f in read if g == host} - {()}
        words, kept, at = stream(found), [], 0
        for state, text in found:
            run, size = (ARTICLE_RUN if state == IN else OPEN_RUN), len(text.split())
            cover = set()
            for k in range(len(words) - run.tokens + 1):
                window = words[k : k + run.tokens]
                if sum(any(d[j : j + run.tokens] == window for j in range(len(d))) for d in distinct) >= max(run.pages, run.share * len(distinct)):
                    cover |= set(range(k, k + run.tokens))
            if len(cover & set(range(at, at + size))) < COVERED * size:
                kept.append(text)
            at += size
        out.append((i, "\n\n".join(kept)))
    return out


@pytest.mark.parametrize(
    "inside",
    [
        '<section id="discussion"><h2>Discussion</h2><p>We found that</p></section>', '<section class="search"><p>We looked for it</p></section>', '<section id="copyright"><p>On copyright law</p></section>', '<section id="menu"><p>Soup and bread</p></section>',
        '<div class="alert"><p>Mind the step</p></div>', '<pre class="comment">-- a note</pre>', "<p>Press <label>start</label> to begin</p>", '<section class="search"><section id="menu"><header><h3>More</h3></header></section></section>',
    ],
)
def test_a_word_in_a_name_alone_drops_no_prose_of_an_article(spark, inside):
    from rasterloom.llm.html_extract import extract

    html = f'<nav>menu</nav><article><p>First</p>{inside}<div class="comments"><p>a reader</p></div><div class="search-form">find</div><aside>side</aside></article><section class="menu">Home</section>'
    want = "\n\n".join(["First", *re.findall(r">([^<>]+)", inside.replace("<label>", "").replace("</label>", ""))])
    assert extract(page_table(spark, [(1, "http://h/", html)])).first().text == want


def test_a_doubtful_part_goes_if_it_repeats(spark):
    from rasterloom.llm.html_extract import extract

    pages = [(i, f"http://h/{i}", f'<article><p>{prose(25, i)}</p><div class="alert">this site will be closed on sunday</div></article>') for i in range(12)]
    pages += [(20 + i, f"http://g/{i}", f'<article><p>{prose(25, i)}</p><div class="alert">this site will be closed on sunday</div></article>') for i in range(2)]
    got = {r.page_id: r.text for r in extract(page_table(spark, pages)).collect()}
    assert got == {i: prose(25, i) for i in range(12)} | {20 + i: prose(25, i) + "\n\nthis site will be closed on sunday" for i in range(2)}


@pytest.mark.parametrize(("size", "few"), [(100, 9), (9, 500_000), (9, 0)])
def test_the_whole_host_decides_however_its_pages_are_dealt(spark, monkeypatch, size, few):
    """Passages just above and just below the shares of a host's pages, in one array and in many, with runs sent to all tasks and joined; copies of a page are one."""
    from rasterloom.llm import html_extract

    monkeypatch.setattr(html_extract, "ARRAY_PAGES", size)
    monkeypatch.setattr(html_extract, "FEW_RUNS", few)
    shared = {n: prose(12, 900 + n) for n in (2, 11, 12, 13, 35, 36, 37, 60)}
    pages = []
    for i in range(60):
        parts = [f"<{'p' if n % 2 else 'div'}>{t}</{'p' if n % 2 else 'div'}>" for n, t in shared.items() if (i * 7 + n) % 60 < n]
        cut = i % (len(parts) + 1)
        pages.append((i, "http://h/", "".join(parts[:cut]) + f"<article><p>{prose(9, i)}</p>{''.join(parts[cut:])}</article>"))
    pages += [(100 + k, "http://h/", pages[3][2]) for k in range(40)] + [(200 + i, "http://g/", f"<div>{prose(9, i)}</div>") for i in range(3)]
    got = Counter((x.page_id, x.text) for x in html_extract.extract(page_table(spark, pages)).collect())
    assert got == Counter(slow_extract(pages))


def test_extraction_against_brute_force(spark):
    from rasterloom.llm.html_extract import extract

    r = random.Random(8)
    shared = [prose(n, 700 + n) for n in (5, 7, 9, 14)]
    pages = []
    for i in range(40):
        parts = [f"<{t}>{r.choice([prose(r.randint(1, 12), 40 * i + k), r.choice(shared)])}</{t}>" for k, t in enumerate(r.choices(["p", "div", "li", "nav", "aside"], k=6))]
        cut = r.randint(0, 6)
        pages.append((i, f"http://h{i % 3}/{i}", "".join(parts[:cut]) + "<article>" * (cut < 6) + "".join(parts[cut:])))
    pages += [(99, "http://h1/", None), (98, "http://h1/", ""), (7, pages[7][1], pages[7][2])]
    got = [(x.page_id, x.text) for x in extract(page_table(spark, pages)).collect()]
    want = slow_extract(pages)
    assert Counter(got) == Counter(want)
    assert any(t != "\n\n".join(b for _, b in ()) for _, t in want)


def test_suffix_array_and_what_it_covers():
    from rasterloom.llm.html_extract import Run, repeated, suffix_array

    r = random.Random(2)
    for _ in range(60):
        streams = [[r.randint(1, r.choice([1, 2, 4, 9])) for _ in range(r.randint(0, 30))] for _ in range(r.randint(1, 7))]
        tokens, page = np.array([x for s in streams for x in s], np.int64), np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        order, common = suffix_array(tokens, page)
        assert sorted(order) == list(range(len(tokens)))
        suffixes = [s[k:] for s in streams for k in range(len(s))]
        for i in range(1, len(order)):
            a, b = suffixes[order[i - 1]], suffixes[order[i]]
            assert common[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        kinds = (Run(2, 2, 0.0), Run(3, 2, 0.5), Run(4, 3, 0.0))
        for kind, found in zip(kinds, repeated([np.array(s, np.int64) for s in streams], kinds), strict=True):
            where, distinct = defaultdict(set), sum(map(bool, streams))
            for i, s in enumerate(streams):
                for k in range(len(s) - kind.tokens + 1):
                    where[tuple(s[k : k + kind.tokens])].add(i)
            for s, cover in zip(streams, found, strict=True):
                want = np.zeros(len(s), bool)
                for k in range(len(s) - kind.tokens + 1):
                    if len(where[tuple(s[k : k + kind.tokens])]) >= max(kind.pages, kind.share * distinct):
                        want[k : k + kind.tokens] = True
                assert cover.tolist() == want.tolist()


# -- op3 ----------------------------------------------------------------------
def nearest_of(vectors, q, k=20):
    """(id, score) of the k nearest of vectors {id: vector}, exactly."""
    score = {i: float((v * vectors[q]).sum()) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])}
    return [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:k]]


def test_search_against_brute_force(spark, monkeypatch):
    from rasterloom.llm import ann

    monkeypatch.setattr(ann, "RECALL", 1.0)
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 16))
    x[50] = x[40]
    x[200:380] = x[200]  # a cell that holds nearly a third of all vectors
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (None, [1.0] * 16)]
    vectors += [(720 + k, [1.0, float(k), 3.0]) for k in range(3)]  # vectors of another length are searched among themselves
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, cell int, block int")
    got = defaultdict(list)
    for row in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    sound = {i: np.array(v, float) for i, v in vectors if i is not None and v and all(c is not None and c == c for c in v) and any(v)}
    assert sorted(got) == [*range(0, 600, 20), 720]
    missed = 0
    for q, found in got.items():
        want = nearest_of(sound, q)
        missed += len({i for i, _ in want} - {i for i, _ in found})
        assert len(found) == len(want) and all(s == pytest.approx(float((sound[i] * sound[q]).sum()), rel=1e-14) for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert missed == 0
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = {(r.query_id, r.vec_id) for r in ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0).collect()}
    assert few == {(0, 1), (0, 2)}


def test_a_query_id_of_several_vectors_asks_with_the_first_in_order(spark):
    from rasterloom.llm.ann import search

    rows = [(0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(3)
        got = [(r["rank"], r.vec_id, r.score) for r in search(df, F.col("vec_id") == 0).collect()]
        assert sorted(got) == [(1, 2, 1.0), (2, 1, 0.1)]


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall_of_the_search(spark, kind):
    """The whole search on 6,000 vectors, a third of them in one place, against brute force; among clusters most cells aren't visited."""
    from rasterloom.llm import ann

    r = np.random.default_rng(1)
    x = r.normal(size=(6000, 32))
    if kind == "clusters":
        x = 0.25 * x + 2 * r.normal(size=(60, 32))[r.integers(0, 60, 6000)]
        x[4000:] = x[4000] + 0.05 * r.normal(size=(2000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for row in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[row.query_id].add(row.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert 0.9 <= hits / 6000
    books = tuple(ann.codebook(h, 13) for h in ann.halves(x))
    held = np.bincount(ann.cells_of(x, books), minlength=len(books[0]) * len(books[1]))
    cells = ann.cells_of(x, books)
    seen = []
    for q in range(0, 2000, 200):
        s = x @ x[q]
        seen += ann.needed(x[q], cells[np.argsort(-s)[1:21]].tolist(), books, held)
    assert kind == "random" or np.quantile(seen, 0.96) < 0.4 * len(x)


def test_cells_in_parts():
    from rasterloom.llm.ann import dealt

    held = np.array([3, 0, 4, 25, 2, 9, 1, 0])
    first, many = dealt(held, 10)
    assert first.tolist()[:1] == [0] and first[2] == 0 and many.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]
    assert first[3] == 1 and first[4] == 4 and first[5] == 5 and first[6] == 5


# -- op4 ----------------------------------------------------------------------
def test_chunks_against_brute_force(spark, docs, rows, empty):
    from rasterloom.llm.chunk_dedup import GEARS, LARGEST, REACH, SMALLEST, borders, gears, rolled, substring_dedup

    gear = gears()
    points = np.frombuffer(prose(50, 1).encode("utf-32-le"), "<u4")
    h = 0
    slow = []
    for p in points:
        h = ((h << 1) + int(gear[p & (GEARS - 1)])) & ((1 << 64) - 1)
        slow.append(h & ((1 << REACH) - 1))
    assert rolled(points, gear).tolist() == slow
    ends = borders(points, gear)
    assert ends[-1] == len(points) and all(SMALLEST <= b - a <= LARGEST for a, b in zip([0, *ends], ends[:-1], strict=False))

    passage = prose(60, 1234)
    extra = [(i, prose(40, 500 + i) + " " + passage + " " + prose(40, 600 + i), "s") for i in (300, 301, 302)]
    found = substring_dedup(table(spark, rows + extra)).collect()
    ids = Counter(r.doc_id for r in found)
    assert {300, 301, 302} <= set(ids) and {104, 105, 3} <= set(ids) and not {0, 1, 2, 4, 103} & set(ids)
    kept = [r for r in found if r.doc_id == 300]
    assert all(r.n_removed == 0 for r in kept) and sum(r.n_removed for r in found if r.doc_id == 301) > 150
    assert substring_dedup(empty).count() == 0


def slow_repeats(rows, least):
    """(id, start, end, n_removed) by looking every chunk up among all chunks."""
    from rasterloom.llm.chunk_dedup import borders, gears

    gear, held, places = gears(), {}, defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            points = np.frombuffer((t or "").encode("utf-32-le"), "<u4")
            ends = borders(points, gear)
            held[i, t or ""] = list(zip([0, *ends[:-1]], ends, strict=True)) if ends else []
    order = {k: (k[0], -(1 << 63) + xxhash.xxh3_64_intdigest(k[1].encode("utf-32-le"))) for k in held}
    for key, parts in held.items():
        for a, b in parts:
            places[key[1][a:b]].append((*order[key], a))
    out = []
    for (i, t), parts in held.items():
        island = []

        def close():
            a, b = island[0][0], island[-1][1]
            if island and (b - a >= least or b - a == len(t)):
                gone, part = 0, []
                for x, y in [*island, (None, None)]:
                    again = x is not None and (*order[i, t], x) != min(places[t[x:y]])
                    if again:
                        part.append((x, y))
                    elif part:
                        n = part[-1][1] - part[0][0]
                        gone += n if n >= least or n == len(t) else 0
                        part = []
                out.append((i, a, b, gone))

        for a, b in parts:
            if len(places[t[a:b]]) > 1:
                island.append((a, b))
            elif island:
                close()
                island = []
        if island:
            close()
    return out


@pytest.mark.parametrize("least", [96, 0, 30])
def test_spans_against_brute_force(spark, rows, least):
    from rasterloom.llm.chunk_dedup import substring_dedup

    r = random.Random(44)
    passages = [prose(r.randint(8, 60), 4000 + k) for k in range(6)]
    more = [(500 + i, " ".join(r.choice([prose(r.randint(3, 30), 4100 + 9 * i + k), r.choice(passages)]) for k in range(5)), "s") for i in range(40)]
    short = [(600, "a short text", "s"), (601, "a short text", "s"), (602, "", "s"), (603, None, "s"), (604, passages[0] * 3, "s")]
    every = rows + more + short
    got = [tuple(x) for x in substring_dedup(table(spark, every), min_run=least).collect()]
    want = slow_repeats(every, least)
    assert sorted(got) == sorted(want) and (601, 0, 12, 12) in got and (600, 0, 12, 0) in got and any(0 < n < b - a for _, a, b, n in want)


def test_repeats_are_cut_out(spark, rows):
    from rasterloom.llm.chunk_dedup import without_repeats

    passage = prose(120, 77)
    pair = [(1, passage, "s"), (2, "before " + passage, "s"), (3, None, "s"), (4, "", "s"), (None, passage, "s")]
    out = without_repeats(table(spark, pair).selectExpr("*", "'a' spans", "'b' row", "'c' key", "'d' removed"))
    assert out.columns[-4:] == ["spans", "row", "key", "removed"] and {r.spans for r in out.collect()} == {"a"}
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[1] == passage and len(got[2]) < 0.6 * len(passage) and got[3] is None and got[4] == "" and got[None] == passage


def test_very_many_repeats_are_cut_out_of_one_text(spark):
    from rasterloom.llm.chunk_dedup import repeats, without_repeats

    passage, r = prose(40, 3), random.Random(5)
    text = "".join(f"{''.join(r.choices('abcdefghij ', k=90))} {passage}" for _ in range(3000))
    df = table(spark, [(1, passage, "s"), (2, text, "s")])
    spans = sorted(tuple(x) for q in repeats(df, min_run=0).collect() if q.id == 2 for x in q.removed)
    want, at = "", 0
    for a, b in spans:
        want, at = want + text[at:a], b
    assert len(spans) > 2000 and {q.doc_id: q.text for q in without_repeats(df, min_run=0).collect()}[2] == want + text[at:]


# -- op5 ----------------------------------------------------------------------
def test_targets():
    from rasterloom.llm.mixing import targets

    assert targets({"a": 100, "b": 100, None: 100}) == pytest.approx({"a": 200.0, "b": 250 / 3, None: 500 / 3})
    assert targets({}) == {}
    sizes = {f"s{i}": 10 * (i + 1) for i in range(7)}
    got = targets(sizes)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)


def test_mix_meets_targets(spark, docs, rows, empty):
    from rasterloom.llm.mixing import mix, mixed_documents, targets

    got = mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    goal = targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, want in goal.items():  # one document of nine parts in ten of its source is taken whole or not
        longest = max(size(t) for _, t, x in rows if x == s)
        assert abs(taken[s] - want) <= max(0.02 * want, longest / 2), (s, taken[s], want)
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, got))
    assert mix(empty).count() == 0
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    unique = [i for i, n in Counter(i for i, _, _ in rows).items() if n == 1]
    copies = {r.doc_id: r.copies for r in got}
    times = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert all(times[i] == copies[i] for i in unique)


def test_dual_finds_the_nearest_rates(spark):
    """The rates are those of the convex problem: no small change at equal words is nearer to 1 in relative entropy."""
    from rasterloom.llm.mixing import mix

    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (n, s) in enumerate([(10, "a"), (30, "a"), (50, "a"), (20, "b"), (900, "b"), (400, "c")])], "doc_id long, text string, source string")
    rows = [r for r in mix(docs).collect() if r.source == "b"]
    x, r = np.array([v.size for v in rows], float), np.array([v.rate for v in rows])
    assert (x * r).sum() == pytest.approx(rows[0].target, rel=1e-5)
    cost = lambda q: (q * np.log(q) - q).sum()
    for e in (1e-3, -1e-3):
        moved = r + np.array([e, -e * x[0] / x[1]])
        if (moved <= 2).all() and (moved > 0).all():
            assert cost(moved) >= cost(r) - 1e-9


# -- op6 ----------------------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            v, digits = m.group(), re.sub("[^0-9]", "", m.group())
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in v.split("."))
            elif kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                ok = 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_personal_data(spark, docs, rows, empty):
    from rasterloom.llm.pii import find_pii, redact

    r = random.Random(8)
    parts = ["1", "2", "3 ", "-", " ", ".", "+", "@", "a", "b.", "com", "(", ")", "4111 1111 1111 1111", "1.2.3.4", "é", "😀", "\n", "255", "256", "_", "%", "x@y.z"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(600)]
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and joe [at] corp [dot] com, call 555-123-4567'
    texts += [None, "", secret, "9" * 20_000, "a" * 50_000, "+1" + "(" * 5_000, "a@b.c_d@e.f"]
    fuzz = table(spark, [(1000 + i, t, "s") for i, t in enumerate(texts)])
    got = {x.doc_id: x for x in find_pii(fuzz).collect()}
    for i, t in enumerate(texts, 1000):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
        assert got[i].n_email == want.count("email:") and got[i].n_card == want.count("card:")
    assert "secret:9:49" in got[1000 + texts.index(secret)].spans
    assert find_pii(empty).count() == 0
    clean = {x.doc_id: x for x in find_pii(docs).collect()}
    assert clean[0].spans == "" and clean[None].spans == ""
    shown = redact(table(spark, [(1, "mail a@b.co now", "s"), (2, None, "s"), (3, "nothing", "s")]))
    assert shown.columns == docs.columns
    assert {(x.doc_id, x.text, x.n_chars) for x in shown.collect()} == {(1, "mail [EMAIL] now", 16), (2, None, None), (3, "nothing", 7)}


def test_no_python_in_the_plan(docs):
    from rasterloom.llm.pii import accepted, train, with_candidates, written

    df = with_candidates(docs.select(F.col("doc_id").alias("row"), "text")).select(written(F.filter("extra", accepted(train([])))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def drawn(rates, kind, n, seed, share=0.4):
    """Votes of n spans under rates by truth, labeler and vote, counted by pattern."""
    r, votes = random.Random(seed), Counter()
    for _ in range(n):
        truth = r.random() < share
        votes["".join(r.choices("10-", x)[0] for x in rates[truth])] += 1
    return [(kind, v, n) for v, n in votes.items()]


def test_reliabilities_recover_known_labelers():
    from rasterloom.llm.pii import KINDS, reliabilities

    full = [[(b, 1 - b, 0) for b in (0.05, 0.1, 0.3, 0.2)], [(a, 1 - a, 0) for a in (0.95, 0.8, 0.7, 0.9)]]
    silent = [[(0.1, 0.9, 0), (0.02, 0, 0.98), (0.05, 0, 0.95), (0.4, 0.6, 0)], [(0.9, 0.1, 0), (0.6, 0, 0.4), (0.7, 0, 0.3), (0.9, 0.1, 0)]]
    last = len(KINDS) - 1
    _, rates = reliabilities(drawn(full, last, 20_000, 4) + drawn(silent, last - 1, 20_000, 5))
    assert np.allclose(rates[last], full, atol=0.05)
    assert np.allclose(rates[last - 1], silent, atol=0.05)  # labelers that only vote for or abstain


def test_silence_and_votes_of_every_labeler_count():
    from rasterloom.llm.pii import KINDS, reliabilities

    silent = [[(0.1, 0.9, 0), (0.02, 0, 0.98), (0.05, 0, 0.95), (0.4, 0.6, 0)], [(0.9, 0.1, 0), (0.6, 0, 0.4), (0.7, 0, 0.3), (0.9, 0.1, 0)]]
    patterns = drawn(silent, KINDS.index("secret"), 20_000, 9)
    p = {v: x for (_, v, _), x in zip(patterns, reliabilities(patterns)[0], strict=True)}
    assert p["1111"] > p["11-1"] > p["1--1"] and p["1-11"] > p["1--1"] and p["1--1"] > p["0--1"]


def test_redaction_keeps_columns_of_any_name(spark):
    from rasterloom.llm.pii import redact

    df = spark.createDataFrame([(1, "mail a@b.co now", "b", "e", "r", "f", "c", "w", None), (2, None, "b", "e", "r", "f", "c", "w", 3)], "doc_id long, text string, base string, extra string, row string, found string, clean string, wide string, n_chars int")
    got = redact(df)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", "b", "e", "r", "f", "c", "w", 16), (2, None, "b", "e", "r", "f", "c", "w", 3)]


def test_arrays_and_texts_in_parts(spark):
    from rasterloom.llm.common import before_each, cut_into, let, part_of

    r = random.Random(12)
    lists = [[r.randint(0, 50) for _ in range(n)] for n in (0, 1, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(v,) for v in lists], "v array<int>")
    got = df.select("v", before_each(F.col("v"), lambda a, b: a + b).alias("s"), before_each(F.col("v"), F.greatest).alias("m")).collect()
    for row in got:
        assert row.s == [sum(row.v[:i]) for i in range(len(row.v))]
        assert row.m == [max([0, *row.v[:i]]) for i in range(len(row.v))]
    texts = ["", "a", "é\n😀" * 300, "x" * 256, "y" * 513]
    df = spark.createDataFrame([(t, a, b) for t in texts for a in (0, 1, 200, 256, 512) for b in (a, a + 1, 256, 700, 900) if a <= b <= len(t)], "t string, a int, b int")
    for row in df.select("t", "a", "b", let(cut_into(F.col("t")), lambda p: part_of(p, F.col("a"), F.col("b"))).alias("part")).collect():
        assert row.part == row.t[row.a : row.b]


def test_a_text_of_very_many_spans(spark):
    """Twenty thousand addresses in one text, found and replaced in time about linear in them."""
    import time

    from rasterloom.llm.pii import find_pii, redact

    took = []
    for n in (5_000, 20_000):
        words = [f"m{i}@b{i % 7}.co" if i % 2 else f"é 10.0.{i % 200}.1 +44 20 7946 {i % 900:04d}" for i in range(n)]
        df = table(spark, [(1, "\n".join(words), "s"), (2, "none", "s")])
        began = time.time()
        got = {x.doc_id: x for x in redact(df).collect()}
        took.append(time.time() - began)
        assert got[1].text == "\n".join("[EMAIL]" if i % 2 else "é [IP] [PHONE]" for i in range(n)) and got[2].text == "none"
        found = {x.doc_id: x for x in find_pii(df).collect()}
        assert (found[1].n_email, found[1].n_ip, found[1].n_phone) == (n // 2, n // 2, n // 2)
    assert took[1] < 8 * took[0] + 5


def test_candidates_that_touch_base_spans_are_left_out(spark):
    from rasterloom.llm.pii import SPAN, apart_from

    r = random.Random(3)
    rows = [(sorted((a := r.randint(0, 60), r.randint(0, 3), a + r.randint(1, 9), "1", 1) for _ in range(n)), sorted((a := r.randint(0, 60), 4 + r.randint(0, 2), a + r.randint(1, 9), "1", 1) for _ in range(m))) for n in (0, 1, 5) for m in (1, 4, 9) for _ in range(8)]
    for row in spark.createDataFrame(rows, f"base {SPAN}, wide {SPAN}").select("base", "wide", apart_from(F.col("base"), F.col("wide")).alias("got")).collect():
        assert row.got == [x for x in row.wide if not any(y.start < x.end and x.start < y.end for y in row.base)]


def test_overlapping_spans_are_replaced_as_one(spark):
    from rasterloom.llm.pii import redact

    text = "a 4111 1111 1111 1111@b.co z +44 20 7946 0000@c.de"
    found = redact(table(spark, [(1, text, "s")])).first().text
    assert found == "a [CARD] z [PHONE]" or found.startswith("a [CARD]")


# -- op7 ----------------------------------------------------------------------
def test_quality(spark, docs, rows, empty):
    from rasterloom.llm.quality import RULES, Text, filter_quality, quality, repeated_windows, rule_order

    junk = [(200, "word!! " * 30, "s"), (201, "a a a a a b b b b b c c c c c d d d d d", "s"), (202, "x### y### z### " * 1 + prose(9, 3).replace(" ", "### "), "s"), (203, prose(40, 8).upper(), "s"), (204, "\n".join([prose(12, 9)] * 5), "s")]
    df = table(spark, rows + junk)
    got = defaultdict(list)
    for r in quality(df).collect():
        got[r.doc_id].append(r)
    for i, t, _ in rows + junk:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        cover = {p for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i][0]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(words) < 10 or 100 * len(cover) > 20 * len(words))
        assert not (r.base_failed and r.kept)
        assert r.kept == (not any(rule.rejects(Text(t)) for rule in RULES))
    assert all(got[i][0].kept for i in range(24)) and not any(got[i][0].kept for i in range(200, 205))
    kept = filter_quality(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, v in got.items() for r in v if r.kept)
    assert quality(empty).count() == 0 and filter_quality(empty).count() == 0
    assert sorted(n for n, _, _ in rule_order(df)) == sorted(r.name for r in RULES)
    long = [b"w%d" % (k % 70_000) for k in range(140_000)]
    assert len(repeated_windows(long)) == 140_000 - 8  # the four windows across the seam are there once


# -- op8 ----------------------------------------------------------------------
def test_toxicity_held_out(spark, empty):
    from rasterloom.llm import toxicity

    r = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        toxic = r.random() < 0.3
        words = prose(60, i).split()
        for _ in range(r.randint(2, 6) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["wretch", "villain", "scoundrel" + r.choice(["s", "ly", "dom"])]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "wretch villain wretch", "s")]
    df = table(spark, rows)
    marks = spark.createDataFrame([x for x in labels if x[0] % 2] + [(5000, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {x.doc_id: x for x in toxicity.severity(df, model).collect()}
    even = [(i, t) for i, t in labels if i % 2 == 0]
    assert np.mean([got[i].toxic == bool(t) for i, t in even]) > 0.97
    assert len(model.thresholds) == 1 and np.mean([got[i].severity for i, t in even if t]) > 0.8 and np.mean([got[i].severity for i, t in even if not t]) < 0.2
    assert not got[1000].toxic and not got[1001].toxic and got[None].toxic
    assert toxicity.severity(empty, model).count() == 0
    none = toxicity.train(df, marks.filter("toxic = 0"))
    assert all(x.severity < 1e-6 for x in toxicity.severity(df, none).collect())


def test_given_grades_keep_their_order(spark):
    """Grades 0 to 3 as labels: held-out severities come near the grades, which three thresholds share one weight vector for."""
    from rasterloom.llm import toxicity

    r = random.Random(16)
    insults = {1: ["rascal", "scamp"], 2: ["wretch", "knave"], 3: ["villain", "fiend"]}
    rows, labels = [], []
    for i in range(1200):
        grade = r.choices([0, 1, 2, 3], [6, 2, 2, 2])[0]
        words = prose(40, i).split()
        for _ in range(2 if grade else 0):
            words.insert(r.randrange(len(words)), r.choice(insults[grade]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, grade))
    df = table(spark, rows)
    marks = spark.createDataFrame([x for x in labels if x[0] % 2] + [(1, labels[1][1])] * 3, "doc_id long, toxic int")  # repeated ids
    model = toxicity.train(df, marks)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {x.doc_id: x for x in toxicity.severity(df, model).collect()}
    means = [np.mean([got[i].severity for i, g in labels if i % 2 == 0 and g == k]) for k in range(4)]
    assert all(abs(m - k) < 0.4 for k, m in enumerate(means)), means
    assert np.mean([got[i].grade == g for i, g in labels if i % 2 == 0]) > 0.9
    with pytest.raises(ValueError, match="values"):
        toxicity.train(df, spark.createDataFrame([(i, i) for i in range(40)], "doc_id long, toxic int"))


def test_thresholds_of_known_grades_are_found():
    from rasterloom.llm.toxicity import fit

    r = np.random.default_rng(5)
    weight, theta = np.array([1.5, 3.0, -1.0]), np.array([0.0, 1.5, 3.0])
    rows = []
    for _ in range(8000):
        held = r.random(3) < 0.5
        grade = int((weight[held].sum() + r.logistic() > theta).sum())
        rows.append((np.flatnonzero(held).tolist(), grade))
    model = fit([0, 1, 2], rows, 4, rounds=3000)
    assert np.allclose(model.weights, weight, atol=0.2) and np.allclose(model.thresholds, theta, atol=0.2)


def test_words_that_grades_share_tell_them_apart(spark):
    """A word of most of grade 2 and of some of the others, one of grades 1 and 2, and one of clean texts: each speaks for its side."""
    from rasterloom.llm import toxicity

    r, rows, labels = random.Random(26), [], []
    shares = {"blood": (0.15, 0.05, 0.9), "damn": (0.02, 0.85, 0.8), "please": (0.8, 0.05, 0.05)}
    for i in range(1500):
        grade = r.choices([0, 1, 2], [5, 2, 2])[0]
        words = prose(40, i).split() + [w for w, by in shares.items() if r.random() < by[grade]]
        r.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, grade))
    df = table(spark, rows)
    model = toxicity.train(df, spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, toxic int"))
    weight = dict(zip(model.columns.tolist(), model.weights.tolist(), strict=True))
    whole = {w: weight[toxicity.columns_of(w)[0]] for w in shares}
    assert whole["blood"] > 0.5 and whole["damn"] > 0.5 and whole["please"] < -0.5
    got = {x.doc_id: x for x in toxicity.severity(df, model).collect()}
    held = [(i, g) for i, g in labels if i % 2 == 0]
    assert np.mean([got[i].grade == 1 for i, g in held if g == 1]) > 0.6
    means = [np.mean([got[i].severity for i, g in held if g == k]) for k in range(3)]
    assert means[0] + 0.4 < means[1] < means[2] - 0.3


def test_severity_against_brute_force(spark, rows):
    """The columns by counting, the weights by the slope of the likelihood told anew, and every score."""
    from rasterloom.llm import toxicity

    r = random.Random(2)
    more = [(2000 + i, " ".join(r.choices(["knave", "rogue", "kind", "fair", "loom", "warp", "weft", "beam"], [1 + 9 * (i % 3 == 2), 1 + 9 * (i % 3 > 0), 9 - 8 * (i % 3 > 0), 5, 9, 9, 9, 9], k=12)), "s") for i in range(240)]
    df = table(spark, rows + more)
    model = toxicity.train(df, spark.createDataFrame([(2000 + i, [0, 5, 9][i % 3]) for i in range(240)], "doc_id long, toxic int"))

    def columns(text):
        words = {w for w in re.findall(r"[^\W\d_]+", (text or "").lower())}
        return {xxhash.xxh3_64_intdigest(f"{n}:{w[:n] if n else w}") % toxicity.FEATURES for w in words for n in (0, 4, 5) if len(w) >= n}

    held = [(columns(t), i % 3) for i, (_, t, _) in enumerate(more)]
    want = set()
    for c in set().union(*(x for x, _ in held)):
        for k in (1, 2):
            up, low = [c in x for x, g in held if g >= k], [c in x for x, g in held if g < k]
            share, ratio = (sum(up) + sum(low)) / len(held), 0.0
            for side in (up, low):
                for n, p in ((sum(side), share), (len(side) - sum(side), 1 - share)):
                    ratio += 2 * n * math.log(n / (len(side) * p)) if n else 0
            most = up if sum(up) / len(up) > sum(low) / len(low) else low
            if share < 1 and sum(most) >= 4 and ratio >= toxicity.LEAST_RATIO:
                want.add(c)
    assert want and model.columns.tolist() == sorted(want)
    weight = dict(zip(model.columns.tolist(), model.weights.tolist(), strict=True))
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def loss(w, theta):
        gaps = [math.log(b - a) for a, b in zip(theta, theta[1:], strict=False)]
        out = 5e-5 * (sum(v * v for v in w.values()) + sum(g * g for g in gaps))
        for x, g in held:
            s = sum(w[c] for c in x if c in w)
            above = [1.0, *(sigmoid(s - t) for t in theta), 0.0]
            out -= math.log(above[g] - above[g + 1]) / len(held)
        return out

    theta, h = model.thresholds.tolist(), 1e-4
    for c in weight:
        assert abs(loss(weight | {c: weight[c] + h}, theta) - loss(weight | {c: weight[c] - h}, theta)) / (2 * h) < 1e-5
    for k in range(2):
        up, down = ([t + d * (j == k) for j, t in enumerate(theta)] for d in (h, -h))
        assert abs(loss(weight, up) - loss(weight, down)) / (2 * h) < 1e-5
    want_rows = Counter()
    for i, t, _ in rows + more:
        s = sum(weight.get(c, 0.0) for c in columns(t))
        above = [1.0, *(sigmoid(s - t_) for t_ in theta), 0.0]
        want_rows[i, round(sum(above[1:-1]), 9), max(range(3), key=lambda g: above[g] - above[g + 1]), above[1] >= 0.5] += 1
    assert Counter((x.doc_id, round(x.severity, 9), x.grade, x.toxic) for x in toxicity.severity(df, model).collect()) == want_rows


# -- op9 ----------------------------------------------------------------------
def shingle_set(t):
    w = (t or "").split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_against_brute_force(spark, docs, rows, empty):
    from rasterloom.llm.minhash import frequencies, near_duplicates, similarity, weighted, without_near_duplicates

    r = random.Random(12)
    extra = []
    for g in range(12):
        words = prose(150, 900 + g).split()
        for k in range(4):
            w = list(words)
            for _ in range(k):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            extra.append((1000 + 10 * g + k, " ".join(w), "s"))
    df = table(spark, rows + extra)
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert None not in got
    texts = {i: t or "" for i, t, _ in rows + extra if i is not None}
    idf = frequencies(df, "text")
    vectors = {i: weighted(t, idf) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (texts[a] == texts[b] or similarity(vectors[a], vectors[b]) >= 0.8):
                parent[top(b)] = top(a) if top(a) < top(b) else top(b)
                parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {i: top(i) for i in ids}
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns
    assert Counter(x.doc_id for x in kept.collect() if x.doc_id is not None).keys() == set(got.values())
    assert near_duplicates(empty).count() == 0


def similar_pairs(vectors, least):
    """Pairs of at least such a weighted similarity, by the shingles that they share."""
    from rasterloom.llm.minhash import similarity

    holders = defaultdict(list)
    for i, (h, _) in vectors.items():
        for x in h.tolist():
            holders[x].append(i)
    met = {(a, b) for who in holders.values() for k, a in enumerate(who) for b in who[k + 1 :]}
    return {(a, b): s for a, b in met if (s := similarity(vectors[a], vectors[b])) >= least}


@pytest.mark.parametrize("span", [0.15, 1.0])
def test_recall_by_similarity(spark, span):
    """A table with a large group of near copies: of pairs at the threshold and above all but a few are of one class, whatever the weights' span; below it none meet but through others."""
    from rasterloom.llm.minhash import frequencies, near_duplicates, weighted

    r, extra = random.Random(31), []
    base = prose(200, 5001).split()
    for k in range(150):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        extra.append((90_000 + k, " ".join(w)))
    for k in range(120):
        w = prose(120, 6000 + k // 2).split()
        for _ in range(r.randint(0, 12) if k % 2 else 0):
            w[r.randrange(len(w))] = f"own{r.randrange(10**6)}"
        extra.append((95_000 + k, " ".join(w)))
    sf = "/root/testdata/sf0.01/documents.parquet"
    rows = [(x.doc_id, x.text or "") for x in spark.read.parquet(sf).select("doc_id", "text").collect()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idf = frequencies(df, "text", span)
    pairs = similar_pairs({i: weighted(t, idf) for i, t in rows}, 0.5)
    label = {x.doc_id: x.class_id for x in near_duplicates(df, idf_span=span).collect()}
    found = defaultdict(list)
    for (a, b), s in pairs.items():
        found["0.9" if s >= 0.9 else "0.8" if s >= 0.8 else "0.5"].append(label[a] == label[b])
    assert len(found["0.9"]) > 100 and len(found["0.8"]) > 100
    assert np.mean(found["0.9"]) > 0.99 and np.mean(found["0.8"]) > 0.9
    # each class holds together by pairs at the threshold
    near = defaultdict(set)
    for (a, b), s in pairs.items():
        if s >= 0.8:
            near[a].add(b)
            near[b].add(a)
    texts = dict(rows)
    for i, c in label.items():
        assert i == c or near[i] or texts[i] == texts[c]


def crowd(n):
    """n texts that share a long passage but are below the threshold, and a pair above it that shares nothing else."""
    r = random.Random(11)
    own = lambda i, k: " ".join(f"w{i}x{r.randrange(10**9)}" for _ in range(k))
    passage = prose(120, 1)
    return [(i, passage + " " + own(i, 44), "s0") for i in range(2, n)] + [(0, passage + " " + own(0, 11), "s0"), (1, passage + " " + own(1, 11), "s0")]


def test_a_single_pair_in_a_large_bucket(spark):
    from rasterloom.llm.minhash import near_duplicates

    got = {r.doc_id: r.class_id for r in near_duplicates(table(spark, crowd(1200))).collect()}
    assert got == {i: i for i in range(1200)} | {1: 0}


def test_split_buckets_keep_the_pair(spark):
    from rasterloom.llm import minhash

    texts = table(spark, crowd(400)).select(F.col("doc_id").alias("id"), "text")
    idf = spark.sparkContext.broadcast(minhash.frequencies(texts, "text"))
    rows = texts.select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.length("text").cast("long").alias("size"), F.col("id").alias("label"))
    parts = minhash.bucketed(minhash.split(rows, texts, idf))
    assert parts.groupBy("key").count().agg(F.max("count")).first()[0] < 200
    assert {(min(r), max(r)) for r in minhash.compared(minhash.met(parts), texts, idf, 0.8).collect()} == {(0, 1)}


def linked(texts, idf):
    """The class of each text by comparing all with all."""
    from rasterloom.llm.minhash import similarity, weighted

    vectors = {i: weighted(t, idf) for i, t in texts.items()}
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and root(a) != root(b) and similarity(vectors[a], vectors[b]) >= 0.8:
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in texts}


@pytest.mark.parametrize("split_at", [1, 99])
def test_rounds_of_large_buckets_lose_no_link(spark, monkeypatch, split_at):
    """Buckets of many blocks, compared a block a round, give the classes that all pairs give."""
    from rasterloom.llm import minhash

    r = random.Random(31)
    base = prose(90, 4).split()
    texts = {}
    for i in range(160):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    docs = table(spark, [(i, t, "s") for i, t in texts.items()]).select(F.col("doc_id").alias("id"), "text")
    idf = spark.sparkContext.broadcast(minhash.frequencies(docs, "text"))
    monkeypatch.setattr(minhash, "BLOCK", 12)
    rows = docs.select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.length("text").cast("long").alias("size"))
    labels = {x.node: x.label for x in minhash.classes(rows, docs, idf, 0.8, width=2, split_at=split_at).collect()}
    want = linked(texts, idf.value)
    assert len(set(want.values())) > 3
    assert {i: labels.get(i, i) for i in texts} == want


def test_a_large_bucket_is_compared_like_a_small_one(spark, monkeypatch):
    """No further bands, which may lose links, for a bucket of many blocks."""
    from rasterloom.llm import minhash

    def lossy(*_):
        raise AssertionError("a bucket was split")

    texts = {i: prose(60, 100 + i // 2) + f" edit{i}" for i in range(60)}
    docs = table(spark, [(i, t, "s") for i, t in texts.items()]).select(F.col("doc_id").alias("id"), "text")
    idf = spark.sparkContext.broadcast(minhash.frequencies(docs, "text"))
    monkeypatch.setattr(minhash, "BLOCK", 12)
    monkeypatch.setattr(minhash, "split", lossy)
    rows = docs.select(F.lit(5).cast("long").alias("key"), F.col("id").alias("node"), F.length("text").cast("long").alias("size"))
    labels = {x.node: x.label for x in minhash.classes(rows, docs, idf, 0.8, width=2).collect()}
    assert {i: labels.get(i, i) for i in texts} == linked(texts, idf.value)


def test_a_large_group_of_near_copies(spark):
    """Of the links in a crowd of thousands, one group of near copies among them, at least nine in ten pairs of a class stay in one."""
    from rasterloom.llm import minhash

    r = random.Random(17)
    base = prose(80, 9).split()
    texts = {i: prose(40, 5000 + i) for i in range(2000)}
    for i in range(2000, 3000):
        w = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    docs = table(spark, [(i, t, "s") for i, t in texts.items()])
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(docs).collect()}
    group = {i: t for i, t in texts.items() if i >= 2000}
    once = {t: i for i, t in sorted(group.items(), reverse=True)}
    want = linked({i: t for t, i in once.items()}, minhash.frequencies(docs, "text"))
    want = {i: want[once[t]] for i, t in group.items()}
    assert all(got[i] == i for i in range(2000))
    together = sum(got[i] == got[want[i]] for i in group)
    assert together >= 0.9 * len(group) and all(want[got[i]] == want[i] for i in group)


def test_blocks_compare_as_similarity_does():
    from rasterloom.llm.minhash import BINS, links_of, similarity, weighted

    r, idf = random.Random(3), (1 + np.random.default_rng(1).random(BINS) / 7).astype(np.float32)
    base = [prose(40, k) + " " + "reed " * (3 * k) for k in range(8)]
    texts = base + [" ".join(w if r.random() > 0.02 * k else "moth" for w in base[k % 8].split()) for k in range(16)] + ["", "reed"]
    vectors, n = [weighted(t, idf) for t in texts], len(texts)
    for first in (np.ones(n, bool), np.arange(n) % 3 == 0):
        near = {(a, b) for a in range(n) for b in range(a + 1, n) if (first.all() or first[a] != first[b]) and similarity(vectors[a], vectors[b]) >= 0.8}
        top = list(range(n))
        for _ in range(n):
            for a, b in near:
                top[a] = top[b] = min(top[a], top[b])
        got = links_of(list(range(n)), list(range(n)), texts, first, idf, 0.8)
        assert {(min(x), max(x)) for x in got} <= near and len(got) == n - len(set(top)) > 0


def test_sampling_estimates_weighted_jaccard():
    from rasterloom.llm.minhash import Sampler, similarity

    r = np.random.default_rng(2)
    sampler = Sampler(4096)
    keys = np.unique(r.integers(1, 2**63, 300, dtype=np.uint64))
    a = (keys[:200], r.uniform(0.5, 3, 200))
    b = (keys[80:], np.concatenate([a[1][80:] * r.uniform(0.7, 1.3, 120), r.uniform(0.5, 3, len(keys) - 200)]))
    same = (sampler(*a) == sampler(*b)).mean()
    assert abs(same - similarity(a, b)) < 0.03


# -- op10 ---------------------------------------------------------------------
def test_licences(spark, empty):
    from rasterloom.llm.licenses import scan

    q = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "nothing here"), (3, "a/b/c/y", "text\nLicensed under CC BY-NC 4.0.\nmore text of a long kind here"), (4, "z", "nothing of the licensed kind is in this text at all"), (5, None, None), (6, "a/b/c/COPYING", "SPDX-License-Identifier: GPL-3.0"), (7, "a/b/c/d/e", ""), (7, "a/b/c/d/e", "")]
    df = spark.createDataFrame([(i, p, t, "x", 1.0) for i, p, t in q], "doc_id long, path string, text string, license string, score double")
    got = {(r.doc_id, r.license, r.origin, r.from_dir) for r in scan(df, F.col("path")).collect()}
    assert got == {(1, "MIT", "file", None), (2, "MIT", "inherited", "a"), (3, "CC-BY-NC-4.0", "header", None), (4, None, None, None), (5, None, None, None), (6, "GPL-3.0", "file", None), (7, "GPL-3.0", "inherited", "a/b/c")}
    assert scan(df, F.col("path")).count() == len(q) and scan(df.limit(0), F.col("path")).count() == 0


def test_notices_among_other_words_and_whole_licences(spark):
    from rasterloom.llm import licenses as m

    matcher = m.Matcher(100_000, {t: 50 for t in m.VOCABULARY})
    best = lambda text: max([matcher.best(x) for x in m.segments(text)], default=(0.0, ""))
    for text, want in [
        ("Copyright (c) 2021 Acme Corp. Licensed under the MIT License.", "MIT"),
        ("Copyright 2021 Acme Corp. All rights reserved. Released under the MIT License.", "MIT"),
        ("Copyright (c) 2020 Someone\n\n" + m.MIT + "\n\n" + m.WARRANTY, "MIT"),
        ("// Licensed under the Apache License, Version 2.0 (the License)", "Apache-2.0"),
        (m.BSD + " " + m.BSD_WARRANTY, "BSD-2-Clause"),
    ]:
        score, name = best(text)
        assert score >= m.THRESHOLD and name == want, (text[:60], score, name)
    assert matcher.best("Copyright (c) 2020 Someone " + m.MIT + " " + m.WARRANTY)[0] >= m.THRESHOLD
    for text in (prose(300, 1), "all rights of the weaver are kept in the book of looms", "he asked for permission to go to the fair"):
        assert best(text)[0] < m.THRESHOLD


def test_licences_against_brute_force(spark):
    """Own licences by the matcher on frequencies counted here, inheritance by walking up, with ties, repeated rows and a directory that holds most texts."""
    from rasterloom.llm import licenses as m

    r = random.Random(21)
    notices = ["Released under the MIT License.", "Licensed under CC BY 4.0.", "SPDX-License-Identifier: GPL-3.0", "Licensed under the Apache License, Version 2.0."]
    rows = []
    for i in range(150):
        folder = "/".join(r.choice("abc") for _ in range(r.randint(0, 4))) if i % 3 else "hot/dir"
        text = prose(r.randint(1, 20), i) + ("\n" + r.choice(notices)) * (r.random() < 0.15)
        name = f"f{i}.txt"
        if folder and r.random() < 0.08:
            name, text = "LICENSE", r.choice(notices)
        rows.append((i, f"{folder}/{name}".lstrip("/"), text))
    rows += [rows[5], (200, "a/LICENSE", notices[0]), (199, "a/COPYING", notices[0]), (None, None, None), (None, "a/b/none", "")]
    texts = [t or "" for _, _, t in rows]
    held = Counter(w for t in texts for w in set(m.TERM.findall(t.lower())) & set(m.VOCABULARY))
    matcher = m.Matcher(len(rows), held)
    own, given = [], {}
    for (i, p, _), t in zip(rows, texts, strict=True):
        best = max((matcher.best(x) for x in m.segments(t)), key=lambda x: x[0], default=(0.0, None))
        best = best if best[0] >= m.THRESHOLD else (None, None)
        folder = (p or "").rpartition("/")[0]
        file = best[1] is not None and (bool(re.search(m.FILE_NAME, p or "")) or matcher.best(t)[0] >= m.THRESHOLD)
        own.append((i, p or "", folder, best[1], file))
        if file:
            given.setdefault(folder, []).append((-round(best[0], 9), best[1], i))
    want = Counter()
    for i, p, folder, name, file in own:
        up = folder
        while name is None and up not in given and up:
            up = up.rpartition("/")[0]
        if name is not None:
            want[i, p, name, "file" if file else "header", None] += 1
        elif up in given:
            want[i, p, min(given[up])[1], "inherited", up] += 1
        else:
            want[i, p, None, None, None] += 1
    df = spark.createDataFrame([(i, p, t, "x", 1.0, "y") for i, p, t in rows], "doc_id long, path string, text string, license string, score double, dir string")
    got = Counter((x.doc_id, x.path, x.license, x.origin, x.from_dir) for x in m.scan(df, F.col("path")).collect())
    assert got == want and {o for *_, o, _ in want} == {"file", "header", "inherited", None}


# -- components, pipeline ------------------------------------------------------
def test_components(spark):
    from rasterloom.llm.graph import components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + k) for k in range(50)] + [(300, 300), (301, 302), (301, 302)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100} | {200 + k: 100 for k in range(50)} | {300: 300, 301: 301, 302: 301}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("chunk", [100, 500_000])
def test_components_of_chains_in_any_order(spark, chunk):
    from rasterloom.llm.graph import components

    r = random.Random(4)
    order = [*range(2001, 3201)]
    r.shuffle(order)
    backward = [1, *range(1500, 1, -1)]
    edges = [e for chain in (order, backward) for e in zip(chain, chain[1:])]
    r.shuffle(edges)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long"), chunk).collect()}
    assert got == dict.fromkeys(range(1, 1501), 1) | dict.fromkeys(range(2001, 3201), 2001)


def test_pipeline_against_brute_force(spark, tmp_path, rows):
    """The stages on a small table, each told again in plain Python from its input."""
    import corpus_pipeline
    from rasterloom.llm.quality import RULES, Text

    texts = [(i, t, s) for i, t, s in rows if i is not None and i != 3] + [(400, "call +1 (743) 555-3824 or write to a.b@mail.example.com about the looms and the reeds of old", "s1"), (401, prose(60, 3), "s2")]
    table(spark, texts).drop("id", "size", "label", "text_key", "class_id", "path").write.parquet(str(tmp_path / "documents.parquet"))
    docs, at = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        at[name] = [r.asDict() for r in docs.collect()]
    columns = {"doc_id", "text", "lang", "source", "n_chars"}
    assert all(set(r) == columns for name, _ in corpus_pipeline.STAGES[:-1] for r in at[name])
    assert {r["doc_id"] for r in at["quality_rules"]} == {i for i, t, _ in texts if not any(x.rejects(Text(t)) for x in RULES)}
    assert 104 not in {r["doc_id"] for r in at["minhash_near_dedup"]} or 105 not in {r["doc_id"] for r in at["minhash_near_dedup"]}
    assert next(r["text"] for r in at["pii"] if r["doc_id"] == 400).startswith("call [PHONE] or write to [EMAIL] about")
    assert all(not base_spans(r["text"]) for r in at["pii"])
    times = Counter(r["doc_id"] for r in at["mixing"])
    assert set(times) <= {r["doc_id"] for r in at["pii"]} and max(times.values()) <= 2
    assert Counter(r["doc_id"] for r in at["best_fit_packing"] if r["piece"] == 0) == times
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(at["best_fit_packing"])


def test_queries_have_names(spark):
    from rasterloom.llm.queries import queries

    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries()}) == list(range(1, 14))
    assert json.dumps(sorted(queries()))


# -- op11 ---------------------------------------------------------------------
TALK = "conv_id long, turn long, role string, text string, depth int, owner string"


def talk_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TALK)


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[c].append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [t[3] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + convs[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = {}
    for p, who in members.items():
        under = [q for q in members if q[: len(p)] == p]
        own = min(who)
        out[own, len(p)] = (
            min(members[p[:-1]]) if p else None, len(who), sum(len(q) == len(p) + 1 for q in under),
            sum(not any(len(z) == len(q) + 1 and z[: len(q)] == q for z in members) for q in under),
            sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q),
            hashlib.sha256(",".join(map(str, sorted(c for c in who if len(built[c]) == len(p)))).encode()).hexdigest(),
        )
    return out


def talks(seed, n, most=6, words=("a", "b b", "c d e", "", None)):
    r = random.Random(seed)
    return [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(words)) for c in range(n) if r.random() < 0.9 for t in range(r.randint(1, most))]


def as_nodes(df):
    assert [k for _, k in df.dtypes] == ["bigint"] * 7 + ["string"]
    found = df.collect()
    assert len({(r[0], r[1]) for r in found}) == len(found)
    return {(r[0], r[1]): tuple(r)[2:] for r in found}


@pytest.mark.parametrize("seed", [1, 2])
def test_prefix_trie_is_as_brute_force(spark, seed):
    from rasterloom.llm.prefix_trie import conversation_trie

    rows = talks(seed, 130) + [(None, 0, "user", "a"), (-7, 1, "user", "a"), (5, 3, "user", "a"), (5, 3, "user", "a"), (20_000, 1, "user", "long " * 5000)]
    rows += [(9000 + c, t, "user", "a") for c in range(60) for t in range(3)]  # copies
    rows += [(7000, t, "user", f"x{t % 3}") for t in range(700)]  # a third of all turns
    assert as_nodes(conversation_trie(talk_table(spark, rows))) == brute_trie(rows)


def test_prefix_trie_of_a_staircase_and_of_many_ends(spark, monkeypatch):
    """Each conversation leaves the one before it a turn later: a tree of chains as high as it can be; and ids of one node in many chunks."""
    from rasterloom.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    rows = [(20 * c, t, "user", f"t{t}" if t <= c else f"own{c}") for c in range(25) for t in range(c + 2)]
    rows += [(3000 + c, 0, "user", "same") for c in range(200)]
    assert as_nodes(prefix_trie.conversation_trie(talk_table(spark, rows))) == brute_trie(rows)


def test_prefix_trie_of_nothing(spark):
    from rasterloom.llm.prefix_trie import conversation_trie

    assert conversation_trie(talk_table(spark, [])).count() == 0
    assert conversation_trie(talk_table(spark, [(None, 1, "user", "x")])).count() == 0


def test_running_totals_reach_over_ranges(spark):
    """A key of most rows is dealt over several ranges."""
    from rasterloom.llm.running import running

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("k", i, 7 * i % 11) for i in range(500)] + [("a", i, i) for i in range(9)] + [("z", 1, 5)]
        df = spark.createDataFrame(rows, "key string, i long, v long").repartition(5)
        dealt = df.repartitionByRange("key", "i").select(F.spark_partition_id().alias("p")).distinct().count()
        got = {(r["key"], r["i"]): (r["s"], r["x"]) for r in running(df, "key", [F.col("i").desc()], {"s": (F.col("v"), "sum"), "x": (F.col("v"), "bit_xor")}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt > 1
    for k in "akz":
        s = x = 0
        for _, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            s, x = s + v, x ^ v
            assert got[k, i] == (s, x)


# -- op12 ---------------------------------------------------------------------
STRETCHES = ["a", "b", "the", "'", "s", "'re", "ll", " ", "  ", "\n", "1", "23", "!", "...", "é", "中文", "字", " ", "　", "\U0001f600", "\x1c", "\x85", "͸", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    from rasterloom.llm.byte_bpe import codec as made

    return made()


def test_every_token_comes_from_its_own_merges(codec):
    """Then a sequence is an encoding if and only if its neighbours agree."""
    ranks = {b: i for i, b in enumerate(codec.bytes_of)}

    def merged(raw):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            if parts[k] + parts[k + 1] not in ranks:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    assert all(merged(b) == [i] for i, b in enumerate(codec.bytes_of))


@pytest.mark.parametrize("plain", [0, 10, 256])
def test_halves_join_to_the_library_ids(codec, plain, monkeypatch):
    from rasterloom.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "LEAF", 5)
    monkeypatch.setattr(byte_bpe, "PLAIN", plain)
    r = random.Random(plain)
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 70))) for pool in [STRETCHES] * 1500 + [r.sample(STRETCHES, 2) for _ in range(1500)]]
    texts += ["x" * 2000, " " * 900 + "x", "中" * 700, "中文字" * 300, "12345" * 200, "'s" * 300, "ab'll" * 200, "\n" * 700]
    for t in texts:
        ids = codec.encode(t)
        assert ids == codec.library.encode_ordinary(t), repr(t)
        assert codec.decode(ids) == t.encode()


def test_byte_bpe_of_a_table(spark, docs, rows, empty, codec):
    from rasterloom.llm import byte_bpe

    for segment in (byte_bpe.SEGMENT, 1000):  # long texts as one row, and as many segments
        found = byte_bpe.decode(byte_bpe.encode(docs, segment=segment)).collect()
        want = Counter((i, tuple(codec.library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in rows)
        assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found) == want
    assert byte_bpe.decode(byte_bpe.encode(empty)).count() == 0


# -- op13 ---------------------------------------------------------------------
def digest_of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """rows of (doc_id, text, lang, source, n_chars): a Counter of the query's rows."""

    def leaf(doc, text, lang, source, n):
        return digest_of(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))

    def tree(nodes):
        """The root and, for each leaf, (before, after) level by level."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
                steps[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
            at = [i // 3 for i in at]
            nodes = [digest_of(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        return nodes[0], steps

    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = tree([leaf(*r) for r in groups[s]])
    if not order:
        return Counter()
    root, upper = tree([trees[s][0] for s in order])
    out = Counter()
    for s, above in zip(order, upper, strict=True):
        for row, own in zip(groups[s], trees[s][1], strict=True):
            doc, text, *rest = row
            touched = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
            h = leaf(doc, text.replace("\n", "") if touched and text is not None else text, *rest)
            for a, b in own + above:
                h = digest_of(a, h, b)
            proof = "".join(a + b for a, b in own + above)
            out[doc, leaf(*row), trees[s][0], root, digest_of(proof), h, h == root] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 29, 170])
def test_merkle_manifest_is_as_brute_force(spark, n):
    from rasterloom.llm.queries import op13_merkle_manifest  # noqa: F401
    from rasterloom.llm import merkle

    r = random.Random(n)
    rows = [(r.randint(-5, 10 * n), prose(r.randint(0, 9), k) + r.choice(["", "\nx", "\n"]), r.choice(["en", None, "dé"]), r.choice(["s", "s", "s", "Z", "ü", "\U0001f600", "￮", None, ""]), r.choice([None, k])) for k in range(n)]
    if n > 20:
        rows += [(None, None, None, None, None), (7, None, "en", "one", 1), rows[0], rows[0]]
    full = [(i, t, lang, s, c, "x", 1, 2, "y", 3, "z") for i, t, lang, s, c in rows]
    df = spark.createDataFrame(full, SCHEMA)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.audited(df, touched, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    got = Counter((x["doc_id"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"], x["folded_root"], x["verified"]) for x in found.collect())
    assert got == brute_manifest(rows)
