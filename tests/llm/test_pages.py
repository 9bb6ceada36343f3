"""Main text of pages: markup, repeats of a host, and the given pages against a plain reading."""

import html
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from wavelode.llm import main_text
from wavelode.llm.html_blocks import ARTICLE, BODY, CHROME, MAIN, page_blocks

SCHEMA = "page_id long, url string, html string"


def test_given_pages_equal_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
        want[r.page_id] = (r.url, "\n\n".join(b for b in blocks if b))
    got = main_text.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='has-sidebar'><article><header><h1>T</h1><p>by me</p></header><p>a <span class=ad>buy</span> b&nbsp;c</p><aside>s</aside><div id=comments><article>c</article></div></article></div><p>z", [("T", ARTICLE), ("by me", CHROME), ("a b c", ARTICLE), ("buy", CHROME), ("s", CHROME), ("c", CHROME), ("z", BODY)]),
        ("<p>one<p>two <b>bold</b>ly<br>x</p>t", [("one", BODY), ("two boldly x", BODY), ("t", BODY)]),
        ("<main><nav>n</nav><p>m</p></main><div role=contentinfo>o</div>", [("n", CHROME), ("m", MAIN), ("o", CHROME)]),
        ("<p title=don't>ok</p> x < y &lt;b&gt; &#233;<!-- no --><script>if (a</b>) {}</script><style>p</style>", [("ok", BODY), ("x < y <b> é", BODY)]),
        ("<article><p>cut <a href='x", [("cut", ARTICLE)]),
        ("", []),
    ],
)
def test_blocks(page, want):
    assert [(text, region) for text, region, _ in page_blocks(page)] == want


@pytest.mark.parametrize("piece", ["<div>", "<a ", '<a href="', "<!--", "&amp", "<", "<script>", "</p>", "<p>x", "<li>", '<div class="ad">x', "<a ='", "</script"])
def test_reading_is_linear(piece):
    def took(n):
        began = time.perf_counter()
        page_blocks(piece * (n // len(piece)))
        return time.perf_counter() - began

    took(10_000)
    assert took(1_000_000) < 12


def plain_cover(streams):
    """Words of each page's stream that LEAST-word runs of enough distinct pages of the host cover."""
    n, hosts = main_text.LEAST, defaultdict(dict)
    for key, (host, words) in streams.items():
        hosts[host].setdefault(tuple(words), []).append(key)
    cover = {}
    for pages in hosts.values():
        seen, need = defaultdict(set), min(main_text.PAGES, len(pages))
        for words in pages:
            for i in range(len(words) - n + 1):
                seen[words[i : i + n]].add(words)
        for words, keys in pages.items():
            hit = [False] * len(words)
            for i in range(len(words) - n + 1):
                if len(seen[words[i : i + n]]) >= max(2, need):
                    hit[i : i + n] = [True] * n
            cover.update(dict.fromkeys(keys, hit))
    return cover


def sites(seed=3):
    """Pages without marked articles: a menu, own words and a closing line in plain divs, on hosts of 1 to 30 pages."""
    r, rows, key = np.random.default_rng(seed), [], 0
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    for h, n in enumerate((1, 2, 5, 30)):
        top, end = word(9), word(12)
        for _ in range(n):
            rows.append((key, f"http://H{h}.org:80/{key}", f"<div>{top}</div><div>{word(40)}</div><div>Page {key} {end}</div>"))
            key += 1
    return rows


@pytest.mark.parametrize("group_words", [main_text.GROUP_WORDS, 300])
def test_repeats_of_a_host_go_and_unique_runs_stay(spark, monkeypatch, group_words):
    """Also where a host's streams are many groups."""
    monkeypatch.setattr(main_text, "GROUP_WORDS", group_words)
    rows = sites()
    rows += [(k + 100, u, h) for k, u, h in rows[-3:]]
    blocks = {k: [t.split() for t, _, _ in page_blocks(h)] for k, _, h in rows}
    cover = plain_cover({k: (main_text_host(u), [w for b in blocks[k] for w in b]) for k, u, _ in rows})
    want = {}
    for k in blocks:
        at, texts = 0, []
        for b in blocks[k]:
            texts.append(" ".join(w for w, c in zip(b, cover[k][at : at + len(b)], strict=True) if not c))
            at += len(b)
        want[k] = "\n\n".join(t for t in texts if t)
    got = {r.page_id: (r.text, r.n_repeated) for r in main_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert {k: v[1] for k, v in got.items()} == {k: sum(c) for k, c in cover.items()}
    # The menu and the closing line are gone where two pages have them, the page's own words never.
    assert got[0][1] == 0 and all(v[1] == 21 for k, v in got.items() if k)


def main_text_host(url):
    return re.match("[a-z]+://([^/:]+)", url.lower())[1]


def test_suffixes_are_sorted():
    r = np.random.default_rng(0)
    words = r.integers(0, 3, 400)
    order, rank = main_text.sort_suffixes(words)
    begin = [tuple(words[i : i + main_text.LEAST]) for i in range(len(words))]
    assert [begin[i] for i in order] == sorted(begin)
    assert all((rank[i] == rank[i + 1]) == (begin[i] == begin[i + 1]) for i in range(len(words) - 1))


def test_copies_near_copies_and_marked_articles_lose_nothing(spark):
    r = np.random.default_rng(1)
    body = " ".join(f"w{x}" for x in r.integers(0, 5000, 80))
    near = [f"<p>{body} v{i}</p>" for i in range(4)]
    rows = [(i, "http://a.org/x", f"<p>{body}</p>") for i in range(5)]
    rows += [(10 + i, "http://b.org/y", x) for i, x in enumerate(near)]
    # The same passage in marked articles is theirs, in an aside it is not.
    rows += [(20 + i, "http://c.org/z", f"<aside>{body}</aside><article><p>{body}</p></article>") for i in range(4)]
    got = {r.page_id: r.text for r in main_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**dict.fromkeys(range(5), body), **{10 + i: f"{body} v{i}" for i in range(4)}, **dict.fromkeys(range(20, 24), body)}


@pytest.mark.parametrize("group_words", [main_text.GROUP_WORDS, 300])
def test_suffix_arrays_find_the_template_inside_marked_articles(spark, monkeypatch, group_words):
    """A notice that most articles of a host have goes, in one block or two; a line of half of them stays, and so do copies, near copies and small hosts."""
    monkeypatch.setattr(main_text, "GROUP_WORDS", group_words)
    r = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    page = lambda *blocks: "<nav>menu</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    rows, want = [], {}

    def add(host, blocks, kept=None):
        rows.append((len(rows), f"http://{host}/{len(rows)}", page(*blocks)))
        want[len(rows) - 1] = ("\n\n".join(blocks if kept is None else kept), sum(len(b.split()) for b in blocks) - sum(len(b.split()) for b in (blocks if kept is None else kept)))

    notice, short, half, quote = word(11), word(5), word(12), word(10)
    for i in range(16):
        own = [word(30), f"{word(9)} {quote} {word(3)}", *([half] if i < 8 else [])]
        # Half of the host's articles is not more than half; a quote inside a block is the article's.
        add("a.org", [own[0], notice, short, *own[1:]], own)
    for _ in range(5):
        add("a.org", [rows_text(rows[0][2])[0], notice, short, *rows_text(rows[0][2])[3:]], [w for w in want[0][0].split("\n\n")])
    for _ in range(main_text.TEMPLATE - 1):
        add("b.org", [word(30), notice])
    body = word(60)
    for i in range(12):
        add("c.org", [body, f"{word(3)} {i}"])
    got = {x.page_id: (x.text, x.n_repeated) for x in main_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert all(want[i][1] == 16 for i in range(21)) and not any(want[i][1] for i in range(21, len(want)))


def rows_text(page):
    return [t for t, region, _ in page_blocks(page) if region == ARTICLE]


def test_nulls_repeated_rows_and_extra_columns(spark):
    long = "<p>" + "word " * 100_000 + "</p>"
    rows = [(1, None, None), (None, "no url", ""), (3, "http://a.org", "<nav>x</nav>"), (3, "http://a.org", "<nav>x</nav>"), (4, None, long), (2**62 + 1, None, "<p>\tä  b</p>")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA + ", host string, `a.b` int")
    got = sorted((r.page_id or 0, r.url, len(r.text), r.n_chars) for r in main_text.extract(df).collect())
    assert got == [(0, "no url", 0, 0), (1, None, 0, 0), (3, "http://a.org", 0, 0), (3, "http://a.org", 0, 0), (4, None, 499_999, 499_999), (2**62 + 1, None, 3, 3)]
    assert main_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0
