"""Main text of web pages, by the markup of a page and by suffix arrays over hosts.

All text of a host's pages is its token stream: of a page that marks its article, the article
and what is around it; a page that marks none is a stream as a whole. Substrings of LEAST words
or more that distinct pages of a host repeat are boilerplate: they are covered, and of a page
without a marked article the unique runs are kept. Marked articles quote each other and are
copied, so in them only what more than half of the host's distinct articles repeat is
boilerplate, such as a notice; blocks that such repeats cover are left out.

Streams are concatenated in groups of bounded size, each of which sorts its suffixes by
prefix doubling. Only words up to LEAST decide whether a repeated substring of that length
begins at a suffix, so suffixes are sorted to this depth, and each interval of the array that
agrees so far is one row in what the groups of a host exchange.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_blocks import ARTICLE, BODY, MAIN, page_blocks
from .shared import stage

#: Doublings of the sorted depth, which give the words of the shortest repeat, and pages that have it at least (two where a host has two).
DOUBLINGS, PAGES = 3, 3
LEAST = 1 << DOUBLINGS
#: Distinct articles of a host that have a line of its template at least; they must be more than half of all as well.
TEMPLATE = 8
#: Words of a group's streams, about, and salts under which a large host is joined.
GROUP_WORDS, SALTS = 200_000, 64
#: Keys of the two word hashes that name a substring, and their odd multipliers.
HASHES = (("0123456789abcdef", 0x9E3779B97F4A7C15), ("fedcba9876543210", 0xC2B2AE3D27D4EB4F))

#: What parsing adds to a page.
PARSED = (("article", "string"), ("streams", "array<string>"), ("blocks", "array<struct<words: int, linked: int, own: boolean>>"))
_BLOCK_TYPE = pa.list_(pa.struct([("words", pa.int32()), ("linked", pa.int32()), ("own", pa.bool_())]))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; '' where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def parse_page(html: str) -> tuple[str | None, list[str], list[dict] | None]:
    """A page with a marked article: its text, which is a stream, and streams of what is around it. Another: the page as a stream, and its blocks."""
    blocks = page_blocks(html)
    if any(region == ARTICLE for _, region, _ in blocks):
        around = [" ".join(text for text, _, _ in run) for article, run in groupby(blocks, lambda b: b[1] == ARTICLE) if not article]
        return "\n\n".join(text for text, region, _ in blocks if region == ARTICLE), around, None
    own = MAIN if any(region == MAIN for _, region, _ in blocks) else BODY
    parts = [{"words": text.count(" ") + 1, "linked": linked, "own": region == own} for text, region, linked in blocks]
    return None, [" ".join(text for text, _, _ in blocks)] if any(p["own"] for p in parts) else [], parts


def _parse(batches):
    for batch in batches:
        made = [parse_page(html or "") for html in batch.column("html").to_pylist()]
        kinds = (pa.string(), pa.list_(pa.string()), _BLOCK_TYPE)
        kept = [c for c in batch.schema.names if c != "html"]
        columns = [batch.column(c) for c in kept] + [pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(name for name, _ in PARSED)])


def sort_suffixes(words: np.ndarray, doublings: int = DOUBLINGS) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a token stream in the order of their first 2^doublings tokens, and a rank that equal beginnings share."""
    rank = pd.factorize(words, sort=True)[0].astype(np.int64)
    for step in range(doublings):
        after = np.full(len(rank), -1, np.int64)
        after[: max(0, len(rank) - (1 << step))] = rank[1 << step :]
        _, rank = np.unique(rank * (len(rank) + 1) + after + 1, return_inverse=True)
    return np.argsort(rank, kind="stable"), rank


def _window_hashes(words: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of the LEAST words that begin at each position, alike in all groups."""
    codes, distinct = pd.factorize(words)
    out = []
    for key, factor in HASHES:
        of = pd.util.hash_array(np.asarray(distinct, object), hash_key=key)[codes]
        total = np.zeros(max(0, len(words) - LEAST + 1), np.uint64)
        for j in range(LEAST):
            total = total * np.uint64(factor) + of[j : j + len(total)]
        out.append((total ^ (total >> np.uint64(29))).view(np.int64))
    return out


def _intervals(texts) -> tuple[np.ndarray, ...]:
    """The suffix array of streams: their words, where each stream begins, a word's stream, suffixes with LEAST words in order, and an interval number that equal beginnings share."""
    streams = [np.array(text.split(" "), object) for text in texts]
    words, sizes = np.concatenate(streams), np.array([len(s) for s in streams])
    ends, of = np.cumsum(sizes), np.repeat(np.arange(len(sizes)), sizes)
    order, rank = sort_suffixes(words)
    order = order[order + LEAST <= ends[of[order]]]
    interval = np.cumsum(np.r_[0, rank[order][1:] != rank[order][:-1]]) if len(order) else order
    return words, ends - sizes, of, order, interval


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    """The intervals of a group's suffix array: pages that begin so, and where, in streams of pages without an article.

    A host that is one group needs the intervals of repeats alone.
    """
    empty = pd.DataFrame({c: pd.Series(dtype=object) for c in ("host", "h1", "h2", "pages", "need", "at")})
    words, begins, of, order, interval = _intervals(pdf["text"])
    if not len(order):
        return empty
    # An interval counts the pages of each of its streams once.
    own = pd.DataFrame({"interval": interval, "stream": of[order]}).drop_duplicates()
    pages = own.assign(pages=pdf["pages"].to_numpy()[own["stream"]]).groupby("interval")["pages"].sum().to_numpy()
    need, first = int(pdf["need"].iloc[0]), np.r_[0, np.nonzero(np.diff(interval))[0] + 1]
    h1, h2 = (h[order[first]] for h in _window_hashes(words))
    is_open = pdf["whole"].to_numpy()
    s1, s2 = pdf["s1"].to_numpy(), pdf["s2"].to_numpy()
    rows = []
    for i in np.nonzero((pages >= need) | (pdf["groups"].iloc[0] > 1))[0]:
        where = order[first[i] : first[i + 1] if i + 1 < len(first) else len(order)]
        where = where[is_open[of[where]]]
        at = [{"s1": int(s1[of[w]]), "s2": int(s2[of[w]]), "pos": int(w - begins[of[w]])} for w in where]
        rows.append((pdf["host"].iloc[0], h1[i], h2[i], pages[i], need, at))
    return pd.DataFrame(rows, columns=list(empty.columns)) if rows else empty


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """(s1, s2, starts): where repeats of LEAST words begin in the streams of pages without a marked article.

    ``parsed`` has host, streams and whether a page is one stream (whole). Equal streams of a
    host are one row; where they are whole pages they are copies of one page, and count as
    one. Streams of a host are dealt to groups by hash, so a host of any size has groups of
    bounded size, and one row for each group and beginning goes from groups to hosts.
    """
    streams = parsed.select("host", "whole", F.explode("streams").alias("text"))
    named = (F.xxhash64(F.lit(i), "host", "text").alias(f"s{i}") for i in (1, 2))
    streams = streams.groupBy("host", "text").agg(F.max("whole").alias("whole"), F.count_if(~F.col("whole")).alias("around"))
    streams = streams.select("host", *named, "text", "whole", (F.col("around") + F.col("whole").cast("long")).alias("pages"), (1 + F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("words"))
    streams = stage(streams, "streams")
    hosts = streams.groupBy("host").agg(F.sum("words").alias("words"), F.sum("pages").alias("sum"), F.max("whole").alias("open"))
    # Only hosts that have a page without a marked article need their repeats, and repeats need two pages.
    hosts = hosts.where((F.col("sum") >= 2) & F.col("open"))
    hosts = hosts.select("host", F.ceil(F.col("words") / GROUP_WORDS).cast("int").alias("groups"), F.least(F.lit(PAGES), F.col("sum")).alias("need"))
    hosts = hosts.withColumn("salt", F.explode(F.when(F.col("groups") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))))
    large = hosts.where("salt >= 0")
    salted = streams.withColumn("salt", F.pmod("s1", F.lit(SALTS)).cast("int"))
    grouped = salted.join(large, ["host", "salt"]).unionByName(salted.drop("salt").join(hosts.where("salt < 0"), "host").select("host", "salt", *[c for c in salted.columns if c not in ("host", "salt")], "groups", "need"))
    grouped = grouped.withColumn("group", F.pmod("s2", F.col("groups")).cast("int"))
    found = grouped.groupBy("host", "group").applyInPandas(_repeats, "host string, h1 long, h2 long, pages long, need long, at array<struct<s1: long, s2: long, pos: int>>")
    found = stage(found, "intervals")
    repeats = found.groupBy("host", "h1", "h2").agg(F.sum("pages").alias("n"), F.max("need").alias("most")).where("n >= most").select("host", "h1", "h2")
    at = found.where(F.size("at") > 0).join(repeats, ["host", "h1", "h2"]).select(F.inline("at"))
    return at.groupBy("s1", "s2").agg(F.collect_list("pos").alias("starts"))


def _majorities(pdf: pd.DataFrame) -> pd.DataFrame:
    """Beginnings that more than half of a group's distinct articles have, with the number that has each; and, without a beginning, the number of its articles."""
    host, texts = pdf["host"].iloc[0], [zlib.decompress(p).decode() for p in pdf["packed"].drop_duplicates()]
    rows = [(host, None, None, len(texts))]
    words, _, of, order, interval = _intervals(texts)
    if len(order) and (pdf["groups"].iloc[0] > 1 or len(texts) >= TEMPLATE):
        # An interval counts each article once.
        own = np.unique(interval * len(texts) + of[order]) // len(texts)
        first = np.r_[0, np.nonzero(np.diff(interval))[0] + 1]
        count = np.bincount(own)
        many = np.flatnonzero(2 * count > len(texts))
        if len(many):
            h1, h2 = (h[order[first[many]]] for h in _window_hashes(words))
            rows += zip([host] * len(many), h1.tolist(), h2.tolist(), count[many].tolist(), strict=True)
    # Kept from floating point, which a null among large numbers would make of them.
    return pd.DataFrame({c: pd.array(v, "Int64") if c != "host" else list(v) for c, v in zip(("host", "h1", "h2", "n"), zip(*rows, strict=True), strict=True)})


def _packed(batches):
    """Articles as streams, compressed for their way to a group; those whose (s1, s2) the task has met, as copies have, do not travel."""
    met = set()
    for batch in batches:
        keys = list(zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist(), strict=True))
        batch = batch.filter(pa.array([k not in met and not met.add(k) for k in keys], pa.bool_()))
        packed = [zlib.compress(text.replace("\n\n", " ").encode()) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("s2"), pa.array(packed, pa.binary())], names=["host", "s2", "packed"])


def _found_lines(text: str, lines) -> tuple[np.ndarray, np.ndarray]:
    """Where lines (h1, h2) begin in an article, and which of them each place has."""
    words = np.array(text.replace("\n\n", " ").split(" "), object)
    number = {(line["h1"], line["h2"]): i for i, line in enumerate(lines)}
    h1, h2 = _window_hashes(words)
    at = np.flatnonzero(np.isin(h1, np.array([k[0] for k in number], np.int64)))
    hit = [(i, number[k]) for i, k in ((i, (int(h1[i]), int(h2[i]))) for i in at) if k in number]
    return np.array([i for i, _ in hit], np.int64), np.array([n for _, n in hit], np.int64)


def _hits(batches):
    for batch in batches:
        found = [sorted(set(_found_lines(text, lines)[1].tolist())) for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "s1", "s2")), pa.array(found, pa.list_(pa.int32()))], names=["host", "s1", "s2", "has"])


def template_lines(articles: DataFrame) -> DataFrame:
    """(host, lines): beginnings (h1, h2) of LEAST words that at least TEMPLATE and more than half of a host's distinct articles have.

    ``articles`` has host and text, blocks being parted by two line feeds. Articles of a host are
    dealt by hash to groups of about GROUP_WORDS words, each of which sorts its suffixes. What more than half of
    all articles have, more than half of some group has: only these beginnings leave
    their groups, and are then counted in all articles of their hosts.
    """
    words = 1 + F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    large = articles.groupBy("host").agg(F.ceil(F.sum(words) / GROUP_WORDS).cast("int").alias("groups")).where("groups > 1")
    named = (F.xxhash64(F.lit(i), "host", "text").alias(f"s{i}") for i in (1, 2))
    articles = articles.select("host", *named, "text")
    sent = articles.mapInArrow(_packed, "host string, s2 long, packed binary")
    # One short row for each host of more than one group, so at most one for GROUP_WORDS words of the input.
    dealt = sent.join(F.broadcast(large), "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    dealt = dealt.select("host", "packed", "groups", F.pmod("s2", "groups").cast("int").alias("group"))
    found = stage(dealt.groupBy("host", "group").applyInPandas(_majorities, "host string, h1 long, h2 long, n long"), "majorities")
    sizes = found.where("h1 is null").groupBy("host").agg(F.sum("n").alias("articles")).where(F.col("articles") >= TEMPLATE)
    asked = found.where("h1 is not null").groupBy("host").agg(F.sort_array(F.collect_set(F.struct("h1", "h2"))).alias("lines")).join(sizes, "host")
    asked = stage(asked, "asked")
    has = articles.join(asked.select("host", "lines"), "host").mapInArrow(_hits, "host string, s1 long, s2 long, has array<int>")
    has = has.where(F.size("has") > 0).dropDuplicates(["host", "s1", "s2"]).select("host", F.explode("has").alias("i"))
    kept = has.groupBy("host", "i").agg(F.count(F.lit(1)).alias("n")).join(asked, "host").where((F.col("n") >= TEMPLATE) & (2 * F.col("n") > F.col("articles")))
    return stage(kept.groupBy("host").agg(F.collect_list(F.get("lines", F.col("i"))).alias("lines")), "lines")


def covered_words(starts, n: int) -> np.ndarray:
    """Which of ``n`` words are in a run of LEAST words that begins at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, np.asarray(starts, np.int64), 1)
    np.add.at(steps, np.minimum(np.asarray(starts, np.int64) + LEAST, n), -1)
    return np.cumsum(steps)[:n] > 0


def _unique_text(stream: str, blocks, starts) -> tuple[str, int]:
    """Text of a page without a marked article, less what is repeated; and how many words that takes.

    A covered run of more than half of the page's words, mostly outside links, is the text
    of a near copy of the page, and stays.
    """
    words = stream.split(" ")
    sizes = [b["words"] for b in blocks]
    own, linked = np.repeat([b["own"] for b in blocks], sizes), np.repeat([b["linked"] / b["words"] for b in blocks], sizes)
    cover = covered_words(starts, len(words)) if starts is not None and len(starts) else np.zeros(len(words), bool)
    edges = np.flatnonzero(np.diff(np.r_[0, cover.astype(np.int8), 0]))
    for lo, hi in zip(edges[::2], edges[1::2], strict=True):
        if 2 * own[lo:hi].sum() > own.sum() and 2 * linked[lo:hi].sum() < hi - lo:
            cover[lo:hi] = False
    kept, texts, at = own & ~cover, [], 0
    for n in sizes:
        texts.append(" ".join(words[i] for i in range(at, at + n) if kept[i]))
        at += n
    return "\n\n".join(t for t in texts if t), int((own & cover).sum())


def _without_lines(article: str, lines) -> tuple[str, int]:
    """A marked article without blocks that lines of its host's template cover, and how many words that takes.

    Where these are more than half of its words, the host's articles are copies of one, and all stays.
    """
    if not lines:
        return article, 0
    blocks = article.split("\n\n")
    sizes = [b.count(" ") + 1 for b in blocks]
    cover = covered_words(_found_lines(article, lines)[0], sum(sizes))
    ends = np.cumsum(sizes)
    whole = [bool(cover[end - n : end].all()) for n, end in zip(sizes, ends, strict=True)]
    gone = sum(n for n, w in zip(sizes, whole, strict=True) if w)
    if 2 * gone > sum(sizes):
        return article, 0
    return "\n\n".join(b for b, w in zip(blocks, whole, strict=True) if not w), gone


def _cut_articles(batches):
    for batch in batches:
        made = [_without_lines(text, lines) for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True)]
        columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_repeated"])


def _cut(batches):
    for batch in batches:
        made = [_unique_text(s, b, st) if s else ("", 0) for s, b, st in zip(*(batch.column(c).to_pylist() for c in ("stream", "blocks", "starts")), strict=True)]
        columns = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_repeated"])


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points) and n_repeated.

    Takes page_id, url and html; other columns are ignored, and every row gives one. The
    whole page is read. What is in menus, headers, footers, sidebars, notices, adverts, forms,
    comments, scripts and styles, by element, role or class, is left out. The text is
    the article's where a page marks one, without blocks of the host's template; else that of <main>,
    or of the body, without the words that pages of its host repeat (n_repeated of them). Blocks are
    joined by two line feeds; inside a block every run of white space is one space.

    A null or empty page, and one without such text, has an empty text. Pages with a null
    URL, or one without a host, count as one host. Copies of a page, repeated rows
    and very long pages lose nothing: pages alike are evidence once. There are no ties; an
    empty table gives no rows.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), F.col("html"))
    kept = rows.drop("html")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", " + ", ".join(f"{name} {kind}" for name, kind in PARSED)
    parsed = stage(rows.mapInArrow(_parse, schema), "parsed").withColumn("whole", F.col("article").isNull())
    marked = parsed.where(~F.col("whole")).select("page_id", "url", "host", F.col("article").alias("text"))
    marked = marked.join(template_lines(marked.select("host", "text")), "host", "left").drop("host")
    named = (F.xxhash64(F.lit(i), "host", F.get("streams", F.lit(0))).alias(f"s{i}") for i in (1, 2))
    others = parsed.where("whole").select("page_id", "url", *named, F.get("streams", F.lit(0)).alias("stream"), "blocks")
    others = others.join(repeated_runs(parsed), ["s1", "s2"], "left").drop("s1", "s2")
    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in others.select("page_id", "url").schema) + ", text string, n_repeated long"
    return marked.mapInArrow(_cut_articles, made).unionByName(others.mapInArrow(_cut, made)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
