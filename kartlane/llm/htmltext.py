"""Operator 7, main text of HTML pages, with a host suffix array for what the markup leaves open.

Each page is cut into blocks of text. Blocks inside the page's article (else
its main element) are content, blocks inside menus, headers, footers, sidebars,
notices, adverts, forms or comments are boilerplate by their markup. All blocks
outside the article make the page's token stream. The streams of a host are
suffix-sorted to a depth of ``DEPTH`` tokens: suffixes that agree so far and come
from pages of different content mark their tokens as repeated. (A token lies in
a repeated substring of DEPTH or more tokens exactly if it lies in a repeated
window of DEPTH, so a deeper order would cover the same tokens.) On pages that
have neither article nor main element, the open blocks that are mostly covered
go and the unique ones stay. Copies of a page count as one page.

Text inside an article is never judged by repetition: articles are copied too.

Defined results: null and empty pages have an empty text; unclosed tags, a tag or
comment cut off at the end and unknown elements are read as browsers do; repeated
rows stay; pages without ``://`` belong to the empty host.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, word_hashes
from .url_filter import host_path

DEPTH = 4
COVERED = 0.5  # share of a block's tokens

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_NAME = re.compile(r"""\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
_BOILER = frozenset("nav footer aside form head menu dialog button select fieldset object canvas audio video search".split())
_LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
_WORDS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent "
                   "notice notices alert sidebar comment comments disqus share sharing social related recommended newsletter subscribe "
                   "nav navbar navigation menu breadcrumb breadcrumbs footer widget popup modal overlay paywall complementary "
                   "contentinfo search toolbar pagination".split())
_SPLIT = re.compile(r"[^a-z0-9]+")

MAIN, BOILER, OPEN = 0, 1, 2


def blocks(page: str) -> list[tuple[int, str]]:
    """``(kind, text)`` of each non-empty block in page order."""
    out, text, stack = [], [], []
    article = main = boiler = 0
    found = [False, False]

    def close():
        if text:
            s = " ".join(_html.unescape("".join(text)).split())
            if s:
                out.append((article > 0, main > 0, boiler > 0, s))
            text.clear()

    def pop():
        nonlocal article, main, boiler
        _, a, m, b = stack.pop()
        article, main, boiler = article - a, main - m, boiler - b

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        m = _TAG.match(page, lt)
        if m is None:
            text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, attrs = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:  # an end tag
            if name not in _INLINE:
                close()
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in _RAW:
            close()
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in _INLINE:
            close()
            while stack and stack[-1][0] == "p":
                pop()
        if name in _VOID or attrs.endswith("/") and name not in _INLINE:
            continue
        marks = {k.lower(): (v or "").strip("\"'").lower() for k, v in _NAME.findall(attrs)} if attrs else {}
        words = {w for k in ("class", "id", "role") if k in marks for w in _SPLIT.split(marks[k])}
        is_boiler = name in _BOILER or bool(words & _WORDS) or "hidden" in marks or (name == "header" or "header" in words) and not article
        is_article = name == "article" and not is_boiler and not boiler or marks.get("itemprop") == "articlebody"
        is_main = name == "main" or marks.get("role") == "main"
        if (name in _INLINE or name in _LOOSE) and not (is_boiler or is_article or is_main):
            continue
        stack.append((name, is_article, is_main, is_boiler))
        article, main, boiler = article + is_article, main + is_main, boiler + is_boiler
        found[0] |= is_article
        found[1] |= is_main
    close()

    def kind(a, m, b):
        if b:
            return BOILER
        return (MAIN if a else BOILER) if found[0] else (MAIN if m else BOILER) if found[1] else OPEN
    return [(kind(a, m, b), s) for a, m, b, s in out]


def parse(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, text, page, open, rest``: the content, and as arrays the open and the boilerplate blocks."""
    host, _ = host_path(F.col("url"))

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                text, page, opened, rest = [], [], [], []
                for raw in part.column(3).to_pylist():
                    found = blocks(raw or "")
                    text.append(" ".join(s for k, s in found if k == MAIN))
                    opened.append([s for k, s in found if k == OPEN])
                    rest.append([s for k, s in found if k == BOILER])
                    h = word_hashes(" ".join(s for _, s in found).encode("utf-8", "replace"))
                    page.append(int(mix((mix(h) * (2 * np.arange(len(h), dtype=np.uint64) + np.uint64(1))).sum(keepdims=True))[0].view(np.int64)))
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(text, pa.string()), pa.array(page, pa.int64()), pa.array(opened, strings),
                     pa.array(rest, strings)], ["page_id", "url", "host", "text", "page", "open", "rest"])
    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(
        run, "page_id bigint, url string, host string, text string, page bigint, open array<string>, rest array<string>")


def suffixes(streams: DataFrame) -> DataFrame:
    """``(host, page, block, pos, key)``: each token's suffix, cut at DEPTH tokens; ``key`` is the hash of those."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            host, page, block, pos, key = [], [], [], [], []
            for h, p, found in zip(*(c.to_pylist() for c in b.columns)):
                for i, s in enumerate(found):
                    w = word_hashes(s.encode("utf-8", "replace"))
                    if len(w) < DEPTH:  # a short block is one suffix of its own length
                        k = mix((mix(w) * (2 * np.arange(len(w), dtype=np.uint64) + np.uint64(1))).sum(keepdims=True) + np.uint64(len(w)))
                    else:
                        n = len(w) - DEPTH + 1
                        k = mix(sum(mix(w[j:j + n] + np.uint64(j * 2654435761)) * np.uint64(2 * j + 3) for j in range(DEPTH)))
                    host += [h] * len(k)
                    page += [p] * len(k)
                    block += [i] * len(k)
                    pos += range(len(k))
                    key.append(k.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(block, pa.int64()), pa.array(pos, pa.int64()),
                 pa.array(np.concatenate(key) if key else np.empty(0, np.int64))], ["host", "page", "block", "pos", "key"])
    return streams.mapInArrow(run, "host string, page bigint, block bigint, pos bigint, key bigint")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    parsed = materialize(parse(pages))
    unsure = parsed.where(F.size("open") > 0)
    done = parsed.where(F.size("open") == 0).select("page_id", "url", "text")
    if not unsure.isEmpty():
        # one stream per page content; hosts are joined and counted by suffix, so no host meets in one task
        evidence = suffixes(parsed.select("host", "page", F.concat("open", "rest").alias("found")))
        repeated = (evidence.groupBy("host", "key").agg(F.min("page").alias("x"), F.max("page").alias("y"))
                    .where("x <> y").select("host", "key"))
        own = suffixes(unsure.select("host", "page", "open")).distinct()
        hit = own.join(repeated, ["host", "key"], "left_semi").groupBy("host", "page", "block").agg(F.collect_list("pos").alias("pos"))
        hit = hit.groupBy("host", "page").agg(F.collect_list(F.struct("block", "pos")).alias("hit"))

        def keep(batches):
            import pyarrow as pa
            for b in batches:
                text = []
                for found, hit in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    at = {h["block"]: h["pos"] for h in hit or []}
                    left = []
                    for i, s in enumerate(found):
                        n = max(1, len(s.split()))
                        covered = np.zeros(n + DEPTH, bool)
                        for p in at.get(i, []):
                            covered[p:p + DEPTH] = True
                        if covered[:n].mean() <= COVERED:
                            left.append(s)
                    text.append(" ".join(left))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(text, pa.string())], ["page_id", "url", "text"])
        rest = unsure.join(hit, ["host", "page"], "left").select("page_id", "url", "open", "hit")
        done = done.unionByName(rest.mapInArrow(keep, "page_id bigint, url string, text string"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
