"""HTML extraction: a suffix array of each host's page texts, with the page's structure as guard and tie-break.

A page is cut into blocks, each with its container (the nearest div, section or the like). The token streams of
all pages of a host, of all their blocks, are concatenated; a suffix array with common prefixes finds the
substrings of `min_tokens` or more that two distinct pages share, and how many pages share them. Then, for each block:

- one inside navigation, header, footer, sidebar, notice, advert, form or reader comments, by tag, role or class,
  goes; repetition can't tell such text where it differs from page to page. Where that leaves a page without any text,
  class and id make no chrome, nor does a form, and repetition decides;
- one inside an article or main element stays, whole: what an article quotes is no boilerplate, however often its
  host repeats it. A class or id makes no article or main element chrome, nor an element around the only ones;
- any other one is decided by repetition. If its container is mostly covered by shared substrings, and isn't the bulk of
  a page without an article, a block mostly covered keeps its uncovered runs alone. In other containers
  a shared passage is a quotation, unless it is common: on `common_pages` pages or more and `common_share` of the host's.
  Beside an article, a block stays only if it has `min_tokens` unshared tokens.

Pages are parsed once, into a table in the shared folder. A host of more than `shard_tokens` tokens is dealt into
shards, by hash of page, each with a suffix array of its own, so a host with a third of all pages is no
single task. Repetition counts over the whole host: where blocks are to be decided, the hashes of
all windows of `min_tokens` tokens are counted by shard and then by host, and each shard gets those of its own windows that
other shards share. A page longer than `shard_tokens` is one task's work. So results don't depend on the shards.

Null html, or none, gives the empty text, and so does an empty table no rows. A null url belongs to the host of the
empty name. Repeated rows come back each; copies of a page (same page_id) don't count as two pages, nor do all pages
without an id. Of equal largest containers the first is the bulk. Bytes that are no UTF-8 are read as U+FFFD. Other
columns of the table, whatever their names, aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import common

CHROME, NEUTRAL, MAIN = 0, 1, 2
#: Of an element that is chrome by a class or id alone.
BY_NAME = -1


@dataclass(frozen=True)
class Boilerplate:
    min_tokens: int = 6
    covered: float = 0.5
    common_pages: int = 3
    common_share: float = 0.2
    shard_tokens: int = 150_000
    #: Hosts with several shards up to which they are broadcast.
    lookup_rows: int = 100_000
    salts: int = 16


#: A quote counts after "=" alone, up to its pair, however far. No part gives back what it took. A tag that meets
#: "<" outside quotes, or the end of the page, has no group 4: it is none, and what it ran over is read by
#: _UNQUOTED, where any "<" or ">" ends a tag. So each character is read twice at most.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?[^<>=]*+)*+)(>?)", re.S)
_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements whose content is text of its own kind, up to their end tag.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FOREIGN = {"svg", "math"}
#: What a reader doesn't see; where no end tag follows, the start tag alone goes, and what stands behind it is text.
_UNSEEN = {"object", "canvas", "noscript", "template"} | _FOREIGN
_CHROME_TAGS = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset", "datalist"} | _UNSEEN
#: Tags that end an svg or math left open, and what may hold such tags inside one.
_BREAKOUT = set("article main section body blockquote center dd div dl dt em h1 h2 h3 h4 h5 h6 header footer nav aside figure hr li ol p pre table ul".split())
_INNER_HTML = re.compile(r"<(?:foreignobject|annotation-xml|mtext|title|desc)\b", re.I)
#: An end tag may have white space, a slash or attributes behind its name.
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.I) for tag in _UNSEEN | _RAW}
#: Elements beside the text, by tag, and their start and end tags.
_SIDES = ("nav", "header", "head", "aside")
_SIDE_TAGS = {tag: re.compile(rf"<(/?){tag}(?=[\s>/])", re.I) for tag in _SIDES}
_CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_CHROME_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer footnav header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments commentlist respond replies discussion disqus share sharing social related recommended pagination pager copyright legal disclaimer".split()
)
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_MAIN_ROLES = {"main", "article"}
_WORD = re.compile(r"[a-z]+")
#: Words that may stand beside a name of chrome in a class or id without making it another thing.
_FILLER = set(
    "box boxes bar bars wrap wrapper container inner outer block blocks area list lists links link item items section panel group row col column content site page global main primary secondary "
    "top bottom left right mobile desktop fixed sticky button buttons icons form policy banner unit slot text small large js the my".split()
)
#: Words of a post's own parts, as in entry-header; but post-comments are comments.
_POST_WORDS = {"entry", "post", "posts", "article", "articles", "story", "stories"}
_BESIDE_POST = set("ad ads advert advertisement sponsor promo comment comments respond replies discussion share sharing social related recommended newsletter subscribe nav navigation pagination pager sidebar widget widgets".split())
#: Elements that hold a part of a page together.
_GROUPS = {"body", "main", "article", "section", "div", "center", "td"}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _names(found: dict[str, str]) -> str:
    return f"{found.get('class', '')} {found.get('id', '')}"


def _named_chrome(names: str) -> bool:
    """Whether one of an element's classes and ids is, as a whole, a name of chrome."""
    for name in names.lower().split():
        words = set(_WORD.findall(name))
        found = words & _CHROME_NAMES
        if found and words <= _CHROME_NAMES | _FILLER | _POST_WORDS and (not words & _POST_WORDS or found & _BESIDE_POST):
            return True
    return False


def _kind(tag: str, raw: str, inside: int, lenient: bool = False) -> int | None:
    """What an element makes of its content; None if nothing. Lenient: no name makes it chrome, and no form is."""
    named = not lenient and tag not in ("html", "body", "article", "main") and not (tag == "header" and inside == MAIN)
    if tag in ("article", "main"):
        kind = MAIN
    elif tag == "form":
        kind = None if lenient else BY_NAME  # some pages are one form
    elif tag in _CHROME_TAGS and not (tag == "header" and inside == MAIN):
        return CHROME
    else:
        kind = None
    if not raw or "=" not in raw and "hidden" not in raw:
        return kind
    found = _attributes(raw)
    role = found.get("role", "").lower()
    if tag in ("html", "body"):
        pass  # a script shows a page that is hidden as a whole, or hides it behind a dialog for a while
    elif "hidden" in found or found.get("aria-hidden") == "true" or role in _CHROME_ROLES:
        return CHROME
    if role in _MAIN_ROLES or found.get("itemprop", "").lower() == "articlebody":
        kind = MAIN
        named = named and role not in _MAIN_ROLES
    if named and _named_chrome(_names(found)):
        return BY_NAME
    return kind


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block that has text, in order; character references decoded, white space single."""
    return [(k, t) for k, t, _ in placed(page)]


def placed(page: str | None) -> list[tuple[int, str, int]]:
    """The blocks, and the number of each one's container."""
    out, around = _blocks(page, False)
    if around and not any(k == MAIN for k, _, _ in out):
        # All its articles are inside elements with names of chrome: these are the page's frame, unless more text
        # stands outside them, as beside a list of related articles.
        framed, _ = _blocks(page, True)
        if sum(len(t) for k, t, _ in framed if k == MAIN) > sum(len(t) for k, t, _ in out if k == NEUTRAL):
            return framed
    if all(k == CHROME for k, _, _ in out):
        # A name, or a form around all, doesn't take a page's whole text: repetition decides.
        lenient, _ = _blocks(page, True, True)
        if any(k != CHROME for k, _, _ in lenient):
            return lenient
    return out


def _blocks(page: str | None, frames: bool, lenient: bool = False) -> tuple[list[tuple[int, str, int]], bool]:
    """The blocks, and whether an article was met in an element that is chrome by name, or a form. With `frames`, such an
    element is none from there on; around a main element it never is. Lenient: names make no chrome, nor do forms, and an
    article leaves any nav, header or aside that it is in."""
    out: list[tuple[int, str, int]] = []
    held: list[str] = []
    groups: list[tuple[str, int]] = []  # open elements of _GROUPS and their numbers
    n_groups = 0
    open_: list[tuple[str, int]] = []  # elements that set a kind, and how many of the same name are open inside
    kinds: list[int] = [NEUTRAL]
    around = False
    by_name = False  # whether the chrome on top is by name
    last: dict[str, int] = {}  # where the last end tag of a name begins
    n_open: Counter[str] = Counter()  # how many of open_ have a name
    n_grouped: Counter[str] = Counter()  # and of groups
    sides: dict[str, tuple[list[int], list[bool]]] = {}  # of a name of _SIDES its tags, and whether an end tag without a start follows
    inner = -1  # where HTML inside svg or math begins last

    def ends_later(tag):
        if tag not in last:
            last[tag] = max((m.start() for m in _ENDS[tag].finditer(page)), default=-1)
        return last[tag] >= at

    def ended_later(tag):
        """Whether the innermost open element of a name of _SIDES gets its end tag."""
        if tag not in sides:
            found = [(m.start(), -1 if m[1] else 1) for m in _SIDE_TAGS[tag].finditer(page)]
            least, low = [], 0
            for _, step in reversed(found):
                low = step + min(0, low)
                least.append(low < 0)
            sides[tag] = [p for p, _ in found], least[::-1]
        places, ends = sides[tag]
        k = bisect.bisect_left(places, at)
        return k < len(places) and ends[k]

    def leave(k):
        """Closes the open elements from the k-th on."""
        n_open.subtract(t for t, _ in open_[k:])
        del open_[k:], kinds[k + 1 :]

    def close_block():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((kinds[-1], text, groups[-1][1] if groups else 0))
            held.clear()

    page, at, end, unquoted = page or "", 0, len(page or ""), 0
    while at < end:
        if at < unquoted:
            m = _UNQUOTED.search(page, at, unquoted)
            if not m:
                held.append(page[at:unquoted])
                at = unquoted
                continue
        else:
            m = _TAG.search(page, at)
        if m and at >= unquoted and m[2] and not m[4]:
            held.append(page[at : m.start()])
            at, unquoted = m.start(), m.end()
            continue
        if not m:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if at == unquoted and m[0].startswith("<!--") and not m[0].endswith("-->"):
                stop = page.find("-->", m.start() + 4)
                at = stop + 3 if stop >= 0 else end
            continue
        tag = m[2].lower()
        if not m[1] and tag in _RAW:
            # Left open, a script or style takes what follows, as in a browser; of others the start tag alone goes.
            stop = _ENDS[tag].search(page, at) if ends_later(tag) else None
            at = stop.end() if stop else end if tag in ("script", "style") else at
            if tag not in _INLINE:
                close_block()
            continue
        if tag not in _INLINE:
            close_block()
        if m[1]:
            if n_grouped[tag] > 0:
                k = next(k for k in range(len(groups) - 1, -1, -1) if groups[k][0] == tag)
                n_grouped.subtract(t for t, _ in groups[k:])
                del groups[k:]
            if n_open[tag] > 0:
                k = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag)
                if open_[k][1]:
                    open_[k] = (tag, open_[k][1] - 1)
                else:
                    close_block()
                    leave(k)
            continue
        if tag in _VOID or m[3].endswith("/") or tag in _UNSEEN and not ends_later(tag):
            continue
        if tag in _GROUPS:
            n_groups += 1
            groups.append((tag, n_groups))
            n_grouped[tag] += 1
        if open_ and open_[-1][0] in _FOREIGN:
            if _INNER_HTML.match(m[0]):
                inner = len(open_)
            elif tag in _BREAKOUT and inner != len(open_):
                leave(len(open_) - 1)
        if tag in _FOREIGN and kinds[-1] != CHROME:
            inner = -1
        if tag in ("article", "main") and kinds[-1] == CHROME and open_[-1][0] in _SIDES and not _named_chrome(_names(_attributes(m[3]))):
            while open_ and open_[-1][0] in _SIDES and (lenient or not ended_later(open_[-1][0])):  # left open by mistake
                leave(len(open_) - 1)
        if tag == "body":
            while open_ and open_[-1][0] == "head":
                leave(len(open_) - 1)
        kind = _kind(tag, m[3], kinds[-1], lenient)
        if kind == MAIN and kinds[-1] == CHROME and by_name:
            own = _attributes(m[3])
            if tag == "main" or not _named_chrome(_names(own)):
                around = True
                if frames or tag == "main" or own.get("role", "").lower() == "main":
                    close_block()
                    kinds[-1] = kinds[-2]
        if kind is not None and kinds[-1] != CHROME:
            close_block()
            open_.append((tag, 0))
            n_open[tag] += 1
            by_name = kind == BY_NAME
            kinds.append(CHROME if by_name else kind)
        elif n_open[tag] > 0:
            k = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag)
            open_[k] = (tag, open_[k][1] + 1)
    close_block()
    return out, around


def suffix_array(tokens: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the common prefix of each with the one before it, by prefix doubling; with a
    depth, in the order of their first `depth` tokens at least, and prefixes exact up to that many."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    levels, width = [rank], 1
    while width < (depth or n) and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + second
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
        width *= 2
    order = np.argsort(levels[-1], kind="stable")
    common_prefix = np.zeros(n, np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        step, inside = 1 << k, (left < n) & (right < n)
        same = inside.copy()
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        same &= np.maximum(left, right) + step <= n
        common_prefix[1:][same] += step
        left[same] += step
        right[same] += step
    return order, common_prefix


def _spread(begins: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of that width from one of the places begins."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, np.minimum(begins + width, n), -1)
    return np.cumsum(change)[:-1] > 0


def covered(streams: list[list[int]], owner: list[int], min_tokens: int, common: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each stream, which tokens lie in a substring of min_tokens or more that streams of two owners hold;
    and which in one that, besides, `common` streams or more hold (0: none)."""
    sizes = [len(s) for s in streams]
    if not sum(sizes):
        return [np.zeros(0, bool) for _ in streams], [np.zeros(0, bool) for _ in streams]
    top = max((max(s) for s in streams if s), default=0)
    # Each stream ends in a token of its own, so that no repeat goes over the end.
    flat = np.concatenate([np.array([*s, top + 1 + k], np.int64) for k, s in enumerate(streams)])
    row = np.repeat(np.arange(len(streams)), [n + 1 for n in sizes])
    page = np.array(owner)[row]
    order, lcp = suffix_array(flat, min_tokens)
    run = np.cumsum(lcp < min_tokens) - 1
    first = np.flatnonzero(lcp < min_tokens)
    shared = (np.minimum.reduceat(page[order], first) != np.maximum.reduceat(page[order], first))[run]
    inside = _spread(order[shared], min_tokens, len(flat))
    often = np.zeros(len(flat), bool)
    if common:
        held = np.unique(run[shared] * len(streams) + row[order[shared]]) // len(streams)
        many = np.bincount(held, minlength=int(run[-1]) + 1) >= common
        often = _spread(order[many[run]], min_tokens, len(flat))
    ends = np.cumsum([n + 1 for n in sizes])
    return tuple([x[e - n - 1 : e - 1] for n, e in zip(sizes, ends, strict=True)] for x in (inside, often))


def windows(texts: list[str], width: int, known: dict[str, int]) -> np.ndarray:
    """A hash of each window of a page's token stream, in order, the same on every machine; known keeps words' hashes."""
    stream = [0] if texts else []
    for text in texts:
        for w in text.split():
            h = known.get(w)
            if h is None:
                h = known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            stream.append(h)
        stream.append(0)
    n = len(stream) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    tokens, total = np.array(stream, np.uint64), np.zeros(n, np.uint64)
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def settle(pages: list[tuple[int, list[tuple[int, str, int]]]], how: Boilerplate, host_pages: int | None = None, shared: np.ndarray | None = None, often: np.ndarray | None = None) -> list[tuple[str, int, int, int]]:
    """For each page of a shard its text, and how many main blocks stayed though shared, neutral ones stayed, and
    blocks outside main that are shared. A page is its id and blocks. Of a host with several shards, host_pages is its number of
    pages; shared and often have the hashes of windows of this shard that other shards' pages hold too, and that are common."""
    names: dict[str, int] = {}
    streams = []
    for _, found in pages:
        stream = []
        for _, text, _ in found:
            # 0 is a block's border, so that short blocks repeat as wholes.
            stream += [0, *(names.setdefault(w, len(names) + 1) for w in text.split())]
        streams.append([*stream, 0] if stream else [])
    # What is common on a host of several shards, its shards can't tell.
    common = 0 if host_pages else max(how.common_pages, math.ceil(how.common_share * len(pages)))
    marks, commons = covered(streams, [p for p, _ in pages], how.min_tokens, common)
    if shared is not None and len(shared):
        known: dict[str, int] = {}
        for (_, found), mark, many in zip(pages, marks, commons, strict=True):
            hashes = windows([t for _, t, _ in found], how.min_tokens, known)
            mark |= _spread(np.flatnonzero(np.isin(hashes, shared)), how.min_tokens, len(mark))
            many |= _spread(np.flatnonzero(np.isin(hashes, often)), how.min_tokens, len(mark))
    return [_text(found, mark, many, how) for (_, found), mark, many in zip(pages, marks, commons, strict=True)]


def _text(found: list[tuple[int, str, int]], mark: np.ndarray, often: np.ndarray, how: Boilerplate) -> tuple[str, int, int, int]:
    """A page's text of its blocks, by what of its stream is shared, and what is common; and settle's three numbers."""
    spans, at = [], 0
    sizes: dict[int, list[int]] = {}  # of each container's neutral blocks: tokens, shared ones
    for kind, text, place in found:
        words = text.split()
        spans.append((at + 1, at + 1 + len(words)))
        at += 1 + len(words)
        if kind == NEUTRAL:
            own = sizes.setdefault(place, [0, 0])
            own[0] += len(words)
            own[1] += int(mark[slice(*spans[-1])].sum())
    beside = any(kind == MAIN for kind, _, _ in found)
    bulk = None
    if sizes and not beside:
        bulk = max(sizes, key=lambda p: sizes[p][0])
        if 2 * sizes[bulk][0] < sum(n for n, _ in sizes.values()):
            bulk = None
    kept, guarded, stayed, repeated = [], 0, 0, 0
    for (kind, text, place), span in zip(found, spans, strict=True):
        own = mark[slice(*span)]
        is_shared = own.mean() >= how.covered
        if kind == MAIN:
            guarded += bool(is_shared)
            kept.append(text)
            continue
        repeated += bool(is_shared)
        if kind == CHROME or beside and (~own).sum() < how.min_tokens:
            continue
        n, n_shared = sizes[place]
        gone = own if place != bulk and n_shared >= how.covered * n else often[slice(*span)]
        if gone.mean() >= how.covered:
            text = " ".join(w for w, m in zip(text.split(), gone.tolist(), strict=True) if not m)
        if text:
            stayed += 1
            kept.append(text)
    return " ".join(kept), guarded, stayed, repeated


_PARSED = "page_id bigint, url string, host string, n_tokens bigint, asks boolean, kinds array<int>, places array<int>, texts string"
_FOUND = "page_id bigint, url string, text string, n_neutral bigint"


def _split(texts: str | None) -> list[str]:
    """The texts of a page's blocks, which the table has in one: a block's text has no line end."""
    return texts.split("\n") if texts else []


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host of each page; its tokens, whether it has neutral blocks; and its blocks."""
    host = F.coalesce(F.regexp_extract(F.make_valid_utf8(F.col("url").cast("string")), r"://([^/?#]*)", 1), F.lit(""))

    def run(batches):
        for batch in batches:
            for part in common.parts(batch, 3, 1 << 20):
                found = [placed(None if x is None else x.decode("utf-8", "replace")) for x in common.byte_texts(part.column(3))]
                tokens = [sum(t.count(" ") + 1 for _, t, _ in f) for f in found]
                asks = [any(k == NEUTRAL for k, _, _ in f) for f in found]
                kinds, texts, places = ([[x[i] for x in f] for f in found] for i in (0, 1, 2))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(3)), pa.array(tokens, pa.int64()), pa.array(asks, pa.bool_()), pa.array(kinds, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(["\n".join(x) if x else None for x in texts], pa.string())],
                    [c.split()[0] for c in _PARSED.split(", ")],
                )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), F.col("html").cast("string").alias("html"))
    return common.map_arrow(rows, run, _PARSED)


def _dealt(parsed: DataFrame, how: Boilerplate) -> DataFrame:
    """parsed with shards and host_pages (1 and null for a host of one shard), whether the host has neutral blocks, and the page's shard."""
    sums = parsed.groupBy("host").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("host_pages"), F.bool_or("asks").alias("host_asks"))
    large = common.cut(sums.where(F.col("n") > how.shard_tokens).select("host", F.ceil(F.col("n") / how.shard_tokens).alias("shards"), "host_pages", "host_asks"))
    if large.limit(how.lookup_rows + 1).count() <= how.lookup_rows:
        joined = parsed.join(F.broadcast(large), "host", "left")
    else:
        # A host's pages are salted, and the merge join's two exchanges let Spark split what is still large.
        salted = large.withColumn("salt", F.explode(F.array(*map(F.lit, range(how.salts)))))
        joined = parsed.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(how.salts))).join(salted.hint("merge"), ["host", "salt"], "left").drop("salt")
    shard = F.when(F.col("shards").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.col("shards")))
    return joined.withColumn("shard", shard.cast("bigint"))


def _evidence(dealt: DataFrame, how: Boilerplate) -> DataFrame:
    """host, shard, and the hashes of that shard's windows in blocks to be decided that other pages of the host
    hold too, with which of them are common. Of hosts with several shards, and with such blocks."""
    rows = dealt.where("host_asks").select("host", "shard", F.coalesce("page_id", F.lit(-1)).alias("page"), "host_pages", "kinds", "texts")

    def counted(batches):
        for batch in batches:
            known: dict[str, int] = {}
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                at, hashes, asks = [], [], []
                for k, (kinds, texts) in enumerate(zip(part.column(4).to_pylist(), map(_split, part.column(5).to_pylist()), strict=True)):
                    found = windows(texts, how.min_tokens, known)
                    # The tokens that are to be decided, borders not.
                    own = np.concatenate([[0], *([0, *[int(kind == NEUTRAL)] * len(t.split())] for kind, t in zip(kinds, texts, strict=True)), [0]])
                    run = np.cumsum(own)
                    asked = run[how.min_tokens : how.min_tokens + len(found)] > run[: len(found)]
                    found, back = np.unique(found, return_inverse=True)
                    at.append(np.full(len(found), k))
                    hashes.append(found)
                    asks.append(np.bincount(back, weights=asked, minlength=len(found)) > 0)
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(4)), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(asks))], ["host", "shard", "page", "host_pages", "window", "asks"])

    each = common.map_arrow(rows, counted, "host string, shard bigint, page bigint, host_pages bigint, window bigint, asks boolean")
    # Partial sums by shard, so a notice on all pages of a hot host is a row of each shard.
    by_shard = each.groupBy("host", "shard", "window").agg(F.count("*").alias("n"), F.min("page").alias("low"), F.max("page").alias("high"), F.bool_or("asks").alias("asks"), F.max("host_pages").alias("host_pages"))
    sums = by_shard.groupBy("host", "window").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("asks").alias("asked"), F.max("host_pages").alias("host_pages"))
    many = F.col("n") >= F.greatest(F.lit(how.common_pages), F.ceil(F.lit(how.common_share) * F.col("host_pages")))
    shared = sums.where("asked AND low < high").select("host", "window", many.alias("many"))
    found = by_shard.where("asks").select("host", "shard", "window").join(shared, ["host", "window"])
    return found.groupBy("host", "shard").agg(F.collect_list("window").alias("windows"), F.collect_list(F.when(F.col("many"), F.col("window"))).alias("often"))


def decide(parsed: DataFrame, how: Boilerplate = Boilerplate()) -> DataFrame:
    """The pages of a table of parse, in the columns of _FOUND."""
    dealt = _dealt(parsed, how)
    schema = "host string, shard bigint, host_pages bigint, page_id bigint, url string, kinds array<int>, places array<int>, texts binary"

    def packed(batches):
        pack = zstandard.ZstdCompressor()
        for batch in batches:
            texts = pa.array([None if x is None else pack.compress(x) for x in common.byte_texts(batch.column(7))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], texts], batch.schema.names)

    # Compressed for the shuffle, which is most of what lies on disk.
    rows = common.map_arrow(dealt.select(*[c.split()[0] for c in schema.split(", ")]), packed, schema)

    def shard(batches):
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not held.num_rows:
                continue
            keys = list(zip(held["host"].to_pylist(), held["shard"].to_pylist(), strict=True))
            starts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            if batch is not None:
                starts.pop()  # the last shard may go on
            for a, b in zip(starts, starts[1:], strict=False):
                part = held.slice(a, b - a)
                # The shard's evidence, if it has any, is a row of its own.
                own = part["windows"].is_valid()
                shared, often = (part.filter(own)[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("windows", "often"))
                part = part.filter(pc.invert(own))
                if not part.num_rows:
                    continue
                found = [list(zip(k, t, p, strict=True)) for k, t, p in zip(part["kinds"].to_pylist(), (_split(zstandard.decompress(x).decode() if x else None) for x in part["texts"].to_pylist()), part["places"].to_pylist(), strict=True)]
                owner = [-1 if x is None else x for x in part["page_id"].to_pylist()]
                out = settle(list(zip(owner, found, strict=True)), how, part["host_pages"][0].as_py(), shared, often)
                yield pa.RecordBatch.from_arrays([part["page_id"].combine_chunks(), part["url"].combine_chunks(), pa.array([x[0] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], [c.split()[0] for c in _FOUND.split(", ")])
            held = held.slice(starts[-1])

    both = rows.unionByName(_evidence(dealt, how), allowMissingColumns=True)
    ordered = both.repartition("host", "shard").sortWithinPartitions("host", "shard")
    return common.map_arrow(ordered, shard, _FOUND)


def extract(pages: DataFrame, how: Boilerplate = Boilerplate()) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html); and n_neutral: how many blocks outside main stayed."""
    found = decide(common.written(parse(pages)), how)
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_neutral")


def _then_none(batches):
    yield from batches
    yield None


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
