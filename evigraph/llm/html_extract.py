"""Main text of web pages by composite text density.

A page is parsed into a DOM (tolerant of unclosed and misnested tags). Every node
gets its composite text density: characters a tag, lowered by the share of linked
characters and linked tags against the body's. The node whose children's
densities sum highest is the core; the lowest density on its path to the body is
the threshold.

Density decides what is kept. The core is kept whole, and so is every block
beside it, or beside an ancestor of it, whose density reaches the threshold.
A block below the threshold is kept
* inside the article or main element that holds the core: density tells which
  of several such elements that is, but not headings from notes inside it;
* if it is unlinked text between two kept blocks, or a heading before the core;
* if less than half of it is linked and its density reaches an eighth of the
  core's (sparse sections, as lists of short items).
What density cannot judge, text as dense as an article's, is set aside by its
element or class before: forms, notices, adverts, readers' comments and the
like; and parts of a page that name themselves, as nav and footer do.

The density formula departs from the usual one in two places. A page without a
link gives the logarithm there a base of 1, a division by zero, so 1 is added to
the base; and a node with one tag and a few linked characters gives a negative
gain, so it is kept at that of an unlinked one. Text-level elements (b, br, links) belong
to the block around them.

Blocks are the runs of text between block-level elements; white space in a
block becomes one space and blocks are joined by an empty line. The time for a
page grows with its length, whatever its markup: no part of it is looked at again
for each tag. Defined results: null or empty html, or a page without text, gives
an empty text; very long and deeply nested pages are taken whole (no recursion);
of nodes with equal sums the first is the core (a tie); repeated rows give equal
results; an empty table gives no rows; other columns are ignored, whatever they
are called.
"""
from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .runtime import texts

#: Element groups of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ASIDE = frozenset("nav footer aside form script style noscript template iframe svg canvas button select textarea object embed dialog menu head input audio video map".split())
#: Words of class, id or role values that mark parts outside the article.
ASIDE_WORDS = frozenset(
    """ad ads advert advertisement advertising adbox alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo
    cookie cookies copyright dialog disqus dropdown footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notification
    overlay pager pagination popup promo promoted promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored
    subscribe toolbar topbar widget""".split()
)
#: The words that count on an article element itself, as each comment or teaser may be one.
ARTICLE_ASIDE_WORDS = frozenset("comment comments reply replies respond related promo promoted sponsored teaser ad advert".split())
#: Words that make a class a statement about the page, as in "has-sidebar" or "comments-open".
ABOUT_FIRST, ABOUT_LAST = frozenset("has with no without not is".split()), frozenset("open closed enabled disabled active on off".split())
P_CLOSERS = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
    hgroup hr main menu nav ol p pre section table ul""".split()
)
#: An element that is closed when one of these starts (up to the given container).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A block without many links belongs to the page's text from this part of the core's density on.
SPARSE = 8
SCOPE = frozenset("table td th caption html button object template".split())

_END = re.compile(r"/([a-zA-Z][^\s/>]*)[^>]*>?")
_NAME = re.compile(r"[^\s/>]*")
_SHORT = re.compile(r"([a-zA-Z][^\s/<>]*)([^<>]*)>")
_SPECIAL = re.compile(r"[>\"']")
_MARK = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class _Tags:
    """The tags of a page from left to right, each as (start, end, name, attributes): a name of "/x" is an end tag, an empty one no element.

    A quote that is never closed ends the tag at the next bracket. What a failed
    look for a tag's end has passed is remembered, so no look passes it again.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {q: page.rfind(q) for q in ">\"'"}
        self.dead: set[int] = set()
        #: The last name and the last plain stretch looked at: the ends for every place within.
        self.name, self.plain = (0, 0), (0, -1)

    def _name_end(self, at: int) -> int:
        if not self.name[0] <= at < self.name[1]:
            self.name = (at, _NAME.match(self.page, at).end())
        return self.name[1]

    def _special(self, at: int) -> int:
        """The next quote or closing bracket."""
        if not self.plain[0] <= at <= self.plain[1]:
            m = _SPECIAL.search(self.page, at)
            self.plain = (at, m.start() if m else len(self.page))
        return self.plain[1]

    def _end(self, at: int) -> int:
        """Where the attributes from a place on end (the bracket), or -1."""
        passed = []
        while at <= self.last[">"]:
            here = self._special(at)
            if here in self.dead or here >= len(self.page):
                break
            if self.page[here] == ">":
                return here
            passed.append(here)
            if here >= self.last[self.page[here]]:
                break
            at = self.page.find(self.page[here], here + 1) + 1
        self.dead.update(passed)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            mark = page[at + 1 : at + 2]
            if mark == "/" and (m := _END.match(page, at + 1)):
                return at, m.end(), "/" + m[1].lower(), ""
            if mark in ("!", "?"):
                close = next((c for o, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(o, at)), ">")
                end = page.find(close, at + (4 if close == "-->" else 2))
                return at, len(page) if end < 0 else end + len(close), "", ""
            if mark.isascii() and mark.isalpha():
                if at > self.last[">"]:
                    return None
                name = self._name_end(at + 1)
                end = self._end(name)
                if end >= 0:
                    return at, end + 1, page[at + 1 : name].lower(), page[name:end]
                if m := _SHORT.match(page, at + 1):
                    return at, m.end(), m[1].lower(), m[2]
            at += 1
        return None


class _Dom:
    """Nodes in document order: name, parent, and whether set aside; text runs as (node, text)."""

    def __init__(self) -> None:
        self.name: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.aside: list[bool] = [False]
        self.runs: list[tuple[int, str]] = []

    def add(self, name: str, parent: int, aside: bool) -> int:
        self.name.append(name)
        self.parent.append(parent)
        self.aside.append(aside)
        return len(self.name) - 1


def _marks(attributes: str) -> Iterator[str]:
    """The words of class, id and role values, without classes that only tell of the page."""
    for m in _MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            own = _WORD.findall(name)
            if own and not (len(own) > 1 and (own[0] in ABOUT_FIRST or own[-1] in ABOUT_LAST)):
                yield from own


def _is_aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in ASIDE or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    words = ARTICLE_ASIDE_WORDS if name in ("article", "main") else ASIDE_WORDS
    return any(w in words or w == "header" and not in_article and name not in ("article", "main") for w in _marks(attributes))


def parse(page: str) -> _Dom:
    """The DOM of a page; implied end tags of paragraphs, list items and cells are supplied."""
    dom = _Dom()
    stack = [0]
    names, runs = dom.name, dom.runs
    #: For each name the places of its open elements on the stack, lowest first.
    places: dict[str, list[int]] = {}

    def pop_to(at: int) -> None:
        for node in reversed(stack[at:]):
            places[names[node]].pop()
        del stack[at:]

    def close(targets: tuple[str, ...], stop) -> None:
        """End the lowest open target above the last element that stops the look."""
        if any(places.get(t) for t in targets):
            floor = max((places[x][-1] for x in stop if places.get(x)), default=0)
            found = [own[k] for t in targets if (own := places.get(t)) and (k := bisect_right(own, floor)) < len(own)]
            if found:
                pop_to(min(found))

    tags = _Tags(page)
    at, lowered = 0, None
    while True:
        tag = tags.next(at)
        if tag is None:
            if at < len(page):
                runs.append((stack[-1], page[at:]))
            return dom
        if tag[0] > at:
            runs.append((stack[-1], page[at : tag[0]]))
        _, at, name, attributes = tag
        if name.startswith("/"):
            name = name[1:]
            if name == "br":
                runs.append((stack[-1], " "))
            elif places.get(name):
                pop_to(places[name][-1])
            elif name == "p":
                dom.add("p", stack[-1], dom.aside[stack[-1]])
        elif name:
            if name in P_CLOSERS:
                close(("p",), SCOPE)
            if name in CLOSES:
                close(*CLOSES[name])
            here = stack[-1]
            aside = dom.aside[here] or _is_aside(name, attributes, bool(places.get("article") or places.get("main")))
            if name in ("body", "html") and places.get(name):
                continue
            if name == "body" and places.get("head"):
                pop_to(places["head"][-1])
                aside, here = False, stack[-1]
            node = dom.add(name, here, aside)
            if name in VOID or attributes.endswith("/") and name not in RAW and name in ("svg", "path"):
                if name in ("br", "hr"):
                    runs.append((node, " "))
            elif name in RAW:
                # A-Z only, so that places stay
                lowered = page.translate(_LOW) if lowered is None else lowered
                end = lowered.find(f"</{name}", at)
                if end < 0:
                    end = len(page)
                runs.append((node, page[at:end] if name in ("textarea", "title") else ""))
                gt = page.find(">", end)
                at = len(page) if gt < 0 else gt + 1
            else:
                places.setdefault(name, []).append(len(stack))
                stack.append(node)


def _density(c: int, lc: int, t: int, lt: int, share: float) -> float:
    """Characters a tag, raised where little is linked and lowered by linked characters against the body's share."""
    gain = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0) + 1.0)
    return c / t * gain / (1.0 + math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e)))


def densities(dom: _Dom, texts: list[tuple[int, str]]) -> tuple[list[float], list[float], list[int], list[int], list[bool]]:
    """For every node its density, the sum of its children's, its characters, the linked ones, and whether it is text-level."""
    n = len(dom.name)
    chars, linked, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link, direct = [False] * n, [0] * n
    for k in range(1, n):
        in_link[k] = in_link[dom.parent[k]] or dom.name[k] == "a"
    for k, t in texts:
        direct[k] += len(t.strip())
    for k in range(n - 1, -1, -1):
        chars[k] += direct[k]
        if in_link[k]:
            linked[k] += direct[k]
        if k and not dom.aside[k]:
            p = dom.parent[k]
            chars[p] += chars[k]
            linked[p] += linked[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + (dom.name[k] == "a")
    body = _body(dom)
    share = linked[body] / max(chars[body], 1)
    # text-level elements belong to the block around them, unless they hold blocks
    text_level = [name in INLINE for name in dom.name]
    for k in range(n - 1, 0, -1):
        if not text_level[k]:
            text_level[dom.parent[k]] = False
    density, total, leaf = [0.0] * n, [0.0] * n, [True] * n
    for k in range(n - 1, -1, -1):
        if dom.aside[k] or not chars[k]:
            continue
        density[k] = _density(chars[k], linked[k], max(tags[k], 1), link_tags[k], share)
        if leaf[k]:
            total[k] = density[k]
        elif direct[k]:
            total[k] += math.log(direct[k] + 1)
        if k and not text_level[k]:
            p = dom.parent[k]
            total[p] += density[k]
            leaf[p] = False
    return density, total, chars, linked, text_level


def _body(dom: _Dom) -> int:
    return next((k for k, name in enumerate(dom.name) if name == "body"), 0)


def _core(dom: _Dom, texts: list[tuple[int, str]]) -> list[bool]:
    """Which nodes are kept."""
    n, body = len(dom.name), _body(dom)
    density, total, chars, linked, text_level = densities(dom, texts)
    keep = [False] * n
    inside = [False] * n
    for k in range(body, n):
        inside[k] = k == body or inside[dom.parent[k]]
    best = max((k for k in range(body, n) if inside[k] and chars[k] and not dom.aside[k] and not text_level[k]), key=lambda k: (total[k], -k), default=-1)
    if best < 0:
        return keep
    path = [best]
    while path[-1] != body:
        path.append(dom.parent[path[-1]])
    threshold = min(density[k] for k in path)
    # the outermost article or main around the core is kept whole, else the core
    named = next((k for k in reversed(path) if dom.name[k] in ("article", "main")), None)
    root = best if named is None else named
    above = set(path[path.index(root) + 1 :])
    heading = [name in HEADINGS for name in dom.name]
    for k in range(n - 1, body, -1):
        heading[dom.parent[k]] |= heading[k]
    beside = [k for k in range(body + 1, n) if dom.parent[k] in above and k not in above and k != root and chars[k] and not dom.aside[k]]

    def reaches(k: int) -> bool:
        if named is not None or density[k] >= threshold - 1e-9:
            return density[k] >= threshold - 1e-9
        free = 2 * linked[k] < chars[k]
        return free and (text_level[k] or density[k] >= density[best] / SPARSE or k < root and heading[k])

    kept = {k for k in beside if reaches(k)}
    if named is None and kept:
        low, high = min(*kept, root), max(*kept, root)
        kept |= {k for k in beside if low < k < high and not linked[k]}
    for k in range(body, n):
        if k == root or k in kept:
            keep[k] = True
        elif k in above:  # its own text, in no block
            keep[k] = named is None
        elif inside[k] and dom.parent[k] not in above:
            keep[k] = keep[dom.parent[k]]
    return keep


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    dom = parse(page)
    texts = [(k, _html.unescape(t) if "&" in t else t) for k, t in dom.runs if not dom.aside[k]]
    keep = _core(dom, texts)
    # the block that a run belongs to: its nearest block-level ancestor
    block = list(range(len(dom.name)))
    for k in range(1, len(block)):
        if dom.name[k] in INLINE:
            block[k] = block[dom.parent[k]]
    blocks: list[list[str]] = []
    last_block, last_node = -1, -1
    for k, t in texts:
        if not keep[k]:
            continue
        # a block goes on only if no other block began in between
        if block[k] != last_block or any(block[j] == j and dom.name[j] not in INLINE for j in range(last_node + 1, k + 1) if j != last_block):
            blocks.append([])
        blocks[-1].append(t)
        last_block, last_node = block[k], max(k, last_node)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = [extract(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return texts(pages).select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
