"""Main text of web pages by tag-path ratios.

The page is read once into text nodes, each under its path of open tags from the root. For every path the nodes'
text length and punctuation are summed and divided by the number of nodes. The two ratios are smoothed over
neighbouring paths of the same part in page order, fused by multiplication and compared with a share of the page's
average; a heading goes by its best sibling. Where the page says what a part is, that weighs in by finite factors: a path inside an article is scored by
its article's ratio and to an eighth (geometrically) by its own, times ARTICLE; a path below a class or id that names a menu, header, sidebar, notice, advert or reader comments is scored times NAMED for each such name, and a name inside an article
takes the article's mark away. A name on an element with more than half of the page's text and all of its
articles says nothing. Only elements that can't be content (menus, asides, footers, forms, what is hidden) weigh
nothing. Paths above the threshold are content; all their text is kept, whole and in page order, with the inline
text of the same block and part.

A block is the text between two starts or ends of block-level tags; a line break is white space. Unclosed
paragraphs, items and cells end where the next one begins. Null and empty pages, and pages without content
nodes, give an empty text. Repeated rows give the same text; other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.DOTALL)
ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

#: Elements whose content isn't text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title select datalist".split())
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends, up to the nearest of the second set.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
}
#: Elements that are no content wherever they stand.
ASIDE = frozenset("nav aside footer form button menu dialog search head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: What the marks of an article and of an aside name multiply a path's fused ratio by.
ARTICLE, NAMED = 8.0, 0.05
#: Parts of class names and ids that mark what is seldom content, and the article itself.
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related"
    " replies reply share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_NAMES = frozenset({"articlebody", "entrycontent", "postcontent", "postbody", "articlecontent", "storybody", "maincontent"})
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Element:
    """An open tag: what its place says about the text below."""

    tag: str
    path: tuple
    aside: bool
    article: int
    header: bool
    #: Numbers of the aside names at or above the article (or without one), and of those inside it.
    above: tuple = ()
    below: tuple = ()


@dataclass
class Node:
    """Text nodes of one path in a row, within one block."""

    path: tuple
    aside: bool
    article: int
    block: int
    parts: list[str] = field(default_factory=list)
    above: tuple = ()
    below: tuple = ()


def _said(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is no content, whether it is the article, and whether it has an aside name, by its tag and attributes."""
    aside, article, named = tag in ASIDE, tag in ("article", "main"), False
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
            if name == "role":
                aside |= value.lower() in ASIDE_ROLES
                article |= value.lower() in ("main", "article")
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                aside = True
            elif name == "itemprop":
                article |= value.lower() == "articlebody"
            elif name in ("class", "id"):
                for part in value.split():
                    named |= tag not in ("html", "body") and not ASIDE_NAMES.isdisjoint(x.lower() for x in NAME.findall(part))
                    article |= re.sub(r"[^a-z]", "", part.lower()) in ARTICLE_NAMES
    return aside, article, named


def nodes(page: str) -> list[Node]:
    """The page's text nodes in order."""
    stack = [Element("", (), False, -1, False)]
    found: list[Node] = []
    at, block, articles, names, raw = 0, 0, 0, 0, ""

    def text(upto: int) -> None:
        if upto > at and not raw:
            top, part = stack[-1], page[at:upto]
            if found and found[-1].block == block and (found[-1].path, found[-1].aside, found[-1].above, found[-1].below) == (top.path, top.aside, top.above, top.below):
                found[-1].parts.append(part)
            else:
                found.append(Node(top.path, top.aside, top.article, block, [part], top.above, top.below))

    for m in TAG.finditer(page):
        tag = (m[2] or "").lower()
        if raw and not (m[1] and tag == raw):
            continue
        text(m.start())
        at = m.end()
        if raw:
            raw = ""
            continue
        if tag == "br":
            text_here = found[-1] if found and found[-1].block == block else None
            if text_here:
                text_here.parts.append(" ")
            continue
        if not tag:
            continue
        if tag in BLOCKS:
            block += 1
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS and tag not in BLOCKS:
                    break  # an inline end tag doesn't end a block
            continue
        if tag in RAW:
            raw = "" if m[3].endswith("/") and tag in ("svg", "math") else tag
            continue
        if tag in BLOCKS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in ENDS:
            own, limit = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in own:
                    del stack[depth:]
                    break
                if stack[depth].tag in limit:
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        top = stack[-1]
        aside, article, named = _said(tag, m[3])
        if tag == "header":
            aside |= top.article < 0
        if article and top.article < 0 and not (aside or top.aside):
            number, articles = articles, articles + 1
        else:
            number = top.article
        heading = tag in HEADINGS
        in_header = tag == "header" or top.header
        out = (top.aside or aside) and not (heading and top.header and top.article >= 0 and not aside)
        above, below = top.above, top.below
        if named:
            above, below = (above, (*below, names)) if top.article >= 0 else ((*above, names), below)
            names += 1
        elif heading and top.header and top.article >= 0:
            below = ()  # the article's own heading
        stack.append(Element(tag, (*top.path, tag), out, number, in_header, above, below))
    text(len(page))
    return found


def smooth(values: list[float], radius: int = 1, width: float = 0.5) -> list[float]:
    """A Gaussian mean over neighbours; narrow, so that a list of links beside long paragraphs stays a list of links."""
    kernel = [math.exp(-(d * d) / (2.0 * width * width)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(k, values[i + d]) for d, k in zip(range(-radius, radius + 1), kernel, strict=True) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in pairs) / sum(k for k, _ in pairs))
    return out


def _keys(found: list[tuple[Node, str]]) -> list[tuple]:
    """Each node's key: path, article, aside, and how many aside names count at or above its article and inside it."""
    held: dict[int, int] = {}
    inside: dict[int, set[int]] = {}
    total, articles = 0, set()
    for node, text in found:
        if node.aside:
            continue
        total += len(text)
        if node.article >= 0:
            articles.add(node.article)
        for name in (*node.above, *node.below):
            held[name] = held.get(name, 0) + len(text)
            inside.setdefault(name, set()).add(node.article)
    wrappers = {n for n, size in held.items() if 2 * size > total and articles <= inside[n]}
    return [(n.path, n.article, n.aside, sum(x not in wrappers for x in n.above), sum(x not in wrappers for x in n.below)) for n, _ in found]


def _smoothed(keys: list[tuple], values: list[float]) -> list[float]:
    """The values smoothed within each part of the page."""
    parts: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        parts.setdefault(k[1:], []).append(i)
    out = [0.0] * len(keys)
    for own in parts.values():
        for i, v in zip(own, smooth([values[i] for i in own]), strict=True):
            out[i] = v
    return out


def _with_headings(fused: dict[tuple, float]) -> dict[tuple, float]:
    """A heading is short by nature: seven eighths (geometrically) of its ratio is the best of its siblings' in the same part."""
    best: dict[tuple, float] = {}
    for k, v in fused.items():
        best[k[0][:-1], *k[1:]] = max(v, best.get((k[0][:-1], *k[1:]), 0.0))
    return {k: v**0.125 * best[k[0][:-1], *k[1:]] ** 0.875 if k[0] and k[0][-1] in HEADINGS else v for k, v in fused.items()}


def content_paths(found: list[tuple[Node, str]], share: float = 0.1) -> tuple[list[tuple], set[tuple]]:
    """The nodes' keys, and those whose smoothed, fused and weighted ratios are above the threshold."""
    of, sums = _keys(found), {}
    for k, (_, text) in zip(of, found, strict=True):
        own = sums.setdefault(k, [0, 0, 0])
        own[0] += 1
        own[1] += len(text)
        own[2] += len(PUNCTUATION.findall(text))
    keys = [k for k in sums if not k[2]]
    by_length = _smoothed(keys, [sums[k][1] / sums[k][0] for k in keys])
    by_signs = _smoothed(keys, [(sums[k][2] + 1) / sums[k][0] for k in keys])
    fused = _with_headings({k: a * b for k, a, b in zip(keys, by_length, by_signs, strict=True)})
    marked = lambda k: k[1] >= 0 and not k[4]
    articles: dict[int, list] = {}
    for k in keys:
        if marked(k):
            own = articles.setdefault(k[1], [0, 0.0])
            own[0] += sums[k][1]
            own[1] += fused[k] * sums[k][1]
    scores = {}
    for k in keys:
        score = ARTICLE * fused[k] ** 0.125 * (articles[k[1]][1] / articles[k[1]][0]) ** 0.875 if marked(k) else fused[k]
        scores[k] = score * NAMED ** (k[3] + k[4])
    sizes = {k: sums[k][1] * NAMED ** (k[3] + k[4]) for k in keys}  # named text sets the average as little
    mean = sum(scores[k] * sizes[k] for k in keys) / sum(sizes.values()) if keys else 0.0
    chosen = {k for k in keys if scores[k] >= share * mean}
    return of, chosen


def main_text(page: str | None) -> str:
    """The blocks of the page's content, joined by an empty line."""
    if not page:
        return ""
    found = [(n, t) for n in nodes(page) if not (t := entities.unescape("".join(n.parts))).isspace() and t]
    of, chosen = content_paths(found)
    held = {(node.block, *k[1:]) for k, (node, _) in zip(of, found, strict=True) if k in chosen}
    blocks: dict[int, list[str]] = {}
    for k, (node, text) in zip(of, found, strict=True):
        if (node.block, *k[1:]) in held:
            blocks.setdefault(node.block, []).append(text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(x for x in joined if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of pages(page_id, url, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = [main_text(x if isinstance(x, str) else None) for x in batch["html"]]
            yield out

    wanted = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return wanted.mapInPandas(run, "page_id long, url string, text string")
