"""HTML extraction by tag-path ratios (operator 10).

A page's text stands in blocks, each at the end of a path of tags from the
root. Per path, text length and punctuation are summed and divided by the
number of blocks, which gives two ratios. Paths are smoothed with their
relatives (the share of the path that they have in common is the weight), the
two ratios are fused by their product, and paths above the page's threshold are
content. Text within links doesn't count for a path, but in an article it does.

What the ratios select says where the article is, and of the article every
block stays. Where a page marks its articles, an article is content as a whole
if its best path is. Elsewhere the content's root is the deepest element that
holds most of the selected text, and all within it is content: list items,
cells and captions too. In a page without such an element, what lies between
selected blocks and isn't mostly links is content.

What HTML itself marks as something else (navigation, forms, asides, and blocks
that a word of their class or id names as such) isn't content; a class or id
alone never takes out an article, nor what holds most of the page's text.
Elements and paths are numbers with links to their parents, so that time is
linear in a page's length however deep it is.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import text_or_empty

#: Share of the mean fused ratio, weighted by text, from which a path is content.
THRESHOLD = 0.2
#: Share of the page's text from which a class or id doesn't make an element something else.
MOST = 0.5
#: Share of the selected text that the content's root holds.
ROOT = 0.75

# Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp annotation annotation-xml select datalist desc".split())
_TO_THE_END = frozenset("script style".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics object svg g path circle ellipse rect line polyline polygon text tspan textpath defs use symbol marker mask pattern clippath lineargradient radialgradient stop filter image animate".split())
_BESIDE = frozenset("nav header footer aside form menu dialog button head".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that hold one block as a rule.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption figcaption pre".split())
#: Elements that end an open one of the same or a related kind.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("table ul ol dl div article section main body td th blockquote".split())
#: Classes and ids, as whole words, that name what is beside the article; tags mark articles, too ("tag-python").
_NAMES = re.compile(
    r"(?:(?:site|global|main|page|primary|secondary|left|right|top|bottom|cookie|post|entry)[_-])?"
    r"(?:(header)|ads?|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|disclaimer|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pager|pagination|popup|promos?|promotions?|promoted|recommend\w*|related|replies|respond|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|subscription|tags|toolbar|topbar|widget)"
    r"(?:[_-](?:area|bar|block|box|buttons?|cloud|container|form|icons|inner|items?|links?|list|menu|notice|panel|posts|section|signup|slot|unit|widget|wrap|wrapper|\d+))*|tag[_-](?:list|links|cloud)",
    re.I,
)
_OPEN = re.compile(r"<(?:!--|[!?/a-zA-Z])")
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What stands between a tag's name and its end, with ends in quotes passed over.
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_NAMED = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?:[\s=>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


def tags(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """The tags of a page, in time linear in its length: start, end, name in lower case (empty for comments and the like), whether it closes, the rest.

    What raw elements hold is part of their tag. Without a ``>`` after it a
    ``<`` is text. Quotes that don't close are no quotes, nor are any after them.
    """
    at, quoted = 0, True
    unclosed: set[str] = set()
    while m := _OPEN.search(html, at):
        start = m.start()
        name = None
        if m[0] == "<!--":
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
        else:
            name = _NAME.match(html, start + 1)
            from_ = name.end() if name else start + 1
            end = _REST.match(html, from_).end() if name and quoted else -1
            if end < 0 or end == len(html):
                quoted = quoted and not name
                end = html.find(">", from_)
                if end < 0:
                    return
            at = end + 1
        if not name:
            yield start, at, "", False, ""
            continue
        tag, closing, rest = name[2].lower(), bool(name[1]), html[from_:end]
        if tag in _RAW and tag not in unclosed and not closing and not rest.endswith("/"):
            close = _closing(tag).search(html, at)
            if close:
                at = close.end()
            elif tag in _TO_THE_END:
                at = len(html)
            else:
                unclosed.add(tag)
        yield start, at, tag, closing, rest


@lru_cache(64)
def _closing(tag: str):
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


@dataclass
class Page:
    """A page's blocks in order, and its elements and paths: lists by number, whose members know their parents (-1: none)."""

    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters within links
    beside: list[bool] = field(default_factory=list)
    element: list[int] = field(default_factory=list)  # of each block
    parent: list[int] = field(default_factory=list)  # of each element
    path: list[int] = field(default_factory=list)  # of each element
    tag: list[str] = field(default_factory=list)  # of each element
    above: list[int] = field(default_factory=list)  # of each path
    depth: list[int] = field(default_factory=list)  # of each path


def named(names: str):
    """The word of a class or id that names what is beside the article, as a match, or None."""
    return next(filter(None, map(_NAMES.fullmatch, names.split())), None)


def blocks(html: str) -> Page:
    page = Page()
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, bool, int, int]] = []  # tag, beside the article, element, number if named as beside it
    opened: Counter[str] = Counter()
    marks: list[list] = []  # of elements named so: text, whether an article is around and within it, the mark around it
    block_marks: list[int] = []  # the innermost mark of each block, or -1
    within: list[int] = []
    articles = 0
    parts: list[str] = []
    linked = links = 0
    at, beside = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                page.texts.append(text)
                page.linked.append(linked)
                page.beside.append(beside > 0)
                page.element.append(stack[-1][2] if stack else -1)
                block_marks.append(within[-1] if within else -1)
                if within:
                    marks[within[-1]][0] += len(text)
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal beside
        while len(stack) > to:
            tag, off, _, number = stack.pop()
            opened[tag] -= 1
            beside -= off
            if number >= 0:
                within.pop()

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece)

    for start, end, tag, closing, rest in tags(html):
        text(html[at:start])
        at = end
        if not tag or tag in _RAW:
            continue
        if tag in _INLINE or tag == "br":
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if tag in _VOID:
            continue
        links = 0
        if closing:
            if opened[tag]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
            continue
        for others in ((("p",),) if tag in _CLOSES_P else ()) + ((_ENDS[tag],) if tag in _ENDS else ()):
            if any(opened[other] for other in others):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in others:
                        pop(i)
                    elif stack[i][0] in _SCOPE and stack[i][0] not in others:
                        break
        names = " ".join(filter(None, (x for found in _NAMED.findall(rest) for x in found))) if rest else ""
        # an article may have a header of its own: its heading is the article's
        inside = opened["article"] + opened["main"] > 0
        if tag in ("article", "main"):
            articles += 1
            if within:
                marks[within[-1]][2] = True
        name = named(names) if names and tag not in ("html", "body", "article", "main") else None
        off = (tag in _BESIDE and not (tag == "header" and inside)) or bool(rest and _HIDDEN.search(rest))
        number = -1
        if name and not (name[1] and (inside or re.fullmatch("h[1-6]", tag))):
            number = len(marks)
            marks.append([0, inside, False, within[-1] if within else -1])
            within.append(number)
        around = stack[-1][2] if stack else -1
        step = (page.path[around] if around >= 0 else -1, f"{tag}.{names}" if names and tag in ("div", "section", "td", "ul") else tag)
        if step not in paths:
            paths[step] = len(page.above)
            page.above.append(step[0])
            page.depth.append(page.depth[step[0]] + 1 if step[0] >= 0 else 1)
        page.path.append(paths[step])
        page.parent.append(around)
        page.tag.append(tag)
        stack.append((tag, off, len(page.parent) - 1, number))
        opened[tag] += 1
        beside += off
    text(html[at:])
    flush()
    # a name doesn't count around an article, nor on what holds most of the text where no article is marked outside of it
    whole = sum(len(x) for x, off in zip(page.texts, page.beside) if not off)
    for n, _, around, outer in reversed(marks):
        if outer >= 0:
            marks[outer][0] += n
            marks[outer][2] |= around
    off = []
    for n, inner, around, outer in marks:
        off.append((outer >= 0 and off[outer]) or not (around or (n > MOST * whole and (inner or not articles))))
    page.beside = [x or (mark >= 0 and off[mark]) for x, mark in zip(page.beside, block_marks)]
    return page


def fused_ratios(page: Page, kept: list[int], article: list[int]) -> tuple[dict[int, float], dict[int, float]]:
    """Each path's fused ratio, and its text, from the blocks ``kept``; -1 is the path of what stands in no element."""
    path_of = lambda k: page.path[page.element[k]] if page.element[k] >= 0 else -1
    sums: dict[int, list[float]] = {}
    for k in kept:
        own = sums.setdefault(path_of(k), [0.0, 0.0, 0.0])
        own[0] += 1
        own[1] += len(page.texts[k]) - (0 if article[k] >= 0 else page.linked[k])
        own[2] += len(_PUNCTUATION.findall(page.texts[k]))
    above = {p: page.above[p] if p >= 0 else -2 for p in sums}

    def smoothed(ratio: dict[int, float]) -> dict[int, float]:
        """Averaged with the best sibling's and the parent's, weighted by the share of the path in common; headings and last lines need what they gain."""
        best: dict[int, list[tuple[float, int]]] = {}  # the two best paths of each parent
        for p, x in ratio.items():
            best[above[p]] = sorted([*best.get(above[p], []), (x, p)], reverse=True)[:2]
        out = {}
        for p, x in ratio.items():
            depth = page.depth[p] if p >= 0 else 1
            shared, total, weight = (depth - 1) / depth, x, 1.0
            sibling = [y for y, q in best[above[p]] if q != p]
            if sibling:
                total, weight = total + shared * sibling[0], weight + shared
            if above[p] in ratio:
                total, weight = total + shared * ratio[above[p]], weight + shared
            out[p] = total / weight
        return out

    length, marks = smoothed({p: n / k for p, (k, n, _) in sums.items()}), smoothed({p: n / k for p, (k, _, n) in sums.items()})
    return {p: log1p(length[p]) * log1p(1 + marks[p]) for p in sums}, {p: n for p, (_, n, _) in sums.items()}


def outermost(page: Page, mark: str) -> list[int]:
    """Of each element, the outermost element of this tag around it or itself, or -1."""
    out: list[int] = []
    for k, up in enumerate(page.parent):
        out.append(out[up] if up >= 0 and out[up] >= 0 else k if page.tag[k] == mark else -1)
    return out


def root_of(page: Page, chosen: list[int]) -> int:
    """The deepest element that holds ``ROOT`` of the text of the blocks ``chosen``; -1 if only the body does."""
    held = [0] * len(page.parent)
    for k in chosen:
        if page.element[k] >= 0:
            held[page.element[k]] += len(page.texts[k])
    for k in range(len(held) - 1, -1, -1):
        if page.parent[k] >= 0:
            held[page.parent[k]] += held[k]
    most = ROOT * sum(len(page.texts[k]) for k in chosen)
    # of elements that hold so much, each is within the one before it
    full = [k for k, n in enumerate(held) if n >= most and page.tag[k] not in ("html", "body")]
    return full[-1] if full else -1


def content(html: str, threshold: float = THRESHOLD) -> list[str]:
    """The texts of a page's content blocks, in page order."""
    page = blocks(html)
    kept = [k for k, off in enumerate(page.beside) if not off]
    if not kept:
        return []
    of = lambda roots, k: roots[page.element[k]] if page.element[k] >= 0 else -1
    marked = {mark: outermost(page, mark) for mark in ("article", "main")}
    article = [max(of(marked["article"], k), of(marked["main"], k)) for k in range(len(page.texts))]
    fused, sums = fused_ratios(page, kept, article)
    whole = sum(sums.values()) or 1.0
    least = threshold * sum(fused[p] * n for p, n in sums.items()) / whole
    passes = lambda k: fused[page.path[page.element[k]] if page.element[k] >= 0 else -1] >= least
    # where a page says what its articles are, its ratios say which of them are content; of these every block stays
    for roots in marked.values():
        good = {of(roots, k) for k in kept if passes(k)} - {-1}
        if good:
            return [page.texts[k] for k in kept if of(roots, k) in good]
    chosen = [k for k in kept if passes(k)]
    if not chosen:
        return []
    root = root_of(page, chosen)
    if root < 0:
        first, last = chosen[0], chosen[-1]
        return [page.texts[k] for k in kept if passes(k) or (first < k < last and 2 * page.linked[k] <= len(page.texts[k]))]
    inside = [False] * len(page.parent)
    for k, up in enumerate(page.parent):
        inside[k] = k == root or (up >= 0 and inside[up])
    # a selected block alone is no root: its element's parent is
    if page.tag[root] in _LEAVES and page.parent[root] >= 0 and page.tag[page.parent[root]] not in ("html", "body"):
        up = page.parent[root]
        for k, over in enumerate(page.parent):
            inside[k] = k == up or (over >= 0 and inside[over])
    return [page.texts[k] for k in kept if passes(k) or (page.element[k] >= 0 and inside[page.element[k]])]


def extract(pages: DataFrame, html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``text`` (content blocks joined by line feeds, empty if none) and ``n_chars``.

    Null and empty pages have the empty text. Rows are independent; repeated
    rows give equal results and an empty table an empty one. Columns named
    ``text`` and ``n_chars`` are replaced; whole pages are read, however long.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(["\n".join(content(page, threshold)) for page in batch], dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    rows = pages.drop("text", "n_chars").withColumn("text", F.pandas_udf(run, "string").asNondeterministic()(text_or_empty(html)))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
