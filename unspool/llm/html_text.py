"""Main text of web pages by tag-path ratios.

Every text block has a path of tags from the root. Over a page, the length of text and the number
of punctuation marks are added up per path and divided by the path's blocks; the two ratios are
smoothed over the page's order and fused by a product; a path whose blocks' mean is under a
threshold is no content. The fused weights are added up over the tree, and from the root the walk
goes down as long as one child holds most of them; that gives the content region, wherever it is.
A region within an article (or main) element is widened to it. Any other is widened to its parent
as long as what that adds is mostly content by its paths; there the content paths select the
blocks, and what stands between two of them, or a heading before one, stays with them.

Markup and names are evidence beside the ratios. Elements for menus, headers, footers, sidebars and
forms, hidden ones and those whose class or id is an exact name of adverts, notices or reader
comments are cut. Any other name that speaks against an element only lowers its weight; within an
article (or main) element, where headings and sections are named by their words, it counts only
where most of the text is links, or, for names of adverts and notices, where the ratios are low.

A null or empty page, and one without content, gives an empty text. Time is linear in the length of
a page, however it is nested or broken. Repeated rows give repeated results; an empty table gives an
empty result. Columns beside `html` pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_UNQUOTED = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is never text of the page.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "canvas", "video", "audio", "annotation", "annotation-xml"}
#: Where a raw element ends; only A-Z are the same in both cases, so places are those of the page itself.
_RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in _RAW}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
_CUT = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "head", "input", "label", "fieldset"}
_CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Parts of class and id names that mark what is not the article.
_CUT_NAMES = re.compile(r"(?:^|[-_ ])(ads?|adsbygoogle|ad(?:box|slot|unit|wrap\w*)|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|notification\w*|alert|newsletter|subscribe|signup|login|sidebar|side|widget\w*|menu\w*|nav\w*|breadcrumbs?|pagination|pager|footer|footnav|masthead|topbar|header|comments?|commentlist|responses|replies|reply|respond|disqus|discussion|share|sharing|social|related|recommend\w*|popup|modal|overlay|toolbar|skip\w*|search\w*|tags|byline-share|copyright|legal|disclaimer|feedback)(?=$|[-_ ])", re.I)
#: Names that nothing but reader comments has, and names of adverts and notices.
_COMMENT_NAMES = re.compile(r"disqus[-_]thread|comment-?list|comments-area|comment-respond|comments-section|reader-comments|user-comments", re.I)
_COMMENTS = re.compile(r"comments?|replies|responses|respond", re.I)
_NOTICE_NAMES = re.compile(r"ads?|adsbygoogle|ad-?(?:box|slot|unit|wrap\w*|container)|advert\w*|sponsored|promo|cookies?(?:-\w+)*|gdpr(?:-\w+)*|consent(?:-\w+)*|newsletter(?:-\w+)*", re.I)
#: Elements that names say something of within an article.
_NAMED = {"div", "ul", "ol", "dl", "table", "ins"}
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_MARKS = re.compile(r"[.,;:!?]")
#: What an element that opens may close, and within which elements it looks for it.
_SCOPES = {"li": "item", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell"}
_ENDS = {"ul": ("item",), "ol": ("item",), "menu": ("item",), "dl": ("term",), "table": ("row", "cell"), "tr": ("cell",)}
_PARA_ENDS = {"div", "section", "article", "main", "body", "td", "th", "li", "blockquote", "ul", "ol", "table"}
#: What a name that speaks against an element leaves of its weight, and what an article (or main) element adds to its own.
WEAK, ARTICLE = 0.2, 5.0


class _Node:
    """An open or closed element. para, item, term, row, cell: the open element that such a one would close."""

    __slots__ = ("tag", "parent", "path", "cut", "weak", "links", "block", "region", "suspect", "notice", "para", "item", "term", "row", "cell", "weight", "text", "content", "linked", "heavy")

    def __init__(self, tag: str, parent: _Node | None, path: int, cut: bool, weak: bool):
        self.tag, self.parent, self.path = tag, parent, path
        self.cut, self.weak = cut, weak or (parent is not None and parent.weak)
        self.links = tag == "a" or (parent is not None and parent.links)
        self.block = self if parent is None or tag in _BLOCK else parent.block
        self.region = self if tag in ("article", "main") else parent.region if parent else None
        #: The outermost element around that a name speaks against, and whether it is an advert's or notice's.
        self.suspect: _Node | None = parent.suspect if parent else None
        self.notice = False
        for scope in ("para", "item", "term", "row", "cell"):
            setattr(self, scope, getattr(parent, scope) if parent else None)
        for scope in _ENDS.get(tag, ()):
            setattr(self, scope, None)
        if tag in _PARA_ENDS:
            self.para = None
        elif tag == "p" or tag in _HEADING:
            self.para = self
        if tag in _SCOPES:
            setattr(self, _SCOPES[tag], self)
        #: Sums over the element: weight, characters that are no headings, of those on content paths, within links; its heaviest child.
        self.weight = self.text = self.content = self.linked = 0.0
        self.heavy: _Node | None = None


def _judge(tag: str, attrs: str, in_region: bool) -> tuple[bool, bool]:
    """Whether an element is cut by its markup, and whether a name speaks against it."""
    if tag in _CUT or (tag == "header" and not in_region):
        return True, False
    weak = False
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            value = _CAMEL.sub("-", value)
            words = value.split()
            if tag == "article" and re.search(r"(?:^|[-_ ])(?:comments?|reply|ads?|related|promo)(?=$|[-_ ])", value, re.I):
                return True, False
            if tag in _NAMED and any(_COMMENT_NAMES.fullmatch(x) or (name == "class" and x.lower() == "comments") for x in words):
                return True, False
            if not in_region and tag not in ("html", "body", "article", "main"):
                if any(_NOTICE_NAMES.fullmatch(x) or _COMMENTS.fullmatch(x) for x in words):
                    return True, False
                weak = weak or bool(_CUT_NAMES.search(value))
        elif name == "role" and value.lower() in _CUT_ROLES:
            return True, False
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True, False
    return False, weak


def _suspicion(attrs: str) -> tuple[bool, bool]:
    """Whether a class speaks against an element within an article, and whether it is an advert's or notice's."""
    classes = [_CAMEL.sub("-", next((v for v in values if v), "")) for name, *values in _ATTR.findall(attrs) if name.lower() == "class"]
    words = [x for value in classes for x in value.split() if x.lower() not in ("header", "masthead")]
    return any(_CUT_NAMES.search(x) for x in words), any(_NOTICE_NAMES.fullmatch(x) for x in words)


def _without_suspects(found: list[tuple[str, _Node, int]], low: float = 0.5) -> list[tuple[str, _Node, int]]:
    """found without the suspects that are mostly links, and the adverts and notices whose ratios are under `low` of the rest's."""
    if not any(n.suspect is not None for _, n, _ in found):
        return found
    ratio = lambda t, linked: max(0, len(t) - linked) * (1 + len(_MARKS.findall(t)))
    rest = [(len(t), ratio(t, linked)) for t, n, linked in found if n.suspect is None]
    mean = sum(a * b for a, b in rest) / max(1, sum(a for a, _ in rest))
    own: dict[int, list[tuple[int, int, float]]] = {}
    for t, n, linked in found:
        if n.suspect is not None:
            own.setdefault(id(n.suspect), []).append((len(t), linked, ratio(t, linked)))
    linked = {k for k, x in own.items() if 2 * sum(y[1] for y in x) >= sum(y[0] for y in x)}
    thin = {k for k, x in own.items() if sum(y[2] for y in x) / len(x) < low * mean}
    return [x for x in found if (s := x[1].suspect) is None or not (id(s) in linked or (s.notice and id(s) in thin))]


def _tags(page: str):
    """(begin of text, end of text, closing, name, attributes, end of tag) for each tag; name is None for what is left out and at the end. One pass."""
    place = start = 0
    end, quotes = len(page), True
    while True:
        at = page.find("<", place)
        if at < 0:
            break
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            place = end if stop < 0 else stop + 3
            yield start, at, False, None, "", place
            start = place
            continue
        m = _OPEN.match(page, at)
        if m is None:
            stop = page.find(">", at) if page[at + 1 : at + 2] in ("!", "?") else -1
            place = at + 1 if stop < 0 else stop + 1
            if stop >= 0:
                yield start, at, False, None, "", place
                start = place
            continue
        stop = first = page.find(">", m.end())
        if first < 0:
            break
        if quotes:
            # A tag ends at the first > outside quotes. Where quotes are never closed, which is found out once, the first > counts.
            stop = _UNQUOTED.match(page, m.end()).end()
            while stop < end and page[stop] != ">":
                close = page.find(page[stop], stop + 1)
                stop = _UNQUOTED.match(page, close + 1).end() if close >= 0 else end
            if stop >= end:
                quotes, stop = False, first
        place = stop + 1
        tag, attrs = m[2].lower(), page[m.end() : stop]
        if tag in _RAW and not m[1]:
            if not attrs.rstrip().endswith("/"):
                last = _RAW_END[tag].search(page, place)
                close = page.find(">", last.start()) if last else -1
                place = close + 1 if close >= 0 else end
            yield start, at, False, None, "", place
        else:
            yield start, at, bool(m[1]), tag, attrs, place
        start = place
    yield start, end, False, None, "", end


def blocks(page: str) -> tuple[list[tuple[str, _Node, int]], list[_Node]]:
    """Text, element and characters within links of each block that the markup does not cut; and all elements, parents first."""
    root = _Node("", None, 0, False, False)
    out, nodes = [], [root]
    paths: dict[tuple[int, str], int] = {}
    open_: Counter[str] = Counter()
    node, buffer, linked = root, [], 0

    def flush() -> None:
        nonlocal buffer, linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((text, node.block, linked))
            buffer, linked = [], 0

    def close(upto: _Node) -> _Node:
        """What is open once upto is closed."""
        at = node
        while at is not upto:
            open_[at.tag] -= 1
            at = at.parent
        open_[at.tag] -= 1
        return at.parent

    for begin, end, closing, tag, attrs, _ in _tags(page):
        if end > begin and not node.cut:
            buffer.append(page[begin:end])
            if node.links:
                linked += end - begin
        if tag is None:
            continue
        if tag in _BLOCK:
            flush()
        if closing:
            # A tag that closes nothing is left out without a look at what is open.
            if open_[tag] > 0:
                at = node
                while at.tag != tag:
                    at = at.parent
                node = close(at)
        elif tag == "br":
            if not node.cut:
                buffer.append(" ")
        elif tag not in _VOID:
            closes = getattr(node, _SCOPES[tag]) if tag in _SCOPES else node.para if tag in _BLOCK else None
            if closes is not None:
                node = close(closes)
            cut, weak = (True, False) if node.cut else _judge(tag, attrs, node.region is not None)
            node = _Node(tag, node, paths.setdefault((node.path, tag), len(paths) + 1), cut, weak)
            nodes.append(node)
            open_[tag] += 1
            if attrs and tag in _NAMED and node.suspect is None and node.region is not None:
                suspect, node.notice = _suspicion(attrs)
                node.suspect = node if suspect or node.notice else None
            if attrs.endswith("/") and tag not in _BLOCK:
                node = close(node)
    flush()
    return out, nodes


def _fused(found: list[tuple[str, _Node, int]], size: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """The fused, smoothed ratio of each block's path; blocks that a name speaks against are paths of their own."""
    _, of = np.unique(np.array([2 * n.path for _, n, _ in found]) + weak, return_inverse=True)
    linked = np.array([x for _, _, x in found])
    count = np.bincount(of)
    length = (np.bincount(of, np.maximum(size - linked, 0)) / count)[of]
    marks = (np.bincount(of, [len(_MARKS.findall(t)) for t, _, _ in found] * (2 * linked < size)) / count)[of]
    weights = np.exp(-0.5 * np.arange(-2, 3) ** 2.0)
    weights /= weights.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), weights, "valid")
    fused = smooth(length) * (1 + smooth(marks)) * (length > 0) * np.where(weak, WEAK, 1.0)
    # A path has the mean of its blocks, so that its blocks stay or go together, and stands for itself as much as for what is around.
    return np.sqrt((np.bincount(of, fused) / count)[of] * length * (1 + marks) * np.where(weak, WEAK, 1.0))


def main_text(page: str | None, floor: float = 0.15, held: float = 0.6) -> str:
    """The blocks of the content, joined by an empty line. floor: a path's least score as a share of the mean over all characters; held: the share of an element's weight that a child must hold for the walk to go on there."""
    found, nodes = blocks(page or "")
    found = _without_suspects(found)
    if not found:
        return ""
    size = np.array([len(t) for t, _, _ in found])
    weak = np.array([n.weak for _, n, _ in found])
    if size[weak].sum() > 0.8 * size.sum():
        # The name is that of what holds the whole page, and tells nothing.
        weak[:] = False
    score = _fused(found, size, weak)
    content = ((score >= floor * (np.average(score, weights=size) + 1e-9)) & ~weak).tolist()
    for (text, node, linked), s, good in zip(found, score.tolist(), content, strict=True):
        node.weight += (s * len(text) + 1e-9) * (ARTICLE if node.region is not None else 1.0)
        if node.tag not in _HEADING:
            node.text += len(text)
            node.content += len(text) * good
            node.linked += linked
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            up.weight, up.text, up.content, up.linked = up.weight + node.weight, up.text + node.text, up.content + node.content, up.linked + node.linked
            if up.heavy is None or node.weight >= up.heavy.weight:
                up.heavy = node
    at = nodes[0]
    while at.heavy is not None and at.heavy.weight >= held * at.weight:
        at = at.heavy
    if at.region is not None:
        inside = _below(nodes, at.region)
        return "\n\n".join(t for t, n, _ in found if n in inside)
    articles = sum(n.weight for n in nodes if n.region is n and (n.parent is None or n.parent.region is None))
    if articles >= held * nodes[0].weight:
        return "\n\n".join(t for t, n, _ in found if n.region is not None)
    while (up := at.parent) is not None:
        more, good, linked = up.text - at.text, up.content - at.content, up.linked - at.linked
        if more > 0 and (2 * good < more or 2 * linked >= more):
            break
        at = up
    inside = _below(nodes, at)
    own = [(t, n, 2 * linked < len(t) and not w, good) for (t, n, linked), good, w in zip(found, content, weak.tolist(), strict=True) if n in inside]
    kept = [plain and good for _, _, plain, good in own]
    if any(kept):
        first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
        for i in range(len(own) - 1, -1, -1):
            _, n, plain, _ = own[i]
            if plain and (first < i < last or (n.tag in _HEADING and i < first and kept[i + 1])):
                kept[i] = True
    return "\n\n".join(x[0] for x, k in zip(own, kept, strict=True) if k)


def _below(nodes: list[_Node], top: _Node) -> set[_Node]:
    """top and all elements in it; parents come first."""
    inside = {top}
    for n in nodes:
        if n.parent in inside:
            inside.add(n)
    return inside


def extract(page: Column | str) -> Column:
    """The main text of each page."""

    @F.arrow_udf("string")
    def page_text(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in pages], pa.string())

    return page_text(page)
