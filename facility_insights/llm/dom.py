"""A small block tree of an HTML page: elements that make blocks, and the text runs between them.

Inline tags only join text; an unclosed inline tag thus changes nothing. Scripts, styles and the
head leave no text. Character references are decoded, and white space in a run becomes one blank.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Elements whose content is not markup; only that of the last two is text, and none of it is article text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "xmp"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meta link q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open one of the second.
_P_ENDS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "body"}


_NONE: frozenset = frozenset()


class Node:
    """An element: its tag, class and id words, children (nodes and text runs) and number in page order."""

    __slots__ = ("tag", "words", "children", "number", "label")

    def __init__(self, tag: str, attributes: str, number: int):
        self.tag, self.children, self.number = tag, [], number
        self.words, self.label = _NONE, tag
        if attributes:
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            if named.strip():
                self.words = frozenset(w for token in named.lower().split() for w in _role_words(token))
                self.label = " ".join([tag, *sorted(found.get("class", "").split())])


def _role_words(token: str) -> list[str]:
    """Letter runs of one class or id; none if it says that something is there or is not, as in has-sidebar or ad-free."""
    words = re.findall(r"[a-z]+", token)
    return [] if STATES.intersection(words) else words


class Run:
    """Text between two block borders."""

    __slots__ = ("text", "number")
    label = "#text"
    children: tuple = ()

    def __init__(self, text: str, number: int):
        self.text, self.number = text, number


def parse(page: str | None) -> Node:
    """The page's tree under a root element; text that is blank makes no run."""
    root = Node("#root", "", 0)
    stack, parts, count, at, text = [root], [], 1, 0, page or ""

    def flush():
        nonlocal count
        if parts:
            run = "".join(parts)
            parts.clear()
            run = " ".join((html.unescape(run) if "&" in run else run).split())
            if run:
                stack[-1].children.append(Run(run, count))
                count += 1

    while at < len(text):
        m = _TOKEN.search(text, at)
        if m is None:
            parts.append(text[at:])
            break
        parts.append(text[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
                at = end.end() if end else len(text)
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if m[1]:
            open_at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if open_at:
                del stack[open_at:]
            continue
        if tag in _P_ENDS:
            _end(stack, {"p"})
        if tag in _SIBLING_ENDS:
            _end(stack, _SIBLING_ENDS[tag])
        node = Node(tag, m[3], count)
        count += 1
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    flush()
    return root


def _end(stack: list[Node], tags: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in _LIMITS:
            return


#: Elements and class or id words of what is not the article. Fixed values.
ROLE_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices "
    "comment comments disqus share sharing social newsletter subscribe related recommended popup modal".split()
)
#: Words of classes that describe a page's state, not an element's role. Fixed values.
STATES = frozenset("has have is no not non with without hide hidden show free less enabled disabled".split())
#: Elements that hold the whole page, whatever their classes say.
WHOLE = frozenset("#root html body main".split())


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element's role is not the article's; a header inside the article is the article's own."""
    if node.tag in WHOLE:
        return False
    if node.tag in ROLE_TAGS or node.tag == "header" and not inside:
        return True
    return bool(node.words) and (bool(node.words & ROLE_WORDS) or not inside and "header" in node.words)


def runs(node: Node, inside: bool = False) -> list[Run]:
    """Text runs under a node in page order, without those under boilerplate."""
    found, waiting = [], [(node, inside)]
    while waiting:
        at, within = waiting.pop()
        if isinstance(at, Run):
            found.append(at)
        elif at is node or not boilerplate(at, within):
            waiting.extend((c, within or at.tag in ("article", "main")) for c in reversed(at.children))
    return found


def mass(node) -> int:
    """Characters of text under a node, boilerplate aside."""
    return sum(len(r.text) for r in runs(node))


def article(root: Node) -> Node:
    """The article by roles alone: the heaviest article or main element, or else the whole page."""
    found, waiting = [], [root]
    while waiting:
        at = waiting.pop()
        if isinstance(at, Node) and (at is root or not boilerplate(at, False)):
            if at.tag in ("article", "main"):
                found.append(at)
            else:
                waiting.extend(at.children)
    return max(found, key=lambda n: (mass(n), -n.number), default=root)
