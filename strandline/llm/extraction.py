"""Main text of web pages: flat text blocks, their neighbours, and a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm.batches import pieces

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

#: Elements that neither show text nor hold any of the article's.
_SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "option", "button", "head", "title"}
#: Elements inside a line of text; every other tag ends a block.
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements and names that frame an article.
_FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
_FRAME_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|foot|footer|header|masthead|banner|side|sidebar|aside|widget|related|recommended|promo|sponsor(?:ed)?|ads?|advert\w*|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|signup|login|social|share|sharing|comments?|commentlist|disqus|replies|reply|search|copyright|legal|pagination|pager|tags|toolbar)(?:$|[\s_-])", re.I)
_BODY_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post|entry|story|content|main)(?:$|[\s_-])", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    tag: str
    framed: bool
    bodied: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; never fails on broken markup."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    silent, links, framed, bodied = 0, 0, 0, 0
    parts: list[str] = []
    linked: list[str] = []
    tag = "body"

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, len(text.split()), len(html.unescape(" ".join(linked)).split()), tag, framed > 0, bodied > 0))
        parts.clear(), linked.clear()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                if not silent:
                    parts.append(m[0])
                    if links:
                        linked.append(m[0])
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                links = max(0, links - 1) if m[1] else links + 1
            elif name == "br" and not silent:
                parts.append(" ")
            continue
        if name in ("script", "style") and not m[1] and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\b", re.I).search(page, at)  # their text isn't markup
            at = end.start() if end else n
        close()
        tag = name
        if m[1]:
            if any(s[0] == name for s in stack):
                while stack:
                    last, f, b = stack.pop()
                    silent -= last in _SILENT
                    framed -= f
                    bodied -= b
                    if last == name:
                        break
            links = 0
        elif name not in _VOID and not m[3].endswith("/"):
            names = " ".join(x for y in _NAMES.findall(m[3]) for x in y)
            inside = name in ("article", "main") or bool(_BODY_NAME.search(names))
            frame = (name in _FRAME or bool(_FRAME_NAME.search(names))) and name not in ("article", "main", "body", "html")
            frame = frame and not (name == "header" and bodied)  # an article's own head
            if name == "p" and stack and stack[-1][0] == "p":
                _, f, b = stack.pop()  # a paragraph ends the one before
                framed, bodied = framed - f, bodied - b
            stack.append((name, frame, inside))
            silent, framed, bodied = silent + (name in _SILENT), framed + frame, bodied + inside
    close()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "framed", "bodied", "heading", "outside")


def features(found: list[Block]) -> np.ndarray:
    """A row per block: its word count and link density, its neighbours', and where it stands."""
    words = np.array([b.words for b in found], float)
    density = np.array([min(b.linked / max(b.words, 1), 1.0) for b in found])
    pad = lambda x, fill: np.concatenate([[fill], x, [fill]])
    w, d = pad(words, 0.0), pad(density, 0.0)
    marked = any(b.bodied for b in found)
    flags = [[b.framed for b in found], [b.bodied for b in found], [b.tag in ("h1", "h2", "h3", "h4", "h5", "h6") for b in found], [marked and not b.bodied for b in found]]
    return np.column_stack([words, density, w[:-2], d[:-2], w[2:], d[2:], *np.array(flags, float)]) if found else np.zeros((0, len(FEATURES)))


#: Fixed values, marked by hand: blocks of common page layouts, in the order of FEATURES, and whether each is main text.
LABELLED = [
    # menus, breadcrumbs and link lists
    ((1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1), 0), ((2, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1), 0), ((6, 1.0, 2, 1.0, 9, 0.1, 1, 0, 0, 0), 0),
    ((1, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), 0), ((3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), 0), ((9, 0.9, 3, 1.0, 40, 0.0, 0, 0, 0, 0), 0),
    ((4, 1.0, 3, 1.0, 5, 1.0, 0, 0, 0, 1), 0), ((12, 0.8, 7, 1.0, 11, 0.9, 1, 0, 0, 0), 0), ((5, 0.6, 9, 0.9, 4, 0.7, 0, 0, 0, 0), 0),
    # adverts, notices, forms, footers and comments, long ones too
    ((8, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 1), 0), ((25, 0.0, 6, 1.0, 12, 0.0, 1, 0, 0, 1), 0), ((40, 0.1, 60, 0.0, 8, 0.4, 1, 0, 0, 0), 0),
    ((14, 0.2, 80, 0.0, 0, 0.0, 1, 0, 0, 1), 0), ((9, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 1), 0), ((55, 0.0, 30, 0.0, 45, 0.0, 1, 1, 0, 0), 0),
    ((20, 0.0, 90, 0.0, 18, 0.0, 1, 1, 0, 0), 0), ((3, 0.0, 55, 0.0, 30, 0.0, 1, 1, 1, 0), 0), ((70, 0.0, 1, 0.0, 35, 0.0, 1, 1, 0, 0), 0),
    ((30, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0, 1), 0), ((60, 0.0, 12, 0.0, 1, 0.0, 0, 0, 0, 1), 0), ((2, 0.0, 0, 0.0, 1, 0.0, 0, 0, 1, 1), 0), ((5, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0, 0), 0),
    ((3, 0.0, 1, 0.0, 2, 0.0, 0, 0, 0, 0), 0), ((6, 0.0, 120, 0.0, 0, 0.0, 1, 0, 0, 0), 0), ((90, 0.0, 50, 0.0, 20, 0.0, 1, 0, 0, 0), 0), ((4, 0.0, 6, 0.8, 2, 1.0, 0, 0, 1, 0), 0),
    # beside a marked article, and link lists before one that isn't marked
    ((50, 0.0, 40, 0.0, 60, 0.0, 0, 0, 0, 1), 0), ((12, 0.0, 60, 0.0, 30, 0.0, 0, 0, 0, 1), 0), ((30, 0.0, 50, 0.0, 30, 0.1, 0, 0, 1, 1), 0), ((10, 0.9, 12, 0.9, 60, 0.0, 0, 0, 0, 0), 0),
    ((8, 0.7, 10, 0.8, 50, 0.0, 0, 0, 0, 0), 0), ((20, 0.6, 60, 0.0, 30, 0.6, 0, 0, 0, 0), 0), ((15, 1.0, 80, 0.0, 0, 0.0, 0, 0, 0, 0), 0), ((6, 1.0, 70, 0.0, 6, 1.0, 0, 0, 0, 0), 0),
    # lists of links inside an article's frame
    ((7, 1.0, 5, 1.0, 8, 1.0, 1, 1, 0, 0), 0), ((2, 1.0, 60, 0.0, 2, 1.0, 1, 1, 0, 0), 0),
    # paragraphs and headings of an article, short ones and ones with links too
    ((60, 0.0, 8, 0.0, 45, 0.0, 0, 1, 0, 0), 1), ((120, 0.05, 60, 0.0, 80, 0.0, 0, 1, 0, 0), 1), ((1, 0.0, 40, 0.0, 1, 0.0, 0, 1, 0, 0), 1),
    ((1, 0.0, 1, 0.0, 60, 0.0, 0, 1, 0, 0), 1), ((9, 0.0, 8, 0.0, 30, 0.0, 0, 1, 1, 0), 1), ((3, 0.0, 70, 0.0, 20, 0.0, 0, 1, 1, 0), 1),
    ((30, 0.3, 45, 0.0, 60, 0.1, 0, 1, 0, 0), 1), ((14, 0.0, 12, 0.0, 16, 0.0, 0, 1, 0, 0), 1), ((5, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0, 0), 1), ((5, 1.0, 50, 0.0, 40, 0.0, 0, 1, 0, 0), 1),
    ((2, 1.0, 60, 0.0, 55, 0.0, 0, 1, 1, 0), 1), ((25, 0.8, 30, 0.0, 6, 0.5, 0, 1, 0, 0), 1), ((4, 0.0, 8, 0.0, 12, 0.0, 0, 1, 0, 0), 1), ((200, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0), 1),
    # pages without a marked article
    ((50, 0.0, 9, 0.9, 60, 0.0, 0, 0, 0, 0), 1), ((70, 0.1, 3, 1.0, 45, 0.0, 0, 0, 0, 0), 1), ((35, 0.2, 60, 0.0, 4, 1.0, 0, 0, 0, 0), 1), ((28, 0.0, 2, 1.0, 33, 0.0, 0, 0, 0, 0), 1),
    ((45, 0.0, 10, 0.0, 60, 0.0, 0, 0, 0, 0), 1), ((80, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 0), 1), ((25, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 0), 1), ((18, 0.05, 30, 0.0, 5, 0.0, 0, 0, 0, 0), 1),
    ((8, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 0), 1), ((6, 0.0, 55, 0.0, 48, 0.0, 0, 0, 1, 0), 1), ((7, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0), 1), ((12, 0.0, 40, 0.0, 35, 0.0, 0, 0, 0, 0), 1), ((150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0), 1),
]


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    main: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> Node:
    """A classification tree: at each node the cut with the lowest Gini impurity, the first on ties."""
    node = Node(main=bool(y.mean() >= 0.5)) if len(y) else Node()
    if depth == 0 or len(np.unique(y)) < 2:
        return node
    best = (y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] <= cut]
            high = y[x[:, f] > cut]
            cost = low.mean() * (1 - low.mean()) * len(low) + high.mean() * (1 - high.mean()) * len(high)
            if cost < best[0] - 1e-12:
                best = (cost, f, float(cut))
    if best[1] < 0:
        return node
    _, node.feature, node.cut = best
    side = x[:, node.feature] <= node.cut
    node.low, node.high = grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1)
    return node


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.main)
    return np.where(x[:, node.feature] <= node.cut, decide(node.low, x), decide(node.high, x))


def default_tree() -> Node:
    return grow(np.array([r for r, _ in LABELLED], float), np.array([y for _, y in LABELLED], float))


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    keep = decide(tree, features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """Main text of each page: the blocks that the tree takes as article text, in page order.

    A block is the text between two tags that aren't inline, with references decoded and white space turned
    into single spaces.  The tree sees its word count, link density, the same of both neighbours, and whether
    it stands in a frame (menu, footer, form, comments and so on), in a marked article or beside one.  Null or
    empty pages give an empty text; unclosed tags and comments end with the page.  Work is linear in
    the length of a page; rows are independent.  Returns page_id, url, text and n_chars.
    """
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            texts = [main_text(x or "", tree) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
