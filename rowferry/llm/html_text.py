"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, each
container's points are discounted by its share of linked text, and the best
container is kept together with siblings that score well beside it. Elements
that are never article text (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are cut before scoring.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from rowferry.llm.words import per_group

_TAG = re.compile(
    r"<!--(.*?)(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S)
_ATTR = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
_DROP = frozenset(
    "nav footer aside form button select option input dialog menu svg math canvas audio video object applet map "
    "fieldset head".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: A name is unwanted if each of its parts is one of the first kind or of the second, and some part of the first.
_UNWANTED = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|comments?|commentlist|"
    r"disqus|replies|sidebar|menu|navbar|navigation|nav|breadcrumbs?|share|sharing|social|related|footer|"
    r"masthead|popup|modal|overlay|subscribe|newsletter|signup|login|search|widget|complementary|contentinfo|"
    r"pagination|pager|skip|toolbar", re.I)
_PLAIN = frozenset(
    "area articles aside bar block bottom box button buttons card col column container content footer form global "
    "header icons inner item items left link links list main page panel policy post posts primary rail right secondary "
    "section side site slot stories thread top unit wrap wrapper".split())
_HEADERS = frozenset(("site-header", "page-header", "side-bar"))
_SEMANTIC = frozenset(("article", "main"))
#: A block counts as a paragraph from this many characters.
PARAGRAPH = 25
#: Siblings of the best container join it from this share of its points.
SIBLING = 0.2
#: The share of its points that each element hands on to the one around it.
HANDED = 0.5


#: Open elements that later tags may close, with the elements that hide them: p, li, dt or dd, tr, td or th.
_SCOPES = (("p",), ("td", "th", "button", "object")), (("li",), ("ul", "ol", "menu")), (("dt", "dd"), ("dl",)), (
    ("tr",), ("table",)), (("td", "th"), ("tr", "table"))
_SHUTS = {"li": 1, "dt": 2, "dd": 2, "tr": 3, "td": 4, "th": 4}


class _Node:
    __slots__ = ("tag", "parent", "drop", "marked", "semantic", "near", "points", "chars", "linked", "links", "direct",
                 "raw", "main")

    def __init__(self, tag, parent, drop, marked=False):
        self.tag, self.parent, self.drop, self.marked = tag, parent, drop, marked
        self.semantic = tag in _SEMANTIC or (parent is not None and parent.semantic)
        self.points, self.chars, self.linked, self.links, self.direct = 0.0, 0, 0, 0, 0.0
        self.raw, self.main = 0.0, tag == "main"
        near = parent.near if parent is not None else (None,) * len(_SCOPES)
        self.near = tuple(self if tag in mine else None if tag in hide else old
                          for (mine, hide), old in zip(_SCOPES, near, strict=True)) if tag in _SCOPED else near


_SCOPED = frozenset(t for mine, hide in _SCOPES for t in (*mine, *hide))


def _unwanted(names: str) -> bool:
    """Whether a class, id or role says that an element is no article text, and nothing else."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        told = [_UNWANTED.fullmatch(p) is not None for p in parts]
        if name in _HEADERS or (any(told) and all(t or p in _PLAIN or p.isdigit()
                                                  for t, p in zip(told, parts, strict=True))):
            return True
    return False


def _blocks(page: str):
    """Nodes in page order and the text blocks (node, text, linked characters) between block borders."""
    root = _Node("#", None, False)
    nodes, blocks, at, link = [root], [], root, 0
    pieces: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((at, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def text(part: str):
        nonlocal linked
        if part:
            pieces.append(html.unescape(part) if "&" in part else part)
            if link:
                linked += len(part.strip())

    open_: Counter = Counter()

    def close(to: _Node):
        nonlocal at
        flush()
        while at is not to:  # each element is left once
            open_[at.tag] -= 1
            at = at.parent

    pos, end = 0, len(page)
    while pos < end:
        m = _TAG.search(page, pos)
        if m is None:
            text(page[pos:])
            break
        text(page[pos:m.start()])
        pos = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name == "a":
                link = max(0, link - 1)
            elif name not in _INLINE:
                if open_[name]:
                    node = at
                    while node.tag != name:
                        node = node.parent
                    close(node.parent)
                    link = 0
            continue
        if m[5] != ">":  # cut off inside a tag
            break
        if name in _RAW:
            stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = stop.end() if stop else end
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in _INLINE:
            if name == "a":
                link, at.links = 1, at.links + 1
            continue
        if name in _CLOSES_P and at.near[0] is not None:
            close(at.near[0].parent)
        shut = at.near[_SHUTS[name]] if name in _SHUTS else None
        if shut is not None:
            close(shut.parent)
        flush()
        link = 0
        if name in _VOID:
            continue
        attrs = m[4]
        names = " ".join(x.strip("\"'") for x in _ATTR.findall(attrs)) if attrs else ""
        drop = at.drop or name in _DROP or (name == "header" and not at.semantic)
        marked = bool(names) and name not in ("html", "body", "article", "main") and _unwanted(names)
        at = _Node(name, at, drop, marked)
        open_[name] += 1
        nodes.append(at)
        if attrs and attrs.endswith("/") and name in ("path", "g"):
            open_[name] -= 1
            at = at.parent
    flush()
    return nodes, blocks


def _points(text: str, linked: int) -> float:
    n = len(text)
    return (1 + text.count(",") + min(n / 100, 3.0)) * (1 - linked / n) if n >= PARAGRAPH else 0.0


def _drop_marked(nodes: list[_Node]) -> None:
    """Drop elements marked as unwanted, but for those around the main element or around all that scores.

    The latter stay only where no article or main element is left outside of them.
    """
    total = nodes[0].raw
    top = [n for n in nodes if n.marked and not n.drop]

    def dropped(some):
        chosen = {id(n) for n in some}
        gone = {}
        for n in nodes:  # parents come first
            gone[id(n)] = n.drop or id(n) in chosen or (n.parent is not None and gone[id(n.parent)])
        return gone

    some = [n for n in top if not n.main]
    gone = dropped(some)
    lost = sum(n.raw for n in some if n.parent is None or not gone[id(n.parent)])
    if total > 0 and total - lost <= 1e-9 * total and not any(n.tag in _SEMANTIC and not gone[id(n)] for n in nodes):
        gone = dropped([n for n in some if n.raw <= total / 2])
    for n in nodes:
        n.drop = gone[id(n)]


def main_text(page: str | None) -> str:
    """The article of one page: blocks in page order joined by an empty line; empty if there is none."""
    if not page:
        return ""
    nodes, blocks = _blocks(page)
    blocks = [b for b in blocks if not b[0].drop]
    scored = [_points(text, linked) for _, text, linked in blocks]
    for (node, _, _), points in zip(blocks, scored, strict=True):
        node.raw += points
    for node in reversed(nodes[1:]):  # children before parents
        node.parent.raw += node.raw
        node.parent.main |= node.main and not node.drop
    _drop_marked(nodes)
    kept = [i for i, b in enumerate(blocks) if not b[0].drop]
    blocks, scored = [blocks[i] for i in kept], [scored[i] for i in kept]
    if not blocks:
        return ""
    for (node, text, linked), points in zip(blocks, scored, strict=True):
        node.chars += len(text)
        node.linked += linked
        node.direct += points
        # A block inside <p> or <li> scores for what contains that element.
        up = node.parent if node.tag in ("p", "li", "pre", "td", "blockquote", "dd") and node.parent else node
        up.points += points
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.linked += node.linked
        node.parent.points += node.points * HANDED

    def value(node):
        return node.points * (1 - node.linked / node.chars) if node.chars else 0.0

    best = max((n for n in nodes if not n.drop), key=value)  # the first of equals
    if best.points == 0.0:
        # Nothing is long enough for a paragraph: a marked article, else no article.
        best = next((n for n in nodes if n.tag in _SEMANTIC and not n.drop and n.chars), None)
        if best is None:
            return ""
    whole = None
    up = best
    while up is not None:
        if up.tag in _SEMANTIC and (not up.chars or up.linked / up.chars < 0.5):
            whole = up
        up = up.parent
    keep = {id(whole or best)}
    if whole is None and best.parent is not None:
        limit = max(2.0, SIBLING * value(best))
        for n in nodes:
            if n.parent is best.parent and n is not best and not n.drop and n.chars:
                clear = n.linked / n.chars
                if value(n) * (1 if n.points else 0) >= limit or (n.direct and clear < 0.25):
                    keep.add(id(n))
                elif n.tag in ("h1", "h2", "h3") and clear < 0.5:
                    keep.add(id(n))
    inside: dict[int, bool] = {}
    for n in nodes:  # parents come first
        mine = id(n) in keep or (n.parent is not None and inside[id(n.parent)])
        if mine and n.tag in ("ul", "ol", "div", "section") and id(n) not in keep and n.chars:
            mine = not (n.linked / n.chars > 0.8 and n.linked > 0)  # a menu within the article
        inside[id(n)] = mine
    return "\n\n".join(text for node, text, _ in blocks if inside[id(node)])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Null or empty html and pages without an article give an empty text. Keys
    and urls, null ones and repeated ones included, pass through; each input
    row gives one row. Other columns are not read. Nothing is shuffled.
    """
    picked = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                          pages[html_col].cast("string").alias("html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return per_group(picked, "html", run, "page_id long, url string, text string, n_chars long")
