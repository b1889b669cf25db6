"""Main text of HTML pages by tree scoring.

A page is read into a light tree.  Each paragraph passes points, for its
length and its commas, to its parent, and smaller shares to the ancestors
above; the points of a container are discounted by its link density.  The
best container is kept, with those siblings that score well or read like
prose.  Parts that are never content (navigation, forms, adverts, comments by
readers and the like) are cut before scoring.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
                   " strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style textarea title iframe noembed noframes xmp noscript template nav footer aside form button select"
                  " option input dialog menu svg canvas object embed audio video map math".split())
PARAGRAPHS = frozenset("p pre td blockquote dd li".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
                   " header hgroup hr main menu nav ol p pre section table ul li dd dt tr td th".split())
#: An opened element that ends an open one of these, not looking past the given scopes.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table select body article section div main".split())
# Words in class, id or role that mark parts which are not the article.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login"
    r"|nav\w*|menu|breadcrumbs?|toolbar|pager|pagination|masthead|site-?header|page-?header|header|footer|site-?footer|sidebar|side|aside|widget\w*|related|recommend\w*"
    r"|share|sharing|social|comments?|commentlist|respond|replies|reply|disqus|rating|tags|skip\w*|search|contentinfo|complementary|navigation)(?=$|[\s_-])",
    re.IGNORECASE)
#: A part so marked is cut even if it holds an article, as lists of comments and teasers do.
FIRM = re.compile(r"comment|repl(?:y|ies)|respond|related|recommend|disqus|teaser|aside|widget", re.IGNORECASE)
KEEP = frozenset(("article", "main", "body", "html"))
#: Within an article these words name its own parts: its head everywhere, the others on a block of text.
HEAD = re.compile(r"(?:^|[\s_-])(?:masthead|page-?header|header)(?=$|[\s_-])", re.IGNORECASE)
SOFT = re.compile(r"(?:^|[\s_-])(?:banner|notice|alert|side|tags|rating|search|skip\w*)(?=$|[\s_-])", re.IGNORECASE)
TEXT = frozenset("p pre h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote figcaption".split())

_PIECE = re.compile(
    r"<!--(?:.*?)(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]++|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

PER_CHARS = 100
MOST_FOR_LENGTH = 3.0
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "firm", "inside", "score", "chars", "linked", "commas", "blocks")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False, firm: bool = False):
        self.tag, self.parent, self.noise, self.firm = tag, parent, noise, firm
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.parts: list[Node | str] = []
        self.score = 0.0


def _is_noise(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never content: by its name, as hidden, or, if it is a block, by a word in its class, id or role.

    ``inside`` an article, words for its own parts do not count."""
    if tag in NEVER:
        return True
    if not attributes or tag in KEEP:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True
        if name in ("class", "id", "role") and tag not in INLINE:
            if inside:
                value = HEAD.sub(" ", value)
                value = SOFT.sub(" ", value) if tag in TEXT else value
            if NOISE.search(value):
                return True
    return False


def parse(html: str) -> Node:
    """The tree of a page; unclosed, stray and misnested tags are tolerated."""
    top = here = Node("html", None)
    at, lower = 0, None
    for m in _PIECE.finditer(html):
        if m.start() < at:
            continue
        if m.start() > at:
            here.parts.append(unescape(html[at:m.start()]))
        at = m.end()
        if m[1] is not None:
            here.parts.append(m[1])
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            node = here
            while node is not top and node.tag != tag:
                node = node.parent
            if node is not top:
                here = node.parent
            elif tag in ("p", "br"):
                here.parts.append(Node(tag, here))
            continue
        if tag in ENDS_P:
            node = here
            while node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in ENDS:
            node = here
            while node is not top and node.tag not in ENDS[tag] and node.tag not in SCOPES:
                node = node.parent
            if node.tag in ENDS[tag] and node.parent is not None:
                here = node.parent
                if tag == "tr" and here.tag == "tr":
                    here = here.parent
        if tag in RAW:
            lower = lower if lower is not None else html.lower()
            end = lower.find("</" + tag, at)
            at = len(html) if end < 0 else (lower.find(">", end) + 1 or len(html))
            continue
        noise = _is_noise(tag, m[4], here.inside)
        node = Node(tag, here, noise, noise and (tag in NEVER or FIRM.search(m[4]) is not None))
        if tag in ("article", "main") and not noise:
            holds = here  # a page wrapper called "with-sidebar" is no sidebar
            while holds is not None and not holds.firm:
                holds.noise, holds = False, holds.parent
        here.parts.append(node)
        if tag not in VOID and not m[4].endswith("/"):
            here = node
    if at < len(html):
        here.parts.append(unescape(html[at:]))
    return top


def _walk(top: Node):
    """All nodes that are not noise, each before its children, without recursion."""
    todo = [top]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.noise]


def _measure(nodes: list[Node]) -> None:
    """Characters, characters in links, commas and block children of each node, from the leaves up."""
    for node in reversed(nodes):
        node.chars = node.linked = node.commas = 0
        node.blocks = False
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(x.strip())
                node.commas += sum(x.count(c) for c in ",،、，")
            elif not x.noise:
                node.chars += x.chars
                node.linked += x.linked
                node.commas += x.commas
                node.blocks |= x.blocks or (x.tag not in INLINE and x.tag not in VOID)
        if node.tag == "a":
            node.linked = node.chars


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def best_nodes(top: Node) -> list[Node]:
    """The best container with the siblings that belong to it, in page order."""
    nodes = list(_walk(top))
    _measure(nodes)
    scored = []
    for node in nodes:
        if not node.chars or not (node.tag in PARAGRAPHS or (node.tag in CONTAINERS and not node.blocks)):
            continue
        points = (1 + node.commas + min(node.chars / PER_CHARS, MOST_FOR_LENGTH)) * (1 - _density(node))
        above, level = node.parent, 1
        if node.tag in CONTAINERS and node.tag not in PARAGRAPHS:
            node.score += points
        while above is not None and level <= 4:
            above.score += points / (1 if level == 1 else 2 if level == 2 else 3 * level)
            above, level = above.parent, level + 1
    scored = [(n.score * (1 - _density(n)), i, n) for i, n in enumerate(nodes) if n.score > 0 and n.tag in CONTAINERS]
    marked = [x for x in scored if x[2].tag in ("article", "main")]
    if not scored:
        return [n for n in nodes if n.tag in ("article", "main") and n.chars][:1] or [top]
    score, _, best = max(marked or scored, key=lambda x: (x[0], -x[1]))
    if best.parent is None:
        return [best]
    out = []
    for x in best.parent.parts:
        if not isinstance(x, Node) or x.noise:
            continue
        good = x.score * (1 - _density(x)) >= max(1.0, SIBLING_SHARE * score) and x.tag in CONTAINERS
        # Beside the best part of a page without an article lie its headings, lists and short paragraphs too.
        prose = (x.tag == "p" and x.chars > 80 if marked else x.tag in TEXT and x.chars > 0) and _density(x) < 0.25
        if x is best or good or prose or (marked and x.tag == best.tag and x.chars):
            out.append(x)
    return out


def text_of(nodes: list[Node]) -> str:
    """Blocks in page order, white space within a block as one space, blocks joined by one space."""
    pieces: list[str] = []
    for top in nodes:
        todo: list[Node | str] = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                pieces.append(x)
            elif not x.noise or x is top:
                if x.tag in INLINE:
                    todo += reversed(x.parts)
                else:
                    pieces.append(" ")
                    todo.append(" ")
                    todo += reversed(x.parts)
        pieces.append(" ")
    return " ".join("".join(pieces).split())


def main_text(html: str | None) -> str:
    return text_of(best_nodes(parse(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages(page_id, url, html, ...)``.

    A null or empty html, or one without text outside cut parts, gives an
    empty text.  Html without any container is read as a whole.  Repeated
    rows are returned each; null keys are passed through; other columns are
    ignored.  An empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
