"""Main text of web pages by composite text density.

A page is read once into a tree (implied end tags, raw-text elements and unclosed elements as browsers
read them).  Parts that are never article text by element, role or hidden attribute (scripts, styles,
menus, headers, footers) are left out at once.  Forms, and class and id words that speak of menus, sidebars,
notices, adverts or reader comments, are evidence only: such a part goes if it is mostly links, if an
article element with much of the text lies elsewhere, or if the parts of its word together hold little
of the plain text (``judge``); and they stay if otherwise little text would be left.

Parts named as reader comments go first, whatever their size, if an article element or enough other text
stands outside of them (``drop_comments``).

Then densities decide.  Every node has its composite text density (characters per tag, adjusted by its
link characters and link tags) and the sum of its children's densities.  The node of the largest sum is
the text; the smallest density on its path up to the body is the threshold.  From the body down, every
node that reaches the threshold, and is no scrap (``SCRAP``) beside the text, gives its descendant of the
largest sum as well.  Around what is chosen,
containers below the threshold go, paragraphs, headings and lists stay unless they are mostly links; inside
it, only lists of links below the threshold go.  No element or class name makes a part text.

Blocks are joined by one newline in page order; white space inside a block becomes one space.  The time
is in proportion to the page, however deep its elements are nested.

Defined results: null and empty html give the empty text; pages without markup are one block; a page
whose text all stands outside the body's blocks keeps it; other columns are ignored.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_of, small_batches, table

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key's set ends an open element of the value, unless a barrier is met first.
CLOSES_P = BLOCK - frozenset("body html legend option summary tbody td tfoot th thead tr".split())
SCOPE = frozenset("table td th caption button object html body".split())
CLOSES_SELF = {
    "li": (("li",), frozenset(("ul", "ol", "menu"))), "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))), "option": (("option",), frozenset(("select",))),
    "tr": (("tr", "td", "th"), frozenset(("table",))), "td": (("td", "th"), frozenset(("table", "tr"))), "th": (("td", "th"), frozenset(("table", "tr"))), "a": (("a",), frozenset(SCOPE)),
}
# What is never article text.
DROPPED = frozenset(
    "script style noscript template head title iframe object embed svg math canvas audio video button select textarea input datalist dialog "
    "nav footer aside menu search noembed noframes xmp".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion "
    "menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer foot bottombar sidebar sidebars aside rail "
    "notice notices cookie cookies consent gdpr banner popup modal overlay disclaimer "
    "comment comments reply replies disqus respond discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets".split()
)
#: Those of them that speak of what readers wrote.
COMMENTS = frozenset("comment comments reply replies disqus respond discussion".split())
#: Words that say what a container has beside it, as in "with-sidebar".
BESIDE = frozenset("has with no without".split())
#: Class words such as "side-bar" or "cookieNotice" are cut at these places before they are looked up.
_CUT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_PAIRS = {("side", "bar"): "sidebar", ("top", "bar"): "topbar", ("sign", "up"): "signup", ("nav", "bar"): "navbar", ("bread", "crumbs"): "breadcrumbs", ("bread", "crumb"): "breadcrumb"}

#: Elements that hold parts of a page rather than blocks of a text.
CONTAINERS = frozenset("article aside body center dd details div dl fieldset figure footer form header hgroup html legend main menu nav search section summary tbody td tfoot th thead tr".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?=[\s=/>]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "parts", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "hints", "rich", "chosen", "in_article")

    def __init__(self, name: str, parent: Node | None, dropped: bool):
        self.name, self.parent, self.dropped, self.parts, self.hints = name, parent, dropped, [], ()
        self.in_article = name in ("article", "main") or (parent is not None and parent.in_article)

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if type(p) is not str]


class Stack:
    """The open elements, with the places of each name, so that none is looked for from place to place."""

    def __init__(self, root: Node):
        self.open, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.open))
        self.open.append(node)

    def cut(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        for node in self.open[place:]:
            self.places[node.name].pop()
        del self.open[place:]

    def last(self, names: Iterable[str]) -> int:
        """The innermost open element of these names; 0: none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names: tuple[str, ...], barriers: frozenset[str], outermost: bool = False) -> None:
        """Closes the innermost (or outermost) open element of these names, unless a barrier is met first."""
        found = self.last(names)
        if not found:
            return
        barrier = self.last(barriers)
        if found > barrier:
            if outermost:
                above = (self.places[n][bisect.bisect(self.places[n], barrier) :] for n in names if self.places.get(n))
                found = min(places[0] for places in above if places)
            self.cut(found)


def _is_dropped(name: str, attributes: str, in_article: bool) -> tuple[bool, set[str] | tuple]:
    """Whether an element is never article text, and the hint words of its class and id."""
    if name in DROPPED or (name == "header" and not in_article):
        return True, ()
    if name in ("body", "html", "main") or (name == "article" and not in_article):
        return False, ()
    if not attributes:
        return False, ("<form>",) if name == "form" else ()
    hints: set[str] = set()
    if name == "form":
        hints.add("<form>")
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True, ()
        if key == "role":
            if value.lower().strip() in ROLES:
                return True, ()
        elif key in ("class", "id"):
            for word in value.split():
                pieces = [p.lower() for p in _CUT.split(word.replace("_", "-")) if p]
                hints.update(p for k, p in enumerate(pieces) if p in HINTS and (not k or pieces[k - 1] not in BESIDE))
                hints.update(_PAIRS[p] for p in zip(pieces, pieces[1:], strict=False) if p in _PAIRS)
    return False, hints & COMMENTS if name == "article" else hints  # an article in an article can be a comment


def parse(page: str) -> Node:
    """The tree of a page; text of dropped parts is left out at once."""
    root = Node("#root", None, False)
    stack, at, size = Stack(root), 0, len(page)
    match = _TOKEN.search
    while at < size:
        m = match(page, at)
        stop = m.start() if m else size
        top = stack.open[-1]
        if stop > at and not top.dropped:
            top.parts.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br" and not top.dropped:
                top.parts.append(" ")
            place = stack.last((name,))
            if place and (name in BLOCK or place >= stack.last(SCOPE)):
                stack.cut(place)
            continue
        if name in CLOSES_P:
            stack.close(("p",), SCOPE)
            if name in HEADINGS and stack.open[-1].name in HEADINGS:
                stack.cut(len(stack.open) - 1)
        if own := CLOSES_SELF.get(name):
            stack.close(*own, outermost=name == "tr")
        top = stack.open[-1]
        if name == "br":
            if not top.dropped:
                top.parts.append(" ")
            continue
        attributes = m[3]
        dropped, hints = (True, ()) if top.dropped else _is_dropped(name, attributes, top.in_article)
        node = Node(name, top, dropped)
        node.hints = hints
        if not dropped:
            top.parts.append(node)
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size
        elif name not in VOID and not attributes.endswith("/") or name in BLOCK and name != "hr":
            stack.push(node)
    return root


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += node.nodes()
    return out


#: A hint word whose parts hold this share of the plain text does not speak of what is beside the text.
MUCH = 1 / 3
#: An article or main element with this share of the body's plain text is where the text is.
ARTICLE = 1 / 4
#: With less than this share of the plain text left, the words are not believed.
LEFT = 1 / 2


#: So many plain characters outside of all hinted parts are a text that readers may have written about.
ENOUGH = 140


def drop_comments(root: Node) -> None:
    """Takes reader comments out, however long they are, where there is something else that they are about.

    That is text of an article or main element outside of them, or ``ENOUGH`` plain text outside of all
    hinted parts.  Where there is neither, as in a whole page named "discussion", the parts named so
    inside of them are looked at instead.
    """
    nodes = _order(root)
    if not any(COMMENTS.intersection(n.hints) for n in nodes):
        return
    at = {id(n): k for k, n in enumerate(nodes)}
    own = [sum(len(_SPACE.sub("", p)) for p in n.parts if type(p) is str) for n in nodes]
    depth, link, inside, article = ([0] * len(nodes) for _ in range(4))
    in_parts, in_articles = {}, {}  # plain characters by the number of comment parts around them
    for k, n in enumerate(nodes):
        j = at.get(id(n.parent), 0)
        comment = bool(COMMENTS.intersection(n.hints))
        depth[k] = depth[j] + comment
        link[k] = link[j] or n.name == "a"
        inside[k] = inside[j] or (bool(n.hints) and not comment)
        article[k] = article[j] or n.name == "main" or (n.name == "article" and not n.hints)
        if not link[k]:
            if not inside[k]:
                in_parts[depth[k]] = in_parts.get(depth[k], 0) + own[k]
            if article[k]:
                in_articles[depth[k]] = in_articles.get(depth[k], 0) + own[k]
    text = said = 0
    for level in range(1, max(depth) + 1):
        text, said = text + in_parts.get(level - 1, 0), said + in_articles.get(level - 1, 0)
        if said or text >= ENOUGH:
            gone = {id(n) for k, n in enumerate(nodes) if depth[k] == level and COMMENTS.intersection(n.hints)}
            for n in nodes:
                if any(id(p) in gone for p in n.parts):
                    n.parts = [p for p in n.parts if id(p) not in gone]
            return


def judge(root: Node) -> None:
    """Takes the hinted parts out that are beside the page's text."""
    nodes = _order(root)
    hinted = [n for n in nodes if n.hints]
    if not hinted:
        return
    at = {id(n): k for k, n in enumerate(nodes)}
    up = [at.get(id(n.parent), 0) for n in nodes]
    link, inside, level, within = [False] * len(nodes), [False] * len(nodes), [{}] * len(nodes), [False] * len(nodes)
    for k, n in enumerate(nodes):  # inside: a hinted part; within: an article that is in no hinted part
        j = up[k]
        link[k] = link[j] or n.name == "a"
        inside[k] = inside[j] or bool(n.hints)
        within[k] = within[j] or (n.name in ("article", "main") and not inside[k])
        level[k] = level[j] | {w: level[j].get(w, 0) + 1 for w in n.hints} if n.hints else level[j]
    chars, plain = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        own = sum(len(_SPACE.sub("", p)) for p in nodes[k].parts if type(p) is str)
        chars[k] += own
        plain[k] += 0 if link[k] else own
        if k:
            chars[up[k]] += chars[k]
            plain[up[k]] += plain[k]
    articles = sum(plain[k] for k in range(1, len(nodes)) if within[k] and not within[up[k]])
    has_article = articles > 0 and articles >= ARTICLE * plain[0]
    total = articles if has_article else plain[0]
    held: dict[tuple[str, int], int] = {}
    for n in hinted:
        k = at[id(n)]
        for w in n.hints:
            held[w, level[k][w]] = held.get((w, level[k][w]), 0) + (plain[k] if within[k] or not has_article else 0)
    sure, likely = set(), set()
    for n in hinted:
        k = at[id(n)]
        if n.name == "form" and 2 * plain[k] > total:
            continue  # a page in a form
        if 2 * plain[k] <= chars[k] or (has_article and not within[k]):
            sure.add(k)
        elif n.name == "form" or any(held[w, level[k][w]] < MUCH * total for w in n.hints):
            likely.add(k)
    gone, lost = [False] * len(nodes), 0
    for k in range(1, len(nodes)):
        gone[k] = gone[up[k]] or k in sure or k in likely
        if gone[k] and not gone[up[k]] and k in likely:
            lost += plain[k]
    for k in sure if total - lost < LEFT * total else sure | likely:
        nodes[up[k]].parts = [p for p in nodes[up[k]].parts if p is not nodes[k]]


def measure(root: Node) -> tuple[list[Node], Node]:
    """Densities and sums of all nodes; the nodes, parents first, and the body."""
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if type(p) is str:
                node.chars += len(_SPACE.sub("", p))
            else:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = next((n for n in nodes if n.name == "body"), root)
    if body.chars < root.chars / 2:
        body = root
    share = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density = max(c / t * math.log(max(c / lc * t / lt, 1.0) + 1) / math.log(base + 1), 0.0)
        else:
            node.density = 0.0
    for node in nodes:
        node.total = sum(p.density for p in node.nodes())
    return nodes, body


#: Containers with so many links, which hold more than half of their text, are lists of links.
LISTED = 3


def content(root: Node) -> Node:
    """The body with what is not text of the page taken out."""
    _, body = measure(root)
    nodes = _order(body)
    for node in reversed(nodes):
        node.rich, node.chosen = node, False
        for p in node.nodes():
            if (p.rich.total, p.rich.chars) > (node.rich.total, node.rich.chars):
                node.rich = p.rich
    best = node = body.rich
    threshold = best.density
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    holds: set[int] = set()  # nodes with a chosen one below
    stack = [body]
    while stack:
        node = stack.pop()
        if node.chosen or not node.chars or node.density < threshold or _is_scrap(node, best):
            continue
        up = node.rich
        up.chosen = True
        while up is not node and up is not body and id(up.parent) not in holds:
            up = up.parent
            holds.add(id(up))
        if not node.chosen:
            stack += node.nodes()
    for node in reversed(nodes):  # a holder's holder holds
        if node is not body and (node.chosen or id(node) in holds):
            holds.add(id(node.parent))
    inner = []  # chosen nodes' descendants
    stack = [body]
    while stack:
        node = stack.pop()
        if node.chosen:
            inner.append((node, 1 if node is body else LISTED))
        elif id(node) in holds:
            node.parts = [p for p in node.parts if type(p) is str or p.chosen or id(p) in holds or (p.name not in CONTAINERS and 2 * p.link_chars <= p.chars)]
            stack += [p for p in node.nodes() if p.chosen or id(p) in holds]
    while inner:
        node, least = inner.pop()
        node.parts = [p for p in node.parts if type(p) is str or not _is_list(p, threshold, least)]
        inner += [(p, LISTED) for p in node.nodes()]
    return body


#: A container of less than this share of the chosen text must be at least so dense beside it.
SCRAP, DENSE = 1 / 20, 1 / 2


def _is_scrap(node: Node, best: Node) -> bool:
    return node.name in CONTAINERS and node.chars < SCRAP * best.chars and node.density < DENSE * best.density


def _is_list(node: Node, threshold: float, least: int) -> bool:
    return node.name in BLOCK and node.link_tags >= least and 2 * node.link_chars > node.chars and node.density < threshold


def blocks(node: Node) -> list[str]:
    """The text of a node's blocks, in page order."""
    out: list[list[str]] = [[]]
    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            out.append([])
        elif type(item) is str:
            out[-1].append(item)
        else:
            block = item.name in BLOCK
            if block:
                out.append([])
                stack.append(None)
            stack += reversed(item.parts)
    texts = (_SPACE.sub(" ", entities.unescape("".join(parts))).strip() for parts in out)
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    drop_comments(root)
    judge(root)
    return "\n".join(blocks(content(root)))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``keep`` columns and text: the main text of each whole page."""
    small_batches(pages.sparkSession)
    names = [f"k{n}" for n in range(len(keep))]

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for (h,) in rows_of([batch], "h")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = T.StructType([*(T.StructField(c, pages.schema[c].dataType) for c in keep), T.StructField("text", T.StringType())])
    return pages.select(*(F.col(c).alias(n) for n, c in zip(names, keep, strict=True)), F.col(html_col).alias("h")).mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
