"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Every node's density is its characters per tag, corrected for links:

    C / T * log( C / LC * T / LT ) to the base ln( C / nLC * LC + LCb / Cb * C + e )

with C characters, T tags, LC and LT those in links, nLC the characters outside links, and Cb, LCb those of the body
(zeros count as 1).  A node's sum is that of its children's densities.  The subtree with the largest sum is the core.
The smallest density on the core's path to the body is the threshold: while the parent's other children that reach
it hold text of the article (or the parent is an article or main element), the core grows to the parent.

Where one article element holds most of what articles hold, it is the core.  Headings next to the core, and its siblings at the body's top that are
as dense, are taken with it.

Elements that hold no article text are left out of the tree: scripts, styles, forms, menus, page headers and footers,
asides, and elements one of whose names (class, id or role, taken whole) is made of words for menus, sidebars, notices, adverts,
share boxes or reader comments.  A form may wrap a whole page and a name may mean something else, so such an element stays (without
its own parts of the kind) where the page outside it holds next to nothing, by how sure its kind is: a doubtful name if it holds 4 times the text outside, a
form or a sure name 20 times and a paragraph's length (200 characters) or an article element, comments only if there is nothing else; none if there is text in an article outside.

Defined results: null or empty html gives an empty text; a null url or page_id is passed through; unclosed and
wrongly nested tags are closed where their parents end or their like begins, also in parts that are left out; text of any length is
taken whole, in time that grows with it (tags that are never closed, deep nesting and end tags of nothing included); a quote that isn't closed ends with its
tag; ties go to the first node; repeated rows get equal results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import heapq
import html as html_
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|"
    # quotes open a value only behind an equals sign
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[\"']?[^\s>]*+))*+)>",
    re.S,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template iframe".split())
_LEFT_OUT = _RAW | frozenset("nav footer aside button select head menu object canvas audio video".split())
_WRAPS = frozenset("form dialog noscript".split())  # left out unless they hold the page
_HEAD = frozenset("meta link title style script base noscript template".split())
_RAW_END = {t: re.compile(f"</{t}(?:[^a-z0-9>][^>]*)?>", re.I) for t in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption option legend body html summary".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a new element of a tag ends.
_ENDS = {t: tuple(_SAME.get(t, ())) + (("p",) if t in _CLOSES_P else ()) for t in _CLOSES_P | set(_SAME)}
_SCOPE = frozenset("ul ol dl table body html article section div main".split())
#: Words in a class, id or role that mark what isn't article text (fixed lists): for certain, perhaps, and words that go with them.
_SURE = frozenset(
    "ad ads advert advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent gdpr newsletter subscribe signup login comment comments comentarios disqus pagination pager contentinfo".split()
)
_MAYBE = frozenset(
    "menu side aside widget header notice notification alert popup modal overlay reply replies respond discussion share sharing social related "
    "recommended search toolbar skip complementary".split()
)
_WITH = frozenset(
    "site page main top bottom left right global primary secondary wrapper wrap container box bar list item items block section area panel inner outer "
    "slot unit user reader readers link links button buttons form posts articles stories results count thread feed policy message text content title "
    "group row col column the js".split()
)
_REPLIES = frozenset("comment comments comentarios disqus".split())
_KNOWN = _SURE | _MAYBE | _WITH
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How many times the text outside an element must hold that would be left out (by ``out``) to stay, and how many characters at least.
_HOLDS = {2: (4, 1), 3: (20, 200), 4: (math.inf, 200)}


class Node:
    __slots__ = ("tag", "kids", "parent", "out", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: int = 0) -> None:
        self.tag, self.parent, self.kids, self.out = tag, parent, [], out  # out: 0 stays, 1 is left out, 2 perhaps, 3 as good as sure, 4 comments
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _split(word: str) -> set[str]:
    """The word, or the two known words that it is made of."""
    if word not in _KNOWN:
        for k in range(2, len(word) - 1):
            if word[:k] in _KNOWN and word[k:] in _KNOWN:
                return {word[:k], word[k:]}
    return {word}


def _named(attributes: str, tag: str) -> int:
    """Whether a name of the element says that it isn't article text, as ``Node.out``."""
    if tag in ("body", "html", "article", "main") or "=" not in attributes:
        return 0
    out = 0
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split()[:50]:
            words = {x for w in _WORD.findall(name[:200]) for x in _split(w.lower())}
            if words and words <= _KNOWN:
                out = max(out, 4 if words & _REPLIES else 3 if words & _SURE else 2 if words & _MAYBE else 0)
    return out


def parse(page: str) -> Node:
    """The tree of a page's elements and texts (strings); what is to be left out is marked."""
    root = Node("html", None)
    path, places = [root], {}  # the open elements, and by tag their places in it
    at, last = 0, page.rfind(">")

    def shut(place: int) -> None:
        while len(path) > place:
            places[path.pop().tag].pop()

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    while at < len(page):
        m = _TOKEN.search(page, at) if at <= last else None
        text = page[at : m.start() if m else len(page)]
        if not m:
            text = text.partition("<!--")[0]
        if text:
            if path[-1].tag == "head" and not text.isspace():
                shut(len(path) - 1)
            path[-1].kids.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:  # an end tag
            place = nearest((tag,))
            if place and (tag in _BLOCK or tag == "body" or place > nearest(("article", "main", "td", "th"))):
                shut(place)
            continue
        if path[-1].tag == "head" and tag not in _HEAD:
            shut(len(path) - 1)
        if tag == "body" and len(path) > 1:
            continue
        if tag in _CLOSES_P or tag in _SAME:
            place = nearest(_ENDS[tag])
            if place and place > nearest(_SCOPE):
                shut(place)
        node = path[-1]
        if tag == "hr":
            node.kids.append(Node(tag, node))
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            if tag == "br":
                node.kids.append(" ")
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        inside = node.inside or node.tag in ("article", "main")
        out = 1 if tag in _LEFT_OUT or tag == "header" and not inside else max(3 if tag in _WRAPS else 0, _named(m[3], tag))
        child = Node(tag, node, out)
        node.kids.append(child)
        places.setdefault(tag, []).append(len(path))
        path.append(child)
    return root


def _prune(root: Node) -> None:
    """Take marked parts out of the tree, but for those that hold the page."""
    order, stack = [], [(root, root, False)]
    outer: dict[int, list[Node]] = {id(root): []}  # a marked node's (and the root's) marked nodes right below it
    own, whole, article = {id(root): 0}, {id(root): 0}, {id(root): False}
    while stack:
        n, owner, link = stack.pop()
        link = link or n.tag == "a"
        article[id(owner)] = article[id(owner)] or n.tag in ("article", "main")
        for k in n.kids:
            if isinstance(k, str):
                own[id(owner)] += 0 if link else len(" ".join(k.split()))
            elif k.out > 1:
                outer[id(owner)].append(k)
                outer[id(k)], own[id(k)], whole[id(k)], article[id(k)] = [], 0, 0, False
                order.append(k)
                stack.append((k, k, link))
            elif not k.out:
                stack.append((k, owner, link))
    for n in reversed(order):  # parts come before what holds them
        whole[id(n)] = own[id(n)] + sum(whole[id(k)] for k in outer[id(n)])
    rest, plain = own[id(root)], article[id(root)]
    heap = [(-whole[id(k)], i, k) for i, k in enumerate(outer[id(root)])]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        size, _, n = heapq.heappop(heap)
        if not size:
            break
        times, least = _HOLDS[n.out]
        if plain and rest or -size < (1 if article[id(n)] else least) or rest and -size <= times * rest:
            continue
        n.out = 0
        rest, plain = rest + own[id(n)], plain or article[id(n)]
        for k in outer[id(n)]:
            count += 1
            heapq.heappush(heap, (-whole[id(k)], count, k))
    stack = [root]
    while stack:
        n = stack.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not k.out]
        stack += [k for k in n.kids if isinstance(k, Node)]


def _measure(root: Node) -> None:
    order, stack = [], [(root, False)]
    linked: dict[int, bool] = {}
    while stack:
        n, link = stack.pop()
        link = link or n.tag == "a"
        linked[id(n)] = link
        order.append(n)
        stack += [(k, link) for k in n.kids if isinstance(k, Node)]
    for n in reversed(order):
        link = linked[id(n)]
        for k in n.kids:
            if isinstance(k, str):
                c = len(" ".join(k.split()))
                n.chars += c
                n.link_chars += c * link
            else:
                n.chars, n.tags, n.link_chars, n.link_tags = n.chars + k.chars, n.tags + k.tags + 1, n.link_chars + k.link_chars, n.link_tags + k.link_tags + (k.tag == "a")
    body = next((n for n in order if n.tag == "body"), root)
    c_b, lc_b = body.chars or 1, body.link_chars
    for n in order:
        if n.chars:
            c, t, lc, lt = n.chars, n.tags or 1, n.link_chars or 1, n.link_tags or 1
            base = math.log(c / ((c - n.link_chars) or 1) * n.link_chars + lc_b / c_b * c + math.e)
            n.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 0.05) if base > 1.0001 else c / t * math.log(max(c / lc * t / lt, 1.0))
    for n in order:
        n.total = sum(k.density for k in n.kids if isinstance(k, Node))


def _article(root: Node) -> Node | None:
    """The article element that holds most of the text of all of them."""
    found, stack = [], [root]
    while stack:
        n = stack.pop()
        if n.tag == "article":
            found.append(n)
        else:
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]
    if not found:
        return None
    size = [n.chars - n.link_chars for n in found]
    top = max(range(len(found)), key=size.__getitem__)
    return found[top] if size[top] * 10 > sum(size) * 6 else None


def _core(root: Node) -> list[Node]:
    """The nodes whose text is the page's, in page order."""
    only = _article(root)
    if only is not None:
        return [only]
    best, stack = root, [root]
    while stack:
        n = stack.pop()
        if n.total > best.total:
            best = n
        stack += [k for k in n.kids if isinstance(k, Node)]
    path, n = [], best
    while n is not None:
        path.append(n)
        if n.tag == "body":
            break
        n = n.parent
    threshold = min(n.density for n in path)

    def alike(k) -> bool:
        return isinstance(k, Node) and bool(k.chars) and (k.tag in _HEADINGS and 2 * k.link_chars <= k.chars or k.density >= threshold and k.chars > 2 * k.link_chars)

    core = best
    for up in path[1:]:
        around = sum(k.chars for k in up.kids if k is not core and alike(k))
        if up.tag in ("body", "html"):
            return [k for k in up.kids if k is core or alike(k) and (k.tag in _HEADINGS or 10 * k.chars >= core.chars)] if core.parent is up else [core]
        if up.tag in ("article", "main") or around * 10 >= core.chars or up.chars - core.chars == around:
            core = up
    return [core]


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = " ".join(html_.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            out.append(text)

    stack: list = nodes[::-1]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            buffer.append(n)
        else:
            block = n.tag in _BLOCK
            if block:
                flush()
                stack.append(None)
            stack += reversed(n.kids)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    _measure(root)
    return "\n".join(_blocks(_core(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string"
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
