"""Main text of a web page by composite text density.

For every node of the page's tree the density is its characters per tag, adjusted by the
share of link characters and link tags in it and in the body. A node's density sum adds up
the densities of its children; formatting elements are part of their block and stand for the
blocks in them. The node with the largest sum is found; the smallest density
on its path to the body is the threshold; wherever a node reaches the threshold, the
subtree with the largest sum below it is marked. The lowest node that holds all marks is main
text, unless that is the body itself: then the marked subtrees are, each by itself. Where a
section, or a child of an article or main element, is chosen, its parent is taken, as other
parts may be too short to be marked. Headings that stand before a chosen subtree, beside it or
beside what holds it, belong to it.

Elements that never hold an article's text (menus, forms, scripts, page headers and footers,
adverts, notices, comments) are not measured: by their tag, or by a token of their class, id or
role whose last word, but for words like "box" or "list", is one of ``NOISE``. Words of
``FURNITURE`` (a menu, a search) may name what a text is about: such a part goes if a third of it
is links or it has no paragraph of ``PARAGRAPH`` characters. An element that holds
a main element, an article or a first heading is a frame round the page and stays, unless
it is about comments, and so does a form with more plain text than all the rest; where nothing
else has text, what holds the densest node stays. Of articles side by side all are taken, but for
such as are mostly links.

Nulls and odd input: a null or empty page, and a page without text, give an empty string;
unclosed and stray tags follow HTML's rules for implied ends; a very long or deep page is read
whole, without recursion; repeated rows are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import small_batches, string_array, task

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
DROP = frozenset(
    "script style title textarea xmp iframe noembed noframes noscript template svg math canvas object audio video head "
    "nav footer aside form button select input label fieldset menu dialog".split()
)
FRAMING = frozenset({"form", "fieldset", "aside", "nav"})  # of these, such as hold a page's heading are kept
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "figcaption", "summary"}
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
# An open element of the key's set ends where the key begins, up to the barrier.
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
# Last words of a class, id or role token that mark a part of the page as no article text.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup related recommended recommendations pagination pager widget "
    "widgets complementary contentinfo".split()
)
# Words that name furniture of a page or what a part of the text is about: the text decides.
FURNITURE = frozenset("nav navbar navigation menu menubar login search share sharing social toolbar".split())
PARAGRAPH = 60  # characters of a paragraph that furniture doesn't have
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
HEADS = frozenset({"header", "masthead", "banner"})
# Words that may follow those in a token, and words that make a token speak of something else.
BOXES = frozenset("area bar block box buttons column container content form group icons inner item items links list panel posts section slot unit wrap wrapper".split())
ABOUT = frozenset("has with no without is not hide show".split())
FRAMES = frozenset({"article", "main", "h1"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "items", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total", "holds")

    def __init__(self, tag: str, parent: Node | None, noise: str):
        self.tag, self.parent, self.noise, self.items = tag, parent, noise, []
        self.holds = False  # a main element, an article or a first heading stands below


def token_kind(token: str, in_article: bool) -> str:
    """"comments", "noise" or "furniture" if a class token says so, else an empty string."""
    words = [w.lower() for w in SPLIT.split(token) if w]
    if not words or words[0] in ABOUT:
        return ""
    while len(words) > 1 and words[-1] in BOXES:
        words.pop()
    if words[-1] in COMMENTS:
        return "comments"
    if words[-1] in FURNITURE:
        return "furniture"
    return "noise" if words[-1] in NOISE or not in_article and words[-1] in HEADS else ""


def noise_kind(tag: str, attrs: str, in_article: bool) -> str:
    """Why an element is no article text: "never", "frame" (if it may be one round the page),
    "comments", "furniture" (if its text is like that), or an empty string if it is."""
    if tag in DROP:
        return "frame" if tag in FRAMING else "never"
    if tag == "header" and not in_article:
        return "frame"
    if tag in ("html", "body", "main") or not attrs:
        return ""
    for m in ATTR.finditer(attrs):
        name = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "never"
        if name in ("class", "id", "role"):
            kinds = {token_kind(t, in_article) for t in value.split()}
            if "comments" in kinds:
                return "comments"
            if "noise" in kinds and tag != "article":
                return "frame"
            if "furniture" in kinds and tag != "article":
                return "furniture"
    return ""


def parse(page: str) -> Node:
    root = Node("html", None, "")
    stack = [root]
    articles = 0  # open article or main elements
    at, size = 0, len(page)

    def pop_to(i: int) -> None:
        nonlocal articles
        articles -= sum(n.tag in ("article", "main") for n in stack[i:])
        del stack[i:]

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # an end tag
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if tag in FORMAT and stack[i].tag in BLOCK:
                    break
            continue
        attrs = m[3] or m[6] or ""
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop_to(i)
                    break
                if stack[i].tag not in FORMAT:
                    break
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            cut = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ended:
                    cut = i
                elif stack[i].tag in barrier:
                    break
            if cut:
                pop_to(cut)
        node = Node(tag, stack[-1], noise_kind(tag, attrs, articles > 0))
        stack[-1].items.append(node)
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in ("article", "main"):
            articles += 1
        if tag in FRAMES:
            up = node.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
        stack.append(node)
    settle(root)
    return root


def text_of(node: Node) -> tuple[int, int, int]:
    """Characters below a node, those in links, and those of its longest paragraph or run of
    text outside links, without what is dropped."""
    chars = links = longest = 0
    todo = [(node, False)]
    while todo:
        n, link = todo.pop()
        here = 0
        for x in n.items:
            if isinstance(x, str):
                here += len(" ".join(x.split()))
            elif not dropped(x):
                todo.append((x, link or x.tag == "a"))
                if x.tag in FORMAT and x.tag != "a":
                    here += sum(len(" ".join(y.split())) for y in x.items if isinstance(y, str))
        chars += sum(len(" ".join(x.split())) for x in n.items if isinstance(x, str))
        if link:
            links += sum(len(" ".join(x.split())) for x in n.items if isinstance(x, str))
        else:
            longest = max(longest, here)
    return chars, links, longest


def settle(root: Node) -> None:
    """Decide what may be furniture by its text (it has many links or no real paragraph), and
    open a form that holds more plain text than all the rest of the page."""
    order, forms, todo = [], [], [root]
    while todo:
        n = todo.pop()
        if n.noise == "furniture":
            order.append(n)
        if n.tag in ("form", "fieldset") and n.noise == "frame" and not n.holds:
            forms.append(n)
        todo.extend(reversed([x for x in n.items if not isinstance(x, str) and x.noise not in ("never", "comments")]))
    for n in reversed(order):  # inner ones first
        n.noise = ""
        chars, links, longest = text_of(n)
        if longest < PARAGRAPH or 3 * links > chars:
            n.noise = "frame"
    if forms:
        chars, links, _ = text_of(root)
        for n in forms:
            mine, my_links, longest = text_of(n)
            if mine - my_links > chars - links and longest >= PARAGRAPH:
                n.noise = ""


def dropped(node: Node) -> bool:
    return bool(node.noise) and not (node.noise == "frame" and node.holds)


def kept_children(node: Node) -> list[Node]:
    """Child elements that may hold article text."""
    return [x for x in node.items if not isinstance(x, str) and not dropped(x)]


def measure(root: Node) -> list[Node]:
    """Counts and densities of all kept nodes, parents before children in the result."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(reversed(kept_children(n)))
    for n in reversed(order):
        n.chars = sum(len(" ".join(x.split())) for x in n.items if isinstance(x, str))
        n.tags = n.link_tags = n.link_chars = 0
        for c in kept_children(n):
            n.chars += c.chars
            n.tags += c.tags + 1
            n.link_chars += c.link_chars
            n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    body_c, body_lc = max(root.chars, 1), root.link_chars
    for n in order:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, n.link_tags
        if c == 0:
            n.density = 0.0
            continue
        base = math.log(c * lc / max(c - lc, 1) + body_lc * c / body_c + math.e)
        n.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(base, 1e-9)
    for n in reversed(order):
        n.total = sum(c.density if c.tag in BLOCK else c.total for c in kept_children(n))
    return order


def marked_nodes(root: Node, order: list[Node]) -> list[Node]:
    """Subtrees that the threshold marks, in page order and not inside each other."""
    best = max(order, key=lambda n: n.total)
    if best.total == 0:
        best = max(order, key=lambda n: n.density)
    threshold, up = math.inf, best
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent
    top: dict[int, Node] = {}  # the node of the largest sum in each subtree
    for n in reversed(order):
        t = n
        for c in kept_children(n):
            if top[id(c)].total > t.total:
                t = top[id(c)]
        top[id(n)] = t
    marked = {id(top[id(n)]) for n in order if n.density >= threshold and n.chars} | {id(best)}
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if id(n) in marked:
            out.append(n)
        else:
            todo.extend(reversed(kept_children(n)))
    return out


def path_of(node: Node) -> list[Node]:
    """The node's ancestors and itself, from the root."""
    path = [node]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return path[::-1]


def widened(node: Node) -> Node:
    """A part of an article: the chosen section's parent, and the article or main round that."""
    while node.parent is not None and node.parent.parent is not None and (node.tag == "section" or node.parent.tag in ("article", "main")):
        node = node.parent
    return node


def main_nodes(root: Node) -> list[Node]:
    """Subtrees of main text, in page order and not inside each other."""
    order = measure(root)
    if root.chars == 0:
        open_densest(root)
        order = measure(root)
        if root.chars == 0:
            return []
    marked = marked_nodes(root, order)
    shared = path_of(marked[0])
    for n in marked[1:]:
        shared = [a for a, b in zip(shared, path_of(n)) if a is b]
    chosen = with_siblings([widened(n) for n in (marked if shared[-1] is root else [shared[-1]])])
    # headings before a chosen subtree, beside it or beside what holds it
    taken = {id(n) for n in chosen}
    heads: set[int] = set()
    for n in chosen:
        path = path_of(n)
        for up, child in zip(path, path[1:]):
            for x in up.items:
                if x is child:
                    break
                if not isinstance(x, str) and x.tag in HEADINGS and not dropped(x) and x.link_chars * 2 <= x.chars:
                    heads.add(id(x))
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if id(n) in taken or id(n) in heads:
            out.append(n)
        else:
            todo.extend(reversed(kept_children(n)))
    return out


def with_siblings(chosen: list[Node]) -> list[Node]:
    """A page of several articles has them side by side: those beside a chosen one too, but
    for such as are mostly links."""
    out = list(chosen)
    for n in chosen:
        if n.tag == "article" and n.parent is not None:
            out += [x for x in kept_children(n.parent) if x.tag == "article" and x.chars and 2 * x.link_chars <= x.chars and not any(x is y for y in out)]
    return out


def open_densest(root: Node) -> None:
    """Where all text is in elements that don't count: let in those round the densest node of
    them, but for what never holds text."""
    closed, todo = [], [root]
    while todo:
        n = todo.pop()
        for x in n.items:
            if not isinstance(x, str) and x.noise != "never":
                todo.append(x)
                if dropped(x):
                    closed.append(x)
    kinds = [x.noise for x in closed]
    for x in closed:
        x.noise = ""
    order = measure(root)
    best = max(order, key=lambda n: n.total or n.density)
    kept = {id(x) for x in path_of(best)}
    for x, kind in zip(closed, kinds):
        x.noise = "" if id(x) in kept and x.tag not in ("nav", "aside") else kind


def blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif dropped(x):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(x.items))
        else:
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str) -> str:
    """Blocks of the main text joined by an empty line."""
    if not page:
        return ""
    return "\n\n".join(b for n in main_nodes(parse(page)) for b in blocks(n))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession, 500)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in string_array(batch.column(2)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(task(extract), "page_id long, url string, text string, n_chars long")
