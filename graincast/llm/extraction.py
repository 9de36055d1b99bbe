"""HTML extraction by wrapper induction.

Pages of one host share a wrapper, made from all its different pages. Their DOM trees are aligned by simple tree matching:
runs of equal siblings count as one repeating node, and children are matched in order so that the number of matched nodes is
largest. Matching looks at labels only, so trees are merged and aligned once a shape, in rounds; texts are counted by aggregation.
A text that stands in the same matched node of two thirds of the pages that have it is template; the other texts are
what the node, a slot, varies in. The content is the node that holds nearly all prose of the slots. A page is aligned
with its host's wrapper the same way, and its text is what stands in the nodes matched with the content. Tags, roles
and class names only help: what they call a menu, an advert, a form or comments weighs nothing and goes, and the content isn't
sought below an article. Where a host has no wrapper or a page doesn't fit it, all texts of the page count as slots.
"""

from __future__ import annotations

import bisect
import hashlib
import html as htmllib
import json
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincast.llm.common import join_small, materialize, merged, slices, table
from graincast.llm.site_lines import host_of

#: Shapes of the host with most that a task merges on average; with more, rounds merge what the tasks gave.
FOLD = 64
#: Lists of children whose table would have more cells than this are put in line by their labels instead.
CELLS = 40_000
#: The content is sought below a node as long as one child holds this share of the node's varying prose.
MOST = 0.7

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "button", "select", "textarea", "input", "nav", "footer", "aside", "menu", "dialog", "header", "xmp"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
NAMES = {"nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "newsletter", "subscribe", "signup", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "login", "toolbar", "form"}
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
#: What may stand beside such words in a name; any other word makes it a name of something else ("share-price", "related-work").
BESIDE = {"box", "block", "container", "wrapper", "wrap", "section", "area", "bar", "list", "links", "link", "button", "buttons", "item", "items", "slot", "unit", "top", "bottom", "left", "right", "main", "primary", "secondary", "site", "page", "global", "inner", "outer", "content", "text", "panel", "row", "col", "group", "post", "posts", "article", "articles", "fixed", "sticky", "small", "large", "mobile", "desktop", "div", "id", "media", "user", "icons", "message", "policy", "email"}
#: Elements that hold a paragraph, not a region.
PARAGRAPHS = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "dd", "dt", "blockquote", "pre", "figcaption"}
#: An opening tag of the key ends the open element of the value, up to the list's own container.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element. ``off`` is 2 if its tag or role, 1 if only its names tell that it isn't content; ``gone`` if it or one above isn't."""

    __slots__ = ("tag", "name", "off", "kids", "gone", "prose", "holds")

    def __init__(self, tag: str, name: str = "", off: int = 0):
        self.tag, self.name, self.off, self.kids = tag, name, off, []
        self.gone, self.prose, self.holds = False, 0, False


def _element(tag: str, attrs: str) -> Node:
    off = 2 if tag in DROPPED else 1 if tag == "form" else 0
    if not attrs:
        return Node(tag, "", off)
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    named = f"{found.get('class', '')} {found.get('id', '')}".split()
    parts: set[str] = set()
    for one in named:
        words = {p.lower() for p in _NAME_PARTS.findall(one)}
        if words <= NAMES | COMMENTS | BESIDE:
            parts |= words
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if hidden or found.get("role", "").lower() in ROLES or parts & COMMENTS:
        off = 2
    elif parts & NAMES:
        off = max(off, 1)
    main = found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"
    return Node(tag, "main" if main else found.get("class", ""), off)


def is_article(tag: str, name: str) -> bool:
    return tag in ("article", "main") or name == "main"


def parse(page: str) -> Node:
    """A forgiving DOM: text kids are strings with character references decoded."""
    root = Node("#root")
    stack, at = [root], 0
    for m in iter(_TOKEN.scanner(page).search, None) if "<" in page else ():
        if m.start() < at:
            continue
        if m.start() > at:
            stack[-1].kids.append(htmllib.unescape(page[at : m.start()]))
        at = m.end()
        tag = m.group(2)
        if tag is None:
            if m.group().startswith("<![CDATA["):
                stack[-1].kids.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        node = _element(tag, m.group(3))
        if tag not in INLINE:
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in stops:
                    break
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.kids.append(htmllib.unescape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.append(node)
    if at < len(page):
        stack[-1].kids.append(htmllib.unescape(page[at:]))
    return root


def _own(node: Node) -> tuple[str, int]:
    """Text of a node without its blocks, and how much of it isn't links."""
    out, links, todo = [], 0, [(node, False)]
    while todo:
        x, link = todo.pop()
        if isinstance(x, str):
            out.append(x)
            links += len(x.strip()) * link
        elif x is node or x.tag in INLINE and not x.off:
            out.append(" " if x.tag == "br" else "")
            todo.extend((k, link or x.tag == "a") for k in reversed(x.kids))
        else:
            out.append(" ")
    text = " ".join("".join(out).split())
    return text, max(0, len(text) - links)


def mark(root: Node) -> None:
    """Sets ``gone``. Names alone don't make an element go that has more than half of the page's prose around an article or heading."""
    order, todo = [], [(root, False)]
    while todo:
        x, article = todo.pop()
        order.append(x)
        inside = article or is_article(x.tag, x.name)
        if x.tag == "header" and article and any(not isinstance(k, str) and k.tag in ("h1", "h2") for k in x.kids):
            x.off = 0  # an article's own head
        todo.extend((k, inside) for k in x.kids if not isinstance(k, str))
    for x in reversed(order):
        x.holds = x.tag == "h1" or is_article(x.tag, x.name)
        if x.off < 2:
            for k in x.kids:
                if isinstance(k, str):
                    x.prose += len(k.strip()) * (x.tag != "a")
                else:
                    x.prose += k.prose
                    x.holds |= k.holds and k.off < 2
    for x in order:
        here = x.gone or x.off == 2 or x.off == 1 and not (x.holds and 2 * x.prose > root.prose)
        x.gone = here
        if here:
            for k in x.kids:
                if not isinstance(k, str):
                    k.gone = True


class Group:
    """A run of equal siblings, one node for matching: its texts with their prose, and the groups below.

    ``weight`` is the prose of its own texts that vary. In a wrapper ``fixed`` has the hashes of template texts, and ``chosen`` tells content.
    """

    __slots__ = ("tag", "name", "nodes", "kids", "texts", "weight", "fixed", "chosen")

    def __init__(self, tag: str, name: str):
        self.tag, self.name, self.nodes, self.kids, self.texts = tag, name, [], [], {}
        self.weight, self.fixed, self.chosen = 0, frozenset(), False

    @property
    def label(self) -> tuple[str, str]:
        return self.tag, self.name


def grouped(root: Node) -> Group:
    """The tree of block groups of a marked page."""
    top = Group("#root", "")
    top.nodes = [root]
    todo = [top]
    while todo:
        g = todo.pop()
        for n in g.nodes:
            text, prose = _own(n)
            if text:
                g.texts[text] = g.texts.get(text, 0) + (0 if n.gone else prose)
            below = [k for k in reversed(n.kids) if not isinstance(k, str)]
            while below:
                x = below.pop()
                if x.tag in INLINE:  # inline elements don't structure a page
                    below.extend(k for k in reversed(x.kids) if not isinstance(k, str))
                    continue
                if not g.kids or g.kids[-1].label != (x.tag, x.name):
                    g.kids.append(Group(x.tag, x.name))
                g.kids[-1].nodes.append(x)
        g.weight = sum(g.texts.values())
        todo.extend(g.kids)
    return top


def in_line(xs: list, ys: list) -> list[tuple[int, int]]:
    """Pairs of equal labels in order, for long lists: what agrees at both ends, and between the ends a longest chain of nth with nth occurrences. In n log n time."""
    low = 0
    while low < min(len(xs), len(ys)) and xs[low] == ys[low]:
        low += 1
    high = 0
    while high < min(len(xs), len(ys)) - low and xs[-1 - high] == ys[-1 - high]:
        high += 1
    place: dict = {}
    for j in range(low, len(ys) - high):
        place.setdefault(ys[j], []).append(j)
    turn: Counter = Counter()
    ends, chain, back = [], [], {}  # the least end of a chain of each length
    for i in range(low, len(xs) - high):
        nth = turn[xs[i]]
        turn[xs[i]] += 1
        if nth < len(place.get(xs[i], ())):
            j = place[xs[i]][nth]
            at = bisect.bisect_left(ends, j)
            if at == len(ends):
                ends.append(j)
                chain.append(i)
            else:
                ends[at], chain[at] = j, i
            back[i] = (j, chain[at - 1] if at else None)
    middle, i = [], chain[-1] if chain else None
    while i is not None:
        middle.append((i, back[i][0]))
        i = back[i][1]
    return [*((k, k) for k in range(low)), *reversed(middle), *((len(xs) - k, len(ys) - k) for k in range(high, 0, -1))]


def match(a: Group, b: Group) -> tuple[int, list]:
    """Simple tree matching below two groups: the largest number of matched nodes, and the pairs as a tree of (x, y, pairs below)."""
    xs, ys = a.kids, b.kids
    if not xs or not ys:
        return 0, []
    if [x.label for x in xs] == [y.label for y in ys]:
        total, pairs = 0, []
        for x, y in zip(xs, ys, strict=True):
            n, below = match(x, y)
            total += n + 1
            pairs.append((x, y, below))
        return total, pairs
    both = {x.label for x in xs} & {y.label for y in ys}
    xs, ys = ([k for k in ks if k.label in both] for ks in (xs, ys))
    if len(xs) * len(ys) > CELLS:
        total, pairs = 0, []
        for i, j in in_line([x.label for x in xs], [y.label for y in ys]):
            n, below = match(xs[i], ys[j])
            total += n + 1
            pairs.append((xs[i], ys[j], below))
        return total, pairs
    best = [[(0, 0)] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    found = {}
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            top = max((best[i][j + 1][0], 1), (best[i + 1][j][0], 2))
            if x.label == y.label:
                found[i, j] = match(x, y)
                top = max(top, (best[i][j][0] + found[i, j][0] + 1, 3))
            best[i + 1][j + 1] = top
    pairs, i, j = [], len(xs), len(ys)
    while i and j:
        how = best[i][j][1]
        if how == 3:
            i, j = i - 1, j - 1
            pairs.append((xs[i], ys[j], found[i, j][1]))
        elif how == 1:
            i -= 1
        else:
            j -= 1
    return best[len(xs)][len(ys)][0], pairs[::-1]


def flat(pairs: list) -> Iterator[tuple[Group, Group]]:
    todo = [pairs]
    while todo:
        for x, y, below in todo.pop():
            yield x, y
            todo.append(below)


def merge(wrapper: Group, page: Group) -> None:
    """Adds a tree to the wrapper; nodes that the wrapper lacks come where they stand between their siblings, so each tree merged fits in whole."""
    todo = [(wrapper, page, match(wrapper, page)[1])]
    while todo:
        w, g, below = todo.pop()
        partner = {id(y): x for x, y, _ in below}
        first: list[Group] = []
        after: dict[int, list[Group]] = {}
        here = first
        for k in g.kids:
            if id(k) in partner:
                here = after.setdefault(id(partner[id(k)]), [])
            else:
                here.append(k)
        w.kids = [*first, *(k for x in w.kids for k in (x, *after.get(id(x), ())))]
        todo.extend(below)


def content(top: Group) -> list[Group]:
    """The groups that hold nearly all prose of the slots; ``top`` itself if no region does."""
    order, todo, parents = [], [top], {}
    while todo:
        g = todo.pop()
        order.append(g)
        todo.extend(g.kids)
        parents.update((id(k), g) for k in g.kids)
    weight = {}
    for g in reversed(order):
        weight[id(g)] = g.weight + sum(weight[id(k)] for k in g.kids)
    at = top
    if not weight[id(top)]:
        return []
    while not is_article(at.tag, at.name):
        least = MOST * weight[id(at)]
        best = max(at.kids, key=lambda k: weight[id(k)], default=None)
        if best is not None and weight[id(best)] >= least and best.tag not in PARAGRAPHS:
            at = best
            continue
        articles = [k for k in at.kids if is_article(k.tag, k.name) and weight[id(k)]]
        if sum(weight[id(k)] for k in articles) >= least:
            return articles
        break
    found, above = [at], at
    while not is_article(at.tag, at.name) and id(above) in parents:
        above = parents[id(above)]
        found += [k for k in above.kids if k.tag == "h1" and weight[id(k)]]  # the heading of a region that has none
    return found


def preorder(top: Group) -> tuple[list[list], list[Group]]:
    """A tree's shape, [number of the node above, tag, name] of each node, parents first, and its nodes in that order."""
    shape, order, todo = [], [], [(top, -1)]
    while todo:
        g, above = todo.pop()
        shape.append([above, g.tag, g.name])
        order.append(g)
        todo.extend((k, len(order) - 1) for k in reversed(g.kids))
    return shape, order


def tree_of(shape: list[list]) -> list[Group]:
    """Nodes of a shape, the top first."""
    made: list[Group] = []
    for above, tag, name in shape:
        made.append(Group(tag, name))
        if above >= 0:
            made[above].kids.append(made[-1])
    return made


def _json(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace").decode()


def digest(page: str) -> tuple[str, list[int], list[int], list[int]]:
    """A page's shape, and of each different text of a node: the node's number, the text's hash and its prose."""
    with _Deep():
        shape, order = preorder(_tree(page)[1])
    found = [(i, _hash(t), prose) for i, g in enumerate(order) for t, prose in g.texts.items()]
    return _json(shape), *([f[i] for f in found] for i in range(3))


def paths(shape: list[list], host: str | None) -> list[int]:
    """A hash of the labels from the top to each node. Only nodes of equal paths can be matched."""
    out: list[bytes] = []
    for above, tag, name in shape:
        up = out[above] if above >= 0 else repr(host).encode("utf-8", "replace")
        out.append(hashlib.blake2b(up + f"{tag} {name}".encode("utf-8", "replace"), digest_size=8).digest())
    return [int.from_bytes(h, "big", signed=True) for h in out]


def pruned(shape: list[list], keep: Iterable[int]) -> list[list]:
    """The shape of the nodes ``keep``; with a node it has the one above."""
    to = {-1: -1}
    out = []
    for i in sorted(keep):
        to[i] = len(out)
        out.append([to[shape[i][0]], *shape[i][1:]])
    return out


def fold(shapes: Iterable[str]) -> str:
    """The shape that all of ``shapes`` fit in."""
    with _Deep():
        tops = [tree_of(json.loads(s))[0] for s in sorted(set(shapes), key=lambda s: (-len(s), s))]
        for top in tops[1:]:
            merge(tops[0], top)
        return _json(preorder(tops[0])[0])


def align(wrapper: list[Group], shape: list[list]) -> list[int]:
    """Of each node of a shape the number of its node in the wrapper, or -1 less the number of the nearest matched one above."""
    made = tree_of(shape)
    number = {id(g): i for i, g in enumerate(wrapper)}
    with _Deep():
        to = {id(y): number[id(x)] for x, y in flat(match(wrapper[0], made[0])[1])}
    to[id(made[0])] = 0
    out: list[int] = []
    for g, (above, _, _) in zip(made, shape, strict=True):
        up = out[above] if above >= 0 else 0
        out.append(to.get(id(g), up if up < 0 else -1 - up))
    return out


def finish(shape: list[list], told: Iterable[tuple[int, int, Iterable[int]]]) -> str:
    """JSON of a wrapper: nodes [number of the node above, tag, name, hashes of template texts, whether it is content], parents first; empty if nothing varies.

    ``told`` has number, prose of varying texts and template texts of nodes.
    """
    made = tree_of(shape)
    for i, weight, fixed in told:
        made[i].weight, made[i].fixed = weight, frozenset(fixed)
    chosen = {id(g) for g in content(made[0])}
    return _json([[*line, sorted(g.fixed), int(id(g) in chosen)] for line, g in zip(shape, made, strict=True)]) if chosen else ""


def induce(pages: list[str]) -> str:
    """The wrapper of a host's pages, as ``wrappers`` makes it, on one machine; empty for less than two different pages."""
    told = [digest(p) for p in dict.fromkeys(pages)]
    if len(told) < 2:
        return ""
    shapes = {s: json.loads(s) for s, *_ in told}
    named = {s: paths(shape, None) for s, shape in shapes.items()}
    pages_of = Counter(p for s, *_ in told for p in set(named[s]))
    whole = json.loads(fold(_json(pruned(shape, (i for i, p in enumerate(named[s]) if pages_of[p] > 1))) for s, shape in shapes.items()))
    to = {s: align(tree_of(whole), shape) for s, shape in shapes.items()}
    have = Counter(i for s, *_ in told for i in to[s] if i >= 0)
    n, total, weight, fixed = Counter(), Counter(), Counter(), {}
    for s, nodes, texts, prose in told:
        for node, text, p in zip(nodes, texts, prose, strict=True):
            i = to[s][node]
            place = (i, text) if i >= 0 else (-1 - i, None)
            n[place] += 1
            total[place] += p
    for (i, text), times in n.items():
        if text is not None and times >= max(2, -(-2 * have[i] // 3)):
            fixed.setdefault(i, []).append(text)
        else:
            weight[i] += total[i, text]
    return finish(whole, [(i, weight[i], fixed.get(i, ())) for i in {i for i, _ in n}])


def wrapper_of(text: str) -> Group:
    """The wrapper from its JSON."""
    made: list[Group] = []
    for above, tag, name, fixed, chosen in json.loads(text):
        g = Group(tag, name)
        g.fixed, g.chosen = frozenset(fixed), bool(chosen)
        if above >= 0:
            made[above].kids.append(g)
        made.append(g)
    return made[0]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


class _Deep:
    """Pages may nest deeply: lifts Python's limit of recursion, which is in no danger of the C stack here."""

    def __enter__(self):
        self.limit = sys.getrecursionlimit()
        sys.setrecursionlimit(1_000_000)

    def __exit__(self, *_):
        sys.setrecursionlimit(self.limit)


def _tree(page: str) -> tuple[Node, Group]:
    root = parse(page)
    mark(root)
    return root, grouped(root)


def extract(page: str | None, wrapper: Group | None) -> str:
    """The main text of a page: blocks in page order, joined by newlines."""
    if not page:
        return ""
    with _Deep():
        root, tree = _tree(page)
        fixed: dict[int, frozenset] = {}
        found: list[Group] = []
        if wrapper is not None:
            pairs = [(wrapper, tree), *flat(match(wrapper, tree)[1])]
            found = [g for w, g in pairs if w.chosen]
            if not any(not n.gone and n.prose for g in found for n in g.nodes):
                found = []
            else:
                fixed = {id(n): w.fixed for w, g in pairs if w.fixed for n in g.nodes}
        aligned = bool(found)  # what the alignment chose keeps its lists of links
        found = found or content(tree)
    tops = {id(n): is_article(g.tag, g.name) for g in found for n in g.nodes} or {id(root): False}
    blocks: list[str] = []
    line: list[str] = []
    linked = [0]

    def flush(owner: Node | None, sure: bool) -> None:
        text = " ".join("".join(line).split())
        links = linked[0]
        line.clear()
        linked[0] = 0
        if text and owner is not None and (sure or (aligned or 2 * links <= len(text)) and _hash(text) not in fixed.get(id(owner), ())):
            blocks.append(text)

    # what, node, owner of its text, within a link, within the content, within an article
    todo: list = [("in", root, None, False, False, False)]
    while todo:
        what, x, owner, link, inside, sure = todo.pop()
        if what == "flush":
            flush(x, sure)
        elif isinstance(x, str):
            if inside:
                line.append(x)
                linked[0] += len(x.strip()) * link
        else:
            block = x.tag not in INLINE
            if id(x) in tops:
                inside, sure = True, sure or tops[id(x)]
            if block and owner is not None:
                flush(owner, sure)
            if x.gone:
                continue
            if x.tag == "br":
                line.append(" ")
            if block:
                todo.append(("flush", x, None, False, inside, sure))
            todo.extend(("in", k, (x if inside else None) if block else owner, link or x.tag == "a", inside, sure) for k in reversed(x.kids))
    return "\n".join(blocks)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        shape, nodes, texts, prose = zip(*map(digest, batch["html"].to_pylist()), strict=True)
        yield pa.RecordBatch.from_arrays([batch["host"], batch["page"], pa.array(shape, pa.string()), pa.array(nodes, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.int64())) for x in (texts, prose))], ["host", "page", "shape", "nodes", "texts", "prose"])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for kind, host, shape, n in zip(*(batch[c].to_pylist() for c in ("kind", "host", "shape", "n")), strict=True):
            found = paths(json.loads(shape), host)
            first = dict(zip(reversed(found), reversed(range(len(found))), strict=True))  # a page counts once a path
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.int64()), pa.array([n * (first[p] == i) for i, p in enumerate(found)], pa.int64())], ["kind", "node", "path", "n"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = [_json(pruned(json.loads(s), keep)) for s, keep in zip(batch["shape"].to_pylist(), batch["keep"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(out, pa.string())], ["host", "shape"])


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": pdf["host"].iloc[:1], "shape": [fold(pdf["shape"])]})


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, wrapper = None, []
    for batch in slices(batches):
        out = []
        for shape, whole in zip(batch["shape"].to_pylist(), batch["whole"].to_pylist(), strict=True):
            if whole != last:
                last, wrapper = whole, tree_of(json.loads(whole))
            out.append(align(wrapper, json.loads(shape)))
        yield pa.RecordBatch.from_arrays([batch["kind"], batch["host"], batch["n"], pa.array(out, pa.list_(pa.int32()))], ["kind", "host", "n", "to"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = [finish(json.loads(w), [(t["node"], t["weight"], t["fixed"]) for t in told or ()]) for w, told in zip(batch["whole"].to_pylist(), batch["told"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(out, pa.string())], ["host", "wrapper"])


def whole_shapes(shapes: DataFrame) -> DataFrame:
    """``host, whole`` of ``kind, host, shape, n``: what all shapes of a host's different pages fit in, less nodes of paths that one page has only, which nothing can be matched with."""
    nodes = materialize(shapes.mapInArrow(_paths, "kind bigint, node int, path bigint, n bigint"), "paths")
    shared = nodes.groupBy("path").agg(F.sum("n").alias("pages")).filter("pages > 1")
    kept = nodes.join(shared, "path", "left_semi").groupBy("kind").agg(F.collect_list("node").alias("keep"))
    parts = materialize(shapes.join(kept, "kind").select("host", "shape", "keep").mapInArrow(merged(_prune), "host string, shape string").distinct(), "shapes")
    blocks = -(-(parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) // FOLD)
    while True:
        block = F.pmod(F.xxhash64("shape"), F.lit(max(1, blocks)))
        parts = materialize(parts.withColumn("block", block).groupBy("host", "block").applyInPandas(_fold, "host string, shape string"), "shapes")
        if blocks <= 1:
            return parts.withColumnRenamed("shape", "whole")
        blocks = -(-blocks // FOLD)


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` from all different pages of each host. A page is parsed to its shape and its texts' hashes; equal pages count once."""
    given = pages.filter(F.col("html").isNotNull()).select("host", F.xxhash64("html").alias("page"), "html")
    read = given.mapInArrow(merged(_digest), "host string, page bigint, shape string, nodes array<int>, texts array<bigint>, prose array<bigint>")
    pages = materialize(read.dropDuplicates(["host", "page"]).withColumn("kind", F.xxhash64("host", "shape")), "digests")
    shapes = materialize(pages.groupBy("kind", "host", "shape").agg(F.count(F.lit(1)).alias("n")), "shapes")
    wholes = whole_shapes(shapes)
    aligned = join_small(shapes, wholes, "host", F.col("kind")).filter("whole is not null")
    aligned = materialize(aligned.mapInArrow(merged(_align), "kind bigint, host string, n bigint, to array<int>"), "aligned")
    place = F.xxhash64("host", "node").alias("place")
    have = aligned.select("host", "n", F.explode("to").alias("node")).filter("node >= 0").groupBy(place).agg(F.sum("n").alias("have"))
    lines = join_small(pages, aligned.select("kind", "to"), "kind", F.col("page")).filter("to is not null")
    lines = lines.select("host", "to", F.explode(F.arrays_zip("nodes", "texts", "prose")).alias("line")).select("host", F.expr("to[line.nodes]").alias("at"), "line.texts", "line.prose")
    # the text of a node that the wrapper lacks varies, and counts for the node above it
    lines = lines.select("host", F.when(F.col("at") >= 0, F.col("at")).otherwise(-1 - F.col("at")).alias("node"), F.when(F.col("at") >= 0, F.col("texts")).alias("text"), "prose")
    texts = lines.groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("n"), F.sum("prose").alias("prose")).select("*", place)
    texts = join_small(texts, materialize(have, "have"), "place", F.xxhash64("text"))
    fixed = F.col("text").isNotNull() & (F.col("n") >= 2) & (3 * F.col("n") >= 2 * F.col("have"))
    told = texts.groupBy("host", "node").agg(F.sum(F.when(fixed, 0).otherwise(F.col("prose"))).alias("weight"), F.collect_list(F.when(fixed, F.col("text"))).alias("fixed"))
    told = materialize(told.groupBy("host").agg(F.collect_list(F.struct("node", "weight", "fixed")).alias("told")), "told")
    return join_small(wholes, told, "host", F.xxhash64("whole")).mapInArrow(merged(_finish), "host string, wrapper string")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, Group] = {}
    for batch in slices(batches):
        out = []
        for page, w in zip(batch["html"].to_pylist(), batch["wrapper"].to_pylist(), strict=True):
            if w and w not in known:
                if len(known) > 500:
                    known.clear()
                known[w] = wrapper_of(w)
            out.append(extract(page, known.get(w)))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``page_id, url, html``, a row each, repeated ones too; an empty table gives none.

    Null html gives an empty text. Pages without a host share the wrapper of the empty host. A host with one
    page has no wrapper: the page's own prose tells its content. Depth isn't limited. Of lists of over CELLS pairs of
    children (long pages) those are matched that stand in line by their labels.
    """
    given = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    wrapped = join_small(given, materialize(wrappers(given), "wrappers"), "host", F.xxhash64("html"))
    return wrapped.select("page_id", "url", "html", "wrapper").mapInArrow(merged(_extract), "page_id bigint, url string, text string, n_chars bigint")


def op2_wrapper_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
