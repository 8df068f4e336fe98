"""Operator 1, HTML extraction by wrapper induction.

Pages of a host are aligned with the host's pivot page (its smallest page_id) by simple tree matching: roots of equal tags
match, and the children's matches, in order, are those of the greatest sum of matched nodes below (exactly, for child
lists of any length). Nodes of the pivot that hold the same text on most of the aligned pages are constant: they are the
host's template and go wherever a page repeats them. The others are slots, and what fills them is content. Votes
are counted over all pages of the host in one grouped aggregation; a page with the pivot's title, heading and nearly all of its text is a
copy of the same article and has no vote, so that copies don't turn an article into template.

Menus, adverts or comments that differ on every page fill slots too. For these HTML's structure decides: elements that are
never the article (navigation, footers, asides, forms, scripts, headers outside the article, hidden ones) go; an element
whose id or class names it as one of these goes too, unless it holds the page's first heading, its article or nearly all
of its text, or is a paragraph, heading, quotation or caption with a name that only might tell. Words for adverts and comments tell whatever
stands beside them in a name. A page with article or main elements
has its content there; on other pages lists of nothing but links are menus. What remains is cut into blocks in page order.

Two passes read the pages; the pivots and templates (one per host) are broadcast if their measured size is small, else
joined by host, hot hosts with salt, since one host may hold a third of all pages.

Cases: null html gives an empty text; a null or odd url is a host of its own name; pages of hosts with fewer than
MIN_VOTES votes are cut by structure alone, since a single other page can't tell a template from a quotation; unclosed
tags end with their parent, a broken tag or comment at the end of a page is dropped; elements nested over DEEPEST levels
are put beside each other; repeated rows get the same text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import OrderedDict
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, BROADCAST_ROWS, blocks, checkpoint, salted_join, sized_broadcast

MIN_VOTES = 2
CONSTANT = 0.6
SAME_ARTICLE = 0.5
#: Share of text of its own that a page with the pivot's title and heading needs to be another article.
OWN_TEXT = 0.2
#: An element with this share of a page's text is no menu or advert, whatever its name.
NEARLY_ALL = 0.8
#: Elements nested deeper become neighbours, as in browsers.
DEEPEST = 400
#: Tables of child lists up to this size are kept whole; larger ones are split until they fit.
TABLE = 1 << 22
#: Shapes and weights that a worker remembers, and bytes of parsed pivots.
REMEMBERED = 200_000
PIVOT_BYTES = 4 << 20

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
SKIP = frozenset("script style noscript template iframe svg math object select button textarea head title nav footer aside form dialog menu canvas audio video input".split())
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figure figcaption li dt dd pre td th tr".split())
# Words of ids and classes that name what isn't the article, and those that stand beside them.
SURE_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe breadcrumb breadcrumbs copyright".split())
SKIP_WORDS = SURE_WORDS | frozenset(
    "promotion banner nav navbar navigation menu sidebar aside footer masthead notice notices alert popup modal overlay signup login search share sharing social comments comment respond disqus "
    "replies reply related recommended pagination pager toolbar skip".split()
)
COMMENT_WORDS = frozenset("comment comments respond disqus replies related recommended".split())
BESIDE_WORDS = frozenset("the site page global top bottom left right main primary secondary box block list wrapper wrap container area section bar link links button buttons slot unit widget module panel content inner outer item items post posts entry article articles form field text body head header title reader user thread".split())
# Words that tell adverts and comments whatever stands beside them, and those that take a name's meaning back.
LOOSE_WORDS = frozenset("ad ads adsense adsbygoogle adunit adblock adbanner adcontainer adwrapper advert adverts advertisement advertising adbox adslot sponsored comment comments commentlist commentbox commentarea commentform commentthread disqus".split())
BACK_WORDS = frozenset("has have no not non with without free hoc count".split())
#: Quotes only count behind an equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    """named is 2 if the element surely isn't content by tag, role or attribute, 1 if an id or class says so, 3 if it says that it holds other articles; skip is the decision."""

    __slots__ = ("tag", "named", "skip", "children", "number", "shape")

    def __init__(self, tag: str, named: int, number: int) -> None:
        self.tag, self.named, self.number = tag, named, number
        self.skip = False
        self.shape = -1
        self.children: list[Node | str] = []


def parse(html: str) -> Node:
    """A tree of elements and text pieces. Elements are numbered in page order."""
    root = Node("", 0, 0)
    stack, at, n = [root], 0, 1
    # what stands in a raw element is never looked at for tags
    while m := TOKEN.search(html, at):
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if not m[0].endswith(">"):  # cut off within a tag
            continue
        if tag in P_CLOSERS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    del stack[i:]
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "tr", "select"):
                    break
        node = Node(tag, 2 if tag in SKIP else _named(tag, m[3]) if m[3] else 0, n)
        n += 1
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else len(html)])
            at = end.end() if end else len(html)
        elif tag not in VOID and not m[3].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    if at < len(html):
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z/!?][^<]*\Z", rest)
        stack[-1].children.append(rest[: cut.start()] if cut else rest)
    settle(root)
    return root


def _named(tag: str, attributes: str) -> int:
    if tag in ("html", "body", "main"):
        return 0
    out = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in SKIP_ROLES or name == "style" and HIDDEN.search(value):
            return 2
        if name in ("class", "id"):
            telling = SURE_WORDS if tag in TEXTUAL else SKIP_WORDS
            for token in value.split():
                words = set(WORDS.findall(token))
                loose = tag not in TEXTUAL and words & LOOSE_WORDS and not words & BACK_WORDS
                if loose or words & telling and words <= SKIP_WORDS | BESIDE_WORDS:
                    out = 3 if loose or words & COMMENT_WORDS or out == 3 else 1
    return out


def settle(root: Node) -> None:
    """Decides which elements are skipped; what stands in a skipped element is skipped."""
    order: list[tuple[Node, bool]] = [(root, False)]
    for node, inside in order:  # grows while it is read: parents before children
        inside = inside or node.tag in ("article", "main")
        if node.tag == "header" and not inside:
            node.named = 2
        order += ((c, inside) for c in node.children if isinstance(c, Node))
    size: dict[int, int] = {}
    holds: dict[int, int] = {}  # 2: the page's first heading or the main element, 1: an article
    first: Node | None = None
    hidden: set[int] = set()
    for node in walked(root):
        if node.named == 2 or node.number in hidden:
            hidden.update(c.number for c in elements(node))
        elif first is None and node.tag == "h1":
            first = node
    for node, _ in reversed(order):
        if node.named == 2:
            size[node.number], holds[node.number] = 0, 0
            continue
        below = [c for c in node.children if isinstance(c, Node)]
        size[node.number] = sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str)) + sum(size[c.number] for c in below)
        own = 2 if node is first or node.tag == "main" else int(node.tag == "article" and not node.named)
        holds[node.number] = max([own, *(holds[c.number] for c in below)])
    total = size[root.number]
    for node, _ in order:
        if not node.skip:
            exempt = holds[node.number] > (node.named == 3) or size[node.number] >= NEARLY_ALL * total
            node.skip = node.named == 2 or node.named > 0 and not exempt
        if node.skip:
            for c in elements(node):
                c.skip = True


def walked(root: Node) -> Iterator[Node]:
    """A node and what is below it, in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += reversed(elements(node))


def own_text(node: Node) -> str:
    """The text of a node that isn't in a block of its own, with inline elements, as it will be printed."""
    out: list[str] = []

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "br":
                out.append(" ")
            elif c.tag in INLINE and not c.skip and not any(isinstance(k, Node) and k.tag not in INLINE for k in c.children):
                walk(c)

    walk(node)
    return tidy("".join(out))


def tidy(raw: str) -> str:
    return SPACE.sub(" ", unescape(raw)).strip() if raw else ""


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


class _Shapes:
    """Trees of tags, told apart by numbers, with the weights of simple tree matching between them."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.all: list[tuple] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> int:
        """The number of a node's shape; its descendants get theirs."""
        if len(self.all) > REMEMBERED:
            raise OverflowError
        todo = [root]
        for node in todo:
            todo += elements(node)
        for node in reversed(todo):
            key = (node.tag, *(c.shape for c in elements(node)))
            known = self.ids.get(key)
            if known is None:
                known = self.ids[key] = len(self.all)
                self.all.append(key)
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
            node.shape = known
        return root.shape

    def weight(self, a: int, b: int) -> int:
        """How many nodes two trees have in common at best."""
        if a == b:
            return self.sizes[a]
        p, q = self.all[a], self.all[b]
        if p[0] != q[0]:
            return 0
        if len(p) == 1 or len(q) == 1:
            return 1
        if a > b:
            a, b, p, q = b, a, q, p
        known = self.weights.get((a, b))
        if known is None:
            known = self.weights[a, b] = 1 + sum(w for _, _, w in self.pairs(p[1:], q[1:]))
        return known

    def pairs(self, p: tuple, q: tuple) -> list[tuple[int, int, int]]:
        """(place in p, place in q, weight): the children's match of the greatest sum, in order."""
        i = 0
        while i < len(p) and i < len(q) and p[i] == q[i]:
            i += 1
        j = 0
        while j < len(p) - i and j < len(q) - i and p[-1 - j] == q[-1 - j]:
            j += 1
        # equal trees at the ends match each other in some best match
        out = [(k, k, self.sizes[p[k]]) for k in range(i)]
        out += ((x + i, y + i, w) for x, y, w in self._middle(p[i : len(p) - j], q[i : len(q) - j]))
        return out + [(len(p) - k, len(q) - k, self.sizes[p[-k]]) for k in range(j, 0, -1)]

    def _row(self, x: int, q: tuple, places: dict):
        import numpy as np

        out = np.zeros(len(q), dtype=np.int64)
        for y, at in places.items():
            if w := self.weight(x, y):
                out[at] = w
        return out

    def _middle(self, p: tuple, q: tuple) -> list[tuple[int, int, int]]:
        if not p or not q:
            return []
        if len(p) * len(q) <= 400:
            return self._small(p, q)
        import numpy as np

        places: dict[int, list[int]] = {}
        for k, y in enumerate(q):
            places.setdefault(y, []).append(k)
        known: dict[int, object] = {}

        def row(x: int):
            if x not in known:
                known[x] = self._row(x, q, places)
            return known[x]

        def last_rows(a: int, z: int, c: int, d: int, back: bool):
            """The best sums of p[a:z] with every beginning of q[c:d] (ends, if back)."""
            best = np.zeros(d - c + 1, dtype=np.int64)
            for k in range(z - 1, a - 1, -1) if back else range(a, z):
                w = row(p[k])[c:d]
                new = np.maximum(best[1:], best[:-1] + (w[::-1] if back else w))
                best[1:] = np.maximum.accumulate(new)
            return best[::-1] if back else best

        out: list[tuple[int, int, int]] = []
        todo = [(0, len(p), 0, len(q))]
        while todo:
            a, z, c, d = todo.pop()
            if a == z or c == d:
                continue
            if (z - a) * (d - c) > TABLE and z - a > 1:
                # the best match goes through some column at the middle row
                mid = (a + z) // 2
                cut = c + int(np.argmax(last_rows(a, mid, c, d, False) + last_rows(mid, z, c, d, True)))
                todo += [(a, mid, c, cut), (mid, z, cut, d)]
                continue
            table = np.zeros((z - a + 1, d - c + 1), dtype=np.int64)
            for k in range(a, z):
                table[k - a + 1, 1:] = np.maximum.accumulate(np.maximum(table[k - a, 1:], table[k - a, :-1] + row(p[k])[c:d]))
            i, j = z - a, d - c
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j, int(row(p[a + i])[c + j])))
        return sorted(out)

    def _small(self, p: tuple, q: tuple) -> list[tuple[int, int, int]]:
        weights = [[self.weight(x, y) for y in q] for x in p]
        best = [[0] * (len(q) + 1)]
        for own in weights:
            last, new = best[-1], [0]
            for j, w in enumerate(own):
                new.append(max(last[j] + w, last[j + 1], new[j]))
            best.append(new)
        i, j, out = len(p), len(q), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j, weights[i][j]))
        return out[::-1]


_shapes = _Shapes()


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The nodes that simple tree matching pairs; none if the roots' tags differ."""
    global _shapes
    # a level of elements takes two or three calls
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * DEEPEST))
    if len(_shapes.all) > REMEMBERED // 2 or len(_shapes.weights) > REMEMBERED:
        _shapes = _Shapes()
    try:
        _shapes.of(a), _shapes.of(b)
    except OverflowError:  # one page of very many shapes
        _shapes = _Shapes()
        _shapes.of(a), _shapes.of(b)
    if a.tag != b.tag:
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        p, q = elements(x), elements(y)
        if p and q:
            todo += ((p[i], q[j]) for i, j, w in _shapes.pairs(_shapes.all[x.shape][1:], _shapes.all[y.shape][1:]) if w)
    return out


def headings(root: Node) -> dict[str, str]:
    """The texts of a page's title and first heading."""
    out: dict[str, str] = {}
    for node in walked(root):
        if node.tag in ("title", "h1") and node.tag not in out and (node.tag == "title" or not node.skip):
            out[node.tag] = tidy(text_of(node))
    return out


def votes(pivot: Node, page: Node) -> list[tuple[int, int]]:
    """(pivot's node number, 1 if the page has the same text there) for matched nodes with text of their own.

    A copy of the pivot's article has no vote: a page with the same title and heading, most of whose text is the pivot's and little is
    its own. How much template the host has doesn't matter, since another article has another heading or enough text of its own.
    """
    both = [(x.number, s, own_text(y)) for x, y in match(pivot, page) if not x.skip and (s := own_text(x))]
    total = sum(len(s) for _, s, _ in both)
    same = sum(len(s) for _, s, t in both if s == t)
    if not total:
        return []
    if same > SAME_ARTICLE * total and total - same < OWN_TEXT * total:
        one, two = headings(pivot), headings(page)
        if all(one[k] == two[k] for k in one.keys() & two.keys()):
            return []
    return [(n, int(s == t)) for n, s, t in both]


def _links_only(node: Node) -> bool:
    """A list, or a box without running text, of three links or more and nothing else."""
    if node.tag not in ("ul", "ol", "div", "section", "table"):
        return False
    links, todo = 0, [node]
    while todo:
        x = todo.pop()
        if x.tag == "a":
            links += 1
            continue
        if x.tag in ("p", "h1", "h2", "h3") or any(isinstance(c, str) and any(k.isalnum() for k in unescape(c)) for c in x.children):
            return False
        todo += elements(x)
    return links >= 3


def extract(page: Node, pivot: Node | None = None, constant: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of the main text. ``constant`` numbers nodes of the pivot that are template."""
    template: dict[int, str] = {}
    if pivot is not None and constant:
        template = {y.number: own_text(x) for x, y in match(pivot, page) if x.number in constant}
    mains: list[Node] = []

    def find(node: Node) -> None:
        for c in elements(node):
            if c.skip:
                continue
            if c.tag in ("article", "main"):
                mains.append(c)
            else:
                find(c)

    find(page)
    found: list[str] = []
    now: list[str] = []

    def flush(node: Node) -> None:
        text = tidy("".join(now))
        now.clear()
        if text and template.get(node.number) != text:
            found.append(text)

    def walk(node: Node, holder: Node, menus: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                now.append(c)
            elif c.tag == "br":
                now.append(" ")
            elif c.skip or menus and _links_only(c):
                continue
            elif c.tag in INLINE:
                walk(c, holder, menus)
            else:
                flush(holder)
                walk(c, c, menus)
                flush(c)

    for m in mains:
        walk(m, m, False)
        flush(m)
    if not found and (not mains or not any(tidy(text_of(m)) for m in mains)):
        walk(page, page, True)
        flush(page)
    return found


def text_of(node: Node) -> str:
    return "".join(c if isinstance(c, str) else text_of(c) for c in node.children if isinstance(c, str) or not c.skip)


def _host(url) -> object:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def pages_of(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", _host(F.col("url")))


def _beside(pages: DataFrame, hosts: DataFrame, size: int) -> DataFrame:
    """Pages with their host's row of ``hosts``, which counts the host's pages in n."""
    if size <= BROADCAST_BYTES and hosts.count() <= BROADCAST_ROWS:
        return pages.join(F.broadcast(hosts), "host", "left")
    # the join sorts by host, so that a task parses a pivot once
    return salted_join(pages, hosts, "host", "n", F.col("page_id"), pages.count(), "left")


class _Pivots:
    """The last pivots that a task has parsed, up to PIVOT_BYTES of them."""

    def __init__(self) -> None:
        self.trees: OrderedDict[str, tuple[Node, int]] = OrderedDict()
        self.bytes = 0

    def __call__(self, host: str, html: str) -> Node:
        if host in self.trees:
            self.trees.move_to_end(host)
        else:
            self.trees[host] = (parse(html), len(html))
            self.bytes += len(html)
            while self.bytes > PIVOT_BYTES and len(self.trees) > 1:
                self.bytes -= self.trees.popitem(last=False)[1][1]
        return self.trees[host][0]


def templates(pages: DataFrame) -> DataFrame:
    """(host, pivot, constant): the pivot page of each host and the numbers of its constant nodes."""
    first = pages.where("html <> ''").groupBy("host").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n"))
    chosen = sized_broadcast(checkpoint(first.where(f"n > {MIN_VOTES}").select("host", "page_id", "n")), 104)
    pivots = checkpoint(pages.where("html <> ''").join(chosen, ["host", "page_id"]).groupBy("host").agg(F.min("html").alias("pivot"), F.max("n").alias("n")))
    size = pivots.agg(F.coalesce(F.sum(F.octet_length("pivot") + 64), F.lit(0))).first()[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pivot = _Pivots()
        for b in blocks(batches, 1):
            counts: dict[tuple[str, int], list[int]] = {}
            for host, html, other in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if other is not None and html:
                    for n, same in votes(pivot(host, other), parse(html)):
                        c = counts.setdefault((host, n), [0, 0])
                        c[0] += 1
                        c[1] += same
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())],
                ["host", "node", "seen", "same"],
            )

    beside = _beside(pages, pivots, size).select("host", "html", "pivot")
    counted = beside.mapInArrow(run, "host string, node int, seen long, same long").groupBy("host", "node").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    # a host's constant nodes are at most the nodes of one page
    constant = counted.where((F.col("seen") >= MIN_VOTES) & (F.col("same") >= CONSTANT * F.col("seen"))).groupBy("host").agg(F.collect_list("node").alias("constant"))
    return checkpoint(pivots.join(constant, "host"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars."""
    pages = pages_of(pages)
    known = templates(pages)
    size = known.agg(F.coalesce(F.sum(F.octet_length("pivot") + 8 * F.size("constant") + 64), F.lit(0))).first()[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        pivot = _Pivots()
        for b in blocks(batches, 3):
            texts = []
            for host, html, other, constant in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                page = parse(html)
                texts.append("\n\n".join(extract(page) if other is None else extract(page, pivot(host, other), frozenset(constant))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    beside = _beside(pages, known, size).select("page_id", "url", "host", "html", "pivot", "constant")
    return checkpoint(beside.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long")))
