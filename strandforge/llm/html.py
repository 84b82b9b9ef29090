"""Main-text extraction by wrapper induction over pages of the same host."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Generator, Iterator
from html import unescape
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandforge.llm.common import cut, record_batch

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.DOTALL)
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript xmp iframe".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
_NEVER = frozenset("script style noscript template nav footer aside form button select option input textarea iframe svg canvas object embed audio video head menu dialog title meta link map".split())
_CONTROLS = frozenset("form button select input textarea".split())
_P_ENDS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article main section div table ul ol body html td th blockquote aside nav footer header form".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that name what isn't the article, also beside other names.
_NOISE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored sidebar nav navigation navbar breadcrumb breadcrumbs footer cookie cookies gdpr popup modal newsletter signup login pagination pager toolbar comment comments commentlist respond replies disqus contentinfo complementary".split())
#: Words that name it only alone, and that else are noise where links or controls say so too.
_DOUBTFUL = frozenset("adv banner promo promotion menu consent notice notices privacy overlay subscribe share sharing social related recommended recommendations widget masthead reply discussion skip hidden search alert".split())
#: Words beside which a name still stands alone.
_FILLER = frozenset("a area bar block body bottom box btn button buttons col column container content cta group icons inline inner item items js l left link links list main module outer panel posts primary region right row secondary section side site slot text title top unit ui widget wrap wrapper".split())
#: Names that mark noise however large it is; another name on most of a page's text (``with-sidebar``) marks a layout.
_ALWAYS = frozenset("comment comments commentlist respond replies disqus nav navigation footer".split())
_HEADER = frozenset("header masthead topbar".split())
_TOKEN = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
#: Children that are aligned by a whole table on either side; more are anchored by what occurs once in both.
_WIDE = 200


class Node:
    __slots__ = ("attrs", "children", "digest", "header", "links", "noise", "order", "parent", "shape", "sign", "size", "sure", "tag", "text", "texts", "words")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.children, self.text, self.parent = tag, attrs, [], "", parent
        self.sign, self.noise, self.sure, self.header = tag, False, False, False


def parse(html: str) -> Node:
    return lay_out(parse_tree(html))


def parse_tree(html: str) -> Node:
    """A forgiving tree: void and raw elements, implied ends of p, li, dt, dd, td, th and tr, and stray end tags are handled.

    Text nodes have tag "" and hold decoded text.  The root's ``order`` lists all nodes, parents before children.
    """
    root = Node("#root")
    order = root.order = [root]
    stack, at, n = [root], 0, len(html)
    opens: dict[str, int] = {}
    last = html.rfind(">")

    def close(k: int) -> None:
        for x in stack[k:]:
            opens[x.tag] -= 1
        del stack[k:]

    def put(node: Node) -> Node:
        stack[-1].children.append(node)
        order.append(node)
        return node

    def add(text: str) -> None:
        if text and not text.isspace():
            put(Node("", "", stack[-1])).text = unescape(text) if "&" in text else text
        elif text and stack[-1].children:
            put(Node("", "", stack[-1])).text = " "

    while at < n:
        m, seek = _TAG.search(html, at), at
        rest = None
        while m is not None and m[2] and (m.end() > last or (rest := _REST.match(html, m.end())) is None):
            seek = m.start() + 1  # no end: text
            m = _TAG.search(html, seek)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        tag = m[2]
        if tag is None:
            at = m.end()
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        at, attrs = rest.end(), rest[1]
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                put(Node("br", "", stack[-1]))
                continue
            block = tag not in _INLINE
            for k in range(len(stack) - 1, 0, -1) if opens.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if not block and stack[k].tag not in _INLINE:
                    break  # an inline end tag doesn't close blocks
                if tag == "p" and stack[k].tag in _SCOPE:
                    break
            continue
        if tag in _P_ENDS and opens.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        if tag in _CLOSES and any(opens.get(x) for x in _CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    close(k)
                    if tag != "tr" or stack[-1].tag != "tr":
                        break
                elif stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        node = put(Node(tag, attrs, stack[-1]))
        if tag in _VOID or attrs.endswith("/") and tag not in _INLINE and tag not in _P_ENDS and tag not in _SCOPE:
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(html, at)
            body = html[at : end.start() if end else n]
            if tag in ("title", "textarea"):
                node.text = unescape(body)
            at = end.end() if end else n
            continue
        stack.append(node)
        opens[tag] = opens.get(tag, 0) + 1
    return root


def _name(node: Node) -> str:
    """Set the node's signature for alignment and what its tag and names say; the kind of its name: "", noise, layout? or links?."""
    a = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)} if "=" in node.attrs else {}
    node.sign = f"{node.tag}.{a['class']}" if "class" in a else node.tag
    node.sure = node.tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody"
    tokens = [_TOKEN.findall(x) for x in f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".lower().split()] if a else []
    words = [w for t in tokens for w in t]
    node.header = node.tag == "header" or not _HEADER.isdisjoint(words)
    if node.tag in _NEVER:
        return "noise"
    if node.sure or node.tag in ("html", "body"):
        return ""
    if "hidden" in node.attrs.lower().split() or a.get("aria-hidden") == "true":
        return "layout?"
    named = _NOISE | _DOUBTFUL
    if named.isdisjoint(words):
        return ""
    # a name stands alone if nothing but fillers, numbers and such names are beside it
    alone = [all(w in named or w in _FILLER or w.isdigit() for w in t) for t in tokens]
    if any(x and not _NOISE.isdisjoint(t) for t, x in zip(tokens, alone, strict=True)) or all(alone):
        return "noise" if not _ALWAYS.isdisjoint(words) else "layout?"
    return "links?"


def lay_out(root: Node) -> Node:
    """Digests, sizes and kinds of all nodes, from the leaves up.

    Nodes named like noise that hold most of a page's text are layout, unless their name can only be noise; a name beside other
    words is noise only on what is mostly links or has controls.
    """
    doubtful: list[Node] = []
    controls: set[int] = set()
    for node in reversed(root.order):
        if not node.tag:
            words = node.text.split()
            node.digest, node.shape, node.size, node.words, node.links = hash(("", *words)), 0, 1, len(words), 0
            continue
        kind = _name(node) if node.attrs or node.tag in _NEVER else ""
        if not node.attrs:
            node.sure, node.header = node.tag in ("article", "main"), node.tag == "header"
        size, words, links = 1, 0, 0
        parts: list = [node.sign]
        for c in node.children:
            parts.append(c.digest)
            size += c.size
            if c.noise is not True:
                words += c.words
                links += c.links
            if id(c) in controls or c.tag in _CONTROLS:
                controls.add(id(node))
        node.shape = hash((node.sign, *[c.shape for c in node.children]))
        if node.text:
            parts.append(node.text)
        node.digest, node.size, node.words = hash(tuple(parts)), size, words
        node.links = words if node.tag == "a" else links
        if kind == "links?":
            kind = "layout?" if 2 * node.links >= words or id(node) in controls else ""
        if kind == "layout?":
            doubtful.append(node)
        node.noise = kind == "noise"
    root.texts = frozenset([x.digest for x in root.order if not x.tag and x.words])
    for node in doubtful:
        node.noise = not (node.words > 0.6 * root.words and any(c.tag for c in node.children))
    return root


#: Steps of an alignment: it asks for the weights of pairs that aren't known yet and returns its result.
Steps = Generator[tuple[Node, Node], int, Any]


def _known(a: Node, b: Node, memo: dict) -> int | None:
    """The weight of a pair where no children need to be aligned for it."""
    if a.sign != b.sign:
        return 0
    if a.shape == b.shape:
        return a.size  # all their nodes pair up
    if not a.children or not b.children:
        return 1
    return memo.get((id(a), id(b)))


def _run(steps: Steps, memo: dict) -> Any:
    """The result of some steps; weights that they ask for are found on a stack of one's own, so depth is bounded by memory alone."""
    stack: list[tuple[tuple[int, int] | None, Steps]] = [(None, steps)]
    value = None
    while True:
        pair, own = stack[-1]
        try:
            x, y = own.send(value)
        except StopIteration as done:
            stack.pop()
            if pair is None:
                return done.value
            value = memo[pair] = 1 + done.value[0]
        else:
            stack.append(((id(x), id(y)), _aligned(x.children, y.children, memo)))
            value = None


def _match(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: the most nodes of two trees that pair up in order, level by level."""
    known = _known(a, b, memo)
    if known is None:
        known = memo[id(a), id(b)] = 1 + _run(_aligned(a.children, b.children, memo), memo)[0]
    return known


def _table(a: list[Node], b: list[Node], memo: dict) -> Steps:
    """The best ordered pairing, from the table of all pairs."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, x = table[i], table[i + 1], a[i]
        for j in range(len(b) - 1, -1, -1):
            y = b[j]
            best = below[j] if below[j] >= row[j + 1] else row[j + 1]
            if x.sign == y.sign:
                w = x.size if x.shape == y.shape else _known(x, y, memo)
                if w is None:
                    w = yield x, y
                if w + below[j + 1] >= best:
                    best = w + below[j + 1]
            row[j] = best
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if table[i][j] == table[i + 1][j]:
            i += 1
        elif table[i][j] == table[i][j + 1]:
            j += 1
        else:
            pairs.append((i, j))
            i, j = i + 1, j + 1
    return table[0][0], pairs


def _anchors(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of equal subtrees that occur once on both sides: the longest run that is in order on both."""
    once = []
    for xs in (a, b):
        seen: dict[int, int] = {}
        for i, x in enumerate(xs):
            seen[x.digest] = -1 if x.digest in seen else i
        once.append(seen)
    both = [(i, once[1][d]) for d, i in once[0].items() if i >= 0 and once[1].get(d, -1) >= 0]
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(both):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        tails[at : at + 1], ends[at : at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(both[k])
        k = back[k]
    return out[::-1]


def _in_turn(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """Pairs of the same signature, each with the next one that is left."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.sign, []).append(j)
    out, j = [], 0
    for i, x in enumerate(a):
        own = places.get(x.sign, [])
        k = bisect_left(own, j)
        if k < len(own):
            out.append((i, own[k]))
            j = own[k] + 1
    return out


def _align(xs: list[Node], ys: list[Node], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    return _run(_aligned(xs, ys, memo), memo)


def _aligned(xs: list[Node], ys: list[Node], memo: dict) -> Steps:
    """(nodes paired, pairs) of the best ordered pairing of two lists of children.

    Equal heads and tails are paired at once.  More than _WIDE children on a side are first anchored by equal subtrees that occur once;
    what then is still as wide pairs off in turn by signature, so that time grows with the children and not with their square.
    """
    head, least = 0, min(len(xs), len(ys))
    while head < least and xs[head].digest == ys[head].digest:
        head += 1
    tail = 0
    while tail < least - head and xs[-1 - tail].digest == ys[-1 - tail].digest:
        tail += 1
    total = sum([x.size for x in xs[:head]]) + sum([x.size for x in xs[len(xs) - tail :]])
    pairs = [(k, k) for k in range(head)]
    gaps = [(head, len(xs) - tail, head, len(ys) - tail)]
    if len(xs) - head - tail > _WIDE or len(ys) - head - tail > _WIDE:
        i0, j0, i1, j1 = head, head, len(xs) - tail, len(ys) - tail
        gaps = []
        for i, j in [*_anchors(xs[i0:i1], ys[j0:j1]), (i1 - head, j1 - head)]:
            gaps.append((i0, head + i, j0, head + j))
            if head + i < i1:
                pairs.append((head + i, head + j))
                total += xs[head + i].size
            i0, j0 = head + i + 1, head + j + 1
    for i0, i1, j0, j1 in gaps:
        a, b = xs[i0:i1], ys[j0:j1]
        if not a or not b:
            continue
        if not {x.digest for x in a}.intersection([y.digest for y in b]) and len({x.shape for x in a}.union([y.shape for y in b])) == 1:
            # rows of one shape without an equal pair: any ordered pairing is as good
            total += a[0].size * min(len(a), len(b))
            pairs += [(i0 + k, j0 + k) for k in range(min(len(a), len(b)))]
            continue
        if len(a) > _WIDE or len(b) > _WIDE:
            found = _in_turn(a, b)
            total += sum([x.size if x.shape == y.shape else 1 for x, y in ((a[i], b[j]) for i, j in found)])
        else:
            n, found = yield from _table(a, b, memo)
            total += n
        pairs += [(i0 + i, j0 + j) for i, j in found]
    pairs += [(len(xs) - k, len(ys) - k) for k in range(tail, 0, -1)]
    return total, pairs


def constant_nodes(page: Node, other: Node) -> set[int]:
    """Ids of the page's text nodes that the aligned tree of another page repeats."""
    out: set[int] = set()
    memo: dict = {}
    todo = [(page, other)]
    while todo:
        a, b = todo.pop()
        if a.digest == b.digest:
            under = [a]
            while under:
                x = under.pop()
                if not x.tag:
                    out.add(id(x))
                under += x.children
        elif a.children and b.children and a.noise is not True:  # what goes by its name needs no vote
            todo += [(a.children[i], b.children[j]) for i, j in _align(a.children, b.children, memo)[1]]
    return out


def body_texts(page: Node) -> list[Node]:
    """Text nodes that are under no noise, in page order."""
    out, todo = [], [page]
    while todo:
        node = todo.pop()
        if not node.tag:
            out.append(node)
        todo += [c for c in reversed(node.children) if c.noise is not True]
    return out


def _mark(node: Node) -> tuple[str, int]:
    return node.parent.sign, node.digest


def marks_of(page: Node) -> frozenset:
    """What a page tells as a witness: its texts and the signatures of the elements that hold them."""
    return frozenset(_mark(x) for x in body_texts(page) if x.words)


def template_of(page: Node, pivots: list[Node], witnesses: list[frozenset] | None = None, aligned: int = 3) -> dict[int, bool]:
    """Constant text nodes of the page; the value tells whether that is firm.

    The page is aligned with up to ``aligned`` pivots, and ``witnesses`` (the pivots, unless given) tell how much of the host
    repeats a text.  A page whose content is mostly the same is a copy and tells nothing; of the others at least two must be aligned.
    A node is constant if most of them and of the witnesses repeat it, and firmly so if all aligned pages do, and three in
    four of at least three witnesses.
    """
    body = [x for x in body_texts(page) if x.words]
    total = max(1, sum([x.words for x in body]))
    votes: dict[int, int] = {}
    told = 0
    own = {x.digest for x in body}
    for other in pivots:
        if told == aligned:
            break
        # without a text in common the alignment can find no constant node
        same = set() if own.isdisjoint(other.texts) else constant_nodes(page, other)
        if sum([x.words for x in body if id(x) in same]) > 0.6 * total:
            continue
        told += 1
        for x in same:
            votes[x] = votes.get(x, 0) + 1
    if told < 2:
        return {}
    nodes = [x for x in body if 2 * votes.get(id(x), 0) > told]
    if not nodes:
        return {}
    telling = [w for w in (witnesses if witnesses is not None else map(marks_of, pivots)) if sum([x.words for x in body if _mark(x) in w]) <= 0.6 * total]
    out = {}
    for x in nodes:
        share = sum([_mark(x) in w for w in telling])
        if 2 * share > len(telling):
            out[id(x)] = votes[id(x)] == told and len(telling) >= 3 and 4 * share >= 3 * len(telling)
    return out


def _content_root(page: Node, template: dict[int, bool]) -> tuple[Node, bool]:
    """The article: a node so named with the most varying text, else the deepest that holds most of the varying text."""
    weights: dict[int, int] = {}
    sure, best = None, 0
    for node in reversed(page.order):
        if not node.tag:
            weights[id(node)] = 0 if id(node) in template else node.words
            continue
        # link lists aren't the article
        weights[id(node)] = 0 if node.tag == "a" else sum([weights[id(c)] for c in node.children if c.noise is not True and not c.header])
        if node.sure and weights[id(node)] >= max(best, 1):  # of equal ones the first in page order
            sure, best = node, weights[id(node)]
    if sure is not None:
        return sure, True
    node, total = page, weights[id(page)]
    while total:
        big = next((c for c in node.children if c.tag and weights[id(c)] >= 0.8 * total and c.tag not in _INLINE and c.tag not in ("p", "h1", "h2", "li")), None)
        if big is None or big.noise is True:
            break
        node = big
    return node, False


def main_text(page: Node, template: dict[int, bool]) -> str:
    """The article's blocks, without noise and without template: inside a named article what is firmly so, else whatever is constant."""
    root, sure = _content_root(page, template)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            if text := _SPACE.sub(" ", "".join(line)).strip():
                blocks.append(text)
            line.clear()

    todo: list[tuple[Node | None, bool]] = [(root, False)]
    while todo:
        node, in_header = todo.pop()
        if node is None:
            flush()
        elif not node.tag:
            if not in_header and not (template.get(id(node), False) if sure else id(node) in template):
                line.append(node.text)
        elif node is root or node.noise is not True and (sure or not node.header):
            if node.tag not in _INLINE:
                flush()
                todo.append((None, False))
                # of an article's own header the headings stay
                in_header = node.header and node is not root or in_header and node.tag not in _HEADINGS
            todo += [(c, in_header) for c in reversed(node.children)]
    flush()
    return " ".join(blocks)


def host_of(url: str = "url") -> Column:
    """The URL's host in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def extract_text(pages: DataFrame, pivots: int = 4, witnesses: int = 12, group_rows: int = 300, most_hot: int = 20_000, most_broadcast: int = 1_000_000) -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the article's text.

    Every page is parsed and aligned by simple tree matching with ``pivots`` pages of its host.  Text that they repeat at the aligned
    place, and that most of the host's ``witnesses`` have, is template; the rest fills slots.  Both are the pages with the least
    hash of their html (copies count once).  Menus, adverts and the like, named as such by tag, class, id or role, are dropped
    whatever they hold, because they may vary from page to page.  A host with too few different pages has no template, only names.

    Pages are dealt by host, each group led by its witnesses; a host of more than ``group_rows`` pages (or a ``most_hot``-th
    of all, so that the table of such hosts is bounded) is dealt in several groups.  A task holds one page and one
    host's pivots at a time.

    Null html gives an empty text, and so does a page without text; a page without a host is aligned with none.  Very long pages
    are read whole, in time that grows with their nodes, at any depth.  Repeated rows give as many rows, a null id is kept,
    an empty table gives none, extra columns are ignored.  Among nodes of equal weight the first in page order is the article.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), host_of().alias("host"), F.xxhash64(html).alias("h"))
    n = pages.count()
    limit = max(group_rows, n // most_hot)
    hot = pages.select(host_of().alias("host")).filter("host is not null").groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    hot = hot.select("host", F.ceil(F.col("n") / limit).cast("long").alias("groups"))  # at most most_hot rows
    useful = own.filter("host is not null and html <> '' and page_id is not null").select("host", "page_id", "h")
    once = useful.groupBy("host", "h").agg(F.min("page_id").alias("page_id"))
    # by a part of the host first, so that no task ranks what all partitions hold of a hot host
    rank = lambda *by: F.row_number().over(Window.partitionBy("host", *by).orderBy("h"))
    first = once.withColumn("part", F.pmod("h", F.lit(64))).withColumn("rank", rank("part")).filter(F.col("rank") <= witnesses)
    picked = cut(first.withColumn("rank", rank()).filter(F.col("rank") <= witnesses).select(F.col("page_id").alias("_page"), F.col("h").alias("_h"), "rank"))
    if picked.count() <= most_broadcast:  # two longs and a number a row; beyond it pages are shuffled by id
        picked = F.broadcast(picked)
    groups = F.coalesce("groups", F.lit(1).cast("long"))
    dealt = own.join(F.broadcast(hot), "host", "left").join(picked, (own.page_id == F.col("_page")) & (own.h == F.col("_h")), "left")
    salt = F.when(F.col("host").isNull(), F.pmod(F.col("h"), F.lit(max(1, n // limit)))).otherwise(F.pmod(F.xxhash64("page_id", "h"), groups))
    # a witness leads every group of its host, and is a page of its own group
    salts = F.when(F.col("rank").isNull(), F.array(salt)).otherwise(F.sequence(F.lit(0).cast("long"), groups - 1))
    dealt = dealt.withColumn("own", salt).withColumn("salt", F.explode(salts)).select("host", "salt", F.coalesce("rank", F.lit(1 << 30)).alias("rank"), (F.col("salt") == F.col("own")).alias("counts"), "h", "html", "page_id", "url")
    group = ["host", "salt"]
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, marks, seen, waiting = None, [], [], set(), []

        def texts() -> Iterator[tuple]:
            """The witnesses' own texts, once all of them are there."""
            for page, url, html in waiting:
                tree = parse(html)
                yield page, url, main_text(tree, template_of(tree, known, marks))
            waiting.clear()

        def done(some) -> pa.RecordBatch:
            some = list(some)
            return record_batch(schema, [[x[0] for x in some], [x[1] for x in some], [x[2] for x in some], [len(x[2]) for x in some]])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for host, salt, rank_, counts, h, html, page, url in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    if (host, salt) != held:
                        out += texts()
                        held, known, marks, seen = (host, salt), [], [], set()
                    if rank_ <= witnesses:
                        if h not in seen:
                            seen.add(h)
                            tree = parse(html)
                            if len(known) < pivots:
                                known.append(tree)
                            marks.append(marks_of(tree))
                        if counts:
                            waiting.append((page, url, html))
                        continue
                    out += texts()
                    tree = parse(html)
                    out.append((page, url, main_text(tree, template_of(tree, known, marks))))
                yield done(out)
        yield done(texts())

    # partitions follow the pages, so that a task's time doesn't
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(n // 2000, 100_000))
    return dealt.repartition(parts, *group).sortWithinPartitions(*group, "rank", "h").mapInArrow(run, schema)
