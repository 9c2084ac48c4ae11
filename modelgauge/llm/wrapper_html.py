"""Main text of web pages by wrapper induction.

The pages of a host are aligned with the host's seed page (its smallest page_id) by simple tree matching: two nodes match if their
names agree, and the children of matched nodes are aligned in order for the largest number of matched nodes. Over all different pages
of the host, each block of the seed is counted with how many pages align with it and have its text; inline elements belong to the
block around them. Blocks that nearly all pages share with the same text are template, the others are slots. A page's text is taken
from its slots, inside and outside of article elements.

What a page itself marks is a supplement: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out if their element, role or hidden attribute says so, or if a whole word of their class or id does. Such a word
is weak evidence: it never drops a block that holds an article (or main) element or, on a page without any, more than half of the page's
text. On a host with fewer than LEAST_PAGES different pages, and on a page that the template would leave without any text, the text is
that of the article (or main) element, or else of the whole page.

Null or empty html gives empty text; a null or odd url belongs to the host ''. Broken markup (unclosed elements, a page cut off in the
middle of a tag) is read as far as it goes; nesting may be of any depth, a page of any length. Equal pages of a host count once, because
a copy does not tell template from content; rows that repeat a page are rows of their own. Further columns may have any name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelgauge.llm.common import slices, stored

#: Pages of a host that are aligned by one task.
BLOCK_PAGES = 512
#: A block is template if at least this share of the host's pages align with it and have its text.
SHARE = 0.8
LEAST_PAGES = 3
#: Pairs of shapes remembered before a task starts afresh.
SHAPES_LIMIT = 200_000

# Fixed values of the HTML format and of common page markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template iframe nav aside footer form button select textarea input svg canvas object dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer notice notices cookie cookies consent "
    "popup modal newsletter subscribe comment comments respond discussion share sharing social related site-nav site-menu main-nav main-menu top-nav site-footer page-footer page-sidebar "
    "site-sidebar cookie-banner cookie-notice cookie-bar ad-slot ad-banner comment-list comments-area comment-section related-posts related-articles share-buttons social-links".split()
)
TOPS = frozenset("header masthead site-header page-header".split())
REPLIES = frozenset("comment comments respond discussion reply replies comment-list".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    """kind: 'drop' (never content), 'weak' (not content, says its class; gone once a page is parsed), 'header' (not content outside of the
    article), 'main' or ''. article: an article element stands in it."""

    __slots__ = ("name", "kind", "children", "index", "shape", "article")

    def __init__(self, name: str, kind: str):
        self.name, self.kind = name, kind
        self.children: list[Node | str] = []
        self.index = self.shape = -1
        self.article = False

    def nodes(self) -> list[Node]:
        """Child elements; a dropped block counts as a bare one."""
        return [] if self.kind == "drop" else [c for c in self.children if isinstance(c, Node)]

    def own_text(self) -> str:
        """Text of a block without the blocks in it; inline elements have none of their own."""
        if self.name in INLINE:
            return ""
        out, open_ = [], [self]
        while open_:
            x = open_.pop()
            if isinstance(x, str):
                out.append(x)
            elif x is self or (x.name in INLINE and x.kind != "drop"):
                open_ += reversed(x.children)
            else:
                out.append(" ")
        return " ".join("".join(out).split())


def _settled(root: Node) -> Node:
    """Decides weak blocks by what they hold, bottom up."""
    order = [root]
    for node in order:
        order.extend(node.nodes())
    size: dict[int, int] = {}
    main: set[int] = set()
    for node in reversed(order):
        kept = [c for c in node.nodes() if c.kind != "drop"]
        size[id(node)] = sum(size[id(c)] for c in kept) + sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.article = any(c.article or c.name == "article" for c in kept)
        if any(c.kind == "main" or id(c) in main for c in kept):
            main.add(id(node))
    for node in order:
        if node.kind == "weak":
            node.kind = "" if id(node) in main or (not main and 2 * size[id(node)] > size[id(root)]) else "drop"
    return root


def parse(page: str | None) -> Node:
    """Tree of a page; nodes are numbered in page order."""
    root = Node("#root", "")
    stack, count, skip_to = [root], 0, 0
    text, names = page or "", Counter()

    def close(depth: int) -> None:
        names.subtract(n.name for n in stack[depth:])
        del stack[depth:]

    for m in _TOKEN.finditer(text):
        if m.start() < skip_to:
            continue
        token = m.group()
        if m.group(2) is None:
            if token[0] != "<" or token == "<":
                stack[-1].children.append(html.unescape(token))
            continue
        if not m.group(4):
            continue  # cut off inside the tag
        name = m.group(2).lower()
        if m.group(1):
            if names[name] > 0:
                close(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].name == name))
            continue
        if name in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    close(depth)
                    break
                if stack[depth].name not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            like = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(name, (name,))
            while len(stack) > 1 and (stack[-1].name in like or stack[-1].name in INLINE or stack[-1].name == "p") and any(names[n] > 0 for n in like):
                close(len(stack) - 1)
        node = Node(name, _kind(name, m.group(3)))
        node.index, count = count, count + 1
        stack[-1].children.append(node)
        if name in RAW and not m.group(3).rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(text, m.end())
            stop = end.start() if end else len(text)
            node.children.append(text[m.end() : stop])
            skip_to = end.end() if end else len(text)
        elif name not in VOID and not m.group(3).rstrip().endswith("/"):
            stack.append(node)
            names[name] += 1
    return _settled(root)


def _kind(name: str, attributes: str) -> str:
    if name in DROPPED:
        return "drop"
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    role = found.get("role", "").lower()
    if name not in ("html", "body", "main"):
        if role in ROLES or "hidden" in attributes.lower().split():
            return "drop"
        names = set((found.get("class", "") + " " + found.get("id", "")).lower().split())
        if names & (REPLIES if name == "article" else WORDS):
            return "weak"
        if name == "header" or (names & TOPS and name != "article"):
            return "header"
    return "main" if name in ("article", "main") or role in ("main", "article") else ""


class Shapes:
    """Numbers for the shapes of subtrees (names only), and the largest alignment of any two shapes."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.size: list[int] = []
        self.best: dict[tuple[int, int], int] = {}

    def mark(self, root: Node) -> None:
        """Set the shape of every node of a tree."""
        order = [root]
        for node in order:
            order.extend(node.nodes())
        for node in reversed(order):
            key = (node.name, tuple(c.shape for c in node.nodes()))
            if key not in self.number:
                self.number[key] = len(self.parts)
                self.parts.append(key)
                self.size.append(1 + sum(self.size[c] for c in key[1]))
            node.shape = self.number[key]

    def weight(self, a: int, b: int) -> int:
        """Nodes in the largest alignment of two shapes; 0 if their names differ."""
        open_ = [(a, b)]
        while open_:
            p, q = open_[-1]
            if self.known(p, q) is not None:
                open_.pop()
                continue
            (_, x), (_, y) = self.parts[p], self.parts[q]
            front, back = ends(x, y)
            inner_x, inner_y = x[front : len(x) - back], y[front : len(y) - back]
            wanted = [(u, v) for u in set(inner_x) for v in set(inner_y) if self.known(u, v) is None]
            if wanted:
                open_ += wanted
                continue
            found = 1 + sum(self.size[c] for c in x[:front]) + sum(self.size[c] for c in x[len(x) - back :])
            if inner_x and inner_y:
                row = np.zeros(len(inner_y) + 1, np.int64)
                for w in self.rows(inner_x, inner_y):
                    row = following(row, w)
                found += int(row[-1])
            self.best[p, q] = found
            open_.pop()
        return self.known(a, b)

    def known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.size[a]
        return 0 if self.parts[a][0] != self.parts[b][0] else self.best.get((a, b))

    def rows(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[np.ndarray]:
        """For each shape of x, its weights with all of y."""
        kinds, at = np.unique(np.array(y), return_inverse=True)
        known: dict[int, np.ndarray] = {}
        for p in x:
            if p not in known:
                known[p] = np.array([self.weight(p, int(k)) for k in kinds], np.int64)
            yield known[p][at]


def ends(x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, int]:
    """How many equal shapes two lists share at the front and, behind those, at the back: some largest alignment always pairs them."""
    least = min(len(x), len(y))
    front = next((i for i in range(least) if x[i] != y[i]), least)
    back = next((i for i in range(least - front) if x[-1 - i] != y[-1 - i]), least - front)
    return front, back


def following(row: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The next row of the alignment table."""
    out = row.copy()
    np.maximum(row[1:], row[:-1] + w, out=out[1:])
    return np.maximum.accumulate(out)


def aligned(x: tuple[int, ...], y: tuple[int, ...], shapes: Shapes) -> list[tuple[int, int]]:
    """Places of the pairs in the largest alignment of two lists of shapes, in order.

    Every step-th row of the table is kept and the rows between are made again on the way back, so memory grows with the width times
    the root of the length, and the pairs are those of the full table.
    """
    front, back = ends(x, y)
    pairs = [(i, i) for i in range(front)]
    tail = [(len(x) - i, len(y) - i) for i in range(back, 0, -1)]
    x, y = x[front : len(x) - back], y[front : len(y) - back]
    middle = []
    if x and y:
        step = max(1, math.isqrt(len(x)))
        kept, row = [], np.zeros(len(y) + 1, np.int64)
        for i, w in enumerate(shapes.rows(x, y)):
            if i % step == 0:
                kept.append(row)
            row = following(row, w)
        j = len(y)
        for block in range(len(kept) - 1, -1, -1):
            part = x[block * step : (block + 1) * step]
            table, weights = [kept[block]], list(shapes.rows(part, y))
            for w in weights:
                table.append(following(table[-1], w))
            i = len(part)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    middle.append((front + block * step + i, front + j))
    return pairs + middle[::-1] + tail


def match(a: Node, b: Node, shapes: Shapes | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two nodes with one name: size of the largest alignment, and its pairs."""
    if shapes is None:
        shapes = Shapes()
        shapes.mark(a)
        shapes.mark(b)
    pairs = [(a, b)]
    for s, p in pairs:
        x, y = s.nodes(), p.nodes()
        if x and y:
            pairs += [(x[i], y[j]) for i, j in aligned(tuple(n.shape for n in x), tuple(n.shape for n in y), shapes)]
    return shapes.weight(a.shape, b.shape), pairs


def main_text(root: Node, template: frozenset[int] | None) -> str:
    """Text of the content blocks, one space between them: what is not template, or what the page marks if that is nothing."""
    if template is not None:
        found = _written([root], template, False)
        if found:
            return found
    mains, open_ = [], [root]
    while open_:
        node = open_.pop()
        if node.kind == "main" and not (node.name == "main" and node.article):
            mains.append(node)
        elif node.kind != "drop":
            open_ += reversed(node.nodes())
    return _written(mains, frozenset(), True) if mains else _written([root], frozenset(), False)


def _written(tops: list[Node], template: frozenset[int], marked: bool) -> str:
    out: list[str] = []
    open_: list[tuple[Node | str, bool, bool]] = [(x, marked, True) for top in reversed(tops) for x in (top, " ")]
    while open_:
        x, inside, own = open_.pop()
        if isinstance(x, str):
            if own:
                out.append(x)
            continue
        if x.name not in INLINE:
            own = x.index not in template
        parts: list[tuple[Node | str, bool, bool]] = []
        for c in x.children:
            if isinstance(c, str):
                parts.append((c, inside, own))
            elif c.kind == "drop" or (c.kind == "header" and not inside):
                parts.append((" ", inside, True))
            else:
                edge = [(" ", inside, True)] if c.name not in INLINE else []
                parts += [*edge, (c, inside or c.kind == "main", own), *edge]
        open_ += reversed(parts)
    return " ".join("".join(out).split())


class Seeds:
    """The seed tree of the host at hand, with the alignments of shapes found so far."""

    def __init__(self) -> None:
        self.seed: tuple[str, str] | None = None

    def shared(self, host: str, seed: str, page: Node) -> list[tuple[Node, Node]]:
        """Pairs of aligned blocks of the seed and of a page that have the same text."""
        if self.seed != (host, seed) or len(self.shapes.best) > SHAPES_LIMIT:
            self.seed, self.shapes, self.tree = (host, seed), Shapes(), parse(seed)
            self.shapes.mark(self.tree)
        self.shapes.mark(page)
        return [(s, p) for s, p in match(self.tree, page, self.shapes)[1] if s.index >= 0 and "drop" not in (s.kind, p.kind) and (text := s.own_text()) and text == p.own_text()]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Record batches with the (host, block, seed, template) that stands before each of their rows, None where there is none."""
    at: tuple = (None, None, None, None)
    for whole in batches:
        for batch in slices(whole, "html", 1 << 20):
            over = []
            for key in zip(*(batch.column(c).to_pylist() for c in ("host", "block", "kind", "html", "template")), strict=True):
                if key[2] == 0:
                    at = (key[0], key[1], key[3], key[4])
                over.append(at if at[:2] == key[:2] else None)
            yield batch, over


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = Seeds()
    for batch, over in _dealt(batches):
        rows, nodes = [], []
        for i, (kind, page, seed) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("html").to_pylist(), over, strict=True)):
            if kind and seed:
                rows.append(i)
                nodes.append([s.index for s, _ in seeds.shared(seed[0], seed[2], parse(page))])
        kept = batch.select(["host", "copy"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(nodes, pa.list_(pa.int32()))], ["host", "copy", "nodes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = Seeds()
    for batch, over in _dealt(batches):
        rows, texts = [], []
        for i, (kind, page, seed) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("html").to_pylist(), over, strict=True)):
            if not kind:
                continue
            root, drop = parse(page), None
            if seed:
                wanted = set(seed[3])
                drop = frozenset(p.index for s, p in seeds.shared(seed[0], seed[2], root) if s.index in wanted) if wanted else frozenset()
            rows.append(i)
            texts.append(main_text(root, drop))
        kept = batch.select(["others"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], ["others", "text"])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def _blocks(rows: DataFrame, hosts: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows of `rows` (host, page_id, html, ...) in blocks of some BLOCK_PAGES pages of a host, each behind one row of `seeds` (host, n, html, template).

    Only hosts of several blocks are looked up, so pages of all others are exchanged once.
    """
    cut = F.ceil(F.col("n") / BLOCK_PAGES).cast("int")
    many = hosts.where(F.col("n") > BLOCK_PAGES).select("host", cut.alias("blocks"))
    block = F.pmod(F.xxhash64("html", "page_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    pages = rows.join(many, "host", "left").withColumns({"block": block, "kind": F.lit(1)}).drop("blocks", "page_id")
    heads = seeds.withColumn("block", F.explode(F.sequence(F.lit(0), cut - 1))).withColumn("kind", F.lit(0)).drop("n")
    return pages.unionByName(heads, allowMissingColumns=True).repartition("host", "block").sortWithinPartitions("host", "block", "kind")


def templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hosts (host, n) of `pages` (host, page_id, html), and host, n, html (of the seed) and template array<int> (numbers of the seed's
    template blocks) of those with LEAST_PAGES different pages."""
    full = pages.where("html IS NOT NULL")
    hosts = stored(full.groupBy("host").agg(F.min_by("html", F.struct("page_id", "html")).alias("html"), F.count("*").alias("n")), "hosts")
    seeds = hosts.where(F.col("n") >= LEAST_PAGES).withColumn("template", F.lit(None).cast("array<int>"))
    dealt = _blocks(full.select("host", "page_id", "html", F.xxhash64("html").alias("copy")), hosts, seeds)
    different = dealt.mapInArrow(_aligned, "host string, copy long, nodes array<int>").dropDuplicates(["host", "copy"])
    counts = different.select("host", F.explode(F.concat(F.array(F.lit(-1)), "nodes")).alias("node")).groupBy("host", "node").agg(F.count("*").alias("same"))  # -1 counts the pages
    pages_of = F.max(F.when(F.col("node") == -1, F.col("same"))).alias("n")
    host = counts.groupBy("host").agg(pages_of, F.collect_list(F.struct("node", "same")).alias("c"))
    fixed = F.transform(F.filter("c", lambda x: (x["node"] >= 0) & (x["same"] >= F.col("n") * SHARE)), lambda x: x["node"])
    found = host.where(F.col("n") >= LEAST_PAGES).select("host", fixed.alias("template"))
    return hosts, stored(hosts.join(found, "host"), "templates")


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` columns and text of every row of `pages` (page_id, url, html)."""
    rows = pages.select(F.struct(*keep).alias("others"), host_of(F.col("url")).alias("host"), "page_id", "html")
    hosts, known = templates(rows.select("host", "page_id", "html"))
    found = _blocks(rows, hosts, known).mapInArrow(_extract, rows.select("others").schema.add("text", "string"))
    return found.select("others.*", "text")
