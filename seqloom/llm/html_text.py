"""Main text of web pages with site style trees (operator 10).

Pages are parsed into trees of tags. The trees of a site are merged: nodes with the same path of styles (tag and class)
are one style node. A site is a host with `large_host` or more pages; pages of smaller hosts form a site with those that
share their template, the order of the different styles of their sections. For each style node the site's pages give
- its presentation importance, the entropy of the ways in which its children are laid out, to the base of its pages;
- its content importance, one minus the mean entropy of its features (own words and links) over the site's pages: what stands on every page
  of the site has 0, what stands on one has 1. One page more, that shares nothing, is counted in, so that a few pages prove little.
A page's branch has the composite importance (1 - g^l) * presentation + g^l * mean of its l children's, or the mean
itself where that is higher, as long lists of like children have one layout; a leaf has its
content importance. A branch goes if it and all inside it are below the bound. Templates draw on few words, whatever they are on one page, so the bound is the site's own: the cut
that parts the content importances of its style nodes best, each weighed by its pages (least variance on both sides).
It holds where the means of both sides lie `least_apart` apart and the upper side holds most of the site's words; else,
and never below, it is `least`. Only style nodes with an importance below 1 go from the sites' statistics to the
pages, each a few numbers, so that a site's row is small however many pages it has.

What the markup itself says is a prior:
- Tags and roles that are no text by the standard (navigation, page headers and footers, asides, forms, scripts, styles),
  and classes or ids that are a word for such a part, alone or with words for a place or box (`comments`, `ad-slot`,
  `left-sidebar`), have no importance.
- A class or id that merely has such a word among others (`related-work`, `share-price`) is a doubt: the branch needs
  an importance of `doubted`, where the bound is lower.
- `article` and `main` stay, while the branches inside them are judged by `least`, so that a template's block in them goes.
  Where nothing of one would be left, as on hosts whose pages all copy one article, it stays whole.
Style nodes with fewer than `fewest_pages` pages are not judged by statistics (on one page there is no entropy).

White space in a block is folded, blocks are joined by a space. Null html is empty; pages without a text have "" and
0. A null or odd url has the host "". Rows that repeat a page_id are parsed each. Empty tables give empty results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import small_batches, stored

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|$)|'[^']*(?:'|$))*)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Opening the key closes an open tag of the value, as HTML has it for tags whose end may be left out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SCOPE = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "html", "aside", "nav", "footer", "header", "form", "blockquote", "td", "th"}
NO_TEXT = {"head", "script", "style", "noscript", "template", "iframe", "svg", "object", "select", "button", "textarea", "form", "nav", "aside", "footer", "dialog", "menu", "title", "xmp", "noembed", "noframes", "canvas", "audio", "video", "map"}
MAIN = {"article", "main"}
#: Words for parts of a page that are no main text, and words for a place or a box that may stand beside them.
PARTS = set("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent popup modal newsletter subscribe signup sharing social comment comments commentlist respond replies disqus pager pagination toolbar login search widget related recommended notice alert share side header".split())
BOXES = set("site page main global top bottom left right upper lower inner outer primary secondary box block slot area bar wrap wrapper container list item items unit row col column links link text form panel section content holder inline fixed sticky mobile desktop".split())
WORD = re.compile(r"[a-z]+|[0-9]+")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu"}
#: The style of a section, in lower-case html: what tells one template from another.
SECTION = r"""<((?:body|header|nav|main|article|aside|footer|section|div|ul|table|form)(?=[\s/>])(?:[^>]*?\sclass\s*=\s*(?:"[^">]*"|'[^'>]*'|[^\s>]+))?)"""
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "style", "path", "children", "links", "prior", "doubt", "main")

    def __init__(self, tag: str, style: str, path: int, prior: int):
        self.tag, self.style, self.path, self.prior = tag, style, path, prior
        self.children: list = []  # nodes and strings, in page order
        self.links: list[str] = []
        self.doubt = self.main = False


def named(value: str) -> int:
    """What a class or an id says: 2 a part that is no main text, 1 a doubt, 0 nothing."""
    found = 0
    for name in value.split():
        words = WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        parts = [w for w in words if w in PARTS]
        if parts and parts != ["header"] and all(w in PARTS or w in BOXES or w.isdigit() for w in words):
            return 2
        if parts:
            found = 1
    return found


def parse(page: str) -> Node:
    """The page's tree. prior: -1 no text by its role, 1 in the main content, 0 other."""
    root = Node("", "", 0, 0)
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            stack[-1].children.append(page[at:stop])
        if not m:
            break
        at = max(m.end(), at + 1)
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k].tag in SCOPE and stack[k].tag not in CLOSES.get(tag, ()):
                break
        given = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(m[3])} if m[3] else {}
        up = stack[-1]
        style = tag + "." + given.get("class", "") if "class" in given else tag
        says = max((named(given[a]) for a in ("class", "id") if a in given), default=0)
        main = tag in MAIN or given.get("role", "").lower() == "main"
        noise = tag in NO_TEXT or tag == "header" and up.prior < 1 or given.get("role", "").lower() in ROLES or "hidden" in given or says == 2
        node = Node(tag, style, xxhash.xxh64_intdigest(style, up.path & (2**64 - 1)) - 2**63, -1 if noise or up.prior < 0 else 1 if up.prior > 0 or main else 0)
        node.doubt, node.main = says == 1, main
        up.children.append(node)
        if "href" in given:
            up.links.append(given["href"])
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                at = (page.find(">", close.end()) + 1) or end
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag not in VOID and not m[3]:
            stack.append(node)
    return root


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, feature, c) for each judged style node: kind 0 a layout of children, 1 a word or link; on c pages
    of the batch. Features of a node are told apart by 40 bits of their hashes."""
    for batch in batches:
        pages: defaultdict[tuple[str, int, int], Counter[str]] = defaultdict(Counter)
        for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            own: defaultdict[tuple[int, int], set[str]] = defaultdict(set)
            todo = [parse(page or "")]
            while todo:
                node = todo.pop()
                if node.prior < 0:
                    continue
                inner = [c for c in node.children if isinstance(c, Node)]
                own[node.path, 0].add("/".join(dict.fromkeys(c.style for c in inner)))
                for text in node.children:
                    if isinstance(text, str) and not text.isspace():
                        own[node.path, 1].update(text.split())
                for x in node.links:
                    own[node.path, 1].add("@ " + x)  # no word has a space
                todo += inner
            for (path, kind), found in own.items():
                pages[name, path, kind].update(found)
        host, path, kind = zip(*pages, strict=True) if pages else ((), (), ())
        node = np.repeat(np.arange(len(pages)), [len(found) for found in pages.values()])
        feature = [xxhash.xxh64_intdigest(x) & (1 << 40) - 1 for found in pages.values() for x in found]
        c = [k for found in pages.values() for k in found.values()]
        columns = [pa.array(host, pa.string()).take(pa.array(node)), np.array(path, np.int64)[node], np.array(kind, np.int32)[node], np.array(feature, np.int64), np.array(c, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["host", "path", "kind", "feature", "c"])


def style_trees(pages: DataFrame, fewest_pages: int) -> DataFrame:
    """host (the site), styles: array of its style nodes with less than full importance: path, presentation p, content c, pages m, words on them n (0: none)."""
    rows = pages.select("host", "html").mapInArrow(_statistics, "host string, path long, kind int, feature long, c long")
    counted = rows.groupBy("host", "path", "kind", "feature").agg(F.sum("c").alias("c"))
    of_kind = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    c = F.col("c")
    # a page has one layout of a node: the layouts' counts add up to the node's pages
    nodes = counted.groupBy("host", "path").agg(
        of_kind(0, c).alias("m"), of_kind(0, c * F.ln(c)).alias("l"), of_kind(1, F.ln(c)).alias("f"), of_kind(1, F.lit(1)).alias("k"), F.coalesce(of_kind(1, c), F.lit(0)).alias("n")
    )
    m = F.ln("m")
    content = F.when(F.col("k") > 0, 1 - F.least(F.lit(1.0), F.col("f") / (F.col("k") * m)) * F.col("m") / (F.col("m") + 1)).otherwise(1.0)
    rated = nodes.where(F.col("m") >= max(2, fewest_pages)).select("host", "path", F.least(F.lit(1.0), 1 - F.col("l") / (F.col("m") * m)).alias("p"), content.alias("c"), "m", "n")
    return rated.where("p < 1 OR c < 1").groupBy("host").agg(F.collect_list(F.struct("path", "p", "c", "m", "n")).alias("styles"))


def site_bound(styles: list[dict], least: float, least_apart: float) -> float:
    """The importance that a branch outside the main content needs on a site with these style nodes."""
    known = sorted((s["c"], s["m"], s["n"]) for s in styles if s["n"])
    weights, words = sum(m for _, m, _ in known), sum(n for _, _, n in known)
    total = sum(c * m for c, m, _ in known)
    best, bound = 0.0, least
    low = mass = below = 0.0
    for (c, m, n), (after, _, _) in zip(known, known[1:], strict=False):
        low, mass, below = low + c * m, mass + m, below + n
        apart = (total - low) / (weights - mass) - low / mass
        if after > c and apart * apart * mass * (weights - mass) > best:
            best = apart * apart * mass * (weights - mass)
            bound = (c + after) / 2 if apart >= least_apart and below < words / 2 else least
    return max(bound, least)


def importances(root: Node, known: dict[int, tuple[float, float]], decay: float) -> dict[int, float]:
    """The composite importance of each node that has no role of its own against it."""
    importance: dict[int, float] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node) and c.prior >= 0]
    for node in reversed(order):
        presentation, content = known.get(node.path, (1.0, 1.0))
        inner = [importance[id(c)] for c in node.children if isinstance(c, Node) and c.prior >= 0]
        value = content
        if inner:
            far, mean = decay ** len(inner), sum(inner) / len(inner)
            value = max((1 - far) * presentation + far * mean, mean)
            if any(isinstance(c, str) and c.strip() for c in node.children):
                value = max(value, content)
        importance[id(node)] = value
    return importance


def kept_nodes(root: Node, known: dict[int, tuple[float, float]], least: float, doubted: float, decay: float, bound: float) -> set[int]:
    """The nodes that stay: those above the bounds with the nodes above them, and the main content."""
    importance = importances(root, known, decay)
    stay: set[int] = set()
    doubts: set[int] = set()  # nodes whose name, or that of one above them, is a doubt
    below: dict[int, tuple[bool, bool]] = {}  # node: whether main content is in it, whether text of it stays
    order, steps = [], [root]
    while steps:
        node = steps.pop()
        order.append(node)
        inner = [c for c in node.children if isinstance(c, Node) and c.prior >= 0]
        if node.doubt or id(node) in doubts:
            doubts.update(map(id, [node, *inner]))
        steps += inner
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node) and c.prior >= 0]
        holds = node.main or any(below[id(c)][0] for c in inner)
        value = importance[id(node)]
        needed = least if node.prior > 0 else bound
        if holds or value >= (max(doubted, needed) if id(node) in doubts else needed) or any(id(c) in stay for c in inner):
            stay.add(id(node))
        text = any(isinstance(c, str) and c.strip() for c in node.children) or any(id(c) in stay and below[id(c)][1] for c in inner)
        below[id(node)] = (holds, text)
        if node.main and not text:
            todo = [node]
            while todo:
                x = todo.pop()
                stay.add(id(x))
                todo += [c for c in x.children if isinstance(c, Node) and c.prior >= 0]
            below[id(node)] = (True, True)
    return stay


def main_text(root: Node, known: dict[int, tuple[float, float]], least: float = 0.1, doubted: float = 0.5, decay: float = 0.9, bound: float = 0.1) -> str:
    stay = kept_nodes(root, known, least, doubted, decay, bound)
    out: list[str] = []
    block: list[str] = []

    def close() -> None:
        text = SPACES.sub(" ", entities.unescape("".join(block))).strip()
        if text:
            out.append(text)
        block.clear()

    steps: list = [iter(root.children)]
    blocky = [False]
    while steps:
        step = next(steps[-1], None)
        if step is None:
            steps.pop()
            if blocky.pop():
                close()
        elif isinstance(step, str):
            block.append(step)
        elif id(step) not in stay:
            if step.tag not in INLINE:
                close()
        else:
            blocky.append(step.tag not in INLINE)
            if blocky[-1]:
                close()
            steps.append(iter(step.children))
    close()
    return " ".join(out)


def _texts(least: float, doubted: float, least_apart: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, tuple[dict, float]] = {}
            texts = []
            hosts = batch.column("host").to_pylist()
            styles = batch.column("styles")
            for i, page in enumerate(batch.column("html").to_pylist()):
                if hosts[i] not in held:
                    found = styles[i].as_py() or []
                    held[hosts[i]] = {s["path"]: (s["p"], s["c"]) for s in found}, site_bound(found, least, least_apart)
                known, bound = held[hosts[i]]
                texts.append(main_text(parse(page or ""), known, least, doubted, bound=bound))
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return run


def sites(pages: DataFrame, large_host: int) -> DataFrame:
    """pages (host, html, others) with `host` replaced by the site: the host where it is large, else the page's template."""
    large = stored(pages.groupBy(F.col("host").alias("large")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= large_host).select("large"))
    styles = F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit(SECTION), F.lit(1))
    template = F.concat(F.lit("#"), F.xxhash64(F.array_join(F.array_distinct(styles), ">")).cast("string"))
    return pages.join(large, F.col("host") == F.col("large"), "left").withColumn("host", F.coalesce("large", template)).drop("large")


def extract(pages: DataFrame, least: float = 0.1, doubted: float = 0.5, fewest_pages: int = 2, large_host: int = 64, least_apart: float = 0.04) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html). least, doubted: the importance that a
    branch needs at the least, and one that its name puts in doubt. fewest_pages: beyond any number, nothing is judged by
    statistics. large_host, least_apart: see above."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    pages = sites(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host")), large_host)
    trees = stored(style_trees(pages, fewest_pages))  # of known size from here on: Spark broadcasts it only if it is small
    joined = pages.join(trees, "host", "left").select("page_id", "url", "html", "host", "styles")
    return joined.mapInArrow(_texts(least, doubted, least_apart), "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
