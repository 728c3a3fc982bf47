"""Main text of web pages by a site style tree (operator 2).

Pages of one host are merged into a style tree: a node is a chain of element
labels (tag and class or id) from the page down, equal siblings share a node.  Per node the tree
counts its presentation styles (sequences of child labels) and its content features
over the host's pages.  Features are the words and link targets of a block, each
weighing as often as it occurs; a paragraph or heading is one feature
with the weight of its words.  A feature on all pages of a node says nothing, one on a
single page everything: on ``n`` of ``m`` pages it has entropy ``log_m n``, and a node's
content importance is one minus the weighted mean over the features below it.  Presentation importance is
the entropy of the node's ``l`` styles.  Both are drawn towards 1/2 by ``PRIOR`` pages, so nodes that
few pages have are judged with care, and the composite importance is
``(1 - g^l) presentation + g^l content`` with ``g`` = 0.9.  A branch goes from every page of its
host if its composite is under ``LOW`` times the content importance of the host's pages as a whole.

Entropy alone can't tell menus whose entries change or reader comments, which look important.  So elements whose tag, role or class names
menus, headers, footers, sidebars, notices, adverts, forms or comments go
whatever their entropy; paragraphs, headings and the article itself are never
judged by entropy, since a paragraph that many pages share is still text.  If the
elements that a page marks as its article hold most of its text, only their blocks count.

A name is sure if all its parts say noise (``share-buttons``, ``topnav``), and a doubtful one if only some
do (``content-sidebar-wrap``).  Doubtful names count neither inside an article nor
for paragraphs and headings, and a branch with a high composite importance
overrules them.  No name or form goes that holds the page's main element or, on a
page without one, most of the page's text.

The counts are folded per slice of pages before the shuffle; what comes out
is one short row per host (only the uppermost branches), joined back on the host (Spark broadcasts it if it is small).
Elements nested deeper than ``DEEP`` levels belong to their ancestor's node, so work and memory are linear in a page's length.

Edge cases: null or empty html gives an empty text; a null url belongs to the
host ``""``; cut-off pages end where they end, an unfinished tag is dropped;
repeated rows each return a row; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import map_arrow, read_table, slices, staged

DECAY = 0.9
LOW = 0.3           # share of the host's content importance under which a branch is noise
PRIOR = 4           # pages that the neutral importance 1/2 counts for
DEEP = 64           # levels of nodes
ARTICLE_SHARE = 0.5     # of a page's text that its article elements must hold to stand alone
NAMED_SHARE = 0.75      # the same for elements that are only named like one
HIGH = 0.7          # composite importance from which a branch overrules a doubtful name
DOUBTFUL, SURE = 1, 2

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp noscript template svg math".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike"
             " strong sub sup time tt u var br wbr img".split())
NOISE_TAGS = set("nav footer aside form button select option input dialog menu object embed audio video canvas fieldset".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promos promotion cookie cookies consent"
    " gdpr notice notices alert sidebar rail aside widget widgets comment comments reply replies disqus respond footer foot header"
    " masthead nav navbar navigation menu menus breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe"
    " subscription signup login popup modal overlay toolbar pagination pager copyright".split())
#: Parts that only say how a named element is laid out.
LAYOUT_WORDS = set("area bar block box button buttons container inner item items icons link links list outer panel posts section"
                   " top bottom left right wrap wrapper".split())
#: Tags that also wrap whole pages.
WRAPPERS = {"form", "fieldset"}
MAIN_NAMES = set("content main-content maincontent article-body articlebody post-content entry-content article post story".split())
PROSE = set("html body article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main"
               " menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[^a-z0-9]+")


class Block(NamedTuple):
    node: int     # its element's number in page order
    text: str
    main: int     # 2: in an article or main element, 1: in an element named like one, 0: neither
    noise: bool   # in an element whose markup says what it is
    links: list   # targets of the links in it


class Element(NamedTuple):
    tag: str
    main: int
    children: list
    node: int     # its number in page order; 0 is the page


class Node(NamedTuple):
    up: int
    id: int       # of the style tree's node: a hash of the labels from the page down
    depth: int
    tag: str
    main: bool    # an article or main element
    noise: int    # what its markup says: 0, DOUBTFUL or SURE
    fixed: bool   # by a tag or role that is no wrapper


def below(up: int, label: str) -> int:
    """The style tree's node for an element with this label under node ``up``."""
    x = (up ^ crc32(label.encode()) ^ len(label) << 32) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return (x ^ x >> 32) >> 1


def name_parts(name: str) -> list[str]:
    """Parts of a class or id; one that two known words make up counts as these (``topnav``, ``commentlist``)."""
    known, out = NOISE_WORDS | LAYOUT_WORDS, []
    for part in (p for p in _NAME.split(name) if p):
        cut = 0 if part in known else next((i for i in range(2, len(part) - 1) if part[:i] in known and part[i:] in known
                                            and not NOISE_WORDS.isdisjoint((part[:i], part[i:]))), 0)
        out += [part[:cut], part[cut:]] if cut else [part]
    return out


def names_noise(tag: str, names: list[str], role: str, in_main: bool) -> int:
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return SURE
    if tag == "header":
        return 0 if in_main else SURE
    noise = 0
    for name in names:
        parts = name_parts(name)
        if not parts or parts[0] in ("has", "with", "no"):
            continue
        found = NOISE_WORDS.intersection(parts)
        if not (found - {"header"} or found and not in_main):
            continue
        if found.union(LAYOUT_WORDS).issuperset(parts):
            return SURE
        if not in_main and tag not in PROSE:
            noise = DOUBTFUL
    return noise


def noisy(nodes: list[Node], lengths: list[int], high: set[int]) -> list[bool]:
    """Whether each node goes for what its markup, or that of an element around it, says; ``lengths`` are of the nodes' own texts."""
    def judged(spared: set[int]) -> list[bool]:
        out = [False] * len(nodes)
        for k in range(1, len(nodes)):
            n = nodes[k]
            out[k] = out[n.up] or k not in spared and (n.noise == SURE or n.noise == DOUBTFUL and n.id not in high)
        return out

    def around(k: int) -> set[int]:
        out = set()
        while k:
            out.add(k)
            k = nodes[k].up
        return out

    plain = judged(set())
    if not any(plain):
        return plain
    total = list(lengths)
    for k in range(len(nodes) - 1, 0, -1):
        total[nodes[k].up] += total[k]
    # the page's main element: a main one, else the longest article; one in a named element only if it is longer than all other unnamed text
    mains = [k for k, n in enumerate(nodes) if n.main and n.tag != "article"]
    if not mains:
        unnamed = sum(length for length, gone in zip(lengths, plain) if not gone)
        mains = [k for k, n in enumerate(nodes) if n.main and not n.noise and total[k] and (not plain[k] or total[k] > unnamed)]
    if mains:
        return judged(around(max(mains, key=lambda k: total[k])))
    most = {k for k, n in enumerate(nodes) if n.noise and not n.fixed and 2 * total[k] > total[0]}
    return judged(most) if most else plain


class Page(NamedTuple):
    blocks: list[Block]     # in page order
    styles: list[tuple[int, str]]   # (node, sequence of child labels) of every element and of the page
    nodes: list[Node]


def parse(page: str, high: set[int] = frozenset()) -> Page:
    """Blocks, styles and nodes of a page; ``high`` are the nodes whose importance overrules a doubtful name."""
    stack = [Element("", 0, [], 0)]
    nodes = [Node(0, 0, 0, "", False, 0, False)]
    lengths = [0]
    texts: list[tuple[int, int, str, list]] = []   # (node, main, text, links)
    styles: list[tuple[int, str]] = []
    text: list[str] = []
    links: list[str] = []
    open_tags: Counter = Counter()

    def flush() -> None:
        if text:
            words = _html.unescape("".join(text)).split()
            text.clear()
            if words:
                top = stack[-1]
                texts.append((top.node, top.main, " ".join(words), links.copy()))
                lengths[top.node] += len(texts[-1][2])
        links.clear()

    def pop() -> None:
        top = stack.pop()
        open_tags[top.tag] -= 1
        styles.append((top.node, " ".join(top.children)))

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at: m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE or any(e.tag == tag for e in stack[-3:]):
                flush_needed = tag not in INLINE or stack[-1].tag in INLINE
                if flush_needed:
                    flush()
                if open_tags[tag] > 0:
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            continue
        if tag in RAW and not m[3].endswith("/>"):
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
                continue
            if "=" not in m[3] or tag not in ("a", "span"):
                continue
        marks = {k.lower(): (a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        names = f"{marks.get('class', '')} {marks.get('id', '')}".lower().split()
        up = stack[-1]
        role = marks.get("role", "").lower()
        noise = names_noise(tag, names, role, up.main == 2) if tag not in ("html", "body", "main") and role != "main" else 0
        if tag in INLINE and not noise:
            if "href" in marks:
                links.append(marks["href"])
            continue
        flush()
        if "href" in marks:
            links.append(marks["href"])
        if tag in CLOSES_P and open_tags["p"] > 0:
            while stack[-1].tag != "p":
                pop()
            pop()
        if tag in SAME_LEVEL:
            while stack[-1].tag in SAME_LEVEL[tag]:
                pop()
        up = stack[-1]
        label = f"{tag}.{names[0]}" if names and tag not in ("html", "body") else tag
        if not up.children or up.children[-1] != label:
            up.children.append(label)
        if tag in VOID:
            continue
        is_main = tag in ("article", "main") or role == "main"
        main = max(up.main, 2 if is_main else 1 if MAIN_NAMES.intersection(names) else 0)
        over = nodes[up.node]
        stack.append(Element(tag, main, [], len(nodes)))
        open_tags[tag] += 1
        nodes.append(Node(up.node, below(over.id, label) if over.depth < DEEP else over.id, min(over.depth + 1, DEEP), tag, is_main, noise,
                          tag in NOISE_TAGS - WRAPPERS or tag == "header" or role in NOISE_ROLES - WRAPPERS))
        lengths.append(0)
        if m[3].endswith("/>") and tag not in ("p", "div", "article", "section", "body", "html", "main"):
            pop()
    flush()
    while len(stack) > 1:
        pop()
    if styles or texts:
        pop()
    gone = noisy(nodes, lengths, high)
    return Page([Block(k, text, main, gone[k], targets) for k, main, text, targets in texts],
                [(nodes[k].id, style) for k, style in styles], nodes)


def main_text(page: str | None, low: set[int] = frozenset(), high: set[int] = frozenset()) -> str:
    """Text of a page without noise and without the branches under the nodes ``low``; ``high`` nodes overrule doubtful names."""
    found = parse(page or "", high)
    kept = [b for b in found.blocks if not b.noise]
    if low:
        gone = [False] * len(found.nodes)
        for k, n in enumerate(found.nodes):
            gone[k] = n.id in low or k > 0 and gone[n.up]
        kept = [b for b in kept if not gone[b.node]]
    total = sum(len(b.text) for b in kept)
    for level, share in ((2, ARTICLE_SHARE), (1, NAMED_SHARE)):
        part = [b for b in kept if b.main >= level]
        if part and sum(len(b.text) for b in part) > share * total:
            kept = part
            break
    return "\n\n".join(b.text for b in kept)


def block_features(block: Block, tag: str) -> Counter:
    """Content features of a block and how often they occur: words and link targets, or a paragraph or heading as a whole."""
    if tag in PROSE and tag:
        return Counter({crc32(block.text.encode()) | len(block.text) << 32: len(block.text.split())})
    found = Counter(crc32(w.encode()) for w in block.text.lower().split())
    found.update(crc32(t.encode()) | 1 << 62 for t in block.links)
    return found


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(found, F.lit(""))


def page_counts(page: str) -> dict[tuple[int, str, int], int]:
    """(node, kind, feature) -> weight on one page.

    Kinds: the node is there (m; feature 1 for prose), has a style (s), a content feature (t, weight: occurrences), a doubtful
    name (d), a parent (u), or holds the content of a node below it or its own (a).
    """
    found = parse(page)
    out: dict[tuple[int, str, int], int] = {}
    for n in found.nodes if found.styles else ():
        out[n.id, "m", int(n.tag in PROSE)] = 1
        if n.noise == DOUBTFUL:
            out[n.id, "d", 0] = 1
        if n.id != found.nodes[n.up].id:
            out[n.id, "u", found.nodes[n.up].id] = 1
    for node, style in found.styles:
        out[node, "s", crc32(style.encode())] = 1
    for b in found.blocks:
        leaf = found.nodes[b.node]
        for feature, times in block_features(b, leaf.tag).items():
            out[leaf.id, "t", feature] = out.get((leaf.id, "t", feature), 0) + times
        k = b.node
        while (found.nodes[k].id, "a", leaf.id) not in out:
            out[found.nodes[k].id, "a", leaf.id] = 1
            k = found.nodes[k].up
    return out


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, node, kind, feature, n, w): pages of the host on which ``page_counts`` has an entry, and the sum of its weights."""
    source = pages.select(host(F.col("url")).alias("host"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                pages_of: Counter = Counter()
                weights: Counter = Counter()
                for where, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    for key, weight in page_counts(page or "").items():
                        pages_of[where, *key] += 1
                        weights[where, *key] += weight
                keys = list(pages_of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.string()),
                     pa.array([k[3] for k in keys], pa.int64()), pa.array(list(pages_of.values()), pa.int64()), pa.array(list(weights.values()), pa.int64())],
                    names=["host", "node", "kind", "feature", "n", "w"])

    rows = map_arrow(source, run, "host string, node long, kind string, feature long, n long, w long")
    return rows.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def importance(counts: DataFrame) -> DataFrame:
    """(host, node, pages, prose, doubtful, presentation, content, composite) for every node of every host's style tree; its root is node 0."""
    n, w, log_n = F.col("n"), F.col("w"), F.log("n")

    def of(kind: str, x: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, x).otherwise(F.lit(0.0)))

    own = counts.where("kind in ('m', 'd', 's', 't')").groupBy("host", "node").agg(
        F.max(F.when(F.col("kind") == "m", n)).alias("pages"), F.max(F.when(F.col("kind") == "m", F.col("feature"))).alias("prose"),
        of("d", n).alias("doubtful"), of("s", n).alias("s_n"), of("s", n * log_n).alias("s_nlog"), of("s", F.lit(1.0)).alias("styles"),
        of("t", w * log_n).alias("t_log"), of("t", w).alias("t_w"))
    base = F.log(F.greatest("pages", F.lit(2.0)))
    leaves = own.where("t_w > 0").select("host", F.col("node").alias("leaf"), (F.col("t_w") - F.col("t_log") / base).alias("kept"), "t_w")
    held = counts.where("kind = 'a'").select("host", "node", F.col("feature").alias("leaf"))
    content = held.join(leaves, ["host", "leaf"]).groupBy("host", "node").agg((F.sum("kept") / F.sum("t_w")).alias("content"))
    tree = own.join(content, ["host", "node"])

    def drawn(x: Column) -> Column:
        return (F.col("pages") * x + PRIOR * 0.5) / (F.col("pages") + PRIOR)

    entropy = F.least(F.lit(1.0), (F.log("s_n") - F.col("s_nlog") / F.col("s_n")) / base)
    tree = tree.withColumn("presentation", drawn(F.coalesce(entropy, F.lit(0.0)))).withColumn("content", drawn(F.greatest(F.lit(0.0), F.col("content"))))
    weight = F.pow(F.lit(DECAY), "styles")
    return tree.select("host", "node", "pages", "prose", "doubtful", "presentation", "content",
                       ((1 - weight) * F.col("presentation") + weight * F.col("content")).alias("composite"))


def low_branches(counts: DataFrame) -> DataFrame:
    """(host, low, high): the uppermost nodes of the branches to remove from the pages of a host, and those that overrule doubtful names."""
    tree = importance(counts)
    whole = tree.where("node = 0").select("host", F.col("content").alias("whole"))
    judged = tree.where("node <> 0").join(whole, "host")
    low = judged.where((F.col("prose") == 0) & (F.col("composite") < LOW * F.col("whole"))).select("host", "node")
    ups = counts.where("kind = 'u'").select("host", "node", F.col("feature").alias("up"))
    inner = low.join(ups, ["host", "node"]).join(low.select("host", F.col("node").alias("up")), ["host", "up"], "left_semi")
    top = low.join(inner, ["host", "node"], "left_anti").withColumn("kind", F.lit("low"))
    high = judged.where((F.col("doubtful") > 0) & (F.col("composite") >= HIGH)).select("host", "node", F.lit("high").alias("kind"))
    return top.unionByName(high).groupBy("host").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("node")))).alias(k) for k in ("low", "high")])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``."""
    counts = staged(style_counts(pages), "style-tree")
    rules = staged(low_branches(counts), "low-branches").withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    rows = rows.join(rules, rows["host"] == rules["_host"], "left").select("page_id", "url", "html", "low", "high")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(page, set(low or ()), set(high or ())) for page, low, high in
                         zip(*(part.column(c).to_pylist() for c in ("html", "low", "high")))]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                                                 names=["page_id", "url", "text"])

    return map_arrow(rows, run, f"page_id {kind}, url string, text string")


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
