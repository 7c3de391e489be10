"""Main text of web pages by a site style tree.

The pages of a host are merged: an element is known by its path of tags and
classes. Over the host's m different articles that have its path, an element's *presentation*
(the sequence of its children) and the *content* of its text blocks have an entropy. What looks the same
on most pages says nothing about one page:

- importance of a block's content = 1 - log(articles with it) / log(m),
- importance of an element's presentation = 1 - (mean over the articles of log(articles that look alike)) / log(m),
  that is the entropy of its presentations to the base m,
- importance of an element = (1 - g**n) * presentation + g**n * mean of its n children.

The base is SMALL at least, so that a few pages are weak evidence and one page is none. Branches whose
importance, and that of all their blocks, is below LOW are removed from every page, first of all;
inside what a page marks as its article the bound is LOW_INSIDE, which only what stands on all but a few
articles of a host (more than m**0.98 of m) falls below, as passages repeat there by right.
Only then do meanings count, for what the tree can't know (branches that stand on few
pages): tags, roles and class names of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments of readers. A class name counts only if all of its words say so (``share-buttons``, not ``share-price``). If a
page names its main part (``main``, or ``article`` elements with at least half of the text), text comes from there.

Pages with the same longest block on the same host count once in the tree, so copies and near copies of an
article are no template. Only contents and presentations of an importance below LOW, on more than the square root of
m articles, are in the table of branches: at most sqrt(m) pages' branches per host; the pages of a host never meet in one task.

Defined results: null or empty html, or a page without text, gives an empty text;
a null or unreadable url has the empty host; repeated rows stay; a very long or deep page is read whole; an empty table gives
an empty result; other columns, whatever their names, are not read. Unclosed, stray and wrongly nested
tags, and entities without a semicolon, are read as browsers do in the common cases.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

#: Below this a branch of the tree is noise, outside and inside of the marked article; a branch's depth of children weighs g.
LOW, LOW_INSIDE, G = 0.5, 0.02, 0.9
#: Least base of the entropies.
SMALL = 8

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements whose names don't count: page frames and headlines.
HEADINGS = frozenset("html body h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold the article's text.
NOISE = frozenset("script style head title template iframe object embed noembed noframes noscript svg canvas audio video map nav menu footer aside form button select option textarea input label fieldset dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
#: Words in class names and ids that mark what isn't the article; words that do so outside of it only; words that say nothing beside them.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion promoted affiliate menu nav navbar navigation navigator topnav subnav breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars aside rail widget widgets footer foot cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login signin register search "
    "comment comments commentlist commentary disqus reply replies respond responses discussion feedback share sharing social related recommended recommendations trending popular toolbar skip skiplink copyright disclaimer".split()
)
HEADS = frozenset("header masthead topbar banner".split())
PLAIN = frozenset(
    "site page main primary secondary top bottom left right block box container wrapper wrap list item items area bar buttons button icons links link slot unit inner outer global fixed sticky thread form policy message widget title posts articles stories "
    "sm md lg xs xl col row js is".split()
)
#: Elements that a new one of the same group closes.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Why a branch is left out by its meaning: not at all, by name, by tag or role, by name outside of the article.
NONE, NAMED, TAGGED, HEADING = 0, 1, 2, 3
ARTICLE, MAIN = 1, 2


class Node:
    __slots__ = ("tag", "sign", "noise", "main", "children", "path")

    def __init__(self, tag: str, sign: str, noise: int, main: int):
        self.tag, self.sign, self.noise, self.main = tag, sign, noise, main
        self.children: list[Node | str] = []  # elements, and texts of blocks
        self.path = 0


def _named(value: str) -> int:
    """What the names of a class or id attribute say: a name counts if all of its words do, or say nothing."""
    out = NONE
    for name in value.split():
        parts = {part.lower() for part in PART.findall(CAMEL.sub(" ", name))}
        if parts & NAMES and parts <= NAMES | PLAIN | HEADS:
            return NAMED
        if parts & HEADS and parts <= HEADS | PLAIN:
            out = HEADING
    return out


@lru_cache(maxsize=50_000)
def _traits(tag: str, attributes: str) -> tuple[str, int, int]:
    """Signature, why it is left out by its meaning, and whether it marks the main part."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or ""))
    role, names, name = found.get("role", "").lower(), found.get("class", ""), found.get("id", "")
    main = MAIN if tag == "main" or role == "main" else ARTICLE if tag == "article" or role == "article" else 0
    noise = TAGGED if tag in NOISE or role in ROLES else NONE
    if not noise and main != MAIN and tag not in HEADINGS:
        said = _named(names), _named(name)
        noise = NAMED if NAMED in said else HEADING if HEADING in said and not main else NONE
        main = 0 if noise else main
    return tag + "." + ".".join(sorted(set(names.split()))) if names else tag, noise, main


def traits(tag: str, attributes: str) -> tuple[str, int, int]:
    """As :func:`_traits`; attributes that don't count are left out first."""
    if attributes:
        low = attributes.lower()
        if "class" in low or "id" in low or "role" in low:
            return _traits(tag, attributes)
    return _traits(tag, "")


def parse(page: str) -> Node:
    """The page's tree of block elements; inline elements are only text, if they aren't noise."""
    root = Node("#", "#", NONE, 0)
    stack, text = [root], []  # open elements; pieces of the block under way
    skip = None  # a raw or noisy inline element under way: no text
    depth = 0

    def flush() -> None:
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = entities.unescape(joined)
            joined = " ".join(joined.split())
            text.clear()
            if joined:
                stack[-1].children.append(joined)

    def close(n: int) -> None:
        flush()
        del stack[n:]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            if skip is None:
                text.append(page[at:])
            break
        if m.start() > at and skip is None:
            text.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1] is not None and skip is None:
                text.append(entities.escape(m[1]))
            continue
        tag = m[3].lower()
        if not m[2]:
            if tag in RAW and not m[4].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = size if end is None else page.find(">", end.start()) + 1 or size
                if tag not in ("script", "style"):
                    text.append(" ")
                continue
            if skip is not None:
                depth += tag == skip and tag not in VOID
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    _close_paragraph(stack, close)
                    flush()
                continue
            if tag not in BLOCKS:
                if traits(tag, m[4])[1] in (NAMED, TAGGED) and not m[4].endswith("/"):
                    skip, depth = tag, 1
                    text.append(" ")
                continue
            if tag in CLOSES:
                group, stop = CLOSES[tag]
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag in stop:
                        break
                    if stack[n].tag in group:
                        close(n)
            _close_paragraph(stack, close)
            flush()
            if tag in ("html", "body") and any(n.tag == tag for n in stack):
                continue
            node = Node(tag, *traits(tag, m[4]))
            if node.main:
                for outer in stack:  # what holds the main part is no noise by its name alone
                    outer.noise = outer.noise if outer.noise == TAGGED else NONE
            stack[-1].children.append(node)
            stack.append(node)
            continue
        if skip is not None:
            if tag == skip:
                depth -= 1
                if depth == 0:
                    skip = None
            elif tag in BLOCKS and any(n.tag == tag for n in stack[1:]):  # an unclosed inline element ends with its block
                skip = None
            else:
                continue
            if tag not in BLOCKS:
                continue
        if tag in ("body", "html"):
            continue
        if tag in BLOCKS:
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    close(n)
                    break
            else:
                flush()
    flush()
    stack = []
    _name(root)
    return root


def _close_paragraph(stack: list[Node], close) -> None:
    for n in range(len(stack) - 1, 0, -1):
        if stack[n].tag == "p":
            close(n)
            return
        if stack[n].tag in ("td", "th", "table", "body", "html"):
            return


def _short(text: str) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >= 1 << 63 else h


def _name(root: Node) -> None:
    """Give every element its path."""
    todo = [root]
    while todo:
        node = todo.pop()
        known: dict[str, int] = {}
        for child in node.children:
            if not isinstance(child, str):
                path = known.get(child.sign)
                if path is None:
                    path = known[child.sign] = _short(f"{node.path}/{child.sign}")
                child.path = path
                todo.append(child)


def nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))


def presentation(node: Node) -> str:
    """The sequence of an element's children."""
    return " ".join(child.sign if isinstance(child, Node) else "#text" for child in node.children)


def features(root: Node) -> list[tuple[int, int | None, int]]:
    """(path, content, presentation) of a page, without repeats: one of the last two is 0 or null.

    Presentations have a null content.
    """
    out: set[tuple[int, int | None, int]] = set()
    for node in nodes(root):
        if node.path:
            out.add((node.path, None, _short(presentation(node))))
        for child in node.children:
            if isinstance(child, str):
                out.add((node.path, _short(child), 0))
    return list(out)


Table = dict[tuple[int, int | None], float]


def importance(root: Node, low: Table) -> dict[int, tuple[float, float]]:
    """Importance of every element by its identity, and the largest of its own and its blocks'.

    ``low`` has (path, content) and (path, None) of what isn't 1.
    """
    out: dict[int, tuple[float, float]] = {}
    for node in reversed(list(nodes(root))):
        parts = [(low.get((node.path, _short(c)), 1.0),) * 2 if isinstance(c, str) else out[id(c)] for c in node.children]
        own = low.get((node.path, None), 1.0) if node.path else 1.0
        if parts:
            weight = G ** len(parts)
            own = (1 - weight) * own + weight * sum(p[0] for p in parts) / len(parts)
        out[id(node)] = own, max([own, *(p[1] for p in parts)])
    return out


def _blocks(root: Node, low: Table) -> tuple[list[tuple[str, int, bool]], int]:
    """Blocks that the tree leaves, each with the kind of main part it is in and whether meanings leave it out; and the number removed."""
    rank = importance(root, low) if low else {}
    out: list[tuple[str, int, bool]] = []
    removed = 0
    todo: list[tuple[Node | str, int, int, bool, bool]] = [(root, 0, 0, False, False)]
    while todo:
        item, path, main, noise, gone = todo.pop()
        bound = LOW_INSIDE if main else LOW
        if isinstance(item, str):
            if gone or (low and low.get((path, _short(item)), 1.0) < bound):
                removed += 1
            else:
                out.append((item, main, noise))
            continue
        main = max(main, item.main)
        gone = gone or (low and rank[id(item)][1] < (LOW_INSIDE if main else LOW))
        noise = noise or item.noise in (NAMED, TAGGED) or (not main and (item.noise == HEADING or item.tag == "header"))
        todo.extend((child, item.path, main, noise, gone) for child in reversed(item.children))
    return out, removed


def extracted(root: Node, low: Table | None = None) -> tuple[str, int, int]:
    """Blocks that stay, in page order, joined by line ends; the number of blocks that the tree and that meanings removed."""
    left, by_tree = _blocks(root, low or {})
    kept = [(text, main) for text, main, noise in left if not noise]
    by_name = len(left) - len(kept)
    size = sum(len(text) for text, _ in kept)
    for kind, share in ((MAIN, 0), (ARTICLE, 0.5)):
        inside = [text for text, main in kept if main >= kind]
        if inside and sum(map(len, inside)) >= share * size:
            return "\n".join(inside), by_tree, by_name + len(kept) - len(inside)
    return "\n".join(text for text, _ in kept), by_tree, by_name


def main_text(root: Node, low: Table | None = None) -> str:
    return extracted(root, low)[0]


def article_name(root: Node) -> int:
    """The article that a page holds, by its longest block."""
    return _short(max(main_text(root).split("\n"), key=lambda block: (len(block), block)))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


FEATURES = "host string, print long, features array<struct<path: long, content: long, shape: long>>"
_FEATURE = pa.struct([("path", pa.int64()), ("content", pa.int64()), ("shape", pa.int64())])


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done() -> pa.RecordBatch:
        flat = [f for one in lists for f in one]
        ends = [0]
        for one in lists:
            ends.append(ends[-1] + len(one))
        rows = pa.StructArray.from_arrays([pa.array([f[i] for f in flat], pa.int64()) for i in range(3)], fields=list(_FEATURE))
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(prints, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["host", "print", "features"])

    for batch in batches:
        hosts, prints, lists, size = [], [], [], 0
        for url, page in zip(batch.column("url"), batch.column("html"), strict=True):
            root = parse(page.as_py() or "")
            hosts.append(host_of(url.as_py()))
            prints.append(article_name(root))
            lists.append(features(root))
            size += len(lists[-1])
            if size > 50_000:
                yield done()
                hosts, prints, lists, size = [], [], [], 0
        yield done()


def style_tree(pages: DataFrame) -> DataFrame:
    """Branches of low importance: host, path, content (null for presentations), importance.

    Counts are sums over keys of host, path and value: partial sums come first, and
    a hot host spreads over as many tasks as it has different branches. Pages with the same article count once.
    A path's m is the number of its articles by presentations, of which an article may have several.
    """
    seen = pages.select("url", "html").mapInArrow(_features_of, FEATURES)
    seen = seen.select(F.xxhash64("host").alias("host"), "print", F.explode("features").alias("f")).select("host", "print", "f.*")
    # one row per page, feature and article; distinct articles are counted, in two steps of partial sums
    counts = seen.groupBy("host", "path", "content", "shape", "print").agg(F.lit(1).alias("one")).groupBy("host", "path", "content", "shape").agg(F.count("*").alias("n"))
    counts = stored(counts)
    logs = F.log(F.col("n").cast("double"))
    of_path = counts.where("content is null").groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * logs).alias("nlogn"))
    base = F.log(F.greatest("m", F.lit(SMALL)).cast("double"))
    shapes = of_path.select("host", "path", F.lit(None).cast("long").alias("content"), (1 - F.col("nlogn") / F.col("m") / base).alias("importance"))
    content = counts.where(F.col("content").isNotNull() & (F.col("n") ** 2 > SMALL)).join(of_path.select("host", "path", "m"), ["host", "path"])
    content = content.select("host", "path", "content", F.greatest(F.lit(0.0), 1 - logs / base).alias("importance"))
    return shapes.unionByName(content).where(F.col("importance") < LOW)


RESULT = "page_id long, url string, text string, n_chars long, n_tree int, n_named int"


#: Branches up to which the table is broadcast (24 bytes each); beyond it the pages are dealt by host and salt. Branches that a worker keeps.
BROADCAST_BRANCHES, SALTS, KEPT = 1_000_000, 64, 300_000


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page; n_tree and n_named count the blocks that the tree and that meanings removed."""
    from pyspark.sql import types as T

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    @F.arrow_udf(T.StringType())
    def host(urls: pa.Array) -> pa.Array:
        return pa.array([host_of(u) for u in urls.to_pylist()], pa.string())

    low = stored(style_tree(rows).groupBy(F.col("host").alias("low_host")).agg(F.collect_list(F.struct("path", "content", "importance")).alias("low")))  # at most m**0.5 times a page's branches
    rows = rows.withColumn("host", F.xxhash64(host("url")))
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_BRANCHES:
        rows = rows.join(F.broadcast(low), F.col("host") == F.col("low_host"), "left")
    else:
        low = low.withColumn("low_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        rows = rows.join(low, (F.col("host") == F.col("low_host")) & (F.col("salt") == F.col("low_salt")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, Table] = {}
        for batch in batches:
            out = []
            for name, page, branches in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("low"), strict=True):
                if name not in kept:
                    if sum(map(len, kept.values())) > KEPT or len(kept) > 1000:
                        kept.clear()
                    kept[name] = {(b["path"], b["content"]): b["importance"] for b in branches.as_py() or ()}
                out.append(extracted(parse(page.as_py() or ""), kept[name]))
            texts = [text for text, _, _ in out]
            counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n, _ in out], pa.int32()), pa.array([n for _, _, n in out], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *counts], [c.split()[0] for c in RESULT.split(", ")])

    return rows.select("page_id", "url", "html", "host", "low").mapInArrow(run, RESULT)
