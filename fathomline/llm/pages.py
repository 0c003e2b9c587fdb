"""Main text of web pages by wrapper induction.

Pages of one host share a template, or one for each layout. Every page's tree of block
elements is aligned with the closest of its host's reference pages, one for each common
layout, by simple tree matching. Texts at one tag path count over all layouts too. A node whose text stays the same over
nearly all pages belongs to the template; nodes with varying text are slots. Slots are
content unless they stand in an element that is furniture by its tag or its names: menus,
headers, footers, sidebars, notices, adverts, forms and reader comments. Names are weak
evidence: they mark no element that holds the article or most of a page's text.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.storage import fits_in_memory, materialise

REFERENCE_BYTES = 32 * 1024 * 1024
#: share of the distinct pages with one text, and the pages needed, to be template
CONSTANT_SHARE = 0.9
CONSTANT_PAGES = 5
#: reference pages of a host at most, of its most common layouts
REFERENCES = 8
#: share of tag paths in common with its reference from which a page counts for the layout
NEAR = 0.5
#: share of a block's characters inside links from which it is a menu
LINK_SHARE = 0.6
#: the tree is cut at this depth: deeper elements stand there as siblings, in page order
DEEPEST = 120
#: children lists of more pairs are halved until a table has no more cells
TABLE_CELLS = 20_000

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is no text of the page
HIDDEN = set("head script style noscript template iframe object svg math canvas audio video select datalist title".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
FURNITURE = set("nav footer aside form button menu dialog fieldset textarea".split())
ARTICLE = {"article", "main"}
NAMES = set(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination popup "
    "promo promoted related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split()
)
#: names that mark an element however much text it has: what readers wrote
VOICES = set("comment comments disqus replies reply respond".split())
#: parts in front of a name that turn it into a remark on the layout, as in ``has-sidebar``
REMARKS = set("has have no not with without is are hide show".split())
#: parts in front of ``header`` that make it the page's; others belong to an article or a list
SITE = set("site main page top global masthead app".split())
#: a main text outside has so many times the characters of all articles
OUTWEIGHS = 3
ROLES = set("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: an element of the key closes an open one of the values, up to the nearest of its limits
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    tag: str
    number: int
    parent: Node | None
    furniture: bool
    hidden: bool
    article: bool
    depth: int
    #: the names of its own that mark it, if any
    names: set[str] = field(default_factory=set)
    #: deepest open element, this or above, that may have children in the tree
    trunk: Node | None = None
    children: list[Node] = field(default_factory=list)


@dataclass
class Block:
    node: Node
    text: str
    linked: int


def parse(source: str) -> tuple[Node, list[Block]]:
    """The tree of block elements, and the text blocks in page order.

    A block is the text between two bounds of block elements; inline elements and line
    breaks do not end it. Character references are decoded, white space becomes one space.
    """
    root = Node("", 0, None, False, False, False, 0)
    root.trunk = root
    node, at = root, 0
    nodes = [root]
    path, opened = [root], {}  # open elements by depth, and those that were opened by tag

    def nearest(tag: str) -> Node | None:
        """The nearest open element of a tag."""
        own = opened.get(tag, [])
        while own and (own[-1].depth > node.depth or path[own[-1].depth] is not own[-1]):
            own.pop()
        return own[-1] if own else None

    blocks: list[Block] = []
    parts: list[str] = []
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not node.hidden:
                blocks.append(Block(node, text, linked))
            parts.clear()
        linked = 0

    for match in _TAG.finditer(source):
        start = match.start()
        if start < at:
            continue
        if start > at:
            parts.append(source[at:start])
            if links:
                linked += start - at
        at = match.end()
        tag = match.group(2)
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), match.group(1), match.group(3)
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        flush()
        if closing:
            up = nearest(tag)
            if up is not None:
                node = up.parent
            links = 0
            continue
        node = _opened_at(node, tag, nearest)
        if tag in VOID:
            continue
        furniture, hidden, names = _judged(tag, rest, node)
        new = Node(tag, len(nodes), node, furniture, hidden, node.article or tag in ARTICLE, node.depth + 1, names)
        new.trunk = new if new.depth < DEEPEST else node.trunk
        nodes.append(new)
        node.trunk.children.append(new)
        if rest.endswith("/") and tag not in RAW:
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        node = new
        path[new.depth :] = [new]
        opened.setdefault(tag, []).append(new)
    if at < len(source):
        parts.append(source[at:])
    flush()
    _mark_named(nodes, blocks)
    return root, blocks


def _mark_named(nodes: list[Node], blocks: list[Block]) -> None:
    """Make named elements furniture, with all that stands in them.

    An element around most of the articles' text is a layout, whatever its name. On a page
    without articles neither does a name mark an element with most of the text, unless
    readers wrote it.
    """
    size, inside = [0] * len(nodes), [0] * len(nodes)
    for b in blocks:
        if not b.node.furniture:
            size[b.node.number] += len(b.text)
            inside[b.node.number] += len(b.text) * b.node.article
    # children come after their parents
    for node in reversed(nodes[1:]):
        size[node.parent.number] += size[node.number]
        inside[node.parent.number] += inside[node.number]
    for node in nodes[1:]:
        if inside[0]:
            layout = not node.article and 2 * inside[node.number] > inside[0]
        else:
            layout = 2 * size[node.number] > size[0] and not node.names & VOICES
        node.furniture |= node.parent.furniture or bool(node.names) and not layout


def _opened_at(node: Node, tag: str, nearest: Callable[[str], Node | None]) -> Node:
    """Where a new element goes: open paragraphs and list items end first."""
    if tag in CLOSES:
        ends, limits = CLOSES[tag]
        end, limit = (
            max((up for up in map(nearest, tags) if up is not None), key=lambda up: up.depth, default=None)
            for tags in (ends, limits)
        )
        return end.parent if end is not None and (limit is None or end.depth > limit.depth) else node
    if node.tag == "p":
        return node.parent
    return node


def _judged(tag: str, rest: str, parent: Node) -> tuple[bool, bool, set[str]]:
    """Whether an element is furniture by its tag or role, whether it is hidden, and the names
    that speak for furniture."""
    furniture = parent.furniture or tag in FURNITURE or (tag == "header" and not parent.article)
    hidden, names = parent.hidden or tag in HIDDEN, set()
    if rest and not (furniture and hidden):
        for name, *values in _ATTRIBUTE.findall(rest):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id"):
                if tag not in ("html", "body", "article", "main"):
                    for token in value.split():
                        names |= _furniture_name(token, parent.article)
            elif name == "role":
                furniture = furniture or value.lower() in ROLES
            elif name == "style":
                hidden = hidden or bool(_HIDING.search(value))
            elif name == "hidden" or value.lower() == "true":
                hidden = True
    return furniture, hidden, names


def _furniture_name(token: str, in_article: bool) -> set[str]:
    """The name in a class or id that begins or ends with it, as ``ad-box`` or ``main-menu`` do."""
    parts = [p.lower() for p in _NAME_PART.findall(token)]
    if not parts or parts[0] in REMARKS:
        return set()
    found = {parts[0], parts[-1]} & NAMES
    if "header" in found and (in_article or len(parts) > 1 and parts[0] not in SITE | {"header"}):
        found.discard("header")
    return found


def shape(node: Node) -> str:
    """The tree as text; equal shapes align alike."""
    if not node.children:
        return node.tag
    return f"{node.tag}({','.join(shape(c) for c in node.children)})"


def align(page: Node, reference: Node) -> dict[int, int]:
    """Numbers of page nodes to numbers of reference nodes, by simple tree matching.

    Two nodes match if their tags are equal; their children are matched in order so that
    the number of matched nodes is largest.
    """
    numbered: dict[tuple, int] = {}

    def kinds(node: Node, found: dict[int, int]) -> dict[int, int]:
        """Numbers of the nodes to numbers of their shapes."""
        below = tuple([kinds(c, found)[c.number] for c in node.children])
        found[node.number] = numbered.setdefault((node.tag, below), len(numbered))
        return found

    own, other = kinds(page, {}), kinds(reference, {})
    known: dict[tuple[int, int], tuple[int, list]] = {}

    def match(a: Node, b: Node) -> tuple[int, list]:
        """Most matched nodes of two shapes, and the places of their matched children."""
        key = (own[a.number], other[b.number])
        if key not in known:
            known[key] = _children(a.children, b.children)
        return known[key]

    def _children(left: list[Node], right: list[Node]) -> tuple[int, list]:
        x, y = [own[c.number] for c in left], [other[c.number] for c in right]
        least = min(len(x), len(y))
        end = 0
        while end < least and x[-1 - end] == y[-1 - end]:
            end += 1
        start = 0
        while start < least - end and x[start] == y[start]:
            start += 1
        # equal shapes at the ends are best matched with each other
        pairs = [(i, i) for i in range(start)] + [(len(x) - i, len(y) - i) for i in range(end, 0, -1)]
        x, y = x[start : len(x) - end], y[start : len(y) - end]
        lefts, rights = {k: left[start + i] for i, k in enumerate(x)}, {k: right[start + j] for j, k in enumerate(y)}
        gains = {}
        for i, a in lefts.items():
            for j, b in rights.items():
                gains[i, j] = match(a, b)[0] if a.tag == b.tag else 0
        pairs += [(start + i, start + j) for i, j in _best_pairs(x, y, gains)]
        return 1 + sum(match(left[i], right[j])[0] for i, j in pairs), pairs

    found, open_pairs = {}, [(page, reference)]
    while open_pairs:
        a, b = open_pairs.pop()
        found[a.number] = b.number
        open_pairs += [(a.children[i], b.children[j]) for i, j in match(a, b)[1]]
    return found


def _best_pairs(x: list[int], y: list[int], gains: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Places in order that have the largest sum of gains, in memory of the lists' length."""
    rows = {}
    if len(x) * len(y) > TABLE_CELLS:
        rows = {i: np.array([gains[i, j] for j in y], np.int64) for i in set(x)}

    def scores(places: range, low: int, high: int, step: int) -> np.ndarray:
        """Best sums of the places with ever more of ``y[low:high]``, from its start or its end."""
        row = np.zeros(high - low + 1, np.int64)
        for i in places:
            gain = rows[x[i]][low:high][::step]
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + gain))
        return row

    pairs, parts = [], [(0, len(x), 0, len(y))]
    while parts:
        first, last, low, high = parts.pop()
        if first == last or low == high:
            continue
        if (last - first) * (high - low) <= TABLE_CELLS:
            pairs += [(first + i, low + j) for i, j in _table_pairs(x[first:last], y[low:high], gains)]
        elif last - first == 1:
            j = high - 1 - int(np.argmax(rows[x[first]][low:high][::-1]))
            if gains[x[first], y[j]]:
                pairs.append((first, j))
        else:
            middle = (first + last) // 2
            before = scores(range(first, middle), low, high, 1)
            after = scores(range(last - 1, middle - 1, -1), low, high, -1)[::-1]
            cut = low + int(np.argmax(before + after))
            parts += [(first, middle, low, cut), (middle, last, cut, high)]
    return pairs


def _table_pairs(x: list[int], y: list[int], gains: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    width = len(y) + 1
    table = [[0] * width]
    for a in x:
        above, row = table[-1], [0] * width
        for j, b in enumerate(y):
            gain = gains[a, b]
            row[j + 1] = max(above[j + 1], row[j], above[j] + gain if gain else 0)
        table.append(row)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        gain = gains[x[i - 1], y[j - 1]]
        if gain and table[i][j] == table[i - 1][j - 1] + gain:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs


def tag_paths(tree: Node) -> dict[int, int]:
    """Numbers of the nodes to checksums of their tag paths."""
    found, open_nodes = {}, [(tree, 0)]
    while open_nodes:
        node, above = open_nodes.pop()
        found[node.number] = own = zlib.crc32(f"/{node.tag}".encode(), above)
        open_nodes += [(c, own) for c in node.children]
    return found


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(page_id, host, copy, html)`` with a digest of their set of tag paths for the page."""
    for batch in batches:
        layouts = []
        for source in batch.column("html").to_pylist():
            paths = sorted(set(tag_paths(parse(source)[0]).values()))
            digest = hashlib.blake2b(repr(paths).encode(), digest_size=8).digest()
            layouts.append(int.from_bytes(digest, "little", signed=True))
        columns = [batch.column(c) for c in ("page_id", "host", "copy")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(layouts, pa.int64())], ["page_id", "host", "copy", "layout"])


_BLOCKS = (
    "page_id long, url string, host string, layout int, near boolean, "
    "blocks array<struct<text:string,slot:int,same:boolean,content:boolean,path:long>>"
)
_BLOCK_TYPE = pa.struct(
    [("text", pa.string()), ("slot", pa.int32()), ("same", pa.bool_()), ("content", pa.bool_()), ("path", pa.int64())]
)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(page_id, url, host, html, references)`` to their blocks.

    ``layout`` is the place of the closest reference, ``near`` tells that it is like the
    page. ``slot`` is the reference node a block is aligned with, -1 without one; ``same``
    tells that the reference has the same text there; ``content`` that the block may be
    content; ``path`` its tag path.
    """
    known: dict = {}
    alignments: dict = {}
    for batch in batches:
        found, layouts, nears = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("host", "html", "references")]
        for host, source, references in zip(*columns):
            tree, blocks = parse(source or "")
            paths = tag_paths(tree)
            mapping, texts, layout, share = {}, {}, 0, 0.0
            if references and blocks:
                if host not in known:
                    if len(known) > 256:
                        known.clear()
                        alignments.clear()
                    known[host] = [_reference(r) for r in references]
                own = set(paths.values())
                shares = [len(own & r[2]) / len(own | r[2]) for r in known[host]]
                share = max(shares)
                layout = shares.index(share)
                other, texts, _ = known[host][layout]
                key = (host, layout, shape(tree))
                if key not in alignments:
                    if len(alignments) > 20_000:
                        alignments.clear()
                    alignments[key] = align(tree, other)
                mapping = alignments[key]
            layouts.append(layout)
            nears.append(share >= NEAR)
            in_article = _article_is_main(blocks)
            rows = []
            for b in blocks:
                slot = mapping.get(b.node.number, -1)
                content = not b.node.furniture and (b.node.article or not in_article)
                if content and b.linked and b.linked > LINK_SHARE * len(b.text) and not b.node.article:
                    content = False
                rows.append((b.text, slot, b.text in texts.get(slot, ()), content, paths[b.node.number]))
            found.append([dict(zip(("text", "slot", "same", "content", "path"), r)) for r in rows])
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("page_id", "url", "host")),
                pa.array(layouts, pa.int32()),
                pa.array(nears, pa.bool_()),
                pa.array(found, pa.list_(_BLOCK_TYPE)),
            ],
            ["page_id", "url", "host", "layout", "near", "blocks"],
        )


def _article_is_main(blocks: list[Block]) -> bool:
    """Whether the articles of a page are its main text, and not teasers beside a longer one."""
    plain = [b for b in blocks if not b.node.furniture]
    inside = sum(len(b.text) for b in plain if b.node.article)
    outside = sum(len(b.text) for b in plain if not b.node.article and b.linked <= LINK_SHARE * len(b.text))
    return 0 < inside and outside <= OUTWEIGHS * inside


def _reference(source: str) -> tuple[Node, dict[int, set[str]], set[int]]:
    tree, blocks = parse(source)
    texts: dict[int, set[str]] = {}
    for b in blocks:
        texts.setdefault(b.node.number, set()).add(b.text)
    return tree, texts, set(tag_paths(tree).values())


def main_text(
    pages: DataFrame, constant_share: float = CONSTANT_SHARE, constant_pages: int = CONSTANT_PAGES
) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    ``text`` is the blocks of the main text in page order, joined by an empty line. Only blocks
    in article or main elements count, if there are any and the text outside has no more than
    ``OUTWEIGHS`` times their characters. A block is dropped as
    template if at least ``constant_pages`` distinct pages of its layout, and ``constant_share``
    of them all, have the reference's text there, or as many of the distinct pages of its host
    have the text at the same tag path. Pages with the same texts are one page, so copies give
    no evidence.

    A null page is empty; a page without content has the empty text. Pages without a host in
    their url form a group of their own. A layout is a set of tag paths. The ``REFERENCES`` layouts
    of a host with most distinct pages, at least ``constant_pages``, have a reference, the page
    with the least id; without such a layout the most common has. Pages go to the closest. Repeated rows get equal results, an
    empty table gives none. Other columns are ignored. Elements nested deeper than
    ``DEEPEST`` are aligned as if they stood there, one after the other.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.col("html").cast("string").alias("html")
    )
    rows = rows.withColumn("copy", F.xxhash64("html"))
    held = rows.where("html is not null and html != ''")
    layouts = (
        held.select("page_id", "host", "copy", "html")
        .mapInArrow(_layouts, "page_id long, host string, copy long, layout long")
        .groupBy("host", "layout", "copy")
        .agg(F.min("page_id").alias("least"))
        .groupBy("host", "layout")
        .agg(F.count("*").alias("pages"), F.min(F.struct("least", "copy"))["copy"].alias("copy"))
    )
    order = Window.partitionBy("host").orderBy(F.desc("pages"), "copy")
    chosen = (
        layouts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= REFERENCES)
        .where((F.col("rank") == 1) | (F.col("pages") >= constant_pages))
        .select("host", "copy", "rank")
    )
    chosen = materialise(chosen, "layouts")
    fits = fits_in_memory(chosen, F.octet_length("host") + 16, REFERENCE_BYTES)
    references = materialise(
        held.join(F.broadcast(chosen) if fits else chosen, ["host", "copy"])
        .groupBy("host", "rank")
        .agg(F.min("html").alias("html"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "html")))["html"].alias("references")),
        "references",
    )
    size = F.octet_length(F.array_join("references", "")) + F.octet_length("host")
    small = F.broadcast(references) if fits_in_memory(references, size, REFERENCE_BYTES) else references
    blocks = rows.join(small, "host", "left").select("page_id", "url", "host", "html", "references")
    blocks = materialise(blocks.mapInArrow(_aligned, _BLOCKS), "blocks")
    def place(b: Column) -> Column:
        return F.xxhash64(b["path"], b["text"])

    def evidence(layout: Column, page: bool, value: Column) -> Column:
        return F.struct(layout.alias("layout"), F.lit(page).alias("page"), value.cast("long").alias("value"))

    # evidence counts once for each distinct page, told by its texts; layout -1 is the whole host
    every, own = F.lit(-1), F.col("layout")
    content = F.filter("blocks", lambda b: b["content"])
    slots = F.filter(content, lambda b: F.col("near") & (b["slot"] >= 0) & b["same"])
    found = F.array_distinct(
        F.concat(
            F.transform(slots, lambda b: evidence(own, False, b["slot"])),
            F.transform(content, lambda b: evidence(every, False, place(b))),
            F.array(evidence(every, True, F.lit(0))),
            F.filter(F.array(evidence(own, True, F.lit(0))), lambda _: F.col("near")),
        )
    )
    counts = (
        blocks.where(F.size("blocks") > 0)
        .select("host", F.xxhash64(F.transform("blocks", lambda b: b["text"])).alias("copy"), found.alias("found"))
        .groupBy("host", "copy")
        .agg(F.min("found").alias("found"))
        .select("host", F.explode("found").alias("e"))
        .groupBy("host", "e.layout", "e.page", "e.value")
        .agg(F.count("*").alias("same"))
        .where(F.col("page") | (F.col("same") >= constant_pages))
    )
    counts = materialise(counts, "evidence")
    # one row per host and layout; what is constant on most of its pages is no more than a page holds
    distinct = counts.where("page").select("host", "layout", F.col("same").alias("pages"))
    small = F.broadcast(distinct) if fits_in_memory(distinct, F.octet_length("host") + 24, REFERENCE_BYTES) else distinct
    constant = (
        counts.where("not page")
        .join(small, ["host", "layout"])
        .where(F.col("same") >= F.col("pages") * constant_share)
        .groupBy("host", "layout")
        .agg(F.collect_list("value").alias("template"))
        .groupBy("host")
        .agg(F.map_from_entries(F.collect_list(F.struct("layout", "template"))).alias("templates"))
    )
    constant = materialise(constant, "templates")
    size = F.size(F.flatten(F.map_values("templates"))) * 8 + F.octet_length("host") + 64
    small = F.broadcast(constant) if fits_in_memory(constant, size, REFERENCE_BYTES) else constant

    def holds(layout: Column, value: Column) -> Column:
        return F.coalesce(F.array_contains(F.try_element_at("templates", layout), value.cast("long")), F.lit(False))

    kept = F.filter(
        "blocks", lambda b: b["content"] & ~(b["same"] & holds(own, b["slot"])) & ~holds(every, place(b))
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    told = blocks.join(small, "host", "left").select("page_id", "url", text.alias("text"))
    return told.withColumn("n_chars", F.length("text").cast("long"))
