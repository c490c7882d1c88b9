"""Main text of web pages by site style trees.

Pages are parsed to blocks: stretches of text between block-level tags, each with the path
of elements around it. Elements that HTML or their whole names mark as menus, headers, footers,
sidebars, notices, adverts, forms or comments are left out, unless they hold the article or
most of the text. Where a page marks its article, the blocks of it are its candidates, else all are.

Candidates, marked or not, are weighed per site. Merging all blocks of the pages of one host gives every node (a path and
its place among equals, counted from either end) a distribution of contents and of inner
markup over the site's different pages. The entropy of these, relative to the number of
pages, is the node's importance: a notice that stands on every page has almost none, an
article paragraph almost one. Pages without the node count as contents of their own, so only what
stands on most of a site is unimportant. A few pages are weak evidence: importance starts at one
and falls with their number, as if ``PRIOR_PAGES`` had said so before; no size of a site switches
anything. Nodes whose content and markup both fall under ``LEAST_IMPORTANCE`` are cut from each page.

Copies of one page are no evidence of a site's boilerplate. Before anything is counted, pages whose
candidates are equal, or equal by 80 % of their characters to those of a smaller page, are left out: pages that share
one of ``BANDS`` samples of blocks, drawn by length, are compared with the smallest of them on all blocks.
Counts are aggregated per (host, node, content) before they meet, so a host with a third of all
pages is no group that any task must hold, and only nodes that hold a content of enough pages are counted.

Defined cases: a null or empty page gives an empty text; pages without a host are read
without site statistics; equal pages of a host count once; repeated rows each get a result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.tables import pick, written

#: Weight of the assumption that a node is important, in pages.
PRIOR_PAGES = 2.9
LEAST_IMPORTANCE = 0.3
#: Pages of more than this share of equal text, in percent, are near copies. Each of the bands is
#: four blocks drawn by length: a pair at the threshold shares one with 98 %.
NEAR_COPY = 80
BANDS, DRAWS = 8, 4

#: Elements that end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search"
    " section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg noframes object xmp".split())
#: Elements that never hold article text.
OUTSIDE = frozenset(
    "nav footer aside form head title button select option textarea dialog menu search fieldset legend label".split()
) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id names that mark what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner sponsor sponsored promo promotion nav navbar navigation"
    " menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices"
    " notification alert newsletter subscribe subscription signup login popup modal overlay comment comments"
    " disqus reply replies respond share sharing social related recommended recommendations pagination pager widget"
    " widgets toolbar search form copyright".split()
)
#: What a compound name may hold besides words of ``NAMES``: site-footer, but not no-sidebar.
PLACES = frozenset(
    "site page main global blog post entry top bottom left right primary secondary sub inner outer section container wrapper"
    " wrap box bar block area list links link mobile desktop button buttons text message".split()
)
#: Names of content: an element that has one of them is not judged by its other class names.
CONTENT = frozenset("article content entry hentry main post story".split())
#: An opened element of the first kind closes an open one of the second, within the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[-_]+")
_NUMBER = re.compile(r"\d+")


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


#: Class names that make even an article element one reader's words.
REMARKS = frozenset(("comment", "reply", "response", "remark"))


def _marked(value: str, marks: frozenset[str]) -> bool:
    """Whether a class or id holds a whole name, or a compound of known words, that marks what is not the article."""
    names = value.split()
    if any(name in CONTENT for name in names):
        return False
    for name in names:
        parts = [p for part in _PART.split(name) if (p := part.strip("0123456789"))]
        if any(p in marks for p in parts) and all(p in marks or p in PLACES or p in NAMES for p in parts):
            return True
    return False


def _remark(value: str) -> bool:
    return any(part in REMARKS for name in value.split() for part in _PART.split(name))


def _names(tag: str, attributes: str, article: bool) -> tuple[str, bool]:
    """The class, id and role of an element, and whether they mark it as no part of an article.

    Names of the page's frame (html, body, main, article) speak of the page, not of their text;
    a header within an article holds its title.
    """
    if "=" not in attributes:
        return "", False
    found = [(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes)]
    if tag in ("html", "body", "main", "article"):
        marks = REMARKS if tag == "article" else frozenset()
        outside = any(w in marks for _, value in found for w in value.split())
    else:
        marks = NAMES - {"header"} if article else NAMES
        outside = any(value.strip() in ROLES if name == "role" else _marked(value, marks) for name, value in found)
    return ".".join(value for _, value in found), outside


class _Outside:
    """An element that is left out with all it holds: its place among the page's elements, and its text."""

    __slots__ = ("articles", "chars", "main", "named", "place")

    def __init__(self, place: int, named: bool) -> None:
        self.place, self.named = place, named
        self.chars = self.articles = 0
        self.main = False


class _Element:
    __slots__ = ("article", "outside", "path", "tag")

    def __init__(self, tag: str, path: str, outside: bool, article: bool) -> None:
        self.tag, self.path, self.outside, self.article = tag, path, outside, article


def page_blocks(page: str) -> list[tuple[str, str, str, bool, bool]]:
    """``path, markup, text, article, candidate`` of every block of a page that is not left out, in page order.

    Where no article is left, elements that were left out are read after all if they hold the
    page's main element or most of its text, as one article or under a mere class or id name.
    """
    read: set[int] = set()
    while True:
        blocks, left_out = _parse(page, read)
        if any(b[3] for b in blocks):
            return [(*b, b[3]) for b in blocks]
        half = (sum(len(b[2]) for b in blocks) + sum(o.chars for o in left_out)) / 2
        wrong = {o.place for o in left_out if o.main or o.articles > half or o.named and o.chars > half}
        if not wrong:
            return [(*b, True) for b in blocks]
        read |= wrong


def parse_blocks(page: str) -> list[tuple[str, str, str, bool]]:
    """``path, markup, text, article`` of every candidate: a block that the site's tree may find to be the article's."""
    return [b[:4] for b in page_blocks(page) if b[4]]


def _parse(page: str, read: set[int]) -> tuple[list[tuple[str, str, str, bool]], list[_Outside]]:
    """All blocks, where elements at the places ``read`` are never left out, and what is left out."""
    left_out: list[_Outside] = []
    place = 0
    stack = [_Element("", "", False, False)]
    out: list[tuple[str, str, str, bool]] = []
    texts: list[str] = []
    markup: list[str] = []

    def flush() -> None:
        top = stack[-1]
        text = " ".join(html.unescape("".join(texts)).split())
        if text and not top.outside:
            holder = next(e for e in reversed(stack) if e.tag in BLOCKS or not e.tag)
            out.append((holder.path, " ".join(markup), text, top.article))
        texts.clear()
        markup.clear()

    def pop(depth: int) -> None:
        del stack[depth:]

    def find(tags: set[str], within: set[str]) -> int | None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in within:
                return None
        return None

    at = 0
    while m := _TOKEN.search(page, at):
        top = stack[-1]
        if not top.outside:
            texts.append(page[at : m.start()])
        elif m.start() > at:
            n = sum(map(len, page[at : m.start()].split()))
            left_out[-1].chars += n
            left_out[-1].articles += n if top.article else 0
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = find({tag}, set())
            if tag in BLOCKS or depth is not None and stack[depth].outside != stack[depth - 1].outside:
                flush()
            else:
                markup.append("/" + tag)
            if depth is not None:
                pop(depth)
            continue
        if tag == "br":
            texts.append(" ")
        parent = stack[-1]
        place += 1
        named, by_name = _names(tag, m[3], parent.article)
        by_tag = tag in OUTSIDE or tag == "header" and not parent.article
        outside = (by_name or by_tag) and (place not in read or tag in RAW)
        if tag in BLOCKS or outside:
            flush()
            closing = CLOSES.get(tag, ({"p"}, {"table", "button", "object"}) if tag in BLOCKS else (set(), set()))
            if closing[0] and (depth := find(*closing)) is not None:
                pop(depth)
            if tag in CLOSES and (depth := find({"p"}, CLOSES[tag][1])) is not None:
                pop(depth)
            parent = stack[-1]
        else:
            markup.append(tag + named)
        if tag in VOID:
            continue
        # numbers in names, as of a post, differ from page to page of one style
        path = f"{parent.path}/{tag}{'.' + _NUMBER.sub('0', named) if named else ''}" if tag in BLOCKS else parent.path
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        article = parent.article or tag == "main" or tag == "article" and not (parent.outside and _remark(named.replace(".", " ")))
        if parent.outside:
            left_out[-1].main |= tag == "main"
        elif outside:
            left_out.append(_Outside(place, by_name and not by_tag))
        stack.append(_Element(tag, path, parent.outside or outside, article))
    if not stack[-1].outside:
        texts.append(page[at:])
    flush()
    return out, left_out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


PARSED = (
    "page_id {id}, url string, host long, blocks array<string>, "
    "nodes array<struct<forward: bigint, backward: bigint, content: bigint, markup: bigint, place: int>>, page long, "
    "bands array<bigint>, parts array<bigint>"
)
#: The lower bits of a part are its number of characters.
_LENGTH = (1 << 24) - 1


def _bands(contents: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Keys that two pages share the likelier the more of their text is equal: blocks drawn by hash and length."""
    if not len(contents):
        return []
    with np.errstate(over="ignore"):
        h = contents.view(np.uint64)[None, :] ^ (np.arange(1, BANDS * DRAWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        drawn = contents[np.argmin(-np.log(((h >> np.uint64(11)) + np.uint64(1)) / 2.0**53) / lengths, axis=1)].reshape(BANDS, DRAWS)
        key = np.zeros(BANDS, np.int64)
        for k in range(DRAWS):
            key = key * np.int64(0x100000001B3) + drawn[:, k]
    return key.tolist()


def parsed_pages(pages: DataFrame, id_type: str) -> DataFrame:
    """Candidates, node keys of all blocks, and what tells near copies, of every row of ``pages(page_id, url, html, host)``;
    ``host`` is 0 for none, ``place`` null for a block that is no candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("forward", "backward", "content", "markup", "place")
        node = pa.struct([(n, pa.int32() if n == "place" else pa.int64()) for n in names])
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                hosts, blocks, nodes, digests, bands, parts = [], [], [], [], [], []
                for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    found = page_blocks(source or "")
                    total: dict[str, int] = {}
                    for path, *_ in found:
                        total[path] = total.get(path, 0) + 1
                    seen: dict[str, int] = {}
                    keys, texts, lengths = [], [], {}
                    for path, markup, text, _, candidate in found:
                        k = seen[path] = seen.get(path, -1) + 1
                        content = _hash(text)
                        place = len(texts) if candidate else None
                        keys.append((_hash(path, str(k)), _hash(path, str(k - total[path])), content, _hash(markup), place))
                        if candidate:
                            texts.append(text)
                            lengths[content] = len(text)
                    hosts.append(_hash(host) if host else 0)
                    blocks.append(texts)
                    nodes.append([dict(zip(names, k, strict=True)) for k in keys])
                    digests.append(_hash(*texts))
                    contents = np.fromiter(lengths, np.int64, len(lengths))
                    bands.append(_bands(contents, np.fromiter(lengths.values(), np.int64, len(lengths))))
                    parts.append([(c & ~_LENGTH) | min(n, _LENGTH) for c, n in lengths.items()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.int64()),
                        pa.array(blocks, pa.list_(pa.string())), pa.array(nodes, pa.list_(node)), pa.array(digests, pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int64())),
                    ],
                    names=["page_id", "url", "host", "blocks", "nodes", "page", "bands", "parts"],
                )

    return pages.mapInArrow(run, PARSED.format(id=id_type))


def _importance(seen: DataFrame, sizes: DataFrame, what: str) -> DataFrame:
    """Relative entropy of ``what`` at each ``host, node`` over all ``n`` different pages of the host, from
    1 down by the weight that ``n`` pages have."""
    each = seen.groupBy("host", "node", what).agg(F.count(F.lit(1)).alias("c"))
    equal = each.groupBy("host", "node").agg(F.sum(F.col("c") * F.log("c")).alias("equal")).join(sizes, "host")
    weight = (F.col("n") - 1) / (F.col("n") - 1 + PRIOR_PAGES)
    # pages without the node are singletons, which add nothing to the sum
    sameness = F.col("equal") / (F.col("n") * F.log(F.greatest("n", F.lit(2))))
    return equal.select("host", "node", (1 - weight * sameness).alias(what))


def near_copies(parsed: DataFrame) -> DataFrame:
    """``host, page`` of the pages that are near copies of a smaller page of their host."""
    pages = parsed.filter("host <> 0")
    banded = pages.select("host", "page", F.posexplode("bands").alias("place", "band"))
    met = banded.groupBy("host", "place", "band").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    # written, so that Spark knows how few they are and moves no pages to find them
    met = written(met.filter("first < last").drop("last"), "page-bands")
    pairs = banded.join(met, ["host", "place", "band"]).filter("page > first").select("host", "page", "first").distinct()
    pairs = written(pairs, "page-pairs")
    parts = pages.select("host", "page", "parts").dropDuplicates(["host", "page"])
    one = parts.join(pairs, ["host", "page"])
    two = parts.join(pairs.select("host", F.col("first").alias("page")).distinct(), ["host", "page"], "left_semi")
    both = one.join(two.select("host", F.col("page").alias("first"), F.col("parts").alias("others")), ["host", "first"])
    chars = "aggregate({}, 0L, (s, x) -> s + (x & " + str(_LENGTH) + "))"
    equal, all_of = chars.format("array_intersect(parts, others)"), f"{chars.format('parts')} + {chars.format('others')}"
    near = both.withColumn("equal", F.expr(equal)).filter(F.expr(f"100 * equal >= {NEAR_COPY} * ({all_of} - equal)"))
    return written(near.select("host", "page").distinct(), "page-copies")


def different_pages(parsed: DataFrame) -> DataFrame:
    """``host, page, nodes`` of the pages that count in their sites' trees; equal ones may come more than once."""
    pages = parsed.filter("host <> 0 AND size(nodes) > 0").select("host", "page", "nodes")
    return pages.join(near_copies(parsed), ["host", "page"], "left_anti")


def _sizes(pages: DataFrame) -> DataFrame:
    return pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def _at_nodes(blocks: DataFrame, *columns: str) -> DataFrame:
    return blocks.select("host", *columns, F.explode(F.array_distinct(F.array("forward", "backward"))).alias("node"))


def _tree(pages: DataFrame, sizes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    seen = _at_nodes(pages.select("host", "page", F.inline("nodes")), "page", "content", "markup")
    if only is not None:
        seen = seen.join(only, ["host", "node"], "left_semi")
    seen = seen.distinct()
    return _importance(seen, sizes, "content").join(_importance(seen, sizes, "markup"), ["host", "node"])


def node_importance(parsed: DataFrame) -> DataFrame:
    """``host, node, content, markup``: the importance of either at every node of a site's tree."""
    pages = different_pages(parsed)
    return _tree(pages, _sizes(pages))


def low_nodes(parsed: DataFrame) -> DataFrame:
    """``host, node`` of the nodes with little importance.

    Relative entropy is at least 1 - log(c) / log(n) where no content stands on more than c of n pages, so
    nodes without a content of that many pages have more; the others are counted in full.
    """
    pages = different_pages(parsed)
    sizes = written(_sizes(pages), "host-pages")
    held = pages.select("host", "page", F.explode(F.expr("array_distinct(nodes.content)")).alias("content")).distinct()
    common = held.groupBy("host", "content").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").join(sizes, "host")
    common = written(common.filter(F.log("c") > (1 - LEAST_IMPORTANCE) * F.log("n") - 1e-9).select("host", "content"), "common-contents")
    blocks = pages.select("host", F.inline("nodes")).join(common, ["host", "content"], "left_semi")
    only = written(_at_nodes(blocks).distinct(), "common-nodes")
    return _tree(pages, sizes, only).filter(F.greatest("content", "markup") < LEAST_IMPORTANCE).select("host", "node")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page ``id_col, url_col, text, n_chars, n_blocks, n_cut`` (blocks cut by the site's tree)."""
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("host", host_of(F.col("url")))
    id_type = rows.schema["page_id"].dataType.simpleString()
    parsed = written(parsed_pages(rows, id_type).withColumn("row", F.monotonically_increasing_id()), "page-blocks")
    low = written(low_nodes(parsed), "low-nodes")
    placed = parsed.select("row", "host", F.inline("nodes")).filter("place IS NOT NULL").select(
        "row", "host", "place", F.explode(F.array_distinct(F.array("forward", "backward"))).alias("node")
    )
    # written, so that the final join knows the size of this side before it moves any text
    cut = written(placed.join(low, ["host", "node"], "left_semi").groupBy("row").agg(F.collect_set("place").alias("cut")), "page-cuts")
    text = "array_join(filter(blocks, (b, i) -> cut is null or not array_contains(cut, i)), '\\n\\n')"
    return parsed.select("row", "page_id", "url", "blocks").join(cut, "row", "left").select(
        F.col("page_id").alias(id_col), F.col("url").alias(url_col), F.expr(text).alias("text"),
        F.expr("cast(size(blocks) as bigint)").alias("n_blocks"),
        F.expr("cast(coalesce(size(cut), 0) as bigint)").alias("n_cut"),
    ).select(id_col, url_col, "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_cut")
