"""Main text of web pages, by templates deduced from pages of the same host.

Each page becomes a stream of tokens: the start tags of all its elements but those within a line, menus and footers among
them, told apart by the containers around them; and blocks of text, told apart by their container and content.  Tokens
of a host with the same occurrence vector form an equivalence class; a vector is kept as a fingerprint that partial sums
can build, so a host with a third of all pages is no hot spot.  A class is valid if its tokens, two or more of them, are
found once in each of three pages or more; since a path holds those of the containers around it, valid classes nest: those
on all pages, and within them those of one of several layouts.  They are the template, and blocks in valid classes are text
of the template.  All other text fills slots.

Of the template's containers, a page's innermost one that holds four fifths of the text of the pages that have it is the
page's region, and what fills slots there is read in page order.  Pages of equal text count once.

Names label slots that the template has told apart: text in menus, headers, footers, sidebars, notices, adverts, forms and
reader comments goes and does not weigh; a region within an article or main element grows to all of it, and in a larger
region the slots in such an element are read.  Numbers in class and id words are left out of paths.

Where a host has too few pages for a template, and for pages that fill no slot of a region, the names decide alone.

Null and empty pages give an empty text.  Rows of the same page are each read.  Pages without a host form one host.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomweave.llm.storage import checkpointed

#: Fixed names of HTML: elements within a line of text, elements without content, elements whose content is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
CONTAINERS = frozenset("html head body nav header footer aside section article main div form ul ol dl table figure dialog menu svg button select fieldset".split())
BOILERPLATE = frozenset("head nav header footer aside form dialog menu svg button select fieldset script style noscript template iframe textarea title".split())
#: Words of class, id and role that name what is not the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended "
                  "notice notices cookie cookies consent popup modal newsletter subscribe signup login share sharing social comment comments respond disqus replies pagination pager toolbar search".split())
ARTICLE = frozenset(("article", "main"))


@dataclass(frozen=True)
class Names:
    """Elements and words that label a slot as no part of the article, and elements that hold one."""

    boilerplate: frozenset = BOILERPLATE
    words: frozenset = NAMES
    article: frozenset = ARTICLE


USUAL, NONE = Names(), Names(frozenset(), frozenset(), frozenset())
LEAST_PAGES = 3  # that hold a token of the template
SHARE = 0.8  # of the text of its pages that a region holds
MOST_BYTES = 32 << 20  # of templates that are broadcast; more are joined

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NUMBER = re.compile(r"(?<![a-z])[0-9a-f]*[0-9][0-9a-f]*(?![a-z])|[0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for tag in RAW}


def _labels(attributes: str) -> tuple[str, ...]:
    return tuple(w for m in _NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()) if attributes else ()


def _is_boilerplate(tag: str, labels: tuple[str, ...], names: Names) -> bool:
    return tag in names.boilerplate or tag not in names.article and tag not in ("html", "body") and any(part in names.words for w in labels for part in re.split(r"[-_]", w))


class Node:
    """All elements of a page with one path: key, the path's hash; times, how often it opens; chars, of text within."""

    __slots__ = ("key", "parent", "depth", "own", "rejected", "article", "times", "chars", "tag", "children", "names")

    def __init__(self, parent: Node | None, name: str, tag: str, labels: tuple[str, ...], names: Names):
        self.parent, self.tag, self.times, self.chars, self.children, self.names = parent, tag, 0, 0, {}, names
        self.key = _hash(f"{parent.key if parent else ''}/{name}")
        self.depth = parent.depth + 1 if parent else 0
        self.article = bool(parent and parent.article) or tag in names.article
        self.own = _is_boilerplate(tag, labels, names)
        self.rejected = bool(parent and parent.rejected) or self.own and not (tag == "header" and self.article and not labels)

    def child(self, tag: str, attributes: str) -> Node:
        """The node of an element in this one. Numbers, also hexadecimal ones, are left out: they tell pages apart, not containers."""
        found = self.children.get((tag, attributes))
        if found is None:
            labels = _labels(attributes)
            name = tag + "".join(f".{_NUMBER.sub('#', w)}" for w in labels)
            found = self.children.get(name)
            if found is None:
                found = self.children[name] = Node(self, name, tag, labels, self.names)
            self.children[tag, attributes] = found
        return found


def parse(html: str, names: Names = USUAL) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The nodes of a page, parents before children, and its blocks of text in order, with the node that holds each."""
    root = Node(None, "", "", (), names)
    nodes, blocks, stack, current, at = [root], [], [root], [], root
    held = Counter()  # tags on the stack

    def opened(tag: str, attributes: str) -> Node:
        node = stack[-1].child(tag, attributes)
        if not node.times:
            nodes.append(node)
        node.times += 1
        return node

    def end():
        text = " ".join(unescape("".join(current)).split())
        if text:
            blocks.append((at, text))
            at.chars += len(text)
        current.clear()

    place = 0
    while place < len(html):
        m = _TOKEN.search(html, place)
        stop = m.start() if m else len(html)
        text = html[place:stop]
        place = m.end() if m else stop
        if m and not m[2] and m[0].startswith("<![CDATA["):
            text += m[0][9:].removesuffix("]]>").replace("&", "&amp;")
        if text and not stack[-1].rejected:
            current.append(text)
            at = stack[-1]
        if not m or not m[2]:
            continue
        closing, tag = m[1], m[2].lower()
        if tag in RAW and not closing:
            end()
            opened(tag, "")
            behind = _RAW_END[tag].search(html, place)
            place = behind.end() if behind else len(html)
            continue
        if tag in INLINE and tag not in VOID:
            if closing:  # only inline elements that are boilerplate were put on the stack
                if len(stack) > 1 and stack[-1].tag == tag:
                    held[stack.pop().tag] -= 1
            elif m[3] and _is_boilerplate(tag, _labels(m[3]), names):
                stack.append(opened(tag, m[3]))
                held[tag] += 1
            continue
        end()
        if tag in VOID:
            continue
        if closing:
            while held[tag]:  # all that is open within ends with it
                last = stack.pop().tag
                held[last] -= 1
                if last == tag:
                    break
            continue
        if tag == "body" and held["head"]:
            stack = [x for x in stack if x.tag != "head"]
            held["head"] = 0
        node = opened(tag, m[3])
        if tag in CONTAINERS or node.own:
            stack.append(node)
            held[tag] += 1
    end()
    return nodes, blocks


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _hosts(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return pages.select("page_id", "url", "html", F.xxhash64(F.lower(host)).alias("host"))


def occurrences(pages: DataFrame, labels: Names = USUAL) -> DataFrame:
    """(host, node, block, vector, n_pages, once, depth, chars, page_chars) of each token: a start tag (block: null) or a block in its node.

    once: no page has it twice; chars: of the text in all elements of the path, page_chars: of their pages.
    """
    names = ("host", "node", "block", "page", "times", "depth", "chars", "page_chars")

    def run(batches):
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes, blocks = parse(html or "", labels)
                if not blocks:
                    continue
                page, count = _hash("\0".join(text for _, text in blocks)), {}
                total = sum(len(text) for _, text in blocks)
                for node in reversed(nodes):  # children before parents
                    if node.parent:
                        node.parent.chars += node.chars
                for node in nodes:
                    rows.append((host, node.key, None, page, node.times, node.depth, node.chars, total))
                for node, text in blocks:
                    key = node.key, _hash(text)
                    count[key] = count.get(key, 0) + 1
                rows += [(host, *key, page, n, 0, 0, 0) for key, n in count.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=list(names))

    found = pages.select("host", "html").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    once = found.groupBy("host", "node", "block", "page").agg(*(F.max(c).alias(c) for c in names[4:]))
    return once.groupBy("host", "node", "block").agg(F.bit_xor(F.xxhash64("page", "times")).alias("vector"), F.count("*").alias("n_pages"), (F.max("times") == 1).alias("once"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("page_chars").alias("page_chars"))


def templates(pages: DataFrame, names: Names = USUAL) -> DataFrame:
    """(host, regions, fixed): the containers of a host's template that hold a page's text, and its texts, each (node, block)."""
    found = checkpointed(occurrences(pages, names).where(f"once AND n_pages >= {LEAST_PAGES}"))  # others are in no valid class
    valid = found.groupBy("host", "vector", "n_pages").agg(F.count("*").alias("tokens"), F.count_if(F.col("block").isNull()).alias("tags")).where("tokens >= 2 AND tags >= 1").select("host", "vector", "n_pages")
    kept = found.join(valid, ["host", "vector", "n_pages"], "left_semi")
    region = F.when(F.col("block").isNull() & (F.col("depth") > 0) & (F.col("chars") >= SHARE * F.col("page_chars")), F.col("node"))
    fixed = F.when(F.col("block").isNotNull(), F.struct("node", "block"))
    return kept.groupBy("host").agg(F.collect_list(region).alias("regions"), F.collect_list(fixed).alias("fixed"))


def read_page(html: str, regions, fixed, names: Names = USUAL) -> str:
    """The main text of a page; regions and fixed: of its host's templates."""
    nodes, blocks = parse(html, names)
    slots = [(node, text) for node, text in blocks if not fixed or (node.key, _hash(text)) not in fixed]
    region = max((n for n in nodes if n.key in regions), key=lambda n: n.depth, default=None)
    if region is not None:
        while region.article and region.parent and region.parent.article:
            region = region.parent
        inside = {id(region)}
        inside.update(id(n) for n in nodes if n.parent and id(n.parent) in inside)  # parents come first
        slots = [(node, text) for node, text in slots if id(node) in inside]
    slots = slots or blocks
    named = [x for x in slots if x[0].article]
    return " ".join(text for _, text in named or slots)


def extract(pages: DataFrame, names: Names = USUAL) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html); names: NONE to leave all to the templates."""
    pages = _hosts(pages)
    known = checkpointed(templates(pages, names))
    size = known.agg(F.sum(8 * F.size("regions") + 16 * F.size("fixed") + 64)).first()[0] or 0
    joined = pages.join(F.broadcast(known) if size <= MOST_BYTES else known, "host", "left").select("page_id", "url", "html", "host", "regions", "fixed")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets, made = {}, []
                for html, host, regions, fixed in zip(*(part.column(c).to_pylist() for c in ("html", "host", "regions", "fixed"))):
                    if host not in sets:
                        sets[host] = set(regions or ()), {(x["node"], x["block"]) for x in fixed or ()}
                    made.append(read_page(html or "", *sets[host], names))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(made, type=pa.string())], names=["page_id", "url", "text"])

    schema = joined.select("page_id", "url", F.lit("").alias("text")).schema
    return joined.mapInArrow(run, schema)
