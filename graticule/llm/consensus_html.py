"""HTML extraction by consensus host paths.

Every page scores its containers: a block of text counts fully for the container it stands in, half for the
next one up, a third for the one above, and text inside links counts against it.  The page votes for the
tag-class path of its best container, generalised (digits and generated names taken out of class names).
Votes are counted per host in Spark, and each page is extracted again at the winning path of its host; a page
without that path, or without a host, is extracted at its own best container.

A best container without the page's title (``h1``) is then widened to its parent while that brings the title or a real
part of the text beside it, outside links; so an article of several sections is not reduced to its longest one.

Text inside navigation, headers, footers, sidebars, forms, scripts and the like never counts, nor does an
element whose class, id or role names such a part.  A name counts by its last telling word (``notice-board`` is a
board) inside an article, by any word elsewhere; states and options (``has-sidebar``, ``no-comments``,
``comments-open``) name no part.  Where no article or main element is left, an element left out for its name that
holds most of the text outside links is kept if its last telling words are others or it holds an article, main or h1 element;
reader comments never are.

Defined cases: null or empty html gives empty text; a null url or one without host counts for itself; equal
votes go to the greatest path; unclosed, crossed and stray tags are repaired the way browsers do for paragraphs
and list items; pages that repeat are separate pages; other columns are ignored; nothing is capped.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from graticule.llm.batches import pieces
from graticule.llm.ordering import same
from graticule.llm.url_trees import host_of
from graticule.plans.lineage import cut

# Elements of HTML by role.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style noscript template iframe noembed noframes textarea title xmp svg math".split())
LEFT_OUT = set("nav header footer aside form dialog menu button select option label fieldset head object video audio canvas".split())
CONTAINERS = set("article main section div td body".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Words in class names, ids and roles of page furniture.
FURNITURE = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus dialog footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted promotion recommended related replies responses search share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar widget".split())

COMMENTS = set("comment comments disqus replies responses".split())
# Words that say where or what shape a part is, not what it holds, and words of states and options.
SHAPES = set("area bar block body bottom box buttons button card cell center col column columns container content count field fields form group head icon icons image inner input item items label left link links list main module outer page panel pane part post posts region reply right row section site slot story text thread title top tree unit wrap wrapper zone".split())
OPTIONS = set("has no non not with without".split())
STATES = set("open closed off on enabled disabled hidden".split())

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
GENERATED = re.compile(r"(?=\S*\d)(?=\S*[a-z])[a-z0-9]{6,}$", re.IGNORECASE)


def named(token: str, whole: bool) -> set[str]:
    """Furniture words of one class, id or role; with ``whole``, only if its last telling word is one."""
    words = [w.lower() for w in NAME.findall(token)]
    if len(words) > 1 and (OPTIONS & set(words[:-1]) or words[-1] in STATES):
        return set()
    if whole:
        while len(words) > 1 and (words[-1] in SHAPES or len(words[-1]) == 1) and words[-1] not in FURNITURE:
            words.pop()
        words = words[-1:]
    return set(words) & FURNITURE


def furniture(names: str, inside: bool) -> set[str]:
    """Words in names that say page furniture; the header of an article holds its title."""
    found = set().union(*[named(token, inside) for token in names.split()])
    if found == {"header"} and {w.lower() for w in NAME.findall(names)} & {"article", "entry", "post", "story"}:
        return set()
    return found


class Node:
    """An open element.  ``hard``: left out whatever it holds; ``soft``: nearest element around it that is left out for its name."""

    __slots__ = ("tag", "parent", "step", "hard", "soft", "weak", "at", "held", "inside", "link", "block", "score", "mark", "plain", "linked", "title")

    def __init__(self, tag: str, parent: Node | None, attributes: str, at: int = 0, spared: frozenset[int] = frozenset()):
        self.tag, self.parent, self.at, self.score, self.mark = tag, parent, at, 0.0, None
        self.held = self.plain = self.linked = 0
        self.title = False
        self.block = tag in BLOCKS
        self.link = tag == "a" or (parent is not None and parent.link)
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        names = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        words = set() if tag in ("body", "html", "article", "main") else furniture(names, self.inside)
        self.hard = (parent is not None and parent.hard) or tag in LEFT_OUT or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() \
            or bool(words & COMMENTS)
        self.soft = self if words and at not in spared else parent.soft if parent is not None else None
        self.weak = self.soft is self and not furniture(names, True)
        classes = sorted({re.sub(r"\d+", "#", c) for c in found.get("class", "").split() if not GENERATED.match(c)})
        self.step = ".".join([tag, *classes])

    @property
    def out(self) -> bool:
        return self.hard or self.soft is not None

    def path(self) -> str:
        steps, node = [], self
        while node is not None:
            if node.block:
                steps.append(node.step)
            node = node.parent
        return ">".join(reversed(steps))


def _mark(before: int, step: str) -> int:
    return xxhash.xxh64_intdigest(step.encode(), before)


def parsed(page: str) -> list[tuple[Node, str, int]]:
    """Blocks in page order: (block element, text, characters of it inside links).  Left-out parts are not among them."""
    blocks, named_parts, total = read(page, frozenset())
    most = frozenset(n.at for n in named_parts if n.weak and 2 * n.held > total)
    if most and not any(node.inside for node, _, _ in blocks):
        blocks, _, _ = read(page, most)
    return blocks


def read(page: str, spared: frozenset[int]) -> tuple[list[tuple[Node, str, int]], list[Node], int]:
    """(blocks, elements left out for their name, characters outside links in both); names at the places ``spared`` do not count."""
    named_parts, total = [], 0
    node = Node("html", None, "")
    stack, blocks, pieces, linked = [node], [], [], 0
    home = node  # block element of the current text

    def end_block() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((home, text, linked))
            pieces, linked = [], 0

    def close_to(k: int) -> None:
        nonlocal home
        if any(n.block for n in stack[k:]):
            end_block()
        del stack[k:]
        home = next(n for n in reversed(stack) if n.block)

    at = 0
    while at < len(page):
        opens, m = page.find("<", at), None
        while opens >= 0 and not (m := TAG.match(page, opens)):
            opens = page.find("<", opens + 1)
        text = page[at: opens] if m else page[at:]
        if text and not stack[-1].out:
            text = entities.unescape(text)
            pieces.append(text)
            if stack[-1].link:
                linked += len(text.strip())
        if text and not stack[-1].hard and not stack[-1].link:
            total += (size := len(text.strip()))
            part = stack[-1].soft
            while part is not None:
                part.held += size
                part = part.parent.soft
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k and (stack[k].block or not any(n.block for n in stack[k + 1:])):
                close_to(k)
            continue
        if tag == "br":
            pieces.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag != "a":
            if tag == "hr":
                end_block()
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        if tag in BLOCKS:
            k = len(stack)
            for j in range(len(stack) - 1, 0, -1):
                if stack[j].tag == "p":
                    k = j
                    break
                if stack[j].block:
                    break
            for j in range(k - 1, 0, -1):
                if stack[j].tag in CLOSES.get(tag, ()):
                    k = j
                elif stack[j].tag in SCOPES.get(tag, ("",)) or tag not in CLOSES:
                    break
            if k < len(stack):
                close_to(k)
            end_block()
        node = Node(tag, stack[-1], m[3], m.start(), spared)
        stack.append(node)
        if node.soft is node:
            named_parts.append(node)
        if tag in ("article", "main", "h1") and not node.hard:
            part = node.soft
            while part is not None:
                part.weak, part = True, part.parent.soft
        if node.block:
            home = node
    end_block()
    return blocks, named_parts, total


def best(blocks: list[tuple[Node, str, int]]) -> Node | None:
    """The container that gathers most, widened; inside an article or main element, that element."""
    held: dict[int, Node] = {}
    for node, text, linked in blocks:
        worth, level, title = len(text) - 2.0 * linked, 1, node.tag == "h1"
        while node is not None:
            if node.tag in CONTAINERS or node.tag == "html":
                node.score += worth / level
                node.plain += len(text) - linked
                node.linked += linked
                node.title = node.title or title
                held[id(node)] = node
                level += 1
            node = node.parent
    top = max(held.values(), key=lambda n: n.score, default=None)  # the first of equals
    for wanted in ("article", "main"):
        node = top
        while node is not None:
            if node.tag == wanted:
                return node
            node = node.parent
    return widened(top)


WIDER = 5  # text beside a container belongs to it from a fifth of its own


def widened(top: Node | None) -> Node | None:
    """The outermost container reached, until one holds the title, while the text added outside links is at least twice that
    inside links and a fifth of the text so far, or brings the title."""
    node = top and top.parent
    while node is not None and not top.title:
        if node.tag in CONTAINERS or node.tag == "html":
            plain, linked = node.plain - top.plain, node.linked - top.linked
            if plain >= 2 * linked and (WIDER * plain >= top.plain and plain or node.title):
                top = node
        node = node.parent
    return top


def text_at(blocks: list[tuple[Node, str, int]], path: str | None) -> str | None:
    """Text of the blocks below ``path``; None if no block is."""
    if path is None:
        return None
    goal = 0
    for step in path.split(">"):
        goal = _mark(goal, step)

    def below(node: Node | None) -> tuple[int, bool]:
        chain = []
        while node is not None and node.mark is None:
            chain.append(node)
            node = node.parent
        mark, inside = node.mark if node is not None else (0, False)
        for n in reversed(chain):
            mark = _mark(mark, n.step) if n.block else mark
            inside = inside or mark == goal
            n.mark = (mark, inside)
        return mark, inside

    kept = [text for node, text, _ in blocks if below(node)[1]]
    return " ".join(kept) if kept else None


def votes(pages: DataFrame) -> DataFrame:
    """host, path of the best container of each page."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            paths = [(n := best(parsed(p or ""))) and n.path() for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], names=["host", "path"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(scan, "host string, path string").where("host <> '' AND path IS NOT NULL")


BROADCAST_HOSTS = 100_000  # up to this many winners are copied to all tasks
SALTS = 64


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, text."""
    count = votes(pages).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    winners = cut(count.groupBy("host").agg(F.max(F.struct("n", "path")).alias("w")).select(F.col("host").alias("_host"), F.col("w.path").alias("path")))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), same(F.col("host"), F.col("_host")), "left")
    else:  # pages of one host are dealt to several tasks
        spread = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
        winners = winners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(winners, same(F.col("host"), F.col("_host")) & (spread == F.col("_salt")), "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            paths, texts = [], []
            for page, path in zip(b.column(2).to_pylist(), b.column(4).to_pylist()):
                blocks = parsed(page or "")
                text = text_at(blocks, path)
                if text is None:
                    own = best(blocks)
                    path = own and own.path()
                    text = text_at(blocks, path)
                paths.append(path), texts.append(text or "")
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(3), pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["page_id", "url", "host", "path", "text"])

    return joined.select("page_id", "url", "html", "host", "path").mapInArrow(scan, "page_id long, url string, host string, path string, text string")
