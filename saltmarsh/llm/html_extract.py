"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that part blocks (fixed list); all others are inline, and part nothing.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not markup, and elements that have no content (fixed lists).
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never the article (fixed list).
OUTSIDE_TAGS = frozenset(
    "head title script style noscript template iframe object svg canvas math nav aside footer form fieldset select optgroup option"
    " button input textarea label datalist dialog menu search audio video noembed noframes xmp".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class or id that mark what surrounds an article.
OUTSIDE_WORDS = frozenset(
    "ad ads adbox adsbygoogle adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion"
    " nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toolbar topbar masthead skip"
    " sidebar aside rail widget widgets related recommended recommendations trending popular"
    " footer foot copyright legal colophon"
    " cookie cookies consent gdpr notice notices alert popup modal overlay"
    " comment comments commentlist disqus replies reply respond"
    " newsletter subscribe subscription signup login share sharing social".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies teaser related ad".split())
CLOSES_P = BLOCK_TAGS - frozenset("body head html title caption tbody td tfoot th thead tr option optgroup legend".split())
#: What an opening tag ends: elements of these kinds, within the nearest of those.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Where a comment, a declaration or a tag may begin; declarations and comments end at the page's end at the latest.
OPENING = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z]", re.DOTALL)
QUOTE_OR_END = re.compile(r"[>\"']")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[,.;:!?…、。，；：！？]")


#: Elements that the search for the article's container may go down into, and those it stops at.
CONTAINERS = frozenset("html body div section center table tbody tr td dl details article main".split())
ARTICLES = ("article", "main")
HEADINGS = ("h1", "h2", "h3")
#: What a path's ratio is multiplied by if a class or id in it names what surrounds articles.
NAMED = 0.05
#: A path is content from this share of the page's best path on; a container holds this share of what is content.
SHARE, HELD = 0.15, 0.7
#: Mean characters, and marks of punctuation, of a block at which a ratio is half of what it can be.
HALF_CHARS, HALF_MARKS = 40.0, 1.0


@dataclass
class Node:
    """A block element: its parent and path by number, whether a word in it or above names surroundings, what hides it."""

    tag: str
    parent: int
    path: int
    outside: bool
    article: bool
    named: bool
    number: int
    parts: list[tuple[str, bool, bool]] = field(default_factory=list)
    inline: list[list] = field(default_factory=list)


@dataclass
class Block:
    """A run of text in one element: its element and path by number, the characters of it that are links."""

    text: str
    node: int
    path: int
    tag: str
    links: int
    named: bool


@dataclass
class Page:
    """The blocks of a page in order, and of each element its parent, its tag and whether it lies in an article."""

    blocks: list[Block]
    parents: list[int]
    tags: list[str]
    articles: list[bool]


def _outside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether the element is never part of an article by what HTML says of it: its kind, role, or that it is hidden."""
    if tag in OUTSIDE_TAGS or tag == "header" and not in_article:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""):
        return True
    return attributes.get("role") in OUTSIDE_ROLES


def _named(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a class or id names what surrounds articles."""
    names = set(WORDS.findall(attributes.get("class", "") + " " + attributes.get("id", "")))
    if tag in ("html", "body", "main", "article"):
        return tag == "article" and bool(names & COMMENT_WORDS)
    return bool(names & OUTSIDE_WORDS) or not in_article and "header" in names


class Tokens:
    """Comments, declarations and tags of a page in order. A tag ends at the first > outside quotes; without one it is text.

    What follows a place outside quotes does not depend on where the tag began, so places from which no end was found are
    remembered, and each is passed once, however many tags never end.
    """

    def __init__(self, page: str) -> None:
        self.page, self.endless = page, set()

    def tag_end(self, at: int) -> int | None:
        passed = []
        while (found := QUOTE_OR_END.search(self.page, at)) and found.start() not in self.endless:
            passed.append(found.start())
            if found.group() == ">":
                return found.end()
            at = self.page.find(found.group(), found.end()) + 1
            if not at:
                break
        self.endless.update(passed)
        return None

    def next(self, at: int) -> tuple[int, int] | None:
        """Start and end of the first token from at."""
        while found := OPENING.search(self.page, at):
            if found.group()[1] in "!?":
                return found.span()
            end = self.tag_end(found.end())
            if end:
                return found.start(), end
            at = found.end()
        return None


class Reader:
    """Reads a page's markup into blocks. A path is the tags and classes of the open block elements, from the root."""

    def __init__(self) -> None:
        self.page, self.paths = Page([], [-1], [""], [False]), {}
        self.stack = [Node("", -1, 0, False, False, False, 0)]
        #: Open block and inline elements by kind; how many open inline ones are hidden, named or links.
        self.open, self.open_inline = Counter(), {}
        self.hidden = self.named = self.links = 0

    def put(self, text: str) -> None:
        if not self.hidden:
            self.stack[-1].parts.append((html.unescape(text), self.named > 0, self.links > 0))

    def end_block(self) -> None:
        node = self.stack[-1]
        if not node.parts:
            return
        own = [p for p in node.parts if not p[1]]
        named = node.named
        if not "".join(text for text, _, _ in own).split():
            own, named = node.parts, True
        text = " ".join("".join(text for text, _, _ in own).split())
        links = sum(len("".join(text.split())) for text, _, link in own if link)
        node.parts = []
        if text and not node.outside:
            self.page.blocks.append(Block(text, node.number, node.path, node.tag, links, named))

    def _shut(self, inline: list) -> None:
        if inline[4]:
            inline[4] = False
            self.hidden, self.named, self.links = self.hidden - inline[1], self.named - inline[2], self.links - inline[3]

    def close(self, upto: int) -> None:
        """Closes block elements down to upto of them, and the inline elements opened within those."""
        while len(self.stack) > upto:
            self.end_block()
            node = self.stack.pop()
            self.open[node.tag] -= 1
            for inline in node.inline:
                self._shut(inline)

    def end_tag(self, tag: str) -> None:
        if tag == "br":
            self.put(" ")
        elif tag in BLOCK_TAGS:
            if self.open[tag]:
                self.close(next(k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == tag))
            else:
                self.end_block()
        else:
            same = self.open_inline.get(tag, [])
            while same and not same[-1][4]:
                same.pop()
            if same:
                self._shut(same.pop())

    def start_block(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in CLOSES_P and self.stack[-1].tag == "p":
            self.close(len(self.stack) - 1)
        if tag in ENDS and any(self.open[t] for t in ENDS[tag][0]):
            ended, within = ENDS[tag]
            upto = None
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in within:
                    break
                if self.stack[k].tag in ended:
                    upto = k
            if upto is not None:
                self.close(upto)
        self.end_block()
        if tag in VOID_TAGS:  # hr parts blocks and holds nothing
            return
        inside = self.stack[-1]
        number = len(self.page.parents)
        path = self.paths.setdefault((inside.path, tag, attributes.get("class", "")), len(self.paths) + 1)
        article = inside.article or tag in ARTICLES or attributes.get("role") in ARTICLES
        outside = inside.outside or self.hidden > 0 or _outside(tag, attributes, inside.article)
        named = inside.named or self.named > 0 or _named(tag, attributes, inside.article)
        self.page.parents.append(inside.number)
        self.page.tags.append("article" if attributes.get("role") in ARTICLES else tag)
        self.page.articles.append(article)
        self.stack.append(Node(tag, inside.number, path, outside, article, named, number))
        self.open[tag] += 1

    def start_inline(self, tag: str, attributes: dict[str, str]) -> None:
        inline = [tag, _outside(tag, attributes, True), _named(tag, attributes, True), tag == "a", True]
        self.hidden, self.named, self.links = self.hidden + inline[1], self.named + inline[2], self.links + inline[3]
        self.stack[-1].inline.append(inline)
        self.open_inline.setdefault(tag, []).append(inline)

    def read(self, page: str) -> Page:
        at, tokens = 0, Tokens(page)
        while found := tokens.next(at):
            if found[0] > at:
                self.put(page[at : found[0]])
            at, token = found[1], page[found[0] : found[1]]
            name = NAME.match(token)
            if not name:
                continue
            tag = name.group(1).lower()
            if token[1] == "/":
                self.end_tag(tag)
                continue
            attributes = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(token[name.end() :])}
            if tag in RAW_TAGS:
                ended = re.compile(rf"</{tag}\b[^>]*>|\Z", re.IGNORECASE).search(page, at)
                at = ended.end() if ended else len(page)
            elif tag in BLOCK_TAGS:
                self.start_block(tag, attributes)
            elif tag == "br":
                self.put(" ")
            elif tag not in VOID_TAGS and not token.endswith("/>"):
                self.start_inline(tag, attributes)
        if at < len(page):
            self.put(page[at:])
        self.close(1)
        self.end_block()
        return self.page


def path_ratios(blocks: list[Block]) -> dict[int, float]:
    """The fused ratio of each path of blocks, from 0 to 1.

    Text length and punctuation are added up over all blocks of a path. Both per block, squashed to below 1, make
    the path's own ratio as a product, times the share that is not link text (squared), times NAMED if a word names it as
    surroundings. Paths are smoothed in the order in which they first occur, by a bell over two neighbours on each side, so
    that a heading's or a list's path takes part in that of the paragraphs beside it. Own and smoothed ratio are
    fused as their mean, times the same factors.
    """
    totals: dict[int, list[float]] = {}
    for b in blocks:
        t = totals.setdefault(b.path, [0, 0, 0, 0, 1.0])
        t[0], t[1], t[2], t[3] = t[0] + len(b.text), t[1] + len(PUNCTUATION.findall(b.text)), t[2] + 1, t[3] + b.links
        if b.named:
            t[4] = NAMED
    factors = [max(0.0, 1 - links / chars) ** 2 * named for chars, _, _, links, named in totals.values()]
    own = []
    for (chars, marks, n, _, _), factor in zip(totals.values(), factors, strict=True):
        own.append(chars / (chars + HALF_CHARS * n) * (marks + 0.2 * n) / (marks + HALF_MARKS * n) * factor)
    bell = [math.exp(-0.5 * k * k) for k in range(3)]
    fused = []
    for k, factor in enumerate(factors):
        near = [(bell[abs(j - k)], own[j]) for j in range(max(0, k - 2), min(len(own), k + 3))]
        smooth = sum(w * r for w, r in near) / sum(w for w, _ in near)
        fused.append((own[k] + smooth * factor) / 2)
    return dict(zip(totals, fused, strict=True))


def container(page: Page, weights: list[float]) -> int:
    """The element that holds the article, from the weight of each block: from the root down, as long as one container
    within holds HELD of the weight in two blocks or more; an article or main element is not left."""
    size = len(page.parents)
    weight, count = [0.0] * size, [0] * size
    for b, w in zip(page.blocks, weights, strict=True):
        weight[b.node] += w
        count[b.node] += 1
    children: list[list[int]] = [[] for _ in range(size)]
    for k in range(size - 1, 0, -1):  # a child has a larger number than its parent
        weight[page.parents[k]] += weight[k]
        count[page.parents[k]] += count[k]
        children[page.parents[k]].append(k)
    at = 0
    while page.tags[at] not in ARTICLES:
        down = [k for k in children[at] if page.tags[k] in CONTAINERS and weight[k] >= HELD * weight[at] > 0 and (count[k] > 1 or page.tags[k] in ARTICLES)]
        if not down:
            break
        at = down[0]
    return at


def _speaks(block: Block) -> bool:
    """Whether nothing of the block's own says that it surrounds an article."""
    return not block.named and 2 * block.links <= len("".join(block.text.split()))


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by two line feeds.

    Hidden blocks and elements that are no content by their kind or role are not read. Of the rest, the fused ratios of tag paths
    decide twice: blocks of content paths, by their length, locate the element that holds the article; and of the blocks in
    it, those whose path, by its ratio among the paths in it, reaches SHARE of the best one stay. So menus and link lists
    go, inside an article too. In a container that is no article element, what comes before the first
    and after the last block with a content ratio of its own goes too, but for headings before it.

    A path's ratio speaks for many blocks, and titles, bylines and short blocks have a low one. So blocks
    beside those that stay are put back unless something of their own speaks against them: a name of surroundings,
    or text that is mostly links. In an article element that holds of all its blocks, elsewhere of those between the
    first and the last that stay. In an article element with other text than headings, blocks named as surroundings go.
    """
    read = Reader().read(page or "")
    blocks = read.blocks
    if not blocks:
        return ""
    ratios = path_ratios(blocks)
    best = SHARE * max(ratios.values())
    at = container(read, [len(b.text) * ratios[b.path] if ratios[b.path] >= best else 0.0 for b in blocks])
    inside = [False] * len(read.parents)
    for k, parent in enumerate(read.parents):
        inside[k] = k == at or k > 0 and inside[parent]
    within = [k for k, b in enumerate(blocks) if inside[b.node]]
    ratios = path_ratios([blocks[k] for k in within])
    best = SHARE * max(ratios.values())
    chosen = [k for k in within if ratios[blocks[k].path] >= best]
    if read.tags[at] not in ARTICLES:
        own = {b.path: path_ratios([blocks[k] for k in within if blocks[k].path == b.path])[b.path] for b in {blocks[k].path: blocks[k] for k in chosen}.values()}
        strong = [k for k in chosen if own[blocks[k].path] >= 2 * best]
        first, last = (min(strong), max(strong)) if strong else (0, len(blocks))
        chosen = [k for k in chosen if first <= k <= last or blocks[k].tag in HEADINGS and k < first]
        before = first - 1
        while before >= 0 and blocks[before].tag in HEADINGS and not blocks[before].named and before not in chosen:
            chosen.insert(0, before)
            before -= 1
        span = range(chosen[0], chosen[-1] + 1) if chosen else range(0)
    else:
        span = range(len(blocks))
        if any(_speaks(blocks[k]) and blocks[k].tag not in HEADINGS for k in within):
            chosen = [k for k in chosen if not blocks[k].named]
    back = {k for k in within if k in span and _speaks(blocks[k])}
    chosen = sorted(back.union(chosen))
    return "\n\n".join(blocks[k].text for k in chosen)


def extracted(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep and text for each row of pages. Works row by row, on whole pages, without a shuffle.

    Null or empty html: empty text. Markup that never ends is read up to the end of the page. Null or repeated
    keys: each row has its result. Empty table: empty result. Other columns are ignored.
    """
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, "text"])

    return rows.mapInArrow(run, rows.drop("_html").schema.add("text", "string"))
