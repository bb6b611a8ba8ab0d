"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A scorer gives each block a cost for being
content and one for being boilerplate: the nearest deciding ancestor (article, main or a content
class against menus, headers, footers, asides, forms and comments), and where no ancestor decides,
link density, length and sentence marks. Where no content mark decides anywhere, shortness is charged
once per run of blocks that follow each other without links or marks, so short lines, lists, tables
and listings stay with the text around them. Words of a class or id are finite evidence for boilerplate
that is weighed with these; an article or main mark on the element itself or below it outweighs
them, as it does an element that is never closed, and they count for nothing around mostly prose.
A form around the page decides nothing. The costs become capacities between the block and the two
terminals. Blocks that follow each other are joined by smoothness
edges that are stronger the nearer they are in the document tree, and so are the text neighbours of
one container. The maximum flow separates the page: blocks still reachable from the content
terminal are content.

The text of a block has its character references decoded and its white space turned into single
spaces; content blocks are joined in page order by one space. Nothing else is dropped or cut.

Pages are independent rows, so there is no shuffle; one page is worked on at a time.

Defined results: a null or empty page, or one without content, has an empty text. Broken markup is
read on: unclosed elements end with their container, stray end tags are skipped, an unclosed script
or comment runs to the end. Repeated rows and null ids give one row each. Only the named columns are
read. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template svg annotation annotation-xml iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select".split())

# What tells boilerplate and content apart, by tag, by word of class or id, and by role.
BOILER_TAGS = frozenset("nav aside footer form button select dialog menu noscript fieldset head".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted promotion recommended related replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
HEADER_WORDS = frozenset({"header", "topbar"})
# A word after one of these, or before one of the second, names a state or a topic, not a part of the page.
STATE_BEFORE = frozenset("has have with without no not is hide show category cat tag tagged topic".split())
STATE_AFTER = frozenset("open closed enabled disabled on off".split())
CONTENT_WORDS = frozenset("article entry post story".split())
CONTENT_NAMES = frozenset("article content main post entry story".split())
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CONTENT_ROLES = frozenset("article main".split())

# Tags that only the frame of a page holds; a form around one of them is the page.
FRAME_TAGS = frozenset("article main nav header footer aside h1".split())

SURE = 600
SHORT = 60
CLASS_WORDS = 200
INSIDE = 100
ADJACENT = 40
CONTAINER = 20

_MARKUP = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+[^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


@dataclass(slots=True)
class Element:
    """An element. ``state`` is 1 inside content, -1 inside boilerplate, else 0."""

    tag: str
    number: int
    link: bool
    container: int
    mark: str
    up: Element | None
    closed: bool = False
    frame: bool = False
    state: int = 0
    comments: bool = False
    lost: bool = False
    article: bool = False
    marked: int = 0
    regained: int = 0


@dataclass(slots=True)
class Block:
    """A run of text between block-level tags."""

    text: str
    state: int
    heading: bool
    linked: int
    path: tuple[int, ...]
    container: int
    marked: bool = False


def _mark(tag: str, rest: str) -> str:
    """What the tag, role, class and id of an element say about it by themselves."""
    roles: set[str] = set()
    words: set[str] = set()
    boiler = comments = one_comment = header = mixed = False
    if rest and tag not in ("html", "body"):
        for name, *values in _NAMED.findall(rest):
            for token in next(filter(None, values), "").split():
                if name.lower() == "role":
                    roles.add(token.lower())
                    continue
                parts = [w.lower() for w in _WORD.findall(token)]
                words.update(parts)
                one_comment |= parts[:1] == ["comment"]
                if parts and parts[-1] in STATE_AFTER:
                    continue
                part = {w for i, w in enumerate(parts) if not STATE_BEFORE & set(parts[:i])}
                boiler |= bool(part & BOILER_WORDS)
                comments |= bool(part & COMMENT_WORDS)
                header |= bool(part & HEADER_WORDS)
                mixed |= bool(part & CONTENT_NAMES) and not part & BOILER_WORDS
    if tag in CONTENT_TAGS or roles & CONTENT_ROLES:
        if tag == "main" or "main" in roles:
            return "main"
        return "comment article" if one_comment and not words & CONTENT_WORDS else "article"
    if tag == "form":
        return "form"
    if tag in BOILER_TAGS or roles & BOILER_ROLES:
        return "boiler"
    if comments:
        return "comments"
    if boiler:
        return "content words" if mixed else "words"
    if tag == "header" and not words & CONTENT_WORDS:
        return "header"
    if header and not words & CONTENT_WORDS:
        return "header words"
    return "content" if mixed or words & CONTENT_NAMES else ""


def _judge(e: Element, wraps: bool) -> None:
    """Sets the state inside an element from its own mark and the state around it."""
    up, mark = e.up, e.mark
    e.state, e.comments, e.lost, e.article, e.marked, e.regained = up.state, up.comments, up.lost, up.article, up.marked, up.regained
    if mark == "comment article" and up.state > 0:
        e.state, e.comments, e.lost = -1, True, False
    elif mark in ("main", "article", "comment article"):
        again = up.lost if not up.comments else mark == "main"
        if (up.state >= 0 and not (up.marked and up.article)) or (up.state < 0 and again):
            # Below other marks, an article that is mostly links is a teaser.
            e.regained = e.number if up.marked else up.regained
            e.state, e.comments, e.lost, e.marked = 1, False, False, 0
        e.article = up.article or mark != "main"
    elif mark == "comments":
        e.state, e.comments, e.lost = -1, True, False
    elif mark == "boiler" or (mark == "form" and not wraps) or (mark == "header" and up.state <= 0):
        e.lost = not e.closed and (up.lost or up.state >= 0)
        e.state = -1
    elif mark in ("words", "content words") or (mark == "header words" and up.state <= 0):
        e.marked = e.number
        e.state = 1 if mark == "content words" and up.state == 0 else up.state
    elif mark == "content" and up.state == 0:
        e.state = 1


def _settle(out: list[Block], elements: list[Element], inside: list[Element]) -> None:
    """Sets the states of the blocks, whose innermost elements are given, once all is known."""
    held, prose = Counter(), Counter()
    for b, e in zip(out, inside):
        held[e.number] += len(b.text)
        prose[e.number] += _value(b) > SHORT
    half = held.total() / 2
    for e in reversed(elements):
        held[e.up.number] += held[e.number]
        prose[e.up.number] += prose[e.number]
    for e in elements:
        _judge(e, (e.frame and not e.up.article) or (prose[e.number] > 0 and held[e.number] >= half))
    # Link-heavy articles below class words, and class words around prose, are told by their whole text.
    chars, linked, prose = Counter(), Counter(), Counter()
    for b, e in zip(out, inside):
        if e.state >= 0:
            chars[e.marked] += len(b.text)
            prose[e.marked] += len(b.text) * (_value(b) > SHORT + CLASS_WORDS)
            linked[e.regained] += min(b.linked, len(b.text)) - len(b.text) / 2
    marking = [e for e in elements if e.marked == e.number]
    for e in reversed(marking):
        chars[e.up.marked] += chars[e.number]
        prose[e.up.marked] += prose[e.number]
    hidden = {0: False}
    for e in marking:
        hidden[e.number] = hidden[e.up.marked] or 2 * prose[e.number] < chars[e.number]
    for b, e in zip(out, inside):
        b.state = e.state
        b.marked = hidden[e.marked] or (e.regained > 0 and linked[e.regained] > 0)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    inside: list[Element] = []
    elements: list[Element] = []
    stack = [Element("", 0, False, 0, "", None)]
    parts: list[str] = []
    linked = made = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            holder = next(e for e in reversed(stack) if e.tag not in INLINE)
            out.append(
                Block(text, 0, len(holder.tag) == 2 and holder.tag[0] == "h" and holder.tag[1].isdigit(), linked, tuple(e.number for e in stack), holder.container)
            )
            inside.append(stack[-1])
        parts.clear()
        linked = 0

    def close_to(depth: int) -> None:
        """Drops the open elements from ``depth`` on."""
        flush()
        del stack[depth:]

    def end(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                close_to(depth)
                return
            if stack[depth].tag in stop:
                return

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if stack[-1].link:
                linked += len(text.strip())

    at = 0
    while match := _MARKUP.search(page, at):
        say(page[at : match.start()])
        at = match.end()
        tag = match["name"]
        if tag is None:
            continue
        tag = tag.lower()
        if match["end"]:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d].tag == tag), 0)
            if not depth:
                continue
            stack[depth].closed = True
            if tag in INLINE and all(e.tag in INLINE for e in stack[depth:]) and not stack[depth].mark:
                del stack[depth:]
            elif tag not in INLINE or all(e.tag in INLINE for e in stack[depth:]):
                close_to(depth)
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            continue
        if tag in VOID:
            parts.append(" " if tag == "br" else "")
            if tag == "hr":
                flush()
            continue
        if tag in ENDS_PARAGRAPH:
            end({"p"}, SCOPES | {"article", "section", "div", "td"})
        if tag in SAME_KIND:
            end(SAME_KIND[tag], SCOPES)
        if tag == "body":
            end({"head"}, frozenset())
        if tag in CONTENT_TAGS:
            # An article inside a menu or page header means that the menu was never closed.
            end({"nav", "header"}, frozenset({"aside", "footer"}))
        if tag in ("mtd", "mspace"):
            parts.append(" ")
        if tag in FRAME_TAGS:
            for e in stack:
                e.frame |= e.mark == "form"
        above = stack[-1]
        mark = _mark(tag, match["rest"])
        if tag not in INLINE or mark:
            flush()
        made += 1
        container = above.container if tag in INLINE else above.number
        stack.append(Element(tag, made, above.link or tag == "a", container, mark, above))
        elements.append(stack[-1])
    say(page[at:])
    flush()
    _settle(out, elements, inside)
    return out


def _value(block: Block) -> float:
    """Length and sentences of a block against its links."""
    links = min(1.0, block.linked / len(block.text))
    sentences = len(_SENTENCE.findall(block.text))
    return min(len(block.text), 400) * 0.5 + 40 * min(sentences, 4) - 300 * links


def score(block: Block) -> int:
    """Cost of calling the block boilerplate minus the cost of calling it content."""
    if block.state < 0 or (block.state and not block.marked):
        return SURE * block.state
    value = _value(block) - SHORT
    value = value * 0.3 if block.heading else value
    return int(value - (CLASS_WORDS - INSIDE * block.state) * block.marked)


def scores(page: list[Block]) -> list[int]:
    """The score of each block; unmarked pages charge shortness per run of unlinked blocks.

    The charge is dealt by worth, so that all blocks of a run fall on one side.
    """
    out = [score(b) for b in page]
    if any(b.state > 0 for b in page):
        return out

    def open_(i: int) -> bool:
        return not page[i].state and not page[i].marked and 2 * page[i].linked < len(page[i].text)

    for run_open, run in groupby(range(len(page)), open_):
        if run_open:
            held = list(run)
            worth = [(_value(page[i]) + 300 * page[i].linked / len(page[i].text)) * (0.3 if page[i].heading else 1) for i in held]
            share = 1 - SHORT / sum(worth)
            for i, w in zip(held, worth):
                charged = w * share - 300 * page[i].linked / len(page[i].text)
                out[i] = max(1, int(charged)) if charged > 0 else int(charged)
    return out


def smoothness(page: list[Block]) -> list[tuple[int, int, int]]:
    """Edges (block, block, weight) between blocks that should rather go together."""
    edges = []
    last_in: dict[int, int] = {}
    for i, block in enumerate(page):
        if i:
            other = page[i - 1].path
            common = 0
            for a, b in zip(block.path, other):
                if a != b:
                    break
                common += 1
            apart = len(block.path) + len(other) - 2 * common
            edges.append((i - 1, i, max(1, ADJACENT // max(1, apart))))
        before = last_in.get(block.container)
        if before is not None and before != i - 1:
            edges.append((before, i, CONTAINER))
        last_in[block.container] = i
    return edges


def content_side(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which blocks the minimum cut leaves with the content terminal.

    Each block keeps the terminal that its score favours. Flow goes from blocks with supply through
    the smoothness edges to blocks with demand, on shortest paths. A search that finds no demand has
    walked a region that no later path can leave, so the region is settled as content.
    """
    left = list(scores)
    room: list[dict[int, int]] = [{} for _ in scores]
    for a, b, weight in edges:
        room[a][b] = room[a].get(b, 0) + weight
        room[b][a] = room[b].get(a, 0) + weight
    settled = [False] * len(scores)
    for start, supply in enumerate(scores):
        while supply > 0 and left[start] > 0 and not settled[start]:
            came = {start: start}
            waiting, found = deque([start]), -1
            while waiting and found < 0:
                x = waiting.popleft()
                for y, free in room[x].items():
                    if free > 0 and y not in came and not settled[y]:
                        came[y] = x
                        if left[y] < 0:
                            found = y
                            break
                        waiting.append(y)
            if found < 0:
                for x in came:
                    settled[x] = True
                break
            path, x = [], found
            while x != start:
                path.append((came[x], x))
                x = came[x]
            flow = min(left[start], -left[found], *(room[a][b] for a, b in path))
            for a, b in path:
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0) + flow
            left[start] -= flow
            left[found] += flow
    return settled


def main_text(page: str | None) -> str:
    """The content of a page as one line."""
    found = blocks(page or "")
    kept = content_side(scores(found), smoothness(found))
    return " ".join(b.text for b, keep in zip(found, kept) if keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    types = dict(read.dtypes)
    return read.mapInArrow(extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint")
