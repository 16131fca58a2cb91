"""Main-text extraction from HTML by tree scoring.

Every paragraph-like block passes points for its length and its commas to the elements above
it: all to the parent, half to the grandparent, then a third, and so on. An element's score is
discounted by the share of its text that lies in links. The best container is the article, or,
if it is no article element, a part of it: elements with prose beside it and beside the elements
around it are kept with what lies between them. The scheme of points is that which Arc90's
Readability (Apache License 2.0) made known; words, numbers and rules here are our own.

Elements nest at most DEPTH deep, as in browsers: what would lie deeper lies beside. So time is
in proportion to a page's length, however it nests.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_texts, small_batches

# Fixed values of HTML: elements without content, raw text, and blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
DECODED_RAW = frozenset(("title", "textarea"))
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center dd details div figure html li main ol section table tbody td tr ul".split())
# Elements whose text is never the article's.
DROPPED = frozenset(
    "nav header footer aside form menu button select option input label fieldset dialog head script style "
    "noscript template textarea title iframe object embed applet canvas svg math xmp noembed noframes "
    "audio video map search".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
    "tablist note".split()
)
# Words of a class or id that mark what is not the article, by kind; plurals follow by rule.
KINDS = {
    "menu": "breadcrumb menu nav navbar navi navigation pager pagination skip toolbar topbar",
    "header or footer": "copyright foot footer header masthead",
    "sidebar": "aside recommended related sidebar sidenav tag teaser widget",
    "notice": "alert banner consent cookie cookiebanner cookiebar disclaimer gdpr modal notice notification paywall popup",
    "advert": "ad adbox adsense adslot adv advert advertisement advertising promo promoted promotion sponsor sponsored",
    "form": "feedback form newsletter subscribe subscription",
    "sharing": "community rss share sharing social",
    "comment": "comment commentlist discussion disqus reaction reply respond response",
}


def _plural(word: str) -> str:
    return word[:-1] + "ies" if word.endswith("y") else word + "s"


def _with_plurals(words: str) -> frozenset:
    return frozenset(x for w in words.split() for x in (w, _plural(w)))


UNLIKELY = _with_plurals(" ".join(KINDS.values()))
# A name with one of these tells a state of the element, such as "has-sidebar", not its kind.
STATES = frozenset("has have with without no not is enabled disabled on off open closed".split())
COMMENTS = _with_plurals(KINDS["comment"])
LIKELY = frozenset("article body content entry main post story text".split())
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
LISTS = frozenset("ul ol dl dir".split())
PROSE = frozenset("p div section blockquote pre".split())
DEPTH = 256
# Points that an element starts with, by its tag; and for a name of LIKELY.
START = {"article": 40.0, "main": 20.0, "div": 4.0, "section": 4.0, "blockquote": 2.0, "td": 2.0, "ol": -4.0, "ul": -4.0, "li": -4.0, "dd": -4.0}
NAMED = 20
NO_NEST_IN_P = BLOCK - frozenset(("html", "body"))
ENDS = {  # an open element on the left is ended by a start tag on the right
    "p": NO_NEST_IN_P,
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
    **{f"h{i}": frozenset(f"h{j}" for j in range(1, 7)) for i in range(1, 7)},
}
SCOPES = frozenset("table td th ul ol dl div section article main body html blockquote".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "block", "likely", "dropped", "unlikely", "holds", "link", "score", "chars", "linked", "scored")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, likely: int, unlikely: frozenset = frozenset()):
        self.tag, self.parent, self.likely, self.unlikely = tag, parent, likely, unlikely
        self.dropped = dropped or (parent is not None and parent.dropped)
        self.block = self if tag in BLOCK or parent is None else parent.block  # that text here belongs to
        self.link = tag == "a" or (parent is not None and parent.link)
        self.score, self.scored, self.chars, self.linked, self.holds = 0.0, False, 0, 0, False


def _above(x: Node | None):
    while x is not None:
        yield x
        x = x.parent


def _marks(tag: str, attributes: str) -> tuple[bool, int, frozenset]:
    """Whether an element is ruled out, a bonus for a name such as "content", and the words of
    its names that make a block unlikely to be the article's."""
    dropped, likely, unlikely = tag in DROPPED, 0, frozenset()
    seen, plain = set(), False
    for m in _MARK.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in seen:  # the first of several counts
            continue
        seen.add(name)
        if name in ("class", "id"):
            for token in value.split():
                words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                if not words & STATES:
                    unlikely |= words & UNLIKELY
                likely = max(likely, NAMED * bool(words & LIKELY))
                plain |= token.lower() in LIKELY
        elif name == "role":
            dropped |= value.strip().lower() in DROPPED_ROLES
        elif name == "style":
            dropped |= bool(_HIDDEN.search(value))
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            dropped = True
    if plain or tag in ("html", "body", "article", "main"):
        unlikely = frozenset()
    # text of inline elements is part of a block's
    return dropped or bool(unlikely) and tag not in BLOCK, likely, unlikely


def _without_unlikely(blocks: list[tuple[Node, str, int]], nodes: list[Node]) -> list[tuple[Node, str, int]]:
    """The blocks outside unlikely elements. An unlikely name does not count where the element
    holds the first article or main element, or most of the prose of that element or, if there
    is none elsewhere, of the page. Comments may well hold most: inside or beside an article
    their names count."""
    if not any(x.unlikely for x in nodes):
        return blocks
    marks = [x for x in nodes if x.tag in ("article", "main")]
    first = [next((x for x in marks if x.tag == tag), None) for tag in ("article", "main")]
    for x in first:
        for y in _above(x):
            y.holds = True
    prose: dict[int, int] = {}
    inside: dict[int, int] = {}
    for node, text, linked in blocks:
        for x in _above(node):
            prose[id(x)] = prose.get(id(x), 0) + len(text) - linked
    for mark in marks:
        for x in _above(mark):
            inside[id(x)] = inside.get(id(x), 0) + 1
    total = sum(len(text) - linked for _, text, linked in blocks)
    verdicts: dict[int, bool] = {}

    def out(x: Node) -> bool:
        if id(x) not in verdicts:
            others = inside.get(id(x), 0) < len(marks)
            around = next((y for y in _above(x.parent) if y in first), None)
            own = prose.get(id(x), 0)
            if x.holds:
                keep = not (others and x.unlikely & COMMENTS)
            elif around is not None:
                keep = not x.unlikely & COMMENTS and 2 * own > prose.get(id(around), 0)
            else:
                keep = not others and 2 * own > total
            verdicts[id(x)] = not keep
        return verdicts[id(x)]

    return [b for b in blocks if not any(x.unlikely and out(x) for x in _above(b[0]))]


def _blocks(source: str) -> list[tuple[Node, str, int]]:
    """The blocks in page order: the element that holds each, its text, characters in links."""
    root = Node("#root", None, False, 0)
    stack, blocks, nodes = [root], [], []
    parts: list[str] = []
    linked, owner = 0, root

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and not owner.dropped:
                blocks.append((owner, text, linked))
        parts.clear()
        linked = 0

    def write(text: str):
        nonlocal owner, linked
        if not text:
            return
        if not parts:
            owner = stack[-1].block
        if stack[-1].dropped and not owner.dropped:  # an inline element that is ruled out
            parts.append(" ")
            return
        parts.append(text)
        if stack[-1].link:
            linked += len(text.strip())

    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            write(html.unescape(source[at:]))
            break
        if lt > at:
            write(html.unescape(source[at:lt]))
        m = _TOKEN.match(source, lt)
        if m is None:
            write("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                write(" ")
                continue
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    # an inline end tag does not close blocks around it
                    if tag in BLOCK or not any(x.tag in BLOCK for x in stack[i + 1 :]):
                        del stack[i:]
                    elif tag not in BLOCK:
                        del stack[i]
                    break
                if tag not in BLOCK and stack[i].tag in SCOPES:
                    break
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                write(" ")
                continue
            if tag in BLOCK:
                flush()
            # close what this start tag ends, within the nearest scope
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if tag in ENDS.get(open_tag, ()):
                    del stack[i:]
                    break
                if open_tag in SCOPES:
                    break
            if tag in VOID:
                continue
            del stack[DEPTH:]
            node = Node(tag, stack[-1], *_marks(tag, m[3] or ""))
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                end = close.start() if close else n
                if not node.dropped and tag in DECODED_RAW:
                    write(html.unescape(source[at:end]))
                gt = source.find(">", end)
                at = n if not close or gt < 0 else gt + 1
                continue
            stack.append(node)
            if not node.dropped:
                nodes.append(node)
    flush()
    return _without_unlikely(blocks, nodes)


def _share(x: Node) -> float:
    return x.linked / x.chars if x.chars else 0.0


def _scored(blocks: list[tuple[Node, str, int]]) -> list[tuple[Node, float]]:
    """The containers that blocks of prose lie in, each with its score."""
    scored: list[Node] = []
    for node, text, linked in blocks:
        if _boilerplate((node, text, linked)):
            continue
        for x in _above(node):
            x.chars += len(text)
            x.linked += linked
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        holder = node if node.tag in CONTAINER or node.parent is None else node.parent
        depth = 1
        while holder is not None:
            if holder.tag in CONTAINER or holder.parent is None:
                if not holder.scored:
                    holder.scored, holder.score = True, START.get(holder.tag, 0.0) + holder.likely
                    scored.append(holder)
                holder.score += points / depth
                depth += 1
            holder = holder.parent
    return [(x, x.score * (1 - _share(x))) for x in scored]


def main_text(source: str) -> str:
    """The article's blocks, one a line; empty if there is none."""
    blocks = _blocks(source)
    rated = _scored(blocks)
    if not rated:
        return ""
    scored = [x for x, _ in rated]
    final = {id(x): score for x, score in rated}
    best = max(scored, key=lambda x: final[id(x)])
    top = final[id(best)]
    kept = {id(best)}
    if best.tag in ("article", "main"):
        # siblings that are part of the same text
        kept |= {id(x) for x in scored if x.parent is best.parent and final[id(x)] >= 0.2 * top}
    whole = [any(id(x) in kept for x in _above(node)) for node, _, _ in blocks]
    chain = list(_above(best))
    places = {id(x): k for k, x in enumerate(chain)}
    branches = [_branch(b, places) for b in blocks]
    for k, level in enumerate(chain[:-1]):
        if level.tag in ("html", "body", "article", "main"):
            break
        _beside(k, level, blocks, branches, whole)
    if best.tag in ("article", "main"):
        for i, (node, text, linked) in enumerate(blocks):
            whole[i] |= node.parent is best.parent and node.tag in PROSE and _prose(text, linked)
    page = best.tag in ("html", "body", "#root")
    out = []
    for b, (k, _), own in zip(blocks, branches, whole, strict=True):
        # a list of links is the article's only inside it
        if own and not (_boilerplate(b) and (page or k) and any(x.tag in LISTS for x in _above(b[0]))):
            out.append(b[1])
    return "\n".join(out)


def _branch(block: tuple[Node, str, int], places: dict[int, int]) -> tuple[int, object]:
    """The place in the chain above the best container where a block joins it, and the child
    there that holds the block, or the block itself."""
    child: object = block
    for x in _above(block[0]):
        if id(x) in places:
            return places[id(x)], child
        child = x
    raise AssertionError("a block outside the tree")


def _prose(text: str, linked: int) -> bool:
    return len(text) > 80 and linked < 0.25 * len(text) or bool(re.search(r"[.!?]\W*$", text)) and not linked


def _beside(k: int, level: Node, blocks: list, branches: list[tuple[int, object]], whole: list[bool]) -> None:
    """Marks what lies beside an element that holds the article or a part of it: siblings with
    prose, however short, and all between the first and the last of them but link lists."""
    at = [level if j <= k else child if j == k + 1 else None for j, child in branches]
    parts = {id(level)}
    for (node, text, linked), x in zip(blocks, at, strict=True):
        if x is not None and (node.tag in PROSE and _prose(text, linked) or len(text) > 80 and linked < 0.25 * len(text)):
            parts.add(id(x))
    ends = [i for i, x in enumerate(at) if x is not None and id(x) in parts]
    if not ends:
        return
    first, last = ends[0], ends[-1]
    while first and at[first - 1] is not None and blocks[first - 1][0].tag in HEADINGS:  # the first part's own
        first -= 1
    for i in range(first, last + 1):
        whole[i] |= at[i] is not None and (id(at[i]) in parts or not _boilerplate(blocks[i]))


def _boilerplate(block: tuple[Node, str, int]) -> bool:
    """A block that is mostly links, such as a list of them."""
    node, text, linked = block
    return linked > 0.6 * len(text) and node.tag not in ("h1", "h2", "h3")


def _extract(key: str, url: str, source: str):
    def run(batches):
        for batch in small_batches(batches, source):
            texts = [
                main_text(x.decode("utf-8", "replace")) if x else ""
                for x in binary_texts(batch, source)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column(url), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    text is the article's blocks in page order, joined by line feeds, white space inside a
    block made one space, character references decoded; empty where there is no main text,
    and for null or empty html. Of containers with the same score the first one found counts.
    Pages may be of any length. Repeated rows stay repeated, null keys and urls are kept,
    other columns are not read, and an empty table gives an empty result.
    """
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds[key]}, url {kinds[url]}, text string, n_chars long"
    return pages.select(key, url, source).mapInArrow(_extract(key, url, source), schema)
