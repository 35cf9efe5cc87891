"""HTML extraction by minimum-cut labelling: a classifier's costs are the capacities from a block to the terminals,
adjacent blocks are joined by smoothness edges that weaken with their distance in the DOM, blocks of one article hang
on that article's own node, and the minimum cut of this graph parts content from boilerplate."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm import common as C

#: Smoothness between neighbours in page order, between a block and the one before it in its container, and between a
#: block and the node of its article.
ADJACENT, SIBLING, MEMBER = 1.0, 0.5, 2.5
#: How much weaker an edge is across the border of a region.
ACROSS = 0.3
#: What speaks for the node of an article, and of a container that is named like one; as much again for every BLOCKS blocks in it.
ARTICLE, NAMED, BLOCKS = 3.0, 1.0, 3
#: What speaks against all that lies in a region: by its tag or a telling name, by a weaker name, by one on a text's own element.
REGION, WEAK, WEAK_TEXT, HIDDEN = 5.0, 3.0, 1.5, 8.0
#: What links speak against a block that is nothing else, in an article and elsewhere.
LINKS_OF_ARTICLE, LINKS = 1.0, 4.0
#: Characters of a block that speak neither way, and how far a block's length counts.
NEUTRAL, SHORTEST, LONGEST = 40.0, -2.0, 2.5

# fixed values: what HTML calls elements of text alone, blocks, and elements without content
_RAW = frozenset("script style noscript noframes noembed template svg iframe textarea select title annotation annotation-xml".split())
_CONTROLS = frozenset("button datalist".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTS = _HEADINGS | frozenset("p pre blockquote li dd dt td th figcaption caption span b i em strong a".split())
_REGIONS = frozenset("nav footer aside form head button dialog menu search".split())
# fixed values: words of classes, ids and roles
_TELLING = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors sidebar nav navbar navigation menu footer cookie cookies consent gdpr comment comments disqus breadcrumb breadcrumbs pagination newsletter popup modal overlay complementary contentinfo dialog search form".split())
_WEAKER = frozenset("related notice header masthead widget reply replies respond share sharing social recommended recommendations recommend promo banner toolbar subscribe signup login alert skip copyright pager".split())
_GOOD = frozenset("article content post entry story main body text".split())

#: Words and tags of what readers or others add to a page; only an article in it makes a layout of it.
_ADDED = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors footer cookie cookies consent gdpr comment comments disqus reply replies respond newsletter popup copyright contentinfo".split())
_ADDED_TAGS = frozenset("nav footer aside dialog menu".split())
#: Share of the page's unlinked text that makes a region of it a layout.
LAYOUT = 0.6

_NAME = re.compile(r"[a-zA-Z][\w:-]*")
# an attribute's value begins after =; it ends at its quote, or else at white space or >
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?")
_REST_OF_TAG = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?)*+>")
_END_OF_COMMENT = re.compile(r"--!?>")
_WORD = re.compile(r"[a-z0-9]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in _RAW | _CONTROLS}


@dataclass(slots=True)
class Node:
    tag: str
    #: How many elements lie above, and its parent's place.
    depth: int
    up: int
    #: What its tag, class, id and role speak against it, and for it, if it is an article or named like one.
    against_own: float = 0.0
    own: float = 0.0
    #: Whether it can be a layout without an article in it.
    wraps: bool = True
    #: What speaks against all that lies in it, and the article or named container it lies in.
    against: float = 0.0
    member: int = 0


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    node: int
    linked: int
    #: The innermost element it ends in.
    top: int
    against: float = 0.0
    member: int = 0
    #: Whether it lies in an article, by its tag.
    article: bool = False


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """("", text, False) for text and (tag, attributes, closing) for a tag; comments, declarations and elements
    of raw text are left out, as are form controls that end. Each character is looked at a fixed number of times, however
    broken the markup: a quote that never ends is a character; what begins like a tag but never ends is left out."""
    at, n, endless = 0, len(page), set()
    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = n
        if open_ > at:
            yield "", page[at:open_], False
        if open_ + 1 >= n:
            if open_ < n:
                yield "", "<", False
            return
        c = page[open_ + 1]
        if page.startswith("<!--", open_):
            if page.startswith((">", "->"), open_ + 4):
                at = page.find(">", open_) + 1
            else:
                end = _END_OF_COMMENT.search(page, open_ + 4)
                at = end.end() if end else n
            continue
        closing = c == "/"
        name = _NAME.match(page, open_ + 1 + closing)
        if not name:
            if c in "!?/":
                end = page.find(">", open_)
                at = end + 1 if end >= 0 else n
            else:
                yield "", "<", False
                at = open_ + 1
            continue
        rest = _REST_OF_TAG.match(page, name.end())
        if not rest:
            return
        tag, said = name[0].lower(), page[name.end() : rest.end() - 1]
        at = rest.end()
        if tag in _CONTROLS:
            if not closing and tag not in endless:
                close = _CLOSE[tag].search(page, at)
                if close:
                    at = close.end()
                    yield "", " ", False
                else:
                    endless.add(tag)
            continue
        if tag in _RAW:
            if not closing and not said.endswith("/"):
                close = _CLOSE[tag].search(page, at)
                at = close.end() if close else n
            continue
        yield tag, said, closing


def evidence(tag: str, said: str) -> tuple[float, float, bool]:
    """What an element's tag, class, id and role speak against and for what lies in it, and whether it may be a layout."""
    against, good, wraps = (REGION if tag in _REGIONS else WEAK if tag == "header" else 0.0), ARTICLE if tag in ("article", "main") else 0.0, tag not in _ADDED_TAGS
    if not said or tag in ("html", "body"):
        return against, good, wraps
    weak = WEAK_TEXT if tag in _TEXTS else WEAK
    for name, *values in _ATTR.findall(said):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "style" and _NOT_SHOWN.search(value):
            against, wraps = max(against, HIDDEN), False
        elif name in ("class", "id", "role"):
            words = _WORD.findall(value.lower())
            wraps = wraps and _ADDED.isdisjoint(words)
            if not _TELLING.isdisjoint(words):
                against = max(against, REGION)
            elif not _WEAKER.isdisjoint(words):
                against = max(against, weak)
            elif not _GOOD.isdisjoint(words) and tag not in _TEXTS:
                good = max(good, NAMED)
    if good == ARTICLE and against < HIDDEN and (wraps or tag == "main"):
        against = 0.0  # an article's kind says more than its name, unless the name says it is a reader's
    return against, good if against < REGION else 0.0, wraps


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The page's text blocks in order. Any block-level tag ends a block; other tags don't, and <br> is white space."""
    nodes = [Node("", 0, 0)]
    stack, out, words, linked, in_link = [0], [], [], 0, 0
    opened: Counter = Counter()  # block elements on the stack
    inline: Counter = Counter()  # other elements above the last of them
    block_at = [0]

    def flush() -> None:
        nonlocal linked
        if words:
            text = "".join(words)
            words.clear()
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, nodes[block_at[-1]].tag, block_at[-1], min(linked, len(text)), stack[-1]))
        linked = 0

    def pop() -> str:
        tag = nodes[stack.pop()].tag
        if tag in _BLOCK:
            opened[tag] -= 1
            block_at.pop()
        else:
            inline[tag] -= 1
        return tag

    for tag, said, closing in tokens(page):
        if not tag:
            words.append(said)
            if in_link:
                linked += len(said)
            continue
        if tag == "br":
            words.append(" ")
            continue
        block = tag in _BLOCK
        if block:
            flush()
        if closing:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if (opened if block else inline)[tag] > 0:
                while pop() != tag:
                    pass
            continue
        if tag in _VOID or said.endswith("/"):
            continue
        if tag == "a":
            in_link += 1
        elif block:  # an open paragraph or inline element ends where a block begins
            in_link = 0
            while len(stack) > 1 and ((top := nodes[stack[-1]].tag) == "p" or top not in _BLOCK or top == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                pop()
        against, good, wraps = evidence(tag, said)
        nodes.append(Node(tag, nodes[stack[-1]].depth + 1, stack[-1], against, good, wraps))
        stack.append(len(nodes) - 1)
        if block:
            opened[tag] += 1
            block_at.append(len(nodes) - 1)
        else:
            inline[tag] += 1
    flush()
    _settle(out, nodes)
    return out, nodes


def _settle(blocks: list[Block], nodes: list[Node]) -> None:
    """What speaks against each element and block, and the article each lies in. A region that holds most of the page's
    unlinked text is the page's layout and not a region of it, if no article lies elsewhere, and if an article lies in it
    or it isn't what readers and others add."""
    text, articles = [0] * len(nodes), [0] * len(nodes)
    for b in blocks:
        text[b.top] += len(b.text) - b.linked
    for i in range(len(nodes) - 1, 0, -1):
        good = nodes[i].own and text[i] and nodes[i].against_own < HIDDEN
        articles[i] += 1 if good else 0
        text[nodes[i].up] += text[i]
        articles[nodes[i].up] += articles[i]
    above = [0] * len(nodes)  # articles that an element lies in
    for i, node in enumerate(nodes[1:], 1):
        up = nodes[node.up]
        above[i] = above[node.up] + bool(up.own and node.up)
        against = node.against_own
        if node.tag == "header" and up.member and against == WEAK:
            against = 0.0  # an article's own header
        inside = articles[i] - bool(node.own and text[i])
        if 0 < against < HIDDEN and text[i] > LAYOUT * text[0] and articles[0] == articles[i] + above[i] and (node.wraps or inside):
            against = 0.0
        node.against, node.member = max(up.against, against), up.member
        if against >= WEAK:
            node.member = 0  # a region of its own
        elif node.own and (node.own == ARTICLE or not up.member):
            node.member = i
    for b in blocks:
        top = nodes[b.top]
        b.against, b.member, b.article = top.against, top.member, bool(top.member) and nodes[top.member].tag == "article"


def content_costs(blocks: list[Block]) -> list[float]:
    """For each block, what labelling it boilerplate costs less what labelling it content does: over 0, the classifier
    by itself holds it for content. Length, tag, punctuation, links, and what its regions speak against it."""
    out = []
    for b in blocks:
        n = len(b.text)
        u = 0.3 if b.tag in _HEADINGS else max(SHORTEST, min(LONGEST, math.log(n / NEUTRAL)))
        u += 0.7 if b.tag in ("p", "pre", "blockquote") else 0.0
        u += 0.3 if b.text[-1] in ".!?…:" else -0.3
        u -= (LINKS_OF_ARTICLE if b.article else LINKS) * b.linked / n + b.against
        if not b.member and n < 120 and ("©" in b.text or "all rights reserved" in b.text.lower()):
            u -= 3.0
        out.append(u)
    return out


def smoothness(blocks: list[Block], nodes: list[Node]) -> tuple[dict[tuple[int, int], float], list[float]]:
    """Edges between adjacent blocks, between a block and the last one of its container, and between a block and the
    node of its article; and what speaks for those nodes, which are numbered after the blocks."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    articles: dict[int, int] = {}
    held: Counter = Counter()
    for i, b in enumerate(blocks):
        if i:
            a, z, steps = blocks[i - 1].node, b.node, 0
            while a != z:
                steps += 1
                if nodes[a].depth >= nodes[z].depth:
                    a = nodes[a].up
                else:
                    z = nodes[z].up
            edges[i - 1, i] = ADJACENT * 2 / (1 + steps) * (1.0 if blocks[i - 1].against == b.against else ACROSS)
        up = nodes[b.node].up
        if (j := last.get(up)) is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING * (1.0 if blocks[j].against == b.against else ACROSS)
        last[up] = i
        if b.member:
            edges[i, len(blocks) + articles.setdefault(b.member, len(articles))] = MEMBER
            held[b.member] += 1
    return edges, [nodes[m].own * (1 + held[m] / BLOCKS) for m in articles]


def min_cut(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (true: content) of least total cost. A node whose own cost exceeds all its edges has its label in any
    minimum cut, so it is settled first and its edges go to its neighbours' terminals; what remains goes through
    maximum flow (by phases of shortest paths)."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    costs, label, open_ = list(costs), [None] * n, [sum(x.values()) for x in near]
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(costs[i]) >= open_[i] - 1e-12:
            label[i] = costs[i] > 0
            for j, w in near[i].items():
                costs[j] += w if label[i] else -w
                open_[j] -= w
                del near[j][i]
                if label[j] is None:
                    todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        reached = _source_side(rest, costs, near)
        for i in rest:
            label[i] = i in reached
    return label


def _source_side(rest: list[int], costs: list[float], near: list[dict[int, float]]) -> set[int]:
    """What the source still reaches once no more flow passes from the nodes with a cost over 0 to the others."""
    cap = {i: dict(near[i]) for i in rest}
    give = {i: costs[i] for i in rest if costs[i] > 0}
    take = {i: -costs[i] for i in rest if costs[i] < 0}
    while True:
        level = {i: 0 for i, c in give.items() if c > 1e-9}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            found = found or take.get(i, 0.0) > 1e-9
            for j, c in cap[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return set(level)
        arcs = {i: iter(list(cap[i])) for i in level}
        for s in [i for i, d in level.items() if d == 0]:
            path = [s]
            while path and give[s] > 1e-9:
                i = path[-1]
                if take.get(i, 0.0) > 1e-9:
                    flow = min(give[s], take[i], *(cap[a][b] for a, b in zip(path, path[1:], strict=False)))
                    give[s] -= flow
                    take[i] -= flow
                    for a, b in zip(path, path[1:], strict=False):
                        cap[a][b] -= flow
                        cap[b][a] += flow
                    k = next((k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if cap[a][b] <= 1e-9), None)
                    if k is not None:
                        del path[k + 1 :]
                    continue
                for j in arcs[i]:
                    if cap[i][j] > 1e-9 and level.get(j, -1) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()


def main_text(page: str, cut: Callable[[list[float], dict[tuple[int, int], float]], list[bool]] = min_cut) -> str:
    """The blocks labelled content, in page order, joined by an empty line."""
    blocks, nodes = blocks_of(page)
    if not blocks:
        return ""
    edges, articles = smoothness(blocks, nodes)
    return "\n\n".join(b.text for b, keep in zip(blocks, cut(content_costs(blocks) + articles, edges), strict=False) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages.

    Null or empty html, or one without content: empty text. Null page_id or url are passed on. Broken markup: an
    unclosed element ends where its parent does or the next of its kind begins; what is no tag is text; a tag that
    never ends is left out with all after it. Very long pages take time in proportion to their length. Repeated rows:
    the same text. An empty table gives no rows; other columns are left out.
    """

    def make() -> Callable[[list[str]], dict[str, list]]:
        def run(pages: list[str]) -> dict[str, list]:
            texts = [main_text(h) for h in pages]
            return {"text": texts, "n_chars": [len(x) for x in texts]}

        return run

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return C.map_text(pages, "html", [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, ["page_id", "url"])


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))
