"""HTML extraction by minimum cut.

A page is cut into blocks: the text between the borders of block elements. A fixed linear classifier gives each block a score from its ancestors (elements, classes, ids, roles), its words, its punctuation and the share of
its text in links; the costs of either label are minus the logarithms of its probabilities, and are the capacities to the terminals. Smoothness edges join neighbours in the page, stronger the nearer they are in
the document tree, and blocks next to each other under one parent. A maximum flow separates content from boilerplate with the least sum of cut capacities.

Before the flow, blocks whose own preference outweighs all their edges take their label, and their edges become costs of their neighbours, over and over; this is exact and leaves few blocks or none.

Null, empty and markup-free html: the empty text, or the text as one block. Very deep or broken markup is read as far as it goes, in time and memory in proportion to the page: unknown end tags are ignored,
open elements end with their parents, and a tag without an end is text. Other columns of any name are ignored.
Repeated rows give a row each; ties are content. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import slices, table, texts

#: A quote begins a value only behind an equals sign. Parts are possessive, so a tag is read once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]*+))*+)>""")
#: How many tags of a page may run to its end before quotes are no longer read.
MOST_OPEN = 64
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea title head select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset({"p", *HEADING})
#: Elements that end an open one of the same group, up to the nearest of the second set.
SIBLINGS = {"option": ({"option"}, {"select", "datalist", "optgroup"}), "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BAD_ELEMENTS = {"nav": 10.0, "footer": 10.0, "aside": 10.0, "form": 10.0, "menu": 10.0, "dialog": 10.0, "button": 10.0, "header": 5.0, "fieldset": 10.0, "object": 20.0, "audio": 20.0, "video": 20.0, "canvas": 20.0, "option": 20.0, "optgroup": 20.0, "figcaption": 0.5, "address": 1.5}
GOOD_ELEMENTS = {"article": 4.0, "main": 3.0}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|nav\w*|menu\w*|breadcrumbs?|foot\w*|masthead|head(?:er)?|site-?header|topbar|toolbar|cookie\w*|consent|gdpr|notice\w*|alert\w*|modal|popup|overlay|newsletter|subscri\w+"
    r"|sign-?up|log-?in|search\w*|form|share|sharing|social\w*|related|recommend\w*|more-?links|comment\w*|disqus|respon[sd]\w*|reply|replies|discussion|feedback|widget\w*|pag(?:er|ination)|tags?|tag-?cloud|copyright|legal|disclaimer|skip\w*|hidden|sr-only|visually-?hidden|meta-?bar|outbrain|taboola)(?=$|[\s_-])",
    re.IGNORECASE,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|body|text|prose|page-?body|post-?body)(?=$|[\s_-])", re.IGNORECASE)
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: The classifier: fixed weights of a block's score in favour of content.
BIAS, BAD_CLASS, GOOD_CLASS, OUTSIDE, PARAGRAPH, TITLE, SENTENCE, LINKS, PER_WORD, MOST_WORDS = -0.6, 10.0, 2.0, 2.5, 1.0, 1.0, 0.8, 5.0, 0.08, 2.4
#: Links count less in what an article lists.
LINKS_INSIDE, LISTED = 2.0, frozenset("li td dd dt".split())
#: Capacities of the smoothness edges: neighbours under one parent, and at each further step in the tree less.
SMOOTH, FADE, KIN = 1.0, 0.5, 0.5
SCALE = 1000


class Block:
    __slots__ = ("node", "pieces", "linked", "score", "inside", "kind")

    def __init__(self, node: int, score: float, inside: bool, kind: str) -> None:
        self.node, self.score, self.inside, self.kind = node, score, inside, kind
        self.pieces: list[str] = []
        self.linked = 0


class Tree:
    """The elements of a page that aren't inline, by number: what each lies in, and how deep. 0 is the page."""

    def __init__(self) -> None:
        self.above, self.depth = [-1], [0]

    def add(self, above: int) -> int:
        self.above.append(above)
        self.depth.append(self.depth[above] + 1)
        return len(self.above) - 1

    def apart(self, a: int, b: int) -> int:
        """How many borders of elements lie between, without the nearest two. In the order of a page all these walks together are as long as the page."""
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.above[a]
            else:
                b = self.above[b]
            steps += 1
        return max(0, steps - 2)


def pieces(page: str) -> Iterator[tuple[int, str, str, str]]:
    """(end, text, "", "") of texts, and (end, what closes it or "", name, attributes) of tags; comments and declarations are left out. send(place) goes on from there."""
    at, n, last, broken = 0, len(page), page.rfind(">"), 0
    while at < n:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            told = yield (n if end < 0 else end + 3), page[at + 9 : n if end < 0 else end], "", ""
            end = n if end < 0 else end + 3
        elif page[at] != "<" or at > last:
            end = n if at > last else page.find("<", at)
            end = n if end < 0 else end
            told = yield end, page[at:end], "", ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            at = page.find(">", at) + 1
            continue
        elif m := (_TAG if broken < MOST_OPEN else _BARE).match(page, at):
            end = m.end()
            told = yield end, m[1], m[2].lower(), m[3]
        else:
            broken += page[at + 1 : at + 2].isalpha()
            end = at + 1
            told = yield end, "<", "", ""
        at = end if told is None else told


def _hint(tag: str, attributes: str) -> tuple[float, bool]:
    """What an element says of the text in it, and whether it marks the article."""
    score, good = -BAD_ELEMENTS.get(tag, 0.0), tag in GOOD_ELEMENTS
    score += GOOD_ELEMENTS.get(tag, 0.0)
    if attributes and not attributes.isspace():
        names = ""
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                names += " " + value
            elif name == "role":
                good |= value in ("main", "article")
                score -= BAD_CLASS * (value.lower() in _BAD_ROLES)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                score -= 2 * BAD_CLASS
        if names and tag not in ("body", "html"):
            if _BAD.search(names):
                score -= BAD_CLASS
            elif _GOOD.search(names):
                score += GOOD_CLASS
    return score, good


def blocks(page: str, tree: Tree | None = None) -> list[Block]:
    """The blocks of a page in its order, each with text."""
    tree, out = tree or Tree(), []
    # Open elements: name, node, kind of the node, sum of hints, inside an article, in a link; how often each name is open; raw elements without an end.
    stack: list[tuple[str, int, str, float, bool, bool]] = [("", 0, "", 0.0, False, False)]
    names: Counter[str] = Counter()
    endless: set[str] = set()
    now: Block | None = None

    def cut() -> None:
        nonlocal now
        if now and any(not x.isspace() for x in now.pieces):
            out.append(now)
        now = None

    def close(at: int) -> None:
        names.subtract(x[0] for x in stack[at:])
        del stack[at:]

    def close_nearest(same: frozenset[str] | set[str], stops) -> None:
        if any(names[x] for x in same):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    return close(i)
                if stops(stack[i][0]):
                    return None
        return None

    source = pieces(page)
    step = next(source, None)
    while step:
        at, mark, tag, attributes = step
        go = None
        if not tag:
            if now is None:
                _, node, kind, score, inside, _ = stack[-1]
                now = Block(node, score, inside, kind)
            now.pieces.append(mark)
            if stack[-1][5]:
                now.linked += len(mark)
        elif mark:
            if tag not in INLINE:
                cut()
            close_nearest({tag}, lambda x, tag=tag: tag in INLINE and x not in INLINE)
        elif tag in RAW and not attributes.endswith("/"):
            if tag not in ("svg", "math", "select"):
                cut()
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            if end:
                go = end.end()
            else:
                endless.add(tag)
                if tag in ("script", "style", "template", "iframe", "noscript", "textarea", "title", "select"):
                    go = len(page)
        elif tag == "br":
            if now:
                now.pieces.append(" ")
        else:
            if tag not in INLINE:
                cut()
                if any(x[0] in CLOSED_BY_BLOCK for x in stack[-8:]):
                    close_nearest(CLOSED_BY_BLOCK, lambda x: x not in INLINE)
                if tag in SIBLINGS:
                    same, border = SIBLINGS[tag]
                    close_nearest(same, border.__contains__)
            if tag not in VOID and not (attributes.endswith("/") and tag not in ("p", "div", "a", "span")):
                score, good = _hint(tag, attributes)
                _, node, kind, above, inside, linked = stack[-1]
                if tag not in INLINE:
                    node, kind = tree.add(node), tag
                names[tag] += 1
                stack.append((tag, node, kind, above + score, inside or good, linked or tag == "a"))
        try:
            step = source.send(go)
        except StopIteration:
            step = None
    cut()
    return out


def scores(found: list[Block]) -> list[tuple[str, float]]:
    """Text and classifier score of each block."""
    article, out = any(b.inside for b in found), []
    for b in found:
        raw = "".join(b.pieces)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        n = text.count(" ") + 1
        s = BIAS + max(-16.0, min(6.0, b.score)) + min(MOST_WORDS, PER_WORD * n) - (LINKS_INSIDE if b.inside and b.kind in LISTED else LINKS) * min(1.0, b.linked / max(1, len(raw.strip())))
        s += PARAGRAPH * (b.kind in ("p", "pre", "blockquote", "td")) + TITLE * (b.kind in HEADING) + SENTENCE * text.endswith((".", "!", "?", "…", "\"", "”", "»"))
        out.append((text, s - OUTSIDE * (article and not b.inside)))
    return out


def edges(found: list[Block], tree: Tree) -> dict[tuple[int, int], int]:
    """Capacities between blocks: neighbours in the page by distance in the tree, and neighbours under one parent."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out[i - 1, i] = int(SCALE * SMOOTH * FADE ** min(64, tree.apart(found[i - 1].node, b.node)))
        parent = tree.above[b.node]
        if parent in last:
            key = (last[parent], i)
            out[key] = out.get(key, 0) + int(SCALE * KIN)
        last[parent] = i
    return out


def minimum_cut(unary: list[tuple[int, int]], joins: dict[tuple[int, int], int]) -> list[bool]:
    """True where a node is on the source's side. unary: a node's costs of the source's and of the sink's side; joins: the cost of parting two nodes. Ties are the source's."""
    n = len(unary)
    gain = [b - a for a, b in unary]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for (i, j), c in joins.items():
        if i != j and c:
            near[i][j] = near[i].get(j, 0) + c
            near[j][i] = near[j].get(i, 0) + c
    side: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(gain[i]) >= sum(near[i].values()) and (gain[i] or not near[i]):
            side[i] = gain[i] >= 0
            for j, c in near[i].items():
                gain[j] += c if side[i] else -c
                del near[j][i]
                queue.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        for i, s in _flow(left, gain, near).items():
            side[i] = s
    return [bool(s) for s in side]


def _flow(nodes: list[int], gain: list[int], near: list[dict[int, int]]) -> dict[int, bool]:
    """Dinic's maximum flow over the remaining nodes; source -1, sink -2."""
    rest: dict[int, dict[int, int]] = {i: dict(near[i]) for i in nodes} | {-1: {}, -2: {}}
    for i in nodes:
        if gain[i] > 0:
            rest[-1][i], rest[i][-1] = gain[i], 0
        elif gain[i] < 0:
            rest[i][-2], rest[-2][i] = -gain[i], 0

    def levels(start: int, forward: bool) -> dict[int, int]:
        out, queue = {start: 0}, deque([start])
        while queue:
            u = queue.popleft()
            for v in rest[u]:
                if v not in out and (rest[u][v] if forward else rest[v].get(u, 0)) > 0:
                    out[v] = out[u] + 1
                    queue.append(v)
        return out

    while -2 in (level := levels(-1, True)):
        tried = {u: iter(list(rest[u])) for u in level}
        path = [-1]
        while path:
            u = path[-1]
            if u == -2:
                least = min(rest[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    rest[a][b] -= least
                    rest[b][a] = rest[b].get(a, 0) + least
                k = next(i for i, (a, b) in enumerate(zip(path, path[1:])) if not rest[a][b])
                del path[k + 1 :]
                tried[path[-1]] = iter([v for v in rest[path[-1]]])
                continue
            for v in tried[u]:
                if rest[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                level[u] = -9
                path.pop()
    # Whatever can't reach the sink any more is content, so ties are too.
    sink = levels(-2, False)
    return {i: i not in sink for i in nodes}


def main_text(page: str) -> str:
    tree = Tree()
    found = blocks(page, tree)
    if not found:
        return ""
    scored = scores(found)
    if len(found) == 1 and not found[0].node:  # no markup
        return scored[0][0]
    soft = lambda x: x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))
    keep = minimum_cut([(int(SCALE * soft(-s)), int(SCALE * soft(s))) for _, s in scored], edges(found, tree))
    return " ".join(t for (t, _), k in zip(scored, keep) if k and t)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        out = [main_text(t.decode("utf-8", "replace")) for t in texts(part.column(2))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", F.col("html").cast("binary").alias("html")).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
