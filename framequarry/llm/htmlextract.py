"""Main text of HTML pages by minimum-cut labelling of blocks."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from framequarry.llm.common import slices

# HTML's element kinds.
BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("script style head title template noscript iframe object svg canvas textarea select button datalist".split())
BAD_TAGS = frozenset("nav footer aside form header menu dialog fieldset".split())
GOOD_TAGS = frozenset("article main".split())
# What class, id and role names say.
BAD_NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|alert|banner|complementary|breadcrumbs?|comments?|consent|contentinfo|cookies?|copyright|disqus|footer|form|header|legal|login|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[-_ ])")
GOOD_NAMES = re.compile(r"(?:^|[-_ ])(?:article|body|content|entry|main|post|story|text)(?:$|[-_ ])")
#: Names that tell how an element looks or what stands in it, and headers of content.
_STATE_NAMES = re.compile(r"(?:^|(?<= ))(?:(?:has|with|no|without|is)-\S+|\S+-(?:enabled|disabled|fixed|open|closed)|(?:article|content|entry|main|post|story)[-_]header)(?= |$)")
#: Elements that names say nothing bad about.
ROOT_TAGS = frozenset("html body main article".split())
_SPACE = re.compile(r"[\s\xa0]+")


#: Elements that can hold an article as a whole.
CONTAINER_TAGS = frozenset("article body center div form html main section table tbody td tr".split())


@dataclass
class Block:
    """A run of text between block-level tags: its text, the characters of it in links, its tag, the element around that, and what its surroundings say."""

    text: str
    linked: int
    parent: int
    tag: str
    element: int
    bad: bool = False
    named: bool = False
    good: bool = False
    inside: bool = False


class _Reader(HTMLParser):
    """Cuts a page into blocks. Void, unclosed and stray tags are taken as browsers do: an end tag closes up to its start tag, a new <p> or <li> closes the open one.

    Elements are numbered as they open, 0 for the page, so a parent's number is below its children's. What is open is counted by
    tag, so a page costs time in proportion to its length however deep its elements nest.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.pieces, self.linked = [], [], 0
        self.parent, self.tags, self.names = [0], [""], [""]
        self.open, self.outer, self.count, self.hidden = [0], [0], Counter(), 0

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.pieces)).strip()
        if text:
            self.blocks.append(Block(text, min(self.linked, len(text)), self.outer[max(0, len(self.outer) - 2)], self.tags[self.outer[-1]], self.open[-1]))
        self.pieces, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            if tag != "html":
                self.leave("head", frozenset())
            for closing, until in (("p", BLOCK_TAGS), ("li", frozenset(("ul", "ol", "menu")))):
                if tag == closing or closing == "p":
                    self.leave(closing, until - {closing})
        elif tag == "br":
            self.pieces.append(" ")
        if tag in VOID_TAGS:
            return
        self.parent.append(self.open[-1])
        self.tags.append(tag)
        self.names.append(" ".join(v.lower() for k, v in attrs if k in ("class", "id", "role") and v))
        self.open.append(len(self.tags) - 1)
        if tag in BLOCK_TAGS:
            self.outer.append(self.open[-1])
        self.count[tag] += 1
        self.hidden += tag in HIDDEN_TAGS

    def leave(self, tag: str, until: frozenset):
        """Closes the innermost open ``tag`` with all inside it, unless an element of ``until`` stands between."""
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if (at := self.tags[self.open[i]]) == tag:
                break
            if at in until:
                return
        for element in self.open[i:]:
            self.count[self.tags[element]] -= 1
            self.hidden -= self.tags[element] in HIDDEN_TAGS
            if self.tags[element] in BLOCK_TAGS:
                self.outer.pop()
        del self.open[i:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        self.leave(tag, frozenset())

    def handle_data(self, data):
        if not self.hidden:
            self.pieces.append(data)
            if self.count["a"]:
                self.linked += len(data.strip())


def blocks_of(html: str | None) -> list[Block]:
    """The page's blocks with what their surroundings say.

    Boilerplate tags and names hold for all inside an element, content tags and names where no boilerplate one stands. A
    boilerplate name says nothing of an element that holds over half of the text outside boilerplate tags, and of the text
    in content elements if there are any; nor does a form that holds over half of all text outside links. ``inside`` marks
    the blocks of the innermost container that holds three fifths of the text that has no boilerplate tag, name or link.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    blocks, parent, tags, names = reader.blocks, reader.parent, reader.tags, reader.names

    def held(chosen, size) -> tuple[list[int], int]:
        """The text that each element holds, and all of it."""
        out = [0] * len(tags)
        for b in chosen:
            out[b.element] += size(b)
        for e in range(len(tags) - 1, 0, -1):
            out[parent[e]] += out[e]
        return out, out[0]

    unlinked, length = (lambda b: len(b.text) - b.linked), (lambda b: len(b.text))
    text, whole = held(blocks, unlinked)
    bad, good = [False] * len(tags), [False] * len(tags)
    for e in range(1, len(tags)):
        up, tag = parent[e], tags[e]
        bad[e] = bad[up] or tag in BAD_TAGS and not (tag == "header" and good[up]) and not (tag == "form" and 2 * text[e] > whole)
        good[e] = good[up] or tag in GOOD_TAGS or bool(names[e] and GOOD_NAMES.search(names[e]))
    plain = [b for b in blocks if not bad[b.element]]
    best = [b for b in plain if good[b.element]]
    (most, of_most), (mine, of_mine) = held(plain, length), held(best, length)
    named, inside = [False] * len(tags), [False] * len(tags)
    for e in range(1, len(tags)):
        telling = tags[e] not in ROOT_TAGS and names[e] and BAD_NAMES.search(_STATE_NAMES.sub("", names[e]))
        spared = len(plain) > 1 and 2 * most[e] > of_most and (not best or 2 * mine[e] > of_mine)
        named[e] = named[parent[e]] or bool(telling) and not spared
    open_text, of_open = held((b for b in plain if not named[b.element]), unlinked)
    box = max((e for e in range(len(tags)) if 5 * open_text[e] >= 3 * of_open and tags[e] in CONTAINER_TAGS), default=0)
    inside[box] = True
    for e in range(1, len(tags)):
        inside[e] = inside[e] or inside[parent[e]]
    for b in blocks:
        b.bad, b.named, b.inside = bad[b.element], named[b.element], inside[b.element]
        b.good = good[b.element] and not b.bad and not b.named
    return blocks


#: Weights of the classifier, in hundredths: what a boilerplate tag, a boilerplate name, a content element, the main container and a copyright mark say.
TAGGED, NAMED, GOOD, INSIDE, MARKED = -600, -500, 300, 150, -200
#: What the block's own tag says.
TAG_WEIGHTS = {"p": 100, "blockquote": 100, "pre": 100, "h1": 50, "h2": 50, "h3": 50, "li": -50, "td": -50, "div": -50}
_SENTENCE = re.compile(r"[.!?:;,\"”»](?:\s|$)")
_COPYRIGHT = re.compile(r"^©|^\(c\) ?\d|all rights reserved", re.I)


def costs(block: Block) -> tuple[int, int]:
    """What it costs to call the block boilerplate and to call it content: a linear classifier over the text and where it stands.

    Integers, so that cuts are exact. Tags and names around the block, its place in or out of the main container, link
    density, length, sentence marks and its own tag all have bounded weights.
    """
    words = block.text.count(" ") + 1
    score = -400 * block.linked // max(1, len(block.text)) + TAG_WEIGHTS.get(block.tag, 0)
    score += 150 if words >= 15 else 50 if words >= 6 else -50
    score += 100 if _SENTENCE.search(block.text) else -50
    score += INSIDE if block.inside else -INSIDE
    score += (GOOD if block.good else 0) + (MARKED if _COPYRIGHT.search(block.text) else 0)
    score += TAGGED if block.bad else NAMED if block.named else 0
    return max(score, 0), max(-score, 0)


#: Capacities of the smoothness edges: neighbours in page order, and the next block below the same parent element.
NEAR, SAME_PARENT = 60, 90


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut that has fewest of them, by maximum flow (Dinic's algorithm).

    First the source's and sink's shares cancel, and nodes whose remaining terminal capacity is at least that of all their edges
    are settled, since the cut can't gain by moving them; their edges become terminal capacities of their neighbours. What is left is small.
    """
    n = len(source)
    net = [a - b for a, b in zip(source, sink)]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[i].get(j, 0) + c
        near[j][i] = near[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(net[i]) > sum(near[i].values()):
            label[i] = net[i] > 0
            for j, c in near[i].items():
                net[j] += c if label[i] else -c
                del near[j][i]
                queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return [bool(x) for x in label]
    at = {i: k + 2 for k, i in enumerate(rest)}
    to: list[list[list[int]]] = [[] for _ in range(len(rest) + 2)]

    def link(a: int, b: int, c: int, back: int):
        to[a].append([b, c, len(to[b])])
        to[b].append([a, back, len(to[a]) - 1])

    for i in rest:
        if net[i] > 0:
            link(0, at[i], net[i], 0)
        elif net[i] < 0:
            link(at[i], 1, -net[i], 0)
        for j, c in near[i].items():
            if i < j:
                link(at[i], at[j], c, c)

    def levels() -> list[int]:
        depth = [-1] * len(to)
        depth[0] = 0
        waiting = deque([0])
        while waiting:
            a = waiting.popleft()
            for b, c, _ in to[a]:
                if c > 0 and depth[b] < 0:
                    depth[b] = depth[a] + 1
                    waiting.append(b)
        return depth

    while (depth := levels())[1] >= 0:
        turn, path = [0] * len(to), []
        a = 0
        while True:
            if a == 1:
                flow = min(to[x][k][1] for x, k in path)
                for x, k in path:
                    e = to[x][k]
                    e[1] -= flow
                    to[e[0]][e[2]][1] += flow
                first = next(p for p, (x, k) in enumerate(path) if to[x][k][1] == 0)
                a = path[first][0]
                del path[first:]
                continue
            while turn[a] < len(to[a]):
                b, c, _ = to[a][turn[a]]
                if c > 0 and depth[b] == depth[a] + 1:
                    path.append((a, turn[a]))
                    a = b
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                a, k = path.pop()
                turn[a] += 1
    for i in rest:
        label[i] = depth[at[i]] >= 0
    return [bool(x) for x in label]


def main_text(html: str | None) -> str:
    """The content blocks of a page in order, joined by line feeds."""
    blocks = blocks_of(html)
    edges = [(i, i + 1, NEAR) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    terminal = [costs(b) for b in blocks]
    content = min_cut([t[0] for t in terminal], [t[1] for t in terminal], edges)
    return "\n".join(b.text for b, c in zip(blocks, content) if c)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch["html"]]
        yield pa.RecordBatch.from_pydict({"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its content blocks, from the whole html.

    Null or empty html, or a page without content: text "". Character references are decoded, white space inside a block (no-break spaces included) is one
    space. Broken markup is read as far as it goes. Repeated rows give equal rows. Empty table: no rows. Other columns are ignored.
    """
    return pages.select("page_id", "url", "html").mapInArrow(lambda it: _extract(slices(it)), "page_id long, url string, text string, n_chars long")
