"""Main-text extraction from web pages by minimum-cut labelling.

A page is read once into text blocks and the tree of elements around them; both are nodes of one graph. A logistic
classifier gives each node a cost for either label, its capacities to the two terminals: a block's comes from its own
text (length, punctuation, share of links, kind of its element), an element's from its name, class and id words, for
every block that it holds. Smoothness edges join a block or element to the nearest element around it that says
something, neighbours in page order by their distance in the tree, and successive blocks under one parent. No cost
outweighs the edges of its node: neither a paragraph nor an element decides alone, and the label of either comes from
the cut. The minimum cut between the terminals is the labelling of least total cost; blocks on its content side are the
text. Only a node without enough edges to hold it is decided beforehand, which changes no minimum.

A class word counts as the head or the first word of its name, and not where the name says otherwise (``with-sidebar``,
``no-ads``). Words that are as common in the names of articles (``share``, ``notice``) are not believed of an element
that holds nearly all of the page's prose.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches_of, table, text_bytes

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
#: Elements whose inside is no markup or part of a form, up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
#: An opening element of the key closes an open element of the values (within the nearest container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot menu div article section main aside body form fieldset".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Words of class, id and role that tell of what is not the article, and of what is.
AWAY = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentlist cookie cookies consent disqus disclaimer discussion feedback footer foot form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup privacy promo promoted promotion recommended related reply replies respond search share sharing sidebar side signup social sponsor sponsored subscribe subscription tags teaser toolbar trending widget complementary contentinfo alert aside rail skip".split()
)
HERE = frozenset("article articlebody body content entry main post story text prose maincontent".split())
#: Of the former, words that name articles as well; words of a name that say of another one that it is not this element;
#: and words that say nothing, so that the one before them is the head.
WEAK = frozenset("alert banner discussion disclaimer feedback foot form header login menu notice notices notification privacy promo promotion related reply respond search share sharing side skip social tags teaser trending widget".split())
OTHERWISE = frozenset("with without no not non has have is by open closed enabled disabled free layout price supported".split())
NEUTRAL = frozenset("area bar block body box button buttons col column container content div group inner item items left list main outer panel right row section slot top bottom unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open paragraph outside of these is not closed from within.
WALLS = BLOCKS - HEADINGS - {"p"}
#: Weight of a block's own evidence and of an element's, for each of its blocks.
OWN, LEAN = 0.4, 0.35
#: Capacity of the edge between a block and its element, between elements, and between blocks. The first is above all
#: that one block can add to an element, so that no element is decided but with its blocks.
HOLD, WITHIN, NEAR = 3.0, 0.5, 0.6
#: An element with a weak name holds the article if what prose is elsewhere is less than this share of its own.
ELSEWHERE = 0.25


@dataclass
class Block:
    text: str
    chain: tuple[int, ...]  # ids of the open elements that count, outermost first
    score: float  # log-odds of being content, by its own text


@dataclass
class _Open:
    name: str
    ident: int
    lean: float  # log-odds of what it holds being content
    weak: float  # the part of it that rests on weak names
    within: bool  # in an article or main element


def _away(value: str) -> tuple[bool, bool]:
    """Whether a name out of a class, id or role tells of what is not the article, and whether only by weak words."""
    found = strong = False
    for token in value.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if words and not OTHERWISE.intersection(words):
            head = next((w for w in reversed(words) if w not in NEUTRAL), words[-1])
            told = {head, words[0]} & AWAY
            found, strong = found or bool(told), strong or bool(told - WEAK)
    return found, found and not strong


def _lean(name: str, attributes: str, within: bool) -> tuple[float, float]:
    """What an element adds to the log-odds of the blocks below it, and what part of that is by weak names."""
    lean = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "menu": -7.0, "dialog": -7.0, "search": -7.0, "fieldset": -3.0, "article": 4.0, "main": 3.0, "head": -20.0}.get(name, 0.0)
    weak = 0.0
    if name == "header" and not within:
        lean -= 7.0
    if attributes:
        told = doubted = here = False
        for match in _ATTRIBUTE.finditer(attributes):
            value = match[2] or match[3] or match[4] or ""
            away, only_weak = _away(value)
            if away and name not in ("body", "html", "article", "main"):
                told, doubted = told or not only_weak, doubted or only_weak
            elif {w.lower() for w in _WORDS.findall(value)} & HERE:
                here = True
        if told or doubted:
            lean -= 7.0
            weak = 0.0 if told else -7.0
        if here:
            lean += 1.5
        if _HIDDEN.search(attributes):
            lean -= 12.0
    return lean, weak


def _believed(blocks: list[Block], leans: dict[int, float], weak: dict[int, float]) -> dict[int, float]:
    """The leans without those by weak names of elements that hold nearly all prose that nothing else speaks against."""
    if not any(weak.values()):
        return leans
    firm = {e: x - weak.get(e, 0.0) for e, x in leans.items()}
    prose: defaultdict[int, int] = defaultdict(int)
    everything = 0
    for block in blocks:
        if block.score > 0 and all(firm[e] >= 0 for e in block.chain):
            everything += len(block.text)
            for e in block.chain:
                prose[e] += len(block.text)
    return {e: firm[e] if weak.get(e) and everything - prose[e] < ELSEWHERE * prose[e] else x for e, x in leans.items()}


def blocks_of(page: str) -> tuple[list[Block], dict[int, float]]:
    """Text blocks of a page in page order, and the log-odds of the elements in their chains."""
    found: list[Block] = []
    leans: dict[int, float] = {}
    weak: dict[int, float] = {}
    stack: list[_Open] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a name on the stack
    parts: list[str] = []
    linked = links = made = 0  # characters in links; open links

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            chain = [e for e in stack if e.lean or e.name in BLOCKS]
            leans.update((e.ident, e.lean) for e in chain)
            weak.update((e.ident, e.weak) for e in chain if e.weak)
            found.append(Block(text, tuple(e.ident for e in chain), _score(text, min(1.0, linked / len(text)), stack)))
        parts.clear()
        linked = 0

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close(k: int) -> None:
        for e in stack[k:]:
            places[e.name].pop()
        del stack[k:]

    at = 0
    while True:
        match = _TAG.search(page, at)
        piece = page[at : match.start()] if match else page[at:]
        if piece:
            text = html.unescape(piece) if "&" in piece else piece
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not match:
            break
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                flush()
            elif name in ("td", "th"):
                parts.append(" ")
            if places.get(name):
                close(places[name][-1])
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if name in VOID:
            if name in ("hr",):
                flush()
            elif name != "wbr":
                parts.append(" ")
            continue
        attributes = match[3] or ""
        if name in BLOCKS:
            flush()
            if places.get("p") and places["p"][-1] > last(WALLS):
                close(places["p"][-1])
        if name in CLOSES:
            if (k := last(CLOSES[name])) > last(CONTAINERS):
                close(k)
        if name in ("td", "th"):
            parts.append(" ")
        if attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name == "a":
            links += 1
        made += 1
        places[name].append(len(stack))
        within = bool(stack and stack[-1].within)
        stack.append(_Open(name, made, *_lean(name, attributes, within), within or name in ("article", "main")))
    flush()
    return found, _believed(found, leans, weak)


def _score(text: str, link_share: float, stack: list[_Open]) -> float:
    score = -0.5 - 4.0 * link_share
    score += min(2.0, len(text) / 80) + (0.7 if text[-1] in ".!?…:\"”»" else -0.3)
    inner = next((e.name for e in reversed(stack) if e.name in BLOCKS), "")
    if inner in HEADINGS:
        score += 1.0
    elif inner in ("p", "blockquote", "pre", "figcaption", "dd"):
        score += 0.8
    return score


def graph_of(blocks: list[Block], leans: dict[int, float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Log-odds of all nodes, the blocks first, and the edges between them."""
    unary = [OWN * b.score for b in blocks]
    node: dict[int, int] = {}
    edges: dict[tuple[int, int], float] = {}
    for i, block in enumerate(blocks):
        above = -1
        for ident in filter(leans.get, block.chain):  # an element that says nothing ties nothing together
            at = node.setdefault(ident, len(unary))
            if at == len(unary):
                unary.append(0.0)
                if above >= 0:
                    edges[above, at] = WITHIN
            unary[at] += LEAN * max(-7.0, min(7.0, leans[ident]))
            above = at
        if above >= 0:
            edges[i, above] = HOLD
    last: dict[tuple[int, ...], int] = {}
    for i, block in enumerate(blocks):
        if i:
            a, b = blocks[i - 1].chain, block.chain
            shared = 0
            for x, y in zip(a, b):
                if x != y:
                    break
                shared += 1
            edges[i - 1, i] = NEAR / (1 + len(a) - shared + len(b) - shared)
        parent = block.chain[-2:-1]
        if parent in last and last[parent] < i - 1:
            edges[last[parent], i] = NEAR / 3
        last[parent] = i
    return unary, [(a, b, capacity) for (a, b), capacity in edges.items()]


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True costs max(0, -unary), False max(0, unary), an edge its capacity where labels differ."""
    near: list[dict[int, float]] = [{} for _ in unary]
    for a, b, capacity in edges:
        near[a][b] = near[a].get(b, 0.0) + capacity
        near[b][a] = near[b].get(a, 0.0) + capacity
    unary, label = list(unary), [None] * len(unary)
    queue = deque(range(len(unary)))
    while queue:  # a block that outweighs its edges is decided; its edges then weigh on its neighbours
        i = queue.popleft()
        if label[i] is None and abs(unary[i]) >= sum(near[i].values()):
            label[i] = unary[i] > 0
            for j, capacity in near[i].items():
                unary[j] += capacity if label[i] else -capacity
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(len(unary)) if label[i] is None]
    if rest:
        source, sink = len(unary), len(unary) + 1
        flow: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            flow[source][i], flow[i][source] = max(0.0, unary[i]), 0.0
            flow[i][sink], flow[sink][i] = max(0.0, -unary[i]), 0.0
        reached = _max_flow(flow, source, sink)
        for i in rest:
            label[i] = i in reached
    return [bool(x) for x in label]


def _max_flow(flow: dict[int, dict[int, float]], source: int, sink: int) -> set[int]:
    """Blocking flows over the shortest paths, until there is none; the nodes then reachable from the source."""
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, left in flow[i].items():
                if left > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        ahead = {i: list(flow[i]) for i in level}  # edges not yet given up, the last first
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                steps = list(zip(path, path[1:]))
                least = min(flow[a][b] for a, b in steps)
                for a, b in steps:
                    flow[a][b] -= least
                    flow[b][a] += least
                del path[next(k for k, (a, b) in enumerate(steps) if flow[a][b] <= 1e-12) + 1 :]
                continue
            while ahead[i] and not (flow[i][ahead[i][-1]] > 1e-12 and level.get(ahead[i][-1]) == level[i] + 1):
                ahead[i].pop()
            if ahead[i]:
                path.append(ahead[i][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by newlines; empty if there is none."""
    blocks, leans = blocks_of(page)
    labels = minimum_cut(*graph_of(blocks, leans))
    return "\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points).

    Null or empty html has an empty text. Pages are read whole; rows may repeat.
    """

    def extracted(batches):
        for batch in batches_of(batches):
            texts = [main_text(t.decode("utf-8", "replace")) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col], pages[url_col].cast("string"), pages[html_col].cast("string"))
    return rows.mapInArrow(extracted, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
