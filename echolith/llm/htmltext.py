"""Main text of web pages by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags). Each block has costs for being content or boilerplate: what its ancestors' tags say, and a logistic classifier of its text and of the class names around it. The costs are terminal capacities of a graph; blocks that stand next to each other, and blocks that follow each other in one DOM parent, are joined by smoothness edges. The minimum cut labels the page: blocks left on the source's side are the article.

The classifier is fitted on a bounded sample: BLOCKS blocks of the SAMPLE pages with the least hash. Its labels come from semantic elements (article and main against nav, footer, aside and the like), which are not among its features; features are the text's shape and whether class names around it hold boilerplate or article words, whole or as part of a compound, whose weights start from PRIOR. Every page is labelled whole.

Elements whose text is never shown go up to their own end tag; self-closed, or without an end tag of their own, only the tag itself goes (script and style: all that follows). Text in math and object elements and in elements with unknown names stays.

Defined results: a null or empty html, or a page without content blocks, gives an empty text of 0 characters. Repeated rows are read alike, whatever their page_id. An empty table gives an empty result. Columns other than page_id, url and html play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, BLOCKS = 2_000, 50_000
#: Elements whose text is never shown, or is not text of the page.
DROPPED = frozenset("script style title template textarea noscript iframe svg select canvas audio video".split())
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark boilerplate, and those that mark the article.
BOILERPLATE_WORDS = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation navlinks newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toolbar topbar complementary contentinfo".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu fieldset label".split())
#: Words that say what a wrapper has or does, not what it is; words too common among wrappers to count whole.
STATES, COMMON = frozenset("has with no without is enabled disabled open closed active inactive visible".split()), frozenset("widget widgets".split())
#: Evidence of one ancestor's tag, in units of log-odds; the classifier's say at most for the text's shape.
TAG_COST, HIDDEN_COST, ARTICLE_GAIN, OUTSIDE_COST, TEXT_MOST = 12.0, 12.0, 5.0, 4.0, 3.0
#: Features of the text's shape, and what class names are believed to weigh before the sample is seen: a boilerplate word that is a whole name, one that is part of a compound, an article word.
SHAPE, PRIOR = 7, (-10.0, -3.0, 3.0)
#: Smoothness between neighbours with the same parent, with parents of the same parent, and other; between blocks that follow each other in one parent with others between them.
SAME, NEAR, FAR, FOLLOWING = 2.0, 1.0, 0.2, 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z!?][^>]*(?:>|\Z)|<[!?][^>]*>", re.S)
NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: For each dropped element: its end tag, or what shows that it has none of its own.
ENDS = {t: re.compile(rf"</({t})\s*>" + ("" if t in ("script", "style") else rf"|<{t}(?=[\s/>])" + ("" if t == "template" else r"|</(?:article|main|body)\s*>")), re.I) for t in DROPPED}


class Block:
    __slots__ = ("text", "linked", "evidence", "words", "inside", "tag", "parent", "grand")

    def __init__(self, text: str, linked: int, evidence: float, words: int, inside: bool, tag: str, parent: int, grand: int):
        self.text, self.linked, self.evidence, self.words, self.inside, self.tag, self.parent, self.grand = text, linked, evidence, words, inside, tag, parent, grand


#: Bits of Block.words: a boilerplate word as a whole name, as part of a compound, an article word.
WHOLE, PART, ARTICLE = 1, 2, 4


def _name_words(value: str, inside: bool) -> int:
    """What the names in a class, id or role say."""
    out = 0
    for name in value.split():
        parts = [x.lower() for x in PARTS.findall(name)]
        if STATES.isdisjoint(parts):
            marks = [x in BOILERPLATE_WORDS or x == "header" and not inside and ARTICLE_WORDS.isdisjoint(parts) for x in parts]
            out |= WHOLE * (any(marks) and len(parts) == 1) | PART * (any(marks) and len(parts) > 1 or not COMMON.isdisjoint(parts))
            out |= ARTICLE * (not any(marks) and not ARTICLE_WORDS.isdisjoint(parts))
    return out


def _evidence(tag: str, attributes: str, inside: bool) -> tuple[float, int, bool]:
    """Log-odds of content that an element adds to its blocks, what its names say, and whether it is the article."""
    gain = -TAG_COST if tag in BOILERPLATE_TAGS or tag == "header" and not inside else 0.0
    article, words = tag in ("article", "main"), 0
    for m in NAMED.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("hidden", "aria-hidden") and value.lower() != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            gain -= HIDDEN_COST
        elif name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
            words |= _name_words(value, inside)
    return gain + ARTICLE_GAIN * (article and not inside), words, article


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page with text, in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, float, int, bool, int]] = [("", 0.0, 0, False, 0)]  # tag, evidence and words so far, inside the article, number
    opened: defaultdict[str, int] = defaultdict(int)  # the tags on the stack: an end tag without one needs no search
    unclosed: set[str] = set()
    serial, links, at = 0, 0, 0
    texts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in BLOCK_TAGS or not i)
                parent = stack[i]
                own = parent[0] in ("p", "li", "td", "th", "dd", "dt") or parent[0][:1] == "h" and parent[0][1:].isdigit()
                up = stack[max(0, i - own)][4]
                out.append(Block(text, min(linked, len(text)), *stack[-1][1:4], parent[0], up, stack[max(0, i - own - 1)][4]))
            texts.clear()
            linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text:
            text = entities.unescape(text) if "&" in text else text
            texts.append(text)
            if links:
                linked += len(text.strip())

    while m := TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag in DROPPED:
            if not m[1] and tag not in unclosed and (tag in ("script", "style") or not m[3].rstrip().endswith("/")):
                end = ENDS[tag].search(page, at)
                if end is None:
                    unclosed.add(tag)
                    at = len(page) if tag in ("script", "style") else at
                elif end[1]:
                    at = end.end()
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        elif tag == "br":
            texts.append(" ")
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    for closed, *_ in stack[i:]:
                        opened[closed] -= 1
                    del stack[i:]
                    break
                if not block and stack[i][0] in BLOCK_TAGS:
                    break  # an inline end tag closes no block
        elif tag not in VOID:
            if block:
                while len(stack) > 1 and (stack[-1][0] in CLOSED_BY_BLOCK or stack[-1][0] not in BLOCK_TAGS or tag == "li" == stack[-1][0]):
                    closed = stack.pop()[0]
                    opened[closed] -= 1
                    links -= closed == "a" and links > 0
            if tag == "a":
                links += 1
            serial += 1
            _, before, words, inside, _ = stack[-1]
            gain, more, article = _evidence(tag, m[3], inside) if block or m[3] and m[3].strip() else (0.0, 0, False)
            if article and not inside:
                words &= WHOLE  # what wrappers' compounds and article words say ends here
            opened[tag] += 1
            stack.append((tag, before + gain, words | more, inside or article, serial))
    put(page[at:])
    flush()
    return out


def names(b: Block) -> list[float]:
    return [float(b.words & bit > 0) for bit in (WHOLE, PART, ARTICLE)]


def shape(b: Block, place: float) -> list[float]:
    """What the classifier sees of a block's text."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    stops = sum(map(b.text.count, ".,;:!?"))
    return [1.0, log1p(n), b.linked / n, stops / words, n / words / 10, float(b.tag == "li"), abs(2 * place - 1)]


def _weights(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge around the prior, both classes weighing the same."""
    prior = np.array([0.0] * SHAPE + list(PRIOR))
    w = prior.copy()
    if len(set(y.tolist())) < 2:
        return w
    share = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean())
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + w - prior
        hess = (x * (share * p * (1 - p) + 1e-9)[:, None]).T @ x + np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page in b.column("html").to_pylist():
            found = blocks(page)
            for i, x in enumerate(found):
                good = x.inside and x.evidence > 0 and not x.words & WHOLE
                if good or x.evidence <= -TAG_COST + ARTICLE_GAIN:
                    rows.append((float(good), [*shape(x, i / len(found)), *names(x)]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["y", "x"])


def train(pages: DataFrame, sample: int = SAMPLE, most: int = BLOCKS) -> list[float]:
    """The classifier's weights."""
    hashed = pages.select(F.col("html").cast("string"), F.xxhash64("url", "page_id").alias("h"))
    least = hashed.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes alone are sorted
    some = hashed.where(F.col("h") <= F.lit(least)).select("html").limit(sample)  # the limit only cuts ties
    rows = some.mapInArrow(_samples, "y double, x array<double>").withColumn("h", F.xxhash64("x")).orderBy("h").limit(most).collect()
    if not rows:
        return [0.0] * SHAPE + list(PRIOR)
    return _weights(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])).tolist()


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether the minimum cut leaves it with the source. gain is the capacity from the source (or, negative, to the sink); edges join nodes both ways. Ties fall to the source."""
    n, gain = len(gain), list(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        near[i][j] = near[j][i] = near[i].get(j, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a node whose terminal outweighs its edges is decided by it
        i = todo.popleft()
        if label[i] is None and abs(gain[i]) >= sum(near[i].values()):
            label[i] = gain[i] >= 0
            for j, c in near[i].items():
                gain[j] += c if label[i] else -c
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, _max_flow(left, gain, near)):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; the nodes that still reach no sink at the end stay with the source."""
    number = {x: k for k, x in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def edge(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((c, back))

    for x in nodes:
        if gain[x] > 0:
            edge(s, number[x], gain[x], 0.0)
        elif gain[x] < 0:
            edge(number[x], t, -gain[x], 0.0)
        for y, c in near[x].items():
            if x < y:
                edge(number[x], number[y], c, c)
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        at = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:  # blocking flow, one path after another
            if a == t:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
            elif at[a] < len(out[a]):
                e = out[a][at[a]]
                if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    at[a] += 1
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break
    sink = {t}
    queue = deque([t])
    while queue:
        b = queue.popleft()
        for e in out[b]:  # e ^ 1 leads to b
            if cap[e ^ 1] > 1e-9 and to[e] not in sink:
                sink.add(to[e])
                queue.append(to[e])
    return [k not in sink for k in range(len(nodes))]


def graph(found: list[Block], weights: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The terminal capacities of blocks, and the edges between them."""
    outside = OUTSIDE_COST if any(b.inside for b in found) else 0.0
    gain = []
    for i, b in enumerate(found):
        text = sum(w * x for w, x in zip(weights, shape(b, i / len(found))))
        said = sum(w * x for w, x in zip(weights[SHAPE:], names(b)))
        gain.append(b.evidence - (0.0 if b.inside else outside) + max(-TEXT_MOST, min(TEXT_MOST, text)) + said)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            edges.append((i - 1, i, SAME if a.parent == b.parent else NEAR if a.grand == b.grand or a.parent == b.grand or a.grand == b.parent else FAR))
        if last.get(b.parent, i - 1) < i - 1:
            edges.append((last[b.parent], i, FOLLOWING))
        last[b.parent] = i
    return gain, edges


def main_text(page: str | None, weights: list[float]) -> str:
    """The article of a page: its content blocks joined by blank lines."""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, min_cut(*graph(found, weights))) if keep)


def _extract(weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, weights) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(_extract(train(pages)), "page_id long, url string, text string, n_chars long")
