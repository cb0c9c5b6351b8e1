"""The main text of web pages: a minimum cut separates content from boilerplate.

1. Blocks. A page's markup is read once. Block elements cut its text into blocks; scripts, styles
   and other elements that hold no prose have none. A block knows its element and the ancestors.
2. Classifier. A logistic model gives each block a score from its words, links, punctuation,
   element and neighbours. It is fitted on blocks whose place is marked by the page itself (inside
   `article` or `main`; inside `nav`, `footer`, `aside`, ...), shrunk towards `PRIOR`, so without
   such pages the prior holds. The place, and class, id and role names, add `EVIDENCE`.
3. Cut. Scores are the capacities between a block and the two terminals. A block is tied to the
   next one on the page, the more tightly the closer they lie in the document tree, and to the next
   block of the same parent. The maximum flow leaves a minimum cut: the blocks on the content side,
   in page order, are the main text. So a short line between paragraphs stays and a lone sentence
   in a menu goes. Blocks whose score outweighs all their ties are decided before the flow, which
   changes no result.

Scale: pages are independent; one scan labels them, two read hashes and a bounded sample to fit the
model (`FIT_PAGES` pages by hash, `FIT_BLOCKS` blocks of each). Nothing is shuffled but the sample.
A page's graph has at most two ties per block, so memory grows with the page only.

Defined results: null and empty pages have an empty text; markup that never ends goes to the end of
the page; white space of any kind is one space, `br` is white space, cells of a table row are one
block; unknown character references stay as they are; rows with equal ids are separate pages; equal
pages have equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import named

FIT_PAGES = 2_000
FIT_BLOCKS = 50
SHRINKAGE = 0.02
MOST_SCORE = 4.0
SCALE = 1000
NEXT_TIE = 0.8
SIBLING_TIE = 0.6

# Names of elements and of their roles, and words of class and id names.
NO_PROSE = "script style textarea title xmp iframe noembed noframes noscript template svg select button object canvas audio video"
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACE_TAGS = frozenset("br td th img wbr input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre figcaption dd tr".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_ROLES = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("nav aside footer header form menu dialog search".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
CONTENT_WORDS = re.compile(r"article|post|entry|story|content|main|body|text")
BOILERPLATE_WORDS = re.compile(
    r"ad|ads|adv|adbox|adslot|adunit|adsense|advert.*|sponsor.*|promo.*|nav|navi.*|navbar.*|menu.*|breadcrumb.*|sidebar.*|aside|footer.*|header|masthead|banner.*|topbar|"
    r"cookie.*|consent.*|gdpr|notice.*|notification.*|popup.*|modal.*|overlay|comment|comments|commentlist|reply|replies|respond|disqus.*|"
    r"share|sharing|social.*|related.*|recommend.*|newsletter.*|subscri.*|signup|login|search.*|pagination|pager|widget.*|toolbar.*|copyright|legal"
)
BOILERPLATE_PHRASES = re.compile(
    r"©|\(c\) \d|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign up|log ?in|advertisement|leave a (?:reply|comment)",
    re.I,
)
#: Which open element ends where another begins, and the elements that this does not reach beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
}
EVIDENCE = {"boilerplate": -8.0, "boilerplate word": -6.0, "content": 3.0, "content word": 1.0}

FEATURES = ("bias", "length", "links", "sentence", "heading", "paragraph", "list", "phrase", "length beside", "links beside")
PRIOR = np.array([-1.0, 1.5, -4.0, 0.75, 1.0, 0.75, -0.5, -2.5, 0.5, -1.0])

_ATTRIBUTES = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
MARKUP = re.compile(
    rf"<({'|'.join(NO_PROSE.split())})(?=[\s/>]){_ATTRIBUTES}.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    rf"|<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-z]))[^>]*+(?:>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*+){_ATTRIBUTES}|([^<]++|<)",
    re.I | re.S,
)
NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that begin so tell what lies elsewhere on the page, like `no-sidebar`.
ABOUT = frozenset("no not has with without is".split())


def named_words(names: str) -> Iterator[str]:
    """The words of class, id or role names, in lower case."""
    for name in names.split():
        words = [x.lower() for x in WORDS.findall(name)]
        if words and words[0] not in ABOUT:
            yield from words


class Page:
    """Blocks of a page, the elements they lie in and what these say about their place."""

    def __init__(self, html: str):
        self.tags, self.parents, self.depths, self.own = [""], [-1], [0], [0.0]
        self.holds = [False]  # elements with marked content in them
        self.texts: list[str] = []
        self.nodes: list[int] = []
        self.linked: list[int] = []
        self._read(html)
        self.evidence = self._evidence()

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        node = len(self.tags)
        own = EVIDENCE["boilerplate"] if tag in BOILERPLATE_TAGS else EVIDENCE["content"] if tag in CONTENT_TAGS else 0.0
        if attributes and tag not in ("html", "body"):
            for name, *values in NAMES.findall(attributes):
                for word in named_words("".join(values)):
                    if name.lower() == "role":
                        own = min(own, EVIDENCE["boilerplate"]) if word in BOILERPLATE_ROLES else EVIDENCE["content"] if word in CONTENT_ROLES and own >= 0 else own
                    elif BOILERPLATE_WORDS.fullmatch(word):
                        own = min(own, EVIDENCE["boilerplate word"])
                    elif own == 0 and CONTENT_WORDS.fullmatch(word):
                        own = EVIDENCE["content word"]
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        self.own.append(own)
        self.holds.append(False)
        if own == EVIDENCE["content"] or (tag == "h1" and own >= 0):
            self._mark(node, tag)
        return node

    def _mark(self, node: int, tag: str) -> None:
        """An article with a heading, or `main`, is content: what is around it is no boilerplate."""
        if tag == "h1":
            while node > 0 and self.own[node] != EVIDENCE["content"]:
                if self.own[node] < 0:
                    return
                node = self.parents[node]
        elif tag == "article":
            return
        while node > 0 and not self.holds[node]:
            self.holds[node] = True
            node = self.parents[node]

    def _read(self, html: str) -> None:
        stack, parts, link, linked = [0], [], None, 0
        tags = self.tags

        def flush():
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.texts.append(text)
                    self.nodes.append(stack[-1])
                    self.linked.append(linked)
                parts, linked = [], 0

        def close(size: int):
            nonlocal link
            del stack[size:]
            if link is not None and link > size:
                link = None

        for match in MARKUP.finditer(html):
            text = match[6]
            if text is not None:
                if "&" in text:
                    text = unescape(text)
                parts.append(text)
                if link is not None:
                    linked += len(text)
                continue
            tag = match[4]
            if tag is None:
                if match[1] is not None:
                    parts.append(" ")
                continue
            tag = tag.lower()
            ending = match[3] == "/"
            if tag in BLOCK_TAGS:
                flush()
                if ending:
                    for at in range(len(stack) - 1, 0, -1):
                        if tags[stack[at]] == tag:
                            close(at)
                            break
                    continue
                if tag in ENDS:
                    same, beyond = ENDS[tag]
                    for at in range(len(stack) - 1, 0, -1):
                        if tags[stack[at]] in same:
                            close(at)
                            break
                        if tags[stack[at]] in beyond:
                            break
                elif tags[stack[-1]] == "p" or tags[stack[-1]] in HEADINGS and tag in HEADINGS:
                    close(len(stack) - 1)
                node = self._open(tag, stack[-1], match[5])
                if tag != "hr":
                    stack.append(node)
            elif tag == "a":
                link = None if ending else len(stack)
            elif tag in SPACE_TAGS:
                parts.append(" ")
        flush()

    def _evidence(self) -> list[float]:
        """What an element and those around it say: the nearest marks, boilerplate before content."""
        out = [0.0] * len(self.tags)
        for node in range(1, len(out)):
            around, own = out[self.parents[node]], self.own[node]
            if own < 0 and (self.holds[node] or (self.tags[node] == "header" and around >= EVIDENCE["content"])):
                own = 0.0
            out[node] = min(around, own) if around < 0 or own < 0 else max(around, own)
        return out

    def place(self, block: int) -> int:
        """1 inside marked content, 0 inside an element for boilerplate, -1 elsewhere."""
        found = self.evidence[self.nodes[block]]
        return 1 if found >= EVIDENCE["content"] else 0 if found <= EVIDENCE["boilerplate"] else -1

    def features(self) -> np.ndarray:
        n = len(self.texts)
        out = np.zeros((n, len(FEATURES)))
        out[:, 0] = 1
        words = np.array([text.count(" ") + 1 for text in self.texts])
        out[:, 1] = np.minimum(np.log2(1 + words), 8) / 4
        out[:, 2] = [min(linked / len(text), 1) for linked, text in zip(self.linked, self.texts, strict=True)]
        for i, (text, node) in enumerate(zip(self.texts, self.nodes, strict=True)):
            tag = self.tags[node]
            out[i, 3:8] = text[-1] in ".!?…。:;\"”»", tag in HEADINGS, tag in PARAGRAPHS, tag == "li", BOILERPLATE_PHRASES.search(text) is not None
        for column, beside in ((1, 8), (2, 9)):
            out[1:, beside] += out[:-1, column] / 2
            out[:-1, beside] += out[1:, column] / 2
        return out

    def distance(self, one: int, other: int) -> int:
        """Steps between two elements in the document tree."""
        steps, depths, parents = 0, self.depths, self.parents
        while one != other:
            if depths[one] < depths[other]:
                one, other = other, one
            one = parents[one]
            steps += 1
        return steps

    def ties(self) -> list[tuple[int, int, int]]:
        """Blocks that are next to each other, on the page or among their parent's, and how tightly."""
        out, last = [], {}
        for block, node in enumerate(self.nodes):
            if block:
                out.append((block - 1, block, round(SCALE * NEXT_TIE / max(self.distance(self.nodes[block - 1], node), 1))))
            parent = self.parents[node]
            if last.get(parent, block - 1) != block - 1:
                out.append((last[parent], block, round(SCALE * SIBLING_TIE)))
            last[parent] = block
        return out


def min_cut(scores: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """The side of each node in a minimum cut; of several, the one with most nodes on the content side.

    A node on the other side than its score's sign pays the score, a tie between sides its weight.
    """
    scores, n = list(scores), len(scores)
    beside: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, weight in ties:
        if a != b and weight:
            beside[a][b] = beside[b][a] = beside[a].get(b, 0) + weight
    held = [sum(x.values()) for x in beside]
    side: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # nodes that no neighbour can turn
        node = todo.pop()
        if side[node] is None and (scores[node] >= held[node] or -scores[node] > held[node]):
            side[node] = scores[node] >= held[node]
            for other, weight in beside[node].items():
                if side[other] is None:
                    scores[other] += weight if side[node] else -weight
                    held[other] -= weight
                    todo.append(other)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {node: i for i, node in enumerate(rest)}
        inner = [(i, number[b], w) for i, a in enumerate(rest) for b, w in beside[a].items() if a < b and side[b] is None]
        for node, content in zip(rest, _flow_cut([scores[i] for i in rest], inner), strict=True):
            side[node] = content
    return side


def _flow_cut(scores: list[int], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's maximum flow; content is what cannot reach the sink in the end."""
    n = len(scores)
    source, sink = n, n + 1
    edges_of: list[list[int]] = [[] for _ in range(n + 2)]
    target, left = [], []

    def tie(a: int, b: int, there: int, back: int):
        edges_of[a].append(len(target))
        edges_of[b].append(len(target) + 1)
        target.extend((b, a))
        left.extend((there, back))

    for node, score in enumerate(scores):
        if score > 0:
            tie(source, node, score, 0)
        elif score < 0:
            tie(node, sink, -score, 0)
    for a, b, weight in ties:
        tie(a, b, weight, weight)
    while True:
        # distance to the sink over edges that have room
        level = [-1] * (n + 2)
        level[sink] = 0
        queue = deque([sink])
        while queue:
            node = queue.popleft()
            for edge in edges_of[node]:
                if left[edge ^ 1] and level[target[edge]] < 0:
                    level[target[edge]] = level[node] + 1
                    queue.append(target[edge])
        if level[source] < 0:
            return [x < 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                room = min(left[edge] for edge in path)
                for edge in path:
                    left[edge] -= room
                    left[edge ^ 1] += room
                full = next(i for i, edge in enumerate(path) if not left[edge])
                node = target[path[full] ^ 1]
                del path[full:]
                continue
            while at[node] < len(edges_of[node]):
                edge = edges_of[node][at[node]]
                if left[edge] and level[target[edge]] == level[node] - 1:
                    path.append(edge)
                    node = target[edge]
                    break
                at[node] += 1
            else:
                if node == source:
                    break
                node = target[path.pop() ^ 1]
                at[node] += 1


def scored(html: str | None, weights: np.ndarray) -> tuple[Page, np.ndarray]:
    page = Page(html or "")
    scores = np.clip(page.features() @ weights, -MOST_SCORE, MOST_SCORE)
    return page, scores + np.array([page.evidence[node] for node in page.nodes])


def labelled(html: str | None, weights: np.ndarray) -> tuple[list[str], np.ndarray, list[bool]]:
    """Blocks of a page, their scores and whether they are content."""
    page, scores = scored(html, weights)
    return page.texts, scores, min_cut(np.rint(scores * SCALE).astype(int).tolist(), page.ties())


def fit(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES, fit_blocks: int = FIT_BLOCKS, shrinkage: float = SHRINKAGE) -> np.ndarray:
    """Weights of the features, from at most `fit_pages` different pages and `fit_blocks` blocks of each."""
    hashed = pages.select(named(html_col).alias("html")).withColumn("hash", F.xxhash64("html"))
    highest = hashed.select("hash").distinct().orderBy("hash").limit(fit_pages).agg(F.max("hash")).first()[0]
    if highest is None:
        return PRIOR
    columns = [f"x{i}" for i in range(len(FEATURES))]

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.zeros((0, len(FEATURES) + 1))]
            for html in batch["html"]:
                page = Page(html or "")
                features, places = page.features(), np.array([page.place(i) for i in range(len(page.texts))])
                known = np.flatnonzero(places >= 0)
                known = known[np.unique(np.linspace(0, len(known) - 1, min(fit_blocks, len(known))).astype(int))] if len(known) else known
                found.append(np.column_stack([features[known], places[known]]))
            yield pd.DataFrame(np.concatenate(found), columns=[*columns, "content"])

    sample = hashed.where(F.col("hash") <= highest).dropDuplicates(["hash"]).select("html")
    rows = sample.mapInPandas(examples, ", ".join(f"{x} double" for x in [*columns, "content"])).toPandas().to_numpy()
    rows = rows[np.lexsort(rows.T)]  # sums do not depend on the order of tasks
    return shrunk_logistic(rows[:, :-1], rows[:, -1], shrinkage)


def shrunk_logistic(x: np.ndarray, y: np.ndarray, shrinkage: float, rounds: int = 25) -> np.ndarray:
    """Logistic regression with both classes of equal weight, held near the prior by a quadratic penalty."""
    share = np.array([(y == 0).mean(), (y == 1).mean()]) if len(y) else np.zeros(2)
    if not share.all():
        return PRIOR
    row_weight = 0.5 / share[y.astype(int)] / len(y)
    weights = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (row_weight * (p - y)) + shrinkage * (weights - PRIOR)
        bend = (x * (row_weight * p * (1 - p))[:, None]).T @ x + shrinkage * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(weights, 6)


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """All blocks: page_id, block (from 0), text, score and whether it is content."""
    weights = fit(pages, html_col) if weights is None else weights

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                found = zip(*labelled(html, weights), strict=True)
                out += [(page_id, number, *block) for number, block in enumerate(found)]
            yield pd.DataFrame(out, columns=["page_id", "block", "text", "score", "content"]).astype({"page_id": object, "text": object})

    rows = pages.select(named(id_col).cast("string").alias("page_id"), named(html_col).alias("html"))
    found = rows.mapInPandas(cut, "page_id string, block int, text string, score double, content boolean")
    kind = pages.schema[id_col].dataType
    return found.withColumn("page_id", F.col("page_id").cast(kind))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights = fit(pages, html_col) if weights is None else weights

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            out = []
            for html in batch:
                texts, _, content = labelled(html, weights)
                out.append("\n".join(text for text, kept in zip(texts, content, strict=True) if kept))
            yield pd.Series(out, dtype=object)

    found = pages.select(named(id_col).alias("page_id"), named(url_col).alias("url"), extract(named(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
