"""Main text of web pages by a tree-structured graphical model.

The DOM is a tree of binary variables: node is content or not. Every node has a
potential from its features (tag kind, name hints in class, id and role, text
length, share of linked text), every parent-child pair one of four by their
states. Messages pass upward from the leaves and downward from the root
(sum-product), which gives each node's exact content marginal; text under a node
whose marginal reaches one half is kept.

The potentials are trained by gradient ascent on the likelihood of labelled
pages: the gradient is the features' labelled counts less their expected counts
under the marginals. Labels come from pages that mark their article up; each
trains also in variants, in which its menus, adverts and footers stand inside the
article or hold paragraphs, and in which the article is a plain container or none,
so that name hints, text shape and the states of parents count too. At most SAMPLE pages train (the least by hash of url); all
pages are extracted, whole.

Scripts, styles, templates, comments and markup hold no text. Inline elements
without a hint belong to the block around them. Character references are decoded
by the HTML rules, white space in a block becomes one space, blocks are trimmed
and joined by one space. Unclosed and crossed tags close with their container.
Null or empty pages have an empty text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 150
EPOCHS = 12
# Tag kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_ONLY = frozenset("script style textarea title".split())  # unclosed, these reach to the page's end
RAW = frozenset("script style noscript template title textarea iframe svg select object canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var".split())
FRAME = frozenset("nav header footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption ul ol li dl dt dd table thead tbody tfoot tr td th caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())  # links may fill these
CLOSES_P = FRAME | MAIN | PARAGRAPH | frozenset("div section address hr details summary center".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
             "option": {"option"}, "p": {"p"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
# Words in class, id and role names that mark page furniture, and such that mark the text.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion "
    "promoted outbrain taboola nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc header masthead topbar "
    "footer foot bottom copyright legal sidebar sidebars aside rail widget widgets related recommended recommendations popular trending "
    "notice notices notification alert cookie cookies consent gdpr popup modal overlay dialog newsletter subscribe subscription signup login "
    "register form search share sharing social follow comment comments commentlist disqus reply replies respond discussion reactions "
    "hidden skip complementary contentinfo tooltip print toolbar tags tagcloud paywall disclaimer".split())
TEXT_NAMES = frozenset("article content main body text entry post story paragraph lead".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<(?=/?[A-Za-z])[^<>]*\Z", re.S)
# Behind the last ">" no tag can end.
TAIL = re.compile(r"<!--.*\Z|<[!?].*\Z|<(?=/?[A-Za-z])[^<>]*\Z", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


class Node:
    __slots__ = ("parent", "tag", "hint", "good", "hidden", "chars", "linked", "words", "children")

    def __init__(self, parent: int, tag: str, hint: bool, good: bool, hidden: bool):
        self.parent, self.tag, self.hint, self.good, self.hidden = parent, tag, hint, good, hidden
        self.chars = self.linked = self.words = self.children = 0


def _names(attributes: str) -> tuple[bool, bool, bool]:
    if not attributes.strip("/ \t\r\n"):
        return False, False, False
    hint = good = False
    for m in NAMES.finditer(attributes):
        for part in PART.findall(m[1] or m[2] or m[3] or ""):
            part = part.lower()
            hint |= part in FURNITURE
            good |= part in TEXT_NAMES
    return hint, good, bool(HIDDEN.search(attributes))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Nodes of the DOM (block elements, and inline ones with a hint) in page order, and its text runs as (node, text);
    a run whose text is None is a block's border."""
    nodes = [Node(-1, "", False, False, False)]
    runs: list[tuple[int, str | None]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    links, at, end, last = 0, 0, len(page), page.rfind(">")
    unclosed: set[str] = set()

    def text(a: int, b: int) -> None:
        if a < b:
            node = stack[-1][1]
            piece = page[a:b]
            runs.append((node, piece))
            n = len(piece.strip())
            nodes[node].chars += n
            nodes[node].words += piece.count(" ")
            if links:
                nodes[node].linked += n

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            tag, _ = stack.pop()
            links -= tag == "a"
            if tag not in INLINE:
                runs.append((stack[-1][1], None))

    while at < end:
        m = (TOKEN.search(page, at, last + 1) if at <= last else None) or TAIL.search(page, max(at, last + 1))
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        tag = m.re is TOKEN and (m[2] or m[5])
        if not tag:
            if at == last + 1 and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>")):
                break  # an unclosed comment reaches to the page's end
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                runs.append((stack[-1][1], None))
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in TEXT_ONLY:
                    at = end
                else:
                    unclosed.add(tag)  # the tag alone goes, not what follows it
            runs.append((stack[-1][1], " "))
            continue
        ends = SAME_ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if ends:
            for depth in range(len(stack) - 1, 0, -1):
                inner = stack[depth][0]
                if inner in ends:
                    pop_to(depth)
                    break
                if inner not in INLINE and inner not in ("td", "th", "tr", "tbody", "thead") or inner in FRAME | MAIN:
                    break
        parent = stack[-1][1]
        hint, good, hidden = _names(attributes)
        if tag in INLINE:
            links += tag == "a"
            if not (hint or hidden):
                if not attributes.endswith("/"):
                    stack.append((tag, parent))
                continue
        else:
            runs.append((parent, None))
        nodes[parent].children += 1
        nodes.append(Node(parent, tag, hint, good, hidden))
        if not attributes.endswith("/") or tag not in VOID:
            stack.append((tag, len(nodes) - 1))
    return nodes, runs


KINDS = 16


def features(nodes: list[Node]) -> list[tuple[int, ...]]:
    """Indices of the features each node has."""
    out = []
    for x in nodes:
        f = [0]
        if x.tag in FRAME:
            f.append(1)
        elif x.tag in MAIN:
            f.append(2)
        elif x.tag in PARAGRAPH:
            f.append(3)
        elif x.tag in ("", "html", "body", "head"):
            f.append(4)
        else:
            f.append(5)
        if x.hint and x.tag not in MAIN and x.tag != "body" and x.tag != "html":
            f.append(6)
        if x.good and not x.hint:
            f.append(7)
        if x.hidden:
            f.append(8)
        f.append(9 if not x.chars else 10 if x.chars < 40 else 11 if x.chars < 160 else 12)
        if x.chars:
            f.append(13 if 2 * x.linked > x.chars and x.tag not in PROSE else 14)
        if x.words > 15:
            f.append(15)
        out.append(tuple(f))
    return out


class Model:
    """Feature weights (for state content against not) and the 2 x 2 log potentials of parent and child states."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = [float(w) for w in weights], [[float(v) for v in row] for row in pair]

    def messages(self, nodes: list[Node], feats: list[tuple[int, ...]]) -> tuple[list[float], list[tuple[float, float, float]]]:
        """Content marginals of all nodes; and, for training, pair marginals (parent 1 child 0, 0-1, 1-1) of all but the root."""
        w = self.weights
        (e00, e01), (e10, e11) = [[math.exp(v) for v in row] for row in self.pair]
        n = len(nodes)
        own = [math.exp(max(-30.0, min(30.0, sum([w[i] for i in f])))) for f in feats]  # odds of content
        inside = own[:]  # own potential times the children's messages, as odds
        up = [1.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parent
            b = inside[i] = min(max(inside[i], 1e-150), 1e150)
            up[i] = (e10 + e11 * b) / (e00 + e01 * b)
            p = nodes[i].parent
            inside[p] = min(max(inside[p] * up[i], 1e-150), 1e150)
        belief = inside[:]
        pairs = [(0.0, 0.0, 0.0)] * n
        for i in range(1, n):
            rest = belief[nodes[i].parent] / up[i]  # the parent's odds without this child
            b = inside[i]
            p00, p01, p10, p11 = e00, e01 * b, rest * e10, rest * e11 * b
            z = p00 + p01 + p10 + p11
            pairs[i] = (p10 / z, p01 / z, p11 / z)
            belief[i] = min(max((p01 + p11) / (p00 + p10), 1e-150), 1e150)
        return [b / (1 + b) for b in belief], pairs


def labels_of(nodes: list[Node]) -> list[int] | None:
    """Content or not of every node by a page's own markup: under an article and under no furniture; None without an article."""
    if not any(x.tag in MAIN for x in nodes):
        return None
    out = [0] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        bad = x.tag in FRAME or x.hint and x.tag not in MAIN or x.hidden
        out[i] = int((x.tag in MAIN or out[x.parent]) and not bad)
    return out


def _variants(nodes: list[Node], y: list[int]) -> Iterator[tuple[list[Node], list[int]]]:
    """The labelled page and made-up ones like it.

    Furniture stands where it was or inside the article, and is as it was or
    holds a copy of the article's blocks (then not content); the article is
    marked up, a plain container, or bare, its blocks right under its parent
    (whose line up to the root then counts as content).
    """
    main = next((i for i, x in enumerate(nodes) if x.tag in MAIN and y[i]), None)
    if main is None:
        return
    children: dict[int, list[int]] = {}
    for j, x in enumerate(nodes[1:], 1):
        children.setdefault(x.parent, []).append(j)
    furniture = [i for i, x in enumerate(nodes) if i and not y[i] and (x.tag in FRAME or x.hint) and not y[x.parent]]
    above, at = set(), nodes[main].parent
    while at >= 0:
        above.add(at)
        at = nodes[at].parent

    def copied(inside: bool, shape: str, stuffed: bool) -> tuple[list[Node], list[int]]:
        made: list[Node] = []
        labels: list[int] = []
        todo = [(0, -1, False)]
        while todo:
            i, parent, dead = todo.pop()
            x = nodes[i]
            kids = [j for j in children.get(i, ()) if not (inside and j in furniture)]
            if i == main and not dead:
                kids = kids + furniture if inside else kids
                if shape == "bare":
                    todo.extend((j, parent, False) for j in reversed(kids))
                    continue
            if stuffed and i in furniture and not dead:
                todo.extend((j, len(made), True) for j in children.get(main, ()) if y[j])
            c = Node(parent, "div" if shape == "plain" and i == main else x.tag, x.hint, x.good and shape == "marked", x.hidden)
            c.chars, c.linked, c.words, c.children = x.chars, x.linked, x.words, x.children
            labels.append(int(not dead and (y[i] or shape == "bare" and i in above)))
            todo.extend((j, len(made), dead) for j in reversed(kids))
            made.append(c)
        return made, labels

    for inside in (False, True):
        for shape in ("marked", "plain", "bare"):
            yield copied(inside, shape, inside == (shape != "bare"))


def train(pages: list[str], epochs: int = EPOCHS) -> Model:
    """Fit the potentials to the marked-up ones among ``pages`` (a bounded sample) by AdaGrad on the tree likelihood."""
    cases = []
    for page in pages:
        nodes, _ = parse(page)
        y = labels_of(nodes)
        if y is not None:
            cases += [(n, features(n), labels) for n, labels in _variants(nodes, y)]
    theta = np.zeros(KINDS + 4)
    theta[:KINDS][[1, 6, 8]] = -1.0
    theta[KINDS:] = (0.5, -0.5, -0.5, 0.5)
    past = np.full(len(theta), 1e-6)
    for _ in range(epochs):
        for nodes, feats, y in cases:
            model = Model(theta[:KINDS], theta[KINDS:].reshape(2, 2))
            p, pairs = model.messages(nodes, feats)
            grad = -0.01 * theta
            for i, f in enumerate(feats):
                grad[list(f)] += y[i] - p[i]
                if i:
                    q10, q01, q11 = pairs[i]
                    q = nodes[i].parent
                    grad[KINDS:] -= (1 - q10 - q01 - q11, q01, q10, q11)
                    grad[KINDS + 2 * y[q] + y[i]] += 1
            past += grad * grad
            theta += 0.4 * grad / np.sqrt(past)
    return Model(theta[:KINDS], theta[KINDS:].reshape(2, 2))


def extract(page: str | None, model: Model) -> str:
    """The page's main text."""
    if not page:
        return ""
    nodes, runs = parse(page)
    p, _ = model.messages(nodes, features(nodes))
    blocks: list[str] = []
    open_: list[str] = []
    for node, piece in runs:
        if piece is None:
            if open_:
                blocks.append("".join(open_))
                open_ = []
        elif p[node] >= 0.5:
            open_.append(piece)
    if open_:
        blocks.append("".join(open_))
    done = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in done if b)


def fit(pages: DataFrame, sample: int = SAMPLE, column: str = "html", key: str = "url") -> Model:
    """Train on at most ``sample`` pages with a marked-up article."""
    marked = pages.where(F.col(column).rlike(r"(?i)<(article|main)[\s>]")).select(column, F.xxhash64(key, column).alias("h"))
    return train([r[0] for r in marked.orderBy("h").limit(sample).collect()])  # `sample` rows at most


def main_text(pages: DataFrame, model: Model, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``column`` as ``into`` (replaced if present); rows and other columns stay."""
    pages = pages.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(t, model) for t in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, into])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(into, T.StringType())]))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages, fit(pages)).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
