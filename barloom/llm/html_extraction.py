"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that can hold text is a node with one of three states: frame (the page around its parts), content, or boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments). A node's emission is a naive Bayes product over its tag, the words
of its class, id and role, and the length, links and sentence marks of its own text. A potential for each pair of states connects parent and child.
Messages go up from the leaves and down from the root (sum-product), which gives every node's marginals; text of nodes whose content marginal
is largest is kept.

Both tables are counts over labelled pages: the hand-labelled layouts below, and pages of the input that label themselves by sectioning
elements (``article`` or ``main``; ``nav``, ``footer``, ``aside``, ``form`` ...), of which ``SAMPLE`` different ones at most are used, those of the least hashes.

Cases: null, empty or text-free html: empty text. Unclosed, crossing and stray tags are tolerated; ``script``, ``style``, ``title``, comments and the
like hold no text. A page of text without tags is content. Character references are decoded; white space inside a block becomes one space; blocks are joined by one newline, in page order.
Repeated rows are extracted each; other columns of the input are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

SAMPLE, SMOOTH, VOCABULARY = 300, 0.05, 5000
FRAME, CONTENT, BOILER = range(3)
# Elements of HTML by how they behave.
RAW = "script style textarea title iframe noembed noframes xmp".split()
SILENT = frozenset("noscript template svg math object select canvas audio video datalist button".split())
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th", "tbody", "thead"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
SCOPES = frozenset("ul ol dl table section article main aside nav div body header footer form td th blockquote figure".split())
OWN_LABEL = {"nav": BOILER, "footer": BOILER, "aside": BOILER, "form": BOILER, "dialog": BOILER, "article": CONTENT, "main": CONTENT}
#: Hand-labelled layouts: ``y`` labels an element and all below it (c content, b boilerplate); what is not labelled is frame.
LAYOUTS = [
    "<body><header y=b class='site-header masthead' id=header role=banner><div class=logo>Name</div><h1>Site name</h1><p>A tagline of the site.</p></header>"
    "<div id=wrapper class='container page'><main y=c id=main role=main class=content>{h}{p}{p}{l}{p}</main><aside y=b class='sidebar widget-area' role=complementary>{box}{links}</aside></div>"
    "<footer y=b id=footer class='site-footer' role=contentinfo><p>{short}</p>{links}</footer></body>",
    "<body><div y=b class='top-bar navbar nav menu' id=nav role=navigation>{links}</div><div class=row><div y=c class='post-content entry-content article-body' id=content>{h}{p}{p}{q}{p}"
    "<div y=b class='share social buttons'>{links}</div></div><div y=b id=comments class='comments comment-list responses discussion'><h3>{short}</h3>{comment}{comment}</div></div>"
    "<div y=b class='footer copyright legal'>{short}</div></body>",
    "<body><div y=b class='cookie-banner consent notice gdpr' id=cookie role=dialog><p>{s}</p><button>{short}</button></div><div y=b class='ad ads advert advertisement banner sponsor sponsored promo'>{s}</div>"
    "<article y=c class='story post hentry'><header><h1>{short}</h1></header>{p}{p}<figure><figcaption>{s}</figcaption></figure>{p}<div y=b class='ad advert promotion'>{s}</div>{p}{t}</article>"
    "<div y=b class='related recommended more-links popular'>{links}</div><div y=b class='newsletter subscribe signup popup modal overlay'><p>{s}</p><form>{short}</form></div></body>",
    "<body>{cp}{cp}{cp}</body>",
    "<body y=c>{x}</body>",
    "<body><h1 y=c>{short}</h1><p y=c>{x}</p><h2 y=c>{short}</h2><p y=c>{s}</p><ul y=c><li>{s}</li><li>{short}</li></ul><h2 y=c>{short}</h2><p y=c>{x}</p></body>",
    "<body><div y=c class=post-body><h2>{short}</h2><p>{x}</p><h3>{short}</h3>{l}<p>{s}</p></div><div y=b class='sidebar'>{links}</div></body>",
    "<body><div id=page><div y=c class='entry' id=article><h1>{short}</h1>{p}{l}<h2>{short}</h2><p>{s}</p>{p}</div></div></body>",
    "<body><p y=c>{x}</p><p y=c>{x}</p><hr><p y=b class=copyright>{short}</p></body>",
    "<body><table><tr><td y=b class=menu>{links}</td><td y=c class=text>{h}{p}{p}</td></tr></table><div y=b class=footer>{s}</div></body>",
    "<body><nav y=b class='breadcrumb breadcrumbs'>{links}</nav><div class='site main-wrapper'><section y=c class='article text body'>{h}{p}{l}{p}</section><section y=b class='comments'>{comment}{comment}</section>"
    "<section y=b class='pagination pager tags tag-list meta byline toc skip-link'>{links}</section></div></body>",
    "<body><form y=b class='search login' role=search><label>{short}</label><p>{s}</p></form><div class=layout><div y=c class='main post story single'>{h}{p}{q}{t}</div><div y=b class='side rail sidebar'>{box}</div></div></body>",
    "<body><div y=b class='alert warning message announcement notice notification' role=alert><p>{s}</p></div><div y=c class=document>{h}{p}{p}<pre>{x}</pre>{p}</div><div y=b class='author-bio about-author profile'><p>{s}</p></div></body>",
    "<body><dialog y=b><p>{s}</p></dialog><div><div y=c><h2>{short}</h2><div>{x}</div><div>{x}</div></div></div><ol y=b class='commentlist replies reply'>{comment}</ol></body>",
    "<body><div y=b hidden><p>{s}</p></div><div class=page><div y=b style='display:none' class=box><p>{x}</p></div><div y=c class=text>{p}{p}<p>{s}</p></div><div y=b aria-hidden=true><p>{s}</p>{links}</div></div></body>",
    # parts that say nothing of themselves
    "<body><div y=c><p>{x}</p><p>{s}</p></div></body>",
    "<body><div y=c><div><p>{s}</p><p>{x}</p><div><p>{x}</p></div></div></div></body>",
    "<body><div y=c><div><div><div><h1>{short}</h1><p>{s}</p><p>{s}</p><p>{x}</p></div></div></div></div></body>",
    "<body><div><div y=c><h1>{short}</h1><p>{s}</p><p>{x}</p></div><div y=b class='comments'>{comment}</div></div></body>",
    "<body><div y=b class=nav>{links}</div><div y=c><p>{s}</p><p>{x}</p></div><div y=b class=footer>{short}</div></body>",
    # a site's header has no class here, and an article's own is content
    "<body><header y=b><h1>{short}</h1></header><article y=c><h1>{short}</h1>{p}<p>{s}</p></article></body>",
    "<body><header y=b><h1>{short}</h1></header><main y=c><header><h1>{short}</h1></header>{p}<p>{s}</p></main><footer y=b>{short}</footer></body>",
    "<body><header y=b><p>{short}</p></header><div y=c class=text><h1>{short}</h1>{p}<p>{s}</p></div></body>",
    "<body><header y=b><h1>{short}</h1><p>{s}</p></header><main y=c>{p}<h2>{short}</h2>{p}</main></body>",
    "<body><header y=b><h1>{short}</h1>{links}</header><article y=c><header><h1>{short}</h1></header>{p}{p}</article></body>",
    "<body><header y=b><h1>{short}</h1></header><div y=c><h1>{short}</h1><p>{s}</p><p>{x}</p></div></body>",
    "<body><header y=b><h1>{short}</h1><h2>{short}</h2></header><main y=c><h1>{short}</h1><p>{s}</p><p>{x}</p></main></body>",
    # words of boilerplate on parts of the content
    "<body><article y=c><h1>{short}</h1><p>{x}</p><ul class='links'><li>{s}</li><li>{x}</li></ul><p class='comment-lead'>{x}</p><p class='promo-lead'>{s}</p></article></body>",
    "<body><main y=c><h1>{short}</h1><p class='comment-lead'>{s}</p><p class='promo-lead lead'>{x}</p><ul class='links related'><li>{s}</li></ul><p>{x}</p></main></body>",
    "<body><div y=c class='blog page-content wiki'>{h}<p>{x}</p><dl><dt>{short}</dt><dd>{x}</dd></dl><h3>{short}</h3>{p}</div><div y=b class='disclaimer terms privacy'><p>{s}</p></div></body>",
]
_PIECES = {
    "{cp}": "<p y=c>{x}</p>", "{p}": "<p>{x}</p>", "{h}": "<h1>{short}</h1>", "{q}": "<blockquote><p>{x}</p></blockquote>", "{l}": "<ul><li>{s}</li><li>{s}</li></ul>",
    "{t}": "<table><tr><td>{short}</td><td>{s}</td></tr></table>", "{links}": "<ul><li><a href=x>{short}</a></li><li><a href=x>{short}</a></li></ul><a href=x>{short}</a>",
    "{box}": "<div class='widget box'><h4>{short}</h4><p>{s}</p></div>", "{comment}": "<div class='comment reply' id=comment-1><p>{x}</p><p>{s}</p></div>",
    "{x}": "Many words, which tell a story in a sentence or in two of them. They go on for a while, as prose does, and end here.", "{s}": "One sentence of a few more words.", "{short}": "Two words",
}

# A quote opens a value only behind an equals sign.
_ATTRIBUTES = r"""(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW)})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|(?=<body[\s/>])|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|y)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACES = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?;:,]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "chars", "linked", "marks", "label")

    def __init__(self, tag: str, attrs: str, parent: int) -> None:
        self.tag, self.attrs, self.parent, self.chars, self.linked, self.marks, self.label = tag, attrs, parent, 0, 0, False, None


def parse(page: str) -> tuple[list[Node], list[tuple[int, str] | None]]:
    """Nodes (parents first), and the pieces of text with their nodes; None breaks blocks."""
    nodes, pieces, stack, links, at, silent = [Node("html", "", -1)], [], [("html", 0)], 0, 0, 0

    def text(raw: str) -> None:
        if raw and not silent:
            raw = html.unescape(raw)
            pieces.append((stack[-1][1], raw))
            n = len(raw.strip())
            if n:
                node = nodes[stack[-1][1]]
                node.chars += n
                node.linked += n if links else 0
                node.marks = node.marks or _SENTENCE.search(raw) is not None

    def leave(k: int) -> None:
        nonlocal links, silent
        links -= sum(t == "a" for t, _ in stack[k:])
        silent -= sum(t in SILENT for t, _ in stack[k:])
        del stack[k:]

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                pieces.append(None)
            continue
        closing, attrs, inline = m[2], m[4] or "", tag in INLINE or tag in ("noscript", "svg", "math", "select", "button")
        if not inline and tag not in ("br", "wbr", "img", "input"):
            pieces.append(None)
        elif tag == "br":
            pieces.append((stack[-1][1], " "))
        if tag in VOID or tag in ("html", "head") or attrs.endswith("/") and (silent or tag in FOREIGN):
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if not inline and not silent:
            gone = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k][0]
                if t == "p" or t in gone:
                    leave(k)
                elif t in SCOPES:
                    break
        if tag in SILENT:
            silent += 1
        if tag == "a":
            links += 1
        if attrs.endswith("/") and inline:
            continue
        if inline and not _NAMED.search(attrs):
            stack.append((tag, stack[-1][1]))
        else:
            nodes.append(Node(tag, attrs, stack[-1][1]))
            stack.append((tag, len(nodes) - 1))
    text(page[at:])
    return nodes, pieces


def traits(node: Node, known: set[str] | None = None) -> tuple[str, ...]:
    """The tag and whether it is bare of words, the (known) words of class, id and role, and what kind of text the node itself has."""
    words = {f"w:{p.lower()}" for m in _NAMED.finditer(node.attrs) if m[1].lower() != "y" for p in _PART.findall(m[2])}
    if node.attrs and _HIDDEN.search(node.attrs):
        words.add("hidden")
    words = words if known is None else words & known
    n = node.chars
    size = "none" if not n else "short" if n < 25 else "line" if n < 80 else "long"
    link = "" if not n else "links" if 2 * node.linked > n else "some" if node.linked else "free"
    return (f"t:{node.tag}{'' if words else ':bare'}", *sorted(words), f"n:{size}:{link}:{'marks' if node.marks else ''}")


class Model:
    """Logarithms of emissions of traits, and potentials between the states of parent and child."""

    def __init__(self) -> None:
        self.seen: Counter = Counter()
        self.pairs, self.states, self.roots = [[SMOOTH] * 3 for _ in range(3)], [0.0] * 3, [SMOOTH, SMOOTH, 0.0]
        self.memory: dict = {}

    def learn(self, nodes: list[Node], labels: list[int]) -> None:
        self.count("root", "", labels[0])
        for node, y in zip(nodes, labels, strict=True):
            self.count("state", "", y)
            for t in traits(node):
                self.count("trait", t, y)
            if node.parent >= 0:
                self.count("pair", str(labels[node.parent]), y)

    def count(self, kind: str, a: str, y: int, n: float = 1.0) -> None:
        if kind == "trait":
            self.seen[a, y] += n
        elif kind == "pair":
            self.pairs[int(a)][y] += n
        else:
            (self.states if kind == "state" else self.roots)[y] += n

    def ready(self) -> Model:
        # what is plainly marked stays what it is below: no text of a boilerplate part is content
        self.potential = [[x / sum(row) for x in row] for row in self.pairs]
        self.known = {t for t, _ in self.seen}
        return self

    def emission(self, node: Node) -> tuple[float, float, float]:
        key = (node.tag, node.attrs, min(node.chars, 80) if node.chars >= 80 or node.chars < 25 and not node.chars else (25 if node.chars >= 25 else 1), 2 * node.linked > node.chars, node.linked > 0, node.marks)
        found = self.memory.get(key)
        if found is None:
            x = [0.0] * 3
            for t in traits(node, self.known):
                if t in self.known:
                    for y in range(3):
                        x[y] += math.log((self.seen[t, y] + SMOOTH) / (self.states[y] + 20 * SMOOTH))
            top = max(x)
            if len(self.memory) > VOCABULARY:
                self.memory.clear()
            found = self.memory[key] = tuple(math.exp(v - top) for v in x)
        return found

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """Each node's probabilities of the three states; the root is no boilerplate."""
        n, psi = len(nodes), self.potential
        belief = [list(self.emission(x)) for x in nodes]
        belief[0] = [b * r for b, r in zip(belief[0], self.roots, strict=True)]
        up: list = [None] * n
        for i in range(n - 1, 0, -1):
            b = belief[i]
            s = b[0] + b[1] + b[2]
            b[0], b[1], b[2] = b[0] / s, b[1] / s, b[2] / s
            m = up[i] = [row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in psi]
            p = belief[nodes[i].parent]
            p[0], p[1], p[2] = p[0] * m[0], p[1] * m[1], p[2] * m[2]
            s = p[0] + p[1] + p[2] or 1.0
            p[0], p[1], p[2] = p[0] / s, p[1] / s, p[2] / s
        for i in range(1, n):
            p, m, b = belief[nodes[i].parent], up[i], belief[i]
            q = [p[k] / m[k] if m[k] else 0.0 for k in range(3)]
            b = [b[k] * (q[0] * psi[0][k] + q[1] * psi[1][k] + q[2] * psi[2][k]) for k in range(3)]
            s = sum(b) or 1.0
            belief[i] = [x / s for x in b]
        return belief


def labels_of(nodes: list[Node], own: bool) -> list[int] | None:
    """Labels from ``y`` attributes or, with ``own``, from sectioning elements; None if the page has no labelled content."""
    out: list[int] = []
    for node in nodes:
        above = out[node.parent] if node.parent >= 0 else FRAME
        y = {m[1].lower(): m[2].strip("\"'") for m in _NAMED.finditer(node.attrs)}.get("y")
        mark = OWN_LABEL.get(node.tag) if own else {"c": CONTENT, "b": BOILER}.get(y)
        if own and node.tag == "header" and above == FRAME:
            mark = BOILER
        out.append(BOILER if above == BOILER else mark if mark is not None else above)
    if CONTENT not in out:
        return None
    if own:
        # a part beside the content that says nothing of itself: its words are learnt as boilerplate
        holds = [False] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            holds[nodes[i].parent] |= holds[i] or out[i] == CONTENT
        for i, node in enumerate(nodes):
            if out[i] == FRAME and i and (out[node.parent] == BOILER or not holds[i] and node.chars):
                out[i] = BOILER
    return out


def layouts() -> list[str]:
    out = []
    for page in LAYOUTS:
        for _ in range(3):
            for k, v in _PIECES.items():
                page = page.replace(k, v)
        out.append(page)
    return out


def _counts(pages: DataFrame) -> DataFrame:
    """(kind, a, b, n): what ``Model.learn`` counts over pages that label themselves, each page in its task: traits with states, and states of parents and children."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for page in batch.column("html").to_pylist():
                nodes = parse(page)[0]
                labels = labels_of(nodes, own=True)
                if not labels:
                    continue
                n["root", "", labels[0]] += 1
                for node, y in zip(nodes, labels, strict=True):
                    n.update([("state", "", y), *(("trait", t, y) for t in traits(node))])
                    if node.parent >= 0:
                        n["pair", str(labels[node.parent]), y] += 1
            kind, a, b = zip(*n, strict=True) if n else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(n.values(), pa.int64())], ["kind", "a", "b", "n"])

    return pages.select("html").mapInArrow(of, "kind string, a string, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def train(pages: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """Count over the layouts and, weighing as much in all, over at most ``sample`` of the pages that label themselves; of these only counts reach the driver."""
    model, hand = Model(), [parse(p)[0] for p in layouts()]
    for nodes in hand:
        model.learn(nodes, labels_of(nodes, own=False))
    for k in ("{x}", "{s}", "{short}"):  # pages without tags
        model.learn(parse(_PIECES[k])[0], [CONTENT])
    if pages is not None:
        some = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).withColumn("h", F.xxhash64("html"))
        chosen = [r.h for r in some.select("h").distinct().orderBy("h").limit(sample).collect()]
        if chosen:
            rows = _counts(some.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html"))).collect()
            weight = min(1.0, sum(map(len, hand)) / max(1, sum(r.n for r in rows if r.kind == "state")))
            for kind, a, b, n in sorted(rows):
                model.count(kind, a, b, weight * n)
    return model.ready()


def extract(page: str | None, model: Model) -> str:
    if not page:
        return ""
    nodes, pieces = parse(page)
    keep = [m[CONTENT] >= max(m) for m in model.marginals(nodes)]
    blocks, now = [], []
    for p in (*pieces, None):
        if p is not None:
            if keep[p[0]]:
                now.append(p[1])
        elif now:
            line = _SPACES.sub(" ", "".join(now)).strip()
            if line:
                blocks.append(line)
            now = []
    return "\n".join(blocks)


def main_text(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h, model) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(of, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train(pages))
