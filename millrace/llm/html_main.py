"""Main text of web pages by a tree-structured graphical model.

Each element of a page is a node with one of three states: MIXED (a wrapper), MAIN, or OTHER. A node's
tag, class and id words, link share and length speak for its state; a potential on each parent-child
pair says which states follow each other. Sum-product messages, upward and then downward, give exact
marginals, and a text belongs to the article if its element is most likely MAIN.

Both kinds of potentials are counts with smoothing, learned from labelled pages: pages of the corpus
whose own markup names the article, of which a bounded share is taken, and the example pages below,
which show the parts a corpus may happen not to have. Counting is a Spark aggregation; the counts are
bounded by the number of hashed features.

Edge cases: null or empty html, and html without text, give the empty text. Markup may end anywhere.
Comments, scripts, styles and the head never hold text. A head ends where anything begins that may not stand
in one. A silent element without an end tag ends where the next block begins, or with the block around it. Character references are decoded as browsers do.
White space (HTML's, as well as no-break and other Unicode spaces) inside a block is one space; blocks
are joined by one space. Rows are treated one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIXED, MAIN, OTHER = range(3)
FIT_PAGES = 2_000
BUCKETS = 4_096
EXAMPLE_WEIGHT = 40
SMOOTHING = 0.5
NAME_WEIGHT, PLAIN_WEIGHT, SHAPE_WEIGHT = 2.0, 0.08, 0.3
TEMPER = 0.5  # of the pair counts: parts inside parts are rarer in any corpus than they are surprising

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("head title script style noscript template svg iframe object select option textarea "
             "button audio video canvas datalist".split())
IN_HEAD = set("html head title base basefont bgsound link meta noscript noframes script style template".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section "
             "summary table tbody td tfoot th thead tr ul br".split())
CLOSES_P = BLOCKS - {"html", "body", "br", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
MATH = set("math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded "
           "mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd "
           "maction".split())
PLAIN = MATH | set("p h1 h2 h3 h4 h5 h6 b i em strong u s small sub sup code q cite span a li ul ol dl dt dd tr td th tbody "
            "blockquote pre figure figcaption label".split())  # as common outside the article as in it
WRAPPERS = set("div section center".split())  # only their names tell
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
          "option": {"select"}}

# Example pages. data-y is the state of an element and of all below it that name none.
EXAMPLES = (
    """<html data-y=x><body><header data-y=o class="site-header top"><a href=/>Home</a><p>Our site</p></header>
    <nav data-y=o class="menu navbar"><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
    <div id=wrapper class="container page"><div id=content class="post entry-content" data-y=m><h1>Head of it</h1>
    <p>A first paragraph of text that is long enough to be read as prose.</p><h2>More</h2><p>And a second with
    <a href=/x>a link</a> and <b>bold</b> words.</p><ul><li>point one<li>point two</ul><blockquote><p>Quoted.</p>
    </blockquote><div class="share social" data-y=o><a href=#>Share</a><span>Tweet</span></div></div>
    <div id=sidebar class="sidebar widget" data-y=o><h3>Recent</h3><p>About this site and its people.</p>
    <ul><li><a href=/c>Three</a></ul></div><div class="comments" id=comments data-y=o><h3>Comments</h3>
    <div class="comment reply"><p>I think this is a long and thoughtful remark by a reader of the page.</p></div>
    <div class="comment"><p>Another remark, just as long as the first one, by another reader.</p></div></div></div>
    <footer data-y=o class="footer bottom"><p>Copyright. All rights reserved.</p><a href=/p>Privacy</a></footer></body></html>""",
    """<html data-y=x><body><div class="cookie notice banner consent" data-y=o><p>We use cookies on this site to
    improve it.</p><button>OK</button></div><main><article data-y=m><header><h1>Title</h1></header><section>
    <p>Text of the article, a sentence or two of it.</p><p>Still more text here.</p><figure><figcaption>A picture
    </figcaption></figure><table><tr><td>cell</td><td>cell</td></tr></table><pre>code</pre></section>
    <aside data-y=o class="related promo"><h4>Read also</h4><p>Another story that you may like.</p></aside>
    <div class="ad advert advertisement sponsored" data-y=o><p>Buy this now for less money.</p></div></article></main>
    <aside data-y=o><h2>Popular</h2><p>Many people read this other thing.</p><ol><li><a href=/1>x</a></ol></aside>
    <form data-y=o class="search newsletter subscribe signup"><label>Mail</label><p>Sign up for news by mail.</p>
    <input></form><section data-y=o class="comments discussion responses" id=disqus><ol><li><p>Reader says a lot of
    things here at some length.</p><li><p>Reader answers with a lot of words as well.</p></ol></section></body></html>""",
    """<html data-y=x><body><table><tr><td data-y=o class="left menu"><a href=/>Home</a><a href=/n>News</a></td>
    <td class=main data-y=m><p>Plain old layout with the text in a cell.</p><p>It goes on for a while.</p></td>
    <td data-y=o class="right ads"><p>Advert text here.</p></td></tr></table><div data-y=o class="breadcrumb pager
    pagination meta byline tags"><a href=/>Home</a> &gt; <span>Here</span></div><div data-y=o class="popup modal overlay
    alert warning message notification" role=alert><p>Please note that this site is changing.</p></div></body></html>""",
    """<html data-y=x><body><div role=navigation data-y=o><p>Skip to the text</p></div><div role=main class="article
    story body text" data-y=m><h1>Words</h1><div class="paragraph lead"><p>The lead of the story.</p></div><div><p>Then
    the rest of it, on and on.</p><dl><dt>term<dd>meaning</dl></div></div><div role=complementary data-y=o><p>Side
    matter that is no part of it.</p></div><div role=contentinfo data-y=o><p>Imprint and legal terms.</p></div>
    <div role=banner data-y=o><p>The name of the site.</p></div></body></html>""",
    """<html data-y=x><body><h1 data-y=m>Bare</h1><p data-y=m>A page of plain text without any parts.</p><p data-y=m>Its
    second paragraph.</p><ul data-y=m><li>one<li>two</ul><blockquote data-y=m>Quoted.</blockquote><p data-y=m>Last.</p>
    <div data-y=x><p data-y=m>Text in a wrapper.</p><p data-y=m>More of it.</p><h2 data-y=m>Part</h2></div></body></html>""",
)


class Node:
    __slots__ = ("tag", "attrs", "up", "down", "texts", "chars", "linked")

    def __init__(self, tag: str, attrs: dict[str, str], up: int):
        self.tag, self.attrs, self.up, self.down = tag, attrs, up, []
        self.texts, self.chars, self.linked = 0, 0, 0


class Tree(HTMLParser):
    """Nodes in page order (a parent before its children), and the page's stream of texts and breaks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.loose: set[int] = set()  # silent elements that have no end tag of their own
        self._read(html)
        while not self.missed <= self.loose:
            self.loose |= self.missed
            self._read(html)
        for n in range(len(self.nodes) - 1, 0, -1):
            node, up = self.nodes[n], self.nodes[self.nodes[n].up]
            if node.tag == "a":
                node.linked = node.chars
            up.chars += node.chars
            up.linked += node.linked

    def _read(self, html: str) -> None:
        self.nodes = [Node("#", {}, -1)]
        self.stream: list[tuple[int, str | None]] = []  # (node, text), or None where a block begins or ends
        self.open = [0]
        self.missed: set[int] = set()
        self.inner: set[int] = set()  # those missed inside a silent element that is still open
        self.reset()
        self.feed(html)
        self.close()
        self._miss(1, False)

    def _silent(self) -> list[int]:
        """Depths of the open silent elements below a head."""
        return [d for d, n in enumerate(self.open) if self.nodes[n].tag in SILENT and self.nodes[n].tag != "head"]

    def _miss(self, depth: int, own: bool) -> None:
        """Note the silent elements that end at depth without their own end tag. own: the first of all has one."""
        silent = self._silent()
        self.inner.update(self.open[d] for d in silent if d > depth or d == depth and not own)
        if silent and silent[0] >= depth:
            if silent[0] > depth or not own:
                self.missed |= self.inner
            self.inner = set()

    def _end(self, depth: int, own: bool = False) -> None:
        self._miss(depth, own)
        if any(self.nodes[n].tag in BLOCKS for n in self.open[depth:]):
            self.stream.append((self.open[depth], None))
        del self.open[depth:]

    def _end_head(self) -> None:
        for depth, n in enumerate(self.open):
            if self.nodes[n].tag == "head":
                return self._end(depth)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[depth]].tag
            if tag in tags:
                return self._end(depth)
            if tag in stop:
                return None

    def handle_starttag(self, tag, attrs):
        silent = self._silent()
        if tag in BLOCKS and silent and all(self.open[d] in self.loose for d in silent):
            self._end(silent[0])
            silent = []
        if tag not in IN_HEAD and not silent:
            self._end_head()
        if tag in CLOSES_P and not silent:
            self._close({"p"}, {"table", "td", "th", "div", "li", "article", "section", "aside", "main", "blockquote"})
        if tag in CLOSED_BY and (tag == "option" or not silent):
            self._close(CLOSED_BY[tag], SCOPES[tag])
        up = self.open[-1]
        if tag in BLOCKS:
            self.stream.append((up, None))
        if tag in VOID:
            return
        self.nodes.append(Node(tag, {k: v or "" for k, v in attrs}, up))
        self.nodes[up].down.append(len(self.nodes) - 1)
        self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and any(self.nodes[n].tag in ("svg", "math") for n in self.open):
            self._end(len(self.open) - 1, own=True)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.nodes[self.open[depth]].tag == tag:
                return self._end(depth, own=True)

    def handle_data(self, data):
        if self.nodes[self.open[-1]].tag == "head" and data.strip():
            self._end_head()
        if any(self.nodes[n].tag in SILENT for n in self.open):
            return
        self.stream.append((self.open[-1], data))
        self.nodes[self.open[-1]].chars += len(data.strip())


NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def features(node: Node) -> list[str]:
    """What speaks for a node's state, with structure before size."""
    found = [f"tag {node.tag}"]
    for key in ("class", "id", "role", "itemprop"):
        found += {f"name {w.lower()}" for w in NAME_PART.findall(node.attrs.get(key, ""))}
    share = node.linked / node.chars if node.chars else 0.0
    found.append(f"links {min(3, int(share * 4))}")
    found.append(f"size {min(5, int(math.log(node.chars + 1, 6)))}")
    return found


def bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % BUCKETS


def example_states(tree: Tree) -> list[int]:
    states = [MIXED] * len(tree.nodes)
    for n, node in enumerate(tree.nodes[1:], 1):
        told = node.attrs.pop("data-y", None)
        states[n] = {"x": MIXED, "m": MAIN, "o": OTHER}[told] if told else states[node.up]
    return states


def landmark_states(tree: Tree) -> list[int] | None:
    """States of a page that names its one article, or nothing."""
    named = [n for n, node in enumerate(tree.nodes) if node.tag == "article"]
    if len(named) != 1 or not tree.nodes[named[0]].chars:
        return None
    states = [OTHER] * len(tree.nodes)
    at = named[0]
    while at >= 0:
        states[at] = MIXED
        at = tree.nodes[at].up
    states[named[0]] = MAIN
    apart = {"nav", "aside", "footer", "form"}
    for n, node in enumerate(tree.nodes[1:], 1):
        if n > named[0] and states[node.up] == MAIN and node.tag not in apart:
            states[n] = MAIN
    return states


def counts(tree: Tree, states: list[int], weight: int = 1) -> Counter:
    """(what, number, state) counts: 'f' a feature bucket, 'e' the parent's state (plus 3 for a plain child)."""
    found: Counter = Counter()
    for n, node in enumerate(tree.nodes[1:], 1):
        found["e", 3 * (node.tag in PLAIN) + states[node.up], states[n]] += weight
        found["n", 0, states[n]] += weight
        for f in features(node):
            found["f", bucket(f), states[n]] += weight
    return found


class Model:
    """Potentials from counts, and marginals of a page."""

    def __init__(self, told: Counter):
        kinds = [sum(v for (w, _, s), v in told.items() if w == "n" and s == y) for y in range(3)]
        seen = {b for (w, b, _) in told if w == "f"}
        self.unary = {b: [math.log((told["f", b, y] + SMOOTHING) / (kinds[y] + SMOOTHING * 50))
                          for y in range(3)] for b in seen}
        follow = [[(told["e", p, y] + SMOOTHING) ** TEMPER for y in range(3)] for p in range(6)]
        rows = [[v / sum(row) for v in row] for row in follow]
        self.pair = {False: rows[:3], True: rows[3:]}  # by whether the child's tag is a plain one
        self.cache: dict[str, list[float]] = {}

    def _evidence(self, node: Node) -> list[float]:
        total = [0.0, 0.0, 0.0]
        for f in features(node):
            own = self.cache.get(f)
            if own is None:
                raw = self.unary.get(bucket(f), [0.0] * 3)
                mean = sum(raw) / 3
                own = [v - mean for v in raw]
                if len(self.cache) < BUCKETS:
                    self.cache[f] = own
            if f.startswith("name "):
                weight = NAME_WEIGHT
            elif node.tag in PLAIN or node.tag in WRAPPERS:  # many small voices must not outvote a named part
                weight = PLAIN_WEIGHT
            else:
                weight = NAME_WEIGHT if f.startswith("tag ") else SHAPE_WEIGHT
            total = [a + weight * b for a, b in zip(total, own)]
        top = max(total)
        return [math.exp(v - top) for v in total]

    def marginals(self, tree: Tree) -> list[list[float]]:
        """P(state) of every node: messages from the leaves to the root, then back down."""
        nodes = tree.nodes
        pairs = [self.pair[n.tag in PLAIN] for n in nodes]
        belief = [self._evidence(n) for n in nodes]  # evidence times messages from below
        belief[0] = [1.0, 1e-6, 1e-6]
        upward = [[1.0] * 3 for _ in nodes]
        for n in range(len(nodes) - 1, 0, -1):
            b = belief[n]
            sent = [row[0] * b[0] + row[1] * b[1] + row[2] * b[2] for row in pairs[n]]
            top = max(sent)
            upward[n] = sent = [v / top for v in sent]
            above = belief[nodes[n].up]
            above = [x * y for x, y in zip(above, sent)]
            top = max(above)
            belief[nodes[n].up] = [v / top for v in above]
        out = [[0.0] * 3 for _ in nodes]
        total = sum(belief[0])
        out[0] = [v / total for v in belief[0]]
        for n in range(1, len(nodes)):
            rest = [p / max(u, 1e-300) for p, u in zip(out[nodes[n].up], upward[n])]  # the parent without this child
            down = [sum(rest[p] * pairs[n][p][y] for p in range(3)) for y in range(3)]
            own = [d * b for d, b in zip(down, belief[n])]
            total = sum(own) or 1.0
            out[n] = [v / total for v in own]
        return out


def main_text(model: Model, html: str | None) -> str:
    if not html:
        return ""
    tree = Tree(html)
    main = [m[MAIN] > max(m[MIXED], m[OTHER]) for m in model.marginals(tree)]
    blocks, now = [], []
    for n, text in tree.stream:
        if text is None:
            blocks.append("".join(now))
            now = []
        elif main[n]:
            now.append(text)
    blocks.append("".join(now))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Model:
    """Learn from the example pages and about fit_pages pages that name their article."""
    n = pages.count()
    some = pages.where(F.col("html").isNotNull())
    if n > fit_pages:
        some = some.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < (fit_pages << 30) // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for html in batch.column(0).to_pylist():
                tree = Tree(html)
                states = landmark_states(tree)
                if states:
                    total.update(counts(tree, states))
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([k[2] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.int64())],
                ["what", "number", "state", "n"])

    told = some.select("html").mapInArrow(run, "what string, number int, state int, n long")
    total: Counter = Counter()
    for r in told.groupBy("what", "number", "state").agg(F.sum("n").alias("n")).collect():  # at most 3 * BUCKETS + 12
        total[r["what"], r["number"], r["state"]] += r["n"]
    share = max(EXAMPLE_WEIGHT, sum(v for k, v in total.items() if k[0] == "n") // 400)
    for html in EXAMPLES:
        tree = Tree(html)
        total.update(counts(tree, example_states(tree), share))
    return Model(total)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(model, h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
