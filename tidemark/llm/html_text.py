"""Operator 7: main text of web pages by tree scoring.

A page is cut into tags and text and built into a tree of blocks, with the end tags that HTML lets authors leave out. Scripts, styles,
menus, headers, footers, sidebars, forms, notices, adverts and reader comments are cut off by tag, role, or class and id names; a name counts by
its last word that isn't a place or a shape ("site-header-left" is a header, "alert-systems" is no alert), and an element so named
by a word among others ("article-share") stays if it holds most of the page's text and no comments. Every paragraph with text gives points (one, one for each comma, one for each 100 characters
up to three) to its parent, half of them to its grandparent and a third and less to those above; a container's points are discounted by the share of its text
inside links. The containers with a fifth of the best one's own points are good; the element that holds them all stands for the article or main
element around it, if there is one. Else it is kept whole if it is good itself, with those siblings that score a fifth of it, or are text
paragraphs, headings, lists, quotations, tables, preformatted text or figures of few links; and if it isn't, what is kept are its parts that hold a
good container or are such siblings. All blocks in what is kept are the text, in page order.

Reading is linear in the length of the page: open elements are kept by tag, so no tag walks the tree, and a tag that never ends ends the page.

White space inside a block is one space; blocks are joined by an empty line. Null and empty pages, and pages without text, give an empty
text. Broken markup is read as browsers roughly do; nothing is cut off by length. Repeated rows are extracted each; an empty table gives
an empty result; other columns are kept, columns named as output columns are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, slices, table, texts_of

# Fixed values of HTML and of this operator.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br picture source".split())
CUT = frozenset("head script style noscript template nav header footer aside form button select textarea input iframe object embed svg math canvas audio video map menu dialog title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promoted related remark "
    "replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget disclaimer gdpr alert".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd section div article main body h1 h2 h3 h4 h5 h6 figcaption".split())
#: Words of names that say where or in what shape something stands, not what it is; and names that no length of text saves.
PLACES = frozenset(
    "main left right top bottom upper lower inner outer wrap wrapper container content box bar list links buttons icons slot area section block widget item items group row column col panel page site global primary secondary desktop mobile fixed sticky js id".split()
)
DISCUSSION = frozenset("comment comments commentlist disqus replies".split())
#: Siblings of the best container that are kept whatever their points, if few of their letters stand in links.
STANDING = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl blockquote table pre figure".split())
#: A start tag ends these open elements, not beyond the second set.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "body": ("head", "html")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
P_BARRIER = frozenset("td th table button article section div aside nav body html object blockquote li".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)|<!--|<[!?]")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element; parts are its texts and elements in page order."""

    __slots__ = ("tag", "parent", "parts", "points", "own", "length", "linked", "cut", "named", "good")

    def __init__(self, tag: str, parent: Node | None, cut: bool, named: bool = False):
        self.tag, self.parent, self.parts, self.cut, self.named = tag, parent, [], cut, named
        self.points = self.own = 0.0
        self.length = self.linked = self.good = 0


def _name(token: str) -> tuple[str, bool]:
    """The word that says what a class or id is, and whether it has no other word than names and places."""
    words = [w.lower() for w in WORDS.findall(token)]
    return next((w for w in reversed(words) if w not in PLACES), ""), all(w in PLACES or w in NAMES for w in words)


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is cut off, and whether it is by its name, so that much text saves it."""
    if tag in CUT:
        return True, False
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False, False
    named = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            found = [(w, plain) for w, plain in map(_name, value.split()) if w in NAMES]
            if any(plain or w in DISCUSSION for w, plain in found):
                return True, False
            named = named or bool(found)
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return False, named


class _Open:
    """The open elements, in order and by tag."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        """Close all elements from this depth on."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def deepest(self, tags: frozenset[str]) -> int:
        return max((at[-1] for t in tags if (at := self.at.get(t))), default=0)

    def start(self, tag: str) -> None:
        """Close what the start tag ends."""
        if tag in CLOSES_P and (p := self.deepest(_P)) > self.deepest(P_BARRIER) and not self.stack[-1].cut:
            self.cut(p)
        if tag in CLOSES:
            ends, barrier = CLOSES[tag]
            if (depth := self.deepest(ends)) > self.deepest(barrier):
                self.cut(depth)
                while self.stack[-1].tag in ends:
                    self.cut(len(self.stack) - 1)

    def end(self, tag: str) -> None:
        """Close an element; a stray inline end tag closes no block."""
        if (at := self.at.get(tag)) and (tag not in INLINE or at[-1] > self.blocks[-1]):
            self.cut(at[-1])


_P = frozenset({"p"})


def parse(page: str) -> Node:
    """The tree of a page; what hangs below a cut element isn't built."""
    root = Node("#root", None, False)
    open_ = _Open(root)
    pos, n = 0, len(page)
    last = {c: page.rfind(c) for c in "\"'>"}
    no_raw_end: set[str] = set()

    def tag_end(at: int) -> int:
        """Where the tag ends whose name ends here: at the first > outside quotes; a quote that never closes counts for nothing."""
        while at <= last[">"]:
            m = STOP.search(page, at)
            if m[0] == ">":
                return m.start()
            at = page.find(m[0], m.end()) + 1 if m.end() <= last[m[0]] else m.end()
        return -1

    while pos < n:
        m = TAG.search(page, pos)
        end = m.start() if m else n
        at = open_.stack[-1]
        if end > pos and not at.cut:
            at.parts.append(page[pos:end])
        if not m:
            break
        if m[0] == "<!--":
            close = page.find("-->", m.end())
            pos = n if close < 0 else close + 3
            continue
        if not m[2]:
            close = page.find(">", m.end())
            pos = n if close < 0 else close + 1
            continue
        if (close := tag_end(m.end())) < 0:
            break
        pos, tag, attributes = close + 1, m[2].lower(), page[m.end() : close]
        if m[1]:
            open_.end(tag)
            continue
        open_.start(tag)
        at = open_.stack[-1]
        if tag in RAW:
            found = None if tag in no_raw_end else re.compile(rf"</{tag}\b", re.I).search(page, pos)
            if not found:
                no_raw_end.add(tag)
                pos = n
                continue
            close = page.find(">", found.start())
            pos = n if close < 0 else close + 1
        elif tag in VOID:
            if not at.cut:
                at.parts.append((" " if tag == "br" else "") if tag in INLINE else Node(tag, at, False))
        else:
            cut, named = (True, False) if at.cut else _unwanted(tag, attributes)
            node = Node(tag, at, cut, named)
            if not cut:
                at.parts.append(node)
            if not (attributes.endswith("/") and tag in ("svg", "math")):
                open_.push(node)
    return root


def _decoded(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


def _post_order(root: Node) -> list[Node]:
    """Elements, each behind those inside it."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in node.parts if isinstance(p, Node)]
    return out[::-1]


def measure(root: Node) -> None:
    """Lengths of the texts of all elements, and of what stands in links."""
    for node in _post_order(root):
        node.length = node.linked = 0
        for p in node.parts:
            if isinstance(p, Node):
                node.length += p.length
                node.linked += p.length if p.tag == "a" else p.linked
            else:
                node.length += len(" ".join(_decoded(p).split()))


def without_named(root: Node) -> None:
    """Cut off elements by name, but for those that hold most of the page's text outside links."""
    order = _post_order(root)
    if not any(x.named for x in order):
        return
    measure(root)
    most = (root.length - root.linked) / 2
    for node in order:
        if any(isinstance(p, Node) and p.named for p in node.parts):
            node.parts = [p for p in node.parts if not (isinstance(p, Node) and p.named and p.length - p.linked <= most)]


def score(root: Node) -> list[Node]:
    """Fill lengths and points; the containers that got points."""
    got: list[Node] = []
    measure(root)
    for node in _post_order(root):
        if node.tag not in PARAGRAPHS:
            continue
        own, commas = 0, 0
        for p in node.parts:
            if isinstance(p, Node):
                own += p.length if p.tag in INLINE else 0
            else:
                text = " ".join(_decoded(p).split())
                own += len(text)
                commas += sum(map(text.count, ",،、，"))
        if own:
            points = 1 + commas + min(own / 100, 3)
            up, share = node.parent, 1.0
            for level in range(4):
                if up is None:
                    break
                if not up.points:
                    got.append(up)
                up.points += points * share
                up.own += points if level == 0 else 0
                up, share = up.parent, 0.5 if level == 0 else 1 / (3 * (level + 1))
    return got


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def _good_top(root: Node, got: list[Node]) -> tuple[Node, bool]:
    """The element that holds all good containers, and whether it is one."""
    own = lambda x: x.own * (1 - _density(x))
    least = 0.2 * max(map(own, got))
    good = {id(x) for x in got if x.own and own(x) >= least}
    for node in _post_order(root):
        node.good = (id(node) in good) + sum(p.good for p in node.parts if isinstance(p, Node))
    top = root
    while id(top) not in good:
        inside = [p for p in top.parts if isinstance(p, Node) and p.good == len(good)]
        if not inside:
            break
        top = inside[0]
    return top, id(top) in good


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks of nodes, in page order; inline elements belong to the block around them."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            if text := " ".join(_decoded("".join(run)).split()):
                out.append(text)
            run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        part = stack.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag in INLINE:
            stack += reversed(part.parts)
        else:
            close()
            stack.append(None)
            stack += reversed(part.parts)
    close()
    return out


def main_text(page: str) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    without_named(root)
    got = score(root)
    if not got:
        return "\n\n".join(blocks([root]))
    top, good = _good_top(root, got)
    around = top
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around is not None:  # the whole article
        return "\n\n".join(blocks([around]))
    value = lambda x: x.points * (1 - _density(x))
    of, least = top, 0.2 * max(map(value, got))
    if good:
        if top.parent is None or top.tag == "body":
            return "\n\n".join(blocks([top]))
        of, least = top.parent, 0.2 * value(top)

    def beside(x: Node) -> bool:
        few = _density(x) < 0.25
        paragraph = x.tag == "p" and (x.length > 80 and few or 0 < x.length <= 80 and not x.linked)
        return x.points > 0 and value(x) >= least or paragraph or x.tag in STANDING and x.length > 0 and few

    return "\n\n".join(blocks([x for x in of.parts if isinstance(x, Node) and (x is top or x.good or beside(x))]))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars (code points)."""
    bounded_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(raw := texts_of(batch, column), 4_000_000):
                texts = [main_text(x) for x in raw[a:b]]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
