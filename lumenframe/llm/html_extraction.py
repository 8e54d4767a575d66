"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. For each host a few exemplar pages (the least hashes of its pages, at most SLOTS)
give reference trees. Every page's tree of block elements is aligned with the exemplars by simple tree matching;
sums over all pages say for each exemplar node how many pages of its layout have it and how many have the same text there. Nodes
with the same text almost everywhere are template; the others are slots. Siblings of the same label are one node, whose
elements are matched by their text and counted each on its own. Copies of an exemplar (pages whose article
is the same or mostly the same) do not count, so a copied article does not look like a template.

Extraction aligns a page again and drops its template nodes. What varies is a slot, and so is what the exemplar does not
have. Slots are content unless they say that they are something else (navigation, footers, adverts, forms, comments
and so on, which vary too); where some say that they are the article, those. Their blocks are joined.

Exemplars and sums are one small row a host. They go to each worker once while their measured size is below
BROADCAST_BYTES, so that no page is shuffled; beyond that, pages and wrappers are joined by host with a plain join, whose hot hosts Spark can split.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import small_batches, staged

SLOTS = 3
BROADCAST_BYTES = 32 << 20
#: The same for the list of exemplars' keys, of about 50 bytes a row.
BROADCAST_ROWS = 400_000
#: A node is template if at least MATCHED other pages have it and SAME of them have the exemplar's text there.
MATCHED, SAME = 5, 0.8

#: Fixed values of HTML: elements without content, with raw content, and inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the key's kind closes, up to the elements that bound the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements, roles and words of class or id that say that a part is not the article.
NOT_TEXT = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe svg canvas object embed dialog menu noembed noframes audio video map".split())
NOT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOT_WORD = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar sidebars widget widgets ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations teaser comment comments commentlist disqus respond reply replies pagination pager searchform copyright skip hidden toolbar masthead".split()
)
HEAD_WORD = frozenset({"header", "head", "top", "topbar"})
MAIN_WORD = frozenset("article articlebody content entry post story main maincontent".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DIGITS = re.compile(r"\d+")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and pieces of text
    drop: bool = False

    def words(self) -> set[str]:
        return {w.lower() for a in ("class", "id") if a in self.attrs for w in PART.findall(self.attrs[a])}

    def label(self) -> str:
        return f"{self.tag}.{DIGITS.sub('#', self.attrs.get('class', ''))}" if self.attrs else self.tag


def parse(page: str) -> Node:
    """A forgiving tree: missing end tags are implied, stray ones ignored."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].children.append(entities.unescape(page[a:b]) if "&" in page[a:b] else page[a:b])

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            text(at, size)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                # An inline end tag does not end the blocks around it.
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag in P_CLOSERS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        elif tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in ends:
                    del stack[k:]
                    break
        raw = m[3]
        node = Node(tag, {a.lower(): entities.unescape(v1 or v2 or v3) for a, v1, v2, v3 in ATTRIBUTE.findall(raw)} if raw and raw.strip(" /") else {})
        stack[-1].children.append(node)
        if tag in VOID or raw.endswith("/") and tag not in INLINE | P_CLOSERS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            node.children.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else size
            continue
        stack.append(node)
    return root


def excluded(node: Node, inside: bool) -> bool:
    """Does the element say that it is not the article's text; inside: it stands in the article's element."""
    if node.drop or node.tag in NOT_TEXT:
        return True
    if node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body", "#root"):
        return False
    a = node.attrs
    if a.get("role", "").lower() in NOT_ROLE or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if "class" in a or "id" in a:
        words = node.words()
        if words & NOT_WORD:
            return True
        if words & HEAD_WORD and not inside and node.tag not in ("article", "main"):
            return True
    return False


def blocks(node: Node, inside: bool) -> list[str]:
    """Texts of the blocks below node, white space collapsed, in page order; excluded parts left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            t = " ".join("".join(line).split())
            if t:
                out.append(t)
            line.clear()

    work: list = [iter(node.children)]
    ends: list = [False]
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
            if ends.pop():
                flush()
        elif isinstance(child, str):
            line.append(child)
        elif child.tag in ("br", "wbr", "hr"):
            line.append(" " if child.tag != "wbr" else "")
            if child.tag == "hr":
                flush()
        elif not excluded(child, inside):
            block = child.tag not in INLINE
            if block:
                flush()
            work.append(iter(child.children))
            ends.append(block)
    flush()
    return out


def found(node: Node, wanted) -> list[Node]:
    """Outermost elements that wanted says, not looking into excluded ones."""
    out, work = [], [node]
    while work:
        n = work.pop()
        if wanted(n) and n is not node:
            out.append(n)
            continue
        work += [c for c in reversed(n.children) if not isinstance(c, str) and not excluded(c, wanted(n))]
    return out


def article_of(root: Node) -> list[Node]:
    """The elements that hold the article; the whole tree if nothing says so."""
    within = found(root, lambda n: n.tag == "main" or n.attrs.get("role") == "main") or [root]
    articles = [a for w in within for a in found(w, lambda n: n.tag == "article" or n.attrs.get("itemprop") == "articleBody")]
    if articles:
        if len(articles) == 1:
            return articles
        sizes = [sum(map(len, blocks(a, True))) for a in articles]
        best = articles[sizes.index(max(sizes))]
        return [a for a in articles if a.label() == best.label()]
    if within[0] is not root:
        return within
    named = found(root, lambda n: n.tag in ("div", "section", "td") and bool(n.words() & MAIN_WORD))
    return named or [root]


class Shape:
    """The tree of block elements: label, hash of the text below, children; runs of equal siblings are one node.

    members has the text hash of each sibling of a run, in order, and is empty where there is one.
    """

    __slots__ = ("label", "text", "children", "nodes", "members", "index")

    def __init__(self, label: str, text: int, children: list[Shape], nodes: list[Node] | None = None, members: list[int] | None = None):
        self.label, self.text, self.children, self.nodes, self.members, self.index = label, text, children, nodes or [], members or [], -1

    def number(self) -> list[Shape]:
        flat, work = [], [self]
        while work:
            s = work.pop()
            s.index = len(flat)
            flat.append(s)
            work += reversed(s.children)
        return flat

    def dump(self) -> list:
        """The nodes in document order, each with its number of children."""
        return [[s.label, s.text, s.members, len(s.children)] for s in self.number()]

    @classmethod
    def load(cls, raw: list) -> Shape:
        rest: list[Shape] = []
        for label, text, members, n in reversed(raw):
            rest.append(cls(label, text, [rest.pop() for _ in range(n)], None, members))
        return rest[0]


#: A run's elements are numbered after it: node * RUN + 1, 2 and so on; the run as a whole is node * RUN.
RUN = 1 << 20


def text_hash(node: Node) -> int:
    """Hash of all text below; 0 if there is none."""
    out, work = [], [node]
    while work:
        n = work.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in RAW:
            if n.tag not in INLINE:
                out.append(" ")
                work.append(" ")
            work += reversed(n.children)
    text = " ".join("".join(out).split())
    return xxhash.xxh3_64_intdigest(text) if text else 0


def parts_of(nodes: list[Node]) -> tuple[list[list[Node]], str]:
    """The runs of block elements right below the nodes, and the text that stands in none of them."""
    groups: list[list[Node]] = []
    texts: list[str] = []
    for n in nodes:
        for c in n.children:
            if isinstance(c, str):
                texts.append(c)
            elif c.tag in INLINE:
                work = [c]
                while work:
                    for x in work.pop().children:
                        if isinstance(x, str):
                            texts.append(x)
                        elif x.tag not in RAW:
                            work.append(x)
            elif c.tag not in RAW:
                if groups and groups[-1][0].label() == c.label():
                    groups[-1].append(c)
                else:
                    groups.append([c])
    return groups, " ".join("".join(texts).split())


def shape_of(nodes: list[Node]) -> Shape:
    """The shape of one element, or of a run of siblings with the same label, however deep it goes."""
    found_: list[tuple[list[Node], str, list[int]]] = []
    work = [(nodes, -1)]
    while work:
        own, above = work.pop()
        groups, text = parts_of(own)
        if above >= 0:
            found_[above][2].append(len(found_))
        work += [(g, len(found_)) for g in reversed(groups)]
        found_.append((own, text, []))
    shapes: list[Shape] = [None] * len(found_)  # type: ignore[list-item]
    for k in range(len(found_) - 1, -1, -1):
        own, text, below = found_[k]
        children = [shapes[c] for c in below]
        some = text or any(c.text for c in children)
        print_ = xxhash.xxh3_64_intdigest(f"{text}|{'|'.join(str(c.text) for c in children)}") if some else 0
        shapes[k] = Shape(own[0].label(), print_, children, own, [text_hash(n) for n in own] if len(own) > 1 else None)
    return shapes[0]


def match(a: Shape, b: Shape, memo: dict) -> int:
    """Simple tree matching: the size of the largest alignment that keeps order and depth; memo gets its choices.

    A pair of nodes comes up from the pair of their parents only, so the pairs in reverse order of discovery have all
    pairs below them done.
    """
    if a.label != b.label:
        return 0
    work = [(a, b)]
    for x, y in work:
        work += [(c, d) for c in x.children for d in y.children if c.label == d.label]
    for x, y in reversed(work):
        m, n = len(x.children), len(y.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        took = [[False] * (n + 1) for _ in range(m + 1)]
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                below = memo.get((x.children[i - 1].index, y.children[j - 1].index))
                up = max(best[i - 1][j], best[i][j - 1])
                if below and best[i - 1][j - 1] + below[0] > up:
                    best[i][j], took[i][j] = best[i - 1][j - 1] + below[0], True
                else:
                    best[i][j] = up
        pairs, i, j = [], m, n
        while i and j:
            if took[i][j]:
                pairs.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif best[i - 1][j] >= best[i][j - 1]:
                i -= 1
            else:
                j -= 1
        memo[(x.index, y.index)] = (best[m][n] + 1, pairs)
    return memo[(a.index, b.index)][0]


def aligned(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Score and all matched pairs of two numbered shapes."""
    memo: dict = {}
    score = match(a, b, memo)
    out, work = [], [(a, b)] if score else []
    while work:
        x, y = work.pop()
        out.append((x, y))
        work += memo[(x.index, y.index)][1]
    return score, out


class Wrapper:
    """Exemplars of a host and, once counted, the template nodes of each."""

    def __init__(self, raw: str):
        slots = json.loads(raw)
        self.shapes = [Shape.load(s["shape"]) for s in slots]
        self.sizes = [len(s.number()) for s in self.shapes]
        self.template = [set(s.get("template", ())) for s in slots]
        self.articles = [set(s["article"]) for s in slots]

    def alignments(self, shape: Shape) -> list[tuple[int, list[tuple[Shape, Shape]]]]:
        shape.number()
        return [aligned(shape, s) for s in self.shapes]

    def align(self, shape: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
        tried = self.alignments(shape)
        best = max(range(len(tried)), key=lambda k: (tried[k][0], -k)) if tried else -1
        return best, tried[best][1] if tried else []


#: Parsed wrappers that a worker keeps, up to this many bytes of their JSON.
KEPT_BYTES = 8 << 20
_WRAPPERS: dict[str, Wrapper] = {}


def wrapper(raw: str) -> Wrapper:
    if raw not in _WRAPPERS:
        if sum(map(len, _WRAPPERS)) + len(raw) > KEPT_BYTES:
            _WRAPPERS.clear()
        _WRAPPERS[raw] = Wrapper(raw)
    return _WRAPPERS[raw]


def block_hashes(root: Node) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) for a in article_of(root) for t in blocks(a, True)]


def exemplar(page: str) -> dict:
    root = parse(page)
    return {"shape": shape_of([root]).dump(), "article": sorted(set(block_hashes(root)))}


def counted(page: str, own: Wrapper) -> list[tuple[int, int, bool]]:
    """(exemplar, node, same text) of what aligned, for every exemplar that shares at least half of its nodes with the page.

    A page counts for all exemplars of its layout, so that each has as many pages to learn from as the layout has;
    it counts for none of which it is a copy.
    """
    root = parse(page)
    shape = shape_of([root])
    hashes = block_hashes(root)
    out = []
    for slot, (score, pairs) in enumerate(own.alignments(shape)):
        if 2 * score < own.sizes[slot] or hashes and 2 * sum(h in own.articles[slot] for h in hashes) > len(hashes):
            continue
        out += [(slot, y.index * RUN, x.text == y.text) for x, y in pairs if y.text]
        for x, y in pairs:
            if y.members:
                have = set(x.members or [text_hash(n) for n in x.nodes])
                out += [(slot, y.index * RUN + k, h in have) for k, h in enumerate(y.members, 1) if h]
    return out


def main_text(page: str, own: Wrapper | None) -> str:
    root = parse(page)
    if own is not None and any(own.template):
        slot, pairs = own.align(shape_of([root]))
        for x, y in pairs:
            if y.index * RUN in own.template[slot] and x.text == y.text:
                for n in x.nodes:
                    n.drop = n.tag not in ("#root", "html", "body")
            elif same := {h for k, h in enumerate(y.members, 1) if y.index * RUN + k in own.template[slot]}:
                for n, h in zip(x.nodes, x.members or [text_hash(n) for n in x.nodes], strict=True):
                    n.drop = n.drop or h in same
    return " ".join(t for a in article_of(root) for t in blocks(a, a.tag != "#root"))


HOST = r"^[a-z][a-z0-9+.-]*://([^/?#]*)"


def prepared(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return own.withColumn("host", F.coalesce(F.regexp_extract(F.lower("url"), HOST, 1), F.lit("")))


def exemplars(rows: DataFrame) -> DataFrame:
    """(host, wrapper): up to SLOTS exemplars of each host as JSON."""
    printed = rows.select("host", "html", F.xxhash64("page_id", "html").alias("h")).withColumn("slot", F.pmod(F.xxhash64("h"), F.lit(SLOTS)))
    least = staged(printed.groupBy("host", "slot").agg(F.min("h").alias("h")), "least")
    chosen = printed.join(F.broadcast(least) if least.count() <= BROADCAST_ROWS else least, ["host", "slot", "h"])
    schema = pa.schema([("host", pa.string()), ("slot", pa.int64()), ("exemplar", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([json.dumps(exemplar(x.as_py())) for x in batch.column(2)], pa.string())], schema=schema)

    parsed = chosen.select("host", "slot", "html").mapInArrow(run, "host string, slot long, exemplar string")
    one = parsed.groupBy("host", "slot").agg(F.first("exemplar").alias("exemplar"))  # copies of an exemplar parse alike
    return one.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "exemplar"))).alias("own")).select("host", F.concat(F.lit("["), F.array_join("own.exemplar", ","), F.lit("]")).alias("wrapper"))


def beside(rows: DataFrame, wrappers: DataFrame) -> tuple[DataFrame, Callable[[str], str | None]]:
    """rows, and what gives a row's wrapper from its column of that name.

    If the measured size allows, the column holds the host and the wrappers go to each worker once; else a plain join
    by host, whose hot hosts Spark can split, puts the wrapper itself there.
    """
    size = wrappers.agg(F.sum(F.length("host") + F.length("wrapper")).alias("n")).first()["n"] or 0
    if size > BROADCAST_BYTES:
        return rows.join(wrappers, "host", "left"), lambda raw: raw
    known = rows.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})
    return rows.withColumn("wrapper", F.col("host")), lambda host: known.value.get(host)


def node_counts(rows: DataFrame, own: Callable[[str], str | None]) -> DataFrame:
    """(host, slot, node, matched, same) summed over all pages; rows has host, html and wrapper."""
    schema = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("slot", "node", "matched", "same"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        equal: Counter = Counter()

        def table() -> pa.RecordBatch:
            rows = [{"host": h, "slot": s, "node": n, "matched": c, "same": equal[(h, s, n)]} for (h, s, n), c in seen.items()]
            seen.clear()
            equal.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for host, page, key in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not (raw := own(key)):
                    continue
                for slot, node, same in counted(page, wrapper(raw)):
                    seen[(host, slot, node)] += 1
                    if same:
                        equal[(host, slot, node)] += 1
            if len(seen) > 100_000:
                yield table()
        yield table()

    parts = rows.select("host", "html", "wrapper").mapInArrow(run, "host string, slot long, node long, matched long, same long")
    return parts.groupBy("host", "slot", "node").agg(F.sum("matched").alias("matched"), F.sum("same").alias("same"))


def induced(wrappers: DataFrame, counts: DataFrame) -> DataFrame:
    """Wrappers with their template nodes."""
    template = counts.where((F.col("matched") >= MATCHED) & (F.col("same") >= SAME * F.col("matched"))).groupBy("host").agg(F.collect_list(F.struct("slot", "node")).alias("template"))
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, nodes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                slots = json.loads(raw)
                for s in slots:
                    s["template"] = []
                for x in nodes or ():
                    slots[x["slot"]]["template"].append(x["node"])
                for s in slots:
                    s["template"].sort()
                out.append(json.dumps(slots))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=schema)

    return wrappers.join(template, "host", "left").select("host", "wrapper", "template").mapInArrow(run, "host string, wrapper string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text.

    Null and empty pages have the text ''; a page of plain text is its own article. Pages without a readable host
    share the host ''. A host of few pages has no template nodes; what elements say about themselves still counts.
    Whole pages are read, of any length and depth; repeated rows give equal rows; an empty table gives none. Other columns are
    ignored.
    """
    small_batches(pages.sparkSession)
    rows = prepared(pages, id_col, url_col, html_col)
    first = staged(exemplars(rows), "exemplars")
    learned = staged(induced(first, node_counts(*beside(rows, first))), "wrappers")
    placed, own = beside(rows, learned)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, wrapper(raw) if (raw := own(key)) else None) for page, key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)

    return placed.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string")
