"""Main text of web pages by wrapper induction.

Each page is aligned with up to REFERENCES pages of its host by simple tree
matching: two nodes match if their labels do, and the children of matched nodes
are aligned in order so that most nodes match.  References of another layout
(fewer than half of the nodes match) don't count.  Blocks that stand at matched
nodes with the same text in the references are the template; what differs or
has no counterpart fills a slot.  Summed over the pages of the host, the slots'
text tells the content region: from the root down, the element that holds most
of it, as long as what a step leaves behind are other parts of the page and not
paragraphs beside it, nor headings; an `article` or `main` is not divided.
Extraction takes the blocks of that region in page order without the template's
constants, that is blocks that alignment found on nearly all pages of the host.
A page that has no counterpart, or lacks its host's region, is measured on its
own.

Alignment can't tell an advert or a comment that changes from page to page from
an article.  There tags, roles and class names mark what is no content; menus,
footers and hidden parts always, other marks (forms, sidebars, class names) only
if a page keeps paragraphs without the marked element: what holds nearly all of
a page's text is its content whatever it is called.

Each page is parsed once, where it was read; blocks and sums are written to the
shared folder.  What hosts share (reference pages, wrappers) is broadcast if a
count shows that it is small, and joined by a shuffle otherwise.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.scratch import materialize

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|["'].*|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe template".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - frozenset("body caption dd dt html legend li option summary tbody td tfoot th thead tr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist"), "p": ("article", "aside", "blockquote", "div", "footer", "form", "header", "li", "main", "nav", "section", "td", "th")}
# --- fixed values: marks of what is no content: elements that never hold any, elements, roles and names that may ---
_NEVER = frozenset("nav footer head select button dialog menu svg object canvas audio video datalist".split())
_RARELY = frozenset("aside form header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation sidebar cookie cookies notice consent gdpr comment comments disqus respond footer header masthead breadcrumb breadcrumbs share sharing social related newsletter subscribe subscription widget popup modal overlay login signup search pagination pager toolbar skip".split())
#: Strength of a mark, and the least ratio of unmarked text to a marked element's at which it is believed: a part of a compound name, a name or an element, and what never is content.
WEAK, PLAIN, SURE = 1, 2, 3
BELIEVED = {WEAK: 0.34, PLAIN: 0.05}
#: Characters in paragraphs that an element must hold to be taken for content in spite of its mark.
PARAGRAPH_CHARS = 200
_WHOLE = frozenset("html body main article".split())
_CONTENT = re.compile(r"(^|/)(article|main)(/|$)")
#: Labels of a path, and levels below which nodes are compared as wholes when trees are matched.
PATH_LABELS, MATCH_DEPTH = 64, 150
#: Cells up to which the table of an alignment is kept; longer levels are aligned in halves, in linear space.
TABLE_CELLS = 1 << 22
#: Pages of a host that each page is aligned with.
REFERENCES = 3
#: A block is a template constant of a host if it is the same on this share of at least that many aligned pages.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 5


#: Characters of reference pages, and bytes of wrappers, up to which these are broadcast.
BROADCAST_CHARS, BROADCAST_BYTES = 16 << 20, 8 << 20
#: Characters up to which a page is preferred as a reference.
SHORT_PAGE = 1 << 16


class Node:
    """An element: label is its tag, for generic elements with the first class. blocks are the texts that it holds directly."""

    __slots__ = ("blocks", "children", "label", "labels", "mark", "parent", "path", "signature", "size", "tag")

    def __init__(self, tag: str, label: str, parent: Node | None, mark: int):
        self.tag, self.label, self.parent, self.mark = tag, label, parent, mark
        self.children: list[Node] = []
        self.blocks: list[int] = []
        self.path, self.labels = label, 1
        if parent:  # nested elements of one label share a path, and so does what lies very deep
            grows = parent.labels < PATH_LABELS and not (parent.label == label and parent.path.endswith(label))
            self.path = f"{parent.path}/{label}" if grows else parent.path
            self.labels = parent.labels + grows
        self.size, self.signature = 1, 0


@lru_cache(50_000)
def _mark(tag: str, attrs: str, heads_content: bool) -> tuple[str, int]:
    """The label, and how surely what is inside is no content; heads_content: it stands in an article or main."""
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    label = f"{tag}.{names[0]}" if found.get("class", "").strip() and tag in ("div", "section", "td", "table", "ul", "ol") else tag
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return label, SURE
    if tag in _NEVER:
        return label, SURE
    if tag == "header" and heads_content:
        return label, 0
    if tag in _RARELY or found.get("role") in _ROLES:
        return label, PLAIN
    if tag in ("html", "body", "main") or tag == "article" and not any(n.startswith(("comment", "reply")) for n in names):
        return label, 0
    if any(n in _NAMES or n in ("reply", "replies") and tag == "article" for n in names):
        return label, PLAIN
    return label, WEAK if any(part in _NAMES for n in names for part in re.split(r"[_-]+", n)) else 0


class Page:
    """The tree of a page and its blocks: (element that holds it, text, it is outside the content)."""

    def __init__(self, source: str):
        self.root = Node("#", "", None, 0)
        self.blocks: list[tuple[Node, str, bool]] = []
        self._inner: list[Node] = []
        self._parse(source)
        self._settle()

    def _parse(self, source: str) -> None:
        node = self.root
        pieces: list[str] = []
        at, end = 0, len(source)

        def flush() -> None:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                holder = node
                while holder.tag not in _BLOCK and holder.parent:
                    holder = holder.parent
                holder.blocks.append(len(self.blocks))
                self.blocks.append((holder, text, False))
                self._inner.append(node)

        open_: Counter = Counter()  # open elements by tag

        def shut(tag: str) -> None:
            """Close the innermost open element of a tag, and all within."""
            nonlocal node
            while True:
                closed, node = node, node.parent
                open_[closed.tag] -= 1
                if closed.tag == tag:
                    return

        while at < end:
            m = _TOKEN.search(source, at)
            if not m:
                pieces.append(source[at:])
                break
            if m.start() > at:
                pieces.append(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[4] != ">":  # cut off inside a tag
                break
            if m[1]:
                if tag in _BLOCK:
                    flush()
                if open_[tag]:
                    shut(tag)
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if tag in _BLOCK:
                flush()
            for kinds, bounds in ([(("p",), _BOUNDS["p"])] if tag in _ENDS_P else []) + ([(_CLOSES[tag], _BOUNDS[tag])] if tag in _CLOSES else []):
                if any(open_[k] for k in kinds):
                    up = node
                    while up.parent and up.tag not in kinds and up.tag not in bounds:
                        up = up.parent
                    if up.parent and up.tag in kinds:
                        shut(up.tag)
            if tag in _VOID or m[3].endswith("/"):
                continue
            read = _mark if len(m[3]) <= 400 else _mark.__wrapped__  # attributes may be long, what is remembered not
            label, mark = read(tag, m[3], tag == "header" and bool(_CONTENT.search(node.path)))
            child = Node(tag, label, node, mark)
            if tag in _BLOCK or child.mark:  # inline elements only matter where they hide their text
                node.children.append(child)
            node = child
            open_[tag] += 1
        flush()

    def _settle(self) -> None:
        """Which blocks are outside the content: under a mark that is believed."""
        above: dict[int, Node | None] = {id(self.root): None}  # an element's outermost mark
        ignored: set[int] = set()

        def outermost(node: Node) -> Node | None:
            way = []
            while id(node) not in above:
                way.append(node)
                node = node.parent
            top = above[id(node)]
            for n in reversed(way):
                top = top or (n if n.mark and id(n) not in ignored else None)
                above[id(n)] = top
            return top

        while True:
            tops = [outermost(n) for n in self._inner]
            chars, paragraphs, tops_by_id, rest = Counter(), Counter(), {}, 0
            for (holder, text, _), top in zip(self.blocks, tops):
                if top is None:
                    rest += len(text)
                else:
                    tops_by_id[id(top)] = top
                    chars[id(top)] += len(text)
                    paragraphs[id(top)] += len(text) * (holder.tag not in ("li", "option", "label", "legend", "td", "th", "dt"))
            doubted = [k for k, n in chars.items() if tops_by_id[k].mark < SURE and rest < BELIEVED[tops_by_id[k].mark] * n and paragraphs[k] >= PARAGRAPH_CHARS]
            if not doubted:
                break
            ignored.add(max(doubted, key=lambda k: chars[k]))
            above = {id(self.root): None}
        self.blocks = [(h, t, top is not None) for (h, t, _), top in zip(self.blocks, tops)]

    def sign(self) -> Page:
        """Sizes and structure hashes, bottom up."""
        order, stack = [], [self.root]
        while stack:
            n = stack.pop()
            order.append(n)
            stack += n.children
        for n in reversed(order):
            n.size = 1 + sum(c.size for c in n.children)
            n.signature = hash((n.label, *(c.signature for c in n.children)))
        return self


def _split_ends(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many children at the front and the back have the same structure: matching those costs nothing."""
    n = min(len(a), len(b))
    front = 0
    while front < n and a[front].signature == b[front].signature:
        front += 1
    back = 0
    while back < n - front and a[-1 - back].signature == b[-1 - back].signature:
        back += 1
    return front, back


def tree_match(a: Node, b: Node, memo: dict[tuple[int, int], int], depth: int = 0) -> int:
    """Number of node pairs of the best simple tree matching of a and b."""
    if a.label != b.label:
        return 0
    if a.signature == b.signature:
        return a.size
    if depth >= MATCH_DEPTH:
        return 1
    key = (a.signature, b.signature)
    if key not in memo:
        front, back = _split_ends(a.children, b.children)
        total = 1 + sum(c.size for c in a.children[:front]) + sum(c.size for c in a.children[len(a.children) - back :])
        mid_a, mid_b = a.children[front : len(a.children) - back], b.children[front : len(b.children) - back]
        memo[key] = total + sum(w for _, _, w in _align(mid_a, mid_b, memo, depth + 1))
    return memo[key]


def _align(a: list[Node], b: list[Node], memo: dict, depth: int = 0) -> list[tuple[Node, Node, int]]:
    """Pairs of children in order with the largest sum of matches."""
    if not a or not b:
        return []
    if len(a) == len(b) == 1:
        w = tree_match(a[0], b[0], memo, depth)
        return [(a[0], b[0], w)] if w else []
    kinds_a, kinds_b = ({c.signature: c for c in side} for side in (a, b))
    place = {k: i for i, k in enumerate(kinds_b)}
    row_of = {k: np.array([tree_match(x, y, memo, depth) for y in kinds_b.values()]) for k, x in kinds_a.items()}
    of_b = np.array([place[y.signature] for y in b])
    weight = lambda x, lo, hi: row_of[x.signature][of_b[lo:hi]]

    def table(rows: list[Node], lo: int, hi: int, back: bool = False) -> Iterator[np.ndarray]:
        """Best sums of the first rows with the first columns, row by row; back: of the last ones."""
        last = np.zeros(hi - lo + 1, np.int64)
        yield last
        for x in reversed(rows) if back else rows:
            w = weight(x, lo, hi)
            w = w[::-1] if back else w
            now = np.zeros_like(last)
            now[1:] = np.maximum.accumulate(np.maximum(last[1:], np.where(w > 0, last[:-1] + w, 0)))
            last = now
            yield last

    def solve(i0: int, i1: int, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        if i0 == i1 or lo == hi:
            return
        if (i1 - i0) * (hi - lo) > TABLE_CELLS and i1 - i0 > 1:
            mid = (i0 + i1) // 2
            *_, head = table(a[i0:mid], lo, hi)
            *_, tail = table(a[mid:i1], lo, hi, back=True)
            cut = lo + int(np.argmax(head + tail[::-1]))
            yield from solve(i0, mid, lo, cut)
            yield from solve(mid, i1, cut, hi)
            return
        rows = list(table(a[i0:i1], lo, hi))
        i, j, found = i1 - i0, hi - lo, []
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((i0 + i, lo + j, int(rows[i + 1][j + 1] - rows[i][j])))
        yield from reversed(found)

    return [(a[i], b[j], w) for i, j, w in solve(0, len(a), 0, len(b))]


def same_layout(page: Page, reference: Page, memo: dict) -> bool:
    """At least half of the nodes of the two pages match."""
    return 4 * tree_match(page.root, reference.root, memo) >= page.root.size + reference.root.size


def template_blocks(page: Page, reference: Page, memo: dict | None = None) -> set[int]:
    """The blocks of the page that the reference has at the matching node with the same text."""
    same: set[int] = set()
    memo = {} if memo is None else memo
    stack = [(page.root, reference.root, 0)]
    while stack:
        a, b, depth = stack.pop()
        if a.blocks and b.blocks:
            texts = [reference.blocks[i][1] for i in b.blocks]
            left = Counter(texts) if len(texts) > 1 else {texts[0]: 1}
            for i in a.blocks:
                text = page.blocks[i][1]
                if left.get(text, 0) > 0:
                    left[text] -= 1
                    same.add(i)
        if not a.children or not b.children:
            continue
        if a.signature == b.signature:
            stack += zip(a.children, b.children, repeat(depth + 1))
            continue
        front, back = _split_ends(a.children, b.children)
        pairs = [*zip(a.children[:front], b.children[:front]), *(zip(a.children[-back:], b.children[-back:]) if back else ())]
        pairs += ((x, y) for x, y, _ in _align(a.children[front : len(a.children) - back], b.children[front : len(b.children) - back], memo, depth + 1))
        stack += ((x, y, depth + 1) for x, y in pairs)
    return same


def _place(holder: Node) -> str:
    """The path of the element that a block's holder stands in."""
    return holder.parent.path if holder.parent and holder.tag not in _WHOLE else holder.path


def _masses(page: Page, skip: set[int]) -> dict[str, list[int]]:
    """Text that fills slots, for each element path from the root down: [in it, directly in it, headings in it]."""
    out: dict[str, list[int]] = {}
    for i, (holder, text, outside) in enumerate(page.blocks):
        if outside or i in skip:
            continue
        path = _place(holder)
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            at = out.setdefault("/".join(parts[:n]), [0, 0, 0])
            at[0] += len(text)
            at[1] += len(text) * (n == len(parts))
            at[2] += holder.tag == "h1"
    return out


#: Share of the slots' text that a region holds at least, share of headings, and share of its text beside its parts that keeps a region whole.
REGION_TEXT, REGION_HEADINGS, REGION_WHOLE = 0.6, 0.5, 0.1


def _region(masses: dict[str, list[int]]) -> str | None:
    """The content region; see the module's description."""
    total, _, headings = masses.get("", (0, 0, 0))
    chain = sorted((p for p, (n, _, h) in masses.items() if n >= REGION_TEXT * total and h >= REGION_HEADINGS * headings), key=lambda p: p.count("/"))
    if not total or not chain:
        return None
    whole = (p for p in chain if masses[p][1] >= REGION_WHOLE * masses[p][0] or re.search(r"(^|/)(article|main)$", p))
    return next(whole, chain[-1])


def _key(path: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_BLOCKS = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("key", pa.int64())]))
_NAMES_OUT = ["kind", "page_id", "url", "host", "own", "blocks", "region", "key", "n", "direct", "headings"]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), _BLOCKS, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_SCHEMA = "kind string, page_id long, url string, host string, own string, blocks array<struct<path:string,text:string,key:long>>, region string, key long, n long, direct long, headings long"


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), _TYPES)], _NAMES_OUT)


def _parser(models):
    """Parse pages (page_id, url, host, html[, models]); models is a broadcast of the reference pages by host, or None where rows carry theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass: dict[tuple[str, str], list[int]] = {}
        constant: Counter = Counter()
        references: dict[str, list[tuple[str, Page]]] = {}
        rows: list[tuple] = []
        size = 0

        def sums() -> Iterator[pa.RecordBatch]:
            out = [("mass", None, None, h, None, None, r, None, *n) for (h, r), n in mass.items()]
            out += [("same", None, None, h, None, None, None, k, n, None, None) for (h, k), n in constant.items()]
            mass.clear()
            constant.clear()
            yield from _batches(out)

        for b in batches:
            for i in range(b.num_rows):  # one row at a time: texts may be long, and references repeat
                page_id, url, host, html = (b.column(c)[i].as_py() for c in range(4))
                model = (models.value.get(host) if models else b.column(4)[i].as_py()) or []
                page = Page(html or "").sign()
                if host not in references or [t for t, _ in references[host]] != model:
                    if len(references) >= 64:
                        references.clear()
                    references[host] = [(t, Page(t).sign()) for t in model]
                memo: dict = {}
                alike = [r for t, r in references[host] if t != html and same_layout(page, r, memo)]
                votes = Counter(j for r in alike for j in template_blocks(page, r, memo))
                same = {j for j, n in votes.items() if 2 * n > len(alike)}
                own = _masses(page, same)
                if alike:
                    for region, n in own.items():
                        at = mass.setdefault((host, region), [0, 0, 0])
                        for k in range(3):
                            at[k] += n[k]
                    constant[host, 0] += 1
                    for key in {_key(page.blocks[j][0].path, page.blocks[j][1]) for j in same if not page.blocks[j][2]}:
                        constant[host, key] += 1
                blocks = [{"path": _place(h), "text": t, "key": _key(h.path, t)} for h, t, outside in page.blocks if not outside]
                rows.append(("page", page_id, url, host, _region(own) if own else _region(_masses(page, set())), blocks, None, None, None, None, None))
                size += len(html or "")
                if len(rows) == 500 or size > 1 << 22:
                    yield from _batches(rows)
                    rows, size = [], 0
            if len(mass) + len(constant) > 200_000:
                yield from sums()
        yield from _batches(rows)
        yield from sums()

    return run


def _regions(mass: DataFrame) -> DataFrame:
    """(host, region): `_region` over the sums of a host. The paths that hold most of its text are a chain, one for each level."""
    total = mass.where("region = ''").select("host", F.col("n").alias("total"), F.col("headings").alias("all_headings"))
    chain = mass.join(total, "host").where((F.col("n") > 0) & (F.col("n") >= REGION_TEXT * F.col("total")) & (F.col("headings") >= REGION_HEADINGS * F.col("all_headings")))
    whole = (F.col("direct") >= REGION_WHOLE * F.col("n")) | F.col("region").rlike("(^|/)(article|main)$")
    level = F.length(F.regexp_replace("region", "[^/]", ""))
    step = F.struct(F.when(whole, level).otherwise(F.lit(1 << 20) - level).alias("order"), "region")  # the first that is whole, else the deepest
    return chain.groupBy("host").agg(F.min(step).alias("m")).select("host", F.col("m.region").alias("region"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty html give an empty text; a url without a host, or null, makes
    a group of its own; null ids and repeated rows keep their rows; other
    columns are ignored; an empty table gives no rows.  Whole pages are parsed,
    whatever their length or depth; below MATCH_DEPTH levels trees match only as
    wholes.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    # of a host's pages, dealt to as many heaps as there are references by a hash, a short one of each heap if there is any, the one with the smallest hash: reruns agree
    heap = F.pmod(F.xxhash64("html", F.lit(1)), F.lit(REFERENCES))
    order = F.struct((F.length("html") > SHORT_PAGE).alias("long"), F.xxhash64("html").alias("h"), "html")
    model = rows.where(F.length("html") > 0).groupBy("host", heap.alias("heap")).agg(F.min(order).alias("m")).groupBy("host").agg(F.sort_array(F.collect_list("m.html")).alias("models"))
    model = materialize(model, "html-models")
    chars = F.aggregate("models", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    if (model.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_CHARS:
        sent = pages.sparkSession.sparkContext.broadcast({r["host"]: r["models"] for r in model.collect()})
        parsed = rows.mapInArrow(_parser(sent), _SCHEMA)
    else:  # two shuffled tables, whose hot hosts adaptive execution splits
        parsed = rows.join(model, "host", "left").select("page_id", "url", "host", "html", "models").mapInArrow(_parser(None), _SCHEMA)
    parsed = materialize(parsed, "html-blocks")
    mass = parsed.where("kind = 'mass'").groupBy("host", "region").agg(*(F.sum(c).alias(c) for c in ("n", "direct", "headings")))
    same = parsed.where("kind = 'same'").groupBy("host", "key").agg(F.sum("n").alias("n"))
    met = same.where("key = 0").select("host", F.col("n").alias("met"))
    often = same.where("key <> 0").join(met, "host").where((F.col("met") >= CONSTANT_PAGES) & (F.col("n") >= CONSTANT_SHARE * F.col("met")))
    constants = often.groupBy("host").agg(F.collect_set("key").alias("constants"))  # blocks of the reference pages
    wrapper = materialize(_regions(mass).join(constants, "host", "full"), "html-wrappers")
    size = wrapper.agg(F.sum(F.lit(100) + 8 * F.coalesce(F.size("constants"), F.lit(0)))).first()[0] or 0
    wrapper = F.broadcast(wrapper) if size <= BROADCAST_BYTES else wrapper
    page = parsed.where("kind = 'page'").select("page_id", "url", "host", "own", "blocks").join(wrapper, "host", "left")
    under = lambda b, region: (region == "") | (b["path"] == region) | b["path"].startswith(F.concat(region, F.lit("/")))
    inside = page.withColumn("region", F.when(F.exists("blocks", lambda b: F.coalesce(under(b, F.col("region")), F.lit(False))), F.col("region")).otherwise(F.col("own")))
    kept = F.filter("blocks", lambda b: F.coalesce(under(b, F.col("region")), F.lit(False)) & (F.col("constants").isNull() | ~F.array_contains(F.coalesce("constants", F.array().cast("array<bigint>")), b["key"])))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return inside.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
