"""Main text of web pages. Subtrees that recur over a host's pages are templates and go; rules drop what is never text.

Each element's subtree is hashed, over the whole page and before any rule; Spark counts the hashes per host, and an element
whose subtree stands on many different pages of its host is deleted. Rules by tag, role and class name drop what the
article is to be without, wherever it doesn't recur.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.skew import split_join
from lattica.llm.staging import stage
from lattica.llm.textops import pieces

RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without main text, whatever they hold but an article. A header inside an article is the article's own.
DROPPED = frozenset("head nav header footer aside form menu dialog button select svg canvas object audio video search".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog tablist".split())
#: Class and id names of what isn't the article ...
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comments comment commentlist commentary disqus respond replies reply toolbar pagination pager skip copyright disclaimer widget hidden".split()
)
#: ... and words that a name may have beside them: "site-footer", "cookie-notice" and "related-posts" count, "layout-with-sidebar" doesn't.
BESIDE = frozenset("site page global main top bottom left right inner outer primary secondary box bar block area wrap wrapper container section panel list item items links posts stories articles content text slot unit form buttons count thread user reader js".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table thead tbody tfoot tr td th figure figcaption dl dt dd".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
P_SCOPE = ("button", "td", "th", "table", "object", "caption")
#: End tags inside these reach out of them only for the names in FAR.
WALLS = frozenset("td th article main body".split())
FAR = frozenset("table tr tbody thead tfoot article main body html".split())
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>\x00]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I) for name in RAW}


def marked(value: str) -> bool:
    """Whether one of the names in a class or id value marks what isn't the article."""
    for name in html.unescape(value).split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & MARKS and words <= MARKS | BESIDE:
            return True
    return False


def _out_of_place(attrs: str) -> tuple[bool, bool]:
    """(marked by class or id, role or hidden) of a start tag's attributes."""
    named = other = False
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            named |= marked(value)
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            other = True
    return named, other


class Node:
    __slots__ = ("name", "attrs", "parts", "hash", "main", "text")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs = name, attrs
        self.parts: list = []  # text, or Node
        self.hash = 0
        self.main = False  # is or holds an article or main element
        self.text = False  # holds any text

    @property
    def is_main(self) -> bool:
        return self.name in ("article", "main") or 'role="main"' in self.attrs


def parse(text: str) -> Node:
    """Tree of a page's elements, in time proportional to the page.

    Tags that close nothing are skipped, open elements end with the one around them. A script, style or title that isn't
    closed takes the rest of the page, as in browsers.
    """
    root = Node("#root")
    stack = [root]
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
    blocks: list[int] = [0]
    walls: list[int] = [0]

    def cut(i: int) -> None:
        while len(stack) > i:
            name = stack.pop().name
            open_at[name].pop()
        for places in (blocks, walls):
            while places[-1] >= i:
                places.pop()

    def innermost(names) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        i = innermost(names)
        if i and i > innermost(scope):
            cut(i)

    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.search(text, at)
        start = m.start() if m else n
        if start > at:
            stack[-1].parts.append(html.unescape(text[at:start]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                stack[-1].parts.append(" ")
                continue
            i = innermost((name,))
            if i and (name in BLOCK or i > blocks[-1]) and (name in FAR or i >= walls[-1]):
                cut(i)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                stack[-1].parts.append(" ")
            continue
        if name in RAW:
            end = _ENDS[name].search(text, at)
            at = end.end() if end else n
            continue
        if name in CLOSES:
            close(CLOSES[name], SCOPE[name])
        if name in BLOCK:
            close(("p",), P_SCOPE)
        node = Node(name, m[3] or "")
        stack[-1].parts.append(node)
        if not node.attrs.rstrip().endswith("/") or name not in ("svg", "path", "use", "g"):
            open_at.setdefault(name, []).append(len(stack))
            if name in BLOCK:
                blocks.append(len(stack))
            if name in WALLS:
                walls.append(len(stack))
            stack.append(node)
    return root


def digest(root: Node) -> list[Node]:
    """Hash each element's subtree (names, and text with white space as one space); all elements, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if isinstance(x, Node)]
    order.reverse()
    for node in order:
        h = hashlib.blake2b(node.name.encode(), digest_size=8)
        node.main = node.is_main and not _out_of_place(node.attrs)[0]
        for x in node.parts:
            if isinstance(x, str):
                words = " ".join(x.split())
                node.text |= words != ""
                h.update(b"\x00" + words.encode("utf-8", "surrogatepass"))
            else:
                h.update(b"\x01" + x.hash.to_bytes(8, "big", signed=True))
                node.text |= x.text
                node.main |= x.main
        node.hash = int.from_bytes(h.digest(), "big", signed=True)
    return order


def _dropped(node: Node, inside: bool) -> bool:
    """Whether a rule drops the element. None drops what holds an article, or an article's paragraph for its class."""
    if node.main and node.name != "head":
        return False
    if node.name in DROPPED and not (inside and node.name == "header"):
        return True
    if not node.attrs or node.name in ("html", "body", "main"):
        return False
    named, other = _out_of_place(node.attrs)
    return other or named and not (inside and node.name in PROSE)


def _tops(root: Node) -> list[Node]:
    """Outermost articles, or else main elements, or else the page."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and _dropped(node, False):
                continue
            if node.name == wanted or wanted == "main" and node.is_main:
                if node.main:
                    found.append(node)
            else:
                todo += [x for x in reversed(node.parts) if isinstance(x, Node)]
        if found:
            return found
    return [root]


def blocks_of(text: str | None) -> tuple[list[str], list[tuple[int, int, int]], list[int], int]:
    """(blocks, held, elements, page) of a page.

    blocks are the texts that no rule drops. held has (hash, first block, block after the last) of the elements around
    them that go if they are templates. elements are the hashes of all countable elements: those of block level with text,
    but html, body and what holds the article. page is the hash of the whole. What goes in an article are its containers
    (div, section, lists): paragraphs, headings, quotes and tables stay even if they recur, for an article may be on many
    pages.
    """
    if not text:
        return [], [], [], 0
    root = parse(text)
    nodes = digest(root)
    elements = list({x.hash for x in nodes if x.text and x.name in BLOCK and not x.main and x.name not in ("html", "body")})
    out: list[str] = []
    held: list[tuple[int, int, int]] = []
    for top in _tops(root):
        inside = top.main
        fixed = PROSE | {"article", "main", "html", "body"} if inside else {"html", "body"}
        piece: list[str] = []

        def flush(piece=piece):
            line = " ".join("".join(piece).split())
            if line:
                out.append(line)
            piece.clear()

        todo: list = [iter(top.parts)]
        open_: list[tuple[Node, int]] = [(top, 0)]
        while todo:
            x = next(todo[-1], None)
            if x is None:
                todo.pop()
                node, first = open_.pop()
                if node.name in BLOCK:
                    flush()
                    if open_ and node.name not in fixed and len(out) > first:
                        held.append((node.hash, first, len(out)))
            elif isinstance(x, str):
                piece.append(x)
            elif not _dropped(x, inside):
                if x.name in BLOCK:
                    flush()
                todo.append(iter(x.parts))
                open_.append((x, len(out)))
            elif x.name in BLOCK or x.name in DROPPED:
                flush()
        flush()
    return out, held, elements, root.hash


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PARSED = "row long, id {}, url string, host string, texts array<string>, held array<struct<element:long,first:int,end:int>>, elements array<long>, page long"


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row, id, url, host, texts, held, elements, page) of each page, written: see blocks_of()."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "html"):
            texts, held, elements, hashes, rows = [], [], [], [], []
            for page in batch.column("html"):
                found, around, counted, whole = blocks_of(page.as_py())
                texts.append(found)
                held.append([{"element": h, "first": i, "end": j} for h, i, j in around])
                elements.append(counted)
                hashes.append(whole)
                rows.append(row)
                row += 1
            longs, ranges = pa.list_(pa.int64()), pa.list_(pa.struct([("element", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column("id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.list_(pa.string())), pa.array(held, ranges), pa.array(elements, longs), pa.array(hashes, pa.int64())],
                names=["row", "id", "url", "host", "texts", "held", "elements", "page"],
            )

    host = F.nullif(F.lower(F.regexp_extract(F.col(url_col), HOST, 1)), F.lit(""))
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    return stage(slim.mapInArrow(run, PARSED.format(slim.schema["id"].dataType.simpleString())))


def templates(parsed: DataFrame, min_pages: int = 5) -> DataFrame:
    """(host, element, pages) of the subtrees on ``min_pages`` different pages of a host at least; equal pages count once."""
    every = parsed.where("host is not null").select("host", "page", F.explode("elements").alias("element"))
    return every.groupBy("host", "element", "page").agg(F.lit(1).alias("one")).groupBy("host", "element").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5) -> DataFrame:
    """(id, url, text) of each page: the main text, its blocks joined by one space.

    An element is a template if its subtree is on ``min_pages`` pages of its host, whatever share of them that is; pages
    that are equal as a whole count once, so copies of a page don't make a template of its text. Counting takes one row
    for each element and page, whose hash deals it out; templates on a large share of all rows go to the executors (few
    by count), all others are joined. Where a page has an article, or else a main element, its text is the main text, and
    what stands beside it isn't. An article's own header is text, its footer isn't. An open tag that is never closed
    drops nothing of an article that follows; an open script or title takes the rest of the page, as in browsers.

    Null and empty pages give empty text; pages without a host in their url have no templates; repeated rows are each
    returned, and ties of counts don't matter; very long and deeply nested pages are read whole, in linear time; an empty
    table gives an empty table; other columns, whatever their names, don't matter.
    """
    parsed = parse_pages(pages, id_col, url_col, html_col)
    often = stage(templates(parsed, min_pages).select("host", "element"))
    inside = parsed.where("host is not null").select("row", "host", F.explode("held").alias("x")).select("row", "host", "x.*")
    gone = split_join(inside, often, ["host", "element"]).groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("gone"))
    open_ = (F.size("held") > 0) & F.col("host").isNotNull()
    kept = F.filter("texts", lambda t, i: ~F.exists("gone", lambda g: (g["first"] <= i) & (i < g["end"])))
    some = parsed.where(open_).join(gone, "row", "left").select("id", "url", F.when(F.col("gone").isNull(), F.col("texts")).otherwise(kept).alias("texts"))
    rest = parsed.where(~open_ | open_.isNull()).select("id", "url", "texts")
    return rest.unionByName(some).select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join("texts", " ").alias("text"))
