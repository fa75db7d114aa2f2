"""Main text of web pages by deduced templates (operator 2).

Equivalence classes: a page becomes a sequence of tokens, one for each tag in its place (the path of open elements with their
classes and ids, so the same tag in two roles is two tokens) and one for the whole text of each block element in its place. Over
the pages of a host, tokens that occur equally often in every page share an occurrence vector; tokens of one vector form
a class. Vectors are compared by a sum of hashes of (page, count), so a host's pages are never gathered: counting is one
aggregation by (host, token), and a host with a third of all pages is folded map-side like any other.

A class is valid if it is frequent (in at least ``SUPPORT`` of the host's pages) and large enough (``MIN_CLASS`` tokens). Valid
classes nest by their places: an element whose tag and whole text are in a valid class belongs to the template with all that it holds;
the others hold the slots. A token is evidence only if ``EVIDENCE`` pages share it, and the text of an element only if so many pages
with different main pieces (their longest one) do, so copies of one page don't make its article a template.

The article's region is the place of a valid class that looks most like an article's and holds most text: ``article`` (but ``main``
where an article beside it holds less), ``main``, an element named so, or else the body. A page that lacks its host's region, or whose host has no
valid class, takes the best of its own. Inside the region, furniture is left out: by element, role or name (menus, footers,
sidebars, notices, adverts, forms, scripts, comments of readers), and in regions that no ``article`` or ``main`` marks also what
the host's template holds. Of a ``header`` inside an article its headings stay. Names count as whole classes or as
the first or last word of a compound (``site-footer``; not ``has-sidebar``, ``legal-analysis``), and never on ``html`` and ``body``.

Inside the region, block elements end a block; character references are decoded; white space inside a block is one
space; blocks are trimmed and joined in page order by a line feed. Unclosed and stray tags are tolerated, quotes count only after
``=``, and reading a page takes time in proportion to its length.

Edge cases: null html and pages without text give an empty text; null and odd urls share one host; repeated rows are
repeated results; a page of any length and depth is read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialize, ship_package

SUPPORT = 0.5
MIN_CLASS = 2
EVIDENCE = 3
#: Elements without content, elements that end a block, elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
                   "title tr ul").split())
RAW = frozenset("script style template textarea iframe svg object select head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Furniture by element, by ARIA role, and by words of classes and ids.
FURNITURE = frozenset("nav header footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu menubar breadcrumb breadcrumbs "
                   "masthead topbar footer sidebar aside cookie cookies gdpr newsletter comments disqus pagination pager popup modal overlay toolbar").split())
#: Words that name furniture alone, as the last word of a compound, or before a word for a box.
WEAK = frozenset("banner header widget share sharing social consent notice notices subscribe subscription signup comment respond login search disclaimer".split())
ALONE = frozenset("related discussion copyright legal".split())
BOXES = frozenset("area bar block box buttons container form inner item items link links list panel posts section top wrap wrapper".split())
MODIFIERS = frozenset("has no not with without is hide".split())
ARTICLE_NAMES = frozenset("article content main post entry story text body".split())
#: Closing rules of unclosed elements: an opening tag on the left closes an open element on the right.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "option", "legend", "caption", "tr", "td", "th", "tbody", "thead", "tfoot", "li", "dd", "dt", "body", "html", "title"} | {"p"}

_MARK = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
# the rest of a tag: a quote opens a value only after "=" (atomic: nothing is tried twice)
_REST = re.compile(r"(?>(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)>")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACES = re.compile(r"\s+")
_PARTS = re.compile(r"[-_]+")
_INLINE_P = frozenset("a abbr b bdi bdo cite code data dfn em i kbd mark q s samp small span strong sub sup time u var".split())


def _named(attrs: str) -> tuple[str, tuple, str]:
    """(place label, classes and ids, role) of a tag's attributes."""
    if "=" not in attrs:
        return "", (), ""
    label, found, role = "", [], ""
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if name.lower() == "role":
            role = value.strip()
        else:
            label += ("." if name.lower() == "class" else "#") + re.sub(r"\d+", "0", value.strip())
            found += value.split()
    return label, tuple(found), role


def _names_furniture(name: str) -> bool:
    parts = [p for p in _PARTS.split(name) if p]
    if not parts or parts[0] in MODIFIERS:
        return False
    if len(parts) == 1:
        return parts[0] in NAMES or parts[0] in WEAK or parts[0] in ALONE
    return parts[0] in NAMES or parts[-1] in NAMES or parts[-1] in WEAK or (parts[-1] in BOXES and (parts[0] in WEAK or parts[0] in ALONE))


def is_furniture(tag: str, names: tuple, role: str) -> bool:
    if tag in ("html", "body"):
        return False
    if tag in FURNITURE or role in ROLES:
        return True
    if tag in ("article", "main"):
        return any(n in NAMES or n in WEAK for n in names)
    return any(_names_furniture(n) for n in names)


def _rank(tag: str, names: tuple, role: str) -> int:
    """How much an element looks like the article's: lower is better."""
    if tag == "article":
        return 0
    if tag == "main" or role == "main":
        return 1
    if tag in ("div", "section", "td") and any(p in ARTICLE_NAMES for n in names for p in (n, *_PARTS.split(n))) and not any(n.startswith("has-") for n in names):
        return 2
    return 3 if tag == "body" else 4


_PRIME, _MASK = 0x100000001B3, (1 << 64) - 1


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


class Node:
    """An element of a page: its place (a hash of its path), and the text pieces and visible characters in it."""

    __slots__ = ("parent", "tag", "label", "place", "hides", "hidden", "rank", "first", "last", "chars")

    def __init__(self, parent, tag: str, label: str, hides: bool, rank: int, places: dict):
        self.parent, self.tag, self.label, self.rank = parent, tag, label, rank
        key = (parent.place if parent else 0, tag + label)
        self.place = places.get(key)
        if self.place is None:
            self.place = places[key] = _digest(b"%d/%s" % (key[0], key[1].encode("utf-8", "replace")))
        self.hides = hides
        self.hidden = hides or (parent is not None and parent.hidden)
        self.first = self.last = self.chars = 0

    def path(self) -> str:
        steps, n = [], self
        while n is not None:
            steps.append(n.tag + n.label)
            n = n.parent
        return "/" + "/".join(reversed(steps))


class Page:
    """A page as elements and a walk of ``("open" | "close", node)`` and ``("text", raw, node)``."""

    def __init__(self, html: str, places: dict | None = None):
        self.nodes: list[Node] = []
        self.walk: list[tuple] = []
        self.pieces: list[str] = []
        self._parse(html, {} if places is None else places)

    def _text(self, raw: str, node) -> None:
        self.walk.append(("text", raw, node))
        piece = _SPACES.sub(" ", raw).strip()
        if piece and not (node is not None and node.hidden):
            self.pieces.append(piece)

    def _close(self, node: Node) -> None:
        node.last = len(self.pieces)
        self.walk.append(("close", node))

    def _parse(self, html: str, places: dict) -> None:
        stack: list[Node] = []
        open_tags: dict[str, int] = {}
        at, n, last_end = 0, len(html), html.rfind(">")
        foreign = 0

        def pop() -> Node:
            node = stack.pop()
            open_tags[node.tag] -= 1
            self._close(node)
            return node

        begun = 0  # start of the text not yet given out
        while True:
            m = _MARK.search(html, at)
            if m is None or m.start() > last_end and not m[0].startswith("<!--"):
                break  # what follows holds no whole tag: text
            top = stack[-1] if stack else None
            if m.start() > begun:
                self._text(html[begun: m.start()], top)
            if m[2] is None:
                if m[0] == "<!--":
                    end = html.find("-->", m.end())
                    at = n if end < 0 else end + 3
                elif m[0] == "<![CDATA[":
                    end = html.find("]]>", m.end())
                    self._text(html[m.end(): n if end < 0 else end].replace("&", "&amp;"), top)
                    at = n if end < 0 else end + 3
                else:
                    at = html.find(">", m.end()) + 1
                begun = at
                continue
            r = _REST.match(html, m.end())
            at = begun = r.end() if r else html.find(">", m.end()) + 1
            attrs, tag = html[m.end(): at - 1], m[2].lower()
            if m[1]:
                if open_tags.get(tag):
                    while pop().tag != tag:
                        pass
                if tag in ("svg", "math"):
                    foreign = sum(open_tags.get(t, 0) for t in ("svg", "math"))
                continue
            closes = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else set())
            if any(open_tags.get(t) for t in closes):
                # what an opening block tag closes: the nearest such element, through inline elements only
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in closes:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag not in _INLINE_P:
                        break
            label, names, role = _named(attrs)
            parent = stack[-1] if stack else None
            node = Node(parent, tag, label, is_furniture(tag, names, role) or tag in RAW, _rank(tag, names, role), places)
            node.first = len(self.pieces)
            self.nodes.append(node)
            self.walk.append(("open", node))
            foreign += tag in ("svg", "math")
            if tag in VOID or (foreign and attrs.endswith("/")):
                self._close(node)
                foreign -= tag in ("svg", "math")
            elif tag in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = begun = end.end() if end else n
                self._close(node)
            else:
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        if begun < n:
            self._text(html[begun:], stack[-1] if stack else None)
        while stack:
            pop()
        # characters and digests of any run of pieces, from sums over the pieces before
        self.sums, self.rolled, self.powers = [0], [0], [1]
        for p in self.pieces:
            self.sums.append(self.sums[-1] + len(p))
            self.rolled.append((self.rolled[-1] * _PRIME + _digest(p.encode("utf-8", "replace"))) & _MASK)
            self.powers.append(self.powers[-1] * _PRIME & _MASK)
        for node in self.nodes:
            node.chars = 0 if node.hidden else self.sums[node.last] - self.sums[node.first]

    def digest(self, node: Node) -> int:
        """Of the whole visible text in an element."""
        return (self.rolled[node.last] - self.rolled[node.first] * self.powers[node.last - node.first]) & _MASK

    def sketch(self) -> int:
        """Tells pages with different main pieces apart."""
        return _digest(max(self.pieces, key=len).encode("utf-8", "replace")) if self.pieces else 0

    def candidates(self) -> list[tuple[Node, bool]]:
        """(element, whether it is inside ``main``) of all that may be the region: of those in one another, the outermost of a rank."""
        out, best = [], {}
        for node in self.nodes:
            above = best.get(id(node.parent), (4, False)) if node.parent else (4, False)
            if not node.hidden and node.rank < above[0]:
                out.append((node, above[1]))
            best[id(node)] = (min(node.rank, above[0]), above[1] or node.rank == 1)
        return out


def choose(candidates: list[tuple]) -> str | None:
    """The path of the region among ``(rank, chars, inside main, path)``."""
    if not candidates:
        return None
    rank, chars, inside, path = min(candidates, key=lambda c: (c[0], -c[1], c[3]))
    if rank == 0 and not inside:
        mains = [c for c in candidates if c[0] == 1 and c[1] > chars]
        if mains:
            return min(mains, key=lambda c: (-c[1], c[3]))[3]
    return path


def host_of(url: str = "url") -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


TOKENS = "host string, place long, text long, path string, rank int, inside boolean, sketch long, pages long, total long, vector long, chars long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tokens(pages: DataFrame) -> DataFrame:
    """``host, place, text, path, rank, inside, pages, total, vector, chars, sketches``: how often each token occurs, with the digest
    of its occurrence vector. ``text`` is null for tags; ``path`` and ``rank`` are set for what may be a region; the row with a
    null place counts the host's pages. Tasks fold their own pages first, so a host's tags give a task's worth of rows at most."""
    ship_package(pages.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            acc: dict[tuple, list] = {}
            places: dict = {}
            for host, key, html in zip(*(c.to_pylist() for c in b.columns)):
                page = Page(html, places)
                sketch = _signed(page.sketch())
                found: dict[tuple, list] = {(None, None, None, None, None): [1, 0]}
                regions = {id(n): inside for n, inside in page.candidates()}
                for node in page.nodes:
                    inside = regions.get(id(node))
                    tag = (_signed(node.place), None, None, None, None) if inside is None else (_signed(node.place), None, node.path(), node.rank, inside)
                    row = found.setdefault(tag, [0, 0])
                    row[0] += 1
                    row[1] += node.chars
                    if node.chars and node.tag in BLOCK and node.rank > 3 and node.tag != "html":
                        found.setdefault((tag[0], _signed(page.digest(node)), None, None, None), [0, 0])[0] += 1
                for token, (n, chars) in found.items():
                    x = (key * 0x9E3779B97F4A7C15 + n * 0xBF58476D1CE4E5B9) & _MASK
                    x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & _MASK
                    # pages are told apart by sketch only where that is evidence: for texts and for the host
                    row = acc.setdefault((host, *token, sketch if token[0] is None or token[1] is not None else None), [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += n
                    row[2] = (row[2] + (x >> 24)) & ((1 << 40) - 1)
                    row[3] += chars
            keys = list(acc)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)] + [pa.array([acc[k][i] for k in keys], pa.int64()) for i in range(4)],
                names=[f.split()[0] for f in TOKENS.split(", ")])

    rows = pages.select(host_of().alias("host"), F.xxhash64("page_id", "url").alias("key"), F.coalesce("html", F.lit("")).alias("html"))
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "vector", "chars")]
    token = ["host", "place", "text", "path", "rank", "inside"]
    return rows.mapInArrow(fold, TOKENS).groupBy(*token, "sketch").agg(*sums).groupBy(*token).agg(*sums, F.count("*").alias("sketches"))


def classes(counted: DataFrame) -> DataFrame:
    """The tokens of valid classes: ``host, class, place, text, path, rank, inside, chars`` (places nest by path)."""
    size = counted.filter("place IS NULL").select(F.col("host").alias("s_host"), F.col("pages").alias("host_pages"), F.col("sketches").alias("host_sketches"))
    c = counted.filter("place IS NOT NULL").join(size, F.col("host") == F.col("s_host"))
    # text must be shared by differing pages; frequent tokens only, so a class is as large as its template at most
    c = c.filter((F.col("pages") >= EVIDENCE) & (F.col("pages") >= SUPPORT * F.col("host_pages")) & F.when(
        F.col("text").isNull(), F.lit(True)).otherwise((F.col("sketches") >= EVIDENCE) & (F.col("sketches") >= SUPPORT * F.col("host_sketches"))))
    token = F.struct("place", "text", "path", "rank", "inside", "chars")
    grouped = c.groupBy("host", "vector", "pages", "total").agg(F.collect_list(token).alias("tokens")).filter(F.size("tokens") >= MIN_CLASS)
    return grouped.select("host", F.xxhash64("vector", "pages", "total").alias("class"), F.inline("tokens"))


def templates(valid: DataFrame) -> DataFrame:
    """``host, region, fixed``: the place of the article in each host's template and the places whose whole text is fixed.
    One row a host, as large as its template."""
    region = F.when(F.col("path").isNotNull(), F.struct("rank", "chars", "inside", "path"))
    fixed = F.when(F.col("text").isNotNull(), F.struct("place", "text"))
    t = valid.groupBy("host").agg(F.collect_set(region).alias("regions"), F.collect_set(fixed).alias("fixed"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [choose([(c["rank"], c["chars"], c["inside"], c["path"]) for c in found]) for found in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string()), b.column(2)], names=["host", "region", "fixed"])

    return t.mapInArrow(pick, "host string, region string, fixed array<struct<place:long,text:long>>")


def extract(html: str, region: str | None, fixed: frozenset = frozenset()) -> str:
    """The text of a page's article: the elements at ``region``, or where the page has none or no region is known, its
    own best element, without furniture and the ``fixed`` (place, text) of its host."""
    page = Page(html)
    candidates = page.candidates()
    at_region = {id(n) for n, _ in candidates if n.path() == region} if region is not None else set()
    if not at_region:
        region = choose([(n.rank, n.chars, inside, n.path()) for n, inside in candidates])
        at_region = {id(n) for n, _ in candidates if n.path() == region}
    marked = any(n.rank < 2 for n, _ in candidates if id(n) in at_region)
    blocks: list[str] = []
    piece: list[str] = []

    def end() -> None:
        if piece:
            text = _SPACES.sub(" ", unescape("".join(piece))).strip()
            if text:
                blocks.append(text)
            piece.clear()

    inside, hidden, headers, headings = int(not at_region), 0, 0, 0
    for e in page.walk:
        node = e[-1]
        if e[0] == "text":
            if inside and not hidden and (not headers or headings):
                piece.append(e[1])
            continue
        step = 1 if e[0] == "open" else -1
        if node.tag in BLOCK:
            end()
        if id(node) in at_region:
            inside += step
            continue
        if node.tag in HEADINGS:
            headings += step
        if node.tag == "header" and marked and node.hides and _in_article(node):
            headers += step
        elif node.hides or (not marked and fixed and (_signed(node.place), _signed(page.digest(node))) in fixed):
            hidden += step
    end()
    return "\n".join(blocks)


def _in_article(node: Node) -> bool:
    """Whether the nearest sectioning element around a header is an article or main."""
    n = node.parent
    while n is not None and n.tag not in ("article", "main", "section", "body", "nav", "aside", "footer", "form"):
        n = n.parent
    return n is not None and n.tag in ("article", "main", "section")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, region`` of every row of ``pages``."""
    ship_package(pages.sparkSession)
    found = materialize(templates(classes(materialize(tokens(pages), "template-tokens"))), "template-regions")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of().alias("host"))
    r, g = rows.alias("r"), found.alias("g")
    # one row a host, so Spark broadcasts it only below its size threshold
    joined = r.join(g, F.col("r.host") == F.col("g.host"), "left").select("page_id", "url", "html", "region", "fixed")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [extract(h, g, frozenset((x["place"], x["text"]) for x in f or ())) for h, g, f in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(made, pa.string()),
                                              pa.array([len(t) for t in made], pa.int64()), b.column(3)], names=["page_id", "url", "text", "n_chars", "region"])

    return joined.mapInArrow(text, "page_id long, url string, text string, n_chars long, region string")


def op2_html_main_text(spark, sf_dir) -> DataFrame:
    """Main text of every page."""
    return main_text(load(spark, sf_dir, "pages"))
