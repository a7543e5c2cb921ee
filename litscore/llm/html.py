"""Main text of web pages by wrappers inferred from the pages of a host.

A page is a stream of tokens: start and end tags of block elements, and text. Repeats within
a page are folded into repeated groups. The distinct streams of a host are then aligned one
after the other: text against text is a slot, a group that only one side has becomes
optional, a group that occurs once here and again and again there becomes repeated. What
results is a union-free regular expression, the host's wrapper. It tells which elements hold
the article on that host; a page's text is what fills the slots in there.

A page without such an element is split into template and slots by its texts: what stands at
the same place on at least half of the host's pages that have that place is template.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litscore.llm.common import store
from litscore.worker import worker_state

# Elements of HTML by what their content is.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter output q"
    " rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset(
    "head nav header footer aside form script style textarea title xmp iframe noembed noframes noscript"
    " template menu dialog select option button input object svg canvas audio video map".split()
)
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
# Last words of a class or id that mark what is not the article.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay"
    " cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " side aside footer foot masthead comment comments respond disqus share sharing social related recommended"
    " newsletter subscribe subscription login signup pagination pager toolbar widget widgets".split()
)
MARKS = BOILERPLATE_WORDS | {"header"}
# Words in front of them that make it a state of the page or a subject of the text: no-sidebar, category-social.
NO_MARK = frozenset("no not non with without has have is hide hidden show enable disable category categories cat tag topic by".split())
CLOSED_BY = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)/?>"
    r"|</?[a-zA-Z][^>]*>",  # a tag with an open quotation mark
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>\"']*)")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements nested deeper are not told apart in wrappers; their text counts all the same.
DEEPEST = 100
#: Partial wrappers of a host are inferred from this many shares of its streams, then merged.
SHARES = 32
#: A page's longest text, if of so many characters, tells it from others: copies of it are no evidence of a template.
OWN_CHARS = 200
#: Wrappers are sent to all executors up to this size; beyond it they are joined by host.
BROADCAST_BYTES = 32 << 20


def _hash(*values: object) -> int:
    text = "\0".join(map(str, values)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _marks(token: str) -> bool:
    """Whether a whole class or id says so: a listed word, or a name that ends in one and tells no state or subject."""
    words = _WORDS.findall(token)
    return bool(words) and words[-1] in MARKS and not NO_MARK.intersection(words[:-1])


def _is_boilerplate(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is none of the article's; an article's own header is.

    Classes and ids never mark what holds the page, the outermost article or a heading.
    """
    if name in BOILERPLATE:
        return not (name == "header" and in_article)
    spared = name in HEADINGS and not (name == "article" and in_article)
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, key = (a or b or c).lower(), key.lower()
        if key == "role" and BOILERPLATE_ROLES.intersection(_WORDS.findall(value)):
            return True
        if key in ("class", "id") and not spared:
            for token in value.split():
                if _marks(token) and not (in_article and token.endswith("header")):
                    return True
    return False


def _key(name: str, attributes: str) -> str:
    """The tag as it counts for alignment: with its class words, without digits."""
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        if key.lower() == "class":
            return ".".join([name, *sorted(set(_WORDS.findall((a or b or c).lower())))])
    return name


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """('start' | 'end' | 'text', name or text, attributes) of a page, raw text elements skipped."""
    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        name, whole = found.group(2), found.group()
        if name is None:
            if whole.startswith("<![CDATA["):
                yield "text", whole[9:].removesuffix("]]>").replace("&", "&amp;"), ""
                continue
            if whole[1] in "!?":
                continue
            name = _NAME.match(whole).group(1)
        name = name.lower()
        if whole[1] == "/":
            yield "end", name, ""
            continue
        yield "start", name, found.group(3) or ""
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else n
            yield "end", name, ""


class Walk:
    """The open elements while a page is read; forgives elements that are not closed."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, bool, int]] = []
        # of each block element: place of its parent, tag, number among the parent's of this tag, tags in it
        self.places: list[tuple[int, str, int, dict[str, int]]] = [(-1, "", 0, {})]

    def start(self, name: str, attributes: str) -> bool:
        """Open an element; true if it is block-level. Void elements are not opened."""
        if name in ROOTS and not any(o[0] in ROOTS for o in self.open):
            # an article inside boilerplate means that the boilerplate was not closed
            cut = next((i for i, o in enumerate(self.open) if o[2]), None)
            if cut is not None:
                del self.open[cut:]
        if name in _ENDS_P:
            self._close("p", {"p"}, {"table", "td", "th", "li", "div", "button", "article", "section"})
        if name in CLOSED_BY:
            self._close(name, CLOSED_BY[name], {"ul", "ol", "dl", "table", "div", "article", "section", "nav"})
        if name not in VOID:
            key, place = _key(name, attributes), self.place()
            if name not in INLINE:
                inner = self.places[place][3]
                inner[key] = inner.get(key, 0) + 1
                self.places.append((place, key, inner[key], {}))
                place = len(self.places) - 1
            self.open.append((name, key, _is_boilerplate(name, attributes, any(o[0] == "article" for o in self.open)), place))
        return name not in INLINE

    def _close(self, name: str, which: set[str], limits: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in which:
                del self.open[i:]
                return
            if self.open[i][0] in limits:
                return

    def end(self, name: str) -> bool:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                break
            if name in INLINE and self.open[i][0] not in INLINE:
                break
        return name not in INLINE

    def path(self) -> tuple[str, ...]:
        return tuple(o[1] for o in self.open if o[0] not in INLINE)

    def skipped(self) -> bool:
        return any(o[2] for o in self.open)

    def place(self) -> int:
        return self.open[-1][3] if self.open else 0

    def place_hashes(self) -> list[tuple[int, int]]:
        """Of each place of a page that has been read: by its numbers from the first and from the last of a tag."""
        out = [(1, 2)]
        for parent, key, number, _ in self.places[1:]:
            first, last = out[parent]
            out.append((_hash(first, key, number), _hash(last, key, self.places[parent][3][key] - number)))
        return out


def stream(page: str) -> list[str]:
    """Block tokens of a page: ``<tag.class``, ``>`` for an end, ``#`` for text; boilerplate text is no slot."""
    walk, out, depth = Walk(), [], []
    for kind, what, attributes in events(page):
        if kind == "text":
            if what.strip() and not walk.skipped() and (not out or out[-1] != "#"):
                out.append("#")
            continue
        walk.start(what, attributes) if kind == "start" else walk.end(what)
        path = walk.path()[:DEEPEST]
        same = 0
        while same < len(path) and same < len(depth) and path[same] == depth[same]:
            same += 1
        if kind == "start" and what not in INLINE and what not in VOID and len(path) == same and same:
            same -= 1  # a new element of the same kind as the one before
        out += [">"] * (len(depth) - same) + ["<" + p for p in path[same:]]
        depth = list(path)
    return out + [">"] * len(depth)


def groups(tokens: list[str]) -> list:
    """Tokens as a tree: an element is (tag, children, repeated, optional)."""
    stack: list[tuple[str, list]] = [("", [])]
    for t in tokens:
        if t == ">":
            if len(stack) > 1:
                tag, children = stack.pop()
                stack[-1][1].append((tag, fold(children), False, False))
        elif t == "#":
            stack[-1][1].append(("#", [], False, False))
        else:
            stack.append((t[1:], []))
    while len(stack) > 1:
        tag, children = stack.pop()
        stack[-1][1].append((tag, fold(children), False, False))
    return fold(stack[0][1])


def fold(children: list) -> list:
    """Neighbours of one tag become one repeated group with the regular expression of all."""
    out: list = []
    for child in children:
        if out and child[0] == out[-1][0]:
            if child[0] != "#":
                out[-1] = (child[0], align(out[-1][1], child[1]), True, out[-1][3] and child[3])
        else:
            out.append(child)
    return out


def align(a: list, b: list) -> list:
    """One expression for two: equal tags are aligned in turn, what one side lacks is optional."""
    if a == b:
        return a
    out: list = []
    tags_a, tags_b = [x[0] for x in a], [x[0] for x in b]
    for op, i, j, k, m in SequenceMatcher(None, tags_a, tags_b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [(x[0], align(x[1], y[1]), x[2] or y[2], x[3] or y[3]) for x, y in zip(a[i:j], b[k:m])]
        else:
            out += [(*x[:3], True) for x in a[i:j]] + [(*y[:3], True) for y in b[k:m]]
    return fold(out)


def write(tree: list) -> str:
    """The expression as text: ``<tag ... >`` with ``+`` for repeated, ``?`` for optional."""
    return "".join(
        ("#" if t == "#" else f"<{t} {write(c)}>") + "+" * bool(r) + "?" * bool(o) for t, c, r, o in tree
    )


def read(text: str) -> list:
    stack: list[list] = [[""]]
    children: list[list] = [[]]
    i = 0
    while i < len(text):
        c = text[i]
        if c == "<":
            end = text.index(" ", i)
            stack.append([text[i + 1 : end]])
            children.append([])
            i = end + 1
            continue
        if c == "#":
            node: tuple = ("#", [], False, False)
        elif c == ">":
            node = (stack.pop()[0], children.pop(), False, False)
        else:
            i += 1
            continue
        i += 1
        repeated = text[i : i + 1] == "+"
        i += repeated
        optional = text[i : i + 1] == "?"
        i += optional
        children[-1].append((node[0], node[1], repeated, optional))
    return children[0]


def roots(tree: list, path: tuple[str, ...] = ()) -> set[tuple[str, ...]]:
    """Paths of the elements that hold the article: the outermost article or main with a slot."""
    out: set[tuple[str, ...]] = set()
    for tag, children, _, _ in tree:
        if tag == "#":
            continue
        own = (*path, tag)
        if tag.split(".")[0] in ROOTS and "#" in write(children):
            inner = roots(children, own) if tag.split(".")[0] == "main" else set()
            out |= {p for p in inner if p[-1].split(".")[0] == "article"} or {own}
        else:
            out |= roots(children, own)
    return out


def main_text(page: str, wrapper_roots: set[tuple[str, ...]], template: frozenset[int] = frozenset()) -> str:
    """Text of the slots inside the wrapper's article, or of all slots if the page has no such element."""
    walk, blocks, found = read_blocks(page, wrapper_roots)
    if found:
        return " ".join(text for text, _, in_root in blocks if in_root)
    return " ".join(slots(walk, blocks, template) if template else [b[0] for b in blocks])


def read_blocks(page: str, wrapper_roots: set[tuple[str, ...]] | None) -> tuple[Walk, list[tuple[str, int, bool]], bool]:
    """The page's elements, its (text, place, in a root) but boilerplate, and whether it has a root; any article or main, if None."""
    blocks, found = [], False
    walk = Walk()
    own: list[str] = []

    def flush(in_root: bool) -> None:
        text = " ".join(entities.unescape("".join(own)).split())
        own.clear()
        if text:
            blocks.append((text, walk.place(), in_root))

    def in_root() -> bool:
        if wrapper_roots is None:
            return any(o[0] in ROOTS for o in walk.open)
        path = walk.path()
        return any(path[: len(r)] == r for r in wrapper_roots)

    now = False
    for kind, what, attributes in events(page):
        if kind == "text":
            if not walk.skipped():
                own.append(what)
            continue
        if what == "br":
            own.append(" ")
            continue
        if what in INLINE:
            walk.start(what, attributes) if kind == "start" else walk.end(what)
            continue
        flush(now)
        walk.start(what, attributes) if kind == "start" else walk.end(what)
        now = in_root()
        found = found or now
    flush(now)
    return walk, blocks, found


def slots(walk: Walk, blocks: list[tuple[str, int, bool]], template: frozenset[int]) -> list[str]:
    """Texts that are not of the template, with the headings that every page has in front of them; all, if there are none."""
    at = walk.place_hashes()
    fixed = [any(_hash(h, text) in template for h in at[place]) for text, place, _ in blocks]
    if all(fixed):
        return [b[0] for b in blocks]

    def heads(i: int) -> bool:
        """Whether a heading stands in front of a slot in the same element."""
        parent, key = walk.places[blocks[i][1]][:2]
        if key.split(".")[0] not in HEADINGS or i + 1 == len(blocks) or fixed[i + 1]:
            return False
        place = blocks[i + 1][1]
        while place > parent:
            place = walk.places[place][0]
        return place == parent

    return [b[0] for i, b in enumerate(blocks) if not fixed[i] or heads(i)]


def placed_texts(page: str) -> list[tuple[int, int, int]]:
    """(place, text at it, page) as hashes, of a page that has no text in an article or main."""
    walk, blocks, _ = read_blocks(page, None)
    if not blocks or any(b[2] for b in blocks):
        return []
    longest = max((b[0] for b in blocks), key=len)
    own = _hash(longest) if len(longest) >= OWN_CHARS else _hash(*(b[0] for b in blocks))
    at = walk.place_hashes()
    return [(h, _hash(h, text), own) for text, place, _ in blocks for h in at[place]]


def host_of(url):
    """Lower-case host of a url, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all pages (url, html): streams are folded page by page, counted
    once per host, aligned in up to ``SHARES`` shares per host, and the shares aligned."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [write(groups(stream(h or ""))) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.string())], names=["host", "wrapper"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        tree: list = []
        for i, text in enumerate(sorted(rows["wrapper"])):
            tree = align(tree, read(text)) if i else read(text)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [write(tree)]})

    streams = (
        pages.select(host_of(F.col("url")).alias("host"), "html")
        .mapInArrow(folded, "host string, wrapper string")
        .distinct()
    )
    shared = streams.withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(SHARES)))
    partial = shared.groupBy("host", "share").applyInPandas(merge, "host string, wrapper string")
    return partial.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def infer_templates(pages: DataFrame) -> DataFrame:
    """(host, template): hashes of the texts that at least half of a host's pages, and two, have at a place.

    Pages count that have no text in an article or main and have the place; copies count once.
    """

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [placed_texts(h or "") for h in batch.column("html").to_pylist()]
            hosts = [x for x, own in zip(batch.column("host").to_pylist(), found) for _ in own]
            columns = zip(*(row for own in found for row in own)) if hosts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["host", "place", "text", "page"])

    laid = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(lay, "host string, place bigint, text bigint, page bigint")
    laid = store(laid.distinct(), "page-texts")
    texts = laid.groupBy("host", "place", "text").agg(F.count("*").alias("n")).filter("n > 1")
    places = laid.groupBy("host", "place", "page").count().groupBy("host", "place").agg(F.count("*").alias("of"))
    fixed = texts.join(places.filter("of > 1").hint("merge"), ["host", "place"]).filter("2 * n >= of")
    return fixed.groupBy("host").agg(F.collect_set("text").alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page; html is read whole, null is empty.

    Other columns are ignored. Pages with no url share a wrapper. A page without the element
    that the wrapper names, or of a host without any, gives all its text but boilerplate and
    the host's template.
    """
    wrappers = store(infer_wrappers(pages).join(infer_templates(pages).hint("merge"), "host", "left"), "wrappers")
    length = F.octet_length("wrapper") + F.octet_length("host") + 8 * F.coalesce(F.array_size("template"), F.lit(0))
    size = wrappers.agg(F.coalesce(F.sum(length), F.lit(0)).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state().setdefault("wrapper roots", {})
        templates: dict[str, frozenset[int]] = {}
        for batch in batches:
            texts = []
            rows = zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), batch.column("host").to_pylist())
            for i, (page, wrapper, host) in enumerate(rows):
                if host not in templates:
                    if len(templates) > 10_000:
                        templates.clear()
                    templates[host] = frozenset(batch.column("template")[i].as_py() or ())
                if wrapper not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[wrapper] = roots(read(wrapper or ""))
                texts.append(main_text(page or "", known[wrapper], templates[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = keyed.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left")
    texts = joined.select("page_id", "url", "html", "wrapper", "template", "host").mapInArrow(run, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
