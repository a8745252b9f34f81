"""HTML extraction by site templates: delete element subtrees that recur on many pages of a host.

Every container element of a page has two hashes: of the subtree as it is, with its text, and
of its shape (tags, classes and ids, with equal neighbours taken as one). Spark counts on how many pages of a host
each hash occurs. A subtree whose hash is on ``MIN_PAGES`` pages and ``MIN_SHARE`` of the
host's pages or more is part of the site's template and deleted, unless it holds the article: inside of
one, paragraphs and headings stay, and only what recurs with its text goes; elsewhere, a
subtree with more than ``MAX_TEXT`` of a page's text stays. So copies of an article on many
pages don't delete it. What no page shows (scripts, styles, the head) and elements that name
themselves as something else than the article are left out also where a host has few pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.llm._store import stored
from keyfold.llm.url_filter import host_of

MIN_PAGES = 3
MIN_SHARE = 0.2
MAX_TEXT = 0.4
#: A host's pages meet its template in this many groups.
SALTS = 64

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "tfoot thead tr ul".split()
)
_CONTAINER = frozenset(
    "aside center details dialog div dl fieldset figure footer form header menu nav ol section table ul".split()
)
_HIDDEN = frozenset("head script style template svg object canvas audio video noscript iframe xmp noembed noframes".split())
_NAMED = frozenset("nav aside footer form button select textarea input dialog menu datalist".split())
#: Words of a class, id or role that name something else than the article.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription sidebar sidenav menu navbar navigation nav "
    "breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies social share sharing related "
    "recommended widget widgets pagination pager toolbar skip login signup search contentinfo complementary alert".split()
)
#: Words that a name can have beside these, as in "site-footer" or "menu_left"; any other, as in "no-sidebar", makes it another name.
_BESIDE = frozenset("site main page post top bottom left right box block bar area list section container wrapper inner outer primary secondary".split())
_HEADED = _WORDS | {"header"}
_NOT_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement promo related sponsored".split())
#: A start tag of the keys ends open elements of the values, up to the nearest element of the third column.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
           "th": ("td th", "tr table"), "option": ("option", "select datalist")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
_P_SCOPE = frozenset("button table td th caption html object template".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile("[a-z0-9]+")


class Node:
    """An element: its children are nodes and texts in page order."""

    __slots__ = ("tag", "words", "names", "parent", "children", "hidden", "in_article", "holds_article", "size", "exact", "shape")

    def __init__(self, tag: str, words: frozenset, parent: Node | None, hidden: bool, names: frozenset = frozenset()):
        self.tag, self.words, self.parent, self.hidden, self.names = tag, words, parent, hidden, names
        self.children: list = []
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.holds_article = False
        self.size = 0


def parse(html: str) -> Node:
    """The tree of a page; end tags that are left out are put where browsers put most of them."""
    root = node = Node("", frozenset(), None, False)
    at = 0
    length = len(html)
    # how many elements of a tag are open, so that a deep page is not searched in vain
    opened: Counter[str] = Counter()

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    while at < length:
        m = _TOKEN.search(html, at)
        if m is None:
            node.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            node.children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[1]:
            tag, open_ = m[1].lower(), node
            if opened[tag] > 0:
                while open_.tag != tag:
                    open_ = open_.parent
                leave(open_.parent)
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        rest = m[3]
        words, names, hidden = set(), set(), False
        if len(rest) > 4:
            for a in _ATTRIBUTE.finditer(rest):
                name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if name in ("hidden", "aria-hidden"):
                    hidden = hidden or (name == "hidden" and a.end() - a.start() == 6) or value == "true"
                else:
                    words.update(_WORD.findall(value))
                    names.update(value.split())
        if tag in _BLOCK or tag in _CLOSES:
            ends, scope = _CLOSES.get(tag, (frozenset(), frozenset()))
            open_, to = node, node
            if any(opened[t] > 0 for t in ends):
                while open_ is not None and open_.tag not in scope:
                    if open_.tag in ends:
                        to = open_.parent
                    open_ = open_.parent
                leave(to)
            open_ = node if tag in _BLOCK and opened["p"] > 0 else None
            while open_ is not None and open_.tag not in _P_SCOPE:
                if open_.tag == "p":
                    leave(open_.parent)
                    break
                open_ = open_.parent
        new = Node(tag, frozenset(words), node, hidden, frozenset(names))
        node.children.append(new)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            stop = end.start() if end else length
            if tag not in _HIDDEN:
                new.children.append(unescape(html[at:stop]))
            at = stop
        elif tag not in _VOID:
            opened[tag] += 1
            node = new
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes, parents first; without recursion, as pages can be nested deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def _hash_all(nodes: list[Node]) -> None:
    """Size of the text, and both hashes, of every subtree."""
    for node in reversed(nodes):
        exact, shape, size = [node.tag, *sorted(node.words)], [node.tag, *sorted(w for w in node.words if not w.isdigit())], 0
        if node.tag in _HIDDEN:
            node.exact = node.shape = node.tag
            continue
        last = None
        for c in node.children:
            if isinstance(c, str):
                own = " ".join(c.split())
                if own:
                    exact.append(own)
                    size += len(own)
            else:
                exact.append(c.exact)
                size += c.size
                if c.tag in _BLOCK and c.shape != last:
                    shape.append(c.shape)
                    last = c.shape
        node.size = size
        node.holds_article = any(not isinstance(c, str) and (c.holds_article or c.tag in ("article", "main", "h1")) for c in node.children)
        node.exact = xxhash.xxh64_hexdigest("\0".join(exact).encode("utf-8", "surrogatepass"))
        node.shape = xxhash.xxh64_hexdigest("\0".join(shape).encode("utf-8", "surrogatepass"))


def _number(kind: str, digest: str) -> int:
    return xxhash.xxh64_intdigest(kind + digest) - 2**63


def template_hashes(node: Node, total: int) -> list[int]:
    """The hashes under which a subtree can be known as part of the site's template."""
    if node.tag not in _CONTAINER:
        return []
    if node.in_article:
        return [_number("exact", node.exact)]
    if node.size > MAX_TEXT * total:
        return []
    return [_number("exact", node.exact), _number("shape", node.shape)]


def _named(node: Node, words: frozenset) -> bool:
    """Whether a whole class, id or role is one of the words, or made of them and of ``_BESIDE``."""
    for name in node.names & words:
        return True
    for name in node.names:
        parts = set(_WORD.findall(name))
        if parts & words and parts <= words | _BESIDE:
            return True
    return False


def _not_shown(node: Node) -> bool:
    """What no page shows as its article, by its element alone."""
    return node.tag in _HIDDEN or node.hidden or node.tag in _NAMED


def _names_itself(node: Node, total: int) -> bool:
    """Whether an element says that it is something else than the article.

    Inside of the article, only comments, adverts and the like. Outside, an element that holds an article or the
    page's heading never goes by its name, nor does one with more than ``MAX_TEXT`` of the text, save headers and comments.
    """
    if _not_shown(node):
        return True
    if node.tag in ("", "html", "body", "main") or not (node.names or node.tag == "header"):
        return False
    if node.tag == "article" or node.in_article:
        return _named(node, _NOT_ARTICLE)
    if node.holds_article:
        return False
    if node.tag == "header" or _named(node, _NOT_ARTICLE):
        return True
    return node.size <= MAX_TEXT * total and _named(node, _HEADED)


def main_text(html: str, template: frozenset) -> str:
    """The text of a page without the subtrees of its site's template, one block a line.

    A page of which names and template would leave nothing keeps all that its elements show.
    """
    root = parse(html)
    nodes = _walk(root)
    _hash_all(nodes)
    dropped = {
        id(n) for n in nodes if _names_itself(n, root.size) or any(h in template for h in template_hashes(n, root.size))
    }
    return _text_without(root, nodes, dropped) or _text_without(root, nodes, {id(n) for n in nodes if _not_shown(n)})


def _text_without(root: Node, nodes: list[Node], dropped: set[int]) -> str:
    # an article element stands for the page if it has most of the text that is left
    left: dict[int, int] = {}
    for n in reversed(nodes):
        own = 0 if id(n) in dropped else sum(len(c) if isinstance(c, str) else left[id(c)] for c in n.children)
        left[id(n)] = own
    starts = [root]
    for tag in ("article", "main"):
        found = [n for n in nodes if n.tag == tag and id(n) not in dropped and left[id(n)]]
        inner: set[int] = set()
        for n in nodes:  # parents come first
            if n.parent is not None and (id(n.parent) in inner or n.parent.tag == tag):
                inner.add(id(n))
        found = [n for n in found if id(n) not in inner]
        if found and 2 * sum(left[id(n)] for n in found) >= left[id(root)]:
            starts = found
            break
    blocks: list[str] = []
    current: list[str] = []

    def close() -> None:
        text = " ".join("".join(current).split())
        current.clear()
        if text:
            blocks.append(text)

    todo: list = list(reversed(starts))
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            current.append(item)
        elif id(item) not in dropped:
            if item.tag in _BLOCK:
                close()
                todo.append(None)
            elif item.tag in ("br", "td", "th", "option"):
                current.append(" ")
            todo.extend(reversed(item.children))
    close()
    return "\n".join(blocks)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, template``: the hashes of a host's recurring subtrees, for hosts that have any.

    A host has at most ``1 / min_share`` times as many as one page has containers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes = [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(html.as_py() or "")
                nodes = _walk(root)
                _hash_all(nodes)
                own = {h for n in nodes for h in template_hashes(n, root.size)}
                hosts += [host] * (len(own) + 1)
                hashes += [None, *own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["host", "hash"])

    counts = (
        pages.select(host_of(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
        .mapInArrow(run, "host string, hash long")
        .groupBy("host", "hash")
        .agg(F.count("*").alias("n"))
        .where(F.col("hash").isNull() | (F.col("n") >= min_pages))
    )
    counts = stored(counts, "template-counts")  # read twice, counted once
    sizes = counts.where("hash is null").select(F.col("host").alias("_host"), F.col("n").alias("pages"))
    # the share decides before anything is gathered, so that a host's list is as short as it says
    recurring = counts.where("hash is not null").join(sizes, F.col("host").eqNullSafe(F.col("_host")))
    return (
        recurring.where(F.col("n") >= F.lit(min_share) * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_list("hash").alias("template"))
    )


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row.

    A null or empty page has the empty text. A null URL, or one without ``://``, belongs to the
    host without a name. Repeated rows and null ids keep their own rows. An empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def text_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[bytes, frozenset] = {}
        for html, template in batches:
            out = []
            for page, own in zip(html, template, strict=True):
                key = b"" if own is None else own.tobytes()
                if key not in known:
                    if len(known) > 1_000:
                        known.clear()
                    known[key] = frozenset() if own is None else frozenset(own.tolist())
                out.append(main_text(page or "", known[key]))
            yield pd.Series(out, dtype=object)

    html, url = F.col("html").cast("string").alias("html"), F.col("url").cast("string")
    salt = F.pmod(F.hash("page_id", url, html), F.lit(SALTS)).alias("salt")
    own = pages.select("page_id", "url", html, host_of(url).alias("host"), salt)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    found = own.join(templates(pages, min_pages, min_share).withColumn("salt", salts), ["host", "salt"], "left")
    return found.select("page_id", "url", text_of("html", "template").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
