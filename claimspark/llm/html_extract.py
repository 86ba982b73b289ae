"""Main text of web pages: site templates are removed by counting element subtrees per host.

Every page is parsed into a tree of elements. Each subtree (name, kind and text of all it holds) has a hash. Spark counts on how many
pages of a host every hash of a block outside running text occurs; blocks that recur on at least half of them are the site's template
and are deleted. Pages with the same reading text (copies) are counted once. Inline elements, blocks within a sentence, and parts of a
list or table never go by themselves; a recurring heading goes only where nothing of its own follows it; a block that holds more than
half of the page's reading text, with its title, is the page's body and stays with all in it. A page that would lose all its text to
templates keeps it. Elements that
are no reading text by their meaning (navigation, headers and footers of the page, sidebars, notices, adverts, forms, scripts,
styles, reader comments; by element name, role, or a whole token of class or id) go as well, but never one that is the page's body: it
holds more than half of the page's text, with the title, the marked article, or, on pages that mark none, mostly unlinked text.

Where a page marks its article (`article`, `main`, role main), the marked parts are chosen by their share of the text: articles
in the main part win if they hold half of it, an article wins over the page if it holds a third. A title that stands before the article stays.
Within it prose that recurs on half of the host's pages goes only at the edges (notices, licence lines): articles may quote each other.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in
page order by one space.

Defined results: null, empty or text-free html gives an empty string; unclosed and stray tags are repaired as browsers
do for paragraphs, lists and tables; a page without a parsable host counts as host ''; repeated rows get one result each;
every page is read with the templates of its own host, whatever its id (null and shared ids too); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import prepare, stored

#: Distinct pages of a host on which a block must occur to be a template, and the share of the host's distinct pages.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.5
#: Largest template table that is broadcast.
BROADCAST_BYTES = 16 << 20

#: Stands for the page itself among its subtrees.
PAGE = 0

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select
summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("br body caption dd dt head html legend li option tbody td tfoot th thead tr".split())
#: Start tag -> open elements that it ends, up to the given bounds.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# What is no reading text: by element, whatever it holds; by element, role, or a word of class or id, unless it is the page's body.
DROPPED = frozenset("""button canvas datalist dialog embed head iframe input menu nav noscript object
select script style svg template textarea title audio video""".split())
SECONDARY = frozenset("aside footer form".split())
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
DROPPED_WORDS = COMMENT_WORDS | frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs
consent cookie cookies footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup
promo promoted related share sharing sidebar social sponsor sponsored subscribe toolbar widget""".split())
#: Words that may follow one of `DROPPED_WORDS` in a token (`share-buttons`, but not `share-price`), and words that void a token.
PARTS = frozenset("""area bar block body bottom box button buttons cell col column container content form group holder icon icons
inner item items left link links list outer panel right row section slot text top unit wrap wrapper zone""".split())
VOIDING = frozenset("can has is js no not with without".split())
#: Articles of these words point to other pages.
CARD_WORDS = frozenset("card teaser tile".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be a template by themselves.
COUNTED = HEADINGS | frozenset("address blockquote center details dir div dl fieldset figure hgroup ol p pre section table ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption b i em strong span a code br".split())

# Possessive throughout: no position is read twice, so a page costs time in proportion to its length.
_TAG = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)|[!?])")
_TAG_END = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in RAW}
_WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_PART = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
# Numbers of references that are longer than any code point.
_ZEROS = re.compile(r"&#0{8,}+")
_DIGITS = re.compile(r"&#[0-9]{9,}+;?")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    __slots__ = ("name", "kinds", "role", "words", "children", "hash", "gross", "linked", "marked", "h1", "body", "size")

    def __init__(self, name: str, kinds: tuple[str, ...] = (), role: str = "", words: frozenset[str] = frozenset()) -> None:
        self.name, self.kinds, self.role, self.words, self.children, self.hash = name, kinds, role, words, [], b""
        self.gross, self.linked, self.marked, self.h1, self.body, self.size = 0, 0, 0, False, False, 0


def decode(piece: str) -> str:
    if "&#" in piece:
        piece = _DIGITS.sub("\ufffd", _ZEROS.sub("&#0", piece))
    return html.unescape(piece)


def furniture_words(tokens: list[str]) -> frozenset[str]:
    """The words by which tokens of class or id name their element: the last word, or the first before mere `PARTS`."""
    found = set()
    for token in tokens:
        words = [w.lower() for w in _PART.findall(token) if len(w) > 1]
        if not words or words[0] in VOIDING:
            continue
        if words[-1] in DROPPED_WORDS or words[-1] in CARD_WORDS:
            found.add(words[-1])
        elif words[0] in DROPPED_WORDS and all(w in PARTS or w in DROPPED_WORDS for w in words[1:]):
            found.add(words[0])
    return frozenset(found)


def parse(source: str) -> Node:
    """The element tree; children are nodes and decoded texts, in order."""
    root = Node("#root")
    open_nodes, at, quotes = [root], 0, True
    places: dict[str, list[int]] = {}  # name -> depths of its open elements

    def text(piece: str) -> None:
        if piece:
            open_nodes[-1].children.append(decode(piece))

    def close(name: str, bounds: set[str]) -> None:
        depths = places.get(name)
        if not depths or any(places.get(b) and places[b][-1] > depths[-1] for b in bounds):
            return
        depth = depths[-1]
        while len(open_nodes) > depth:
            places[open_nodes.pop().name].pop()

    while at < len(source):
        m = _TAG.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at:m.start()])
        if not m[2]:
            mark = "-->" if source.startswith("<!--", m.start()) else ">"
            end = source.find(mark, m.start() + 2)
            at = end + len(mark) if end >= 0 else len(source)
            continue
        whole = _TAG_END.match(source, m.end()) if quotes else None
        if whole:
            at = whole.end()
        else:  # a quote that swallows the page's end is none, and neither is any after it
            quotes = False
            at = source.find(">", m.end()) + 1
            if not at:
                text(source[m.start():])
                break
        inside = source[m.end():at - 1]
        name = m[2].lower()
        if m[1]:
            if name == "br":
                open_nodes[-1].children.append(Node("br"))
            elif name not in VOID:
                close(name, set() if name in ("body", "html") else {"table"} if name not in ("table", "tr", "td", "th", "tbody",
                                                                     "thead", "tfoot", "caption") else set())
            continue
        if name in ENDS_P:
            close("p", {"table", "td", "th", "button", "object"})
        if name in ENDS:
            ended, bounds = ENDS[name]
            for other in ended:
                close(other, bounds)
        kinds, role, words = (), "", frozenset()
        if "=" in inside:
            found = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(inside)
                     if a[0].lower() in ("class", "id", "role")}
            role = found.get("role", "").strip().lower()
            named = found.get("class", "") + " " + found.get("id", "")
            kinds = tuple(w.lower() for w in _WORD.findall(named))
            words = furniture_words(named.split())
        node = Node(name, kinds, role, words)
        open_nodes[-1].children.append(node)
        if name in RAW:
            end = _RAW_ENDS[name].search(source, at)
            node.children.append(decode(source[at:end.start() if end else len(source)]))
            at = end.end() if end else len(source)
        elif name not in VOID and not inside.endswith("/"):
            places.setdefault(name, []).append(len(open_nodes))
            open_nodes.append(node)
    return root


def _postorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    return out[::-1]


def hash_subtrees(root: Node) -> None:
    """Set the hash of every element (b'' where nothing is to be read below it) and its weights (see `_weigh`)."""
    nodes = _postorder(root)
    for node in nodes:
        h, some = blake2b(digest_size=8), False
        h.update(node.name.encode() + b"\0" + " ".join(node.kinds).encode("utf-8", "replace"))
        for child in node.children:
            if isinstance(child, Node):
                h.update(b"\1" + child.hash)
                some = some or bool(child.hash)
            else:
                words = " ".join(child.split())
                h.update(b"\2" + words.encode("utf-8", "replace"))
                some = some or bool(words)
        node.hash = h.digest() if some else b""
    _weigh(nodes)


def _is_mark(node: Node) -> bool:
    return node.name in ("article", "main") or node.role in ("article", "main")


def _weigh(nodes: list[Node]) -> None:
    """Weights of elements, given children first: `gross` characters without `DROPPED` elements and reader comments, those
    `linked` or in a `marked` article, whether an `h1` is inside, whether it is the page's `body`, and the `size` of its reading text."""
    for node in nodes:
        node.h1 = node.name == "h1"
        for child in node.children:
            if isinstance(child, str):
                node.gross += len("".join(child.split()))
            elif child.name not in DROPPED and (child.h1 or not COMMENT_WORDS & child.words):
                node.gross += child.gross
                node.linked += child.linked
                node.marked += child.marked
                node.h1 = node.h1 or child.h1
        if node.name == "a":
            node.linked = node.gross
        if _is_mark(node) and (node.name == "main" or not node.words):
            node.marked = node.gross
    page = nodes[-1]
    for node in nodes:
        if node.gross * 2 > page.gross:
            unmarked = not page.marked and node.name not in ("aside", "footer") and node.linked * 2 <= node.gross
            node.body = node.h1 or not COMMENT_WORDS & node.words and (node.marked * 2 > page.gross or unmarked)
        for child in node.children:
            if isinstance(child, str):
                node.size += len("".join(child.split()))
            elif not is_furniture(child, True):
                node.size += child.size


def is_furniture(node: Node, in_article: bool) -> bool:
    """True for elements that are no reading text by their meaning."""
    if node.name in DROPPED:
        return True
    if node.body:
        return False
    if node.name in SECONDARY or node.role in DROPPED_ROLES:
        return True
    if node.name == "header":
        return not in_article
    words = node.words & DROPPED_WORDS if node.name != "article" else node.words
    if in_article:
        words -= {"header", "masthead"}  # an article's own header holds its title
    return bool(words) and node.name not in ("html", "body", "main")


def _outermost(root: Node, marked, inside: bool = False) -> list[Node]:
    """The outermost elements below `root` that `marked` accepts, in page order, outside furniture."""
    found, todo = [], [c for c in root.children[::-1] if isinstance(c, Node) and not is_furniture(c, inside)]
    while todo:
        node = todo.pop()
        if marked(node):
            found.append(node)
        else:
            todo += [c for c in node.children[::-1] if isinstance(c, Node) and not is_furniture(c, inside)]
    return found


def _size(nodes: list[Node]) -> int:
    return sum(n.size for n in nodes)


def _article(root: Node) -> Node | None:
    """The marked part that is the article, by its share of the text; a common parent for several, or for a title and its article."""
    marks = _outermost(root, _is_mark)
    mains = [n for n in marks if "main" in (n.name, n.role)]
    chosen = [n for n in marks if n not in mains]
    scope = root
    if mains and _size(mains) >= _size(chosen):
        chosen, scope = mains, Node("#mains")
        scope.children = mains
        inner = [a for m in mains for a in _outermost(m, _is_mark, True)]
        if inner and 2 * _size(inner) >= _size(mains):
            chosen = inner
    elif 3 * _size(chosen) < root.size:
        return None
    if not chosen:
        return None
    if not any(n.h1 for n in chosen):
        first = chosen[0]
        before = _outermost(scope, lambda n: n is first or n.name == "h1", scope is not root)
        place = next((k for k, n in enumerate(before) if n is first), 0)
        chosen = before[max(place - 1, 0):place] + chosen
    if len(chosen) == 1:
        return chosen[0]
    out = Node("#articles")
    out.children, out.size = chosen, _size(chosen)
    return out


def _in_sentence(children: list, place: int) -> bool:
    """True for an element next to text or to an inline element that holds text."""
    for step in (-1, 1):
        k = place + step
        while 0 <= k < len(children):
            other = children[k]
            if isinstance(other, Node):
                if other.name in BLOCK:
                    break
                if other.hash:
                    return True
            elif other.strip():
                return True
            k += step
    return False


def counted_blocks(root: Node) -> list[Node]:
    """The blocks that can be a template: outside furniture and running text; hashes must be set."""
    found, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        for k, child in enumerate(node.children):
            if isinstance(child, Node) and child.hash and not is_furniture(child, inside) and not _in_sentence(node.children, k):
                if child.name in COUNTED:
                    found.append(child)
                if child.name not in HEADINGS and child.name not in ("p", "pre"):
                    todo.append((child, inside or not {"article", "main"}.isdisjoint((child.name, child.role))))
    return found


def read_text(root: Node, templates: frozenset[bytes]) -> str:
    """Blocks of reading text, without furniture and template blocks; hashes must be set."""
    article = _article(root)
    inside = article is not None
    top = article or root
    # element -> whether it goes wherever it stands, or only at the article's edges
    found = {id(n): not (inside and n.name in PROSE) for n in counted_blocks(root) if n.hash in templates} if templates else {}
    blocks: list[tuple[str, bool, bool]] = []  # text, goes at an edge, heading
    current: list[str] = []
    edge = heading = False

    def flush() -> None:
        words = " ".join("".join(current).split())
        if words:
            blocks.append((words, edge, heading))
        current.clear()

    def is_body(node: Node) -> bool:
        if not any(isinstance(c, Node) and c.name in BLOCK for c in node.children):
            return False
        return node.size * 2 > top.size and (inside or node.h1 or node.marked > 0)

    def push(node: Node, exempt: bool) -> None:
        gone = True  # whether nothing of its own follows a heading
        for child in node.children[::-1]:
            if isinstance(child, str):
                gone = gone and not child.strip()
                todo.append((child, exempt))
                continue
            own = exempt
            template = not exempt and found.get(id(child), False)
            if template and is_body(child):
                template, own = False, True
            if is_furniture(child, inside) or template and (child.name not in HEADINGS or gone):
                gone = True
                if child.name in BLOCK:
                    todo.append((None, None))
            else:
                gone = gone and not child.hash
                todo.append((child, own))

    todo: list = []
    push(top, False)
    while todo:
        item, exempt = todo.pop()
        if item is None:
            flush()
            if exempt is not None:
                edge, heading = exempt
        elif isinstance(item, str):
            current.append(item)
        else:
            if item.name in BLOCK:
                flush()
                todo.append((None, (edge, heading)))
                edge = edge or inside and not exempt and id(item) in found and not found[id(item)] and item.name not in HEADINGS
                heading = heading or item.name in HEADINGS
            push(item, exempt)
    flush()
    if found and not blocks:
        return read_text(root, frozenset())
    own = [k for k, (_, at_edge, title) in enumerate(blocks) if not at_edge and not title]
    if own:
        blocks = [b for k, b in enumerate(blocks) if not b[1] or own[0] < k < own[-1]]
    return " ".join(b[0] for b in blocks)


def _send_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, content, subtrees) of every page: the hash of its reading text, and its distinct countable blocks with `PAGE` in front."""
    for batch in batches:
        contents, lists = [], []
        for source in batch.column("html").to_pylist():
            root = parse(source or "")
            hash_subtrees(root)
            text = read_text(root, frozenset())
            contents.append(int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
            own = {int.from_bytes(n.hash, "little", signed=True) for n in counted_blocks(root)}
            lists.append([PAGE, *sorted(own - {PAGE})])
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(contents, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                                         names=["host", "content", "subtrees"])


def page_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST.pattern, 1))


def _source(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    prepare(pages.sparkSession)
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        page_host(F.col(url_col)).alias("host"))


def site_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   min_pages: int = TEMPLATE_PAGES, min_share: float = TEMPLATE_SHARE) -> DataFrame:
    """(host, subtree, pages) of template subtrees; `pages` counts pages of distinct reading text.

    Copies share one row before the count, with one copy's blocks (the same one in every run). Counts are summed map-side, so a large host is
    no hot group.
    """
    src = _source(pages, id_col, url_col, html_col)
    sent = src.select("host", "html").mapInArrow(_send_subtrees, "host string, content long, subtrees array<long>")
    distinct = sent.groupBy("host", "content").agg(F.min("subtrees").alias("subtrees"))
    counted = (distinct.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree")
               .agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages))
    counted = stored(counted, "page-blocks")  # blocks on `min_pages` distinct pages and more, and the hosts' sizes
    sizes = counted.where(F.col("subtree") == PAGE).select("host", F.col("pages").alias("host_pages"))
    found = counted.where(F.col("subtree") != PAGE).join(sizes, "host")
    return found.where(F.col("pages") >= F.col("host_pages") * min_share).select("host", "subtree", "pages")


def _read_pages(batches: Iterator[pa.RecordBatch], templates_of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for row, source in enumerate(batch.column("html").to_pylist()):
            root = parse(source or "")
            hash_subtrees(root)
            texts.append(read_text(root, templates_of(batch, row)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def _signed(values) -> frozenset[bytes]:
    return frozenset(v.to_bytes(8, "little", signed=True) for v in values or ())


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_pages: int = TEMPLATE_PAGES, min_share: float = TEMPLATE_SHARE) -> DataFrame:
    """id, url, text and n_chars (code points) of every page.

    Templates (they grow with the hosts, not the pages) are broadcast while they fit `BROADCAST_BYTES`, and pages stay
    where they are. Beyond it one row per host is joined to the host's pages: each template is on a `min_share` of them, so a row
    holds at most 1 / `min_share` times a page's subtrees. A host with a third of all pages is then a skewed join
    key, which adaptive execution splits.
    """
    src = _source(pages, id_col, url_col, html_col)
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long"
    templates = stored(site_templates(pages, id_col, url_col, html_col, min_pages, min_share), "page-templates")
    size = templates.agg(F.coalesce(F.sum(F.octet_length("host") + 32), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        by_host: dict[str, list[int]] = {}
        for r in templates.toLocalIterator():
            by_host.setdefault(r["host"], []).append(r["subtree"])
        sent = pages.sparkSession.sparkContext.broadcast({h: _signed(v) for h, v in by_host.items()})
        out = src.mapInArrow(lambda it: _read_pages(
            it, lambda batch, row: sent.value.get(batch.column("host")[row].as_py(), frozenset())), schema)
    else:
        of_host = templates.groupBy("host").agg(F.collect_list("subtree").alias("templates"))
        out = src.join(of_host, "host", "left").mapInArrow(lambda it: _read_pages(
            it, lambda batch, row: _signed(batch.column("templates")[row].as_py())), schema)
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
