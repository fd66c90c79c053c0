"""Main text of web pages by wrapper induction.

Pages become small DOM trees in which runs of like siblings are one repeating node. The trees of
a host's pages are aligned by simple tree matching and merged into the host's template, whose
nodes count on how many pages they stand, which texts they hold on how many pages, and how much
of their text is links. Texts that most of a host's pages hold at the same place are the wrapper,
and so are blocks outside an article that are nearly all links, whatever the links say; nodes whose
text varies are slots for content. No node and no text is left out of the template, and a host's texts
are counted by shuffles, not in one task. A page's text is that of its slots within the article, without
elements that say what they are (menus, headers, footers, sidebars, notices, adverts, forms, comments).
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import discard, materialise
from foliospark.llm.url_filter import url_host

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never main text.
ASIDE = frozenset("nav header footer aside form menu dialog button input label select option head audio video canvas".split())
#: Words of class, id and role values that say the same, if a whole value consists of them and of PLACE_WORDS.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split()
)
#: Words that only place such an element: site-header, main-nav.
PLACE_WORDS = frozenset("site main top bottom left right primary secondary global mobile section area box list bar wrapper".split())
#: Never set aside by a class, id or role.
CONTENT = frozenset("html body main article".split())
_CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
    "tbody": ("tr td th thead tbody", ("table",)), "tfoot": ("tr td th thead tbody", ("table",)), "thead": ("tr td th", ("table",)),
}
_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<bang>[!?])[^>]*>|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Different pages, and share of the host's pages, that must hold a text at a place for it to be wrapper.
SUPPORT, SHARE = 3, 0.5
#: The same for paragraphs and headings, and for anything inside an article or main element.
BLOCK_SUPPORT, BLOCK_SHARE = 5, 0.9
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: A block on SUPPORT pages with so many links a page and such a share of its text in them is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.8
#: Levels of a page that take part in the alignment; deeper text is extracted all the same.
DEPTH = 200
#: Texts that a task holds, and hosts, before it writes them as partial counts and starts anew.
HELD_TEXTS, HELD_HOSTS = 50_000, 1000


class Node:
    __slots__ = ("aside", "children", "key", "tag")

    def __init__(self, tag: str, key: str, aside: bool):
        self.tag, self.key, self.aside = tag, key, aside
        self.children: list[Node | str] = []


def _says_aside(token: str) -> bool:
    """cookie-notice and site-header, but not has-sidebar."""
    words = set(_WORD.findall(token))
    return bool(words & ASIDE_WORDS) and words <= ASIDE_WORDS | PLACE_WORDS


def parse(page: str) -> Node:
    """A forgiving DOM: missing and stray end tags, raw text elements, comments and references are handled."""
    root = Node("#root", "#root", False)
    stack, at = [root], 0

    def close(names: tuple[str, ...] | set[str], stops: tuple[str, ...]) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                del stack[depth:]
                return
            if stack[depth].tag in stops:
                return

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "br":
                stack[-1].children.append(" ")
            elif any(n.tag == tag for n in stack):
                close((tag,), () if tag in BLOCK else ("td", "th", "table", "article", "body"))
            continue
        if tag in RAW:
            if not m["rest"].endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else len(page) if tag in ("script", "style") else at
            continue
        if tag in BLOCK:
            close(("p",), ("article", "section", "div", "td", "th", "li", "blockquote", "body", "button", "object"))
        if tag in _CLOSES:
            names, stops = _CLOSES[tag]
            close(tuple(names.split()), stops)
        said = [x.lower() for a in _NAMED.finditer(m["rest"]) for x in (a[2] or a[3] or a[4] or "",)]
        named = tag not in CONTENT and any(_says_aside(token) for value in said for token in value.split())
        # Values with digits change from page to page, and so may those of the page itself.
        steady = sorted(t for value in said for t in value.split() if not any(c.isdigit() for c in t)) if tag not in CONTENT else []
        node = Node(tag, tag + "".join("." + t for t in steady), tag in ASIDE or named)
        stack[-1].children.append(" " if tag == "br" else node)
        if tag not in VOID and not m["rest"].rstrip().endswith("/"):
            stack.append(node)


def _sign(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


# A template node: [key, pages, links, characters in links, characters, {sign of a text: [pages, some pages]}, names, children].
# Links and characters are those of the whole subtree. Names are those under which tasks have written its texts.


def outline(node: Node, depth: int = DEPTH) -> list:
    """The page as a template of itself, runs of like siblings merged."""
    text = own_text(node)
    made: list[list] = []
    for child in node.children if depth else ():
        if isinstance(child, Node) and not child.aside:
            part = outline(child, depth - 1)
            if made and made[-1][0] == part[0]:
                made[-1] = merge(made[-1], part, siblings=True)
            else:
                made.append(part)
    size = len(text) + sum(c[4] for c in made)
    if node.tag == "a":
        links, linked = 1, size
    else:
        links, linked = (sum(c[k] for c in made) for k in (2, 3))
    return [node.key, 1, links, linked, size, {_sign(text): [1, []]} if text else {}, [], made]


def _matching(a: list[list], b: list[list], known: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the aligned pairs in order that match most nodes."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [(i, i) for i in range(len(a))]
    # A child whose key the other side lacks has no partner, so it takes no part.
    places: dict[str, list[int]] = {}
    ours = {x[0] for x in a}
    right = [j for j, y in enumerate(b) if y[0] in ours]
    for n, j in enumerate(right):
        places.setdefault(b[j][0], []).append(n)
    left = [i for i, x in enumerate(a) if x[0] in places]
    at = {key: np.array(ns) for key, ns in places.items()}

    def above(i: int, below: np.ndarray) -> np.ndarray:
        """The most nodes that children from ``i`` on match with those from each place on, given those of ``i + 1``."""
        x = a[left[i]]
        ns = at[x[0]]
        scores = np.array([_score(x, b[right[n]], known) for n in ns]) if x[-1] else 1
        row = below.copy()
        row[ns] = np.maximum(row[ns], below[ns + 1] + scores)
        return np.maximum.accumulate(row[::-1])[::-1]

    # One row in ``step`` is kept and those between are made again, so long lists don't need the whole square.
    step = int(len(left) ** 0.5) + 1
    row, kept = np.zeros(len(right) + 1, np.int64), {}
    for i in range(len(left), -1, -1):
        row = above(i, row) if i < len(left) else row
        if i % step == 0 or i == len(left):
            kept[i] = row
    pairs, n = [], 0
    for first in range(0, len(left), step):
        last = min(first + step, len(left))
        rows = {last: kept[last]}
        for i in range(last - 1, first - 1, -1):
            rows[i] = above(i, rows[i + 1])
        i = first
        while i < last and n < len(right):
            x, y = a[left[i]], b[right[n]]
            if x[0] == y[0] and rows[i][n] == rows[i + 1][n + 1] + _score(x, y, known):
                pairs.append((left[i], right[n]))
                i, n = i + 1, n + 1
            elif rows[i][n] == rows[i + 1][n]:
                i += 1
            else:
                n += 1
    return pairs


def _score(a: list, b: list, known: dict[tuple[int, int], int]) -> int:
    if not a[-1] or not b[-1]:
        return 1
    pair = id(a), id(b)
    if pair not in known:
        known[pair] = 1 + sum(_score(a[-1][i], b[-1][j], known) for i, j in _matching(a[-1], b[-1], known))
    return known[pair]


def _texts(a: dict[int, list], b: dict[int, list], add) -> dict[int, list]:
    """``a`` with the texts of ``b``."""
    for sign, (n, some) in b.items():
        m, others = a.get(sign, (0, ()))
        a[sign] = [add(m, n), sorted({*others, *some})[:BLOCK_SUPPORT]]
    return a


def merge(a: list, b: list, siblings: bool | None = None, known: dict[tuple[int, int], int] | None = None) -> list:
    """Two aligned nodes as one. Of different pages (``siblings`` False) counts add up; of one page
    (``siblings`` True) only links and characters do; the same node twice (None) stays as it is.
    Whatever either has stays, in its order; ``a`` is used up."""
    known = {} if known is None else known
    pages, sizes = (max if siblings is not False else int.__add__), (max if siblings is None else int.__add__)
    pairs = _matching(a[-1], b[-1], known)
    made, i, j = [], 0, 0
    for x, y in [*pairs, (len(a[-1]), len(b[-1]))]:
        made += [*a[-1][i:x], *b[-1][j:y]]
        if x < len(a[-1]):
            made.append(merge(a[-1][x], b[-1][y], siblings, known))
        i, j = x + 1, y + 1
    # An aligned gap has no key on both sides, so no two like nodes have come next to each other.
    return [a[0], pages(a[1], b[1]), *(sizes(a[k], b[k]) for k in (2, 3, 4)), _texts(a[5], b[5], pages), [*a[6], *(x for x in b[6] if x not in a[6])], made]


class Template:
    """A host's merged outline and the signs of up to BLOCK_SUPPORT different pages."""

    def __init__(self, tree: list | None = None, pages: set[int] | None = None):
        self.tree, self.pages = tree, pages or set()
        if tree is not None and tree[1] == 1 and len(self.pages) == 1:  # a page of its own
            todo = [tree]
            for node in todo:
                for entry in node[5].values():
                    entry[1] = list(self.pages)
                todo += node[-1]

    def add(self, other: Template) -> None:
        self.tree = other.tree if self.tree is None else self.tree if other.tree is None else merge(self.tree, other.tree, siblings=False)
        self.pages = set(sorted(self.pages | other.pages)[:BLOCK_SUPPORT])

    def places(self) -> Iterator[tuple[list, str, int, float, bool]]:
        """(node, path, different pages and pages that must hold a text to make it wrapper, whether the node is a menu)."""
        if self.tree is None or len(self.pages) < SUPPORT:
            return
        todo = [(self.tree, "", False)]
        while todo:
            node, path, inside = todo.pop()
            key, pages, links, linked, size = node[:5]
            tag = key.split(".")[0]
            path, inside = f"{path}/{key}", inside or tag in ("article", "main")
            support, share = (BLOCK_SUPPORT, BLOCK_SHARE) if inside or tag in TEXT_BLOCKS else (SUPPORT, SHARE)
            menu = not inside and tag in BLOCK and tag not in CONTENT and pages >= SUPPORT and links >= MENU_LINKS * pages and linked >= MENU_SHARE * size
            yield node, path, support, share * self.tree[1], menu
            todo += [(c, path, inside) for c in node[-1]]

    def constants(self) -> list[tuple[str, int | None]]:
        """(path, sign) of the wrapper's texts, and (path, None) of its menus."""
        found: list[tuple[str, int | None]] = []
        for node, path, support, need, menu in self.places():
            found += [(path, sign) for sign, (n, some) in node[5].items() if len(some) >= support and n >= need]
            found += [(path, None)] if menu else []
        return sorted(found, key=str)


def _region(root: Node) -> list[Node]:
    """Articles (or main elements) that are not within another or set aside; else the whole page."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            for c in todo.pop().children:
                if isinstance(c, Node) and not c.aside:
                    (found if c.tag == wanted else todo).append(c)
        if found:
            return found
    return [root]


def extract(page: str, wrapper: frozenset[tuple[str, int | None]] = frozenset()) -> str:
    """The page's main text: blocks in page order, one to a line."""
    root = parse(page)
    region = set(map(id, _region(root)))
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(held).split()):
            blocks.append(block)
        held.clear()

    # A node to open (with its path, depth, inside), a text, or None to end a block.
    todo: list[tuple[Node, str, int, bool] | str | None] = [(root, "", 0, False)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        else:
            node, path, depth, inside = item
            path = f"{path}/{node.key}" if wrapper and depth <= DEPTH else ""
            inside = inside or id(node) in region
            is_block = node.tag in BLOCK or node.tag == "#root"
            if is_block:
                flush()
            if wrapper and (path, None) in wrapper and not _holds(node, region):
                continue
            skip = bool(wrapper) and (path, _sign(own_text(node))) in wrapper
            following: list = [None] if is_block else []
            for c in reversed(node.children):
                if isinstance(c, str):
                    if inside and not skip:
                        following.append(c)
                elif not c.aside:
                    following.append((c, path, depth + 1, inside))
                elif c.tag in BLOCK:
                    following.append(None)
            todo += following
    return "\n".join(blocks)


def _holds(node: Node, region: set[int]) -> bool:
    """Whether an article is below the node."""
    todo: list[Node] = [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if id(c) in region:
                    return True
                todo.append(c)
    return False


def _dump(template: Template) -> str:
    return json.dumps([template.tree, sorted(template.pages)])


def _load(data: str) -> Template:
    tree, pages = json.loads(data)
    for node in (todo := [tree] if tree else []):  # JSON has no numbers as keys
        node[5] = {int(sign): entry for sign, entry in node[5].items()}
        todo += node[-1]
    out = Template()
    out.tree, out.pages = tree, set(pages)
    return out


#: A task's template of a host, or (``template`` null) on how many pages a template node holds a text.
_OUTLINES = "host string, part long, template string, name long, sign long, n long, some array<long>"


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Template] = {}
    part, named, held = TaskContext.get().partitionId(), 0, 0

    def out() -> pa.RecordBatch:
        nonlocal named
        rows: list[tuple] = []
        for host, template in found.items():
            todo = [template.tree]
            for node in todo:
                name, named = part << 32 | named, named + 1
                rows += [(None, None, name, sign, n, some) for sign, (n, some) in node[5].items()]
                node[5], node[6] = {}, [name]
                todo += node[-1]
            rows.append((host, _dump(template), None, None, None, None))
        hosts, templates, names, signs, counts, some = zip(*rows) if rows else [()] * 6
        longs = [pa.array(x, pa.int64()) for x in (names, signs, counts)]
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([part] * len(rows), pa.int64()), pa.array(templates, pa.string()), *longs, pa.array(some, pa.list_(pa.int64()))], names=["host", "part", "template", "name", "sign", "n", "some"])

    for batch in batches:
        for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if page:
                tree = outline(parse(page))
                todo = [tree]
                for node in todo:
                    held += len(node[5])
                    todo += node[-1]
                found.setdefault(host, Template()).add(Template(tree, {_sign(page)}))
                if held > HELD_TEXTS or len(found) > HELD_HOSTS:
                    yield out()
                    found.clear()
                    held = 0
    yield out()


def _merged(table: pa.Table) -> Template:
    whole = Template()
    for data in sorted(table.column("template").to_pylist()):
        whole.add(_load(data))
    return whole


def _merge_parts(table: pa.Table) -> pa.Table:
    return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "part": pa.array([table.column("part")[0].as_py()], pa.int64()), "template": pa.array([_dump(_merged(table))], pa.string())})


def _places(table: pa.Table) -> pa.Table:
    """A row per name of a node, and one without a name per menu."""
    rows = []
    for number, (node, path, support, need, menu) in enumerate(_merged(table).places()):
        rows += [(path, number, name, support, need) for name in [*node[6], *([None] if menu else [])]]
    paths, numbers, names, supports, needs = zip(*rows) if rows else [()] * 5
    host = pa.array([table.column("host")[0].as_py()] * len(rows), pa.string())
    return pa.table({"host": host, "path": pa.array(paths, pa.string()), "node": pa.array(numbers, pa.int64()), "name": pa.array(names, pa.int64()), "support": pa.array(supports, pa.int64()), "need": pa.array(needs, pa.float64())})


def _wrapper(table: pa.Table) -> pa.Table:
    constants = sorted(set(zip(table.column("path").to_pylist(), table.column("sign").to_pylist(), strict=True)), key=str)
    return pa.table({"host": pa.array([table.column("host")[0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(constants)], pa.string())})


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", fan_in: int = 64) -> DataFrame:
    """(host, wrapper) of hosts that have one, as a written table.

    Each task sends a merged outline per host, however many pages it has, and outlines of one host
    are merged ``fan_in`` tasks at a time. They hold no texts: on how many pages a node of a task's
    outline holds a text goes out as rows, which are added up under the node of the host's template
    that it has become, so every text and every node counts in full.
    """
    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    written = materialise(rows.mapInArrow(_outlines, _OUTLINES), "outlines")
    outlines = written.filter("template IS NOT NULL").select("host", "part", "template")
    parts = rows.rdd.getNumPartitions()
    while parts > fan_in:
        outlines = outlines.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("host", "part").applyInArrow(_merge_parts, "host string, part long, template string")
        parts = -(-parts // fan_in)
    places = materialise(outlines.groupBy("host").applyInArrow(_places, "host string, path string, node long, name long, support long, need double"), "places")
    held = written.filter("template IS NULL").select("name", "sign", "n", "some").join(places.select("host", "node", "name", "support", "need"), "name")
    often = held.groupBy("host", "node", "sign").agg(F.sum("n").alias("n"), F.first("need").alias("need"), F.first("support").alias("support"))
    often = often.filter("n >= need AND n >= support").select("host", "node", "sign")
    shared = held.join(often, ["host", "node", "sign"]).select("host", "node", "sign", "support", F.explode("some").alias("page")).distinct()
    shared = shared.groupBy("host", "node", "sign").agg(F.count(F.lit(1)).alias("n"), F.first("support").alias("support")).filter("n >= support")
    texts = shared.join(places.select("host", "node", "path").distinct(), ["host", "node"]).select("host", "path", "sign")
    menus = places.filter("name IS NULL").select("host", "path", F.lit(None).cast("long").alias("sign"))
    wrappers = materialise(texts.union(menus).groupBy("host").applyInArrow(_wrapper, "host string, wrapper string"), "wrappers")
    discard(written, places)
    return wrappers


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset[tuple[str, int | None]]] = {}
    for batch in batches:
        texts = []
        for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if wrapper and wrapper not in known:
                if len(known) > 1000:
                    known.clear()
                known[wrapper] = frozenset((p, s) for p, s in json.loads(wrapper))
            texts.append(extract(page or "", known[wrapper] if wrapper else frozenset()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_rows: int = 10_000, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page has an empty text. Pages without a host (null url) form one group.
    Wrappers need SUPPORT different pages; copies of one page don't count as evidence, and on
    hosts with less only the elements' own marks decide. Elements more than DEPTH levels deep take
    no part in the alignment, but their text is extracted; a page may be of any length and depth.
    Wrappers are broadcast up to ``broadcast_rows`` hosts and ``broadcast_bytes`` and joined by a
    shuffle beyond. Repeated rows are extracted alike; an empty table gives an empty result; other
    columns are ignored.
    """
    wrappers = induce_wrappers(pages, url_col, html_col).withColumnRenamed("host", "wrapper_host")
    size = wrappers.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("wrapper")).alias("chars")).first()
    if size["n"] <= broadcast_rows and (size["chars"] or 0) <= broadcast_bytes:
        wrappers = F.broadcast(wrappers)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    joined = rows.join(wrappers, url_host(F.col("url")) == F.col("wrapper_host"), "left").select("page_id", "url", "html", "wrapper")
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return joined.mapInArrow(_extract, schema)
