"""Main text of web pages by consensus: each host votes on the path of its content container.

Every page is read into a tree by a tolerant reader (unclosed tags, stray ends,
broken attributes and character references are all taken as browsers take them).
Containers are scored by the text of their own blocks and half of what lies
below; the best one of a page, widened to the article around it, votes for its
path: tag names with their classes and ids, digits generalised.  Spark sums the
votes per host and path and ranks the paths of each host.  A second pass reads
the pages again and takes what the host's best path present in the page selects.
A page whose host has no path that it holds falls back on its own best container.

Left out inside the container: navigation, forms, asides, page headers and
footers, scripts and styles, adverts, notices and comments (by tag, role, or by
the words of class and id), and lists that hold links and nothing else.

Votes are summed inside each batch before they are shuffled (a host and path per
batch at most), and only paths with a share of a host's votes are listed, so one host may hold any share of the pages.  Winners travel to the
pages by a broadcast only if their measured size allows; else by a join on
host and a salt, with each host's winners copied to every salt.

Defined results: a null or empty html gives ''; a null url votes as host '';
repeated rows are extracted alike; a page without any container of text gives
''; other columns pass through (``text`` and ``n_chars`` replace columns so
called); an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxscan.session import BROADCAST_BYTES, measured_bytes, stage

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that close an open paragraph, and what closes an element of the same kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
P_SCOPE = frozenset(("button", "table", "td", "th", "caption", "object"))
#: How far up an end tag or an implied end may look.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "thead": {"table"}, "tbody": {"table"}, "option": {"select"}}
#: Blocks whose text belongs to the container around them.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption address summary figure hr".split())
#: Containers that hand their text on to the one around them.
LISTS = frozenset("ul ol dl".split())

#: Elements that are never article text.
LEFT_OUT = frozenset("nav aside footer button select dialog menu svg canvas audio video object".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words of class or id that mark what is not the article.
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "promotion promoted banner banners nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars "
    "aside rail footer foot masthead topbar toolbar comment comments commentlist disqus respond reply replies "
    "discussion cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget widgets pagination pager paging skip hidden breaking toc".split()
)
#: Words of an element that holds a whole article.
WHOLE = frozenset("article post entry story hentry".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
_DIGITS = re.compile(r"\d+")


@dataclass(slots=True)
class Node:
    """A container.  ``bad``: 0 no, 1 by its words only, 2 by its tag or role."""

    tag: str
    parent: int
    name: str
    bad: int
    whole: bool
    passes: bool
    left_out: bool = False
    article: bool = False
    own: float = 0.0
    below: float = 0.0
    size: int = 0
    plain: int = 0


@dataclass(slots=True)
class Block:
    node: int
    text: str
    linked: int
    heading: bool


@dataclass(slots=True)
class Page:
    """The containers and text blocks of a page, in order."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _names(attributes: str) -> tuple[list[str], list[str], str, bool]:
    """Classes, ids, role and whether the element is hidden; the first of repeated attributes counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found.get("class", "").split(), found.get("id", "").split(), found.get("role", "").lower(), "hidden" in found


def _words(names: list[str]) -> set[str]:
    return {w.lower() for name in names for w in _WORD.findall(name)}


class _Reader:
    """One pass over the tags of a page."""

    def __init__(self) -> None:
        self.page = Page([Node("", -1, "", 0, False, False)])
        self.open: list[tuple[str, int]] = [("", 0)]
        self.count: dict[str, int] = {}
        self.articles = 0
        self.text: list[str] = []
        self.linked = 0
        self.in_link = False

    def flush(self) -> None:
        """Ends the block that is being read."""
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                tag, node = self.open[-1]
                self.page.blocks.append(Block(node, text, min(self.linked, len(text)), tag in HEADINGS))
            self.text = []
        self.linked, self.in_link = 0, False

    def words(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.text.append(text)
        if self.in_link:
            self.linked += len(" ".join(text.split()))

    def push(self, tag: str, node: int) -> None:
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1

    def close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Closes the nearest open element of these tags and all inside it, unless ``stop`` comes first."""
        if not any(self.count.get(tag) for tag in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name in tags:
                for gone, _ in self.open[k:]:
                    self.count[gone] -= 1
                del self.open[k:]
                return
            if name in stop:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = True
            elif tag == "br":
                self.text.append(" ")
            return
        self.flush()
        if tag in VOID or tag == "head" or tag in ("html", "body") and self.count.get(tag):
            return
        self.close({"p"}, P_SCOPE)
        if tag in HEADINGS and self.open[-1][0] in HEADINGS:
            self.close(HEADINGS, frozenset())
        if tag in CLOSES:
            for _ in range(3 if tag in ("tr", "thead", "tbody") else 1):
                self.close(CLOSES[tag], SCOPE[tag])
        parent = self.open[-1][1]
        above = self.page.nodes[parent]
        classes, ids, role, hidden = _names(attributes) if attributes.strip() else ([], [], "", False)
        words = _words(classes + ids)
        bad = 0
        if tag in LEFT_OUT or role in LEFT_OUT_ROLES or hidden:
            bad = 2
        elif tag in ("html", "body"):
            pass
        elif tag == "form" or words & BAD_WORDS:
            bad = 1
        elif (tag == "header" or "header" in words) and not above.article:
            bad = 1  # the page's; the header of an article holds its title
        if tag in BLOCKS and not bad:
            self.push(tag, parent)
            return
        name = ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in classes}), *("@" + _DIGITS.sub("#", i) for i in ids)])
        whole = tag in ("article", "main") or role == "main" or tag in ("div", "section", "td") and bool(words & WHOLE)
        self.page.nodes.append(Node(
            tag, parent, name, bad, whole, tag in LISTS, article=above.article or whole))
        self.push(tag, len(self.page.nodes) - 1)

    def end(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = False
            elif tag == "br":
                self.text.append(" ")
            return
        self.flush()
        if tag not in VOID and tag not in ("html", "body"):
            self.close({tag}, SCOPE.get(tag, frozenset()))


def read_page(source: str) -> Page:
    """The containers and blocks of a page, with sizes and scores."""
    reader = _Reader()
    at, size, tag_of = 0, len(source), _TAG
    while at < size:
        begin = source.find("<", at)
        if begin < 0:
            reader.words(source[at:])
            break
        if begin > at:
            reader.words(source[at:begin])
        mark = source[begin + 1:begin + 2]
        if mark in ("!", "?"):
            close = "-->" if source.startswith("<!--", begin) else ">"
            end = source.find(close, begin + 2)
            at = size if end < 0 else end + len(close)
            continue
        found = tag_of.match(source, begin)
        if found is None and mark and (mark == "/" or mark.isascii() and mark.isalpha()):
            if tag_of is _TAG and (found := _BROKEN_TAG.match(source, begin)):
                tag_of = _BROKEN_TAG  # a quote is never closed; looking for it again would read the rest each time
            elif mark != "/":
                break  # a tag that is cut off at the end of the page
        if found is None:
            reader.words("<")
            at = begin + 1
            continue
        at = found.end()
        ending, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
        if tag in RAW:
            if not ending:
                close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                at = size if close is None else close.end()
        elif ending:
            reader.end(tag)
        else:
            reader.start(tag, attributes)
    reader.flush()
    _measure(reader.page)
    return reader.page


def path_of(page: Page, k: int) -> str:
    """Names of a container and those around it, as far as ``PATH_DEPTH`` of them."""
    names = []
    while k > 0 and len(names) < PATH_DEPTH:
        names.append(page.nodes[k].name)
        k = page.nodes[k].parent
    return ">".join(reversed(names))


def _measure(page: Page) -> None:
    """Sizes and scores of all containers, and which are left out."""
    nodes = page.nodes
    for block in page.blocks:
        node = nodes[block.node]
        node.size += len(block.text)
        node.plain += 0 if block.heading else len(block.text)
    # an element that is left out for its words alone is kept if it wraps the page's article
    wraps = [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        node = nodes[k]
        wraps[node.parent] |= wraps[k] or node.tag in ("article", "main") and not node.bad
    for k, node in enumerate(nodes):
        node.left_out = k > 0 and nodes[node.parent].left_out or node.bad == 2 or node.bad == 1 and not wraps[k]
    for block in page.blocks:
        nodes[block.node].own += max(0, len(block.text) - 2 * block.linked)
    for k in range(len(nodes) - 1, 0, -1):
        node = nodes[k]
        if not node.left_out:
            above = nodes[node.parent]
            above.below += _weight(node) * (1 if node.passes else 0.5)
            above.size += node.size
            above.plain += node.plain


def _weight(node: Node) -> float:
    """Text of the container itself and, by half, of those below it."""
    return node.own + node.below


def best_container(page: Page) -> int:
    """The container of most text, widened to its article and to headings beside it; -1 without text."""
    nodes = page.nodes
    found = [k for k, node in enumerate(nodes) if not node.left_out and not node.passes]
    best = max(found, key=lambda k: (_weight(nodes[k]), -k), default=-1)
    if best < 0 or _weight(nodes[best]) <= 0:
        return -1
    above = [best]
    while above[-1] > 0:
        above.append(nodes[above[-1]].parent)
    for tag in ("article", "main"):
        inner = next((k for k in above if nodes[k].tag == tag), None)
        if inner is not None:
            return inner
    best = next((k for k in reversed(above) if nodes[k].whole), best)
    while best > 0:
        outer = nodes[nodes[best].parent]
        if outer.plain != nodes[best].plain or outer.size == nodes[best].size:
            break  # it adds more than headings, or nothing
        best = nodes[best].parent
    return best


def texts_of(page: Page, containers: list[int]) -> list[str]:
    """The blocks inside these containers, in page order, without what is left out."""
    chosen = set(containers)
    state: list[int] = []  # 0 outside, 1 inside, 2 left out, for each node
    for k, node in enumerate(page.nodes):
        above = state[node.parent] if k else 0
        state.append(2 if above == 2 or node.left_out else 1 if above == 1 or k in chosen else 0)
    links = _link_lists(page)
    return [b.text for b in page.blocks if state[b.node] == 1 and b.node not in links]


def _link_lists(page: Page) -> set[int]:
    """Containers whose blocks are links and nothing else, three at least."""
    count: dict[int, list[int]] = {}
    for b in page.blocks:
        sums = count.setdefault(b.node, [0, 0, 0])
        sums[0] += 1
        sums[1] += len(b.text)
        sums[2] += b.linked
    return {k for k, (n, size, linked) in count.items() if n >= 3 and linked >= 0.9 * size}


def vote(source: str | None) -> str | None:
    """The path of a page's best container."""
    page = read_page(source or "")
    best = best_container(page)
    return None if best < 0 else path_of(page, best)


def extract(source: str | None, paths: list[str]) -> str:
    """The text that the first of these paths selects in the page; by its own best container without any."""
    page = read_page(source or "")
    wanted, by_path = {path.rpartition(">")[2] for path in paths}, {}
    for k, node in enumerate(page.nodes):
        if node.name in wanted and not node.left_out:
            by_path.setdefault(path_of(page, k), []).append(k)
    for path in paths:
        if path in by_path:
            texts = texts_of(page, _main_ones(page, by_path[path]))
            if texts:
                return "\n\n".join(texts)
    best = best_container(page)
    return "" if best < 0 else "\n\n".join(texts_of(page, [best]))


def _main_ones(page: Page, same: list[int]) -> list[int]:
    """Of containers with one path, the largest and those with a quarter of its text."""
    size = {k: _weight(page.nodes[k]) for k in same}
    top = max(size.values())
    return [k for k in same if 4 * size[k] >= top]


#: Elements of a path; more are cut off at its head.
PATH_DEPTH = 12
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"
#: Paths of a host that are tried in order: those with a share of its votes.
LEAST_SHARE = 0.05
#: Copies of a host's winners where they are joined by host.
SALTS = 64


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count: dict[tuple[str, str], int] = {}
        hosts, sources = batch.column(0), batch.column(1)
        for k in range(batch.num_rows):
            path = vote(sources[k].as_py())
            if path is not None:
                key = hosts[k].as_py(), path
                count[key] = count.get(key, 0) + 1
        yield pa.RecordBatch.from_pydict({
            "host": pa.array([h for h, _ in count], pa.string()), "path": pa.array([p for _, p in count], pa.string()),
            "n": pa.array(list(count.values()), pa.int64()),
        })


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, paths: the paths with a share of the host's votes, the one of most votes first."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))
    found = pages.select(host.alias("host"), F.col(source).alias("html")).mapInArrow(_vote, "host string, path string, n long")
    ranked = stage(found.groupBy("host", "path").agg(F.sum("n").alias("n")), "host-votes")
    total = ranked.groupBy(F.col("host").alias("of_host")).agg(F.sum("n").alias("total"))
    kept = ranked.join(total, F.col("host") == F.col("of_host")).where(F.col("n") >= LEAST_SHARE * F.col("total"))
    return kept.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "path"))).alias("all")
    ).select("host", F.transform("all", lambda x: x.path).alias("paths"))


def extract_pages(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """The columns of ``pages`` but the html, plus ``text`` and ``n_chars``."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", source)]
    winners = stage(host_paths(pages, url, source), "host-paths")
    rows = pages.select(
        F.struct(*keep).alias("row"), F.col(source).alias("html"),
        F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1)).alias("host"),
    )
    size = measured_bytes(winners.select("host", F.array_join("paths", " ").alias("paths")))
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("html"), F.lit(SALTS))
        copies = winners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("salt", salt).join(copies, ["host", "salt"], "left")
    out = joined.select("row", "html", "paths")
    schema = T.StructType([out.schema["row"], T.StructField("text", T.StringType())])
    return out.mapInArrow(_extracted, schema).select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, paths = batch.column(1), batch.column(2)
        texts = [extract(sources[k].as_py(), paths[k].as_py() or []) for k in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])
