"""Main text of web pages by consensus of the pages of a host.

Every page is read into blocks of text and the elements around them. Its containers are scored by the text that stands
outside of links and boilerplate; the best one grows to the article around it, and to containers that add headings and
paragraphs of their own. The generalised tag-class path of what comes out is the page's vote. Spark adds the
votes up per (host, path), combined in each task first, so a host with a third of all pages is one row per path and
task. Each page is then extracted again by the first path, in the order of its host's votes, that it has; a page with
none of them keeps its own best container.

A path counts for a host if ``LEAST_SHARE`` of its votes or more are for it, so a host has at most 1 / LEAST_SHARE paths.

An element is boilerplate by its tag, its role, or a part of its class or id (but ``has-sidebar`` or ``no-comments`` say
something about another element). One that holds most of the page's text outside of links, with the article or the main
heading in it, is none: some servers put the whole page into a form.

Blocks are cut at block elements; character references are decoded; white space inside a block becomes one space; a
line break element is white space.

Defined results: a null or empty page has an empty text; a null url is a host of its own; ties of votes go to the path
with more text, then to the first in alphabetical order; repeated pages vote and are extracted each; an empty table
gives no rows; extra columns are ignored. Markup that is cut off or badly nested is read as far as it goes.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SHARE = 0.01
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# fixed values: elements of HTML by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("# article body blockquote center dd div dl fieldset figure html li main ol section table tbody td tr ul".split())
DROPPED = frozenset("aside button datalist dialog footer form head input label menu nav option select".split())
ENDS_BEFORE = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "tr": {"tr", "td", "th"},
    "option": {"option"},
}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Parts of class and id names of what is no article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion "
    "disqus dropdown footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted promotion related recommended recommendations reply replies respond search share sharing sidebar signin signup skip social sponsor "
    "sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: First parts of class names that speak of another element.
MODIFIERS = frozenset("has hide hides is no not show shows with without".split())


def step(key: bytes, name: str) -> bytes:
    """The key of a path that is one name longer."""
    return hashlib.blake2b(key + name.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Node:
    """An element. Its path is held as a key of fixed size, so that markup of any depth takes linear room."""

    __slots__ = ("boiler", "depth", "holder", "inside", "key", "link", "name", "own", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent = tag, parent
        classes, boiler = "", tag in DROPPED
        if attributes and not attributes.isspace():
            own = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            classes = own.get("class", "").lower()
            names = re.sub(r"([a-z])([A-Z])", r"\1-\2", own.get("class", "") + " " + own.get("id", "")).lower().split()
            split = [re.split(r"[^a-z]+", n) for n in names]
            parts = {x for n in split if n[0] not in MODIFIERS for x in n}
            boiler = boiler or bool(parts & NAMES) and tag not in ("html", "body") or own.get("role", "").lower() in ROLES
        inside = parent is not None and parent.inside
        if tag == "header" and not inside:
            boiler = True
        self.inside = inside or tag in ("article", "main")
        self.own = boiler
        self.boiler = boiler or (parent is not None and parent.boiler)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.name = ".".join([tag, *sorted(re.sub(r"\d+", "N", classes).replace(">", "-").split())])
        self.key = step(parent.key if parent is not None else b"", self.name)
        self.depth = parent.depth + 1 if parent is not None else 0
        self.holder: Node = self if parent is None or tag in CONTAINERS else parent.holder

    def path(self) -> str:
        return ">".join(reversed([x.name for x in self.line()]))

    def holders(self) -> Iterator[Node]:
        """The containers it is in, innermost first."""
        at: Node | None = self.holder
        while at is not None:
            yield at
            at = at.parent.holder if at.parent is not None else None

    def line(self) -> Iterator[Node]:
        at: Node | None = self
        while at is not None:
            yield at
            at = at.parent


def blocks(page: str | None) -> list[tuple[str, int, Node]]:
    """(text, characters in links, innermost element) of each block, in page order."""
    out: list[tuple[str, int, Node]] = []
    if not page:
        return out
    root = Node("#", None, "")
    stack, pieces, blank, linked, place, owner = [root], [], True, 0, 0, root

    def flush() -> None:
        nonlocal blank, linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append((text, linked, owner))
        pieces.clear()
        blank, linked = True, 0

    opened: Counter[str] = Counter()

    def close(names: set[str] | frozenset[str], until: frozenset[str]) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                opened.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    def said(text: str) -> None:
        nonlocal blank, linked, owner
        if not text:
            return
        text = html.unescape(text) if "&" in text else text
        if blank:
            at = stack[-1]
            while at.tag not in BLOCKS and at.parent is not None and not at.boiler:
                at = at.parent
            owner = at
        elif stack[-1].boiler and not owner.boiler or owner.boiler and not stack[-1].boiler:
            flush()
            owner = stack[-1]
        pieces.append(text)
        blank = blank and not text.strip()
        if stack[-1].link:
            linked += len(text)

    while True:
        m = _TOKEN.search(page, place)
        if m is None:
            said(page[place:])
            break
        said(page[place : m.start()])
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if tag not in VOID:
                close({tag}, frozenset(("body", "table")) if tag not in ("body", "html", "table") else frozenset())
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, place)
                place = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            flush()
            close({"p"}, CONTAINERS)
            if tag in ENDS_BEFORE:
                close(ENDS_BEFORE[tag], frozenset(("ul", "ol", "dl", "table", "select", "body")))
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close({"h1", "h2", "h3", "h4", "h5", "h6"}, CONTAINERS)
        elif tag in ("br", "wbr"):
            if tag == "br" and pieces:
                pieces.append(" ")
            continue
        if tag not in VOID:
            stack.append(Node(tag, stack[-1], m[3]))
            opened[tag] += 1
    flush()
    return pardoned(out)


def around(owners: Iterator[Node]) -> list[Node]:
    """The elements and all elements around them, innermost first."""
    seen: set[Node] = set()
    for at in owners:
        while at is not None and at not in seen:
            seen.add(at)
            at = at.parent
    return sorted(seen, key=lambda x: -x.depth)


def pardoned(found: list[tuple[str, int, Node]]) -> list[tuple[str, int, Node]]:
    """The blocks, after boilerplate marks are taken from elements that hold most of the page's text outside of links
    together with its main heading or an article that is not marked itself."""
    nodes = around(owner for _, _, owner in found if owner.boiler)
    if not nodes:
        return found
    held: dict[Node, int] = dict.fromkeys(nodes, 0)
    total = 0
    for text, linked, owner in found:
        own = max(0, len(text) - 2 * linked)
        total += own
        if owner.boiler:
            held[owner] += own
    headed: set[Node] = set()
    wrong = False
    for x in nodes:
        if x.own and x in headed and 2 * held[x] > total:
            x.own, wrong = False, True
        if x.parent is not None:
            held[x.parent] += held[x]
            if x in headed or x.tag in ("h1", "article", "main") and not x.own:
                headed.add(x.parent)
    if wrong:
        for x in reversed(nodes):
            x.boiler = x.own or (x.parent is not None and x.parent.boiler)
    return found


def best(found: list[tuple[str, int, Node]]) -> tuple[str, int] | None:
    """Path and text length of the container with the highest score.

    Text outside of links counts fully for the nearest container, by half for the next one out, and so on; an article
    element counts half as much again. Of equals the outer one wins. Then the container grows: to the article it is in,
    and to any container around it of whose further text at least half stands in it directly.
    """
    scores: dict[Node, float] = {}
    direct: dict[Node, int] = {}
    for text, linked, owner in found:
        own = len(text) - 2 * linked
        if owner.boiler or own <= 0:
            continue
        direct[owner.holder] = direct.get(owner.holder, 0) + own
        for at in owner.holders():
            scores[at] = scores.get(at, 0.0) + own
            own /= 2
            if own < 1:
                break
    total = dict(direct)
    for x in around(iter(direct)):
        if x.parent is not None:
            total[x.parent] = total.get(x.parent, 0) + total.get(x, 0)
    if not scores:
        return None
    value = lambda x: (scores[x] * (1.5 if x.tag in ("article", "main") else 1.0), -x.depth)
    top = max(scores, key=value)
    top = next((x for x in top.line() if x.tag == "article"), top)
    for at in top.holders():
        more = total[at] - total[top]
        if at.tag not in ("#", "html") and 0 < more <= 2 * direct.get(at, 0):
            top = at
    return top.path(), total[top]


def within(node: Node, key: bytes, known: dict[Node, bool]) -> bool:
    """Whether the element or one around it has the path of the key; ``known`` keeps the answers for this key."""
    passed, at = [], node
    while at is not None and at not in known and at.key != key:
        passed.append(at)
        at = at.parent
    result = at is not None and known.get(at, True)
    known.update(dict.fromkeys(passed, result))
    return result


def extract(found: list[tuple[str, int, Node]], paths: list[str]) -> str:
    """Blocks inside containers of the first path that the page has, without boilerplate."""
    own = best(found)
    for path in [*paths, own[0] if own else ""]:
        key, known = functools.reduce(step, path.split(">"), b""), {}
        texts = [text for text, _, owner in found if not owner.boiler and within(owner, key, known)]
        if texts:
            return "\n\n".join(texts)
    return ""


def host(url: Column) -> Column:
    """Lower-case host, without a leading www., of an absolute address; else the empty text."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def votes(pages: DataFrame) -> DataFrame:
    """host, paths (by votes)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [best(blocks(h.as_py())) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.int64())], ["host", "path", "chars"])

    cast = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(vote, "host string, path string, chars bigint").where("path is not null")
    counted = cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    whole = Window.partitionBy("host")
    frequent = counted.where(F.col("n") > 0).withColumn("all", F.sum("n").over(whole)).where(F.col("n") >= LEAST_SHARE * F.col("all"))
    order = whole.orderBy(F.desc("n"), F.desc("chars"), "path")
    top = frequent.withColumn("place", F.row_number().over(order))
    return top.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars.

    The paths of up to ``BROADCAST_HOSTS`` hosts go to the executors with a broadcast; of more, by a shuffled join,
    whose skewed partitions adaptive execution splits.
    """
    from holdfast.plans.storage import stored

    kind = pages.schema["page_id"].dataType.simpleString()
    paths = stored(votes(pages), "host-paths")
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(paths) if paths.count() <= BROADCAST_HOSTS else paths, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(blocks(h.as_py()), p or []) for h, p in zip(b.column("html"), b.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return joined.select("page_id", "url", "html", "paths").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars bigint")
