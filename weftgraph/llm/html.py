"""Main text of web pages by consensus host paths.

Each page scores its containers and names the generalised tag-class path of the best.
The hosts' pages vote in Spark; every page is then extracted from the containers on its
host's winning path, or from its own best one where it has none there. A container that
stands in an article or main element stands for all of the nearest one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Comments, declarations and tags. In a tag only a quote right after ``=`` opens a value; other quotes are signs like any.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]+|=(?:\s*\"[^\"]*(?:\"|\Z)|\s*'[^']*(?:'|\Z)|(?!\s*[\"'])))*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
#: Fixed values of HTML: elements without content, elements of raw text, elements that break lines of text into blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe title noframes xmp".split())
#: Raw elements whose missing end tag hides all that follows; of others only the tag itself is left out.
CODE = frozenset("script style".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body blockquote".split())
#: What never belongs to the article.
APART = frozenset("nav footer aside form button dialog menu fieldset label input select head noscript template svg math object audio video canvas".split())
#: Of these, those that hold nothing if they are never closed.
ENDED = frozenset("select noscript template svg math object audio video canvas button dialog".split())
#: Elements of other languages, which a block of HTML ends.
FOREIGN = frozenset("svg math".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
APART_NAMES = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|disclaimer|side-?bar\w*|nav\w*|menus?|breadcrumbs?|footer\w*|comments?|comment-?list|repl(?:y|ies)|respond|discuss\w*|disqus\w*|share\w*|social\w*|related|recommend\w*|newsletter|subscri\w*|widgets?|popup|modal|overlay|pagination|pager|login|sign-?(?:in|up)|search\w*|toolbar|skip|copyright|masthead|site-?header|page-?header|top-?bar|hidden)(?:$|[_-])",
    re.I,
)
#: Names that say what an element has or lacks, not what it is.
MODIFIER = re.compile(r"(?:has|with|without|no|is|not|show|hide|js|can|allow|enable|disable)[_-]", re.I)
GOOD_NAMES = re.compile(r"article|content|main|post|entry|story|body|text", re.I)
#: Elements that a start tag closes when they are open: (the new one, those closed).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


#: Hosts whose paths are sent to every task, as 8 bytes each.
MAX_HOSTS = 5_000_000


class Node:
    __slots__ = ("tag", "apart", "path", "score", "good", "parent", "link", "doubts", "size", "main")

    def __init__(self, tag: str, names: str, parent: Node | None, apart: bool, doubted: bool = False):
        self.tag, self.parent, self.apart = tag, parent, apart
        # elements above, and this one, whose names alone speak against them; how much text they hold, and whether it is the page's main part
        self.doubts = (parent.doubts if parent else ()) + ((self,) if doubted else ())
        self.size, self.main = 0, False
        self.link = tag == "a" or bool(parent and parent.link)
        self.score, self.good = 0.0, tag in ("article", "main") or bool(names and GOOD_NAMES.search(names))
        if tag in CONTAINERS:
            step = tag + "".join("." + re.sub(r"\d+", "#", c) for c in sorted(set(names.lower().split()))[:3])
            self.path = (parent.path + ">" if parent and parent.path else "") + step
        else:
            self.path = parent.path if parent else ""


def parse(page: str) -> list[tuple[Node, list[str], int]]:
    """Blocks of text in page order: the element they stand in, their pieces, characters within links."""
    root = Node("html", "", None, False)
    stack, blocks, pieces, linked = [root], [], [], 0
    owner, doubts = root, ()
    total = 0

    def flush() -> None:
        nonlocal pieces, linked, doubts
        if pieces:
            blocks.append((owner, pieces, linked, doubts))
        pieces, linked, doubts = [], 0, ()

    def text(raw: str) -> None:
        nonlocal owner, linked, total, doubts
        top = stack[-1]
        if raw and not top.apart:
            if top.doubts != doubts and pieces:
                flush()
            if not pieces:
                owner = next(x for x in reversed(stack) if x.tag in BLOCKS)
                doubts = top.doubts
            pieces.append(raw)
            if top.link:
                linked += len(raw)
            size = len(raw.strip())
            total += size
            for x in top.doubts:
                x.size += size

    at, end, low, ends = 0, len(page), page.lower(), {}
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            break
        text(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                flush()
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                if any(x.tag in BLOCKS for x in stack[k:]):
                    flush()
                del stack[k:]
            continue
        if tag == "br":
            text("\n")
            continue
        if tag in BLOCKS or tag == "body":
            # a head without an end tag ends where the body or a block begins, and so does a drawing or formula
            k = next((i for i, x in enumerate(stack) if x.tag in FOREIGN or x.tag == "head"), 0)
            if k:
                del stack[k:]
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p" or stack[i].tag in CLOSES.get(tag, ()):
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS and stack[i].tag not in ("p",):
                    break
        if tag in VOID:
            continue
        closed = m[3].rstrip().endswith("/")
        if tag in ENDED:
            if tag not in ends:
                ends[tag] = low.rfind(f"</{tag}")
            if ends[tag] < at:  # it never ends, so it is only a tag
                continue
        if tag in RAW and not any(x.tag in FOREIGN for x in stack):
            close = re.compile(rf"</{tag}(?:\s[^>]*)?/?>", re.I).search(page, at)
            at = close.end() if close else end if tag in CODE else at
            continue
        attributes = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(m[3])} if m[3] else {}
        parent = stack[-1]
        inside = any(x.tag in ("article", "main") for x in stack)
        apart = parent.apart or tag in APART or (tag == "header" and not inside)
        doubted = False
        if attributes and not apart and tag not in ("body", "html"):
            apart = (
                attributes.get("role", "").lower() in APART_ROLES
                or "hidden" in attributes
                or attributes.get("aria-hidden") == "true"
                or "display:none" in attributes.get("style", "").replace(" ", "").lower()
            )
            names = [x for x in (attributes.get("class", "") + " " + attributes.get("id", "")).split() if not MODIFIER.match(x)]
            doubted = not apart and any(map(APART_NAMES.search, names)) and not (tag in ("article", "main") and not any(map(APART_NAMES.search, attributes.get("class", "").split())))
        node = Node(tag, attributes.get("class", "") if attributes else "", parent, apart, doubted)
        if node.doubts and (tag in ("article", "main", "h1") or tag in CONTAINERS and node.good):
            for x in node.doubts:
                x.main = True
        if not closed or tag in BLOCKS:
            stack.append(node)
    if at < end:
        text(page[at:])
    flush()
    # a name drops what it stands for, but not what holds the title or an article and most of the page's text
    return [(owner, pieces, linked) for owner, pieces, linked, doubts in blocks if all(x.main and 2 * x.size > total for x in doubts)]


def _clean(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def _containers(node: Node | None) -> Iterator[Node]:
    while node is not None:
        if node.tag in CONTAINERS:
            yield node
        node = node.parent


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def best_path(page: str, blocks: list | None = None) -> tuple[str, float]:
    """Path of the container with the highest score and its share of the page's score.

    A block's characters outside of links count for its container, half of them for the
    next one above, a quarter for the one above that; articles and well-named containers count more.
    """
    seen: dict[int, Node] = {}
    total = 0.0
    for owner, pieces, linked in parse(page) if blocks is None else blocks:
        size = len(_clean(pieces))
        weight = size * max(0.0, 1 - 1.5 * linked / max(1, sum(map(len, pieces))))
        total += weight
        for depth, node in enumerate(_containers(owner)):
            if depth > 2:
                break
            node.score += weight * 0.5**depth * (1.6 if node.good else 1.0)
            seen[id(node)] = node
    if not seen:
        return "", 0.0
    top = max(seen.values(), key=lambda x: x.score)
    return top.path, top.score / max(total, 1.0)


def _article(node: Node | None) -> Node | None:
    """The nearest article or main element that ``node`` is or stands in."""
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node


def _on(node: Node | None, path: str) -> Node | None:
    """The outermost container on ``path`` that ``node`` is or stands in."""
    found = None
    for x in _containers(node):
        if x.path == path:
            found = x
    return found


def extract(page: str, chosen: str | None | Callable[[str], bool]) -> str:
    """Blocks of the containers on the ``chosen`` path (or the first one it holds for), or of the nearest article or main around
    them, joined by newlines; the page's own best path where it has no text there."""
    blocks = parse(page)
    texts = [(owner, t) for owner, pieces, _ in blocks if (t := _clean(pieces))]
    paths = [chosen]
    if callable(chosen):
        paths = [x for x in dict.fromkeys(node.path for owner, _ in texts for node in _containers(owner)) if chosen(x)]
    for p in (*paths, None):
        if p is None:
            p = best_path(page, blocks)[0]
        if p:
            within = [(owner.path == p or owner.path.startswith(p + ">")) for owner, _ in texts]
            whole = {id(a) for (owner, _), x in zip(texts, within) if x and (a := _article(_on(owner, p)))}
            got = [t for (owner, t), x in zip(texts, within) if x or (whole and any(id(a) in whole for a in _above(owner)))]
            if got:
                return "\n".join(got)
    return "\n".join(t for _, t in texts)


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the winning path of each host. A page votes with the share of its score that its best
    container has; ties go to the first path by name. Votes are added up before they are shuffled."""

    def vote(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [best_path(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column(0), "path": pa.array([g[0] for g in got], pa.string()), "vote": pa.array([int(round(g[1] * 1e6)) for g in got], pa.int64())})

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host <> ''").mapInArrow(vote, "host string, path string, vote long")
    sums = votes.filter("path <> ''").groupBy("host", "path").agg(F.sum("vote").alias("vote"))
    best = sums.groupBy("host").agg(F.max("vote").alias("most"))
    return sums.join(best, "host").filter("vote = most").groupBy("host").agg(F.min("path").alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null or empty html gives an empty text. Pages without a host (null or odd url) go by
    their own best container. Repeated rows each vote and give a row; an empty table gives no rows.
    """
    pages = pages.select("page_id", "url", "html")

    def take(batches: Iterator, own: bool = False) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [extract(x or "", p if own else _wins(p)) for x, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(got, pa.string()), "n_chars": pa.array([len(x) for x in got], pa.int64())}
            )

    def _wins(host: str) -> Callable[[str], bool] | None:
        import xxhash

        def wins(path: str) -> bool:
            key = xxhash.xxh64(f"{host}\n{path}".encode("utf-8", "replace"), seed=42).intdigest()
            i = int(np.searchsorted(shared.value, np.uint64(key)))
            return i < len(shared.value) and int(shared.value[i]) == key

        return wins if host else None

    schema = "page_id long, url string, text string, n_chars long"
    paths = stored(host_paths(pages))
    hosts = pages.withColumn("host", host_of(F.col("url")))
    if paths.count() <= MAX_HOSTS:
        # each host's winning path goes to every task as one 64-bit hash of both; a page asks for its own few paths
        keys = paths.select(F.xxhash64(F.concat_ws("\n", "host", "path")).alias("k")).toArrow().column(0).to_numpy()
        shared = pages.sparkSession.sparkContext.broadcast(np.sort(keys.view(np.uint64)))
        return hosts.select("page_id", "url", "html", "host").mapInArrow(take, schema)
    rows = hosts.join(paths, "host", "left").select("page_id", "url", "html", "path")
    return rows.mapInArrow(lambda batches: take(batches, True), schema)
