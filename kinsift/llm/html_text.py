"""Main text of web pages by consensus host paths.

A page is read once, by a scanner that never goes back, into a tree of its block elements and the texts in
them. Every page votes for its lowest container that holds nearly all of the text that is neither in links nor
repeated on many pages of its host. A container's path is generalised to tags and classes, without numbers
and places among siblings. The votes of a host are summed in Spark and the best path wins. All pages then give
the blocks below their host's path, or below their own best one if they lack it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsift.llm.common import BROADCAST_BYTES, held_bytes, join_by_hot_key, materialize, unique_columns

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div form main section td blockquote".split())
#: What is in these is never text of the article.
SKIPPED = frozenset("button canvas head iframe menu nav noscript object option select svg template textarea title".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in "script style noscript template textarea title iframe svg".split()}
CLOSED_BY = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
KEPT_WHOLE = frozenset(("article", "main"))
#: Elements that stand apart from the article, unless the page is in them; a header of an article is part of it.
ASIDE = frozenset("aside footer form header".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search".split())

#: Parts of class names and ids of what may stand apart from the article, and of what does not whatever else the name says.
APART = frozenset(
    "ad ads adslot advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
BELONGS = frozenset("article body content entry has main no page post story text with without".split())

#: The share of a page's text that the container it votes for holds at least.
NEARLY = 0.9
#: Elements that stand apart go; but one with more than half of the text stays if without all of them less than this is left.
LEFT = 0.1
#: A block is repeated if it is on so many different pages of its host, and on this share of them.
REPEATED_PAGES, REPEATED_SHARE = 3, 0.3

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)\s*(=?)\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_SPACE = re.compile(r"[\s/]*")
_PARTS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """Block elements, parents before children, as (parent, step of the path); the root is element 0. Blocks of text as (element, text, characters in links)."""

    parents: list[int] = field(default_factory=lambda: [-1])
    steps: list[str] = field(default_factory=lambda: [""])
    places: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)


class _Scanner:
    """Tags and texts of a page, in order, in time that grows as its length."""

    def __init__(self, page: str):
        self.page = page
        # quotes that are searched for in vain are not searched for again
        self.closed = {'"': page.rfind('"'), "'": page.rfind("'")}

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """('', text, {}), ('/', tag, {}) of closing tags, and ('<', tag, attributes); texts of raw elements are left out."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            open_at = page.find("<", at)
            if open_at < 0:
                yield "", page[at:], {}
                return
            after = page[open_at + 1 : open_at + 2]
            if after in ("!", "?"):
                if open_at > at:
                    yield "", page[at:open_at], {}
                end = page.find("-->", open_at + 4) + 3 if page.startswith("<!--", open_at) else page.find(">", open_at) + 1
                at = end if end > open_at else n
                continue
            close = after == "/"
            name = _NAME.match(page, open_at + 1 + close)
            if name is None:
                yield "", page[at : open_at + 1], {}
                at = open_at + 1
                continue
            if open_at > at:
                yield "", page[at:open_at], {}
            tag = name[0].lower()
            attributes, at = self._attributes(name.end())
            if close:
                yield "/", tag, {}
                continue
            yield "<", tag, attributes
            if tag in RAW:
                end = RAW[tag].search(page, at)
                at = end.start() if end else n

    def _attributes(self, at: int) -> tuple[dict[str, str], int]:
        page, found = self.page, {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            if m is None:
                at = _SPACE.match(page, at).end()
                if at >= len(page):
                    return found, at
                at += 1
                if page[at - 1] == ">":
                    return found, at
                continue
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in ('"', "'") and self.closed[quote] > at:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    value = _UNQUOTED.match(page, at)[0]
                    at += len(value)
            found.setdefault(m[1].lower(), value)


def _step(tag: str, attributes: dict[str, str]) -> tuple[str, bool]:
    """The element's part of a path, and whether its names say that it may stand apart from the article."""
    if not attributes:
        return tag, False
    names = attributes.get("class", "").lower().split()
    classes = sorted({_DIGITS.sub("N", c).replace("/", "|") for c in names})
    apart = attributes.get("role", "").lower() in APART_ROLES
    parts = {part for name in (*names, attributes.get("id", "").lower()) for part in _PARTS.findall(name)}
    return ".".join([tag, *classes]), apart or (not APART.isdisjoint(parts) and BELONGS.isdisjoint(parts))


def read_page(page: str) -> Page:
    """The tree of a page and its texts, without what stands apart from the article."""
    # open elements as (tag, element of the tree, place of the innermost open block, in a skipped element, in a link)
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
    still_open: dict[str, int] = defaultdict(int)
    made, apart, words = Page(), [False], []
    pieces: list[tuple[int, list[tuple[str, bool]]]] = []

    def flush() -> None:
        if words:
            pieces.append((stack[-1][1], words.copy()))
            words.clear()

    def cut(depth: int) -> None:
        for gone in stack[depth:]:
            still_open[gone[0]] -= 1
        del stack[depth:]

    for kind, tag, attributes in _Scanner(page):
        top = stack[-1]
        if not kind:
            if not top[3]:
                words.append((tag, top[4]))
            continue
        if tag in BLOCKS:
            flush()
        if kind == "/":
            if still_open[tag]:
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in BLOCKS:
            # a block ends a paragraph that was left open, a list item the one before, and so on
            ends = CLOSED_BY.get(tag, CLOSED_BY["p"])
            while (depth := stack[-1][2]) and stack[depth][0] in ends:
                cut(depth)
        elif tag == "br":
            words.append((" ", False))
        if tag in VOID:
            continue
        _, element, depth, skipped, link = stack[-1]
        if tag in BLOCKS:
            step, named = _step(tag, attributes)
            made.parents.append(element)
            made.steps.append(step)
            apart.append(tag not in ("html", "body") and (named or tag in ASIDE))
            element, depth = len(made.steps) - 1, len(stack)
        stack.append((tag, element, depth, skipped or tag in SKIPPED, link or tag == "a"))
        still_open[tag] += 1
    flush()
    tags = [step.split(".")[0] for step in made.steps]
    whole, held = [False] * len(tags), [0] * len(tags)
    for i in range(1, len(tags)):
        parent = made.parents[i]
        if tags[i] == "header" and whole[parent]:
            apart[i] = False
        whole[i] = whole[parent] or (tags[i] in KEPT_WHOLE and not apart[i])
    sizes = [sum(len(text.strip()) for text, _ in own) for _, own in pieces]
    # the bulk is that of the text in articles, or of all text if there is none
    articles = any(whole[place] and size for (place, _), size in zip(pieces, sizes, strict=True))
    for (place, _), size in zip(pieces, sizes, strict=True):
        held[place] += size if whole[place] or not articles else 0
    for i in range(len(tags) - 1, 0, -1):
        held[made.parents[i]] += held[i]
    gone = [False] * len(tags)
    for i in range(1, len(tags)):
        gone[i] = gone[made.parents[i]] or apart[i]
    rest = sum(size for (place, _), size in zip(pieces, sizes, strict=True) if not gone[place] and (whole[place] or not articles))
    spared = rest < LEFT * held[0]
    for i in range(1, len(tags)):
        gone[i] = gone[made.parents[i]] or (apart[i] and not (spared and 2 * held[i] > held[0]))
    for place, own in pieces:
        if not gone[place]:
            text = " ".join(html.unescape("".join(t for t, _ in own)).split())
            if text:
                made.places.append(place)
                made.texts.append(text)
                made.links.append(sum(len(t) for t, link in own if link))
    return made


def best_path(page: Page, repeated: frozenset[int] | set[int] = frozenset(), hashes: list[int] | None = None) -> tuple[str, int] | None:
    """The container path that a page votes for, and its text less what is in links or repeated; none if the page has no text.

    An article or main element that holds more than half of the text comes first; else it is the lowest container that
    holds nearly all of it. Text counts for all containers around it, but not for those within an article or main element.
    """
    if not page.texts:
        return None
    worth = [0 if repeated and hashes[i] in repeated else max(0, len(text) - 2 * link) for i, (text, link) in enumerate(zip(page.texts, page.links, strict=True))]
    total = sum(worth)
    if not total:
        worth = [len(text) for text in page.texts]
    sums = [0] * len(page.steps)
    for place, w in zip(page.places, worth, strict=True):
        sums[place] += w
    tags = [step.split(".")[0] for step in page.steps]
    # elements of one path count as one; what stands in an article or main element counts as that element
    path, known, above, depth, score = [0] * len(tags), {}, [-1], [0], [0]
    for i in range(1, len(tags)):
        parent = path[page.parents[i]]
        if tags[page.parents[i]] in KEPT_WHOLE:
            path[i] = parent
            tags[i] = tags[page.parents[i]]
            continue
        key = (parent, page.steps[i])
        if key not in known:
            known[key] = len(above)
            above.append(parent)
            depth.append(depth[parent] + 1)
            score.append(0)
        path[i] = known[key]
    steps: list[str] = [""] * len(above)
    for (_, step), p in known.items():
        steps[p] = step
    for i, w in enumerate(sums):
        score[path[i]] += w
    for p in range(len(above) - 1, 0, -1):
        score[above[p]] += score[p]
    kind = [step.split(".")[0] for step in steps]
    best = [p for p in range(len(above)) if kind[p] in KEPT_WHOLE and 2 * score[p] > score[0]]
    best = best or [p for p in range(len(above)) if (p == 0 or kind[p] in CONTAINERS) and score[p] >= NEARLY * score[0]]
    lowest = max(depth[p] for p in best)

    def spelled(p: int) -> str:
        parts = []
        while p > 0:
            parts.append(steps[p])
            p = above[p]
        return "/".join(reversed(parts))

    return max(spelled(p) for p in best if depth[p] == lowest), total


def text_below(page: Page, wanted: str) -> str:
    """The blocks below all elements of a path, one a line; the root's path is empty."""
    if not wanted:
        return "\n".join(page.texts)
    steps = wanted.split("/")
    # how many of the path's steps lead to an element; -1 off the path, and all of them below its end
    led = [0] * len(page.steps)
    for i in range(1, len(page.steps)):
        before = led[page.parents[i]]
        led[i] = before if before in (-1, len(steps)) else before + 1 if page.steps[i] == steps[before] else -1
    return "\n".join(text for place, text in zip(page.places, page.texts, strict=True) if led[place] == len(steps))


def main_text(page: str | None, wanted: str | None = None) -> str:
    """The text below the wanted path, or below the page's own best path if that gives none."""
    return _chosen_text(read_page(page or ""), wanted)


def _chosen_text(page: Page, wanted: str | None, repeated: frozenset[int] | set[int] = frozenset(), hashes: list[int] | None = None) -> str:
    if wanted is not None and (text := text_below(page, wanted)):
        return text
    own = best_path(page, repeated, hashes)
    return text_below(page, own[0]) if own else ""


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


PARSED = "parents array<int>, steps array<string>, places array<int>, texts array<string>, links array<int>"


def parsed_pages(rows: DataFrame) -> DataFrame:
    """(id, url, host, page) to (id, url, host, PARSED)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    lists = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32())]
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                pages = [read_page(p.as_py() or "") for p in part.column("page")]
                arrays = [pa.array([getattr(p, name) for p in pages], kind) for name, kind in zip(names, lists, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "url", "host")), *arrays], ["id", "url", "host", *names])

    return rows.select("id", "url", "host", "page").mapInArrow(run, f"id {kinds['id']}, url string, host string, {PARSED}")


def repeated_blocks(parsed: DataFrame) -> DataFrame:
    """(host, repeated): the hashes of texts that are on many different pages of a host; pages with the same texts count once.

    A page has each text once here, so a host keeps less than the blocks of its average page / REPEATED_SHARE.
    """
    pages = parsed.select("host", F.xxhash64("texts").alias("page"), F.array_distinct(F.transform("texts", lambda t: F.xxhash64(t))).alias("blocks"))
    pages = pages.groupBy("host", "page").agg(F.first("blocks").alias("blocks"))
    pages = materialize(pages, "blocks")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= REPEATED_PAGES)
    counts = pages.select("host", F.explode("blocks").alias("block")).groupBy("host", "block").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= REPEATED_PAGES)
    met = counts.join(sizes, "host").filter(F.col("on") >= REPEATED_SHARE * F.col("pages"))
    return met.groupBy("host").agg(F.collect_list("block").alias("repeated"))


def _with_hosts(parsed: DataFrame, hosts: DataFrame, columns: list[str], sizes: DataFrame) -> DataFrame:
    """Left join of pages with a table of hosts, broadcast if what it holds is small; else rows of large hosts stay where they are."""
    if held_bytes(hosts) <= BROADCAST_BYTES:
        return parsed.join(F.broadcast(hosts), "host", "left")
    counted = materialize(sizes.join(hosts, "host", "left"), "hosts")
    total = counted.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    return join_by_hot_key(parsed, counted, "host", "pages", max(1, total)).select(*parsed.columns, *columns)


def _pages_of(batch: pa.RecordBatch) -> Iterator[tuple[Page, set[int], list[int]]]:
    for first in range(0, batch.num_rows, 100):
        part = batch.slice(first, 100)
        for row in part.select(["parents", "steps", "places", "texts", "links", "hashes", "repeated"]).to_pylist():
            yield Page(row["parents"], row["steps"], row["places"], row["texts"], row["links"]), set(row["repeated"] or ()), row["hashes"]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], int] = defaultdict(int)

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], ["host", "path", "votes"])
        held.clear()
        return out

    for batch in batches:
        for name, (page, repeated, hashes) in zip(batch.column("host").to_pylist(), _pages_of(batch), strict=True):
            own = best_path(page, repeated, hashes)
            if own and own[1]:
                held[name, own[0]] += 1
        if len(held) > 50_000:
            yield flush()
    yield flush()


def host_paths(ready: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host, of equal votes the first by name; a page has one vote."""
    votes = ready.mapInArrow(_vote, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("b"))
    return best.select("host", F.col("b.path").alias("path"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars.

    Null and empty pages, and pages without text outside what stands apart, have an empty text. A null url
    and a url without a host count as one host. Character references are decoded, white space within a
    block is one space, blocks are joined by a line end. Rows that repeat an id are pages of their own.
    Paths with equal votes are told apart by name. Broken markup is read as it comes: a tag that nothing closes
    runs to the page's end. Extra columns play no part; an empty table gives no rows.
    """
    rows = unique_columns(pages, [id_col, url_col, html_col]).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("page")).withColumn("host", host(F.col("url")))
    id_type = rows.schema["id"].dataType.simpleString()
    parsed = materialize(parsed_pages(rows), "parsed")
    sizes = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    ready = _with_hosts(parsed, materialize(repeated_blocks(parsed), "repeated"), ["repeated"], sizes)
    ready = ready.withColumn("hashes", F.when(F.col("repeated").isNotNull(), F.transform("texts", lambda t: F.xxhash64(t))))
    ready = _with_hosts(ready, materialize(host_paths(ready), "paths"), ["path"], sizes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_chosen_text(page, wanted, repeated, hashes) for wanted, (page, repeated, hashes) in zip(batch.column("path").to_pylist(), _pages_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return ready.mapInArrow(read, f"id {id_type}, url string, text string, n_chars bigint").withColumnRenamed("id", id_col)
