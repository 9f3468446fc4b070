"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of elements (tag, classes, id; numbers in them
are all alike). For every element of the tree, with m pages that have it:

* presentation: its children's sequences, repeats collapsed, and how many pages have
  each; importance is their entropy to the base m (0: all pages alike);
* content: its texts, and on how many pages each stands; importance is the mean of
  1 - ln(pages) / ln(m) over its texts (0: the same texts everywhere), less for the share of
  the characters that are links;
* a branch: the mean of what its elements have, weighted by pages and by ``DECAY`` for
  every level further down.

All elements of the page are counted. Importance is smoothed for few pages: the less often
a branch was seen, the more counts how rare it is on its host. It is then weighted by what
the presentation says: elements and words for menus, footers, adverts, comments weigh
``FURNITURE``, all else 1. Words that name content as well are settled by the tree and by
where its text is: beside an ``article`` or ``main`` with important text of its own they are
furniture; elsewhere they are, unless the text under them is most of what the host says
(``MOST``), when they weigh ``DOUBTFUL``. As the id of a section or a headline that stands among the
text's own elements they are a place in the text, and weigh that too. A branch is removed if it and all within it are below
``LEAST`` of the host's most important text. So text under any word stays where it
is what the host has to say, and where all pages are alike the weights alone decide, so
copied articles stay. Hosts of one page share one tree.

Pages are parsed once, into blocks of text and the counts of the tree, a row for an element
and value of a batch's pages, combined in the task before the shuffle; there is no
gathering by host, so a hot host does no harm. Pages of a host that have the same elements
share a list of those that are unimportant: places in their own elements, however many the host has.

Time is linear in a page's length, whatever its markup. Elements below the ``DEPTH``-th level
are counted as parts of their ancestor there, so their text goes or stays with it. A tag of more than
``WIDEST`` characters ends at its first ">".

Defined cases: null html is the empty page, whose text is empty. Pages without a host
make no tree; presentation alone decides: furniture goes, and all outside ``article`` and
``main`` where a page has them. What is not rendered (scripts, hidden elements) is never text. Repeated rows count as pages of their own and
stay. Null ids and urls are kept. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .url_filter import host_of

DECAY = 0.9
LEAST = 0.15
LONE = "/"  # no host has this name
PRIOR = 0.1  # importance of what stands on all pages, before any two were compared
FURNITURE = 0.1
NAMED = 0.3  # stands for a word that may name content, until the host's tree settles it
ANCHOR = 0.4  # the same as an id of a section or headline
DOUBTFUL = 0.5
MOST = 4.0  # times as long as all other important text of the host
IMPORTANT = 0.3
LINKED = 0.9  # of the importance of a text that is all links
DEPTH = 48
NAME = 200  # characters of an element's name in the tree
WIDEST = 1 << 14

# Roles of HTML elements
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe noembed noframes xmp".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
NO_CONTENT = set(
    "head script style title noscript template iframe nav header footer aside menu form button input select "
    "option textarea label dialog svg canvas object applet audio video map".split()
)
NOT_RENDERED = set(
    "head script style title noscript template iframe svg canvas object applet audio video map input select option textarea".split()
)
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = (
    set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hr main menu nav ol p pre section table ul".split())
    | HEADINGS
)
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
# Words in classes, ids and roles that name furniture
NO_CONTENT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget related share sharing social "
    "footer masthead header cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist disqus reply replies respond skip contentinfo "
    "complementary search alert toolbar topbar sidenav disclaimer feedback discussion".split()
)
# Of these, the words that often name content as well
DOUBTFUL_WORDS = set(
    "advertising alert banner comment disclaimer discussion feedback header menu navigation notice notices notification "
    "promotion related replies reply respond search share sharing skip social sponsor subscription".split()
)
BEGINNINGS = ("comments", "cookie", "advert", "sidebar", "sponsor", "breadcrumb", "newsletter")
WITHOUT = {"has", "with", "no", "without"}  # "has-sidebar" is about what stands beside

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_NUMBER = re.compile(r"[0-9]+")
_IN_MAIN = r"(^| )(article|main)([.#\[ ]|$)"


@functools.lru_cache(10_000)
def _presentation(tag: str, attributes: str) -> tuple[str, float, bool]:
    """Name in the tree, weight, whether it is not rendered."""
    found: dict[str, str] = {}
    if attributes and not attributes.isspace():
        for key, value in _ATTRIBUTE.findall(attributes):
            found.setdefault(key.lower(), html.unescape(value.strip("\"'")))
    marks = [f".{m}" for m in sorted(set(found.get("class", "").split()))]
    if name := "_".join(found.get("id", "").split()):
        marks.append(f"#{name}")
    if role := "_".join(found.get("role", "").split()):
        marks.append(f"[{role}]")
    weight = FURNITURE if tag in NO_CONTENT else 1.0
    if tag not in ("html", "body", "main"):  # their classes describe the page
        place = tag == "section" or tag in HEADINGS
        for kind in ("class", "id", "role"):
            for mark in found.get(kind, "").split():
                words = [w.lower() for w in _WORD.findall(mark)]
                for before, word in zip(["", *words], words):
                    if before not in WITHOUT and (word in NO_CONTENT_WORDS or word.startswith(BEGINNINGS)):
                        doubtful = ANCHOR if kind == "id" and place else NAMED
                        weight = min(weight, doubtful if word in DOUBTFUL_WORDS else FURNITURE)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    name = _NUMBER.sub("0", tag + "".join(marks))
    if len(name) > NAME:
        name = f"{name[:NAME]}~{_hash(name):x}"
    return name, weight, hidden or tag in NOT_RENDERED


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


class Element:
    """``owner`` is the innermost element that makes a block; ``depth`` ends at DEPTH, and so does the path."""

    __slots__ = ("tag", "path", "depth", "name", "children", "weight", "hidden", "no_content", "in_main", "head", "owner")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag = tag
        self.name, self.weight, self.hidden = _presentation(tag, attributes)
        self.children: list[str] = []
        self.owner = self
        if parent is None:
            self.path, self.depth = self.name, 1
            self.no_content = self.head = self.in_main = False
            return
        inside = parent.in_main
        self.depth = min(parent.depth + 1, DEPTH)
        self.path = f"{parent.path} {self.name}" if parent.depth < DEPTH else parent.path
        self.head = tag == "header" and inside or parent.head
        self.hidden = self.hidden or parent.hidden
        if parent.no_content and parent.head and tag in HEADINGS:  # the headline in an article's header
            self.weight = 1.0
        else:
            self.weight = min(self.weight, parent.weight)
        self.no_content = self.weight < 1 or self.hidden
        self.in_main = inside or tag in MAIN and not self.no_content
        if tag in INLINE and not self.no_content:
            self.owner = parent.owner
        if parent.depth < DEPTH and (not parent.children or parent.children[-1] != self.name):
            parent.children.append(self.name)


def _tags(source: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, match) of all that is markup; without a match it is a comment, a declaration or a broken tag."""
    at = source.find("<")
    while at >= 0:
        after = source[at + 1 : at + 2]
        end, m = -1, None
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
        elif source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            end = len(source) if end < 0 else end + 3
        elif after in ("!", "?"):
            end = source.find(">", at)
            end = len(source) if end < 0 else end + 1
        elif after == "/" or after.isascii() and after.isalpha():
            m = _TAG.match(source, at, at + WIDEST)
            end = m.end() if m else source.find(">", at + 2) + 1
            if not end:  # no tag ends any more, but a comment may still begin
                at = source.find("<!", at + 1)
                continue
        if end >= 0:
            yield at, end, m
        at = source.find("<", end if end >= 0 else at + 1)


def parse(source: str) -> tuple[list[Element], list[tuple[Element, str, float]]]:
    """Elements of a page, and its blocks of text with the block's innermost element and the share of links."""
    root = Element("html", "", None)
    stack, elements = [root], [root]
    opened: Counter[str] = Counter()  # tags on the stack, above the root
    blocks: list[tuple[Element, str, float]] = []
    held: list[str] = []
    linked = 0
    owner = root
    skip = 0  # where the content of a script or the like ends

    def flush() -> None:
        nonlocal held, linked
        if held:
            raw = "".join(held)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append((owner, text, linked / len(raw)))
            held, linked = [], 0

    def add(text: str) -> None:
        nonlocal owner, linked
        if text:
            if not held:
                if text.isspace():
                    return
                owner = stack[-1].owner
            held.append(text)
            if opened["a"]:
                linked += len(text)

    def cut(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    at = 0
    for start, end, m in _tags(source):
        if start < skip:
            continue
        add(source[at:start])
        at = end
        if m is None:
            if source.startswith("<![CDATA[", start):
                add(html.escape(source[start + 9 : end].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                flush()
            elif opened[tag]:
                if tag not in INLINE or stack[-1].no_content:
                    flush()
                while stack[-1].tag != tag:
                    if stack[-1].tag not in INLINE:
                        flush()
                    opened[stack.pop().tag] -= 1
                opened[stack.pop().tag] -= 1
            continue
        if tag == "br":
            flush()
            continue
        if tag == "html":
            continue
        if tag not in INLINE:
            flush()
        if tag in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES_SAME and any(opened[t] for t in CLOSES_SAME[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES_SAME[tag]:
                    cut(k)
                    break
                if stack[k].tag in STOPS[tag]:
                    break
        attributes = m[3] or ""
        parent = stack[-1]
        element = Element(tag, attributes, parent)
        if element.no_content and not parent.no_content:
            flush()
        counted = parent.depth < DEPTH and (tag not in INLINE or element.no_content)
        if tag in VOID or attributes.endswith("/"):
            if counted:
                elements.append(element)
            continue
        if tag in RAW:
            close = _END[tag].search(source, at)
            at = close.start() if close else len(source)
            if counted:
                elements.append(element)
            if close:
                end = source.find(">", at)
                at = end + 1 if end >= 0 else len(source)
            skip = at
            continue
        stack.append(element)
        opened[tag] += 1
        if counted:
            elements.append(element)
    add(source[at:])
    flush()
    return elements, blocks


def main_text(source: str, paths: list[str], judged: bool = False) -> str:
    """Text of a page without the elements that are in unimportant branches of its host;
    by presentation alone if it is not ``judged`` by a tree."""
    _, blocks = parse(source)
    if judged:
        out = set(paths)
        return "\n".join(t for e, t, _ in blocks if not e.hidden and e.path not in out)
    return "\n".join(t for _, t, _ in _by_presentation(blocks))


def _by_presentation(blocks: list[tuple[Element, str, float]]) -> list[tuple[Element, str, float]]:
    if any(e.in_main for e, _, _ in blocks):
        blocks = [b for b in blocks if b[0].in_main]
    return [b for b in blocks if not b[0].no_content]


COUNT = [
    ("host", pa.string()), ("path", pa.string()), ("weight", pa.float64()), ("is_text", pa.bool_()),
    ("value", pa.int64()), ("pages", pa.int64()), ("chars", pa.int64()), ("linked", pa.float64()),
]
PAGE = [
    ("page_id", pa.int64()), ("url", pa.string()), ("page_host", pa.string()), ("paths", pa.list_(pa.string())),
    ("blocks", pa.list_(pa.struct([("at", pa.int32()), ("text", pa.string())]))),
]
PARSED = (
    "page_id long, url string, page_host string, paths array<string>, blocks array<struct<at int, text string>>, host string, path string, "
    "weight double, is_text boolean, value long, pages long, chars long, linked double"
)


def parsed(pages: DataFrame) -> DataFrame:
    """Rows of pages (path is null): their blocks of text, each with the place of its element's path
    in ``paths``; and rows of counts: on how many pages of a host an element has which
    presentation or text. ``pages`` has page_id, url, host and html; without a host a page has
    no counts and the blocks that presentation leaves it."""

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            counts: Counter[tuple] = Counter()
            rows = []
            for host, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                elements, blocks = parse(source or "")
                if not host:
                    rows.append(([], [{"at": -1, "text": t} for _, t, _ in _by_presentation(blocks)]))
                    continue
                styles: dict[tuple[str, float], list[str]] = {}
                for e in elements:
                    styles.setdefault((e.path, e.weight), []).append(",".join(e.children))
                counts.update((host, *p, False, _hash("|".join(dict.fromkeys(v))), 0, 0.0) for p, v in styles.items())
                blocks = [b for b in blocks if not b[0].hidden]
                texts = {(e.path, e.weight, _hash(t)): (len(t), len(t) * share) for e, t, share in blocks}
                counts.update((host, path, weight, True, value, *n) for (path, weight, value), n in texts.items())
                places: dict[str, int] = {}
                own = [{"at": places.setdefault(e.path, len(places)), "text": t} for e, t, _ in blocks]
                rows.append((list(places), own))
            columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows), PAGE[3:])] if rows else [pa.array([], k) for _, k in PAGE[3:]]
            columns = [*[batch.column(i) for i in range(3)], *columns, *[pa.nulls(len(rows), k) for _, k in COUNT]]
            names = [n for n, _ in PAGE + COUNT]
            yield pa.RecordBatch.from_arrays(columns, names)
            if counts:
                found = [(*k[:5], c, k[5] * c, k[6] * c) for k, c in counts.items()]
                columns = [pa.array(c, k) for c, (_, k) in zip(zip(*found), COUNT)]
                blank = [pa.nulls(len(found), k) for _, k in PAGE]
                yield pa.RecordBatch.from_arrays([*blank, *columns], names)

    return small_batches(pages.select("page_id", "url", "host", "html")).mapInArrow(work, PARSED)


def site_values(found: DataFrame) -> DataFrame:
    """(host, path, weight, is_text, value, c, chars, linked) of the rows of counts."""
    counts = found.where("path IS NOT NULL").groupBy("host", "path", "weight", "is_text", "value")
    return counts.agg(F.sum("pages").alias("c"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))


def site_trees(pages: DataFrame) -> DataFrame:
    """``trees`` of the pages; ``pages`` has host and html."""
    unnamed = {"page_id": F.lit(None).cast("long"), "url": F.lit(None).cast("string")}
    return trees(site_values(parsed(pages.withColumns(unnamed))))


def trees(values: DataFrame) -> DataFrame:
    """(host, path, importance, weight, has_text) of every element of every host's tree."""
    kinds_ = values.groupBy("host", "path", "is_text").agg(
        F.max("weight").alias("weight"),
        F.sum("c").alias("total"),
        F.sum(F.col("c") * F.log("c")).alias("c_log_c"),
        F.sum(F.log("c")).alias("log_c"),
        F.count("*").alias("n"),
        F.sum("chars").alias("chars"),
        F.sum("linked").alias("linked"),
    )
    own = kinds_.groupBy("host", "path").agg(
        F.max("weight").alias("weight"),
        F.max(F.when(~F.col("is_text"), F.col("total"))).alias("m"),
        F.max(F.when(~F.col("is_text"), F.col("c_log_c"))).alias("style"),
        F.max(F.when(F.col("is_text"), F.col("log_c") / F.col("n"))).alias("text"),
        F.coalesce(F.max(F.when(F.col("is_text"), F.col("linked") / F.col("chars"))), F.lit(0.0)).alias("links"),
        F.max("chars").alias("chars"),
    )
    own = written(own.where("m IS NOT NULL"), "elements")
    base = F.log("m")
    style = F.when(F.col("m") > 1, 1 - F.col("style") / F.col("m") / base).otherwise(1.0)
    text = F.when(F.col("m") > 1, 1 - F.col("text") / base).otherwise(1.0)
    seen = F.when(F.col("text").isNull(), style).otherwise(F.greatest(style, text))
    # Few pages say little: then it counts on how many of the host's pages the branch is not
    rare = 1 - (1 - PRIOR) * F.col("m") / F.col("of")
    links = 1 - LINKED * F.col("links")
    own = own.join(own.groupBy("host").agg(F.max("m").alias("of")), "host").select(
        "host", "path", "m", "weight", "chars", F.col("text").isNotNull().alias("has_text"),
        (links * ((F.col("m") - 1) * seen + rare) / F.col("m")).alias("own"),
    )
    own = written(_settled(own), "settled")
    pages = F.col("m") * F.pow(F.lit(DECAY), F.col("below"))
    itself = F.col("below") == 0
    return _for_ancestors(own.select("host", "path", "m", "weight", "has_text", "own")).groupBy("host", "path").agg(
        (F.sum(pages * F.col("own")) / F.sum(pages)).alias("importance"),
        F.max(F.when(itself, F.col("weight"))).alias("weight"),
        F.max(F.when(itself, F.col("has_text"))).alias("has_text"),
    )


def _settled(own: DataFrame) -> DataFrame:
    """What words weigh that may name content, by the important text of the host."""
    in_main = F.col("path").rlike(_IN_MAIN)
    doubtful = F.col("weight").isin(NAMED, ANCHOR)
    plain = (F.col("weight") == 1) & F.col("has_text") & (F.col("own") >= IMPORTANT)
    hosts = own.groupBy("host").agg(
        F.coalesce(F.bool_or(plain & in_main), F.lit(False)).alias("has_main"),
        F.sum(F.when(plain, F.col("chars")).otherwise(0)).alias("plain_chars"),
        F.sum(F.when(doubtful, F.col("chars")).otherwise(0)).alias("doubtful_chars"),
    )
    # An anchor is a place in the text if its element stands among the text's own
    beside = own.where(plain).select("host", F.regexp_replace("path", r" [^ ]*$", "").alias("parent")).distinct()
    anchors = own.where(F.col("weight") == ANCHOR).select("host", F.regexp_replace("path", r" [^ ]*$", "").alias("parent"))
    flows = anchors.join(beside, ["host", "parent"]).select("host", F.lit(True).alias("flows")).distinct()
    hosts = hosts.join(flows, "host", "left")
    rest = F.when(F.col("doubtful_chars") > MOST * F.col("plain_chars"), DOUBTFUL).otherwise(FURNITURE)
    named = F.when(F.col("has_main"), FURNITURE).otherwise(rest)
    anchor = F.when(F.col("has_main") & ~in_main, FURNITURE).when(F.col("flows") | in_main, DOUBTFUL).otherwise(named)
    weight = F.when(F.col("weight") == NAMED, named).when(F.col("weight") == ANCHOR, anchor).otherwise(F.col("weight"))
    return own.join(hosts, "host").withColumn("weight", weight)


def _for_ancestors(elements: DataFrame) -> DataFrame:
    """Every row for its own path and each path above it (DEPTH at most), ``below`` levels up."""
    parts = F.split("path", " ")
    up = elements.withColumns({"parts": parts, "level": F.explode(F.sequence(F.lit(1), F.size(parts)))})
    up = up.withColumn("path", F.concat_ws(" ", F.slice("parts", F.lit(1), F.col("level"))))
    return up.withColumn("below", F.size("parts") - F.col("level")).drop("parts", "level")


def unimportant(trees: DataFrame, least: float = LEAST) -> DataFrame:
    """(host, path) of branches that are unimportant throughout."""
    scored = written(trees.withColumn("score", F.col("importance") * F.col("weight")), "trees")
    most = _for_ancestors(scored).groupBy("host", "path").agg(F.max("score").alias("most"))
    best = scored.where("has_text").groupBy("host").agg(F.max("score").alias("best"))
    return most.join(best, "host").where(F.col("most") < least * F.col("best")).select("host", "path")


def unimportant_of_hosts(found: DataFrame, least: float = LEAST) -> DataFrame:
    """(host, path) of the unimportant branches of every host, by the tree of all hosts of one page if it
    is one of them; ``found`` has the rows of counts."""
    values = written(site_values(found), "values")
    roots = values.where((F.col("path") == "html") & ~F.col("is_text"))  # one for each page
    lone = roots.groupBy("host").agg(F.sum("c").alias("pages")).where("pages = 1")
    lone = written(lone.select("host", F.lit(LONE).alias("tree")), "lone")
    of_tree = values.join(lone, "host", "left").withColumn("host", F.coalesce("tree", "host")).drop("tree")
    merged = of_tree.groupBy("host", "path", "weight", "is_text", "value")
    merged = merged.agg(*[F.sum(c).alias(c) for c in ("c", "chars", "linked")])
    low = written(unimportant(trees(merged), least), "low")
    own = values.join(lone, "host").select("host", "path").distinct()
    of_lone = own.join(low.where(F.col("host") == LONE).select("path"), "path").select("host", "path")
    return low.where(F.col("host") != LONE).unionByName(of_lone)


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    hosted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(pages["url"]).alias("host"), "html")
    found = written(parsed(hosted), "parsed", "zstd")  # all text, read once again
    low = written(unimportant_of_hosts(found, least), "unimportant")
    # Pages of a host that have the same paths lose the same ones: one row for each such list
    rows = found.where("path IS NULL").withColumn("list", F.xxhash64("page_host", "paths"))
    lists = rows.where(F.size("paths") > 0).select("page_host", "list", "paths").distinct()
    each = lists.select("page_host", "list", F.posexplode("paths").alias("at", "path"))
    gone = each.join(low.withColumnRenamed("host", "page_host"), ["page_host", "path"])
    gone = written(gone.groupBy("page_host", "list").agg(F.collect_set("at").alias("out")), "out")
    joined = rows.join(gone, ["page_host", "list"], "left")
    kept = F.filter("blocks", lambda b: ~F.array_contains("out", b["at"]))
    kept = F.when(F.col("out").isNull(), F.col("blocks")).otherwise(kept)
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op2_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
