"""HTML extraction (6): consensus host paths.

Each page's containers are scored by their prose: characters outside of links in blocks that read like sentences, and
outside of boilerplate. From the page down, the container that holds nearly all of its parent's score is taken (an
``article`` or ``main`` with most of it first). The best one's path of tags and generalised classes (digits and what
follows them gone) is a vote of its host; votes are counted in Spark, and every page is read again with its host's
winning path. A page that has no such container, or whose url names no host, goes by its own best one.

A host's parts are compared as well. A part is a division, list, table or the like, outside of ``article`` and ``main`` also a
paragraph or heading, at its path of tags and classes. What stands on four different pages and more (and a hundredth of the host's), and
has at most one text for four of them, is fixed: boilerplate, whatever its name. Pages are different by their texts, so that copies of a page count once. A
container that is fixed wins no vote; if nothing on a page that reads like prose is outside of fixed parts, they stay. On a
host of four different pages and more, a sentence outside of the winning container stays too, unless it is fixed or the page has an ``article`` or
``main``: how long it is doesn't matter. On other pages a sibling with under a tenth of the prose goes.

Boilerplate is navigation, headers and footers of the page (those of an open ``article`` or ``main`` stay), asides, forms, scripts,
styles, hidden parts and what a class or id calls an advert, menu, sidebar, notice, comment or the like. The name has to be
made of such words and words of layout alone; one that only holds such a word beside others (``post-header``, ``related-work``,
``widget-theory``, ``ad-hoc``) is no more than a suspicion, which needs a part that is mostly links or holds form fields. Where a page has no ``article`` or ``main``, blocks that are nothing but a short link go, too.

Blocks are paragraphs, headings, list items, cells and the like; a line break inside one is white space. Null or empty
html gives an empty text. Repeated rows vote and are read one by one; of paths with equal votes the one with more prose wins, then the
first by name. An empty table gives no rows; pages may be of any length. Other columns of the pages are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import BASE, cut

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.DOTALL)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article body div html main section table tbody td tr".split())
DROPPED = frozenset("nav aside form footer button select option svg canvas object audio video dialog menu head".split())
#: Words of a class or id, split at what isn't a letter. The first ones name boilerplate, the next do beside words of layout.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus modal nav navbar navigation newsletter pager pagination popup promo promoted replies respond responses sidebar signup sponsor sponsored subscribe toolbar widget widgets".split()
)
WEAK = frozenset("banner footer form header menu notice notices related search share sharing skip social tags".split())
LAYOUT = frozenset("area articles bar block bottom box button buttons card container content cta footer global group head header inner item items left letter links list main outer page pages panel placeholder policy posts primary reader readers right row secondary section site slot stories teaser text thread title top unit user users wrap wrapper".split())
FIELDS = frozenset("button form input select textarea".split())
#: Parts that a host's pages are compared by; the second ones outside of article and main alone.
PARTS = frozenset("div dl ol section table ul".split())
LOOSE_PARTS = frozenset("blockquote figure h1 h2 h3 h4 h5 h6 header p pre".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open tag of the key is closed by the start of one of its own kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SENTENCE = re.compile(r"[.!?。！？…](?:\s|$|[\"')\]»”])")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url).hostname if url else None
    except ValueError:
        return None


class Node:
    """An open element. Suspects count the characters of their text, those of them in links, and form fields."""

    __slots__ = ("dropped", "fields", "inside", "links", "parent", "path", "place", "score", "suspect", "tag", "text")

    def __init__(self, tag: str, path: str, place: str, parent, dropped: bool, suspect: bool = False):
        self.tag, self.path, self.place, self.parent, self.dropped, self.suspect = tag, path, place, parent, dropped, suspect
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.score = self.text = self.links = self.fields = 0

    def is_boilerplate(self) -> bool:
        return self.dropped or self.suspect and (self.fields > 0 or 2 * self.links > self.text)

    def is_part(self) -> bool:
        return self.tag in PARTS or self.tag in LOOSE_PARTS and not self.inside


class Block(NamedTuple):
    at: Node  # the container
    inside: Node  # the innermost element
    text: str
    links: int  # characters in links

    def score(self) -> int:
        """Characters outside of links, if it reads like prose."""
        return len(self.text) - self.links if SENTENCE.search(self.text) or self.text.count(" ") >= 7 else 0


def _parts(word: str) -> tuple[str, ...]:
    """The word, or the two that it is made of, as in ``commentlist``."""
    for at in range(3, len(word) - 2):
        if word[:at] in STRONG and word[at:] in LAYOUT or word[:at] in LAYOUT and word[at:] in STRONG:
            return word[:at], word[at:]
    return (word,)


def _names_boilerplate(value: str) -> tuple[bool, bool]:
    """Does a class, id or role name boilerplate; may it?"""
    sure = maybe = False
    for name in value.split():
        words = {part for w in CAMEL.findall(name) for part in _parts(w.lower())}
        telling = words & (STRONG | WEAK)
        sure |= bool(telling) and words <= STRONG | WEAK | LAYOUT
        maybe |= bool(telling)
    return sure, maybe


def _open(tag: str, attributes: str, parent: Node) -> Node:
    kind, suspect = "", False
    dropped = parent.dropped or tag in DROPPED or (tag == "header" and not parent.inside)
    if attributes:
        for name, *values in NAMED.findall(attributes):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name == "class":
                kind = "." + ".".join(re.sub(r"\d.*", "", c) for c in sorted(value.lower().split()))
            if name in ("class", "id", "role") and tag not in ("body", "html", "article", "main"):
                sure, maybe = _names_boilerplate(value)
                dropped |= sure
                suspect |= maybe
            dropped |= name == "hidden" or (name == "aria-hidden" and value == "true")
    path = f"{parent.path}/{tag}{kind}" if tag in CONTAINERS else parent.path
    place = parent.place if tag in INLINE else f"{parent.place}/{tag}{kind}"
    return Node(tag, path, place, parent, dropped, suspect)


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The blocks outside of boilerplate, in page order, and all containers in page order."""
    root = Node("", "", "", None, False)
    stack, containers, blocks, text, linked = [root], [root], [], [], []

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block and not stack[-1].dropped:
                at = stack[-1]
                while at.tag and at.tag not in CONTAINERS:
                    at = at.parent
                links = min(len(block), len(" ".join(html.unescape("".join(linked)).split()))) if linked else 0
                blocks.append(Block(at, stack[-1], block, links))
                for node in stack:
                    if node.suspect:
                        node.text += len(block)
                        node.links += links
            text.clear()
            linked.clear()

    in_link = False
    at = 0
    search = TOKEN.search
    while True:
        m = search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not stack[-1].dropped:
            text.append(piece)
            if in_link:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m[1]
        if tag in FIELDS and not m[1]:
            for node in stack:
                node.fields += node.suspect
        if m[1]:
            if tag in INLINE:
                if tag == "br":
                    text.append(" ")
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag not in INLINE:
                        break
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                text.append(" " if tag == "br" else "")
            else:
                node = _open(tag, m[3], stack[-1])
                if node.dropped or node.suspect:
                    stack.append(node)
            continue
        flush()
        while len(stack) > 1 and stack[-1].tag in INLINE:
            stack.pop()
        if tag in VOID:
            continue
        if tag in CLOSES_P and any(x.tag == "p" for x in stack):
            k = max(k for k, x in enumerate(stack) if x.tag == "p")
            if not any(x.tag in CONTAINERS for x in stack[k:]):
                del stack[k:]
        elif tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        if m[3].rstrip().endswith("/") and tag not in CONTAINERS and tag != "p":
            continue
        node = _open(tag, m[3], stack[-1])
        stack.append(node)
        if tag in CONTAINERS:
            containers.append(node)
    flush()
    return [b for b in blocks if not _within(b.inside, Node.is_boilerplate)], containers


def _within(node: Node | None, test: Callable[[Node], bool]) -> bool:
    """Does the test hold for the element or one around it?"""
    while node is not None:
        if test(node):
            return True
        node = node.parent
    return False


def best_container(blocks: list[Block], containers: list[Node], share: float = 0.5, nearly: float = 0.9) -> Node | None:
    """An article or main with more than ``share`` of the page's score; else, from the page down, the child with ``nearly`` all of it."""
    for block in blocks:
        node, score = block.at, block.score()
        while node is not None:
            node.score += score
            node = node.parent
    if not (total := containers[0].score):
        return None
    if named := [c for c in containers if c.tag in ("article", "main") and c.score > share * total]:
        return max(named, key=lambda c: (c.tag == "article", c.score, c.path.count("/")))
    at = containers[0]
    for c in containers[1:]:  # in page order: a child comes after its parent
        if c.score >= nearly * at.score and _within(c.parent, lambda node, at=at: node is at):
            at = c
    return at


def place_key(place: str) -> int:
    return xxhash.xxh64_intdigest(place) - (1 << 63)


class Profile(NamedTuple):
    """What a page tells its host: the best container's path, its score and key, and hashes of the texts of the page and of its parts."""

    path: str | None
    size: int
    at: int | None
    page: int
    places: list[int]
    texts: list[int]


def profile(page: str) -> Profile:
    blocks, containers = blocks_of(page)
    best = best_container(blocks, containers)
    texts: dict[str, int] = {"": 1}
    for b in blocks:
        text = xxhash.xxh64_intdigest(b.text)
        node = b.inside
        while node is not None:
            if node.is_part() or not node.tag:
                texts[node.place] = (texts.get(node.place, 1) * BASE + text) % (1 << 64)
            node = node.parent
    whole = texts.pop("") - (1 << 63)
    vote = (best.path, best.score, place_key(best.place) if best.is_part() else None) if best else (None, 0, None)
    return Profile(*vote, whole, [place_key(x) for x in texts], [x - (1 << 63) for x in texts.values()])


def extract(page: str | None, path: str | None = None, fixed: frozenset[int] = frozenset(), known: bool = False) -> str:
    """The blocks of the containers at the path, or of the page's best one, joined by line breaks.

    fixed: keys of the host's fixed parts. known: the host has pages enough to tell them.
    """
    if not page:
        return ""
    blocks, containers = blocks_of(page)
    if fixed:
        left = [b for b in blocks if not _within(b.inside, lambda node: node.is_part() and place_key(node.place) in fixed)]
        blocks = left if any(b.score() for b in left) else blocks
    chosen = {id(c): c for c in containers if path and c.path == path}
    if not chosen or not any(_within(b.at, lambda node: id(node) in chosen) for b in blocks):
        best = best_container(blocks, containers) or containers[0]
        chosen = {id(best): best}
    wide = known and not any(c.inside for c in chosen.values())
    kept = [b for b in blocks if wide and b.score() and SENTENCE.search(b.text) or _within(b.at, lambda node: id(node) in chosen)]
    if any(not _within(b.at, lambda node: node.tag in ("article", "main")) and b.links < len(b.text) for b in kept):
        kept = [b for b in kept if b.links < len(b.text) or SENTENCE.search(b.text) or _within(b.at, lambda node: node.tag in ("article", "main"))]
    return "\n".join(b.text for b in kept)


def fixed_parts(found: DataFrame, pages: DataFrame, least: int = 4, per_text: int = 4, per_host: int = 100) -> DataFrame:
    """__host, place of the parts that are fixed.

    found: __host, page, places, texts of each page. pages: __host, n_pages. Parts on at least a ``per_host``-th of a host's
    pages are so few that a host's list of them is ``per_host`` times the parts of a page at most, whatever the host's size.
    """
    each = found.select("__host", "page", F.explode(F.arrays_zip("places", "texts")).alias("x")).select("__host", "page", F.col("x.places").alias("place"), F.col("x.texts").alias("part"))
    of_text = each.distinct().groupBy("__host", "place", "part").agg(F.count("*").alias("n"))
    of_place = of_text.groupBy("__host", "place").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    enough = (F.col("n") >= least) & (F.col("texts") * per_text <= F.col("n")) & (F.col("n") * per_host >= F.col("n_pages"))
    return of_place.join(pages, "__host").where(enough).select("__host", "place")


def html_extraction(pages: DataFrame, broadcast_hosts: int = 20_000, broadcast_parts: int = 1_000_000, salts: int = 16, least: int = 4, id_col: str = "page_id") -> DataFrame:
    """page_id, url, text, n_chars and the host's winning path.

    least: different pages of a host from which on its parts are compared.
    """

    @F.pandas_udf("string")
    def hosts(urls):
        return urls.map(host_of)

    @F.pandas_udf("path string, size long, at long, page long, places array<long>, texts array<long>")
    def profiles(htmls):
        import pandas as pd

        found = pd.DataFrame([profile(h) for h in htmls], columns=Profile._fields, dtype=object)
        return found.astype({"size": "int64", "at": "Int64", "page": "int64"})

    @F.pandas_udf("string")
    def texts(htmls, paths, fixed, known):
        import pandas as pd

        sets: dict[bytes, frozenset] = {}  # of the batch's hosts
        out = []
        for page, path, parts, enough in zip(htmls, paths, fixed, known, strict=True):
            parts = np.empty(0, np.int64) if parts is None else parts
            if (key := parts.tobytes()) not in sets:
                sets[key] = frozenset(parts.tolist())
            out.append(extract(page, path, sets[key], bool(enough)))
        return pd.Series(out, dtype=object)

    base = pages.select(F.col(id_col), F.col("url"), F.col("html"), hosts("url").alias("__host"))
    found = cut(base.where("__host is not null and html is not null").select("__host", profiles("html").alias("v")).select("__host", "v.*"))
    sizes = found.groupBy("__host").agg(F.count_distinct("page").alias("n_pages"))
    fixed = cut(fixed_parts(found, sizes, least))
    votes = found.where("path is not null").groupBy("__host", "path", "at").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    votes = votes.join(fixed.withColumnRenamed("place", "at"), ["__host", "at"], "left_anti")
    votes = votes.groupBy("__host", "path").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    first = Window.partitionBy("__host").orderBy(F.desc("n"), F.desc("size"), "path")
    winners = votes.withColumn("r", F.row_number().over(first)).where("r = 1").select("__host", "path")
    lists = fixed.groupBy("__host").agg(F.sort_array(F.collect_list("place")).alias("fixed"))
    told = sizes.join(winners, "__host", "left").join(lists, "__host", "left")
    told = cut(told.select("__host", "path", "fixed", (F.col("n_pages") >= least).alias("known")))
    if told.count() <= broadcast_hosts and fixed.count() <= broadcast_parts:  # a path a host, a number a part: some MB at most
        rows = base.join(F.broadcast(told), "__host", "left")
    else:
        spread = told.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = base.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int")).join(spread, ["__host", "__salt"], "left")
    rows = rows.select(id_col, "url", texts("html", "path", "fixed", F.coalesce("known", F.lit(False))).alias("text"), "path")
    return rows.select(id_col, "url", "text", F.char_length("text").cast("long").alias("n_chars"), F.col("path").alias("host_path"))
