"""Main text of web pages by deduced templates.

Pages of one host come from templates. A page's tokens are its runs of text, each in its place: the path of block elements
with their classes and ids. The places of a host are grouped by occurrence vector (how often they stand on which pages): an
equivalence class. A class whose members stand once a page, on several pages, always in one order, is valid; the widest one
is the host's frame. The frame cuts every page into slots, and the other valid classes, also those that repeat on a page, nest
into the slots and cut them further, so that one place is told apart by the innermost slot it stands in. Of each (slot, place) the template keeps how many words vary from page to page, and
which texts don't vary: these are the template's own.

A second pass extracts the slots: blocks of ``article`` and ``main`` elements where the page has them; else, from the page's
root, it goes down to the part that holds the words that vary, by the template's numbers, without the template's own texts and
without places for links. Elements such as ``nav`` or ``footer``, and classes and ids named so, never hold main text; names
for main text only break ties. A page of an unknown layout is judged by its own words, so hosts may have any number of layouts.

Pages whose places are equal, one by one, have one layout: classes and slots are found on each host's distinct layouts, which count
as their pages. Vectors are kept as page count, sum and an order-free hash, and everything is grouped by page or summed by task first,
so no host's pages are ever gathered. A host's template grows with the variety of its markup, not with its pages.

Defined results: a null or empty page, or one without main text, gives the empty text. Pages are treated one by one, equal
or not; broken markup is read as browsers do (an open paragraph ends where the next begins, what is left open ends with the
page). A null URL is a host of its own; null ids stay null. Pages of any length are read whole. An empty table gives an empty
result. Columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
#: Elements, and words of classes, that never hold main text.
SIDE_ELEMENTS = frozenset("head title nav header footer aside form script style noscript template iframe button select textarea svg canvas object embed audio video dialog menu".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side aside footer header masthead topbar comment comments disqus respond reply replies cookie cookies consent notice notices alert popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended widget toolbar pagination pager copyright legal".split()
)
MAIN_ELEMENTS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article content main post entry story body text".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|role|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Words that say where or how large, beside the word that says what.
FILLER = frozenset("left right top bottom first last box wrap wrapper container area block section list item items inner outer post posts link links bar global site page mobile desktop".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^A-Za-z_\-\s]+")
_COUNTER = re.compile(r"\d{3,}")
#: Blocks of text that are part of something larger.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
_HEADINGS = frozenset("h1 h2 h3".split())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, path or name, text): "open" and "close" of block elements, "break" of br, "link" and "unlink", "text"."""
    at = 0
    find = _TAG.search
    while True:
        m = find(page, at)
        if m is None:
            if at < len(page):
                yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            yield "close", name, ""
            continue
        label = name
        if m[3]:
            # Long numbers count pages, not places.
            words = {_COUNTER.sub("0", w.replace(".", "-").replace("/", "-")) for _, *x in _NAMES.findall(m[3]) for w in "".join(x).split()}
            if words:
                label = name + "." + ".".join(sorted(words))
        yield "open", label, ""
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if name in ("title", "textarea"):
                yield "text", "", page[at:stop]
            at = end.end() if end else len(page)
            yield "close", name, ""


def runs(page: str) -> Iterator[tuple[str, str, int, int]]:
    """(path, text, characters in links, place): the page's blocks of text, each with the path of its block elements."""
    stack: list[str] = []
    names: list[str] = []
    part: list[str] = []
    links = in_link = place = 0

    def block() -> tuple[str, str, int, int] | None:
        nonlocal links, place
        text = " ".join(entities.unescape("".join(part)).split())
        part.clear()
        out = ("/".join(stack), text, links, place) if text else None
        links = 0
        place += out is not None
        return out

    for kind, label, text in tokens(page):
        if kind == "text":
            part.append(text)
            if in_link:
                links += len(text.strip())
            continue
        name = label.partition(".")[0]
        if name == "br":
            part.append(" ")
        elif name == "a":
            in_link = 1 if kind == "open" else 0
        elif name in INLINE and name != "label":
            # An inline element with a telling class is a place of its own.
            if kind == "open" and "." in label and _side(label.partition(".")[2]):
                if (out := block()) is not None:
                    yield out
                stack.append(label), names.append(name)
            elif kind == "close" and names and names[-1] == name:
                if (out := block()) is not None:
                    yield out
                stack.pop(), names.pop()
        elif name in VOID:
            if name == "hr" and (out := block()) is not None:
                yield out
        else:
            if (out := block()) is not None:
                yield out
            in_link = 0
            if kind == "open":
                while names and name in ENDED_BY.get(names[-1], ()):
                    stack.pop(), names.pop()
                stack.append(label), names.append(name)
            elif name in names:
                while names:
                    stack.pop()
                    if names.pop() == name:
                        break
    if (out := block()) is not None:
        yield out


def host(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


@lru_cache(1 << 16)
def _words_of(name: str) -> frozenset[str]:
    return frozenset(w.lower() for w in _PARTS.findall(name) if not w.isdigit())


def _side(names: str) -> bool:
    """Whether a class or id names a part without main text: all its words do but those of place and size ("right-sidebar", "relatedPosts", not "no-sidebar")."""
    return any((telling := _words_of(n) - FILLER) and telling <= SIDE_WORDS for n in names.split("."))


def _main(names: str, words: frozenset[str]) -> bool:
    return any(parts and parts <= words for n in names.split(".") for parts in [_words_of(n)])


@lru_cache(1 << 16)
def _role(path: str) -> int:
    """-1: never main text; 1: in an element for it; 2: in one whose class names it; 0: unknown.

    Side elements hold no main text at any depth. Of classes the innermost telling element's count, sides first, but a mere class
    word for main text doesn't lead out of an element with a side class (a comment's body). Classes of html and body never count.
    """
    role = 0
    for label in path.split("/"):
        name, _, names = label.partition(".")
        if name in SIDE_ELEMENTS:
            return -1
        if name in ("html", "body"):
            continue
        if names and _side(names):
            role = -1
        elif name in MAIN_ELEMENTS or (names and _main(names, MAIN_ELEMENTS)):
            role = 1
        elif role == 0 and names and _main(names, MAIN_WORDS):
            role = 2
    return role


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


#: A row for each page; its runs of text in their order, in lists. layout names the list of their places, by 128 bits.
_PAGE_ROW = "host string, layout binary, places array<string>, texts array<long>, words array<int>, linked array<int>"


def page_rows(pages: DataFrame) -> DataFrame:
    """The places of all pages (host, html) and what stands in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = [[(path, text_key(text), text.count(" ") + 1, int(2 * links >= len(text))) for path, text, links, _ in runs(page or "") if _role(path) >= 0] for page in batch.column(1).to_pylist()]
                first = pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32())
                columns = list(zip(*(x for f in found for x in f), strict=True)) or [()] * 4
                lists = [pa.ListArray.from_arrays(first, pa.array(c, k)) for c, k in zip(columns, kinds, strict=True)]
                layout = pa.array([xxhash.xxh3_128_digest("\n".join([str(len(f)), *(path for path, *_ in f)]).encode()) for f in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), layout, *lists], names=[c.split()[0] for c in _PAGE_ROW.split(", ")])

    return pages.select("host", "html").mapInArrow(run, _PAGE_ROW)


def layouts(rows: DataFrame) -> DataFrame:
    """(host, page, places, copies): each host's distinct lists of places, and on how many pages each stands."""
    return rows.groupBy("host", F.col("layout").alias("page"), "places").agg(F.count("*").alias("copies"))


def places(pages: DataFrame) -> DataFrame:
    """(host, page, copies, pos, place): the places of distinct layouts, each of which counts as so many pages."""
    return pages.select("host", "page", "copies", F.posexplode("places").alias("pos", "place"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """The places of all pages (host, page, html), each a layout of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[path for path, *_ in runs(page or "") if _role(path) >= 0] for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), pa.array([1] * len(found), pa.int64())], names=["host", "page", "places", "copies"])

    return places(pages.mapInArrow(run, "host string, page long, places array<string>, copies long"))


def equivalence_classes(blocks: DataFrame) -> DataFrame:
    """(host, class, place, pages, n, at, size): places with their class, named by the hash of its occurrence vector; at: mean position; size: members.

    A place stands equally often on all pages of a layout, so that layouts tell vectors apart as pages do.
    """
    counts = blocks.groupBy("host", "page", "place").agg(F.max("copies").alias("copies"), F.count("*").alias("n"), F.min("pos").alias("pos"))
    vectors = counts.groupBy("host", "place").agg(
        F.sum("copies").alias("pages"), F.sum(F.col("n") * F.col("copies")).alias("n"), (F.sum(F.col("pos") * F.col("copies")) / F.sum("copies")).alias("at"), F.bit_xor(F.xxhash64("page", "n")).alias("class")
    )
    size = vectors.groupBy("host", "class").agg(F.count("*").alias("size"))
    return vectors.join(size, ["host", "class"]).select("host", "class", "place", "pages", "n", "at", "size")


def valid_classes(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, class): classes on two pages at least whose members come in one order on all, on each page as often as the class stands there, round after round."""
    found = blocks.select("host", "page", "place", "pos").join(classes.filter("pages >= 2").select("host", "place", "class", "size"), ["host", "place"])
    order = found.groupBy("host", "class", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "place"))), lambda x: x["place"]).alias("order"), F.max("size").cast("int").alias("size"))
    order = order.withColumn("once", F.expr("slice(order, 1, size)")).withColumn("rounds", F.expr("order = flatten(array_repeat(once, cast(size(order) DIV size AS int)))"))
    return order.groupBy("host", "class").agg(F.min(F.hash("once")).alias("low"), F.max(F.hash("once")).alias("high"), F.min("rounds").alias("rounds")).filter("low = high AND rounds").select("host", "class")


def frames(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, place, at): the members of each host's frame, its widest valid class: once a page, on two pages at least, in one order on all."""
    once = classes.filter("pages >= 2 AND n = pages")
    valid = valid_classes(blocks, once)
    widest = once.join(valid, ["host", "class"]).groupBy("host").agg(F.max_by("class", F.struct("pages", "size", "class")).alias("class"))
    return once.join(widest, ["host", "class"]).select("host", "place", "at")


#: The slot that a whole page is, before its frame cuts it.
PAGE = 0


def nested(blocks: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, slot, class, size, place): members of the valid classes and the slot that each class cuts; (host, page, pos, slot): slots behind members, from pos -1 on.

    First the frame cuts the pages, then in every slot, round by round, those valid classes cut that stand in this slot alone on all their pages and are
    the widest such there on each of them; so layouts that share no page go on together. A class that stands in several slots nests nowhere.
    """
    known = classes.join(valid_classes(blocks, classes), ["host", "class"]).select("host", "place", "class", "size", F.struct((F.col("n") == F.col("pages")).alias("once"), "pages", "size", "class").alias("rank"))
    known = materialized(known, "template-valid")
    members = blocks.select("host", "page", "pos", "place").join(known, ["host", "place"]).select("host", "page", "pos", "class", "rank")
    starts = blocks.select("host", "page").distinct().withColumn("pos", F.lit(-1))
    now = materialized(members.unionByName(starts, allowMissingColumns=True).withColumn("slot", F.lit(PAGE).cast("long")).withColumn("open", F.col("class").isNotNull()), "template-nests")
    cuts = now.filter("false").select("host", "slot", "class")
    within = Window.partitionBy("host", "page", "slot")
    while True:
        one = now.filter("open").groupBy("host", "class").agg(F.min("slot").alias("low"), F.max("slot").alias("high")).filter("low = high").select("host", "class", F.lit(True).alias("inside"))
        seen = now.join(one, ["host", "class"], "left").withColumn("inside", F.col("open") & F.coalesce("inside", F.lit(False)))
        seen = seen.withColumn("cut", F.max(F.when(F.col("inside"), F.col("rank"))).over(within)["class"])
        widest = seen.filter("inside").groupBy("host", "class").agg(F.min(F.col("cut") == F.col("class")).alias("all")).filter("all").select("host", F.col("class").alias("cut"), F.lit(True).alias("chosen"))
        seen = seen.join(widest, ["host", "cut"], "left").withColumn("taken", F.coalesce(F.col("chosen") & F.col("open") & (F.col("class") == F.col("cut")), F.lit(False)))
        passed = F.sum(F.col("taken").cast("long")).over(within.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        width = F.max(F.when(F.col("taken"), F.col("rank")["size"])).over(within)
        gap = F.when(passed > 0, (passed - 1) % width + 1).otherwise(F.lit(0).cast("long"))
        seen = seen.withColumn("of", F.col("slot")).withColumn("slot", F.when(F.col("chosen"), F.xxhash64("slot", "cut", gap)).otherwise(F.col("slot"))).withColumn("open", F.col("open") & ~F.col("taken"))
        now = materialized(seen.select("host", "page", "pos", "class", "rank", "slot", "open", "of", "taken"), "template-nests")
        fresh = now.filter("taken").select("host", F.col("of").alias("slot"), "class").distinct()
        if fresh.isEmpty():
            cuts = cuts.join(known.select("host", "class", "size", "place"), ["host", "class"]).select("host", "slot", "class", "size", "place")
            return cuts, now.select("host", "page", "pos", "slot")
        cuts, now = cuts.unionByName(fresh), now.drop("of", "taken")


def _part_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pages as lists (parts, of, texts, words, linked): a row for each part and text of a batch, pages: on how many of its pages it stands."""
    names = ("part", "text", "of", "pages", "n", "words", "linked")
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            page = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
            if not len(page):
                continue
            part, of, text, words, linked = (batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            order = np.lexsort((page, text, part))
            page, part, of, text, words, linked = (x[order] for x in (page, part, of, text, words, linked))
            new = np.ones(len(page), bool)
            new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
            other = new.copy()
            other[1:] |= page[1:] != page[:-1]
            start = np.flatnonzero(new)
            sums = (np.add.reduceat(x.astype(np.int64), start) for x in (other, np.ones(len(page)), words, linked))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part[new], text[new], of[new], *sums)], names=names)


def templates(rows: DataFrame) -> DataFrame:
    """(host, cuts, parts, own): members of the nested classes with the slots that they cut; (slot, place, words that vary on a page) of its parts; keys of texts of its own."""
    distinct = materialized(layouts(rows), "template-layouts")
    blocks = places(distinct)
    classes = materialized(equivalence_classes(blocks), "template-classes")
    cuts, behind = nested(blocks, classes)
    inside = Window.partitionBy("host", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    slotted = blocks.withColumn("slot", F.lit(None).cast("long")).unionByName(behind, allowMissingColumns=True)
    slotted = slotted.groupBy("host", "page", "pos").agg(F.max("place").alias("place"), F.max("slot").alias("slot"))
    slotted = materialized(slotted.withColumn("slot", F.last("slot", ignorenulls=True).over(inside)).filter("pos >= 0"), "template-slots")
    # A part is a place in a slot. It has a number, and each layout the list of its parts.
    named = slotted.select("host", "slot", "place").distinct().join(classes.select("host", "place", F.col("pages").alias("of")), ["host", "place"])
    named = materialized(named.withColumn("part", F.monotonically_increasing_id()), "template-parts")
    listed = slotted.join(named, ["host", "slot", "place"]).groupBy("host", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "of"))).alias("at"))
    listed = materialized(listed.select("host", F.col("page").alias("layout"), F.col("at")["part"].alias("parts"), F.col("at")["of"].alias("of")), "template-lists")
    texts = rows.select("host", "layout", "texts", "words", "linked").join(listed, ["host", "layout"]).select("parts", "of", "texts", "words", "linked")
    texts = texts.mapInArrow(_part_texts, "part long, text long, of long, pages long, n long, words long, linked long")
    texts = texts.groupBy("part", "text").agg(F.max("of").alias("of"), *[F.sum(c).alias(c) for c in ("pages", "n", "words", "linked")])
    # A text is the template's own where half of the pages that have its place, and four at least, have it there.
    texts = texts.withColumn("own", (F.col("of") >= 4) & (2 * F.col("pages") >= F.col("of")))
    parts = texts.groupBy("part").agg(
        F.max("of").alias("of"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("words"))).alias("words"), F.sum("n").alias("n"), F.sum("linked").alias("linked"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("same"),
        F.collect_set(F.when(F.col("own"), F.col("text"))).alias("own"),
    )
    weight = F.when((2 * F.col("linked") >= F.col("n")) | (2 * F.col("same") > F.col("n")), 0.0).otherwise(F.col("words") / F.col("of"))
    known = parts.filter("of >= 2").join(named.drop("of"), "part").groupBy("host").agg(F.collect_list(F.struct("slot", "place", weight.alias("weight"))).alias("parts"), F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    cut = cuts.groupBy("host").agg(F.collect_list(F.struct("slot", "place", "class", "size")).alias("cuts"))
    return known.join(cut, "host", "left").select("host", "cuts", "parts", "own")


def _child(slot: int, name: int, gap: int) -> int:
    """The slot's name, as Spark's xxhash64 of the three gives it."""
    seed = 42
    for x in (slot, name, gap):
        seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


class Template:
    """A host's template as tasks use it."""

    def __init__(self, cuts=None, parts=None, own=None):
        self.cuts = {(c["slot"], c["place"]): (c["class"], c["size"]) for c in cuts or ()}
        self.weight = {(p["slot"], p["place"]): p["weight"] for p in parts or ()}
        self.own = frozenset(own or ())
        self._children: dict[tuple[int, int, int], int] = {}

    def slots(self, places: list[str]) -> list[int]:
        """The innermost slot of each of a page's places, given in their order."""
        out = [PAGE] * len(places)
        work = [(PAGE, list(range(len(places))))] if self.cuts else []
        while work:
            slot, at = work.pop()
            found = [self.cuts.get((slot, places[i])) for i in at]
            cut = next((x for x in found if x), None)
            if cut is None:
                continue
            passed, gaps = 0, {}
            for i, x in zip(at, found, strict=True):
                passed += x == cut
                gaps.setdefault((passed - 1) % cut[1] + 1 if passed else 0, []).append(i)
            for gap, inner in gaps.items():
                key = (slot, cut[0], gap)
                child = self._children.get(key)
                if child is None:
                    child = self._children[key] = _child(*key)
                for i in inner:
                    out[i] = child
                work.append((child, inner))
        return out


def _core(free: list[tuple[str, float]]) -> str:
    """The path of the part that holds the words: from the root, down to the one child that has nearly all of them, as long as no heading is left behind."""
    prefix: list[str] = []
    paths = [(path.split("/"), weight) for path, weight in free]
    while True:
        depth = len(prefix)
        below: dict[str, float] = {}
        for path, weight in paths:
            key = path[depth] if depth < len(path) else ""
            below[key] = below.get(key, 0.0) + weight
        best = max(below, key=below.get)
        left = [path for path, weight in paths if (path[depth] if depth < len(path) else "") != best and weight > 0]
        if not best or best.partition(".")[0] in LEAVES or below[best] < 0.8 * sum(below.values()) or any(p[-1].partition(".")[0] in _HEADINGS for p in left):
            return "/".join(prefix)
        prefix.append(best)
        paths = [x for x in paths if x[0][depth : depth + 1] == [best]]


def main_text(page: str, template: Template | None = None) -> str:
    """The blocks of a page's main text, in order."""
    known = template or Template()
    found = [(path, text, links, role) for path, text, links, _ in runs(page) if (role := _role(path)) >= 0]
    blocks = [(*b, slot) for b, slot in zip(found, known.slots([b[0] for b in found]), strict=True)]
    if out := [text for _, text, _, role, _ in blocks if role == 1]:
        return "\n".join(out)
    plain = [b for b in blocks if 2 * b[2] < len(b[1])]
    free = [(b, known.weight.get((b[4], b[0]), float(b[1].count(" ") + 1))) for b in plain if text_key(b[1]) not in known.own]
    free = [(b, w) for b, w in free if w > 0] or free or [(b, 1.0) for b in plain]
    if not free:
        return ""
    named = [(b, w) for b, w in free if b[3] == 2]
    if 2 * sum(w for _, w in named) >= sum(w for _, w in free):
        free = named
    # A place's weight is that of all its blocks on a page.
    share: dict[tuple[int, str], int] = {}
    for b, _ in free:
        share[b[4], b[0]] = share.get((b[4], b[0]), 0) + 1
    core = _core([(b[0], w / share[b[4], b[0]] if (b[4], b[0]) in known.weight else w) for b, w in free])
    return "\n".join([b[1] for b, _ in free if not core or b[0] == core or b[0].startswith(core + "/")])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host(F.col("url")))
    found = materialized(templates(materialized(page_rows(rows), "template-pages")), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                # Rows of one host stand together or not; each host's template is read once a slice.
                names = batch.column(2).to_pylist()
                held = {h: held[h] for h in set(names) & set(held)}
                for k, h in enumerate(names):
                    if h not in held:
                        held[h] = Template(*(batch.column(c)[k].as_py() for c in (4, 5, 6)))
                texts = [main_text(page or "", held[h]) for h, page in zip(names, batch.column(3).to_pylist(), strict=True)]
                sizes = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes)], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(found, "host", "left").select("page_id", "url", "host", "html", "cuts", "parts", "own")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
