"""Operator 3: main text of web pages by templates that are deduced from the pages of each host.

1. Each page is cut into tokens: an element at its place (the tags around it, each with its number among its like), or
   a block of text with the tags around it. How often each token occurs in each page of its host is its occurrence
   vector. Vectors are only compared, so each is summed up as two hash sums over its (page, count) pairs; tasks sum
   before anything is shuffled.
2. Tokens of a host with the same vector are an equivalence class. Classes of MEMBERS tokens or more in SUPPORT of
   the host's pages or more are valid. Their elements nest by their places; their texts, ordered by where they stand,
   have to keep that order in a page, or they aren't the template's there. A host of fewer than PAGES pages has none,
   since two pages that share a block may as well share what they say.
3. The elements that hold DOMINANT of the host's text outside links lie within each other; the innermost, though none
   beside a heading, is the template's slot of the article. Elements of the template that hold hardly more than links
   are its menus.
4. A page's text is what stands in that slot less the template's own texts and menus. Where a page has an article or
   main element, that is the slot, for its author has named it; on a page whose host has no template, or that lacks
   the template's slot, the page's own elements are measured as if it were its host. Parts that tags or names mark as a
   menu, header, footer, advert, form, comments or the like are dropped. Template text in the slot (share buttons,
   notices) stays if nothing else is there or it holds most of an article: then the page is a copy or near copy of
   others, not a frame around nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempestry.llm import common

MEMBERS, SUPPORT, PAGES = 3, 0.8, 3
#: Share of the text outside links that the elements around the article's slot hold; of links in a menu.
DOMINANT, LINKED = 0.5, 0.6
#: Template text of so many characters stays on a page without an article if template text is most of the page.
PROSE = 80
#: Templates are broadcast up to so many tokens of all hosts (8 bytes each) and joined by host beyond.
BROADCAST_TOKENS = 500_000
#: Running sums a task holds before it hands them on.
HELD = 300_000

#: Elements whose content is never text; that hold no content; that start and end a block; that are chrome.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select option datalist textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CHROME = frozenset("head title nav header footer aside form menu dialog".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role attributes that name chrome.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dialog "
    "disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup "
    "promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "toolbar topbar widget widgets contentinfo complementary".split()
)
#: Elements whose content is characters up to their own end tag, whatever it looks like.
RAW = frozenset("script style noscript iframe textarea title".split())
#: An end tag that is missing is implied where one of these starts.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}

SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


class Element(NamedTuple):
    """An open block element; chrome and content hold for those around it too, named and outer count names of chrome."""

    tag: str = ""
    name: str = ""
    chrome: bool = False
    content: bool = False
    named: int = 0
    outer: int = 0
    place: int = 0
    inside: dict[str, int] = {}  # noqa: RUF012 - the root's is made anew for each page


class Piece(NamedTuple):
    """A block of text, or an element that starts (text is None)."""

    path: str
    text: str | None
    marks: int
    content: bool
    tag: str
    place: int
    around: int
    linked: int


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def blocks(html: str) -> Iterator[Piece]:
    """Elements and text blocks of a page in order.

    marks is -1 for chrome, else how many elements with a name of chrome are, or are around, the innermost article or
    main: a name there may speak of what stands beside the article (has-sidebar, comment-open). path names the open
    block elements with their classes, place and around number an element and the one it is in, or the one that a text
    is in; linked counts a text's characters in links. References are decoded, white space within a block is one space;
    blocks without text are left out. Unclosed elements end where HTML implies it, a cut page anywhere.
    """
    root = Element(inside={})
    stack: list[Element] = []
    text: list[str] = []
    linked, link = 0, False

    def path() -> str:
        return "/".join(s.name for s in stack[-4:])

    def flush() -> Iterator[Piece]:
        nonlocal linked
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                e = stack[-1] if stack else root
                marks = -1 if e.chrome or e.named > e.outer else e.named
                yield Piece(path(), joined, marks, e.content, "", e.place, 0, min(linked, len(joined)))
            linked = 0

    silent, at = None, 0
    while m := TOKEN.match(html, at):
        at = m.end()
        closing, element, attributes, chars = m.groups()
        if element is None:
            if chars and silent is None:
                text.append(chars)
                if link:
                    linked += len(chars)
            elif m.group(0).startswith("<![CDATA[") and silent is None:
                text.append(m.group(0)[9:].removesuffix("]]>"))
            continue
        element = element.lower()
        title = ""
        if element in RAW and not closing and not attributes.endswith("/"):
            end = RAW_END[element].search(html, at)
            if element != "title":
                at = end.end() if end else len(html)
                continue
            if end:  # an unclosed title is read on as markup
                title, at = html[at : end.start()], end.start()
        if silent is not None:
            if closing and element == silent:
                silent = None
            continue
        if element in SILENT:
            if not closing and not attributes.endswith("/"):
                silent = element
            continue
        if element not in BLOCKS:
            if element == "a":
                link = not closing
            if element in ("br", "wbr", "img", "input"):
                text.append(" " if element == "br" else "")
            continue
        yield from flush()
        link = False
        if closing:
            opened = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == element), None)
            if opened is not None:
                del stack[opened:]
            continue
        if element in VOID or element == "hr":
            continue
        closes = CLOSES.get(element, ())
        while stack and (stack[-1].tag in ("p", *closes) or stack[-1].tag == "head" and element != "title"):
            stack.pop()
        names = []
        if "=" in attributes:
            names = [n for found in NAMED.findall(attributes) for n in SPLIT.split("".join(found)) if n]
        around = stack[-1] if stack else root
        within = any(s.tag in CONTENT for s in stack)
        hidden = bool(attributes and HIDDEN.search(attributes))
        chrome = around.chrome or element in CHROME and not (element == "header" and within) or hidden
        chrome_name = any(n.lower() in NAMES and not (within and n.lower() == "header") for n in names)
        named = around.named + (chrome_name and element not in ("html", "body", "main"))
        around.inside[element] = around.inside.get(element, 0) + 1
        stack.append(
            Element(
                element,
                f"{element}.{'.'.join(names)}" if names else element,
                chrome,
                around.content or (element in CONTENT and not chrome),
                named,
                named if element in CONTENT else around.outer,
                hashed(f"{around.place}/{element}{around.inside[element]}"),
                {},
            )
        )
        yield Piece(path(), None, 0, False, element, stack[-1].place, around.place, 0)
        if title:
            text.append(title)
    yield from flush()


def token_hash(path: str, text: str) -> int:
    return hashed(f"{path}\0{text}")


class Measure:
    """Elements of a page: place of the element around each, characters outside and in links, whether a heading."""

    def __init__(self, pieces: list[Piece]):
        self.around = {p.place: p.around for p in pieces if p.text is None}
        self.headings = {p.place for p in pieces if p.text is None and p.tag in HEADINGS}
        self.chars: dict[int, int] = dict.fromkeys(self.around, 0)
        self.links: dict[int, int] = dict.fromkeys(self.around, 0)
        for p in pieces:
            if p.text is not None and p.marks >= 0:
                for place in self.up(p.place):
                    self.chars[place] += len(p.text) - p.linked
                    self.links[place] += p.linked

    def up(self, place: int) -> Iterator[int]:
        while place:
            yield place
            place = self.around[place]

    def slot(self) -> int:
        """The page's own slot: as its host's, from this page alone."""
        most = max(self.chars.values(), default=0)
        chain = [(e, around) for e, around in self.around.items() if self.chars[e] >= DOMINANT * most]
        return innermost(chain, {self.around[h] for h in self.headings}) if most else 0


def innermost(chain: list[tuple[int, int]], with_heading: set[int]) -> int:
    """The last of the elements (place, around), from the outermost in, before one that has a heading beside it; or 0."""
    found = 0
    for place, around in chain:
        if found and around in with_heading:
            break
        found = place
    return found


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; an empty one if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


SUMS = ["v1", "v2", "pages", "at", "chars", "links"]
#: around is 0 for a text and the element around, plus 1, for an element; heading is 1 for one.
TOKENS = f"host string, token long, around long, heading long, {', '.join(f'{c} long' for c in SUMS)}"
TOKENS_ARROW = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("token", "around", "heading", *SUMS))])


def occurrences(pages: DataFrame) -> DataFrame:
    """TOKENS: v1 and v2 (hash sums of the token's vector), pages that have it, at (sum of its first places), and for
    an element the characters it holds outside and in links.

    Token 0 stands for the host itself: its pages are the host's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int, int], list[int]] = defaultdict(lambda: [0] * len(SUMS))

        def made() -> pa.RecordBatch:
            columns = [*([k[i] for k in sums] for i in range(4)), *([v[i] for v in sums.values()] for i in range(6))]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, TOKENS_ARROW, strict=True)]
            sums.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=TOKENS_ARROW)

        for batch in batches:
            for host, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                host, html = host.as_py(), html.as_py() or ""
                pieces = list(blocks(html))
                measure = Measure(pieces)
                found: dict[tuple[int, int, int], list[int]] = {}
                for at, p in enumerate(pieces):
                    if p.text is None:
                        key = (p.place, p.around + 1, int(p.tag in HEADINGS))
                        found[key] = [1, at, measure.chars[p.place], measure.links[p.place]]
                    else:
                        found.setdefault((token_hash(p.path, p.text), 0, 0), [0, at, 0, 0])[0] += 1
                page = xxhash.xxh64_intdigest(f"{url.as_py()}\0{html}")
                marks: dict[int, tuple[int, int]] = {}
                for token, (n, at, chars, links) in found.items():
                    if n not in marks:
                        h = xxhash.xxh64_intdigest(page.to_bytes(8, "little"), n)
                        marks[n] = (h & 0x7FFFFFFF, h >> 33)
                    s = sums[host, *token]
                    for i, x in enumerate((*marks[n], 1, at, chars, links)):
                        s[i] += x
                sums[host, 0, 0, 0][2] += 1
                if len(sums) > HELD:
                    yield made()
        yield made()

    rows = pages.select(
        host_of(F.col("url")).alias("host"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).mapInArrow(task, TOKENS)
    return rows.groupBy("host", "token", "around", "heading").agg(*(F.sum(c).alias(c) for c in SUMS))


def templates(pages: DataFrame) -> DataFrame:
    """host, texts (the template's, in their order), chain (elements that hold DOMINANT of the text, and the one around
    each, from the outermost in), headed (elements with a heading in them), menus; hosts without a template are left out.
    """
    sums = common.written(occurrences(pages), "occurrences")
    hosts = sums.where("token = 0").select("host", F.col("pages").alias("of")).where(F.col("of") >= PAGES)
    total = sums.where("around = 1").groupBy("host").agg(F.sum("chars").alias("all_chars"))  # the outermost elements
    frequent = sums.where("token != 0").join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    is_text = F.col("around") == 0
    classes = frequent.groupBy("host", "v1", "v2", "pages").agg(F.count("*").alias("members"))
    valid = frequent.join(classes.where(F.col("members") >= MEMBERS), ["host", "v1", "v2", "pages"])
    place = F.col("at") / F.col("pages")
    kinds = valid.join(total, "host", "left").select(
        "host",
        F.when(is_text, F.struct(place.alias("place"), "token")).alias("text"),
        F.when(
            ~is_text & (F.col("chars") >= DOMINANT * F.col("all_chars")) & (F.col("chars") > 0),
            F.struct(place.alias("place"), "token", (F.col("around") - 1).alias("around")),
        ).alias("chain"),
        F.when(F.col("heading") == 1, F.col("around") - 1).alias("headed"),
        F.when(
            ~is_text & (F.col("links") > 0) & (F.col("links") >= LINKED * (F.col("chars") + F.col("links"))),
            F.col("token"),
        ).alias("menu"),
    )
    kinds = kinds.where("text is not null or chain is not null or headed is not null or menu is not null")
    found = kinds.groupBy("host").agg(
        F.array_sort(F.collect_list("text")).alias("texts"),
        F.array_sort(F.collect_list("chain")).alias("chain"),
        F.array_sort(F.collect_set("headed")).alias("headed"),
        F.array_sort(F.collect_set("menu")).alias("menus"),
    )
    return found.select(
        "host",
        F.col("texts.token").alias("texts"),
        F.transform("chain", lambda e: F.struct(e["token"].alias("token"), e["around"].alias("around"))).alias("chain"),
        "headed",
        "menus",
    )


class Template:
    def __init__(self, row: dict | None = None):
        row = row or {"texts": [], "chain": [], "headed": [], "menus": []}
        self.rank = {token: i for i, token in enumerate(row["texts"])}
        self.slot = innermost([(e["token"], e["around"]) for e in row["chain"]], {*row["headed"]})
        self.menus = {*row["menus"]}

    def in_order(self, tokens: list[tuple[int, int]]) -> set[int]:
        """Numbers of the page's texts, given as (number, token), that are the template's in its order: of those the
        longest run, so that a text at another place isn't taken for the template's."""
        ends: list[int] = []
        last: list[tuple[int, tuple | None]] = []
        for number, token in tokens:
            if token not in self.rank:
                continue
            rank = self.rank[token]
            i = bisect_left(ends, rank + 1)  # a text that stands twice counts twice
            link = (number, last[i - 1] if i else None)
            if i == len(ends):
                ends.append(rank)
                last.append(link)
            else:
                ends[i], last[i] = rank, link
        found, at = set(), last[-1] if last else None
        while at:
            found.add(at[0])
            at = at[1]
        return found


def page_text(html: str | None, template: Template) -> str:
    """Text of the page: its slots, one block a line.

    An article with a name of chrome on or around it counts if it's longer than all that is marked less, or if a single
    one is named on a page without an unmarked article.
    """
    pieces = list(blocks(html or ""))
    framed = template.in_order([(i, token_hash(p.path, p.text)) for i, p in enumerate(pieces) if p.text is not None])
    found: dict[int, list[int]] = defaultdict(list)
    for i, p in enumerate(pieces):
        if p.text is not None and p.marks >= 0:
            found[p.marks].append(i)

    def size(numbers: list[int]) -> int:
        return sum(len(pieces[i].text) for i in numbers)

    taken = found.pop(0, [])
    if any(pieces[i].content for i in taken):
        taken = [i for i in taken if pieces[i].content]
    plain = not any(pieces[i].content for i in taken)
    for marks in sorted(found):
        if marks == 1 and plain or size(found[marks]) > size(taken):
            taken = sorted(taken + found[marks])
    article = any(pieces[i].content for i in taken)
    if not article:
        measure = Measure(pieces)
        slot = template.slot if template.slot in measure.around else measure.slot()
        within = [i for i in taken if slot in measure.up(pieces[i].place)]
        menus = template.menus.difference(measure.up(slot))
        taken = [i for i in within if menus.isdisjoint(measure.up(pieces[i].place))] or within or taken
    own = [i for i in taken if i not in framed]
    if 2 * size(own) < size(taken):
        own = [i for i in taken if article or i not in framed or len(pieces[i].text) >= PROSE]
    return "\n".join(pieces[i].text for i in own or taken)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html; others are ignored).

    A null html is empty; a page without content has an empty text. A null url has the host "". Pages of any length
    are read whole; repeated rows are extracted each, and count as pages of their host.
    """
    common.short_batches(pages.sparkSession)
    found = common.written(templates(pages), "templates")
    parts = ("texts", "chain", "headed", "menus")
    size = found.agg(F.coalesce(F.sum(sum(F.size(c) for c in parts)), F.lit(0))).first()[0]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, template = None, Template()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, texts = batch.slice(start, 256), []
                for html, host, row in zip(part.column(2), part.column(3), part.column(4), strict=True):
                    if host.as_py() != known:
                        known, template = host.as_py(), Template(row.as_py())
                    texts.append(page_text(html.as_py(), template))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
                )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    whole = found.select("host", F.struct(*parts).alias("template"))
    joined = rows.join(F.broadcast(whole) if size <= BROADCAST_TOKENS else whole, "host", "left")
    joined = joined.select("page_id", "url", "html", "host", "template")
    return joined.mapInArrow(task, "page_id long, url string, text string")
