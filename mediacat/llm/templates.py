"""Main text of web pages by the template that the pages of a host share."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import shared_folder, written

#: Different pages that a host's template needs, the share of the host's pages that a class must be in, and its least tags.
LEAST_PAGES = 10
LEAST_SHARE = 0.5
LEAST_TAGS = 3

MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter output progress q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var nobr".split()
)
#: A start tag of the one closes an open one of the other.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
#: Within these an open one further out is another one.
FENCES = frozenset("ul ol dl table article section main aside nav div body select".split())
BESIDE = frozenset(
    "head script style noscript template nav footer aside form button select option textarea dialog iframe svg math object canvas"
    " audio video menu noembed noframes title".split()
)
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted"
    " nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar rail widget widgets footer masthead topbar"
    " toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations comment comments respond reply replies disqus skip toc".split()
)
#: Class names that begin so speak of the page around an element.
AROUND = ("has-", "with-", "no-", "without-", "is-", "js-")
MAIN = frozenset(("article", "main"))
PARTS = re.compile(r"[^A-Za-z]+")


@dataclass
class Segment:
    """A block of text: what is between two block-level tags. element: the innermost one around it."""

    element: int
    text: str
    beside: bool
    main: bool
    linked: bool
    entry: bool


@dataclass
class Page:
    """tags: (element, whether it is an end tag) -> times; parents and slots: by element."""

    tags: Counter = field(default_factory=Counter)
    parents: dict[int, int] = field(default_factory=dict)
    slots: set[int] = field(default_factory=set)
    segments: list[Segment] = field(default_factory=list)


def number_of(*parts) -> int:
    data = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def _beside(name: str, attributes: str, in_main: bool) -> tuple[bool, str]:
    """Whether an element holds no article by its name, role, class or id, and how it is called with its class."""
    mark = name
    beside = name in BESIDE or name == "header" and not in_main
    for key, *values in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "class":
            mark += "." + value
        if key in ("class", "id") and name not in ("html", "body"):
            for word in value.split():
                parts = [word] if name in MAIN or word.startswith(AROUND) else PARTS.split(word)
                beside |= any(p in BESIDE_WORDS or p == "header" and not in_main for p in parts)
        elif key == "role":
            beside |= value in BESIDE_ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            beside = True
        elif key == "style":
            beside |= "display:none" in value.replace(" ", "")
    return beside, mark


def read_page(source: str) -> Page:
    """Tags by path and blocks of text of one page.

    Comments, declarations and raw elements end as browsers end them; a missing end tag is supplied by the
    next one further out, or by a block-level start tag within a paragraph; end tags without a start are
    ignored. Inline elements end no block and are in no path; a line break is white space.
    """
    page, at, size = Page(), 0, len(source)
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
    known: dict[tuple[int, str], int] = {}
    pieces: list[str] = []
    linked = plain = link = 0

    def flush() -> None:
        nonlocal linked, plain, link
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            name, element, beside, main = stack[-1]
            page.segments.append(Segment(element, text, beside, main, linked > 0 and plain == 0, name == "li"))
        linked = plain = link = 0

    def put(text: str) -> None:
        nonlocal linked, plain
        pieces.append(html.unescape(text) if "&" in text else text)
        visible = not text.isspace()
        linked += visible and link
        plain += visible and not link

    def element_of(mark: str) -> int:
        up = stack[-1][1]
        key = known.get((up, mark))
        if key is None:
            key = known[up, mark] = number_of(up, mark)
            page.parents[key] = up
        page.tags[key, False] += 1
        return key

    def close(names: frozenset | set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in FENCES:
                return

    while at < size:
        found = source.find("<", at)
        if found != at:
            put(source[at : found if found >= 0 else size])
            at = found if found >= 0 else size
            continue
        m = MARKUP.match(source, at)
        if m is None:
            put("<")
            at += 1
            continue
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if name in ("br", "wbr"):
            pieces.append(" " if name == "br" else "")
        elif m.group(1):
            if name == "a":
                link = 0
            elif name not in INLINE and (depth := next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)):
                flush()
                page.tags[stack[depth][1], True] += 1
                del stack[depth:]
        elif name in INLINE:
            beside, _ = _beside(name, m.group(3), stack[-1][3])
            end = re.compile(rf"[^<]*</{name}\s*>", re.I).match(source, at) if beside else None
            if end:
                at = end.end()
            elif name == "a":
                link = 1
        else:
            flush()
            if name not in VOID and name not in RAW:
                close({"p"})
                close(CLOSED_BY.get(name, frozenset()))
            _, _, was_beside, was_main = stack[-1]
            beside, mark = _beside(name, m.group(3), was_main)
            element = element_of(mark)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else size
            elif name not in VOID:
                main = not (was_beside or beside) and (was_main or name in MAIN)
                if main and not was_main:
                    page.slots.add(element)
                stack.append((name, element, was_beside or beside, main))
    flush()
    return page


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
TOKENS = "host string, token bigint, element bigint, parent bigint, slot boolean, n bigint, page bigint"
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
COMMON = "host string, token bigint, element bigint, parent bigint, slot boolean, pages bigint, total bigint, a bigint, b bigint"
TEMPLATE = "host string, slots array<bigint>, elements array<bigint>, texts array<bigint>"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tags and texts of each page by element, with the number of times; the page itself is the token 0."""
    names = [c.split()[0] for c in TOKENS.split(", ")]
    for batch in batches:
        for at in range(0, len(batch), 256):
            out: list[tuple] = []
            for host, source in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns]):
                page, own = read_page(source), number_of(source)
                out.append((host, 0, None, None, None, 1, own))
                for (element, end), n in page.tags.items():
                    token, up = (number_of(element, "/"), None) if end else (element, page.parents[element])
                    out.append((host, token, element, up, element in page.slots, n, own))
                texts = Counter(number_of(s.element, s.text) for s in page.segments if not s.beside and not s.main)
                out += [(host, t, None, None, None, n, own) for t, n in texts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=names)


def nested_classes(tokens: pd.DataFrame) -> tuple[set[int], set[int], set[int]]:
    """The template of one host: its article slots, its elements, and the texts that are part of it.

    tokens: token, element and parent (end tags have no parent, texts neither), slot, pages, total, and the prints
    a and b of the vector. Tokens with one vector are a class. A class is valid if it has start tags, each of them
    in an element of the same class or of a valid class that is on as many pages or more, and end tags of such
    elements only; so valid classes nest. Texts that share the vector of a valid class of LEAST_TAGS tags or more, once
    a page, are as fixed as its tags and belong to the template. A slot is an article or main element of a valid class.
    """
    classes = [own for _, own in tokens.groupby(["pages", "total", "a", "b"], sort=False)]
    classes.sort(key=lambda c: (-c["pages"].iloc[0], c["total"].iloc[0], -len(c)))
    slots, elements, texts = set(), {0}, set()
    for own in classes:
        tags = own[own["element"].notna()]
        starts = tags[tags["parent"].notna()]
        inside = elements | set(starts["element"].astype("int64"))
        if not len(starts) or not set(tags["element"].astype("int64")) <= inside or not set(starts["parent"].astype("int64")) <= inside:
            continue
        elements = inside
        slots |= set(starts.loc[starts["slot"].astype(bool), "element"].astype("int64"))
        if len(tags) >= LEAST_TAGS and own["total"].iloc[0] == own["pages"].iloc[0]:
            texts |= set(own.loc[own["element"].isna(), "token"].astype("int64"))
    return slots, elements - {0}, texts


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def page_templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """host, slots, elements, texts: the template that a host's pages share; hosts without one have no row.

    Each page gives its tags and its texts by element, outside menus and articles, with the times each occurs. Tokens
    that occur equally often on every page of a host share a vector, known by two 64-bit prints summed by exclusive
    or over the pages, so a host may have any number of pages: a map task sends one row a token. Only tokens
    on half of a host's pages or more are looked at; there cannot be more of them than twice what an average
    page holds. A host needs LEAST_PAGES different pages.
    """
    folder = shared_folder(pages.sparkSession)
    hosts = pages.select(_host(url).alias("host"), F.coalesce(source, F.lit("")).alias("source"))
    prints = [F.expr(f"bit_xor(xxhash64({seed}, page, n))").alias(c) for c, seed in (("a", 1), ("b", 2))]
    facts = [F.max(c).alias(c) for c in ("element", "parent", "slot")]
    counts = hosts.mapInArrow(_tokens, TOKENS).groupBy("host", "token").agg(*facts, F.count("*").alias("pages"), F.sum("n").alias("total"), *prints)
    counts = written(counts.where(F.col("pages") >= LEAST_PAGES), folder, "tokens")
    different = hosts.select("host", F.xxhash64("source").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("different"))
    sizes = counts.where("token = 0").select("host", F.col("pages").alias("all_pages"))
    sizes = sizes.join(different.where(F.col("different") >= LEAST_PAGES), "host").drop("different")
    common = counts.where("token <> 0").join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all_pages"))

    def template(group: pd.DataFrame) -> pd.DataFrame:
        found = nested_classes(group.astype({c: "Int64" for c in ("element", "parent")}))
        return pd.DataFrame({"host": group["host"].iloc[:1], **{c: [sorted(map(int, f))] for c, f in zip(("slots", "elements", "texts"), found)}})

    columns = [c.split()[0] for c in COMMON.split(", ")]
    return written(common.select(*columns).groupBy("host").applyInPandas(template, TEMPLATE), folder, "templates")


def main_text(page: Page, slots: set[int], elements: set[int], texts: set[int]) -> str:
    """What is left of a page in the slots of its template, as blocks between empty lines.

    Blocks beside the article go. If the page has article slots, of the template or, where there is none, of
    its own, the text is what they hold; otherwise it is all that is left but for texts of the template and, in
    list entries and elements of the template, blocks that are nothing but a link.
    """
    left = [s for s in page.segments if not s.beside]
    slots = slots & page.slots or page.slots
    if slots:
        within: dict[int, bool] = {0: False}

        def inside(element: int) -> bool:
            way = []
            while element not in within and element not in slots:
                way.append(element)
                element = page.parents[element]
            held = element in slots or within[element]
            within.update(dict.fromkeys(way, held))
            return held

        main = [s for s in left if s.main and inside(s.element)]
        if main:
            return "\n\n".join(s.text for s in main)
    fixed = [s for s in left if not (texts and number_of(s.element, s.text) in texts)]
    return "\n\n".join(s.text for s in fixed if not (s.linked and (s.entry or s.element in elements)))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Main text of web pages: page_id, url, text, n_chars.

    The project keeps no web pages, so this is general: it takes any table of pages with an address each.

    The pages of a host are compared: tokens (tags by path, texts by path) with the same occurrence vector form
    classes, valid classes nest into the host's template, and the article is what stands in the template's slots.
    Article and main elements are slots whole, since copies of one article share all of its text. On pages without
    them the text is what is neither fixed in the template nor in a menu, header, footer, sidebar, notice, advert,
    form or comment; element names, roles and class names tell those, within slots too. Hosts with fewer than
    LEAST_PAGES different pages have no template, and pages without its slots use their own. White space within
    a block is one space; blocks stand in page order with an empty line between them.

    NULL and empty pages give an empty text; pages with a NULL or bad url are one host; repeated rows give a row each;
    other columns are not looked at. Templates are a written table joined by host: Spark broadcasts it where
    it is measured to be small, and otherwise splits the hosts that have too many pages.
    """
    templates = page_templates(pages, url, source)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(source, F.lit("")).alias("source"), _host(url).alias("host"))
    joined = rows.join(templates, "host", "left").select("page_id", "url", "source", "slots", "elements", "texts")
    kind = rows.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = zip(*[c.to_pylist() for c in part.columns[2:]])
                out = [main_text(read_page(source), *[set(x or ()) for x in template]) for source, *template in found]
                columns = [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars bigint")
