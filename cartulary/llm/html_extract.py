"""Operator 3, HTML extraction by equivalence-class template deduction.

Pages of one host are made by templates. Each page becomes a list of tokens: tags, named by their path of elements with class and id, and
words, named by word and path. Over a group of same-host pages every token has an occurrence vector, its count in each page; tokens with one vector form
an equivalence class. A class is valid if it has ``min_size`` tokens, occurs in ``min_support`` of the group's pages, and its tokens come in the same order in
every page. Valid classes must nest: a class belongs to the innermost class in one of whose gaps (between two tokens that follow one another) all of
its occurrences lie; one that crosses another is dropped. The nested classes are the template; a gap is a slot, and every text stands in one slot: that of
the innermost class around it.

The slots are judged once for the whole group. What the elements of a slot's template path say (nav, footer, aside, form, ..., or a class or id such as
menu, cookie, advert, comments) makes it boilerplate; article and main elements make it a main slot. If the template has main slots, a page's text is all that
stands in them, also lines that every page has, such as its headings. Elements inside a slot that the template does not know are judged by name too. A page without text in any main
slot, as one of a minority template, is judged by its own elements: by its article or main element, or else all slots that are neither boilerplate nor template,
but for lines of links only that stand outside the path prefix of most of the page's own free text.

Inside a main element a compound name counts by its last part (``share-price`` is no share bar), or by its first if its last says that it holds other things
(``comments-area``, but not ``ad-hoc`` or ``related-work``), and a header is the article's own.

Rows are dealt by host; hosts with more than 1 / ``SHARES`` of all pages (so at most ``SHARES`` hosts) are salted over many tasks. Within
a task a host's pages follow one another and are taken in groups of ``group_pages`` up to twice as many, so memory does not depend on
the host's size, and paths are numbered, so it grows in proportion to depth. A host with one page has no vectors and is judged by its elements
alone. Pages without a host form groups likewise.

Text: character references are decoded, white space within a block becomes one space, blocks are joined in page order by one line feed. A
``br`` ends a block, as do block elements.

Nulls and edges: null or empty html gives empty text and 0 characters; a null url is allowed; repeated rows give repeated results; a page of
any length is read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartulary.llm.batches import no_tables

GROUP_PAGES = 64
SHARES = 1024
MIN_SUPPORT = 0.8
MIN_SIZE = 3

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd td th tr".split()),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}),
}
SCOPES = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"})}

#: Elements and names that mark what is not the article.
NOT_TEXT = frozenset("head title nav header footer aside form script style noscript template iframe svg button select option textarea object canvas dialog menu".split())
NOT_NAMES = frozenset(
    "nav navbar navigation menu menus header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended breadcrumb breadcrumbs comment comments respond reply replies disqus "
    "form search pagination pager toolbar widget widgets skip copyright".split()
)
NOT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())
#: First parts of compound names that mark what is not the article even inside it, before a last part that means a holder; and names that inside it are its own.
NEVER_PROSE = frozenset("comment comments respond disqus cookie cookies ad ads adv advert adverts advertisement newsletter sidebar breadcrumb breadcrumbs popup modal related recommended sponsor sponsored promo".split())
HOLDERS = frozenset("area box list section container wrapper wrap block slot unit bar panel posts articles stories links items thread feed inner outer module zone strip rail column tile card cards group widget".split())
OWN_NAMES = frozenset({"header", "masthead", "banner", "notice", "notices"})
MAIN = frozenset({"article", "main"})
MAIN_NAMES = frozenset({"article", "content", "post", "entry", "story", "main", "body"})

LEX = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def _element(name: str, attributes: str, inside: bool) -> tuple[str, bool, bool]:
    """Signature, whether it marks boilerplate, whether it marks the main text. inside: whether it stands inside a main element."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attributes)} if attributes else {}
    words = [[p.lower() for p in PARTS.findall(w)] for key in ("class", "id") for w in found.get(key, "").split()]
    role = found.get("role", "").lower()
    sign = name + "".join(f".{c}" for c in found.get("class", "").split()) + (f"#{found['id']}" if found.get("id") else "")
    if inside:
        named = any(w and (w[-1] in NOT_NAMES and w[-1] not in OWN_NAMES or w[0] in NEVER_PROSE and (w[-1] in HOLDERS or w[-1].isdigit())) for w in words)
        bad = name in NOT_TEXT and name != "header" or named
    else:
        bad = name in NOT_TEXT or any(not NOT_NAMES.isdisjoint(w) for w in words)
    bad = bad or role in NOT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    good = name in MAIN or role == "main" or any(not MAIN_NAMES.isdisjoint(w) for w in words)
    if name in MAIN or name in ("body", "html"):
        bad = "hidden" in found
    return sign, bad, good


class Names:
    """Numbers for the paths and tokens of a group's pages. A path: its parent's number, its last element, and what its elements say."""

    def __init__(self):
        self.paths: list[tuple[int, str, bool, bool, bool]] = [(-1, "", False, False, False)]  # parent, sign, boilerplate, main, link
        self.path_numbers: dict[tuple[int, str], int] = {}
        #: a token: ("<", path), ("</", path), or (word, path)
        self.tokens: list[tuple[str, int]] = []
        self.token_numbers: dict[tuple[str, int], int] = {}

    def path(self, parent: int, name: str, attributes: str) -> int:
        key = (parent, name + attributes)
        found = self.path_numbers.get(key)
        if found is None:
            _, _, was_bad, was_good, link = self.paths[parent]
            sign, bad, good = _element(name, attributes, was_good)
            own = (parent, "\0" + sign)
            found = self.path_numbers.get(own)
            if found is None or self.paths[found][2:4] != (was_bad or bad, was_good or good):
                found = self.path_numbers[own] = len(self.paths)
                self.paths.append((parent, sign, was_bad or bad, was_good or good, link or name == "a"))
            self.path_numbers[key] = found
        return found

    def token(self, kind: str, path: int) -> int:
        key = (kind, path)
        found = self.token_numbers.get(key)
        if found is None:
            found = self.token_numbers[key] = len(self.tokens)
            self.tokens.append(key)
        return found

    def is_tag(self, token: int) -> bool:
        return self.tokens[token][0] in ("<", "</")

    def signs(self, path: int) -> list[str]:
        """The elements of a path from the outermost, ids left out."""
        out = []
        while path > 0:
            path, sign = self.paths[path][:2]
            out.append(sign.partition("#")[0])
        return out[::-1]


class Page:
    """The tokens of one page, and its texts: [path, value, block number, number of tokens before it]."""

    def __init__(self, source: str, names: Names):
        self.names = names
        self.tokens: list[int] = []
        self.texts: list[tuple[int, str, int, int]] = []
        stack: list[tuple[str, int]] = []
        block = at = 0
        skip = lower = None

        def close(k: int) -> None:
            for _, path in reversed(stack[k:]):
                self.tokens.append(names.token("</", path))
            del stack[k:]

        def text(raw: str) -> None:
            value = html.unescape(raw) if "&" in raw else raw
            if value:
                path = stack[-1][1] if stack else 0
                self.texts.append((path, value, block, len(self.tokens)))
                if not value.isspace():
                    self.tokens.extend([names.token(w, path) for w in value.split()])

        while at < len(source):
            if skip:
                lower = lower if lower is not None else source.lower()
                end = lower.find(f"</{skip}", at)
                at, skip = (len(source) if end < 0 else end), None
                continue
            start = source.find("<", at)
            if start < 0:
                text(source[at:])
                break
            m = LEX.match(source, start)
            if m is None:  # a lone "<" is text
                nxt = source.find("<", start + 1)
                end = len(source) if nxt < 0 else nxt
                text(source[at:end])
                at = end
                continue
            if start > at:
                text(source[at:start])
            at = m.end()
            if m[1] is not None:
                text(m[1])
            if m[3] is None:
                continue
            name = m[3].lower()
            if name not in INLINE:
                block += 1
            if m[2]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                continue
            if name not in VOID:
                for opened, closers in CLOSED_BY.items():
                    if name in closers:
                        scope = SCOPES.get(opened, frozenset())
                        for k in range(len(stack) - 1, -1, -1):
                            if stack[k][0] == opened:
                                close(k)
                                break
                            if stack[k][0] in scope or opened == "p" and stack[k][0] not in INLINE:
                                break
            here = names.path(stack[-1][1] if stack else 0, name, m[4])
            self.tokens.append(names.token("<", here))
            if name in VOID or m[4].endswith("/"):
                continue
            stack.append((name, here))
            if name in RAW:
                skip = name


class Class:
    """A valid equivalence class: its vector, its tokens in template order, its occurrences in each page that has it, and its parent and gap there."""

    def __init__(self, vector: tuple, tokens: list[int], places: dict[int, list[int]]):
        self.vector, self.tokens, self.places = vector, tokens, places
        self.parent: Class | None = None
        self.gap = -1

    def spread(self) -> int:
        return sum(p[-1] - p[0] for p in self.places.values())

    def gap_of(self, inner: Class) -> int | None:
        """The gap that holds all occurrences of inner; None if there is none, -1 if it lies outside."""
        gaps = set()
        for page, places in inner.places.items():
            own = self.places.get(page)
            if own is None:
                return -1
            for at in places:
                k = bisect_left(own, at)
                gaps.add(-1 if k in (0, len(own)) else (k - 1) % len(self.tokens))
        return gaps.pop() if len(gaps) == 1 else None


def valid_classes(pages: list[Page], min_support: float, min_size: int) -> tuple[set[int], list[Class]]:
    """The tokens that the template prints, and the nested valid classes."""
    n = len(pages)
    if n < 2:
        return set(), []
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for i, page in enumerate(pages):
        for t in page.tokens:
            own = counts[t]
            own[i] = own.get(i, 0) + 1
    groups: dict[tuple, list[int]] = defaultdict(list)
    for t, c in counts.items():
        if len(c) >= min_support * n:
            groups[tuple(c.items())].append(t)
    wanted = {t: k for k, tokens in enumerate(groups.values()) if len(tokens) >= min_size for t in tokens}
    orders: dict[int, list | None] = {}
    places: dict[int, dict[int, list[int]]] = defaultdict(dict)
    for i, page in enumerate(pages):
        for at, t in enumerate(page.tokens):
            k = wanted.get(t)
            if k is not None:
                places[k].setdefault(i, []).append(at)
        for k, own in places.items():
            if i in own:
                sequence = [page.tokens[at] for at in own[i]]
                size = len(set(sequence))
                once = sequence[:size]
                # the same order in every repetition and every page, else the class is not valid
                if len(set(once)) < size or sequence != once * (len(sequence) // size) or orders.setdefault(k, once) != once:
                    orders[k] = None
    found = [Class(vector, orders[k], places[k]) for k, vector in enumerate(groups) if orders.get(k)]
    found.sort(key=lambda c: (-c.spread(), c.tokens))
    nested: list[Class] = []
    for c in found:
        gaps = [(outer, outer.gap_of(c)) for outer in nested]
        if any(gap is None for _, gap in gaps):
            continue  # it crosses another class
        for outer, gap in reversed(gaps):
            if gap >= 0:
                c.parent, c.gap = outer, gap
                break
        nested.append(c)
    template = {t for c in nested for t in c.tokens}
    # a word that the template prints several times has a multiple of its class's vector, and stands in the same slots of every page
    once = {c.vector for c in nested}
    again: dict[int, list] = {}
    for vector, tokens in groups.items():
        k = gcd(*(n for _, n in vector))
        if k > 1 and tuple((i, n // k) for i, n in vector) in once:
            again.update((t, []) for t in tokens if not pages[0].names.is_tag(t))
    for i, page in enumerate(pages if again else ()):
        starts, slots = _edges(i, nested)
        for t in again:
            again[t].append([])
        for at, t in enumerate(page.tokens):
            if t in again:
                again[t][-1].append(slots[bisect_right(starts, at) - 1])
    template.update(t for t, own in again.items() if len({tuple(x) for x in own if x}) == 1)
    return template, nested


def _edges(i: int, nested: list[Class]) -> tuple[list[int], list[tuple[int, int]]]:
    """Where the slots of page i begin, and which they are: (number of the innermost class around, gap), or (-1, -1) outside all classes."""
    starts, slots = [0], [(-1, -1)]
    number = {id(c): j for j, c in enumerate(nested)}
    for at, j, r in sorted((at, j, r) for j, c in enumerate(nested) for r, at in enumerate(c.places.get(i, ()))):
        c = nested[j]
        starts.append(at + 1)
        if r == len(c.places[i]) - 1:  # after its last token the text is in the slot around the class
            slots.append((number[id(c.parent)], c.gap) if c.parent else (-1, -1))
        else:
            slots.append((j, r % len(c.tokens)))
    return starts, slots


def slots_of(pages: list[Page], nested: list[Class]) -> list[list[tuple[int, int]]]:
    """Of each page the slot of each text."""
    out = []
    for i, page in enumerate(pages):
        starts, slots = _edges(i, nested)
        out.append([slots[bisect_right(starts, t[3]) - 1] for t in page.texts])
    return out


def judged_slots(names: Names, nested: list[Class]) -> tuple[set[tuple[int, int]], set[tuple[int, int]]]:
    """The template's main slots and its boilerplate slots, by what the elements open there say."""
    main, boilerplate = set(), set()
    for j, c in enumerate(nested):
        for gap, token in enumerate(c.tokens):
            kind, path = names.tokens[token]
            _, _, bad, good, _ = names.paths[names.paths[path][0] if kind == "</" else path]
            if bad:
                boilerplate.add((j, gap))
            elif good:
                main.add((j, gap))
    return main, boilerplate


def _printed(text: tuple, template: set[int], page: Page) -> bool:
    numbers = page.names.token_numbers
    words = text[1].split()
    return bool(words) and all(numbers[w, text[0]] in template for w in words)


def _main_path(page: Page, free: list[tuple]) -> tuple[str, ...]:
    """Where no element says what the main text is: the deepest path prefix, ids left out, with 60 % or more of the page's free text."""
    sizes: dict[int, int] = defaultdict(int)
    for text in free:
        sizes[text[0]] += len(text[1].strip())
    total = sum(sizes.values())
    prefix: tuple[str, ...] = ()
    paths = [(page.names.signs(p), n) for p, n in sizes.items()]
    while True:
        here: dict[str, int] = defaultdict(int)
        for signs, n in paths:
            if len(signs) > len(prefix):
                here[signs[len(prefix)]] += n
        best = max(here, key=lambda s: (here[s], s), default=None)
        if best is None or here[best] < 0.6 * total or re.fullmatch(r"(p|li|h[1-6]|a|b|span)(\..*)?", best):
            return prefix
        prefix = (*prefix, best)
        paths = [(signs, n) for signs, n in paths if signs[len(prefix) - 1 : len(prefix)] == [best]]


def _lines(kept: list[tuple], left_out: set[int] = frozenset()) -> str:
    blocks: dict[int, list[str]] = {}
    for text in kept:
        if text[2] not in left_out:
            blocks.setdefault(text[2], []).append(text[1])
    lines = [" ".join("".join(parts).split()) for parts in blocks.values()]
    return "\n".join(x for x in lines if x)


def _without_main(page: Page, template: set[int]) -> str:
    free = [t for t in page.texts if not page.names.paths[t[0]][2] and not _printed(t, template, page)]
    prefix = _main_path(page, free)
    aside = {t[2] for t in free}  # lines outside the prefix, as long as they are links only
    for t in free:
        if t[1].strip() and (not page.names.paths[t[0]][4] or tuple(page.names.signs(t[0])[: len(prefix)]) == prefix):
            aside.discard(t[2])
    return _lines(free, aside)


def extract(sources: list[str], min_support: float = MIN_SUPPORT, min_size: int = MIN_SIZE) -> list[str]:
    """The main texts of pages of one host."""
    names = Names()
    pages = [Page(s, names) for s in sources]
    template, nested = valid_classes(pages, min_support, min_size)
    main, boilerplate = judged_slots(names, nested)
    mains = []
    for page, slots in zip(pages, slots_of(pages, nested), strict=True):
        clean = [not names.paths[t[0]][2] for t in page.texts]
        own = [c and s in main for c, s in zip(clean, slots, strict=True)]
        if not any(o and t[1].strip() for o, t in zip(own, page.texts, strict=True)):  # of another template, or the only page
            own = [c and names.paths[t[0]][3] and s not in boilerplate for c, s, t in zip(clean, slots, page.texts, strict=True)]
        mains.append(own)
    out = []
    for page, own in zip(pages, mains, strict=True):
        if any(o and t[1].strip() for o, t in zip(own, page.texts, strict=True)):
            out.append(_lines([t for o, t in zip(own, page.texts, strict=True) if o]))
        else:
            out.append(_without_main(page, template))
    return out


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group_pages: int = GROUP_PAGES, min_support: float = MIN_SUPPORT, min_size: int = MIN_SIZE
) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("_host"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """html as zlib bytes: what the shuffle moves is a third of what its own compression leaves."""
        for batch in batches:
            data = [zlib.compress((h or "").encode("utf-8", "surrogatepass"), 3) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(data, pa.binary()), batch.column("_host")], names=["page_id", "url", "html", "_host"])

    squeezed = rows.mapInArrow(squeeze, f"page_id {kind}, url string, html binary, _host string")
    counts = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
    # only hosts with more than 1 / SHARES of all pages are salted: SHARES rows at most
    large = counts.withColumn("_salts", F.ceil(F.col("_n") * SHARES / total)).where("_salts > 1").drop("_n")
    dealt = squeezed.join(F.broadcast(large), "_host", "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.col("_salts"))))
    sorted_rows = dealt.repartition("_host", "_salt").sortWithinPartitions("_host", "_salt", F.xxhash64("page_id", "url"), "page_id").select("page_id", "url", "html", "_host", "_salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A host's rows follow one another; they are taken in groups of group_pages to twice as many less one."""
        no_tables()
        held: list[tuple] = []
        key = types = None

        def made(group: list[tuple]) -> pa.RecordBatch:
            texts = extract([zlib.decompress(x[2]).decode("utf-8", "surrogatepass") for x in group], min_support, min_size)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in group], types), pa.array([x[1] for x in group], pa.string()), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

        for batch in batches:
            types = batch.schema.field("page_id").type
            for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (row[3:] != key or len(held) >= 2 * group_pages):
                    whole = len(held) if row[3:] != key else group_pages
                    yield made(held[:whole])
                    held = held[whole:]
                key = row[3:]
                held.append(row)
        if held:
            yield made(held)

    return sorted_rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
