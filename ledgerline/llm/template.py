"""Main text of HTML pages by equivalence-class template deduction.

A page is a sequence of tokens: tags (told apart by their place in the tree and
their class) and text blocks. Over the different pages of one host every token has
an occurrence vector, how often it stands on each page; copies of a page count
once. Tokens with the same vector form an equivalence class. A class with enough
tokens on enough pages is part of the host's template if it is valid: its tokens
stand in one order on every page, round by round, and its rounds lie between two
tokens of another class or apart from them, so classes nest. Tokens and classes
that break this on any page are taken out, the lighter of two classes that cross.

The nested template's tokens delimit slots. Every text block lies in the slot
behind the last token of the innermost class that is open there. Article elements
and the tags and class names of menus, headers, footers, side bars, notices,
adverts and forms are evidence on slots, summed over the host's pages: a page's
text is in the slots that hold articles (on this page, or mostly articles over the
host), else in those that do not mostly hold dropped elements. Dropped elements,
comments, scripts and styles are left out of the chosen slots too, and where a
page has an article inside a slot, the rest of that slot is.

A class or id drops its element by itself only where it says nothing else
(``comments``, ``cookie-notice``). Where it says more (``related-work``), or
stands on a paragraph that may well be called so (``alert``), the element goes
only if its tag is part of the host's template. Headings in an article's own
header stay. Long texts are never part of a template, and where most of a host's
text would be, its pages are near copies of each other and keep theirs.

Vectors are compared by order-free sums of hashes, so a host's pages are never
gathered: its classes, their validity and the evidence on its slots come from
partial aggregates, however many pages it has.
"""

from __future__ import annotations

import html
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import on_workers, pick
from ledgerline.llm.url_rules import host_and_path
from ledgerline.plans.materialize import stage

#: A token belongs to a template if its class has so many tokens, on so many pages and so large a share of the host's.
LEAST_TOKENS = 2
LEAST_PAGES = 3
LEAST_SHARE = 0.5
#: Texts of so many code points are content, however many pages have them.
LONG_TEXT = 300
#: Where a larger share of a host's text would be template, the text is content that its pages share.
MOST_TEMPLATE = 2 / 3
#: Templates of all hosts are sent to every task up to this size, joined beyond it.
BROADCAST_BYTES = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold main text.
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe input label map menu nav noscript "
    "picture search select svg template textarea title video".split()
)
#: Words of a class, id or role that mark such an element.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising alert banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies "
    "reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription widget".split()
)
#: Words that say nothing about an element but that it is one.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block bottom box btn button buttons container content desktop fixed form global group "
    "holder icon icons inner item items label left link links list main mobile module outer page panel post posts "
    "primary right row secondary section site slot sticky stories story thread title top unit wrap wrapper".split()
)
_PLAIN_MARKS = DROPPED_WORDS | NEUTRAL_WORDS
#: Of DROPPED_WORDS those that a paragraph of an article may have too, and the elements this is about.
AMBIGUOUS_WORDS = frozenset(
    "alert banner comment comments header menu modal notice notices overlay related replies reply respond search".split()
)
TEXT_LEVEL = frozenset("a b blockquote code em h1 h2 h3 h4 h5 h6 i p pre q small span strong".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(["article", "main"])
#: Elements whose id is an anchor made of their title, no mark.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 section p".split())
#: What an opening tag closes if it is still open, up to the nearest of the limits.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|iframe|svg|textarea|title)\b(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>
        .*?(?:</(?P=raw)\s*>|(?=</head\b)|\Z)
      | <[!?][^>]*>?
      | <(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>
    """,
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Marks(NamedTuple):
    """What an opening tag's class, id and role say."""

    label: str  # class and role, for the token
    dropped: bool  # an element that is no content
    weak: bool  # perhaps one
    header: bool  # dropped, but for its headings
    main: bool  # role is main


def _marks(attributes: str, name: str) -> Marks:
    label, dropped, weak, header, main = "", False, False, False, False
    for m in _MARKS.finditer(attributes):
        value = m.group(2) or m.group(3) or m.group(4) or ""
        attribute = m.group(1).lower()
        if attribute != "id":
            label += "." + value
        elif name in ANCHORED:
            continue
        for part in value.split():
            words = [w.lower() for w in _WORDS.findall(part)]
            found = {
                w for before, w in zip([""] + words, words)
                if w in DROPPED_WORDS and before not in ("has", "with", "no", "without")
            }
            if not found:
                continue
            if attribute == "id":
                label += "#" + part
            if name in TEXT_LEVEL and found <= AMBIGUOUS_WORDS or not _PLAIN_MARKS.issuperset(words):
                weak = True
            else:
                dropped = True
                header |= found == {"header"}
        main |= attribute == "role" and value.strip().lower() == "main"
    return Marks(label, dropped, weak and not dropped, header, main)


class Block(NamedTuple):
    """A text block: its words joined by single spaces, its place, its fate by tags alone."""

    text: str
    path: str
    dropped: bool
    article: bool
    at: int  # the tag tokens before it
    weak: tuple[str, ...] = ()  # tags of the elements around it that are perhaps no content


class Open(NamedTuple):
    """An open element."""

    name: str
    path: str
    dropped: bool
    article: bool
    weak: tuple[str, ...] = ()
    header: bool = False  # in an article's own header, whose headings are content


def parse(page: str) -> tuple[list[str], list[Block]]:
    """Tag tokens and text blocks of a page, each in page order.

    White space inside a block is one space, character references are decoded,
    and inline tags separate nothing. Elements left open end with their parent.
    """
    tokens: list[str] = []
    blocks: list[Block] = []
    stack = [Open("", "", False, False)]
    words: list[str] = []
    begin = -1  # the tag tokens before the open block's first word

    def close_block() -> None:
        nonlocal begin
        place, begin = begin, -1
        text = "".join(words)
        words.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            top = stack[-1]
            blocks.append(Block(text, top.path, top.dropped, top.article, len(tokens) if place < 0 else place, top.weak))

    def pop_to(i: int) -> None:
        del stack[i:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            word = page[at : m.start()]
            words.append(word)
            if begin < 0 and not word.isspace():
                begin = len(tokens)
        at = m.end()
        if m.group("raw"):
            continue
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("end"):
            if name in BLOCK:
                close_block()
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if found:
                if any(e.dropped != stack[found - 1].dropped for e in stack[found:]):
                    close_block()
                pop_to(found)
            tokens.append(f"{stack[-1].path}</{name}>")
            continue
        if name in BLOCK:
            close_block()
            while stack[-1].name == "p":
                pop_to(len(stack) - 1)
            if name in CLOSES:
                closed, limits = CLOSES[name]
                closed = closed.split()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in limits:
                        break
                    if stack[i].name in closed:
                        pop_to(i)
        elif name == "br":
            words.append(" ")
        marks = _marks(m.group("attributes"), name)
        top = stack[-1]
        token = f"{top.path}<{name}{marks.label}>"
        tokens.append(token)
        if name in VOID or m.group("attributes").endswith("/"):
            continue
        header = top.header
        if name in ("html", "body") or (name in ARTICLE and not marks.dropped):
            dropped = top.dropped
        elif name in HEADINGS and header and not marks.dropped:
            dropped = False
        else:
            dropped = top.dropped or marks.dropped or name in DROPPED
            if name == "header" or marks.header:
                header = top.article and (header or not top.dropped)
            elif name in DROPPED or marks.dropped:
                header = False
        article = top.article or ((name in ARTICLE or marks.main) and not dropped)
        if name in BLOCK or dropped != top.dropped:
            if dropped != top.dropped:
                close_block()
            weak = (*top.weak, token) if marks.weak and name not in ("html", "body") else top.weak
            path = top.path if name in ("p", "li", "td", "th", "tr", "dt", "dd") else f"{top.path}/{name}{marks.label}"
            stack.append(Open(name, path, dropped, article, weak, header))
    rest = page[at:]
    if re.search(r"<[a-zA-Z/!?][^>]*\Z", rest):  # a tag that the page's end cut off
        rest = re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", rest)
    words.append(rest)
    close_block()
    return tokens, blocks


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


_tag_hash = lru_cache(1 << 16)(_hash)


def _text_token(b: Block) -> str:
    return f"{b.path}#{b.text}"


PAGE = "page"  # the token that stands once on every page
NO_TOKEN = 0  # stands for text that is never part of a template: long, or inside the article
_IN_HEADING = re.compile(r"/h[1-6](?:\.[^/]*)?\Z")


def page_items(page: str) -> tuple[list[int], list[int], list[Block]]:
    """Hashed tags and texts in page order, the text blocks' places among them, and the blocks."""
    tags, blocks = parse(page)
    items: list[int] = []
    places: list[int] = []
    done = 0
    for b in blocks:
        items.extend(map(_tag_hash, tags[done : b.at]))
        done = b.at
        places.append(len(items))
        items.append(NO_TOKEN if b.article or len(b.text) >= LONG_TEXT else _hash(_text_token(b)))
    items.extend(map(_tag_hash, tags[done:]))
    return items, places, blocks


#: Bits of a text block's kind.
IS_DROPPED, IS_ARTICLE, IS_HEADING, IS_WEAK = 1, 2, 4, 8


def _kind(b: Block) -> int:
    return (
        b.dropped * IS_DROPPED | b.article * IS_ARTICLE | bool(_IN_HEADING.search(b.path)) * IS_HEADING | bool(b.weak) * IS_WEAK
    )


def distinct_pages(pages: DataFrame) -> DataFrame:
    """(host, key, items, place, kind, size): the different pages of a host, from (host, page_id, html).

    Pages with the same tags and texts are one: copies would lend each other's
    content the vectors of a template. ``place``, ``kind`` and ``size`` (code
    points) describe the text blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, items, place, kind, size = [], [], [], [], []
            for page in batch.column(1).to_pylist():
                ids, places, blocks = page_items(page or "")
                key = xxhash.xxh128(array("q", ids).tobytes())
                for b in blocks:
                    key.update(f"\0{b.text}")
                keys.append(key.hexdigest())
                items.append(ids)
                place.append(places)
                kind.append(list(map(_kind, blocks)))
                size.append([len(b.text) for b in blocks])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(keys, pa.string()), pa.array(items, pa.list_(pa.int64())),
                    *(pa.array(c, pa.list_(pa.int32())) for c in (place, kind, size)),
                ],
                names=["host", "key", "items", "place", "kind", "size"],
            )

    columns = ["items", "place", "kind", "size"]
    read = pages.select("host", "html").mapInArrow(
        run, "host string, key string, items array<long>, place array<int>, kind array<int>, size array<int>"
    )
    return read.groupBy("host", "key").agg(*[F.first(c).alias(c) for c in columns])


def occurrences(distinct: DataFrame) -> DataFrame:
    """(host, token, at, lo, hi, heading) per distinct page and distinct token.

    ``lo`` and ``hi`` hash the page and the token's count on it; their sums over
    pages stand for the occurrence vector. ``at`` is the token's first place on
    the page; ``heading`` tells text that stands in a heading.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, token, at, lo, hi, heading = [], [], [], [], [], []
            for h, key, items, place, kind in zip(*(c.to_pylist() for c in batch.columns)):
                counts = Counter(items)
                counts.pop(NO_TOKEN, None)
                counts[_hash(PAGE)] = 1
                first = dict(zip(reversed(items), range(len(items) - 1, -1, -1)))
                titles = {items[p] for p, k in zip(place, kind) if k & IS_HEADING}
                for t, n in counts.items():
                    v = xxhash.xxh64_intdigest(f"{key}/{n}")
                    host.append(h)
                    token.append(t)
                    at.append(first.get(t, 0))
                    lo.append(v & 0xFFFFFFFF)
                    hi.append(v >> 32)
                    heading.append(t in titles)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(host, pa.string()), *(pa.array(c, pa.int64()) for c in (token, at, lo, hi)),
                    pa.array(heading, pa.bool_()),
                ],
                names=["host", "token", "at", "lo", "hi", "heading"],
            )

    read = distinct.select("host", "key", "items", "place", "kind")
    return read.mapInArrow(run, "host string, token long, at long, lo long, hi long, heading boolean")


OUTSIDE = (-1,)
IN_TEMPLATE = -2  # names, among the slots, the texts of the template itself


class Template:
    """A host's template: tokens class by class, in order; heavier classes first."""

    def __init__(self, tokens: list[int], classes: list[int], main: list[int] = (), dropped: list[int] = ()):
        self.tokens, self.classes = tokens, classes
        self.main, self.dropped = frozenset(main or ()), frozenset(dropped or ())
        self.keeps_text = IN_TEMPLATE in self.main  # the host's pages are near copies of each other
        self.index = {t: i for i, t in enumerate(tokens)}
        self.members: dict[int, list[int]] = {}
        for i, c in enumerate(classes):
            self.members.setdefault(c, []).append(i)
        self.last = {c: m[-1] for c, m in self.members.items()}

    def invalid(self, items: list[int]) -> set[int]:
        """Indices of tokens that break the order of their class on this page, or whose class crosses a heavier one.

        What is left is ordered and nests, also after more tokens are taken out.
        """
        places: dict[int, list[int]] = {}
        found = [(k, i) for k, i in enumerate(map(self.index.get, items)) if i is not None]
        for k, i in found:
            places.setdefault(i, []).append(k)
        bad: set[int] = set()
        last: dict[int, int] = {}
        for c in {self.classes[i] for i in places}:
            first = before = None
            for i in self.members[c]:
                here = places.get(i, [])
                if before is None:
                    first = before = here
                elif (
                    len(here) == len(before)
                    and all(x < y for x, y in zip(before, here))
                    and all(x < y for x, y in zip(here, first[1:]))
                ):
                    before = here
                else:
                    bad.add(i)
                    continue
                last[c] = i
        crossed: set[int] = set()
        opened: list[int] = []
        for _, i in found:
            c = self.classes[i]
            if i in bad or c in crossed:
                continue
            depth = next((d for d in range(len(opened) - 1, -1, -1) if self.classes[opened[d]] == c), None)
            if depth is None:
                opened.append(i)
                depth = len(opened) - 1
            else:
                above = [self.classes[j] for j in opened[depth + 1 :]]
                if above and min(above) < c:
                    crossed.add(c)
                    del opened[depth]
                    continue
                crossed.update(above)
                del opened[depth + 1 :]
                opened[depth] = i
            if i == last[c]:
                del opened[depth]
        for c in crossed:
            bad.update(self.members[c])
        return bad

    def slots(self, items: list[int]) -> list[tuple[int, ...] | None]:
        """For every item the nested slots it lies in, outermost first; None for a token of the template, if that is
        not to be kept.

        A slot is named by the token before it; what is outside all classes lies in the slot -1.
        """
        out: list[tuple[int, ...] | None] = []
        opened: list[int] = []
        here = OUTSIDE
        for i in map(self.index.get, items):
            if i is None:
                out.append(here)
                continue
            out.append(here if self.keeps_text else None)
            if opened and self.classes[opened[-1]] == self.classes[i]:
                opened[-1] = i
            else:
                opened.append(i)
            if i == self.last[self.classes[i]]:
                opened.pop()
            here = tuple(opened) or OUTSIDE
        return out


def _per_host(df: DataFrame, by_host: DataFrame, how: str) -> DataFrame:
    """``df`` with its host's row of the staged ``by_host``."""
    arrays = [n for n, kind in by_host.dtypes if kind.startswith("array")]
    size = by_host.agg(F.sum(sum(F.size(c) * 8 for c in arrays) + F.length("host") + 32)).first()[0] or 0
    return df.join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "host", how)


def _classes(distinct: DataFrame) -> DataFrame:
    """(host, template, class): tokens of large and frequent classes, class by class, in order of their mean place."""
    tokens = occurrences(distinct).groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("at").alias("at"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"),
        F.max("heading").alias("heading"),
    )
    tokens = tokens.where(F.col("n") >= LEAST_PAGES)
    classes = tokens.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("host", "n", "lo", "hi")))
    sizes = classes.where(F.col("token") == _hash(PAGE)).select("host", F.col("n").alias("pages"))
    large = classes.where(F.col("size") >= LEAST_TOKENS).join(sizes, "host")
    chosen = large.where((F.col("n") >= F.lit(LEAST_SHARE) * F.col("pages")) & (F.col("token") != _hash(PAGE)))
    # a heading that some pages have and others lack belongs to their content
    chosen = chosen.where(~F.col("heading") | (F.col("n") == F.col("pages")))
    key = F.struct((-F.col("n")).alias("n"), (-F.col("size")).alias("size"), "lo", "hi")
    token = F.struct(key.alias("key"), (F.col("at") / F.col("n")).alias("at"), "token")
    ordered = chosen.groupBy("host").agg(F.sort_array(F.collect_list(token)).alias("p"))
    return ordered.select(
        "host",
        F.col("p.token").alias("template"),
        # numbers of the classes: distinct keys in order
        F.transform("p.key", lambda k: F.array_position(F.array_distinct("p.key"), k).cast("int")).alias("class"),
    )


def _valid(classes: DataFrame, distinct: DataFrame) -> DataFrame:
    """``classes`` without the tokens that are out of order, or of crossing classes, on any page."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, Template] = {}
            broken: set[tuple[str, int]] = set()
            for row, h in enumerate(batch.column(0).to_pylist()):
                if h not in made:
                    made[h] = Template(batch.column(2)[row].as_py(), batch.column(3)[row].as_py())
                t = made[h]
                broken.update((h, t.tokens[i]) for i in t.invalid(batch.column(1)[row].as_py()))
            host, token = zip(*sorted(broken)) if broken else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(host, pa.string()), pa.array(token, pa.int64())], names=["host", "token"]
            )

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            template, kinds = [], []
            for tokens, classes, broken in zip(*(c.to_pylist() for c in batch.columns[1:])):
                gone = set(broken or ())
                left = Counter(c for t, c in zip(tokens, classes) if t not in gone)
                kept = [(t, c) for t, c in zip(tokens, classes) if t not in gone and left[c] >= LEAST_TOKENS]
                template.append([t for t, _ in kept])
                kinds.append([c for _, c in kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(template, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int32()))],
                names=["host", "template", "class"],
            )

    read = _per_host(distinct.select("host", "items"), classes, "inner").select("host", "items", "template", "class")
    broken = read.mapInArrow(find, "host string, token long").distinct()
    broken = broken.groupBy("host").agg(F.collect_list("token").alias("broken"))
    both = classes.join(broken, "host", "left").select("host", "template", "class", "broken")
    return both.mapInArrow(clean, "host string, template array<long>, class array<int>")


def _evidence(valid: DataFrame, distinct: DataFrame) -> DataFrame:
    """(host, main, dropped): slots whose text, with that of the slots inside, is mostly in articles, and slots whose
    own text is mostly in dropped elements. IN_TEMPLATE is main where most of the text outside both is template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, Template] = {}
            sums: dict[tuple[str, int], list[int]] = {}
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for row, (h, items, place, kind, size) in enumerate(zip(*columns)):
                if h not in made:
                    made[h] = Template(batch.column(5)[row].as_py(), batch.column(6)[row].as_py())
                slots = made[h].slots(items)
                for p, k, n in zip(place, kind, size):
                    for s in slots[p] or ():
                        v = sums.setdefault((h, s), [0, 0, 0, 0])
                        v[0 if k & IS_ARTICLE and not k & IS_DROPPED else 1] += n
                    if slots[p]:
                        v[2 if k & (IS_DROPPED | IS_WEAK) else 3] += n
                    if not k & (IS_DROPPED | IS_ARTICLE):
                        sums.setdefault((h, IN_TEMPLATE), [0, 0, 0, 0])[1 if slots[p] else 0] += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in sums], pa.string()), pa.array([s for _, s in sums], pa.int32()),
                    *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4)),
                ],
                names=["host", "slot", *counts],
            )

    counts = ["article", "rest", "dropped", "kept"]
    columns = ["host", "items", "place", "kind", "size", "template", "class"]
    read = _per_host(distinct.select(*columns[:5]), valid, "inner").select(*columns)
    sums = read.mapInArrow(run, "host string, slot int, " + ", ".join(f"{c} long" for c in counts))
    sums = sums.groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in counts])
    # of IN_TEMPLATE, ``article`` counts the template's text and ``rest`` the other text
    most = F.col("article") > F.lit(MOST_TEMPLATE) * (F.col("article") + F.col("rest"))
    main = F.when(F.col("slot") == IN_TEMPLATE, most).otherwise(F.col("article") > F.col("rest"))
    dropped = F.col("dropped") > F.col("kept")
    return sums.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(main, F.col("slot")))).alias("main"),
        F.sort_array(F.collect_list(F.when(dropped, F.col("slot")))).alias("dropped"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, class, main, dropped): per host its template's tokens (hashes) with the numbers of their
    classes, and its main and dropped slots, from (host, page_id, html).

    ``template`` holds tokens on half of the host's different pages at least, so
    its size is bounded by the size of a page.
    """
    distinct = stage(distinct_pages(pages), "template-pages")
    classes = stage(_classes(distinct), "template-classes")
    valid = stage(_valid(classes, distinct), "template-valid")
    return valid.join(_evidence(valid, distinct), "host", "left")


def main_text(page: str | None, template: Template | None) -> str:
    """The page's main text: the blocks of its main slots."""
    items, places, blocks = page_items(page or "")
    slots = template.slots(items) if template else [OUTSIDE] * len(items)
    known = template.index if template else {}
    kept = [
        (slots[p], b) for p, b in zip(places, blocks)
        if not b.dropped and slots[p] is not None and not any(_tag_hash(t) in known for t in b.weak)
    ]
    article = {s for within, b in kept if b.article for s in within}
    held = {within[-1] for within, _ in kept}
    chosen = held & (article | (template.main if template else frozenset()))
    if not chosen:
        chosen = (held - template.dropped if template else held) or held
    return "\n\n".join(b.text for within, b in kept if within[-1] in chosen and (b.article or within[-1] not in article))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages``.

    Defined cases: a null or empty page, or one without main text, gives an
    empty text; rows without a host share one group; pages with the same tags and
    texts count once for the template; a host with fewer than three different
    pages has no template, its pages are one slot each, read by their tags;
    repeated rows are all returned; an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    on_workers(spark)
    pages = pick(pages, "page_id", "url", "html")
    pages = pages.withColumn("host", host_and_path(F.col("url"))[0])
    by_host = stage(templates(pages.select("host", "page_id", "html")), "templates")
    columns = ["page_id", "url", "html", "host", "template", "class", "main", "dropped"]
    joined = _per_host(pages, by_host, "left").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, Template | None] = {}
            text = []
            for row, (page, h) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if h not in made:
                    parts = [batch.column(i)[row].as_py() for i in range(4, 8)]
                    made[h] = Template(*parts) if parts[0] else None
                text.append(main_text(page, made[h]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
