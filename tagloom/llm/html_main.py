"""Main text of web pages: templates are deduced from token equivalence classes of same-host pages."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import settle

SUPPORT = 0.5  # of the pages of a host, or of one kind of its pages, that hold a template's token, at least
LEAST_PAGES = 3  # that hold a text before it is taken for a fixed one inside of content elements
ROOT = 7  # the path above a page's elements; as a token it counts pages
BROADCAST_TOKENS = 200_000

# Elements and words of the web's vocabulary
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "option", "body", "head", "html", "title"}
NOT_CONTENT = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe menu nav noscript object option script select style svg template textarea title video".split()
)
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer"
    " disqus footer gdpr login menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted"
    " recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Beside an aside word these say no more than that it is a part of a page; any other word makes it a weak hint
PART_WORDS = frozenset(
    "area article bar block body bottom box btn button buttons card center column container content desktop element entry fixed floating form global"
    " group head heading holder home icon icons inline inner item items label layer left link links list main media mobile module outer overlay page"
    " panel post posts primary right row secondary section site slot sticky story tab text title toggle top unit wrap wrapper zone".split()
)
OTHERS_WORDS = frozenset("ad ads advert adverts advertisement adsbygoogle comment comments promo promoted recommended related replies reply sponsored".split())  # on articles too
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WEAK = 3
HOLDS = 0.5  # of a page's text, at least, in a form that holds the page; of a larger element's, in one that stands for it
HEADER_WORDS = frozenset("header masthead".split())
LAYOUT_WORDS = frozenset("has layout no with without".split())  # beside such a word the others name what surrounds an element
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN_WORDS = frozenset("articlebody".split())
MAIN_CLASSES = re.compile(r"(?:^|\s)(?:article|article[-_]?(?:body|content|text)|(?:post|entry|story|page|main)[-_]?(?:body|content|text)|post|entry|content|main)(?=\s|$)", re.I)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_KEYS = frozenset("class id role itemprop hidden aria-hidden".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_MASK = (1 << 63) - 1


@dataclass(slots=True)
class Element:
    name: str
    path: int
    aside: int  # 1 beside the content, 2 a header, which an article may have for its own heading, 3 a weak hint, 0 neither
    main: int  # 3 article, 2 main or article body, 1 a class that says content, 0 none
    link: bool
    named: bool = False  # beside the content by nothing but the words of a class or an id, and these not of others' texts


@dataclass(slots=True)
class Item:
    """A token of a page: an opening tag, a closing tag or a run of text."""

    kind: str
    token: int
    name: str = ""
    text: str = ""
    element: Element | None = None
    depth: int = 0
    close: int = -1  # of an opening tag: where its element ends


def _describe(name: str, attrs: str) -> tuple[str, int, int, bool]:
    """Label for paths, whether it is beside the content, how much it says that it holds the content, and ``Element.named``."""
    by_name = False
    label, aside, main = name, int(name in NOT_CONTENT) or 2 * (name == "header"), 3 if name == "article" else 2 if name == "main" else 0
    if attrs:
        named = []
        for m in _ATTR.finditer(attrs):
            key = m[1].lower()
            if key not in _KEYS:
                continue
            value = m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                label += ("." if key == "class" else "#") + _DIGITS.sub("0", value)
                named.append(value)
                if name not in ("html", "body") and MAIN_CLASSES.search(value):
                    main = main or 1
            elif key == "role":
                aside = 1 if value.lower() in ASIDE_ROLES else aside
                main = max(main, 2 if value.lower() == "main" else 3 if value.lower() == "article" else 0)
            elif key == "itemprop":
                main = max(main, 3 if value.lower() in MAIN_WORDS else 0)
            elif key == "hidden" or value.lower() == "true":
                aside = 1
        if named and aside != 1 and name not in ("html", "body") and name not in HEADINGS:
            found = [_hint(value, main) for value in named]
            aside = 1 if 1 in found else 2 if aside or 2 in found else max(found)
            by_name = aside == 1 and not any({w.lower() for w in _WORD.findall(v)} & OTHERS_WORDS for v in named)
    return label, aside, main, by_name


def _hint(value: str, main: int) -> int:
    """What a class or an id says: an aside by all words of one of its names, a weak hint by some of them.

    Names of an element that says that it is the content count only if they are one aside word, those of articles and
    main elements only if that word stands for other people's or other pages' texts.
    """
    if main:
        return int(any(n.lower() in (OTHERS_WORDS if main > 1 else ASIDE_WORDS) for n in value.split()))
    names = [{w.lower() for w in _WORD.findall(n)} for n in value.split()]
    words = set().union(*names)
    if words & LAYOUT_WORDS:
        return 0
    hits = [n for n in names if n & ASIDE_WORDS]
    if any(all(w in ASIDE_WORDS or w in PART_WORDS or w in HEADER_WORDS or len(w) < 3 for w in n) for n in hits):
        return 1
    return 2 if words & HEADER_WORDS else WEAK if hits else 0


def tokenize(page: str) -> list[Item]:
    """The page's tags and text in order, each with a token that its path and its own label or text decide.

    Raw text elements are passed over whole. A closing tag closes what is open inside its element; one without an
    element is ignored; what is open at the end is closed there.
    """
    out: list[Item] = []
    root = Element("", ROOT, 0, 0, False)
    stack: list[tuple[Element, int]] = [(root, -1)]
    open_names: Counter = Counter()
    pos, end = 0, len(page)

    def text(stop: int) -> None:
        if stop > pos:
            raw = page[pos:stop]
            value = entities.unescape(raw) if "&" in raw else raw
            at = stack[-1][0]
            norm = " ".join(value.split())
            out.append(Item("t", xxhash.xxh64_intdigest(norm, at.path ^ 1) & _MASK if norm else 0, text=value, element=at, depth=len(stack)))

    def shut(k: int) -> None:
        while len(stack) > k:
            e, opened = stack.pop()
            open_names[e.name] -= 1
            out[opened].close = len(out)
            out.append(Item("c", xxhash.xxh64_intdigest(b"/", e.path) & _MASK, e.name, element=stack[-1][0], depth=len(stack)))

    search = _TAG.search
    while (m := search(page, pos)) is not None:
        text(m.start())
        pos = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if open_names[name] > 0 else ():
                if stack[k][0].name == name:
                    shut(k)
                    break
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                own = stack[k][0].name
                if own == "p" or (name == "li" and own == "li"):
                    shut(k)
                    break
                if own in CLOSES_P:
                    break
        attrs = m[3] if m[2] else m[6]
        label, aside, main, named = _describe(name, attrs)
        up = stack[-1][0]
        e = Element(name, xxhash.xxh64_intdigest(label, up.path), aside, main, up.link or name == "a", named)
        out.append(Item("o", e.path & _MASK, name, element=e, depth=len(stack)))
        if name in VOID or (attrs and attrs.endswith("/") and name not in BLOCKS and name not in RAW):
            out[-1].close = len(out)
            continue
        stack.append((e, len(out) - 1))
        open_names[name] += 1
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, pos)
            pos = stop.start() if stop else end
    text(end)
    shut(1)
    free_forms(out)
    free_parts(out)
    return out


@dataclass
class Template:
    """Tokens of a host's template: their class, their place in the order of the host's pages, and how many hold them."""

    classes: dict[int, tuple[int, float, int]] = field(default_factory=dict)


def template_positions(items: list[Item], template: Template | None) -> set[int]:
    """Places of a page's tokens that stand in valid classes of the template.

    A class is valid on a page if its tokens that occur once there keep the template's order and if it nests: seen from
    another class, all of it lies in one gap. Of two that cross, the smaller one goes, or else the one that begins later.
    """
    if template is None or not template.classes:
        return set()
    seen = Counter(x.token for x in items if x.token)
    by_class: dict[int, list[tuple[float, int]]] = {}
    for at, x in enumerate(items):
        own = template.classes.get(x.token)
        if own and seen[x.token] == 1:
            by_class.setdefault(own[0], []).append((own[1], at))
    ordered = {}
    for key, members in by_class.items():
        places = [at for _, at in sorted(members)]
        if all(a < b for a, b in zip(places, places[1:])):
            ordered[key] = places
    return {at for key in _nested(ordered) for at in ordered[key]}


def _nested(classes: dict[int, list[int]]) -> set[int]:
    """Classes that nest, by one sweep over the page with a stack of those that are open.

    A class that is met again below others on the stack crosses these. Sizes on the stack are kept in a tree of maxima, so a
    step costs the logarithm of the number of classes.
    """
    steps = sorted((at, key) for key, places in classes.items() for at in places)
    last = {key: places[-1] for key, places in classes.items()}
    width = 1 << max(0, len(classes) - 1).bit_length()
    tree = [0] * (2 * width)

    def put(k: int, size: int) -> None:
        k += width
        tree[k] = size
        while k > 1:
            k >>= 1
            tree[k] = max(tree[2 * k], tree[2 * k + 1])

    def most(k: int) -> int:
        """The largest size at stack place ``k`` or above."""
        out, a, z = 0, k + width, 2 * width
        while a < z:
            if a & 1:
                out, a = max(out, tree[a]), a + 1
            if z & 1:
                z -= 1
                out = max(out, tree[z])
            a, z = a >> 1, z >> 1
        return out

    stack: list[int] = []
    place: dict[int, int] = {}
    gone: set[int] = set()
    for at, key in steps:
        if key in gone:
            continue
        if key not in place:
            while stack and stack[-1] in gone:
                put(len(stack) - 1, 0)
                stack.pop()
            place[key] = len(stack)
            stack.append(key)
            put(place[key], len(classes[key]))
        elif place[key] + 1 < len(stack):
            if most(place[key] + 1) > len(classes[key]):
                gone.add(key)
                put(place[key], 0)
                continue
            while len(stack) > place[key] + 1:
                gone.add(stack[-1])
                put(len(stack) - 1, 0)
                stack.pop()
        if at == last[key]:
            put(len(stack) - 1, 0)
            stack.pop()
    return set(classes) - gone


def _blocks(items: list[Item], start: int, stop: int, take: set[int] | None) -> list[str]:
    """Text of the blocks between two places, of the texts in ``take`` (None: all), without elements beside the content."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(held).split())
        if joined:
            out.append(joined)
        held.clear()

    at = start
    while at < stop:
        x = items[at]
        if x.kind == "t":
            if take is None or at in take:
                held.append(x.text)
        elif x.kind == "o":
            aside = x.element.aside
            if aside == 1 or (aside == 2 and (start == 0 or not _has_heading(items, at))) or (aside == WEAK and _of_links(items, at)):
                if x.name in BLOCKS:
                    flush()
                at = max(at + 1, x.close)
                continue
            if x.name in BLOCKS:
                flush()
        elif x.name in BLOCKS:
            flush()
        at += 1
    flush()
    return out


def _has_heading(items: list[Item], at: int) -> bool:
    return any(x.kind == "o" and x.name in ("h1", "h2", "h3") for x in items[at + 1 : max(at + 1, items[at].close)])


def _of_links(items: list[Item], at: int) -> bool:
    """Whether most of an element's characters are links."""
    own = [(len(x.text.strip()), x.element.link) for x in items[at + 1 : max(at + 1, items[at].close)] if x.kind == "t"]
    return sum(n for n, link in own if link) > 0.5 * sum(n for n, _ in own)


def free_forms(items: list[Item]) -> None:
    """A form that holds most of a page's text is no aside."""
    forms = [(at, x) for at, x in enumerate(items) if x.kind == "o" and x.name == "form" and x.element.aside]
    if forms:
        sums = list(accumulate((len(x.text.strip()) if x.kind == "t" else 0 for x in items), initial=0))
        for at, x in forms:
            if sums[max(x.close, at)] - sums[at] > HOLDS * sums[-1]:
                x.element.aside = 0


def free_parts(items: list[Item]) -> None:
    """Inside an article or main element, what holds its first heading or most of its text is no aside, whatever its class is called."""
    sums: list[int] = []
    upto = -1
    for at, x in enumerate(items):
        if x.kind != "o" or at < upto or x.element.main < 2 or x.element.aside == 1:
            continue
        upto = x.close
        parts = [k for k in range(at + 1, x.close) if items[k].kind == "o" and items[k].element.named]
        if not parts:
            continue
        sums = sums or list(accumulate((len(y.text.strip()) if y.kind == "t" else 0 for y in items), initial=0))
        heading = next((k for k in range(at + 1, x.close) if items[k].kind == "o" and items[k].name == "h1"), -1)
        for k in parts:
            if k < heading < items[k].close or sums[max(items[k].close, k)] - sums[k] > HOLDS * (sums[x.close] - sums[at]):
                items[k].element.aside = 0


def page_kind(items: list[Item]) -> int:
    """What a page is among its host's: the path of the element that says most that it is the content, or of the body."""
    rank, kind = 0, ROOT
    for x in items:
        if x.kind == "o":
            e = x.element
            if e.main > rank and e.aside in (0, WEAK):
                rank, kind = e.main, e.path & _MASK
            elif not rank and x.name in ("html", "body"):
                kind = e.path & _MASK
    return kind


def fixed_blocks(items: list[Item], template: Template | None, fixed: set[int]) -> set[int]:
    """Texts of the blocks that have nothing but the template's texts; a block with a word of its own stays whole."""
    out: set[int] = set()
    if template is None or not template.classes:
        return out
    seen = Counter(x.token for x in items if x.kind == "t" and x.token)
    run: list[int] = []

    def judge() -> None:
        for at in run:
            own = template.classes.get(items[at].token)
            if own is None or own[2] < LEAST_PAGES or (at not in fixed and seen[items[at].token] == 1):
                break
        else:
            out.update(run)
        run.clear()

    for at, x in enumerate(items):
        if x.kind == "t":
            if x.token:
                run.append(at)
        elif x.name in BLOCKS:
            judge()
    judge()
    return out


def main_text(page: str | None, template: Template | None = None) -> str:
    """The article's text: blocks in page order, white space inside each as one space, joined by one space.

    The template's texts are taken out of the page; what remains between its tokens are its slots, and their blocks are the
    result. Which slots hold the article is said by elements: those beside the content (menus, footers, adverts, ...) never
    do; among the others an article, or else a main element, or one whose class says that it is the content, decides.
    Where no element says so, all other slots are taken but blocks of links. Without a template (hosts with too few or too
    unlike pages) the page is one slot. Where nothing varies, pages are copies of each other and the page is one slot too.
    """
    return items_text(tokenize(page), template) if page else ""


def slots(items: list[Item], fixed: set[int], own: set[int]) -> list[tuple[int, int]]:
    """The template's slots on a page, as places from and to: what has text between its tags ``fixed`` and its blocks ``own``.

    A fixed text inside a block that varies is part of the slot.
    """
    out, start, text = [], 0, False
    for at, x in enumerate(items):
        if at in own or (at in fixed and x.kind != "t"):
            if text:
                out.append((start, at))
            start, text = at + 1, False
        elif x.kind == "t" and x.token:
            text = True
    return [*out, (start, len(items))] if text else out


def items_text(items: list[Item], template: Template | None) -> str:
    fixed = template_positions(items, template)
    own = fixed_blocks(items, template, fixed)
    held = slots(items, fixed, own)
    spans = _choose(items, fixed, own)
    for inside in (held, [(0, len(items))]):
        out = {at for a, z in inside for at in range(a, z) if items[at].kind == "t"}
        text = " ".join(b for a, z in spans for b in _blocks(items, a, z, out))
        if text:
            return text
    links = _link_blocks(items)
    for inside in (held, [(0, len(items))]):
        out = {at for a, z in inside for at in range(a, z) if items[at].kind == "t" and at not in links}
        text = " ".join(_blocks(items, 0, len(items), out))
        if text:
            return text
    return ""


def _choose(items: list[Item], fixed: set[int], own: set[int]) -> list[tuple[int, int]]:
    """The spans of the elements that say that they hold the content: they decide among slots.

    Articles go before main elements, these before content classes, unless one element of a later rank, around or beside
    all that was chosen, has so much more that this is less than ``HOLDS`` of it. An element of a later rank that has
    more than all that was chosen and stands apart from it comes besides. Elements are measured by their characters
    without fixed blocks and blocks of links.
    """
    beside = _beside(items)
    chosen: list[tuple[int, int]] = []
    lengths: dict[tuple[int, int], int] = {}
    counted: set[int] = set()

    def length(span: tuple[int, int]) -> int:
        if not lengths:
            counted.update({at for at, x in enumerate(items) if x.kind == "t"} - own - _link_blocks(items))
        if span not in lengths:
            lengths[span] = sum(map(len, _blocks(items, *span, counted)))
        return lengths[span]

    for rank in (3, 2, 1):
        spans, upto = [], -1
        for at, x in enumerate(items):
            if x.kind == "o" and x.element.main == rank and at >= upto and at not in beside and x.element.aside in (0, WEAK) and x.close > at + 1:
                spans.append((at + 1, x.close))
                upto = x.close
        spans = _headed(items, spans) if rank == 3 else spans
        framed = [s for s in spans if s[0] - 1 in fixed]
        if framed and len(framed) < len(spans):  # tags of the template itself outrank those that only this page has, unless one holds more
            most = sum(map(length, framed))
            spans = [s for s in spans if s in framed or length(s) > most]
        if not chosen:
            chosen = [s for s in spans if _blocks(items, *s, None)]
        elif spans:
            size = sum(map(length, chosen))
            larger = [s for s in spans if HOLDS * length(s) > size]
            apart = [s for s in spans if length(s) > size and all(s[1] <= a or z <= s[0] for a, z in chosen)]
            chosen = larger or sorted(chosen + apart)
    return chosen


def _headed(items: list[Item], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Articles without those of another element that has none with a heading, where another's have: readers' texts beside the article."""
    homes: dict[int, list[tuple[int, int]]] = {}
    open_at: list[int] = []
    starts = {a - 1: (a, z) for a, z in spans}
    for at, x in enumerate(items):
        while open_at and items[open_at[-1]].close <= at:
            open_at.pop()
        if at in starts:
            homes.setdefault(open_at[-1] if open_at else -1, []).append(starts[at])
        if x.kind == "o" and x.close > at:
            open_at.append(at)
    headed = [own for own in homes.values() if any(items[k].kind == "o" and items[k].name == "h1" for a, z in own for k in range(a, z))]
    return sorted(s for own in headed for s in own) if headed else spans


def _beside(items: list[Item]) -> set[int]:
    """Opening tags inside elements beside the content; a form around a whole page doesn't make it so."""
    out: set[int] = set()
    upto = -1
    for at, x in enumerate(items):
        if x.kind == "o":
            if at < upto:
                out.add(at)
            elif x.element.aside in (1, 2) and x.name != "form":
                upto = x.close
    return out


def _link_blocks(items: list[Item]) -> set[int]:
    """Texts of lists and blocks whose characters are mostly links."""
    out: set[int] = set()
    run: list[int] = []

    def judge() -> None:
        n = sum(len(items[k].text.strip()) for k in run)
        if n and sum(len(items[k].text.strip()) for k in run if items[k].element.link) > 0.5 * n:
            out.update(run)
        run.clear()

    for at, x in enumerate(items):
        if x.kind == "t":
            run.append(at)
        elif x.name in BLOCKS:
            judge()
    judge()
    return out


def page_tokens(pages: DataFrame) -> DataFrame:
    """``host, kind, token, n, place, page_hash`` of each page's distinct tokens, and of ROOT; ``pages(host, page, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, kind, token, n, place, page = [], [], [], [], [], []
            for i, h in enumerate(b.column("html")):
                raw = h.as_py() if h.is_valid else ""
                items = tokenize(raw)
                seen: dict[int, list[int]] = {ROOT: [1, -1]}
                for at, x in enumerate(items):
                    if x.token:
                        own = seen.setdefault(x.token, [0, at])
                        own[0] += 1
                own_hash = xxhash.xxh64_intdigest(raw, i) >> 1
                own_kind = page_kind(items)
                for k, (count, at) in seen.items():
                    who.append(i)
                    kind.append(own_kind)
                    token.append(k)
                    n.append(count)
                    place.append(at)
                    page.append(xxhash.xxh64_intdigest(count.to_bytes(8), own_hash) >> 32)
            columns = [b.column("host").take(pa.array(who, pa.int64())), *(pa.array(x, pa.int64()) for x in (kind, token, n, place, page))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "kind", "token", "n", "place", "page_hash"])

    return pages.select("host", "html").mapInArrow(run, "host string, kind bigint, token bigint, n bigint, place bigint, page_hash bigint")


def deduce(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``host, kind, token, class, place, pages``: tokens of the equivalence classes that make a host's template.

    An occurrence vector is how often a token occurs on each page of the host (``kind`` 0) or on its pages of one kind;
    it is held as pages, occurrences and a sum of hashes of (page, count), so vectors are added up before they are
    shuffled and no host's pages are gathered. Tokens with the same vector are a class; classes of two tokens or more
    that occur on two pages and on ``support`` of those pages at least are kept. A kind that all pages of a host are of
    is the host's.
    """
    return _deduce(pages, support)[0]


def _deduce(pages: DataFrame, support: float) -> tuple[DataFrame, DataFrame]:
    """The template's tokens, and ``host, kind`` of all pages."""
    vectors = settle(
        page_tokens(pages)
        .withColumn("kind", F.explode(F.array(F.lit(0).cast("long"), "kind")))
        .groupBy("host", "kind", "token")
        .agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum("page_hash").alias("sig"), F.avg("place").alias("place"))
        .where((F.col("pages") >= 2) | (F.col("token") == ROOT))
    )
    counts = vectors.where((F.col("token") == ROOT) & (F.col("pages") >= 2)).selectExpr("host", "kind", "pages as n_kind")
    hosts = counts.where("kind = 0").selectExpr("host", "n_kind as n_host")
    counts = counts.join(hosts, "host").where("kind = 0 or n_kind < n_host").select("host", "kind", "n_kind")
    kept = settle(vectors.where(F.col("token") != ROOT).join(counts, ["host", "kind"]).where(F.col("pages") >= F.col("n_kind") * support).drop("n_kind"))
    cls = F.xxhash64("pages", "total", "sig")
    sizes = kept.groupBy("host", "kind", cls.alias("class")).agg(F.count("*").alias("size")).where("size >= 2")
    found = kept.select("host", "kind", "token", cls.alias("class"), "place", "pages").join(sizes, ["host", "kind", "class"])
    found = settle(found.select("host", "kind", "token", "class", "place", "pages"))
    return found, vectors.where((F.col("token") == ROOT) & (F.col("kind") != 0)).select("host", "kind")


def add_kind(rows: DataFrame) -> DataFrame:
    """``rows`` with the kind of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pa.array([page_kind(tokenize(h or "")) for h in b.column("html").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, kinds], [*b.schema.names, "kind"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", kind bigint")


def extract_main_text(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page, url, text, n_chars`` of every row: the main text (empty if there is none) and its code points.

    Null pages are empty; pages without a host have no template; repeated rows are rows and count as pages of their
    host; an empty table has an empty result. Templates are broadcast up to a checked number of tokens; beyond it they
    come by a join on the host and kind of page, whose arrays hold no more tokens than twice a page's; pages are shuffled once
    for it, and parsed twice.
    """
    host = F.lower(F.regexp_extract(F.col(f"`{url}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rows = df.select(F.col(f"`{page}`").alias("page"), F.col(f"`{url}`").alias("url"), host.alias("host"), F.col(f"`{html}`").alias("html"))
    tokens, kinds = _deduce(rows.where("host <> ''"), SUPPORT)
    few = tokens.count() <= BROADCAST_TOKENS
    known: dict[tuple[str, int], dict] = {}
    if few:
        for r in tokens.toLocalIterator():
            known.setdefault((r.host, r.kind), {})[r.token] = (r["class"], r.place, r.pages)
    else:
        part = F.collect_list(F.struct("token", "class", "place", "pages"))
        of_host = tokens.where("kind = 0").groupBy("host").agg(part.alias("of_host"))
        of_kind = tokens.where("kind <> 0").groupBy("host", "kind").agg(part.alias("of_kind"))
        # templates are put together by host and kind first, so that pages are shuffled once
        known_kinds = settle(kinds.join(of_host, "host", "left").join(of_kind, ["host", "kind"], "left").where("of_host is not null or of_kind is not null"))
        rows = add_kind(rows).join(known_kinds, ["host", "kind"], "left").select("page", "url", "host", "html", "of_host", "of_kind")
    shared = df.sparkSession.sparkContext.broadcast(known)
    kind = rows.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[tuple[str, int], Template] = {}
        for b in batches:
            texts = []
            for i, (host, page) in enumerate(zip(b.column("host").to_pylist(), b.column("html").to_pylist())):
                items = tokenize(page) if page else []
                if few:
                    key = (host, page_kind(items))
                    if key not in merged:
                        merged[key] = Template(shared.value.get((host, 0), {}) | shared.value.get(key, {}))
                    template = merged[key]
                else:
                    parts = [b.column(c)[i].as_py() or [] for c in ("of_host", "of_kind")]
                    template = Template({t["token"]: (t["class"], t["place"], t["pages"]) for x in parts for t in x})
                texts.append(items_text(items, template))
            yield pa.RecordBatch.from_arrays([b.column("page"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page", "url", "text", "n_chars"])

    out = rows.mapInArrow(run, f"page {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"page": page, "url": url})
