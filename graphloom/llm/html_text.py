"""HTML extraction (operator 7) by two passes of rules over blocks.

A page is cut into blocks at block-level tags. The first pass measures every block that no holder rules out (menus,
forms, asides and the like, or anything outside the article of a page that marks one): its length, its link density and
its density of stop words. Enough text with few links is kept if it is long, dense in stop words or held by an article;
blocks of links go; short ones, and middling ones of few stop words, stay undecided, since their measures don't tell.
In the second pass undecided blocks take the label of the nearest decided neighbours: those under the same parent
before others, of both if they agree, of the nearer one if not; between two equally near ones that differ, one ruled
out by its holder counts less, then length and stop words break the tie. A heading goes with what it stands above.

Defined results: null and empty pages have an empty text; pages where no block is decided for keep what is
undecided; white space of any kind, and line breaks by tags, are one space inside a block; repeated rows
each get a row; tags that never close end with the page or where an outer tag closes, and an unclosed script or style
runs to the end of the page; drawings, templates, embedded pages and what players show where they fail are no text, but
only up to their end tag; formulas are text; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.quality import STOP_WORDS

LINK_DENSITY = 0.5
#: A block of so few links that its length alone speaks for it.
LOW_LINKS = 0.2
SHORT = 70
LONG = 200
STOP_HIGH = 0.25
STOP_LOW = 0.10

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What these hold is never article text.
AWAY_TAGS = frozenset("nav footer aside button select option dialog menu head title search".split())
#: What these hold isn't either, unless it is most of the page's text.
DOUBTFUL_TAGS = frozenset(["form", "fieldset"])
MOST = 0.5
MAIN_TAGS = frozenset(["article", "main"])
#: An open one of the key ends where one of its values begins, as HTML parsers do.
ENDED_BY = {
    "p": BLOCK_TAGS - {"button", "option", "body", "html", "head", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "tr": frozenset(["tr"]),
    "head": frozenset(["body"]),
}
#: Elements an implied end doesn't reach across.
SCOPES = frozenset("article aside body div footer form header main nav section table td th ul ol dl blockquote".split())
VOID = frozenset("hr br img input meta link".split())
#: Words of class, id and role values; fixed values.
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "footer foot header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog comment comments reply replies disqus discussion respond "
    "share sharing social follow subscribe subscription newsletter signup login search related recommended recommendations widget widgets toolbar skip complementary contentinfo form".split()
)
#: Of those, words of readers' own texts, which may be longer than the article.
READERS_WORDS = frozenset("comment comments reply replies disqus discussion respond".split())
SOFT_WORDS = frozenset("article content post story entry".split())
#: By tag, the open elements that its beginning may end.
ENDS = {tag: [t for t, by in ENDED_BY.items() if tag in by] for tag in BLOCK_TAGS}
#: Doubtful elements around a block that are looked at, outermost first; deeper ones are inside those.
DEEPEST = 8
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose blocks belong to the element around them.
LEAVES = HEADINGS | frozenset("p li dt dd td th pre caption figcaption blockquote summary".split())
#: What stands between the tags of these is not shown as text.
UNSHOWN = frozenset("noscript template iframe svg textarea canvas audio video".split())

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LAST = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.IGNORECASE) for tag in UNSHOWN}
_EDGES = ".,;:!?\"'()[]«»"


@dataclass
class Block:
    text: str
    link_chars: int
    away: bool  # held by something that is never article text
    main: bool  # held by an article
    doubts: tuple[int, ...] = ()  # the elements around it that are away unless they hold most of the page's text
    soft: bool = False  # held by something named as content
    heading: bool = False
    parent: int = 0  # the element that it shares with its siblings
    label: bool | None = None
    stops: float = 0.0

    @property
    def linked(self) -> bool:
        return self.link_chars > LINK_DENSITY * len(self.text)


@dataclass
class _Open:
    tag: str
    away: bool
    main: bool
    soft: bool = False
    number: int = 0
    doubts: tuple[int, ...] = ()


def _attributes(attrs: str) -> dict[str, str]:
    """Names in lower case with their values; of a name that comes twice, the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        out.setdefault(name.lower(), "".join(values))
    return out


def _named_words(attributes: dict[str, str]) -> frozenset[str]:
    values = [attributes[n] for n in ("class", "id", "role") if attributes.get(n)]
    return frozenset(w for v in values for w in _SPLIT.split(_CAMEL.sub(" ", v).lower()))


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[str] = []
    links: list[str] = []
    unclosed: set[str] = set()
    standing: Counter[str] = Counter()  # open elements by tag
    link_depth, opened = -1, 0  # elements open where the open link began, -1 without one

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                linked = len(" ".join(entities.unescape(" ".join(links)).split()))
                top = stack[-1] if stack else _Open("", False, False)
                around = stack[-2] if top.tag in LEAVES and len(stack) > 1 else top
                out.append(Block(text, linked, top.away, top.main, top.doubts, top.soft, top.tag in HEADINGS, around.number))
            parts.clear()
            links = []

    def close(k: int) -> None:
        nonlocal link_depth
        standing.subtract(o.tag for o in stack[k:])
        del stack[k:]
        if link_depth > k:
            link_depth = -1

    def add(text: str) -> None:
        parts.append(text)
        if link_depth >= 0:
            links.append(text)

    at = 0
    while piece := _PIECE.search(page, at):
        if piece.start() > at:
            add(page[at : piece.start()])
        at = piece.end()
        tag = piece["tag"] or piece["tag2"]
        if tag is None:
            continue
        tag, ends, attrs = tag.lower(), bool(piece["end"] or piece["end2"]), piece["attrs"] or piece["attrs2"] or ""
        if tag == "a":
            link_depth = -1 if ends else len(stack)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in UNSHOWN:
            if not ends and not attrs.endswith("/") and tag not in unclosed:
                last = _LAST[tag].search(page, at)
                if last:
                    at = last.end()
                else:
                    unclosed.add(tag)
            continue
        if tag not in BLOCK_TAGS:
            continue
        flush()
        if ends:
            for k in range(len(stack) - 1, -1, -1) if standing[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        for k in range(len(stack) - 1, -1, -1) if any(standing[t] for t in ENDS.get(tag, ())) else ():
            if tag in ENDED_BY.get(stack[k].tag, ()):
                close(k)
                break
            if stack[k].tag in SCOPES:
                break
        if tag in VOID:
            continue
        top = stack[-1] if stack else _Open("", False, False)
        attributes = _attributes(attrs) if attrs and not attrs.isspace() else {}
        words = _named_words(attributes)
        main = top.main or tag in MAIN_TAGS or attributes.get("role", "").strip().lower() == "main"
        away = top.away or tag in AWAY_TAGS or tag == "header" and not main or _hidden(attributes)
        named = tag not in ("html", "body", "article", "main") and bool(words & AWAY_WORDS)
        away = away or named and bool(words & READERS_WORDS)
        opened += 1
        doubts = (*top.doubts, opened) if tag in DOUBTFUL_TAGS or named else top.doubts
        stack.append(_Open(tag, away, main, top.soft or tag != "body" and not named and bool(words & SOFT_WORDS), opened, doubts[:DEEPEST]))
        standing[tag] += 1
    if at < len(page):
        add(page[at:])
    flush()
    settle_doubts(out)
    return out


def settle_doubts(blocks: list[Block]) -> None:
    """Forms and elements with a name that speaks against them go, unless one holds most of the text that may be shown."""
    sizes: Counter[int] = Counter()
    for b in blocks:
        if not b.away:
            sizes.update(dict.fromkeys(b.doubts, len(b.text)))
    whole = sum(len(b.text) for b in blocks if not b.away)
    for b in blocks:
        b.away = b.away or any(sizes[d] <= MOST * whole for d in b.doubts)


def stop_density(text: str) -> float:
    words = text.split()
    return sum(w.strip(_EDGES).lower() in STOP_WORDS for w in words) / len(words)


def decide(blocks: list[Block]) -> None:
    """First pass: what the block alone tells. A holder only rules out; what it lets in is measured."""
    # an article counts as one only if it isn't outweighed by what reads like paragraphs elsewhere: a teaser is
    inside = sum(len(b.text) for b in blocks if b.main and not b.away)
    has_main = inside > 0 and inside >= sum(len(b.text) for b in blocks if not b.main and not b.away and len(b.text) >= SHORT and b.link_chars < LOW_LINKS * len(b.text))
    for i, b in enumerate(blocks):
        if b.away or has_main and not b.main:
            b.label = False
            continue
        size, held = len(b.text), b.main or b.soft
        b.stops = stop_density(b.text)
        if b.linked:
            # one block of links among text may be part of it, several in a row are a menu
            alone = not any(x.linked and not x.away for x in blocks[max(0, i - 1) : i] + blocks[i + 1 : i + 2])
            b.label = None if alone and (b.main or b.soft and size < SHORT) else False
        elif size >= LONG and (b.link_chars < LOW_LINKS * size or b.stops >= STOP_LOW) or size >= SHORT and (held or b.stops >= STOP_HIGH):
            b.label = True
        elif size < SHORT and b.link_chars and not held:
            b.label = False


def _nearest(blocks: list[Block]) -> list[int | None]:
    """For each block the place of the last decided one before it."""
    out: list[int | None] = []
    last = None
    for i, b in enumerate(blocks):
        out.append(last)
        last = i if b.label is not None else last
    return out


def _neighbours(blocks: list[Block]) -> list[tuple[int | None, int | None]]:
    """For each block the nearest decided ones before and after it."""
    last, before = len(blocks) - 1, _nearest(blocks)
    after = [None if k is None else last - k for k in reversed(_nearest(blocks[::-1]))]
    return list(zip(before, after, strict=True))


def _taken(blocks: list[Block], i: int, left: int | None, right: int | None) -> bool:
    """The label that block i takes from decided neighbours, one of which may be missing."""
    b = blocks[i]
    if left is None or right is None or b.heading:
        return bool(blocks[left if right is None else right].label)
    one, other = blocks[left], blocks[right]
    if one.label == other.label or i - left != right - i:
        return bool((one if i - left <= right - i else other).label)
    against = other if one.label else one
    return against.away or b.main or len(b.text) >= SHORT or b.stops >= STOP_LOW


def inherit(blocks: list[Block]) -> None:
    """Second pass: undecided blocks take the label of the nearest decided neighbours, siblings first."""
    if not any(b.label for b in blocks):  # nothing speaks for any block, so that ruled-out neighbours tell nothing
        for b in blocks:
            b.label = b.label is None
        return
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        groups.setdefault(b.parent, []).append(i)
    siblings: dict[int, tuple[int | None, int | None]] = {}
    for held in groups.values():
        near = _neighbours([blocks[i] for i in held])
        siblings.update((i, tuple(None if k is None else held[k] for k in pair)) for i, pair in zip(held, near, strict=True))
    inner = [i for i, b in enumerate(blocks) if b.main and not b.away]
    near = _neighbours([blocks[i] for i in inner])
    in_main = {i: tuple(None if k is None else inner[k] for k in pair) for i, pair in zip(inner, near, strict=True)}
    labels = []
    for i, (b, pair) in enumerate(zip(blocks, _neighbours(blocks), strict=True)):
        choices = [siblings[i], in_main[i]] if i in in_main else [siblings[i], pair]
        found = next((c for c in choices if c != (None, None)), None)
        labels.append(b.label if b.label is not None else found is None or _taken(blocks, i, *found))
    for b, label in zip(blocks, labels, strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = blocks_of(page)
    decide(blocks)
    inherit(blocks)
    return "\n".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns ``carry`` with the main text of each whole page."""
    carry = list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*carry, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in carry)
    return pages.select(*carry, F.col(html).alias("graphloom_html")).mapInArrow(run, f"{schema}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
