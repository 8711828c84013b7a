"""Main text of raw pages by two-pass block rules.

A small scanner cuts the page into blocks at block-level tags, remembering for each the characters inside
links and the place it stands in. End tags may be missing where HTML lets them (head, p, li, dt, dd, table
parts, options); a stray end tag of an inline element closes nothing beyond its block. Scripts, styles,
templates, form controls, comments and the head never yield text; a control without its end tag loses its
text up to the next block-level tag only. Places with a say of their own: navigation, header, footer, aside,
form and dialog elements, and elements whose class, id or role names such a part (menu, sidebar, cookie,
advert, comment, ...; also of an article or inline element, but not in words like "no-sidebar"), are
boilerplate; other article and main elements are content. Of a header element inside an article only headings
(h1-h6) are text, whatever its class. If names of classes leave nothing of a page, it is judged without them.

Pass one decides a block by its place, link density, length and stop-word density:

* boilerplate place, no word, or link density above ``max_link_density``: bad;
* at least ``long_chars`` characters: good inside an article or main element, if the stop-word density reaches
  ``stop_high``, or on a page whose language is not listed (listed stop words are less than ``stop_page`` of
  its words); else bad;
* at least ``short_chars`` characters and a stop-word density of ``stop_low``: good;
* all others: undecided.

Pass two gives each undecided block the label of its nearest decided neighbour within the same content
container (equally near ones of both kinds: good). Without any, blocks of an article or main element
are good, and those of a page without such an element are good if nothing else of the page is.

Where articles and main elements hold at least ``main_share`` of the characters labelled good, text outside
them is dropped (teasers, notices); else they are only parts of the page and the labels alone decide.

Null and empty pages give an empty text. Block texts have character references decoded and white space
folded to single spaces; they are joined by two line breaks in page order, whole. Repeated rows are
extracted each on its own.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import slices, texts

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose whole content is no text; those of RAW hold no markup.
SILENT = frozenset("script style noscript template select button textarea svg iframe object canvas audio video math title".split())
RAW = frozenset("script style".split())
#: Elements that may stand in a head; any other start tag ends it.
HEAD_PARTS = frozenset("title meta link base basefont bgsound script style noscript template noframes".split())
BAD_PLACES = frozenset("nav header footer aside form dialog menu".split())
GOOD_PLACES = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Start tags that end an open element of the same row, their end tags being optional.
SIBLINGS = {t: row for row in (("li",), ("dt", "dd"), ("td", "th"), ("tr",), ("option",), ("optgroup",)) for t in row}
#: Words of a class, id or role that tell a part of the page that is not its article.
BAD_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside rail widget ad ads advert adverts advertisement adsense banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended trending pagination pager "
    "comment comments commentlist respond reply replies disqus contentinfo complementary search form toolbar copyright legal disclaimer skip hidden".split()
)
#: Beside one of these, such a word tells how a wrapper is laid out, not what it holds.
LAYOUT_WORDS = frozenset("no has with without hide show is not layout page wrapper wrap container site body template format".split())
HEADER_NAMES = frozenset(("header", "masthead"))
#: Fixed lists of the most frequent function words.
STOP_WORDS = frozenset(
    # English
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about "
    "how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way "
    # German
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch "
    # French
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme nous on cette ses être fait elle deux leur "
    # Spanish
    "el los las y del se por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy "
    # Italian, Portuguese, Dutch
    "di il che è per non sono della nel alla dei gli delle questo ma anche come da os do em não uma na dos ao ele das à seu sua ou het een van op te dat niet zijn".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|"
    r"<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>(?:\"[^\"]*\"|'[^']*'|[^'\"<>]+)*))>|"
    r"<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^<>]*>",  # quotes that never close
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=\s|/|$)""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME_PART = re.compile(r"[a-z]+")
_BLOCK_START = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK_TAGS - {'option', 'optgroup'}))})\b", re.I)
_EDGE = ".,;:!?()[]{}\"'«»“”’#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    max_link_density: float = 0.5
    long_chars: int = 140
    short_chars: int = 40
    stop_high: float = 0.12
    stop_low: float = 0.2
    stop_page: float = 0.02
    main_share: float = 0.34


@dataclass
class Block:
    text: str
    link_chars: int
    bad_place: bool
    container: int  # the nearest article or main element; 0: none


def _bad_name(value: str, own: frozenset[str]) -> bool:
    """Whether one of the names in a class, id or role tells a boilerplate part."""
    for name in value.split():
        parts = set(_NAME_PART.findall(name.lower()))
        if parts & own and not parts & LAYOUT_WORDS:
            return True
    return False


def _bad_attrs(attrs: str, names: bool, own: frozenset[str] = BAD_NAMES) -> bool:
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if _UNSEEN.search(value):
                return True
        elif names and name != "aria-hidden" and _bad_name(value, own):
            return True
    return False


class _Open:
    """An open element: where its text stands, and, for a block, its open inline elements by tag."""

    __slots__ = ("tag", "bad", "header", "container", "link", "block", "inline")

    def __init__(self, tag: str, bad: bool, header: bool, container: int, link: bool, block: bool):
        self.tag, self.bad, self.header, self.container, self.link, self.block = tag, bad, header, container, link, block
        self.inline: dict[str, int] = {}


class _Scanner:
    def __init__(self, page: str, names: bool):
        self.page, self.names = page, names
        self.out: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.containers = 0
        self.stack = [_Open("", False, False, 0, False, True)]
        self.blocks = [self.stack[0]]  # the open blocks, innermost last
        self.count: dict[str, int] = {}  # open blocks by tag
        self.closed: dict[str, bool] = {}  # tags known to have no end tag ahead

    def flush(self) -> None:
        if self.parts:
            text = " ".join(_html.unescape("".join(self.parts)).split())
            if text:
                here = self.blocks[-1]
                in_heading = any(b.tag in HEADINGS for b in reversed(self.blocks[-3:])) if here.header else False
                bad = here.bad or (here.header and not in_heading)
                self.out.append(Block(text, min(self.linked, len(text)), bad, here.container))
            self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        here = self.stack[-1]
        if self.count.get("head") or (here.bad and not self.blocks[-1].bad):
            self.parts.append(" ")  # inside the head, or inside an inline element that tells boilerplate
            return
        self.parts.append(raw)
        if here.link:
            self.linked += len(" ".join(_html.unescape(raw).split()))

    def pop_to(self, at: int) -> None:
        """Closes all elements from place ``at`` of the stack on."""
        for e in reversed(self.stack[at:]):
            if e.block:
                self.blocks.pop()
                self.count[e.tag] -= 1
            else:
                self.blocks[-1].inline[e.tag] -= 1
        del self.stack[at:]

    def close(self, tag: str) -> None:
        if tag in BLOCK_TAGS or tag == "head":
            if self.count.get(tag, 0) > 0:
                at = len(self.stack) - 1
                while self.stack[at].tag != tag:
                    at -= 1
                self.pop_to(at)
        elif self.blocks[-1].inline.get(tag, 0) > 0:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self.pop_to(at)

    def close_block(self) -> None:
        """Closes the innermost open block."""
        at = len(self.stack) - 1
        while not self.stack[at].block:
            at -= 1
        self.pop_to(at)

    def open(self, tag: str, attrs: str) -> None:
        block = tag in BLOCK_TAGS or tag == "head"
        if block:
            here = self.blocks[-1].tag
            if here == "p" or here in SIBLINGS.get(tag, ()):
                self.close_block()
        elif tag == "a" and self.blocks[-1].inline.get("a", 0) > 0:
            self.close("a")
        up = self.stack[-1]
        header = up.header or (tag == "header" and up.container > 0)
        bad, own = up.bad or (tag in BAD_PLACES and not (tag == "header" and up.container > 0)), up.container
        if attrs and tag not in ("body", "html"):
            bad = bad or _bad_attrs(attrs, self.names, BAD_NAMES - HEADER_NAMES if header else BAD_NAMES)
        if tag in GOOD_PLACES and not bad:
            self.containers += 1
            own = self.containers
        e = _Open(tag, bad, header, own, up.link or tag == "a", block)
        self.stack.append(e)
        if block:
            self.blocks.append(e)
            self.count[tag] = self.count.get(tag, 0) + 1
        else:
            inline = self.blocks[-1].inline
            inline[tag] = inline.get(tag, 0) + 1

    def after_silent(self, tag: str, at: int) -> int:
        """Where the page goes on after a silent element whose start tag ends at ``at``."""
        if not self.closed.get(tag):
            end = re.compile(rf"</{tag}\s*>", re.I).search(self.page, at)
            if end is None:
                self.closed[tag] = True
            elif tag in RAW or not re.compile(rf"<{tag}\b", re.I).search(self.page, at, end.start()):
                return end.end()
        if tag in RAW:
            return len(self.page)
        after = _BLOCK_START.search(self.page, at)  # its end tag is missing: only its own text goes
        return after.start() if after else len(self.page)

    def run(self) -> list[Block]:
        page, at = self.page, 0
        while (m := _TOKEN.search(page, at)) is not None:
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            if (cdata := m["cdata"]) is not None:
                self.text(cdata)
                continue
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag, closing, attrs = tag.lower(), m["close"] or m["close2"], m["attrs"] or ""
            if self.count.get("head") and not closing and tag not in HEAD_PARTS:
                self.close("head")
            if tag in SILENT:
                if not closing and not attrs.endswith("/"):
                    self.parts.append(" ")
                    at = self.after_silent(tag, at)
                continue
            if tag in BLOCK_TAGS or tag == "head":
                self.flush()
            elif tag == "br":
                self.parts.append(" ")
            if tag in VOID:
                continue
            if closing:
                self.close(tag)
            elif not attrs.endswith("/"):
                self.open(tag, attrs)
        if at < len(page):
            tail = page[at:]
            cut = re.search(r"<[a-zA-Z/!]", tail)
            self.text(tail[: cut.start()] if cut else tail)
        self.flush()
        return self.out


def blocks(page: str, names: bool = True) -> list[Block]:
    """The text blocks of a page in order; ``names``: classes, ids and roles tell boilerplate."""
    return _Scanner(page, names).run()


def classify(found: list[Block], rules: Rules) -> list[bool]:
    """Whether each block belongs to the main text: the two passes."""
    counts = []
    for b in found:
        words = b.text.lower().split()
        counts.append((sum(w.strip(_EDGE) in STOP_WORDS for w in words), len(words)))
    foreign = sum(s for s, _ in counts) < rules.stop_page * sum(n for _, n in counts)
    first: list[bool | None] = []
    for b, (stops, n) in zip(found, counts):
        if b.bad_place or b.link_chars > rules.max_link_density * len(b.text):
            first.append(False)
        elif len(b.text) >= rules.long_chars:
            first.append(foreign or b.container > 0 or stops >= rules.stop_high * n)
        elif len(b.text) >= rules.short_chars and stops >= rules.stop_low * n:
            first.append(True)
        else:
            first.append(None)
    has_container = any(b.container for b in found)
    any_good = any(first)
    members: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        if not b.bad_place:  # boilerplate places are no neighbours of the text around them
            members.setdefault(b.container, []).append(i)
    verdict = [False] * len(found)
    for key, idx in members.items():
        before: list[tuple[int, bool] | None] = []
        last = None
        for k, i in enumerate(idx):
            if first[i] is not None:
                last = (k, first[i])
            before.append(last)
        nxt = None
        for k in range(len(idx) - 1, -1, -1):
            i = idx[k]
            if first[i] is not None:
                nxt = (k, first[i])
                verdict[i] = first[i]
                continue
            near = [(abs(k - c[0]), not c[1]) for c in (before[k], nxt) if c]
            if near:
                verdict[i] = not min(near)[1]
            else:
                verdict[i] = key > 0 or (not has_container and not any_good)
    if has_container:
        inside = sum(len(b.text) for b, good in zip(found, verdict) if good and b.container)
        outside = sum(len(b.text) for b, good in zip(found, verdict) if good and not b.container)
        if inside and inside >= rules.main_share * (inside + outside):
            verdict = [good and b.container > 0 for b, good in zip(found, verdict)]
    return verdict


def extract(page: str | None, rules: Rules = Rules()) -> str:
    """The main text of one page."""
    for names in (True, False):
        found = blocks(page or "", names)
        kept = [b.text for b, good in zip(found, classify(found, rules)) if good]
        if kept or not any(b.bad_place for b in found):
            break
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(p, rules) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = texts(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
