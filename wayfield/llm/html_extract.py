"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass classifies a block by the
density of stop words among its words, its length and the share of its characters inside
links. Markup is a prior: elements that HTML keeps for other content (nav, footer,
aside ...) or that are named for it are out, and in an article a long block with
few stop words is ambiguous instead of bad, since its language may have none listed.
The second pass gives short and other ambiguous blocks the label of the nearest decided
block; outside articles the ends of the page count as decided against.

An element whose name is doubtful (a header, a sidebar) but which holds most of the
page's good text is a wrapper, and its name doesn't count. All steps take time in
proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import batch_limits

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he her his i in is it its not of on or she that the their they this to was we were will with you "
    "als am auch auf aus bei das dem den der des die du ein eine einen er es für hat ich im ist mit nach nicht noch sich sie sind so und von war wie wird zu zum zur "
    "au aux avec ce cette dans de elle en est et il ils je la le les leur mais ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "al como con del el ella ellos entre era esta este ha las lo los más me mi muy no nos o para pero por se ser si sin sobre su sus también te una y ya".split()
)
SHORT = 70
LONG = 140
STOPS_LOW = 0.1
STOPS_HIGH = 0.2
LINKS = 0.5
#: Share of stop words in a page's longer blocks below which its language counts as one without listed ones.
UNLISTED = 0.02
#: Characters that stand for a word or more, and what ends a sentence.
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
SENTENCE = re.compile("[.!?…。！？।؟]")

#: Tags whose content is no text of the page.
SKIPPED = frozenset("head script style noscript template textarea select option button svg math iframe object embed canvas audio video map datalist label".split())
#: Of those, the ones whose content isn't markup.
RAW = frozenset("script style textarea noscript template iframe".split())
ASIDE = frozenset("nav footer aside menu dialog".split())
REGION = frozenset("article main".split())
BLOCK = REGION | ASIDE | frozenset(
    "address blockquote body caption center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what isn't the article, and such as may also name a wrapper of all.
ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscri\w+|related|recommend\w*|share|sharing|social|breadcrumbs?|menu|nav|navbar|"
    r"navigation|footer|comments?|replies|reply|disqus|respond|pagination|pager|login|signup|contentinfo|notice|alert)(?:$|[\s_-])",
    re.I,
)
WRAPPER_NAME = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner|overlay|sidebar|side|widget|search|complementary)(?:$|[\s_-])", re.I)
#: Names that speak of another element than their own.
OTHER_NAME = re.compile(r"(?:^|\s)(?:has|no|with|without|hide|show|is)[_-]\S+", re.I)
#: Words in class, id, role or itemprop that mark the article where no tag does.
REGION_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|main|post|entry|story)(?:$|[\s_-])", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What may end a tag: its bracket, or a quote of a value.
_EDGE = re.compile(r""">|=\s*+["']""")
#: Elements that hold text themselves; what holds these is a block's home.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Headings of reader comments, with a number before or after (fixed values).
SECTIONS = frozenset("section div article".split())
COMMENTS = re.compile(r"(?:\(?\d+\)?\s+)?(?:(?:reader|user|leave\s+(?:a|your)|post\s+a|all|recent)\s+)?(?:comments?|replies|reply|discussion|kommentare?|leserkommentare|commentaires?|comentarios?|комментарии|评论)(?:\s*\(?\d+\)?)?\s*:?", re.I)
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre legend caption summary figcaption".split())


@dataclass
class Block:
    region: int  # 0 outside any article or main element, else its number
    aside: bool
    text: str
    linked: int = 0
    named: bool = False  # the region is known by a name only
    home: int = 0  # number of the element it stands in, paragraphs and the like apart
    wrapper: int = 0  # the innermost element around it with a doubtful name
    stops: float = 0.0
    good: bool | None = None


@dataclass
class _Open:
    tag: str
    number: int
    home: int
    aside: int  # 1 by a name only, 2 by tag or inside a region
    region: int
    wrapper: int = 0


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    open: list[_Open] = field(default_factory=list)
    count: Counter = field(default_factory=Counter)  # of open tags
    parts: list[tuple[str, bool]] = field(default_factory=list)  # text, linked
    named: set[int] = field(default_factory=set)  # regions known by a name only
    below: set[int] = field(default_factory=set)  # regions below what only a name marks as aside
    wrappers: dict[int, int] = field(default_factory=dict)  # doubtful elements, with the next one around each
    elements: int = 0
    regions: int = 0

    def top(self) -> _Open:
        return self.open[-1] if self.open else _Open("", 0, 0, 0, 0)

    def end_block(self) -> None:
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            at = self.top()
            if at.tag in HEADINGS and len(text) < SHORT and len(self.open) > 1 and self.open[-2].tag in SECTIONS and COMMENTS.fullmatch(text):
                at.aside = self.open[-2].aside = 2  # what follows in the section is the readers'
            linked = sum(len(" ".join(t.split())) for t, link in self.parts if link)
            self.blocks.append(Block(at.region, at.aside > 0, text, linked, at.region in self.named, at.home, at.wrapper, stop_share(text)))
        self.parts.clear()

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.count[tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.count[tag] > 0:
            while self.pop() != tag:
                pass

    def start(self, tag: str, attributes: str) -> None:
        """Open a block-level element."""
        while self.open and (self.open[-1].tag == "p" or tag == "li" and self.open[-1].tag == "li"):
            self.pop()
        above = self.top()
        aside, region, wrapper = above.aside, above.region, above.wrapper
        name = " ".join(next(filter(None, m), "") for m in _NAMES.findall(attributes)) if attributes else ""
        name = OTHER_NAME.sub(" ", name) if tag not in ("body", "html") else ""
        self.elements += 1
        if tag == "form" and not aside:
            region = 0  # its blocks are judged by density, wherever it stands
        if tag in REGION and aside == 1 and not ASIDE_NAME.search(name):
            self.regions += 1
            aside, region = 0, self.regions
            self.below.add(region)
        elif tag in ASIDE or tag == "header" and not region:
            aside = 2
        elif name and tag not in REGION and ASIDE_NAME.search(name):
            aside = max(aside, 2 if region else 1)
        elif name and tag not in REGION and WRAPPER_NAME.search(name) and not region:
            self.wrappers[self.elements] = wrapper
            wrapper = self.elements
        elif not aside and (tag in REGION and (not region or region in self.named) or not region and name and REGION_NAME.search(name)):
            self.regions += 1
            region = self.regions
            if tag in REGION:
                wrapper = 0
            else:
                self.named.add(region)
        home = above.home if tag in TEXTUAL else self.elements
        self.open.append(_Open(tag, self.elements, home, aside, region, wrapper))
        self.count[tag] += 1


def _tags(page: str):
    """(start, end, name, closing, attributes) of every tag and comment, the latter without a name.

    One pass: a value's quotes are looked for only where they are closed, and only once.
    """
    at, size = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    last_bracket, last_comment = page.rfind(">"), page.rfind("-->")
    while (begin := page.find("<", at)) >= 0:
        after = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4) + 3 if last_comment >= begin + 4 else size
            yield begin, at, "", False, ""
            continue
        if after in ("!", "?") and after:
            at = page.find(">", begin) + 1 if last_bracket > begin else begin + 2
            yield begin, at, "", False, ""
            continue
        closing = after == "/"
        name = _NAME.match(page, begin + 1 + closing)
        if not name:
            at = begin + 1
            continue
        at = edge = name.end()
        while True:
            found = _EDGE.search(page, edge) if last_bracket >= edge else None
            if not found:
                # No bracket: the rest of the page. A quote that swallowed the last one doesn't count.
                end = page.find(">", at) if last_bracket >= at else -1
                break
            if found[0] == ">":
                end = found.start()
                break
            quote = found[0][-1]
            if last[quote] < found.end():
                edge = found.end()  # never closed
                continue
            edge = page.find(quote, found.end()) + 1
        stop = end if end >= 0 else size
        yield begin, min(size, stop + 1), name[0].lower(), closing, page[at:stop]
        at = min(size, stop + 1)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order; text in skipped tags is left out."""
    state, at, link = _Page(), 0, None  # how many elements were open where the open link began
    skipped: list[str] = []  # open skipped tags that hold markup
    held: Counter = Counter()  # the same, counted
    last: dict[str, int] = {}  # where the last end tag of a skipped tag, or of a link, stands
    lower = page.lower() if len(page.lower()) == len(page) else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
    size = len(page)
    for begin, at_next, tag, closing, attributes in _tags(page):
        if begin < at:
            continue  # inside what was left out
        if begin > at and not skipped:
            state.parts.append((html.unescape(page[at:begin]), link is not None))
        at = at_next
        if not tag:
            continue
        if tag in SKIPPED:
            if tag not in last:
                last[tag] = lower.rfind(f"</{tag}")
            if tag in RAW and not closing:
                if last[tag] >= at:
                    at = _raw_end(tag).search(page, at).end()
                elif tag in ("script", "style"):
                    at = size  # code to the end
            elif tag not in VOID:
                if not closing and not attributes.rstrip().endswith("/"):
                    if tag == "option" and skipped and skipped[-1] == "option":
                        held[skipped.pop()] -= 1
                    # A tag that is never closed hides nothing, but a head ends at the body and an option with its list.
                    if last[tag] >= at or tag == "head" or tag == "option" and skipped:
                        if not skipped:
                            state.end_block()
                        skipped.append(tag)
                        held[tag] += 1
                elif closing and held[tag]:
                    while (gone := skipped.pop()) != tag:
                        held[gone] -= 1
                    held[tag] -= 1
            continue
        if skipped and not closing and (tag == "body" or tag in REGION or skipped[0] == "head" and tag in BLOCK and tag not in ("title", "html")):
            held.clear()
            skipped.clear()  # a head, or another tag, that was never closed
        if skipped:
            continue
        if tag == "br":
            state.parts.append((" ", link is not None))
        elif tag == "a":
            if "a" not in last:
                last["a"] = lower.rfind("</a")
            # A link goes on around blocks, but not out of the element it began in; one that is never closed is none.
            link = len(state.open) if not closing and last["a"] >= at else None
        elif tag in BLOCK:
            state.end_block()
            if closing:
                state.close(tag)
                if link is not None and len(state.open) < link:
                    link = None
            elif tag not in VOID:
                state.start(tag, attributes)
    if at < size and not skipped:
        state.parts.append((html.unescape(page[at:]), link is not None))
    state.end_block()
    # An article below such a wrapper counts unless one stands outside; then it is a teaser or the like.
    if any(b.region and not b.aside and not b.named and b.region not in state.below for b in state.blocks):
        for b in state.blocks:
            b.aside = b.aside or b.region in state.below
    judge_wrappers(state.blocks, state.wrappers)
    return state.blocks


@lru_cache(16)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I)


def judge_wrappers(blocks: list[Block], wrappers: dict[int, int]) -> None:
    """Blocks below an element with a doubtful name are aside, unless it holds most of the page's good text."""
    held: Counter = Counter()
    total = 0
    for b in blocks:
        if not b.aside and dense(b):
            total += len(b.text)
            held[b.wrapper] += len(b.text)
    # Elements are numbered from the outside in.
    for w in reversed(wrappers):
        held[wrappers[w]] += held[w]
    out = {0: False}
    for w, around in wrappers.items():
        out[w] = 2 * held[w] <= total or out[around]
    for b in blocks:
        b.aside = b.aside or out[b.wrapper]


def stop_share(text: str) -> float:
    found = re.findall(r"\w+", text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def dense(b: Block, listed: bool = True) -> bool | None:
    """The first pass without any prior: by links, length and stop words; None if ambiguous.

    Where the page's language has no ``listed`` stop words, length and links decide.
    """
    if b.linked > LINKS * len(b.text):
        return False
    if not listed:
        size = len(b.text) + 2 * len(WIDE.findall(b.text))
        return True if size >= LONG and SENTENCE.search(b.text) else None if size >= SHORT else False
    if len(b.text) < SHORT:
        return None
    if b.stops >= STOPS_HIGH or len(b.text) >= LONG and b.stops >= STOPS_LOW:
        return True
    return False if b.stops < STOPS_LOW else None


def classify(blocks: list[Block]) -> None:
    """Both passes, in place."""
    prose = [b for b in blocks if not b.aside and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)]
    listed = not prose or sum(b.stops * len(b.text) for b in prose) >= UNLISTED * sum(len(b.text) for b in prose)
    for b in blocks:
        b.good = False if b.aside else dense(b, listed)
        if b.region and not b.aside and not b.good and b.linked <= LINKS * len(b.text):
            # The language of an article need not be one with listed stop words, nor an article prose.
            b.good = True if len(b.text) >= SHORT and b.stops >= STOPS_LOW else None
    before, after = _decided(blocks, range(len(blocks))), _decided(blocks, range(len(blocks) - 1, -1, -1))
    marked: list[bool] = []
    for i, b in enumerate(blocks):
        if b.good is not None:
            marked.append(b.good)
            continue
        # Of two as near, the one in the same element counts; else a block of an article is kept and any other is not.
        near = [(abs(i - k), blocks[k].home != b.home, blocks[k].good != bool(b.region), blocks[k].good) for k in (before[i], after[i]) if k is not None]
        if not b.region:
            near += [(i + 1, True, False, False), (len(blocks) - i, True, False, False)]
        marked.append(min(near)[3] if near else True)
    for b, good in zip(blocks, marked, strict=True):
        b.good = good


def _decided(blocks: list[Block], order: range) -> list[int | None]:
    """For each block the last decided one of its region before it in ``order``; in an article asides and lists of links tell nothing."""
    last: dict[int, int] = {}
    out: list[int | None] = [None] * len(blocks)
    for i in order:
        b = blocks[i]
        out[i] = last.get(b.region)
        if b.good is not None and (b.good or not b.region):
            last[b.region] = i
    return out


def extract(page: str | None) -> str:
    """The main text: good blocks in order, an empty line between them."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.good)


def extracted(page: Column) -> Column:
    @arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p) for p in pages.to_pylist()], pa.string())

    return run(page)


def main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text (empty if there is none) and n_chars, its code points.

    Null pages are empty. Columns of these two names are replaced, all others and
    all rows stay. Broken markup is read as far as it goes: unclosed tags end with
    their parents, a cut tag at the end is dropped.
    """
    batch_limits(pages.sparkSession)
    return pages.withColumn("text", extracted(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
