"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies blocks by their text. Blocks that are mostly
links are bad. A long block is good if ``ENOUGH`` signs of prose meet: a fair density of stop words, a high one, few
linked letters, an end of a sentence, a place inside the page's article; else it is bad. A short block is good if its
stop words are dense; all other short ones stay open. In the second pass an open block inherits the label of the
nearest decided block, the good one if both are as near.

What the page says about places is a hint beside these rules: menus, headers, footers, sidebars, notices, adverts,
forms and comments that are named as such are bad whatever their text, and if a marked article holds a good block, all
blocks outside it are bad.

Rows. Null html is empty and gives an empty text; markup that is cut off or badly nested is read as far
as it goes, in time linear in its length. Repeated rows are extracted alike, an empty table gives an empty one. Other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import in_slices

#: Blocks of so many characters are decided by themselves.
LONG = 70
#: Stop words among the words of a block: a fair density, and a high one that decides short blocks of ``WORDS`` words.
PROSE_DENSITY, STOP_DENSITY, WORDS = 0.08, 0.25, 5
#: Linked letters among those of a block: mostly links, and few.
LINK_DENSITY, FEW_LINKS = 0.5, 0.2
#: Signs of prose that make a long block good.
ENOUGH = 2

# Function words of the languages that the corpus holds.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their there they this to was we were which will with you "
    "als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht sich sie sind und von war wie wir zu zum "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "al como con de del el ella en es esta este fue ha la las lo los más no o para pero por que se ser si sin su sus un una y ya".split())
# Elements that start a block of their own.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split())
# Elements whose text is never content.
DROPPED_TAGS = frozenset("aside button datalist dialog footer form head iframe menu nav object option select svg canvas title audio video map template noscript".split())
# Elements whose content is not markup.
RAW_TAGS = frozenset("script style textarea xmp noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert advertisement adverts advertising banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright disqus footer footers gdpr header masthead menu menus "
    "modal nav navbar navigation newsletter notice notices outbrain overlay pagination pager paywall popup privacy promo promoted promotion recommended related replies reply respond share sharing sidebar sidebars signup skip social sponsor "
    "sponsored subscribe subscription taboola toolbar topbar widget widgets alert contentinfo complementary search".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the end of a tag; a quote opens a value only after an equals sign.
_REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u06d4]")
_RIGHTS = re.compile(r"\xa9|\(c\)|copyright", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


class Block:
    """Text between two block borders, with what the page says about the place."""

    __slots__ = ("text", "linked", "furniture", "region", "label")

    def __init__(self, text: str, linked: int, furniture: bool, region: int) -> None:
        self.text, self.linked, self.furniture, self.region = text, linked, furniture, region
        self.label: bool | None = None


def _is_furniture(tag: str, attributes: str, inside: bool) -> bool:
    if tag in DROPPED_TAGS or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for found in _NAMES.finditer(attributes):
        words = set(_SPLIT.split((found[1] or found[2] or found[3] or "").lower()))
        if tag in ("article", "main"):
            words &= {"comment", "comments", "ad", "advert", "advertisement", "sponsored", "promo", "related", "reply"}
        elif tag == "header" or re.fullmatch("h[1-6]", tag):
            words -= {"header"}
        if words & FURNITURE:
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = link = 0
    stack: list[tuple[str, bool, int]] = []  # tag, furniture, region
    standing: Counter = Counter()  # how often each tag stands in the stack
    bad_depth, region, regions = 0, 0, 0
    at, end, last, quoted = 0, len(page), page.rfind(">"), True

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, bad_depth > 0, region))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if link else 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        tag = _TAG.match(page, lt + 1)
        if not tag and page[lt + 1 : lt + 2] not in ("!", "?"):
            add(page[at : lt + 1])  # a sign, not a tag
            at = lt + 1
            continue
        add(page[at:lt])
        if not tag:
            comment = page.startswith("<!--", lt)
            stop = page.find("-->" if comment else ">", lt + (4 if comment else 1))
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        if lt > last:
            break  # a tag that never ends
        rest = _REST.match(page, tag.end()) if quoted else None
        if not rest:
            quoted = False  # a quote that never closes: from here on a tag ends at the next sign
            stop = page.find(">", tag.end())
            if stop < 0:
                break
        at = rest.end() if rest else stop + 1
        closing, name, attributes = tag[1], tag[2].lower(), page[tag.end() : at - 1]
        if name == "a":
            link = 0 if closing else 1
            continue
        if closing:
            if name in BLOCK_TAGS:
                close_block()
            if standing[name]:
                if name not in BLOCK_TAGS:
                    close_block()
                else:
                    link = 0
                while True:
                    tag_name, bad, _ = stack.pop()
                    standing[tag_name] -= 1
                    bad_depth -= bad
                    if tag_name == name:
                        break
                region = stack[-1][2] if stack else 0
            continue
        if name in RAW_TAGS:
            gone = re.compile(rf"</{name}\s*+>", re.I).search(page, at)
            at = gone.end() if gone else end
            continue
        if name in VOID_TAGS:
            if name == "br":
                parts.append("\n")
            elif name in BLOCK_TAGS:
                close_block()
            continue
        bad = _is_furniture(name, attributes, region > 0)
        if name in BLOCK_TAGS or bad:
            close_block()
            if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and not bad:
                continue  # often left open: they bound blocks but hold no state
            if name in ("article", "main") and not bad:
                regions += 1
                region = regions
            bad_depth += bad
            stack.append((name, bad, region))
            standing[name] += 1
    close_block()
    return out


def _decide(b: Block) -> bool | None:
    """The first pass: good, bad or open, by the text of a block and, as one sign among others, its place."""
    if b.furniture or b.linked > LINK_DENSITY * len(b.text):
        return False
    words = _LETTERS.findall(b.text.lower())
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    few_links = b.linked <= FEW_LINKS * len(b.text)
    if len(b.text) >= LONG:
        signs = (density >= PROSE_DENSITY) + (density >= STOP_DENSITY) + few_links + bool(_SENTENCE.search(b.text)) + (b.region > 0)
        return signs >= ENOUGH
    if density >= STOP_DENSITY and len(words) >= WORDS and few_links:
        return True
    return False if not b.region and _RIGHTS.search(b.text) else None


def classify(found: list[Block]) -> None:
    """Label every block good (True) or bad (False) in two passes."""
    for b in found:
        b.label = _decide(b)
    marked = {b.region for b in found if b.region and b.label}
    # neighbours by region: furniture decides nothing about the text beside it
    by_region: dict[int, list[Block]] = {}
    for b in found:
        if not b.furniture:
            by_region.setdefault(b.region, []).append(b)
    for region, near in by_region.items():
        if marked and not region:
            for b in near:
                b.label = False
            continue
        inherited: list[bool] = []
        before: tuple[int, bool] | None = None
        after = [None] * (len(near) + 1)
        for i in range(len(near) - 1, -1, -1):
            after[i] = (i, near[i].label) if near[i].label is not None else after[i + 1]
        for i, b in enumerate(near):
            if b.label is not None:
                before = (i, b.label)
                inherited.append(b.label)
                continue
            options = [(abs(i - k), not label, label) for k, label in filter(None, (before, after[i + 1]))]
            inherited.append(min(options)[2] if options else region > 0)
        for b, label in zip(near, inherited):
            b.label = label


def extract(page: str | None) -> str:
    """The main text of a page: its good blocks joined by one space."""
    found = blocks(page or "")
    classify(found)
    return " ".join(b.text for b in found if b.label)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 2):
        texts = [extract(p) for p in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of ``pages``."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
