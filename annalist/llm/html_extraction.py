"""Main text of web pages from streaming parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser sends start, end and data events; they are folded into lines (one per block element), each
with its text, the number of tags that it holds and the grouping element it lies in. Elements that never hold main text by
their meaning (menus, footers, asides, forms, scripts, styles, headers outside an article) give no lines.
The lines' text-to-tag ratios are smoothed with a Gaussian. Lines over the threshold (a share of the deviation) are content;
their text is the mass of the groups around them. From the body down, the region is the group that holds at least DOMINANT
of the mass of the group above it; the descent ends at an article or main element, or where no group dominates. So the
clusters choose the region, and they grow to all of it, short lines too; of a body in which no group dominates the lines
between its first and last content line are kept.
Names are hints: mass in an article or main element counts FAVOUR times, mass in a group whose class, id or role says advert,
notice, sidebar, comments or the like a tenth. Such a group inside the region is left out unless it has half of the region's
text; a region inside such a group is kept. A class says so only if all its words do ("ad-banner" and "comment-list", but
not "social-science" or "share-prices").

Character references are decoded, white space in a block becomes one space, blocks are joined by an empty line. A tag that
the page's end cuts off is dropped. Null or empty html gives an empty text. Every row gives one row, repeated ones and ones
of a null id too; kept columns called `text` are replaced by the result. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import chunks, tidy

SIGMA = 1.0
RADIUS = 2
SHARE = 0.25
DOMINANT = 0.7
FAVOUR = 8.0
DISLIKE = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form script style noscript template head button select textarea svg iframe object canvas dialog menu".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
GROUP = frozenset("article body center details div fieldset main section table tbody td tr".split())
REGION = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Words of classes and ids of parts that are no main text, and words that say nothing beside them.
HINTS = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidenav menu navbar nav navigation breadcrumb breadcrumbs footer comment comments disqus respond share sharing social related recommended promo promotion newsletter subscribe signup login pagination".split())
HEADS = frozenset("header masthead banner topbar".split())
NEUTRAL = frozenset("area article bar block blog bottom box button buttons center col column container content entry form global group icons inner item items left link links list list main media message page panel policy post posts primary reader row right section secondary site slot strip thread top unit user widget widgets wrap wrapper".split())
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CUT = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?$")
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]


def disliked(names: str, headed: bool) -> bool:
    """Whether one of the names (a class or id attribute) consists of hint words and neutral ones only; headed: inside an
    article or main element, where headers belong to the text."""
    for name in names.lower().split():
        words = [w for w in _WORDS.findall(name) if not w.isdigit()]
        hints = HINTS if headed else HINTS | HEADS
        if any(w in hints for w in words) and all(w in hints or w in NEUTRAL for w in words):
            return True
    return False


class _Lines(HTMLParser):
    """lines: (text, tags, group); groups: parent, kind (element name) and whether a hint speaks against it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.groups: list[tuple[int, str, bool]] = [(-1, "html", False)]
        self.stack: list[tuple[str, bool, int, int]] = []  # tag, hides, group and regions before it
        self.blocks: list[int] = []  # places of block elements in the stack
        self.open: Counter = Counter()
        self.hidden = self.tags = self.regions = self.group = 0
        self.parts: list[str] = []

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, max(self.tags, 1), self.group))
            self.parts = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if not self.hidden:
                if tag == "br":
                    self.parts.append(" ")
                elif tag == "hr":
                    self._flush()
                self.tags += 1
            return
        block = tag in BLOCK
        if block:
            self._flush()
            # An open paragraph, item or cell ends where the next one begins.
            if tag in ("p", "li", "dt", "dd", "td", "th", "tr") and self.blocks and self.stack[self.blocks[-1]][0] == tag:
                self._pop(self.blocks[-1])
        hide = tag in NEVER or tag == "header" and not self.regions
        against = False
        if not hide and attrs and tag not in ("html", "body"):
            for name, value in attrs:
                if name == "hidden":
                    hide = True
                elif value and (name in ("class", "id") and disliked(value, self.regions > 0) or name == "role" and value.lower() in ROLES):
                    against = tag not in REGION
        before = self.group, self.regions
        if tag in GROUP or against:
            self.groups.append((self.group, tag, against))
            self.group = len(self.groups) - 1
            if against and not block:
                self._flush()
        self.regions += tag in REGION
        if block:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, hide, *before))
        self.open[tag] += 1
        self.hidden += hide
        if not self.hidden:
            self.tags += 1

    def _pop(self, i: int) -> None:
        while len(self.stack) > i:
            tag, hide, group, self.regions = self.stack.pop()
            if group != self.group:
                self._flush()
            self.group = group
            self.open[tag] -= 1
            self.hidden -= hide
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._flush()
        if self.open[tag]:
            i = len(self.stack) - 1
            while self.stack[i][0] != tag:
                i -= 1
            self._pop(i)
        if not self.hidden:
            self.tags += 1

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def smooth(values: list[float]) -> list[float]:
    out = []
    for i in range(len(values)):
        near = [(w, values[i + d]) for w, d in zip(_KERNEL, range(-RADIUS, RADIUS + 1), strict=True) if 0 <= i + d < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_lines(lines: list[tuple[str, int, int]]) -> list[bool]:
    """Whether each line's smoothed text-to-tag ratio reaches the threshold."""
    ratios = smooth([len(text) / tags for text, tags, _ in lines])
    mean = sum(ratios) / len(ratios)
    threshold = SHARE * min(mean, math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)))
    return [r >= threshold for r in ratios]


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(_CUT.sub("", html))
    parser.close()
    parser._flush()
    lines, groups = parser.lines, parser.groups
    if not lines:
        return ""
    content = content_lines(lines)
    n = len(groups)
    favour, semantic = [1.0] * n, [False] * n
    children: list[list[int]] = [[] for _ in range(n)]
    for g in range(1, n):  # a group comes after its parent
        parent, kind, against = groups[g]
        children[parent].append(g)
        semantic[g] = semantic[parent] or kind in REGION
        favour[g] = (FAVOUR if semantic[g] and not semantic[parent] else 1.0) * favour[parent] * (DISLIKE if against else 1.0)
    mass, size = [0.0] * n, [0] * n
    for (text, _, g), c in zip(lines, content, strict=True):
        mass[g] += len(text) * favour[g] * c
        size[g] += len(text)
    for g in range(n - 1, 0, -1):
        mass[groups[g][0]] += mass[g]
        size[groups[g][0]] += size[g]
    region = 0
    while groups[region][1] not in REGION and children[region]:
        best = max(children[region], key=lambda g: mass[g])
        if mass[best] < DOMINANT * mass[region] or not mass[best]:
            break
        region = best
    state = [0] * n  # 1: in the region, 2: in a part of it that a hint leaves out
    state[region] = 1
    for g in range(region + 1, n):
        state[g] = state[groups[g][0]]
        if state[g] == 1 and groups[g][2] and 2 * size[g] < size[region]:
            state[g] = 2
    kept = [i for i, (_, _, g) in enumerate(lines) if state[g] == 1]
    if groups[region][1] in ("html", "body"):  # no group dominates: what comes before and after all content is no text
        core = [i for i in kept if content[i]]
        kept = [i for i in kept if core and core[0] <= i <= core[-1]] or kept
    return "\n\n".join(lines[i][0] for i in kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id_col, *keep, text) for every row; one pass, no shuffle."""
    keep = tuple(c for c in dict.fromkeys(keep) if c not in (id_col, "text"))
    base = pages.select(F.col(id_col), *keep, F.col(html_col).cast("string").alias("__html"))
    out = base.drop("__html").withColumn("text", F.lit("")).schema

    def run(batches):
        for batch in chunks(batches, "__html"):
            texts = [extract(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return base.mapInArrow(tidy(run), out)
