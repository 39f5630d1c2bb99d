"""Main text of HTML pages as the maximum-scoring run of words and tags.

A page is a sequence of words and tags. Words score positive, tags negative, and the contiguous
run of the highest sum is the content, found in one scan. How much a tag costs and what a word in
a certain place is worth is learned from labelled pages: those that mark their own content with
an ``article`` or ``main`` element.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerovox.llm.common import sample_rows, small_batches

#: Labelled pages that the weights are learned from, at most.
TRAINING_PAGES = 1000

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset(["article", "main"])
#: Never content, wherever they stand.
OUTSIDE = frozenset(
    "nav footer aside form button select option input label fieldset menu dialog svg canvas audio video object "
    "applet map head".split()
) | RAW
#: Class names, ids and roles of elements that are never content.
HINTS = frozenset(
    "ad ads advert advertisement advertising adsense adslot banner banners sponsor sponsored promo promotion "
    "promoted outbrain taboola "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip "
    "header masthead topbar footer footnav bottombar colophon copyright "
    "sidebar sidenav aside widget widgets related recommended recommendations popular trending "
    "comment comments commentlist disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login signin paywall share sharing social follow "
    "complementary contentinfo search searchbox form".split()
)

#: Those that count for an ``article`` too: readers' comments and adverts often are articles.
STRONG_HINTS = frozenset("ad advert comment comments reply related recommended sponsored promo teaser".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, value, outside): kind "open" or "close" with the element's name, or "text".

    ``outside`` tells whether an element that is never content surrounds the token. The content
    of raw elements is left out. Elements that stay open end where one around them ends.
    """
    open_elements: list[tuple[str, bool]] = []
    names: Counter[str] = Counter()
    at = 0
    out = False
    # From where the last token ended: what is in a raw element is no token, and none begins there.
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()], out
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), out
            continue
        name = name.lower()
        if name == "p" and not m[1] and open_elements and open_elements[-1][0] == "p":
            open_elements.pop()  # a paragraph ends where the next one begins
            names["p"] -= 1
            out = bool(open_elements) and open_elements[-1][1]
        if m[1]:
            if names[name]:
                while True:
                    last = open_elements.pop()[0]
                    names[last] -= 1
                    if last == name:
                        break
                out = bool(open_elements) and open_elements[-1][1]
            yield "close", name, out
            continue
        inner = out or _never(name, m[3])
        yield "open", name, inner
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, out
        elif name not in VOID and (name in BLOCK or not m[3].rstrip().endswith("/")):
            open_elements.append((name, inner))
            names[name] += 1
            out = inner
    if at < len(page):
        yield "text", page[at:], out


def _never(name: str, attributes: str) -> bool:
    if name in OUTSIDE:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    hints = STRONG_HINTS if name in CONTENT else HINTS
    # Whole names: what "has-sidebar" or "entry-header" is called may well be the content.
    return any(hints.intersection(value.strip("\"'").lower().split()) for _, value in _NAMED.findall(attributes))


def _events(page: str) -> list[tuple[str, str, bool, bool]]:
    """``tokens`` with a fourth value: whether an ``article`` or ``main`` surrounds the token."""
    events, depth, site = [], 0, 0
    for kind, value, out in tokens(page):
        if kind == "open" and value == "header" and not depth:
            site += 1
        events.append((kind, value, out or site > 0, depth > 0))
        if kind == "close" and value == "header" and site:
            site -= 1
        if value in CONTENT and kind != "text":
            depth = max(0, depth + (1 if kind == "open" else -1))
    return events


class Weights:
    """Scores: a ``word``, a tag by its name, tags of a page's marked content (``calm``). What is in
    an element that is never content is left out anyway and only parts the text a little."""

    def __init__(self, word: float, calm: float, tags: dict[str, float], other: float, stray: float) -> None:
        self.word, self.calm, self.tags, self.other, self.stray = word, calm, tags, other, stray

    def of(self, kind: str, value: str, out: bool, content: bool) -> float:
        if kind == "text":
            return (self.stray if out else self.word) * len(value.split())
        if content or out:
            return self.calm if value not in CONTENT else self.tags[value]
        return self.tags.get(value, self.other)


def learn(pages: list[str]) -> Weights:
    """Weights from labelled pages: tags that stand at the border of the content or outside it cost
    as many words as stray text beside them has, those inside cost next to nothing."""
    inside: Counter[str] = Counter()
    beyond: Counter[str] = Counter()
    words = defaultdict(lambda: [1, 1])
    stray_runs: list[int] = []
    for page in pages:
        events = _events(page)
        if not any(e[3] for e in events):
            continue
        run = 0
        for kind, value, out, content in events:
            if kind == "text":
                n = len(value.split())
                words[out][content] += n
                run = 0 if content else run + n
            else:
                (inside if content else beyond)[value] += 1
                if run and value in BLOCK:
                    stray_runs.append(run)
                    run = 0
    # What stray text of a page weighs: nearly all of its runs are shorter than this.
    stray_runs.sort()
    reach = max(8, stray_runs[int(0.99 * (len(stray_runs) - 1))]) if stray_runs else 8
    tags = {}
    for name in {*inside, *beyond}:
        share = (beyond[name] + 0.5) / (inside[name] + beyond[name] + 1)
        tags[name] = -(0.01 + share * share * reach) if name in BLOCK else -0.01 - share
    for name in OUTSIDE | CONTENT:
        tags[name] = min(tags.get(name, 0.0), -float(reach))
    # Words by the odds that they are content, those of plain text being 1.
    plain, stray = (math.log(words[out][True] / words[out][False]) for out in (False, True))
    word = max(plain, 0.1)
    return Weights(1.0, -0.01, tags, -1.0, max(-0.2, min(-0.05, stray / word / 100)))


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of the highest sum; the first of several, shortest start;
    empty if no score is positive."""
    best, here, start, found = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if here <= 0:
            here, start = 0.0, i
        here += score
        if here > best:
            best, found = here, (start, i + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    """The main text: blocks joined by a line end, white space inside a block as one space."""
    events = _events(page)
    low, high = best_run([weights.of(*e) for e in events])
    blocks, parts = [], []
    for kind, value, out, _ in events[low:high]:
        if kind == "text":
            if not out:
                parts.append(html.unescape(value))
        elif value in BLOCK:
            blocks.append("".join(parts))
            parts = []
        elif value == "br":
            parts.append(" ")
    blocks.append("".join(parts))
    cleaned = (" ".join(b.split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


def train(pages: DataFrame, most: int = TRAINING_PAGES) -> Weights:
    """Weights from at most ``most`` labelled pages, chosen by a hash."""
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.octet_length("html") < 1 << 16))
    return learn([r.html for r in sample_rows(labelled, most).select("html").toLocalIterator()])


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``; empty if there is none or html is null.

    Without ``weights`` they are learned from the labelled ones among ``pages``. Rows may repeat;
    other columns stay; a column ``text`` is replaced; an empty table gives an empty table.
    """
    small_batches(pages.sparkSession)
    weights = weights or train(pages)
    pages = pages.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h or "", weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(run, f"{kinds}, text string")
