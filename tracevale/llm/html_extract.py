"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores 1. A tag scores 0 or less: the more often it stands outside the
article in labelled pages, and the more words follow it there, the less. One linear scan finds the contiguous region with
the greatest sum. Elements that are never text (scripts, styles, menus, forms, adverts, comments and so on) give no words,
wherever they stand, with all that is in them, articles too. An element is also one of these if its class, id or role names
one, as a whole name (or by all its parts: gdpr-consent); of the names that also stand for ordinary parts of a text (social, header, widget), only if the scores
of its links outweigh its words. A name that only has such a word in it (has-sidebar, post-header) makes a tag of its own kind,
with a score; in pages with an article, such an element outside of it also costs as much as it has words. The region's words,
block by block, are the text. A dropped element that is never closed ends before the next article, main part or body.

Labelled pages are pages that mark their main text with one <article> element; at most `sample` of them are used. Where
there are none, lists of links still count against a region, by default scores.

Defined cases: a null or empty html, or one without words, gives an empty text; tags may be unclosed or cut off; a `<`
that starts no tag is text; ties go to the longer region. Repeated rows give equal texts. Other columns aren't read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import hash_sample

#: Elements whose content isn't a page's text, elements that are part of a line, and void elements.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg canvas object button select textarea dialog menu title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in the class, id or role of elements whose content isn't a page's text.
MARKED = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe teaser teasers toolbar widget".split())
#: Those of them that also stand for ordinary parts, and elements whose end tag may be left out.
EITHER = frozenset("header share sharing social toolbar widget".split())
OPEN_ENDED = frozenset("dd dt li option p td th tr".split())
#: Fixed value: the score of a start tag with such a word in a longer name, if labelled pages have none of its name.
MARKED_SCORE = -10.0
#: Scores of tags where no page is labelled; lists of links cost more than their words bring.
DEFAULT = {"a": -3.0, "/a": -3.0, "li": -2.0, "ul": -2.0, "option": -3.0, "td": -1.0}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^<>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][\w:-]*)([^<>]*)(?:>|\Z)""", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
ROOTS = frozenset(("article", "main", "body"))


class _Part:
    """A text or tag of a page: its words, and for a start tag the marked words in its names and where its element ends."""

    __slots__ = ("end", "marks", "name", "partly", "start", "text", "words")

    def __init__(self, text: str | None = None, name: str = "", start: bool = False, rest: str = ""):
        self.text, self.name, self.start, self.end = text, name, start, None
        self.words = len(text.split()) if text else 0
        names = {w for x in NAMES.findall(rest) for w in x.strip("\"'").lower().split()} if rest and start else ()
        split = [{x for x in PARTS.split(w) if x and not x.isdigit()} for w in names]
        self.marks = frozenset().union(*(x for x in split if x <= MARKED))
        self.partly = any(x & MARKED for x in split)


def _parts(page: str) -> list[_Part]:
    out, open_, at = [], defaultdict(list), 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append(_Part(page[at : m.start()]))
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        start = not (m[2] or m[5])
        if start and name not in VOID:
            open_[name].append(len(out))
        elif not start and open_[name]:
            out[open_[name].pop()].end = len(out)
        out.append(_Part(None, name, start, (m[4] if m[3] else m[7]) or ""))
    if at < len(page):
        out.append(_Part(page[at:]))
    return out


class _Page:
    """A page's parts, with running sums, so that what is in an element costs no walk through it."""

    def __init__(self, page: str):
        self.parts = _parts(page)
        self.words = [0, *accumulate(p.words for p in self.parts)]
        self.score = [0.0, *accumulate(p.words + (DEFAULT.get(p.name, 0.0) if p.start else 0.0) for p in self.parts)]
        self.roots = [i for i, p in enumerate(self.parts) if p.start and p.name in ROOTS]

    def end(self, i: int) -> int:
        """Where the element that starts at `i` ends; one that is never closed, before the next main part."""
        own = self.parts[i]
        if own.end is not None:
            return own.end + 1
        k = bisect_right(self.roots, i)
        last = self.roots[k] if k < len(self.roots) else len(self.parts)
        if own.name in OPEN_ENDED:  # or before the next of its kind, or with what it stands in
            for j in range(i + 1, last):
                p = self.parts[j]
                if p.start and p.name == own.name or not p.start and p.text is None and p.name not in INLINE and p.name not in OPEN_ENDED:
                    return j
        return last

    def holds_root(self, i: int, end: int) -> bool:
        k = bisect_left(self.roots, i)
        return k < len(self.roots) and self.roots[k] < end


def tokens(page: str) -> Iterator[tuple[str, str, bool, float]]:
    """(kind, value, dropped, cost): text as written, and tags by name, with a / in front of the end tag's and a . behind a name with a marked word in a longer one."""
    of = _Page(page)
    whole = any(p.name == "article" and p.start for p in of.parts)
    until = inside = 0
    for i, p in enumerate(of.parts):
        if p.text is not None:
            yield "text", p.text, i < until, 0.0
            continue
        if i < until:
            yield "tag", ("" if p.start else "/") + p.name, True, 0.0
            continue
        cost = 0.0
        if p.start and p.name not in VOID:
            end = of.end(i) if p.marks or p.partly or p.name in DROPPED or p.name == "header" else i
            drop = p.name in DROPPED or p.name == "header" and not inside or p.name not in ("main", "body") and bool(p.marks - EITHER)
            if drop or p.marks and p.name not in ROOTS and of.score[end] - of.score[i] <= 0:
                until = end
                yield "tag", p.name, True, 0.0
                continue
            if p.partly and whole and not inside and not of.holds_root(i, end):
                cost = -float(of.words[end] - of.words[i])
        if p.name == "article":
            inside = max(0, inside + (1 if p.start else -1))
        yield "tag", ("" if p.start else "/") + p.name + ("." if p.partly else ""), False, cost


def learn(pages: list[str]) -> dict[str, float]:
    """Scores of tags from labelled pages."""
    seen, outside, after = defaultdict(int), defaultdict(int), defaultdict(list)
    for page in pages:
        last, inside = "", False
        for kind, value, dropped, _ in tokens(page):
            if kind == "tag":
                if not dropped:
                    inside = value.strip(".") == "article" or inside and value != "/article"
                last = value
                seen[value] += 1
                outside[value] += not inside and value != "/article"
            elif last and not inside:
                after[last].append(len(value.split()))
    # so many words that few tags have more behind them; a single odd page doesn't count
    most = {t: sorted(n)[int(0.98 * (len(n) - 1))] for t, n in after.items()}
    return {t: -round(outside[t] / n * (1 + 2 * most.get(t, 0)), 3) for t, n in seen.items() if outside[t] or t.endswith(".")}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region of a page."""
    units: list[tuple[float, str | None]] = []  # score, and the text of a block's part or None for a block's end
    for kind, value, dropped, cost in tokens(page or ""):
        if kind == "tag":
            name = value.strip("/.")
            units.append((cost + weights.get(value, MARKED_SCORE if value.endswith(".") else 0.0), " " if name == "br" else "" if name in INLINE else None))
        elif not dropped:
            value = html.unescape(value)
            units.append((float(len(value.split())), value))
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, (score, _) in enumerate(units):
        total += score
        if total < 0:
            total, start = 0.0, i + 1
        elif total >= best[0] and total > 0:
            best = (total, start, i + 1)
    blocks: list[list[str]] = [[]]
    for _, text in units[best[1] : best[2]]:
        if text is None:
            blocks.append([])
        else:
            blocks[-1].append(text)
    return "\n\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def tag_weights(pages: DataFrame, sample: int = 400, largest: int = 1 << 18) -> dict[str, float]:
    """Scores from at most `sample` labelled pages of up to `largest` bytes, taken by a hash of their html; DEFAULT if there are none."""
    labelled = pages.select("html").where((F.octet_length("html") <= largest) & (F.regexp_count("html", F.lit("(?i)<article[ >]")) == 1) & (F.regexp_count("html", F.lit("(?i)</article>")) == 1))
    found = learn([r[0] for r in hash_sample(labelled, sample, "html").limit(sample).toLocalIterator()])
    return found or dict(DEFAULT)


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = tag_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
