"""Main text of web pages by a tree-structured graphical model.

Nodes are the block elements of a page (inline elements belong to the block they stand in). Each
has a hidden label, content or not. A parent and its child share a potential, each node has one
of its own from its tag, class and id words, link share, text length and punctuation. All are
counted on labelled pages. Sum-product messages pass up from the leaves and down from the root;
what blocks with a content marginal above one half hold is the text.

Labelled pages are of two kinds: a few layouts written for this purpose (LAYOUTS, with labels),
and a bounded sample of the given pages, about SAMPLE_PAGES, that mark their article themselves
(`article`, `main`, or an article role); pages without such a mark do not train. Words of class
and id attributes are hashed into a fixed number of buckets, so the model has a fixed size.
Pages are read whole, one at a time, in Arrow batches; nothing is shuffled for them.

Defined cases: null or empty html gives an empty text; a page cut short, unclosed or unknown
tags are read as far as they go; repeated rows and null ids are pages of their own; a marginal
of exactly one half is not content; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 400
WORD_BUCKETS = 4096
SMOOTHING = 0.5
#: How often each written layout counts beside the sampled pages.
LAYOUT_WEIGHT = 10
#: Features of one block say much the same; their sum counts only so much.
FEATURE_WEIGHT = 0.6
_MILLION = 1_000_000

# fixed sets of HTML element names
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label
mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr audio canvas object video math
mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder mstyle mspace semantics""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg head title iframe select option button textarea".split())
CLOSES_PARAGRAPH = frozenset("""address article aside blockquote details div dl fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul""".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
                 "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DOCTYPE_WITH_INNER = re.compile(r"<!doctype[^>\[]*\[.*?\]\s*>", re.I | re.S)
LIST_LIKE = frozenset("ul ol dl table menu".split())
CONTAINERS = frozenset("root html body div section article main table tbody tr td form aside header footer nav center".split())


#: Words of attributes and tags that never belong to an article, even inside it.
ASIDE_TAGS = frozenset("nav header footer aside form menu dialog".split()) | SILENT
ASIDE_WORDS = frozenset("""ad ads advert advertisement banner sponsored promo comment comments respond disqus
cookie consent notice newsletter subscribe share sharing social related sidebar breadcrumb breadcrumbs
pagination pager footer nav navigation menu popup modal""".split())
ARTICLE_WORDS = frozenset("articlebody main".split())


class Page(HTMLParser):
    """Block elements in page order with their attributes, and text runs with their block."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.words, self.parents, self.gold = ["root"], [[]], [-1], [False]
        self.runs: list[tuple[int, str, bool]] = []  # block, text, whether in a link
        self.open: list[tuple[str, int]] = [("root", 0)]  # tag and block of the open elements
        self.now = Counter()  # open elements by tag
        self.silent = 0
        self.feed(html)
        self.close()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Conditional and unknown sections are comments, as in browsers."""
        if self.rawdata[i:i + 9].upper() == "<![CDATA[" and (end := self.rawdata.find("]]>", i)) >= 0:
            return end + 3
        return self.rawdata.find(">", i) + 1 or -1

    def parse_html_declaration(self, i: int) -> int:
        """A document type ends after its own declarations."""
        inner = DOCTYPE_WITH_INNER.match(self.rawdata, i)
        return inner.end() if inner else super().parse_html_declaration(i)

    def _pop(self, at: int) -> None:
        for tag, _ in self.open[at:]:
            self.now[tag] -= 1
            self.silent -= tag in SILENT
        del self.open[at:]

    def _close(self, tags: set[str] | frozenset[str], until: frozenset[str]) -> None:
        """Close the nearest open element of `tags`, unless one of `until` stands in between."""
        if not any(self.now[tag] for tag in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in tags:
                self._pop(at)
                return
            if tag in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br" or tag == "hr":
            self.runs.append((self.open[-1][1], "\n", False))
        if tag in VOID:
            return
        if tag in CLOSES_PARAGRAPH:
            self._close({"p"}, frozenset(CLOSES_PARAGRAPH - {"p"}))
        if tag in CLOSES_ITSELF:
            self._close(CLOSES_ITSELF[tag], LIST_LIKE)
        if tag == "body":
            self._close({"head"}, frozenset())
        block = self.open[-1][1]
        if tag not in INLINE:
            values = dict(attrs)
            named = " ".join(values.get(k) or "" for k in ("class", "id", "role", "itemprop"))
            self.tags.append(tag)
            self.words.append(re.findall("[a-z]+", named.lower()))
            self.parents.append(block)
            self.gold.append("data-gold" in values)
            block = len(self.tags) - 1
        self.open.append((tag, block))
        self.now[tag] += 1
        self.silent += tag in SILENT

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not self.now[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                self._pop(at)
                return
            if tag in INLINE and name not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.runs.append((self.open[-1][1], data, self.now["a"] > 0))


def node_features(page: Page) -> list[list[str]]:
    """What each block shows of itself: tag, attribute words, length, links, punctuation."""
    size, linked, marks = [0] * len(page.tags), [0] * len(page.tags), [0] * len(page.tags)
    for block, text, in_link in page.runs:
        length = len(text.strip())
        size[block] += length
        linked[block] += length * in_link
        marks[block] += sum(map(text.count, ".,;:!?"))
    for i in range(len(page.tags) - 1, 0, -1):
        up = page.parents[i]
        size[up] += size[i]
        linked[up] += linked[i]
        marks[up] += marks[i]
    found = []
    for i, tag in enumerate(page.tags):
        share = linked[i] / size[i] if size[i] else 0.0
        own = [f"tag {tag}", f"under {page.tags[page.parents[i]] if i else '-'} {tag}",
               f"long {min(12, size[i].bit_length())}", f"links {math.ceil(4 * share)}",
               f"marks {min(4, 200 * marks[i] // (size[i] + 1) // 2)}",
               f"aside {not ASIDE_WORDS.isdisjoint(page.words[i])}"]
        own += [f"word {zlib.crc32(w.encode()) % WORD_BUCKETS}" for w in set(page.words[i])]
        found.append(own)
    return found


def own_labels(page: Page) -> list[bool] | None:
    """Labels from a page's own markup, None where it marks no article."""
    label, marked = [False] * len(page.tags), False
    for i in range(1, len(page.tags)):
        aside = page.tags[i] in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(page.words[i])
        starts = page.tags[i] in ("article", "main") or not ARTICLE_WORDS.isdisjoint(page.words[i])
        label[i] = not aside and (starts or label[page.parents[i]])
        marked |= starts
    return label if marked else None


def _layouts() -> list[str]:
    """Small pages of common layouts; data-gold marks the elements that are content."""
    text = "This is a paragraph of the article, with several sentences. It goes on for a while, and ends here."
    links = "".join(f'<li><a href="/{i}">Entry {i}</a></li>' for i in range(6))
    body = f"<h1 data-gold>The title of it</h1><p data-gold>{text}</p><p data-gold>{text} {text}</p>" \
           f"<h2 data-gold>A part</h2><p data-gold>{text}</p><ul data-gold><li data-gold>{text}</li></ul>" \
           f"<blockquote data-gold><p data-gold>{text}</p></blockquote><p data-gold>Short.</p>"
    comments = f'<div class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>{text}</p></div>' \
               f'<ol class="comment-list"><li class="comment"><p>Nice, thanks.</p></li></ol></div>'
    form = '<form class="search"><label>Search</label><input name="q"></form>' \
           f'<form class="newsletter subscribe"><p>Subscribe to our newsletter, {text}</p></form>'
    notice = f'<div class="cookie-notice consent banner" role="alert"><p>We use cookies. {text}</p></div>'
    advert = f'<div class="ad advert sponsored"><p>{text}</p></div><div class="ads promo">Buy it now.</div>'
    side = f'<aside class="sidebar widget"><h3>Related</h3><ul>{links}</ul><p>{text}</p></aside>'
    head = f'<header class="site-header"><h1>Site</h1><p>{text}</p></header><nav class="menu"><ul>{links}</ul></nav>'
    foot = f'<footer class="site-footer"><p>(c) Site. {text}</p><ul>{links}</ul></footer>'
    return [
        f"<body>{head}{notice}<main data-gold><article data-gold>{body}{advert}</article>{comments}</main>{side}{foot}</body>",
        f'<body>{head}<div class="page"><div class="content" id="content" data-gold>{body}</div>'
        f'<div class="sidebar" id="sidebar"><ul>{links}</ul><p>{text}</p></div></div>{comments}{form}{foot}</body>',
        f'<body>{notice}{head}<div class="post entry" data-gold><div class="entry-content" data-gold>{body}</div>'
        f'<div class="share social"><a href="/s">Share</a></div></div>{side}{advert}{comments}{form}{foot}</body>',
        f'<body><div class="nav navigation breadcrumb"><a href="/">Home</a> <a href="/x">Part</a></div>'
        f'<section data-gold>{body}</section><section class="comments">{comments}</section>'
        f'<div class="related"><ul>{links}</ul></div><div class="popup modal notice"><p>{text}</p></div>'
        f'<div class="footer"><p>All rights reserved. {text}</p></div></body>',
        f"<body>{form}<table data-gold><tr data-gold><td data-gold>{body}</td><td class='sidebar'><ul>{links}</ul></td>"
        f"</tr></table>{foot}</body>",
    ]


def _count(pages: Iterator[tuple[Page, list[bool]]]) -> Counter:
    """Counts of (kind, label, what): features by label, child labels by parent label."""
    counts: Counter = Counter()
    for page, label in pages:
        for i, own in enumerate(node_features(page)):
            y = int(label[i])
            counts[("node", y, "")] += 1
            for name in own:
                counts[("feature", y, name)] += 1
            if i:
                counts[("pair", int(label[page.parents[i]]), f"{page.tags[i] in CONTAINERS} {y}")] += 1
    return counts


class Model:
    """`unary`: log potential of a feature, content against not. `pair`[container][parent][child]:
    how labels follow each other, for children that hold blocks and for those that hold text."""

    def __init__(self, counts: Counter):
        total = [counts[("node", y, "")] + 2 * SMOOTHING for y in (0, 1)]
        names = {what for kind, _, what in counts if kind == "feature"}
        self.unary = {name: math.log((counts[("feature", 1, name)] + SMOOTHING) / total[1])
                      - math.log((counts[("feature", 0, name)] + SMOOTHING) / total[0]) for name in names}
        self.pair = {}
        for container in (False, True):
            seen = [[counts[("pair", parent, f"{container} {y}")] + SMOOTHING for y in (0, 1)] for parent in (0, 1)]
            self.pair[container] = [[n / sum(row) for n in row] for row in seen]

    def own(self, page: Page) -> list[float]:
        """Log potential of each block from what it shows of itself."""
        return [FEATURE_WEIGHT * sum(self.unary.get(name, 0.0) for name in names) for names in node_features(page)]

    def link(self, page: Page, i: int) -> list[list[float]]:
        return self.pair[page.tags[i] in CONTAINERS]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every block: messages to the root, then back to the leaves.

        Messages are ratios content : not, so nothing under- or overflows on large pages.
        """
        n = len(page.tags)
        below = [math.exp(max(-30.0, min(30.0, x))) for x in self.own(page)]
        below[0] = 0.0  # the page as a whole is not content
        up = [1.0] * n
        for i in range(n - 1, 0, -1):
            r, pair = below[i], self.link(page, i)
            up[i] = (pair[1][0] + pair[1][1] * r) / (pair[0][0] + pair[0][1] * r)
            j = page.parents[i]
            below[j] = min(max(below[j] * up[i], 1e-200 if j else 0.0), 1e200)
        full = below[:]
        for i in range(1, n):
            rest, pair = full[page.parents[i]] / up[i], self.link(page, i)
            down = (pair[0][1] + pair[1][1] * rest) / (pair[0][0] + pair[1][0] * rest)
            full[i] = min(max(below[i] * down, 1e-200), 1e200)
        return [r / (1 + r) for r in full]


def main_text(html: str, model: Model) -> str:
    page = Page(html)
    content = [p > 0.5 for p in model.marginals(page)]
    pieces, last = [], None
    for block, text, _ in page.runs:
        if content[block]:
            if block != last:
                pieces.append(" ")
            pieces.append(text)
        last = block
    return " ".join("".join(pieces).split())


def training_counts(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Counter:
    """Counts over the written layouts and about `sample_pages` of the given pages."""
    counts: Counter = Counter()
    written = [Page(html) for html in _layouts()]
    for key, n in _count((page, page.gold) for page in written).items():
        counts[key] += LAYOUT_WEIGHT * n
    readable = pages.where(F.col("html").isNotNull())
    total = readable.count()
    if not total:
        return counts
    draw = F.pmod(F.xxhash64("html"), F.lit(_MILLION))
    chosen = readable.where(draw < min(_MILLION, -(-sample_pages * _MILLION // total))).select("html")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = ((page, own_labels(page)) for page in map(Page, batch["html"]))
            found = _count((page, label) for page, label in read if label is not None)
            yield pd.DataFrame([(*key, n) for key, n in found.items()],
                               columns=["kind", "label", "what", "n"])

    summed = chosen.mapInPandas(rows, "kind string, label int, what string, n long").groupBy(
        "kind", "label", "what").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        counts[(r.kind, r.label, r.what)] += r.n
    return counts


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text of every page."""
    counts = training_counts(pages, sample_pages)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(counts)
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"],
                                "text": [main_text(html, model) if html else "" for html in batch["html"]]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(
        rows, "page_id long, url string, text string")
