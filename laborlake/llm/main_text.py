"""Main text of web pages by tag-path ratios.

1. A page is cut into blocks: the text between two block-level tags, inline tags and line breaks apart. Each block has the
   path of the block elements around it, root first, with their ids and classes; an element that nothing names is told
   from its like by its number among them, paragraphs and other ends of a path apart. Elements that are no content by
   their kind (navigation, forms, scripts, styles ...), their role or the words of their class and id make no blocks.
2. Text length, punctuation and link text are aggregated per path. A path's length ratio (characters a block),
   punctuation ratio and share of plain text are fused into one.
3. The ratios' mass is smoothed over the tree of paths: each element weighs what its paths weigh together. From the root
   the way goes down as long as one element below holds ``SHARE`` of the weight, to an article at most, and never past
   a heading. The element where it ends is the content.
4. Of its paths, those pass that are mostly plain text, or whose fused ratio reaches ``LEAST`` of the best one's.

A page is one row, and everything about it is decided there, so pages need no shuffle, however many a host has, and a
lost executor costs its own rows. Elements are closed as HTML says: a paragraph ends before the next block, and what was
never closed ends with what is around it.

Defined results: null or empty html, and pages without content, have an empty text of 0 characters; repeated pages have
one row each; very long and deeply nested pages take time in proportion to their length; truncated tags, comments and
scripts end with the page; an empty table gives no row. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the weight that leads further down; share of link text up to which a path passes; share of the best ratio.
SHARE, MOST_LINKS, LEAST = 0.8, 0.7, 0.3

#: A comment; a tag (its slash, name and attributes); other markup. Quoted values may hold ``>``.
MARKUP = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟،]")


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


VOID = _names("area base br col embed hr img input link meta param source track wbr")
#: Their content is text up to their own end tag; none of it is shown.
RAW = _names("script style title textarea xmp iframe noembed noframes noscript")
BLOCK = _names(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul"
)
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
#: Elements whose text is no content, by kind, by role, and by a word of their class or id.
APART = _names(
    "nav footer aside form menu button select datalist dialog search template svg math object canvas audio video map "
    "option optgroup label fieldset legend input applet"
)
ROLES = _names("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist note status")
WORDS = _names(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead topbar header footer foot sidebar rail aside widget widgets "
    "notice notices cookie cookies consent gdpr banner alert ad ads adv advert adverts advertisement advertisements advertising adsense "
    "sponsor sponsored sponsors promo promos promotion promotions popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus "
    "pagination pager copyright colophon toolbar hidden"
)
#: Before one of the words above they say that the element only has, or has not, or is the head of, such a thing.
HAS, OF_ARTICLE = _names("has with no without non"), _names("article post entry story content")
#: What a start tag closes: open elements of the first kind, looked for up to one of the second.
LISTS, TABLES = _names("ul ol menu dir"), _names("table")
CLOSES = {
    "li": (_names("li"), LISTS), "dt": (_names("dt dd"), _names("dl")), "dd": (_names("dt dd"), _names("dl")),
    "tr": (_names("tr td th"), TABLES), "td": (_names("td th"), TABLES | {"tr"}), "th": (_names("td th"), TABLES | {"tr"}),
    "thead": (_names("thead tbody tfoot tr td th"), TABLES), "tbody": (_names("thead tbody tfoot tr td th"), TABLES),
    "tfoot": (_names("thead tbody tfoot tr td th"), TABLES), "option": (_names("option"), _names("select")),
}
#: An end tag doesn't reach beyond these, its own kind apart.
WALLS = _names("td th caption table button")


def words_of(name: str) -> list[str]:
    """Words of a class or id: cut at signs and where small letters end."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", name)]


def _is_apart(tag: str, given: dict[str, str], in_article: bool) -> bool:
    if tag in APART or (tag == "header" and not in_article) or "hidden" in given:
        return True
    if given.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "")):
        return True
    if tag in ("article", "main"):
        return False
    for name in f"{given.get('class', '')} {given.get('id', '')}".split():
        found = words_of(name)
        for k, word in enumerate(found):
            if word in WORDS and not HAS.intersection(found[:k]):
                if word == "header" and (in_article or OF_ARTICLE.intersection(found)):
                    continue
                return True
    return False


class Page:
    """Blocks of a page (text, path, characters in links) and the tree of paths (parent, tag)."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self._known, self._like = [-1], ["body"], {}, {}
        self.texts: list[str] = []
        self.paths: list[int] = []
        self.links: list[int] = []
        # Open elements: tag, path (None: inline), apart, in an article. Numbers of open elements by tag.
        self._open: list[tuple[str, int | None, bool, bool]] = []
        self._count: dict[str, int] = {}
        self._path, self._apart, self._article, self._in_link = 0, False, False, 0
        self._pieces: list[tuple[str, bool]] = []
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at = 0
        while found := MARKUP.search(source, at):
            self._say(source[at : found.start()])
            at = found.end()
            if name := found[2]:
                tag = name.lower()
                if found[1]:
                    self._end(tag)
                else:
                    self._start(tag, found[3])
                    if tag in RAW:
                        over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
                        at = over.start() if over else len(source)
        self._say(source[at:])

    def _say(self, text: str) -> None:
        if text and not self._apart:
            self._pieces.append((html.unescape(text), self._in_link > 0))

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(t for t, _ in self._pieces).split())
            if text:
                self.texts.append(text)
                self.paths.append(self._path)
                self.links.append(sum(len("".join(t.split())) for t, linked in self._pieces if linked))
            self._pieces = []

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "head", "body") or tag in RAW:
            return
        if tag == "br":
            self._say(" ")
            return
        if tag in BLOCK:
            self._flush()
            if self._count.get("p"):
                self._close({"p"}, WALLS)
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        if tag in VOID:
            return
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        apart = self._apart or _is_apart(tag, given, self._article)
        if apart and not self._apart:
            self._flush_inline(tag)
        path = self._below(tag, given) if tag in BLOCK and not apart else None
        self._open.append((tag, path, apart, self._article or tag == "article"))
        self._count[tag] = self._count.get(tag, 0) + 1
        self._now(tag == "a", 1)

    def _flush_inline(self, tag: str) -> None:
        """What is taken out of a line leaves a blank."""
        if tag not in BLOCK:
            self._say(" ")

    def _below(self, tag: str, given: dict[str, str]) -> int:
        named = f"{given.get('id', '')}.{'.'.join(sorted(given.get('class', '').split()))}"
        step = f"{tag}#{named}"
        if named == "." and tag in ("div", "section", "td", "ul", "ol", "table", "dl", "center"):
            key = (self._path, tag)
            self._like[key] = self._like.get(key, 0) + 1
            step = f"{tag}[{self._like[key]}]"
        key = (self._path, step)
        if key not in self._known:
            self._known[key] = len(self.parent)
            self.parent.append(self._path)
            self.tag.append(tag)
        return self._known[key]

    def _now(self, link: bool, step: int) -> None:
        """State after a change at the end of the open elements."""
        self._in_link += step if link else 0
        if self._open:
            _, path, self._apart, self._article = self._open[-1]
            if path is not None:
                self._path = path
        else:
            self._path, self._apart, self._article = 0, False, False

    def _drop(self) -> None:
        tag, path, _, _ = self._open.pop()
        self._count[tag] -= 1
        if path is not None:
            self._path = self.parent[path]
        self._now(tag == "a", -1)

    def _close(self, kinds: frozenset[str] | set[str], walls: frozenset[str]) -> None:
        """Close the outermost open element of these kinds inside the innermost wall, and what stands in it."""
        if not any(self._count.get(k) for k in kinds):
            return
        last = None
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] in kinds:
                last = k
            elif self._open[k][0] in walls or (last is not None and self._open[k][0] in BLOCK):
                break
        if last is not None:
            while len(self._open) > last:
                self._drop()

    def _end(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self._flush()
        if tag == "br":
            self._say(" ")
        if not self._count.get(tag):
            return
        for k in range(len(self._open) - 1, -1, -1):
            other = self._open[k][0]
            if other == tag or (tag in HEADINGS and other in HEADINGS):
                was_apart = self._apart
                while len(self._open) > k:
                    self._drop()
                if was_apart and not self._apart:
                    self._flush_inline(tag)
                return
            if not block and other in BLOCK:  # an inline end tag doesn't close blocks; the element just ends
                self._forget(tag)
                return
            if block and other in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return

    def _forget(self, tag: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                if not self._open[k][2]:
                    del self._open[k]
                    self._count[tag] -= 1
                    self._in_link -= tag == "a"
                return


def content(page: Page) -> list[str]:
    """The blocks that belong to the main text, in page order."""
    if not page.texts:
        return []
    paths, n = np.array(page.paths), len(page.parent)
    length = np.array([len(t) for t in page.texts], float)
    blocks = np.bincount(paths, minlength=n)
    some = np.maximum(blocks, 1)
    chars = np.bincount(paths, length, n)
    marks = np.bincount(paths, [len(PUNCTUATION.findall(t)) for t in page.texts], n)
    linked = np.minimum(np.bincount(paths, page.links, n) / np.maximum(chars, 1), 1)
    fused = chars / some * (1 + marks / some) * (1 - linked) ** 2
    weight = fused * blocks
    below: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):  # a path comes after the one above it
        weight[page.parent[k]] += weight[k]
        below[page.parent[k]].append(k)
    top = 0
    while page.tag[top] not in ("article", "main") and weight[top] > 0:
        heaviest = max(below[top], key=lambda k: weight[k], default=None)
        leads = heaviest is not None and weight[heaviest] >= SHARE * weight[top] and (below[heaviest] or page.tag[heaviest] in ("article", "main"))
        if not leads or any(page.tag[k] in HEADINGS for k in below[top]):
            break
        top = heaviest
    inside = np.zeros(n, bool)
    inside[top] = True
    for k in range(top + 1, n):
        inside[k] = inside[page.parent[k]]
    passes = inside & ((linked <= MOST_LINKS) | (fused >= LEAST * fused.max(initial=0, where=inside)))
    return [t for t, p in zip(page.texts, page.paths) if passes[p]]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(content(Page(source.as_py() or ""))) for source in batch.column("html")]
        yield pa.record_batch(
            {
                "page_id": batch.column("page_id"), "url": batch.column("url"),
                "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (page_id, url, html)."""
    given = pages.selectExpr("cast(page_id as long) AS page_id", "cast(url as string) AS url", "html")
    return given.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")
