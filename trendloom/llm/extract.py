"""Main text of web pages by tree scoring.

Each block of text earns points for its length and commas and passes them on to its ancestors; a container's sum is discounted
by its link density. The best container is kept, widened to the article element around it, together with those
siblings that look like text as well. Menus, adverts, forms, comments and the like never count and never come out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from trendloom.llm.textkit import batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody tfoot thead title tr ul".split()
)
CELLS = frozenset(["br", "td", "th", "img"])
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input iframe object svg canvas math "
    "menu dialog noembed noframes audio video map search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promos promotion sponsor sponsored sponsors sidebar "
    "sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice "
    "notices notification alert newsletter subscribe subscription signup popup modal overlay paywall share sharing social "
    "related recommended recommendations comment comments disqus respond replies reactions widget widgets pagination pager "
    "toolbar login skip".split()
)
HEADER_NAMES = frozenset(["header", "heading"])
CONTENT_NAMES = frozenset("article body content entry main page post story text title".split())
STATE_NAMES = frozenset("has no with without is open closed".split())
#: Elements that a class or id never drops.
KEPT = frozenset(["html", "body", "main", "article"])
#: A start tag closes these open elements, up to the given boundary.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
ROOMY = frozenset("div section article main body td th li blockquote center form fieldset html details figure".split())
LEAST_TEXT = 25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def _is_dropped(tag: str, rest: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    names: set[str] = set()
    if "=" in rest or "hidden" in rest:
        for key, *values in ATTRIBUTE.findall(rest):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id"):
                names.update(x.lower() for x in NAME.findall(unescape(value)))
            elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
                return True
            elif key == "role" and DROPPED_ROLES & set(value.lower().split()):
                return True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
    if tag == "header":
        return not in_article
    if tag in KEPT or not names or names & STATE_NAMES:
        return False
    return bool(names & DROPPED_NAMES) or bool(names & HEADER_NAMES) and not names & CONTENT_NAMES and not in_article


class Page:
    """Nodes of a page in page order, each with its parent; texts with the node and the block they stand in."""

    def __init__(self, html: str):
        self.tags, self.parents, self.dropped = ["#"], [0], [False]
        self.texts: list[tuple[int, int, str]] = []
        self._article = [False]
        self._open, self._block = [0], 0
        self._names: Counter[str] = Counter()  # open tags by name, so that no walk looks for one that is not open
        self._read(html)

    def _text(self, raw: str) -> None:
        if raw:
            self.texts.append((self._open[-1], self._block, unescape(raw) if "&" in raw else raw))

    def _close(self, depth: int) -> None:
        if any(self.tags[n] in BLOCKS for n in self._open[depth:]):
            self._block += 1
        self._names.subtract(self.tags[n] for n in self._open[depth:])
        del self._open[depth:]

    def _start(self, tag: str, rest: str) -> None:
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            for depth in range(len(self._open) - 1, 0, -1) if any(self._names[t] for t in ends) else ():
                if self.tags[self._open[depth]] in bounds:
                    break
                if self.tags[self._open[depth]] in ends:
                    self._close(depth)
                    break
        elif tag in BLOCKS:
            for depth in range(len(self._open) - 1, 0, -1) if self._names["p"] else ():
                name = self.tags[self._open[depth]]
                if name == "p":
                    self._close(depth)
                    break
                if name in BLOCKS or name in CELLS:
                    break
        if tag in BLOCKS:
            self._block += 1
        if tag in CELLS:
            self.texts.append((self._open[-1], self._block, " "))
        if tag in VOID:
            return
        parent = self._open[-1]
        in_article = self._article[parent] or tag in ("article", "main")
        self.tags.append(tag)
        self.parents.append(parent)
        self._article.append(in_article)
        self.dropped.append(self.dropped[parent] or _is_dropped(tag, rest, in_article))
        self._open.append(len(self.tags) - 1)
        self._names[tag] += 1

    def _read(self, html: str) -> None:
        at = 0
        while True:
            cut = html.find("<", at)
            if cut < 0:
                break
            found = TOKEN.match(html, cut)
            if not found:
                self._text(html[at : cut + 1])
                at = cut + 1
                continue
            self._text(html[at:cut])
            at = found.end()
            ending, tag, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if tag is None:
                continue
            tag = tag.lower()
            if ending:
                for depth in range(len(self._open) - 1, 0, -1) if self._names[tag] > 0 else ():
                    if self.tags[self._open[depth]] == tag:
                        self._close(depth)
                        break
                continue
            self._start(tag, rest)
            if tag in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
        self._text(html[at:])

    def blocks(self) -> list[tuple[int, int, str]]:
        """(node of the first text, nearest block element, collapsed text) of every block that is not dropped."""
        out, k = [], 0
        while k < len(self.texts):
            node, block, _ = self.texts[k]
            pieces, first = [], None
            while k < len(self.texts) and self.texts[k][1] == block:
                if not self.dropped[self.texts[k][0]]:
                    if first is None and not self.texts[k][2].isspace():
                        first = self.texts[k][0]
                    pieces.append(self.texts[k][2])
                k += 1
            text = " ".join("".join(pieces).split())
            if text:
                owner = first
                while owner and self.tags[owner] not in BLOCKS and self.tags[owner] not in ("td", "th"):
                    owner = self.parents[owner]
                out.append((first, owner, text))
        return out

    def link_share(self) -> list[float]:
        total, linked = [0] * len(self.tags), [0] * len(self.tags)
        in_link = [False] * len(self.tags)
        for n in range(1, len(self.tags)):
            in_link[n] = in_link[self.parents[n]] or self.tags[n] == "a"
        for node, _, text in self.texts:
            if not self.dropped[node]:
                size = len(text.strip())
                total[node] += size
                linked[node] += size * in_link[node]
        for n in range(len(self.tags) - 1, 0, -1):
            total[self.parents[n]] += total[n]
            linked[self.parents[n]] += linked[n]
        return [b / a if a else 0.0 for a, b in zip(total, linked)]


def main_text(html: str | None) -> str:
    """Text of the best container and its siblings; blocks in page order, joined by an empty line. Null gives ''."""
    if not html:
        return ""
    page = Page(html)
    blocks = page.blocks()
    if not blocks:
        return ""
    points = [0.0] * len(page.tags)
    for _, owner, text in blocks:
        if len(text) < LEAST_TEXT:
            continue
        earned = 1 + text.count(",") + min(len(text) // 100, 3)
        node = owner if page.tags[owner] in ROOMY else page.parents[owner]
        for share in (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
            points[node] += earned * share
            if not node:
                break
            node = page.parents[node]
    share = page.link_share()
    points = [p * (1 - s) for p, s in zip(points, share)]
    best = max(range(len(points)), key=lambda n: (points[n], -n))
    chosen = {best if points[best] > 0 else 0}
    if points[best] > 0 and best:
        around = best
        while around and page.tags[around] not in ("article", "main"):
            around = page.parents[around]
        if around:
            chosen = {around}
        else:
            least = max(10.0, 0.2 * points[best])
            size = [0] * len(page.tags)
            for _, owner, text in blocks:
                size[owner] += len(text)
            chosen |= {
                n
                for n in range(1, len(page.tags))
                if page.parents[n] == page.parents[best] and not page.dropped[n]
                and (points[n] >= least or size[n] >= 80 and share[n] < 0.25
                     or page.tags[n] in ("h1", "h2", "h3") and share[n] < 0.25)
            }
    inside = [0 in chosen] * len(page.tags)
    for n in range(1, len(page.tags)):
        inside[n] = inside[page.parents[n]] or n in chosen
    return "\n\n".join(text for node, _, text in blocks if inside[node])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    Null or empty html gives an empty text; null ids and urls pass through; repeated rows give repeated rows; other columns
    are ignored. One narrow pass: a page is parsed where it was read, and memory is bounded by the longest page.
    """

    def parse(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(
        parse, f"page_id {kinds['page_id']}, url string, text string, n_chars long"
    )
