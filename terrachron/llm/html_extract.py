"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SKIPPED = frozenset("script style noscript template nav header footer aside form button select textarea svg canvas iframe object head title menu dialog".split())
RAW = frozenset(["script", "style"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What may stand in a head; the start of any other element, and text, closes it.
HEAD = frozenset("base link meta noscript object script style template title".split())
#: Tags whose start closes an open p.
ENDS_P = (BLOCK | {"dialog", "menu"}) - {"br", "html"}
#: Tags that a start of the same tag closes.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|banners?|promos?|sponsor(?:ed)?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|comments?|disqus|respond|"
    r"cookies?|consent|notices?|alerts?|popups?|modals?|newsletters?|subscribe|share|sharing|social|related|footers?|headers?|masthead|widgets?|pagination|pager|login|search|toolbar|skip-link|copyright|disclaimer)(?=$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form toolbar".split())
MAIN = frozenset(["article", "main"])
CONTAINERS = SKIPPED | MAIN | {"html", "body", "div", "section", "table", "ul", "ol", "td"}
#: Elements that may be a region of the page.
REGIONS = MAIN | frozenset("html body div section center table td ul ol dl".split())
#: What a character in an article or main element counts for; the ratio still decides between regions.
MARKED = 8
#: Share of the heaviest region's selected text under which another is left out; a single line needs more.
WEAK, WEAK_LINE = 0.1, 0.5
#: A region of several lines with this share of its text in links is a menu.
LINKED = 0.8
UNFINISHED = re.compile(r"<(?:[!?]|/?[A-Za-z])")


class _Events(HTMLParser):
    """Blocks of visible text, (text, its characters outside links, tags since the block before, region, whether marked), and the tree of regions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # tag, whether it starts chrome, region around it
        self.at: dict[str, list[int]] = {}  # where each tag is open
        self.walls: list[int] = []  # where containers are open
        self.chrome, self.marked, self.links, self.tags = 0, 0, 0, 0
        self.region, self.above = 0, [-1]
        self.text: list[str] = []
        self.plain = 0
        self.blocks: list[tuple[str, int, int, int, bool]] = []

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, min(self.plain, len(text)), self.tags, self.region, self.marked > 0))
            self.tags = 0
        self.text.clear()
        self.plain = 0

    def last(self, tag: str) -> int:
        return (self.at.get(tag) or (-1,))[-1]

    def close_from(self, at: int) -> None:
        while len(self.open) > at:
            self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        head = self.last("head")
        if tag == "body" and head >= 0:
            self.close_from(head + 1)
        if tag not in HEAD and head >= 0 and head == len(self.open) - 1:
            self._pop()
        if tag in ENDS_P and self.last("p") > (self.walls[-1] if self.walls else -1):
            self.close_from(self.last("p"))
        closes = SELF_CLOSING.get(tag)
        if closes and self.open and self.open[-1][0] in closes:
            self._pop()
        if tag in VOID:
            return
        a = {k: v or "" for k, v in attrs}
        chrome = tag not in ("html", "body") and (
            tag in SKIPPED or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or (tag not in MAIN or "comment" in (a.get("class", "") + a.get("id", "")).lower()) and bool(CHROME.search(f"{a.get('class', '')} {a.get('id', '')}"))
        )
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in CONTAINERS:
            self.walls.append(len(self.open))
        self.open.append((tag, chrome, self.region))
        self.chrome += chrome
        self.marked += tag in MAIN
        self.links += tag == "a"
        if tag in REGIONS:
            self.above.append(self.region)
            self.region = len(self.above) - 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        at = self.last(tag)
        if at < 0 or tag not in CONTAINERS and self.walls and self.walls[-1] > at:
            return  # the end tag of a phrase doesn't close a container
        self.close_from(at)

    def _pop(self) -> None:
        tag, chrome, region = self.open.pop()
        self.at[tag].pop()
        if tag in CONTAINERS:
            self.walls.pop()
        self.chrome -= chrome
        self.marked -= tag in MAIN
        self.links -= tag == "a"
        self.region = region

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._pop()
        if not self.chrome and not (self.open and self.open[-1][0] in RAW):
            self.text.append(data)
            if not self.links:
                self.plain += len(data)

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections, and declarations that aren't known, end at the next ``>``, as in browsers."""
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def read(self, html: str) -> None:
        """All of a page; a comment or tag that never ends hides the rest, and what the parser can't read ends the page."""
        try:
            self.feed(html)
            if not UNFINISHED.match(self.rawdata):
                self.close()
        except AssertionError:
            pass
        self.cut()


def _smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means of neighbouring lines."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[cut] / np.convolve(np.ones(len(ratio)), kernel)[cut]


def content_blocks(html: str, sigma: float = 1.5, share: float = 0.5) -> list[str]:
    """The blocks of the page's content regions, in page order.

    Each block is a line of the page; its text-to-tag ratio is its code points outside links over the tags since the
    line before. The ratios are smoothed by a Gaussian of ``sigma`` lines, and lines from their standard deviation on,
    at most ``share`` of their maximum, are selected. From the whole page down, the region that holds the selected text
    is entered as long as all beside it is weak (see WEAK); text in an article or main element counts MARKED times.
    Where several regions hold selected text, each is kept whole, so that headings and short paragraphs stay; lists of
    links in them are left out.
    """
    p = _Events()
    p.read(html)
    blocks = p.blocks
    if not blocks:
        return []
    ratio = np.array([plain / max(1, tags) for _, plain, tags, _, _ in blocks])
    smooth = _smoothed(ratio, sigma)
    picked = smooth >= min(ratio.std(), share * smooth.max())
    n = len(p.above)
    mass, lines, chars, linked = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for (text, plain, _, region, marked), on in zip(blocks, picked):
        mass[region] += on * plain * (MARKED if marked else 1)
        lines[region] += 1
        chars[region] += len(text)
        linked[region] += len(text) - plain
    below: list[list[int]] = [[] for _ in range(n)]
    for r in range(n - 1, 0, -1):  # a region comes after the one around it
        for total in (mass, lines, chars, linked):
            total[p.above[r]] += total[r]
        if lines[r]:
            below[p.above[r]].append(r)
    menu = (lines >= 3) & (linked >= LINKED * chars)
    here, kept = 0, None
    while kept is None:
        inner = [r for r in below[here] if not menu[r]]
        top = max(inner, key=lambda r: mass[r], default=0)
        direct = mass[here] - sum(mass[r] for r in below[here])
        strong = [r for r in inner if mass[r] > 0 and mass[r] >= (WEAK if lines[r] > 1 else WEAK_LINE) * mass[top]]
        if not mass[top]:
            kept = None if len(inner) == 1 and not direct and lines[inner[0]] == lines[here] else inner
            here = inner[0] if kept is None else here
        elif len(strong) == 1 and direct < WEAK * mass[top] and (lines[top] > 1 or lines[here] == 1 or mass[here] == mass[top]):
            here = top
            kept = [] if not below[top] else None
        else:
            kept = inner if lines[top] == 1 or direct >= WEAK * mass[top] else strong
    inside = np.zeros(n, dtype=bool)
    inside[[here, *kept]] = True
    for r in range(1, n):
        inside[r] |= p.above[r] != here and inside[p.above[r]]
        inside[r] &= not (menu[r] and r != here)
    return [text for text, _, _, region, _ in blocks if inside[region]]


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with its html replaced by ``text`` and its code points ``n_chars``.

    Rows are kept one to one; other columns pass through, but an own column of the name ``text`` or ``n_chars`` is
    replaced. Null or empty html, and pages without content, give an empty text and 0. Pages are streamed in Arrow
    batches; no shuffle.
    """
    keep = [c for c in pages.columns if c.lower() not in {html.lower(), text.lower(), n_chars.lower()}]
    schema = pages.select(*keep).schema.add(text, "string").add(n_chars, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [" ".join(content_blocks(h)) if h else "" for h in b.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], [*keep, text, n_chars])

    return pages.select(*keep, html).mapInArrow(run, schema)
