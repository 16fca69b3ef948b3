"""The main text of raw web pages.

The standard library's parser streams events; block-level tags cut the page into lines.  Each line has a
text-to-tag ratio; the ratios are smoothed with a Gaussian and lines above a threshold cluster into content
regions.  The innermost element that holds most of the text clustered so gives the article (if it lies in an article or
main element, that one does): every line in it that no menu, notice, form or comment section holds, so that short
paragraphs stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import need, ready, texts

#: Width of the Gaussian in lines, and the threshold as a share of the ratios' standard deviation.
SIGMA, THRESHOLD = 1.0, 0.5
#: Share of the clustered text that the chosen element must hold.
HOLDS = 0.6

# fixed values: HTML element names
_RAW = frozenset("script style noscript template svg math iframe object embed canvas audio video head title".split())
_NOT_TEXT = frozenset("nav footer aside form button select textarea fieldset dialog menu input label option datalist".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("article main section div body td blockquote center".split())
#: Names in class, id or role that mark what is no article.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|foot\w*|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|subscribe\w*|newsletter|signup|login|search\w*|share\w*|sharing|social|related|recommend\w*|comments?|respond|replies|reply|disqus\w*|complementary|contentinfo|navigation|dialog|widget\w*|pagination|pager|skip\w*)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|page-?header|site-?header)(?:$|[\s_-])", re.I)
#: Of these, what may hold articles that are not the page's.
_OTHERS = re.compile(r"comment|respond|repl|disqus|related|recommend|side|widget|promo|sponsor", re.I)


class _Line:
    __slots__ = ("text", "tags", "linked", "path", "out")

    def __init__(self, text: str, tags: int, linked: int, path: tuple, out: bool):
        self.text, self.tags, self.linked, self.path, self.out = text, tags, linked, path, out


class _Lines(HTMLParser):
    """Turns events into lines: block text, tags met on the way, characters in links, enclosing elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[tuple[str, int, int]] = []  # name, own number, whether it is no article (2: articles in it neither)
        self.n = self.tags = self.linked = self.links = self.raw = 0
        self.head = False  # an open head, whose end tag may be missing
        self.buffer: list[str] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.lines.append(_Line(text, self.tags, self.linked, tuple((s[0], s[1]) for s in self.stack if s[0] in _CONTAINERS), any(s[2] for s in self.stack)))
        if text or self.tags > 8:
            self.tags = 0
        self.buffer, self.linked = [], 0

    def _close(self, upto: int) -> None:
        self._flush()
        del self.stack[upto:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in _RAW:
            if tag != "head" or not self.head:
                self.raw += tag not in _VOID
            self.head |= tag == "head"
            return
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.buffer.append(" ")
        if tag not in _BLOCKS:
            if tag in _NOT_TEXT and tag not in _VOID:
                self._flush()
                self._open(tag, attrs)
            return
        self._flush()
        self.links = 0
        if self.head:  # the first block ends it
            self.raw, self.head = max(0, self.raw - 1), False
        if tag == "body":
            self.raw = 0
        if tag in ("article", "main"):  # nothing that was left open before it holds the page's article
            for k, (_, _, out) in enumerate(self.stack):
                if out == 1:
                    self._close(k)
                    break
        for k in range(len(self.stack) - 1, -1, -1):  # what this tag ends by itself
            name = self.stack[k][0]
            if name == "p" or name == tag == "li" or (name in ("dt", "dd") and tag in ("dt", "dd")) or (name == tag and tag in ("tr", "td", "th", "option")) or (re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", tag)):
                self._close(k)
            break
        if tag not in _VOID:
            self._open(tag, attrs)

    def _open(self, tag: str, attrs: list) -> None:
        self.n += 1
        inside = any(s[0] in ("article", "main") for s in self.stack)
        out = 2 if tag == "aside" else int(tag in _NOT_TEXT or (tag == "header" and not inside))
        if not out and attrs and tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if value and (name in ("class", "id", "role") and (_MARKED.search(value) or (not inside and _HEADER.search(value)))):
                    out = 2 if _OTHERS.search(value) else 1
                elif name in ("hidden", "aria-hidden") and value != "false":
                    out = 2
        self.stack.append((tag, self.n, out))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _RAW:  # has no end tag
            self.tags += 1
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _RAW:
            if tag != "head" or self.head:
                self.raw = max(0, self.raw - 1)
            self.head &= tag != "head"
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in _BLOCKS or tag in _NOT_TEXT:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    self._close(k)
                    return
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.buffer.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def smooth(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; the kernel is renormalised at either end."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def content_lines(lines: list[_Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> list[bool]:
    """Lines whose smoothed text-to-tag ratio reaches the threshold."""
    ratios = [0.0 if x.out else max(0, len(x.text) - 2 * x.linked) / max(1, x.tags) for x in lines]
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    level = min(threshold * spread, max(ratios) / 2)
    return [s >= level and not x.out for s, x in zip(smooth(ratios, sigma), lines, strict=True)]


def chosen_scope(lines: list[_Line], mass: dict[tuple, int], total: int) -> set[tuple] | None:
    """The elements that hold the article, from the clustered text in each: the innermost that holds most of it.

    Tags only refine the choice: inside an article or main element all of that element is meant, and where several
    articles share the text, all of those that have some of it.  None: no element holds enough.
    """
    inner = [e for e in mass if mass[e] >= HOLDS * total]
    if inner:
        best = max(inner, key=lambda e: e[1])
        path = next(x.path for x in lines if best in x.path)
        around = [e for e in path[: path.index(best) + 1] if e[0] in ("article", "main")]
        if around:
            return {around[-1]}
    several = {e for e in mass if e[0] == "article"}
    if sum(mass[e] for e in several) >= HOLDS * total:  # that lie side by side
        return several
    return {best} if inner else None


def main_text(html: str) -> str:
    """The article of a page; the empty text if there is none.  Lines are joined by a newline."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines or all(x.out for x in lines):
        return ""
    content = content_lines(lines)
    mass: dict[tuple, int] = {}
    total = 0
    for x, c in zip(lines, content, strict=True):
        if c:
            total += len(x.text)
            for element in x.path:
                mass[element] = mass.get(element, 0) + len(x.text)
    if not total:
        return ""
    scope = chosen_scope(lines, mass, total)
    held = [not x.out and (scope is None or not scope.isdisjoint(x.path)) for x in lines]
    if scope is None or next(iter(scope))[0] not in ("article", "main"):
        # no element says where the article ends: from the first content line (and a heading before it) to the last
        first = next(i for i, c in enumerate(content) if c and held[i])
        last = max(i for i, c in enumerate(content) if c and held[i])
        first -= first > 0 and held[first - 1] and not lines[first - 1].linked
        held = [h and first <= i <= last for i, h in enumerate(held)]
    return "\n".join(x.text for x, h in zip(lines, held, strict=True) if h)


def extract_text(pages: DataFrame, html_col: str = "html", *, text_col: str = "text") -> DataFrame:
    """``pages`` with the main text instead of the html, and n_chars, its code points.

    A null or empty page, and one without an article, gives the empty text; an empty table gives no rows.  Broken and cut-off markup is read
    as far as it goes.  Columns named ``text_col`` or n_chars are replaced; others stay; repeated rows repeat.
    """
    need(pages, html_col)
    ready(pages.sparkSession)
    more = [T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())]
    out = T.StructType([f for f in pages.schema.fields if f.name not in (html_col, text_col, "n_chars")] + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [main_text(t) for t in texts(b.column(b.schema.get_field_index(html_col)))]
            new = {text_col: pa.array(made, pa.string()), "n_chars": pa.array([len(t) for t in made], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else b.column(b.schema.get_field_index(f.name)) for f in out.fields], names=out.names)

    return pages.mapInArrow(run, out)
