"""Main-text extraction from HTML by tag-path ratios.

A page's text nodes are grouped by the path of tags from the root to them (marks inside a line of text, such as ``b``, don't
count). For each path the text length outside links and the punctuation of any script are aggregated for each
occurrence; the cells of a table and the items of a list are one occurrence. The two ratios are fused as their geometric
mean, with a term added to the punctuation, so that text without marks scores low but not nothing; the same is done with
the ratios smoothed by a Gaussian over neighbouring blocks, and both are fused again. A path is content when the mean of
its blocks' score, less the share of links in it, reaches a threshold set from the page's mean and its best path. An
``article`` or ``main`` element raises the scores in it and lowers those outside by the share of the page's text that it
holds. Elements that name themselves as navigation, header, footer, advert, form, comment and so on weigh nothing; a
layout name on a wrapper of most of the text doesn't count. Headings go with the content that follows them.

Pages are judged each by itself, in the tasks. Defined results: a null or empty page and one without text blocks have an
empty text; rows that repeat are treated alike; broken markup is read leniently, an open tag at the end of a page is text
no longer.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import table

TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z",
    regex.I | regex.S,
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open element of the same kind (within the nearest container).
ENDS = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CONTAINER = frozenset("article aside body div footer form header html main nav ol section table ul dl blockquote".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog head label".split())
NAMES = regex.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|notices|alert|popup|modal|nav\w*|menu\w*|breadcrumbs?|side-?bar|footer|header|"
    r"masthead|comments?|respond|discussion|replies|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|login|search|tags|toolbar|pagination|pager|widget|legal|copyright)(?:$|[\s_-])",
    regex.I,
)
#: Names that stand for layout as well: on an element that holds most of the page's text they say nothing.
LAYOUT = regex.compile(r"(?:^|(?<=[\s_-]))(?:banner|notices?|alert|nav\w*|menu\w*|side-?bar|footer|header|masthead|social|search|tags|toolbar|widget|legal|copyright)(?=$|[\s_-])", regex.I)
ABOUT_OTHERS = regex.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|without)[-_]\S+", regex.I)
TOPIC = regex.compile(r"(?:^|(?<=\s))(?:tag|category)-\S+", regex.I)
HEADER = regex.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead)(?=$|[\s_-])", regex.I)
ATTRIBUTE = regex.compile(r"([a-z_:@][^\s=>\"'/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", regex.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
PUNCTUATION = regex.compile(r"[\p{Terminal_Punctuation}…]")
SPACE = regex.compile(r"\s+")
HEADING = regex.compile(r"h[1-6]$")
HREF = regex.compile(r"\bhref\s*=", regex.I)
CELLS = frozenset("td th li dt dd caption option".split())
RUNS = frozenset("table ul ol dl".split())
#: Added to the marks of a path.
NO_MARKS = 0.5


def _named_boilerplate(attrs: str, main: bool, tag: str = "") -> int:
    """Whether an element's class, id or role names it as something beside the text (2), or may do so if it isn't a wrapper
    of the text (1); an article may have its own header."""
    found = 0
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return 2
        if name in ("class", "id"):
            value = ABOUT_OTHERS.sub("", value)
            if tag == "article":
                value = TOPIC.sub("", value)
            value = HEADER.sub("", value) if main else value
            if NAMES.search(value):
                if NAMES.search(LAYOUT.sub("", value)):
                    return 2
                found = 1
    return found


def blocks(page: str) -> list[tuple[str, str, bool, int, int, int]]:
    """(path, text, boilerplate, number of its article or main element or 0, characters in links, number of its list or
    table or else of the block) of each block of text, in page order."""
    out: list[tuple[str, str, bool, int, int, int]] = []
    perhaps: list[tuple[int, ...]] = []  # for each block the open elements that are boilerplate unless they wrap the text
    # tag, boilerplate, article or main, whether it is in an article, list or table, elements with a layout name
    stack: list[tuple[str, bool, int, bool, int, tuple[int, ...]]] = []
    parts: list[str] = []
    linked, link, number = 0, -1, 0  # characters in links; depth at which a link opened

    def flush() -> None:
        nonlocal linked, number
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                tag, off, main, _, run, wraps = stack[-1] if stack else ("", False, 0, False, 0, ())
                number += 1
                out.append(("/".join(x[0] for x in stack), text, off, main, min(linked, len(text)), run if tag in CELLS and run else number))
                perhaps.append(wraps)
            linked = 0

    def cut(k: int) -> None:
        nonlocal link
        flush()
        del stack[k:]
        if k < link:
            link = -1

    def put(a: int, b: int) -> None:
        nonlocal linked
        parts.append(page[a:b])
        if link >= 0:
            linked += len(SPACE.sub(" ", entities.unescape(parts[-1])))

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            put(at, m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                link = len(stack) if not m["close"] and HREF.search(m["attrs"]) else -1
            continue
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
                if tag not in CONTAINER and stack[k][0] in CONTAINER:
                    flush()
                    break
            else:
                flush()
            continue
        flush()
        if tag in VOID:
            continue
        ends = ENDS.get(tag, "").split() or (["p"] if tag in CLOSES_P else [])
        if tag in CLOSES_P and "p" not in ends:
            ends.append("p")
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                cut(k)
                break
            if stack[k][0] in CONTAINER:
                break
        if HEADING.match(tag) and stack and HEADING.match(stack[-1][0]):
            cut(len(stack) - 1)
        _, off, main, article, run, wraps = stack[-1] if stack else ("", False, 0, False, 0, ())
        number += 1
        own = tag == "header" and main  # an article's own header holds its title
        wrap = tag == "form"
        off = off or tag in BOILERPLATE and not own and not wrap
        if tag not in ("html", "body", "main") and not off:
            named = _named_boilerplate(m["attrs"], bool(main) or tag == "article", tag)
            off, wrap = named == 2, wrap or named == 1
        if tag == "article" and not article or tag == "main" and not main:
            main = number
        stack.append((tag, off, main, article or tag == "article", number if tag in RUNS else run, (*wraps, number) if wrap and not off else wraps))
    if at < len(page):
        put(at, len(page))
    flush()
    if not any(perhaps):
        return out
    held: dict[int, list[int]] = {}
    total = 0
    for b, wraps in zip(out, perhaps, strict=True):
        if not b[2]:
            total += len(b[1]) - b[4]
            for w in wraps:
                held.setdefault(w, []).append(len(b[1]) - b[4])
    beside = {w for w, n in held.items() if len(n) < 2 or 2 * sum(n) <= total}
    return [(b[0], b[1], b[2] or not beside.isdisjoint(wraps), *b[3:]) for b, wraps in zip(out, perhaps, strict=True)]


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """A Gaussian over the neighbouring blocks, renormalised at the ends."""
    k = np.exp(-0.5 * (np.arange(-3, 4) / sigma) ** 2)
    if len(x) < 2:
        return x
    return np.convolve(x, k)[3:-3] / np.convolve(np.ones(len(x)), k)[3:-3]


def main_text(page: str | None, share: float = 0.25) -> str:
    """The content blocks of ``page``, joined by blank lines; ``share`` weighs the page's mean score in the threshold."""
    found = [b for b in blocks(page or "") if not b[2]]
    if not found:
        return ""
    paths: dict[tuple[int, str], list[int]] = {}
    for i, b in enumerate(found):
        paths.setdefault((b[3], b[0]), []).append(i)
    length = np.array([len(b[1]) for b in found], float)
    free = length - [b[4] for b in found]
    marks = np.array([len(PUNCTUATION.findall(b[1])) for b in found], float)
    by_path, unlinked = np.zeros((2, len(found))), np.zeros(len(found))
    for rows in paths.values():
        n = len({found[i][5] for i in rows})
        by_path[0, rows], by_path[1, rows] = free[rows].sum() / n, marks[rows].sum() / n
        unlinked[rows] = free[rows].sum() / length[rows].sum()
    near = np.sqrt(smooth(by_path[0]) * (smooth(by_path[1]) + NO_MARKS))
    fused = np.sqrt(np.sqrt(by_path[0] * (by_path[1] + NO_MARKS)) * near) * unlinked
    part: dict[int, float] = {}
    for b, n in zip(found, free.tolist(), strict=True):
        part[b[3]] = part.get(b[3], 0.0) + n / max(1.0, free.sum())
    part[0] = 0.0
    most = max(part.values())
    prior = {e: (1 + 15 * p * p) * (1 - 0.75 * (most - p)) for e, p in part.items()}
    score = {p: fused[rows].mean() for p, rows in paths.items()}
    best, mean = max(score.values()), float(fused.mean())
    least = share * mean + (1 - share) * min(mean, best / 4)
    content = {p for p, s in score.items() if s * prior[p[0]] >= least}
    keep = [(b[3], b[0]) in content for b in found]
    for i in range(len(found) - 2, -1, -1):
        if not keep[i] and keep[i + 1] and HEADING.search(found[i][0]):
            keep[i] = True
    return "\n\n".join(b[1] for b, k in zip(found, keep, strict=True) if k)


@F.pandas_udf(T.StringType())
def _main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text, na_action=None)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    rows = pages.select("page_id", "url", _main_text("html").alias("text"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
