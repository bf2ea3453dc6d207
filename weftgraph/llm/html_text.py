"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from weftgraph.llm.common import bounded_batches, without

#: Elements whose content is never text of the page, up to their end tag.
RAW = frozenset("script style noscript template title textarea iframe object svg math canvas audio video select xmp noembed noframes".split())
#: Elements outside the main text.
ASIDE = frozenset("nav footer aside form button dialog menu head fieldset".split())
#: Elements that do not begin a new line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers: a border of one is an empty line of the distribution.
BLOCKS = frozenset("div section article main table tbody thead tr td th ul ol dl center header body html".split())
#: Words that name, in class, id or role, an element outside the main text...
NOISE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations comment comments disqus replies respond pagination pager toolbar login search contentinfo complementary alert".split())
#: ... if nothing but these stands beside them: "share-buttons" is noise, "share-price" is not.
BESIDE = frozenset("a and area bar block body bottom box btn button buttons by column container content footer form global header icons inner item items left link links list main media more nav outer page panel post posts article articles primary reader right secondary section side site slot small sticky text the thread title to top unit user users widget wrap wrapper".split())
#: These name a page's header, unless they stand in the article.
HEADER = frozenset(["header", "head", "site header", "page header", "main header", "global header", "top header"])
_TAG = re.compile(r"""<(?:!--(?P<comment>)|(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<other>[!?/])[^>]*>?)""")
_BROKEN = re.compile(r"<(?P<end>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>[^>]*)>?")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")


def is_noise(name: str) -> bool:
    """Whether one name of an element, such as a class, says that it is outside the main text."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w in NOISE for w in words) and all(w in NOISE or w in BESIDE for w in words)


def _outside(rest: str, article: bool) -> bool:
    """Whether an element's attributes say that it is hidden or outside the main text."""
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            for name in value.split():
                if is_noise(name) or not article and " ".join(_WORDS.findall(name)).lower() in HEADER:
                    return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return True
    return False


class _Lines:
    """Lines of a page outside of noise, with their characters inside links and the innermost article or main element that
    they are in (0: none); a line of no characters is the border of a container."""

    def __init__(self, page: str):
        self.rows: list[tuple[str, int, int]] = []
        self.marks: list[tuple[str, int]] = [("", 0)]  # name of an article or main element, and the one around it
        self.parts: list[str] = []
        self.link = 0
        stack: list[tuple[str, int, bool]] = []  # open element, mark, noise
        state = (0, False)
        at, n, links = 0, len(page), 0
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                self.parts.append(page[at:lt])
                self.link += (lt - at) * links
            if lt == n:
                break
            m = _TAG.match(page, lt) or _BROKEN.match(page, lt)
            if not m:
                self.parts.append("<")
                at = lt + 1
                continue
            at = m.end()
            got = m.groupdict()
            if got.get("comment") is not None:
                close = page.find("-->", at)
                at = n if close < 0 else close + 3
                continue
            if not got["name"]:
                continue
            name = got["name"].lower()
            if name == "a":
                links = 0 if got["end"] else 1
            if name not in INLINE:
                self._line(*state)
            if got["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if name in INLINE and stack[k][1:] != state:
                            self._line(*state)
                        noise = stack[k][2]
                        del stack[k:]
                        state = stack[-1][1:] if stack else (0, False)
                        if name in BLOCKS:
                            self._border(state[0], noise)
                        break
                continue
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = n if close is None else close.end()
                continue
            if name in VOID:
                continue
            mark, noise = state
            inside = any(self.marks[k][0] == "article" for k in self.around(mark))
            if name in ASIDE or name == "header" and not inside:
                noise = True
            elif got["rest"] and name not in ("html", "body", "main") and _outside(got["rest"], inside):
                noise = True
            if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            if name in BLOCKS:
                self._border(mark, noise)
            if name in ("article", "main") and not noise:
                self.marks.append((name, mark))
                mark = len(self.marks) - 1
            if (mark, noise) != state:
                self._line(*state)
                state = (mark, noise)
            stack.append((name, mark, noise))
        self._line(*state)

    def around(self, mark: int) -> list[int]:
        """A mark and those around it, from the innermost on."""
        out = []
        while mark:
            out.append(mark)
            mark = self.marks[mark][1]
        return out

    def _border(self, mark: int, noise: bool) -> None:
        if not noise:
            self.rows.append(("", 0, mark))

    def _line(self, mark: int, noise: bool) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text and not noise:
                self.rows.append((text, self.link, mark))
            self.parts, self.link = [], 0


def surges(sizes: np.ndarray, width: int, least: float) -> np.ndarray:
    """Which lines lie between a surge and a dive of the line-block distribution.

    A block is the sum of sizes over `width` lines. The distribution surges at a line with text whose block, from it
    on, reaches `least`, and dives before a block of nothing; lines that end in a block, up to them, of less than `least` are
    cut off again. Lines next to those kept, with nothing empty between, belong to them: headings and short last lines.
    """
    n = len(sizes)
    inside = np.zeros(n, bool)
    if not n:
        return inside
    total = np.concatenate([[0], np.cumsum(sizes)])
    ahead = total[np.minimum(np.arange(n) + width, n)] - total[:-1]
    back = total[1:] - total[np.maximum(np.arange(n) + 1 - width, 0)]
    i = 0
    while i < n:
        if not sizes[i] or ahead[i] < least:
            i += 1
            continue
        j = i
        while j < n and ahead[j] > 0:
            j += 1
        end = j
        while end > i + 1 and (not sizes[end - 1] or back[end - 1] < least):
            end -= 1
        while i > 0 and sizes[i - 1]:
            i -= 1
        while end < n and sizes[end]:
            end += 1
        inside[i:end] = True
        i = max(j, end)
    return inside


def main_text(page: str | None, width: int = 3, least: int = 80, share: float = 0.1, most_links: float = 0.5, weight: int = 3) -> str:
    """Text between surge and dive points of a page's lines.

    Lines of noise are left out first; lines made of links and borders of containers weigh nothing, lines in an article or
    main element `weight` times their characters. A surge takes blocks of `least` characters and `share` of the page's
    greatest block. If the heaviest stretch between surge and dive is in an article or main element, stretches
    outside of all of these go, and the articles (else the main elements) with a line between surge and dive are kept
    whole. Where nothing surges, all that weighs something is kept.
    """
    found = _Lines(page or "")
    lines = found.rows
    n = len(lines)
    sizes = np.array([0 if link > most_links * len(t) else len(t) * (weight if mark else 1) for t, link, mark in lines], np.int64)
    marks = np.array([mark for *_, mark in lines], np.int64)
    blocks = np.convolve(sizes, np.ones(width, np.int64)) if n else sizes
    inside = surges(sizes, width, max(least, share * blocks.max(initial=0)))
    if not inside.any():
        inside[:] = True
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    heaviest = max(zip(edge[::2], edge[1::2], strict=True), key=lambda e: sizes[e[0] : e[1]].sum(), default=(0, 0))
    keep = inside & (sizes > 0)
    at = sizes[heaviest[0] : heaviest[1]] > 0
    if (marks[heaviest[0] : heaviest[1]][at] > 0).any():
        keep &= marks > 0
        chain = {m: found.around(m) for m in set(marks.tolist())}
        kind = "article" if any(found.marks[k][0] == "article" for m in set(marks[keep].tolist()) for k in chain[m]) else "main"
        whole = {k for m in set(marks[keep].tolist()) for k in chain[m] if found.marks[k][0] == kind}
        keep |= (sizes > 0) & np.array([any(k in whole for k in chain[m]) for m in marks.tolist()])
    return " ".join(t for (t, *_), ok in zip(lines, keep, strict=True) if ok)


@arrow_udf(StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points) added: each page's main text.

    Markup, scripts, menus, headers, footers, sidebars, notices, adverts, forms and reader comments go;
    character references are decoded, white space within a line becomes one blank and lines are joined in page
    order by one blank. Null or empty pages, and pages without main text, give the empty text. Unclosed
    comments and scripts reach to the page's end; cut-off tags are dropped. Of stretches of equal weight the first is the
    heaviest. Repeated rows and other columns stay; columns with the added names are replaced.
    """
    bounded_batches(pages)
    pages = without(pages, "text", "n_chars")
    kept = [F.col(f"`{c}`") for c in pages.columns]
    out = pages.withColumn("text", _main_text(F.col("html")))
    return out.select(*kept, "text", F.char_length("text").cast("long").alias("n_chars"))
