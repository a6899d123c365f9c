"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, each with the length of its text outside links. What stands in menus, page
headers and footers, sidebars, notices, adverts, forms and reader comments, by elements' names, roles and classes, counts as a line of
length 0 and is never text. Lengths are summed over sliding windows of lines. Text is kept from each line where the sum surges to the
line where it dives to 0, that is, where nothing but links and set-aside lines follows for a whole window:

* windows run over the lines of each outermost <article> or <main> by themselves, and over the lines outside of them;
* a sum surges if it reaches ``surge`` characters or, if none of the page does, the fullest sum of the page;
* inside <article> and <main> the text also reaches back from the surge to the last dive before it, a dive takes a whole window of lines,
  and text resumes after a dive within the same innermost <article>; elsewhere it resumes under the same parent as kept text;
* where text surges inside <article> or <main>, text outside of them is kept only if it is more than that.

An element is not set aside if the page's only <main>, or its only article with most of the text, stands in it, or if its class alone
(or <form>) would set most of the page's text aside; reader comments and hidden elements stay out whatever they hold.

Defined cases: null and empty pages give an empty text; markup that is cut off or badly nested is read as far as it goes; very long
pages are read whole; equal pages give equal texts; repeated rows stay repeated; null ids and URLs stay null; extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|</?[a-zA-Z][^>]*\Z|</?\Z""", re.S)
#: Elements whose content isn't text of the page.
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "head", "title", "object", "canvas", "audio", "video", "select", "textarea", "button", "datalist", "annotation", "annotation-xml"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "q", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp", "nobr", "source", "track", "link", "meta", "base", "area", "param", "embed", "col", "math", "mi", "mn", "mo", "ms", "mtext",
    "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mstyle", "mspace", "mpadded", "mphantom", "menclose", "merror", "mmultiscripts", "semantics",
}
_SPACE = {"br", "wbr", "img", "input"}
#: Elements without content.
_EMPTY = {"hr", "br", "wbr", "img", "input", "source", "track", "link", "meta", "base", "area", "param", "embed", "col"}
#: Elements that end where one of these elements begins, up to the elements that hold them.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
}
#: Their text is their parent's, as to where text resumes.
_PART = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption"}
_SIDE = {"nav", "aside", "footer", "form", "menu", "dialog"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
_SIDE_WORD = re.compile(
    r"(?:nav|navbar|navigation|menus?|sidebar|aside|ads?|adverts?|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookies?|notice|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription"
    r"|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus|reply|replies|breadcrumbs?|pagination|pager|search|form|widget|skip|toolbar|disclaimer|footer|topbar|masthead)",
    re.I,
)
_HEAD_CLASS = re.compile(r"(?:^|\s)(?:header|page-header|site-header)(?:$|\s)", re.I)
_READERS = re.compile(r"(?:comments?|commentlist|disqus|reply|replies)", re.I)
#: 'has-sidebar' says how a page is laid out; 'cookie-notice' and 'sidebar-left' are what they say.
_LAYOUT = {"has", "no", "with", "without", "is", "show", "hide", "not"}
_PLACE = {"area", "left", "right", "section", "box", "bar", "list", "links", "buttons", "container", "block", "top", "bottom", "primary", "secondary", "inner", "unit", "slot", "wrapper"}


def _side_words(value: str) -> list[str]:
    """The words by which a class or id names something that is not the article: a whole token, its head, or what stands at a place."""
    out = []
    for token in value.split():
        parts = [x for x in re.split(r"[_-]+", token) if x]
        if not parts or (len(parts) > 1 and parts[0].lower() in _LAYOUT):
            continue
        if _SIDE_WORD.fullmatch(parts[-1]):
            out.append(parts[-1])
        elif len(parts) > 1 and _SIDE_WORD.fullmatch(parts[0]) and parts[-1].lower() in _PLACE:
            out.append(parts[0])
    return out


#: Words by which an inline element is set aside.
_INLINE_SIDE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "share", "sharing"}
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?![\w-])""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _side_kind(name: str, attributes: str, in_article: bool) -> str:
    """'' (not set aside), 'hidden', 'element' (by element or role), 'readers' (reader comments), 'form' or 'class'."""
    kind = ""
    inline = name in _INLINE
    if name in _SIDE or (name == "header" and not in_article):
        kind = "form" if name == "form" else "element"
    if not attributes:
        return kind
    whole = name in ("body", "html", "article", "main")
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true" and not whole) or (key == "style" and _UNSEEN.search(value)):
            return "hidden"
        if kind or whole:
            continue
        if inline:
            if key in ("class", "id") and any(x.lower() in _INLINE_SIDE for x in value.split()):
                kind = "class"
        elif key == "role":
            if value.lower() in _ROLES:
                kind = "element"
        elif key in ("class", "id"):
            if words := _side_words(value):
                kind = "readers" if any(_READERS.fullmatch(x) for x in words) else "class"
            elif not in_article and _HEAD_CLASS.search(value):
                kind = "class"
    return kind


def _set_aside(regions: list[list], lines: list[tuple], surge: float) -> list[bool]:
    """Which of the elements that names or classes set aside stay so, now that the lengths of the lines are known."""
    chars, total, apart = [0] * len(regions), 0, True
    for line in lines:
        plain, inside, r = line[1], line[2], line[3]
        total += plain
        apart = apart and not (inside and r < 0)
        while r >= 0:
            chars[r] += plain
            r = regions[r][0]
    out: list[bool] = []
    for (parent, kind, articles, mains), n in zip(regions, chars, strict=True):
        most = 2 * n > total
        whole = apart and (mains or (articles and (kind == "form" or (most and kind != "readers"))))
        keep = kind != "hidden" and (whole or (kind in ("form", "class") and most and n >= surge))
        out.append((parent >= 0 and out[parent]) or not keep)
    return out


#: A line: text, length outside links (0 if set aside), whether set aside, outermost article or main (0: none), innermost article (0: none), parent.
Line = tuple[str, int, bool, int, int, object]


class _Open:
    """An open block element: its region (-1: none), article, container, number and the part of the page it stands for."""

    __slots__ = ("name", "region", "article", "container", "number", "parent")

    def __init__(self, name: str, region: int, article: int, container: int, number: int, parent: object):
        self.name, self.region, self.article, self.container, self.number, self.parent = name, region, article, container, number, parent


def lines_of(page: str, surge: float = 86) -> list[Line]:
    """The lines of a page, in its order."""
    out: list[tuple] = []
    parts: list[str] = []
    linked: list[str] = []
    root = _Open("", -1, 0, 0, 0, 0)
    stack: list[_Open] = [root]
    regions: list[list] = []  # outer region, kind, holds an article, holds main
    link = -1  # depth of the stack at which a link was opened
    mute, muted, mute_depth = "", 0, 0  # an inline element set aside, how deep its name is nested, depth of the stack
    opened = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            top = stack[-1]
            plain = len(text) - len(" ".join(html.unescape("".join(linked)).split())) if linked else len(text)
            out.append((text, max(plain, 0), top.container > 0, top.region, top.container, top.article, top.parent))
        parts.clear()
        linked.clear()

    def close(depth: int) -> None:
        nonlocal link, mute
        del stack[depth:]
        if link >= depth:
            link = -1
        if mute and mute_depth > len(stack):
            mute = ""

    at, raw_end = 0, {}
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not mute:
            parts.append(text)
            if link >= 0:
                linked.append(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                end = raw_end.setdefault(name, re.compile(rf"</{name}\b[^>]*(?:>|\Z)" + (r"|<body\b" if name in ("head", "title") else ""), re.I)).search(page, at)
                at = (end.start() if end[0][1:5].lower() == "body" else end.end()) if end else len(page)
            if not mute:
                parts.append(" ")
            continue
        if name in _INLINE:
            if mute == name:
                muted += -1 if closing else 1
                if not muted:
                    mute = ""
            elif not mute and not closing and attributes and name not in _EMPTY and _side_kind(name, attributes, True):
                mute, muted, mute_depth = name, 1, len(stack)
            elif name == "a":
                link = -1 if closing else len(stack)
            if name in _SPACE and not mute:
                parts.append(" ")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    close(i)
                    break
            continue
        if stack[-1].name == "p":
            close(len(stack) - 1)
        if name in _ENDS:
            ended, until = _ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in until:
                    break
                if stack[i].name in ended:
                    close(i)
        if name in _EMPTY or attributes.endswith("/"):
            continue
        top = stack[-1]
        region = top.region
        whole = name in ("article", "main")
        if whole:
            r = region
            while r >= 0:
                regions[r][2], regions[r][3], r = True, regions[r][3] or name == "main", regions[r][0]
        if kind := _side_kind(name, attributes, top.container > 0):
            regions.append([region, kind, False, False])
            region = len(regions) - 1
        opened += 1
        parent = opened if name not in _PART else (top.parent if top.name not in ("", "body", "html") else (top.parent, name))
        stack.append(_Open(name, region, opened if name == "article" else top.article, top.container or (opened if whole else 0), opened, parent))
    flush()
    aside = _set_aside(regions, out, surge)
    gone = [line[3] >= 0 and aside[line[3]] for line in out]
    return [(text, 0 if g else plain, g, container, article, parent) for (text, plain, _, _, container, article, parent), g in zip(out, gone, strict=True)]


def window_sums(lengths: np.ndarray, window: int) -> np.ndarray:
    """The sum of each line and the ``window`` - 1 lines after it."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    n = len(lengths)
    return total[np.minimum(np.arange(n) + window, n)] - total[:n]


def surges(lengths: np.ndarray, window: int, level: float, inside: bool) -> np.ndarray:
    """Which lines lie between a surge and the next dive of the window sums; ``inside`` an article also those back to the dive before
    it, and fewer lines than a window at the end are no dive."""
    sums = window_sums(lengths, window)
    n = len(lengths)
    keep = np.zeros(n, bool)
    i = 0
    while i < n:
        if sums[i] >= level and lengths[i]:
            start = i
            while inside and start and lengths[max(start - window, 0) : start].any() and not keep[start - 1]:
                start -= 1
            while i < n and sums[i] > 0:
                i += 1
            if inside and n - i < window:
                i = n
            keep[start:i] = True
        else:
            i += 1
    return keep


def main_text(page: str | None, window: int = 3, surge: float = 86) -> str:
    lines = lines_of(page or "", surge)
    lengths = np.array([x[1] for x in lines], np.int64)
    within = np.array([x[3] for x in lines], np.int64)
    places = [(c, np.flatnonzero(within == c)) for c in np.unique(within)]
    level = min(surge, max((window_sums(lengths[at], window).max() for _, at in places), default=0))
    keep = np.zeros(len(lines), bool)
    if level > 0:
        for c, at in places:
            keep[at] = surges(lengths[at], window, level, c > 0)
    # Text resumes where kept text stands.
    homes = {(x[3], x[4] or x[5]) for x, k in zip(lines, keep, strict=True) if k and x[1]}
    keep |= np.array([x[1] > 0 and (x[3], x[4] or x[5]) in homes for x in lines], bool)
    inside = within > 0
    if lengths[keep & inside].sum() and lengths[keep & inside].sum() >= lengths[keep & ~inside].sum():
        keep &= inside
    return "\n".join(x[0] for x, k in zip(lines, keep, strict=True) if k and not x[2])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, surge: float = 86) -> DataFrame:
    """Per row: id, url, text, n_chars. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), window, surge) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["_id", "_url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"_id {kinds['_id']}, _url {kinds['_url']}, text string, n_chars bigint").withColumnsRenamed({"_id": id_col, "_url": url_col})
