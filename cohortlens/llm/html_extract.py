"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags negative; the weights are log ratios of how often
a kind of token stands inside and outside the main text of labelled pages.  Scripts, menus, footers and such never hold an article.  Forms
and elements whose class or id names adverts, comments, notices and the like are kinds of their own, by what else the name says and by whether
they hold most of the page's prose; labelled pages decide which of those kinds count as outside, where words score as tags do.  A linear
scan finds the contiguous region of the highest sum.  It then grows over neighbouring text blocks of the same
container, which a short last paragraph needs, and its blocks without what is outside are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .page_labels import PAGES

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")

#: Elements of HTML by how they lay out or what they hold.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
TEXT_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "dl", "dd", "dt", "figure", "figcaption", "table", "tbody", "tr", "td", "th"}
ENDS_P = BLOCK - {"body", "html", "head", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "figcaption", "summary"}
OUTSIDE = {"nav", "footer", "aside", "button", "select", "option", "input", "svg", "canvas", "object", "video", "audio", "template", "menu", "dialog", "head", *RAW}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar"}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal",
    "overlay", "comment", "comments", "disqus", "reply", "replies", "respond", "newsletter", "subscribe", "signup", "login", "search", "share", "sharing", "social",
    "related", "recommended", "trending", "pagination", "pager", "toolbar", "disclaimer",
}
HOLDERS = {"html", "body", "main", "article"}
#: Words of class names that say that an element holds an article or a part of one, and words that say nothing.
CONTENT = {"content", "article", "post", "entry", "main", "story", "body", "text", "page", "news", "blog"}
NEUTRAL = {"list", "area", "section", "box", "wrap", "wrapper", "container", "item", "items", "block", "inner", "outer", "thread", "bar", "top", "bottom", "left", "right", "row", "col", "column", "links", "form"}
#: Open elements that a start tag ends, where no other block lies between.
IMPLIED = {"li": {"li", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}}
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE | re.ASCII) for name in RAW}


def _outside(name: str, attrs: str, in_article: bool) -> bool:
    """Whether the element is never part of an article, whatever its class."""
    if name in OUTSIDE or (name == "header" and not in_article):
        return True
    if not attrs or name in HOLDERS:
        return False
    for m in _NAMES.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "role" and value in ROLES:
            return True
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


def _mark(name: str, attrs: str, in_article: bool) -> str:
    """What the element's name, class and id say: '' nothing, 'pure' of marks alone, 'mixed' of marks and other words; a form is mixed."""
    told = "mixed" if name == "form" else ""
    if not attrs or name in HOLDERS:
        return told
    for m in _NAMES.finditer(attrs):
        if m[1].lower() not in ("class", "id"):
            continue
        marks, others = set(), set()
        for one in (m[2] or "").strip("\"'").lower().split():
            words = set(_WORD.findall(one))
            if words & {"has", "with", "no"}:  # such as has-sidebar, on what holds the article too
                continue
            if "header" in words and not in_article and not words & CONTENT:
                marks.add("header")
            marks |= words & MARKS
            others |= words - MARKS - NEUTRAL - {"header"}
        if marks and not others:
            return "pure"
        if marks:
            told = "mixed"
    return told


class Token:
    """A tag, or the text between two; kind is its weight's class, where that of the marked elements around it, if any."""

    __slots__ = ("block", "box", "kind", "n", "out", "owner", "text", "where")

    def __init__(self, kind: str, n: int, out: bool, block: bool, box: int, text: str | None, owner: int = -1):
        self.kind, self.n, self.out, self.block, self.box, self.text, self.owner, self.where = kind, n, out, block, box, text, owner, ""


def tokens(page: str) -> list[Token]:
    """Tags and texts in order.  ``box`` numbers the container around a token's text block; ``block`` is where a block begins or ends."""
    found: list[Token] = []
    stack: list[tuple[str, bool, int, int, int]] = []  # name, whether outside, box, place of the innermost block, innermost marked element
    marked: list[tuple[str, int]] = []  # what a marked element's names say, and the one around it
    opened: Counter[str] = Counter()
    links, articles, boxes, at, size = 0, 0, 0, 0, len(page)

    def text(piece: str) -> None:
        n = len(piece.split())
        if n or piece:
            out, box, owner = (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, 0, -1)
            found.append(Token("linked" if links else "word", n, out, False, box, piece, owner))

    def close(to: int) -> None:
        nonlocal links, articles
        while len(stack) > to:
            name = stack.pop()[0]
            opened[name] -= 1
            links -= name == "a"
            articles -= name == "article"

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends = bool(m[1] or m[4])
        block = name in BLOCK
        if ends:
            if opened[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                out, box, owner = stack[i][1], stack[i][2], stack[i][4]
                close(i)
                found.append(Token("/" + name if block or name == "a" else "/inline", 1, out, block, box, None, owner))
            continue
        attrs = m[3] or m[6] or ""
        ended = IMPLIED.get(name, {"p"} if name in ENDS_P else ())
        while ended and stack and stack[-1][3] >= 0 and stack[stack[-1][3]][0] in ended:
            close(stack[-1][3])
        parent = stack[-1] if stack else ("", False, 0, -1, -1)
        out, owner = parent[1] or _outside(name, attrs, articles > 0), parent[4]
        if not out and (said := _mark(name, attrs, articles > 0)):
            marked.append((said, owner))
            owner = len(marked) - 1
        box = parent[2]
        if block and name not in TEXT_BLOCK:
            boxes += 1
            box = boxes
        found.append(Token(name if block or name in ("a", "br") else "inline", 1, out, block, box, None, owner))
        inner = len(stack) if block else stack[-1][3] if stack else -1
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else size
            stack.append((name, True, box, inner, owner))
            opened[name] += 1
        elif name not in VOID and not attrs.endswith("/"):
            stack.append((name, out, box, inner, owner))
            opened[name] += 1
            links += name == "a"
            articles += name == "article"
    if at < size:
        text(page[at:])
    _place(found, marked)
    return found


def _place(found: list[Token], marked: list[tuple[str, int]]) -> None:
    """Tells each token's ``where``: the least hopeful kind of the marked elements around it."""
    if not marked:
        return
    prose = [0] * len(marked)
    pure = [said == "pure" for said, _ in marked]
    for i, (_, around) in enumerate(marked):
        pure[i] = pure[i] or (around >= 0 and pure[around])
    total = 0
    for t in found:
        if t.kind == "word" and not t.out and not (t.owner >= 0 and pure[t.owner]):
            total += t.n
            if t.owner >= 0:
                prose[t.owner] += t.n
    for i in range(len(marked) - 1, -1, -1):
        if marked[i][1] >= 0:
            prose[marked[i][1]] += prose[i]
    order = ["", "mixed, most", "mixed, least", "pure"]
    where: list[str] = []
    for i, (_, around) in enumerate(marked):
        own = "pure" if pure[i] else "mixed, most" if 2 * prose[i] > total else "mixed, least"
        where.append(max(own, where[around] if around >= 0 else "", key=order.index))
    for t in found:
        if t.owner >= 0:
            t.where = where[t.owner]


def _kind(t: Token, outside: frozenset) -> str:
    """The class of a token's weight: outside, where it stands there."""
    return "outside" if t.out or t.where in outside else t.kind


def _labelled(pages: list[str]) -> Iterator[tuple[Token, bool]]:
    for page in pages:
        begin, end = page.index("[["), page.index("]]") - 2
        plain = page.replace("[[", "").replace("]]", "")
        first, last = len(tokens(plain[:begin])), len(tokens(plain[:end]))
        for i, t in enumerate(tokens(plain)):
            yield t, first <= i < last


def _log_ratios(inside: Counter, outside: Counter, alpha: float) -> dict[str, float]:
    kinds = set(inside) | set(outside)
    total_in, total_out = sum(inside.values()) + alpha * len(kinds), sum(outside.values()) + alpha * len(kinds)
    return {k: math.log((inside[k] + alpha) / total_in) - math.log((outside[k] + alpha) / total_out) for k in kinds}


def learn(pages: list[str], alpha: float = 0.5) -> tuple[dict[str, float], frozenset]:
    """(weights, outside): log ratios of the shares of token kinds inside and outside the marked main texts, words above and tags below 0;
    and the kinds of marked elements whose words are likelier outside."""
    rows = list(_labelled(pages))
    words, counts = (Counter(), Counter()), (Counter(), Counter())
    for t, inner in rows:
        if t.text is not None and not t.out:
            words[not inner][t.where] += t.n
    outside = frozenset(k for k, w in _log_ratios(*words, alpha).items() if k and w < 0)
    for t, inner in rows:
        counts[not inner][_kind(t, outside)] += t.n
    return {k: max(w, 0.05) if k in ("word", "linked") else min(w, -0.05) for k, w in _log_ratios(*counts, alpha).items()}, outside


WEIGHTS, PLACES = learn(PAGES)
#: A kind of tag that no labelled page has.
UNKNOWN = -0.5


def best_region(found: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """First and last + 1 token of the region of the highest sum, the first and longest on ties; empty where no sum is positive."""
    best, region, total, begin = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(found):
        if total <= 0:
            total, begin = 0.0, i
        total += weights.get(_kind(t, PLACES), UNKNOWN) * t.n
        if total > best:
            best, region = total, (begin, i + 1)
    return region


def _grown(found: list[Token], begin: int, end: int) -> tuple[int, int]:
    """The region with all further tokens next to it that lie in text blocks of the containers at its edges, or outside an article."""

    def goes_on(t: Token, box: int) -> bool:
        return t.out or (t.box == box and (t.text is None or t.kind == "word" or not t.n))

    edge = next(t.box for t in found[begin:end] if t.n and t.text is not None and not t.out)
    while begin > 0 and goes_on(found[begin - 1], edge):
        begin -= 1
    edge = next(t.box for t in reversed(found[begin:end]) if t.n and t.text is not None and not t.out)
    while end < len(found) and goes_on(found[end], edge):
        end += 1
    return begin, end


def main_text(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    """The page's main text: character references decoded, white space inside a block one space, blocks joined by two line feeds."""
    found = tokens(page or "")
    for t in found:
        t.out = t.out or t.where in PLACES
    begin, end = best_region(found, weights)
    if begin == end:
        return ""
    begin, end = _grown(found, begin, end)
    blocks: list[list[str]] = [[]]
    for t in found[begin:end]:
        if t.text is None:
            if t.block:
                blocks.append([])
            elif t.kind == "br":
                blocks[-1].append(" ")
        elif not t.out:
            blocks[-1].append(t.text)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n\n".join(x for x in lines if x)


def _extract(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                texts = [main_text(page, weights) for page in batch.column(2).slice(lo, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), batch.column(1).slice(lo, 256), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of pages, from the whole html.

    A null or empty html, and a page without words outside menus and the like, has an empty text.  Other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(weights), "page_id bigint, url string, text string, n_chars bigint")


def op2_max_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
