"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element, and each line is measured by the text
that is not in links. Sums of those lengths over sliding windows of lines form a curve: it
surges where the main text begins and dives where it ends. Text between a surge and its dive
is kept. What elements say of themselves enters as weights of their lines: lines of menus, site
headers, footers, sidebars, notices, adverts, forms and reader comments (by tag, role or class)
weigh nothing and leave valleys in the curve; on a page with a declared article, each line of it
weighs a little more, enough to keep a curve from diving but not to open one, and lines outside
of it half. The curve decides on every page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, by_slices

#: Lines a window holds, and the window sums that open and close a main stretch.
WINDOW, SURGE, DIVE = 3, 86, 10

_SKIP = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "head", "title", "select", "textarea", "button", "form", "nav", "footer", "aside", "menu", "dialog", "audio", "video", "map"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math"}
_BLOCK = {"address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|sidebar|side|aside|footer|foot|masthead|breadcrumbs?|cookies?|consent|notice|notices|notification|alert|gdpr|popup|modal|overlay"
    r"|comments?|comment-?list|replies|reply|respond|disqus|discussion|related|recommend\w*|share|sharing|social|subscribe|newsletter|signup|login|pagination|pager|widget|toolbar|skip|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
_ARTICLE = re.compile(r"(?:article|post|entry|story|content|main)(?:[_-]?(?:body|text|content))?", re.I)
_NEGATED = re.compile(r"(?:^|(?<=\s))(?:no|non|not|without|with|has|hide)[_-]\S+", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|$)", re.S)  # a quote opens a value only behind an equals sign
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_SPACE = re.compile(r"\s+")


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _SKIP or (tag == "header" and not in_article):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if found.get("role", "").lower() in {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}:
        return True
    if found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return True
    names = _NEGATED.sub("", f"{found.get('class', '')} {found.get('id', '')}").strip()
    if not names or tag in {"html", "body", "main"}:
        return False
    if not in_article and re.search(r"(?:^|[\s_-])header(?=$|[\s_-])", names, re.I):
        return True
    each = names.split()
    # a container of the main text is spared unless a whole name of it is unwanted
    own = any(_ARTICLE.fullmatch(x) for x in each)
    return any((m := _NAMES.search(x)) and (not own or m[0] == x) for x in each)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside an article element) of each block, in page order; unwanted blocks are empty."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    plain = article = hidden = 0
    stack: list[tuple[str, bool, bool]] = []  # (tag, opens a skipped part, opens an article)
    skipping = links = 0
    at, n = 0, len(page)

    def add(raw: str) -> None:
        nonlocal plain, hidden
        if skipping:
            hidden += bool(raw.strip())
        elif raw:
            text = html_lib.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if not links:
                plain += len(_SPACE.sub("", text))

    def close() -> None:
        nonlocal plain, hidden
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((text, plain, article > 0))
        elif hidden:
            out.append(("", 0, False))
        parts.clear()
        plain = hidden = 0

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[1]:
            if tag == "br":
                add(" ")
            elif tag in _BLOCK:
                close()
            if tag in _RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}\s*>?", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag in _VOID or m[3].endswith("/"):
                continue
            unwanted, opens = _unwanted(tag, m[3], article > 0), tag == "article" or (tag == "main" and not article)
            stack.append((tag, unwanted, opens))
            skipping += unwanted
            article += opens
            links += tag == "a"
        elif any(t == tag for t, _, _ in stack):
            if tag in _BLOCK or tag in _SKIP:
                close()
            keep = []
            while stack:
                t, unwanted, opens = stack.pop()
                if t != tag and tag not in _BLOCK and tag not in _SKIP and (t in _BLOCK or t in _SKIP):
                    keep.append((t, unwanted, opens))  # an inline end tag closes no block
                    continue
                skipping -= unwanted
                article -= opens
                links -= t == "a"
                if t == tag:
                    break
            stack.extend(reversed(keep))
        elif tag in _BLOCK:
            close()
    close()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    """The main text: blocks in page order joined by newlines; empty for null, empty or text-free pages."""
    lines = lines_of(page) if page else []
    declared = any(inside for _, _, inside in lines)
    weights = [plain if not declared else (plain + dive + 1 if inside else (plain + 1) // 2) for _, plain, inside in lines]
    sums = [sum(weights[i : i + window]) for i in range(len(lines))]
    kept: list[str] = []
    i = end = 0
    while i < len(lines):
        if weights[i] > 0 and sums[i] > surge:  # the surge
            lead = i
            while lead > end and lines[lead - 1][2] and weights[lead - 1] > 0:  # short lines of the article that lead up to it
                lead -= 1
            kept += [lines[j][0] for j in range(lead, i)]
            while i < len(lines) and sums[i] > dive:  # up to the dive
                if weights[i] > 0:
                    kept.append(lines[i][0])
                i += 1
            end = i
        i += 1
    return "\n".join(kept or [text for (text, _, _), weight in zip(lines, weights, strict=True) if weight > 0])


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without html, with the main text and its code points n_chars.

    Null and empty pages give empty texts; columns of the same names as the two new ones are
    replaced. A very long page is a slice of its own; repeated rows get equal texts. Rows are
    independent of each other; nothing is shuffled.
    """
    keep = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    slim = bounded_batches(pages).select(*keep, html_col)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != html_col), f"`{out_col}` string", "n_chars bigint"])

    def ready() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in batch.column(html_col).to_pylist()]
            columns = [batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[*keep, out_col, "n_chars"])

        return run

    return slim.mapInArrow(by_slices(html_col, ready), fields)
