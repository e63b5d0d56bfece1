"""HTML columns by pattern, and the one place a page is really parsed: into rows of text nodes with their path."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text

PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"

# Signs of a paywall, in page source and in visible text.
PAYWALL_TEXT = [
    "subscribe to continue reading", "subscription required", "premium content", "subscriber only", "subscribers only", "paywall",
    "sign in to read", "become a member", "unlock this article", "continue reading", "read the full story", "free trial",
    "limited time offer", "register to read", "login to continue", "subscription", "premium", "subscriber-only", "locked-content",
    "auth-required", "registration-wall", "piano.io", "tinypass", "cleeng", "zuora", "recurly", "stripe", "chargebee",
]
PAYWALL_CLASSES = ["paywall", "subscription", "premium", "auth-required", "subscriber-only", "registration-wall", "meter-limit"]
TRUNCATION_TEXT = ["...", "continue reading", "read more", "full article", "subscribe to", "view more"]


def meta_tag(html, name: str) -> Column:
    """Content of a meta tag by property or name, whichever order the attributes come in; null when absent."""
    q = name.replace(".", r"\.")
    a = F.regexp_extract(html, rf'(?is)<meta\s[^>]*(?:property|name)=["\']{q}["\'][^>]*\scontent=["\']([^"\']+)["\']', 1)
    b = F.regexp_extract(html, rf'(?is)<meta\s[^>]*content=["\']([^"\']+)["\'][^>]*\s(?:property|name)=["\']{q}["\']', 1)
    return F.coalesce(F.nullif(F.trim(a), F.lit("")), F.nullif(F.trim(b), F.lit("")))


def tag_text(html, tag: str) -> Column:
    """Plain text of the first element of a kind."""
    return text.strip_html(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1))


def visible(html) -> Column:
    return F.regexp_replace(html, HIDDEN, " ")


def paragraphs(html) -> Column:
    """Plain paragraphs of a page, empty ones left out."""
    found = F.transform(F.regexp_extract_all(visible(html), F.lit(PARAGRAPH), 1), text.strip_html)
    return F.filter(found, lambda p: p != "")


def paywall_signs(html, literal_repeats: bool = False) -> Column:
    """How many paywall signs a page shows; one phrase counts once unless the historical repeats are wanted."""
    low = F.lower(html)
    body = F.lower(text.strip_tags(visible(html)))
    n = text.count_any(low, PAYWALL_TEXT + (["paywall"] if literal_repeats else []))
    for c in PAYWALL_CLASSES:
        n = n + F.rlike(low, F.lit(rf'class=["\'][^"\']*\b{c}\b')).cast("int")
    n = n + F.rlike(low, F.lit(r"<[a-z][^>]*\sdata-paywall(?![a-z0-9_-])")).cast("int")
    return n + text.count_any(body, [t for t in TRUNCATION_TEXT if literal_repeats or t not in PAYWALL_TEXT])


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "section", "article", "footer", "header", "nav", "figure"}


HOLDS_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Walker(HTMLParser):
    """Rows of one page in document order, as a tree of intervals: the nodes below an element are those from ``seq`` to ``last``.

    ``prose`` is the innermost heading or paragraph around a node. Rows are lists, as an element's end is known when it closes.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.stack = [], []

    def _row(self, kind: str, tag: str = "", names: tuple = ("", ""), body: str = "", src: str = "", width: int = 0, height: int = 0) -> list:
        seq = len(self.rows)
        prose = next((x for x in reversed(self.stack) if x[4] in HOLDS_PROSE), None)
        row = [seq, seq, self.stack[-1][0] if self.stack else None, kind, tag, *names, prose and prose[0], prose and prose[4], body, src, width, height]
        self.rows.append(row)
        return row

    def _close(self, at: int) -> None:
        for x in self.stack[at:]:
            x[1] = len(self.rows) - 1
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in CLOSES_P and any(x[4] == "p" for x in self.stack):
            self.handle_endtag("p")

        def size(k: str) -> int:
            v = a.get(k) or ""
            return int(v) if v.isdigit() and len(v) < 9 else 0

        names = [" ".join((a.get(k) or "").split()) for k in ("class", "id")]
        row = self._row("element", tag, names, a.get("alt") or "", a.get("src") or a.get("data-src") or "", size("width"), size("height"))
        if tag not in VOID:
            self.stack.append(row)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][4] == tag:
                return self._close(i)

    def handle_data(self, data):
        if data.strip():
            self._row("text", body=data)

    def handle_comment(self, data):
        self._row("comment")

    def close(self):
        super().close()
        self._close(0)


#: Nodes that leave the walker together, so that a batch of pages is never held as one table.
NODES_AT_ONCE = 20_000
NODE_SCHEMA = ("page_id long, seq int, last int, parent int, kind string, tag string, class string, name string, prose int, prose_tag string, "
               "body string, src string, width int, height int")


def page_nodes(pages: DataFrame) -> DataFrame:
    """One row per element, text node and comment of ``pages(page_id, html)``, numbered in document order."""
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"parent": "Int32", "prose": "Int32"})

    def walk(batches):
        for pdf in batches:
            out: list = []
            for page_id, source in zip(pdf["page_id"], pdf["html"]):
                w = _Walker()
                w.feed(source or "")
                w.close()
                out.extend((page_id, *r) for r in w.rows)
                if len(out) >= NODES_AT_ONCE:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    return pages.select("page_id", "html").mapInPandas(walk, NODE_SCHEMA)
