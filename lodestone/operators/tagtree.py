"""Main text of a page by its tree of elements and the density of text in each, after Sun, Song and Liao (SIGIR 2011)."""

from __future__ import annotations

from collections import Counter
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "head", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog"}
BLOCKS = {
    "html", "body", "address", "article", "blockquote", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "li", "main", "menu", "ol", "p", "pre",
    "section", "summary", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "ul",
}
#: What a start tag ends without an end tag: the elements that it ends, and those that it doesn't look beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements below this depth belong to the one there, as in browsers; their text stays.
DEPTH = 512


class _Tree(HTMLParser):
    """Elements in the order of their start tags, each with its parent, and runs of text with the element they stand in.

    A run of None ends a block. What stands in a dropped element leaves neither elements nor text. Runs hold character
    references as they are written.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.runs = ["#root"], [-1], []
        self.stack, self.gone, self.inner = [0], None, Counter()
        self.feed(html.replace("&", "&amp;"))  # which the parser undoes
        self.close()

    def _pop(self, size: int) -> None:
        if any(self.tags[i] in BLOCKS for i in self.stack[size:]):
            self.runs.append((self.stack[-1], None))
        del self.stack[size:]

    def handle_starttag(self, tag, attrs):
        if self.gone:
            if tag not in VOID:
                self.inner[tag] += 1
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.runs.append((self.stack[-1], None))
            return
        told = {name: value and unescape(value) for name, value in attrs}
        if tag in DROPPED or "hidden" in told or told.get("aria-hidden") == "true" or (told.get("role") or "").lower() in ROLES:
            self.runs.append((self.stack[-1], None))
            self.gone, self.inner = tag, Counter()
            return
        if tag in BLOCKS:
            ended, bound = ENDS.get(tag, ({"p"}, BLOCKS - {"p"}))
            cut = None
            for k in range(len(self.stack) - 1, 0, -1):
                name = self.tags[self.stack[k]]
                if name in bound:
                    break
                if name in ended:
                    cut = k
            if cut is not None:
                self._pop(cut)
            self.runs.append((self.stack[-1], None))
        if len(self.stack) < DEPTH:
            self.tags.append(tag)
            self.parents.append(self.stack[-1])
            self.stack.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        """A slash at the end of a tag says nothing in HTML."""
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.gone:
            if self.inner[tag] > 0:
                self.inner[tag] -= 1
                return
            if tag == self.gone:
                self.gone = None
                return
            if tag not in BLOCKS or all(self.tags[i] != tag for i in self.stack):
                return
            self.gone = None
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tags[self.stack[k]]
            if name == tag:
                self._pop(k)
                return
            if name in BLOCKS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if not self.gone:
            self.runs.append((self.stack[-1], data))


def _densities(tree: _Tree) -> tuple[list[int], list[float], list[float]]:
    """Of each element: characters outside of links, density (these by element within it), and the densities of its children
    added up. An element comes after its parent, so one pass from the last to the first sums all subtrees."""
    n = len(tree.tags)
    link = [False] * n
    for i in range(1, n):
        link[i] = link[tree.parents[i]] or tree.tags[i] == "a"
    chars, below, density, sums = [0] * n, [0] * n, [0.0] * n, [0.0] * n
    for i, text in tree.runs:
        if text and not link[i]:
            chars[i] += len("".join(unescape(text).split()))
    for i in range(n - 1, -1, -1):
        density[i] = chars[i] / max(1, below[i])
        if i:
            p = tree.parents[i]
            chars[p] += chars[i]
            below[p] += below[i] + 1
            sums[p] += density[i]
    return chars, density, sums


def _marked(tree: _Tree) -> set[int]:
    """The elements whose text is the page's: the `article` or `main` with most characters outside of links, the first of
    equals; where none has any, of each element that is as dense as the sparsest one around the densest, its densest part."""
    chars, density, sums = _densities(tree)
    named = [i for i, tag in enumerate(tree.tags) if tag in ("article", "main") and chars[i]]
    if named:
        return {max(named, key=lambda i: (chars[i], -i))}
    n = len(tree.tags)
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        if (sums[best[i]], -best[i]) > (sums[best[p]], -best[p]):
            best[p] = best[i]
    at, least = best[0], density[best[0]]
    while at > 0:
        least, at = min(least, density[at]), tree.parents[at]
    return {best[i] for i in range(n) if density[i] >= least}


def _kept(html: str):
    """The runs of the main text, as they are written; None ends a block."""
    tree = _Tree(html)
    marked, inside = _marked(tree), []
    for i, p in enumerate(tree.parents):
        inside.append(i in marked or (p >= 0 and inside[p]))
    for i, text in (*tree.runs, (0, None)):
        if text is None or inside[i]:
            yield text


def main_text(html: str | None) -> str:
    """The main text of a page: blocks joined by a newline, white space within a block one space. Null or no text is empty.

    Elements may be nested in any depth and left open; navigation, headers, footers, forms and what is hidden go as whole
    subtrees; all character references are decoded.
    """
    if not html:
        return ""
    blocks, block = [], []
    for text in _kept(html):
        if text is None:
            if line := " ".join("".join(block).split()):
                blocks.append(line)
            block = []
        else:
            block.append(unescape(text))
    return "\n".join(blocks)


#: References that the pages' regular expressions decode, in their order; all others stay as they are written.
PLAIN = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(html: str | None) -> str:
    """The main text without blocks: runs joined by a space, of the references only those of PLAIN decoded."""
    out = []
    for text in _kept(html) if html else ():
        if text:
            for name, char in PLAIN:
                text = text.replace(name, char)
            out.append(text)
    return " ".join(out)


def tree_text(html: Column, plain: bool = False) -> Column:
    """main_text of a column, or plain_text, in Arrow batches; null stays null."""
    one = plain_text if plain else main_text

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return read(html)


def tree_documents(pages: DataFrame, least: int = 200) -> DataFrame:
    """page_id, url, text, error_code of pages by their trees: each is read where it is scanned, without a shuffle.

    A text under `least` characters is rejected as too short; a null page has no text and is rejected too.
    """
    rows = pages.select("page_id", "url", F.coalesce(tree_text(F.col("html")), F.lit("")).alias("text"))
    return rows.withColumn("error_code", F.when(F.length("text") < least, "article_too_short"))
