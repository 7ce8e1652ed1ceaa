"""Site template removal: element subtrees are hashed and counted per host, and those that recur on many of its pages go."""

from __future__ import annotations

import html
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+|[^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile("[a-z0-9]+")

# Elements of HTML by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if it is open, and the elements beyond which nothing is closed.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "body": ({"head"}, set()),
}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that are never part of an article.
DROPPED = frozenset("head script style noscript template title nav footer aside form iframe svg canvas button select textarea object embed dialog menu xmp noembed noframes math audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words in a class or an id that say an element is not part of an article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar footer masthead comment comments respond replies disqus related recommended share sharing social toolbar pagination pager widget widgets login search skip".split()
)
_KEPT = frozenset(("html", "body", "main"))


class Node:
    __slots__ = ("tag", "attributes", "children", "digest", "n", "gone", "heading", "prose")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.digest, self.n, self.gone, self.heading, self.prose = 0, 0, False, False, False

    def named(self) -> dict[str, str]:
        return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(self.attributes)}


def _role(node: Node) -> tuple[bool, bool]:
    """(whether the element is no part of an article by its kind, whether it is the main part of a page)."""
    if node.tag in DROPPED:
        return True, False
    main = node.tag == "main"
    if node.attributes:
        named = node.named()
        role = named.get("role", "").lower()
        main = main or role == "main" or named.get("itemprop") == "articleBody"
        if "hidden" in named or named.get("aria-hidden") == "true" or role in ROLES or "display:none" in named.get("style", "").replace(" ", "").lower():
            return node.tag not in _KEPT, False
        words = set(_WORDS.findall(f"{named.get('class', '')} {named.get('id', '')}".lower()))
        if words & NAMES and node.tag not in _KEPT and node.tag not in HEADINGS:
            return True, False
    return False, main


def parse(text: str) -> Node:
    """The tree of a page; tags that HTML leaves out are made up for, stray end tags are skipped."""
    top = Node("#top")
    stack, opened, at = [top], {}, 0

    def close(n: int) -> None:
        while len(stack) > n:
            opened[stack.pop().tag] -= 1

    def close_first(tags, beyond) -> None:
        """Closes the outermost of these elements that is open this side of the others."""
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                found = i
            elif stack[i].tag in beyond:
                break
        if found:
            close(found)

    match = _TOKEN.search(text)
    while match:
        if match.start() > at:
            stack[-1].children.append(text[at : match.start()])
        at = match.end()
        tag = (match.group(2) or "").lower()
        if tag and match.group(1):
            if opened.get(tag):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        elif tag:
            if tag in ENDS_P and opened.get("p"):
                close_first({"p"}, {"article", "section", "div", "td", "th", "li", "body", "button"})
            if tag in CLOSES:
                own, beyond = CLOSES[tag]
                if any(opened.get(t) for t in own):
                    close_first(own, beyond)
            node = Node(tag, match.group(3) or "")
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(text, at)
                node.children.append(text[at : end.start() if end else len(text)])
                at = end.end() if end else len(text)
            elif tag not in VOID:
                stack.append(node)
                opened[tag] = opened.get(tag, 0) + 1
        match = _TOKEN.search(text, at)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return top


def _walk(top: Node):
    """(node, whether it is left) of all nodes, parents around their children."""
    stack = [(top, False)]
    while stack:
        node, left = stack.pop()
        yield node, left
        if not left:
            stack.append((node, True))
            stack.extend((x, False) for x in reversed(node.children) if type(x) is Node)


def _blank(s: str) -> str:
    return " ".join(s.split())


class Page:
    """A page's tree with the hash of each element's subtree, and its main parts."""

    def __init__(self, text: str):
        self.top = parse(text)
        articles, mains, depth, inside = [], [], 0, 0
        for node, left in _walk(self.top):
            dead = depth > 0
            if not left:
                gone, main = (True, False) if dead else _role(node)
                node.gone = gone
                depth += gone
                if not gone:
                    (articles if node.tag == "article" else mains if main else []).append(node)
                inside += node.tag == "article"
                continue
            depth -= node.gone
            inside -= node.tag == "article"
            texts = ["" if node.tag in RAW else _blank(html.unescape(x)) if type(x) is str else x for x in node.children]
            inner = [x for x in node.children if type(x) is Node]
            node.n = sum(len(x) if type(x) is str else x.n for x in texts)
            node.digest = xxhash.xxh3_64_intdigest("\0".join((node.tag, *(f"{x.digest:x}" if type(x) is Node else x for x in texts if type(x) is Node or x)))) >> 1
            node.heading = node.tag in HEADINGS or any(x.heading for x in inner)
            node.prose = node.tag in PROSE or any(x.prose for x in inner)
            if node.tag == "header" and not node.gone and not (inside and node.heading):
                node.gone = True
        some = [x for x in articles if x.n] or [x for x in mains if x.n]
        held, self.main = set(), []
        for x in some:
            if id(x) not in held:
                self.main.append(x)
                held.update(id(y) for y, _ in _walk(x))
        self.explicit = bool(self.main)
        self.main = self.main or [self.top]

    def candidates(self):
        """Elements that a template may hold. Where the page names its main part, prose in it is its own, however often it recurs."""
        for part in self.main:
            dead = 0
            for node, left in _walk(part):
                if node.gone:
                    dead += -1 if left else 1
                elif not left and not dead and node is not part and node.n and node.tag not in INLINE and node.tag not in _KEPT and not (self.explicit and node.prose):
                    yield node

    def text(self, templates: frozenset) -> str:
        """The blocks of the main parts, without what is gone and without subtrees that are templates."""
        if templates:
            for node in list(self.candidates()):
                node.gone = node.digest in templates
        blocks, now = [], []

        def end() -> None:
            if now:
                block = _blank("".join(now))
                if block:
                    blocks.append(block)
                now.clear()

        for part in self.main:
            stack: list = [part]
            while stack:
                x = stack.pop()
                if x is None:
                    end()
                elif type(x) is str:
                    now.append(html.unescape(x))
                elif x.tag == "br":
                    now.append("\n")
                elif not x.gone:
                    if x.tag not in INLINE:
                        end()
                        stack.append(None)
                    stack.extend(reversed(x.children))
            end()
        return "\n".join(blocks)


def templates(pages: DataFrame, least: int = 5, share: float = 0.2) -> DataFrame:
    """(host, hashes): of each host the subtrees that stand on `share` of its pages, and on `least` pages that differ.
    As a page has only so many subtrees, a host has at most the mean of them divided by `share`."""
    import pyarrow as pa

    def signs(batches):
        for b in batches:
            hosts, hashes, whole = [], [], []
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(text)
                found = {n.digest for n in page.candidates()}
                hosts += [host] * len(found)
                hashes += found
                whole += [page.top.digest] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(whole, pa.int64())], names=["host", "hash", "page"])

    # pages that are equal throughout count once, so that copies of one page make no template of it
    found = pages.mapInArrow(signs, "host string, hash long, page long").groupBy("host", "hash").agg(F.countDistinct("page").alias("n"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages"))
    return found.where(F.col("n") >= least).join(sizes, "host").where(F.col("n") >= F.col("pages") * share).groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract_main(pages: DataFrame, least: int = 5, share: float = 0.2) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars: the article's blocks, one to a line.

    A page's main parts are its outermost `article` elements, or else those marked as main, or else all of it. What is no
    part of an article by its element, role, class or id goes, and so do subtrees that recur on many pages of the
    host (`templates`); prose within a named main part stays, however often it recurs. Character references are decoded,
    white space within a block is one space, empty blocks go. A null or empty page has an empty text; a null or odd url
    belongs to a host without name. Repeated rows are rows each; other columns are ignored.

    Pages are read twice and never grouped; a host's templates, a few hundred at most, are joined to its pages.
    """
    import pyarrow as pa

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    known = common.cut(templates(rows.select("host", "html"), least, share))

    def read(batches):
        for b in batches:
            own = b.column("hashes").to_pylist()
            texts = [Page(x).text(frozenset(h or ())) for x, h in zip(b.column("html").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return rows.join(known, "host", "left").select("page_id", "url", "html", "hashes").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
