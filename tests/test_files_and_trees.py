"""Folders of report files as a data source, and main text by the tree of elements."""

import os
import time
from html.parser import HTMLParser

import pytest

from lodestone.operators import tagtree
from lodestone.sources import files

DIR = "/root/testdata/sf0.001"


def put(folder, name, data: bytes):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


# --- files ---


def test_pages_written_as_files_come_back(spark, tmp_path):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    pages = {f"host{r.page_id % 7}/p{r.page_id}.html": r.html or "" for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    for name, html in pages.items():
        put(tmp_path, name, html.encode())
    rows = files.read(spark, str(tmp_path), split_bytes=1 << 20)
    got = {r.uri[len(str(tmp_path)) + 1 :]: r.text for r in rows.collect()}
    assert got == pages
    cost = sum(len(h.encode()) + files.OPENING for h in pages.values())
    assert cost / (1 << 20) <= rows.rdd.getNumPartitions() <= 2 * cost / (1 << 20) + 1
    texts = {r.uri[len(str(tmp_path)) + 1 :]: r.text for r in files.with_main_text(rows).collect()}
    assert texts == {name: tagtree.main_text(html) for name, html in pages.items()}


@pytest.mark.parametrize("split", [1, 2, 7, 50, 10_000])
def test_ranges_of_lines_make_up_the_file(spark, tmp_path, split):
    text = "".join("é" * (k * 7 % 23) + ("\n" if k % 5 else "\n\n") for k in range(60)) + "last line without a newline"
    put(tmp_path, "a.log", text.encode())
    rows = files.read(spark, f"file://{tmp_path}", split_bytes=split).orderBy("byte_start").collect()
    assert "".join(r.text for r in rows) == text
    assert all(r.text.endswith("\n") for r in rows[:-1])
    assert [r.byte_start for r in rows[1:]] == [r.byte_end for r in rows[:-1]] and rows[-1].byte_end == len(text.encode())
    assert len(rows) > 1 if split < 100 else len(rows) == 1


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    put(tmp_path, "a.pdf", b"%PDF")
    put(tmp_path, "b.unknown", b"x")
    put(tmp_path, "c.md", b"\xff\xfe")
    put(tmp_path, "d.html", b"<p>" + b"x" * 200)
    put(tmp_path, "e.txt", b"one\n" + b"y" * 300 + b"\ntwo\n")
    put(tmp_path, "f.txt", b"")
    put(tmp_path, "_SUCCESS", b"")
    put(tmp_path, ".hidden/g.txt", b"no")
    rows = files.read(spark, str(tmp_path), split_bytes=20, max_bytes=100).orderBy("uri", "byte_start").collect()
    got = [(os.path.basename(r.uri), r.text, r.error_code) for r in rows]
    assert got == [
        ("a.pdf", None, "unsupported_format"), ("b.unknown", None, "unsupported_format"), ("c.md", None, "not_utf8"), ("d.html", None, "file_too_large"),
        ("e.txt", "one\n", None), ("e.txt", None, "line_too_long"), ("e.txt", "two\n", None), ("f.txt", "", None),
    ]
    assert files.read(spark, str(tmp_path), formats="pdf,md").count() == 2


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, place = tmp_path / "in", str(tmp_path / "checkpoint")
    put(source, "a.txt", b"first\n")

    def run():
        stream = files.read_stream(spark, str(source), settle_seconds=0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", place).trigger(availableNow=True).start()
        assert stream.awaitTermination(60) and stream.exception() is None
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["first\n"]
    assert run() == ["first\n"]
    later = put(source, "sub/0.md", b"second")
    os.utime(later, (time.time() + 0.01,) * 2)
    time.sleep(0.1)
    assert run() == ["first\n", "second"]


# --- trees ---


def test_nested_navigation_goes_whole():
    html = "<body><nav>a<nav>b</nav>c<div>d</div></nav><article><h1>Title</h1><p>One <b>bold</b><i>er</i> &eacute;&amp;&#x41;&lt;p&gt;</p><aside>no<aside>no</aside>no</aside><p>Two</p></article>menu</body>"
    assert tagtree.main_text(html) == "Title\nOne bolder é&A<p>\nTwo"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<br>c", "a\nb\nc"), ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<main><p>x</main></main></p>y", "x"), ("<article><nav>open<div>in</div></article><p>after the article</p>", "after the article"), ("<p>a</p><script>var x = '<p>no</p>';</script><!-- no --><p>b", "a\nb"),
        ("<article>one</article><article>the longer one</article>", "the longer one"), ("<div hidden>no</div><div role=navigation>no</div><p>yes", "yes"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>a < b &notanentity; &copy</p>", "a < b ¬anentity; ©"), ("<article></article><p>rest", "rest"), ("<a href=x>only a link</a>", "only a link"),
    ],
)
def test_small_pages(html, text):
    assert tagtree.main_text(html) == text


def test_references_that_sql_leaves_as_they_are_count_as_written(spark, tmp_path):
    """Text cut within a reference, references that SQL has no name for, and white space that it keeps."""
    duckdb = pytest.importorskip("duckdb")
    from lodestone.plans import catalog

    html = [
        "<article><p>cut at &quot</p><p>&quo</p> &lt &gt &#39 &nbsp</article>", "<main>&copy; &copy &eacute; &#65; &amp;lt; &amp;amp &am<b>p</b> &l<b>t;</b>, a&nbsp;b</main>", "<article>wide\u2003space\u0085and\u00a0more</article>",
        "<nav>&quot</nav><article>x &amp y &amp;quot &amp;&quot;</article>", "<article></article>", "", None, "<article>&lt;p&gt;&middot;</article>",
    ]
    os.makedirs(tmp_path / "in")
    spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/in/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/in/pages.parquet/*.parquet'")
    got = catalog.QUERIES["html_tree_text"](spark, f"{tmp_path}/in")
    assert sorted(map(tuple, got.collect())) == sorted(c.execute(catalog.ORACLES["html_tree_text"]).fetchall())
    assert tagtree.main_text(html[0]) == "cut at \"\n&quo\n< > '" and tagtree.main_text("<p role='navig&#97;tion'>no</p>yes &amp;lt;") == "yes &lt;"


def test_the_dense_part_is_kept_without_names():
    menu = "<div>" + "".join(f"<div><a href=/{k}>entry {k}</a></div>" for k in range(20)) + "</div>"
    body = "".join(f"<p>Sentence {k} of a report, {'with many words ' * 10}and one <a href=x>link</a>.</p>" for k in range(5))
    text = tagtree.main_text(f"<html><body>{menu}<div><div>{body}</div></div>{menu}</body></html>")
    assert text.count("Sentence") == 5 and text.count("link") == 5 and "entry" not in text


def test_depth_and_length():
    began = time.time()
    for html in ("<div>" * 30_000 + "deep", "<p>" + "<b>" * 30_000 + "</i>" * 30_000 + "deep", "<nav>" * 50_000 + "</nav>" * 50_000 + "deep", "<b><p>" * 50_000 + "deep"):
        assert tagtree.main_text(html) == "deep"
    assert tagtree.main_text("<p>w</p>" * 100_000).count("\n") == 99_999
    assert time.time() - began < 60


class _Plain(HTMLParser):
    """A tree of nested lists of a well-formed page: [tag, children], text as strings."""

    def __init__(self, html):
        super().__init__()
        self.open = [["#root", []]]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][1].append(data)


def _brute(html):
    """The densities by walking each element's whole subtree anew."""
    nodes, parent = [], {}

    def walk(node, up):
        nodes.append(node)
        parent[id(node)] = up
        for c in node[1]:
            if isinstance(c, list):
                walk(c, node)

    walk(_Plain(html).open[0], None)
    under = lambda n: [n] + [x for c in n[1] if isinstance(c, list) for x in under(c)]
    linked = lambda n: n is not None and (n[0] == "a" or linked(parent[id(n)]))
    chars = lambda n: 0 if linked(n) else sum(len("".join(c.split())) if isinstance(c, str) else chars(c) for c in n[1])
    density = lambda n: chars(n) / max(1, len(under(n)) - 1)
    total = lambda n: sum(density(c) for c in reversed(n[1]) if isinstance(c, list))
    best = lambda n: max(under(n), key=lambda x: (total(x), -next(i for i, y in enumerate(nodes) if y is x)))
    main = at = best(nodes[0])
    least = density(main)
    while parent[id(at)] is not None:
        least, at = min(least, density(at)), parent[id(at)]
    kept = {id(best(n)) for n in nodes if density(n) >= least}
    words = []

    def tell(n, inside):
        inside = inside or id(n) in kept
        for c in n[1]:
            if isinstance(c, list):
                tell(c, inside)
            elif inside:
                words.extend(c.split())

    tell(nodes[0], False)
    return words


def test_densities_against_brute_force():
    import random

    rng = random.Random(3)

    def element(depth):
        tag = rng.choice(["div", "div", "p", "span", "a", "section"]) if depth else "body"
        if tag == "p" or depth > 4:
            return f"<{tag}>" + " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 12))) + f"</{tag}>"
        return f"<{tag}>" + "".join(element(depth + 1) if rng.random() < 0.7 else " word " * rng.randint(1, 3) for _ in range(rng.randint(1, 5))) + f"</{tag}>"

    for _ in range(150):
        html = element(0)
        assert "".join(tagtree.main_text(html).split()) == "".join(_brute(html)), html
