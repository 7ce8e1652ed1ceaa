"""Main text of pages: roles, broken markup, templates per host, and the cases the docstring names."""

from pyspark.sql import functions as F

from lodestone.llm.html_extraction import Page, extract_main

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<article>no</article>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home<nav>inner</nav></a></li></ul>menu</nav>
<div class="cookie-notice"><p>We use cookies</p></div>
<main><article class="post"><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>,
  second&nbsp;<i>word</i>.<p>Unclosed<br>line<!-- hidden --> on<ul><li>one<li>two</ul>
<form><input value=">"><button>Send</button></form><aside>Side</aside><div class="ad">Buy</div><div class='share'>Share</div>
<blockquote>Quote &lt;tag&gt; &#233;&#x41;</blockquote><figure><img alt="no"><figcaption>Caption</figcaption></figure><noscript>ns</noscript>
<section id="comments"><article class="comment"><p>Reader says</p></article></section></article></main>
<aside class="sidebar">More</aside><footer>&copy; host</footer></body></html>"""


def texts(spark, rows, **k):
    return {r.page_id: r for r in extract_main(spark.createDataFrame(rows, "page_id long, url string, html string"), **k).collect()}


def test_whole_page(spark):
    got = texts(spark, [(1, "http://a.example/x", FULL)])[1]
    assert got.text.split("\n") == ["Title & more", "First bold, second word.", "Unclosed line on", "one", "two", "Quote <tag> éA", "Caption"]
    assert got.n_chars == len(got.text) and got.url == "http://a.example/x"


def test_edge_cases(spark):
    long = "<article>" + "<div>" * 3000 + "<p>deep" + "<b>x" * 5000 + "</article>" + "z" * 100_000
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "plain &amp text"), (4, "http://h/", "<article><h1>cut &am"), (5, "http://h/", "</p></div><p>a</b>b<"), (6, "http://h/", long), (6, "http://h/", long), (7, "http://h/", "<body hidden><p>shown</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit("x")).withColumn("hashes", F.lit(2))
    out = sorted((r.page_id, r.text[:9], r.n_chars) for r in extract_main(df).collect())
    assert out[:5] == [(1, "", 0), (2, "", 0), (3, "plain & t", 12), (4, "cut &am", 7), (5, "ab<", 3)]
    assert out[5] == out[6] and out[5][1].startswith("deepx") and out[7] == (7, "shown", 5)
    assert extract_main(df.limit(0)).count() == 0


def test_templates_go_and_prose_stays(spark):
    """Boxes without a telling name go once they recur on a host; an article's own prose stays though it recurs, and so do copies of one page."""
    box = "<div><span>Follow us</span> <a href='/{0}'>everywhere</a></div>"
    page = "<html><body><div>Site of things</div>{box}<article><h1>Head {0}</h1><p>Told again.</p>{box}<p>Only {0}.</p></article><div>Bottom {1}</div></body></html>"
    plain = "<html><body><div>Corp line</div><div><p>Story {0} here.</p></div></body></html>"
    rows = [(i, "http://A.example:80/p", page.replace("{box}", box).format(i, i % 3)) for i in range(20)]
    rows += [(100 + i, "https://u@b.example/q", plain.format(i)) for i in range(20)] + [(200 + i, "http://c.example/", plain.format(7)) for i in range(20)]
    got = texts(spark, rows)
    assert all(got[i].text == f"Head {i}\nTold again.\nOnly {i}." for i in range(20))
    assert all(got[100 + i].text == f"Story {i} here." for i in range(20))
    assert all(got[200 + i].text == "Corp line\nStory 7 here." for i in range(20))


def test_hashes_do_not_depend_on_the_process():
    assert Page("<div><p>a</p></div>").top.digest == Page("<DIV ><p>a </p></DIV>").top.digest == 9150195827980376917
