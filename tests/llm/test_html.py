import html
import re

import pytest
from odd import odd_pages, rows_of

from zonespark.llm.html_text import deduce_templates, extract_text, main_text, read_page
from zonespark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_articles_of_all_pages(spark):
    """The article element of these pages holds headings and paragraphs only, which a pattern can read."""
    found = {r["page_id"]: r for r in QUERIES["op4_template_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p["html"], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        text = "\n".join(b for b in blocks if b)
        assert (found[p["page_id"]]["text"], found[p["page_id"]]["n_chars"], found[p["page_id"]]["url"]) == (text, len(text), p["url"])


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<", "<"), ("a<b", "a<b"), ("<p>x<", "x<"), ("<!-- open", ""), ("<script>x", ""), ("</p></div>x", "x"), ("<a href='>'>y</a>", "y"),
    ('<p a="open>z</p>', "z"), ("&lt;p&gt; &#x41;&nbsp;b", "<p> A b"), ("<!-->a<!-- x --->b", "ab"), ("<p>a<p>b<br>c", "a\nb c"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\nb\nc\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><header><h1>t</h1></header><p>x</p><footer>f</footer><div class='share-box'>s</div></article><p>out</p>", "t\nx"),
    ("<main><p>x</p><section id=comments><p>nice</p></section></main><article class='comment'>no</article>", "x"),
    ("<body class='has-sidebar'><header>h</header><p>x</p><div role=navigation>n</div><div style='display: none'>n</div><p hidden>n</p></body>", "x"),
    ("<p>x</p><form><input><label>l</label></form><button>b</button><select><option>o</select><noscript>n</noscript><svg><text>s</text></svg>", "x"),
    ("<p>one <b>two</b><i> three</i>\n\t four</p>", "one two three four"), ("<SCRIPT>a</p></SCRIPT><P>X</P>", "X"), ("<p>a<script>b<p>c</script> d", "a d"),
])
def test_single_pages(page, text):
    assert main_text(read_page(page), None, set()) == text


@pytest.mark.parametrize("page", ["<" * 200_000, "<a " * 50_000, '<a "' * 50_001, "<!--" * 50_000, "<b>" * 50_000 + "<p>" * 5000, "<div>" * 50_000 + "x"])
def test_awkward_pages_take_linear_time(page):
    main_text(read_page(page), None, set())


def story(i, extra=""):
    return (
        f"<html><body><div class='top'>Welcome to our site</div><div id='wrap'><div class='left'><p>Constant text</p></div>"
        f"<div class='story'><p>Story {i} of things number {i * i}</p><p>More words {'x' * i} and more text{extra}</p></div></div>"
        f"<div>All rights are ours</div></body></html>"
    )


def test_template_texts_go_where_no_article_is_marked(spark):
    rows = [(i, f"http://www.a.com/{i}", story(i)) for i in range(9)] + [(100 + i, f"http://b.com/{i}", story(i)) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    for i in range(9):
        assert found[i] == f"Story {i} of things number {i * i}\nMore words {'x' * i} and more text".replace("  ", " ")
    # Two pages are no evidence of a template, so nothing is left out.
    assert all(found[100 + i].startswith("Welcome to our site\nConstant text\nStory") for i in range(2))


def test_texts_shared_by_articles_stay(spark):
    page = "<html><body><nav>m</nav><article><p>The same passage stands in every article of this host.</p><p>{}</p></article></body></html>"
    rows = [(i, f"http://a.com/{i}", page.format(i)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert all(r["text"] == f"The same passage stands in every article of this host.\n{r['page_id']}" for r in extract_text(pages).collect())


def test_cards_do_not_replace_the_text_beside_them(spark):
    page = (
        "<html><body><div class=top>Welcome to our site</div><div class=story><p>Story {0} of {1} and a good deal more to be told</p></div>"
        "<div class=more><article><h3>Card {0}</h3></article><article><h3>Other {0}</h3></article></div></body></html>"
    )
    rows = [(i, f"http://a.com/{i}", page.format(i, i * i)) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extract_text(pages).collect():
        i = r["page_id"]
        assert r["text"].split("\n")[0] == f"Story {i} of {i * i} and a good deal more to be told" and "Welcome" not in r["text"]


def test_texts_are_counted_over_marked_and_other_pages(spark):
    other = "<html><body><div class=top>Welcome to our site</div><div class=story><p>Story {0} of {1}</p></div><div class=end>All rights are ours</div></body></html>"
    marked = other.replace("<div class=story>", "<article>").replace("</p></div>", "</p></article>")
    rows = [(i, f"http://a.com/{i}", (marked if i % 2 else other).format(i, i * i)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract_text(pages).collect()} == {i: f"Story {i} of {i * i}" for i in range(20)}


def test_marked_pages_need_no_template(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.lit("h").alias("host"), "html", F.monotonically_increasing_id().alias("row"))
    assert deduce_templates(pages).count() == 0


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><meta charset=utf-8><body><p>x</p></body></html>", "x"),
    ("<head><title>t</title><script>s</script><p>x<p>y", "x\ny"), ("<head><title>t</title>x<p>y", "x\ny"), ("<head><title>t<body><p>x", "x"),
    ("<head>\n<title>a <b>c</title>\n<style>p{}</style></head><p>x", "x"),
])
def test_a_head_without_its_end_stops_at_the_body(page, text):
    assert main_text(read_page(page), None, set()) == text


@pytest.mark.parametrize("page, text", [
    ("<body><form id=form1><nav>n</nav><article><h1>t</h1><p>x</p></article><input><button>b</button></form></body>", "t\nx"),
    ("<body><form id=aspnetForm><p>some text</p><label>l</label><select><option>o</select></form><p>c</p></body>", "some text\nc"),
    ("<main><form><p>some text</p><button>b</button></form></main>", "some text"),
    ("<p>a long enough text</p><form><p>your name</p><input></form>", "a long enough text"),
    ("<main><p>a long enough text</p><form><p>your name</p></form></main>", "a long enough text"),
    ("<p>x</p><form class=newsletter-form><p>all the news by mail</p></form>", "x"),
])
def test_a_form_around_the_page_is_not_left_out(page, text):
    assert main_text(read_page(page), None, set()) == text


def test_odd_pages(spark):
    pages = odd_pages(spark)
    rows = extract_text(pages).collect()
    assert len(rows) == pages.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    texts = {r["page_id"]: r["text"] for r in rows}
    assert texts[1].startswith("Some text & more of it") and texts[3] == texts[4] == "" and texts[5] == "short"
    assert len(texts[6]) == 5 * 100_000 - 1
    assert rows_of(extract_text(pages.limit(0))) == []
