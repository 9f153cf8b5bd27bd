import re
import time

from codeatlas.llm import html_text
from codeatlas.llm.common import table

PAGE = """<!DOCTYPE html><html><body><header><a href=/>Home</a> Site</header><div class="cookie-notice">We use cookies</div>
<div id="content-12" class="post-34"><h1>Title &eacute;&amp;</h1><p>A long&nbsp;paragraph of <b>bo</b>ld text which goes on and on and on.</p><div class="ad">buy</div>
<form><input>send</form><p>Second   one<ul><li>x<li>y</ul></div><div class=comments><p>Great post, I liked it so much that I wrote this very long comment to you, thanks a lot for it</p></div>
<aside>related</aside><script>if (a < b) {"</p>"}</script><style>p{}</style><footer>(c) <b>2020</b></footer>"""


def test_boilerplate_goes_and_blocks_stay_in_order():
    tree, found = html_text.blocks(PAGE)
    best = html_text.best_of(tree, html_text.container_scores(tree, found))
    assert tree.path(best) == "html body div.post-0#content-0"
    assert html_text.text_under(tree, found, best) == "Title é& A long paragraph of bold text which goes on and on and on. Second one x y"


def test_table_equals_the_article_elements(spark, sf_dir):
    import html

    pages = table(spark, sf_dir, "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        parts = re.sub(r"</?b>", "", inner)
        parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.sub(r"<[^>]*>", "\0", parts).split("\0")]
        want = " ".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_the_host_decides_where_a_page_alone_would_not(spark):
    page = lambda n, side: f"<body><div class='c{n}'><p>{'main words ' * 30}</p></div><div class='box'><p>{'side ' * side}</p></div></body>"
    rows = [(n, f"http://h.org/{n}", page(n, 5)) for n in range(9)] + [(9, "http://h.org/9", page(9, 300))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(t == ("main words " * 30).strip() for t in got.values())


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain text only"), (4, "http://a", "<p>one<p>two"), (4, "http://a", "<p>one<p>two"), (None, "http://b", "<div>" * 3000 + "deep"), (5, "http://c", "a &lt; b <unclosed"), (6, "http://d", "<script>never ends")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as host", "1 as text")
    got = {(r.page_id, r.url): r.text for r in html_text.extract(df).collect()}
    assert len(html_text.extract(df).collect()) == 8
    assert got[1, None] == got[2, ""] == got[6, "http://d"] == ""
    assert got[3, "x"] == "plain text only" and got[4, "http://a"] == "one two" and got[None, "http://b"] == "deep"
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_of_links_and_leads_beside_the_container_keep_their_text(spark):
    item = lambda n: f"<p><a href=/{n}>link number {n}</a></p>"
    rows = [
        (1, "http://l", f"<html><body><div>{item(1)}{item(2)}</div><nav><a href=/>home</a></nav></body></html>"),
        (2, "http://m", f"<html><body><p>The lead.</p><div><p>{'long text ' * 50}</p></div></body></html>"),
    ]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "link number 1 link number 2"
    assert got[2] == "The lead. " + ("long text " * 50).strip()


def test_broken_and_deeply_nested_pages_take_linear_time():
    pages = ["<a " * 30_000, "<a '" * 30_001, "<div class='a'>" * 20_000 + "x</span></div>" * 20_000, "<b>" * 20_000 + "<li>q</li>" * 20_000, "<span>" + "<div>" * 20_000 + "</span>" * 20_000 + "end", "<!--" * 30_000]
    began = time.time()
    for page in pages:
        tree, found = html_text.blocks(page)
        best = html_text.best_of(tree, html_text.container_scores(tree, found))
        if best:
            html_text.text_under(tree, found, best)
    assert time.time() - began < 30


def test_equal_containers_and_text_at_every_depth(spark):
    two = "<div class=a><p>same words here</p></div><div class=b><p>same words here</p></div>"
    tree, found = html_text.blocks(two)
    assert tree.path(html_text.best_of(tree, html_text.container_scores(tree, found))) == "div.b"
    levels = "<body>top text<main>lead text<div>inner text that is the longest of all the texts here by far</div>end text</main>last text</body>"
    rows = [(1, "http://t", levels), (2, "http://v", None)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "top text lead text inner text that is the longest of all the texts here by far end text last text"
    assert got[2].text == "" and got[2].n_chars == 0


def test_a_quote_that_never_closes_costs_no_text():
    tree, found = html_text.blocks('<div><p title="oops>first</p><p>second</p></div> <b>x')
    assert [t for _, t, _, _ in found] == ["first", "second", "x"]


def test_class_words_mark_boilerplate_only_where_the_whole_name_says_so(spark):
    kept = "<p class=share-price>price up</p><p class=skip>skipped beat</p><div class=side-by-side>two columns</div><p class='notice'>a notice board</p><math><mi>x</mi> plus one</math><noscript>still text</noscript>"
    gone = "<p class=advert>buy this</p><div class='share-buttons'>tweet</div><div id=cookie-notice-0>cookies</div><div class='comment__list x'>first!</div><div class='post-footer'>filed</div>"
    page = f"<body><noscript>enable scripts</noscript><article><p>{'lead text ' * 20}</p>{kept}{gone}</article></body>"
    (row,) = html_text.extract(spark.createDataFrame([(1, "http://x", page)], "page_id long, url string, html string")).collect()
    assert row.text == ("lead text " * 20).strip() + " price up skipped beat two columns a notice board x plus one still text"


def test_a_page_is_cut_once(spark):
    """The second look at a page reads its kept blocks: extraction cuts each page a single time."""
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    plan = html_text.extract(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "texts" in plan and "html" not in plan.split("MapInArrow", 1)[1].lower().replace("html_text", "")
