from pyspark.sql import functions as F

from kinlink.llm import html_extract

PAGE = "page_id long, url string, html string"
P = "<p>{}</p>".format
LONG = "Many quiet words of an article stand here in one paragraph, so that it is long enough to be read as text."


def text(page):
    return html_extract.main_text(page, html_extract.train_tree())


NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"


def test_layouts():
    article = f"<h1>A title</h1>{P(LONG)}{P('Short.')}{P(LONG)}"
    want = f"A title {LONG} Short. {LONG}"
    foot = "<footer>&copy; example.net &middot; All rights.</footer>"
    for page in (
        f"<html><head><title>T</title><style>p{{x:1}}</style></head><body>{NAV}<div class=ad>{P('Buy this now')}</div><article>{article}</article>{foot}",
        f"<header>Site name</header>{NAV}<div class='cookie-notice'>{P(LONG)}</div><main>{article}</main><aside>{P(LONG)}</aside>{foot}",
        f"<div id='menu'><a href=x>One</a> <a href=y>Two</a></div><div class='content'>{article}</div><div class='comments'>{P('Nice one, thanks')}{P(LONG)}</div>",
        f"<article>{article}<section class=\"comments\">{P('I disagree')}</section><form>{P('Your name')}<input></form></article>",
        f"<article>{article}<script>var t=\"</p><p>no</p>\";</script><!-- {LONG} --></article>",
    ):
        assert text(page) == want


def test_references_and_white_space():
    assert text(f"<article><p>a&amp;b &lt;i&gt; &#233;&#x41; 1 &lt 2&nbsp;x\n\t y<br>z {LONG}</p></article>") == f"a&b <i> éA 1 < 2 x y z {LONG}"
    assert text(f"<article><p>one<b>two</b> <i>three</i></p><p>{LONG}</article>") == f"onetwo three {LONG}"


def test_broken_pages():
    assert text(None) == text("") == text("<div></div>") == ""
    assert text(f"{NAV}<article><p>{LONG}<p>{LONG}</arti") == f"{LONG} {LONG}"
    assert text(f"<article><p>{LONG} fish &am") == f"{LONG} fish &am"
    assert text(f'<article><p>{LONG}</p><a href="/cut') == LONG
    assert text(f"<article><p>{LONG}</p><script>never closed {LONG}") == LONG
    assert text("<" * 5000 + f"<article>{P(LONG)}</article>").endswith(LONG)


def test_names_that_say_nothing():
    assert text(f'<article><h1>T</h1><div class="share-price">{P(LONG)}</div><section id="top-story">{P(LONG)}</section></article>') == f"T {LONG} {LONG}"
    assert text(f'<article>{P(LONG)}<div class="ad-slot">{P(LONG)}</div><div class="newsletter-box">{P("Sign up")}</div></article>') == LONG
    assert text(f'<div class=site-header>{P("My site")}</div><div class=content><div class=header><h1>A title</h1></div>{P(LONG)}</div>') == f"A title {LONG}"


def test_links_within_an_article():
    notes = "<ol><li><a href=r>Smith, A study of rivers and stones</a> 2010</li><li><a href=r>Jones, On light and gardens in winter</a></li></ol>"
    want = f"{LONG} Read the full report of the office here {LONG} Smith, A study of rivers and stones 2010 Jones, On light and gardens in winter"
    assert text(f"<article>{P(LONG)}{P('<a href=x>Read the full report of the office here</a>')}{P(LONG)}{notes}</article>") == want
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>Sport today</a></li></ul>"
    assert text(f"<article>{P(LONG)}{menu}{P(LONG)}</article>") == f"{LONG} {LONG}"


def test_only_scripts_and_the_like_are_cut():
    assert text(f"<article>{P(LONG)}<p>A sum <math><mi>x</mi><mo>+</mo><mn>2</mn></math> <object>of two</object></p></article>") == f"{LONG} A sum x+2 of two"
    assert text(f"<article>{P(LONG)}<form><textarea>Write</textarea><button>Send</button></form><p hidden>{LONG}</p></article>") == LONG


#: Pages written by hand, with other words and names than the labelled ones: what is between the brackets is article text.
OTHER_PAGES = (
    "<body><ul class=topnav><li><a href=/>Start</a><li><a href=/w>Weather</a><li><a href=/s>Sports</a></ul><div id=primary><h1>[The old mill burns down]</h1>"
    "<p>[A fire destroyed the old mill by the river on Sunday night, and the fire service worked until the morning to save the houses beside it.]"
    "<p>[Nobody was hurt, said the head of the fire service, but the cause is still unknown and an inquiry has begun in the town hall.]</div>"
    "<div id=colophon><p>All rights reserved</p></div>",
    "<header><h2>City paper</h2></header><main><h1>[Rain]</h1><p>[Short news.]</p><p>[More rain is expected in the coming days, as a front moves in from the west.]</p>"
    "<blockquote>[<a href=q>We have seen nothing like it in forty years, said the keeper of the weir</a>]</blockquote>"
    "<aside><p>The ten wettest places of the country in one long table to look at.</p></aside></main><footer><p>Imprint and contact</p></footer>",
    "<nav><a href=1>One</a> <a href=2>Two</a></nav><article class='hentry'><p>[First.]</p><table><tr><td>[Year]<td>[Tons]<tr><td>[1990]<td>[12]</table>"
    "<p>[The second paragraph is somewhat longer than the first one was.]</p></article><section id=comments><p>I do not believe a single word of this long article at all.</p></section>",
)


def test_pages_of_other_makers():
    import re

    for page in OTHER_PAGES:
        want = [re.sub("<[^>]*>", "", x) for x in re.findall(r"\[(.*?)\]", page)]
        assert text(page.replace("[", "").replace("]", "")) == " ".join(want)


def test_query_against_sql(spark):
    import duckdb

    rows = [(k, f"u{k}", f"{NAV}<article><h1>T {k}</h1><p>a &amp; <b>b{k}</b><p>{LONG} &lt; 2</article><footer>{LONG}</footer>") for k in range(30)]
    rows += [(40, "x", None), (41, None, ""), (42, "y", f"<div class=ad>{P(LONG)}</div><article>{P(LONG)}")]
    pages = spark.createDataFrame(rows, PAGE)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = sorted(map(tuple, html_extract.html_extract_digest(pages).collect()))
    assert [r[2:] for r in got] == [r[2:] for r in sorted(con.sql(html_extract.ORACLE).fetchall())]


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", f"<article>{P(LONG)}</article>", "a", "b")], "page_id long, url string, html string, page string, c0 string")
    got = html_extract.extract_text(pages).first()
    assert (got.page, got.c0, got.text) == ("a", "b", LONG)


def test_tree_on_other_pages():
    tree = html_extract.train_tree()
    right = total = 0
    for page in html_extract.labelled_pages(200, seed=99):
        blocks = html_extract.read_blocks(page)
        if blocks:
            main = tree.predict(html_extract.features(blocks)) >= 0.5
            right += sum(bool(b.label) == m for b, m in zip(blocks, main, strict=True))
            total += len(blocks)
    assert right / total > 0.97


def test_query(spark):
    rows = [(1, "u", f"<article>{P(LONG)}</article>"), (2, None, None), (1, "u", f"<article>{P(LONG)}</article>"), (None, "x", f"<article>{P('é ' * 60_000)}</article>")]
    pages = spark.createDataFrame(rows, PAGE)
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html_extract.html_extract_digest(pages).collect()), key=str)
    assert got == sorted([(1, "u", len(LONG)), (1, "u", len(LONG)), (2, None, 0), (None, "x", 119_999)], key=str)
    more = html_extract.extract_text(pages.withColumns({"text": F.lit("mine"), "other": F.lit(2)}))
    assert more.columns == ["page_id", "url", "html", "other", "text", "n_chars"] and more.first().other == 2
    assert html_extract.html_extract_digest(spark.createDataFrame([], PAGE)).count() == 0
