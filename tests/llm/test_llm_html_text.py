import html
import re

from tidemark.llm import html_text as ht

TREE = ht.default_tree()


def test_tree_fits_its_table():
    for *row, label in ht.LABELLED:
        assert ht.classify(TREE, tuple(row)) == label


def test_page_furniture_goes():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script>
    </head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site, please accept them all.</div><!-- <p>never</p> -->
    <article class=post><h1>Head&shy;line</h1><p class="a">First <b>line<br>goes</b>\n on &lt;here&gt; &amp;amp; &#233;.
    <p>Short.<div class="ad">Buy now, it is cheap and good and new.</div><ul><li>An item of text<li>Another item of text</ul>
    <aside>An aside of some length that is not the article at all.</aside><p>Last &copy</article>
    <section id="comments"><p>I think that this is a very good article, thank you for it.</p></section>
    <form><p>Your name please, and the rest of it</p><input value="x"><button>Send</button></form>
    <footer>&copy; 2024 All rights reserved. More words in a footer.</footer></body></html>"""
    assert ht.main_text(page, TREE).split("\n\n") == [
        "Head\xadline", "First line goes on <here> &amp; é.", "Short.", "An item of text", "Another item of text", "Last ©"]


def test_without_article_element():
    text = "word " * 40
    page = f"<body><ul><li><a href=/>Home</a><li><a href=/>News</a></ul><div><p>{text}</p><p>{text}</div>"
    assert ht.main_text(page, TREE) == "\n\n".join([text.strip()] * 2)


def test_odd_pages():
    assert ht.main_text(None, TREE) == ht.main_text("", TREE) == ht.main_text("<p></p>", TREE) == ""
    assert ht.main_text("<article>plain < 3 and > 2 <b>x", TREE) == "plain < 3 and > 2 x"
    assert ht.main_text('<article><p title="a>b">x</p><p title="open>y</p>', TREE) != ""
    ht.main_text("<" * 20000, TREE)
    ht.main_text('<a "' * 3000, TREE)
    ht.main_text("<div>" * 20000 + "x", TREE)
    assert len(ht.main_text("<article>" + "<p>word" * 30000, TREE).split("\n\n")) == 30000


def test_anchors_and_odd_classes_lose_no_text():
    text = "Some words of a text that goes on for a while and then comes to its end here."
    assert ht.main_text(f"<article><h2 id=search>Search</h2><p>{text}</article>", TREE) == f"Search\n\n{text}"
    assert ht.main_text(f"<article><p>{text}<p class='widget-note'>A note on it.</article>", TREE) == f"{text}\n\nA note on it."
    assert ht.main_text(f"<main><div id='social-history'><p>{text}</div></main>", TREE) == text
    linked = "This page says <a href=x>that all of it stands on another page by now</a> and no more."
    assert ht.main_text(f"<body><p>{linked}</body>", TREE).startswith("This page says that")
    for mark in ["class=newsletter", "class='ad-label'", "class='share-buttons'"]:
        assert ht.main_text(f"<article><p>{text}<p {mark}>Take this offer now.</article>", TREE) == text, mark
    for mark in ["id=sidebar-left", "id=comments", "id='site-footer'", "class='promo-strip'"]:
        assert ht.main_text(f"<article><p>{text}</article><div {mark}><p>{text}</div>", TREE) == text, mark


def test_unmatched_end_tags_cost_one_pass():
    import time

    start = time.perf_counter()
    assert ht.main_text("<article>" + "<span>" * 60000 + "x" + "</i>" * 60000 + "</p>" * 60000, TREE) == "x"
    assert time.perf_counter() - start < 10


def test_wrappers_of_the_page_are_no_furniture():
    text = "Some words of a text that goes on for a while and then comes to its end here. " * 3
    body = f"<h1>A headline of words</h1><p>{text}</p><p>{text}</p>"
    wanted = "\n\n".join(["A headline of words", text.strip(), text.strip()])
    aside = "<nav><ul><li><a href=x>One</a></ul></nav>"
    comments = f'<section id="comments"><article class=comment><p>{text}</p></article><p>{text} {text} {text}</p></section>'
    article = f"<article>{body}</article>"
    for page in [f'<body class="no-sidebar">{aside}{article}', f'<html class="has-menu"><body class="menu">{aside}{body}',
                 f'<div class="page has-sidebar">{aside}{article}</div>', f'<div class="layout with-menu">{article}</div>{aside}',
                 f'<article class="post has-comments">{body}</article>{aside}', f'<div aria-hidden="false">{article}</div>',
                 f'<div title="The hidden cost">{article}</div>', f'<div data-x="a class=menu">{article}</div>',
                 f'<form id=f>{aside}{article}</form>', f"<form>{aside}{body}</form>", f'<div class="sidebar-left">{aside}{body}</div>',
                 f'<main><div class="sidebar-right">{article}</div></main>', f"{article}{comments}", f"<main>{article}{comments}</main>",
                 f'<article><div class="entry-header"><h1>A headline of words</h1></div><p>{text}</p><p>{text}</p></article>',
                 f'<article><header class="article-header"><h1>A headline of words</h1></header><p>{text}<p>{text}</article>']:
        assert ht.main_text(page, TREE) == wanted, page
    for mark in ["hidden", "style='display: none'", "class=sidebar", "class='x site-footer'", "role=navigation", "id=cookie-notice"]:
        assert ht.main_text(f"{article}<div {mark}><p>{text}</p></div>", TREE) == wanted, mark


def test_fixture_pages_give_the_article(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = ht.extract(pages.withColumn("text", pages["url"])).select("html", "text", "n_chars").collect()
    assert len(rows) == pages.count()
    for row in rows:
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert row.text == "\n\n".join(p for p in parts if p)
        assert row.n_chars == len(row.text)
    assert ht.extract(spark.createDataFrame([(1, None)], "page_id long, html string")).first().text == ""
    assert ht.extract(pages.limit(0)).count() == 0
