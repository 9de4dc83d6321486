"""HTML extraction (op 10)."""

import html
import re

from flowlens.llm import op10_html, registry
from tests.llm.cases import SF, sf_rows


def test_table_against_the_markup(spark):
    rows = {r["page_id"]: r for r in registry.QUERIES["op10_html_extraction"](spark, SF).collect()}
    pages = sf_rows("pages")
    assert len(rows) == len(pages)
    for p in pages:
        inside = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert rows[p["page_id"]]["text"] == want and rows[p["page_id"]]["n_chars"] == len(want)


FURNITURE = """<!doctype html><html><head><title>Not text</title><style>p{}</style></head><body class="has-sidebar">
<header class="site"><h1>Site name</h1></header><nav><a href="/">Home</a> <a href="/b">More</a></nav><div class="cookie-notice">We use cookies, please agree.</div>
%s
<div id="sidebar"><p>Most read today in this long list of things that people like.</p></div>
<section class="comments"><article><p>I liked this a lot, thank you for the fine text my friend.</p></article></section>
<form><label>Name</label><input value="x"><select><option>One</option></select><button>Send</button></form>
<script>var a = "<p>no</p>";</script><footer>&copy; 2024 Somebody</footer></body></html>"""
BODY = ("<h2>Tea &amp; toast</h2><p>First  paragraph with <a href='#'>a link</a>, <b>bold<br>words</b> and enough of them to be read as prose by anyone."
        "<p>Short.<div class='ad'>Buy now, this is an advert of some length.</div><ul><li>An item of the text that says something more.</ul>")
WANT = ("Tea & toast\nFirst paragraph with a link, bold words and enough of them to be read as prose by anyone.\nShort.\n"
        "An item of the text that says something more.")


def test_furniture_goes():
    assert op10_html.main_text(FURNITURE % f"<article>{BODY}</article>") == WANT
    assert op10_html.main_text(FURNITURE % f"<main>{BODY}</main>") == WANT
    assert op10_html.main_text(FURNITURE % f"<div class='content'>{BODY}</div>").startswith("Tea & toast\nFirst paragraph")


def test_cases(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<article><p>a &lt; b &#x41;&nbsp;c</article>"), (3, "u", "<article><p>a &lt; b &#x41;&nbsp;c</article>"),
             (None, "u", "<article>open <!-- never closed <p>x"), (5, "u", "<article><p>kept</p><script>while(1){ <p>lost"), (6, "u", "<<a < b>> & &bogus; <"),
             (7, "u", "<article>" + "<p>word " * 20000), (8, "u", "<div hidden>no</div><article><p style='display: none'>no</p>yes <span hidden>no</span>ok</article>")]
    df = spark.createDataFrame([p + ("x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    rows = {(r["page_id"], r["url"]): r for r in op10_html.extract(df).collect()}
    assert op10_html.extract(df).count() == len(pages)
    assert rows[1, "u"]["text"] == "" and rows[2, None]["n_chars"] == 0
    assert rows[3, "u"]["text"] == "a < b A c" and rows[None, "u"]["text"] == "open" and rows[5, "u"]["text"] == "kept"
    assert rows[7, "u"]["text"] == "\n".join(["word"] * 20000) and rows[8, "u"]["text"].endswith("ok")
    assert op10_html.extract(df.where("false")).count() == 0


def test_the_tree_fits_its_table():
    rows = op10_html.LABELLED
    assert sum(op10_html.decide(op10_html.tree(), r[:-1]) == r[-1] for r in rows) >= 0.95 * len(rows)


PROSE = "<p>" + "This is the main text of the page, with many words in it. " * 8 + "</p><p>And one more paragraph with enough words to count as text.</p>"
ASIDE = ("<div class='sidebar'><a href=x>Link one</a> <a href=y>two</a></div>"
         "<div id='comments'><p>Nice post, thank you for sharing this with all of us here.</p></div>")


def page(around):
    return f"<html><body><nav><a href=a>Home</a></nav>{around % (PROSE, ASIDE)}<footer>c</footer></body></html>"


def test_wrappers_named_after_parts_keep_their_text():
    want = op10_html.main_text(page("<article>%s</article>%s"))
    assert want.count("main text") == 8 and want.endswith("count as text.")
    for around in ('<div class="layout has-sidebar">%s%s</div>', '<div class="no-sidebar"><article>%s</article>%s</div>', '<div id="main-form-page">%s%s</div>',
                   '<div class="post-with-comments"><article>%s</article>%s</div>', '<div class="nav-fixed"><main>%s</main>%s</div>',
                   '<div class="search"><article>%s</article>%s</div>', '<div class="sidebar">%s%s</div>'):
        assert op10_html.main_text(page(around)) == want, around
    got = op10_html.main_text(page('<article><div class="entry-header"><h1>Head line here</h1></div>%s</article>%s'))
    assert got == "Head line here\n" + want
    assert op10_html.main_text(page("<div><button>Menu %s%s")).endswith(want)


def test_comments_stay_out_however_long():
    for around in ('<div class="comments-area"><article class="comment">%s</article>%s</div>', '<section id="comments">%s%s</section>',
                   '<article><p>Short story of the day, told in a few words only.</p></article><div class="comment-list"><article>%s</article>%s</div>'):
        assert "main text" not in op10_html.main_text(page(around)), around
