"""Main text of pages: hand-made pages of many kinds, and the given pages beside a plain reading of their one layout."""

import re
from html import unescape

import pytest
from luminal.llm.html import main_text, main_texts

SF = "/root/testdata/sf0.01"
LONG = "Rivers carry sand, silt and stones, and over a long time they wear valleys into the rock that they cross."
MORE = "Glaciers do the same work, slower still, with the weight of ice, and leave broad valleys when they go."
SHORT = "So it goes."


def page(body, head="<title>A title</title><style>p{color:red}</style><script>var t='</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "article among all else": (
        page(f"<header><h1>The Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Rivers</h1><p>{LONG}</p><p>{SHORT}</p></article><aside><p>{MORE}</p></aside><footer><p>{MORE}</p></footer>"),
        ["Rivers", LONG, SHORT],
    ),
    "containers by class": (
        page(f'<div class="site-header">The Site</div><div id="cookie-notice"><p>{MORE}</p></div><div class="wrap"><div class="content"><h2>Rivers</h2><p>{LONG}</p><p>{SHORT}</p><p>{MORE}</p></div><div class="sidebar"><p>{MORE}</p><p>{MORE}</p></div></div><div id="footer">{LONG}</div>'),
        ["Rivers", LONG, SHORT, MORE],
    ),
    "comments longer than the text": (
        page(f'<article><h1>Rivers</h1><p>{LONG}</p></article><section id="comments"><h3>2 comments</h3>' + f'<article class="comment"><p>{MORE} {MORE}, {MORE}</p></article>' * 5 + "</section>"),
        ["Rivers", LONG],
    ),
    "comments and an advert inside the article": (
        page(f'<main><article><header><h1>Rivers</h1><p>By someone</p></header><p>{LONG}</p><div class="ad-slot"><p>{MORE}</p></div><p>{MORE}</p><div class="comment-list"><p>{LONG}</p></div><footer>Tags</footer></article></main>'),
        ["Rivers", LONG, MORE],
    ),
    "no class at all": (page(f'<table><tr><td><a href="/a">One page</a> <a href="/b">Another page</a> <a href="/c">And a third of them</a></td></tr></table><div><h1>Rivers</h1><p>{LONG}</p><p>{MORE}</p></div>'), ["Rivers", LONG, MORE]),
    "sections of one container": (page(f"<div><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{MORE}</p></section></div>"), ["One", LONG, "Two", MORE]),
    "bare body": (page(f"<h1>Rivers</h1><p>{LONG}<p>{MORE}"), ["Rivers", LONG, MORE]),
    "text straight in a div, lines by br": (page(f"<div>{LONG}<br><br>{MORE}</div>"), [f"{LONG} {MORE}"]),
    "unclosed elements": (page(f"<article><h1>Rivers</h1><p><b>{LONG}<br><p>{SHORT}<ul><li>one<li>two</ul>{MORE}</article>"), ["Rivers", LONG, SHORT, "one", "two", MORE]),
    "a wrapper that names its sidebar": (page(f'<div class="content-sidebar-wrap"><main class="content"><p>{LONG}</p></main><div class="widget-area"><p>{MORE}</p></div></div>'), [LONG]),
    "a body that says it has a sidebar": (f'<html><body class="home with-sidebar"><div class="has-comments post"><p>{LONG}</p><p>{MORE}</p></div></body></html>', [LONG, MORE]),
    "hidden parts and forms": (page(f'<article><p>{LONG}</p><p hidden>{MORE}</p><div style="display: none">{MORE}</div><form><p>{MORE}</p><button>Send</button></form></article>'), [LONG]),
    "references and space": (page(f"<article><p>&lt;b&gt; &amp;amp; caf&eacute;&nbsp;&#8212;\n\t x&#x41;&copy &unknown; {LONG}</p></article>"), [f"<b> &amp; café — xA© &unknown; {LONG}"]),
    "inline elements join": (page(f"<article><p>un<b>break</b>able <a href=x>{SHORT}</a> {LONG}</p></article>"), [f"unbreakable {SHORT} {LONG}"]),
    "table in an article": (page(f"<article><p>{LONG}</p><table><tr><td>a</td><td>b</td></tr><tr><th>c<td>d</table></article>"), [LONG, "a b", "c d"]),
    "an empty block parts text": (page("<article>one<div></div>two<hr>three</article>"), ["one", "two", "three"]),
    "cut off in the text": (f"<html><body><nav>menu</nav><article><h1>Rivers</h1><p>{LONG[:40]}", ["Rivers", LONG[:39]]),
    "cut off in a tag": (f"<article><p>{LONG}</p><p class='x", [LONG]),
    "cut off in a script": (f"<article><p>{LONG}</p><script>if (a < b) {{ '<p>{MORE}</p>'", [LONG]),
    "cut off in a comment": (f"<article><p>{LONG}</p><!-- <p>{MORE}</p>", [LONG]),
    "only a heading": (page("<nav><a href=/>Home</a></nav><article><h1>Rivers</h1></article>"), ["Rivers"]),
    "no markup": (f"{LONG}\n{MORE}", [f"{LONG} {MORE}"]),
    "marks that are no tags": (page(f"<article><p>a < b and b > c, 1<2 {LONG}</p></article>"), [f"a < b and b > c, 1<2 {LONG}"]),
    "quotes hold an end": (page(f'<article><p title="a > b" data-x=\'</p>\'>{LONG}</p></article>'), [LONG]),
    "upper case": (f"<HTML><BODY><NAV>Menu</NAV><ARTICLE><H1>Rivers</H1><P>{LONG}</P></ARTICLE></BODY></HTML>", ["Rivers", LONG]),
    "nothing but a menu": (page("<nav><ul><li><a href=/>Home</a></li></ul></nav><footer>Bye</footer>"), []),
    "roles": (page(f'<div role="banner">Site</div><div role="main"><p>{LONG}</p><div role="complementary"><p>{MORE}</p></div></div><div role="contentinfo">{MORE}</div>'), [LONG]),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    html, want = CASES[name]
    assert main_text(html).split("\n") == (want or [""])


def test_null_and_empty():
    assert main_text(None) == main_text("") == main_text("<p") == main_text("<html>") == main_text("<!-- -->") == ""


def test_deep_and_long_pages():
    assert main_text("<div>" * 20_000 + LONG) == LONG
    assert main_text(f"<article>{'<b>' * 20_000}{LONG}{'</i>' * 20_000}</article>") == LONG
    assert main_text('<a href="' * 20_000 + LONG) is not None
    big = main_text("<article>" + f"<p>{LONG}</p>" * 50_000 + "</article>")
    assert len(big) == 50_000 * (len(LONG) + 1) - 1


def plain(html):
    """The article of the one layout that the given pages have."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", html or "", re.S)
    whole = re.sub(r"<[^>]*\Z", "", m[1]) if m else ""
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", whole))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    rows = main_texts(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(rows) == 250 and all(r.text == plain(r.html) and r.n_chars == len(r.text) for r in rows)


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, f"<p>{LONG}</p>", None, 2), (2, "", "", 3), (3, "<p>\U0001f600 é</p>" * 9, "y", 4)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, row int")
    out = main_texts(df).collect()
    assert sorted((str(r.page_id), r["row"], r.text, r.n_chars) for r in out) == sorted((str(i), k, main_text(h), len(main_text(h))) for i, h, _, k in rows)
    assert main_texts(df.limit(0)).count() == 0
