import html as H
import re

import pytest

from cosignal.llm import main_text as M
from cosignal.llm.queries import op12_main_text

from .helpers import SF

P1 = "The river rose again in the night, and the village, built on old stones, stayed dry until the morning."
P2 = "Nobody had expected it, least of all the miller, who had slept through the storm, the bells, and the dogs."
P3 = "By noon the water was gone."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul>'


def text(page):
    return " ".join(M.extract(page))


def page(body, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T, t</title><style>p,a{{}}</style></head><body>{before}{body}{after}</body></html>"


FURNITURE = [
    f"<nav>{MENU}</nav>", f"<div class='main-menu'>{MENU}</div>", "<header><h1>Site name</h1><p>Daily, and fresh.</p></header>",
    "<footer>&copy; 2024, all rights, reserved</footer>", "<aside><p>See also, this, that and more of it, too.</p></aside>",
    "<div id=sidebar><p>Popular, much read, and very long text about other things, really.</p></div>",
    "<div class='cookie-notice'><p>We use cookies, as all do, to make things, well, better.</p></div>",
    "<div class='ad'>Buy now, cheap, good, and fast, before it is gone, today.</div>",
    "<form action=/s><label>Name, please</label><input name=q><button>Go, now</button><textarea>x, y</textarea></form>",
    "<script>var t='</p>, <article>no, no</article>';</script>", "<style>p > a, b {}</style>", "<!-- <p>no, no, no</p> -->",
    "<div class=comments><article class=comment><p>First, I say, and first again, dear reader!</p></article></div>",
    "<section id='user-comments'><p>Great, really great, thanks, all.</p></section>",
    "<div role=complementary><p>Aside, of course, from that.</p></div>", "<p hidden>Not, to be, seen.</p>",
    "<noscript><p>Please, please, enable scripts.</p></noscript>", "<div class='promo banner'><p>Win, win, win!</p></div>",
    f"<div>{MENU}{MENU}</div>", "<svg><text>pic, ture</text></svg>", "<iframe src=x>frame, text</iframe>",
    "<div style='display: none'><p>Hidden, very hidden.</p></div>", "<div class=siteFooter>Imprint, terms</div>",
]
SHAPES = [
    "<article><h1>Flood</h1><p>{0}</p><p>{1}</p><p>{2}</p></article>",
    "<div class=content><h1>Flood</h1><p>{0}</p><p>{1}</p><p>{2}</p></div>",
    "<main><h1>Flood</h1><div><p>{0}</p><p>{1}</p></div><p>{2}</p></main>",
    "<div id=page><div class='post has-sidebar'><h1>Flood</h1><div class=entry><p>{0}<p>{1}<p>{2}</div></div></div>",
    "<article><h1>Flood</h1><section><p>{0}</p></section><section><p>{1}</p><p>{2}</p></section></article>",
    "<table><tr><td><h1>Flood</h1><p>{0}<p>{1}<p>{2}</table>",
]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("extra", FURNITURE)
def test_furniture_goes_and_the_article_stays(shape, extra):
    body = shape.format(P1, P2, P3)
    want = f"Flood {P1} {P2} {P3}"
    assert text(page(body)) == want
    assert text(page(body, extra, extra)) == want
    if "article" in shape and "<header>" not in extra:     # an article's own header holds its title
        assert text(page(body.replace(P2, P2 + "</p>" + extra + "<p>", 1).replace("<p></p>", ""))) == want


def test_inline_markup_references_and_white_space():
    assert text("<p>a<b>b</b><i>c</i> &amp;&lt;x&gt; &#233;&eacute;&nbsp;&amp &am <br>z\n\t y</p>") == "abc &<x> éé & &am z y"
    assert text("<article><p><b>one<br><p>two</b> three</article>") == "one two three"
    assert text("<article>x<p>y</article>") == "x y"
    assert text("plain text, no tags at all") == "plain text, no tags at all"
    assert text("<p>1 < 2 and 3 > 2 </ p> <3 a</p>") == "1 < 2 and 3 > 2 <3 a"
    assert text("<p title='a > b' x=\"<p>\">kept</p>") == "kept"
    assert text("<p>kept</p><div class=\"a") == "kept"
    assert text("<P>up<SCRIPT>x</p></Script >per</P>") == "upper"


def test_an_article_inside_a_form_or_with_inner_furniture():
    assert text(f"<form><div class=menu>{MENU}</div><article><p>{P1}</p><input><label>q</label></article></form>") == P1
    body = f"<article><header><h1>Flood</h1></header><p>{P1}</p><ul><li>one</li><li>two</li></ul><footer>By me</footer></article>"
    assert text(page(body)) == f"Flood {P1} one two"
    assert text(page(f"<div class=post><div class=post-header><h2>Flood</h2></div><p>{P1}</p></div>")) == f"Flood {P1}"


def test_siblings_of_the_container():
    body = f"<div><p>{P1}</p><p>{P2}</p></div><p>{P2}</p><p>short</p><div><p>{P1}</p></div>"
    assert text(page(f"<div id=x>{body}</div>")) in (f"{P1} {P2} {P2} short {P1}", f"{P1} {P2} {P2} {P1}")


def test_short_articles_beat_long_adverts():
    assert text(page("<article><p>Ti.</p></article>", f"<div class=ad>{P1} {P2}</div>", f"<footer>{P2}</footer>")) == "Ti."


def test_deep_and_long_pages_stay_linear():
    deep = "<div>" * 200_000 + P1 + "</div>" * 200_000
    assert text(deep) == P1
    n = 200_000
    assert len(M.extract("<article>" + "<p>word, word" * n + "</article>")) == n
    assert text("<article>" * 50_000 + P1) == P1
    assert M.extract("<a b='" * 100_000) == [] and M.extract("<!--" * 200_000) == []
    assert text("<b>" * 100_000 + "x" + "</i>" * 100_000) == "x"


def test_awkward_rows(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "  \n ", None), (4, "u", page(SHAPES[0].format(P1, P2, P3)), "t"),
            (4, "u", page(SHAPES[0].format(P1, P2, P3)), "t"), (None, None, f"<p>{P1}", "t"), (5, "u", "<p></p><div></div>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = M.extract_pages(pages).collect()
    assert [(r.doc.page_id, r.text, r.n_blocks) for r in got] == [
        (1, "", 0), (2, "", 0), (3, "", 0), (4, f"Flood {P1} {P2} {P3}", 4), (4, f"Flood {P1} {P2} {P3}", 4),
        (None, P1, 1), (5, "", 0)]
    assert [r.doc.text for r in got] == [r[3] for r in rows]
    assert M.extract_pages(pages.limit(0)).count() == 0


def test_query_whole_table(spark):
    """The test pages mark their article; cut it out and strip its tags by pattern."""
    given = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op12_main_text(spark, SF).collect()
    assert len(got) == len(given)
    for r in got:
        inside = re.search("<article>(.*)</article>", given[r.page_id].html, re.S).group(1)
        parts = re.split("</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", inside)))
        want = " ".join(filter(None, (" ".join(H.unescape(x).split()) for x in parts)))
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, want, len(want))
