import html
import json
import re

from draftsmith.llm import entries
from draftsmith.llm.wrapper import Template, extract_main_text, induce, main_text, match, parse
from tests.conftest import SF_SMALL


def page(title, paras, extra="", ad="Buy now"):
    body = "".join(f"<p>{p}</p>" for p in paras)
    return (
        f"<html><head><title>{title}</title><script>var t='<p>no</p>';</script></head><body><header>Site name</header><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
        f"<div class='ad'>{ad}</div><div id='content'><h1>{title}</h1>{body}</div><div class='box'>About this site and its people</div>{extra}<footer>&copy; all</footer></body></html>"
    )


def test_op6_is_the_article_of_the_given_pages(spark):
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = entries.QUERIES["op6_wrapper_extraction"](spark, SF_SMALL).collect()
    assert len(got) == len(src)
    for r in got:
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", src[r.page_id], re.S)
        parts = re.sub(r"<[^>]*>", "\x00", re.sub(r"</?b>", "", m[1])).split("\x00")
        want = " ".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())
        assert r.text == want and r.n_chars == len(want)


def test_template_of_a_host_without_article_elements():
    pages = [page(f"Title {i}", [f"First text {i} is long enough.", f"More {i} &amp; more.", *([f"Third {i}"] if i % 2 else [])], ad=f"Ad {i}") for i in range(5)]
    t = induce(pages)
    assert main_text(pages[1], t) == "Title 1 First text 1 is long enough. More 1 & more. Third 1"
    assert main_text(page("New", ["Only one paragraph here"]), t) == "New Only one paragraph here"  # the box is template


def test_comments_forms_and_notices_go():
    extra = "<div class='comments'><p>I disagree</p></div><form><label>Mail</label><input></form><div class='cookie-notice'>We use cookies</div><!-- x <p>y</p> -->"
    inside = "<article><header><h1>T</h1></header><p>Text <b>bold</b>text<br>next</p><aside>See also</aside><div class='share'>Share</div></article>"
    assert main_text(page("T", ["Body words."], extra), None).endswith("Body words. About this site and its people")
    assert main_text(f"<body>{extra}{inside}{extra}</body>", None) == "T Text boldtext next"


def test_names_that_only_tell_a_state():
    body = "<div class='content has-sidebar no-ads'><p>Kept text.</p><div class='sidebar left'>Gone</div><article class='comment'>Gone too</article></div>"
    assert main_text(f"<body>{body}</body>", None) == "Kept text."


def test_broken_markup():
    assert main_text("<article><p><b>one<br><p>two &am &ampx &lt;b&gt;<div>three <a href='x", None) == "one two &am &x <b> three"
    assert main_text("plain text only", None) == "plain text only"
    assert main_text("<p>a</p></div></p><p>b", None) == "a b"
    assert main_text("<script>never closed <p>x", None) == ""
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000, None) == "deep"
    assert main_text("<article><p>5 < 6 and 7 > 3</p></article>", None) == "5 < 6 and 7 > 3"


def test_nests_of_any_depth():
    for n in (100, 200, 5000):
        nest = "<div>" * n + "deep <aside>Ad</aside><nav><p>Menu</nav>" + "</div>" * n
        body = f"<body><div class='page'><article><p>Before.</p>{nest}<p>After.</p></article><div><p>Outside the article, a longer text than any in it</p></div></div></body>"
        assert main_text(body, None) == "Before. deep After."
        pages = ["<div>" * n + f"<div class='x'><p>Text {i} of page {i}</p></div><p>Same on all</p>" + "</div>" * n for i in range(3)]
        t = Template.load(json.loads(json.dumps(induce(pages).dump())))
        assert main_text(pages[1], t) == "Text 1 of page 1"


def test_many_unclosed_and_unopened_tags():
    assert main_text("<b>" * 30_000 + "</i></div>" * 30_000 + "text", None) == "text"


def test_simple_tree_matching():
    a, b = parse("<div><p>1</p><ul><li>x</li><li>y</li></ul><p>2</p></div>"), parse("<div><ul><li>z</li></ul><p>3</p><hr></div>")
    size, pairs = match(a, b)
    assert size == 5 and [(x.tag, y.tag) for x, y in pairs if x.tag != "#page"].count(("p", "p")) == 1


def test_edges(spark):
    rows = [(1, "http://h.example/1", None, "x"), (2, "http://h.example/2", "", "x"), (3, None, "<p>no host</p>", "x"), (4, "not a url", "<p>odd</p>", "x")]
    rows += [(10 + i, "https://H.example:80/p", page(f"T{i}", [f"Body {i} text.", "Same."]), "x") for i in range(12)]
    rows += [(50, "http://one.example/", page("Copy", ["Same page."]), "x")] * 3
    rows += [(60, "http://h.example/long", page("Long", [f"Paragraph {i} text." for i in range(3000)]), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = extract_main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[3] == "no host" and by[4] == "odd"
    assert by[13] == "T3 Body 3 text."  # outside article elements a constant node is template
    assert len([r for r in got if r.page_id == 50 and r.text.startswith("Copy Same page.")]) == 3
    assert by[60] == "Long " + " ".join(f"Paragraph {i} text." for i in range(3000))
    assert extract_main_text(pages.limit(0)).count() == 0


def test_constant_nodes_inside_articles_and_page_types(spark):
    def news(i):
        few = "<p>Shared by three.</p>" if i < 3 else ""
        return f"<body><main id='post-{i}'><div class='zz'>Read our other pages</div><p>News {i} of the day.</p>{few}<p>Even more {i}.</p><p>Printed in Town</p></main></body>"

    def shop(i):
        return f"<body><div class='shop'><div class='q'>Free delivery</div><section class='item'><h2>Item {i}</h2><p>Costs {i} coins.</p></section></div></body>"

    rows = [(i, "http://h.example/n", news(i)) for i in range(60)] + [(100 + i, "http://h.example/s", shop(i)) for i in range(15)]
    rows += [(200 + i, "http://same.example/", f"<body><nav>{i}</nav><article><p>One text.</p></article></body>") for i in range(20)]
    rows += [(300 + i, "http://few.example/", news(i)) for i in range(3)] + [(400, "http://copies.example/", news(7))] * 30
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(60):
        assert got[i] == f"News {i} of the day. {'Shared by three. ' if i < 3 else ''}Even more {i}."
    for i in range(15):
        assert got[100 + i] == f"Item {i} Costs {i} coins."
    assert all(got[200 + i] == "One text." for i in range(20))  # nothing else on the page
    assert got[301] == "Read our other pages News 1 of the day. Shared by three. Even more 1. Printed in Town"
    assert got[400] == "Read our other pages News 7 of the day. Even more 7. Printed in Town"
