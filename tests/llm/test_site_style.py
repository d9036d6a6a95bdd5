from notegrid.llm import site_style
from notegrid.llm.site_style import Page

PAGE = "page_id long, url string, html string, host string, text string"
FRAME = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><div id="cookieNotice">We use cookies</div>
%s<aside>side</aside><div class="sidebar-left">side</div><form>Name <input></form><section id="comments"><article class="comment">me too</article></section>
<footer>&copy; foot</footer></body></html>"""


def text(html):
    return Page(html).text()


def test_article_without_its_surroundings():
    body = "<article><h1>Head  line</h1><p><b>One &amp; two<br><p>Thr<b>ee</b>\n four</p><!-- no --><div class='share'>Share</div><p>&lt;five&gt;&nbsp;6</article>"
    assert text(FRAME % body) == "Head line One & two Three four <five> 6"


def test_page_without_article_and_broken_markup():
    assert text(FRAME % "<div><p>Body<p>text</div>") == "Body text"
    assert text("<p>a<p>b &am") == "a b &am"
    assert text('<article><p>a</p><a href="unclosed') == "a"
    assert text("<article>x<script>var a = 1;") == "x"
    assert text("a < b and 3 > 2") == "a < b and 3 > 2"
    assert text("<!-- open <p>gone") == "" and text("") == ""
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<article>in<span class='ad'>ad</span>side</article>") == "in side"
    assert text("<p style='display: none'>no</p><p hidden>no</p><p>yes</p>") == "yes"
    assert text("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == "a b c d"


def test_branches_repeated_over_a_host_are_removed(spark):
    pages = []
    for i in range(30):
        body = f"<div class='body'><p>story {i} told</p><p>end {i}</p></div><div class='strip'><span>Call us today</span></div>"
        pages.append((i, "http://a.example/x", f"<html><body>{body}</body></html>", "clash", "clash"))
        pages.append((100 + i, "http://copies.example/", "<body><div class='body'><p>the same story</p></div></body>", None, None))
    pages += [(500, None, None, None, None), (501, "http://a.example/y", "", None, None), (502, "nonsense", "<p>x</p>", None, None),
              (0, "http://a.example/x", pages[0][2], None, None), (503, "http://a.example/z", "<p>" + "long " * 100_000, None, None)]
    df = spark.createDataFrame(pages, PAGE)
    got = site_style.extract(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r for r in got}
    for i in range(30):
        assert by[i].text == f"story {i} told end {i}"
        assert by[100 + i].text == "the same story"
    assert by[500].text == by[501].text == "" and by[502].text == "x" and by[503].n_chars == 499_999
    assert all(r.n_chars == len(r.text) for r in got)
    low = {r.host: r.paths for r in site_style.low_branches(df).collect()}
    assert any("strip" in p for p in low["a.example"]) and not any("body>div.body" in p for p in low["a.example"])
    assert site_style.extract(df.limit(0)).count() == 0


def of(spark, pages):
    return {r.page_id: r.text for r in site_style.extract(spark.createDataFrame([(*p, None, None) for p in pages], PAGE)).collect()}


def test_marks_are_weighed_not_obeyed(spark):
    story = [f"Story {i} tells of place {i * 7} and what was seen there on day {i * 3}. " * 8 for i in range(12)]
    pages = [(i, "http://teaser.example/", f"<body><article class='card'>See {i}</article><div><p>{s}</p></div></body>") for i, s in enumerate(story)]
    pages += [(100 + i, "http://form.example/", f"<body><form><div><p>{s}</p></div><aside>side</aside></form></body>") for i, s in enumerate(story)]
    pages += [(200 + i, "http://nav.example/", f"<body><nav>Home</nav><div class='sidebar'><p>{s}</p></div></body>") for i, s in enumerate(story)]
    pages += [(300, "http://one.example/", f"<body><nav>Home</nav><div class='widget'><p>{story[0]}</p></div></body>")]
    got = of(spark, pages)
    for i, s in enumerate(story):
        assert got[i].endswith(s.strip()) and got[100 + i] == s.strip() and got[200 + i] == s.strip()
    assert got[300] == story[0].strip()
    assert text(f"<div>{story[0]}</div><section class='comments'>{story[1]}</section>") == story[0].strip()


def test_low_branches_are_judged_one_by_one(spark):
    terms = "<div class='terms'><p>These terms bind all readers of this site. " + "Nothing here may be copied, told or sold. " * 4 + "</p></div>"
    copy = "<div class='body'><h1>Same head</h1><p>" + "The same long story. " * 20 + "</p></div>"
    pages = [(i, "http://short.example/", f"<body><div class='body'><p>Short story number {i} of the host</p></div>{terms}</body>") for i in range(20)]
    pages += [(100 + i, "http://copies.example/", f"<body>{copy}<div class='count'>Visit {i}</div></body>") for i in range(20)]
    strip = "<div class='strip'>Call us</div>"
    pages += [(200 + i, "http://few.example/", f"<body><div><p>Text {i} is here</p></div>{strip * 4}</body>") for i in range(3)]
    pages += [(300, "http://again.example/", f"<body><div><p>Text is here</p></div>{strip}</body>")] * 12
    got = of(spark, pages)
    for i in range(20):
        assert got[i] == f"Short story number {i} of the host"
        assert got[100 + i] == "Same head " + ("The same long story. " * 20).strip() + f" Visit {i}"
    low = {r.host: r.paths for r in site_style.low_branches(spark.createDataFrame([(*p, None, None) for p in pages], PAGE)).collect()}
    assert any("terms" in p for p in low["short.example"]) and "few.example" not in low and "again.example" not in low
