from ledgerlake.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><header>site</header><nav><ul><li>m</ul></nav>
<div class="cookie-notice">ok?</div><article><header><h1>Title &amp; more</h1></header><p><b>one<br>two</b> <a href="x">link</a>&nbsp;end
 <div class="ad">buy</div><p>three<ul><li>a<li>b &lt;c&gt;</ul><table><tr><td>1<td>2</table><form><p>f</form><section id="comments"><p>c</section><p>a < b</article><aside>s</aside><footer>&copy;</footer>"""


def text_of(page, *others):
    tree = h.tree_of(page)
    for other in others:
        tree = h.align(tree, h.tree_of(other))
    return h.main_text(page, frozenset(h.main_paths(tree, bool(others))))


def test_main_text():
    assert text_of(PAGE) == "Title & more\none two link end\nthree\na\nb <c>\n1\n2\na < b"


def test_no_landmark_uses_what_varies():
    page = lambda x: f"<body><div>Welcome to the site</div><div class='x'><p>{x}</p><p>more {x}</p></div><div><a href=1>home</a></div></body>"
    assert text_of(page("one text"), page("other text"), page("third")) == "one text\nmore one text"


def test_wrapper_has_optionals_and_repeats():
    a, b = h.tree_of("<body><p>1<p>2<hr><dl><dt>a<dd>b<dt>c<dd>d</dl></body>"), h.tree_of("<body><h1>t</h1><p>1</body>")
    kids = h.align(a, b)[h.KIDS][0][h.KIDS]
    assert [(k[h.SIGN], k[h.OPTIONAL], k[h.REPEATED]) for k in kids] == [("h1", True, False), ("p", False, True), ("dl", True, False)]
    assert [k[h.SIGN] for k in kids[2][h.KIDS]] == ["dt", "dd"]


def test_odd_pages():
    for page in (None, "", "plain", "<", "<p", "<article><p>cut off", "<article>" * 3000 + "deep", "</p></div>", "<!-- never ended", "<script>x"):
        assert isinstance(h.main_text(page, frozenset(h.main_paths(h.tree_of(page or ""), False))), str)
    assert text_of("<article><p>cut off</p><p>her") == "cut off\nher" and text_of("<article><p>cut off</p><p cla") == "cut off"


def test_frames(spark):
    rows = [(1, "http://a.b/1", PAGE, "x"), (2, "http://a.b/2", PAGE, "x"), (3, None, None, "x"), (4, "http://c/", "", "x"), (5, "no scheme", "<main><p>hi</p></main>", "x"), (5, "no scheme", "<main><p>hi</p></main>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in h.extract(pages).collect()}
    assert found[1].main_text == found[2].main_text == text_of(PAGE) and found[3].main_text == found[4].main_text == "" and found[5].main_text == "hi" and found[5].host == "x"
    assert h.extract(pages).count() == 6 and h.extract(pages.limit(0)).count() == 0
    h_most, h.MAX_BROADCAST = h.MAX_BROADCAST, -1
    try:
        assert {r.page_id: r.main_text for r in h.extract(pages).collect()} == {k: r.main_text for k, r in found.items()}
    finally:
        h.MAX_BROADCAST = h_most


def test_pages_with_and_without_landmark(spark):
    rows = [(1, None, "<article><p>in one</article><div>menu"), (2, None, "<body><div class=content><p>first page</div>"), (3, None, "<body><div class=content><p>second page</div>"), (4, None, "<nav><article>x</article></nav><div class=content><p>third page</div>")]
    found = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.main_text for r in found} == {1: "in one", 2: "first page", 3: "second page", 4: "third page"}


def test_text_of_one_page_stays():
    page = lambda x, more="": f"<body><div>Welcome</div><div class='x'><p>{x}</p>{more}</div></body>"
    once = page("one", "<blockquote>said once</blockquote><h3>head</h3><table><tr><td>cell</table>")
    assert text_of(once, page("two"), page("three")) == "one\nsaid once\nhead\ncell"
    assert text_of(page("two"), once, page("three")) == "two"


def test_deep_text_stays():
    deep = "<div>" * 100
    assert text_of(f"<article><p>top</p>{deep}far down<div class=ad>buy</div><p>below</p>") == "top\nfar down\nbelow"
    assert text_of(f"<body>{deep}one<nav>menu</nav>", f"<body>{deep}two<nav>menu</nav>") == "one"
