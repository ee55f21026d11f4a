import html
import math
import re

import pytest

from tessera.llm import html_text as H


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a<p>b<li>c", "a\nb\nc"),
        ("<div>x<b>y</b> z<div>in</div>after</div>", "xy z\nin\nafter"),
        ('<nav>n</nav><div class="comments"><p>c</p></div><p>ok&nbsp;&nbsp; fine</p><footer>f', "ok fine"),
        ("<article><header><h1>T</h1></header><p>b<br>c</p><aside>n</aside><form>f</form></article><p>outside</p>", "T\nb c"),
        ("<script>if (a < b) '</p>'</script><p>1 < 2 &lt;3</p><style>p{}</style>", "1 < 2 <3"),
        ("<p>a<!-- <p>no --> b</p><p", "a b"),
        ("<table><tr><td>1<td>2<tr><td>3</table>t", "1\n2\n3\nt"),
        ('<main><p class="ad">x</p><p>&#8217;&eacute;&bogus;</p></main>', "’é&bogus;"),
        ('<div id="cookie-notice">c</div><div role="navigation">n</div><div hidden>h</div><p>t</p>', "t"),
        ("<p>a</b></i>b</p>c</div>d", "ab\ncd"),
        ("<head><title>t</title></head><body><h1>h</h1>x</body>", "h\nx"),
    ],
)
def test_main_text(source, want):
    assert H.main_text(source) == want


def test_articles_of_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", body))
        want = "\n".join(x for x in blocks if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.fixture(scope="module")
def site(spark):
    rows = [(k, f"http://a.example/{k}", f'<body><div class="top">The same words</div><div class="text"><p>Own text {k}</p><p>more {k * 7}</p></div><div class="end">The end</div></body>') for k in range(9)]
    rows += [(90, None, None), (91, "no url", ""), (92, "http://b.example/1", '<div class="top">The same words</div>'), (92, "http://b.example/1", '<div class="top">The same words</div>')]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


def test_style_tree_removes_what_repeats(site):
    got = {(r.page_id, r.text) for r in H.extract(site).collect()}
    assert {x for x in got if x[0] < 90} == {(k, f"Own text {k}\nmore {k * 7}") for k in range(9)}
    assert {x for x in got if x[0] >= 90} == {(90, ""), (91, ""), (92, "The same words")}


def test_importance(site):
    host = site.sparkSession.range(1).selectExpr("xxhash64('a.example')").first()[0]
    nodes, blocks = (x.collect() for x in H.style_tree(site.withColumn("host", H.host_of())))
    tree = [r for r in nodes if r.host == host]
    assert sum(r.importance < H.THRESHOLD for r in tree) == 2 and all(r.pages == 9 for r in tree)
    assert {(r.n, r.pages) for r in blocks if r.host == host} == {(9, 9)}


def texts_of(spark, pages):
    rows = [(k, f"http://a.example/{k}", x) for k, x in enumerate(pages)]
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_tree_decides_inside_an_article(spark):
    """Repeated branches and blocks go, varied ones stay, whatever a mild name says."""
    body = '<article><h1>Title {k}</h1><div class="author">By the same hand</div><p>Own words {k}</p><section class="legal"><p>Varied ruling {k}</p></section><p>Share this</p><div class="related"><p>Always these</p></div></article>'
    got = texts_of(spark, [body.format(k=k) for k in range(9)])
    assert got == {k: f"Title {k}\nOwn words {k}\nVaried ruling {k}" for k in range(9)}
    # Too few pages to tell: all stays but what HTML settles.
    got = texts_of(spark, [body.format(k=k) for k in range(3)])
    assert got[0] == "Title 0\nBy the same hand\nOwn words 0\nVaried ruling 0\nShare this\nAlways these"


def test_a_mild_name_halves_the_importance(spark):
    """A branch that shows one of three texts: kept without a name, removed with one."""
    body = '<article><p>Own words {k}</p><div class="{name}">{text}</div></article>'
    for name, stays in (("legal", False), ("lemma", True)):
        pages = [body.format(k=k, name=name, text=f"Text {k % 3}") for k in range(15)]
        assert ("Text 0" in texts_of(spark, pages)[0]) == stays


def test_copies_of_a_page_are_no_boilerplate(spark):
    long = " ".join(f"word{k}" for k in range(60))
    pages = [f"<article><h1>One</h1><p>{long}</p><p>tail</p></article>"] * 30 + [f"<article><h1>H{k}</h1><p>{long} {k}</p><p>t{k}</p></article>" for k in range(6)]
    got = texts_of(spark, pages)
    assert got[0] == f"One\n{long}\ntail" and got[31] == f"H1\n{long} 1\nt1"


def test_tree_against_brute_force(spark):
    """The merged tree of a small site by plain dictionaries."""
    pages = [f'<div class="top">Same</div><div class="mid"><p>a{k % 3}</p>{"<ul><li>x</li></ul>" * (k % 2)}</div><p>own {k}</p>' for k in range(8)]
    found = [H.page_features(x) for x in pages]
    shows = {}
    for page, features in found:
        for f in features:
            shows.setdefault(f, set()).add(page)
    above = {f[0]: paths for _, features in found for f, (_, paths) in features.items() if f[1] == "p"}
    want = {}
    for path in above:
        m = len(shows[(path, "p", 0)])
        styles = [len(v) for (p, kind, _), v in shows.items() if p == path and kind == "s"]
        entropy = -sum(n / m * math.log(n / m) for n in styles) / math.log(m) if m > 1 else 1.0
        leaves = [1 - math.log(len(v)) / math.log(n) if (n := len(shows[(p, "p", 0)])) > 1 else 1.0 for (p, kind, _), v in shows.items() if kind == "c" and path in above.get(p, [])]
        g = H.GAMMA ** len(styles)
        want[path] = (m, (1 - g) * entropy + g * (sum(leaves) / len(leaves) if leaves else 1.0))
    frame = spark.createDataFrame([(x, "h") for x in pages], "html string, host string")
    got = {r.path: (r.pages, r.importance) for r in H.style_tree(frame)[0].collect()}
    assert got.keys() == want.keys() and all(got[p][0] == want[p][0] and abs(got[p][1] - want[p][1]) < 1e-9 for p in want)


@pytest.mark.parametrize("piece", ["<b>", "<p>", "<div>", "<li>", "<article>", "<a href='", "<td>", "</b>", "<ul><li><p>"])
def test_time_grows_with_the_page_only(piece):
    import time

    began = time.perf_counter()
    H.main_text("<div class='ad'>" + piece * 100_000 + "end")
    assert time.perf_counter() - began < 6


def test_joined_by_host_where_branches_are_many(site, monkeypatch):
    want = sorted((r.page_id, r.text) for r in H.extract(site).collect())
    monkeypatch.setattr(H, "BROADCAST_BRANCHES", 0)
    assert sorted((r.page_id, r.text) for r in H.extract(site).collect()) == want


def test_empty(site):
    assert H.extract(site.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<div class="layout has-sidebar"><article><p>a</p></article></div>', "a"),
        ('<div id="page" class="no-header nav-open"><main><p>a</p></main></div>', "a"),
        ('<div class="widget"><div class="menu"><article><p>a</p></article></div><p>w</p></div>', "a"),
        ('<article><h1 class="article-header">T</h1><p class="legal-analysis">a</p><p class="share-prices">b</p><div class="related-work">c</div><p id="comment-on-x">d</p></article>', "T\na\nb\nc\nd"),
        ('<article><div class="post-header"><p>Lead</p></div><section class="legal"><p>Body</p></section><p id="related-work">r</p><p>end</p></article>', "Lead\nBody\nr\nend"),
        ('<p class=a">x</p><p title=">">y</p><p', "x\ny"),
        # Still noise: whole names, and an article among comments beside the page's own.
        ('<article><p class="x ad-banner">n</p><p>a</p></article><div class="comments"><article>c</article></div>', "a"),
    ],
)
def test_names_are_whole_and_spare_the_article(source, want):
    assert H.main_text(source) == want
