"""Main texts against the article's blocks, alignment against plain dynamic programming, template lines by differencing."""

import html as h
import random
import re

from helixloom.llm import html_text as X


def plain_article(page):
    """For pages with one article and no furniture inside: its blocks by regular expressions."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1)>", m[1] if m else "")
    return " ".join(t for b in blocks if (t := " ".join(h.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split())))


def test_query(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = X.op5_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text)


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment(monkeypatch):
    rng = random.Random(5)
    for most in (1 << 30, 12):
        monkeypatch.setattr(X, "MOST_BITS", most)
        for _ in range(400):
            a, b = ([rng.randrange(rng.choice([2, 5, 30])) for _ in range(rng.randrange(25))] for _ in range(2))
            got = [a[k] for k in sorted(X.shared_lines(a, b))]
            it = iter(b)
            assert all(x in it for x in got) and len(got) == lcs(a, b)


def test_marks_and_broken_markup():
    page = """<html><head><title>T</title></head><body><div id="site-header">S</div><main><h2>A&amp;B &lt;x&gt;</h2><p>one <b>tw</b>o<p>three
      <div class="share-box">Share <p>me</div><ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><aside>no</aside><form>f</form>
      <section class="comments"><p>reader</p></section><script>if (a < b) "</p>"</script><p hidden>gone</p> 5 < 6 <span>s</spa n>t</main><footer>F"""
    assert " ".join(t for m, t in X.lines(page) if m == X.ARTICLE) == "A&B <x> one two three x y c1 c2 5 < 6 st"
    for broken in (None, "", "<", "<p", "a<b", "<!-- x", "</p></p>x", "<article", "<p class='x", "<script>x", "<b><i></b>x</i>", "<a href=\"x>y"):
        X.lines(broken)
    assert X.lines("x<!-- y -->z<p>&#65;&nbsp;&am") == [(1, "xz"), (1, "A &am")]
    assert len(X.lines("<div>" * 3000 + "x")) == 1


def test_differencing(spark):
    shell = "<div>Site name</div><p>Since 1999</p>{}<p>All rights</p>"
    rows = [(k, f"http://a.org/n/{k}", shell.format(f"<p>story {k}</p>"), 1) for k in range(6)]
    rows += [(10, "http://b.org/x", shell.format("<p>alone</p>"), 1), (11, None, None, 1), (12, "http://a.org/n/3", shell.format("<p>story 3</p>"), 1), (13, "http://c.org/1", "<article><p>same</p></article><p>c</p>", 1), (14, "http://c.org/2", "<article><p>same</p></article><p>d</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r.text for r in X.extract(df).collect()}
    assert [got[k] for k in range(6)] == [f"story {k}" for k in range(6)] and got[12] == "story 3"
    assert got[10] == "Site name Since 1999 alone All rights" and got[11] == "" and got[13] == got[14] == "same"
    assert X.extract(df.limit(0)).count() == 0


def test_small_card_beside_main_text(spark):
    page = "<p>Site name</p><div><p>{}</p><p>second part of story {}</p></div><article><p>read on</p></article><p>All rights</p>"
    rows = [(k, f"http://a.org/n/{k}", page.format(f"a long story with number {k}", k)) for k in range(3)]
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"a long story with number {k} second part of story {k} read on" for k in range(3)}


def test_nearest_url_is_found_beyond_long_common_paths(spark):
    path = "/" + "x" * 80
    rows = [(1, f"http://h{path}/x/alpha", "<p>A</p><p>T1</p>"), (2, f"http://h{path}/x/alphb", "<p>B</p><p>T1</p>"), (3, f"http://h{path}/z", "<p>C</p><p>T2</p>")]
    got = {r.page_id: r.text for r in X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A", 2: "B", 3: "C T2"}


def test_head_without_end_tag():
    assert X.lines("<html><head><title>t</title><meta charset=utf-8><body><p>x</p>") == [(X.OTHER, "x")]
    assert X.lines("<head><style>s</style><div>y</div>") == [(X.OTHER, "y")] and X.lines("<head><title>t</title></head>z") == [(X.OTHER, "z")]


def test_very_long_page_and_clashing_names(spark):
    page = "<article>" + "".join(f"<p>line {k}</p>" for k in range(30_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a/1", page, "h", "p"), (2, "http://a/2", page + "<p>z", "h", "p")], "page_id long, url string, html string, host string, path string")
    want = " ".join(f"line {k}" for k in range(30_000))
    assert {r.page_id: r.text for r in X.extract(df).collect()} == {1: want, 2: want}
