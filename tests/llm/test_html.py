import pytest
from pyspark.sql import functions as F

from remitta.llm import html_tree as T


@pytest.fixture(scope="module")
def model():
    return T.fit([T.labelled(h) for h, _ in T.generated(200)], epochs=20)


def test_unseen_pages_of_the_generator(model):
    pages = T.generated(150, seed=77)
    same, f1 = 0, []
    for h, want in pages:
        got, _ = model.extract(h.replace(' data-y="1"', ""))
        same += got == want
        a, b = set(got.split("\n")), set(want.split("\n"))
        f1.append(2 * len(a & b) / (len(a) + len(b)))
    assert same / len(pages) > 0.85 and sum(f1) / len(f1) > 0.97


PAGE = """<!DOCTYPE html><html><head><title>t &amp; u</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-banner">We use cookies to improve things. <button>OK</button></div><article><h1>The  headline&nbsp;here</h1><p>First <b>bold</b> paragraph &mdash; with text, and more of it.
 Second line.<p>Unclosed one &lt;tag&gt; here. It goes on.<!-- a comment --><ul><li>item one of the list</li><li>item two of the list</ul><div class="ad">Buy now!</div></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this one very much.</p></div></section><footer>&copy; 2024 Site</footer></body></html>"""


def test_a_page(model):
    text, confidence = model.extract(PAGE)
    assert text == "The headline here\nFirst bold paragraph — with text, and more of it. Second line.\nUnclosed one <tag> here. It goes on.\nitem one of the list\nitem two of the list"
    assert confidence > 0.5


@pytest.mark.parametrize("source", ["", "<", "<<<>>>", "plain", "</p></div>", "<p", "<!-- never closed", "<script>alert(1)", "<a href='x>y", "<div>" * 3000 + "deep", "<p>" * 2000, "&#xFFFFFF; &#0; &nosuch; &"])
def test_odd_markup(model, source):
    text, confidence = model.extract(source)
    assert isinstance(text, str) and 0 <= confidence <= 1


def test_marginals_are_exact(model):
    """Against summing over all labellings of a small tree."""
    import itertools
    import math

    page = T.Page("<div><p>a b c</p><ul><li>x</li></ul></div>")
    _, score = model.features(page)
    n = len(score)
    total, on = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        e = sum(s * v for s, v in zip(score, y)) + sum(model.pair[T._kind(page.tags[i])][2 * y[page.parent[i]] + y[i]] for i in range(1, n))
        p = math.exp(e)
        total += p
        for i in range(n):
            on[i] += p * y[i]
    got, _ = model.marginals(page, score)
    assert all(abs(a - b / total) < 1e-6 for a, b in zip(got, on))


def test_rows(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>x</p>"), (1, "u", PAGE), (4, "u", "<article><p>" + "Long text goes on. " * 50_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = T.main_text(spark, df, model=model).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[2].text == by[3].text == "" and by[2].n_chars == 0 and by[2].url is None
    assert by[1].n_chars == len(by[1].text) and by[4].n_chars > 900_000
    assert T.main_text(spark, df.limit(0), model=model).count() == 0
    assert T.main_text(spark, df).count() == len(rows)


def test_tables_of_an_article_and_what_stands_for_scripts(model):
    table = "<table><tr><th>Year</th><th>Crop of wheat</th></tr><tr><td>2001</td><td>17 tons</td></tr><tr><td>2002</td><td>21 tons</td></tr></table><noscript><p>Please turn on scripts to read this page.</p></noscript>"
    text, _ = model.extract(PAGE.replace("<!-- a comment -->", table))
    assert "Year\nCrop of wheat\n2001\n17 tons\n2002\n21 tons\nitem one" in text and "scripts" not in text


def test_trees_are_built_in_linear_time():
    import time

    def took(n: int, make) -> float:
        source, best = make(n), 9.0
        for _ in range(3):
            began = time.perf_counter()
            T.Page(source)
            best = min(best, time.perf_counter() - began)
        return best

    for make in (lambda n: "<div>" * n + "</b>" * n, lambda n: "<div>" * n + "<li>x" * n, lambda n: "<p>" + "<b>" * n + "<div>" * n + "<p>x</p>" * n, lambda n: "<div><p>" * n + "</p>" * n):
        assert took(16_000, make) < 3.2 * took(8000, make) + 0.05
    assert T.Page("<p>a<b>b<div>c").parent == [-1, 0, 1, 0] and T.Page("<ul><li>a<ul><li>b<li>c</ul><li>d").parent == [-1, 0, 1, 2, 3, 3, 1]


def test_formulas_drawings_and_objects_are_text(model):
    inside = '<p>Energy is <math><mi>E</mi><mo>=</mo><msup><mi>mc</mi><mn>2</mn></msup></math> as everybody knows by now.</p><svg><style>x{}</style><text>A label of the drawing</text></svg><object data="x"><p>What the object says to readers, at length.</p></object>'
    page = T.Page(f"<body><article>{inside}</article></body>")
    assert page.text([True] * len(page.tags)) == "Energy is E=mc2 as everybody knows by now.\nA label of the drawing\nWhat the object says to readers, at length."
    text, _ = model.extract(PAGE.replace("<!-- a comment -->", inside))
    assert "E=mc2" in text and "What the object says" in text
