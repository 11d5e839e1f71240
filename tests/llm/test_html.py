from collections import Counter

from tapelens.llm import html_model

TEXT = "Some words of a sentence, and others. More of the same follows here; then it ends."
LINKS = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(8))


def test_layouts_and_unmarked_pages(spark):
    model = html_model.Model(html_model.training_counts(spark.createDataFrame([], "html string")))
    page = (f'<html><head><title>no</title><style>p{{}}</style></head><body><header><p>{TEXT}</p></header><nav><ul>{LINKS}</ul></nav>'
            f'<div class="cookie-banner"><p>We use cookies. {TEXT}</p></div><div id="content"><h1>Head &amp; line</h1>'
            f"<p>First <b>bold</b>part,\n with <a href='/x'>a link</a>.<p>{TEXT}<br>Next&eacute; {TEXT}</p></div>"
            f'<aside class="sidebar"><p>{TEXT}</p><ul>{LINKS}</ul></aside><form><p>{TEXT}</p></form>'
            f'<div class="comments"><div class="comment"><p>{TEXT}</p></div></div><script>var x = "<p>";</script><footer><p>{TEXT}</p></footer>')
    assert html_model.main_text(page, model) == (
        f"Head & line First boldpart, with a link. {TEXT} {TEXT} Nexté {TEXT}".replace(f"{TEXT} {TEXT} Nexté", f"{TEXT} Nexté"))


def test_messages_give_the_exact_marginals():
    import itertools
    import math

    page = html_model.Page("<div><p>One, two.</p><ul><li>a</li><li>b</li></ul></div>")
    model = html_model.Model(html_model._count((p, p.gold) for p in map(html_model.Page, html_model._layouts())))
    own = model.own(page)
    total, content = 0.0, Counter()
    for rest in itertools.product((0, 1), repeat=len(page.tags) - 1):
        y = (0, *rest)
        weight = math.prod(model.link(page, i)[y[page.parents[i]]][y[i]] * math.exp(own[i] * y[i]) for i in range(1, len(y)))
        total += weight
        for i, v in enumerate(y):
            content[i] += v * weight
    for i, p in enumerate(model.marginals(page)):
        assert abs(p - content[i] / total) < 1e-9


def test_articles_of_sampled_pages(spark):
    def html(i):
        return (f"<!DOCTYPE html><html><head><title>t</title></head><body><nav><ul>{LINKS}</ul></nav><div class='ad'>{TEXT}</div>"
                f"<article><h1>Title {i}</h1><p>{TEXT} {i}</p><p>Short.</p></article><footer>&copy; {TEXT}</footer>")

    rows = [(i, f"u{i}", html(i)) for i in range(40)] + [(90, None, None), (None, "u", ""), (91, "u", "no tags & \x00"),
                                                       (92, "u", "<div>" * 3000), (93, "u", "<p>" * 50000 + "end")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text")
    got = {r.page_id: r.text for r in html_model.extract(pages).collect()}
    for i in range(40):
        assert got[i] == f"Title {i} {TEXT} {i} Short."
    assert got[90] == got[None] == got[92] == ""
    assert html_model.extract(pages.limit(0)).collect() == []


def read(html):
    return "".join(text for _, text, _ in html_model.Page(html).runs)


def test_malformed_pages_are_read_as_far_as_they_go():
    assert read("<p>a<![foo[bar]]>b</p>") == "ab"
    assert read("<p>a<![if !IE]>b<![endif]>c<![CDATA[x > y]]>d<![") in ("abcd", "abcd<![")
    assert read("<!DOCTYPE html [<!ELEMENT x>]><p>a</p>") == "a"
    assert read("<!doctype html><p>a<!-- b --><!x y>c</p>") == "ac"
    for cut in range(60):
        read('<![cdata[ a ]]><!DOCTYPE x [<!y>]><p class="z">a &am <b'[:cut])


def test_deep_pages_take_linear_time():
    import time

    start = time.perf_counter()
    page = html_model.Page("<div>" * 50_000 + "<p>" + "<span>" * 50_000 + "deep" + "</b>" * 50_000)
    assert time.perf_counter() - start < 3
    assert len(page.tags) == 50_002 and [t for _, t, _ in page.runs] == ["deep"]


def test_formulas_and_fallback_texts_are_text(spark):
    model = html_model.Model(html_model.training_counts(spark.createDataFrame([], "html string")))
    page = f"<article><p>The area is <math><mi>r</mi><mo>*</mo><mi>r</mi></math> squared. {TEXT}</p><p>{TEXT} <audio>Clip.</audio></p></article>"
    assert html_model.main_text(page, model) == f"The area is r*r squared. {TEXT} {TEXT} Clip."
