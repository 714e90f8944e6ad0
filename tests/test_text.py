"""Literal cases of text, address and markup expressions."""

import pytest
from pyspark.sql import functions as F

from deckweave.functions import text as T
from deckweave.functions import urls as U
from deckweave.operators import html


def values(spark, inputs, make):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r[0] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_noise(spark):
    assert values(spark, ["é", "12", "•", "...", "", None, "  ", "Of", "a1", "1234", "•••"], T.noise) == [True] * 7 + [False] * 3 + [True]


def test_badge(spark):
    texts = ["Passed", "Incomplete", "Inactive", "Locked", "", None, "zzz", " in-progress ", "pending"]
    assert values(spark, texts, T.badge) == ["passed", "passed", "pending", "locked", "unknown", "unknown", "unknown", "pending", "pending"]


def test_safe_name(spark):
    assert values(spark, [" A  b/c? ", "???", "", None, "x" * 200], T.safe_name) == ["A_b_c", "untitled", "untitled", "untitled", "x" * 120]


def test_numbered(spark):
    df = spark.range(1).select(*(T.numbered(F.lit(n)) for n in (1, 9, 10, 100)))
    assert list(df.first()) == ["01", "09", "10", "100"]


def test_course_code(spark):
    assert values(spark, ["see mat101a now", "AB12", None, "X CSC2030"], T.course_code) == ["MAT101A", "", "", "CSC2030"]


def test_latin(spark):
    assert values(spark, ["• “ñ” → ©", "日本", "é😀", None, "Å"], T.latin) == ['* "n" -> (c)', "??", "e?", None, "Å"]


def test_strip_tags(spark):
    assert values(spark, ["<b>a</b>&nbsp; b", "&amp;lt;", "x<br/>y", None], T.strip_tags) == ["a b", "<", "x y", None]


def test_sentence_and_list_marks(spark):
    assert values(spark, ["End.", "End.”", "and", "so:", "x\n"], lambda c: c.rlike(T.SENTENCE_FINAL)) == [True, True, False, True, False]
    assert values(spark, ["• a", "1. a", "A) a", "(b) x", "Ab", "12a"], lambda c: c.rlike(T.LIST_START)) == [True, True, True, True, False, False]


def test_asset_type(spark):
    assert values(spark, ["x.pdf?a=1", "x.PPTX", "x.ppt", "x.pdf#p2", "", None], U.asset_type) == ["pdf", "pptx", "ppt", "unknown", "unknown", "unknown"]


def test_asset_url(spark):
    viewer = "https://v.example/assets/library/pdfjs/web/viewer.html"
    texts = [f"{viewer}?file=%2Fa%2Fb.pdf&x=1", f"{viewer}?file=https%3A%2F%2Fo.example%2Fc.pdf", viewer, "https://h.example/d.pptx?x", "https://h.example/d.html", "no url.pdf", "", None]
    assert values(spark, texts, U.asset_url) == ["https://v.example/a/b.pdf", "https://o.example/c.pdf", "", "https://h.example/d.pptx?x", "", "", "", ""]


@pytest.mark.parametrize(("cookie", "request_path", "fits"), [("/a", "/a", True), ("/a", "/a/b", True), ("/a", "/ab", False), ("/a/", "/a/b", True), ("", "/x", True), (None, "/x", True)])
def test_cookie_path(spark, cookie, request_path, fits):
    assert spark.range(1).select(U.path_matches(F.lit(cookie).cast("string"), F.lit(request_path))).first()[0] is fits


@pytest.mark.parametrize(("domain", "host", "fits"), [(".x.org", "x.org", True), ("x.org", "m.x.org", True), ("x.org", "ax.org", False)])
def test_cookie_domain(spark, domain, host, fits):
    assert spark.range(1).select(U.domain_matches(F.lit(domain), F.lit(host))).first()[0] is fits


def test_segments_and_sections(spark):
    pages = spark.createDataFrame([(1, "<p> a  b </p><i>12.5</i><b> </b>x<u>c</u>"), (2, None), (3, "")], "k int, html string")
    assert [(r["k"], r["normalized"]) for r in html.segments(pages).orderBy("k", "pos").collect()] == [(1, "a b"), (1, "x"), (1, "c")]
    pages = spark.createDataFrame([(1, "<head><h1>no</h1></head>pre<h2 a=1>One</h2>body<h3>Two</h3>"), (2, "only <b>text</b>"), (3, "<h1>T</h1>")], "k int, html string")
    got = {(r["k"], r["section_no"]): r["text"] for r in html.sections(pages, "k").collect()}
    assert got == {(1, 1): "pre", (1, 2): "One\nbody", (1, 3): "Two", (2, 1): "only text", (3, 1): "T"}


def test_translate_markup_keeps_markup(spark):
    df = spark.createDataFrame([("a<p> x  y </p><b>12</b>z",)], "h string")
    assert df.select(html.translate_markup(F.col("h"), F.upper)).first()[0] == "a<p> X Y </p><b>12</b>z"


def test_cards_modules_assets(spark):
    page = """<table><tbody><tr><td><button class="card-course x" course="" description=" d " department="sci">MAT101 <span class="badge">In-progress</span></button><td><button class=card-course course=abc123><button class=card-course>none</button></table>"""
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string")
    got = [(r["col"], r["row_no"], r["code"], r["title"], r["status"]) for r in html.extract_cards(df).collect()]
    assert got[0] == (0, 0, "MAT101", "SCI MAT101", "pending") and got[1][:3] == (1, 0, "ABC123") and len(got) == 2
    rows = """<ul><li data-role="MBG-LINE" data-course="A1" data-status="passed" module-id="1" course-id="2"><span class="module-title"> T  x </span></li>
    <li data-role="MBG-LINE" module-id="3" course-id="2">plain<li data-role="MBG-LINE" course-id="2">no id</li></ul>"""
    df = spark.createDataFrame([("a1", rows)], "course string, html string")
    assert [r["title"] for r in html.extract_modules(df, course="course").collect()] == ["plain"]
    assert sorted(r["title"] for r in html.extract_modules(df, course="course", strict=False).collect()) == ["T x", "plain"]
    open_ = '<div class="module-body collapse show"><a endpoint-url=" u1 "></a><a endpoint-url="u1"></a></div><div class="collapse"><a endpoint-url="u2"></a></div>'
    df = spark.createDataFrame([(1, open_), (2, '<a endpoint-url="u3">'), (3, '<div class="collapse show">x</div><a endpoint-url="u4">')], "k int, html string")
    assert {r["k"]: r["urls"] for r in html.extract_assets(df).collect()} == {1: ["u1"], 2: ["u3"], 3: []}
