"""Layout, fitting, alignment, catalogue and audit operators on small tables, against folds written out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from deckweave.operators import align, audit, catalog, fit, layout, reports, translate
from deckweave.plans import pipeline

ITEM = "doc int, page int, seq bigint, text string, x double, y double, font_size double, font_name string, width double"


def items(spark, rows):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], ITEM)


def test_y_buckets(spark):
    df = items(spark, [("t", 0.0, y, 10.0, None, None) for y in (700.0, 698.0, 695.5, 690.0, 697.2)])
    got = layout.y_buckets(df).groupBy("bucket").agg(F.count("*").alias("n"), F.max("bucket_y").alias("y")).orderBy("bucket").collect()
    assert [(r["n"], round(r["y"], 4)) for r in got] == [(3, 698.1), (1, 695.5), (1, 690.0)]


def test_y_buckets_against_fold(spark):
    rng = random.Random(2)
    ys = [float(rng.randint(0, 60)) for _ in range(300)]
    buckets = []
    for y in ys:
        for b in buckets:
            if abs(b[0] - y) <= 3:
                b[0], b[1] = (b[0] + y) / 2, b[1] + 1
                break
        else:
            buckets.append([y, 1])
    got = layout.y_buckets(items(spark, [("t", 0.0, y, 1.0, None, None) for y in ys])).groupBy("bucket").agg(F.count("*").alias("n"), F.max("bucket_y").alias("y")).orderBy("bucket").collect()
    assert [(r["n"], r["y"]) for r in got] == [(n, y) for y, n in buckets]


@pytest.mark.parametrize(("gap", "text", "joined"), [(4.5, "b", "ab"), (4.6, "b", "a b"), (9.0, " b", "a b")])
def test_gap_join(spark, gap, text, joined):
    df = items(spark, [("a", 0.0, 5.0, 10.0, None, 5.0), (text, 5.0 + gap, 5.0, 10.0, None, 5.0)]).withColumn("line", F.lit(1))
    assert layout.joined_text(df, ["doc", "page", "line"]).first()["text"] == joined


def test_containers_and_assignment(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 10.0, 10.0, 50.0, 50.0), (1, 1, 3, 0.0, 0.0, 4.0, 90.0), (1, 1, 4, 0.0, 0.0, float("nan"), 9.0), (1, 1, 5, 0.0, 0.0, 1e4, 1e4)], "doc int, page int, seq bigint, x double, y double, width double, height double")
    held = layout.containers(boxes, 1e6)
    assert {(r["seq"], r["container_id"]) for r in held.collect()} == {(1, 1), (2, 2)}
    assert {r["container_id"]: r["depth"] for r in layout.container_depth(held).collect()} == {1: 0, 2: 1}
    df = items(spark, [("a", 20.0, 20.0, 8.0, None, 10.0), ("b", 70.0, 20.0, 8.0, None, 10.0), ("c", 500.0, 20.0, 8.0, None, 10.0), ("d", 9.0, 20.0, 8.0, None, 10.0), ("e", 8.9, 20.0, 8.0, None, 10.0)])
    assert {r["text"]: r["container_id"] for r in layout.assign_containers(df, held).collect()} == {"a": 2, "b": 1, "c": None, "d": 2, "e": 1}


def test_headings(spark):
    rows = [(12.5, False, "x"), (10.5, True, "y" * 119), (10.5, True, "y" * 120), (10.0, True, "UNIT 1"), (10.0, True, "Unit 1"), (12.4, False, "x")]
    df = spark.createDataFrame(rows, "s double, b boolean, t string")
    at = lambda base: [r[0] for r in df.select(layout.heading_rule(F.col("s"), F.col("b"), F.col("t"), F.lit(base))).collect()]
    assert at(10.0) == ["heading", "heading", "paragraph", "heading", "paragraph", "paragraph"]
    assert set(at(0.0)) == {"paragraph"}


def test_medians(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 4.0), (1, 9.0), (1, 0.0), (2, 0.0), (2, None)], "doc int, font_size double")
    assert {r["doc"]: r["baseline"] for r in layout.baselines(df).collect()} == {1: 3.0, 2: 0.0}


def test_reflow_against_fold(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice(["paragraph", "paragraph", "heading"]), rng.choice(["Hello", "world.", "a list", "• item", "1. one", "so:", "end”", "é"]), rng.choice([None, 1, 2])) for d in range(40) for i in range(30)]
    expected = {}
    for d in range(40):
        out = []
        for _, _, kind, text, c in [r for r in rows if r[0] == d]:
            p = out[-1] if out else None
            if p and p[0] == kind == "paragraph" and p[2] == c and not re.search(r"[.!?…:][\"'”’]?\s*\Z", p[1]) and not re.match(r"\s*([•·●▪■◆\-*]|\d+[.)\s]|[A-Z][.)\s]|\([a-z0-9]+\))", text):
                out[-1] = (kind, re.sub(r"\s+", " ", f"{p[1]} {text.strip()}"), c)
            else:
                out.append((kind, text, c))
        expected[d] = out
    df = spark.createDataFrame(rows, "doc int, at int, type string, text string, container_id int")
    got = layout.reflow(df, ["doc"], ["at"]).orderBy("doc", "part").collect()
    assert {d: [(r["type"], r["text"], r["container_id"]) for r in got if r["doc"] == d] for d in range(40)} == expected


def test_extract_end_to_end(spark):
    df = items(spark, [("Title", 0.0, 700.0, 20.0, "Bold", 40.0), ("first", 0.0, 650.0, 10.0, None, 20.0), ("part", 30.0, 651.0, 10.0, None, 20.0), ("goes on", 0.0, 630.0, 10.0, None, 30.0), ("7", 0.0, 20.0, 10.0, None, 5.0), ("", 0.0, 10.0, 10.0, None, 5.0)])
    boxes = spark.createDataFrame([], "doc int, page int, seq bigint, x double, y double, width double, height double")
    lines = layout.extract(df, layout.containers(boxes))
    out = layout.reflow(layout.without_noise(lines), ["doc", "page"], ["line_no"]).orderBy("part").collect()
    assert [(r["type"], r["text"]) for r in out] == [("heading", "Title"), ("paragraph", "first part goes on")]
    page = layout.compact(layout.reflow(layout.without_noise(lines), ["doc", "page"], ["line_no"]), ["doc", "page"], "part").first()
    assert [(x["h"], x["p"]) for x in page["lines"]] == [("Title", None), (None, "first part goes on")]


def test_fit_plans():
    assert fit.plan("abcd", 10.0, 100.0, 20.0) == ("fit-original", 10.0, ["abcd"])
    assert fit.plan("abcd " * 5, 10.0, 100.0, 20.0)[0] == "fit-shrunk"
    assert fit.plan("word " * 10, 10.0, 100.0, 60.0)[0] == "wrap-fit"
    kind, size, lines = fit.plan("word " * 200, 10.0, 50.0, 15.0)
    assert (kind, size) == ("truncated", 6.0) and lines[-1].endswith("...") and len(lines) == 2
    assert fit.plan("word " * 200, 10.0, 50.0, 2.0) == ("no-room", 6.0, [])
    assert fit.plan("", 10.0, 50.0, 20.0)[0] == fit.plan(None, 10.0, 50.0, 20.0)[0] == "no-room"


def test_fit_columns_match_the_plan(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 40), float(rng.randint(6, 20)), float(rng.randint(1, 200)), float(rng.randint(0, 40))) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, text string, font_size double, room_width double, room_height double")
    one = {r["k"]: (r["decision"], r["fit_size"]) for r in fit.single_line(df).collect()}
    for r in fit.plan_fit(df, ["k"]).collect():
        if one[r["k"]][0] != "wrap":
            assert (r["decision"], r["size"]) == one[r["k"]]
    t = fit.tally(fit.plan_fit(df, ["k"])).first()
    assert t["overlays"] + t["skipped"] == 300


def test_wrapped_column(spark):
    df = spark.createDataFrame([("aa bb  cc dddddddd e",), ("",), ("  ",)], "t string")
    assert [r[0] for r in df.select(fit.wrapped(F.col("t"), F.lit(5))).collect()] == [["aa bb", "cc", "dddddddd", "e"], [], []]


NODE = "plan string, col int, status string"


@pytest.mark.parametrize(("terms", "current"), [([["passed"], ["passed", "pending"], ["pending"]], 1), ([["locked"], ["pending"]], None), ([["pending"]], 0), ([["passed"], ["passed"]], None), ([["unknown"]], 0)])
def test_current_term(spark, terms, current):
    df = spark.createDataFrame([("p", c, s) for c, t in enumerate(terms) for s in t], NODE)
    got = catalog.current_term(catalog.cluster_columns(df, ["plan"]), ["plan"]).collect()
    assert [r["index"] for r in got] == ([] if current is None else [current])


@pytest.mark.parametrize(("urls", "best"), [(["b.pptx", "a.pdf"], "a.pdf"), (["x.html", "y.ppt"], "y.ppt"), (["x.html"], "x.html"), ([None, ""], "")])
def test_first_asset(spark, urls, best):
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate(urls)], "g int, i int, url string")
    assert catalog.first_asset(df, ["g"], "url", ["i"]).first()["url"] == best


def test_keep_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (None, "d", 4)], "k int, v string, t int")
    assert sorted(r["v"] for r in catalog.keep_first(df, [F.col("k")], ["t"]).collect()) == ["a", "c"]
    assert sorted(r["v"] for r in align.last_wins(df, ["k"], ["t"]).collect()) == ["b", "d"]


def test_chosen(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    assert sorted(r["v"] for r in catalog.chosen(df, "2, 2, x, 9", ["v"]).collect()) == ["b"]
    assert sorted(r["v"] for r in catalog.chosen(df, "0, x", ["v"]).collect()) == ["a", "b", "c"]


def test_cookies(spark):
    raw = spark.createDataFrame([(1, " n ", None, None, None, None, None, None, None), (2, "", "v", None, None, None, None, None, None), (3, "t", "v", ".x.org", " ", 5, True, True, "None")], "cookie_no int, name string, value string, domain string, path string, expires bigint, http_only boolean, secure boolean, same_site string")
    own = catalog.normal_cookies(raw, "d.org")
    assert [tuple(r) for r in own.orderBy("cookie_no").collect()] == [(1, "n", "", "d.org", "/", -1, False, False, "Lax"), (3, "t", "v", ".x.org", "/", 5, True, True, "None")]
    asks = spark.createDataFrame([("https://m.x.org/a",), ("http://x.org/a",), ("https://d.org/",)], "url string")
    assert {r["url"]: r["header"] for r in catalog.cookie_headers(asks, own, ["url"], "url", 4).collect()} == {"https://m.x.org/a": "t=v", "http://x.org/a": "", "https://d.org/": "n="}
    assert catalog.session_alive(own.withColumn("name", F.lit("MySession")), "d.org", 4).first()["alive"] is True
    assert catalog.session_alive(own.where("false"), "d.org", 4).first()["alive"] is False
    assert catalog.netscape_lines(own).orderBy("cookie_no").first()["line"] == ".d.org\tTRUE\t/\tFALSE\t0\tn\t"


def test_zip_and_key_joins_differ(spark):
    line = "doc int, page int, pos int, text string, key string"
    a = spark.createDataFrame([(1, 1, 1, "a", "p"), (1, 2, 1, "b", "p"), (1, 2, 2, "b2", "p"), (1, 3, 1, "c", "h")], line)
    b = spark.createDataFrame([(1, 1, 1, "A", "p"), (1, 3, 1, "C", "h")], line)
    assert [tuple(r) for r in align.page_drift(a, b, "doc", "page").collect()] == [(1, 2, 2, 1)]
    assert tuple(align.overlay_pages(a, b, "doc", "page").first()) == (1, 2, 2)
    assert sorted(r["source_text"] for r in align.zip_lines(a, b, ["doc", "page"]).collect()) == ["a", "c"]
    same = a.withColumnRenamed("page", "page_pos")
    assert align.same_shape(same, same, "doc").first()["valid"] is True
    assert align.same_shape(same, same.where("text <> 'b2'"), "doc").first()["valid"] is False
    assert align.same_shape(same, same.where("false"), "doc").first()["valid"] is False


def test_fallback(spark):
    a = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "k int, source_text string")
    b = spark.createDataFrame([(1, "t1"), (2, "")], "k int, translated string")
    at = lambda e: [r["text"] for r in align.fallback(a, b, ["k"], e).orderBy("k").collect()]
    assert at(True) == ["t1", "", "s3"] and at(False) == ["t1", "s2", "s3"]


def test_backends(spark):
    entries = spark.createDataFrame([("a b", "X"), ("a b", "Y")], "p string, translated string")
    df = spark.createDataFrame([(1, " a  b "), (2, "c"), (3, None), (4, "")], "k int, t string")
    at = lambda run: [r["translated"] for r in translate.translate_column(df, "t", run).orderBy("k").collect()]
    assert at(translate.backend("dictionary", entries=entries)) == ["X", "c", None, ""]
    assert at(translate.backend("identity")) == ["a b", "c", None, ""]
    assert at(translate.backend("callable", translate=lambda texts: [t.upper() for t in texts])) == ["A B", "C", None, ""]
    with pytest.raises(ValueError, match="unknown backend"):
        translate.backend("none")
    assert [translate.default_backend(*a) for a in (("x", "y"), (None, "y"), (None, None, "k"), ())] == ["x", "y", "callable", "dictionary"]


def test_again():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert translate.again(flaky, 5, waits.append) == "ok" and len(waits) == 2
    assert translate.pause(1, 0.5) == 500 and translate.pause(9, 1.0) == 30_000
    with pytest.raises(ZeroDivisionError):
        translate.again(lambda: 1 / 0, 2, waits.append)


def test_replies(spark):
    raws = ['{"a": 1}', '```json\n{"a": 1}\n```', "[1]", 'prose {"a":1} end', "{bad", None, ""]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, r string").orderBy("i")
    assert [r[0] for r in df.select(translate.reply_object(F.col("r")).isNotNull()).collect()] == [True, True, False, False, False, False, False]
    assert [r[0] for r in df.select(translate.reply_lenient(F.col("r")).isNotNull()).collect()] == [True, True, True, True, False, False, False]


def test_translated_path(spark):
    df = spark.createDataFrame([("a/b.json",), ("a.x/b",), ("c.d.pdf",)], "p string")
    assert [r[0] for r in df.select(translate.translated_path(F.col("p"), "tl")).collect()] == ["a/b.tl.json", "a.x/b.tl", "c.d.tl.pdf"]


def test_audits(spark):
    rec = "course string, cached_path string, json_path string, translated_path string"
    df = spark.createDataFrame([("A", "x", "j", None), ("A", "x", "j", "t"), ("B", "x", "", None), ("B", None, "j", None)], rec)
    got = {r["course"]: (r["modules"], r["pdfs"], r["jsons"], r["translated"], r["ok"]) for r in audit.verify(df, "course").collect()}
    assert got == {"A": (2, 2, 2, 1, True), "B": (2, 1, 1, 0, False), None: (4, 3, 3, 1, False)}
    tiers = [df.where("false"), df.where("course = 'A'"), df]
    assert {r["course"] for r in audit.first_tier(tiers).collect()} == {"A"}
    lines = spark.createDataFrame([("OK a",), ("FAIL b",), ("OKAY",), (None,)], "line string")
    assert tuple(audit.log_tally(lines).first()) == (1, 1)
    assert [r[0] for r in df.select(audit.relative(F.concat("course", F.lit("/"), "cached_path"), F.col("course"))).collect()] == ["x", "x", "x", ""]
    m = audit.manifest(df.withColumn("at", F.lit(1)), "course", ["at"], {"pdf": F.col("cached_path"), "json": F.col("json_path")}).orderBy("course").collect()
    assert m[1]["manifest"] == '[{"json":"j"},{"pdf":"x"}]'
    names = spark.createDataFrame([("pdf",), ("old",)], "name string")
    assert [r[0] for r in audit.unkept(names, ["pdf", "json"]).collect()] == ["old"]


def test_pipeline():
    stage = lambda n, skip=False: pipeline.Stage(n, lambda t, o: {n: len(t)}, lambda t, o: skip)
    stages = [stage("a"), stage("b", True), stage("c"), stage("d")]
    tables, done = pipeline.run_stages(stages, {}, pipeline.Options(), "c")
    assert (tables, done) == ({"a": 0, "c": 1}, ["a", "c"])
    with pytest.raises(ValueError, match="no stage"):
        pipeline.run_stages(stages, {}, pipeline.Options(), "x")
    o = pipeline.Options.parse(["--render", "--target-lang=es"])
    assert (o.render, o.translate, o.all_courses, o.target_lang) == (True, True, True, "es")
    assert [pipeline.truthy(x, True) for x in ("TRUE", "0", "yes", "", None)] == [True, False, False, True, True]


def test_reports(spark):
    df = items(spark, [("b", 0.0, 1.0, 1.0, None, None), (" c ", 0.0, 1.0, 1.0, None, None)])
    assert reports.page_texts(df, ["doc", "page"]).first()["text"] == "b c"
    one = spark.createDataFrame([("http://h/v1//", 503, "x"), ("http://h", None, "socket hang up"), (None, 404, None)], "base string, status int, message string")
    got = one.select(reports.endpoint(F.col("base")), reports.retryable(F.col("status"), F.col("message"))).collect()
    assert [tuple(r) for r in got] == [("http://h/v1/chat/completions", True), ("http://h/chat/completions", True), (None, False)]
    assert spark.range(1).select(reports.prompt(F.lit('{"pages":[]}'), "Tagalog")).first()[0].endswith('{"pages":[]}')
    pages = spark.createDataFrame([(1, 2, "b", ""), (1, 1, "a", "A"), (1, 10, None, None)], "doc int, page int, source_text string, translated_text string")
    out = reports.module_json(pages, "doc").first()
    assert out["page_count"] == 3 and out["json"] == '{"PAGE 1":{"original":"a","translated":"A"},"PAGE 2":{"original":"b","translated":"b"},"PAGE 10":{"original":"","translated":""}}'
    ratio = reports.length_ratio(spark.createDataFrame([(1, "ab", "abc"), (2, "", "x")], "doc int, source_text string, translated_text string"), "doc")
    assert {r["doc"]: r["ratio"] for r in ratio.collect()} == {1: 1.5, 2: None}


def test_tally_by_document(spark):
    plans = spark.createDataFrame([(1, "wrap-fit"), (1, "no-room"), (2, "truncated")], "doc int, decision string")
    assert {r["doc"]: (r["wrap_fit"], r["truncated"], r["no_room"], r["overlays"], r["skipped"]) for r in fit.tally(plans, ["doc"]).collect()} == {1: (1, 0, 1, 1, 1), 2: (0, 1, 0, 1, 0)}


def test_plan_on_the_jvm_equals_the_loop(spark):
    rng = random.Random(4)
    words = ["a", "word", "longer-word", "extraordinarily-long-word-without-any-break"]
    rows = [(i, None if i % 17 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.choice([4.0, 6.0, 7.5, 9.0, 14.0]), rng.uniform(1, 200), rng.uniform(0, 90)) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, text string, font_size double, room_width double, room_height double")
    got = {r["i"]: (r["decision"], r["size"], list(r["lines"])) for r in fit.plan_fit(df, ["i"]).collect()}
    assert got == {r[0]: fit.plan(*r[1:]) for r in rows}
    assert {g[0] for g in got.values()} == set(fit.DECISIONS)
    other = fit.plan_fit(df, ["i"], lambda t, s: len(t) * s * 0.4).collect()
    assert {r["i"]: r["decision"] for r in other} == {r[0]: fit.plan(*r[1:], lambda t, s: len(t) * s * 0.4)[0] for r in rows}


def test_boxes_of_two_kinds(spark):
    paths = spark.createDataFrame([("d", 1, 1, 10.0, 10.0, -5.0, 4.0)], "doc string, page int, seq bigint, x double, y double, width double, height double")
    bare = spark.createDataFrame([("d", 1, 1, 0.0, 0.0, 3.0, 3.0)], "doc string, page int, seq bigint, x double, y double, width double, height double")
    assert [tuple(r) for r in layout.candidate_boxes(paths, bare).orderBy("seq").select("seq", "x", "width").collect()] == [(1, 5.0, 5.0), (2, 0.0, 3.0)]
