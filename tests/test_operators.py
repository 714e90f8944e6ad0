"""Ranks of hot groups, pruning, metrics, headers, paths and statuses."""

import random

import pytest
from pyspark.sql import functions as F

from deckweave.functions import urls as U
from deckweave.operators import align, audit, catalog, reports
from deckweave.sources import sinks, tables
from deckweave.sources.files import files_below


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice([None, *range(200)]), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int, _at string")
    got = {r["i"]: r["rank"] for r in catalog.ranked(df.drop("_at"), ["g"], ["o", "i"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: n for n, r in enumerate(own, 1)}
    assert got == want
    assert catalog.ranked(df.where("false"), ["g"], ["o", "i"]).count() == 0


def test_first_and_last_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("k", None, "a"), ("k", 2, "b"), (None, 1, "c"), (None, 3, "d"), ("k", 2, "b")], "k string, t int, v string")
    assert sorted(r["v"] for r in catalog.keep_first(df, [F.col("k")], ["t", "v"]).collect()) == ["a", "c"]
    assert sorted(r["v"] for r in align.last_wins(df, ["k"], ["t", "v"]).collect()) == ["b", "d"]
    assert align.last_wins(df.where("false"), ["k"], ["t"]).count() == 0


def test_prune_deletes_files_alone(spark, tmp_path):
    for name in ("pdf", "old.txt", "json"):
        (tmp_path / name).write_text("x")
    (tmp_path / "folder").mkdir()
    assert audit.prune(spark, str(tmp_path), ["pdf", "json"]) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["folder", "json", "pdf"]
    assert audit.prune(spark, str(tmp_path / "none"), []) == 0


def test_what_is_known_of_a_written_table(spark, tmp_path):
    df, seen = audit.observed(spark.range(10), "run", even=F.count_if(F.col("id") % 2 == 0))
    sinks.write_report(df.withColumn("reason", F.lit(None).cast("string")), str(tmp_path / "out"))
    assert seen.get == {"rows": 10, "even": 5}
    assert '{"id":0,"reason":null}' in [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]


def test_headers_paths_and_slides(spark):
    one = spark.range(1)
    merged = U.overlaid(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("b"), F.lit("3")))
    row = one.select(merged.alias("m"), U.joined_path(F.lit("/out"), F.lit("A B"), F.lit(None).cast("string"), F.lit("c")).alias("p"), U.suffixes(F.lit("a.b.c")).alias("s"), reports.slide_header(F.lit(None).cast("string"), F.lit(3)).alias("h"), reports.slide_body(F.lit("")).alias("b")).first()
    assert row["m"] == {"a": "2", "b": "3"} and row["p"] == "/out/A_B/c" and row["s"] == ["a.b.c", "b.c", "c"] and (row["h"], row["b"]) == ("module - Page 3", "(no text)")


def test_statuses_of_rows_without_a_pdf(spark):
    df = spark.createDataFrame([("a", "pdf", None), (None, "pdf", None), ("b", "pptx", "ok"), ("c", None, None)], "path string, ext string, status string")
    assert [r[0] for r in df.select(catalog.extract_status(F.col("path"), F.col("ext"), F.col("status"))).collect()] == ["extracted", "no-pdf", "ok", "no-pdf"]


def test_irregular_terms_are_an_error(spark):
    columns = spark.createDataFrame([("p", 0, 1, True, False)], "plan string, index int, nodes int, has_pending boolean, all_passed boolean")
    with pytest.raises(NotImplementedError):
        catalog.current_term(columns, ["plan"], "irregular")


def test_cookies_of_hosts_below_their_domain(spark):
    jar = spark.createDataFrame([(1, "session", "v", ".b.org", "/", -1, False), (2, "x", "w", "org", "/a", 5, False), (3, "y", "z", "other.net", "/", -1, False)], "cookie_no int, name string, value string, domain string, path string, expires bigint, secure boolean")
    asks = spark.createDataFrame([("https://a.b.org/a/1",), ("https://b.org/",), ("https://ab.org/",), ("https://a.b.org/a/1",), (None,)], "url string")
    got = {r["url"]: r["header"] for r in catalog.cookie_headers(asks, jar, ["url"], "url", 4).collect()}
    assert got == {"https://a.b.org/a/1": "session=v; x=w", "https://b.org/": "session=v", "https://ab.org/": "", None: ""}
    hosts = spark.createDataFrame([("a.b.org",), ("ab.org",), (None,)], "host string")
    assert {r["host"]: r["alive"] for r in catalog.alive_hosts(hosts, jar, "host", 4).collect()} == {"a.b.org": True, "ab.org": False, None: False}


def test_files_and_listings_are_in_order(spark, tmp_path):
    for course in ("b", "a"):
        (tmp_path / course / "pdf").mkdir(parents=True)
        (tmp_path / course / "pdf" / "01-x.source.pdf").write_bytes(b"x")
    assert [r["course"] for r in tables.saved_decks(spark, str(tmp_path)).collect()] == ["a", "b"]
    assert [f.split("/")[-3] for f in files_below(str(tmp_path), ".pdf")] == ["a", "b"]
    assert files_below(f"file://{tmp_path}/a/pdf/01-x.source.pdf", ".pdf") == [f"file://{tmp_path}/a/pdf/01-x.source.pdf"]
