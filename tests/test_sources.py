"""Sources, sinks, streams, and every query of the core against the other engine."""

import json
import math
import os

import duckdb
import pytest

from deckweave.plans import more, oracle, registry
from deckweave.sources import sinks, tables
from deckweave.sources.positioned import PositionedText
from deckweave.streaming import arrivals

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings course_nodes module_records page_lines page_docs translated_lines answer_pairs segment_dictionary eval_items".split()


@pytest.fixture(scope="module")
def other():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(found):
    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in found)


SQL = oracle.oracle_sql() | more.SQL
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, other, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in columns)).collect()
    if name not in SQL:
        assert got
        return
    result = other.execute(SQL[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    at = [names.index(c) for c in columns]
    assert rows(got) == rows([[r[i] for i in at] for r in result.fetchall()])
    assert {c: KINDS[t] for c, t in df.dtypes} == types


def test_saved_decks(spark, tmp_path):
    for course, name in (("A", "01-x.source.pdf"), ("A", "02-y.source.PPTX"), ("B", "note.txt")):
        (tmp_path / course / "pdf").mkdir(parents=True, exist_ok=True)
        (tmp_path / course / "pdf" / name).write_bytes(b"123")
    assert {(r["course"], r["file_base"], r["ext"], r["bytes"]) for r in tables.saved_decks(spark, str(tmp_path)).collect()} == {("A", "01-x", "pdf", 3), ("A", "02-y", "pptx", 3)}


def test_page_documents_round_trip(spark, tmp_path):
    doc = {"meta": {"source": "s", "lineCount": 2}, "pages": [{"n": 1, "lines": [{"h": "T"}, {"p": "x", "c": 3}]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "in" / "b.json").write_text("{broken")
    df = tables.page_documents(spark, str(tmp_path / "in"))
    assert sorted(r["pages"] is None for r in df.collect()) == [False, True]
    lines = tables.page_lines(df, "source_path").orderBy("line_no").collect()
    assert [(r["page"], r["line_no"], r["h"], r["p"], r["c"]) for r in lines] == [(1, 1, "T", None, None), (1, 2, None, "x", 3)]
    sinks.write_pages(df.where("pages IS NOT NULL").select("meta", "pages"), str(tmp_path / "out"))
    text = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".json").read_text()
    assert json.loads(text)["pages"][0]["lines"] == [{"h": "T"}, {"p": "x", "c": 3}]
    assert sinks.json_sizes(df.where("pages IS NOT NULL").select("source_path", "pages"), "source_path").first()["bytes"] > 20


def test_cookie_files(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"name": "a", "expires": 5}, {"name": "b", "secure": true}]')
    assert [(r["cookie_no"], r["name"], r["secure"]) for r in tables.cookies(spark, str(tmp_path / "c.json")).orderBy("cookie_no").collect()] == [(0, "a", None), (1, "b", True)]
    for name, text, code in (("e", "", "EMPTY"), ("f", "[]", "EMPTY"), ("g", "{nope", "INVALID")):
        (tmp_path / name).write_text(text)
        with pytest.raises(tables.CookieFileError) as error:
            tables.cookies(spark, str(tmp_path / name))
        assert error.value.code == code
    with pytest.raises(tables.CookieFileError) as error:
        tables.cookies(spark, str(tmp_path / "missing"))
    assert error.value.code == "MISSING"


def test_positioned_text(spark, tmp_path):
    page = {"doc": "d", "page": 1, "items": [["a", 1, 2, -10, "F", None], ["b", 3, 2, 9, None, 4]]}
    (tmp_path / "p.jsonl").write_text(json.dumps(page) + "\n\n")
    spark.dataSource.register(PositionedText)
    got = spark.read.format("positioned_text").option("path", str(tmp_path)).load().orderBy("seq").collect()
    assert [(r["text"], r["font_size"], r["width"]) for r in got] == [("a", 10.0, None), ("b", 9.0, 4.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", "en"), ("y", "tl")], "line string, lang string")
    sinks.write_lines(df, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["x", "y"]
    sinks.write_table(df, str(tmp_path / "p"), ["lang"])
    sinks.write_table(df.where("lang = 'tl'").replace("y", "z"), str(tmp_path / "p"), ["lang"])
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {("x", "en"), ("z", "tl")}


def test_arrivals_are_worked_on_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: arrivals.run_once(arrivals.arrivals(spark, str(tmp_path / "in"), "k int"), lambda b: b.select("k"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    (tmp_path / "in" / "a.json").write_text('{"k": 1}\n')
    run()
    (tmp_path / "in" / "b.json").write_text('{"k": 2}\n')
    run()
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
