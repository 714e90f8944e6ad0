"""The queries of source and translation, over modules with several translated documents and with none."""

import pytest

from deckweave.plans import more, oracle, registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    source = [(1, 1, 1, "Head", None, None), (1, 1, 2, None, "one", 1), (2, 1, 1, None, "two", None)]
    translated = [(7, 1, 1, 1, "Ulo", None, None), (7, 1, 1, 2, None, "isa", 1), (8, 1, 1, 1, "Tete", None, None), (8, 1, 1, 2, None, "", 1), (8, 1, 2, 3, None, "trois", None)]
    spark.createDataFrame(source, "module_key bigint, page int, line_no int, h string, p string, c int").selectExpr("CAST(monotonically_increasing_id() AS BIGINT) AS line_id", "*").write.parquet(f"{out}/page_lines.parquet")
    spark.createDataFrame(translated, "tdoc_id bigint, module_key bigint, page int, line_no int, h string, p string, c int").selectExpr("CAST(monotonically_increasing_id() AS BIGINT) AS tline_id", "*").write.parquet(f"{out}/translated_lines.parquet")
    spark.createDataFrame([(1, "a.json", "a.tl.json", None, 1), (2, None, None, None, 1)], "module_key bigint, json_path string, translated_path string, updated_at timestamp, ordinal int").write.parquet(f"{out}/module_records.parquet")
    spark.createDataFrame([(1, ("v1",)), (1, ("v2",))], "module_key bigint, meta struct<schema_tag:string>").write.parquet(f"{out}/page_docs.parquet")
    return out


def rows(spark, folder, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in registry.queries()[name](spark, folder).collect()), key=str)


def test_every_translated_document_is_paired(spark, folder):
    assert rows(spark, folder, "line_zip_join", "module_key", "tdoc_id", "pos", "source_text", "translated_text") == [(1, 7, 1, "Head", "Ulo"), (1, 7, 2, "one", "isa"), (1, 8, 1, "Head", "Tete")]
    assert rows(spark, folder, "check_report", "module_key", "tdoc_id", "source_lines", "translated_lines", "translated_pages") == [(1, 7, 2, 2, 1), (1, 8, 2, 3, 2), (2, None, 1, 0, 0)]
    assert rows(spark, folder, "shape_validation", "module_key", "tdoc_id", "valid") == [(1, 7, True), (1, 8, False), (2, None, False)]


def test_every_query_keeps_every_document(spark, folder):
    for name in ("overlay_page_join", "check_report", "shape_validation", "cache_validation", "length_ratio", "module_json"):
        assert {r[:2] for r in rows(spark, folder, f"{name}", "module_key", "tdoc_id")} >= {(1, 7), (1, 8)}, name
    assert set(oracle.oracle_sql() | more.SQL) <= set(registry.queries())


def test_headings_keep_their_translation(spark, folder):
    got = rows(spark, folder, "translation_fallback_join", "module_key", "tdoc_id", "pos", "kept", "filled")
    assert got == [(1, 7, 1, "Ulo", "Ulo"), (1, 7, 2, "isa", "isa"), (1, 8, 1, "Tete", "Tete"), (1, 8, 2, "", "one"), (2, None, 1, "two", "two")]
