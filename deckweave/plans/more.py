"""Queries of the smaller reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckweave.functions import urls as U
from deckweave.operators import align, layout, reports
from deckweave.plans import bindings as B
from deckweave.plans.oracle import HELD, PAIRED, TRN, collapse, d, q
from deckweave.plans.registry import paired, query


@query
def page_texts(spark, folder):
    return reports.page_texts(B.of(spark, folder, B.ITEMS), ["doc", "page"])


@query
def container_stats(spark, folder):
    held = layout.containers(B.of(spark, folder, B.BOXES), 900.0 * 900.0)
    return reports.container_stats(held, B.of(spark, folder, B.ITEMS).select("doc", "page").distinct())


@query
def union_boxes(spark, folder):
    return reports.union_boxes(B.of(spark, folder, B.BOXES), ["doc", "page"])


@paired
def drift_list(spark, folder):
    drift = align.page_drift(B.of(spark, folder, B.PAIRED_SOURCE), B.of(spark, folder, B.TRANSLATED), "doc", "page")
    text = F.transform("drift", lambda x: F.concat_ws(":", x["page"], x["source_lines"], x["translated_lines"]))
    return reports.drift_list(drift, "doc").select("doc", F.array_join(text, ";").alias("drift"))


@paired
def length_ratio(spark, folder):
    pairs = align.zip_lines(B.of(spark, folder, B.PAIRED_SOURCE), B.of(spark, folder, B.TRANSLATED), ["doc", "page"])
    return reports.length_ratio(pairs, "doc")


@paired
def module_json(spark, folder):
    """Bytes apart, the JSON itself differs between engines, so its keys are counted."""
    texts = lambda b, name: B.of(spark, folder, b).groupBy("doc", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias(name))
    own = reports.module_json(texts(B.PAIRED_SOURCE, "source_text").join(texts(B.TRANSLATED, "translated_text"), ["doc", "page"], "left"), "doc")
    same = F.size(F.filter(F.map_values(F.from_json("json", "map<string,struct<original:string,translated:string>>")), lambda x: x["original"] == x["translated"]))
    return own.select("doc", "page_count", same.cast("bigint").alias("untranslated"))


@query
def retryable_failures(spark, folder):
    own = B.of(spark, folder, "{records}").where("error IS NOT NULL")
    status = F.expr("try_cast(nullif(regexp_extract(error, 'HTTP ([0-9]+)', 1), '') AS INT)")
    return own.select("module_key", reports.retryable(status, F.col("error")).alias("again"))


@query
def sign_in_pages(spark, folder):
    url = F.when(F.col("module_key") % 9 == 0, F.concat(F.col("asset_url"), F.lit("/login"))).otherwise(F.col("asset_url"))
    return B.of(spark, folder, "{records}").select("module_key", F.coalesce(url.rlike(U.SIGN_IN), F.lit(False)).alias("sign_in"))


@query
def box_filter(spark, folder):
    own = layout.containers(B.of(spark, folder, B.BOXES), 300.0 * 300.0)
    return own.select("doc", "page", "seq", F.round("area", 6).alias("area"))


SQL: dict[str, str] = {
    "page_texts": f"SELECT doc, page, {collapse('string_agg(text, chr(32) ORDER BY seq)')} AS text FROM {d(B.ITEMS)} GROUP BY doc, page",
    "container_stats": f"""WITH {HELD}, p AS (SELECT DISTINCT doc, page FROM {d(B.ITEMS)}), n AS (SELECT doc, page, count(*) AS n FROM held GROUP BY doc, page),
s AS (SELECT doc, count(*) AS pages, CAST(sum(coalesce(n, 0)) AS BIGINT) AS containers FROM p LEFT JOIN n USING (doc, page) GROUP BY doc)
SELECT doc, pages, containers, floor(containers * 10.0 / pages + 0.5) / 10 AS per_page FROM s""",
    "union_boxes": f"SELECT doc, page, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM {d(B.BOXES)} GROUP BY doc, page",
    "drift_list": B.keyed_duck(f"""
WITH sc AS (SELECT doc, page, count(*) AS a, row_number() OVER (PARTITION BY doc ORDER BY page) AS i FROM {PAIRED} GROUP BY doc, page), tc AS (SELECT doc, count(*) AS b, row_number() OVER (PARTITION BY doc ORDER BY page) AS i FROM {TRN} GROUP BY doc, page)
SELECT sc.doc, string_agg(concat(page, ':', a, ':', b), ';' ORDER BY page) AS drift FROM sc JOIN tc ON sc.doc = tc.doc AND sc.i = tc.i WHERE a <> b GROUP BY sc.doc"""),
    "length_ratio": B.keyed_duck(f"""
WITH z AS (SELECT s.doc, length(s.text) AS a, length(t.text) AS b FROM {PAIRED} s JOIN {TRN} t ON s.doc = t.doc AND s.page = t.page AND s.pos = t.pos WHERE t.text <> '')
SELECT doc, CAST(sum(a) AS BIGINT) AS source_chars, CAST(sum(b) AS BIGINT) AS translated_chars, round(CAST(sum(b) AS DOUBLE) / nullif(sum(a), 0), 6) AS ratio FROM z GROUP BY doc"""),
    "module_json": B.keyed_duck(f"""
WITH s AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY pos) AS a FROM {PAIRED} GROUP BY doc, page), t AS (SELECT doc, page, string_agg(text, chr(10) ORDER BY pos) AS b FROM {TRN} GROUP BY doc, page)
SELECT s.doc, count(*) AS page_count, count(CASE WHEN coalesce(nullif(b, ''), a) = a THEN 1 END) AS untranslated FROM s LEFT JOIN t ON s.doc = t.doc AND s.page = t.page GROUP BY s.doc"""),
    "retryable_failures": f"""SELECT module_key, coalesce(TRY_CAST(nullif(regexp_extract(error, 'HTTP ([0-9]+)', 1), '') AS INT) IN (429, 500, 502, 503, 504), FALSE) OR regexp_matches(error, {q(reports.TRANSIENT)}) AS again
FROM {d('{records}')} WHERE error IS NOT NULL""",
    "sign_in_pages": f"SELECT module_key, coalesce(regexp_matches(CASE WHEN module_key % 9 = 0 THEN asset_url || '/login' ELSE asset_url END, {q(U.SIGN_IN)}), FALSE) AS sign_in FROM {d('{records}')}",
    "box_filter": f"SELECT doc, page, seq, round(width * height, 6) AS area FROM {d(B.BOXES)} WHERE width >= 5 AND height >= 5 AND width * height <= 90000.0 * 0.85",
}
