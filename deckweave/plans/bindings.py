"""The operators' input tables, made from the driver's tables by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckweave.sources.tables import table

ITEMS = """
SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS seq,
  concat('w', CAST(l_partkey AS VARCHAR(20))) AS text, CAST((l_partkey * 37) % 600 AS DOUBLE) AS x, CAST((l_partkey * 13) % 700 AS DOUBLE) AS y,
  CAST(8 + round(l_discount * 100) AS DOUBLE) AS font_size, CASE WHEN l_returnflag = 'R' THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font_name,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS width,
  CAST(floor(((l_partkey * 13) % 700) / 3.0 + 0.5) AS BIGINT) AS line
FROM (SELECT *, CAST(floor(l_orderkey / 40.0) AS BIGINT) AS doc, CAST(l_suppkey % 3 + 1 AS INT) AS page FROM {lineitem}) i"""

BOXES = """
SELECT CAST(floor(p_partkey / 8.0) AS BIGINT) AS doc, CAST(p_partkey % 3 + 1 AS INT) AS page, p_partkey AS seq,
  CAST((p_partkey * 53) % 500 AS DOUBLE) AS x, CAST((p_partkey * 29) % 700 AS DOUBLE) AS y, CAST(p_size * 12 AS DOUBLE) AS width, CAST(p_size * 9 AS DOUBLE) AS height
FROM {part}"""

HTML = """
SELECT node_id AS page_id, concat('<html><head><title>', coalesce(title, ''), '</title><style>p{{margin:0}}</style></head><body><p> ', coalesce(status, ''),
  ' </p><h2 class="t">', coalesce(title, ''), '</h2><script>var a="b";</script><p>', coalesce(description, ''), '</p><ul><li>', coalesce(department, ''),
  '</li><li> 12.5 </li></ul>', CASE WHEN node_id % 3 = 0 THEN '' ELSE concat('<a href="', coalesce(href, ''), '">more</a><a href="https://cards.example/', coalesce(course_code, ''), '"><b>card</b></a>') END,
  '<h3>', coalesce(course_code, ''), ' &amp;lt; notes</h3>  A&nbsp;B &gt; C <br>', coalesce(curriculum, ''), '</body></html>') AS html, course_code
FROM {course_nodes}"""

NODES = """
SELECT node_id, curriculum, course_code, title, description, department, status, col, row_no, href FROM {course_nodes}"""

SOURCE = """
SELECT module_key AS doc, page, CAST(row_number() OVER (PARTITION BY module_key, page ORDER BY line_no, line_id) AS BIGINT) AS pos, h, p, c, coalesce(h, p, '') AS text,
  CASE WHEN h IS NOT NULL THEN 'h' WHEN p IS NOT NULL THEN 'p' END AS key
FROM {page_lines}"""

#: Source and translation are paired for every translated document: doc is "module_key:tdoc_id", and a module without a translation has an empty tdoc_id.
PAIRED_SOURCE = """
SELECT concat(coalesce(CAST(s.module_key AS VARCHAR(20)), ''), ':', coalesce(CAST(f.tdoc_id AS VARCHAR(20)), '')) AS doc, s.page, s.pos, s.h, s.p, s.c, s.text, s.key
FROM (SELECT module_key, page, CAST(row_number() OVER (PARTITION BY module_key, page ORDER BY line_no, line_id) AS BIGINT) AS pos, h, p, c, coalesce(h, p, '') AS text,
  CASE WHEN h IS NOT NULL THEN 'h' WHEN p IS NOT NULL THEN 'p' END AS key FROM {page_lines}) s
LEFT JOIN (SELECT DISTINCT module_key, tdoc_id FROM {translated_lines}) f ON s.module_key = f.module_key"""

TRANSLATED = """
SELECT concat(CAST(module_key AS VARCHAR(20)), ':', coalesce(CAST(tdoc_id AS VARCHAR(20)), '')) AS doc, page,
  CAST(row_number() OVER (PARTITION BY module_key, tdoc_id, page ORDER BY line_no, tline_id) AS BIGINT) AS pos, h, p, c, coalesce(h, p, '') AS text,
  CASE WHEN h IS NOT NULL THEN 'h' WHEN p IS NOT NULL THEN 'p' END AS key
FROM {translated_lines} WHERE module_key IS NOT NULL"""

FACTS = """
SELECT r.module_key, r.json_path, r.translated_path, t.source_schema, t.cached_schema FROM ({records}) r
LEFT JOIN (SELECT module_key, max(meta.schema_tag) AS source_schema, min(meta.schema_tag) AS cached_schema FROM {page_docs} GROUP BY module_key) t ON r.module_key = t.module_key"""

RECORDS = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY module_key ORDER BY updated_at DESC, ordinal) AS newest FROM {module_records}) r WHERE newest = 1"""

COOKIES = """
SELECT * FROM (VALUES
  (1, 'laravel_session', 'a1', 'larkmoor-campus.example', '/', -1, TRUE), (2, 'theme', 'dark', '.open-quill.example', '/decks', 0, FALSE),
  (3, 'XSRF-TOKEN', 'b2', 'tidewell-college.example', '/decks/', 1900000000, TRUE), (4, 'old', 'c3', 'kestrel-learning.example', '/', 1600000000, FALSE),
  (5, 'deck', 'd4', 'northbay-institute.example', '/deck', -1, FALSE), (6, 'lang', 'tl', 'example', '/', -1, FALSE),
  (7, 'token', 'e5', 'sanlinaw-academy.example', '', 1900000000, TRUE)) AS c(cookie_no, name, value, domain, path, expires, secure)"""

REQUESTS = """
SELECT DISTINCT CASE WHEN ordinal % 4 = 0 THEN replace(asset_url, 'https:', 'http:') ELSE asset_url END AS url FROM {module_records} WHERE asset_url IS NOT NULL"""

ASSETS = """
SELECT module_key, course, ordinal, CASE WHEN module_key % 5 = 0 THEN concat('https://viewer.example/assets/library/pdfjs/web/viewer.html?file=', replace(coalesce(asset_url, ''), '/', '%2F'))
  WHEN module_key % 5 = 1 THEN concat('https://viewer.example/assets/library/pdfjs/web/viewer.html?file=%2Fdecks%2F', CAST(module_key AS VARCHAR(20)), '.pdf&page=2')
  WHEN module_key % 5 = 2 THEN replace(asset_url, 'https://', '') ELSE asset_url END AS url
FROM ({records}) r"""

SCOPES = """
SELECT module_key, concat('<html><div class="module-body collapse', CASE WHEN module_key % 3 = 0 THEN ' show' ELSE '' END, '"><a endpoint-url="', coalesce(asset_url, ''), '"></a><a endpoint-url="', coalesce(asset_url, ''),
  '"></div><section class="collapse', CASE WHEN module_key % 3 = 2 THEN '' ELSE ' show' END, '"><b><i endpoint-url=" https://other.example/', CAST(module_key AS VARCHAR(20)), ' "></section>') AS html
FROM ({records}) r"""

REPLIES = """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('```json ', props, ' ```') WHEN 2 THEN concat('Sure: ', props, ' done')
  WHEN 3 THEN substring(props, 1, length(props) - 1) WHEN 4 THEN '[1]' ELSE concat('```', props, '```') END AS raw
FROM {events}"""

FIT = """
SELECT doc, page, line, text, "left", "right", bottom, top, font_size, lead(top) OVER (PARTITION BY doc, page ORDER BY baseline DESC, line DESC) AS next_top FROM boxes_of_lines"""


def of(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A binding as a DataFrame; only the tables its text names are read."""
    sql = sql.replace("{records}", RECORDS)
    names = {n for n in ("lineitem", "part", "course_nodes", "page_lines", "translated_lines", "module_records", "events", "segment_dictionary", "page_docs", "documents") if f"{{{n}}}" in sql}
    return spark.sql(sql, **{n: table(spark, folder, n) for n in names})


def duck(sql: str) -> str:
    """A binding as a subquery for the other engine."""
    out = sql.replace("{records}", RECORDS)
    for n in ("lineitem", "part", "course_nodes", "page_lines", "translated_lines", "module_records", "events", "segment_dictionary", "page_docs", "documents"):
        out = out.replace(f"{{{n}}}", n)
    return "(" + out.replace("{{", "{").replace("}}", "}") + ")"


#: What the paired queries have in place of doc.
DOC_KEYS = {"module_key": 1, "tdoc_id": 2}


def keyed(df: DataFrame) -> DataFrame:
    """(module_key, tdoc_id, ...) in place of doc."""
    part = {k: F.nullif(F.split_part("doc", F.lit(":"), F.lit(i)), F.lit("")).cast("bigint").alias(k) for k, i in DOC_KEYS.items()}
    return df.select(*part.values(), *(c for c in df.columns if c != "doc"))


def keyed_duck(sql: str) -> str:
    part = ", ".join(f"CAST(nullif(split_part(doc, ':', {i}), '') AS BIGINT) AS {k}" for k, i in DOC_KEYS.items())
    return f"SELECT {part}, * EXCLUDE (doc) FROM ({sql})"
