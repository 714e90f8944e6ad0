"""SQL for the queries of this subpackage that SQL can express, for another engine to check them."""

from __future__ import annotations

from .lookalike import INVISIBLE_RANGES, LIGATURES, ONE_FROM, ONE_TO


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def look(x: str) -> str:
    invisible = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in INVISIBLE_RANGES) + "]"
    out = f"translate(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), {_text(invisible)}, '', 'g'), {_text(ONE_FROM)}, {_text(ONE_TO)})"
    for a, b in LIGATURES.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


def line_key(x: str) -> str:
    folded = f"replace(lower({look(x)}), 'ß', 'ss')"
    return f"regexp_replace(regexp_replace({folded}, '[0-9]+', '0', 'g'), '\\s+', '', 'g')"


REPEATED = f"""
WITH keyed AS (
  SELECT line_id, source, module_key, {line_key('p')} AS k FROM page_lines WHERE p IS NOT NULL AND source IS NOT NULL),
lines AS (SELECT * FROM keyed WHERE regexp_matches(k, '\\p{{L}}')),
sizes AS (SELECT source, count(DISTINCT module_key) AS modules FROM page_lines WHERE source IS NOT NULL GROUP BY source),
counts AS (SELECT source, k, count(DISTINCT module_key) AS in_modules FROM lines GROUP BY source, k),
over AS (SELECT source, k FROM counts JOIN sizes USING (source) WHERE in_modules >= 3 AND in_modules * 5 >= modules),
gone AS (SELECT line_id FROM lines JOIN over USING (source, k) WHERE module_key IS NOT NULL)
"""

PAGE = "array_to_string(list_transform(coalesce(page.lines, []), lambda l: coalesce(l.h, l.p, '')), chr(10))"

ORACLE: dict[str, str] = {
    "p2_found": REPEATED + "SELECT line_id FROM gone",
    "p2_clean": REPEATED
    + """SELECT module_key, CAST(count(*) - count(g.line_id) AS BIGINT) AS lines_left, CAST(count(g.line_id) AS BIGINT) AS lines_removed
FROM page_lines p LEFT JOIN gone g ON p.line_id = g.line_id GROUP BY module_key""",
    "p3_found": f"""
WITH d AS (SELECT node_id, description, {look('description')} AS k FROM course_nodes WHERE description IS NOT NULL),
s AS (SELECT seg_id, p, {look('p')} AS k FROM segment_dictionary WHERE p IS NOT NULL),
l AS (SELECT line_id, p, {look('p')} AS k FROM page_lines WHERE p IS NOT NULL)
SELECT 'description' AS field, a.node_id AS key_a, b.node_id AS key_b FROM d a JOIN d b ON a.k = b.k
WHERE a.node_id < b.node_id AND a.description <> b.description AND trim(a.k) <> ''
UNION ALL
SELECT 'p' AS field, s.seg_id AS key_a, l.line_id AS key_b FROM s JOIN l ON s.k = l.k WHERE s.p <> l.p AND trim(s.k) <> ''""",
    "p4_found": f"""
WITH pages AS (SELECT page_doc_id, unnest(pages) AS page FROM page_docs)
SELECT page_doc_id, page.n AS n FROM pages WHERE page IS NOT NULL AND length({PAGE}) > 1200""",
    "p4_joined": f"""
WITH pages AS (SELECT page_doc_id, unnest(pages) AS page FROM page_docs)
SELECT page_doc_id, page.n AS n, md5({PAGE}) AS digest, TRUE AS fits FROM pages WHERE page IS NOT NULL AND length({PAGE}) > 1200""",
    "p3_canonical_lines": f"""
WITH l AS (SELECT line_id, p, {look('p')} AS k FROM page_lines), v AS (SELECT p, k FROM l WHERE trim(k) <> '' UNION SELECT p, {look('p')} FROM segment_dictionary WHERE trim({look('p')}) <> ''),
c AS (SELECT k, arg_min(p, struct_pack(odd := p <> k, v := encode(p))) AS canonical FROM v GROUP BY k)
SELECT line_id, coalesce(canonical, p) AS canonical FROM l LEFT JOIN c ON l.k = c.k AND trim(l.k) <> ''""",
    "p3_classes": f"""
WITH d AS (SELECT node_id, description, {look('description')} AS k FROM course_nodes WHERE description IS NOT NULL), v AS (SELECT description, k, count(*) AS copies FROM d WHERE trim(k) <> '' GROUP BY ALL),
c AS (SELECT k, sum(copies) AS rows, arg_min(description, struct_pack(odd := description <> k, v := encode(description))) AS canonical FROM v GROUP BY k)
SELECT node_id, canonical, CAST(rows - copies AS BIGINT) AS links FROM d JOIN v ON d.description = v.description JOIN c ON v.k = c.k""",
    "p3_canonical": f"""
WITH d AS (SELECT node_id, description, {look('description')} AS k FROM course_nodes),
c AS (SELECT k, arg_min(description, struct_pack(odd := description <> k, v := encode(description))) AS canonical FROM (SELECT DISTINCT description, k FROM d WHERE trim(k) <> '') GROUP BY k)
SELECT node_id, coalesce(canonical, description) AS canonical FROM d LEFT JOIN c ON d.k = c.k AND trim(d.k) <> ''""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
