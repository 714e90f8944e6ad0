"""The queries again as SQL for another engine, written from what they mean and not from how they run here."""

from __future__ import annotations

from deckweave.functions import text as T
from deckweave.functions import urls as U
from deckweave.operators import html as H
from deckweave.plans import bindings as B

d = B.duck


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(T.SPACE + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{T.SPACE}+|{T.SPACE}+' + chr(92) + 'z')}, '', 'g')"


def strip_tags(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{a}', '{b}')"
    return collapse(out)


def safe(x: str, most: int, default: str) -> str:
    out = f"regexp_replace({strip(x)}, '[^A-Za-z0-9._-]+', '_', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '_+', '_', 'g'), '^_|_\\z', '', 'g')"
    return f"coalesce(nullif(left({out}, {most}), ''), '{default}')"


def badge(x: str) -> str:
    v = f"lower({strip(f'coalesce({x}, {q(str())})')})"
    return f"""CASE WHEN {v} = '' THEN 'unknown' WHEN regexp_matches({v}, 'passed|complete') THEN 'passed'
WHEN regexp_matches({v}, 'active|current|ongoing|in-progress|pending') THEN 'pending' WHEN regexp_matches({v}, 'locked') THEN 'locked' ELSE 'unknown' END"""


def noise(x: str) -> str:
    v = strip(f"coalesce({x}, '')")
    return f"({v} = '' OR regexp_matches({v}, '^([0-9\\W]){{0,3}}\\z') OR regexp_matches({v}, '^[•·●▪■◆\\-*]+\\z'))"


def latin(x: str) -> str:
    out = f"translate({x}, {q(''.join(T.ONE_TO_ONE))}, {q(''.join(T.ONE_TO_ONE.values()))})"
    for a, b in T.ONE_TO_MANY.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[^ -~\\x{{A0}}-\\x{{FF}}]', '?', 'g')"


def kind(x: str) -> str:
    v = f"lower(coalesce({x}, ''))"
    return f"CASE WHEN regexp_matches({v}, '\\.pdf(\\?|\\z)') THEN 'pdf' WHEN regexp_matches({v}, '\\.pptx(\\?|\\z)') THEN 'pptx' WHEN regexp_matches({v}, '\\.ppt(\\?|\\z)') THEN 'ppt' ELSE 'unknown' END"


ORIGIN = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"
HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))"
PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), ''), '/')"


def absolute(x: str, base: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+') THEN {x} WHEN {x} LIKE '/%' THEN concat({base}, {x}) WHEN {x} IS NULL THEN NULL ELSE concat({base}, '/', {x}) END"


SHOWN = "regexp_extract(url, '[?&]file=([^&#]*)', 1)"
RESOLVED = f"""CASE WHEN url IS NULL OR {ORIGIN} = '' THEN '' WHEN contains(lower({PATH}), '{U.VIEWER}') THEN
  CASE WHEN {SHOWN} = '' THEN '' ELSE {absolute(f'url_decode({SHOWN})', ORIGIN)} END
  WHEN regexp_matches(url, {q(U.ASSET)}) THEN url ELSE '' END"""

SEGMENTS = f"""
WITH h AS (SELECT * FROM {d(B.HTML)}), s AS (
  SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS raw FROM (SELECT page_id, regexp_extract_all(html, '>([^<]+)<', 1) AS a FROM h)),
n AS (SELECT page_id, pos, {collapse('raw')} AS normalized FROM s),
segments AS (SELECT * FROM n WHERE normalized <> '' AND NOT regexp_matches(normalized, {q(T.ONLY_PUNCTUATION)}))
"""

SECTIONS = f"""
WITH h AS (SELECT page_id, regexp_replace(html, {q(H.UNSEEN)}, '', 'g') AS x FROM {d(B.HTML)}),
a AS (SELECT page_id, regexp_extract_all(x, {q(H.HEADING)}) AS heads, regexp_split_to_array(x, {q(H.HEADING)}) AS bodies FROM h),
p AS (SELECT page_id, len(heads) AS n, unnest(range(len(bodies))) AS i, unnest(list_concat([''], heads)) AS head, unnest(bodies) AS body FROM a),
t AS (SELECT page_id, n, i, {strip_tags('head')} AS head, {strip_tags('body')} AS body FROM p),
u AS (SELECT page_id, n, i, CASE WHEN head <> '' AND body <> '' THEN concat(head, chr(10), body) ELSE concat(head, body) END AS text FROM t),
sections AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS section_no, text FROM u WHERE i > 0 OR n = 0 OR text <> '')
"""

WIDE = "coalesce(width, length(text) * font_size * 0.5)"
LINES = f"""
items AS (SELECT * FROM {d(B.ITEMS)}),
boxes_of_lines AS (SELECT doc, page, line, min(x) AS "left", max(x + {WIDE}) AS "right", min(y - font_size * 0.25) AS bottom, max(y + font_size * 0.85) AS top,
  arg_min(y, struct_pack(x := x, seq := seq)) AS baseline, max(font_size) AS font_size FROM items GROUP BY doc, page, line),
lagged AS (SELECT *, lag(text) OVER w AS pt, lag(x) OVER w AS px, lag(width) OVER w AS pw, lag(font_size) OVER w AS pf FROM items WINDOW w AS (PARTITION BY doc, page, line ORDER BY x, seq)),
pieces AS (SELECT *, CASE WHEN pt IS NOT NULL AND NOT regexp_matches(pt, '\\s\\z') AND NOT regexp_matches(text, '^\\s') AND x - (px + coalesce(pw, length(pt) * pf * 0.5)) > pf * 0.45 THEN concat(' ', text) ELSE text END AS piece FROM lagged),
texts AS (SELECT doc, page, line, {collapse("string_agg(piece, '' ORDER BY x, seq)")} AS text FROM pieces GROUP BY doc, page, line),
sizes AS (SELECT doc, page, line, greatest(max(font_size), 0.0) AS font_size, bool_or(regexp_matches(font_name, {q(T.BOLD)})) AS bold FROM items GROUP BY doc, page, line),
medians AS (SELECT doc, coalesce(median(CASE WHEN font_size > 0 THEN font_size END), 0.0) AS baseline FROM sizes GROUP BY doc)
"""
NEXT = """floors AS (SELECT *, lead(top) OVER (PARTITION BY doc, page ORDER BY baseline DESC, line DESC) AS next_top FROM boxes_of_lines)"""
FIT = f"""WITH {LINES}, {NEXT},
roomy AS (SELECT f.doc, f.page, f.line, t.text, f.font_size, greatest(1.0, f."right" - f."left") AS w, greatest(0.0, f.top - greatest(18.0, coalesce(f.next_top + 2.0, 18.0))) AS h
  FROM floors f JOIN texts t USING (doc, page, line)),
sized AS (SELECT *, floor(least(font_size, (w + 1.0) / (length(text) * 0.5)) / 0.5) * 0.5 AS fit FROM roomy),
fits AS (SELECT *, CASE WHEN length(text) > 0 AND fit >= 6 AND fit * 1.15 <= h + 1.0 THEN fit END AS fit_size FROM sized),
planned AS (SELECT doc, page, line, CAST(fit_size AS DOUBLE) AS fit_size, CASE WHEN fit_size IS NULL THEN 'wrap' WHEN fit_size >= font_size - 1e-6 THEN 'fit-original' ELSE 'fit-shrunk' END AS decision FROM fits)"""

# Every size from the font's down to the least is tried, and the largest at which the wrapped lines fit is taken.
PACKED = """CASE WHEN len(a) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_reduce(a, lambda s, x: CASE WHEN length(concat(s[-1], ' ', x[1])) * size * 0.5 <= w + 1.0
  THEN list_concat(s[1:len(s) - 1], [concat(s[-1], ' ', x[1])]) ELSE list_concat(s, x) END) END"""
FIT_PLAN = f"""WITH {LINES}, {NEXT},
roomy AS (SELECT f.doc, f.page, f.line, t.text, f.font_size, f."left", f."right", f.top, greatest(1.0, f."right" - f."left") AS w, greatest(0.0, f.top - greatest(18.0, coalesce(f.next_top + 2.0, 18.0))) AS h,
  list_transform(list_filter(regexp_split_to_array(t.text, '[\\s\\x{{0B}}\\x{{A0}}]+'), lambda x: x <> ''), lambda x: [x]) AS a FROM floors f JOIN texts t USING (doc, page, line)),
sized AS (SELECT *, floor(least(font_size, (w + 1.0) / (length(text) * 0.5)) / 0.5) * 0.5 AS fit FROM roomy),
ones AS (SELECT *, CASE WHEN length(text) > 0 AND fit >= 6 AND fit * 1.15 <= h + 1.0 THEN fit END AS one FROM sized),
steps AS (SELECT *, font_size - k * 0.5 AS size FROM (SELECT *, unnest(range(0, CAST(greatest(floor((font_size - 6) / 0.5), -1) AS BIGINT) + 1)) AS k FROM ones WHERE one IS NULL)),
tried AS (SELECT doc, page, line, size, {PACKED} AS lines, h FROM steps),
best AS (SELECT doc, page, line, max(size) AS size, arg_max(lines, size) AS lines FROM tried WHERE len(lines) > 0 AND len(lines) * size * 1.15 <= h + 1.0 GROUP BY doc, page, line),
least AS (SELECT doc, page, line, {PACKED} AS lines FROM (SELECT *, 6.0 AS size FROM ones WHERE one IS NULL)),
cuts AS (SELECT doc, page, line, CASE WHEN floor(h / 6.9) < 1 OR len(lines) = 0 THEN [] ELSE list_concat(kept[1:len(kept) - 1], [concat(left(kept[-1], CAST(greatest(0, floor((w + 1.0) / 3.0) - 3) AS BIGINT)), '...')]) END AS lines
  FROM (SELECT l.*, o.w, o.h, lines[1:CAST(greatest(1, floor(o.h / 6.9)) AS BIGINT)] AS kept FROM least l JOIN ones o USING (doc, page, line))),
plans AS (SELECT o.doc, o.page, o.line, "left", "right", top, CASE WHEN one IS NOT NULL THEN CASE WHEN one >= font_size - 1e-6 THEN 'fit-original' ELSE 'fit-shrunk' END
  WHEN b.size IS NOT NULL THEN CASE WHEN b.size < font_size THEN 'fit-shrunk' WHEN len(b.lines) = 1 THEN 'fit-original' ELSE 'wrap-fit' END WHEN len(c.lines) = 0 THEN 'no-room' ELSE 'truncated' END AS decision,
  CAST(coalesce(one, b.size, 6.0) AS DOUBLE) AS size, CASE WHEN one IS NOT NULL THEN [text] WHEN b.size IS NOT NULL THEN b.lines ELSE c.lines END AS lines
  FROM ones o LEFT JOIN best b USING (doc, page, line) LEFT JOIN cuts c USING (doc, page, line))
"""

HELD = f"""
raw AS (SELECT *, width * height AS area FROM {d(B.BOXES)}),
held AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY area DESC, seq) AS container_id FROM raw WHERE width >= 5 AND height >= 5 AND area <= 810000.0 * 0.85)"""
ASSIGNED = f"""{HELD}, items AS (SELECT * FROM {d(B.ITEMS)}),
hits AS (SELECT i.doc, i.page, i.seq, b.container_id, row_number() OVER (PARTITION BY i.doc, i.page, i.seq ORDER BY b.area, b.container_id) AS nth
  FROM items i JOIN held b ON i.doc = b.doc AND i.page = b.page AND i.x >= b.x - 1 AND i.y - i.font_size * 0.25 >= b.y - 1
  AND i.x + coalesce(i.width, length(i.text) * i.font_size * 0.5) <= b.x + b.width + 1 AND i.y - i.font_size * 0.25 + i.font_size * 1.1 <= b.y + b.height + 1),
assigned AS (SELECT doc, page, seq, container_id FROM hits WHERE nth = 1)"""

REFLOW = f"""
WITH e AS (SELECT doc, page, pos, CASE WHEN h IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS type, text, c FROM {d(B.SOURCE)} s WHERE NOT {noise('text')}),
l AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px, lag(c) OVER w AS pc FROM e WINDOW w AS (PARTITION BY doc, page ORDER BY pos)),
f AS (SELECT *, CASE WHEN type = 'paragraph' AND pt = 'paragraph' AND c IS NOT DISTINCT FROM pc AND NOT regexp_matches(px, {q(T.SENTENCE_FINAL)}) AND NOT regexp_matches(text, {q(T.LIST_START)}) THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY pos) AS part FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY doc, page, part ORDER BY pos) AS nth FROM g),
reflowed AS (SELECT doc, page, CAST(part AS BIGINT) AS part, arg_min(type, pos) AS type,
  CASE WHEN count(*) > 1 THEN regexp_replace(string_agg(CASE WHEN nth = 1 THEN text ELSE trim(text) END, ' ' ORDER BY pos), {q(T.SPACE + '+')}, ' ', 'g') ELSE any_value(text) END AS text,
  max(c) AS container_id FROM o GROUP BY doc, page, part)
"""

NODES = f"nodes AS (SELECT node_id, curriculum, course_code, title, href, col, {badge('status')} AS status FROM course_nodes)"
COLUMNS = f"""{NODES},
terms AS (SELECT curriculum, col, count(*) AS nodes, bool_or(status IN ('pending', 'unknown')) AS has_pending, bool_and(status = 'passed') AS all_passed FROM nodes GROUP BY curriculum, col),
numbered AS (SELECT *, row_number() OVER (PARTITION BY curriculum ORDER BY col) - 1 AS index FROM terms)"""

REC = d("{records}")
SRC, PAIRED, TRN = d(B.SOURCE), d(B.PAIRED_SOURCE), d(B.TRANSLATED)
COUNTS = f"""
sc AS (SELECT doc, page, count(*) AS source_lines, row_number() OVER (PARTITION BY doc ORDER BY page) AS page_pos FROM {PAIRED} GROUP BY doc, page),
tc AS (SELECT doc, page, count(*) AS translated_lines, row_number() OVER (PARTITION BY doc ORDER BY page) AS page_pos FROM {TRN} GROUP BY doc, page),
drift AS (SELECT sc.doc, sc.page, source_lines, translated_lines FROM sc JOIN tc ON sc.doc = tc.doc AND sc.page_pos = tc.page_pos WHERE source_lines <> translated_lines)"""

COOKIE_FITS = f"""(c.expires <= 0 OR c.expires >= 1700000000) AND ({HOST} = regexp_replace(lower(c.domain), '^\\.', '') OR {HOST} LIKE '%.' || regexp_replace(lower(c.domain), '^\\.', ''))
  AND (c.path IN ('', '/') OR {PATH} = c.path OR (starts_with({PATH}, c.path) AND (c.path LIKE '%/' OR substr({PATH}, length(c.path) + 1, 1) IN ('/', ''))))
  AND (NOT c.secure OR url LIKE 'https:%')"""


def relative(x: str) -> str:
    return f"coalesce(CASE WHEN starts_with({x}, concat(course, '/')) THEN substr({x}, length(course) + 2) ELSE {x} END, '')"


def has(x: str) -> str:
    return f"CAST(count(CASE WHEN {x} <> '' THEN 1 END) AS BIGINT)"


ORACLE: dict[str, str] = {
    "html_segments": SEGMENTS + "SELECT page_id, pos, normalized FROM segments",
    "html_segment_counts": SEGMENTS + "SELECT page_id, count(*) AS segments, count(DISTINCT normalized) AS distinct_segments FROM segments GROUP BY page_id",
    "strip_tags": f"SELECT page_id, {strip_tags('html')} AS text FROM {d(B.HTML)}",
    "html_sections": SECTIONS + "SELECT page_id, section_no, text FROM sections",
    "page_object_map": SECTIONS + "SELECT page_id, string_agg(concat('PAGE ', section_no, '=', text), '|' ORDER BY section_no) AS pages FROM sections GROUP BY page_id",
    "html_translate_roundtrip": f"""
WITH t AS (SELECT page_id, regexp_extract_all(html, {q(H.TOKEN)}) AS tokens FROM {d(B.HTML)}),
e AS (SELECT page_id, len(tokens) AS n, unnest(range(len(tokens))) AS i, unnest(tokens) AS x FROM t),
r AS (SELECT page_id, i, CASE WHEN x LIKE '<%' OR i = 0 OR i = n - 1 OR {collapse('x')} = '' OR regexp_matches({collapse('x')}, {q(T.ONLY_PUNCTUATION)}) THEN x
  ELSE concat(regexp_extract(x, {q('^' + T.SPACE + '*')}), '[', {collapse('x')}, ']', regexp_extract(x, {q(T.SPACE + '*' + chr(92) + 'z')})) END AS y FROM e),
o AS (SELECT page_id, string_agg(y, '' ORDER BY i) AS out FROM r GROUP BY page_id)
SELECT page_id, md5(out) AS digest, length(out) AS size FROM o""",
    "lateral_page_links": f"""
WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS a FROM {d(B.HTML)}),
l AS (SELECT page_id, unnest(range(len(a))) AS pos, unnest(a) AS href FROM h UNION ALL SELECT page_id, NULL, NULL FROM h WHERE len(a) = 0)
SELECT page_id, pos, {absolute('href', "'https://campus.example'")} AS url FROM l""",
    "course_cards": f"""
WITH n AS (SELECT node_id, concat(coalesce(title, ''), coalesce(status, '')) AS label, nullif(course_code, '') AS code, trim(replace(coalesce(description, ''), '"', '')) AS description, upper(coalesce(department, '')) AS department, status FROM course_nodes),
c AS (SELECT *, upper(coalesce(code, nullif(regexp_extract(upper(label), {q(T.COURSE_CODE)}, 1), ''))) AS full_code FROM n)
SELECT node_id, CAST(1 AS INT) AS col, CAST(0 AS INT) AS row_no, full_code AS code, CASE WHEN department <> '' THEN concat(department, ' ', full_code) ELSE full_code END AS title, description, {badge('status')} AS status FROM c WHERE full_code IS NOT NULL""",
    "strict_relaxed_audit": f"""
WITH r AS (SELECT upper(course) AS course, lower(trim(coalesce(translate_status, ''))) AS status FROM {REC} WHERE {collapse("coalesce(title, '')")} <> '' AND trim(coalesce(course, '')) <> '')
SELECT course, count(*) FILTER (status IN ('', 'active', 'pending', 'current')) AS strict_links, count(*) AS relaxed_links FROM r GROUP BY course""",
    "asset_scope": f"""
WITH r AS (SELECT module_key, module_key % 3 AS k, coalesce(trim(asset_url), '') AS x, concat('https://other.example/', module_key) AS y FROM {REC})
SELECT module_key, CASE k WHEN 0 THEN x WHEN 1 THEN y ELSE concat_ws(' ', nullif(x, ''), y) END AS urls FROM r""",
    "json_roundtrip": """
WITH p AS (SELECT page_doc_id, pages, flatten(list_transform(coalesce(pages, []), lambda x: coalesce(x.lines, []))) AS lines FROM page_docs)
SELECT page_doc_id, CAST(coalesce(len(pages), 0) AS BIGINT) AS pages, CAST(len(lines) AS BIGINT) AS lines, CAST(coalesce(list_sum(list_transform(lines, lambda x: coalesce(length(x.h), 0))), 0) AS BIGINT) AS heading_chars,
  CAST(coalesce(list_sum(list_transform(lines, lambda x: coalesce(length(x.p), 0))), 0) AS BIGINT) AS paragraph_chars FROM p""",
    "safe_file_name": f"SELECT module_key, {safe('title', 120, 'untitled')} AS name, {safe('title', 100, 'module')} AS part FROM {REC}",
    "badge_status": f"SELECT node_id, {badge('status')} AS badge FROM course_nodes",
    "derive_course_code": f"SELECT node_id, coalesce(regexp_extract(upper(concat_ws(' ', title, course_code)), {q(T.COURSE_CODE)}, 1), '') AS code FROM course_nodes",
    "sanitize_winansi": f"SELECT line_id, {latin('coalesce(h, p)')} AS text FROM page_lines",
    "noise_filter": f"SELECT line_id, {noise('coalesce(h, p)')} AS noise FROM page_lines",
    "asset_type": f"SELECT module_key, {kind('url')} AS kind FROM {d(B.ASSETS)}",
    "asset_url_resolve": f"SELECT module_key, {RESOLVED} AS resolved FROM {d(B.ASSETS)}",
    "fetch_urls": f"SELECT module_key, concat('https://campus.example/map/', url_encode(coalesce(course, '')), '&curriculum=', url_encode(coalesce(title, ''))) AS url FROM {REC}",
    "translated_path": f"SELECT module_key, regexp_replace(json_path, '^(.*?)(\\.[^./]*)?\\z', '\\1.tl\\2') AS expected FROM {REC} WHERE json_path IS NOT NULL",
    "slide_headers": f"""
WITH l AS (SELECT doc, page, count(CASE WHEN text <> '' THEN 1 END) AS filled FROM {SRC} GROUP BY doc, page)
SELECT doc, page, concat(coalesce(title, 'module'), ' - Page ', page) AS header, CASE WHEN filled > 0 THEN 'text' ELSE '(no text)' END AS body
FROM l JOIN {REC} r ON l.doc = r.module_key""",
    "container_depth": f"""WITH {HELD},
deep AS (SELECT c.doc, c.page, c.container_id, count(*) AS depth FROM held c JOIN held o ON c.doc = o.doc AND c.page = o.page AND o.area > c.area
  AND c.x >= o.x - 1 AND c.y >= o.y - 1 AND c.x + c.width <= o.x + o.width + 1 AND c.y + c.height <= o.y + o.height + 1 GROUP BY ALL)
SELECT h.doc, h.page, h.seq, h.container_id, coalesce(depth, 0) AS depth FROM held h LEFT JOIN deep USING (doc, page, container_id)""",
    "item_container_argmin": f"WITH {ASSIGNED} SELECT doc, page, seq, container_id FROM assigned",
    "y_bucket_fold": f"""
WITH g AS (SELECT doc, page, list({{'y': y, 'n': 1}} ORDER BY seq) AS a FROM {d(B.ITEMS)} GROUP BY doc, page),
f AS (SELECT doc, page, list_reduce(list_transform(a, lambda i: [i]), lambda s, i:
  CASE WHEN list_contains(list_transform(s, lambda v: abs(v.y - i[1].y) <= 3), true)
  THEN list_transform(s, lambda v, k: CASE WHEN k = list_position(list_transform(s, lambda u: abs(u.y - i[1].y) <= 3), true) THEN {{'y': (v.y + i[1].y) / 2, 'n': v.n + 1}} ELSE v END)
  ELSE list_concat(s, i) END) AS b FROM g),
e AS (SELECT doc, page, unnest(range(1, len(b) + 1)) AS bucket, unnest(b) AS v FROM f)
SELECT doc, page, bucket, CAST(v.n AS BIGINT) AS n, round(v.y, 6) AS bucket_y FROM e""",
    "pipeline_end_to_end": f"""
WITH {ASSIGNED}, g AS (SELECT doc, page, list({{'y': y, 's': [seq]}} ORDER BY seq) AS a FROM items GROUP BY doc, page),
f AS (SELECT doc, page, list_reduce(list_transform(a, lambda i: [i]), lambda s, i:
  CASE WHEN list_contains(list_transform(s, lambda v: abs(v.y - i[1].y) <= 3), true)
  THEN list_transform(s, lambda v, k: CASE WHEN k = list_position(list_transform(s, lambda u: abs(u.y - i[1].y) <= 3), true) THEN {{'y': (v.y + i[1].y) / 2, 's': list_concat(v.s, i[1].s)}} ELSE v END)
  ELSE list_concat(s, i) END) AS b FROM g),
u AS (SELECT doc, page, unnest(range(1, len(b) + 1)) AS bucket, unnest(b) AS v FROM f),
w AS (SELECT doc, page, bucket, v.y AS bucket_y, unnest(v.s) AS seq FROM u),
own AS (SELECT i.*, bucket, bucket_y, coalesce(container_id, -1) AS container FROM items i JOIN w USING (doc, page, seq) LEFT JOIN assigned USING (doc, page, seq)),
lagged AS (SELECT *, lag(text) OVER k AS pt, lag(x) OVER k AS px, lag(width) OVER k AS pw, lag(font_size) OVER k AS pf FROM own WINDOW k AS (PARTITION BY doc, page, bucket, container ORDER BY x, seq)),
pieces AS (SELECT *, CASE WHEN pt IS NOT NULL AND x - (px + coalesce(pw, length(pt) * pf * 0.5)) > pf * 0.45 THEN concat(' ', text) ELSE text END AS piece FROM lagged),
made AS (SELECT doc, page, bucket, bucket_y, container, {collapse("string_agg(piece, '' ORDER BY x, seq)")} AS text, greatest(max(font_size), 0.0) AS font_size, bool_or(regexp_matches(font_name, {q(T.BOLD)})) AS bold FROM pieces GROUP BY ALL),
based AS (SELECT *, (SELECT coalesce(median(m.font_size), 0.0) FROM made m WHERE m.doc = made.doc AND m.font_size > 0) AS baseline FROM made),
typed AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY round(bucket_y, 3) DESC, container, bucket) AS line_no, CASE WHEN baseline > 0 AND (font_size >= baseline * 1.25 OR (bold AND font_size >= baseline * 1.05 AND length(text) < 120)
  OR (bold AND length(text) < 80 AND regexp_matches(text, {q(T.CAPS_HEADING)}))) THEN 'heading' ELSE 'paragraph' END AS type FROM based WHERE text <> ''),
e AS (SELECT doc, page, line_no, type, text, container AS c FROM typed WHERE NOT {noise('text')}),
l AS (SELECT *, lag(type) OVER k AS pt, lag(text) OVER k AS px, lag(c) OVER k AS pc FROM e WINDOW k AS (PARTITION BY doc, page ORDER BY line_no)),
fresh AS (SELECT *, CASE WHEN type = 'paragraph' AND pt = 'paragraph' AND c = pc AND NOT regexp_matches(px, {q(T.SENTENCE_FINAL)}) AND NOT regexp_matches(text, {q(T.LIST_START)}) THEN 0 ELSE 1 END AS is_new FROM l),
parts AS (SELECT *, sum(is_new) OVER (PARTITION BY doc, page ORDER BY line_no) AS part FROM fresh),
flowed AS (SELECT doc, page, part, arg_min(type, line_no) AS type, {collapse("string_agg(text, ' ' ORDER BY line_no)")} AS text FROM parts GROUP BY doc, page, part),
known AS (SELECT {collapse('p')} AS text, min(translated) AS translated FROM segment_dictionary GROUP BY ALL)
SELECT doc, count(*) AS lines, count(*) FILTER (type = 'heading') AS headings, count(*) FILTER (coalesce(translated, f.text) = f.text) AS unchanged FROM flowed f LEFT JOIN known k ON f.text = k.text GROUP BY doc""",
    "gap_join_items": f"WITH {LINES} SELECT doc, page, line, text FROM texts",
    "line_bbox": f"""WITH {LINES} SELECT doc, page, line, round("left", 6) AS "left", round("right", 6) AS "right", round(bottom, 6) AS bottom, round(top, 6) AS top,
  round(baseline, 6) AS baseline, round(font_size, 6) AS font_size FROM boxes_of_lines""",
    "doc_baseline_median": f"WITH {LINES} SELECT doc, baseline FROM medians",
    "classify_lines": f"""WITH {LINES} SELECT s.doc, s.page, s.line, floor(font_size * 10 + 0.5) / 10 AS size, CASE WHEN baseline > 0 AND (font_size >= baseline * 1.25
  OR (bold AND font_size >= baseline * 1.05 AND length(text) < 120) OR (bold AND length(text) < 80 AND regexp_matches(text, {q(T.CAPS_HEADING)}))) THEN 'heading' ELSE 'paragraph' END AS type
  FROM sizes s JOIN texts t USING (doc, page, line) JOIN medians m ON s.doc = m.doc""",
    "splits_prevented": f"""WITH {ASSIGNED},
own AS (SELECT i.doc, i.page, i.line, a.container_id FROM items i LEFT JOIN assigned a USING (doc, page, seq)),
counts AS (SELECT doc, page, count(*) AS lines, count(DISTINCT line) AS heights FROM (SELECT DISTINCT * FROM own) GROUP BY doc, page)
SELECT doc, CAST(sum(greatest(0, lines - heights)) AS BIGINT) AS splits FROM counts GROUP BY doc""",
    "next_line_floor": f"WITH {LINES}, {NEXT} SELECT doc, page, line, round(next_top, 6) AS next_top FROM floors",
    "reflow_paragraphs": REFLOW + "SELECT doc, page, part, type, text, container_id FROM reflowed",
    "compact_pages": REFLOW + """SELECT doc, page, count(CASE WHEN type = 'heading' THEN 1 END) AS headings, count(CASE WHEN type <> 'heading' THEN 1 END) AS paragraphs, count(container_id) AS in_containers
FROM reflowed GROUP BY doc, page""",
    "greedy_wrap": """
WITH w AS (SELECT line_id, list_transform(list_filter(regexp_split_to_array(coalesce(h, p, ''), '[\\s\\x{0B}\\x{A0}]+'), lambda x: x <> ''), lambda x: [x]) AS a FROM page_lines),
f AS (SELECT line_id, CASE WHEN len(a) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_reduce(a, lambda s, x: CASE WHEN length(concat(s[-1], ' ', x[1])) <= 60
  THEN list_concat(s[1:len(s) - 1], [concat(s[-1], ' ', x[1])]) ELSE list_concat(s, x) END) END AS lines FROM w)
SELECT line_id, CAST(len(lines) AS BIGINT) AS n, array_to_string(lines, '/') AS wrapped FROM f""",
    "fit_single_line": FIT + "SELECT doc, page, line, decision, fit_size FROM planned",
    "fit_plan": FIT_PLAN + """SELECT doc, page, line, decision, size, CAST(len(lines) AS BIGINT) AS n, array_to_string(lines, '/') AS drawn, round("left" - 0.5, 4) AS cover_x,
  round(top - len(lines) * size * 1.15 - 0.5, 4) AS cover_y, round(greatest("right" - "left", coalesce(list_max(list_transform(lines, lambda x: length(x))), 0) * size * 0.5) + 1.0, 4) AS cover_width,
  round(len(lines) * size * 1.15 + 1.0, 4) AS cover_height, round("left", 4) AS draw_x, round(top - size * 0.8, 4) AS draw_y FROM plans""",
    "fit_histogram": FIT_PLAN + """SELECT doc, count(*) FILTER (decision = 'fit-original') AS fit_original, count(*) FILTER (decision = 'wrap-fit') AS wrap_fit, count(*) FILTER (decision = 'fit-shrunk') AS fit_shrunk,
  count(*) FILTER (decision = 'truncated') AS truncated, count(*) FILTER (decision = 'no-room') AS no_room, count(*) FILTER (decision <> 'no-room') AS overlays, count(*) FILTER (decision = 'no-room') AS skipped FROM plans GROUP BY doc""",
    "reflow_boxes": f"""
WITH e AS (SELECT doc, page, pos, CASE WHEN h IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS type, text, c FROM {d(B.SOURCE)} s WHERE NOT {noise('text')}),
l AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px, lag(c) OVER w AS pc FROM e WINDOW w AS (PARTITION BY doc, page ORDER BY pos)),
f AS (SELECT *, CASE WHEN type = 'paragraph' AND pt = 'paragraph' AND c IS NOT DISTINCT FROM pc AND NOT regexp_matches(px, {q(T.SENTENCE_FINAL)}) AND NOT regexp_matches(text, {q(T.LIST_START)}) THEN 0 ELSE 1 END AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY pos) AS part FROM f)
SELECT doc, page, CAST(part AS BIGINT) AS part, count(*) AS lines, page * 1.0::DOUBLE AS "left", max(page + length(text) * 1.0::DOUBLE) AS "right", min(-pos * 10.0::DOUBLE) AS bottom, max(8.0::DOUBLE - pos * 10.0::DOUBLE) AS top FROM g GROUP BY doc, page, part""",
    "cluster_by_column": f"WITH {COLUMNS} SELECT curriculum, index, col, nodes, has_pending, all_passed FROM numbered",
    "current_term": f"""WITH {COLUMNS},
ready AS (SELECT *, coalesce(bool_and(all_passed) OVER (PARTITION BY curriculum ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fine FROM numbered),
firsts AS (SELECT *, row_number() OVER (PARTITION BY curriculum ORDER BY index) AS nth FROM ready WHERE fine AND has_pending)
SELECT curriculum, col, nodes FROM firsts WHERE nth = 1""",
    "dedupe_keep_first": """
WITH k AS (SELECT node_id, course_code, title, row_number() OVER (PARTITION BY concat(upper(coalesce(course_code, '')), '||', coalesce(regexp_replace(href, '/[0-9]+\\z', ''), ''), '||', coalesce(title, '')) ORDER BY node_id) AS nth FROM course_nodes)
SELECT node_id, course_code, title FROM k WHERE nth = 1""",
    "latest_run": f"SELECT module_key, ordinal, status FROM {REC}",
    "module_file_base": f"""
WITH o AS (SELECT module_key, title, row_number() OVER (PARTITION BY course ORDER BY ordinal, module_key) AS nth FROM {REC})
SELECT module_key, concat(CASE WHEN nth < 10 THEN concat('0', nth) ELSE CAST(nth AS VARCHAR) END, '-', {safe('title', 120, 'untitled')}) AS file_base FROM o""",
    "pick_courses": """
WITH c AS (SELECT course_code, row_number() OVER (ORDER BY course_code) AS ordinal FROM (SELECT DISTINCT course_code FROM course_nodes WHERE course_code IS NOT NULL)),
hit AS (SELECT * FROM c WHERE ordinal IN (1, 3, 999))
SELECT * FROM hit UNION ALL SELECT course_code, NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM hit)""",
    "priority_asset_pick": f"""
WITH r AS (SELECT course, asset_url, row_number() OVER (PARTITION BY course ORDER BY asset_url IS NULL OR asset_url = '', CASE {kind('asset_url')} WHEN 'pdf' THEN 0 WHEN 'unknown' THEN 2 ELSE 1 END, ordinal, module_key) AS nth FROM {REC})
SELECT course, coalesce(asset_url, '') AS asset_url FROM r WHERE nth = 1""",
    "cookie_url_theta_join": f"""
SELECT url, coalesce(string_agg(concat(c.name, '=', c.value), '; ' ORDER BY c.cookie_no), '') AS header FROM {d(B.REQUESTS)} r LEFT JOIN {d(B.COOKIES)} c ON {COOKIE_FITS} GROUP BY url""",
    "session_alive": f"""
WITH hosts AS (SELECT DISTINCT {HOST} AS host FROM {d(B.REQUESTS)})
SELECT host, bool_or(c.cookie_no IS NOT NULL) AS alive FROM hosts LEFT JOIN {d(B.COOKIES)} c
  ON (c.expires <= 0 OR c.expires >= 1700000000) AND regexp_matches(c.name, {q(U.SESSION)}) AND (host = regexp_replace(lower(c.domain), '^\\.', '') OR host LIKE '%.' || regexp_replace(lower(c.domain), '^\\.', '')) GROUP BY host""",
    "netscape_lines": f"""
SELECT CAST(cookie_no AS BIGINT) AS cookie_no, concat_ws(chr(9), CASE WHEN domain LIKE '.%' THEN domain ELSE '.' || domain END, 'TRUE', path, CASE WHEN secure THEN 'TRUE' ELSE 'FALSE' END,
  CAST(greatest(expires, 0) AS VARCHAR), name, value) AS line FROM {d(B.COOKIES)}""",
    "header_overlay": f"""
WITH k AS (SELECT url, coalesce(string_agg(concat(c.name, '=', c.value), '; ' ORDER BY c.cookie_no), '') AS header FROM {d(B.REQUESTS)} r LEFT JOIN {d(B.COOKIES)} c ON {COOKIE_FITS} GROUP BY url)
SELECT url, concat('accept:', CASE WHEN {kind('url')} = 'pdf' THEN 'application/pdf' ELSE '*/*' END, CASE WHEN header <> '' THEN concat('|cookie:', header) ELSE '' END, '|lang:tl|mode:cors') AS headers FROM k""",
    "segment_dictionary_join": f"""
WITH s AS (SELECT {collapse('p')} AS k, min(translated) AS translated FROM segment_dictionary GROUP BY ALL), l AS (SELECT line_id, {collapse("coalesce(h, p, '')")} AS k FROM page_lines)
SELECT line_id, coalesce(translated, k) AS translated FROM l LEFT JOIN s USING (k)""",
    "translation_fallback_join": B.keyed_duck(f"""
SELECT s.doc, s.page, s.pos, coalesce(t.h, t.p, s.text) AS kept, coalesce(nullif(coalesce(t.h, t.p), ''), s.text) AS filled FROM {PAIRED} s LEFT JOIN {TRN} t ON s.doc = t.doc AND s.page = t.page AND s.pos = t.pos"""),
    "overlay_page_join": B.keyed_duck(f"""WITH {COUNTS}
SELECT sc.doc, CAST(sum(CASE WHEN tc.doc IS NULL THEN 0 ELSE least(source_lines, translated_lines) END) AS BIGINT) AS overlaid, CAST(sum(CASE WHEN tc.doc IS NULL THEN source_lines ELSE 0 END) AS BIGINT) AS skipped
FROM sc LEFT JOIN tc ON sc.doc = tc.doc AND sc.page = tc.page GROUP BY sc.doc"""),
    "line_zip_join": B.keyed_duck(f"""
SELECT s.doc, s.page, s.pos, s.text AS source_text, t.text AS translated_text FROM {PAIRED} s JOIN {TRN} t ON s.doc = t.doc AND s.page = t.page AND s.pos = t.pos WHERE t.text <> ''"""),
    "page_drift": B.keyed_duck(f"WITH {COUNTS} SELECT doc, page, source_lines, translated_lines FROM drift"),
    "check_report": B.keyed_duck(f"""WITH {COUNTS},
s AS (SELECT doc, count(*) AS source_lines, count(DISTINCT page) AS source_pages, count(c) AS in_containers FROM {PAIRED} GROUP BY doc),
t AS (SELECT doc, count(*) AS translated_lines, count(DISTINCT page) AS translated_pages FROM {TRN} GROUP BY doc),
p AS (SELECT doc, count(*) AS drift_pages FROM drift GROUP BY doc)
SELECT s.doc, s.source_lines, coalesce(t.translated_lines, 0) AS translated_lines, s.source_lines - coalesce(t.translated_lines, 0) AS drift, in_containers,
  floor(in_containers * 1000.0 / s.source_lines + 0.5) / 10 AS in_containers_pct, source_pages, coalesce(translated_pages, 0) AS translated_pages, coalesce(drift_pages, 0) AS drift_pages
FROM s LEFT JOIN t USING (doc) LEFT JOIN p USING (doc)"""),
    "shape_validation": B.keyed_duck(f"""
WITH s AS (SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY page) AS page_pos, pos, key FROM {PAIRED}), t AS (SELECT doc, dense_rank() OVER (PARTITION BY doc ORDER BY page) AS page_pos, pos, key FROM {TRN}),
b AS (SELECT coalesce(s.doc, t.doc) AS doc, s.doc IS NOT NULL AND t.doc IS NOT NULL AND s.key IS NOT DISTINCT FROM t.key AS fine FROM s FULL JOIN t ON s.doc = t.doc AND s.page_pos = t.page_pos AND s.pos = t.pos)
SELECT doc, bool_and(fine) AS valid FROM b WHERE doc IN (SELECT doc FROM s) GROUP BY doc"""),
    "cache_validation": B.keyed_duck(f"""WITH {COUNTS},
s AS (SELECT doc, count(DISTINCT page) AS sp FROM {PAIRED} GROUP BY doc), t AS (SELECT doc, count(DISTINCT page) AS tp FROM {TRN} GROUP BY doc), f AS (SELECT doc, min(page) AS first_drift FROM drift GROUP BY doc)
SELECT doc, CASE WHEN json_path IS NULL THEN 'source unreadable' WHEN translated_path IS NULL THEN 'cached unreadable' WHEN source_schema <> cached_schema THEN concat('schema ', cached_schema, ' != ', source_schema)
  WHEN tp <> sp THEN concat('page count ', tp, ' != ', sp) WHEN first_drift IS NOT NULL THEN concat('page ', first_drift, ' lines differ') ELSE 'valid' END AS reason
FROM s JOIN t USING (doc) LEFT JOIN f USING (doc) LEFT JOIN {d(B.FACTS)} m ON m.module_key = CAST(split_part(doc, ':', 1) AS BIGINT)"""),
    "json_parse_ladder": f"""
WITH r AS (SELECT event_id, trim(raw) AS x, regexp_extract(trim(raw), '(?is)```(?:json)?\\s*(.*?)\\s*```', 1) AS f, trim(regexp_replace(regexp_replace(raw, '(?i)\\A```(?:json)?\\s*', ''), '\\s*```\\z', '')) AS c FROM {d(B.REPLIES)}),
g AS (SELECT *, regexp_extract(c, '(?s)\\{{.*\\}}') AS g, CASE WHEN json_valid(x) AND json_type(x) = 'OBJECT' THEN x WHEN json_valid(f) AND json_type(f) = 'OBJECT' THEN f END AS o FROM r)
SELECT event_id, o IS NOT NULL AS object, json_valid(c) OR (g <> '' AND json_valid(g)) AS lenient, array_to_string(list_sort(json_keys(o)), ',') AS keys FROM g""",
    "translate_status": f"""
SELECT module_key, CASE WHEN json_path IS NULL THEN 'no-source' WHEN cached AND module_key % 3 <> 0 THEN 'translated' WHEN translate_status = 'translated' THEN 'translated'
  WHEN translate_status = 'pending' THEN 'pending' WHEN translate_status = 'skipped' THEN 'skipped' WHEN cached THEN 'translated' ELSE 'failed' END AS status
FROM (SELECT *, translated_path IS NOT NULL AND module_key % 2 = 0 AS cached FROM {REC})""",
    "backend_outcomes": f"""
WITH p AS (SELECT page_doc_id, coalesce(len(pages), 0) AS n, json_path, x.path IS NOT NULL AS there, coalesce(x.broken, FALSE) AS broken FROM page_docs t LEFT JOIN {REC} r ON t.module_key = r.module_key
  LEFT JOIN (SELECT regexp_replace(json_path, '^(.*?)(\\.[^./]*)?\\z', '\\1.tl\\2') AS path, bool_and(translate_reason IS NOT NULL) AS broken FROM {REC} WHERE translated_path IS NOT NULL AND json_path IS NOT NULL GROUP BY ALL) x
  ON x.path = regexp_replace(json_path, '^(.*?)(\\.[^./]*)?\\z', '\\1.tl\\2'))
SELECT page_doc_id, 'identity' AS backend, 'skipped' AS status FROM p
UNION ALL SELECT page_doc_id, 'manual', CASE WHEN json_path IS NULL THEN 'failed' WHEN NOT there THEN 'pending' WHEN broken THEN 'failed' ELSE 'translated' END FROM p
UNION ALL SELECT page_doc_id, 'callable', CASE WHEN n % 4 IN (2, 3) THEN 'translated' ELSE 'failed' END FROM p""",
    "page_map_fallback": f"""
WITH l AS (SELECT doc, page, count(*) AS n, row_number() OVER (PARTITION BY doc ORDER BY format('PAGE {{:04d}}', page)) AS k, count(*) OVER (PARTITION BY doc) AS many FROM {SRC} GROUP BY doc, page)
SELECT doc, string_agg(concat(format('PAGE {{:04d}}', page), '=', CASE WHEN many % 3 = 0 THEN concat('[text ', n, ']') WHEN k = 1 THEN concat('text ', n) ELSE concat('TEXT ', n) END), '|' ORDER BY k) AS pages FROM l GROUP BY doc""",
    "download_status": f"""
WITH u AS (SELECT module_key, error, asset_url AS url FROM {REC}), v AS (SELECT module_key, error, coalesce(nullif({RESOLVED}, ''), url, '') AS best FROM u)
SELECT module_key, CASE WHEN best = '' OR {kind('best')} = 'unknown' THEN 'no-asset-url' WHEN error IS NOT NULL THEN 'download-failed' ELSE 'ok' END AS status FROM v""",
    "pending_anti_join": f"SELECT module_key, json_path FROM {REC} WHERE json_path IS NOT NULL AND module_key NOT IN (SELECT module_key FROM translated_lines WHERE module_key IS NOT NULL)",
    "artifact_semi_join": f"SELECT module_key, cached_path FROM {REC} WHERE module_key IN (SELECT module_key FROM page_docs)",
    "tiered_relation_pick": f"""
WITH t AS (SELECT module_key, 0 AS tier FROM {REC} WHERE render_status = 'pdf-ready' UNION ALL SELECT module_key, 1 FROM {REC} WHERE translate_status = 'translated'
  UNION ALL SELECT module_key, 2 FROM {REC} WHERE json_path IS NOT NULL UNION ALL SELECT module_key, 3 FROM {REC})
SELECT module_key, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""",
    "verify_rollup": f"""
WITH b AS (SELECT course, count(*) AS modules, {has('cached_path')} AS pdfs, {has('json_path')} AS jsons, {has('translated_path')} AS translated FROM {REC} GROUP BY course),
o AS (SELECT *, pdfs >= modules AND jsons >= pdfs AS ok FROM b)
SELECT * FROM o UNION ALL SELECT NULL, CAST(sum(modules) AS BIGINT), CAST(sum(pdfs) AS BIGINT), CAST(sum(jsons) AS BIGINT), CAST(sum(translated) AS BIGINT), bool_and(ok) FROM o""",
    "relative_paths": f"SELECT module_key, {relative('cached_path')} AS pdf, {relative('json_path')} AS json FROM {REC}",
    "manifest_records": f"""
SELECT course, module_key, concat('{{', concat_ws(',', CASE WHEN title <> '' THEN concat('"title":', to_json(title)) END, CASE WHEN coalesce(status, 'unknown') <> '' THEN concat('"status":', to_json(coalesce(status, 'unknown'))) END,
  CASE WHEN {relative('cached_path')} <> '' THEN concat('"pdf":', to_json({relative('cached_path')})) END, CASE WHEN {relative('json_path')} <> '' THEN concat('"json":', to_json({relative('json_path')})) END,
  CASE WHEN page_count IS NOT NULL THEN concat('"pages":', page_count) END, CASE WHEN error <> '' THEN concat('"error":', to_json(error)) END), '}}') AS record FROM {REC}""",
    "extract_status": f"SELECT module_key, CASE WHEN cached_path IS NULL OR coalesce(ext, '') <> 'pdf' THEN coalesce(status, 'no-pdf') ELSE 'extracted' END AS status FROM {REC}",
    "log_tally": f"SELECT count(CASE WHEN error IS NULL THEN 1 END) AS ok, count(error) AS failed FROM {REC} WHERE file_base IS NOT NULL",
    "prune_unkept": f"SELECT DISTINCT coalesce(ext, 'none') AS name FROM {REC} WHERE coalesce(ext, 'none') NOT IN ('pdf', 'json')",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
