"""Operators on markup held in a column."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from deckweave.functions import text as T

HEADING = "(?is)<h[1-3][^>]*>.*?</h[1-3]>"
UNSEEN = "(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>"
TOKEN = "<[^>]*>|[^<]+"


def segments(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds pos, raw and normalized: one row for each text between tags, but for blanks and bare punctuation."""
    out = pages.select("*", F.posexplode(F.regexp_extract_all(html, F.lit(">([^<]+)<"), 1)).alias("pos", "raw"))
    out = out.withColumn("normalized", T.collapse(F.col("raw")))
    return out.where((F.col("normalized") != "") & ~F.col("normalized").rlike(T.ONLY_PUNCTUATION))


def sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, section_no, text): the text before the first heading if there is any, then each heading with what follows it."""
    cleaned = F.regexp_replace(html, UNSEEN, "")
    own = pages.select(key, F.regexp_extract_all(cleaned, F.lit(HEADING), 0).alias("heads"), F.split(cleaned, HEADING).alias("bodies"))
    parts = own.select(key, F.size("heads").alias("n"), F.posexplode(F.expr("transform(bodies, (b, i) -> struct(if(i = 0, '', heads[i - 1]) AS head, b AS body))")).alias("i", "part"))
    parts = parts.select(key, "n", "i", T.strip_tags(F.col("part.head")).alias("head"), T.strip_tags(F.col("part.body")).alias("body"))
    parts = parts.withColumn("text", F.when((F.col("head") != "") & (F.col("body") != ""), F.concat_ws("\n", "head", "body")).otherwise(F.concat("head", "body")))
    parts = parts.where("i > 0 OR n = 0 OR text <> ''").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("all"))
    return parts.select(key, F.posexplode("all").alias("at", "part")).select(key, (F.col("at") + 1).alias("section_no"), F.col("part.text").alias("text"))


def page_map(sections_: DataFrame, key: str) -> DataFrame:
    """(key, pages): a map from "PAGE n" to the section's text, in their order."""
    entry = F.struct(F.col("section_no"), F.concat(F.lit("PAGE "), F.col("section_no")).alias("name"), F.col("text"))
    own = sections_.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("all"))
    return own.select(key, F.map_from_entries(F.expr("transform(all, x -> struct(x.name, x.text))")).alias("pages"))


def translate_markup(html: Column, translate) -> Column:
    """Markup with each text between tags put through ``translate`` (Column to Column), its outer white space kept."""
    tokens = F.regexp_extract_all(html, F.lit(TOKEN), 0)
    last = F.size(tokens) - 1

    def one(token: Column, i: Column) -> Column:
        normal = T.collapse(token)
        keep = token.startswith("<") | (i == 0) | (i == last) | (normal == "") | normal.rlike(T.ONLY_PUNCTUATION)
        before, after = F.regexp_extract(token, f"^{T.SPACE}*", 0), F.regexp_extract(token, f"{T.SPACE}*\\z", 0)
        return F.when(keep, token).otherwise(F.concat(before, translate(normal), after))

    return F.array_join(F.transform(tokens, one), "")


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds pos and href of each link; a page without links keeps one row with nulls."""
    return pages.select("*", F.posexplode_outer(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))


class _Tree(HTMLParser):
    """Flat list of elements with their attributes, ancestors and text, enough for a few selectors on broken markup."""

    EMPTY = {"br", "img", "input", "meta", "link", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}  # noqa: RUF012

    # Open elements that a start tag closes, and elements it doesn't look beyond.
    CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead"}, "button": {"button"}, "option": {"option"}}  # noqa: RUF012
    BOUNDS = {"ul", "ol", "table", "body", "html"}  # noqa: RUF012

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.stack: list[int] = []
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        ends = self.CLOSES.get(tag, set())
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.nodes[self.stack[k]]["tag"]
            if not ends or name in self.BOUNDS:
                break
            if name in ends:
                del self.stack[k:]
        self.nodes.append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "above": tuple(self.stack), "text": []})
        if tag not in self.EMPTY:
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[k]]["tag"] == tag:
                del self.stack[k:]
                return

    def handle_data(self, data):
        for k in self.stack:
            self.nodes[k]["text"].append(data)

    def has(self, k: int, *names: str) -> bool:
        return set(names) <= set(self.nodes[k]["attrs"].get("class", "").split())

    def text(self, k: int) -> str:
        return "".join(self.nodes[k]["text"])

    def under(self, k: int) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if k in n["above"]]


def course_cards(html: str) -> list[dict]:
    """Cards of a course table: their cell's column, their row over all tables, code, description, department and badge text."""
    tree, out, row = _Tree(html), [], -1
    for k, node in enumerate(tree.nodes):
        if node["tag"] != "tr" or not any(tree.nodes[a]["tag"] == "tbody" for a in node["above"]):
            continue
        row += 1
        cells = [i for i in tree.under(k) if tree.nodes[i]["tag"] == "td" and tree.nodes[i]["above"][-1] == k]
        for column, cell in enumerate(cells):
            for i in tree.under(cell):
                own = tree.nodes[i]
                if own["tag"] == "button" and tree.has(i, "card-course"):
                    badge = "".join(tree.text(b) for b in tree.under(i) if tree.has(b, "badge"))
                    out.append({"col": column, "row_no": row, "code": own["attrs"].get("course", ""), "label": tree.text(i), "description": own["attrs"].get("description", "").strip(), "department": own["attrs"].get("department", "").upper(), "badge": badge})
    return out


def module_rows(html: str) -> list[dict]:
    """Rows of a module list with their attributes and title."""
    tree, out = _Tree(html), []
    for k, node in enumerate(tree.nodes):
        a = node["attrs"]
        if node["tag"] == "li" and a.get("data-role") == "MBG-LINE":
            inner = tree.under(k)
            titles = [tree.text(i) for i in inner if tree.has(i, "module-title")] or [tree.text(i) for i in inner if tree.nodes[i]["tag"] == "a" and tree.has(i, "MBG-COURSE-HEADING-MODAL")]
            title = (titles[0] if titles else "") or tree.text(k)
            out.append({"title": " ".join(title.split()), "module_id": a.get("module-id", "").strip(), "course_id": a.get("course-id", "").strip(), "module_data_id": a.get("data-module", "").strip(), "status": a.get("data-status", "").strip().lower(), "row_course": a.get("data-course", "").strip().upper()})
    return out


def asset_addresses(html: str) -> list[str]:
    """Distinct addresses in the open module body, else in whatever is open, else anywhere."""
    tree = _Tree(html)
    everything = range(len(tree.nodes))
    for names in (("module-body", "collapse", "show"), ("collapse", "show")):
        scopes = [k for k in everything if tree.has(k, *names)]
        if scopes:
            inside = [i for i in everything if set(tree.nodes[i]["above"]) & set(scopes)]
            break
    else:
        inside = list(everything)
    return list(dict.fromkeys(v for i in inside if (v := tree.nodes[i]["attrs"].get("endpoint-url", "").strip())))


_CARD = "array<struct<col:int,row_no:int,code:string,label:string,description:string,department:string,badge:string>>"
_ROW = "array<struct<title:string,module_id:string,course_id:string,module_data_id:string,status:string,row_course:string>>"


def _parsed(pages: DataFrame, html: str, parse, shape: str) -> DataFrame:
    """Adds the column ``parsed``; markup goes to the parser in Arrow batches, the other columns pass by untouched.  Null markup parses to an empty list."""
    names = pages.columns
    at, kind = names.index(html), to_arrow_type(_parse_datatype_string(shape))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x) if x else [] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*names, "parsed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(work, f"{fields}, parsed {shape}")


def extract_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Course nodes of each page; cards without a code anywhere are dropped."""
    own = _parsed(pages, html, course_cards, _CARD).select(*[c for c in pages.columns if c != html], F.explode("parsed").alias("card")).select("*", "card.*").drop("card")
    own = own.withColumn("code", F.upper(T.or_else(F.col("code"), T.course_code(F.col("label")))))
    own = own.where("code IS NOT NULL").withColumn("status", T.badge(F.col("badge")))
    return own.withColumn("title", F.when(F.col("department") != "", F.concat_ws(" ", "department", "code")).otherwise(F.col("code"))).drop("label", "badge")


def extract_modules(pages: DataFrame, html: str = "html", course: str | None = None, strict: bool = True) -> DataFrame:
    """Module links of each page: with a title and both ids, of the page's course where both name one, and in strict mode with an open status."""
    own = _parsed(pages, html, module_rows, _ROW).select(*[c for c in pages.columns if c != html], F.explode("parsed").alias("row")).select("*", "row.*").drop("row")
    own = own.where("title <> '' AND module_id <> '' AND course_id <> ''")
    if course:
        wanted = F.upper(F.coalesce(F.col(course), F.lit("")))
        own = own.where((wanted == "") | (F.col("row_course") == "") | (wanted == F.col("row_course")))
    return own.where(F.col("status").isin("", "active", "pending", "current")) if strict else own


def extract_assets(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds urls, the distinct asset addresses in scope."""
    return _parsed(pages, html, asset_addresses, "array<string>").withColumnRenamed("parsed", "urls")
