"""The queries of the core, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from deckweave.functions import text as T
from deckweave.functions import urls as U
from deckweave.operators import align, audit, catalog, documents, fit, html, layout, reports, translate
from deckweave.plans import bindings as B
from deckweave.plans import pipeline
from deckweave.sources import sinks
from deckweave.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = 1_700_000_000
LINE = ["doc", "page", "line"]
WRAP_AT = 60


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def paired(f: Query) -> Query:
    """A query over every translated document with its module's lines, by module_key and tdoc_id."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return B.keyed(f(spark, folder))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return query(run)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def long(name: str):
    return F.col(name).cast("bigint").alias(name)


# Markup


@query
def html_segments(spark, d):
    return html.segments(B.of(spark, d, B.HTML)).select("page_id", long("pos"), "normalized")


@query
def html_segment_counts(spark, d):
    own = html.segments(B.of(spark, d, B.HTML)).groupBy("page_id").agg(F.count("*").alias("segments"), F.countDistinct("normalized").alias("distinct_segments"))
    return own


@query
def strip_tags(spark, d):
    return B.of(spark, d, B.HTML).select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query
def html_sections(spark, d):
    return html.sections(B.of(spark, d, B.HTML), "page_id").select("page_id", long("section_no"), "text")


@query
def page_object_map(spark, d):
    own = html.page_map(html.sections(B.of(spark, d, B.HTML), "page_id"), "page_id")
    return own.select("page_id", F.array_join(F.expr("transform(map_entries(pages), e -> concat(e.key, '=', e.value))"), "|").alias("pages"))


@query
def html_translate_roundtrip(spark, d):
    out = html.translate_markup(F.col("html"), lambda t: F.concat(F.lit("["), t, F.lit("]")))
    return B.of(spark, d, B.HTML).select("page_id", F.md5(out).alias("digest"), F.length(out).cast("bigint").alias("size"))


@query
def lateral_page_links(spark, d):
    own = html.links(B.of(spark, d, B.HTML))
    return own.select("page_id", long("pos"), U.absolute(F.col("href"), F.lit("https://campus.example")).alias("url"))


@query
def course_cards(spark, d):
    """Cards of a course table, parsed from markup made of the catalogue, with cells and a button left open."""
    card = "concat('<table><tbody><tr><td><p>', '<td><button class=\"btn card-course\" course=\"', coalesce(course_code, ''), '\" description=\"', coalesce(replace(description, '\"', ''), ''), '\" department=\"', coalesce(department, ''), '\">', coalesce(title, ''), '<span class=badge>', coalesce(status, ''), '</span></button></table>')"
    pages = table(spark, d, "course_nodes").select("node_id", F.expr(card).alias("html"))
    return html.extract_cards(pages).select("node_id", "col", "row_no", "code", "title", "description", "status")


@query
def strict_relaxed_audit(spark, d):
    """Module links that the strict mode keeps and the relaxed one adds, by course."""
    row = "concat('<li data-role=\"MBG-LINE\" data-course=\"', coalesce(course, ''), '\" data-status=\"', coalesce(translate_status, ''), '\" module-id=\"', module_key, '\" course-id=\"', coalesce(course, ''), '\"><span class=\"module-title\"> ', coalesce(title, ''), ' </span></li>')"
    pages = B.of(spark, d, "{records}").select("course", F.expr(row).alias("html"))
    pages = pages.select(F.upper("course").alias("course"), "html")
    strict = html.extract_modules(pages, course="course").groupBy("course").agg(F.count("*").alias("strict_links"))
    relaxed = html.extract_modules(pages, course="course", strict=False).groupBy("course").agg(F.count("*").alias("relaxed_links"))
    both = strict.join(relaxed, "course", "full_outer")
    return both.select("course", F.coalesce("strict_links", F.lit(0)).cast("bigint").alias("strict_links"), F.coalesce("relaxed_links", F.lit(0)).cast("bigint").alias("relaxed_links"))


@query
def asset_scope(spark, d):
    """Asset addresses in the open module body, else in what is open, else anywhere, from markup made of the modules."""
    pages = B.of(spark, d, B.SCOPES)
    return html.extract_assets(pages).select("module_key", F.array_join("urls", " ").alias("urls"))


# Text


@query
def safe_file_name(spark, d):
    return B.of(spark, d, "{records}").select("module_key", T.safe_name(F.col("title")).alias("name"), T.safe_name(F.col("title"), 100, "module").alias("part"))


@query
def badge_status(spark, d):
    return B.of(spark, d, B.NODES).select("node_id", T.badge(F.col("status")).alias("badge"))


@query
def derive_course_code(spark, d):
    return B.of(spark, d, B.NODES).select("node_id", T.course_code(F.concat_ws(" ", "title", "course_code")).alias("code"))


@query
def sanitize_winansi(spark, d):
    return table(spark, d, "page_lines").select("line_id", T.latin(F.coalesce("h", "p")).alias("text"))


@query
def noise_filter(spark, d):
    return table(spark, d, "page_lines").select("line_id", T.noise(F.coalesce("h", "p")).alias("noise"))


@query
def asset_type(spark, d):
    return B.of(spark, d, B.ASSETS).select("module_key", U.asset_type(F.col("url")).alias("kind"))


@query
def asset_url_resolve(spark, d):
    return B.of(spark, d, B.ASSETS).select("module_key", U.asset_url(F.col("url")).alias("resolved"))


@query
def fetch_urls(spark, d):
    return B.of(spark, d, "{records}").select("module_key", U.map_url("https://campus.example", F.col("course"), F.col("title")).alias("url"))



@query
def translated_path(spark, d):
    return B.of(spark, d, "{records}").where("json_path IS NOT NULL").select("module_key", translate.translated_path(F.col("json_path"), "tl").alias("expected"))


@query
def slide_headers(spark, d):
    lines = B.of(spark, d, B.SOURCE).groupBy("doc", "page").agg(F.max(F.when(F.col("text") != "", "text")).alias("text"))
    own = lines.join(B.of(spark, d, "{records}").select(F.col("module_key").alias("doc"), "title"), "doc")
    return own.select("doc", "page", reports.slide_header(F.col("title"), F.col("page")).alias("header"), reports.slide_body(F.col("text")).alias("body"))



# Layout


@query
def container_depth(spark, d):
    own = layout.container_depth(layout.containers(B.of(spark, d, B.BOXES), 900.0 * 900.0))
    return own.select("doc", "page", "seq", long("container_id"), long("depth"))


@query
def item_container_argmin(spark, d):
    held = layout.containers(B.of(spark, d, B.BOXES), 900.0 * 900.0)
    own = layout.assign_containers(B.of(spark, d, B.ITEMS), held).where("container_id IS NOT NULL")
    return own.select("doc", "page", "seq", long("container_id"))


@query
def y_bucket_fold(spark, d):
    own = layout.y_buckets(B.of(spark, d, B.ITEMS))
    return own.groupBy("doc", "page", "bucket").agg(F.count("*").alias("n"), F.round(F.max("bucket_y"), 6).alias("bucket_y")).select("doc", "page", long("bucket"), "n", "bucket_y")


@query
def gap_join_items(spark, d):
    return layout.joined_text(B.of(spark, d, B.ITEMS), LINE)


@query
def line_bbox(spark, d):
    own = layout.line_boxes(B.of(spark, d, B.ITEMS), LINE)
    return own.select(*LINE, *(F.round(c, 6).alias(c) for c in ("left", "right", "bottom", "top", "baseline", "font_size")))


@query
def doc_baseline_median(spark, d):
    return layout.baselines(layout.line_sizes(B.of(spark, d, B.ITEMS), LINE))


@query
def classify_lines(spark, d):
    own = layout.lines_of(B.of(spark, d, B.ITEMS), LINE)
    own = own.join(layout.baselines(own), "doc")
    kind = layout.heading_rule(F.col("font_size"), F.col("bold"), F.col("text"), F.col("baseline"))
    return own.select(*LINE, kind.alias("type"), (F.floor(F.col("font_size") * 10 + 0.5) / 10).alias("size"))


@query
def splits_prevented(spark, d):
    items = B.of(spark, d, B.ITEMS)
    own = layout.assign_containers(items, layout.containers(B.of(spark, d, B.BOXES), 900.0 * 900.0))
    lines = own.select("doc", "page", "line", "container_id").distinct()
    return layout.splits_prevented(items, lines)


@query
def next_line_floor(spark, d):
    own = layout.next_top(layout.line_boxes(B.of(spark, d, B.ITEMS), LINE), ["doc", "page"], [F.desc("baseline"), F.desc("line")])
    return own.select(*LINE, F.round("next_top", 6).alias("next_top"))


@query
def reflow_paragraphs(spark, d):
    return _reflowed(spark, d).select("doc", "page", long("part"), "type", "text", "container_id")


def _reflowed(spark, d):
    own = B.of(spark, d, B.SOURCE).select("doc", "page", "pos", F.when(F.col("h").isNotNull(), "heading").otherwise("paragraph").alias("type"), "text", F.col("c").alias("container_id"))
    return layout.reflow(layout.without_noise(own), ["doc", "page"], ["pos"])


@query
def compact_pages(spark, d):
    own = layout.compact(_reflowed(spark, d), ["doc", "page"], "part")
    size = lambda p: F.size(F.filter("lines", p)).cast("bigint")
    return own.select("doc", "page", size(lambda x: x["h"].isNotNull()).alias("headings"), size(lambda x: x["p"].isNotNull()).alias("paragraphs"), size(lambda x: x["c"].isNotNull()).alias("in_containers"))


@query
def json_roundtrip(spark, d):
    """What each page document's JSON holds when it is read again: pages, lines and characters."""
    own = table(spark, d, "page_docs").select("page_doc_id", "pages")
    shape = own.schema["pages"].dataType
    back = own.select("page_doc_id", F.from_json(sinks.as_json(F.struct("pages")), StructType([StructField("pages", shape)]))["pages"].alias("pages"))
    lines = F.flatten(F.transform("pages", lambda x: F.coalesce(x["lines"], F.lit(None).cast(shape.elementType["lines"].dataType), F.array().cast(shape.elementType["lines"].dataType))))
    chars = lambda c: F.aggregate(F.transform(lines, lambda x: F.coalesce(F.length(x[c]), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return back.select("page_doc_id", *(F.coalesce(x, F.lit(0)).cast("bigint").alias(n) for n, x in {"pages": F.size("pages"), "lines": F.size(lines), "heading_chars": chars("h"), "paragraph_chars": chars("p")}.items()))


@query
def json_sizes(spark, d):
    """Bytes of each page document's JSON (no SQL: the engines write JSON differently; json_roundtrip compares what is in it)."""
    return sinks.json_sizes(table(spark, d, "page_docs").select("page_doc_id", "pages"), "page_doc_id")


# Fitting


@query
def greedy_wrap(spark, d):
    own = table(spark, d, "page_lines").select("line_id", fit.wrapped(align.line_text(), F.lit(WRAP_AT)).alias("lines"))
    return own.select("line_id", F.size("lines").cast("bigint").alias("n"), F.array_join("lines", "/").alias("wrapped"))


def _fit_input(spark, d):
    own = layout.lines_of(B.of(spark, d, B.ITEMS), LINE, boxes=True)
    return fit.room(layout.next_top(own, ["doc", "page"], [F.desc("baseline"), F.desc("line")]))


@query
def fit_single_line(spark, d):
    return fit.single_line(_fit_input(spark, d)).select(*LINE, "decision", "fit_size")


@query
def fit_plan(spark, d):
    """The whole plan of every line, with the rectangle that covers the old text and where the new one is drawn."""
    own = fit.drawn(fit.plan_fit(_fit_input(spark, d), [*LINE, "left", "right", "room_left", "room_top"]))
    places = ("cover_x", "cover_y", "cover_width", "cover_height", "draw_x", "draw_y")
    return own.select(*LINE, "decision", "size", F.size("lines").cast("bigint").alias("n"), F.array_join("lines", "/").alias("drawn"), *(F.round(c, 4).alias(c) for c in places))


@query
def reflow_boxes(spark, d):
    """The box round each merged paragraph's lines and how many there are; each line's box is made of its place."""
    at = F.col("pos") * 10.0
    box = F.struct((F.col("page") * 1.0).alias("left"), (F.col("page") + F.length("text") * 1.0).alias("right"), (-at).alias("bottom"), (8.0 - at).alias("top"))
    own = B.of(spark, d, B.SOURCE).select("doc", "page", "pos", F.when(F.col("h").isNotNull(), "heading").otherwise("paragraph").alias("type"), "text", F.col("c").alias("container_id"), F.array(box).alias("boxes"))
    own = layout.reflow(layout.without_noise(own), ["doc", "page"], ["pos"]).withColumn("round", layout.union_box())
    return own.select("doc", "page", long("part"), F.size("boxes").cast("bigint").alias("lines"), "round.left", "round.right", "round.bottom", "round.top")


@query
def fit_histogram(spark, d):
    """All five decisions of the whole plan by document, with overlays and skipped."""
    return fit.tally(fit_plan(spark, d), ["doc"])


# Catalogue


@query
def cluster_by_column(spark, d):
    nodes = B.of(spark, d, B.NODES).withColumn("status", T.badge(F.col("status")))
    own = catalog.cluster_columns(nodes, ["curriculum"])
    return own.select("curriculum", long("index"), "col", "nodes", "has_pending", "all_passed")


@query
def current_term(spark, d):
    nodes = B.of(spark, d, B.NODES).withColumn("status", T.badge(F.col("status")))
    return catalog.current_term(catalog.cluster_columns(nodes, ["curriculum"]), ["curriculum"]).select("curriculum", "col", "nodes")


@query
def dedupe_keep_first(spark, d):
    key = F.concat_ws("||", T.or_else(F.upper("course_code"), F.lit("")), T.or_else(F.col("href"), F.lit("")), T.or_else(F.col("title"), F.lit("")))
    nodes = B.of(spark, d, B.NODES).withColumn("href", F.regexp_replace("href", "/[0-9]+$", ""))
    return catalog.keep_first(nodes, [key], ["node_id"]).select("node_id", "course_code", "title")


@query
def latest_run(spark, d):
    return align.last_wins(table(spark, d, "module_records"), ["module_key"], ["updated_at", -F.col("ordinal")]).select("module_key", "ordinal", "status")



@query
def module_file_base(spark, d):
    own = catalog.ranked(B.of(spark, d, "{records}").select("module_key", "course", "ordinal", "title"), ["course"], ["ordinal", "module_key"], "at")
    return own.select("module_key", catalog.file_base(F.col("at"), F.col("title")).alias("file_base"))



@query
def pick_courses(spark, d):
    own = B.of(spark, d, B.NODES).select("course_code").where("course_code IS NOT NULL").distinct()
    return catalog.chosen(own, "3, 1, x, 3, 999", ["course_code"]).select("course_code", long("ordinal"))


@query
def priority_asset_pick(spark, d):
    return catalog.first_asset(B.of(spark, d, "{records}"), ["course"], "asset_url", ["ordinal", "module_key"])


@query
def cookie_url_theta_join(spark, d):
    return catalog.cookie_headers(B.of(spark, d, B.REQUESTS), B.of(spark, d, B.COOKIES), ["url"], "url", NOW)


@query
def session_alive(spark, d):
    hosts = B.of(spark, d, B.REQUESTS).select(U.host(F.col("url")).alias("host"))
    return catalog.alive_hosts(hosts, B.of(spark, d, B.COOKIES), "host", NOW)



@query
def netscape_lines(spark, d):
    return catalog.netscape_lines(B.of(spark, d, B.COOKIES)).select(long("cookie_no"), "line")


@query
def header_overlay(spark, d):
    """Headers of each request: the base ones, then extra ones, then the request's own with its cookies, the last of a name winning."""
    base = F.create_map(F.lit("accept"), F.lit("*/*"), F.lit("lang"), F.lit("en"))
    extra = F.create_map(F.lit("lang"), F.lit("tl"), F.lit("mode"), F.lit("cors"))
    own = F.when(U.asset_type(F.col("url")) == "pdf", F.create_map(F.lit("accept"), F.lit("application/pdf")))
    cookie = F.when(F.col("header") != "", F.create_map(F.lit("cookie"), F.col("header")))
    asks = catalog.cookie_headers(B.of(spark, d, B.REQUESTS), B.of(spark, d, B.COOKIES), ["url"], "url", NOW)
    return asks.select("url", F.array_join(F.transform(F.map_entries(U.overlaid(base, extra, own, cookie)), lambda e: F.concat_ws(":", e["key"], e["value"])), "|").alias("headers"))



# Source and translation


@query
def segment_dictionary_join(spark, d):
    run = translate.backend("dictionary", entries=table(spark, d, "segment_dictionary"))
    own = table(spark, d, "page_lines").select("line_id", align.line_text().alias("text"))
    return translate.translate_column(own, "text", run).select("line_id", "translated")


@paired
def translation_fallback_join(spark, d):
    a = B.of(spark, d, B.PAIRED_SOURCE).select("doc", "page", "pos", F.col("text").alias("source_text"))
    b = B.of(spark, d, B.TRANSLATED).select("doc", "page", "pos", F.coalesce("h", "p").alias("translated"))
    keys = ["doc", "page", "pos"]
    kept = align.fallback(a, b, keys, True).select(*keys, F.col("text").alias("kept"), "source_text", "translated")
    return kept.select(*keys, "kept", F.coalesce(F.nullif("translated", F.lit("")), "source_text").alias("filled"))


@paired
def overlay_page_join(spark, d):
    return align.overlay_pages(B.of(spark, d, B.PAIRED_SOURCE), B.of(spark, d, B.TRANSLATED), "doc", "page")


@paired
def line_zip_join(spark, d):
    return align.zip_lines(B.of(spark, d, B.PAIRED_SOURCE), B.of(spark, d, B.TRANSLATED), ["doc", "page"])


@paired
def page_drift(spark, d):
    return align.page_drift(B.of(spark, d, B.PAIRED_SOURCE), B.of(spark, d, B.TRANSLATED), "doc", "page")


@paired
def check_report(spark, d):
    return align.check_report(B.of(spark, d, B.PAIRED_SOURCE), B.of(spark, d, B.TRANSLATED), "doc", "page")


@paired
def shape_validation(spark, d):
    def placed(df):
        place = F.dense_rank().over(Window.partitionBy("doc").orderBy("page"))
        return df.withColumn("page_pos", place).select("doc", "page_pos", "pos", "key")

    return align.same_shape(placed(B.of(spark, d, B.PAIRED_SOURCE)), placed(B.of(spark, d, B.TRANSLATED)), "doc")


@paired
def cache_validation(spark, d):
    source, cached = B.of(spark, d, B.PAIRED_SOURCE), B.of(spark, d, B.TRANSLATED)
    a = source.groupBy("doc").agg(F.countDistinct("page").alias("source_pages"))
    b = cached.groupBy("doc").agg(F.countDistinct("page").alias("cached_pages"))
    first = align.page_drift(source, cached, "doc", "page").groupBy("doc").agg(F.min("page").alias("first_drift"))
    own = a.join(b, "doc").join(first, "doc", "left").withColumn("module_key", F.split_part("doc", F.lit(":"), F.lit(1)).cast("bigint"))
    own = own.join(B.of(spark, d, B.FACTS), "module_key", "left")
    facts = {"source_readable": F.col("json_path").isNotNull(), "cached_readable": F.col("translated_path").isNotNull()}
    reason = translate.cache_reason(facts | {c: F.col(c) for c in ("source_schema", "cached_schema", "source_pages", "cached_pages", "first_drift")})
    return own.select("doc", F.coalesce(reason, F.lit("valid")).alias("reason"))


@query
def json_parse_ladder(spark, d):
    """Which replies hold an object and any JSON, and the keys of the object."""
    own = B.of(spark, d, B.REPLIES).withColumns({"obj": translate.reply_object(F.col("raw")), "any": translate.reply_lenient(F.col("raw"))})
    keys = lambda v: F.array_join(F.array_sort(F.json_object_keys(F.to_json(v))), ",")
    return own.select("event_id", F.col("obj").isNotNull().alias("object"), F.col("any").isNotNull().alias("lenient"), keys("obj").alias("keys"))



@query
def translate_status(spark, d):
    own = B.of(spark, d, "{records}")
    reason = F.when(F.col("module_key") % 3 == 0, "stale")
    status = translate.status_of(F.col("json_path").isNotNull(), F.col("translated_path").isNotNull() & (F.col("module_key") % 2 == 0), reason, F.col("translate_status"))
    return own.select("module_key", status.alias("status"))


@query
def backend_outcomes(spark, d):
    """The outcome of each document under three backends; the one that is called answers by the number of pages: nothing, one page too few, in fences, or plainly."""
    own = table(spark, d, "page_docs").select("page_doc_id", "module_key", "meta", "pages")
    records = B.of(spark, d, "{records}").select("module_key", "json_path", "translated_path", "translate_reason")
    placed = own.join(records, "module_key", "left")
    raw = F.when(F.col("translate_reason").isNull(), F.lit('{"pages": []}')).otherwise("{")
    siblings = records.where("translated_path IS NOT NULL").select(translate.translated_path(F.col("json_path"), "tl").alias("path"), raw.alias("raw"))
    by = {
        "identity": documents.identity_documents(own, "page_doc_id"), "manual": documents.manual_documents(placed, siblings, "page_doc_id", "json_path", "tl"),
        "callable": documents.called_documents(own, "page_doc_id", _answer, "tl", attempts=1),
    }
    out = [df.select("page_doc_id", F.lit(name).alias("backend"), "status") for name, df in by.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _answer(prompt: str) -> str:
    import json

    document = json.loads(prompt[prompt.index("{") :])
    pages = document.get("pages") or []
    text = json.dumps({"pages": pages[:-1] if len(pages) % 4 == 1 else pages})
    return ["no answer", text, f"Here:\n```json\n{text}\n```", text][len(pages) % 4]


@query
def page_map_fallback(spark, d):
    """Pages translated by one call a document, or page by page where that call's reply is no JSON."""
    lines = B.of(spark, d, B.SOURCE).groupBy("doc", "page").agg(F.count("*").alias("n"))
    maps = lines.groupBy("doc").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.format_string("PAGE %04d", "page"), F.concat(F.lit("text "), F.col("n").cast("string")))))).alias("pages"))
    out = documents.page_map_translation(maps, "doc", "pages", _answer_pages, "tl", attempts=1)
    return out.select("doc", F.array_join(F.transform(F.map_entries("pages"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("pages"))


def _answer_pages(prompt: str) -> str:
    import json

    if "{" not in prompt:
        return f"[{prompt}]"
    pages = json.loads(prompt[prompt.index("{") :])
    return "no answer" if len(pages) % 3 == 0 else json.dumps({k: v.upper() for k, v in list(pages.items())[1:]})


@query
def download_status(spark, d):
    return B.of(spark, d, "{records}").select("module_key", catalog.download_status(F.col("asset_url"), F.col("error")).alias("status"))


@query
def extract_status(spark, d):
    return B.of(spark, d, "{records}").select("module_key", catalog.extract_status(F.col("cached_path"), F.col("ext"), F.col("status")).alias("status"))



# Audits


@query
def pending_anti_join(spark, d):
    wanted = B.of(spark, d, "{records}").where("json_path IS NOT NULL").select("module_key", "json_path")
    return audit.pending(wanted, table(spark, d, "translated_lines"), "module_key")


@query
def artifact_semi_join(spark, d):
    wanted = B.of(spark, d, "{records}").select("module_key", "cached_path")
    return audit.existing(wanted, table(spark, d, "page_docs"), "module_key")


@query
def tiered_relation_pick(spark, d):
    own = B.of(spark, d, "{records}")
    tiers = [own.where("render_status = 'pdf-ready'"), own.where("translate_status = 'translated'"), own.where("json_path IS NOT NULL"), own]
    return audit.first_tier([t.select("module_key") for t in tiers]).select("module_key", "tier")


@query
def verify_rollup(spark, d):
    return audit.verify(B.of(spark, d, "{records}"), "course")


@query
def relative_paths(spark, d):
    return B.of(spark, d, "{records}").select("module_key", audit.relative(F.col("cached_path"), F.col("course")).alias("pdf"), audit.relative(F.col("json_path"), F.col("course")).alias("json"))


@query
def manifest_records(spark, d):
    own = B.of(spark, d, "{records}")
    fields = {"title": F.col("title"), "status": F.coalesce("status", F.lit("unknown")), "pdf": audit.relative(F.col("cached_path"), F.col("course")), "json": audit.relative(F.col("json_path"), F.col("course")), "pages": F.col("page_count"), "error": F.col("error")}
    return audit.manifest_records(own, ["course", "module_key"], fields)



@query
def log_tally(spark, d):
    line = F.concat(F.when(F.col("error").isNull(), "OK ").otherwise("FAIL "), F.col("file_base"))
    return audit.log_tally(B.of(spark, d, "{records}").select(line.alias("line")))


@query
def prune_unkept(spark, d):
    names = B.of(spark, d, "{records}").select(F.coalesce("ext", F.lit("none")).alias("name")).distinct()
    return audit.unkept(names, ["pdf", "json"])


@query
def pipeline_end_to_end(spark, d):
    """Items to audited, translated pages through the named stages."""
    def extract(tables, options):
        raw = layout.extract(tables["items"], layout.containers(tables["boxes"], 900.0 * 900.0))
        return {"lines": layout.reflow(layout.without_noise(raw), ["doc", "page"], ["line_no"])}

    def translated(tables, options):
        run = translate.backend(options.backend) if options.backend == "identity" else translate.backend("dictionary", entries=tables["dictionary"])
        return {"translated": translate.translate_column(tables["lines"], "text", run)}

    def check(tables, options):
        t = tables["translated"]
        return {"report": t.groupBy("doc").agg(F.count("*").alias("lines"), F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("translated") == F.col("text")).alias("unchanged"))}

    stages = [pipeline.Stage("extract", extract), pipeline.Stage("translate", translated, lambda t, o: not o.translate), pipeline.Stage("check", check)]
    tables = {"items": B.of(spark, d, B.ITEMS), "boxes": B.of(spark, d, B.BOXES), "dictionary": table(spark, d, "segment_dictionary")}
    return pipeline.run_stages(stages, tables, pipeline.Options(translate=True))[0]["report"]
